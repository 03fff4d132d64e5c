"""From raw documents to encoded training data: five stages, each reading what the one before has written.

Quality rules drop documents, near copies leave one of each group, repeated passages are cut out of texts, sources are mixed to
target weights (documents are repeated or left out), and every document of the mix is encoded.

Nulls and ties: a null text has no words and is dropped by the first stage, and so are empty and short ones. A null source is a
source of its own; null ids are never near copies and count as smaller than all others for passages. Rows that share an id are
judged by their own texts; equal rows stay or go together until the mix, which takes a number of them. An empty table, and one
of which no document is kept, gives an empty result. Columns beside doc_id and text are kept as they are up to the mix."""

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.jaccard_join import without_near_copies
from corpusloom.llm.mixing import by_length, mixed
from corpusloom.llm.prefix_bpe import encode_documents
from corpusloom.llm.quality_rules import keep_good
from corpusloom.llm.queries import byte_bpe, table
from corpusloom.llm.scratch import cut, mark, release
from corpusloom.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the isolation forest keep, unchanged. Without labels of both kinds only the base rule
    decides."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.75), the one with the least id, unchanged; rows without an id
    stay, and unlike texts of one id are judged on their own."""
    return without_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 50-word windows that a document with a smaller id has; n_chars follows, and documents of which
    nothing is left stay as empty texts."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice; their rows are not changed."""
    return mixed(docs, weight=by_length())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each row of the mix; an empty text has no tokens."""
    return encode_documents(docs, **byte_bpe())


STAGES = [("quality rules", quality), ("near copies", near_copies), ("repeated passages", passages), ("mixing", mix), ("encoding", encode)]

#: Several stages can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents of a folder. What a stage has read and written on its way is deleted once the next
    stage's input is written."""
    docs, begun = table(spark, sf_dir, "documents"), mark(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            release(spark, begun)
    return docs
