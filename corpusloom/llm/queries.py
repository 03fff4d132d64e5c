"""One query for each operator, over its whole table, with production parameters."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word window that a document with a smaller id also has are removed."""
    from corpusloom.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 400-byte string that also starts elsewhere are removed."""
    from corpusloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of each document and the verdict of a base rule and an isolation forest."""
    from corpusloom.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host and path, the rule that fits, and the verdict of the rule or of the language models."""
    from corpusloom.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 5-word shingles are similar by 0.75 or more."""
    from corpusloom.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    from corpusloom.llm.spot_signatures import spot_signatures

    return spot_signatures(table(spark, sf_dir, "documents"))


def byte_bpe() -> dict[str, str]:
    """The vocabulary file and pattern of the public byte-level tokenizer."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes that they decode to."""
    from corpusloom.llm.prefix_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), **byte_bpe())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with targets by source takes of each document."""
    from corpusloom.llm.mixing import by_length, mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weight=by_length())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document after a two-pass shuffle."""
    from corpusloom.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from three quarters of the documents."""
    from corpusloom.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level BPE and of a piece BPE line up in each document, and how often linked ids are linked at all."""
    import public_tokenizers

    from corpusloom.llm.token_links import token_links

    return token_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets in each document: patterns, and strings that tests can't tell from random ones."""
    from corpusloom.llm.secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's code by codebooks of sixteen entries for each of eight parts, fitted in six rounds."""
    from corpusloom.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_suffix_dedup, op3_quality_rules, op4_url_filter, op5_jaccard_join, op6_spot_signatures, op7_prefix_bpe, op8_mixing, op9_sharding, op10_language_id, op11_token_links, op12_secret_scan, op13_vector_codes)}
