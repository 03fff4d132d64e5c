"""Connected components of a table of links, by alternating star contractions.

Each round points every node's larger neighbours at the node's least neighbour (large star) and its smaller ones likewise
(small star), until nothing changes; the number of rounds is logarithmic in practice. Links never leave the executors. A
node with very many neighbours takes part in a join and a pre-aggregated minimum only, never in a collected list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b")  # no more rows than links; the small star drops repeats
    out = joined.select("b", "m", "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
    return out.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one target and no target has one of its own: then each component is a star."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Of links (a, b): for each node that is linked, (node, component), the least node that it can reach. Self links
    and nulls are ignored; repeated links count once; no links give an empty result."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(rounds):
        links = cut(_star(_star(links, True), False))
        if _settled(links):
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", F.col("b").alias("c"))).distinct()
