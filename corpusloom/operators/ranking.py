"""Places in one order of all rows, without one task that sorts them all."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are dealt to, and rows that their bounds are taken from, at most.
RANGES, SAMPLE = 64, 4096


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their places from 1 in the ascending order of columns that can be compared (nulls first). Rows are dealt to ranges
    between bounds from a sample, which are literals then, so that every task deals alike; a row's place is its place in its range
    after the rows of the ranges before, counted by range. The sample decides how even the ranges are, never a place."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = rows.withColumn("__key", key)
    bounds = [r[0] for r in keyed.select("__key").orderBy(F.xxhash64("__key")).limit(SAMPLE).orderBy("__key").collect()]
    cuts = [bounds[len(bounds) * i // RANGES] for i in range(1, RANGES)] if bounds else []
    kind = keyed.schema["__key"].dataType
    if not cuts:
        return rows.withColumn(name, F.lit(1))
    held = rows.sparkSession.createDataFrame([(cuts,)], f"__cuts array<{kind.simpleString()}>")
    dealt = keyed.join(F.broadcast(held)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col("__key")))).drop("__cuts")  # one row of RANGES bounds
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # A row for each range.
    out = dealt.join(F.broadcast(before), F.col("__range") == F.col("__r"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__key")) + F.col("__before")
    return out.withColumn(name, place.cast("int")).drop("__key", "__range", "__r", "__before")
