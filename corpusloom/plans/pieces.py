"""A registry of pieces made of orders, with its manifests, records and requests, as frames and as common table expressions: orders'
numbers decide what a piece declares, and their dates when it was or will be published."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOW = "1995-06-17 12:00:00"


def _orders(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), F.concat(F.lit("p"), k).alias("slug"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")


def _by(n: int, *values):
    """The value for the remainder of the order's number."""
    out = F.lit(None)
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(F.col("k") % n == i, v).otherwise(out)
    return out


def pieces(spark, d) -> DataFrame:
    """(slug, folder, outlets, published_at, publish_at, former)."""
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    day = F.col("day")
    moment = _by(8, F.concat(day, F.lit(" 09:00 UTC")), F.concat(day, F.lit(" 09:00 America/Bogota")), day, None, F.concat(day, F.lit("T10:00:30+0200")), F.concat(F.lit('"'), day, F.lit(' 23:30 -0300"')), F.concat(day, F.lit(" Z # settled")), F.lit("soon"))
    return _orders(spark, d).select(
        "slug",
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("f"), "k")).otherwise(F.col("slug")).alias("folder"),
        _by(6, names("site", "feed"), names("feed", "site", "feed", "nowhere"), names(), names("pro", "bare"), None, F.array(F.lit("second"), F.col("o_orderstatus"))).alias("outlets"),
        _by(5, None, F.lit(""), day, day, day).alias("published_at"),
        moment.alias("publish_at"),
        _by(3, F.array(F.concat(F.lit("old"), "k"), F.col("slug"), F.lit(" "), F.lit("rag")), None, names()).alias("former"),
    )


def dated(spark, d) -> DataFrame:
    """Pieces with the dates on which they went live on an outlet, where they did."""
    live = F.create_map(_by(4, F.lit("-"), F.lit("feed"), F.lit("bare"), F.lit("feed")), _by(4, F.lit(""), F.col("day"), F.col("day"), F.lit("")))
    own = _orders(spark, d).select("slug", F.when(F.col("k") % 4 > 0, live).alias("published"))
    return pieces(spark, d).join(own, "slug")


def manifests(spark, d) -> DataFrame:
    """(slug, fields): the addresses that pieces record."""
    k, at = F.col("k"), lambda base, end="": F.concat(F.lit(base), "slug", F.lit(end))
    pair = lambda when, field, url: F.when(when, F.struct(F.lit(field).alias("field"), url.alias("url")))
    every = F.array_compact(F.array(
        pair(k % 3 == 0, "site_url", at("https://site.org/p/", "/")), pair(k % 3 != 1, "public_url", at("https://feed.org/p/")), pair(k % 5 == 0, "canonical", at("https://feed.org/p/", "/")), pair(k % 5 == 1, "canonical", F.lit("https://else.org")),
        pair(k % 4 == 0, "pro_url", at("https://pro.org/x/")), pair(k % 7 == 0, "bare_url", F.lit("")), pair(k % 2 == 0, "title", F.col("o_orderstatus")),
    ))
    return _orders(spark, d).select("slug", F.map_from_entries(every).alias("fields"))


def records(spark, d) -> DataFrame:
    """(slug, outlet): schedules that outlets know of."""
    return _orders(spark, d).where("k % 9 IN (0, 4)").select("slug", F.when(F.col("k") % 9 == 0, "feed").otherwise("second").alias("outlet"))


def requests(spark, d) -> DataFrame:
    """(slug, outlet, approved): requests to record a schedule, some for pieces that there are not."""
    return _orders(spark, d).select(F.when(F.col("k") % 50 == 0, F.concat(F.lit("zz"), "k")).otherwise(F.col("slug")).alias("slug"), _by(3, F.lit("feed"), F.lit("site"), F.lit("second")).alias("outlet"), _by(4, F.lit("E"), F.col("day"), F.lit(" "), None).alias("approved"))


_O = "(SELECT o_orderkey AS k, 'p' || o_orderkey AS slug, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate AS at_, o_orderstatus FROM orders)"
PIECES = f"""p AS (SELECT slug, CASE WHEN k % 7 = 0 THEN 'f' || k ELSE slug END AS folder, CASE k % 6 WHEN 0 THEN ['site', 'feed'] WHEN 1 THEN ['feed', 'site', 'feed', 'nowhere'] WHEN 2 THEN []::VARCHAR[] WHEN 3 THEN ['pro', 'bare'] WHEN 5 THEN ['second', o_orderstatus] END AS outlets,
 CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE day END AS published_at, CASE k % 3 WHEN 0 THEN ['old' || k, slug, ' ', 'rag'] WHEN 2 THEN []::VARCHAR[] END AS former FROM {_O})"""
MOMENTS = f"""w AS (SELECT slug, CASE k % 8 WHEN 0 THEN at_ + INTERVAL 9 HOUR WHEN 1 THEN at_ + INTERVAL 14 HOUR WHEN 4 THEN at_ + INTERVAL 8 HOUR + INTERVAL 30 SECOND WHEN 5 THEN at_ + INTERVAL 26 HOUR + INTERVAL 30 MINUTE WHEN 6 THEN at_ END AS "at" FROM {_O})"""
DATES = f"t AS (SELECT slug, CASE k % 4 WHEN 2 THEN 'bare' ELSE 'feed' END AS outlet, CASE k % 4 WHEN 3 THEN '' ELSE day END AS date FROM {_O} WHERE k % 4 > 0)"
FIELDS = f"""f AS (SELECT slug, 'site_url' AS field, 'https://site.org/p/' || slug || '/' AS url FROM {_O} WHERE k % 3 = 0 UNION ALL SELECT slug, 'public_url', 'https://feed.org/p/' || slug FROM {_O} WHERE k % 3 <> 1
 UNION ALL SELECT slug, 'canonical', 'https://feed.org/p/' || slug || '/' FROM {_O} WHERE k % 5 = 0 UNION ALL SELECT slug, 'canonical', 'https://else.org' FROM {_O} WHERE k % 5 = 1 UNION ALL SELECT slug, 'pro_url', 'https://pro.org/x/' || slug FROM {_O} WHERE k % 4 = 0
 UNION ALL SELECT slug, 'bare_url', '' FROM {_O} WHERE k % 7 = 0)"""
RECORDS = f"rec AS (SELECT slug, CASE WHEN k % 9 = 0 THEN 'feed' ELSE 'second' END AS outlet FROM {_O} WHERE k % 9 IN (0, 4))"
REQUESTS = f"q AS (SELECT CASE WHEN k % 50 = 0 THEN 'zz' || k ELSE slug END AS slug, CASE k % 3 WHEN 0 THEN 'feed' WHEN 1 THEN 'site' ELSE 'second' END AS outlet, CASE k % 4 WHEN 0 THEN 'E' WHEN 1 THEN day WHEN 2 THEN ' ' END AS approved FROM {_O})"
