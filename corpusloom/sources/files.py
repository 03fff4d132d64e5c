"""Readers and writers of files: indexes, manifest tables, site maps and folders. All of them are lazy Spark readers."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """SC7: tab-separated rows, gzip or not: (locator, text) or (section, chapter, verse, text), told apart row by row. Rows of
    another arity keep their line in `unparsed`; an empty file has no rows."""
    cells = F.split("value", "\t")
    four, two = F.size(cells) == 4, F.size(cells) == 2
    number = lambda i: F.when(four, F.try_element_at(cells, F.lit(i)).try_cast("int"))
    return spark.read.text(path).where("value <> ''").select(
        F.when(two, F.try_element_at(cells, F.lit(1))).alias("locator"),
        F.when(four, F.try_element_at(cells, F.lit(1))).alias("section"),
        number(2).alias("chapter"),
        number(3).alias("verse"),
        F.when(four | two, F.try_element_at(cells, F.lit(-1))).alias("text"),
        F.when(~(four | two), F.col("value")).alias("unparsed"),
    )


def write_index(rows: DataFrame, path: str) -> None:
    """SK1: rows as tab-separated lines in gzip files; white space inside cells becomes one space."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ") for c in rows.columns]
    rows.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def manifest_rows(lines: DataFrame) -> DataFrame:
    """SC8: rows of a Markdown table from lines (line, value): cells split at pipes without a backslash. A row of fewer than six
    cells, or without a file name, keeps its text in `unparsed`."""
    inner = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    body = lines.where(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|\s*(File\s*\||:?-{3})"))
    name = F.regexp_replace(F.regexp_replace(F.get(cells, F.lit(0)), r"^\[[^\]]*\]\(([^)]*)\)$", "$1"), "^`|`$", "")
    name = F.regexp_replace(name, "^.*/", "")
    good = (F.size(cells) >= 6) & (name != "")
    at = lambda i: F.when(good, F.get(cells, F.lit(i)))
    return body.select("line", F.when(good, name).alias("file"), at(1).alias("book"), at(2).alias("work"), at(3).alias("edition"), at(4).alias("added"), at(5).alias("redistribution"), F.when(~good, F.col("value")).alias("unparsed"))


def sitemap_slugs(xml: Column, base: str) -> Column:
    """SC17: slugs exactly one segment below the base, each once."""
    root = base.rstrip("/") + "/"
    urls = F.transform(F.regexp_extract_all(xml, F.lit("<loc>([^<]+)</loc>"), F.lit(1)), lambda u: F.regexp_replace(u, "/+$", ""))
    return F.array_distinct(F.filter(F.transform(F.filter(urls, lambda u: u.startswith(root)), lambda u: F.substring(u, len(root) + 1, 1 << 30)), lambda s: (s != "") & ~F.contains(s, F.lit("/"))))


def tree(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SC19, SC20: files below a folder with sizes and digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def markdown(spark: SparkSession, path: str, excluded: str = r"/(log|\.git)/|/corrections\.md$") -> DataFrame:
    """SC1, SC3, SC22: Markdown files below a folder as (path, slug, text), comments out; the slug is the file's folder. Files
    whose path matches `excluded` are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    named = files.select(F.input_file_name().alias("path"), F.regexp_replace("value", "(?s)<!--.*?-->", "").alias("text"))
    return named.where(~F.col("path").rlike(excluded)).select("path", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("slug"), "text")


def resolved_refs(refs: DataFrame, texts: DataFrame, kinds: tuple[str, ...] = ("piece", "talk")) -> DataFrame:
    """SC2: references (ref), a slug or kind/slug, against texts (kind, slug); of a bare slug's kinds the first one counts.
    Unknown references have nulls."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    r = refs.select("ref", F.regexp_extract("ref", r"^(?:([^/]+)/)?([^/]+)$", 1).alias("__k"), F.regexp_extract("ref", r"([^/]+)$", 1).alias("slug"))
    met = r.join(texts.select("kind", "slug"), "slug").where("__k = '' OR __k = kind")
    best = met.groupBy("ref").agg(F.min_by(F.struct("kind", "slug"), rank).alias("b")).select("ref", "b.*")
    return refs.select("ref").distinct().join(best, "ref", "left")


def scan_faults(envelopes: DataFrame) -> DataFrame:
    """SC15: envelopes (scan, sha256) whose text has another digest than they state, with both digests."""
    actual = F.sha2("scan", 256)
    return envelopes.where(~actual.eqNullSafe(F.col("sha256"))).select("sha256", actual.alias("actual"))
