"""Queries over what is read and written as files, references, site maps, captions and envelopes, and their DuckDB SQL. Files are written
by the queries into the folder that the cluster shares."""

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import norm
from corpusloom.operators import checks, html, reconcile
from corpusloom.sources import files


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def folder(spark) -> str:
    """A new folder where spark.checkpoint.dir or else the warehouse is."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/corpusloom-files-{uuid.uuid4().hex}"


def references(spark, d):
    """SC2: customers as references, with and without a kind, against their orders as pieces and talks."""
    texts = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "piece").otherwise("talk").alias("kind"), F.concat(F.lit("s"), "o_custkey").alias("slug")).distinct()
    k = F.col("c_custkey")
    refs = table(spark, d, "customer").select(F.when(k % 3 == 0, F.concat(F.lit("s"), k)).when(k % 3 == 1, F.concat(F.lit("talk/s"), k)).otherwise(F.concat(F.lit("piece/s"), k)).alias("ref"))
    return files.resolved_refs(refs, texts)


def sitemaps(spark, d):
    """SC17: orders as addresses of each customer's site map, some deeper or elsewhere."""
    k = F.col("o_orderkey")
    loc = F.concat(F.lit("<url><loc>https://x.org/"), F.when(k % 5 == 0, "q/").otherwise("p/"), k, F.when(k % 4 == 0, "/deeper").when(k % 3 == 0, "/").otherwise(""), F.lit("</loc></url>"))
    maps = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(loc), "\n").alias("xml"))
    return maps.select("o_custkey", F.array_join(F.array_sort(files.sitemap_slugs(F.col("xml"), "https://x.org/p/")), ",").alias("slugs"))


def scan_faults(spark, d):
    """SC15: documents as scans, of which every fifth states the digest of another text and every seventh none."""
    k = F.col("doc_id")
    sha = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256))
    return files.scan_faults(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("text").alias("scan"), sha.alias("sha256")))


def manifest_table(spark, d):
    """SC8: customers as rows of a Markdown table, of which some are too short, without a file, or its head."""
    k = F.col("c_custkey")
    cell = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    row = F.when(k % 6 == 0, "| File | Book |").when(k % 6 == 1, cell("| `dir/f", k, ".pdf` | a \\| b | w", k, " | e | 2026 | ✅ |")).when(k % 6 == 2, cell("| [t](x/g", k, ".pdf) | b | w | e | d | no | more |")).when(k % 6 == 3, cell("| short", k, " | b |")).when(k % 6 == 4, "| | b | w | e | d | r |").otherwise("not a row")
    return files.manifest_rows(table(spark, d, "customer").select(k.alias("line"), row.alias("value")))


def index_files(spark, d):
    """SC7, SK1: order lines written as an index of verses and orders as one of locators, and both read again."""
    path = folder(spark)
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("c"), F.col("l_partkey").alias("v"), F.concat(F.lit("a\tb \n "), "l_returnflag").alias("t"))
    files.write_index(items, f"{path}/verses")
    files.write_index(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority")).alias("t")), f"{path}/locators")
    files.write_index(table(spark, d, "nation").select("n_name"), f"{path}/others")
    rows = files.read_index(spark, f"{path}/*")
    return rows.groupBy("section", "text", "unparsed", F.col("locator").isNotNull().alias("located")).agg(F.count(F.lit(1)).alias("n"), F.sum("verse").alias("verses"), F.max("chapter").alias("last"))


def file_tree(spark, d):
    """SC19, SC20: sizes and digests of files of customers."""
    path = folder(spark)
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 7).alias("part"), "c_custkey", F.concat(F.lit("customer "), "c_custkey").alias("value"))
    rows.repartition(7, "part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(path)
    return files.tree(spark, path, "*.txt").select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "size", "md5", "sha256")


def captions(spark, d):
    """PJ14: captions of figures on pages, some empty."""
    page = F.concat("html", F.lit('<figure class="a"><img src="x"><FIGCAPTION id="c">A <b>bold</b>\n caption '), F.col("page_id").cast("string"), F.lit("</FIGCAPTION></figure><figure><img></figure>"))
    return table(spark, d, "pages").select("page_id", F.array_join(html.captions(page), "|").alias("captions"))


def caption_findings(spark, d):
    """FL11: orders as images of customers, with and without captions, some by address."""
    o = table(spark, d, "orders").withColumn("file", F.concat(F.lit("images/"), "o_orderkey"))
    k = F.col("o_orderkey")
    images = o.where("o_orderkey % 7 > 0").select("o_custkey", F.when(k % 2 == 0, F.concat(F.lit("https://cdn.org/"), "o_orderkey")).otherwise(F.col("file")).alias("src"))
    urls = o.where("o_orderkey % 3 > 0").select("o_custkey", F.concat(F.lit("https://cdn.org/"), "o_orderkey").alias("url"), "file")
    notes = o.where("o_orderkey % 5 > 0").select("o_custkey", "file", F.when(k % 11 == 0, " ").otherwise("said").alias("caption"))
    return checks.caption_findings(images, notes, urls, "o_custkey")


def neighbour_ranges(spark, d):
    """JN9: ranges around order lines in the order in which they are tried."""
    loci = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("locus"), F.col("l_linenumber").alias("verse")).distinct()
    return checks.neighbour_ranges(loci, 2).select("locus.l_orderkey", "locus.l_linenumber", "lo", "hi", "tried")


def one_way_companions(spark, d):
    """JN15: orders that point at a neighbour which does not point back."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, k + 1).when(k % 4 == 2, k + 1).alias("to"), F.when(k % 4 == 1, k - 1).when(k % 4 == 3, k - 2).alias("back"))
    return reconcile.one_sided(rows, "id", "to", "back")


def human_deltas(spark, d):
    """TM4: how far events are from a moment, in words."""
    minutes = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").cast("timestamp"))) / 60)
    return table(spark, d, "events").select("event_id", reconcile.human_delta(minutes).alias("delta"))


def anchor_tails(spark, d):
    """PJ11: notes' anchors on pages with the words before them."""
    page = F.concat(F.lit("<p>Some words of page "), F.col("page_id").cast("string"), F.lit(' here<a class="footnote-anchor" href="#f">1</a> and on<a class="footnote-anchor">2</a>.</p>'), "html")
    blocks = table(spark, d, "pages").select("page_id", F.get(html.blocks_of(page), F.lit(0)).alias("b"))
    return blocks.select("page_id", F.array_join(F.transform(html.anchor_tails(F.col("b"), 12), lambda a: F.concat_ws(":", a["label"], a["tail"])), "|").alias("tails"))


def owned_upsert(spark, d):
    """SK2: an index of documents by address, merged with a newer one: addresses that another source holds are refused."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    old = docs.where("doc_id % 4 <> 0").select("doc_id", F.col("lang").alias("title"), F.array("lang").alias("tags"), F.when(k % 6 > 0, F.col("source")).alias("owner"))
    new = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(k % 5 == 0, "new").otherwise(F.col("lang")).alias("title"), F.array("source").alias("tags"), F.when(k % 7 == 0, "other").otherwise(F.col("source")).alias("owner"))
    out = reconcile.upserted(old, new, ["doc_id"], ["title"], ["tags"], "owner")
    return out.select("doc_id", "title", "owner", F.array_join("tags", ",").alias("tags"), "change")


def sentence_splits(spark, d):
    """PJ22: sentences of documents by each of the splits in use."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", *(F.size(norm.sentences(F.col("text"), kind)).alias(kind) for kind in norm.SENTENCES), F.sha2(F.array_join(norm.sentences(F.col("text"), "prose"), "|"), 256).alias("sha"))


QUERIES = {f.__name__: f for f in (owned_upsert, sentence_splits, references, sitemaps, scan_faults, manifest_table, index_files, file_tree, captions, caption_findings, neighbour_ranges, one_way_companions, human_deltas, anchor_tails)}

ORACLES = {
    "references": """WITH t AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'piece' ELSE 'talk' END AS kind, 's' || o_custkey AS slug FROM orders),
r AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 's' || c_custkey WHEN 1 THEN 'talk/s' || c_custkey ELSE 'piece/s' || c_custkey END AS ref, CASE c_custkey % 3 WHEN 1 THEN 'talk' WHEN 2 THEN 'piece' END AS want, 's' || c_custkey AS s FROM customer)
SELECT ref, min(kind) AS kind, min(slug) AS slug FROM r LEFT JOIN t ON slug = s AND (want IS NULL OR kind = want) GROUP BY ref""",
    "sitemaps": "SELECT o_custkey, coalesce(string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0), '') AS slugs FROM orders GROUP BY o_custkey",
    "scan_faults": "SELECT CASE WHEN doc_id % 7 > 0 THEN sha256(text || ' ') END AS sha256, sha256(text) AS actual FROM documents WHERE text IS NOT NULL AND (doc_id % 7 = 0 OR doc_id % 5 = 0)",
    "manifest_table": """SELECT c_custkey AS line, CASE k WHEN 1 THEN 'f' || c_custkey || '.pdf' WHEN 2 THEN 'g' || c_custkey || '.pdf' END AS file, CASE k WHEN 1 THEN 'a | b' WHEN 2 THEN 'b' END AS book, CASE k WHEN 1 THEN 'w' || c_custkey WHEN 2 THEN 'w' END AS work, CASE WHEN k < 3 THEN 'e' END AS edition,
CASE k WHEN 1 THEN '2026' WHEN 2 THEN 'd' END AS added, CASE k WHEN 1 THEN '✅' WHEN 2 THEN 'no' END AS redistribution, CASE k WHEN 3 THEN '| short' || c_custkey || ' | b |' WHEN 4 THEN '| | b | w | e | d | r |' END AS unparsed FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer) WHERE k IN (1, 2, 3, 4)""",
    "index_files": """WITH r AS (SELECT l_orderkey::VARCHAR AS section, 'a b ' || l_returnflag AS text, NULL AS unparsed, false AS located, l_partkey AS verse, l_linenumber AS chapter FROM lineitem
UNION ALL SELECT NULL, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority ELSE '' END, NULL, true, NULL, NULL FROM orders UNION ALL SELECT NULL, NULL, n_name, false, NULL, NULL FROM nation)
SELECT section, text, unparsed, located, count(*) AS n, sum(verse)::BIGINT AS verses, max(chapter)::INTEGER AS last FROM r GROUP BY section, text, unparsed, located""",
    "file_tree": "SELECT part::INTEGER AS part, length(t) AS size, md5(t) AS md5, sha256(t) AS sha256 FROM (SELECT c_custkey % 7 AS part, string_agg('customer ' || c_custkey || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY ALL)",
    "captions": r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html || '<figure class="a"><img src="x"><FIGCAPTION id="c">A <b>bold</b>' || chr(10) || ' caption ' || page_id || '</FIGCAPTION></figure><figure><img></figure>', '(?is)<figure\b.*?</figure>'),
 lambda f: trim(regexp_replace(regexp_replace(regexp_extract(f, '(?is)<figcaption[^>]*>(.*?)</figcaption>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), '|') AS captions FROM pages""",
    "caption_findings": """WITH o AS (SELECT o_custkey, o_orderkey AS k, 'images/' || o_orderkey AS file FROM orders), i AS (SELECT DISTINCT o_custkey, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'https://cdn.org/' || k ELSE file END AS file FROM o WHERE k % 7 > 0)
SELECT o_custkey, file, 'missing' AS finding FROM i WHERE (o_custkey, file) NOT IN (SELECT (o_custkey, file) FROM o WHERE k % 5 > 0 AND k % 11 > 0) UNION ALL SELECT o_custkey, file, 'orphan' FROM o WHERE k % 5 > 0 AND (o_custkey, file) NOT IN (SELECT (o_custkey, file) FROM i)""",
    "neighbour_ranges": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), a AS (SELECT *, unnest(range(greatest(l_linenumber - 2, 0), l_linenumber + 1)) AS lo FROM l), b AS (SELECT *, unnest(range(l_linenumber, l_linenumber + 3)) AS hi FROM a)
SELECT l_orderkey, l_linenumber, lo, hi, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY lo DESC, hi))::INTEGER AS tried FROM b WHERE NOT (lo = l_linenumber AND hi = l_linenumber)""",
    "one_way_companions": """SELECT a.o_orderkey AS id, a.o_orderkey + 1 AS "to" FROM orders a WHERE a.o_orderkey % 2 = 0 AND NOT (a.o_orderkey % 4 = 0 AND a.o_orderkey + 1 IN (SELECT o_orderkey FROM orders))""",
    "human_deltas": """WITH m AS (SELECT event_id, floor((floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-15')) / 60)::BIGINT AS m FROM events), a AS (SELECT event_id, m, abs(m) AS n FROM m),
t AS (SELECT event_id, m, CASE WHEN n // 1440 > 0 THEN (n // 1440) || 'd ' || (n % 1440 // 60) || 'h' WHEN n // 60 > 0 THEN (n // 60) || 'h ' || (n % 60) || 'm' ELSE n || 'm' END AS x FROM a) SELECT event_id, CASE WHEN m >= 0 THEN 'in ' || x ELSE x || ' ago' END AS delta FROM t""",
    "anchor_tails": "SELECT page_id, '1:' || right('Some words of page ' || page_id || ' here', 12) || '|2:' || right(page_id || ' here and on', 12) AS tails FROM pages",
}


def _split(pattern: str, to: str) -> str:
    return f"list_filter(string_split(regexp_replace(text, {pattern}, {to}, 'g'), chr(1)), lambda s: trim(s) <> '')"


#: The splits with the characters before and behind them as groups, as there is no looking around.
_AFTER, _BETWEEN = "'\\1' || chr(1)", "'\\1' || chr(1) || '\\2'"
_PROSE = _split(r"""'([.!?])[*"”\])]*\s+([“"*\[(]*[A-Z])'""", _BETWEEN)
ORACLES["sentence_splits"] = f"""SELECT doc_id, len({_PROSE})::INTEGER AS prose, len({_split("'([.!?]) '", _AFTER)})::INTEGER AS collapsed, len({_split("'([.!?:])" + chr(92) + "s+([A-Z*`" + chr(92) + "[(])'", _BETWEEN)})::INTEGER AS status,
 len({_split("'([.!?" + chr(92) + "n])'", _AFTER)})::INTEGER AS clauses, len({_split("'([.?!])" + chr(92) + "s+'", _AFTER)})::INTEGER AS plain, sha256(array_to_string({_PROSE}, '|')) AS sha FROM documents WHERE text IS NOT NULL"""
ORACLES["owned_upsert"] = """WITH a AS (SELECT doc_id, lang AS title, [lang] AS tags, CASE WHEN doc_id % 6 > 0 THEN source END AS owner FROM documents WHERE doc_id % 4 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS title, [source] AS tags, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE source END AS owner FROM documents WHERE doc_id % 3 <> 0),
m AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.title AS ta, b.title AS tb, a.tags AS ga, b.tags AS gb, a.owner AS oa, b.owner AS ob, a.doc_id IS NOT NULL AS old, b.doc_id IS NOT NULL AS fresh FROM a FULL JOIN b ON a.doc_id = b.doc_id),
f AS (SELECT *, old AND fresh AND coalesce(oa, '') <> '' AND oa IS DISTINCT FROM ob AS foreign_, list_sort(list_distinct(list_concat(coalesce(ga, []), coalesce(gb, [])))) AS u FROM m)
SELECT doc_id, CASE WHEN fresh AND NOT foreign_ THEN tb ELSE ta END AS title, CASE WHEN fresh AND NOT foreign_ THEN ob ELSE oa END AS owner, array_to_string(CASE WHEN foreign_ THEN ga ELSE u END, ',') AS tags,
 CASE WHEN foreign_ THEN 'refused' WHEN NOT old THEN 'insert' WHEN NOT fresh OR (ta IS NOT DISTINCT FROM tb AND oa IS NOT DISTINCT FROM ob AND u = ga) THEN 'keep' ELSE 'update' END AS change FROM f"""
