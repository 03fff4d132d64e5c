"""URL filters: rules by host and path, and a ratio of character language models where no rule fits.

Two smoothed variable-order Markov models over characters are counted from the URLs that the rules accept and reject. Each
interpolates contexts of three, two, one and no characters: the weight of a context against the next shorter one is its
number of distinct followers (Witten and Bell). A URL without a rule is allowed if its log-likelihood difference, divided by
its length, is at least a threshold, which is calibrated on a fifth of the ruled URLs that the models do not count.

Everything is DataFrame functions. The models count distinct whole URLs, from the host on with query and fragment, with their
own characters, since rules turn on single digits and letters; every held-out ruled URL calibrates. Gram scores grow with the
URLs' characters and are joined, not broadcast: each occurrence of a gram moves with a digest of its URL, not with its text.
Counts are summed by gram before they are shuffled, and each distinct URL is scored once. The counts of all four orders come
from one aggregation over the grams' ends, since an end's length tells its order. judged_urls() can instead read host and path
with characters folded to 33 symbols (letters, one digit, `/ . - =`, one for all others and the start), which merges URLs of
unlike verdicts; no query does.

Nulls and ties: a null URL or one without `://` has an empty host and path, fits no rule, has a difference of 0 and is
blocked. Rows with equal ids are judged on their own. Without ruled URLs of both kinds the difference is 0 for all and the
threshold 0. An empty table gives an empty result; other columns are ignored."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import cut

#: (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's; the longest wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ORDER = 3
SYMBOLS = 33
#: Symbols of URLs: all code points.
CODE_POINTS = 0x110000
#: One ruled URL in so many calibrates the threshold.
HELD_OUT = 5
BIN = 0.01


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = after_scheme(url)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def whole(url: Column) -> Column:
    """A URL from the host, in lower case, to its end."""
    return F.concat(host_and_path(url)[0], F.regexp_replace(after_scheme(url), r"(?s)^[^/?#]*", ""))


def folded(url: Column) -> Column:
    """Host and path: letters in lower case, 0 for digits, / . - = as they are, ~ for the rest."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat(*host_and_path(url))), "[0-9]", "0"), r"(?s)[^a-z0/.\-=]", "~")


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The rule that fits, as host and path in one string, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(text: Column) -> Column:
    """For each character the gram of it and the ORDER before it; ^ stands before the start."""
    padded = F.concat(F.lit("^" * ORDER), text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(ORDER + 1))))


def gram_scores(counts: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Of (gram, accepted, rejected) the difference of log probabilities of each gram's last character."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda k: F.substring("gram", F.lit(ORDER + 2) - k, k))
    by_end = cut(counts.select(F.explode(ends).alias("end"), "accepted", "rejected").groupBy("end").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    context = F.expr("substring(end, 1, length(end) - 1)")
    kinds = ("accepted", "rejected")
    by_context = by_end.groupBy(context.alias("context")).agg(*(e for x in kinds for e in (F.sum(x).alias(f"{x}_n"), F.sum((F.col(x) > 0).cast("long")).alias(f"{x}_t"))))
    known = by_end.withColumn("context", context).join(by_context, "context").drop("context")
    # Each gram with what is known of its four ends, in a row.
    each = counts.select("gram", F.explode(ends).alias("end")).join(known, "end")
    of = lambda k, x: F.max(F.when(F.length("end") == k + 1, F.col(x))).alias(f"{x}_{k}")
    rows = each.groupBy("gram").agg(*(of(k, x + y) for k in range(ORDER + 1) for x in kinds for y in ("", "_n", "_t")))
    chance = {x: F.lit(1.0 / symbols) for x in kinds}
    for k in range(ORDER + 1):
        for x in kinds:
            seen, n, t = (F.col(f"{x}{y}_{k}") for y in ("", "_n", "_t"))
            chance[x] = F.when(n > 0, (seen + t * chance[x]) / (n + t)).otherwise(chance[x])
    return rows.select("gram", (F.log(chance["accepted"]) - F.log(chance["rejected"])).alias("difference"))


def judged_urls(pages: DataFrame, rules=RULES, text=folded, symbols: int = SYMBOLS) -> tuple[DataFrame, float]:
    """pages with host, path, rule, ruled (the rule's verdict) and difference (null: an empty URL), and the calibrated
    threshold. text: what of a URL the models read, made of at most so many symbols."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), text(F.col("url")).alias("text"))
    rule, ruled = matched(F.col("host"), F.col("path"), rules)
    # Two hashes stand for a URL's text, so that grams need not carry it.
    urls = urls.select("*", rule.alias("rule"), ruled.alias("ruled"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))

    # Distinct URLs: copies of a page do not teach the models. Equal whole URLs have one verdict; folded ones may have both.
    held = F.pmod(F.crc32("text"), F.lit(HELD_OUT)) == 0
    known = urls.where("text <> ''").groupBy("h1", "h2", "text").agg(F.max(F.coalesce((F.col("ruled") == "allow").cast("int"), F.lit(0))).alias("allowed"), F.max(F.coalesce((F.col("ruled") == "block").cast("int"), F.lit(0))).alias("blocked"))
    known = cut(known.withColumn("held_out", held))
    learns = (~F.col("held_out")).cast("long")
    each = known.select((F.col("allowed") * learns).alias("a"), (F.col("blocked") * learns).alias("r"), F.explode(grams(F.col("text"))).alias("gram"))
    counts = cut(each.groupBy("gram").agg(F.sum("a").alias("accepted"), F.sum("r").alias("rejected")))
    scores = cut(gram_scores(counts, symbols))

    flags = (F.col("allowed") + 2 * F.col("blocked") + 4 * F.col("held_out").cast("int")).alias("flags")
    scored = known.select("h1", "h2", F.length("text").alias("n"), flags, F.explode(grams(F.col("text"))).alias("gram")).join(scores, "gram")
    scored = scored.groupBy("h1", "h2", "n", "flags").agg(F.round(F.sum(F.col("difference").cast("decimal(30,12)")).cast("double") / F.col("n"), 9).alias("difference"))
    scored = cut(scored)
    return urls.drop("text").join(scored.select("h1", "h2", "difference"), ["h1", "h2"], "left"), calibrated(scored)


def calibrated(scored: DataFrame) -> float:
    """The threshold with the best mean of both kinds' rates on the held-out URLs, from a histogram of bounded size."""
    bins = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("difference") / BIN))).cast("int")
    counts = [F.sum((F.col("flags") == 4 + k).cast("long")).alias(x) for k, x in ((1, "allowed"), (2, "blocked"))]
    rows = scored.where("flags IN (5, 6)").groupBy(bins.alias("bin")).agg(*counts).orderBy("bin").collect()
    allowed, blocked = sum(r.allowed for r in rows), sum(r.blocked for r in rows)
    if not allowed or not blocked:
        return 0.0
    best, threshold, below_a, below_b = -1.0, 0.0, 0, 0
    for r in rows:
        rate = (allowed - below_a) / allowed + below_b / blocked
        if rate > best:
            best, threshold = rate, r.bin * BIN
        below_a, below_b = below_a + r.allowed, below_b + r.blocked
    return threshold


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """For each page page_id, host, path, rule, verdict and difference."""
    urls, threshold = judged_urls(pages, rules, whole, CODE_POINTS)
    own = F.when(F.col("difference") >= threshold, "allow").otherwise("block")
    return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.coalesce("difference", F.lit(0.0)).alias("difference"))
