"""DuckDB SQL of the registered queries. Regular expressions avoid lookaround, which that engine lacks."""

WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:[''’][a-z]+)?')"


#: A SQL string of the straight forms of the four curly quotes.
QUOTES = "'''''\"\"'"


def short(text: str) -> str:
    flat = f"translate({text}, '‘’“”', {QUOTES})"
    return rf"substr(sha256(trim(regexp_replace({flat}, '[\s\x0B]+', ' ', 'g'))), 1, 16)"


def source_text(text: str = "text") -> str:
    s = rf"regexp_replace(lower(replace(regexp_replace(translate({text}, '‘’“”', {QUOTES}), '[—–]', ' ', 'g'), '‐', '-')), '[^a-z0-9'' ]+', ' ', 'g')"
    # An apostrophe is kept between two letters or digits: those are marked first.
    s = rf"regexp_replace({s}, '([a-z0-9])''([a-z0-9])', '\1' || chr(1) || '\2', 'g')"
    s = rf"regexp_replace({s}, '([a-z0-9])''([a-z0-9])', '\1' || chr(1) || '\2', 'g')"
    return rf"trim(regexp_replace(replace(replace({s}, '''', ' '), chr(1), ''''), ' +', ' ', 'g'))"


def page_text(text: str) -> str:
    word = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
    s = f"replace(regexp_replace(translate({text}, '‘’“”', {QUOTES}), '[—–]', '-', 'g'), '…', '...')"
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    for name, c in (("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = f"replace({s}, '{name}', '{c}')"
    s = rf"trim(regexp_replace({s}, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))"
    s = rf"regexp_replace(regexp_replace({s}, ' ([,.;:!?%)\]}}])', '\1', 'g'), '([(\[{{]) ', '\1', 'g')"
    s = rf"regexp_replace({s}, '({word}) ?'' ?(s|t|re|ve|ll|d|m)\b', '\1''\2', 'g')"
    return rf"regexp_replace({s}, '({word})-\s+({word})', '\1-\2', 'g')"


LINT = r"""
s AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS no, unnest(p) AS sentence
      FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
h AS (SELECT doc_id, no, 'verdict' AS rule, len(regexp_extract_all(sentence, '\b(that is|this is)\b')) AS hits FROM s
      UNION ALL SELECT doc_id, no, 'of_the', len(regexp_extract_all(sentence, '\bof the\b')) FROM s
      UNION ALL SELECT doc_id, no, 'from', len(regexp_extract_all(sentence, '\bfrom (a|an|the)\b')) FROM s),
hits AS (SELECT doc_id, no::INTEGER AS no, rule, hits FROM h WHERE hits > 0)"""

FURNITURE = r"""
w AS (SELECT source, doc_id, list_filter(string_split(regexp_replace(trim(text), '[\s\x0B]+', ' ', 'g'), ' '), lambda x: x <> '') AS raw FROM documents),
m AS (SELECT source, doc_id, raw, list_transform(raw, lambda x: regexp_replace(lower(x), '[0-9]+', '#', 'g')) AS ws FROM w),
r AS (SELECT source, doc_id, i, array_to_string(ws[i:i + 2], ' ') AS run FROM (SELECT source, doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM m WHERE len(ws) >= 3)),
t AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source HAVING count(DISTINCT doc_id) >= 4),
f AS (SELECT source, run, count(DISTINCT doc_id) AS on_pages, any_value(pages) AS pages FROM r JOIN t USING (source) GROUP BY source, run
      HAVING count(DISTINCT doc_id) >= greatest(2, floor(any_value(pages) * 0.02)))"""

VOCABULARY = "v(publication, tag) AS (VALUES ('F', '1-URGENT'), ('F', '2-HIGH'), ('O', '1-URGENT'), ('O', '9-NEVER'))"
TAGS = "u AS (SELECT o_orderstatus AS publication, o_orderpriority AS tag FROM orders)"

STATE = """CASE WHEN b IS NULL OR d IS NULL OR l IS NULL THEN 'unknown' WHEN d = b AND l = b THEN 'unchanged' WHEN l = b THEN 'push'
WHEN d = b THEN 'pull' WHEN d = l THEN 'converged' ELSE 'conflict' END"""


def garbled(text: str) -> str:
    words = f"list_filter(string_split({text}, ' '), lambda x: x <> '')"
    return f"(len({words}) >= 12 AND len(list_filter({words}, lambda x: length(x) <= 2 OR NOT regexp_full_match(x, '[a-z'']+'))) > 0.35 * len({words}))"


#: Verdicts of pairs pr(span_id, doc_id) of spans sp(span_id, span) and streams d(doc_id, stream); every run of four words or more is looked
#: for, and gaps are found word by word. The best of a span has rank 1 in v8.
JUDGED = rf"""pt AS (SELECT span_id, list_filter(string_split(span, '…'), lambda p: p <> '') AS parts FROM sp),
fr AS (SELECT span_id, unnest(parts) AS part FROM pt),
f4 AS (SELECT span_id, array_to_string(w[i:i + 3], ' ') AS run FROM (SELECT span_id, string_split(part, ' ') AS w, unnest(range(1, greatest(1, len(string_split(part, ' ')) - 2))) AS i FROM fr)),
dd AS (SELECT doc_id, stream, replace(stream, ' ', '') AS bare, trim(regexp_replace(regexp_replace(regexp_replace(' ' || replace(stream, ' ', '  ') || ' ', ' \d{{1,4}} ', '  ', 'g'), ' +', ' ', 'g'), '^ | $', ' ', 'g')) AS plain FROM d WHERE stream IS NOT NULL),
{{pairs}}v0 AS (SELECT *, instr(stream, parts[1]) AS f1 FROM pr JOIN pt USING (span_id) JOIN dd USING (doc_id) WHERE len(parts) > 0),
v1 AS (SELECT *, CASE WHEN f1 = 0 THEN parts[1] WHEN len(parts) = 2 AND instr(substr(stream, f1 + length(parts[1])), parts[2]) = 0 THEN parts[2] END AS lost FROM v0),
v2 AS (SELECT *, string_split(lost, ' ') AS w, contains(stream, lost) AS earlier FROM v1),
rn AS (SELECT span_id, doc_id, max(ROW(j - i, -i, array_to_string(w[i:j - 1], ' '))) AS x FROM (SELECT *, unnest(range(i + 4, len(w) + 2)) AS j FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM v2 WHERE lost IS NOT NULL)) WHERE contains(stream, array_to_string(w[i:j - 1], ' ')) GROUP BY ALL),
v3 AS (SELECT v2.*, x[1] AS run, instr(stream, x[3]) - 1 AS pos FROM v2 LEFT JOIN rn USING (span_id, doc_id)),
v4 AS (SELECT *, substr(stream, (greatest(pos - 300, 0) + 1)::BIGINT, (pos + 3 * length(lost) + 300 - greatest(pos - 300, 0))::BIGINT) AS near, ' ' || substr(stream, (greatest(pos - 300, 0) + 1)::BIGINT, (pos + length(lost) + 700 - greatest(pos - 300, 0))::BIGINT) || ' ' AS win FROM v3),
g AS (SELECT span_id, doc_id, 0 AS k, 0::BIGINT AS p, []::VARCHAR[] AS gaps, w, win FROM v4 WHERE run IS NOT NULL
 UNION ALL SELECT span_id, doc_id, k + 1, CASE WHEN instr(substr(win, p + 1), ' ' || w[k + 1] || ' ') = 0 THEN -1 ELSE p + instr(substr(win, p + 1), ' ' || w[k + 1] || ' ') + length(w[k + 1]) END,
  CASE WHEN p > 0 AND trim(substr(win, p + 1, instr(substr(win, p + 1), ' ' || w[k + 1] || ' ') - 1)) <> '' THEN list_append(gaps, trim(substr(win, p + 1, instr(substr(win, p + 1), ' ' || w[k + 1] || ' ') - 1))) ELSE gaps END, w, win FROM g WHERE k < len(w) AND p >= 0),
gp AS (SELECT span_id, doc_id, gaps FROM g WHERE k = len(w) AND p >= 0),
v5 AS (SELECT v4.*, gaps, coalesce(len(gaps) > 0 AND list_sum(list_transform(gaps, lambda x: length(x))) <= 400, false) AS elided, len(list_filter(list_distinct(w), lambda y: contains(' ' || near || ' ', ' ' || y || ' '))) / len(w) AS share FROM v4 LEFT JOIN gp USING (span_id, doc_id)),
v6 AS (SELECT span_id, doc_id, CASE WHEN lost IS NULL THEN 'MATCH' WHEN NOT earlier AND (contains(bare, replace(lost, ' ', '')) OR contains(plain, lost)) THEN 'MATCH2' WHEN run IS NULL THEN NULL WHEN earlier THEN 'OUT OF ORDER'
 WHEN elided THEN CASE WHEN len(list_filter(gaps, lambda x: NOT ({garbled("x")} OR len(string_split(x, ' ')) <= 2))) = 0 THEN 'MATCH3' ELSE 'UNMARKED ELISION' END WHEN share >= 0.6 THEN CASE WHEN {garbled("near")} THEN 'SOURCE ILLEGIBLE HERE' ELSE 'DRIFT' END END AS st, run, share, w, parts FROM v5),
v7 AS (SELECT span_id, doc_id, CASE WHEN st LIKE 'MATCH%' THEN 'MATCH' ELSE st END AS status, CASE st WHEN 'MATCH' THEN list_sum(list_transform(parts, lambda p: len(string_split(p, ' '))))::BIGINT WHEN 'MATCH2' THEN len(w) ELSE run END AS run, CASE WHEN st IN ('DRIFT', 'SOURCE ILLEGIBLE HERE') THEN share ELSE 1.0 END AS score FROM v6 WHERE st IS NOT NULL),
v8 AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY CASE status WHEN 'MATCH' THEN 1 WHEN 'UNMARKED ELISION' THEN 2 WHEN 'OUT OF ORDER' THEN 3 WHEN 'DRIFT' THEN 4 ELSE 5 END, score DESC, run DESC, doc_id) AS rk FROM v7)
"""
#: Every pair that shares a run of four words, or a fragment in some form.
SHARING = """pr AS (SELECT span_id, doc_id FROM f4 JOIN dd ON contains(stream, run) UNION SELECT span_id, doc_id FROM fr JOIN dd ON contains(stream, part) OR contains(bare, replace(part, ' ', '')) OR contains(plain, part)),
"""
QUOTE_VERDICTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {source_text()} AS stream FROM documents), b AS (SELECT item_id, list_filter(string_split({source_text()}, ' '), lambda w: w <> '') AS ws FROM benchmark),
r AS (SELECT item_id, ws, greatest(1, len(ws) // 12) AS n, unnest(range(1, greatest(1, len(ws) // 12) + 1)) AS k FROM b WHERE len(ws) > 0),
s0 AS (SELECT item_id || ':' || (k - 1) AS span_id, (k - 1) % 5 AS kind, ws[12 * k - 11:CASE WHEN k = n THEN len(ws) ELSE 12 * k END] AS w FROM r),
sp AS (SELECT span_id, CASE kind WHEN 1 THEN array_to_string(w[7:], ' ') || '…' || array_to_string(w[:6], ' ') WHEN 2 THEN array_to_string(w[:5] || w[9:], ' ') WHEN 3 THEN array_to_string(w[:5] || ['another'] || w[7:], ' ') ELSE array_to_string(w, ' ') END AS span FROM s0),
{JUDGED.replace("{pairs}", SHARING)}
SELECT sp.span_id, doc_id AS source, coalesce(status, 'NO OVERLAP') AS status, score, run FROM sp LEFT JOIN v8 ON v8.span_id = sp.span_id AND rk = 1
"""

ORACLES = {
    "quote_verdicts": QUOTE_VERDICTS,
    "leak_shingles": f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12)),
t AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM b WHERE len(ws) >= 12))
SELECT doc_id, item_id, count(*) AS shared FROM s JOIN t USING (g) GROUP BY doc_id, item_id""",
    "furniture_runs": f"WITH {FURNITURE} SELECT * FROM f",
    "furniture_removed": f"""
WITH {FURNITURE}, hit AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 3)))) AS gone FROM r JOIN f USING (source, run) GROUP BY doc_id),
k AS (SELECT m.doc_id, list_filter(raw, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM m LEFT JOIN hit USING (doc_id))
SELECT doc_id, sha256(coalesce(array_to_string(kept, ' '), '')) AS left_sha256 FROM k""",
    "doc_digests": f"SELECT doc_id, {short('text')} AS h FROM documents",
    "chunk_digests": "SELECT doc_id, sha256(replace(text, chr(10), chr(30)) || chr(30)) AS digest FROM documents",
    "exact_phrase_search": f"""
WITH d AS (SELECT doc_id, {source_text()} AS stream FROM documents), b AS (SELECT item_id, list_filter(string_split({source_text()}, ' '), lambda w: w <> '') AS ws FROM benchmark),
r AS (SELECT item_id, ws, greatest(1, len(ws) // 8) AS n, unnest(range(1, greatest(1, len(ws) // 8) + 1)) AS k FROM b WHERE len(ws) > 0),
p AS (SELECT item_id || ':' || (k - 1) AS span_id, array_to_string(ws[8 * k - 7:CASE WHEN k = n THEN len(ws) ELSE 8 * k END], ' ') AS phrase FROM r),
m AS (SELECT doc_id, span_id, phrase, stream, string_split(stream, phrase) AS parts FROM d JOIN p ON contains(stream, phrase)),
h AS (SELECT doc_id, span_id, phrase, stream, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase)))::INTEGER AS "at" FROM m)
SELECT doc_id, span_id, "at", substr(stream, greatest("at" - 60, 0) + 1, "at" + length(phrase) + 60 - greatest("at" - 60, 0)) AS context FROM h""",
    "phrase_locator_asof": """
WITH l AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS line, unnest(p) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, line, length(content) AS n, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(content) - 1 AS "at" FROM l),
x AS (SELECT doc_id, line, "at", row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line) AS r FROM s)
SELECT doc_id, "at"::BIGINT AS "at", (line // 40 * 40 + 1)::BIGINT AS locator FROM x WHERE r = 1""",
    "links_by_host": r"""
WITH l AS (SELECT DISTINCT page_id, regexp_replace(u, '[.,;:!?)]+$', '') AS link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS u FROM pages))
SELECT regexp_extract(link, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""",
    "html_block_counts": """SELECT page_id, len(regexp_extract_all(html, '(?i)<p[ >]')) AS p, len(regexp_extract_all(html, '(?i)<h2[ >]')) AS h2,
len(regexp_extract_all(html, '(?i)<li[ >]')) AS li FROM pages""",
    "lint_hits": f"WITH {LINT} SELECT * FROM hits",
    "lint_term_threshold": f"WITH {LINT}, t AS (SELECT *, sum(hits) OVER (PARTITION BY doc_id, rule) AS total FROM hits) SELECT doc_id, no, rule, hits FROM t WHERE total < 3",
    "sentence_stats": r"""
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.?!])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS p FROM documents)
SELECT doc_id, len(p)::BIGINT AS n, list_max(list_transform(p, lambda x: length(x)))::BIGINT AS longest FROM s""",
    "title_like_lines": r"""
WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(string_split(text, chr(10))[1]), '[\s\x0B]+'), lambda w: length(w) >= 4) AS long FROM documents)
SELECT doc_id, len(long) >= 2 AND len(list_filter(long, lambda w: regexp_matches(w, '^[A-Z]'))) >= 0.7 * len(long) AS title_like FROM s""",
    "tag_usage": f"WITH {VOCABULARY}, {TAGS} SELECT v.publication, v.tag, count(u.tag) AS uses FROM v LEFT JOIN u ON u.publication = v.publication AND u.tag = v.tag GROUP BY 1, 2",
    "tag_unknown": f"WITH {VOCABULARY}, {TAGS} SELECT publication, tag, count(*) AS uses FROM u ANTI JOIN v USING (publication, tag) GROUP BY 1, 2",
    "required_missing": """
WITH r AS (SELECT i AS grp, s AS status FROM range(25) t(i), (VALUES ('F'), ('O')) x(s) WHERE i % 2 = 1 OR s = 'F')
SELECT c_custkey, status FROM customer JOIN r ON c_nationkey = grp WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = status)""",
    "fk_ownership": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "index_losses": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)",
    "publication_conflicts": "SELECT doc_id, source AS live_owner, 'moved' AS bundle_owner FROM documents WHERE doc_id % 7 = 0 AND source <> 'moved'",
    "upload_plan": """
WITH a AS (SELECT 'd/' || doc_id AS key, md5(text) AS m, strlen(text) AS s FROM documents WHERE doc_id % 11 <> 3),
b AS (SELECT 'd/' || doc_id AS key, md5(t) AS m, strlen(t) AS s FROM (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN text || '!' WHEN 2 THEN reverse(text) ELSE text END AS t FROM documents WHERE doc_id % 11 <> 5))
SELECT key, CASE WHEN a.s IS NULL THEN 'stale' WHEN b.s IS NULL OR a.s <> b.s OR a.m <> b.m THEN 'upload' ELSE 'skip' END AS action FROM a FULL JOIN b USING (key)""",
    "three_way_rows": f"""
WITH x AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1))::INTEGER AS idx, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
y AS (SELECT doc_id, idx, CASE WHEN idx % 13 <> 12 THEN {short('line')} END AS b,
CASE WHEN idx % 11 <> 10 THEN {short("CASE WHEN doc_id % 3 = 0 AND idx % 2 = 0 THEN line || ' edited' ELSE line END")} END AS d,
{short("CASE WHEN doc_id % 3 = 0 AND idx % 3 = 0 OR doc_id % 5 = 0 THEN line || ' edited' ELSE line END")} AS l FROM x)
SELECT doc_id, idx, {STATE} AS state, CASE WHEN b IS NULL AND d IS NULL THEN 'added_live' WHEN b IS NOT NULL AND d IS NULL THEN 'removed_draft' END AS structure FROM y""",
    "drift_status": f"""
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'UNREACHABLE' WHEN doc_id % 4 = 1 AND {short('text')} <> {short("text || ' more'")} THEN 'DRIFT'
WHEN doc_id % 4 = 2 AND lang <> 'xx' THEN 'DRIFT-MARKS' ELSE 'MATCH' END AS status FROM documents""",
    "embargo_state": """
SELECT event_id, CASE WHEN event_id % 7 = 3 THEN 'none' WHEN event_id % 7 IN (0, 5) THEN 'malformed' WHEN "at" <= TIMESTAMP '2024-03-01' THEN 'open' ELSE 'embargoed' END AS state
FROM (SELECT event_id, CASE event_id % 7 WHEN 1 THEN date_trunc('minute', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('second', ts) + INTERVAL 5 HOUR ELSE date_trunc('minute', ts) END AS "at" FROM events)""",
    "moments_due": "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-17'",
    "notes_backlog": """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'skip' WHEN o_orderstatus = 'F' THEN 'posted' WHEN o_orderpriority = '1-URGENT' THEN 'drafted' ELSE 'missing' END AS state,
count(*) AS n FROM orders GROUP BY 1""",
    "first_role_order": """
SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f, role)::INTEGER AS number FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2)""",
    "carry_forward": """
SELECT conv_id, turn, asked FROM (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations)
WHERE role = 'assistant'""",
    "merge_adjacent": """
WITH a AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM conversations),
g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM a)
SELECT conv_id, min(turn) AS turn, any_value(role) AS role, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256 FROM g GROUP BY conv_id, g""",
    "interior_gaps": """
SELECT conv_id, after, next FROM (SELECT conv_id, turn AS after, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE turn % 3 <> 1)
WHERE next IS NOT NULL AND next <> after + 1""",
    "page_calibration_mode": """
WITH c AS (SELECT l_suppkey AS source, (floor(l_quantity) % 5)::BIGINT AS d, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT source, arg_max(d, n * 100 - d) AS mode, sum(n)::BIGINT AS seen FROM c GROUP BY 1)
SELECT source, mode, seen, sum(CASE WHEN abs(d - mode) <= 1 THEN n ELSE 0 END)::BIGINT AS agree, sum(CASE WHEN abs(d - mode) <= 1 THEN n ELSE 0 END) >= 0.6 * seen AS calibrated
FROM c JOIN m USING (source) WHERE seen >= 3 GROUP BY source, mode, seen""",
    "index_upsert": """
WITH x AS (SELECT doc_id, lang, source, doc_id % 4 <> 0 AS o, doc_id % 3 <> 0 AS n, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS t, doc_id % 2 = 0 AS extra FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN n THEN t ELSE lang END AS title, CASE WHEN n AND extra AND source <> 'site' THEN array_to_string(list_sort(['site', source]), ',') ELSE source END AS outlets,
CASE WHEN NOT o THEN 'insert' WHEN NOT n OR (t = lang AND NOT extra) THEN 'keep' ELSE 'update' END AS change FROM x""",
    "shelf_audit": """
WITH r AS (SELECT doc_id, 'f' || doc_id AS file, CASE WHEN doc_id % 6 = 0 THEN '0000' ELSE substr(sha256(text), 1, 12) END AS digest,
CASE WHEN quality = 1 THEN 'free: ✅ to share. ⚠️ OCR.' WHEN doc_id % 2 = 0 THEN '❌ no, not ✅' WHEN doc_id % 3 = 0 THEN 'book, no sharing: ok' END AS cell FROM labels JOIN documents USING (doc_id)),
f AS (SELECT 'f' || doc_id AS file, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 7)
SELECT file, CASE WHEN h IS NULL THEN 'missing' WHEN digest IS NULL THEN 'unlisted' WHEN starts_with(h, digest) THEN 'held' ELSE 'altered' END AS state,
NOT starts_with(coalesce(cell, ''), 'free') AS restricted FROM r FULL JOIN f USING (file)""",
    "best_source_rank": """
WITH x AS (SELECT l_partkey, l_suppkey AS source, CASE l_returnflag WHEN 'A' THEN 'MATCH' WHEN 'N' THEN 'DRIFT' ELSE 'OUT OF ORDER' END AS status,
CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE 3 END AS k, l_quantity::BIGINT AS score, l_linenumber::BIGINT AS run FROM lineitem)
SELECT l_partkey, source, status, score, run FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY k, score DESC, run DESC, source) AS r FROM x) WHERE r = 1""",
    "hits_per_source": """
SELECT source, doc_id, n_chars, total FROM (SELECT source, doc_id, n_chars, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3""",
    "talk_minutes": r"""
SELECT conv_id, role, sum(n)::BIGINT AS words, round(sum(n) / 130, 4) AS minutes
FROM (SELECT conv_id, role, len(regexp_extract_all(text, '[^\s\x0B]+')) AS n FROM conversations) GROUP BY 1, 2""",
    "gate_summary": f"""
WITH {LINT}, r(rule) AS (VALUES ('verdict'), ('of_the'), ('from'), ('never')), c AS (SELECT rule, CASE WHEN rule = 'never' THEN 0 ELSE (SELECT count(*) FROM documents) END AS n_checked FROM r),
n AS (SELECT rule, count(*) AS found FROM hits GROUP BY rule)
SELECT rule, n_checked, coalesce(found, 0) AS found, CASE WHEN n_checked = 0 THEN 'not_checked' WHEN coalesce(found, 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM c LEFT JOIN n USING (rule)""",
    "links_extract": r"""
SELECT DISTINCT page_id, regexp_replace(u, '[.,;:!?)]+$', '') AS link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS u FROM pages)""",
    "ocr_garbled_docs": f"""
WITH w AS (SELECT doc_id, list_filter(string_split({source_text()}, ' '), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, coalesce(len(ws) >= 12 AND len(list_filter(ws, lambda x: length(x) <= 2 OR NOT regexp_full_match(x, '[a-z'']+'))) > 0.35 * len(ws), false) AS garbled FROM w""",
    "content_presence": f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, {page_text('line')} AS want FROM p),
h AS (SELECT doc_id, regexp_replace({page_text("CASE WHEN doc_id % 3 = 0 THEN array_to_string(string_split(text, chr(10))[2:], chr(10)) ELSE text END")}, '\\s+', '', 'g') AS have
      FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE NOT coalesce(contains(have, regexp_replace(want, '\\s+', '', 'g')), false)) AS missing
FROM w LEFT JOIN h USING (doc_id) WHERE length(want) >= 40 GROUP BY doc_id""",
    "tag_unused": f"WITH {VOCABULARY}, {TAGS} SELECT publication, tag FROM v ANTI JOIN u USING (publication, tag)",
    "tags_in_order": """
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS tags FROM orders GROUP BY 1""",
    "deck_compare": """
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'k' ELSE '' END || turn AS slide,
CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 'missing' WHEN conv_id % 3 = 0 AND turn = 1 AND text IS NOT NULL THEN 'drift' ELSE 'match' END AS status,
CASE WHEN NOT (conv_id % 5 = 0 AND turn = 2) AND conv_id % 3 = 0 AND turn = 1 AND text IS NOT NULL THEN 'text' ELSE '' END AS faults FROM conversations""",
    "resolved_rows": f"""
WITH x AS (SELECT doc_id, text AS t, CASE WHEN doc_id % 2 = 0 THEN text || 'd' ELSE text END AS d, CASE WHEN doc_id % 3 = 0 THEN text || 'l' ELSE text END AS l FROM documents),
y AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN l WHEN 1 THEN d ELSE t END AS b, d, l FROM x) SELECT doc_id, {STATE} AS state FROM y""",
    "deferrals_lapsed": "SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 9 = 0 OR doc_id % 4 = 0",
    "furniture_top": f"""
WITH {FURNITURE} SELECT source, run, on_pages, total FROM
(SELECT source, run, on_pages, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY on_pages DESC, run) AS r FROM f) WHERE r <= 6""",
    "superseded_lines": r"""
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)\b(from|old)\b') GROUP BY 1""",
    "landed_on_not_found": "SELECT page_id, contains(url, '/404') OR contains(url, '/en/') OR contains(url, 'not-found') AS lost FROM pages",
}
