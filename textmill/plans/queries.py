"""The queries on the driver's tables: name, Spark form and, where SQL can say it, the SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import cleaning as cl
from textmill.functions import pandas_text
from textmill.functions import text as tx
from textmill.functions.columns import with_struct
from textmill.functions.patterns import Search, glob_matches, ignored, literal_prefix
from textmill.operators import layout, logs, reading, reports, search
from textmill.shipping import shipping
from textmill.sources import corpus as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: SQL for the corpus and its lines, which the queries below start from.
CORPUS = "corpus AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text, doc_id, lang, source FROM documents)"
LINES = CORPUS + r""", split AS (SELECT path, string_split(text, chr(10)) AS l FROM corpus),
numbered AS (SELECT path, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM split),
lines AS (SELECT path, CAST(i AS BIGINT) AS line_no, line FROM numbered WHERE NOT (i = n AND line = ''))"""
SAMPLES = """samples AS (SELECT event_id AS iteration, '1k' AS scale, event_type AS tool, 'day-' || strftime(ts, '%Y-%m-%d') AS scenario,
  CASE WHEN CAST(props->>'$.k' AS INT) >= 50 THEN 8 ELSE 1 END AS concurrency, 't' || CAST(user_id AS VARCHAR) AS target,
  CAST(props->>'$.k' AS INT) < 10 AS is_warmup, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'skipped' ELSE 'ok' END AS status, value AS duration_ms,
  event_type <> 'error' AS success FROM events)"""
CALLS = "calls AS (SELECT user_id, event_id AS call_id, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 60000) AS BIGINT) * 1000 AS end_us FROM events)"
GAPS = "gaps AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)"
DOC_LINES = LINES + r""", t AS (SELECT path, trim(line) AS line FROM lines WHERE trim(line) <> '')"""


#: Texts of kinds that the documents don't have: scripts, Markdown, citations, forms, journals, broken text layers. One in two documents is one of them.
VARIED = [
    "これは日本語の文章です。漢字とカタカナとひらがながあります。", "这是一个中文句子，没有别的文字。第二句也是中文。", "한국어 문장입니다. 띄어쓰기가 있습니다.", "שלום עולם 12 هذا نص عربي", "यह हिन्दी है ประเทศไทย ខ្មែរ",
    "# Title\n\n```\ncode\n```\n> quote\n- item one\n- item two\n1. first\n2) second\n* * *\n|a|b|\n|---|:-:|\n|1|2|\n## Second title", "as shown [1], [2-3] and (4), in (2020) x² by Smith (2021) and [Lee et al., 2019] (Jones and Brown, 2018)",
    "Name: ____\nDate: ____\n[ ] yes [ ] no\nSign: ______", "Journal of Things, Volume 12\ndoi:10.1000/182\nwww.journal.org 2021\nno number in this article", "∑ x ≤ 1 [1]\n∫ y et al 2001\n∞ ≠ 3 [2]\n≈ π [3]\n√ 2 [4]\n± 5 [5]", "a b c d e f g h i j k l m n",
    "same same same same same same same same word word", "\ue000\ue001\ue002\ue003\ue004\ue005\ue006 glyphs lost in a page", "-- ... ,,, ;;; ::: !!! ??? ((( ))) --- ===", "  wide   gaps   in   each   line   of   this\n  and   more   of   them   here   and   there", "", "short", "see mailto:a@b.org, ftp://x.org or mail a@b c. d",
]
_LITERALS = " ".join(f"WHEN {2 * k} THEN '{t}'" for k, t in enumerate(VARIED))
#: SQL for the same corpus, and for its lines.
VARIED_CORPUS = f"corpus AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CASE doc_id % {2 * len(VARIED)} {_LITERALS} ELSE text END AS text, doc_id FROM documents)"


VARIED_LINES = VARIED_CORPUS + LINES[len(CORPUS) :]
VARIED_DOC_LINES = VARIED_LINES + DOC_LINES[len(LINES) :]


def varied(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    for k, t in enumerate(VARIED):
        text = F.when(F.col("doc_id") % (2 * len(VARIED)) == 2 * k, F.lit(t)).otherwise(text)
    return docs(spark, sf).withColumn("text", text)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = shipping(f)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents_corpus(spark, sf)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """events as benchmark samples."""
    e = src.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("iteration"), F.lit("1k").alias("scale"), F.col("event_type").alias("tool"), F.concat(F.lit("day-"), F.date_format("ts", "yyyy-MM-dd")).alias("scenario"),
        F.when(k >= 50, 8).otherwise(1).alias("concurrency"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target"), (k < 10).alias("is_warmup"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"),
        F.when(k >= 20, F.struct((k.cast("long") * 1048576).alias("peak_working_set_bytes"), F.col("value").alias("delta_cpu_ms"))).alias("resource_delta"),
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """events as calls that last value minutes."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return src.table(spark, sf, "events").select("user_id", F.col("event_id").alias("call_id"), start.alias("start_us"), (start + F.round(F.col("value") * 60000).cast("long") * 1000).alias("end_us"))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds between a user's events."""
    e = src.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return e.select("user_id", ((F.col("us") - F.lag("us").over(w)) / 1e6).alias("gap"))


# Sources and scans


@query(f"WITH {CORPUS} SELECT path, octet_length(encode(text)) AS n_bytes, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n_lines, string_split(path, '/')[-1] AS name, 'txt' AS ext, len(string_split(path, '/')) AS depth FROM corpus")
def scan_corpus(spark, sf):
    d = src.with_path_parts(docs(spark, sf))
    return d.select("path", F.octet_length("text").cast("long").alias("n_bytes"), F.size(search.split_lines(F.col("text"))).cast("long").alias("n_lines"), "name", "ext", F.col("depth").cast("long"))


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE starts_with(path, 'src1/en/') AND ends_with(path, '.txt')")
def glob_prefix(spark, sf):
    glob = "src1/en/*.txt"
    parts = zip(["source", "lang"], literal_prefix(glob).split("/")[:-1], strict=False)
    d = docs(spark, sf)
    for name, value in parts:  # the directories that the glob names in full are columns, which the scan filters by
        d = d.where(F.col(name) == value)
    return d.where(glob_matches(F.col("path"), glob)).select("path")


PAGE_PATH = "pg AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)"


@query(f"WITH {PAGE_PATH}, p AS (SELECT page_id, path, string_split(path, '/') AS c FROM pg) SELECT page_id, path FROM p WHERE NOT list_has_any(c[1:len(c)-1], ['.git','node_modules','target','.venv','venv','dist','build','__pycache__','es','fr'])")
def scan_denied(spark, sf):
    return src.without_denied(src.pages_corpus(spark, sf), [*src.DENIED, "es", "fr"]).select("page_id", "path")


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE NOT ((regexp_matches(path, '^(.*/)?src1[^/]*/') AND NOT starts_with(path, 'src10/')) OR regexp_matches(path, '^src2/en/[^/]*[.]txt$') OR regexp_matches(path, '(^|/)[^/]*9[.]txt$'))")
def scan_ignored(spark, sf):
    return docs(spark, sf).where(~ignored(F.col("path"), ["# generated", "src1*/", "!src10/", "/src2/en/*.txt", "*9.txt"])).select("path")


# Search


@query(f"WITH {LINES} SELECT path, CAST(sum(len(regexp_extract_all(line, 'the'))) AS BIGINT) AS occurrences FROM lines GROUP BY path HAVING sum(len(regexp_extract_all(line, 'the'))) > 0")
def grep_count(spark, sf):
    return search.occurrence_counts(docs(spark, sf), Search("the", case="sensitive"))


@query(f"WITH {LINES} SELECT DISTINCT path FROM lines WHERE regexp_matches(line, '[a-z]+tion (of|and) th')")
def grep_regex(spark, sf):
    return search.matching_files(docs(spark, sf), Search("[a-z]+tion (of|and) th", case="sensitive"))


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE contains(text, 'er. ')")
def grep_fixed(spark, sf):
    return docs(spark, sf).where(F.col("text").contains("er. ")).select("path")


@query(f"WITH {LINES} SELECT path, CAST(sum(len(regexp_extract_all(line, '(?i)tion'))) AS BIGINT) AS occurrences FROM lines GROUP BY path HAVING sum(len(regexp_extract_all(line, '(?i)tion'))) > 0")
def grep_smart_case(spark, sf):
    return search.occurrence_counts(docs(spark, sf), Search("tion"))


@query(f"WITH {LINES} SELECT DISTINCT path FROM lines WHERE regexp_matches(line, '^The ')")
def grep_files(spark, sf):
    return search.matching_files(docs(spark, sf), Search("^The "))


@query(f"WITH {LINES} SELECT path, line_no, CAST(unnest(range(1, len(regexp_extract_all(line, 'er the')) + 1)) AS BIGINT) AS occ, line FROM lines WHERE regexp_matches(line, 'er the')")
def grep_content(spark, sf):
    return search.contents(docs(spark, sf), Search("er the", case="sensitive"))


@query(f"WITH {LINES}, hit AS (SELECT *, regexp_matches(line, 'er the') AS m FROM lines), near AS (SELECT *, max(CAST(m AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k FROM hit) SELECT path, line_no, CASE WHEN m THEN 'match' ELSE 'context' END AS kind, line FROM near WHERE k = 1")
def grep_context(spark, sf):
    return search.with_context(docs(spark, sf), Search("er the", case="sensitive"), 1, 1)


@query(f"WITH {LINES}, h AS (SELECT path, line_no, line, row_number() OVER (ORDER BY path, line_no) AS r FROM lines WHERE regexp_matches(line, 'er the')), m AS (SELECT count(*) AS n FROM h) SELECT path, line_no, line, CASE WHEN n > 250 THEN CAST(250 AS BIGINT) END AS next_offset FROM h, m WHERE r > 50 AND r <= 250")
def grep_page(spark, sf):
    wanted = Search("er the", case="sensitive")
    found = search.lines(search.candidates(docs(spark, sf), wanted)).where(wanted.found(F.col("line")))
    return search.page(found, ["path", "line_no"], 50, 200)


@query(f"WITH {LINES}, c AS (SELECT path, sum(len(regexp_extract_all(line, 'the'))) AS n FROM lines GROUP BY path) SELECT count(*) AS file_count, CAST(sum(n) AS BIGINT) AS hit_count FROM c WHERE n > 0")
def grep_summary(spark, sf):
    return search.summary(search.occurrence_counts(docs(spark, sf), Search("the", case="sensitive")))


@query(f"WITH {PAGE_PATH} SELECT page_id, path FROM pg WHERE regexp_full_match(path, '([^/]+/)*en/[0-9]?[^/]*')")
def glob_match(spark, sf):
    return src.pages_corpus(spark, sf).where(glob_matches(F.col("path"), "**/en/*")).select("page_id", "path")


@query(f"WITH {CORPUS} SELECT path, false AS is_dir FROM corpus UNION SELECT source, true FROM corpus UNION SELECT source || '/' || lang, true FROM corpus")
def glob_type(spark, sf):
    return src.entries(docs(spark, sf)).select("path", "is_dir")


@query(f"WITH {CORPUS}, t AS (SELECT path, CASE doc_id % 20 WHEN 0 THEN NULL WHEN 1 THEN text || chr(0) WHEN 2 THEN repeat('x', 70000) ELSE text END AS text FROM corpus), r AS (SELECT path, CASE WHEN text IS NULL THEN 'unreadable' WHEN contains(text, chr(0)) THEN 'binary' WHEN len([l for l in string_split(text, chr(10)) if octet_length(encode(l)) > 65536]) > 0 THEN 'line_too_long' END AS reason FROM t) SELECT reason, count(*) AS total, array_to_string(list(path ORDER BY path)[1:32], ' ') AS sample FROM r WHERE reason IS NOT NULL GROUP BY reason")
def skip_reasons(spark, sf):
    text = F.when(F.col("doc_id") % 20 == 1, F.concat("text", F.lit("\0"))).when(F.col("doc_id") % 20 == 2, F.repeat(F.lit("x"), F.lit(70000))).when(F.col("doc_id") % 20 > 0, F.col("text"))
    return search.skip_notes(docs(spark, sf).withColumn("text", text)).withColumn("sample", F.array_join("sample", " "))


@query(f"WITH {LINES} SELECT path, line_no FROM lines WHERE regexp_matches(line, 'er the') AND (path > 'src1' OR (path = 'src1' AND line_no > 3)) ORDER BY path, line_no LIMIT 100")
def grep_page_after(spark, sf):
    found = search.lines(search.candidates(docs(spark, sf), Search("er the", case="sensitive"))).where(Search("er the", case="sensitive").found(F.col("line")))
    return search.page_after(found, ["path", "line_no"], ("src1", 3), 100).select("path", "line_no")


@query(f"WITH {CORPUS}, a AS (SELECT path FROM corpus WHERE contains(text, 'the')), b AS (SELECT path FROM corpus WHERE contains(text, 'tion')) SELECT path, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT path, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def path_set_diff(spark, sf):
    d = docs(spark, sf)
    return reports.set_difference(d.where(F.col("text").contains("the")).select("path"), d.where(F.col("text").contains("tion")).select("path"))


# Reading and budgets


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE line_no BETWEEN 3 AND 12")
def read_slice(spark, sf):
    return reading.line_slice(docs(spark, sf), 3, 10)


@query(f"WITH {LINES} SELECT path, line_no, octet_length(encode(line)) > 512 AS truncated, md5(CASE WHEN octet_length(encode(line)) <= 512 THEN line ELSE left(line, list_max([k for k in range(0, least(length(line), 512) + 1) if octet_length(encode(left(line, k))) <= 512])) END) AS cut FROM lines")
def read_truncate(spark, sf):
    d = search.lines(docs(spark, sf)).withColumn("t", reading.truncated(F.col("line"), 512))
    return d.select("path", "line_no", "t.truncated", F.md5(F.col("t.text").cast("binary")).alias("cut"))


@query(f"WITH {LINES}, u AS (SELECT path, line_no, CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) AS used FROM lines) SELECT path, line_no, used FROM u WHERE line_no = 1 OR used <= 2048")
def read_budget(spark, sf):
    return reading.read_budget(docs(spark, sf), 2048).select("path", "line_no", "used")


@query(f"WITH {LINES}, u AS (SELECT path, line_no, CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) AS used FROM lines) SELECT path, line_no, used FROM u WHERE used <= 1000")
def page_budget(spark, sf):
    return reading.page_budget(docs(spark, sf), 1000)


@query("WITH c AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS page_count FROM conversations) SELECT conv_id, turn, page_count FROM c WHERE turn BETWEEN 1 AND least(3, page_count)")
def page_slice(spark, sf):
    return reading.page_slice(src.table(spark, sf, "conversations"), "conv_id", "turn", 1, 3).select("conv_id", "turn", "page_count")


@query(f"WITH {CORPUS} SELECT path, left(text, CASE WHEN length(text) <= 200 THEN length(text) ELSE 100 END) AS head, CASE WHEN length(text) <= 200 THEN '' ELSE right(text, 100) END AS tail, greatest(length(text) - 200, 0) AS omitted FROM corpus")
def head_tail(spark, sf):
    return docs(spark, sf).select("path", reading.head_tail(F.col("text"), 200).alias("h")).select("path", F.when(F.col("h.omitted") > 0, F.col("h.head")).otherwise(F.concat("h.head", "h.tail")).alias("head"), F.when(F.col("h.omitted") > 0, F.col("h.tail")).otherwise("").alias("tail"), "h.omitted")


@query("SELECT page_id, octet_length(encode(html)) AS total, greatest(octet_length(encode(html)) - 64, 0) AS start, right(hex(encode(html)), 128) AS data FROM pages")
def log_tail(spark, sf):
    p = src.table(spark, sf, "pages").select("page_id", reading.tail_bytes(F.col("html").cast("binary"), 64).alias("t"))
    return p.select("page_id", "t.total", F.col("t.start").cast("long").alias("start"), F.hex("t.data").alias("data"))


@query(f"WITH {CORPUS}, b AS (SELECT path, hex(encode(text)) AS h FROM corpus), c AS (SELECT path, h, substr(h, 201, 666) AS d FROM b), e AS (SELECT path, d, length(d) // 2 AS n, [k for k in range(1, 5) if k <= length(d) // 2 AND substr(d, length(d) - 2 * k + 1, 1) NOT IN ('8', '9', 'A', 'B')][1] AS lead FROM c), w AS (SELECT *, substr(d, length(d) - 2 * lead + 1, 1) AS f FROM e) SELECT path, CASE WHEN lead < (CASE f WHEN 'F' THEN 4 WHEN 'E' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 2 ELSE 0 END) THEN left(d, 2 * (n - lead)) ELSE d END AS data, 100 + length(CASE WHEN lead < (CASE f WHEN 'F' THEN 4 WHEN 'E' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 2 ELSE 0 END) THEN left(d, 2 * (n - lead)) ELSE d END) // 2 AS next_cursor FROM w")
def log_cursor(spark, sf):
    f = docs(spark, sf).select("path", F.col("text").cast("binary").alias("content"), F.lit(100).cast("long").alias("cursor"), F.lit(False).alias("finalized"))
    return reading.cursor_page(f, 333).withColumn("data", F.hex("data"))


@query(f"WITH {CORPUS}, c AS (SELECT path, left(md5(path), 16) || CASE WHEN length(path) > 14 THEN '.' || CAST(doc_id AS VARCHAR) WHEN length(path) > 13 THEN '.x' ELSE '' END AS cursor FROM corpus) SELECT path, CASE WHEN regexp_full_match(cursor, '[0-9a-f]{{16}}([.][0-9]{{1,18}})?') THEN left(cursor, 16) END AS id, CASE WHEN regexp_full_match(cursor, '[0-9a-f]{{16}}([.][0-9]{{1,18}})?') THEN CAST(coalesce(nullif(regexp_extract(cursor, '[.]([0-9]+)$', 1), ''), '0') AS BIGINT) END AS at FROM c")
def cursor_parse(spark, sf):
    n = F.length("path")
    cursor = F.concat(F.left(F.md5(F.col("path").cast("binary")), F.lit(16)), F.when(n > 14, F.concat(F.lit("."), F.col("doc_id").cast("string"))).when(n > 13, ".x").otherwise(""))
    return docs(spark, sf).select("path", reading.cursor_parse(cursor).alias("c")).select("path", "c.id", "c.at")


@query(f"WITH {VARIED_CORPUS} SELECT path, CAST(len(regexp_extract_all(text, '[一-鿿]')) AS DOUBLE) / greatest(length(text), 1) AS ratio FROM corpus")
def cjk_ratio(spark, sf):
    return varied(spark, sf).select("path", tx.cjk_ratio(F.col("text")).alias("ratio"))


@query(f"WITH {VARIED_CORPUS} SELECT path, least(20480, CAST(floor((CAST(5.17 AS DOUBLE) - CAST(len(regexp_extract_all(text, '[一-鿿]')) AS DOUBLE) / greatest(length(text), 1) * 3.0) * 10000) AS BIGINT)) AS bytes FROM corpus")
def cjk_budget(spark, sf):
    return varied(spark, sf).select("path", tx.byte_budget(F.col("text"), 20480).alias("bytes"))


@query(f"WITH {CORPUS} SELECT path, octet_length(encode(text)) + len(regexp_extract_all(text, '[\"\\\\\\x08\\t\\n\\x0C\\r]')) + 5 * len(regexp_extract_all(text, '[\\x00-\\x07\\x0B\\x0E-\\x1F]')) AS encoded FROM corpus")
def json_len(spark, sf):
    return docs(spark, sf).select("path", tx.json_length(F.col("text")).alias("encoded"))


@query(f"WITH {CORPUS} SELECT path, CASE WHEN octet_length(encode(text)) <= 512 THEN octet_length(encode(text)) END AS tokens, CASE WHEN octet_length(encode(text)) <= 512 THEN octet_length(encode(text)) + 128 END AS projected FROM corpus")
def token_bound(spark, sf):
    t = tx.token_bound(F.col("text"), 4096)["tokens"]
    return docs(spark, sf).select("path", t.alias("tokens"), tx.projected_tokens(t, F.lit(0)).alias("projected"))


@query()
def pretokens(spark, sf):
    return docs(spark, sf).select("path", pandas_text.pretokens("text").alias("pretokens"))


# Benchmark reports


@query(f"WITH {SAMPLES}, m AS (SELECT scale, tool, scenario, concurrency, target, list_sort(list(duration_ms)) AS v, median(duration_ms) AS p50 FROM samples WHERE NOT is_warmup AND status = 'ok' GROUP BY ALL) SELECT scale, tool, scenario, concurrency, target, len(v) AS n, p50, v[greatest(1, least(len(v), CAST(floor(len(v) * CAST(0.95 AS DOUBLE)) AS BIGINT)))] AS p95 FROM m")
def bench_latency(spark, sf):
    return reports.latency(samples(spark, sf))


@query(f"WITH {SAMPLES} SELECT tool, quantile_disc(duration_ms, CAST(0.95 AS DOUBLE)) AS p95 FROM samples GROUP BY tool")
def bench_p95_disc(spark, sf):
    return samples(spark, sf).groupBy("tool").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95"))


@query(f"WITH {SAMPLES} SELECT scale, tool, scenario, concurrency, target, count(*) AS n, round(CASE WHEN avg(duration_ms) > 0 THEN concurrency * CAST(1000.0 AS DOUBLE) / avg(duration_ms) ELSE 0 END, 6) AS ops FROM samples WHERE NOT is_warmup AND status = 'ok' GROUP BY scale, tool, scenario, concurrency, target")
def bench_ops(spark, sf):
    return reports.throughput(samples(spark, sf)).withColumn("ops", F.round("ops", 6))


@query(f"WITH {SAMPLES} SELECT scale, scenario AS round_key, target, arg_min(duration_ms, iteration) AS wall_ms, count(*) FILTER (success) AS ok, count(*) AS total FROM samples GROUP BY ALL")
def bench_rounds(spark, sf):
    return reports.rounds(samples(spark, sf).withColumn("round_key", F.col("scenario")))


@query(f"WITH {SAMPLES}, r AS (SELECT s.*, CAST(props->>'$.k' AS BIGINT) AS k FROM samples s JOIN events e ON e.event_id = s.iteration) SELECT scale, tool, scenario, target, CAST(max(k) AS DOUBLE) AS peak_mib, round(avg(duration_ms), 6) AS cpu_ms FROM r WHERE NOT is_warmup AND status = 'ok' AND k >= 20 GROUP BY ALL")
def bench_resources(spark, sf):
    return reports.resources(samples(spark, sf)).withColumn("cpu_ms", F.round("cpu_ms", 6))


@query(f"WITH {SAMPLES} SELECT target, tool, scenario, status, count(*) AS n FROM samples WHERE status IN ('unsupported', 'skipped') AND NOT is_warmup GROUP BY ALL")
def bench_skipped(spark, sf):
    return reports.skipped(samples(spark, sf))


@query("SELECT user_id, max(value) AS peak, greatest(arg_max(CAST(props->>'$.k' AS BIGINT), event_id) - arg_min(CAST(props->>'$.k' AS BIGINT), event_id), 0) AS delta FROM events GROUP BY user_id")
def resource_delta(spark, sf):
    e = src.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return reports.resource_delta(e, ["user_id"], "event_id", "value", "k")


@query("SELECT event_type, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM events GROUP BY event_type")
def upper_median(spark, sf):
    r = reports.ranked(src.table(spark, sf, "events"), ["event_type"], "value")
    return r.where(F.col("_rank") == F.floor(F.col("_n") / 2)).select("event_type", F.col("value").alias("upper_median"))


@query(f"WITH {GAPS} SELECT user_id, count(gap) AS n, round(min(gap), 3) AS least, round(max(gap), 3) AS most, round(avg(gap), 3) AS mean, round(stddev_pop(gap), 3) AS deviation, round(quantile_cont(gap, CAST(0.25 AS DOUBLE)), 3) AS p25, round(quantile_cont(gap, CAST(0.5 AS DOUBLE)), 3) AS median, round(quantile_cont(gap, CAST(0.75 AS DOUBLE)), 3) AS p75 FROM gaps WHERE gap IS NOT NULL GROUP BY user_id")
def gap_stats(spark, sf):
    g = reports.gap_statistics(gaps(spark, sf), ["user_id"])
    return g.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("least", "most", "p25", "median", "p75", "mean", "deviation")])


@query(f"WITH {GAPS} SELECT user_id, round(CASE WHEN count(gap) < 10 THEN CAST(0.1 AS DOUBLE) ELSE least(greatest(quantile_cont(gap, CAST(0.5 AS DOUBLE)) * CAST(1.5 AS DOUBLE), CAST(3600 AS DOUBLE)), CAST(40000 AS DOUBLE)) END, 3) AS threshold FROM gaps WHERE gap IS NOT NULL GROUP BY user_id")
def gap_threshold(spark, sf):
    g = reports.adaptive_threshold(reports.gap_statistics(gaps(spark, sf), ["user_id"]), 1.5, 3600.0, 40000.0)
    return g.select("user_id", F.round("threshold", 3).alias("threshold"))


@query("WITH s AS (SELECT lang, CAST(floor(sqrt(n_chars)) AS BIGINT) AS size, CAST(sum(n_chars) AS BIGINT) AS weight FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, size) AS k FROM s) SELECT lang, size, weight FROM r WHERE k = 1")
def weighted_mode(spark, sf):
    d = src.table(spark, sf, "documents").withColumn("size", F.floor(F.sqrt("n_chars")).cast("long"))
    return reports.weighted_mode(d, ["lang"], "size", "n_chars")


# Logs, jobs, bursts


@query("""WITH e AS (SELECT user_id, event_id, CAST(event_type = 'error' AS INT) AS err FROM events),
s AS (SELECT *, coalesce(sum(err) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e),
r AS (SELECT *, max(err) OVER (PARTITION BY user_id, seg) AS has, row_number() OVER (PARTITION BY user_id, seg ORDER BY event_id DESC) AS back FROM s)
SELECT user_id, event_id, err = 0 AS context FROM r WHERE has = 1 AND back <= 5""")
def flight_recorder(spark, sf):
    e = src.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return logs.flight_recorder(e, "user_id", "event_id", F.col("event_type") == "error", 4).select("user_id", "event_id", "context")


LOG_FILES = "files AS (SELECT CAST(ts AS DATE) AS dt, event_type || '.jsonl' AS path, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL)"


def _log_files(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "events").groupBy(F.to_date("ts").alias("dt"), F.concat("event_type", F.lit(".jsonl")).alias("path")).agg(F.sum(F.length("props")).cast("long").alias("bytes"))


@query(f"WITH {LOG_FILES} SELECT (SELECT count(*) FROM files) AS files, CAST((SELECT sum(bytes) FROM files) AS BIGINT) AS bytes, CAST((SELECT min(dt) FROM files) AS VARCHAR) AS oldest, CAST((SELECT max(dt) FROM files) AS VARCHAR) AS newest, CAST((SELECT sum(CAST(props->>'$.k' AS BIGINT)) FROM events) AS BIGINT) AS dropped")
def log_status(spark, sf):
    records = src.table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("dropped_since_last"))
    return logs.status(_log_files(spark, sf), records).withColumns({"oldest": F.col("oldest").cast("string"), "newest": F.col("newest").cast("string")})


@query(f"WITH {LOG_FILES}, p AS (SELECT *, sum(bytes) OVER (ORDER BY dt DESC, path DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM files WHERE dt < DATE '2024-01-28' AND dt >= DATE '2024-01-28' - 20) SELECT CAST(f.dt AS VARCHAR) AS dt, f.path, f.bytes, CASE WHEN f.dt >= DATE '2024-01-28' THEN false WHEN f.dt < DATE '2024-01-28' - 20 THEN true ELSE used > 20000 END AS removed FROM files f LEFT JOIN p USING (dt, path)")
def log_retention(spark, sf):
    return logs.retention(_log_files(spark, sf), F.lit("2024-01-28").cast("date"), 20, 20000).select(F.col("dt").cast("string").alias("dt"), "path", "bytes", "removed")


JOBS = """jobs AS (SELECT user_id * 100 + CAST(props->>'$.k' AS BIGINT) AS job_id, event_id AS "at", CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'terminated' ELSE 'running' END AS state FROM events)"""
JOB_STATES = """st AS (SELECT job_id, min("at") AS started, min("at") FILTER (state <> 'running') AS finished, coalesce(arg_min(state, "at") FILTER (state <> 'running'), arg_max(state, "at")) AS state FROM jobs GROUP BY job_id)"""


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "terminated").otherwise("running")
    return logs.job_states(src.table(spark, sf, "events").select((F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")).alias("job_id"), F.col("event_id").alias("at"), state.alias("state")))


@query(f"WITH {JOBS}, {JOB_STATES} SELECT job_id, started, finished, state FROM st")
def job_states(spark, sf):
    return _jobs(spark, sf)


@query(f"WITH {JOBS}, {JOB_STATES} SELECT job_id, started, finished, state FROM st WHERE finished IS NOT NULL ORDER BY finished DESC, job_id LIMIT 32")
def job_history(spark, sf):
    return logs.job_history(_jobs(spark, sf))


@query(f"WITH {CALLS}, b AS (SELECT *, max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM calls), n AS (SELECT *, CASE WHEN pe IS NULL OR start_us >= pe + 2000000 THEN 1 ELSE 0 END AS new FROM b) SELECT user_id, call_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY start_us, call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst_id FROM n")
def burst_sessions(spark, sf):
    return logs.bursts(calls(spark, sf), "user_id", "start_us", "end_us").select("user_id", "call_id", "burst_id")


# Text functions


@query(f"WITH {VARIED_CORPUS} SELECT path, array_to_string([array_to_string([trim(regexp_replace(l, '[\\t-\\r \\x{{85}}\\x{{A0}}\\x{{3000}}]+', ' ', 'g')) for l in string_split(p, chr(10)) if trim(regexp_replace(l, '[\\t-\\r \\x{{85}}\\x{{A0}}\\x{{3000}}]+', ' ', 'g')) <> ''], chr(10)) for p in string_split(text, chr(10) || chr(10))], chr(10) || chr(10)) AS normal FROM corpus")
def ws_normalize(spark, sf):
    return varied(spark, sf).select("path", tx.normalize_space(F.col("text")).alias("normal"))


@query(f"WITH {VARIED_CORPUS}, u AS (SELECT path, text, CASE WHEN contains(text, '://') OR contains(text, 'www.') THEN regexp_replace(text, '(https?://[^\\s<>\\[\\]]*[^\\s<>\\[\\].,!?;:])', '[\\1](\\1)', 'g') ELSE text END AS x FROM corpus) SELECT path, CASE WHEN contains(text, '@') THEN regexp_replace(x, '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', '[\\1](mailto:\\1)', 'g') ELSE x END AS linked FROM u")
def linkify(spark, sf):
    return varied(spark, sf).select("path", tx.linkify(F.col("text")).alias("linked"))


@query(f"WITH {VARIED_CORPUS}, l AS (SELECT path, text, lower(text) AS low, strpos(text, '@') AS k FROM corpus) SELECT path, length(text) >= 7 AND (contains(low, 'http://') OR contains(low, 'https://') OR contains(low, 'ftp://') OR contains(low, 'mailto:')) AS url, k > 0 AND contains(substr(text, k + 1), '.') AS email FROM l")
def has_url_email(spark, sf):
    return varied(spark, sf).select("path", tx.has_url(F.col("text")).alias("url"), tx.has_email(F.col("text")).alias("email"))


@query(f"WITH {VARIED_CORPUS} SELECT path, " + ", ".join(f"len(regexp_extract_all(text, '{e}')){' - len(regexp_extract_all(text, ' + chr(39) + r'\(\d{4}\)' + chr(39) + '))' if k == 'paren' else ''} AS {k}" for k, e in tx.CITATIONS) + " FROM corpus")
def citation_counts(spark, sf):
    return varied(spark, sf).select("path", *[c.alias(k) for k, c in tx.citation_counts(F.col("text")).items()])


@query()
def citations(spark, sf):
    return varied(spark, sf).select("path", F.explode(pandas_text.citations("text")).alias("c")).select("path", "c.*")


@query(f"""WITH {VARIED_CORPUS}, w AS (SELECT path, text, length(text) AS total, [x for x in string_split(regexp_replace(text, '[\\t-\\r \\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ' ', 'g'), ' ') if x <> ''] AS words FROM corpus),
m AS (SELECT path, total, len(words) AS n, len(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ゟ゠-ヿ가-힣]')) > 0.5 * len(regexp_extract_all(text, '[^\\s]')) AS cjk, len(regexp_extract_all(text, '[\\x00-\\x08\\x0E-\\x1F\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]')) AS bad, len([x for x in words if length(x) <= 2]) / len(words) AS frag,
 len([i for i in range(1, len(words)) if words[i] = words[i + 1]]) / len(words) AS rep, list_sum([length(x) for x in words]) / len(words) AS mean, len(regexp_extract_all(text, '[\\pL\\pN]')) / total AS alnum FROM w)
SELECT path, CASE WHEN total < 16 THEN NULL WHEN bad / total > 0.20 THEN 'glyph_mapping_missing' WHEN n >= 8 AND frag > 0.80 AND NOT cjk THEN 'glyph_mapping_missing' WHEN n >= 8 AND (rep > 0.30 OR (frag > 0.55 AND mean < 2.5 AND NOT cjk)) THEN 'below_threshold' WHEN alnum < 0.20 THEN 'below_threshold' END AS reason FROM m""")
def quality_gate(spark, sf):
    return varied(spark, sf).select("path", tx.quality_gate(F.col("text")).alias("reason"))


SQL["page_state"] = SQL["quality_gate"].replace("SELECT path, CASE WHEN total < 16 THEN NULL", "SELECT path, CASE WHEN n = 0 THEN 'blank' WHEN total < 16 THEN 'text_ready'").replace("'glyph_mapping_missing'", "'text_uncertain'").replace("'below_threshold'", "'text_uncertain'").replace("END AS reason", "ELSE 'text_ready' END AS state")


@query(SQL["page_state"])
def page_state(spark, sf):
    return varied(spark, sf).select("path", tx.page_state(F.col("text"), F.lit(False)).alias("state"))


def _document_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: lines, bytes of a line (mean, deviation), shares of justified, form and citation lines, math lines, and gaps between words in ems."""
    d = search.lines(varied(spark, sf)).select("path", F.trim("line").alias("line")).where("line <> ''")
    line = F.col("line")
    gaps = F.transform(F.regexp_extract_all(line, F.lit(" +"), F.lit(0)), lambda g: F.length(g).cast("long"))
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("g", "g2", "gn", "tight")])
    step = lambda s, g: F.struct((s["g"] + g).alias("g"), (s["g2"] + g * g).alias("g2"), (s["gn"] + 1).alias("gn"), (s["tight"] + (g < 2).cast("long")).alias("tight"))
    # Where no gap is wider than a space, all four are the number of spaces.
    spaces = (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))).cast("long")
    plain = F.struct(*[spaces.alias(c) for c in ("g", "g2", "gn", "tight")])
    d = with_struct(d, "s", F.when(line.contains("  "), F.aggregate(gaps, start, step)).otherwise(plain))
    s = d.groupBy("path").agg(
        F.count("*").alias("line_count"), F.avg(F.octet_length(line)).alias("mean_bytes"), F.stddev_pop(F.octet_length(line)).alias("deviation"), (F.avg(tx.looks_justified(line).cast("int")) * 100).alias("justified"),
        (F.avg(tx.is_form(line).cast("int")) * 100).alias("form"), (F.avg(tx.is_citation_line(line).cast("int")) * 100).alias("cites"), F.sum(tx.is_math_line(line).cast("int")).alias("math"),
        *[F.sum(f"s.{c}").alias(c) for c in ("g", "g2", "gn", "tight")],
    )
    mean = F.try_divide("g", "gn")
    spread = F.sqrt(F.greatest(F.try_divide("g2", "gn") - mean * mean, F.lit(0.0))) * 0.1
    return s.withColumns({"gap_mean": F.coalesce(mean * 0.1, F.lit(0.0)), "gap_deviation": F.coalesce(spread, F.lit(0.0)), "tightness": F.coalesce(F.try_divide("tight", "gn"), F.lit(0.0))})


DOC_STATS = VARIED_DOC_LINES + r""", f AS (SELECT path, octet_length(encode(line)) AS b, CAST(contains(line, '  ') AND len(regexp_split_to_array(line, '\s+')) > 5 AS INT) AS justified,
 CAST(length(line) - length(replace(line, '_', '')) >= 3 OR regexp_matches(line, '[\[\]☐☒□]') AS INT) AS form,
 CAST(contains(line, 'et al') OR contains(line, 'et. al') OR (contains(line, '[') AND contains(line, ']')) OR regexp_matches(line, '19\d\d|20\d\d|2100') AS INT) AS cites,
 CAST(regexp_matches(line, '[∑∫∂∇√∞≈≠≤≥±×÷αβγδεθλμπσω]') AS INT) AS math, [length(x) for x in regexp_extract_all(line, ' +')] AS gaps FROM t),
g AS (SELECT *, coalesce(list_sum(gaps), 0) AS g, coalesce(list_sum([x * x for x in gaps]), 0) AS g2, len(gaps) AS gn, len([x for x in gaps if x < 2]) AS tight FROM f),
s AS (SELECT path, count(*) AS line_count, avg(b) AS mean_bytes, stddev_pop(b) AS deviation, avg(justified) * 100 AS justified, avg(form) * 100 AS form, avg(cites) * 100 AS cites, CAST(sum(math) AS BIGINT) AS math,
 coalesce(sum(g) / nullif(sum(gn), 0) * 0.1, 0) AS gap_mean, coalesce(sqrt(greatest(sum(g2) / nullif(sum(gn), 0) - (sum(g) / nullif(sum(gn), 0)) * (sum(g) / nullif(sum(gn), 0)), 0)) * 0.1, 0) AS gap_deviation, coalesce(sum(tight) / nullif(sum(gn), 0), 0) AS tightness FROM g GROUP BY path)"""


@query(f"WITH {DOC_STATS} SELECT path, line_count, math, " + ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in ("mean_bytes", "deviation", "justified", "form", "cites", "gap_mean", "tightness")) + " FROM s")
def doc_stats(spark, sf):
    return _document_stats(spark, sf).select("path", "line_count", "math", *[F.round(c, 4).alias(c) for c in ("mean_bytes", "deviation", "justified", "form", "cites", "gap_mean", "tightness")])


@query(f"WITH {DOC_STATS} SELECT path, CASE WHEN form > 15 THEN 'form' WHEN math > 5 AND cites > 5 THEN 'academic' WHEN justified > 30 AND gap_deviation > 1 AND form < 5 THEN 'policy' WHEN tightness > 0.7 AND math > 2 THEN 'academic' WHEN deviation < 10 AND justified > 20 THEN 'government' ELSE 'mixed' END AS doc_type FROM s")
def doc_type(spark, sf):
    c = F.col
    kind = (
        F.when(c("form") > 15, "form").when((c("math") > 5) & (c("cites") > 5), "academic").when((c("justified") > 30) & (c("gap_deviation") > 1) & (c("form") < 5), "policy")
        .when((c("tightness") > 0.7) & (c("math") > 2), "academic").when((c("deviation") < 10) & (c("justified") > 20), "government").otherwise("mixed")
    )
    return _document_stats(spark, sf).select("path", kind.alias("doc_type"))


@query(f"WITH {VARIED_LINES}, t AS (SELECT trim(line) AS t FROM lines) SELECT CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^(```|~~~)') THEN 'fence' WHEN regexp_matches(t, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(t, '^\\|( *[-:]+ *\\|){{2,}}$') THEN 'table_separator' WHEN regexp_matches(t, '^\\|.*\\|$') THEN 'table' WHEN regexp_matches(t, '^>') THEN 'quote' WHEN regexp_matches(t, '^([-*+]|\\d+[.)]) ') THEN 'list' WHEN regexp_matches(t, '^(-( *-){{2,}}|\\*( *\\*){{2,}}|_( *_){{2,}})$') THEN 'rule' ELSE 'text' END AS kind, count(*) AS n FROM t GROUP BY 1")
def md_line_kind(spark, sf):
    return search.lines(varied(spark, sf)).groupBy(tx.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {VARIED_CORPUS} SELECT path, " + ", ".join(f"len(regexp_extract_all(text, '[{r}]')) AS {k}" for k, r in tx.SCRIPTS.items()) + ", CASE WHEN regexp_matches(text, '[぀-ゟ゠-ヿ]') THEN 'japanese' WHEN regexp_matches(text, '[가-힣]') THEN 'korean' WHEN regexp_matches(text, '[一-鿿㐀-䶿]') THEN 'chinese' END AS language FROM corpus")
def script_counts(spark, sf):
    return varied(spark, sf).select("path", *[c.alias(k) for k, c in tx.script_counts(F.col("text")).items()], tx.inferred_language(F.col("text")).alias("language"))


@query("WITH p AS (SELECT conv_id, turn, unnest(string_split(CASE WHEN conv_id % 3 = 0 THEN 'Report 7, page ' || CAST(turn AS VARCHAR) || chr(10) || text ELSE text END, chr(10))) AS line FROM conversations), b AS (SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(line, '[0-9]', '', 'g'), '\\s+', ' ', 'g'))) AS band FROM p), c AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM b GROUP BY 1), s AS (SELECT conv_id, band, count(DISTINCT turn) AS n FROM b WHERE length(band) > 3 GROUP BY 1, 2) SELECT conv_id, band, n, pages FROM s JOIN c USING (conv_id) WHERE pages >= 3 AND n >= greatest(2, ceil(pages * CAST(0.3 AS DOUBLE)))")
def repeated_lines(spark, sf):
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Report 7, page "), F.col("turn").cast("string"), F.lit("\n"), "text")).otherwise(F.col("text"))
    p = src.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split(text, "\n")).alias("line"))
    return layout.running_lines(p.withColumn("band", tx.band_line(F.col("line"))), "conv_id", "turn", "band", 0.3).select("conv_id", "band", "n", "pages")


@query(f"WITH {LINES}, n AS (SELECT path, line_no, line, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS norm FROM lines), p AS (SELECT *, lag(norm) OVER (PARTITION BY path ORDER BY line_no) AS before FROM n) SELECT path, line_no FROM p WHERE before IS NULL OR before <> norm")
def dedup_paragraphs(spark, sf):
    d = search.lines(docs(spark, sf)).withColumn("norm", F.lower(tx.collapse_space(F.col("line"))))
    before = F.lag("norm").over(Window.partitionBy("path").orderBy("line_no"))
    return d.withColumn("before", before).where("before IS NULL OR before <> norm").select("path", "line_no")


@query()
def dehyphenate(spark, sf):
    return docs(spark, sf).select("path", F.md5(pandas_text.dehyphenate(F.regexp_replace("text", "tion ", "-\n")).cast("binary")).alias("joined"))


@query(f"WITH {VARIED_CORPUS} SELECT path, md5(array_to_string([CASE WHEN regexp_matches(r, '^[\\x00-\\x7F]') OR regexp_matches(r, '[^\\x00-\\x{{FF}}]') THEN r ELSE array_to_string([CASE WHEN ord(c) < 192 THEN 'Â' || c ELSE 'Ã' || chr(ord(c) - 64) END for c in string_split(r, '')], '') END for r in regexp_extract_all(text, '[\\x00-\\x7F]+|[^\\x00-\\x7F]+')], '')) AS repaired FROM corpus")
def mojibake(spark, sf):
    """Texts read as Latin-1: runs with a character beyond it come back, others stay as they are."""
    garbled = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    return varied(spark, sf).select("path", F.md5(pandas_text.mojibake(garbled).cast("binary")).alias("repaired"))


@query(f"WITH {CORPUS}, o AS (SELECT path, text, CASE WHEN contains(text, 'idiot') THEN '70' WHEN contains(text, 'license') THEN '1' ELSE '0' END AS code FROM corpus) SELECT path, CASE WHEN code = '0' THEN 'ok' WHEN code = '70' AND len([l for l in string_split(text, chr(10)) if contains(lower(l), 'stupid') AND lower(l) <> 'stupid']) > 0 THEN 'runner_failed' WHEN contains(lower(text), 'public license') THEN 'denied' ELSE 'ok' END AS outcome FROM o")
def outcome_class(spark, sf):
    t = F.col("text")
    code = F.when(t.contains("idiot"), "70").when(t.contains("license"), "1").otherwise("0")
    return docs(spark, sf).select("path", tx.outcome_class(code, t, ["stupid"], ["stupid"], ["public license"], [70]).alias("outcome"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS n FROM events")
def json_counts(spark, sf):
    return src.table(spark, sf, "events").select("event_id", tx.first_int(F.col("props"), ["hit_count", "k", "count"]).alias("n"))


@query(r"""WITH c AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'C:\bin\PWSH.exe -c x' WHEN 1 THEN '"/usr/bin/python" a.py' WHEN 2 THEN 'ls -l' WHEN 3 THEN '  bash.exe -c y' WHEN 4 THEN 'cmd /c dir' WHEN 5 THEN chr(39) || '/opt/a b/node' || chr(39) || ' x' WHEN 6 THEN 'wsl.exe ls' WHEN 7 THEN '' ELSE event_type || ' --flag' END AS x FROM events),
t AS (SELECT event_id, trim(CASE WHEN starts_with(ltrim(x), '"') THEN string_split(x, '"')[2] WHEN starts_with(ltrim(x), chr(39)) THEN string_split(x, chr(39))[2] ELSE string_split(ltrim(x), ' ')[1] END) AS token FROM c),
n AS (SELECT event_id, lower(string_split(replace(token, '\', '/'), '/')[-1]) AS name FROM t), z AS (SELECT event_id, name, CASE WHEN contains(name, '.') THEN left(name, length(name) - strpos(reverse(name), '.')) ELSE name END AS stem FROM n)
SELECT event_id, CASE WHEN name = 'bash.exe' THEN 'wsl' WHEN stem IN ('pwsh', 'powershell') THEN 'pwsh' WHEN stem IN ('cmd', 'wsl') THEN stem WHEN stem IN ('python', 'node', 'perl', 'ruby') THEN 'other-interpreter' ELSE 'none' END AS delegate FROM z""")
def shell_delegate(spark, sf):
    commands = [r"C:\bin\PWSH.exe -c x", '"/usr/bin/python" a.py', "ls -l", "  bash.exe -c y", "cmd /c dir", "'/opt/a b/node' x", "wsl.exe ls", ""]
    command = F.concat("event_type", F.lit(" --flag"))
    for k, c in enumerate(commands):
        command = F.when(F.col("event_id") % 9 == k, F.lit(c)).otherwise(command)
    return src.table(spark, sf, "events").select("event_id", tx.shell_delegate(command).alias("delegate"))


# Layout


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return layout.text_spans(src.table(spark, sf, "conversations"), ["conv_id", "turn"])


@query("WITH ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM conversations), w AS (SELECT conv_id, turn, r, len([x for x in string_split(l, ' ') if x <> '']) AS n FROM ln) SELECT conv_id, turn, count(*) - 1 AS last_line, CAST(sum(n) AS BIGINT) AS words FROM w WHERE n > 0 GROUP BY conv_id, turn")
def cluster_lines(spark, sf):
    return layout.lines_of_page(_spans(spark, sf), ["conv_id", "turn"], 3.0).groupBy("conv_id", "turn").agg(F.max("line").alias("last_line"), F.count("*").alias("words")).withColumn("last_line", F.col("last_line").cast("long"))


@query("""WITH RECURSIVE ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations), wk AS (SELECT conv_id, turn, string_split(l, ' ') AS ws, unnest(range(len(string_split(l, ' ')))) AS k FROM ln),
v AS (SELECT conv_id, turn, list_sort(list(CAST(6 * coalesce(list_sum([length(z) + 1 for z in ws[1:k]]), 0) AS DOUBLE))) AS v FROM wk WHERE ws[k + 1] <> '' GROUP BY conv_id, turn),
c AS (SELECT conv_id, turn, v, 1 AS i, 1 AS k, v[1] AS total, 1 AS n FROM v UNION ALL
 SELECT conv_id, turn, v, i + 1, CASE WHEN abs(v[i + 1] - total / n) <= 12 THEN k ELSE k + 1 END, CASE WHEN abs(v[i + 1] - total / n) <= 12 THEN total + v[i + 1] ELSE v[i + 1] END, CASE WHEN abs(v[i + 1] - total / n) <= 12 THEN n + 1 ELSE 1 END FROM c WHERE i < len(v))
SELECT conv_id, turn, max(k) AS clusters FROM c GROUP BY conv_id, turn""")
def cluster_values(spark, sf):
    return layout.clustered(_spans(spark, sf).select("conv_id", "turn", "seq", "x"), ["conv_id", "turn"], "x", 12.0).groupBy("conv_id", "turn").agg((F.max("cluster") + 1).alias("clusters"))


@query()
def reading_order(spark, sf):
    return layout.reading_order(_spans(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", "seq", "place")


@query("WITH ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r FROM conversations), wk AS (SELECT conv_id, turn, r, string_split(l, ' ') AS ws, unnest(range(len(string_split(l, ' ')))) AS k FROM ln), s AS (SELECT conv_id, turn, CAST(r AS BIGINT) * 100000 + k AS seq, ws[k + 1] AS text, CAST(6 * coalesce(list_sum([length(z) + 1 for z in ws[1:k]]), 0) AS DOUBLE) AS x, CAST(6 * length(ws[k + 1]) AS DOUBLE) AS w FROM wk WHERE ws[k + 1] <> '') SELECT conv_id, turn, seq, text FROM s WHERE x <= 300 AND (least(x + w, 300) - x) / w >= 0.5")
def rect_filter(spark, sf):
    s = _spans(spark, sf)
    boxes = s.groupBy("conv_id", "turn").agg(F.lit(0.0).alias("rx"), F.min("y").alias("ry"), F.lit(300.0).alias("rw"), (F.max("y") - F.min("y") + 10.0).alias("rh"))
    return layout.within(s, boxes, ["conv_id", "turn"]).select("conv_id", "turn", "seq", "text")


# Streams, read up over what is there


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    root = root or "/tmp/textmill-checkpoints"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """events.parquet as a stream; the path is a file or a folder of files."""
    schema = src.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


@query(SQL["burst_sessions"])
def stream_bursts(spark, sf):
    from textmill.streaming.calls import burst_stream, read_up

    start = F.unix_micros(F.col("ts").cast("timestamp"))
    c = _event_stream(spark, sf).select("user_id", F.col("event_id").alias("call_id"), start.alias("start_us"), (start + F.round(F.col("value") * 60000).cast("long") * 1000).alias("end_us"))
    return read_up(spark, burst_stream(c, "user_id"), _folder(spark))


@query(SQL["flight_recorder"])
def stream_flight_recorder(spark, sf):
    from textmill.streaming.calls import read_up, recorder_stream

    c = _event_stream(spark, sf).select("user_id", F.col("event_id").alias("record_id"), (F.col("event_type") == "error").alias("is_error"))
    return read_up(spark, recorder_stream(c, "user_id", 4), _folder(spark)).select("user_id", F.col("record_id").alias("event_id"), "context")


# Cleaning and classes


@query(f"WITH {CORPUS} SELECT path, md5(trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS signature FROM corpus")
def artifact_signature(spark, sf):
    return docs(spark, sf).select("path", F.md5(cl.artifact_signature(F.col("text")).cast("binary")).alias("signature"))


@query(f"WITH {VARIED_LINES} SELECT path, line_no FROM lines WHERE regexp_matches(line, '[0-9]') AND (contains(lower(line), 'doi.org') OR contains(lower(line), 'doi:') OR contains(lower(line), '/doi/') OR contains(lower(line), 'volume') OR contains(lower(line), 'vol.') OR contains(lower(line), 'article') OR contains(lower(line), 'issue') OR (contains(lower(line), 'www.') AND (contains(lower(line), '.org') OR contains(lower(line), '.com') OR contains(lower(line), '.net'))))")
def stable_pagination(spark, sf):
    return search.lines(varied(spark, sf)).where(cl.stable_pagination(F.col("line"))).select("path", "line_no")


@query(f"WITH {CORPUS} SELECT path, len([x for x in string_split(text, chr(10)) if trim(x) <> '' AND NOT (starts_with(lower(trim(x)), '[') OR starts_with(lower(trim(x)), 'the ') OR starts_with(lower(trim(x)), 'de '))]) AS n FROM corpus")
def content_lines(spark, sf):
    return docs(spark, sf).select("path", F.size(cl.content_lines(F.col("text"), ["[", "the ", "de "])).cast("long").alias("n"))


@query(f"WITH {VARIED_LINES} SELECT path, count(*) AS items FROM lines WHERE regexp_matches(line, '^\\s*([-*+] \\s*\\S|[-*+] $|[0-9]+[.)] )') GROUP BY path")
def list_items(spark, sf):
    return search.lines(varied(spark, sf)).where(cl.is_list_item(F.col("line"))).groupBy("path").agg(F.count("*").alias("items"))


@query(f"WITH {CORPUS}, w AS (SELECT path, [trim(c) for c in string_split(text, '|') if trim(c) <> ''] AS c, len(string_split(text, '|')) AS k FROM corpus) SELECT path, k < 5 OR len(c) = 0 OR len([x for x in c if regexp_matches(x, '^[0-9.,%+\\-−$€£]*[0-9][0-9.,%+\\-−$€£]*$')]) * 2 >= len(c) OR len([x for x in c if NOT regexp_matches(x, '\\s')]) <= len(c) * 0.7 AS table_like FROM w")
def table_quality(spark, sf):
    rows = F.array(F.split("text", "[|]", -1))
    return docs(spark, sf).select("path", cl.table_not_prose(rows).alias("table_like"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN q < 5 AND 50 - (q + d * 400) < 5 THEN 'full' WHEN abs(q - (50 - (q + d * 400))) < 10 THEN 'center' WHEN 50 - (q + d * 400) < 5 THEN 'right' WHEN q < 5 AND t * 10 > 0.5 THEN 'full' WHEN q < 5 THEN 'left' ELSE 'none' END AS mode FROM r")
def justification_mode(spark, sf):
    d, q = src.table(spark, sf, "lineitem"), F.col("l_quantity")
    return d.select("l_orderkey", "l_linenumber", cl.justification(F.col("l_tax") * 10, q, q + F.col("l_discount") * 400, F.lit(50.0), F.lit(0.0)).alias("mode"))


@query(f"WITH {LINES}, s AS (SELECT path, count(*) AS n, avg(length(regexp_replace(line, '\\s', '', 'g'))) AS m, avg(CAST(length(line) >= 60 AS INT)) AS w, avg(CAST(regexp_matches(line, '^\\s*[\\[(]?[0-9]+[\\]).]') AS INT)) AS nu, avg(CAST(contains(line, ':') AS INT)) AS f FROM lines GROUP BY path) SELECT path, CASE WHEN n < 6 THEN 'mixed' WHEN m < 10 THEN 'table' WHEN f >= 0.4 THEN 'form' WHEN m > 12 AND nu >= 0.3 THEN 'reference' WHEN m > 20 AND w > 0.5 THEN 'prose' ELSE 'mixed' END AS region FROM s")
def region_class(spark, sf):
    line = F.col("line")
    s = search.lines(docs(spark, sf)).groupBy("path").agg(
        F.count("*").alias("n"), F.avg(F.length(F.regexp_replace(line, r"\s", ""))).alias("m"), F.avg((F.length(line) >= 60).cast("int")).alias("w"),
        F.avg(line.rlike(r"^\s*[\[(]?[0-9]+[\]).]").cast("int")).alias("nu"), F.avg(line.contains(":").cast("int")).alias("f"),
    )
    return s.select("path", cl.region_class(*[F.col(c) for c in ("n", "m", "w", "nu", "f")], F.lit(False)).alias("region"))


@query()
def markdown_clean(spark, sf):
    """Stray pipes escaped and lists tightened."""
    return docs(spark, sf).select("path", F.md5(cl.tighten_lists(pandas_text.escape_stray_pipes(cl.split_ligatures(cl.drop_metadata_lines(F.col("text"))))).cast("binary")).alias("cleaned"))
