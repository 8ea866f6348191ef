"""Queries of paths, results, layout, sinks and reports on made inputs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import cleaning as cl
from textmill.functions import paths
from textmill.functions import text as tx
from textmill.operators import layout, logs, reading, reports
from textmill.plans.queries import CORPUS, LINES, SAMPLES, VARIED_CORPUS, _spans, docs, query, samples, varied
from textmill.sinks import json_lines
from textmill.sources import corpus as src

#: SQL for the words of conversations as spans of a page.
SPANS = """ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r FROM conversations),
wk AS (SELECT conv_id, turn, r, string_split(l, ' ') AS ws, unnest(range(len(string_split(l, ' ')))) AS k FROM ln),
spans AS (SELECT conv_id, turn, r, CAST(r AS BIGINT) * 100000 + k AS seq, ws[k + 1] AS text, CAST(6 * coalesce(list_sum([length(z) + 1 for z in ws[1:k]]), 0) AS DOUBLE) AS x, CAST(-12 * r AS DOUBLE) AS y, CAST(6 * length(ws[k + 1]) AS DOUBLE) AS w FROM wk WHERE ws[k + 1] <> '')"""
PAGE = ["conv_id", "turn"]


# Paths and sources


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) WHEN 1 THEN source || '/' || CAST(doc_id AS VARCHAR) END AS normal, CASE doc_id % 5 WHEN 0 THEN 'C:/x/' WHEN 1 THEN '//srv/s/' ELSE 'a/b/' END || source AS shown, doc_id % 5 IN (0, 1) AND source = 'src1' AND (doc_id % 5 = 1 OR lang = 'en') AND (doc_id % 5 = 0 OR CAST(doc_id AS VARCHAR) = 'en') AS granted FROM documents")
def path_scope(spark, sf):
    d, k = src.table(spark, sf, "documents"), F.col("doc_id") % 5
    name = F.col("doc_id").cast("string")
    raw = (
        F.when(k == 0, F.concat("source", F.lit("/./"), "lang", F.lit("//"), name)).when(k == 1, F.concat("source", F.lit("/x/../"), name)).when(k == 2, F.concat(F.lit("../"), name))
        .when(k == 3, F.concat(F.lit("/"), "source")).otherwise(F.concat("source", F.lit("/a/b/../../../../"), name))
    )
    shown = F.concat(F.when(k == 0, "//?/C:\\x\\").when(k == 1, "//?/UNC/srv\\s/").otherwise("a\\b/"), "source")
    d = d.select("doc_id", paths.normalized(raw).alias("normal"), paths.display(shown).alias("shown"))
    return d.withColumn("granted", paths.in_scope(F.col("normal"), ["src1/en"]))


@query(f"WITH {CORPUS} SELECT path, left(md5('true|' || path || '|' || CAST(octet_length(encode(text)) AS VARCHAR)), 16) AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS at FROM corpus")
def source_cursor(spark, sf):
    """Cursors made of sources and offsets, read back."""
    made = paths.cursor(paths.source_id(F.lit(True), F.col("path"), F.octet_length("text")), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    return docs(spark, sf).select("path", reading.cursor_parse(made).alias("c")).select("path", "c.id", "c.at")


@query("SELECT doc_id, doc_id % 12 < 11 AND doc_id % 12 > 0 AS magic, doc_id % 12 = 11 AS pdf FROM documents")
def content_kind(spark, sf):
    """Contents that begin like executables and images of all kinds, like a PDF, or like text (whose headers are cut short)."""
    begins = ["25504446", *paths.MAGIC, "52494646AABBCCDD57454250", "255044462D312E37"]
    content = F.lit("")
    for k, b in enumerate(begins):
        content = F.when(F.col("doc_id") % 12 == k, F.lit(b)).otherwise(content)
    raw = F.unhex(F.concat(content, F.hex(F.lit(" and more").cast("binary"))))
    return src.table(spark, sf, "documents").select("doc_id", paths.has_binary_magic(raw).alias("magic"), paths.has_pdf_header(raw).alias("pdf"))


@query(f"WITH {CORPUS} SELECT path, md5(text) AS content FROM corpus WHERE doc_id = 1")
def read_file(spark, sf):
    one = docs(spark, sf).where("doc_id = 1").select("path").first()[0]
    return src.single_file(docs(spark, sf), one).select("path", F.md5(F.col("text").cast("binary")).alias("content"))


@query(f"WITH {LINES} SELECT path, line_no, md5(line) AS line FROM lines WHERE path LIKE '%/en/%'")
def lines_function(spark, sf):
    """Lines by the table function, in SQL."""
    src.register_lines(spark)
    d = docs(spark, sf).where("lang = 'en'")
    return spark.sql("SELECT path, line_no, md5(CAST(line AS BINARY)) AS line FROM {d}, LATERAL text_lines(text)", d=d)


@query("SELECT count(*) AS entries, count(*) FILTER (doc_id % 7 = 0) AS io_errors, count(*) FILTER (doc_id % 11 = 0) AS escaped, count(*) FILTER (doc_id % 13 = 0) AS non_unicode FROM documents")
def traversal_counters(spark, sf):
    name = F.concat(F.when(F.col("doc_id") % 11 == 0, "a/../../").otherwise("a/../"), F.when(F.col("doc_id") % 13 == 0, "\ufffd").otherwise("x"), F.col("doc_id").cast("string"))
    d = src.table(spark, sf, "documents").select(name.alias("path"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    return reports.traversal_counters(d, "path", "text")


@query("WITH f AS (SELECT unnest(range(1000)) AS i) SELECT count(*) AS files, count(*) FILTER (i % 100 = 0) AS sparse_files, count(*) FILTER (i % 50 = 0) AS dense_files, 4 * count(*) FILTER (i % 50 = 0) AS dense_hits FROM f")
def ground_truth(spark, sf):
    return reports.ground_truth(src.synthetic_code(spark, 1000, "SPARSE", "DENSE"))


@query(f"WITH {CORPUS}, s AS (SELECT DISTINCT event_type, length(event_type) AS doc_id FROM events) SELECT event_type, path FROM s LEFT JOIN (SELECT doc_id, path FROM corpus WHERE doc_id < 7) USING (doc_id)")
def manifest_lookup(spark, sf):
    s = src.table(spark, sf, "events").select("event_type", F.length("event_type").cast("long").alias("target_key")).distinct()
    return reports.targets_of(s, docs(spark, sf).where("doc_id < 7").select(F.col("doc_id").alias("target_key"), "path")).select("event_type", "path")


# Results


NOTE = "more lines follow"


@query(f"WITH {LINES}, u AS (SELECT path, line_no, line, CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path ORDER BY line_no) AS BIGINT) - 1 AS used, CAST(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY path) AS BIGINT) - 1 AS full_size, count(*) OVER (PARTITION BY path) AS total FROM lines) SELECT path, count(*) FILTER (full_size <= 600 OR used <= 600 - 18) AS shown, any_value(total) AS total, md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (full_size <= 600 OR used <= 600 - 18), '') || CASE WHEN any_value(full_size) <= 600 THEN '' ELSE CASE WHEN count(*) FILTER (used <= 600 - 18) > 0 THEN chr(10) ELSE '' END || '{NOTE}' END) AS result FROM u GROUP BY path")
def page_result(spark, sf):
    return reading.page_result(docs(spark, sf), 600, NOTE).select("path", "shown", "total", F.md5(F.col("text").cast("binary")).alias("result"))


@query(f"WITH {CORPUS}, b AS (SELECT path, text, octet_length(encode(text)) AS total, [k for k in range(0, least(length(text), 333) + 1) if octet_length(encode(left(text, k))) <= 333] AS ks FROM corpus), c AS (SELECT path, total, left(text, ks[-1]) AS t FROM b) SELECT path, md5(t) AS chunk, CASE WHEN octet_length(encode(t)) < total THEN octet_length(encode(t)) END AS next_offset, total FROM c")
def text_chunk(spark, sf):
    d = docs(spark, sf).select("path", reading.chunk(F.col("text"), F.lit(0).cast("long"), 333).alias("c"))
    return d.select("path", F.md5(F.col("c.text").cast("binary")).alias("chunk"), "c.next_offset", "c.total")


@query(f"WITH {CORPUS}, b AS (SELECT path, text, [k for k in range(0, least(length(text), 188) + 1) if octet_length(encode(left(text, k))) <= 188] AS ks FROM corpus) SELECT path, md5(CASE WHEN octet_length(encode(text)) <= 200 THEN text ELSE left(text, ks[-1]) || ' [truncated]' END) AS bounded FROM b")
def bounded_text(spark, sf):
    return docs(spark, sf).select("path", F.md5(tx.bounded(F.col("text"), 200).cast("binary")).alias("bounded"))


@query()
def stream_render(spark, sf):
    """Head and tail of a stream by lines; held against a plain rewriting in the tests."""
    return docs(spark, sf).select("path", reading.rendered(F.col("text").cast("binary"), 400).alias("r")).select("path", F.md5(F.col("r.text").cast("binary")).alias("text"), "r.shown", "r.omitted")


@query("WITH e AS (SELECT event_id, CAST(ts AS DATE) AS dt, event_type, CASE WHEN event_id % 50 = 0 THEN repeat('x', 9000) ELSE 'fine' END AS diagnostic FROM events), l AS (SELECT event_id, dt, '{\"dt\":\"' || strftime(dt, '%Y-%m-%d') || '\",\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"event_type\":\"' || event_type || '\",\"diagnostic\":\"' || CASE WHEN diagnostic = 'fine' THEN diagnostic ELSE '[diagnostic omitted: log line limit]' END || '\"}' AS line FROM e), b AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY dt ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k FROM l) SELECT CAST(dt AS VARCHAR) AS dt, CAST(k // 2000 + 1 AS INT) AS part, k AS start, md5(line) AS line FROM b WHERE k + length(line) + 1 <= 20000")
def json_log_lines(spark, sf):
    """A day's log lines dealt to parts, one line with a diagnostic that is too long among fifty."""
    e = src.table(spark, sf, "events").select(F.to_date("ts").alias("dt"), "event_id", "event_type", F.when(F.col("event_id") % 50 == 0, F.repeat(F.lit("x"), F.lit(9000))).otherwise("fine").alias("diagnostic"))
    r = json_lines.rotated(e, "dt", ["event_id"], part=2000, most=20000)
    return r.select(F.col("dt").cast("string").alias("dt"), "part", F.col("at").cast("long").alias("start"), F.md5(F.col("line").cast("binary")).alias("line"))


@query("SELECT event_id, value * 1e6 / 1e6 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at_text, epoch_us(ts) // 1000 AS at_ms FROM events")
def times(spark, sf):
    e = src.table(spark, sf, "events")
    return e.select("event_id", tx.milliseconds(F.col("value") * 1e6).alias("ms"), tx.rfc3339(F.col("ts")).alias("at_text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


@query("WITH g AS (SELECT event_type AS stage, count(*) AS calls, sum(CAST(floor(value * 1000000) AS BIGINT)) AS ns FROM events GROUP BY 1) SELECT stage, calls, round(ns / 1e6, 6) AS total_ms, round(ns / calls / 1e6, 6) AS mean_ms, round(ns / sum(ns) OVER (), 9) AS share FROM g")
def stage_profile(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.floor(F.col("value") * 1000000).alias("ns"))
    return reports.stage_profile(e, "stage", "ns").select("stage", "calls", F.round("total_ms", 6).alias("total_ms"), F.round("mean_ms", 6).alias("mean_ms"), F.round("share", 9).alias("share"))


ROUND_SAMPLES = SAMPLES + ", t AS (SELECT * REPLACE (CASE iteration % 4 WHEN 0 THEN 'storm_r1_round' || CAST(iteration % 3 AS VARCHAR) || '_q' || CAST(iteration % 5 AS VARCHAR) WHEN 1 THEN 'storm_r2_round1' ELSE scenario END AS scenario) FROM samples)"


def _round_samples(spark, sf):
    k = F.col("iteration")
    storm = F.concat(F.lit("storm_r1_round"), (k % 3).cast("string"), F.lit("_q"), (k % 5).cast("string"))
    return samples(spark, sf).withColumn("scenario", F.when(k % 4 == 0, storm).when(k % 4 == 1, "storm_r2_round1").otherwise(F.col("scenario")))


@query(f"WITH {ROUND_SAMPLES}, r AS (SELECT *, regexp_extract(scenario, '^(.+_r[0-9]+_round[0-9]+)_q[0-9]+$', 1) AS round_key FROM t WHERE NOT is_warmup AND status = 'ok') SELECT scale, round_key, target, arg_min(duration_ms, iteration) AS wall_ms, count(*) FILTER (success) AS ok, count(*) AS total FROM r WHERE round_key <> '' AND concurrency > 1 GROUP BY ALL")
def bench_storms(spark, sf):
    """Rounds of concurrent samples by the keys in their scenarios."""
    return reports.rounds(reports.split_rounds(_round_samples(spark, sf))[1])


@query(f"WITH {ROUND_SAMPLES} SELECT target, tool, CASE WHEN regexp_matches(scenario, '_r[0-9]+_round[0-9]+(_q[0-9]+)?$') THEN 'storm' ELSE scenario END AS scenario, status, count(*) AS n FROM t WHERE status IN ('unsupported', 'skipped') AND NOT is_warmup GROUP BY ALL")
def bench_skipped_storms(spark, sf):
    return reports.skipped(_round_samples(spark, sf))


@query("WITH j AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, least(n, 2) AS admitted FROM j")
def admissions(spark, sf):
    """All jobs of a user run at once from the first second on, with two slots: the first two are admitted."""
    e = src.table(spark, sf, "events").select("user_id", F.col("event_id").alias("job_id"), F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("e"))
    a = logs.admissions(e, "user_id", "s", "e", 2)
    return a.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


# Text


@query(f"WITH {VARIED_CORPUS} SELECT path, " + ", ".join(f"len(regexp_extract_all(text, '[{r}]')) AS {k}" for k, r in tx.CJK_MARKS.items()) + " FROM corpus")
def cjk_marks(spark, sf):
    return varied(spark, sf).select("path", *[c.alias(k) for k, c in tx.cjk_mark_counts(F.col("text")).items()])


@query(f"WITH {VARIED_CORPUS} SELECT path, CASE WHEN regexp_matches(text, '[\\x{{0590}}-\\x{{08FF}}\\x{{FB1D}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFC}}]') THEN md5(chr(8295) || text || chr(8297)) ELSE md5(text) END AS isolated, length(regexp_replace(text, '\\s', '', 'g')) > 0 AND len(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ゟ゠-ヿ가-힣]')) > 0.5 * len(regexp_extract_all(text, '[^\\s]')) AS cjk FROM corpus")
def text_direction(spark, sf):
    return varied(spark, sf).select("path", F.md5(tx.isolated(F.col("text")).cast("binary")).alias("isolated"), tx.cjk_dominant(F.col("text")).alias("cjk"))


@query("SELECT doc_id, chr(CAST(12032 + doc_id % 3 AS INT)) || 'x' AS raw, CASE doc_id % 3 WHEN 0 THEN '一' WHEN 1 THEN '丨' ELSE '丶' END || 'x' AS unified, 'office {\"data\":\"\",\"k\":1}' AS cleaned FROM documents")
def unified_radicals(spark, sf):
    d = src.table(spark, sf, "documents")
    raw = F.concat(F.element_at(F.array(F.lit("\u2f00"), F.lit("\u2f01"), F.lit("\u2f02")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("x"))
    return d.select("doc_id", raw.alias("raw"), cl.unify_radicals(raw).alias("unified"), cl.strip_images(cl.split_ligatures(F.lit('oﬃce {"data":"QUJD","k":1}'))).alias("cleaned"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'empty' WHEN event_id % 6 = 1 THEN 'scanned' WHEN event_id % 6 = 2 THEN 'text_layer' WHEN event_id % 6 = 3 THEN 'image_text' WHEN event_id % 6 = 4 THEN 'scanned' ELSE 'text_layer' END AS kind FROM events")
def page_kinds(spark, sf):
    """Signals of one page of each kind: nothing; outlines; plain text; text beside an image; an image with hardly any text; an image over invisible text."""
    signals = [(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.9, 0.1, 0.0, 0.0), (900, 0.0, 0.1, 0.0, 0.0, 0.5, 0.0), (900, 0.0, 0.1, 0.0, 0.4, 0.4, 0.0), (900, 0.0, 0.1, 0.0, 0.95, 0.02, 0.1), (900, 0.0, 0.1, 0.0, 0.95, 0.5, 0.9)]
    k = F.col("event_id") % 6
    of = [F.element_at(F.array(*[F.lit(float(s[i])) for s in signals]), (k + 1).cast("int")) for i in range(7)]
    return src.table(spark, sf, "events").select("event_id", cl.page_kind(*of, empty=k == 0).alias("kind"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a\\xFFb\\xC3' WHEN 1 THEN 'fine é' ELSE '\\xE2\\x82' END AS text, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 2 END AS invalid FROM documents")
def invalid_bytes(spark, sf):
    raw = F.unhex(F.element_at(F.array(F.lit("61FF62C3"), F.lit("66696E6520C3A9"), F.lit("E282")), (F.col("doc_id") % 3 + 1).cast("int")))
    return src.table(spark, sf, "documents").select("doc_id", cl.escaped(raw).alias("e")).select("doc_id", "e.text", "e.invalid")


# Layout


@query(f"WITH {SPANS}, o AS (SELECT conv_id, turn, seq, row_number() OVER (PARTITION BY conv_id, turn ORDER BY floor(y / 5) DESC, x, seq) - 1 AS place FROM spans) SELECT * FROM o")
def banded_order(spark, sf):
    return layout.simple_order(_spans(spark, sf), PAGE).select(*PAGE, "seq", "place").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SPANS} SELECT conv_id, turn, seq, row_number() OVER (PARTITION BY conv_id, turn ORDER BY floor(x / 5) DESC, y DESC, seq) - 1 AS place FROM spans")
def vertical_order(spark, sf):
    return layout.vertical_order(_spans(spark, sf), PAGE).select(*PAGE, "seq", "place").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SPANS}, b AS (SELECT *, CASE WHEN x + w / 2 BETWEEN 200 AND 400 THEN 1 WHEN x + w / 2 BETWEEN 0 AND 200 THEN 2 END AS bead FROM spans) SELECT conv_id, turn, seq, row_number() OVER (PARTITION BY conv_id, turn ORDER BY bead ASC NULLS LAST, floor(y / 5) DESC, x, seq) - 1 AS place FROM b")
def thread_order(spark, sf):
    """Two beads, the right one first; a center on their common edge is in the first."""
    s = _spans(spark, sf)
    beads = s.select(*PAGE).distinct().withColumn("b", F.explode(F.array(*[F.struct(F.lit(k).alias("bead"), F.lit(x).alias("bx")) for k, x in ((1, 200.0), (2, 0.0))])))
    beads = beads.select(*PAGE, "b.bead", "b.bx", F.lit(-1e6).alias("by_"), F.lit(200.0).alias("bw"), F.lit(2e6).alias("bh"))
    return layout.thread_order(s, beads, PAGE).select(*PAGE, "seq", "place").withColumn("place", F.col("place").cast("long"))


@query(f"WITH RECURSIVE {SPANS}, n AS (SELECT DISTINCT conv_id, seq // 100000 AS mark FROM spans WHERE turn = 0), t AS (SELECT conv_id, mark, 0 AS depth, [mark] AS p FROM n WHERE mark = 0 UNION ALL SELECT n.conv_id, n.mark, t.depth + 1, list_append(t.p, -n.mark) FROM t JOIN n ON n.conv_id = t.conv_id AND n.mark > 0 AND (n.mark - 1) // 2 = t.mark WHERE t.depth < 64), k AS (SELECT conv_id, mark, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS rank FROM t) SELECT conv_id, turn, seq, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank ASC NULLS LAST, seq) - 1 AS place FROM spans LEFT JOIN k ON k.conv_id = spans.conv_id AND spans.turn = 0 AND seq // 100000 = k.mark".replace("SELECT conv_id, turn, seq, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank", "SELECT spans.conv_id, turn, seq, row_number() OVER (PARTITION BY spans.conv_id, turn ORDER BY rank"))
def structure_order(spark, sf):
    """Lines of first turns as marked content of a binary structure tree whose later children come first."""
    s = _spans(spark, sf).withColumn("mark", F.floor(F.col("seq") / 100000))
    nodes = s.where("turn = 0").select("conv_id", "mark").distinct().select(F.col("conv_id").alias("tree"), F.col("mark").alias("node"), F.when(F.col("mark") > 0, F.floor((F.col("mark") - 1) / 2)).alias("parent"), (-F.col("mark")).alias("seq"))
    tree = layout.tree_order(nodes).select(F.col("tree").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("node").alias("mark"), F.col("place").alias("rank"))
    return layout.structure_order(s, tree, PAGE, "mark").select(*PAGE, "seq", "place").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SPANS}, r AS (SELECT *, CASE WHEN turn % 2 = 0 THEN seq % 7 END AS rank, CASE WHEN seq % 5 = 0 THEN 90 ELSE 0 END AS rotation FROM spans) SELECT conv_id, turn, seq, CASE WHEN turn % 2 = 0 THEN 1 ELSE 3 END AS tier, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rotation <> 0, rotation, coalesce(rank, 0), floor(y / 5) DESC, x, seq) - 1 AS place FROM r")
def tiered_order(spark, sf):
    s = _spans(spark, sf).withColumns({"rank": F.when(F.col("turn") % 2 == 0, F.col("seq") % 7).cast("int"), "rotation": F.when(F.col("seq") % 5 == 0, 90).otherwise(0)})
    return layout.tiered_order(s, PAGE).select(*PAGE, "seq", "tier", "place").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {SPANS}, m AS (SELECT *, max(x + w) OVER (PARTITION BY conv_id, turn ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT * REPLACE (CASE WHEN x >= 120 THEN x + 40 ELSE x END AS x) FROM spans)) SELECT conv_id, turn, seq, CAST(sum(CASE WHEN x - reach >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS INT) AS \"column\" FROM m")
def page_columns(spark, sf):
    s = _spans(spark, sf).withColumn("x", F.when(F.col("x") >= 120, F.col("x") + 40).otherwise(F.col("x")))
    return layout.columns_of_page(s, PAGE).select(*PAGE, "seq", "column")


@query(f"WITH {SPANS}, n AS (SELECT conv_id, turn, y, count(*) OVER (PARTITION BY conv_id, turn) AS c FROM spans), d AS (SELECT DISTINCT conv_id, turn, y FROM n WHERE c >= 4), g AS (SELECT conv_id, turn, lag(y) OVER (PARTITION BY conv_id, turn ORDER BY y DESC) - y AS gap FROM d) SELECT conv_id, turn, list_sort(list(gap))[CAST(floor(count(*) / 2) AS INT) + 1] AS line_height FROM g WHERE gap BETWEEN 5 AND 30 GROUP BY conv_id, turn")
def line_height(spark, sf):
    return layout.line_height(_spans(spark, sf), PAGE, 10.0)


@query(f"WITH {SPANS}, b AS (SELECT DISTINCT conv_id, turn, CAST(floor(x / 10) AS BIGINT) AS bin FROM spans), i AS (SELECT conv_id, turn, CASE WHEN bin - lag(bin) OVER (PARTITION BY conv_id, turn ORDER BY bin) = 1 THEN 0 ELSE 1 END AS new FROM b), c AS (SELECT conv_id, turn, CAST(sum(new) AS BIGINT) AS columns FROM i GROUP BY ALL), m AS (SELECT conv_id, turn, count(*) AS spans, list_sort(list(w))[CAST(floor(count(*) / 2) AS INT) + 1] AS width, round(var_pop(y), 6) AS y_variance FROM spans GROUP BY ALL) SELECT conv_id, turn, spans, width, y_variance, columns FROM m JOIN c USING (conv_id, turn)")
def page_properties(spark, sf):
    return layout.page_properties(_spans(spark, sf), PAGE).withColumn("y_variance", F.round("y_variance", 6))


@query("SELECT l_orderkey, round(coalesce(stddev_pop(l_quantity), 0), 6) AS deviation FROM lineitem GROUP BY 1")
def spacing_deviation(spark, sf):
    return layout.spacing_deviation(src.table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity").withColumn("deviation", F.round("deviation", 6))


@query(f"WITH {SPANS}, c AS (SELECT conv_id, turn, seq, text, x, w, unnest(range(length(text))) AS i FROM spans) SELECT conv_id, turn, seq, i, text[i + 1] AS ch, x + w / length(text) * i AS x, w / length(text) AS w FROM c")
def span_characters(spark, sf):
    return layout.characters(_spans(spark, sf), PAGE).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {SPANS}, l AS (SELECT conv_id, turn, r, string_agg(text, ' ' ORDER BY x, seq) AS text FROM spans GROUP BY ALL) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r) - 1 AS line, md5(text) AS text FROM l")
def assembled_lines(spark, sf):
    return layout.assembled(_spans(spark, sf), PAGE).select(*PAGE, "line", F.md5(F.col("text").cast("binary")).alias("text")).withColumn("line", F.col("line").cast("long"))


@query("WITH l AS (SELECT conv_id, turn, unnest(string_split('Report 7, page ' || CAST(turn AS VARCHAR) || chr(10) || text, chr(10))) AS line FROM conversations), b AS (SELECT *, lower(trim(regexp_replace(regexp_replace(line, '[0-9]', '', 'g'), '\\s+', ' ', 'g'))) AS band FROM l), c AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM b GROUP BY 1), s AS (SELECT conv_id, band FROM b JOIN c USING (conv_id) WHERE length(band) > 3 AND pages >= 3 GROUP BY conv_id, band, pages HAVING count(DISTINCT turn) >= greatest(2, ceil(pages * CAST(0.3 AS DOUBLE)))) SELECT conv_id, turn, md5(line) AS line FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = b.conv_id AND s.band = b.band)")
def body_lines(spark, sf):
    """Lines of turns without those that run over their conversation."""
    text = F.concat(F.lit("Report 7, page "), F.col("turn").cast("string"), F.lit("\n"), "text")
    p = src.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split(text, "\n")).alias("line")).withColumn("band", tx.band_line(F.col("line")))
    kept = layout.without_artifacts(p, layout.running_lines(p, "conv_id", "turn", "band", 0.3), "conv_id", "band")
    return kept.select("conv_id", "turn", F.md5(F.col("line").cast("binary")).alias("line"))


def _rects(spark, sf):
    n, q, k = F.col("l_linenumber").cast("double"), F.col("l_quantity"), F.col("l_partkey").cast("double") % 50
    return src.table(spark, sf, "lineitem"), layout.rect(n, q, F.lit(10.0), F.lit(5.0)), layout.rect(F.lit(3.0), k, F.lit(8.0), F.lit(9.0))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y, CAST(l_partkey % 50 AS DOUBLE) AS k FROM lineitem), i AS (SELECT *, x < 11 AND x + 10 > 3 AND y < k + 9 AND y + 5 > k AS meets FROM r) SELECT l_orderkey, l_linenumber, meets, (greatest(x + 10, 11) - least(x, 3)) * (greatest(y + 5, k + 9) - least(y, k)) AS union_area, CASE WHEN meets THEN (least(x + 10, 11) - greatest(x, 3)) * (least(y + 5, k + 9) - greatest(y, k)) END AS shared_area, round(sqrt((x + 5 - 7) * (x + 5 - 7) + (y + 2.5 - k - 4.5) * (y + 2.5 - k - 4.5)), 6) AS distance FROM i")
def rect_algebra(spark, sf):
    d, a, b = _rects(spark, sf)
    return d.select("l_orderkey", "l_linenumber", layout.intersects(a, b).alias("meets"), layout.area(layout.union_of(a, b)).alias("union_area"), layout.area(layout.intersection_of(a, b)).alias("shared_area"), F.round(layout.center_distance(a, b), 6).alias("distance"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN CASE WHEN 10 - l_quantity <= 3 THEN 0 END WHEN l_quantity > 40 THEN CASE WHEN l_quantity - 40 <= 3 THEN 2 END WHEN l_quantity < 20 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END AS cell, list_position([floor(abs(l_quantity - c) * 1000) for c in [5, 15, 25, 45]], list_min([floor(abs(l_quantity - c) * 1000) for c in [5, 15, 25, 45]])) - 1 AS center FROM lineitem")
def grid_assignment(spark, sf):
    q = F.col("l_quantity")
    centers = F.array(*[F.lit(float(c)) for c in (5, 15, 25, 45)])
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", layout.interval_of(q, [10.0, 20.0, 30.0, 40.0]).alias("cell"), layout.nearest(q, centers).alias("center"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS tables, 2 AS cells FROM conversations")
def ruled_tables(spark, sf):
    """A page of two cells each: beside each other (one table), or touching at a corner (two)."""
    even = F.col("conv_id") % 2 == 0
    c = src.table(spark, sf, "conversations").select(*PAGE, even.alias("even"))

    def lines(rects):
        edges = []
        for x0, y0, x1, y1 in rects:
            edges += [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]
        return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("x0", "y0", "x1", "y1"), strict=True)]) for e in edges])

    e = c.select(*PAGE, F.explode(F.when(F.col("even"), lines([(0, 0, 50, 50), (50, 0, 100, 50)])).otherwise(lines([(0, 0, 50, 50), (50, 50, 100, 100)]))).alias("e")).select(*PAGE, "e.*")
    return layout.grid_cells(e, PAGE).groupBy(*PAGE).agg(F.countDistinct("table").cast("int").alias("tables"), F.count("*").cast("int").alias("cells"))
