"""Text functions, reports, logs and layout by hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions import pandas_text as pt
from textmill.functions import text as tx
from textmill.operators import layout, logs, reading, reports


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "wanted"), [("", 0), ("abc", 3), ('a"b', 4), ("\t\n\r\x08\x0c", 10), ("\x01", 6), ("é", 2), ("\\", 2)])
def test_json_length(spark, text, wanted):
    assert one(spark, text, tx.json_length) == wanted


def test_truncation_keeps_characters(spark):
    for text, most in [("abc", 3), ("abcd", 3), ("aéb", 2), ("aéb", 3), ("日本語", 7), ("", 3)]:
        got = one(spark, text, lambda c, m=most: reading.truncated(c, m))
        want = text.encode()[:most].decode(errors="ignore")
        assert (got.text, got.truncated) == (want, len(text.encode()) > most)


@pytest.mark.parametrize(("cursor", "ok"), [("", 0), ("short", 0), ("0123456789ABCDEF", 0), ("0123456789abcde", 0), ("0123456789abcdef0", 0), ("0123456789abcdef.", 0), ("0123456789abcdef.-1", 0), ("0123456789abcdef.x", 0), ("0123456789abcdef.1.2", 0), ("0123456789abcdef", 1), ("0123456789abcdef.42", 1)])
def test_cursors(spark, cursor, ok):
    got = one(spark, cursor, reading.cursor_parse)
    assert (got is not None) == bool(ok)
    if cursor.endswith(".42"):
        assert got.at == 42


def test_cursor_pages_end_at_characters(spark):
    text = "aé日b" * 50
    raw, at, out = text.encode(), 0, b""
    while at < len(raw):
        d = spark.createDataFrame([("p", bytearray(raw), at, True)], "path string, content binary, cursor long, finalized boolean")
        r = reading.cursor_page(d, 37).first()
        bytes(r.data).decode()
        out, at = out + bytes(r.data), r.next_cursor
    assert out == raw


def test_citation_lines_and_math(spark):
    for text, wanted in [("see et al", True), ("as in [1]", True), ("[42]", True), ("hello world", False), ("in 1999", True)]:
        assert one(spark, text, tx.is_citation_line) is wanted
    assert one(spark, "∫ π", tx.is_math_line) and not one(spark, "a b", tx.is_math_line)


def test_outcomes(spark):
    case = lambda code, err: spark.createDataFrame([(code, err)], "c string, e string").select(tx.outcome_class(F.col("c"), F.col("e"), ["runner failed"], ["notice"], ["denied"], [70])).first()[0]
    assert case("70", "notice\r\nRUNNER FAILED to start") == "runner_failed"
    assert case("1", "RUNNER FAILED") == "ok" and case("70", "notice") == "ok" and case("0", "denied") == "ok" and case("1", "Denied") == "denied" and case(None, "denied") == "denied"


def test_shells(spark):
    for text, wanted in [("pwsh -c", "pwsh"), ("'C:\\x y\\cmd.exe' /c", "cmd"), ("/usr/bin/node a", "other-interpreter"), ("bash.exe", "wsl"), ("ls", "none"), ("", "none")]:
        assert one(spark, text, tx.shell_delegate) == wanted


def test_percentiles(spark):
    d = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 10.0)] + [("b", 5.0)], "k string, x double")
    got = {r.k: tuple(r)[1:] for r in reports.ranked(d, ["k"], "x").groupBy("k").agg(reports.linear("x", 0.25).alias("l"), reports.linear("x", 0.5).alias("m"), reports.linear("x", 0.9).alias("h")).collect()}
    assert got["a"] == (1.75, 2.5, pytest.approx(7.9)) and got["b"] == (5.0, 5.0, 5.0)


def test_rounds_are_kept_apart(spark):
    rows = [("storm_a_r1_round2_q3", 8, "ok"), ("storm_a_r1_round2_q4", 8, "ok"), ("storm_a_r1_round2_q4", 1, "ok"), ("plain", 8, "ok"), ("storm_a_r1_round2", 8, "skipped"), ("storm_a_r2_round1_q1", 8, "skipped"), ("x", 1, "skipped")]
    d = spark.createDataFrame([(s, c, st, "t", "g", False) for s, c, st in rows], "scenario string, concurrency int, status string, target string, tool string, is_warmup boolean")
    single, of_round = reports.split_rounds(d)
    assert sorted((r.scenario, r.concurrency) for r in single.collect()) == [("plain", 8), ("storm_a_r1_round2_q4", 1)]
    assert [r.round_key for r in of_round.collect()] == ["storm_a_r1_round2"] * 2
    assert sorted((r.scenario, r.n) for r in reports.skipped(d).collect()) == [("storm_a", 2), ("x", 1)]


def test_bursts_split_at_equality(spark):
    s = 1_000_000
    d = spark.createDataFrame([(1, 1, 0, s), (1, 2, 3 * s, int(3.5 * s)), (1, 3, int(5.4 * s), int(5.5 * s))], "k long, call_id long, start long, end long")
    assert [r.burst_id for r in logs.bursts(d, "k", "start", "end").orderBy("call_id").collect()] == [1, 2, 2]


@pytest.mark.parametrize(("before", "after", "rows"), [(3, 0, 4), (70, 0, 65), (3, 2, 4), (0, 5, 1)])
def test_flight_recorder(spark, before, after, rows):
    d = spark.createDataFrame([(1, i, i == before) for i in range(before + 1 + after)], "k long, i long, e boolean")
    got = logs.flight_recorder(d, "k", "i", F.col("e")).collect()
    assert len(got) == rows and sum(r.context for r in got) == rows - 1


def test_retention(spark):
    import datetime as dt

    day = dt.date(2026, 3, 31)
    d = spark.createDataFrame([(f"p{i}", day - dt.timedelta(days=i), 100) for i in (0, 1, 2, 3, 30, 31)], "path string, dt date, bytes long")
    got = {r.path: r.removed for r in logs.retention(d, F.lit(day), 30, 250).collect()}
    assert got == {"p0": False, "p1": False, "p2": False, "p3": True, "p30": True, "p31": True}


def test_jobs(spark):
    d = spark.createDataFrame([(1, 1, "running"), (1, 5, "completed"), (1, 7, "terminated"), (2, 2, "running"), (3, 3, "timed_out")], "job_id long, at long, state string")
    got = {r.job_id: (r.started, r.finished, r.state) for r in logs.job_states(d).collect()}
    assert got == {1: (1, 5, "completed"), 2: (2, None, "running"), 3: (3, 3, "timed_out")}
    assert [r.job_id for r in logs.job_history(logs.job_states(d), 1).collect()] == [1]


def test_hyphens():
    assert pt.join_hyphens("the Govern-\nMENT of x") == "the GovernMENT of x"
    assert pt.join_hyphens("self-\nmade") == "self-\nmade" and pt.join_hyphens("content-\nType: x") == "content-\nType: x"
    assert pt.join_hyphens("govern-\nment", frozenset(["government"])) == "government"
    assert pt.join_hyphens("co­\nmade it") == "comade it" and pt.join_hyphens("- item\n- more") == "- item\n- more"
    assert pt.join_hyphens(None) is None and pt.join_hyphens("") == ""


def test_mojibake():
    for text in ("Привет мир", "日本"):
        assert pt.repair_mojibake(text.encode().decode("latin-1")) == text
    assert pt.repair_mojibake("Résumé") == "Résumé" and pt.repair_mojibake("Ã©") == "Ã©"


def test_citations():
    got = pt.find_citations("a [1] b [2-3] (4) (2020) x² Smith (2021) [Lee et al., 2019]")
    assert [(c["kind"], c["text"]) for c in got] == [("numeric", "[1]"), ("range", "[2-3]"), ("paren", "(4)"), ("superscript", "²"), ("author_year", "Smith (2021)"), ("combined", "[Lee et al., 2019]")]


def test_decoding():
    assert pt._decoded("é".encode(), None) == ("é", "utf-8") and pt._decoded("é".encode("utf-16"), "latin-1")[0] == "é"
    assert pt._decoded("中文文字编码".encode("gbk"), None) == ("中文文字编码", "gbk") and pt._decoded(b"\xff\xff", None) == (None, "undetected")
    assert pt._decoded(b"a\0b", None)[1] == "binary" and pt._decoded(b"\xff\xfe\0\0", None)[1] == "utf-32"


def test_tokens(spark):
    assert [pt.pretoken_count(" x" * n) for n in (0, 1, 7)] == [0, 1, 7]
    odd = ["Hello world's 12345 things!!\n\n  x", "ÄÖ ǅ ﬁ\u3000全角　文字 \u0301e", "a\r\nb\t\t c   ", "don't WON'T it'S", "//path/to\n/x", "", None, "١٢٣٤ नमस्ते 😀😀"]
    d = spark.createDataFrame([(x,) for x in odd], "x string")
    assert [r[0] for r in d.select(pt.pretokens(F.col("x"))).collect()] == [pt.pretoken_count(x) for x in odd]


def test_exact_token_counts_by_a_rank_file(spark, tmp_path):
    import base64

    words = [bytes([k]) for k in range(256)] + [b"he", b"ll", b"hell", b"hello", b" w", b"or", b" wor", b"ld", b" world"]
    (tmp_path / "ranks").write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % k for k, w in enumerate(words)) + b"\n")
    d = spark.createDataFrame([("hello world",), ("hell",), ("xyz",), ("",), (None,)], "x string")
    assert [r[0] for r in d.select(pt.token_counter(str(tmp_path / "ranks"))("x")).collect()] == [2, 1, 3, 0, 0]


def test_clusters_and_words(spark):
    assert layout.cluster_values(np.array([10.0, 1.0, 1.4, 1.7, 9.8]), 0.6).tolist() == [1, 0, 0, 0, 1]
    chars = [(1, i, c, float(x), 10.0) for i, (c, x) in enumerate(zip("HelloWorld", [0, 11, 22, 33, 44, 100, 111, 122, 133, 144], strict=True))]
    d = spark.createDataFrame(chars, "page int, idx int, ch string, x double, w double")
    got = layout.words_of_line(d, ["page"], 20.0).orderBy("idx").collect()
    assert [r.word for r in got] == [0] * 5 + [1] * 5


def test_line_bands_compare_with_the_first_member(spark):
    d = spark.createDataFrame([(1, i, 0.0, y) for i, y in enumerate([10.0, 8.0, 6.0, 4.0])], "page int, seq int, x double, y double")
    assert [r.line for r in layout.lines_of_page(d, ["page"], 3.0).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_xy_cut_reads_columns():
    x, y = [0, 0, 0, 100, 100, 100], [30, 20, 10, 30, 20, 10]
    w, h = [50] * 6, [8] * 6
    assert layout.xy_cut(*(np.array(v, float) for v in (x, y, w, h))) == [0, 1, 2, 3, 4, 5]
    assert layout.xy_cut(*(np.array(v, float) for v in ([100, 0], [1, 1], [5, 5], [5, 5]))) == [1, 0]


def test_rectangles_and_grids(spark):
    s = spark.createDataFrame([(1, i, *r) for i, r in enumerate([(0.0, 0.0, 10.0, 10.0), (8.0, 0.0, 10.0, 10.0), (50.0, 0.0, 1.0, 1.0)])], "page int, seq int, x double, y double, w double, h double")
    b = spark.createDataFrame([(1, 0.0, 0.0, 12.0, 12.0)], "page int, rx double, ry double, rw double, rh double")
    assert [r.seq for r in layout.within(s, b, ["page"]).collect()] == [0]
    assert sorted(r.seq for r in layout.within(s, b, ["page"], keep=False).collect()) == [1, 2]
    lines = [(1, 0.0, y, 20.0, y) for y in (0.0, 10.0, 20.0)] + [(1, x, 0.0, x, 20.0) for x in (0.0, 10.0, 20.0)]
    e = spark.createDataFrame(lines, "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.table, r.row, r.col) for r in layout.grid_cells(e, ["page"]).collect()) == [(0, r, c) for r in (0, 1) for c in (0, 1)]


def test_plan_of_runs(spark):
    sc = spark.createDataFrame([("grep", "a"), ("pdf", "b")], "tool string, scenario string")
    t = spark.createDataFrame([("x",), ("y",)], "target string")
    skip = spark.createDataFrame([("y", "pdf")], "target string, tool string")
    got = reports.run_plan(sc, t, skip, 2)
    assert got.count() == 6
    assert [r.target for r in got.where("scenario = 'a'").orderBy("iteration", "turn").collect()] == ["x", "y", "y", "x"]


def test_page_states(spark):
    state = lambda t, drawn: spark.createDataFrame([(t,)], "x string").select(tx.page_state(F.col("x"), F.lit(drawn))).first()[0]
    assert [state(None, True), state(" ", True), state("", False), state("a plain line of readable words stands here", True), state("a a a a a a a a a a", True)] == ["unavailable", "image_required", "blank", "text_ready", "text_uncertain"]


def test_repeated_head_lines(spark):
    d = spark.createDataFrame([(1, p, f"Page {p} of Report") for p in (1, 2, 3)] + [(1, 1, "only here"), (2, 1, "Same"), (2, 2, "Same")], "doc int, page int, line string")
    got = layout.running_lines(d.withColumn("band", tx.band_line(F.col("line"))), "doc", "page", "band").collect()
    assert [(r.doc, r.band, r.n) for r in got] == [(1, "page of report", 3)]


def test_allowance_stream(spark, tmp_path):
    from textmill.streaming.calls import allowance_stream, job_stream, read_up

    events = [(1, 1, 0, "begin", 0), (1, 2, 1, "begin", 0), (1, 1, 2, "claim", 0), (1, 1, 3, "finish", 40), (1, 2, 4, "claim", 0), (1, 2, 5, "finish", 10), (1, 3, 2_000_005, "begin", 0), (1, 3, 2_000_006, "claim", 0)]
    schema = "k long, call_id long, at_us long, kind string, tokens long"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = read_up(spark, allowance_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", 100), str(tmp_path / "out")).collect()
    assert {(r.call_id, r.burst_id, r.allowance) for r in got} == {(1, 1, 50), (2, 1, 60), (3, 2, 100)}
    schema = "job_id long, at_us long, state string, timeout_ms long"
    spark.createDataFrame([(1, 1, "running", 0), (1, 2, "completed", 0), (1, 3, "terminated", 0), (2, 1, "running", 1), (2, 5000, "tick", 0), (2, 6000, "completed", 0)], schema).coalesce(1).write.parquet(str(tmp_path / "jobs"))
    got = read_up(spark, job_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "jobs"))), str(tmp_path / "jobs_out")).collect()
    assert sorted((r.job_id, r.at_us, r.state) for r in got) == [(1, 1, "running"), (1, 2, "completed"), (2, 1, "running"), (2, 1001, "timed_out")]


def test_process_trees_and_gates(spark):
    p = spark.createDataFrame([(1, 10, 1, 5), (1, 11, 10, 7), (1, 12, 11, 9), (1, 20, 1, 100), (2, 10, 1, 6), (2, 12, 11, 50)], "tick int, pid int, ppid int, gauge long")
    got = {(r.tick, r.root): (r.processes, r.total) for r in reports.tree_sum(p, spark.createDataFrame([(10,)], "pid int")).collect()}
    assert got == {(1, 10): (3, 21), (2, 10): (1, 6)}
    e = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "scenario string, wanted int")
    f = spark.createDataFrame([("a", 1), ("b", 5)], "scenario string, value int")
    assert {r.scenario: r.passed for r in reports.gates(f, e).collect()} == {"a": True, "b": False, "c": False}


def test_admissions_and_lookups(spark):
    d = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 1, 5), (1, 3, 2, None), (1, 4, 6, 7), (1, 5, 10, 11)], "k int, job_id long, s int, e int")
    got = {r.job_id: (r.active, r.admitted) for r in logs.admissions(d, "k", "s", "e", 2).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (2, False), 4: (2, True), 5: (1, True)}  # a job that isn't admitted holds no slot
    ids = lambda rows: spark.createDataFrame(rows, "job_id long, state string")
    found = logs.job_lookup(spark.createDataFrame([(1,), (2,), (3,)], "job_id long"), ids([(1, "running")]), ids([(1, "old"), (2, "completed")]))
    assert {r.job_id: r.state for r in found.collect()} == {1: "running", 2: "completed", 3: "unknown"}


def test_streams_are_rendered_by_lines(spark):
    from textmill.operators import reading

    text = "".join(f"line {k} of it, é\n" for k in range(100))
    raw = [text.encode(), b"short", None, b"x" * 1000, ("é" * 500).encode(), b"\xff" * 30, b"a\n" * 300, ("ab\n" + "c" * 900 + "\nend").encode()]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "x binary").select(reading.rendered(F.col("x"), 200)).collect()]
    for r, g in zip(raw, got, strict=True):
        r = r or b""
        assert g.shown + g.omitted == len(r)
        if len(r) <= 200:
            assert g.omitted == 0 and g.text == r.decode("utf-8", "backslashreplace").replace("\\xff", "\\xFF")
            continue
        head, _, tail = g.text.partition(f"... {g.omitted} bytes omitted ...")
        assert 90 <= g.shown <= 200 and r.startswith(head.removesuffix("\n").encode()) and r.endswith(tail.removeprefix("\n").encode())
        if r.count(b"\n") > 50:
            assert head.endswith("\n") and r[-len(tail.encode()) :] == tail.removeprefix("\n").encode() or tail.startswith("\n")


def test_chunks_visit_every_byte(spark):
    from textmill.operators import reading

    for text in ("aé日😀" * 40, "", "plain " * 30):
        offset, seen = 0, ""
        while offset is not None:
            c = spark.createDataFrame([(text, offset)], "x string, o long").select(reading.chunk(F.col("x"), F.col("o"), 37)).first()[0]
            assert len(c.text.encode()) <= 37 and c.total == len(text.encode())
            seen, offset = seen + c.text, c.next_offset
        assert seen == text
    d = spark.createDataFrame([("é", 1), ("é", 5), ("é", 2)], "x string, o long")
    assert [r[0] and r[0].text for r in d.select(reading.chunk(F.col("x"), F.col("o"), 9)).collect()] == [None, None, ""]


def test_log_lines_are_written_by_day_and_part(spark, tmp_path):
    from textmill.sinks import json_lines

    d = spark.createDataFrame([("2024-01-01", k, "y" * 100, "z" * (9000 if k == 3 else 5)) for k in range(20)] + [("2024-01-02", 1, "w" * 9000, "d")], "dt string, k long, e string, diagnostic string")
    r = json_lines.rotated(d, "dt", ["k"], part=1000, most=2500)
    json_lines.append(r, "dt", str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert {r.dt for r in back.select("dt").distinct().collect()} == {"2024-01-01"} or str(back.first().dt) == "2024-01-01"
    assert back.where(back.k == 3).first().diagnostic == json_lines.OMITTED and sorted(r.k for r in back.collect()) == list(range(back.count()))
    assert {r.part for r in r.select("part").distinct().collect()} == {1, 2, 3}


def test_white_space_of_all_scripts(spark):
    """The quality gate and collapsing treat every white space like a blank."""
    texts = ["same same same same same same word word word", "a b c d e f g h i j k l m n", "plain words that stand in a whole sentence", "  two   gaps  ", ""]
    wide = ["\xa0", "\x85", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\t"]
    rows = [(k, t.replace(" ", w)) for k, t in enumerate(texts) for w in [" ", *wide]]
    found = spark.createDataFrame(rows, "k int, text string").select("k", tx.quality_gate(F.col("text")).alias("gate"), tx.collapse_space(F.col("text")).alias("one"), tx.page_state(F.col("text"), F.lit(False)).alias("state"))
    kinds = {tuple(r) for r in found.collect()}
    assert kinds == {
        (0, "below_threshold", texts[0], "text_uncertain"), (1, "glyph_mapping_missing", texts[1], "text_uncertain"),
        (2, None, texts[2], "text_ready"), (3, None, "two gaps", "text_ready"), (4, None, "", "blank"),
    }
