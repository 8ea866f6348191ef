"""Tables, regions and Markdown of pages: gates, odd pages and the order of regions."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions import profiles
from textmill.operators import layout, tables
from textmill.plans import tables as plans  # noqa: F401 (adds its queries)
from textmill.plans.queries import QUERIES, SQL

SPANS = "page long, seq long, x double, y double, w double, h double, text string"


def cells(df):
    return sorted((r.page, r.row, r.col, r.text) for r in df.collect())


def test_columns_merge_when_near_or_touching():
    lo = [0.0, 2.0, 20.0, 100.0, 130.0]
    assert tables.merged_columns(lo, [v + 10 for v in lo]) == [0, 0, 0, 1, 2]
    assert tables.merged_columns([0.0, 90.0], [95.0, 185.0]) == [0, 0]


def test_running_clusters():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v = rng.integers(0, 60, 30).astype(float)
        wanted = layout.cluster_values(v, 4.0)
        assert [sorted(c) for c in tables.running_clusters(v.tolist(), 4.0)] == [np.flatnonzero(wanted == k).tolist() for k in range(wanted.max() + 1)]


def test_spatial_tables_gates(spark):
    rows = [(1, 10 * r + c, 100.0 * c, -12.0 * r, 20.0, 10.0, f"{r}.{c}") for r in range(3) for c in range(2)]
    rows += [(2, 10 * r + c, 100.0 * c, -12.0 * r, 20.0, 10.0, "two rows") for r in range(2) for c in range(3)]
    rows += [(3, 10 * r + c, 60.0 * c, -12.0 * r, 20.0, 10.0, "word") for r in range(4) for c in range(6)]
    rows += [(4, 10 * r + c, 60.0 * c, -12.0 * r, 20.0, 10.0, "1.5") for r in range(4) for c in range(6)]
    rows += [(5, 100 * r + c, 60.0 * c, -12.0 * r, 20.0, 10.0, "1") for r in range(4) for c in range(16)]
    d = spark.createDataFrame(rows, SPANS)
    found = cells(tables.spatial_tables(d, ["page"]))
    assert {p for p, *_ in found} == {1, 4}
    assert [t for p, _, _, t in found if p == 1] == ["0.0", "0.1", "1.0", "1.1", "2.0", "2.1"]
    assert tables.spatial_tables(d.limit(0), ["page"]).count() == 0


def test_table_markdown_headers(spark):
    schema = "page long, row int, col int, colspan int, header boolean, text string"
    rows = [(1, 0, 0, 1, True, "a"), (1, 1, 0, 1, True, "b"), (1, 2, 0, 2, False, "c|d"), (2, 0, 0, 1, False, "x"), (3, 0, 0, 1, True, "only")]
    got = {r.page: r.markdown for r in tables.table_markdown(spark.createDataFrame(rows, schema), ["page"]).collect()}
    assert got[1] == "| a | |\n| b | |\n|---|---|\n| c\\|d | |\n"
    assert got[2] == "| x |\n|---|\n" and got[3] == "| only |\n|---|\n"


def test_heading_levels(spark):
    rows = [("Big Title", 1.8, False, 1), ("Part", 1.4, False, 2), ("Section", 1.2, False, 3), ("Bold", 1.05, True, 4), ("Plain", 1.05, False, None), ("2.1.3 Results", 1.0, False, 3), ("1. item", 1.0, False, None), ("2 Foo", 1.0, False, None), ("th", 2.0, False, None), ("x", 2.0, False, None), ("One end. Next one", 2.0, False, None), ("1.2.3.4.5.6.7 Deep", 1.0, False, 6), (" ".join("w" * 21), 2.0, False, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, ratio double, bold boolean, level int")
    for r in d.withColumn("got", tables.heading_level(F.col("text"), F.col("ratio"), F.col("bold"))).collect():
        assert r.got == r.level, r.text


def test_body_size(spark):
    rows = [(1, 10.0), (1, 10.2), (1, 14.0), (1, 14.0), (2, 8.0), (2, 8.0), (3, 20.0)]
    got = {r.page: r.body for r in tables.body_size(spark.createDataFrame(rows, "page long, size double"), ["page"]).collect()}
    assert got == {1: 10.0, 2: 12.0, 3: 12.0}


def test_lines_markdown(spark):
    rows = ["Title of it", "first line", "second line", "", "• one", "- two", "1. three", "2) four", "after"]
    d = spark.createDataFrame([(1, i, t, 20.0 if i == 0 else 10.0, False) for i, t in enumerate(rows)], "page long, line int, text string, size double, bold boolean")
    assert tables.lines_markdown(d, ["page"]).first().markdown == "# Title of it\n\nfirst line second line\n\n- one\n- two\n\n1. three\n2) four\n\nafter"
    assert tables.lines_markdown(d.limit(0), ["page"]).count() == 0


def page(gap, rows=6, head=False):
    out = [(60.0 * k + gap * (k > 1), -12.0 * r, 58.0, 10.0, 20) for r in range(rows) for k in range(4)]
    return out + ([(0.0, 30.0, 240.0 + gap, 10.0, 30)] if head else [])


def test_region_order():
    two = [np.array(c, float) for c in zip(*page(40.0, head=True), strict=True)]
    order = layout.region_order(*two).tolist()
    assert order[0] == 24 and order[1:13] == [4 * r + k for r in range(6) for k in (0, 1)] and order[13:] == [4 * r + k for r in range(6) for k in (2, 3)]
    for one in (page(0.0), page(40.0, rows=3), page(40.0)[:7]):
        assert layout.region_order(*[np.array(c, float) for c in zip(*one, strict=True)]) is None


def test_profiles():
    assert profiles.by_name("academic")["citations"] and profiles.by_name("form")["margin"] == 0.08
    with pytest.raises(ValueError):
        profiles.by_name("none")


def test_lines_markdown_query_on_odd_lines(spark, tmp_path):
    """Addresses, section numbers, ordinals, printed bullets, tabs and CRs: as the query's SQL has them."""
    texts = [
        "Ung sich\n56.187.231.175 Keit in lich auf.\n2.1.3 Results\n1.2 a", "th\nst\nnd", "a\n• one\n► two\n- three\n* four\n-\tfive", "a\n- \t\n-\x0bx\n1.\x0bx\n2. y\n- \t\t",
        "Title\r\nfirst\r\n\r\n- one\r\n- two\r\n1. x\r\n", "Big " + "w\x0b" * 30, "Big " + "w\t" * 17 + "\t", "x", "56.187.231.175 Keit", "", "\n\n", None, "10.20.30.40 " + "ä" * 70,
    ]
    rows = [(2 * i + 1, t, "en", "src", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["lines_markdown"](spark, str(tmp_path)).select("path", "markdown").collect())
    assert len(got) == 10 and got == sorted(con.sql(f"select path, markdown from ({SQL['lines_markdown']})").fetchall())
