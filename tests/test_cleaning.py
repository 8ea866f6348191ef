"""Cleaning and classes by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import cleaning as cl
from textmill.functions.pandas_text import escape_pipes


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text_cleaning(spark):
    assert one(spark, "a\nWhitePoint [ 1 ]\nGamma\nGammas are rays\nb", cl.drop_metadata_lines) == "a\nGammas are rays\nb"
    assert one(spark, "ﬁne oﬃce", cl.split_ligatures) == "fine office"
    assert one(spark, "⽇本⽔", cl.unify_radicals) == "日本水"
    assert one(spark, " Page 12  of ٣٤ ", cl.artifact_signature) == "Page # of #"
    assert [one(spark, x, cl.stable_pagination) for x in ("doi:10.1/x", "Volume 3", "www.a.org 1", "www.a.org", "OMB No. 15")] == [True, True, True, False, False]
    assert one(spark, "שלום", cl.looks_rtl) and not one(spark, "abc", cl.looks_rtl)
    assert one(spark, '{"data": "QUJD=", "mime": "x"}', cl.strip_images) == '{"data": "", "mime": "x"}'
    assert one(spark, "No matches\r\n a \n\n(b", lambda c: cl.content_lines(c, ["no matches", "("])) == ["a"]


def test_markdown_cleaning(spark):
    assert escape_pipes("| stray\n|a|b|\n|---|:-:|\n|1|2|\nend\n  | x") == "\\| stray\n|a|b|\n|---|:-:|\n|1|2|\nend\n  \\| x"
    assert escape_pipes("plain") == "plain" and escape_pipes(None) is None
    assert one(spark, "- a\n\n- b\n\n\n1. c\n\ntext\n\n- d", cl.tighten_lists) == "- a\n- b\n1. c\n\ntext\n\n- d"
    assert [one(spark, x, cl.is_list_item) for x in ("- a", "12) b", "-a", "1.b", "* x")] == [True, True, False, False, True]


@pytest.mark.parametrize(("rows", "valid", "not_prose"), [([["a", "b"], ["c", "d"]], True, True), ([["a", "b"], ["", "d"]], False, True), ([["", ""], ["", "x"], ["", ""]], False, True), ([["one", "two", "three", "four", "five"]], True, False), ([["1", "2%", "$3", "4", "x"]], True, True)])
def test_tables(spark, rows, valid, not_prose):
    assert one(spark, rows, cl.valid_table, "array<array<string>>") is valid
    assert one(spark, rows, cl.table_not_prose, "array<array<string>>") is not_prose


def test_classes(spark):
    d = spark.range(1)
    lit = lambda *v: [F.lit(x) for x in v]
    got = d.select(
        cl.justification(*lit(0.0, 0, 100, 100, 0)), cl.justification(*lit(0.0, 30, 70, 100, 0)), cl.justification(*lit(0.0, 30, 98, 100, 0)), cl.justification(*lit(0.9, 0, 60, 100, 0)), cl.justification(*lit(0.1, 0, 60, 100, 0)), cl.justification(*lit(0.1, 20, 60, 100, 0)),
        cl.region_class(*lit(5, 50, 1.0, 0.0, 0.0, False)), cl.region_class(*lit(9, 5, 1.0, 0.0, 0.0, False)), cl.region_class(*lit(9, 30, 1.0, 0.5, 0.0, False)), cl.region_class(*lit(9, 30, 1.0, 0.0, 0.0, False)),
        cl.page_kind(*lit(100, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0)), cl.page_kind(*lit(0, 0.0, 0.0, 0.9, 0.1, 0.0, 0.0)), cl.page_kind(*lit(100, 0.0, 0.0, 0.0, 0.5, 0.5, 0.0)), cl.page_kind(*lit(100, 0.5, 0.0, 0.0, 0.5, 0.5, 0.0)),
    ).first()
    assert list(got) == ["full", "center", "right", "full", "left", "none", "mixed", "table", "reference", "prose", "text_layer", "scanned", "image_text", "scanned"]


def test_invalid_bytes(spark):
    d = spark.createDataFrame([(b"a\xffb\xc3",), (None,), ("é\\xFF".encode(),), (b"\xff" * 100_000,)], "x binary")
    got = [tuple(r[0]) for r in d.select(cl.escaped(F.col("x"))).collect()]
    assert got[:3] == [("a\\xFFb\\xC3", 2), (None, None), ("é\\xFF", 0)] and got[3][1] == 100_000
    assert cl.escape_invalid(b"a\xffb\xc3") == ("a\\xFFb\\xC3", 2) and cl.escape_invalid("é".encode()) == ("é", 0)
