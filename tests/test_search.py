"""The search fixture: three files, one of them ignored."""

import pytest

from textmill.functions.patterns import PatternError, Search, glob_matches, glob_to_regex, ignored
from textmill.operators import search
from textmill.sources.corpus import entries, synthetic_code, without_denied

FILES = [("src/a.rs", "before\nNeedle needle\nafter\n"), ("src/b.rs", "needle\nnone\nneedle\n"), ("ignored.rs", "needle\n"), (".gitignore", "ignored.rs\n")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def rust(corpus):
    from pyspark.sql import functions as F

    return corpus.where(glob_matches(F.col("path"), "**/*.rs"))


def test_counts_occurrences_not_lines(corpus):
    found = {r.path: r.occurrences for r in search.occurrence_counts(rust(corpus), Search("needle")).collect()}
    assert found == {"src/a.rs": 2, "src/b.rs": 2, "ignored.rs": 1}


def test_content_repeats_a_line_for_each_match(corpus):
    found = search.contents(rust(corpus), Search("needle")).where("path = 'src/a.rs'").collect()
    assert [(r.line_no, r.occ) for r in found] == [(2, 1), (2, 2)]


def test_case_modes(corpus):
    count = lambda p, **k: sum(r.occurrences for r in search.occurrence_counts(corpus, Search(p, **k)).collect())
    assert count("needle") == 5 and count("Needle") == 1 and count("Needle", case="insensitive") == 5 and count("needle", case="sensitive") == 4
    assert not Search(r"\W").insensitive and Search(r"\Wa").insensitive and not Search(r"\WA").insensitive


def test_context_and_lines(corpus, spark):
    found = search.with_context(rust(corpus), Search("needle"), 1, 1).where("path = 'src/a.rs'").orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.line) for r in found] == [(1, "context", "before"), (2, "match", "Needle needle"), (3, "context", "after")]
    odd = spark.createDataFrame([("x", "a\r\nb"), ("y", ""), ("z", "\n"), ("n", None)], "path string, text string")
    assert {(r.path, r.line_no, r.line) for r in search.lines(odd).collect()} == {("x", 1, "a"), ("x", 2, "b"), ("z", 1, "")}


def test_pages_visit_every_row_once(corpus):
    found, offset, seen = search.contents(corpus, Search("needle")), 0, []
    while True:
        rows = search.page(found, ["path", "line_no", "occ"], offset, 2).orderBy("path", "line_no", "occ").collect()
        seen += [(r.path, r.line_no, r.occ) for r in rows]
        if rows[-1].next_offset is None:
            break
        offset = rows[-1].next_offset
    assert len(seen) == len(set(seen)) == 5
    assert seen == sorted(seen)


def test_patterns_are_checked():
    for bad in ("", "a\0", "(?=x)", r"(a)\1", "(", "[a"):
        with pytest.raises(PatternError):
            Search(bad)
    assert Search("(", fixed=True).regex


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("*.rs", ["a.rs"], ["src/a.rs"]), ("**/*.rs", ["a.rs", "x/y/a.rs"], ["a.rsx"]), ("a?c", ["abc"], ["a/c", "ac"]), ("{a,b}/*", ["a/x", "b/y"], ["c/x", "a/x/y"]), ("[a-c]x", ["bx"], ["dx"]), ("[!a]x", ["bx"], ["ax", "/x"]), ("src/**", ["src/a/b"], ["srcx/a"]), ("**", ["a/b"], []), ("**.txt", ["a.txt"], ["a/b.txt"]), ("a**b", ["axb"], ["a/b"]), (r"a\b", ["a\\b"], ["ab"])],
)
def test_globs(glob, yes, no):
    import re

    assert all(re.search(glob_to_regex(glob), p) for p in yes)
    assert not any(re.search(glob_to_regex(glob), p) for p in no)


def test_ignore_rules(spark):
    from pyspark.sql import functions as F

    paths = ["a.tmp", "x/a.tmp", "build/x", "x/build/y", "keep.tmp", "root.txt", "x/root.txt", "log/x"]
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r.path for r in d.where(ignored(F.col("path"), ["*.tmp", "!keep.tmp", "build/", "/root.txt", "# log"])).collect()}
    assert found == {"a.tmp", "x/a.tmp", "build/x", "x/build/y", "root.txt"}


def test_denied_directories_and_entries(spark):
    d = spark.createDataFrame([("a/target/x",), ("target",), ("a/b/target",), ("a/dist/y/z",)], "path string")
    assert {r.path for r in without_denied(d).collect()} == {"target", "a/b/target"}
    assert {(r.path, r.is_dir) for r in entries(d).where("is_dir").collect()} == {(p, True) for p in ("a", "a/target", "a/b", "a/dist", "a/dist/y")}


def test_skips(spark):
    d = spark.createDataFrame([("a", "x\0y"), ("b", None), ("c", "z" * 70000), ("d", "fine")], "path string, text string")
    assert {(r.reason, r.total, tuple(r.sample)) for r in search.skip_notes(d).collect()} == {("binary", 1, ("a",)), ("unreadable", 1, ("b",)), ("line_too_long", 1, ("c",))}


def test_synthetic_code_counts(spark):
    d = synthetic_code(spark, 1000, "SPARSE", "DENSE")
    assert search.summary(search.occurrence_counts(d, Search("SPARSE"))).first().file_count == 10
    assert search.summary(search.occurrence_counts(d, Search("DENSE"))).first().asDict() == {"file_count": 20, "hit_count": 80}
    few, many = ({(r.path, r.occurrences) for r in search.occurrence_counts(x, Search("v = 7")).collect()} for x in (d.repartition(1), d.repartition(7)))
    assert few == many


def test_patterns_of_the_dialect(spark):
    texts = ["foo", "straße 12", "a😀b", "x:alph", "foo bar", "Ελλάδα", "abc\r", "ab\u2028c"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    found = lambda p: {r.i for r in d.where(Search(p, case="sensitive").found(d.x)).collect()}
    assert found(r"^\p{L}+$") == {0, 5} and found(r"\x{1F600}") == {2} and found(r"\bfoo\z") == {0} and found("^[[:alpha:]]+$") == {0}
    assert found("(?P<word>o{2}) b") == {4} and found(r"^\p{Greek}+$") == {5} and found(r"c$") == {7} and found(r"ab.c") == {7} and found(r"[[:^alpha:]]b") == {2, 4}
    for bad in ("[[:nope:]]", "a++", "(?>a)", r"\Z", r"\p{Nope}", "(?P<n>a"):
        with pytest.raises(PatternError):
            Search(bad)


def test_one_carriage_return_goes(spark):
    d = spark.createDataFrame([("x", "abc\r\r\nd")], "path string, text string")
    assert [r.line for r in search.lines(d).orderBy("line_no").collect()] == ["abc\r", "d"]


def test_pages_by_key(corpus):
    found, after, seen = search.contents(corpus, Search("needle")), None, []
    while rows := search.page_after(found, ["path", "line_no", "occ"], after, 2).collect():
        seen += [(r.path, r.line_no, r.occ) for r in rows]
        after = seen[-1]
    assert len(seen) == 5 and seen == sorted(seen)
