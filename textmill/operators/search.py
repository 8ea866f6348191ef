"""Search over a corpus(path, text): lines, files, counts, contents with context, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.patterns import Search


def split_lines(text: Column) -> Column:
    """Lines of a text without their ends (LF or CRLF); a final end adds no line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines(corpus: DataFrame, *keep: str) -> DataFrame:
    """One row per line: path, line_no from 1, line."""
    d = corpus.select("path", *keep, F.posexplode(split_lines(F.col("text"))).alias("i", "line"))
    return d.select("path", *keep, (F.col("i") + 1).cast("long").alias("line_no"), F.regexp_replace("line", "\r\\z", "").alias("line"))


def candidates(corpus: DataFrame, search: Search) -> DataFrame:
    """Rows whose whole text matches somewhere, before any line is made; anchors need lines, so they aren't tried."""
    if search.fixed or not any(c in search.pattern for c in "^$\\"):
        return corpus.where(search.found(F.col("text")))
    return corpus


def matching_files(corpus: DataFrame, search: Search) -> DataFrame:
    """path of files (a row is a file) with a match in a line. Decided within each row: nothing is shuffled."""
    return candidates(corpus, search).where(F.exists(split_lines(F.col("text")), lambda x: search.found(F.regexp_replace(x, "\r\\z", "")))).select("path")


def occurrence_counts(corpus: DataFrame, search: Search) -> DataFrame:
    """path and occurrences (matches that don't overlap, not lines) of files that have any. Counted within each row: nothing is shuffled."""
    per_line = F.transform(split_lines(F.col("text")), lambda x: search.count(F.regexp_replace(x, "\r\\z", "")))
    total = F.aggregate(per_line, F.lit(0).cast("long"), lambda a, b: a + b)
    return candidates(corpus, search).select("path", total.alias("occurrences")).where("occurrences > 0")


def contents(corpus: DataFrame, search: Search) -> DataFrame:
    """One record for each occurrence (a line with two matches comes twice): path, line_no, occ, line."""
    found = lines(candidates(corpus, search)).withColumn("n", search.count(F.col("line"))).where("n > 0")
    return found.select("path", "line_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("occ"), "line")


def with_context(corpus: DataFrame, search: Search, before: int = 0, after: int = 0) -> DataFrame:
    """Matching lines and the lines around them: path, line_no, kind (match or context), line."""
    d = lines(candidates(corpus, search)).withColumn("hit", search.found(F.col("line")).cast("int"))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(-after, before)
    d = d.withColumn("near", F.max("hit").over(w)).where("near = 1")
    return d.select("path", "line_no", F.when(F.col("hit") == 1, "match").otherwise("context").alias("kind"), "line")


def page(ordered: DataFrame, order: list, offset: int = 0, limit: int = 200) -> DataFrame:
    """Rows offset to offset + limit of a total order, with next_offset (null on the last page): one top-k, no full sort."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000 and offset not negative")
    probe = ordered.orderBy(*order).limit(offset + limit + 1)
    rank = F.row_number().over(Window.orderBy(*order))  # over the probe alone
    more = F.max("_rank").over(Window.partitionBy()) > offset + limit
    probe = probe.withColumn("_rank", rank).withColumn("next_offset", F.when(more, F.lit(offset + limit)).cast("long"))
    return probe.where((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)).drop("_rank")


def page_after(rows: DataFrame, order: list[str], after: tuple | None = None, limit: int = 200) -> DataFrame:
    """The first limit rows beyond the key after of a total order (None: from the start). However far a page is, no row before it is brought together."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            beyond, same = beyond | (same & (F.col(name) > F.lit(value))), same & (F.col(name) == F.lit(value))
        rows = rows.where(beyond)
    return rows.orderBy(*order).limit(limit)


def summary(counts: DataFrame) -> DataFrame:
    """file_count and hit_count of occurrence counts."""
    return counts.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("occurrences"), F.lit(0)).cast("long").alias("hit_count"))


#: Lines longer than this many bytes stop a search of their file.
LONG_LINE = 64 * 1024


def skip_reason(text: Column) -> Column:
    """Why a file is left out of a search: unreadable, binary (a NUL), a line too long, or null if it isn't."""
    return F.when(text.isNull(), "unreadable").when(F.instr(text, "\0") > 0, "binary").when(F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) > LONG_LINE), "line_too_long")


def skip_notes(corpus: DataFrame, sample: int = 32) -> DataFrame:
    """Skipped files: reason, total of it, and a sample of at most that many paths, the first in order."""
    s = corpus.select("path", skip_reason(F.col("text")).alias("reason")).where("reason IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("path"))
    few = s.withColumn("k", rank).where(F.col("k") <= sample)  # a top-k of each task before the shuffle
    few = few.groupBy("reason").agg(F.array_sort(F.collect_list("path")).alias("sample"))
    return s.groupBy("reason").agg(F.count("*").alias("total")).join(few, "reason").select("reason", "total", "sample")
