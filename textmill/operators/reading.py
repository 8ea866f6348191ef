"""Reading: line and page slices, budgets in bytes, heads and tails, cursors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import cleaning
from textmill.operators.search import lines, split_lines

#: Lines of a read at most, bytes of a line, of a read.
MOST_LINES, LINE_BYTES, READ_BYTES = 2000, 8 * 1024, 256 * 1024


def line_slice(corpus: DataFrame, start: int = 1, count: int = MOST_LINES) -> DataFrame:
    """Lines start to start + count - 1 of each file; cut within the row before lines are made."""
    if start < 1 or not 1 <= count <= MOST_LINES:
        raise ValueError(f"start is from 1 and count 1 to {MOST_LINES}")
    d = corpus.select("path", F.posexplode(F.slice(split_lines(F.col("text")), start, count)).alias("i", "line"))
    return d.select("path", (F.col("i") + start).cast("long").alias("line_no"), F.regexp_replace("line", "\r\\z", "").alias("line"))


def truncated(line: Column, most: int = LINE_BYTES) -> Column:
    """struct(text, truncated): the longest beginning of whole characters within most bytes."""
    whole = F.octet_length(line) <= most
    head = F.left(line, F.lit(most))
    over = F.octet_length(head) - most
    # Only a line that isn't ASCII is walked character by character.
    sizes = F.transform(F.split(head, ""), lambda c: F.octet_length(c))
    fit = F.aggregate(sizes, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")), lambda s, b: F.when((s["bytes"] >= 0) & (s["bytes"] + b <= most), F.struct((s["bytes"] + b).alias("bytes"), (s["chars"] + (b > 0).cast("int")).alias("chars"))).otherwise(F.struct(F.lit(-1).alias("bytes"), s["chars"].alias("chars"))), lambda s: s["chars"])
    text = F.when(whole, line).when(over <= 0, head).otherwise(F.left(head, fit))
    return F.struct(text.alias("text"), (~whole).alias("truncated"))


def read_budget(corpus: DataFrame, most: int = READ_BYTES) -> DataFrame:
    """Lines of each file while their running size, a byte for each line end, is within most; the first always."""
    d = lines(corpus).withColumn("used", F.sum(F.octet_length("line") + 1).over(Window.partitionBy("path").orderBy("line_no")))
    return d.where((F.col("line_no") == 1) | (F.col("used") <= most))


def page_budget(corpus: DataFrame, most: int) -> DataFrame:
    """Lines of each file that a page of most bytes holds: path, line_no, used."""
    d = lines(corpus).withColumn("used", F.sum(F.octet_length("line") + 1).over(Window.partitionBy("path").orderBy("line_no")))
    return d.where(F.col("used") <= most).select("path", "line_no", "used")


def page_slice(pages: DataFrame, doc: str, number: str, first: int, last: int, most: int = 20) -> DataFrame:
    """Pages first to last of each document (at most that many; the end is the document's end)."""
    if first < 1 or last < first or last - first + 1 > most:
        raise ValueError(f"a range has 1 to {most} pages")
    total = F.max(number).over(Window.partitionBy(doc))
    return pages.withColumn("page_count", total).where(F.col(number).between(F.lit(first), F.least(F.lit(last), F.col("page_count"))))


def head_tail(text: Column, most: int) -> Column:
    """struct(head, tail, omitted) in characters: half for each end, spare moved over, nothing omitted if all fits."""
    n = F.length(text)
    head = F.least(n, F.lit(most // 2))
    tail = F.least(n - head, F.lit(most) - head)
    head = F.least(n - tail, F.lit(most) - tail)
    return F.struct(F.left(text, head).alias("head"), F.when(tail > 0, F.right(text, tail)).otherwise("").alias("tail"), (n - head - tail).cast("long").alias("omitted"))


def tail_bytes(content: Column, most: int) -> Column:
    """struct(total, start, data): the last bytes of a growing file."""
    total = F.length(content).cast("long")
    start = F.greatest(total - most, F.lit(0))
    return F.struct(total.alias("total"), start.alias("start"), F.substring(content, -most, most).alias("data"))


def cursor_page(files: DataFrame, most: int) -> DataFrame:
    """files(path, content, cursor, finalized) -> path, data, next_cursor: bytes from the cursor, cut to whole characters unless the file is finalized."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, cursor, done in pdf[["path", "content", "cursor", "finalized"]].itertuples(index=False):
                data = content[cursor : cursor + most]
                if not (done and cursor + len(data) == len(content)):
                    for k in range(1, min(4, len(data)) + 1):  # an unfinished character at the end stays for the next page
                        b = data[-k]
                        if b >= 0xC0:
                            if k < (4 if b >= 0xF0 else 3 if b >= 0xE0 else 2):
                                data = data[:-k]
                            break
                        if b < 0x80:
                            break
                out.append((path, data, cursor + len(data)))
            yield pd.DataFrame(out, columns=["path", "data", "next_cursor"])

    return files.mapInPandas(run, "path string, data binary, next_cursor long")


def cursor_parse(cursor: Column) -> Column:
    """struct(id, at): 16 lower-case hex digits, then nothing or a dot and an offset; null if it isn't a cursor."""
    ok = cursor.rlike(r"^[0-9a-f]{16}(\.[0-9]{1,18})?$")
    at = F.regexp_extract(cursor, r"^[0-9a-f]{16}\.([0-9]{1,18})$", 1)
    return F.when(ok, F.struct(F.left(cursor, F.lit(16)).alias("id"), F.coalesce(F.nullif(at, F.lit("")), F.lit("0")).cast("long").alias("at")))


def page_result(corpus: DataFrame, most: int, note: str) -> DataFrame:
    """The result of a read of each file: path, shown (lines), total and text, its first lines joined, with a note on a line of its own where not all are shown. text has most bytes at most; a note is always whole."""
    room = most - len(note.encode()) - 1
    if room < 0:
        raise ValueError("a result has to hold its note")
    d = lines(corpus).withColumn("used", F.sum(F.octet_length("line") + 1).over(Window.partitionBy("path").orderBy("line_no")) - 1)
    all_ = F.sum(F.octet_length("line") + 1) - 1 <= most
    kept = F.struct("line_no", "line", "used")
    g = d.where(F.col("used") <= most).groupBy("path").agg(F.array_sort(F.collect_list(kept)).alias("rows"))  # most bytes at most
    g = g.join(d.groupBy("path").agg(F.count("*").alias("total"), all_.alias("whole")), "path", "right")
    few = F.filter("rows", lambda r: F.col("whole") | (r["used"] <= room))
    g = g.select("path", "total", "whole", F.coalesce(few, F.expr("cast(array() as array<struct<line_no:bigint,line:string,used:bigint>>)")).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    text = F.when(F.col("whole"), body).when(F.size("rows") == 0, F.lit(note)).otherwise(F.concat_ws("\n", body, F.lit(note)))
    return g.select("path", F.size("rows").cast("long").alias("shown"), "total", text.alias("text"))


def chunk(text: Column, offset: Column, most: int) -> Column:
    """struct(text, next_offset, total) of the whole characters in most bytes from a byte offset; null if that lies past the end or within a character. next_offset is null at the end."""
    raw = text.cast("binary")
    total = F.length(raw).cast("long")
    here = F.substr(raw, (offset + 1).cast("int"), F.lit(most + 4))
    valid = (offset >= 0) & (offset <= total) & ~F.hex(F.substring(here, 1, 1)).rlike("^[89AB]")
    size = F.least(F.lit(most).cast("long"), total - offset)
    # Bytes of a character that the cut leaves at the end: continuations right after the cut belong to it.
    after = F.hex(F.substr(here, (size + 1).cast("int"), F.lit(1)))
    head = F.hex(F.substr(here, F.lit(1), size.cast("int")))
    whole = F.when(after.rlike("^[89AB]"), F.regexp_replace(head, "(?:C|D|E|F).(?:[89AB].){0,3}$", "")).otherwise(head)
    end = offset + F.length(whole) / 2
    return F.when(valid, F.struct(F.decode(F.unhex(whole), "UTF-8").alias("text"), F.when(end < total, end.cast("long")).alias("next_offset"), total.alias("total")))


def _aligned(raw: bytes, most: int) -> tuple[str, int, int]:
    """(text, bytes shown, bytes omitted): the head and the tail of bytes, each cut to whole lines if half of it stays."""
    if len(raw) <= most:
        return raw.decode("utf-8", "escape-bytes"), len(raw), 0
    head, tail = raw[: most - most // 2], raw[len(raw) - most // 2 :]
    for k in range(1, 4):  # a character that the cut leaves unfinished
        if k <= len(head) and head[-k] >= 0xC0:
            if k < (4 if head[-k] >= 0xF0 else 3 if head[-k] >= 0xE0 else 2):
                head = head[:-k]
            break
        if k <= len(head) and head[-k] < 0x80:
            break
    if 2 * (end := head.rfind(b"\n") + 1) >= len(head) and end:
        head = head[:end]
    start = next((k for k, b in enumerate(tail) if not 0x80 <= b < 0xC0), len(tail))
    tail = tail[start:]
    if (end := tail.find(b"\n") + 1) and 2 * (len(tail) - end) >= len(tail):
        tail = tail[end:]
    omitted = len(raw) - len(head) - len(tail)
    middle = (b"" if not head or head.endswith(b"\n") else b"\n") + f"... {omitted} bytes omitted ...".encode() + (b"" if not tail or tail.startswith(b"\n") else b"\n")
    return (head + middle + tail).decode("utf-8", "escape-bytes"), len(head) + len(tail), omitted


def rendered(content: Column, most: int) -> Column:
    """struct(text, shown, omitted) of a stream's bytes: head and tail of most bytes together, cut at line ends, with a line that says what is left out. Bytes that aren't UTF-8 are escaped."""

    def run(s: pd.Series) -> pd.DataFrame:
        cleaning.register()
        return pd.DataFrame([_aligned(r or b"", most) for r in s], columns=["text", "shown", "omitted"])

    return F.pandas_udf(run, "text string, shown long, omitted long")(content)
