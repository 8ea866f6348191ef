"""Lines of JSON, capped in length, in a few parts for each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a line, of a part, of a day's events. Fixed values.
LINE_BYTES, PART_BYTES, DAY_BYTES = 8 * 1024, 64 * 1024 * 1024, 127 * 1024 * 1024
#: What stands for a diagnostic that makes its line too long. Fixed value.
OMITTED = "[diagnostic omitted: log line limit]"


def line_of(df: DataFrame, diagnostic: str = "diagnostic", most: int = LINE_BYTES) -> Column:
    """A row as a line of JSON; if it is too long its diagnostic is left out, and null if it still is."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    short = F.to_json(F.struct(*[F.lit(OMITTED).alias(c) if c == diagnostic else F.col(f"`{c}`") for c in df.columns])) if diagnostic in df.columns else whole
    return F.when(F.octet_length(whole) <= most, whole).when(F.octet_length(short) <= most, short)


def rotated(df: DataFrame, day: str, order: list[str], diagnostic: str = "diagnostic", part: int = PART_BYTES, most: int = DAY_BYTES) -> DataFrame:
    """day, part (from 1), at (bytes of the day before the line) and line. Lines beyond a day's most bytes are dropped, as are those too long."""
    d = df.withColumn("line", line_of(df, diagnostic)).where("line IS NOT NULL").select(day, *order, "line")
    size = F.octet_length("line") + 1
    before = F.coalesce(F.sum(size).over(Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("at", before).where(F.col("at") + size <= most)
    return d.select(day, (F.floor(F.col("at") / part) + 1).cast("int").alias("part"), "at", "line")


def append(lines: DataFrame, day: str, folder: str) -> None:
    """Write lines of rotated() below folder, in a folder for each day and part."""
    lines.select(day, "part", F.col("line").alias("value")).write.mode("append").partitionBy(day, "part").text(folder)


def write_samples(samples: DataFrame, folder: str) -> None:
    """Benchmark samples, a line of JSON each."""
    samples.write.mode("append").json(folder)
