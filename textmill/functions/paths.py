"""Paths as columns: normal forms, display, scopes, identities and cursors of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbatim prefixes of paths and what is shown for them. Fixed values.
VERBATIM = [("//?/UNC/", "//"), ("//?/", "")]


def normalized(path: Column) -> Column:
    """A relative path without empty, `.` and `..` components; null if it is absolute or leads out of its root."""

    def step(s: Column, x: Column) -> Column:
        up = F.struct((s["ok"] & (F.size(s["parts"]) > 0)).alias("ok"), F.slice(s["parts"], F.lit(1), F.greatest(F.size(s["parts"]) - 1, F.lit(0))).alias("parts"))
        down = F.struct(s["ok"].alias("ok"), F.concat(s["parts"], F.array(x)).alias("parts"))
        return F.when(x.isin("", "."), s).when(x == "..", up).otherwise(down)

    start = F.struct(F.lit(True).alias("ok"), F.expr("cast(array() as array<string>)").alias("parts"))
    out = F.aggregate(F.split(path, "/"), start, step, lambda s: F.when(s["ok"], F.array_join(s["parts"], "/")))
    return F.when(~path.startswith("/"), out)


def display(path: Column) -> Column:
    """A path as it is shown: slashes only, without a verbatim prefix."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    shown = out
    for prefix, instead in reversed(VERBATIM):
        shown = F.when(out.startswith(prefix), F.concat(F.lit(instead), F.substr(out, F.lit(len(prefix) + 1), F.length(out)))).otherwise(shown)
    return shown


def in_scope(path: Column, granted: list[str]) -> Column:
    """Whether a normal path is, or stands below, one of the granted ones; the empty grant is the root. False for null."""
    out = F.lit(False)
    for g in granted:
        out = out | (F.lit(True) if g == "" else (path == g) | path.startswith(g + "/"))
    return F.coalesce(path.isNotNull() & out, F.lit(False))


def source_id(*identity: Column) -> Column:
    """16 hexadecimal digits for what a source is (path, length, time of change and the like): equal identities have equal ids."""
    return F.left(F.md5(F.concat_ws("|", *[c.cast("string") for c in identity]).cast("binary")), F.lit(16))


def cursor(source: Column, offset: Column) -> Column:
    """The cursor of an offset in a source, as reading.cursor_parse takes it; a null offset is the beginning."""
    return F.when(offset.isNull(), source).otherwise(F.concat_ws(".", source, offset.cast("string")))


#: First bytes of files that aren't text, in hexadecimal digits. Fixed values.
MAGIC = ["7F454C46", "4D5A", "89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A"]


def has_binary_magic(content: Column) -> Column:
    """Whether bytes begin like an executable or an image."""
    head = F.hex(F.substring(content, 1, 12))
    out = head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24)
    for m in MAGIC:
        out = out | head.startswith(m)
    return out


def has_pdf_header(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 8)).rlike("^255044462D3[0-9]2E3[0-9]$")
