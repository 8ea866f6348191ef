"""Cleaning of extracted text and classes of tables, regions and pages, as columns."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of colour spaces that leak into text. Fixed values.
METADATA = ["WhitePoint", "BlackPoint", "Gamma", "Matrix", "CalRGB", "CalGray"]
#: Ligatures and their letters. Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Words that mark a citation of a journal, and hosts. Fixed values.
JOURNAL_WORDS = ["volume", "vol.", "article", "issue"]
HOSTS = [".org", ".com", ".net"]
RTL = r"\u0590-\u08FF\uFB1D-\uFDFF\uFE70-\uFEFC"


def drop_metadata_lines(text: Column) -> Column:
    """Text without lines that begin with a colour space key and go on with a bracket, a name or nothing."""
    leak = "^(" + "|".join(METADATA) + r")\s*($|[\[/<])"
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(leak)), "\n")
    return F.when(text.rlike("|".join(METADATA)), kept).otherwise(text)


def split_ligatures(text: Column) -> Column:
    for k, v in LIGATURES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def unify_radicals(text: Column) -> Column:
    """Kangxi radicals as the unified ideographs that they are compatible with, by the Unicode tables that Python has."""
    import unicodedata

    radicals = [chr(c) for c in range(0x2F00, 0x2FD6)]
    return F.translate(text, "".join(radicals), "".join(unicodedata.normalize("NFKC", c) for c in radicals))


def artifact_signature(text: Column) -> Column:
    """White space as single spaces and runs of digits of any script as #, for comparison over pages."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Nd}+", "#"), r"\s+", " "))


def stable_pagination(text: Column) -> Column:
    """Whether a line that never changes is a page's furniture: a digit with a DOI, a volume or the host of a journal."""
    low = F.lower(text)
    any_of = lambda words: F.lit(False) if not words else low.contains(words[0]) | any_of(words[1:])
    return low.rlike(r"\p{Nd}") & (any_of(["doi.org", "doi:", "/doi/"]) | any_of(JOURNAL_WORDS) | (low.contains("www.") & any_of(HOSTS)))


def looks_rtl(text: Column) -> Column:
    return text.rlike(f"[{RTL}]")


def content_lines(text: Column, prefixes: list[str]) -> Column:
    """Lines, trimmed, that aren't empty and don't begin with one of the prefixes (in lower case)."""

    def skip(x: Column) -> Column:
        out = x == ""
        for p in prefixes:
            out = out | F.lower(x).startswith(p)
        return out

    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: ~skip(x))


def strip_images(payload: Column) -> Column:
    """A JSON text with the data of images left out."""
    return F.regexp_replace(payload, r'("data"\s*:\s*")[A-Za-z0-9+/=]*(")', "$1$2")


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^\s*([-*+] (?=\s*\S)|[-*+] $|[0-9]+[.)] )")


def tighten_lists(text: Column) -> Column:
    """Text without the blank lines between two list items."""
    item = r"[ \t]*(?:[-*+] [^\n]*\S[^\n]*|[0-9]+[.)] [^\n]*)"
    return F.regexp_replace(text, rf"(?m)(?<=^|\n)({item})\n(?:[ \t]*\n)+(?={item}(?:\n|$))", "$1\n")


def is_data_value(cell: Column) -> Column:
    return cell.rlike(r"^[0-9.,%+\-−$€£]*[0-9][0-9.,%+\-−$€£]*$")


def valid_table(rows: Column) -> Column:
    """rows: array of rows of cells. Not too empty, and no wrapped value below an empty label in a table of two columns."""
    cells = F.flatten(rows)
    empty = F.size(F.filter(cells, lambda c: F.trim(c) == "")) / F.greatest(F.size(cells), F.lit(1))
    wrapped = F.exists(rows, lambda r: (F.size(r) == 2) & (F.trim(F.get(r, F.lit(0))) == "") & (F.trim(F.get(r, F.lit(1))) != ""))
    return (F.size(cells) > 0) & (empty <= 0.6) & ~((F.size(F.get(rows, F.lit(0))) == 2) & wrapped)


def table_not_prose(rows: Column) -> Column:
    """A table of five columns and more without rules is prose if over 0.7 of its cells are single words and under half are values."""
    cells = F.filter(F.transform(F.flatten(rows), lambda c: F.trim(c)), lambda c: c != "")
    n = F.size(cells)
    values = F.size(F.filter(cells, is_data_value))
    single = F.size(F.filter(cells, lambda c: ~c.rlike(r"\s")))
    return (F.size(F.get(rows, F.lit(0))) < 5) | (n == 0) | (values * 2 >= n) | (single <= n * 0.7)


def justification(variance: Column, start: Column, end: Column, width: Column, margin: Column) -> Column:
    """How a line is set, by its distance from both margins and how its word spaces vary."""
    left, right = start - margin, width - end
    return (
        F.when((left < 5) & (right < 5), "full").when(F.abs(left - right) < 10, "center").when(right < 5, "right")
        .when((left < 5) & (variance > 0.5), "full").when(left < 5, "left").otherwise("none")
    )


def region_class(lines: Column, mean_chars: Column, wide: Column, numbered: Column, form: Column, hanging: Column) -> Column:
    """What a block of lines is; wide, numbered and form are shares of its lines."""
    return (
        F.when(lines < 6, "mixed").when(mean_chars < 10, "table").when(form >= 0.4, "form")
        .when((mean_chars > 12) & ((numbered >= 0.3) | hanging), "reference").when((mean_chars > 20) & (wide > 0.5), "prose").otherwise("mixed")
    )


def page_kind(glyphs: Column, garbled: Column, fragmented: Column, paths: Column, image: Column, text: Column, invisible: Column, empty: Column | None = None) -> Column:
    """Whether a page is empty, scanned, text over an image or a text layer, by its signals (counts and shares).

    empty: whether nothing at all is on the page. Its text can be used if there are 24 glyphs and
    few are garbled or in fragments. Vector outlines without usable text, and full images without it, are scans;
    a full image over mostly invisible usable text is a text layer, a smaller image beside it image and text.
    """
    sound = (garbled <= 0.20) & (fragmented <= 0.80)
    usable, full = sound & (glyphs >= 24), image >= 0.80
    text_layer = (full & usable & (invisible >= 0.50)) | (usable & ~full & (image <= 0.05)) | (~usable & ~full & (glyphs > 0) & sound & (image < 0.05) & (paths <= 0.60)) | (usable & full & (text >= 0.10))
    return (
        F.when(F.lit(False) if empty is None else empty, "empty")
        .when(full & usable & (invisible < 0.50) & (text < 0.10), "scanned")
        .when(text_layer, "text_layer")
        .when(usable & (image > 0.05) & ~full, "image_text")
        .otherwise("scanned")
    )


def register() -> None:
    """Make the error handler known, in each process that decodes."""
    codecs.register_error("escape-bytes", lambda e: ("".join(f"\\x{b:02X}" for b in e.object[e.start : e.end]), e.end))


def escape_invalid(raw: bytes) -> tuple[str, int]:
    """Bytes as text, each byte that isn't UTF-8 as an escape of its two digits, and how many there are."""
    register()
    text = raw.decode("utf-8", "escape-bytes")
    return text, (len(text.encode()) - len(raw)) // 3  # an escape takes the place of one byte by four


def escaped(raw: Column) -> Column:
    """struct(text, invalid) of bytes; null bytes give nulls."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if r is None else escape_invalid(r) for r in s], columns=["text", "invalid"])

    return F.pandas_udf(run, "text string, invalid int")(raw)
