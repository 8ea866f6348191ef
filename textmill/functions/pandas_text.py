"""Text functions that walk a text step by step, as Arrow-batched pandas functions."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: First parts that keep their hyphen, and pairs of parts that do. Fixed values.
COMPOUND_FIRST = set(
    "self non anti pre post re co ex multi semi sub super ultra under over cross inter intra counter mid well ill all half high low full part short long hard soft".split()
)
COMPOUND_PAIRS = [("content", "type"), ("content", "length"), ("content", "encoding"), ("content", "coding"), ("user", "agent"), ("cache", "control"), ("product", "version"), ("media", "type")]


def _keeps_hyphen(first: str, second: str, common: frozenset[str]) -> bool:
    low = first.lower()
    if low in COMPOUND_FIRST or any(low == a and second.lower().startswith(b) for a, b in COMPOUND_PAIRS):
        return True
    return bool(second[:1].islower() and first[-1:].islower() and first + second not in common)


def join_hyphens(text: str | None, common: frozenset[str] = frozenset(), least: int = 2) -> str | None:
    """Words that a hyphen parts over a line end, joined with the rest of the next line; compounds keep theirs. common: words that are never compounds."""
    if text is None:
        return None
    rows, out, i = text.split("\n"), [], 0
    while i < len(rows):
        line = rows[i]
        i += 1
        while i < len(rows):
            m = re.search(r"(\S*[^\W\d_])([-­])\s*$", line)
            following = rows[i].split(None, 1)
            if not m or not following or len(following[0].encode()) < least or (m[2] == "-" and _keeps_hyphen(m[1], following[0], common)):
                break
            before = line[: m.start()].rstrip()
            line = " ".join(x for x in (before, m[1] + following[0], *following[1:]) if x)
            i += 1
        out.append(line)
    return "\n".join(out)


_LATIN = re.compile("[\x80-\xff]{2,}")


def repair_mojibake(text: str | None) -> str | None:
    """Runs of Latin-1 characters that are UTF-8 bytes of text beyond Latin-1, decoded."""

    def fix(m: re.Match) -> str:
        try:
            out = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return out if any(c > "\xff" for c in out) else m[0]

    return None if text is None else _LATIN.sub(fix, text)


def find_citations(text: str | None) -> list[dict]:
    """struct(position, kind, text) in order; of those at one position the first in the order of forms stays."""
    from textmill.functions.text import CITATIONS

    found: dict[int, dict] = {}
    for kind, expression in CITATIONS:
        for m in re.finditer(expression, text or ""):
            if kind == "paren" and re.fullmatch(r"\(\d{4}\)", m[0]):
                continue
            found.setdefault(m.start(), {"position": m.start(), "kind": kind, "text": m[0]})
    return [found[k] for k in sorted(found)]


@functools.cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Pretokens: words with their case runs and contractions, numbers of up to three digits, punctuation, white space. Fixed values.
PRETOKEN = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)


@functools.cache
def _pretoken():
    import regex

    return regex.compile(PRETOKEN)


def pretoken_count(text: str | None) -> int:
    return sum(1 for _ in _pretoken().finditer(text or ""))


_SEPARATOR, _PIPED = re.compile(r"^\s*\|(\s*[-:]+\s*\|){2,}\s*$"), re.compile(r"^(\s*)\|")


def escape_pipes(text: str | None) -> str | None:
    """Text with the first | of a row escaped unless the row is part of a table: a separator, the row above it, or the rows with | right below."""
    if text is None or "|" not in text:
        return text
    rows, inside, out = text.split("\n"), False, []
    for k, row in enumerate(rows):
        inside = bool(_SEPARATOR.match(row)) or (inside and bool(_PIPED.match(row)))
        above = k + 1 < len(rows) and _SEPARATOR.match(rows[k + 1])
        out.append(row if inside or above else _PIPED.sub(r"\1\\|", row))
    return "\n".join(out)


def escape_stray_pipes(text: ColumnOrName) -> Column:
    return F.pandas_udf(lambda s: s.map(escape_pipes), "string")(text)


def dehyphenate(text: ColumnOrName) -> Column:
    return F.pandas_udf(lambda s: s.map(join_hyphens), "string")(text)


def mojibake(text: ColumnOrName) -> Column:
    return F.pandas_udf(lambda s: s.map(repair_mojibake), "string")(text)


def pretokens(text: ColumnOrName) -> Column:
    """Pretokens of a text, counted by Java's matcher (U: white space and case of all scripts)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?U)" + PRETOKEN)).cast("long")


def citations(text: ColumnOrName) -> Column:
    return F.pandas_udf(lambda s: s.map(find_citations), "array<struct<position:int,kind:string,text:string>>")(text)


def token_counter(path: str):
    """A function that counts tokens exactly by the rank file at path, which all executors must be able to read."""

    def run(s: pd.Series) -> pd.Series:
        e = _encoding(path)
        return pd.Series([len(x) for x in e.encode_ordinary_batch(s.fillna("").tolist(), num_threads=1)], dtype="int64")

    return F.pandas_udf(run, "long")


def _decoded(raw: bytes | None, label: str | None) -> tuple[str | None, str]:
    """Strict decoding: a byte order mark beats a label; without either UTF-8, then GBK or Big5 if enough bytes speak for one."""
    if raw is None:
        return None, "missing"
    if raw[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff"):
        return None, "utf-32"
    marks = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
    mark = next(((m, e) for m, e in marks if raw.startswith(m)), None)
    tries = [(raw[len(mark[0]) :], mark[1])] if mark else [(raw, label)] if label else [(raw, "utf-8")] + ([(raw, "gbk"), (raw, "big5")] if sum(b > 127 for b in raw) >= 8 else [])
    for data, name in tries:
        try:
            text = data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        return (None, "binary") if "\0" in text else (text, name)
    return None, "undetected"


def decode_files(raw: pd.Series, label: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_decoded(r, x if isinstance(x, str) else None) for r, x in zip(raw, label, strict=True)], columns=["text", "encoding"])


def decode(raw: ColumnOrName, label: ColumnOrName) -> Column:
    """struct(text, encoding) of file contents; text is null if they aren't text."""
    return F.pandas_udf(decode_files, "text string, encoding string")(raw, label)
