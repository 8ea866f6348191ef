"""Column functions on texts: sizes, quality, citations, links, scripts, classes of lines and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.columns import let

#: Bytes of a token in English and in CJK text; bytes a result has at most per 10,000 tokens of it. Fixed values.
ENGLISH_BYTES, CJK_BYTES, BUDGET_TOKENS = 5.17, 2.17, 10_000
#: Tokens that a result's frame, each image and its caption cost; bytes up to which the bound is used. Fixed values.
FRAME_TOKENS, IMAGE_TOKENS, CAPTION_TOKENS, BOUND_BYTES = 128, 1844, 32, 512
#: Code point ranges of scripts. Fixed values.
SCRIPTS = {"han": "一-鿿", "han_ext": "㐀-䶿", "hiragana": "぀-ゟ", "katakana": "゠-ヿ", "hangul": "가-힣", "rtl": "֐-ࣿ", "indic": "ऀ-ൿ", "thai": "฀-๿", "khmer": "ក-៿"}
#: Characters that count as mathematical. Fixed values.
MATH = "∑∫∂∇√∞≈≠≤≥±×÷αβγδεθλμπσω"
#: Links and addresses. Fixed values.
URL = r"https?://[^\s<>\[\]]*[^\s<>\[\].,!?;:]"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: Forms of citations: class, expression. Fixed values.
CITATIONS = [
    ("numeric", r"\[\s*\d+\s*\]"),
    ("range", r"\[\s*\d+-\d+\s*\]"),
    ("paren", r"\(\d+\)"),
    ("superscript", r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+"),
    ("author_year", r"\([A-Z][a-z]+(?:,?\s+and\s+[A-Z][a-z]+)?,?\s*\d{4}\)|[A-Z][a-z]+\s*\(\d{4}\)|[A-Z][a-z]+,\s*\d{4}"),
    ("combined", r"\[[A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}\]"),
]


#: White space of all scripts, inside brackets. Fixed values.
WIDE = r"\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WHITE = r"\t-\r " + WIDE


def count_of(text: Column, expression: str) -> Column:
    return F.regexp_count(text, F.lit(expression)).cast("long")


def plain_space(text: Column) -> Column:
    """A text with a blank for each white space beyond ASCII, so that \\s, which is far faster than the class of all, finds every one."""
    some = text.contains("\x85") | text.contains("\xa0") | text.rlike(r"[\u1680-\u3000]")
    return F.when((F.octet_length(text) > F.length(text)) & some, F.regexp_replace(text, f"[{WIDE}]", " ")).otherwise(text)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def cjk_ratio(text: Column) -> Column:
    return ratio(count_of(text, f"[{SCRIPTS['han']}]").cast("double"), F.length(text))


def cjk_dominant(text: Column) -> Column:
    """Whether over half of the characters that aren't white space are Chinese, Japanese or Korean."""
    ranges = "".join(SCRIPTS[k] for k in ("han", "han_ext", "hiragana", "katakana", "hangul"))
    return ratio(count_of(text, f"[{ranges}]").cast("double"), count_of(text, r"\S")) > 0.5


def byte_budget(text: Column, ceiling: int) -> Column:
    """Bytes that a result may have: fewer the denser its text is in tokens."""
    per_token = F.lit(ENGLISH_BYTES) - cjk_ratio(text) * (ENGLISH_BYTES - CJK_BYTES)
    return F.least(F.lit(ceiling).cast("long"), F.floor(per_token * BUDGET_TOKENS).cast("long"))


def json_length(text: Column) -> Column:
    """Bytes of a text inside a JSON string: two for a short escape, six for another control character."""
    return (F.octet_length(text) + count_of(text, r'["\\\x08\t\n\x0C\r]') + 5 * count_of(text, r"[\x00-\x07\x0B\x0E-\x1F]")).cast("long")


#: Fixed parts of a result's envelope.
ENVELOPE = ['{"resultType":"complete","content":[{"type":"text","text":"', '"}]', ',"isError":', "}"]


def envelope_length(text: Column, is_error: Column) -> Column:
    return json_length(text) + sum(map(len, ENVELOPE)) + F.when(is_error, 4).otherwise(5)


def token_bound(text: Column, limit: int) -> Column:
    """struct(tokens, exact): the bytes as a bound of the tokens if they are few, else null, to be counted."""
    n = F.octet_length(text).cast("long")
    return F.struct(F.when((n <= BOUND_BYTES) & (n <= limit), n).alias("tokens"), F.lit(False).alias("exact"))


def projected_tokens(tokens: Column, images: Column) -> Column:
    return tokens + FRAME_TOKENS + images * (IMAGE_TOKENS + CAPTION_TOKENS)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(plain_space(text), r"\s+", " "))


def normalize_space(text: Column) -> Column:
    """Each paragraph's lines trimmed, runs of white space as one space, empty lines left out; paragraphs stay apart."""

    def paragraph(p: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.split(p, "\n"), collapse_space), lambda x: x != ""), "\n")

    return F.array_join(F.transform(F.split(text, "\n\n"), paragraph), "\n\n")


def linkify(text: Column) -> Column:
    """URLs, then e-mail addresses, as Markdown links."""
    urls = F.when(text.contains("://") | text.contains("www."), F.regexp_replace(text, f"({URL})", "[$1]($1)")).otherwise(text)
    return F.when(text.contains("@"), F.regexp_replace(urls, f"({EMAIL})", "[$1](mailto:$1)")).otherwise(urls)


def has_url(text: Column) -> Column:
    return (F.length(text) >= 7) & text.rlike("(?i)https?://|ftp://|mailto:")


def has_email(text: Column) -> Column:
    """An @ and, anywhere after the first one, a dot."""
    at = F.instr(text, "@")
    return (at > 0) & (F.instr(F.substr(text, at + 1, F.length(text)), ".") > 0)


def citation_counts(text: Column) -> dict[str, Column]:
    """Matches of each form; a number of four digits in parentheses is a year, not a citation."""
    out = {k: count_of(text, e) for k, e in CITATIONS}
    out["paren"] = out["paren"] - count_of(text, r"\(\d{4}\)")
    return out


def quality_gate(text: Column) -> Column:
    """Why a text layer isn't usable (glyph_mapping_missing or below_threshold), or null if it is. All counts are made on the text itself."""
    total, bad = F.length(text), count_of(text, r"[\x00-\x08\x0E-\x1F\uFFFD\uE000-\uF8FF]")
    alnum = total - F.length(F.regexp_replace(text, r"[\p{IsAlphabetic}\p{N}]++", ""))

    def counts(plain: Column) -> Column:
        return F.struct(plain.alias("plain"), F.greatest(count_of(plain, r"\S++"), F.lit(1)).alias("m"), count_of(plain, r"(?<!\S)\S{1,2}(?!\S)").alias("short"))

    def reason(c: Column) -> Column:
        m, short, cjk = c["m"], c["short"] / c["m"], cjk_dominant(text)
        again = count_of(c["plain"], r"(?<!\S)(\S++)(?=\s++\1(?!\S))") / m
        mean = (total - count_of(c["plain"], r"\s")) / m
        return (
            F.when(total < 16, None)
            .when(bad / total > 0.20, "glyph_mapping_missing")
            .when((m >= 8) & (short > 0.80) & ~cjk, "glyph_mapping_missing")
            .when((m >= 8) & ((again > 0.30) | ((short > 0.55) & (mean < 2.5) & ~cjk)), "below_threshold")
            .when(alnum / total < 0.20, "below_threshold")
        )

    return let(let(plain_space(text), counts), reason)


def page_state(text: Column, drawn: Column) -> Column:
    """State of a page by its text and whether anything is drawn on it."""
    empty = ~text.rlike(f"[^{WHITE}]")
    return F.when(text.isNull(), "unavailable").when(empty & drawn, "image_required").when(empty, "blank").when(quality_gate(text).isNotNull(), "text_uncertain").otherwise("text_ready")


def looks_justified(line: Column) -> Column:
    return line.contains("  ") & (F.size(F.split(F.trim(line), r"\s+")) > 5)


def is_form(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit("_"), F.lit(""))) >= 3) | line.rlike(r"[\[\]☐☒□]")


def is_citation_line(line: Column) -> Column:
    return line.contains("et al") | line.contains("et. al") | (line.contains("[") & line.contains("]")) | line.rlike(r"19\d\d|20\d\d|2100")


def is_math_line(line: Column) -> Column:
    """A class of many single characters is slow to try, so ranges that hold them all come first."""
    return line.rlike("[±×÷α-ω∂-≥]") & line.rlike(f"[{MATH}]")


def line_kind(line: Column) -> Column:
    """What a line of Markdown is: blank, fence, heading, table_separator, table, quote, list, rule or text."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank")
        .when(t.rlike("^(```|~~~)"), "fence")
        .when(t.rlike("^#{1,6} "), "heading")
        .when(t.rlike(r"^\|( *[-:]+ *\|){2,}$"), "table_separator")
        .when(t.rlike(r"^\|.*\|$"), "table")
        .when(t.rlike("^>"), "quote")
        .when(t.rlike(r"^([-*+]|\d+[.)]) "), "list")
        .when(t.rlike(r"^([-*_])( *\1){2,}$"), "rule")
        .otherwise("text")
    )


def script_counts(text: Column) -> dict[str, Column]:
    return {k: count_of(text, f"[{r}]") for k, r in SCRIPTS.items()}


def inferred_language(text: Column) -> Column:
    """Kana mean Japanese, Hangul Korean, Han alone Chinese; null otherwise."""
    return F.when(text.rlike(f"[{SCRIPTS['hiragana']}{SCRIPTS['katakana']}]"), "japanese").when(text.rlike(f"[{SCRIPTS['hangul']}]"), "korean").when(text.rlike(f"[{SCRIPTS['han']}{SCRIPTS['han_ext']}]"), "chinese")


def band_line(text: Column) -> Column:
    """A line without digits, in lower case, for comparison over pages."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain_space(text), "[0-9]", ""), r"\s+", " ")))


#: Interpreters by the stem of a command's first word. Fixed values.
SHELLS = {"pwsh": "pwsh", "powershell": "pwsh", "cmd": "cmd", "wsl": "wsl", "python": "other-interpreter", "node": "other-interpreter", "perl": "other-interpreter", "ruby": "other-interpreter"}


def shell_delegate(command: Column) -> Column:
    """Which interpreter a command hands its work to."""
    quoted = F.regexp_extract(command, r"^\s*(?:'([^']*)'|\"([^\"]*)\")", 0)
    token = F.when(quoted != "", F.regexp_replace(F.trim(quoted), "^['\"]|['\"]$", "")).otherwise(F.regexp_extract(command, r"^\s*([^\s'\"]\S*)", 1))
    name = F.lower(F.regexp_extract(token, r"([^/\\]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = F.lit("none")
    for k, v in SHELLS.items():
        out = F.when(stem == k, v).otherwise(out)
    return F.when(name == "bash.exe", "wsl").otherwise(out)


def outcome_class(code: Column, stderr: Column, fatal: list[str], informational: list[str], denied: list[str], codes: list[int] | None = None) -> Column:
    """runner_failed, denied or ok of a finished call; code is the exit's text (null if it never ended)."""
    lowered = F.transform(F.split(stderr, "\n"), lambda x: F.lower(F.regexp_replace(x, "\r$", "")))

    def any_of(x: Column, words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | x.contains(w.lower())
        return out

    number = F.regexp_extract(F.coalesce(code, F.lit("")), "^([0-9]+)", 1)
    gate = F.lit(True) if codes is None else number.isin([str(c) for c in codes])
    info = F.array(*[F.lit(x.lower()) for x in informational]) if informational else F.array().cast("array<string>")
    failed = gate & F.exists(lowered, lambda x: ~F.array_contains(info, x) & any_of(x, fatal))
    zero = F.coalesce(code == "0", F.lit(False))
    return F.when(zero, "ok").when(failed, "runner_failed").when(any_of(F.lower(stderr), denied), "denied").otherwise("ok")


def first_int(payload: Column, keys: list[str]) -> Column:
    """The first of keys that a JSON object has as a number, a list (its length) or an object with a numeric count."""
    found = []
    for k in keys:
        value = F.get_json_object(payload, f"$.{k}")
        listed = F.json_array_length(value)
        found.append(F.when(value.rlike("^-?[0-9]+$"), value.cast("long")).when(value.rlike(r"^\["), listed.cast("long")).when(value.rlike(r"^\{"), F.get_json_object(value, "$.count").try_cast("long")))
    return F.coalesce(*found)


#: Classes of CJK punctuation. Fixed values.
CJK_MARKS = {"sentence": "。！？", "enumeration": "、，；：", "bracket": "〈-】〔〕（）［-］｛-｝", "other": "　〃・．－～"}


def cjk_mark_counts(text: Column) -> dict[str, Column]:
    return {k: count_of(text, f"[{r}]") for k, r in CJK_MARKS.items()}


#: What stands at the end of a text that was cut. Fixed value.
CUT_MARKER = " [truncated]"


def bounded(text: Column, most: int, marker: str = CUT_MARKER) -> Column:
    """A text of most bytes at most: whole, or its longest beginning with the marker; empty if not even the marker fits."""
    from textmill.operators.reading import truncated

    room = most - len(marker.encode())
    cut = F.concat(truncated(text, room)["text"], F.lit(marker)) if room >= 0 else F.lit("")
    return F.when(F.octet_length(text) <= most, text).otherwise(cut)


def isolated(text: Column) -> Column:
    """A text that looks right-to-left between the marks that isolate its direction."""
    from textmill.functions.cleaning import looks_rtl

    return F.when(looks_rtl(text), F.concat(F.lit("\u2067"), text, F.lit("\u2069"))).otherwise(text)


def milliseconds(nanoseconds: Column) -> Column:
    return nanoseconds / 1e6


def rfc3339(at: Column) -> Column:
    """A time of UTC to the millisecond."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
