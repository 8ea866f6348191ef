"""Personal data to format-preserving pseudonyms by keyed Feistel permutations, with DataFrame functions only.

Found and validated: e-mail addresses, card and account numbers (13 to 19 digits in one, 4-4-4-4, 4-6-5 or 4-6-4
groups, with a right check digit; others stay as they are), social security numbers (of areas that exist), phone
numbers (3-3-4 digits, or 8 to 15 in any groups after a plus), IPv4 addresses (octets up to 255), numeric dates
(days of the calendar from 1800 to 2199: year, month, day; day, month, year; or month, day, year where only that
is a day), keys of 32 and more hexadecimal digits and access keys with a known beginning. Each is permuted within
its format: rounds of a Feistel network, alternating between two halves, add a keyed hash of one half to the
other, modulo the size of the half's domain (numbers) or of each character's alphabet (strings); a string of one
character takes a keyed permutation of its alphabet. A permutation has no collisions, so equal values get equal
pseudonyms in all documents and different values different ones. Separators stay, and in numbers take no part, so
one number written in two ways stays one number; nor does case, which is kept place by place (in keys, of which
letters and digits change places, for the whole key). An e-mail's domain is permuted by itself but for its last part, its
local part under that domain. A check digit is made anew, so valid numbers stay valid ones.

The key is the caller's or the session's textmill.pii.key. Where neither is set, one is drawn for the session, so
that nobody can undo the pseudonyms; values are then linked within the session only.

Defined results: a null text stays null and has 0 finds; text outside the finds is unchanged; letters beyond ASCII
in an address stay; repeated rows get the same result each; an empty table gives an empty result; other columns
are kept by pseudonymize and left out of the query.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import let

KEY = "textmill.pii.key"
ROUNDS = 8

#: What is found, in order of precedence. Fixed values.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
KINDS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])(?=[._%+-]*+[\p{L}\p{N}])[\p{L}\p{N}._%+-]++@[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+(?:\.[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+)++(?<=\.[A-Za-z][A-Za-z0-9-]{1,62})(?![\p{L}\p{N}])"),
    ("secret", r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"),
    ("token", r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|glpat-[0-9A-Za-z_-]{20,}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z])"),
    ("date", r"(?<![0-9./-])(?:(?:1[89]|2[01])[0-9]{2}([-/])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([./-])(?:0?[1-9]|[12][0-9]|3[01])\2(?:1[89]|2[01])[0-9]{2})(?![0-9]|[./-][0-9])"),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"),
    ("phone", r"(?<![0-9])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9](?:[ ./-]?\(?[0-9]\)?){7,14})(?![0-9])"),
    ("ip", rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"),
    ("number", r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])"),
]
#: The beginnings of access keys, which stay. Fixed values.
TOKEN_BEGINS = r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|sk-|xox[abprs]-|AIza)"
#: What any find has, and that few other texts have many of.
HINT = r"[0-9@]|AKIA|ASIA|gh[pousr]_|glpat-|sk-|xox[abprs]-|AIza"
DAYS, DAYS_A, DAYS_B = 146097, 189, 773  # days of 400 years, as a product
FROM_DAY = "1800-01-01"
LATE_A, LATE_B, LATE_MONTH = 9, 9833, 88497 / 4800  # days after the 12th in 400 years, as a product, and those of a mean month
#: Country codes of phone numbers. Fixed values.
CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def patterns() -> tuple[str, dict[str, str]]:
    """All kinds as one expression, and each kind's own; back references are numbered by where their groups stand."""
    joined, seen = [], 0
    for _, p in KINDS:
        groups = 2 if r"\2" in p else 0
        joined.append("(?:" + p.replace(r"\2", rf"\{seen + 2}").replace(r"\1", rf"\{seen + 1}") + ")")
        seen += groups
    return "|".join(joined), dict(KINDS)


def _hash(key: Column, what: str, i: Column, other: Column, block: Column | None = None) -> Column:
    """512 bits as hexadecimal digits; what names the kind of value, so that no two kinds share a permutation."""
    return F.sha2(F.concat_ws("|", key, F.lit(what), i.cast("string"), *([] if block is None else [block.cast("string")]), other.cast("string")), 512)


def feistel_number(x: Column, a: int, b: int, key: Column, what: str) -> Column:
    """Permutes 0 <= x < a * b; x is taken as a pair below a and b."""

    def step(s: Column, i: Column) -> Column:
        def add(of: Column, other: Column, size: int) -> Column:
            return F.pmod(of + F.conv(F.substring(_hash(key, what, i, other), 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))

        left = F.struct(add(s["l"], s["r"], a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), add(s["r"], s["l"], b).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b).cast("long")).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


#: Characters of a string that one hash moves: each by 15 bits of it or more, 4 hexadecimal digits.
PER_HASH = 32


def _shifted(text: Column, key: Column, what: str, i: Column, other: Column, alphabets: list[str]) -> Column:
    """Each character moved within its alphabet by a part of its own of a keyed hash of other; others stay."""

    def moved(parts: Column) -> Column:
        def move(c: Column, j: Column) -> Column:
            by = F.conv(F.get(parts, j), 16, 10).cast("int")
            out = c
            for alphabet in alphabets:
                place = F.position(c, F.lit(alphabet))
                to = F.substr(F.lit(alphabet), F.pmod(place - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
                out = F.when((c != "") & (place > 0), to).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(text, ""), move), "")

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / PER_HASH).cast("int"))
    cut = lambda h: F.transform(F.sequence(F.lit(0), F.lit(PER_HASH - 1)), lambda k: F.substr(h, k * 4 + 1, F.lit(4)))
    return let(F.flatten(F.transform(blocks, lambda b: let(_hash(key, what, i, other, b), cut))), moved)


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def swap_or_not(c: Column, alphabet: str, key: Column, what: str, rounds: int = 24) -> Column:
    """A keyed permutation of an alphabet: each round maps a place to itself or to its mirror."""
    n = F.lit(len(alphabet))

    def number(r: Column, other: Column) -> Column:
        return F.conv(F.substring(_hash(key, what, r, other), 1, 15), 16, 10).cast("long")

    def step(x: Column, r: Column) -> Column:
        def swapped(mirror: Column) -> Column:
            return F.when(number(r, F.greatest(x, mirror)) % 2 == 1, mirror).otherwise(x)

        return let(F.pmod(number(r, F.lit("mirror")) - x, n), swapped)

    place = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), (F.position(c, F.lit(alphabet)) - 1).cast("long"), step)
    return F.substr(F.lit(alphabet), place.cast("int") + 1, F.lit(1))


def feistel_string(x: Column, alphabets: list[str], key: Column, what: str) -> Column:
    """Permutes the strings that have the same length and the same alphabet at each place as x. key may hold what the permutation depends on besides."""

    def step(s: Column, i: Column) -> Column:
        left = F.struct(_shifted(s["l"], key, what, i, s["r"], alphabets).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), _shifted(s["r"], key, what, i, s["l"], alphabets).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1, F.length(x)).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))
    for alphabet in alphabets:
        out = F.when((F.length(x) == 1) & (F.position(x, F.lit(alphabet)) > 0), swap_or_not(x, alphabet, key, what)).otherwise(out)
    return out


def permuted(x: Column, key: Column, what: str) -> Column:
    """A name of letters and digits permuted in lower case; separators before it take no part, case is kept place by place."""
    begin = F.regexp_extract(x, "^[._%+-]*", 0)
    form = F.substr(x, F.length(begin) + 1, F.length(x))
    out = F.split(feistel_string(F.lower(form), [DIGITS, LOWER], key, what), "")
    return F.concat(begin, F.array_join(F.zip_with(out, F.split(form, ""), lambda c, f: F.when(f.rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), ""))


def luhn_sum(digits: Column, check: bool) -> Column:
    """The Luhn sum of a digit string; check: whether its last digit is the check digit or still to be found."""

    def add(s: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(k % 2 == (1 if check else 0), doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def written_like(digits: Column, form: Column, skip: Column | int = 0) -> Column:
    """form with its digits, after the first skip of them, replaced by digits in order."""

    def fill(d: Column) -> Column:
        def put(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substr(form, F.lit(1), i + 1), "[^0-9]", "")) - skip
            return F.when(c.between("0", "9") & (nth > 0), F.substr(d, nth, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(form, ""), put), "")

    return let(digits, fill)


def pseudonym(x: Column, key: Column) -> Column:
    """struct(kind, value) for one find."""
    digits = F.regexp_replace(x, "[^0-9]", "")

    name, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    body = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    tweaked = F.concat_ws("|", key, F.lower(domain))
    email = F.concat(permuted(name, tweaked, "email"), F.lit("@"), permuted(body, key, "domain"), top)

    # Letters and digits of a key change places, so its case is that of its letters: upper if it has no lower-case one.
    secret = let(feistel_string(F.lower(x), ["0123456789abcdef"], key, "secret"), lambda v: F.when(x.rlike("[a-f]"), v).otherwise(F.upper(v)))
    begin = F.regexp_extract(x, TOKEN_BEGINS, 0)
    token = F.concat(begin, feistel_string(F.substr(x, F.length(begin) + 1, F.length(x)), [DIGITS, LOWER, LOWER.upper()], key, "token"))

    first = x.rlike("^[0-9]{4}")
    shape = F.regexp_extract(x, "[./-]", 0)
    parts = F.split(F.regexp_replace(x, "[./]", "-"), "-")
    two = [F.lpad(F.get(parts, F.lit(k)), 2, "0") for k in (0, 1, 2)]
    one_digit = x.rlike("(?<![0-9])[0-9](?![0-9])")

    def of_parts(y: int, m: int, d: int) -> Column:
        return F.try_to_date(F.concat_ws("-", F.get(parts, F.lit(y)), two[m], two[d]), "yyyy-MM-dd")

    # Month before day only where it can't be the other way; these dates, all after the 12th, are permuted among themselves.
    month_first = ~first & of_parts(2, 1, 0).isNull()
    day = F.when(first, of_parts(0, 1, 2)).otherwise(F.coalesce(of_parts(2, 1, 0), of_parts(2, 0, 1)))
    from_day = F.lit(FROM_DAY).cast("date")
    any_day = F.date_add(from_day, feistel_number(F.datediff(day, from_day).cast("long"), DAYS_A, DAYS_B, key, "date").cast("int"))
    late = F.datediff(day, from_day) - 12 * ((F.year(day) - 1800) * 12 + F.month(day))

    def late_day(r: Column) -> Column:
        month = F.floor(r / LATE_MONTH).cast("int")
        begins = lambda m: F.datediff(F.add_months(from_day, m), from_day) - 12 * m
        m = F.when(begins(month + 1) <= r, month + 1).when(begins(month) <= r, month).otherwise(month - 1)
        return F.date_add(from_day, (r + 12 * (m + 1)).cast("int"))

    moved = F.when(month_first, let(feistel_number(late.cast("long"), LATE_A, LATE_B, key, "late"), late_day)).otherwise(any_day)

    def dated(v: Column) -> Column:
        y = F.date_format(v, "yyyy")
        m, d = (F.when(one_digit, F.date_format(v, k)).otherwise(F.date_format(v, k * 2)) for k in "Md")
        return F.when(first, F.concat(y, shape, m, shape, d)).when(month_first, F.concat(m, shape, d, shape, y)).otherwise(F.concat(d, shape, m, shape, y))

    date = let(moved, dated)

    # Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
    area = F.substring(digits, 1, 3).cast("long")
    rest = (F.substring(digits, 4, 2).cast("long") - 1) * 9999 + F.substring(digits, 6, 4).cast("long") - 1

    def written(n: Column) -> Column:
        new_area, new_rest = F.floor(n / (99 * 9999)), F.pmod(n, F.lit(99 * 9999).cast("long"))
        new_area = new_area + 1 + (new_area >= 665).cast("long")
        return F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(new_rest / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(new_rest, F.lit(9999).cast("long")) + 1).cast("string"), 4, "0"))

    ssn = let(feistel_number((area - 1 - (area > 666).cast("long")) * (99 * 9999) + rest, 898, 99 * 9999, key, "ssn"), written)

    # A country code stays; without one there are ten digits.
    coded = F.when(x.startswith("+"), F.length(F.regexp_extract(digits, CODE, 0))).otherwise(F.length(digits) - 10)
    phone = let(coded, lambda n: written_like(feistel_string(F.substr(digits, n + 1, F.length(digits)), [DIGITS], key, "phone"), x, n))

    octets = F.split(x, "[.]")
    word = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    octet = lambda v, k: F.pmod(F.floor(v / 2**k).cast("long"), F.lit(256).cast("long")).cast("string")
    ip = let(feistel_number(word, 65536, 65536, key, "ip"), lambda v: F.concat_ws(".", *[octet(v, k) for k in (24, 16, 8, 0)]))

    def account(d: Column) -> Column:
        body = feistel_string(F.substr(d, F.lit(1), F.length(d) - 1), [DIGITS], key, "number")
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, False), F.lit(10)).cast("string")))

    number = written_like(let(digits, account), x)

    made = {"email": email, "secret": secret, "token": token, "date": date, "ssn": ssn, "phone": phone, "ip": ip, "number": number}
    kind = F.lit("none")
    for k, p in reversed(KINDS):
        valid = luhn_sum(digits, True) % 10 == 0 if k == "number" else ~day.isNull() if k == "date" else F.lit(True)
        kind = F.when(x.rlike("^(?:" + p + ")$"), F.when(valid, F.lit(k)).otherwise("none")).otherwise(kind)

    def of_kind(k: Column) -> Column:
        value = x
        for name, column in made.items():
            value = F.when(k == name, column).otherwise(value)
        return F.struct(k.alias("kind"), value.alias("value"))

    return let(kind, of_kind)


def session_key(spark: SparkSession) -> str:
    """The session's key; one is drawn where none is set."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text replaced and pii, an array of struct(kind, value) of the pseudonyms in order. What looks like a date or number but isn't a valid one stays and isn't listed."""
    secret = F.lit(key or session_key(docs.sparkSession))
    pattern = F.lit(patterns()[0])
    nothing = F.expr("cast(array() as array<string>)")
    finds = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(nothing)

    def replaced(made: Column) -> Column:
        """The gaps between the finds with the pseudonyms put in."""
        gaps = F.split("text", patterns()[0], -1)
        text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(made, i)["value"], F.lit("")))), "")
        # Separators before an address are found with it, so that each run is tried once.
        own = lambda p: F.when(p["kind"] == "email", F.regexp_replace(p["value"], "^[._%+-]+", "")).otherwise(p["value"])
        valid = F.transform(F.filter(made, lambda p: p["kind"] != "none"), lambda p: F.struct(p["kind"].alias("kind"), own(p).alias("value")))
        return F.struct(F.when(F.size(made) > 0, text).otherwise(F.col("text")).alias("text"), valid.alias("pii"))

    # One row from each, by a generator, which the optimizer doesn't merge with what uses its columns: all is computed once.
    out = let(F.transform(finds, lambda x: pseudonym(x, secret)), replaced)
    empty = F.expr("cast(array() as array<struct<kind:string,value:string>>)")
    rest = [c for c in docs.columns if c not in ("text", "pii")]
    d = docs.select(*[F.col(f"`{c}`") for c in rest], F.explode(F.array(out)).alias("_p"))
    return d.select(*[F.col(f"`{c}`") for c in rest], F.col("_p.text").alias("text"), F.coalesce("_p.pii", empty).alias("pii"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def number_of(kind: str) -> Column:
        return F.size(F.filter("pii", lambda p: p["kind"] == kind)).alias(f"n_{kind}")

    return docs.select("doc_id", "text", F.size("pii").alias("n_pii"), *[number_of(k) for k, _ in KINDS])
