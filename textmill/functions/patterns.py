"""Path globs, ignore rules and search patterns, compiled on the driver to Java regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """The pattern isn't one that the search accepts."""


def glob_to_regex(glob: str) -> str:
    """An anchored expression for a path glob: * and ? stop at a slash, ** as a whole component crosses it, {a,b} and [a-z] work, a backslash is itself."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            n = len(glob) - len(glob[i:].lstrip("*")) - i
            if n >= 2 and (i == 0 or glob[i - 1] == "/") and glob[i + n : i + n + 1] == "/":
                out += "(?:[^/]+/)*"
                i += n + 1
                continue
            crosses = n == 2 and (i == 0 or glob[i - 1] == "/") and i + n == len(glob)  # beside other characters ** is two *
            out += ".*" if crosses else "[^/]*"
            i += n
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise PatternError(f"unclosed class in glob: {glob}")
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            out += "[" + ("^/" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:]) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise PatternError(f"unclosed group in glob: {glob}")
    return f"^{out}$"


def glob_matches(path: Column, glob: str) -> Column:
    return path.rlike("(?s)" + glob_to_regex(glob))


def literal_prefix(glob: str) -> str:
    """The directories that a glob names in full; a filter on them reaches the scan."""
    fixed = re.split(r"[*?\[{]", glob)[0]
    return fixed[: fixed.rfind("/") + 1]


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules drop a file: the last rule that matches the path or a directory above it decides; ! keeps."""
    out = F.lit(False)
    for line in rules:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.removeprefix("!")
        only_dir, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body = glob_to_regex(rule.lstrip("/"))[1:-1]
        tail = "/.*" if only_dir else "(?:/.*)?"
        out = F.when(path.rlike(f"^{'' if anchored else '(?:.*/)?'}{body}{tail}$"), F.lit(not keep)).otherwise(out)
    return out


#: POSIX classes, which stand in brackets, and Java's names for them. Fixed values.
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


def java_regex(pattern: str) -> str:
    """A search pattern in Java's dialect: named groups, POSIX classes, names of scripts and properties."""

    def posix(m: re.Match) -> str:
        if m[2] not in POSIX and m[2] != "word":
            raise PatternError(f"unknown class [:{m[2]}:]")
        if m[2] == "word":
            return "\\W" if m[1] else "\\w"
        return ("\\P{" if m[1] else "\\p{") + POSIX[m[2]] + "}"

    out = re.sub(r"\[:(\^?)([a-z]+):\]", posix, pattern.replace("(?P<", "(?<"))
    return re.sub(r"\\([pP])\{(\^?)([A-Za-z]{3,})\}", lambda m: "\\" + (m[1] if not m[2] else m[1].swapcase()) + ("{" if m[3] in POSIX.values() or m[3].startswith("Is") else "{Is") + m[3] + "}", out)


def check_java(expression: str) -> None:
    """Raises PatternError for what Java's compiler refuses; without a session the regex library stands in for it."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    try:
        if sc is not None:
            sc._jvm.java.util.regex.Pattern.compile(expression)
        else:
            import regex

            regex.compile(re.sub(r"^\(\?[dUiu]+\)", "", expression).replace(r"\z", r"\Z"))
    except Py4JJavaError as e:
        raise PatternError(str(e.java_exception.getMessage())) from e
    except Exception as e:
        raise PatternError(str(e)) from e


@dataclass(frozen=True)
class Search:
    """A search request. case: smart (insensitive if the pattern has letters and none is upper case), sensitive or insensitive."""

    pattern: str
    fixed: bool = False
    case: str = "smart"

    def __post_init__(self):
        if not self.pattern or "\0" in self.pattern or "\n" in self.pattern:
            raise PatternError("a pattern is one line, not empty and without NUL")
        if self.case not in ("smart", "sensitive", "insensitive"):
            raise PatternError(f"unknown case mode {self.case}")
        if not self.fixed:
            if re.search(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*(?:\\[1-9GZQERXHhVvNk]|(?:[*+?]|\{[0-9,]+\})\+)", self.pattern):
                raise PatternError("look-around, back references and possessive repeats aren't supported")
            check_java(self.regex)

    @property
    def insensitive(self) -> bool:
        if self.case != "smart":
            return self.case == "insensitive"
        literal = self.pattern if self.fixed else re.sub(r"\\.", "", self.pattern)
        return any(c.isalpha() for c in literal) and not any(c.isupper() for c in literal)

    @property
    def regex(self) -> str:
        """For Java: Unicode classes as the search has them, so that \\w and \\b know letters beyond ASCII."""
        body = re.escape(self.pattern) if self.fixed else java_regex(self.pattern)
        # Of line ends only LF is one, so that $ and . don't stop at others within a line.
        flags = ("d" if not self.fixed else "") + ("U" if re.search(r"\\[wWdDsSbB]", body) and not self.fixed else "") + ("iu" if self.insensitive else "")
        return (f"(?{flags})" if flags else "") + body

    def found(self, text: Column) -> Column:
        """Whether a text, or a line, has a match. A literal is left to the scan to filter by."""
        if self.fixed and not self.insensitive:
            return text.contains(self.pattern)
        return text.rlike(self.regex)

    def count(self, line: Column) -> Column:
        return F.regexp_count(line, F.lit(self.regex)).cast("long")
