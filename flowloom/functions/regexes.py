"""Linear-time regular expressions on Java's engine: checked, then translated.

Patterns are those of the RE2 family, matched without regard to case. What that family lacks
(lookaround, backreferences, possessive quantifiers, atomic groups) is refused by name; what Java reads
differently is rewritten, so a pattern never means something else silently.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive, Unicode folding, only \n ends a line for '.'.
FLAGS = "(?iud)"

_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}",
    "space": r"\t\n\x0B\f\r ", "blank": r"\t ", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}", "word": r"\w", "ascii": r"\x00-\x7F",
}
_REFUSED_GROUPS = (("(?=", "lookahead"), ("(?!", "negative lookahead"), ("(?<=", "lookbehind"), ("(?<!", "negative lookbehind"), ("(?>", "atomic group"))


class PatternError(ValueError):
    """A pattern outside the supported family."""


def translate(pattern: str) -> str:
    """The Java pattern of the same meaning, with FLAGS; PatternError where there is none."""
    out, i, n = [], 0, len(pattern)
    in_class = class_start = False
    quantified = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("trailing backslash")
            e = pattern[i + 1]
            if e == "Q" and not in_class:
                end = pattern.find("\\E", i + 2)
                text = pattern[i + 2 : end if end >= 0 else n]
                out.append("".join("\\" + x if not x.isalnum() and x.isascii() else x for x in text))
                i = (end + 2) if end >= 0 else n
                quantified = class_start = False
                continue
            if e.isdigit() and e != "0":
                raise PatternError(f"backreference \\{e} is not supported")
            if e == "k":
                raise PatternError("named backreference is not supported")
            if e in "GRXhHZCVNoce":
                raise PatternError(f"\\{e} is not supported")
            text = {"s": "\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]", "S": "[^\\t\\n\\f\\r ]", "v": "\\x0B"}.get(e, "\\" + e)
            out.append(text)
            i += 2
            quantified = class_start = False
            continue
        if in_class:
            if c == "[":
                m = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
                if m:
                    if m.group(2) not in _POSIX:
                        raise PatternError(f"unknown character class [:{m.group(2)}:]")
                    out.append(f"[^{_POSIX[m.group(2)]}]" if m.group(1) else _POSIX[m.group(2)])
                    i += m.end()
                    class_start = False
                    continue
                out.append("\\[")
            elif c == "]" and not class_start:
                in_class = False
                out.append(c)
            elif c == "]" or c == "&":
                out.append("\\" + c)
            else:
                out.append(c)
            class_start = class_start and c == "^"
            i += 1
            quantified = False
            continue
        if c == "[":
            in_class = class_start = True
            out.append(c)
        elif c == "$":
            out.append("\\z")
        elif c == "(":
            for mark, name in _REFUSED_GROUPS:
                if pattern.startswith(mark, i):
                    raise PatternError(f"{name} {mark}...) is not supported")
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
            out.append(c)
        elif c in "*+?" or (c == "{" and re.match(r"\{\d+(,\d*)?\}", pattern[i:])):
            if quantified and c == "+":
                raise PatternError("possessive quantifiers are not supported")
            if quantified and c != "?":
                raise PatternError("a quantifier follows a quantifier")
            out.append(c if c != "{" else (m := re.match(r"\{\d+(,\d*)?\}", pattern[i:]).group()))
            i += len(m) if c == "{" else 1
            quantified = not quantified
            continue
        else:
            out.append(c)
        quantified = False
        i += 1
    if in_class:
        raise PatternError("missing closing ]")
    text = "".join(out)
    return FLAGS + text


def check(spark, pattern: str) -> str:  # noqa: ANN001
    """Translated pattern, compiled once on the driver so that a bad one fails before any job."""
    text = translate(pattern)
    try:
        spark._jvm.java.util.regex.Pattern.compile(text)
    except Exception as e:
        raise PatternError(f"bad pattern {pattern!r}: {str(getattr(e, 'java_exception', e)).splitlines()[0]}") from None
    return text


def matches(haystack: Column, pattern: str) -> Column:
    """Whether the pattern is found in the haystack; NULL counts as ''. A pattern that is a plain literal is
    searched as such, and one anchored at both ends without letters becomes an equality, which a scan can push down."""
    text = F.coalesce(haystack, F.lit(""))
    m = re.fullmatch(r"\^([0-9 _/:,;%@=-]*)\$", pattern)
    if m and m.group(1):
        return F.coalesce(haystack == m.group(1), F.lit(False))
    return text.rlike(translate(pattern))
