"""The filter language for flows and messages.

An expression is a list of terms that all must hold. ``!`` negates the next term. Terms that need
an argument take the next token, whatever it is; a token that is no term is a pattern on the URL (flows)
or the payload (messages). Unknown ``~x`` tokens are patterns in the flow dialect and errors in the
message dialect. Terms are applied in stages of rising cost (own columns, side tables, headers,
bodies), and a side table is joined only if a term needs it and after the cheaper stages filtered.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.common import text
from flowloom.functions.flows import display_host, has_response, status_text, url
from flowloom.functions.regexes import PatternError, check, matches
from flowloom.plans import side

COLUMNS, ANNOTATIONS, HEADERS, BODIES = range(4)


class FilterError(ValueError):
    """An expression that can't be compiled."""


@dataclass(frozen=True)
class Term:
    name: str
    argument: str = ""
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    """What a term reads. needs: side inputs; build: condition from the argument (patterns are checked before)."""

    cost: int
    build: Callable[[str], Column]
    takes: str = ""  # what the argument is called, '' for flags
    needs: tuple[str, ...] = ()
    pattern: bool = True


def _any(*haystacks: str | Callable[[], Column]) -> Callable[[str], Column]:
    """A pattern on any of the columns (names, or functions that give them)."""

    def build(p: str) -> Column:
        of = [F.col(h) if isinstance(h, str) else h() for h in haystacks]
        out = matches(of[0], p)
        for h in of[1:]:
            out = out | matches(h, p)
        return out

    return build


def _with_display(plain: Column, shown: Column, p: str) -> Column:
    return matches(plain, p) | (F.lower(text(F.col("authority"))).contains("xn--") & matches(shown, p))


def _meta(argument: str) -> Column:
    key, eq, pattern = argument.partition("=")
    if not eq or not pattern:
        return F.coalesce(F.map_contains_key(F.col("metadata"), F.lit(key)), F.lit(False))
    return matches(F.try_element_at(F.col("metadata"), F.lit(key)), pattern)


_SHARED = {
    "~mark": Rule(ANNOTATIONS, _any("mark_color"), "a pattern", ("marks",)),
    "~tag": Rule(ANNOTATIONS, _any("tag_text"), "a pattern", ("tags",)),
    "~group": Rule(ANNOTATIONS, _any("group_text"), "a pattern", ("groups",)),
    "~comment": Rule(ANNOTATIONS, _any("comment_text"), "a pattern", ("comments",)),
    "~fav": Rule(ANNOTATIONS, lambda _: F.coalesce(F.col("favorite"), F.lit(False)), "", ("tags",)),
    "~meta": Rule(ANNOTATIONS, _meta, "a key or key=pattern", ("metadata",), pattern=False),
}

FLOW_RULES: dict[str, Rule] = {
    "~m": Rule(COLUMNS, _any("method"), "a pattern"),
    "~d": Rule(COLUMNS, lambda p: _with_display(F.col("authority"), display_host(F.col("authority")), p), "a pattern"),
    "~u": Rule(COLUMNS, lambda p: _with_display(url(), url(authority=display_host(F.col("authority"))), p), "a pattern"),
    "~c": Rule(COLUMNS, _any(lambda: status_text(F.col("status"))), "a pattern"),
    "~t": Rule(COLUMNS, _any("content_type"), "a pattern"),
    "~conn": Rule(COLUMNS, _any("connection_id"), "a pattern"),
    "~stream": Rule(COLUMNS, _any("stream_id"), "a pattern"),
    "~proto": Rule(COLUMNS, _any("protocol"), "a pattern"),
    "~s": Rule(COLUMNS, lambda _: has_response(F.col("status"))),
    "~q": Rule(COLUMNS, lambda _: ~has_response(F.col("status"))),
    "~h": Rule(HEADERS, _any("request_header_text", "response_header_text"), "a pattern", ("headers",)),
    "~hq": Rule(HEADERS, _any("request_header_text"), "a pattern", ("headers",)),
    "~hs": Rule(HEADERS, _any("response_header_text"), "a pattern", ("headers",)),
    "~b": Rule(BODIES, _any("request_body_text", "response_body_text"), "a pattern", ("request_body", "response_body")),
    "~bq": Rule(BODIES, _any("request_body_text"), "a pattern", ("request_body",)),
    "~bs": Rule(BODIES, _any("response_body_text"), "a pattern", ("response_body",)),
} | _SHARED

MESSAGE_RULES: dict[str, Rule] = {
    "~b": Rule(BODIES, _any("payload_text"), "a pattern", ("payload",)),
    "~op": Rule(COLUMNS, _any("opcode"), "a pattern"),
    "~from": Rule(COLUMNS, lambda p: matches(F.when(F.col("from_client"), "client").otherwise("server"), p), "a pattern"),
} | _SHARED

DIALECTS = {"flow": (FLOW_RULES, "~u"), "message": (MESSAGE_RULES, "~b")}


def parse(expression: str | None, dialect: str = "flow") -> list[Term]:
    """Terms in order; a last ! without a term is dropped; a blank expression has none."""
    rules, bare = DIALECTS[dialect]
    tokens, out, i, negated = (expression or "").split(), [], 0, False
    while i < len(tokens):
        token = tokens[i]
        if token == "!":
            negated, i = not negated, i + 1
            continue
        if token[0] == "!" and len(token) > 1:
            negated, token = not negated, token[1:]
        rule = rules.get(token)
        if rule is None:
            if dialect == "message" and token[0] == "~":
                raise FilterError(f"{token} is no term of the message filter; it has {' '.join(sorted(rules))}")
            out.append(Term(bare, token, negated))
        elif rule.takes:
            if i + 1 >= len(tokens):
                raise FilterError(f"{token} needs {rule.takes} after it")
            i += 1
            out.append(Term(token, tokens[i], negated))
        else:
            out.append(Term(token, "", negated))
        negated, i = False, i + 1
    return out


def validate(spark, terms: list[Term], dialect: str = "flow") -> None:  # noqa: ANN001
    """FilterError for patterns that can't be matched."""
    rules, _ = DIALECTS[dialect]
    for t in terms:
        pattern = t.argument if rules[t.name].pattern else t.argument.partition("=")[2]
        try:
            check(spark, pattern)
        except PatternError as e:
            raise FilterError(f"{t.name} {t.argument}: {e}") from None


def condition(term: Term, dialect: str = "flow") -> Column:
    """The term as a condition that is never NULL."""
    held = F.coalesce(DIALECTS[dialect][0][term.name].build(term.argument), F.lit(False))
    return ~held if term.negated else held


def needs(terms: list[Term], dialect: str = "flow") -> set[str]:
    return {n for t in terms for n in DIALECTS[dialect][0][t.name].needs}


def apply_filter(rows: DataFrame, expression: str | None, tables: side.SideTables | None = None, dialect: str = "flow", *, keep_side: bool = False) -> DataFrame:
    """Rows that hold; only the columns of ``rows`` come back unless ``keep_side``. rows need ``id``."""
    terms = parse(expression, dialect)
    validate(rows.sparkSession, terms, dialect)
    rules, _ = DIALECTS[dialect]
    columns, joined = rows.columns, set()
    for cost in range(BODIES + 1):
        stage = [t for t in terms if rules[t.name].cost == cost]
        wanted = {n for t in stage for n in rules[t.name].needs} - joined
        if wanted:
            rows = side.attach(rows, tables or side.SideTables(), wanted)
            joined |= wanted
        for t in stage:
            rows = rows.filter(condition(t, dialect))
    return rows if keep_side else rows.select(*columns)


def hints(expression: str | None, dialect: str = "flow") -> list[str]:
    """Advice on bare tokens that look like another language's syntax; none where parsing fails."""
    try:
        terms = parse(expression, dialect)
    except FilterError:
        return []
    rules, bare = DIALECTS[dialect]
    plain = [t.argument for t in terms if t.name == bare]
    first: dict[str, str] = {}
    for token in plain:
        if token in ("&", "|", "&&", "||", "and", "or", "AND", "OR"):
            first.setdefault("operator", f"{token!r} is matched as text: terms are joined by a space, all must hold")
        if (token.startswith("(") and "~" in token) or token in ("(", ")"):
            first.setdefault("parenthesis", f"{token!r} is matched as text: terms can't be grouped")
        if re.fullmatch(r"\d{3}", token) and "~c" in rules:
            first.setdefault("status", f"{token} is searched in the URL; ~c {token} asks for the status")
    for t in terms:
        if len(t.argument) > 1 and t.argument[0] in "'\"" and t.argument[-1] == t.argument[0]:
            first.setdefault("quotes", f"the quotes of {t.argument} are part of the pattern")
    return list(first.values())
