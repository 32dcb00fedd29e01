"""Read-only SQL over named views, with row, byte and time budgets.

Statements are parsed before anything runs; only query plans over the allowed view names (and the
statement's own WITH names) pass, which also shuts out path relations, table functions that read and all
commands. Queries run in a session of their own with ANSI mode off, so a malformed cast gives NULL.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, MOST_ROWS, BYTES, SECONDS, MOST_SECONDS = 200, 2000, 1 << 20, 10.0, 60.0

_QUERY_ROOTS = frozenset(
    "Project Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except Filter UnresolvedWith WithWindowDefinition UnresolvedHaving Join SubqueryAlias "
    "UnresolvedInlineTable LocalRelation OneRowRelation Generate Pivot UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedTVFAliases".split()
)
_FORBIDDEN = re.compile(r"(?:^|[\s:+'|-])(InsertInto\w*|Create\w+|Drop\w+|Alter\w+|Delete\w*|Update\w*|Merge\w*|Set\w*Command|\w*Command|ScriptTransformation|ScriptInputOutputSchema|Refresh\w+|Cache\w+|Uncache\w+|Truncate\w+|LoadData)\b")
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_WITH = re.compile(r"(?:CTE|UnresolvedWith) \[([^\]]*)\]")
_FUNCTION = re.compile(r"UnresolvedTableValuedFunction \[([^\]]*)\]")
_CALLS_OUT = re.compile(r"'(reflect|java_method|try_reflect)\(", re.I)
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


_GLOB = re.compile(r"\bGLOB\s+'((?:[^']|'')*)'|'(?:[^']|'')*'", re.I)


def glob_pattern(glob: str) -> str:
    """The regular expression of a GLOB pattern: * any text, ? a character, [...] one of a set, all else itself, letter case included."""
    out = []
    for part in re.findall(r"\*|\?|\[\^?\]?[^\]]*\]|.", glob, re.S):
        if part in "*?":
            out.append(".*" if part == "*" else ".")
        elif len(part) > 1:
            begin = 2 if part[1] == "^" else 1
            out.append("[" + "^" * (begin - 1) + re.sub(r"([\\\[\]&^])", r"\\\1", part[begin:-1]) + "]")
        else:
            out.append(re.escape(part) if not part.isalnum() else part)
    return "(?s)^" + "".join(out) + "$"


def with_globs(sql: str) -> str:
    """The statement with GLOB and a literal as RLIKE; what stands in other literals isn't touched."""
    literal = lambda g: glob_pattern(g.replace("''", "'")).replace("\\", "\\\\").replace("'", "\\'")
    return _GLOB.sub(lambda m: m.group() if m.group(1) is None else f"RLIKE '{literal(m.group(1))}'", sql)


class SqlRefused(ValueError):
    """A statement that may not run."""


class SqlTimeout(TimeoutError):
    """A statement that was stopped at its time budget."""


@dataclass
class SqlResult:
    columns: list[str]
    rows: list[str]
    truncated: bool
    elapsed_ms: int


def inspect(spark: SparkSession, sql: str, allowed: set[str]) -> None:
    """SqlRefused unless the statement is a query over allowed names."""
    if not sql or not sql.strip():
        raise SqlRefused("the statement is empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SqlRefused(str(getattr(e, "java_exception", None) or e).split("\n\n")[0]) from None
    root, tree = plan.getClass().getSimpleName(), plan.treeString()
    if root not in _QUERY_ROOTS or (m := _FORBIDDEN.search(tree)):
        raise SqlRefused(f"only queries are allowed, not {root if root not in _QUERY_ROOTS else m.group(1)}")
    if m := _CALLS_OUT.search(tree):
        raise SqlRefused(f"function {m.group(1)} is not allowed")
    own = {n.strip().strip("`").lower() for m in _WITH.finditer(tree) for n in m.group(1).split(",")}
    for m in _RELATION.finditer(tree):
        parts = [p.strip().strip("`").lower() for p in m.group(1).split(",")]
        if len(parts) > 1 and not parts[-1].startswith(("[", "false", "true")) or parts[0] not in allowed | own:
            raise SqlRefused(f"no view {'.'.join(parts)}; there are {', '.join(sorted(allowed))}")
    for m in _FUNCTION.finditer(tree):
        if m.group(1).split(",")[0].strip().lower() not in _TABLE_FUNCTIONS:
            raise SqlRefused(f"table function {m.group(1)} is not allowed")


class SqlGate:
    """Views by name, each a function of the session that reads it."""

    def __init__(self, spark: SparkSession, views: dict[str, Callable[[SparkSession], DataFrame]]) -> None:
        self.session = spark.newSession()
        for key, value in (("spark.sql.ansi.enabled", "false"), ("spark.sql.session.timeZone", "UTC")):
            self.session.conf.set(key, value)
        self.views = {k.lower() for k in views}
        for name, read in views.items():
            read(self.session).createOrReplaceTempView(name)

    def schema(self) -> list[tuple[str, str, str]]:
        """(view, column, type) of everything that can be queried."""
        return [(v, c, t) for v in sorted(self.views) for c, t in self.session.table(v).dtypes]

    def dataframe(self, sql: str, params: list[str] | None = None) -> DataFrame:
        """The whole result, unbudgeted, as a plan."""
        sql = with_globs(sql or "")
        inspect(self.session, sql, self.views)
        return self.session.sql(sql, args=params) if params else self.session.sql(sql)

    def query(self, sql: str, params: list[str] | None = None, limit: int | None = None, timeout: float | None = None) -> SqlResult:
        """At most ``limit`` rows as JSON objects; truncated if the row, byte or no other budget left rows out."""
        most = min(limit or ROWS, MOST_ROWS)
        df = self.dataframe(sql, params)
        names = df.columns
        renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
        group, sc, began = f"sql-{uuid.uuid4()}", self.session.sparkContext, time.monotonic()
        sc.setJobGroup(group, sql[:80], interruptOnCancel=True)
        budget, done = min(timeout or SECONDS, MOST_SECONDS), threading.Event()

        def watch() -> None:
            late = not done.wait(budget)
            while late and not done.wait(0.1):  # again and again: a statement that is still planned has no job yet
                sc.cancelJobGroup(group)

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            got = renamed.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()
        except Exception as e:
            if time.monotonic() - began >= budget:
                raise SqlTimeout(f"the statement ran longer than {budget} s") from e
            raise
        finally:
            done.set()
            watcher.join()
            sc.setLocalProperty("spark.jobGroup.id", None)
        rows, size = [], 0
        for r in got[:most]:
            values = json.loads(r[0])
            line = json.dumps({n: values[f"c{i}"] for i, n in enumerate(names)}, ensure_ascii=False)
            if size + len(line) > BYTES:
                return SqlResult(names, rows, True, int((time.monotonic() - began) * 1000))
            rows.append(line)
            size += len(line)
        return SqlResult(names, rows, len(got) > most, int((time.monotonic() - began) * 1000))
