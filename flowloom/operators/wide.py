"""Attribute-value rows into wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.common import free_name

MAX_ATTRIBUTES = 2000

TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

_NUMBER = r"^[+-]?(\d+([,_]\d+)*(\.(\d+([,_]\d+)*)?)?|\.\d+([,_]\d+)*)([eE][+-]?\d+)?$"
_DIGITS = r"^\d{1,18}$"
_STAMP = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s*(Z|z|UTC|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key_form(c: Column) -> Column:
    """The form in which spellings of one key agree: no case, no outer space, none of . _ - and space."""
    return F.regexp_replace(F.lower(strip(c)), r"[._\- ]", "")


def _number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), F.regexp_replace(c, "[,_]", "").try_cast("decimal(38,12)"))


def typed(value: Column, value_type: str, stripped: bool = False) -> Column:
    """value as a column of the type, NULL where it is blank or in no usual notation of it."""
    c = value if stripped else strip(value)
    if value_type == "text":
        return F.when(c != "", c)
    if value_type == "integer":
        n = _number(c)
        return F.when(n == F.floor(n), n).try_cast("decimal(38,0)")
    if value_type == "decimal":
        return _number(c).try_cast("decimal(38,3)")
    if value_type == "boolean":
        low = F.lower(c)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if value_type == "timestamp":
        n = F.when(c.rlike(_DIGITS), c.try_cast("long"))
        scale = F.when(n < 10**11, F.lit(1_000_000)).when(n < 10**14, F.lit(1000)).otherwise(F.lit(1))
        zone = F.regexp_extract(c, _STAMP, 3)
        zone = F.when(zone.isin("", "z", "UTC"), "Z").otherwise(F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})?$", "$1:$2"))
        zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
        clock = F.regexp_extract(c, _STAMP, 2)
        iso = F.concat(F.regexp_extract(c, _STAMP, 1), F.lit("T"), F.when(clock == "", "00:00:00").when(F.length(clock) < 6, F.concat(clock, F.lit(":00"))).otherwise(clock), zone)
        return F.coalesce(F.timestamp_micros(n * scale), F.when(c.rlike(_STAMP), iso.try_cast("timestamp")))
    raise ValueError(f"unknown value type {value_type!r}")


def spelled(c: Column, value_type: str) -> Column:
    """The one spelling of a typed value."""
    return F.unix_micros(c).cast("string") if value_type == "timestamp" else c.cast("string")


def read_back(c: Column, value_type: str) -> Column:
    """The typed value of what spelled() wrote."""
    if value_type == "timestamp":
        return F.timestamp_micros(c.cast("long"))
    return c.cast({"integer": "decimal(38,0)", "decimal": "decimal(38,3)", "boolean": "boolean", "text": "string"}[value_type])


def discover_attributes(keys: DataFrame, name: str = "attr_name", value_type: str = "value_type", limit: int = MAX_ATTRIBUTES) -> list[tuple[str, str]]:
    """(name, type) of every attribute, in order of name. A width of more than ``limit`` columns is an error,
    so the list on the driver is bounded. Names that agree as keys, or have no type, are an error too."""
    rows = keys.filter(keys[name].isNotNull()).select(keys[name].alias("n"), keys[value_type].alias("t"), key_form(keys[name]).alias("k")).distinct().orderBy("n").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} attributes")
    if len({r.k for r in rows}) < len(rows):
        raise ValueError("two attribute names are spellings of one key")
    return [(r.n, r.t) for r in rows]


def infer_attributes(rows: DataFrame, key: str, value: str, *, limit: int = MAX_ATTRIBUTES, share: float = 1.0) -> list[tuple[str, str]]:
    """(name, type) of every key in the data, where no list of attributes is given: spellings of one key are one attribute, named by its
    most frequent spelling without outer space (of equally frequent ones the least); its type is the first of boolean, integer,
    decimal, timestamp that at least ``share`` of its usable values have, else text. Blank keys are none, a key without usable values is
    text. All rows are counted, per key alone; more than ``limit`` keys are an error."""
    k, v = key_form(rows[key]), strip(rows[value])
    some = rows.select(k.alias("k"), strip(rows[key]).alias("name"), v.alias("v")).filter(F.coalesce(F.col("k") != "", F.lit(False)))
    usable = F.col("v") != ""
    tests = {t: F.count_if(usable & typed(F.col("v"), t, stripped=True).isNotNull()).alias(t) for t in ("boolean", "integer", "decimal", "timestamp")}
    named = some.groupBy("k", "name").agg(F.count("*").alias("c"), F.count_if(usable).alias("n"), *tests.values())
    best = F.struct((-F.col("c")).alias("c"), F.col("name").alias("name"))
    told = named.groupBy("k").agg(F.min(best)["name"].alias("name"), *[F.sum(c).alias(c) for c in ("n", *tests)]).orderBy("name").limit(limit + 1).collect()
    if len(told) > limit:
        raise ValueError(f"more than {limit} keys")
    return [(r.name, next((t for t in tests if r.n and r[t] >= share * r.n), "text")) for r in told]


def widen(rows: DataFrame, attributes: list[tuple[str, str]], *, entity: str, key: str, value: str, order: str) -> DataFrame:
    """One row per present entity, one typed column per attribute, in one aggregation.

    The row with the greatest ``order`` alone decides a cell, even if its value is unusable; among
    rows of equal order the greatest value without outer white space does, NULL being least; a NULL order is before all others.
    Unknown keys fill no cell but their entity still gets a row; NULL or '' entities get none.
    Column names of the result are those of the attributes, so one called like ``entity`` in any
    letter case is an error. The aggregation is combined on the map side, so an entity with a large
    part of all rows needs no more memory than any other. An empty table gives no rows.
    """
    if entity.lower() in {a.lower() for a, _ in attributes}:
        raise ValueError(f"an attribute is called like the entity column {entity!r}")
    forms = rows.sparkSession.range(1).select(*[key_form(F.lit(a)).alias(f"f{i}") for i, (a, _) in enumerate(attributes)]).first() if attributes else ()
    v, k = F.col("__v"), F.col("__k")
    kind = {t: [f for f, (_, u) in zip(forms, attributes) if u == t] for t in {t for _, t in attributes}}
    text_of = F.coalesce(*[F.when(k.isin(*fs), spelled(typed(v, t, stripped=True), t)) for t, fs in sorted(kind.items())], F.lit(None).cast("string"))
    src = rows.select(rows[entity].alias("__e"), key_form(rows[key]).alias("__k"), rows[order].alias("__o"), strip(rows[value]).alias("__v")).filter(F.coalesce(F.col("__e").cast("string") != "", F.lit(False)))
    # a key that fills no cell is neither typed nor kept, but for its entity
    src = src.select("__e", F.when(k.isin(list(forms)), k).alias("__k"), F.when(k.isin(list(forms)), F.struct(F.col("__o").alias("o"), v.alias("v"), text_of.alias("t"))).alias("__r"))
    cells = [F.max(F.when(F.col("__k") == forms[i], F.col("__r"))).alias(f"__c{i}") for i in range(len(attributes))]
    wide = src.groupBy("__e").agg(*cells) if cells else src.select("__e").distinct()
    return wide.select(F.col("__e").alias(entity), *[read_back(F.col(f"__c{i}.t"), t).alias(a) for i, (a, t) in enumerate(attributes)])


def cells(wide: DataFrame, attributes: list[tuple[str, str]], entity: str) -> DataFrame:
    """The non-empty cells of a wide table: entity, attr_name, typed_value. Without attributes, none."""
    q = lambda s: "`" + s.replace("`", "``") + "`"
    if not attributes:
        return wide.select(entity, F.lit("").alias("attr_name"), F.lit("").alias("typed_value")).filter(F.lit(False))
    entries = F.array(*[F.struct(F.lit(a).alias("attr_name"), spelled(F.col(q(a)), t).alias("typed_value")) for a, t in attributes])
    held = free_name(wide, "cell")
    return wide.select(F.col(q(entity)), F.explode(F.filter(entries, lambda x: x["typed_value"].isNotNull())).alias(held)).select(F.col(q(entity)), f"{held}.attr_name", f"{held}.typed_value")
