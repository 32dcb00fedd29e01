"""Queries of problems 1 and 2: percentiles and frequent values of stored flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowloom.common import cut, load, present, utc_day
from flowloom.llm.frequent import frequent_items, vote_sketch
from flowloom.llm.quantiles import build_sketches, exact_in_brackets, merge_sketches, part_sketches, sketch_percentiles

RATIO = 20
MIN_ROWS = 30
SHARE = 1 / 200
PERCENTS = [50, 75, 90, 95, 99]


def host(authority: Column) -> Column:
    """Lower case, without a port of 80 or 443, without a closing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority), r":(80|443)$", ""), r"\.$", "")


def _durations(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    t = load(spark, sf_dir, "flows").filter("duration_micros > 0").select(host(F.col("authority")).alias("authority"), "protocol", "duration_micros", *more)
    return t.filter(present(F.col("authority")) & present(F.col("protocol")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _durations(spark, sf_dir), ["authority", "protocol"]
    guess = sketch_percentiles(build_sketches(rows, keys, "duration_micros", min_rows=MIN_ROWS), keys, [50, 99], blocks=True)
    at = lambda q, c: F.max(F.when(F.col("percent") == q, F.col(c)))
    brackets = guess.groupBy(*keys, "n").agg(at(50, "value_low").alias("low_50"), at(50, "value_high").alias("high_50"), at(99, "value_low").alias("low_99"), at(99, "value_high").alias("high_99"), at(50, "block_low").alias("least_50"), at(99, "block_high").alias("most_99"))
    # by exact counters, so that no pair is ruled out by an estimate
    near = cut(brackets.filter(F.col("most_99") >= RATIO * F.col("least_50")).drop("least_50", "most_99"))
    exact = cut(exact_in_brackets(rows, keys, "duration_micros", near, [50, 99]))
    held = F.col("p_50").isNotNull() & F.col("p_99").isNotNull()
    missed = exact.filter(~held)
    out = exact.filter(held)
    if not missed.isEmpty():
        whole = missed.select(*keys, "n", *[F.lit(v).cast("long").alias(f"{s}_{q}") for q in (50, 99) for s, v in (("low", -(2**63)), ("high", 2**63 - 1))])
        out = out.unionByName(exact_in_brackets(rows, keys, "duration_micros", whole, [50, 99]))
    return out.filter(F.col("p_99") >= RATIO * F.col("p_50")).select(*keys)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of single days, added up, then read at five percentiles."""
    rows = _durations(spark, sf_dir, utc_day(F.unix_micros("pushed_at")).alias("utc_day"))
    daily = part_sketches(rows, ["authority", "protocol", "utc_day"], "duration_micros")
    keys = ["authority", "protocol"]
    return sketch_percentiles(merge_sketches(daily, keys), keys, PERCENTS)


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per percentile: groups, and those whose exact percentile lies between value_low and value_high, by an order of all values."""
    keys, rows = ["authority", "protocol"], _durations(spark, sf_dir)
    told = p1_percentiles(spark, sf_dir).select(*keys, "percent", F.col("n").alias("n_told"), "value_low", "value_high")
    order = Window.partitionBy(*keys).orderBy("duration_micros")
    ranked = rows.groupBy(*keys, "duration_micros").agg(F.count("*").alias("c")).select(*keys, "duration_micros", F.sum("c").over(order).alias("cum"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    exact = ranked.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * q / F.lit(100)), F.col("duration_micros"))).alias(f"p_{q}") for q in PERCENTS])
    each = exact.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(q).alias("percent"), F.col(f"p_{q}").alias("p")) for q in PERCENTS])).alias("x")).select(*keys, "n", "x.*")
    held = (F.col("n_told") == F.col("n")) & F.col("p").between(F.col("value_low"), F.col("value_high"))
    return each.join(told, [*keys, "percent"], "full").groupBy("percent").agg(F.count("*").alias("n_groups"), F.count_if(held).alias("n_held"))


FIELDS = ["authority", "ja4", "user_agent"]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "flows").select(host(F.col("authority")).alias("authority"), F.trim("ja4").alias("ja4"), F.trim("user_agent").alias("user_agent"))


def p2_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(vote_sketch(_values(spark, sf_dir), FIELDS), FIELDS, SHARE)


def p2_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that make up the share, by exact counts, with whether the sketch names them and its bounds hold them."""
    rows_of = _values(spark, sf_dir)
    told = frequent_items(vote_sketch(rows_of, FIELDS), FIELDS, SHARE)
    each = rows_of.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item_value")) for f in FIELDS])).alias("x")).select("x.*").filter(present(F.col("item_value")))
    counts = each.groupBy("field_name", "item_value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("field_name").agg(F.sum("n").alias("n_all"))
    exact = counts.join(F.broadcast(totals), "field_name")
    both = exact.join(told, ["field_name", "item_value"], "left")
    held = F.coalesce(F.col("n").between(F.col("n_low"), F.col("n_high")) & (F.col("n_rows") == F.col("n_all")), F.lit(False))
    return both.filter((F.col("n") * 200 >= F.col("n_all")) | F.col("n_low").isNotNull()).groupBy("field_name").agg(F.count_if(F.col("n") * 200 >= F.col("n_all")).alias("n_frequent"), F.count_if((F.col("n") * 200 >= F.col("n_all")) & held).alias("n_held"), F.count_if(F.col("n_low").isNotNull() & ~held).alias("n_wrong"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, sf_dir)
    guess = frequent_items(vote_sketch(rows, FIELDS), FIELDS, SHARE)
    # at most depth * width candidates a field, each of a value's length
    told = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item_value")) for f in FIELDS])).alias("x")).select("x.*")
    counts = told.join(F.broadcast(guess.select("field_name", "item_value", "n_rows")), ["field_name", "item_value"]).groupBy("field_name", "item_value", "n_rows").agg(F.count("*").alias("c"))
    return counts.filter(F.col("c") * 200 >= F.col("n_rows")).select("field_name", "item_value")


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p1_bounds, p2_found, p2_frequent, p2_bounds)}

_HOST = r"regexp_replace(regexp_replace(lower(authority), ':(80|443)$', ''), '\.$', '')"

SQL = {
    "p1_found": f"""
WITH rows AS (SELECT {_HOST} AS authority, protocol, duration_micros AS d FROM flows WHERE duration_micros > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY authority, protocol ORDER BY d) AS rn, count(*) OVER (PARTITION BY authority, protocol) AS n FROM rows WHERE authority <> '' AND protocol <> '')
SELECT authority, protocol FROM ranked WHERE n >= 30 GROUP BY authority, protocol, n
HAVING max(CASE WHEN rn = (n * 99 + 99) // 100 THEN d END) >= 20 * max(CASE WHEN rn = (n * 50 + 99) // 100 THEN d END)""",
    "p2_found": f"""
WITH v AS (SELECT 'authority' AS field_name, {_HOST} AS item_value FROM flows UNION ALL SELECT 'ja4', trim(ja4) FROM flows UNION ALL SELECT 'user_agent', trim(user_agent) FROM flows),
c AS (SELECT field_name, item_value, count(*) AS c FROM v WHERE item_value <> '' GROUP BY ALL)
SELECT field_name, item_value FROM c QUALIFY c * 200 >= sum(c) OVER (PARTITION BY field_name)""",
    "p1_bounds": f"""
WITH g AS (SELECT {_HOST} AS authority, protocol FROM flows WHERE duration_micros > 0),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT authority, protocol FROM g WHERE authority <> '' AND protocol <> ''))
SELECT q.percent, n AS n_groups, n AS n_held FROM n, (VALUES (50), (75), (90), (95), (99)) AS q(percent)""",
    "p2_bounds": f"""
WITH v AS (SELECT 'authority' AS field_name, {_HOST} AS item_value FROM flows UNION ALL SELECT 'ja4', trim(ja4) FROM flows UNION ALL SELECT 'user_agent', trim(user_agent) FROM flows),
c AS (SELECT field_name, item_value, count(*) AS c FROM v WHERE item_value <> '' GROUP BY ALL),
f AS (SELECT *, c * 200 >= sum(c) OVER (PARTITION BY field_name) AS often FROM c)
SELECT field_name, count(*) FILTER (WHERE often) AS n_frequent, count(*) FILTER (WHERE often) AS n_held, 0 AS n_wrong FROM f GROUP BY field_name""",
}
