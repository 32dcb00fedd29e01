"""Queries of problems 3 to 5: references, wide tables, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.common import load, present, utc_day
from flowloom.operators.hierarchy import descendants, resolve_hierarchy
from flowloom.operators.references import MATCHES, orphan_references
from flowloom.operators.wide import cells, discover_attributes, infer_attributes, widen


def _fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = load(spark, sf_dir, "flows")
    gone = load(spark, sf_dir, "deleted_records").select("record_table", "record_id", F.unix_micros("deleted_at").alias("deleted"))

    def refs(name: str, column: str) -> DataFrame:
        t = load(spark, sf_dir, name)
        day = F.floor(F.unix_micros(t["pushed_at"]) / F.lit(86_400_000_000)) * F.lit(86_400_000_000)
        return t.filter(present(t[column])).select(F.lit(name).alias("child_table"), t[column].alias("ref_id"), day.alias("day_at")).distinct()

    def fates(children: DataFrame, record_table: str, parents: DataFrame) -> DataFrame:
        return orphan_references(
            children, ["ref_id"], parents, ["id"], at="day_at", arrived="arrived",
            deletions=gone.filter(F.col("record_table") == record_table), deleted_keys=["record_id"], deleted_at="deleted",
        )

    to_flows = fates(refs("flow_headers", "flow_id").unionByName(refs("flow_client_hellos", "flow_id")), "flows", flows.select("id", F.unix_micros("pushed_at").alias("arrived")))
    to_analyses = fates(refs("flows", "analysis_id"), "analyses", load(spark, sf_dir, "analyses").select("id", (F.col("created_at") * 1000).alias("arrived")))
    return to_flows.unionByName(to_analyses).select("child_table", "ref_id", utc_day(F.col("day_at")).alias("utc_day"), "fate")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fates(spark, sf_dir)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fates(spark, sf_dir).groupBy("child_table", "utc_day", "fate").agg(F.count("*").alias("n_refs"))


def p3_partial_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, analysis_id) of flows against analyses, where either may be absent: partial match."""
    refs = load(spark, sf_dir, "flows").select("session_id", "analysis_id").distinct()
    return orphan_references(refs, ["session_id", "analysis_id"], load(spark, sf_dir, "analyses"), ["session_id", "id"], match="partial").select("session_id", "analysis_id", "null_mask", "fate")


def p3_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, analysis_id) of flows per day against analyses, with deletions and lateness, under all three match semantics."""
    f, analyses = load(spark, sf_dir, "flows"), load(spark, sf_dir, "analyses").select("session_id", "id", (F.col("created_at") * 1000).alias("arrived"))
    day = F.floor(F.unix_micros("pushed_at") / F.lit(86_400_000_000)) * F.lit(86_400_000_000)
    refs = f.select("session_id", "analysis_id", day.alias("day_at")).distinct()
    gone = load(spark, sf_dir, "deleted_records").filter("record_table = 'analyses'").select(F.col("record_id").alias("id"), F.unix_micros("deleted_at").alias("deleted"))
    gone = gone.join(analyses.select("id", "session_id").distinct(), "id")
    out = None
    for match in MATCHES:
        one = orphan_references(refs, ["session_id", "analysis_id"], analyses, ["session_id", "id"], match=match, at="day_at", arrived="arrived", deletions=gone, deleted_keys=["session_id", "id"], deleted_at="deleted")
        one = one.groupBy(F.lit(match).alias("match"), "null_mask", utc_day(F.col("day_at")).alias("utc_day"), "fate").agg(F.count("*").alias("n_refs"))
        out = one if out is None else out.unionByName(one)
    return out


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    attributes = discover_attributes(load(spark, sf_dir, "metadata_keys"))
    return widen(load(spark, sf_dir, "session_metadata"), attributes, entity="session_id", key="key", value="value", order="merged_at"), attributes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, attributes = _wide(spark, sf_dir)
    return cells(wide, attributes, "session_id")


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)[0]


def p4_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes that the rows themselves show, without the list, as entity counts of the wide table they give."""
    rows = load(spark, sf_dir, "session_metadata")
    attributes = infer_attributes(rows, "key", "value")
    wide = cells(widen(rows, [(a, "text") for a, _ in attributes], entity="session_id", key="key", value="value", order="merged_at"), [(a, "text") for a, _ in attributes], "session_id")
    return wide.groupBy("attr_name").agg(F.count("*").alias("n_cells"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_hierarchy(load(spark, sf_dir, "groups")).select(F.col("id").alias("group_id"), F.col("state").alias("tree_state"), F.col("root").alias("root_id"), F.col("depth").alias("depth_no"), "n_below", F.col("path").alias("id_path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(load(spark, sf_dir, "groups"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_partial_keys, p3_composite, p4_found, p4_wide, p4_inferred, p5_found, p5_descendants)}

_FATES = """
refs AS (
  SELECT DISTINCT 'flow_headers' AS child_table, flow_id AS ref_id, strftime(pushed_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS utc_day, 'flows' AS record_table FROM flow_headers WHERE flow_id <> ''
  UNION ALL
  SELECT DISTINCT 'flow_client_hellos', flow_id, strftime(pushed_at AT TIME ZONE 'UTC', '%Y-%m-%d'), 'flows' FROM flow_client_hellos WHERE flow_id <> ''
  UNION ALL
  SELECT DISTINCT 'flows', analysis_id, strftime(pushed_at AT TIME ZONE 'UTC', '%Y-%m-%d'), 'analyses' FROM flows WHERE analysis_id <> ''),
records AS (
  SELECT 'flows' AS record_table, id, min(epoch_us(pushed_at)) AS first_at, max(epoch_us(pushed_at)) AS last_at FROM flows GROUP BY id
  UNION ALL
  SELECT 'analyses', id, min(created_at * 1000), max(created_at * 1000) FROM analyses GROUP BY id),
gone AS (SELECT record_table, record_id, max(epoch_us(deleted_at)) AS gone_at FROM deleted_records GROUP BY ALL),
fates AS (
  SELECT child_table, ref_id, utc_day,
    CASE WHEN gone_at IS NOT NULL AND NOT coalesce(last_at > gone_at, false) THEN 'deleted'
         WHEN r.id IS NULL THEN 'missing'
         WHEN strftime(make_timestamp(first_at), '%Y-%m-%d') > utc_day THEN 'late' END AS fate
  FROM refs LEFT JOIN records r ON r.record_table = refs.record_table AND r.id = ref_id
  LEFT JOIN gone g ON g.record_table = refs.record_table AND g.record_id = ref_id)
"""

_TREE = """
last AS (SELECT id, arg_max(parent_id, updated_at) AS parent_id FROM (SELECT id, coalesce(parent_id, '') AS parent_id, updated_at FROM groups WHERE id <> '') GROUP BY id),
links AS (SELECT l.id, p.id AS parent FROM last l LEFT JOIN last p ON p.id = l.parent_id),
above(id, anc) AS (SELECT id, parent FROM links WHERE parent IS NOT NULL UNION SELECT a.id, l.parent FROM above a JOIN links l ON l.id = a.anc WHERE l.parent IS NOT NULL),
cyc AS (SELECT id FROM above WHERE id = anc),
below AS (SELECT DISTINCT a.id FROM above a JOIN cyc ON cyc.id = a.anc),
paths(id, root, depth, path) AS (
  SELECT id, id, 0, id FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, p.root, p.depth + 1, p.path || '/' || l.id FROM links l JOIN paths p ON p.id = l.parent)
"""

SQL = {
    "p3_found": f"WITH {_FATES} SELECT * FROM fates WHERE fate IS NOT NULL",
    "p3_report": f"WITH {_FATES} SELECT child_table, utc_day, fate, count(*) AS n_refs FROM fates WHERE fate IS NOT NULL GROUP BY ALL",
    "p3_partial_keys": """
WITH refs AS (SELECT DISTINCT session_id, analysis_id, CASE WHEN coalesce(session_id, '') = '' THEN '1' ELSE '0' END || CASE WHEN coalesce(analysis_id, '') = '' THEN '1' ELSE '0' END AS null_mask FROM flows)
SELECT session_id, analysis_id, null_mask, 'missing' AS fate FROM refs
WHERE null_mask <> '11' AND NOT EXISTS (SELECT 1 FROM analyses a WHERE (null_mask[1] = '1' OR a.session_id = refs.session_id) AND (null_mask[2] = '1' OR a.id = refs.analysis_id))
""",
    "p3_composite": """
WITH refs AS (SELECT DISTINCT session_id, analysis_id, strftime(pushed_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS utc_day, CASE WHEN coalesce(session_id, '') = '' THEN '1' ELSE '0' END || CASE WHEN coalesce(analysis_id, '') = '' THEN '1' ELSE '0' END AS null_mask FROM flows),
rec AS (SELECT session_id, id, min(created_at * 1000) AS first_at, max(created_at * 1000) AS last_at FROM analyses GROUP BY ALL),
gone AS (SELECT record_id AS id, max(epoch_us(deleted_at)) AS gone_at FROM deleted_records WHERE record_table = 'analyses' GROUP BY ALL),
one AS (SELECT rec.*, gone_at IS NOT NULL AND NOT coalesce(last_at > gone_at, false) AS dead FROM rec LEFT JOIN gone USING (id)),
told AS (SELECT refs.session_id, refs.analysis_id, utc_day, null_mask, min(first_at) AS first_at, count(one.id) AS n, coalesce(bool_or(dead), false) AS dead, coalesce(bool_or(NOT dead), false) AS alive
  FROM refs LEFT JOIN one ON (null_mask[1] = '1' OR one.session_id = refs.session_id) AND (null_mask[2] = '1' OR one.id = refs.analysis_id) WHERE null_mask <> '11' GROUP BY ALL),
fates AS (SELECT *, CASE WHEN dead AND NOT alive THEN 'deleted' WHEN n = 0 THEN 'missing' WHEN strftime(make_timestamp(first_at), '%Y-%m-%d') > utc_day THEN 'late' END AS fate FROM told),
every AS (SELECT 'simple' AS match, null_mask, utc_day, fate FROM fates WHERE null_mask = '00' UNION ALL SELECT 'partial', null_mask, utc_day, fate FROM fates UNION ALL SELECT 'full', null_mask, utc_day, fate FROM fates WHERE null_mask = '00' UNION ALL SELECT 'full', null_mask, utc_day, 'partly_null' FROM fates WHERE null_mask <> '00')
SELECT match, null_mask, utc_day, fate, count(*) AS n_refs FROM every WHERE fate IS NOT NULL GROUP BY ALL""",
    "p5_found": f"""WITH RECURSIVE {_TREE}
SELECT l.id AS group_id, CASE WHEN p.id IS NOT NULL THEN 'rooted' WHEN l.id IN (SELECT id FROM cyc) THEN 'on_cycle' ELSE 'below_cycle' END AS tree_state,
  coalesce(p.root, '') AS root_id, coalesce(p.depth, -1)::INTEGER AS depth_no,
  CASE WHEN p.id IS NULL THEN -1 ELSE coalesce((SELECT count(*) FROM above a WHERE a.anc = l.id), 0) END::INTEGER AS n_below, coalesce(p.path, '') AS id_path
FROM links l LEFT JOIN paths p ON p.id = l.id""",
    "p5_descendants": f"""WITH RECURSIVE {_TREE}
SELECT a.anc AS ancestor, a.id AS descendant, (p.depth - q.depth)::INTEGER AS distance FROM above a JOIN paths p ON p.id = a.id JOIN paths q ON q.id = a.anc""",
}

_NUM = r"^[+-]?([0-9]+([,_][0-9]+)*(\.([0-9]+([,_][0-9]+)*)?)?|\.[0-9]+([,_][0-9]+)*)([eE][+-]?[0-9]+)?$"
SQL["p4_found"] = rf"""
WITH attrs AS (SELECT attr_name, value_type, regexp_replace(lower(trim(attr_name)), '[._\- ]', '', 'g') AS k FROM metadata_keys),
ranked AS (
  SELECT session_id, attr_name, value_type, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v,
    row_number() OVER (PARTITION BY session_id, attr_name ORDER BY merged_at DESC NULLS LAST, v DESC NULLS LAST) AS rn
  FROM session_metadata JOIN attrs ON regexp_replace(lower(regexp_replace(key, '^\s+|\s+$', '', 'g')), '[._\- ]', '', 'g') = k WHERE session_id <> ''),
cells AS (
  SELECT session_id, attr_name, value_type, v, CASE WHEN regexp_full_match(v, '{_NUM}') THEN TRY_CAST(regexp_replace(v, '[,_]', '', 'g') AS DECIMAL(38,12)) END AS num FROM ranked WHERE rn = 1),
typed AS (
  SELECT session_id, attr_name, CASE value_type
    WHEN 'text' THEN nullif(v, '')
    WHEN 'integer' THEN CASE WHEN num = floor(num) THEN CAST(CAST(num AS DECIMAL(38,0)) AS VARCHAR) END
    WHEN 'decimal' THEN CAST(CAST(num AS DECIMAL(38,3)) AS VARCHAR)
    WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true','t','yes','y','on','1') THEN 'true' WHEN lower(v) IN ('false','f','no','n','off','0') THEN 'false' END
    WHEN 'timestamp' THEN CASE WHEN regexp_full_match(v, '[0-9]{{1,18}}') THEN CAST(CAST(v AS BIGINT) * CASE WHEN CAST(v AS BIGINT) < 100000000000 THEN 1000000 WHEN CAST(v AS BIGINT) < 100000000000000 THEN 1000 ELSE 1 END AS VARCHAR)
      ELSE CAST(epoch_us(TRY_CAST(CASE WHEN regexp_matches(v, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN v ELSE v || 'Z' END AS TIMESTAMPTZ)) AS VARCHAR) END END AS typed_value FROM cells)
SELECT * FROM typed WHERE typed_value IS NOT NULL"""

SQL["p4_inferred"] = r"""
WITH c AS (SELECT session_id, regexp_replace(key, '^\s+|\s+$', '', 'g') AS name, regexp_replace(lower(regexp_replace(key, '^\s+|\s+$', '', 'g')), '[._\- ]', '', 'g') AS k, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v, merged_at FROM session_metadata),
names AS (SELECT k, name FROM (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, name) AS rn FROM c WHERE k <> '' GROUP BY k, name) WHERE rn = 1),
last AS (SELECT session_id, k, v FROM (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY merged_at DESC NULLS LAST, v DESC NULLS LAST) AS rn FROM c WHERE session_id <> '' AND k <> '') WHERE rn = 1)
SELECT name AS attr_name, count(*) AS n_cells FROM last JOIN names USING (k) WHERE v <> '' GROUP BY name"""
