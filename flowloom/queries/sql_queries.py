"""The relational surface: the same text runs here and in the checking engine unless noted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.common import load
from flowloom.plans.sqlgate import SqlGate, SqlRefused

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "flows", "sessions", "groups", "analyses", "deleted_records", "session_metadata", "metadata_keys", "flow_headers")


def gate(spark: SparkSession, sf_dir: str) -> SqlGate:
    return SqlGate(spark, {t: (lambda s, t=t: load(s, sf_dir, t)) for t in TABLES})


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: gate(spark, sf_dir).dataframe(sql)


_D = "CAST({} AS DECIMAL(18,2))"
_BOTH = {
    "J_project_filter": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size FROM orders WHERE o_orderpriority LIKE '1-%' AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderstatus IN ('O', 'F')",
    "J_inner_join": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "J_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "J_right_join": "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "J_full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k",
    "J_cross_small": "SELECT r_name, t.x FROM region CROSS JOIN (SELECT 1 AS x UNION ALL SELECT 2) t",
    "J_using_natural": "SELECT n_name, n FROM nation JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1) c USING (n_nationkey)",
    "J_theta_join": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "J_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "J_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "J_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "J_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority LIKE '1-%')",
    "J_correlated_scalar": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)",
    "J_aggregates": f"SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, {_D.format('sum(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag",
    "J_filter_clause": "SELECT method, count(*) FILTER (WHERE status >= 400) AS errors, count(*) AS n FROM flows GROUP BY method",
    "J_group_ordinal_having": "SELECT authority, count(*) AS n FROM flows WHERE authority <> '' GROUP BY 1 HAVING count(*) > 20",
    "J_rollup": "SELECT protocol, method, count(*) AS n FROM flows GROUP BY ROLLUP (protocol, method)",
    "J_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "J_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "J_window_ranking": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    "J_window_distribution": "SELECT c_custkey, ntile(7) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS tile, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS cd FROM customer",
    "J_window_offset": "SELECT event_id, lag(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "J_window_frames": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events",
    "J_order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 25 OFFSET 10",
    "J_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "J_union_all": "SELECT 'c' AS t, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier",
    "J_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "J_except": "SELECT id FROM flows EXCEPT SELECT record_id FROM deleted_records WHERE record_table = 'flows'",
    "J_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big, top WHERE n >= m - 2",
    "J_recursive_cte": "WITH RECURSIVE c(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM c WHERE n < 20) SELECT n, f FROM c",
    "J_strings": "SELECT id, length(label) AS n, upper(label) AS u, lower(label) AS l, substr(label, 2, 5) AS s, replace(label, 'a', '@') AS r, trim(session_group) AS t, instr(label, 'run') AS i, concat(label, '!') AS c FROM sessions",
    "J_math": "SELECT o_orderkey, abs(o_custkey - 500) AS d, o_orderkey % 7 AS m, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, round(o_totalprice, 1) AS r, CAST(sign(o_custkey - 500) AS INTEGER) AS s FROM orders",
    "J_nulls_order": "SELECT frame_number, id FROM flows WHERE id <> '' ORDER BY frame_number ASC NULLS FIRST, id, pushed_at, content_type LIMIT 50",
    "J_total": "SELECT protocol, coalesce(sum(request_bytes), 0) AS total FROM flows GROUP BY protocol",
    "J_latency_bands": "SELECT protocol, CASE WHEN duration_micros <= 0 THEN 'none' WHEN duration_micros < 10000 THEN 'fast' WHEN duration_micros < 1000000 THEN 'usual' ELSE 'slow' END AS band, count(*) AS n FROM flows GROUP BY 1, 2",
}
_PAIRS = {  # (here, there)
    "J_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "J_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "J_dates": ("SELECT id, date_format(timestamp_millis(created_at), 'yyyy-MM-dd HH:mm') AS d, hour(timestamp_millis(created_at)) AS h FROM sessions", "SELECT id, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d %H:%M') AS d, CAST(hour(make_timestamp(created_at * 1000)) AS INTEGER) AS h FROM sessions"),
    "J_integer_division": ("SELECT o_orderkey, o_custkey DIV 7 AS q FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q FROM orders"),
    "J_regexp": ("SELECT id FROM flows WHERE path RLIKE '^/[a-m]' GROUP BY id", "SELECT DISTINCT id FROM flows WHERE regexp_matches(path, '^/[a-m]')"),
    "J_count_if": ("SELECT authority, count_if(status >= 400) AS errors FROM flows GROUP BY authority", "SELECT authority, count(*) FILTER (WHERE status >= 400) AS errors FROM flows GROUP BY authority"),
    "J_time_buckets": ("SELECT CAST(unix_micros(window(CAST(ts AS TIMESTAMP), '1 day').start) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", "SELECT epoch_us(date_trunc('day', ts)) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "J_group_names": (
        "WITH RECURSIVE t(id, depth) AS (SELECT id, 0 FROM (SELECT DISTINCT id, parent_id FROM groups) WHERE coalesce(parent_id, '') = '' UNION ALL SELECT g.id, t.depth + 1 FROM (SELECT DISTINCT id, parent_id FROM groups) g JOIN t ON g.parent_id = t.id WHERE t.depth < 6) SELECT depth, count(*) AS n FROM t GROUP BY depth",
        "WITH RECURSIVE t(id, depth) AS (SELECT id, 0 FROM (SELECT DISTINCT id, parent_id FROM groups) WHERE coalesce(parent_id, '') = '' UNION ALL SELECT g.id, t.depth + 1 FROM (SELECT DISTINCT id, parent_id FROM groups) g JOIN t ON g.parent_id = t.id WHERE t.depth < 6) SELECT depth, count(*) AS n FROM t GROUP BY depth",
    ),
    "J_glob": ("SELECT id, path FROM flows WHERE path GLOB '/[a-m]*s?*' GROUP BY id, path", "SELECT DISTINCT id, path FROM flows WHERE path GLOB '/[a-m]*s?*'"),
    "J_arrays": ("SELECT n_regionkey, cardinality(array_agg(n_name)) AS n, array_join(sort_array(array_agg(n_name)), '|') AS names, array_contains(array_agg(n_name), 'CHINA') AS has FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(len(list(n_name)) AS INTEGER) AS n, array_to_string(list_sort(list(n_name)), '|') AS names, list_contains(list(n_name), 'CHINA') AS has FROM nation GROUP BY n_regionkey"),
    "J_maps": ("SELECT event_id, map_from_entries(array(named_struct('k', event_type, 'v', user_id)))[event_type] AS u, element_at(map('a', 1, 'b', 2), 'b') AS b FROM events", "SELECT event_id, map([event_type], [user_id])[event_type] AS u, 2 AS b FROM events"),
    "J_json_rows": ("SELECT to_json(named_struct('k', r_regionkey, 'n', r_name)) AS j FROM region", "SELECT '{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}' AS j FROM region"),
}

QUERIES = {k: _run(v) for k, v in _BOTH.items()} | {k: _run(v[0]) for k, v in _PAIRS.items()}
SQL = dict(_BOTH) | {k: v[1] for k, v in _PAIRS.items()}


def J_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(spark, sf_dir).dataframe("SELECT id, status FROM flows WHERE status = ? AND method = ?", ["200", "GET"])


SQL["J_params"] = "SELECT id, status FROM flows WHERE status = 200 AND method = 'GET'"

_REFUSED = ["DELETE FROM flows", "INSERT INTO flows SELECT * FROM flows", "DROP TABLE flows", "CREATE TABLE x AS SELECT 1 AS a", "SELECT * FROM parquet.`/etc`", "SELECT * FROM elsewhere", "SET a=1", "SHOW TABLES", "", "SELECT 1 AS a", "WITH x AS (SELECT id FROM flows) SELECT count(*) AS n FROM x", "SELECT (SELECT max(x) FROM secret) AS m FROM flows"]


def J_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gate(spark, sf_dir)

    def refused(sql: str) -> bool:
        try:
            g.dataframe(sql)
        except SqlRefused:
            return True
        return False

    return spark.createDataFrame([(s, refused(s)) for s in _REFUSED], "statement string, refused boolean")


SQL["J_read_only"] = "SELECT * FROM (VALUES " + ", ".join("('" + s.replace("'", "''") + f"', {str(s not in _REFUSED[9:11]).lower()})" for s in _REFUSED) + ") AS t(statement, refused)"


def J_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = gate(spark, sf_dir).query("SELECT id FROM flows ORDER BY id", limit=7)
    return spark.createDataFrame([(len(r.rows), r.truncated, ",".join(r.columns))], "n int, truncated boolean, columns string")


SQL["J_budget"] = "SELECT 7 AS n, true AS truncated, 'id' AS columns"
QUERIES |= {"J_params": J_params, "J_read_only": J_read_only, "J_budget": J_budget}
