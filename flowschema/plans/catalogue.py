"""SQL queries of both dialects over the standard tables: our text, and the same result in ANSI SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import TABLES, register
from ..sql.lower import Keys, run

#: Keys that FINAL and SAMPLE use.
KEYS = {"events": Keys(order_by=["user_id"], version="ts", sample_by="event_id"), "lineitem": Keys(sample_by="l_orderkey")}

FLAGSHIP = """SELECT n.n_name AS nation, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'F' GROUP BY n.n_name HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 10"""

#: name: (dialect, text, ANSI text or None if the text is ANSI already)
QUERIES: dict[str, tuple[str, str, str | None]] = {
    "sql_flagship_join_agg": ("spark", FLAGSHIP, None),
    "sql_filter_project": ("spark", "SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R')", None),
    "sql_distinct": ("spark", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "sql_like_any": ("spark", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE ANY ('%STEEL', '%TIN') AND p_brand NOT LIKE 'Brand#1%'", "SELECT p_partkey, p_type FROM part WHERE (p_type LIKE '%STEEL' OR p_type LIKE '%TIN') AND p_brand NOT LIKE 'Brand#1%'"),
    "sql_rlike": ("spark", "SELECT c_custkey FROM customer WHERE c_name RLIKE '[05]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[05]$')"),
    "sql_null_safe": ("spark", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') <=> NULL AND nullif(o_orderpriority, 'x') IS DISTINCT FROM NULL", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AND nullif(o_orderpriority, 'x') IS DISTINCT FROM NULL"),
    "sql_case_no_end": ("spark", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' AS size FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders"),
    "sql_arithmetic": ("spark", "SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey DIV 7 AS d, o_orderkey & 12 AS b, o_orderkey | 3 AS o, -o_custkey AS neg, o_orderstatus || '-' || o_orderpriority AS s FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, o_orderkey // 7 AS d, o_orderkey & 12 AS b, o_orderkey | 3 AS o, -o_custkey AS neg, o_orderstatus || '-' || o_orderpriority AS s FROM orders"),
    "sql_date_functions": ("spark", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, FLOOR(o_orderdate TO MONTH) AS first FROM orders", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, date_trunc('month', o_orderdate) AS first FROM orders"),
    "sql_interval": ("spark", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 1 MONTH > TIMESTAMP_NTZ '1998-01-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 1 MONTH > TIMESTAMP '1998-01-01 00:00:00'"),
    "sql_string_functions": ("spark", "SELECT c_custkey, SUBSTRING(c_name FROM 1 FOR 4) AS head, TRIM(LEADING 'C' FROM c_name) AS cut, upper(c_mktsegment) AS seg, left(c_name, 3) AS l3 FROM customer", "SELECT c_custkey, substring(c_name, 1, 4) AS head, ltrim(c_name, 'C') AS cut, upper(c_mktsegment) AS seg, left(c_name, 3) AS l3 FROM customer"),
    "sql_in_subquery": ("spark", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "sql_exists_corr": ("spark", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", None),
    "sql_not_exists": ("spark", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "sql_scalar_subquery_corr": ("spark", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(l_extendedprice / l_quantity) FROM lineitem l WHERE l.l_partkey = p.p_partkey)", None),
    "sql_left_join_using": ("spark", "SELECT k, n_orders, segment FROM (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer) a LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY o_custkey) b USING (k)", None),
    "sql_right_join": ("spark", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'", None),
    "sql_full_join": ("spark", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 3", None),
    "sql_cross_join": ("spark", "SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "sql_left_semi": ("spark", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'"),
    "sql_left_anti": ("spark", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "sql_theta_join": ("spark", "SELECT r.r_name, n.n_name FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey", None),
    "sql_nested_join": ("spark", "SELECT n_name, r_name, s_suppkey FROM (nation JOIN region ON n_regionkey = r_regionkey) JOIN supplier ON s_nationkey = n_nationkey", None),
    "sql_group_agg": ("spark", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "sql_rollup": ("spark", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "sql_cube": ("spark", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "sql_grouping_sets": ("spark", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())"),
    "sql_having": ("spark", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15", None),
    "sql_count_distinct": ("spark", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority", None),
    "sql_group_ordinal": ("spark", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2", None),
    "sql_agg_filter": ("spark", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey", None),
    "sql_window_rank": ("spark", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS q FROM orders", None),
    "sql_window_running": ("spark", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m FROM events", None),
    "sql_window_range": ("spark", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS n FROM orders", None),
    "sql_window_lag_lead": ("spark", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events", None),
    "sql_window_named": ("spark", "SELECT event_id, first_value(event_type) OVER w AS f, CAST(row_number() OVER w AS BIGINT) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)", None),
    "sql_window_distribute": ("spark", "SELECT event_id, CAST(dense_rank() OVER (DISTRIBUTE BY user_id SORT BY event_type) AS BIGINT) AS n FROM events", "SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM events"),
    "sql_union": ("spark", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "sql_union_all": ("spark", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "sql_intersect": ("spark", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier", None),
    "sql_minus": ("spark", "SELECT c_custkey AS k FROM customer MINUS SELECT o_custkey FROM orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "sql_except_all": ("spark", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "sql_intersect_all": ("spark", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "sql_cte": ("spark", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM per JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment", None),
    "sql_pivot": ("spark", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(o_orderpriority) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders"),
    "sql_lateral_explode": ("spark", "SELECT doc_id, w, count(*) AS n FROM documents LATERAL VIEW explode(split(text, ' ')) t AS w GROUP BY doc_id, w", "SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY doc_id, w"),
    "sql_lateral_outer": ("spark", "SELECT n_name, x FROM nation LATERAL VIEW OUTER explode(filter(array(n_nationkey, n_regionkey), v -> v > 20)) AS x", "SELECT n_name, CASE WHEN n_nationkey > 20 THEN n_nationkey END AS x FROM nation"),
    "sql_lateral_comma": ("spark", "SELECT n_name, a, b FROM nation LATERAL VIEW explode(array(1, 2)) t1 AS a, LATERAL VIEW explode(array(3, 4)) t2 AS b", "SELECT n_name, a, b FROM nation, (VALUES (1), (2)) x(a), (VALUES (3), (4)) y(b)"),
    "sql_lateral_values": ("spark", "SELECT n_name, name, value FROM nation LATERAL TABLE (VALUES ('one', 1), ('two', 2)) AS numbers (name, value)", "SELECT n_name, name, value FROM nation, (VALUES ('one', 1), ('two', 2)) numbers(name, value)"),
    "sql_limit_offset": ("spark", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10", None),
    "sql_limit_comma": ("spark", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10, 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10"),
    "sql_order_sort": ("spark", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey SORT BY c_custkey LIMIT 15", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 15"),
    "sql_distribute_sort": ("spark", "SELECT o_orderkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_orderkey", "SELECT o_orderkey FROM orders"),
    "sql_from_first": ("spark", "FROM orders SELECT o_orderkey WHERE o_orderstatus = 'P'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "sql_higher_order": ("spark", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS pos, exists(embedding, x -> x > 0.3) AS big FROM embeddings", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS pos, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS big FROM embeddings"),
    "sql_json": ("spark", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "sql_tablesample_bucket": ("spark", " UNION ALL ".join(f"SELECT o_orderkey FROM orders TABLESAMPLE (BUCKET {i} OUT OF 4 ON o_orderkey)" for i in (1, 2, 3, 4)), "SELECT o_orderkey FROM orders"),
    "sql_tablesample_share": ("spark", "SELECT b.n / a.n BETWEEN 0.2 AND 0.3 AS quarter, b.n = c.n AS repeatable FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM orders TABLESAMPLE (BUCKET 2 OUT OF 4 ON o_orderkey)) b, (SELECT count(*) AS n FROM orders TABLESAMPLE (BUCKET 2 OUT OF 4 ON o_orderkey)) c", "SELECT true AS quarter, true AS repeatable"),
    "sql_tablesample_rows": ("spark", "SELECT (SELECT count(*) FROM orders TABLESAMPLE (70 ROWS)) AS n, (SELECT count(*) FROM orders TABLESAMPLE (100 PERCENT)) AS every, (SELECT count(*) FROM orders TABLESAMPLE (50 PERCENT)) BETWEEN 0.4 * (SELECT count(*) FROM orders) AND 0.6 * (SELECT count(*) FROM orders) AS half", "SELECT 70::BIGINT AS n, count(*) AS every, true AS half FROM orders"),
    "sql_is_truth": ("spark", "SELECT count_if(nullif(o_orderstatus, 'F') IS NULL) AS a, count_if(nullif(o_orderstatus, 'F') IS NOT NULL) AS b, count_if((o_totalprice > 100000) IS TRUE) AS c, count_if((o_totalprice > 100000) IS NOT TRUE) AS d, count_if((nullif(o_orderstatus, 'F') = 'O') IS FALSE) AS e, count_if((nullif(o_orderstatus, 'F') = 'O') IS NOT FALSE) AS f FROM orders", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b, count(*) FILTER (WHERE o_totalprice > 100000) AS c, count(*) FILTER (WHERE NOT o_totalprice > 100000) AS d, count(*) FILTER (WHERE o_orderstatus = 'P') AS e, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS f FROM orders"),
    "sql_like_all": ("spark", "SELECT p_partkey FROM part WHERE p_type LIKE ALL ('%A%', '%E%') AND p_name NOT LIKE ALL ('%z%', '%q%')", "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_type LIKE '%E%' AND p_name NOT LIKE '%z%' AND p_name NOT LIKE '%q%'"),
    "sql_multi_alias": ("spark", "SELECT inline(array(named_struct('a', n_nationkey, 'b', n_name), named_struct('a', n_regionkey, 'b', 'region'))) AS (k, v) FROM nation", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_regionkey, 'region' FROM nation"),
    "sql_empty_group": ("spark", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY ()", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders"),
    "sql_pivot_many": ("spark", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice, o_orderkey FROM orders) PIVOT (count(o_orderkey) AS n, max(o_totalprice) AS top FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f_n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f_top, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o_n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o_top FROM orders GROUP BY o_orderpriority"),
    "sql_cluster_by": ("spark", "SELECT o_orderkey, o_custkey FROM orders CLUSTER BY o_custkey", "SELECT o_orderkey, o_custkey FROM orders"),
    "sql_hint": ("spark", "SELECT /*+ SHUFFLE_HASH(n) */ s_suppkey, n_name FROM supplier JOIN nation n ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation n ON s_nationkey = n_nationkey"),
    "sql_lateral_second": ("spark", "SELECT n_name, r_name, x FROM nation JOIN region ON n_regionkey = r_regionkey LATERAL VIEW explode(array(n_nationkey, r_regionkey * 100)) t AS x", "SELECT n_name, r_name, n_nationkey AS x FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, r_name, r_regionkey * 100 FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "sql_bits": ("spark", "SELECT o_orderkey, o_orderkey ^ 21 AS x, ~o_orderkey AS inv FROM orders", "SELECT o_orderkey, xor(o_orderkey, 21) AS x, ~o_orderkey AS inv FROM orders"),
    "sql_cast_nested": ("spark", "SELECT n_nationkey, CAST(array(n_nationkey, n_regionkey) AS ARRAY<STRING>)[1] AS second, CAST(struct(n_name, n_nationkey) AS STRUCT<a: STRING, b: BIGINT>).b AS b, CAST(map(n_name, n_nationkey) AS MAP<STRING, STRING>)[n_name] AS m FROM nation", "SELECT n_nationkey, n_regionkey::VARCHAR AS second, n_nationkey::BIGINT AS b, n_nationkey::VARCHAR AS m FROM nation"),
    "sql_maps": ("spark", "SELECT n_name, size(map_filter(map('a', n_nationkey, 'b', n_regionkey), (k, v) -> v > 2)) AS big, map_keys(map(n_name, 1))[0] AS k, element_at(transform_values(map('x', n_nationkey), (k, v) -> v * 2), 'x') AS twice FROM nation", "SELECT n_name, (n_nationkey > 2)::INT + (n_regionkey > 2)::INT AS big, n_name AS k, n_nationkey * 2 AS twice FROM nation"),
    "sql_window_shares": ("spark", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)"),
    "sql_extract_units": ("spark", "SELECT event_id, EXTRACT(QUARTER FROM ts) AS q, EXTRACT(WEEK FROM ts) AS w, EXTRACT(DAY FROM ts) AS d, EXTRACT(DOW FROM ts) AS dow, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, CAST(EXTRACT(SECOND FROM ts) AS INT) AS s FROM events", "SELECT event_id, quarter(ts)::INT AS q, weekofyear(ts)::INT AS w, day(ts)::INT AS d, dayofweek(ts)::INT + 1 AS dow, hour(ts)::INT AS h, minute(ts)::INT AS mi, floor(second(ts))::INT AS s FROM events"),
    "sql_escapes_comments": ("spark", "SELECT 'it''s' AS a, \"dq\" AS b, 'tab\\tend' AS c, 1.5e1 AS d, 12L AS e, 0.25BD AS f -- a comment; with a semicolon\nFROM region /* and another */ WHERE r_regionkey = 0;", "SELECT 'it''s' AS a, 'dq' AS b, 'tab' || chr(9) || 'end' AS c, 15.0::DOUBLE AS d, 12::BIGINT AS e, 0.25::DECIMAL(2, 2) AS f FROM region WHERE r_regionkey = 0"),
    "ch_any_right": ("clickhouse", "SELECT o.o_orderkey, c.c_custkey FROM orders AS o ANY RIGHT JOIN customer AS c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_custkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"),
    "ch_any_full": ("clickhouse", "SELECT c.c_custkey, s.s_suppkey FROM customer AS c ANY FULL JOIN supplier AS s ON c.c_custkey = s.s_suppkey", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN (SELECT min(s_suppkey) AS s_suppkey FROM supplier GROUP BY supplier.s_suppkey) ON c_custkey = s_suppkey"),
    "ch_rollup_totals": ("clickhouse", "SELECT l_returnflag, l_linestatus, count() AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP WITH TOTALS", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) UNION ALL SELECT NULL, NULL, count(*) FROM lineitem"),
    "ch_cube_totals": ("clickhouse", "SELECT l_returnflag, l_linestatus, count() AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus) WITH TOTALS", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT NULL, NULL, count(*) FROM lineitem"),
    "ch_tuple_access": ("clickhouse", "SELECT n_nationkey, (n_name, n_regionkey).2 AS b, t.1 AS a FROM (SELECT n_nationkey, n_name, n_regionkey, tuple(n_name, n_regionkey) AS t FROM nation)", "SELECT n_nationkey, n_regionkey AS b, n_name AS a FROM nation"),
    "ch_windows": ("clickhouse", "SELECT o_orderkey, count() OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two, CAST(row_number() OVER w AS Int64) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC)", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders"),
    "ch_interval_starts": ("clickhouse", "SELECT event_id, CAST(toStartOfInterval(ts, INTERVAL 15 MINUTE) AS STRING) AS q, arraySum([1, 2, 3]) AS whole, arraySum([0.5, 1.5]) AS parts FROM events", "SELECT event_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS q, 6::BIGINT AS whole, 2.0::DOUBLE AS parts FROM events"),
    "ch_sketches": ("clickhouse", "SELECT abs(uniq(o_custkey) / uniqExact(o_custkey) - 1) < 0.15 AS a, abs(uniqHLL12(o_orderkey) / count() - 1) < 0.15 AS b, abs(quantile(0.5)(o_totalprice) / quantileExact(0.5)(o_totalprice) - 1) < 0.02 AS q FROM orders", "SELECT true AS a, true AS b, true AS q"),
    "ch_ties_offset": ("clickhouse", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderstatus LIMIT 50 WITH TIES", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY rank() OVER (ORDER BY o_orderpriority, o_orderstatus) <= 50"),
    "ch_limit_by": ("clickhouse", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2 BY o_custkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "ch_limit_by_offset": ("clickhouse", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2 OFFSET 1 BY o_custkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) BETWEEN 2 AND 3"),
    "ch_with_ties": ("clickhouse", "SELECT l_orderkey, l_quantity FROM lineitem ORDER BY l_quantity DESC LIMIT 10 WITH TIES", "SELECT l_orderkey, l_quantity FROM lineitem QUALIFY rank() OVER (ORDER BY l_quantity DESC) <= 10"),
    "ch_top_ties": ("clickhouse", "SELECT TOP 5 WITH TIES l_orderkey, l_tax FROM lineitem ORDER BY l_tax", "SELECT l_orderkey, l_tax FROM lineitem QUALIFY rank() OVER (ORDER BY l_tax) <= 5"),
    "ch_with_totals": ("clickhouse", "SELECT o_orderstatus, count() AS n FROM orders GROUP BY o_orderstatus WITH TOTALS", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())"),
    "ch_array_join": ("clickhouse", "SELECT vec_id, x, i FROM embeddings ARRAY JOIN embedding AS x, range(64) AS i", "SELECT vec_id, unnest(embedding) AS x, unnest(range(64))::INT AS i FROM embeddings"),
    "ch_left_array_join": ("clickhouse", "SELECT n_name, x FROM nation LEFT ARRAY JOIN arrayFilter(v -> v > 20, [n_nationkey]) AS x", "SELECT n_name, CASE WHEN n_nationkey > 20 THEN n_nationkey END AS x FROM nation"),
    "ch_any_join": ("clickhouse", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c ANY LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders) AS o ON c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"),
    "ch_semi_left": ("clickhouse", "SELECT c_custkey FROM customer SEMI LEFT JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "ch_right_anti": ("clickhouse", "SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "ch_global_join": ("clickhouse", "SELECT n_name, r_name FROM nation GLOBAL ALL INNER JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "ch_asof_join": ("clickhouse", "SELECT a.event_id AS id, b.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') AS a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') AS b ON a.user_id = b.user_id AND a.ts >= b.ts", "SELECT a.event_id AS id, b.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts"),
    "ch_sample": ("clickhouse", " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber FROM lineitem SAMPLE 1 / 4 OFFSET {i} / 4" for i in range(4)), "SELECT l_orderkey, l_linenumber FROM lineitem"),
    "ch_sample_share": ("clickhouse", "SELECT b.n / a.n BETWEEN 0.08 AND 0.12 AS tenth, c.n = b.n AS repeatable FROM (SELECT count() AS n FROM lineitem) AS a, (SELECT count() AS n FROM lineitem SAMPLE 1 / 10 OFFSET 1 / 2) AS b, (SELECT count() AS n FROM lineitem SAMPLE 1 / 10 OFFSET 1 / 2) AS c", "SELECT true AS tenth, true AS repeatable"),
    "ch_final": ("clickhouse", "SELECT user_id, event_id, ts FROM events FINAL", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"),
    "ch_prewhere": ("clickhouse", "SELECT count() AS n FROM lineitem PREWHERE l_quantity > 30 WHERE l_discount = 0.05 OR l_tax = 0.02", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30 AND (l_discount = 0.05 OR l_tax = 0.02)"),
    "ch_ternary": ("clickhouse", "SELECT o_orderkey, o_totalprice > 100000 ? 'big' : 'small' AS size FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders"),
    "ch_scalar_with": ("clickhouse", "WITH 10 + 20 AS least SELECT l_orderkey, l_quantity - least AS over FROM lineitem WHERE l_quantity > least", "SELECT l_orderkey, l_quantity - 30 AS over FROM lineitem WHERE l_quantity > 30"),
    "ch_functions": ("clickhouse", "SELECT o_orderkey, toYYYYMM(o_orderdate) AS ym, toYear(o_orderdate) AS y, multiIf(o_totalprice > 200000, 'a', o_totalprice > 100000, 'b', 'c') AS band, toString(o_custkey) AS c, arraySum(x -> x * 2, [1, 2, 3]) AS s, [5, 6, 7][2] AS second FROM orders", "SELECT o_orderkey, (year(o_orderdate) * 100 + month(o_orderdate))::INT AS ym, year(o_orderdate)::INT AS y, CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' ELSE 'c' END AS band, o_custkey::VARCHAR AS c, 12.0::DOUBLE AS s, 6 AS second FROM orders"),
    "ch_aggregates": ("clickhouse", "SELECT o_orderstatus, countIf(o_totalprice > 100000) AS big, uniqExact(o_custkey) AS customers, argMax(o_orderkey, o_orderkey) AS last, round(quantileExact(0.5)(o_totalprice), 4) AS mid FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) AS customers, max(o_orderkey) AS last, round(quantile_cont(o_totalprice, 0.5), 4) AS mid FROM orders GROUP BY o_orderstatus"),
    "ch_global_in": ("clickhouse", "SELECT c_custkey FROM customer WHERE c_custkey GLOBAL NOT IN (SELECT o_custkey FROM orders)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "ch_numbers": ("clickhouse", "SELECT number, number * number AS sq FROM numbers(100) WHERE number % 3 = 1", "SELECT range AS number, range * range AS sq FROM range(100) WHERE range % 3 = 1"),
    "ch_cube_order": ("clickhouse", "SELECT o_orderstatus, o_orderpriority, count() AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority) ORDER BY n DESC, o_orderstatus, o_orderpriority LIMIT 12", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority) ORDER BY n DESC, o_orderstatus NULLS LAST, o_orderpriority NULLS LAST LIMIT 12"),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    dialect, text, _ = QUERIES[name]
    tables = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def call(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder, tables)
        return run(spark, text, dialect, keys=KEYS)

    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: ansi or text for name, (_, text, ansi) in QUERIES.items()}
