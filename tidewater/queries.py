"""The registered queries of the engine and their SQL for DuckDB."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.frame import Frame
from tidewater.functions import predict, strict, vector
from tidewater.operators.profile import profile_table
from tidewater.session import Session, SessionOptions
from tidewater.sources import datagen, ipc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_TABLE = re.compile(rf"\b(?:{'|'.join(TABLES)})\b")


def session(spark: SparkSession, sf_dir: str, names) -> Session:
    s = Session(spark)
    for name in names:
        s.register_frame(name, s.spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
    return s


def _sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, sorted(set(_TABLE.findall(text)))).sql(text)


#: The same statement for both engines.
SQL: dict[str, str] = {
    # filters and projections
    "filter_project": "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 2 AND l_discount < 0.04",
    "filter_flipped": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 45 < l_quantity AND 0.04 > l_discount",
    "filter_or_ne_between": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE (l_returnflag = 'R' OR l_linestatus <> 'O') AND l_quantity BETWEEN 10 AND 12",
    "filter_is_null": "SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL",
    "filter_is_not_null": "SELECT count(*) AS n FROM events WHERE props IS NOT NULL",
    "filter_like_case_in": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#45') AND p_name LIKE '%a%'",
    "project_computed": "SELECT 1 + 1 AS two, l_orderkey, l_linenumber, l_quantity * 2 AS twice, CAST(l_quantity AS BIGINT) AS q FROM lineitem",
    "cast_double_colon": "SELECT o_orderkey, o_orderkey::double / 4 AS quarter FROM orders",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.95 FROM orders)",
    # joins
    "join_inner_int64": "SELECT l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber, o.o_custkey AS o_custkey, o.o_orderpriority AS o_orderpriority FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    "join_projected": "SELECT o.o_orderdate AS o_orderdate, l.l_quantity AS l_quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' AND l.l_quantity > 40",
    "join_left": "SELECT c.c_custkey AS c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "join_right": "SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0",
    "join_full": "SELECT n.n_name AS n_name, s.s_suppkey AS s_suppkey FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000",
    "join_residual": "SELECT l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_quantity < p.p_size",
    "join_multi_key": "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "join_string_key": "SELECT a.n_nationkey AS k, count(*) AS n FROM nation a JOIN nation b ON a.n_name = b.n_name GROUP BY a.n_nationkey",
    "join_null_safe": "SELECT CAST(sum(a.n * b.n) AS BIGINT) AS n FROM (SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) x GROUP BY k) a JOIN (SELECT k, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) y GROUP BY k) b ON a.k IS NOT DISTINCT FROM b.k",
    "join_self": "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey",
    "join_theta": "SELECT count(*) AS n FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey",
    "join_three_way": "SELECT r.r_name AS r_name, count(*) AS n FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti_not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END FROM orders)",
    "semi_exists": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "anti_not_exists": "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)",
    # aggregations
    "agg_sum_count_min_max": "SELECT l_suppkey, sum(l_quantity) AS sum_q, count(l_quantity) AS n, min(l_quantity) AS min_q, max(l_extendedprice) AS max_p FROM lineitem GROUP BY l_suppkey",
    "agg_int64_sum": "SELECT l_suppkey, CAST(sum(l_partkey) AS BIGINT) AS s, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY l_suppkey",
    "agg_null_key": "SELECT k, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM (SELECT CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_orderkey % 4 END AS k, CASE WHEN l_linenumber > 3 THEN NULL ELSE l_partkey END AS v FROM lineitem) t GROUP BY k",
    "agg_avg": "SELECT l_returnflag, round(avg(l_quantity), 6) AS avg_q FROM lineitem GROUP BY l_returnflag",
    "agg_global_count_star": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25",
    "agg_string_key": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_over_join": "SELECT o.o_orderpriority AS o_orderpriority, sum(l.l_quantity) AS s FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority",
    "agg_expression": "SELECT l_linenumber, sum(l_quantity + l_linenumber) AS s FROM lineitem GROUP BY l_linenumber",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_filter_clause": "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 30) AS big, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_linestatus",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_statistics": "SELECT l_linenumber, round(stddev_pop(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY l_linenumber",
    "agg_regression": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem",
    "agg_median": "SELECT l_linenumber, median(l_quantity) AS m FROM lineitem GROUP BY l_linenumber",
    "agg_bits_bools": "SELECT o_orderstatus, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx, bool_and(o_totalprice > 0) AS pa, bool_or(o_totalprice > 400000) AS po FROM orders GROUP BY o_orderstatus",
    # windows
    "window_count_partition": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem",
    "window_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "window_lag_lead": "SELECT o_orderkey, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next2 FROM orders",
    "window_rows_frame": "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM lineitem",
    "window_range_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM lineitem",
    "window_first_last_nth": "SELECT l_orderkey, l_linenumber, first_value(l_partkey) OVER w AS f, last_value(l_partkey) OVER w AS l, nth_value(l_partkey, 2) OVER w AS n2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    # sorts and limits
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "order_nulls_limit": "SELECT k, o_orderkey FROM (SELECT CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM orders) t ORDER BY k NULLS FIRST, o_orderkey LIMIT 40",
    "order_nulls_default": "SELECT k, o_orderkey FROM (SELECT CASE WHEN o_orderkey > 20 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM orders) t ORDER BY k, o_orderkey LIMIT 40",
    "order_offset": "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 15",
    # set operations and tables
    "union_all_aggs": "SELECT 'o' AS t, count(*) AS n FROM orders UNION ALL SELECT 'l' AS t, count(*) AS n FROM lineitem",
    "union_distinct": "SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "distinct": "SELECT DISTINCT l_returnflag, l_shipdate FROM lineitem",
    "values_inline": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)",
    "cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    # scalars
    "scalar_string_pack": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substr(p_name, 2, 3) AS s, concat(p_brand, '-', p_type) AS c, replace(p_name, 'a', 'A') AS r, reverse(p_brand) AS v, lpad(p_brand, 12, '*') AS l, trim(p_type) AS t, strpos(p_name, 'a') AS at, split_part(p_type, ' ', 1) AS first_word, starts_with(p_name, 'b') AS b, repeat('ab', 2) AS rep, ascii(p_name) AS asc_code, md5(p_name) AS m FROM part",
    "scalar_date_pack": "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_part('month', o_orderdate) AS BIGINT) AS mo, CAST(o_orderdate AS DATE) AS d FROM orders",
    "scalar_math_pack": "SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, power(p_size, 2) AS p, p_size % 7 AS m, sign(p_size - 25) AS sg, gcd(p_size, 12) AS g, lcm(p_size, 4) AS lc, greatest(p_size, 10) AS gr, least(p_size, 10) AS le, coalesce(nullif(p_size, 7), -1) AS nf FROM part",
    # peers, filters on windows, other joins
    "window_groups_frame": "SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM lineitem",
    "window_qualify_nested": "SELECT o_orderpriority, count(*) AS n FROM (SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) t GROUP BY o_orderpriority UNION ALL SELECT 'last' AS o_orderpriority, o_orderkey AS n FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) = 1",
    "join_cross": "SELECT r.r_name AS r_name, n.n_name AS n_name FROM region r CROSS JOIN nation n",
    "join_lateral": "SELECT n.n_name AS n_name, s.s_suppkey AS s_suppkey, s.s_acctbal AS s_acctbal FROM nation n, LATERAL (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n.n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) s",
    "order_desc_nulls": "SELECT k, o_orderkey FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM orders) t ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 40",
    "float_compare": "SELECT a, b, x = y AS eq, x < y AS lt, x >= y AS ge FROM (SELECT a, b, CASE a WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('-0.0' AS DOUBLE) WHEN 2 THEN CAST('0.0' AS DOUBLE) WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END AS x, CASE b WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('-0.0' AS DOUBLE) WHEN 2 THEN CAST('0.0' AS DOUBLE) WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END AS y FROM (VALUES (0), (1), (2), (3), (4)) AS p(a) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS q(b)) t",
    "filter_nan": "SELECT k, count(*) AS n, min(v) AS lo, max(v) AS hi FROM (SELECT l_linenumber AS k, CASE WHEN l_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem) t WHERE v > 10 GROUP BY k",
    "agg_sum_negative_zero": "SELECT l_linenumber, sum(CAST('-0.0' AS DOUBLE)) = 0.0 AS z, sum(l_quantity * 0) AS s FROM lineitem GROUP BY l_linenumber",
    "cast_special_floats": "SELECT 'NaN'::double AS n, CAST('Infinity' AS DOUBLE) AS i, CAST(NULL AS DOUBLE) AS z",
}

#: Statements that the engines spell differently: (ours, DuckDB's).
PAIRS: dict[str, tuple[str, str]] = {
    # integers divide to integers
    "window_rank_family": (
        "SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS t FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY CAST(s_acctbal AS BIGINT) / 1000)",
        "SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS t FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY trunc(CAST(s_acctbal AS BIGINT) / 1000))",
    ),
    "integer_division": (
        "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS q, (l_orderkey + 1) / 2 / 3 AS r, (3 - l_orderkey) / 4 AS neg, l_quantity / 4 AS f FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, (l_orderkey + 1) // 2 // 3 AS r, CAST(trunc((3 - l_orderkey) / 4) AS BIGINT) AS neg, l_quantity / 4 AS f FROM lineitem",
    ),
    "scalar_string_more": (
        "SELECT c_custkey, concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '-' END, c_mktsegment) AS c, concat_ws('/', c_name, NULL, c_mktsegment) AS w, left(c_name, 4) AS l, right(c_name, 3) AS r, rpad(c_mktsegment, 12, '.') AS rp, translate(c_mktsegment, 'AEI', 'aei') AS t, octet_length(c_name) AS o, position('#' IN c_name) AS p, chr(8364) AS euro, contains(c_name, '9') AS h, ends_with(c_name, '1') AS e, btrim('  x ') AS b, ltrim('xxa', 'x') AS lt, to_hex(c_custkey) AS hx, levenshtein(c_mktsegment, 'MACHINERY') AS lv, c_name ILIKE '%R#%7' AS il FROM customer",
        "SELECT c_custkey, concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '-' END, c_mktsegment) AS c, concat_ws('/', c_name, NULL, c_mktsegment) AS w, left(c_name, 4) AS l, right(c_name, 3) AS r, rpad(c_mktsegment, 12, '.') AS rp, translate(c_mktsegment, 'AEI', 'aei') AS t, CAST(octet_length(encode(c_name)) AS INTEGER) AS o, CAST(position('#' IN c_name) AS INTEGER) AS p, chr(8364) AS euro, contains(c_name, '9') AS h, suffix(c_name, '1') AS e, 'x' AS b, 'a' AS lt, lower(to_hex(c_custkey)) AS hx, CAST(levenshtein(c_mktsegment, 'MACHINERY') AS INTEGER) AS lv, c_name ILIKE '%R#%7' AS il FROM customer",
    ),
    "scalar_regexp_more": (
        r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first_one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS all_of, regexp_replace(p_type, '(\w)(\w)', '\2\1') AS swapped, regexp_match(p_brand, '([0-9])([0-9])')[2] AS digit, regexp_match(p_name, 'zzz')[1] AS none, p_type SIMILAR TO '.*[A-D].*' AS s, p_name ~ '^[a-m]' AS t, p_name !~ 'x' AS u, p_name ~* 'A' AS v, regexp_count(p_name, 'a') AS n FROM part",
        r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first_one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS all_of, regexp_replace(p_type, '(\w)(\w)', '\2\1') AS swapped, nullif(regexp_extract(p_brand, '([0-9])([0-9])', 2), '') AS digit, CAST(NULL AS VARCHAR) AS none, regexp_matches(p_type, '[A-D]') AS s, regexp_matches(p_name, '^[a-m]') AS t, NOT regexp_matches(p_name, 'x') AS u, regexp_matches(p_name, '[aA]') AS v, CAST(len(regexp_extract_all(p_name, 'a')) AS INTEGER) AS n FROM part",
    ),
    "scalar_date_more": (
        "SELECT event_id, CAST(date_part('dow', ts) AS INT) AS dow, CAST(extract(doy FROM ts) AS INT) AS doy, CAST(floor(date_part('epoch', ts)) AS BIGINT) AS ep, CAST(date_part('second', ts) AS INT) AS sec, CAST(extract(quarter FROM ts) AS INT) AS q, from_unixtime(event_id) AS f, to_timestamp_millis(event_id) AS m, to_timestamp_seconds(event_id) AS s, to_char(ts, '%Y-%m-%d %H') AS c, make_date(2024, 2, 29) AS d, date_trunc('hour', ts) AS h, to_timestamp('2024-05-06 07:08:09') AS t FROM events",
        "SELECT event_id, CAST(date_part('dow', ts) AS INT) AS dow, CAST(date_part('doy', ts) AS INT) AS doy, CAST(floor(epoch(ts)) AS BIGINT) AS ep, CAST(date_part('second', ts) AS INT) AS sec, CAST(date_part('quarter', ts) AS INT) AS q, make_timestamp(event_id * 1000000) AS f, make_timestamp(event_id * 1000) AS m, make_timestamp(event_id * 1000000) AS s, strftime(ts, '%Y-%m-%d %H') AS c, DATE '2024-02-29' AS d, date_trunc('hour', ts) AS h, TIMESTAMP '2024-05-06 07:08:09' AS t FROM events",
    ),
    "scalar_math_more": (
        "SELECT p_partkey, round(log(p_retailprice), 9) AS l10, round(log(2, p_retailprice), 9) AS l2, trunc(-p_retailprice) AS t, round(trunc(p_retailprice, 1), 6) AS t1, round(cbrt(p_size), 9) AS cb, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS ra, round(atan2(p_size, 3), 9) AS at, round(exp(p_size / 50.0), 9) AS ex, round(sinh(p_size / 50.0), 9) AS sh, factorial(5) AS fa, nanvl(CAST('NaN' AS DOUBLE), 1.5::double) AS nv, iszero(p_size - 7) AS z, round(cot(p_size + 0.5), 6) AS ct FROM part",
        "SELECT p_partkey, round(log10(p_retailprice), 9) AS l10, round(log2(p_retailprice), 9) AS l2, trunc(-p_retailprice) AS t, round(floor(p_retailprice * 10) / 10, 6) AS t1, round(cbrt(p_size), 9) AS cb, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS ra, round(atan2(p_size, 3), 9) AS at, round(exp(p_size / 50.0), 9) AS ex, round((exp(p_size / 50.0) - exp(-p_size / 50.0)) / 2, 9) AS sh, CAST(120 AS BIGINT) AS fa, CAST(1.5 AS DOUBLE) AS nv, p_size = 7 AS z, round(cot(p_size + 0.5), 6) AS ct FROM part",
    ),
    "scalar_array_more": (
        "SELECT o_orderkey, array_pop_back(a) AS pb, array_pop_front(a) AS pf, array_remove(a, 1) AS r1, array_remove_all(a, 1) AS ra, array_replace(a, 1, 9) AS p1, array_replace_all(a, 1, 9) AS pa, array_position(a, o_orderkey % 4) AS ps, array_position(a, 77) AS no, a[9] AS far, a[-1] AS last_one, array_slice(a, 2, -1) AS sl, array_prepend(0, a) AS pre, list_append(a, 5) AS app, array_distinct(a) AS di, array_sort(a) AS so, range(1, 4) AS rg, generate_series(3, 1) AS gs, array_has_any(a, [1, 8]) AS an, array_to_string(a, ',') AS js FROM (SELECT o_orderkey, [o_orderkey % 4, 1, 2, 1] AS a FROM orders) t",
        "SELECT o_orderkey, a[:3] AS pb, a[2:] AS pf, CASE WHEN a[1] = 1 THEN a[2:] ELSE [a[1], a[3], a[4]] END AS r1, list_filter(a, lambda x: x <> 1) AS ra, CASE WHEN a[1] = 1 THEN [9, 1, 2, 1] ELSE [a[1], 9, 2, 1] END AS p1, list_transform(a, lambda x: CASE WHEN x = 1 THEN 9 ELSE x END) AS pa, CAST(list_position(a, o_orderkey % 4) AS BIGINT) AS ps, CAST(NULL AS BIGINT) AS no, a[9] AS far, a[4] AS last_one, a[2:] AS sl, list_prepend(0, a) AS pre, list_append(a, 5) AS app, CASE WHEN a[1] IN (1, 2) THEN [a[1], 3 - a[1]] ELSE [a[1], 1, 2] END AS di, list_sort(a) AS so, [1, 2, 3] AS rg, CAST([] AS INTEGER[]) AS gs, true AS an, array_to_string(a, ',') AS js FROM (SELECT o_orderkey, [o_orderkey % 4, 1, 2, 1] AS a FROM orders) t",
    ),
    "scalar_map_struct": (
        "SELECT s_suppkey, map_keys(m) AS ks, map_values(m) AS vs, map_extract(m, 'a') AS ea, map_extract(m, 'z') AS ez, m['b'] AS b, named_struct('x', s_suppkey, 'y', s_name).y AS y, cardinality(m) AS n FROM (SELECT s_suppkey, s_name, map('a', s_suppkey, 'b', s_nationkey) AS m FROM supplier) t",
        "SELECT s_suppkey, ['a', 'b'] AS ks, [s_suppkey, CAST(s_nationkey AS BIGINT)] AS vs, [s_suppkey] AS ea, CAST([] AS BIGINT[]) AS ez, CAST(s_nationkey AS BIGINT) AS b, s_name AS y, 2 AS n FROM supplier",
    ),
    "scalar_hash_pack": (
        "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, digest(n_name, 'sha256') AS d, encode(n_name, 'base64') AS b, encode(n_name, 'hex') AS h, CAST(decode(encode(n_name, 'base64'), 'base64') AS STRING) AS back FROM nation",
        "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, sha256(n_name) AS d, rtrim(base64(encode(n_name)), '=') AS b, lower(hex(encode(n_name))) AS h, n_name AS back FROM nation",
    ),
    "scalar_conditional": (
        "SELECT o_orderkey, nvl(k, -1) AS a, nvl2(k, 'some', 'none') AS b, coalesce(k, o_custkey) AS c, nullif(o_orderstatus, 'F') AS d, greatest(k, 100) AS g, least(k, 100) AS l, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS e FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) t",
        "SELECT o_orderkey, coalesce(k, -1) AS a, CASE WHEN k IS NOT NULL THEN 'some' ELSE 'none' END AS b, coalesce(k, o_custkey) AS c, nullif(o_orderstatus, 'F') AS d, greatest(k, 100) AS g, least(k, 100) AS l, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS e FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) t",
    ),
    "agg_array": (
        "SELECT s_nationkey, array_agg(k ORDER BY s_suppkey DESC) AS a, array_agg(k ORDER BY k, s_suppkey) FILTER (WHERE s_suppkey % 2 = 0) AS f, first_value(s_name ORDER BY s_acctbal) AS lo, last_value(s_name ORDER BY s_acctbal) AS hi, string_agg(s_name, ';' ORDER BY s_suppkey DESC) AS names FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS k FROM supplier) t GROUP BY s_nationkey",
        "SELECT s_nationkey, array_agg(k ORDER BY s_suppkey DESC) AS a, coalesce(array_agg(k ORDER BY k NULLS LAST, s_suppkey) FILTER (WHERE s_suppkey % 2 = 0), []) AS f, first(s_name ORDER BY s_acctbal) AS lo, last(s_name ORDER BY s_acctbal) AS hi, string_agg(s_name, ';' ORDER BY s_suppkey DESC) AS names FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS k FROM supplier) t GROUP BY s_nationkey",
    ),
    "scalar_array_pack": (
        "SELECT o_orderkey, array_length([o_orderkey, o_custkey]) AS n, [o_orderkey, o_custkey][2] AS second, array_to_string(['a', 'b'], '-') AS j, array_has([1, 2, 3], 2) AS h FROM orders",
        "SELECT o_orderkey, CAST(len([o_orderkey, o_custkey]) AS INTEGER) AS n, o_custkey AS second, 'a-b' AS j, true AS h FROM orders",
    ),
    "generate_series": ("SELECT value, value * 2 AS twice FROM generate_series(1, 100)", "SELECT generate_series AS value, generate_series * 2 AS twice FROM generate_series(1, 100)"),
    "date_bin": (
        "SELECT event_id, date_bin(INTERVAL '15' MINUTE, ts) AS b FROM events",
        "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01 00:00:00') AS b FROM events",
    ),
    "agg_string_agg": (
        "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "scalar_regexp_pack": (
        "SELECT p_partkey, regexp_replace(p_name, '^[aeiou]', '_') AS r, regexp_like(p_name, '^[a-m]') AS k FROM part",
        "SELECT p_partkey, regexp_replace(p_name, '^[aeiou]', '_') AS r, regexp_matches(p_name, '^[a-m]') AS k FROM part",
    ),
    "agg_percentile": (
        "SELECT l_linenumber, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q FROM lineitem GROUP BY l_linenumber",
        "SELECT l_linenumber, quantile_cont(l_quantity, 0.25) AS q FROM lineitem GROUP BY l_linenumber",
    ),
    "unnest_array": (
        "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x",
        "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)",
    ),
}

_QUERY = [round((k % 7) / 7 - 0.5, 3) for k in range(64)]
_DUCK_QUERY = "[" + ", ".join(f"{x}::FLOAT" for x in _QUERY) + "]"
# distances in double arithmetic over the stored floats, summed in the order of the elements, agree to the last digits
_ZIP = f"list_zip(embedding, {_DUCK_QUERY})"
_L2 = f"sqrt(list_sum(list_transform({_ZIP}, lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"
_DOT = f"list_sum(list_transform({_ZIP}, lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NORM_A = "sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE)))"
_NORM_B = f"sqrt(list_sum(list_transform({_DUCK_QUERY}, lambda z: z::DOUBLE * z::DOUBLE)))"


def _frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return session(spark, sf_dir, [name]).table(name)


def vector_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vector.l2_distance(F.col("embedding"), vector.query_vector(_QUERY), "double")
    return _frame(spark, sf_dir, "embeddings").select("vec_id", F.round(d, 6).alias("d")).df


def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vector.cosine_distance(F.col("embedding"), vector.query_vector(_QUERY), "double")
    return _frame(spark, sf_dir, "embeddings").select("vec_id", F.round(d, 6).alias("d")).df


def topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frame(spark, sf_dir, "embeddings")
    d = vector.l2_distance(F.col("embedding"), vector.query_vector(_QUERY), "double")
    return f.with_column("d", d).sort("d", "vec_id").limit(10).select("vec_id", "label").df


def topk_cosine_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"SELECT vec_id, label FROM embeddings ORDER BY cosine_distance(embedding, {_QUERY}), vec_id LIMIT 10"
    return _sql(text, spark, sf_dir)


def frame_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, ["lineitem", "orders"])
    joined = s.table("lineitem").filter(F.col("l_quantity") > 20).join(s.table("orders").alias("o"), "l_orderkey", "o.o_orderkey")
    return joined.aggregate(["o_orderpriority"], [F.sum("l_quantity").alias("s"), F.count("*").alias("n")]).sort("o_orderpriority").limit(3).df


def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table(_frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").df).select("name", "min", "max", "null_count")


def profile_lineitem_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column with its type and quantiles; the quantiles are approximate, so tests hold them to brute force."""
    return profile_table(_frame(spark, sf_dir, "lineitem").df)


def strict_float_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = datagen.demo_table(spark, 100_000, special_floats=True)
    return strict.with_total_order(df, "v").groupBy("k").agg(strict.total_min("v").alias("lo"), strict.total_max("v").alias("hi"))


def wrapping_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _frame(spark, sf_dir, "lineitem").df.select("l_suppkey", (F.col("l_orderkey") + F.lit(2**63 - 1 - 2**40)).alias("x"))
    return df.groupBy("l_suppkey").agg(strict.wrapping_sum(F.col("x")).alias("s"))


def gen_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen.demo_table(spark, 200_000)


def vector_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null vectors, vectors without length and null elements, through SQL."""
    some = "CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN transform(embedding, x -> CAST(0 AS FLOAT)) WHEN 2 THEN transform(embedding, (x, i) -> if(i = 0, CAST(NULL AS FLOAT), x)) ELSE embedding END"
    text = f"SELECT vec_id, v IS NULL AS no_vector, l2_distance(v, {_QUERY}) IS NULL AS no_l2, cosine_distance(v, {_QUERY}) IS NULL AS no_cosine, isnan(cosine_distance(v, {_QUERY})) AS nan_cosine FROM (SELECT vec_id, {some} AS v FROM embeddings) t"
    return _sql(text, spark, sf_dir)


_LAYERS = [
    (np.array([[((r + c) % 5 - 2) / 8 for c in range(64)] for r in range(3)], dtype=np.float32), np.array([0.25, -0.5, 0.125], dtype=np.float32)),
    (np.array([[1, -0.5, 0.25], [0.5, 2, -1]], dtype=np.float32), np.array([0.0, 1.0], dtype=np.float32)),
]


def predict_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers with relu between them; one vector in five is null."""
    s = session(spark, sf_dir, ["embeddings"])
    s.spark.udf.register("score", predict.scorer_of(s.spark, predict.Model(_LAYERS, "relu")))
    return s.sql("SELECT vec_id, round(CAST(y[1] AS DOUBLE), 3) AS a, round(CAST(y[2] AS DOUBLE), 3) AS b FROM (SELECT vec_id, score(CASE WHEN vec_id % 5 > 0 THEN embedding END) AS y FROM embeddings) t")


def _duck_model() -> str:
    """The same model as SQL over the embedding."""
    hidden = []
    for w, b in zip(*_LAYERS[0], strict=True):
        zipped = f"list_zip(embedding, [{', '.join(f'{x}::DOUBLE' for x in w.tolist())}])"
        hidden.append(f"greatest(list_sum(list_transform({zipped}, lambda z: z[1]::DOUBLE * z[2])) + {b}, 0)")
    cols = ", ".join(f"{h} AS h{k}" for k, h in enumerate(hidden))
    outs = [f"CASE WHEN vec_id % 5 > 0 THEN round({' + '.join(f'({x}) * h{k}' for k, x in enumerate(w.tolist()))} + {b}, 3) END" for w, b in zip(*_LAYERS[1], strict=True)]
    return f"SELECT vec_id, {outs[0]} AS a, {outs[1]} AS b FROM (SELECT vec_id, {cols} FROM embeddings)"


def _folder(spark: SparkSession) -> str:
    """A new folder for files, shared where the cluster names one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{base.rstrip('/')}/tidewater-files-{uuid.uuid4().hex}"


def copy_and_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY to Parquet and CSV, an external table over each, a table created from their join."""
    s, at = session(spark, sf_dir, ["orders"]), _folder(spark)
    s.sql(f"COPY (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) TO '{at}/p' STORED AS PARQUET")
    s.sql(f"COPY (SELECT o_orderkey, o_orderstatus FROM orders) TO '{at}/c' STORED AS CSV")
    s.sql(f"CREATE EXTERNAL TABLE back STORED AS PARQUET LOCATION '{at}/p'")
    s.sql(f"CREATE EXTERNAL TABLE states STORED AS CSV LOCATION '{at}/c'")
    s.sql("CREATE TABLE both AS SELECT b.o_custkey, c.o_orderstatus, b.o_totalprice FROM back b JOIN states c ON b.o_orderkey = CAST(c.o_orderkey AS BIGINT)")
    return s.sql("SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM both GROUP BY o_custkey, o_orderstatus")


def ipc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as one Arrow file by the driver and read again from it."""
    path = f"{tempfile.mkdtemp()}/supplier.arrow"
    ipc.write_ipc(_frame(spark, sf_dir, "supplier").df, path)
    return ipc.read_ipc(spark, path)


def strict_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that wrap, and min and max with -0.0 before 0.0 and NaN last, in a strict session."""
    s = Session(spark, SessionOptions(strict=True))
    s.register_frame("lineitem", s.spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet"))
    v = "CASE WHEN l_linenumber = 1 THEN CAST('-0.0' AS DOUBLE) WHEN l_linenumber = 2 THEN CAST('0.0' AS DOUBLE) WHEN l_orderkey % 7 = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END"
    return s.sql(f"SELECT k, sum(x) AS s, CAST(min(v) AS STRING) AS lo, CAST(max(v) AS STRING) = 'NaN' AS nan_top FROM (SELECT l_suppkey AS k, l_orderkey + {2**63 - 1 - 2**40} AS x, {v} AS v FROM lineitem) t GROUP BY k")


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "vector_l2": (vector_l2, f"SELECT vec_id, round({_L2}, 6) AS d FROM embeddings"),
    "vector_cosine": (vector_cosine, f"SELECT vec_id, round(1 - {_DOT} / ({_NORM_A} * {_NORM_B}), 6) AS d FROM embeddings"),
    "topk_l2": (topk_l2, f"SELECT vec_id, label FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10"),
    "topk_cosine_sql": (topk_cosine_sql, f"SELECT vec_id, label FROM embeddings ORDER BY 1 - {_DOT} / ({_NORM_A} * {_NORM_B}), vec_id LIMIT 10"),
    "frame_verbs": (
        frame_verbs,
        "SELECT o_orderpriority, sum(l_quantity) AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 20 GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 3",
    ),
    "profile_lineitem": (
        profile_lineitem,
        "SELECT 'l_orderkey' AS name, CAST(min(l_orderkey) AS VARCHAR) AS min, CAST(max(l_orderkey) AS VARCHAR) AS max, count(*) - count(l_orderkey) AS null_count FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS VARCHAR), CAST(max(l_linenumber) AS VARCHAR), count(*) - count(l_linenumber) FROM lineitem UNION ALL SELECT 'l_returnflag', min(l_returnflag), max(l_returnflag), count(*) - count(l_returnflag) FROM lineitem",
    ),
    "wrapping_sum": (
        wrapping_sum,
        "SELECT l_suppkey, CAST(((sum(CAST(l_orderkey AS HUGEINT) + 9223370937343148031) + 9223372036854775808) % 18446744073709551616) - 9223372036854775808 AS BIGINT) AS s FROM lineitem GROUP BY l_suppkey",
    ),
    "vector_nulls": (
        vector_nulls,
        "SELECT vec_id, vec_id % 4 = 0 AS no_vector, vec_id % 4 IN (0, 2) AS no_l2, vec_id % 4 IN (0, 2) AS no_cosine, vec_id % 4 = 1 AS nan_cosine FROM embeddings",
    ),
    "predict_embeddings": (predict_embeddings, _duck_model()),
    "copy_and_create": (copy_and_create, "SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey, o_orderstatus"),
    "ipc_round_trip": (ipc_round_trip, "SELECT * FROM supplier"),
    "strict_sql": (
        strict_sql,
        "SELECT l_suppkey AS k, CAST(((sum(CAST(l_orderkey AS HUGEINT) + 9223370937343148031) + 9223372036854775808) % 18446744073709551616) - 9223372036854775808 AS BIGINT) AS s, CASE WHEN bool_or(l_linenumber = 1) THEN '-0.0' WHEN bool_or(l_linenumber = 2) THEN '0.0' ELSE CAST(min(CASE WHEN l_orderkey % 7 = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END) AS VARCHAR) END AS lo, bool_or(l_linenumber > 2 AND l_orderkey % 7 = 3) AS nan_top FROM lineitem GROUP BY l_suppkey",
    ),
    "profile_lineitem_all": (profile_lineitem_all, None),
    "strict_float_minmax": (strict_float_minmax, None),
    "gen_data": (gen_data, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(_sql, text) for name, text in SQL.items()}
    out |= {name: partial(_sql, ours) for name, (ours, _) in PAIRS.items()}
    return out | {name: f for name, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | {name: theirs for name, (_, theirs) in PAIRS.items()} | {name: sql for name, (_, sql) in FRAMES.items() if sql}
