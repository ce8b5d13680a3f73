"""Scans, predicates, expressions, joins, subqueries, aggregates, sorting and set operations."""

from .catalog import sql

COUNT = "CAST(count(*) AS BIGINT)"

sql(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, CAST(count(*) AS BIGINT) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)

# Scans and projections
sql("scan_project_alias", "SELECT c_custkey AS id, c_name AS name, c_acctbal balance FROM customer")
sql("select_star_region", "SELECT * FROM region")
sql("select_qualified_star", "SELECT n.* FROM nation n")
sql("select_no_from", "SELECT 1 AS one, 'a' AS letter, NULL IS NULL AS yes")
sql("scan_by_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")

# Predicates
sql("filter_comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_custkey <= 700 AND o_orderstatus <> 'F' AND o_orderkey != 3")
sql("filter_and_or_not", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT p_brand = 'Brand#11'")
sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_type LIKE 'S%'")
sql("filter_like_underscore", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#_____00__'")
sql("filter_in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
sql("filter_not_in", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1, 3)")
sql("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12")
sql("filter_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 3 AND 48")
sql("filter_not_like", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
sql("filter_is_null", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
sql("filter_is_not_null", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
sql("filter_null_safe", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') <=> NULL", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT DISTINCT FROM NULL")
sql("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1996-04-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-04-01 00:00:00'")

# Expressions
sql("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band FROM part")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
sql("arith_int_float", "SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS a, l_linenumber - l_orderkey AS b, l_quantity * l_linenumber AS c, l_extendedprice - l_tax AS d FROM lineitem")
sql("int_division_trunc", "SELECT p_partkey, (0 - p_size) / 7 AS q, p_partkey / (p_size - p_size) AS by_zero FROM part", "SELECT p_partkey, CAST(CAST(trunc((0 - p_size) / 7) AS BIGINT) AS DOUBLE) AS q, CAST(NULL AS DOUBLE) AS by_zero FROM part")
sql("float_division", "SELECT p_partkey, p_retailprice / p_size AS unit FROM part", "SELECT p_partkey, p_retailprice / nullif(p_size, 0) AS unit FROM part")
sql("modulo", "SELECT o_orderkey, o_orderkey % 7 AS r, mod(o_custkey, 5) AS m FROM orders", "SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS r, CAST(o_custkey % 5 AS BIGINT) AS m FROM orders")
sql("unary_minus", "SELECT c_custkey, -c_acctbal AS debit, -(c_custkey + 1) AS n FROM customer")
sql("string_concat_op", "SELECT n_name || '-' || n_nationkey AS tag FROM nation")
sql("precedence", "SELECT p_partkey FROM part WHERE NOT p_size = 5 AND p_size + 2 * 3 > 20 OR p_brand = 'Brand#23'")
sql("boolean_projection", "SELECT n_nationkey, n_regionkey > 2 AS east, TRUE AS t FROM nation")

# Joins
sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
sql("join_bare", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("join_left", f"SELECT c.c_custkey, {COUNT} AS n, CAST(count(o.o_orderkey) AS BIGINT) AS orders_n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey", None)
sql("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
sql("join_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a FULL OUTER JOIN nation b ON a.n_nationkey = b.n_nationkey + 20")
sql("join_cross_small", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
sql("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql("join_using", "SELECT k, a.x, b.y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b USING (k)")
sql("join_natural", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b")
sql("join_three_way", "SELECT r.r_name, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
sql("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_theta", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey > n.n_nationkey AND s.s_acctbal > 9000")
sql("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql("join_anti_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
sql("join_semi_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")

# Subqueries
sql("derived_table", "SELECT t.seg, t.n FROM (SELECT c_mktsegment AS seg, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment) t WHERE t.n > 10")
sql("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
sql("correlated_scalar_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("scalar_subquery_select", "SELECT r_regionkey, (SELECT CAST(count(*) AS BIGINT) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS nations FROM region r")

# Aggregation
sql("agg_global", f"SELECT {COUNT} AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
sql("agg_group", f"SELECT o_orderstatus, {COUNT} AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
sql("agg_group_multi", f"SELECT l_returnflag, l_linestatus, {COUNT} AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_empty_input", f"SELECT {COUNT} AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_orderkey) AS low FROM orders WHERE o_orderkey < 0")
sql("agg_expr_arg", "SELECT round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem")
sql("agg_of_exprs", "SELECT o_orderpriority, round(sum(o_totalprice) / count(*), 4) AS mean FROM orders GROUP BY o_orderpriority")
sql("agg_count_distinct", "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS states FROM orders")
sql("agg_sum_distinct", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes FROM part")
sql("agg_nulls", "SELECT CAST(count(nullif(p_size, 1)) AS BIGINT) AS n, min(nullif(p_size, 1)) AS low FROM part")
sql("agg_having", f"SELECT o_custkey, {COUNT} AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sql("agg_having_alias", f"SELECT c_nationkey, {COUNT} AS n FROM customer GROUP BY c_nationkey HAVING n > 60")
sql("group_without_aggregate", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
sql("group_first_row", "SELECT p_brand, min_by(p_name, p_partkey) AS name FROM part GROUP BY p_brand", "SELECT p_brand, arg_min(p_name, p_partkey) AS name FROM part GROUP BY p_brand")

# Sorting, limits, set operations
sql("sort_multi_key", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey ASC")
sql("sort_expr", "SELECT p_partkey FROM part ORDER BY p_size * p_retailprice DESC, p_partkey LIMIT 20")
sql("sort_nulls", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r, n_nationkey LIMIT 12", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r NULLS FIRST, n_nationkey LIMIT 12")
sql("sort_ordinal", "SELECT n_name, n_nationkey FROM nation ORDER BY 2 DESC LIMIT 3")
sql("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10")
sql("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("union_three_arms", "SELECT 'n' AS kind, n_nationkey AS k FROM nation UNION ALL SELECT 'r', r_regionkey FROM region UNION SELECT 'n', n_nationkey FROM nation")
sql("intersect_except", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
