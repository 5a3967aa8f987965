"""SQL texts users may run over mounted files; the same text runs on both engines."""

TEXTS = {
    "inner_join": "SELECT n.n_name, COUNT(*) AS n FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "left_join": "SELECT c.c_mktsegment, COUNT(*) AS n, COUNT(o.o_orderkey) AS orders FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_mktsegment",
    "right_join": "SELECT n.n_name, COUNT(s.s_suppkey) AS n FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "full_join": "SELECT COUNT(*) AS n, COUNT(c.c_custkey) AS c, COUNT(p.p_partkey) AS p FROM (SELECT c_custkey FROM {customer} WHERE c_custkey % 2 = 0) c FULL JOIN (SELECT p_partkey FROM {part} WHERE p_partkey % 3 = 0) p ON c.c_custkey = p.p_partkey",
    "theta_join": "SELECT a.n_regionkey, COUNT(*) AS n FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey GROUP BY a.n_regionkey",
    "semi_join": "SELECT COUNT(*) AS n FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "anti_join": "SELECT c.c_mktsegment, COUNT(*) AS n FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) GROUP BY c.c_mktsegment",
    "cross_join_filter": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n WHERE r.r_regionkey = n.n_regionkey",
    "group_having": "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 14",
    "count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag",
    "grouping_sets": "SELECT COALESCE(l_returnflag, '*') AS f, COALESCE(l_linestatus, '*') AS s, COUNT(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "cube": "SELECT COALESCE(l_returnflag, '*') AS f, COALESCE(l_linestatus, '*') AS s, COUNT(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT COALESCE(event_type, '*') AS e, COALESCE(user_id, -1) AS u, COUNT(*) AS n FROM {events} GROUP BY ROLLUP (event_type, user_id)",
    "ranking": "SELECT c_custkey, CAST(rn AS BIGINT) AS rn, CAST(rk AS BIGINT) AS rk, CAST(dr AS BIGINT) AS dr FROM (SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM {customer}) t WHERE rn <= 10",
    "lag_lead": "SELECT s_suppkey, COALESCE(LAG(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), -1) AS before, COALESCE(LEAD(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), -1) AS after FROM {supplier}",
    "frame_sum": "SELECT s_suppkey, CAST(SUM(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM {supplier}",
    "union": "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}",
    "union_all": "SELECT COUNT(*) AS n FROM (SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}) t",
    "intersect": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}",
    "except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000",
    "order_limit_offset": "SELECT p_partkey, p_name FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5",
    "scalar_subquery": "SELECT c.c_mktsegment, COUNT(*) AS n FROM {customer} c WHERE c.c_acctbal > (SELECT AVG(d.c_acctbal) FROM {customer} d WHERE d.c_mktsegment = c.c_mktsegment) GROUP BY c.c_mktsegment",
    "cte": "WITH spend AS (SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM spend GROUP BY n",
    "strings": "SELECT UPPER(p_name) AS u, SUBSTR(p_name, 2, 3) AS s, REPLACE(p_brand, '#', '-') AS r, CONCAT(p_type, '/', TRIM(p_name)) AS c, COUNT(*) AS n FROM {part} GROUP BY 1, 2, 3, 4",
    "dates": "SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS m, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM {orders} GROUP BY 1, 2",
    "maths": "SELECT s_suppkey, ROUND(s_acctbal, 1) AS r, ABS(s_acctbal) AS a, CAST(FLOOR(s_acctbal) AS BIGINT) AS f FROM {supplier}",
    "conditionals": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, COALESCE(NULLIF(p_brand, 'Brand#1'), 'none') AS brand, COUNT(*) AS n FROM {part} GROUP BY 1, 2",
}
