"""Relational constructs as registered queries: one SQL text for Spark, and the same or an equivalent one for DuckDB.

Sums and averages of doubles are rounded; counts are BIGINT; nulls and ties are ordered explicitly.
"""

from __future__ import annotations

SAME: dict[str, str] = {
    # joins
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_three_way": "SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_six_way": """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
        JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY r_name, n_name""",
    "join_left": "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "join_left_anti_pattern": "SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL",
    "join_cross": "SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey",
    "join_comma": "SELECT n_name, s_name FROM nation, supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_or_condition": "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey",
    "join_expr_key": "SELECT p_brand, count(*) AS pairs FROM part JOIN nation ON upper(trim(substr(p_name, 1, 1))) = upper(substr(n_name, 1, 1)) GROUP BY p_brand",
    "self_join": "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_right_full": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, l.quality FROM labels l FULL OUTER JOIN documents d ON d.doc_id = l.doc_id",
    "semi_in": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti_not_in_pairs": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY c_nationkey",
    "anti_not_in_with_nulls": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey > 5 THEN c_custkey END FROM customer)",
    "join_or_three": "SELECT n_name, count(*) AS pairs FROM supplier JOIN customer ON s_suppkey = c_custkey OR s_nationkey = c_nationkey AND s_acctbal < c_acctbal OR s_name = c_name JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name",
    "rank_over_all": "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS place, dense_rank() OVER (ORDER BY o_orderpriority) AS priority FROM orders",
    "share_over_all": "SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (), 4) AS above_mean, count(*) OVER () AS n FROM supplier WHERE s_acctbal > 0",
    "anti_not_in": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "exists": "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)",
    "not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "orphan_documents_labels": "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id",
    # filters and expressions
    "filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "filter_in_list": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_type ILIKE 's%'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_brand NOT ILIKE '%1'",
    "filter_or_not": "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT (c_nationkey = 3)",
    "null_predicates": "SELECT count(*) AS labelled, count(quality) AS with_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL OR l.doc_id IS NULL",
    "case_when": "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1",
    "concat": "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR(10)) AS label FROM nation",
    # aggregation
    "global_agg": "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem",
    "group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "having_scalar_subquery": "SELECT p_brand, avg(p_size) AS mean_size FROM part GROUP BY p_brand HAVING avg(p_size) > (SELECT avg(p_size) FROM part)",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders_n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "sum_distinct": "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes FROM part",
    "conditional_agg": "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(CASE WHEN o_totalprice > 150000 THEN 1 END) AS large FROM orders GROUP BY o_orderpriority",
    "ratio_pct": "SELECT o_orderstatus, round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM orders), 4) AS pct FROM orders GROUP BY o_orderstatus",
    "nested_agg": "SELECT round(avg(n), 6) AS mean_orders, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t",
    "max_of_counts": "SELECT max(n) AS most FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) t",
    "min_max": "SELECT n_regionkey, min(n_name) AS first_name, max(n_name) AS last_name FROM nation GROUP BY n_regionkey",
    # windows
    "rank_partition_topk": "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders) t WHERE place <= 3",
    "dense_rank": "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS place FROM part",
    "row_number": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS place FROM conversations",
    # sort, limit, sets
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 10",
    "top1_with_ties": "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT src, count(*) AS n FROM (SELECT 'c' AS src FROM customer UNION ALL SELECT 's' FROM supplier) u GROUP BY src",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000",
    "order_nulls": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS FIRST, d.doc_id LIMIT 25",
    # scalar functions
    "substr_neg": "SELECT p_partkey, substr(p_name, -3, 2) AS tail, substr(p_brand, 2, 3) AS part_of FROM part",
    "instr_split": "SELECT c_custkey, substr(c_name, 1, instr(c_name, '#') - 1) AS word, CAST(substr(c_name, instr(c_name, '#') + 1) AS BIGINT) AS number FROM customer",
    "trim_lower_upper": "SELECT DISTINCT lower(trim('  ' || c_mktsegment || ' ')) AS low, upper(c_mktsegment) AS up FROM customer",
    "replace_cast": "SELECT DISTINCT CAST(replace(o_orderpriority, substr(o_orderpriority, 2), '') AS INTEGER) AS level FROM orders",
    "round_abs": "SELECT c_custkey, round(abs(c_acctbal), 1) AS size FROM customer",
    "coalesce_nullif": "SELECT d.doc_id, coalesce(nullif(l.quality, 0), -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "length": "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n FROM part",
    "greatest_least": "SELECT l_orderkey, l_linenumber, greatest(l_partkey, l_suppkey) AS hi, least(l_partkey, l_suppkey) AS lo FROM lineitem WHERE l_quantity > 48",
    # subqueries
    "scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.9 FROM customer)",
    "scalar_subquery_select": "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region",
    "correlated_max": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders a WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders b WHERE b.o_custkey = a.o_custkey)",
    "correlated_latest": """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) t
        ON o_custkey = c_custkey AND rn = 1""",
    "derived_table": "SELECT band, count(*) AS n FROM (SELECT CAST(floor(p_size / 10) AS BIGINT) AS band FROM part) t GROUP BY band",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON c_custkey = o_custkey WHERE total > 1000000 GROUP BY c_mktsegment",
    "multi_cte": """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey), b AS (SELECT avg(q) AS mean_q FROM a)
        SELECT l_suppkey, round(q, 2) AS q FROM a CROSS JOIN b WHERE q > mean_q""",
    "recursive_cte": "WITH RECURSIVE t(n, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total * 2 FROM t WHERE n < 20) SELECT n, total FROM t",
    "disjoint_ratio": "SELECT l_returnflag, round(CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 6) AS share FROM lineitem GROUP BY l_returnflag",
}

#: Texts that differ: (Spark, DuckDB).
PAIRS: dict[str, tuple[str, str]] = {
    "orphan_documents_labels": (SAME["orphan_documents_labels"], "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "integer_division": ("SELECT p_partkey, p_size div 7 AS q, p_size % 7 AS r FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, p_size % 7 AS r FROM part"),
    "running_sum": ("SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderdate) AS so_far FROM orders", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate) AS BIGINT) AS so_far FROM orders"),
    "join_or_direct": ("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey OR (s_nationkey = c_nationkey AND s_acctbal = c_acctbal)", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey UNION SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal = c_acctbal"),
    "strftime_year": ("SELECT date_format(o_orderdate, 'yyyy') AS y, count(*) AS n FROM orders GROUP BY 1", "SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders GROUP BY 1"),
    "group_by_expr": ("SELECT date_format(l_shipdate, 'yyyy-MM') AS m, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY date_format(l_shipdate, 'yyyy-MM')", "SELECT strftime(l_shipdate, '%Y-%m') AS m, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1"),
    "julianday_diff": ("SELECT o_orderkey, round(julianday(cast(o_orderdate AS STRING)) - julianday('1995-01-01'), 4) AS days FROM orders", "SELECT o_orderkey, round(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 86400.0, 4) AS days FROM orders"),
    "date_trunc_filter": ("SELECT event_id FROM events WHERE to_date(ts) = DATE '2024-01-15'", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'"),
    "datetime_text": ("SELECT event_id, sqlite_datetime(cast(ts AS STRING)) AS at, sqlite_date(cast(ts AS STRING)) AS d FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y-%m-%d') AS d FROM events"),
    "text_time_parse": ("SELECT event_id, cast(split_part(date_format(ts, 'mm:ss'), ':', 1) AS INT) * 60 + cast(substring_index(date_format(ts, 'mm:ss'), ':', -1) AS INT) AS seconds FROM events", "SELECT event_id, CAST(minute(ts) * 60 + floor(second(ts)) AS INTEGER) AS seconds FROM events"),
    "json_field": ("SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) % 7 AS k, count(*) AS n, count(get_json_object(props, '$.missing')) AS missing FROM events GROUP BY 1, 2", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS k, count(*) AS n, count(json_extract(props, '$.missing')) AS missing FROM events GROUP BY 1, 2"),
    "lenient_cast": (
        "SELECT s, lenient_real(s) AS r, lenient_int(s) AS i FROM VALUES ('-3.5e2x'), ('.5'), ('12ab'), ('1.9'), (''), ('x'), (NULL) AS t(s)",
        "SELECT * FROM (VALUES ('-3.5e2x', -350.0::DOUBLE, -3::BIGINT), ('.5', 0.5, 0), ('12ab', 12.0, 12), ('1.9', 1.9, 1), ('', 0.0, 0), ('x', 0.0, 0), (NULL, NULL, NULL)) t(s, r, i)",
    ),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
}

#: SQLite-flavoured texts that go through the dialect layer, with their DuckDB equivalents.
DIALECT: dict[str, tuple[str, str]] = {
    "dialect_iif_cast": (
        "SELECT `c_mktsegment`, CAST(SUM(IIF(c_acctbal > 0, 1, 0)) AS REAL) * 100 / COUNT(*) AS pct FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::DOUBLE * 100 / count(*) AS pct FROM customer GROUP BY c_mktsegment",
    ),
    "dialect_strftime_limit": (
        "SELECT STRFTIME('%Y', o_orderdate) AS y, COUNT(*) AS n FROM orders WHERE o_orderpriority LIKE '%urgent' GROUP BY y ORDER BY y LIMIT 1, 3",
        "SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS n FROM orders WHERE o_orderpriority ILIKE '%urgent' GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 1",
    ),
    "dialect_quotes_division": (
        'SELECT "p_brand" AS brand, COUNT(*) / 3 AS thirds, MAX(p_size) / 0 AS nothing FROM part WHERE p_type <> "none" GROUP BY p_brand',
        "SELECT p_brand AS brand, CAST(count(*) // 3 AS BIGINT) AS thirds, NULL::BIGINT AS nothing FROM part WHERE p_type <> 'none' GROUP BY p_brand",
    ),
    "dialect_set_precedence": (
        "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 3",
        "(SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 3",
    ),
    "dialect_scalar_max": (
        "SELECT n_nationkey, MAX(n_nationkey, n_regionkey) AS hi, SUBSTR(n_name, 0, 3) AS head, SUBSTR(n_name, -2) AS tail FROM nation",
        "SELECT n_nationkey, greatest(n_nationkey, n_regionkey) AS hi, substr(n_name, 1, 2) AS head, substr(n_name, -2) AS tail FROM nation",
    ),
    "iif": ("SELECT c_custkey, IIF(c_acctbal < 0, 'debt', IIF(c_acctbal > 5000, 'rich', 'credit')) AS kind FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'credit' END AS kind FROM customer"),
    "glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]?' AND NOT p_type GLOB 'S*'", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]?' AND NOT p_type GLOB 'S*'"),
    "any_value_group": (
        "SELECT o_custkey, o_orderkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey",
    ),
    "dialect_bare_dependent": (
        "SELECT c.c_custkey, c_mktsegment, COUNT(*) AS n FROM customer c JOIN orders ON o_custkey = c.c_custkey GROUP BY c.c_custkey",
        "SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    ),
    "dialect_where_alias": ("SELECT c_custkey, c_acctbal / 2 AS half FROM customer WHERE half > 2500", "SELECT c_custkey, c_acctbal / 2 AS half FROM customer WHERE c_acctbal / 2 > 2500"),
    "dialect_time_difference": (
        "SELECT o_orderkey, strftime('%Y', o_orderdate) - strftime('%m', o_orderdate) AS x, 2000 - strftime('%Y', o_orderdate) AS before FROM orders",
        "SELECT o_orderkey, CAST(year(o_orderdate) - month(o_orderdate) AS BIGINT) AS x, CAST(2000 - year(o_orderdate) AS BIGINT) AS before FROM orders",
    ),
    "dialect_limit_subquery": (
        "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT (SELECT COUNT(*) / 3 FROM customer)",
        "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= (SELECT count(*) // 3 FROM customer)",
    ),
    "dialect_first_of_rows": (
        "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region, (SELECT 'has' FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
        "SELECT n_nationkey, r_name AS region, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'has' END AS suppliers FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "dialect_case_division": (
        "SELECT o_orderstatus, SUM(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) * 100 / COUNT(*) AS pct, SUM(IIF(o_totalprice > 150000, 1, 0)) / COUNT(*) AS whole, CAST(SUM(o_totalprice > 150000) AS REAL) / COUNT(*) AS share FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, CAST(n * 100 // total AS BIGINT) AS pct, CAST(n // total AS BIGINT) AS whole, n::DOUBLE / total AS share FROM (SELECT o_orderstatus, count(*) FILTER (o_totalprice > 150000) AS n, count(*) AS total FROM orders GROUP BY o_orderstatus)",
    ),
    "dialect_qualified_division": (
        "SELECT t.s_suppkey, t.n / 4 AS quarter, t.q / 4 AS real_quarter FROM (SELECT l_suppkey AS s_suppkey, COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) AS t",
        "SELECT l_suppkey AS s_suppkey, CAST(count(*) // 4 AS BIGINT) AS quarter, max(l_quantity) / 4 AS real_quarter FROM lineitem GROUP BY l_suppkey",
    ),
    "dialect_literals": (
        "SELECT n_nationkey, 'LIMIT 1, 2' AS a, 'it''s a / b' AS b FROM nation WHERE n_name <> 'x LIKE y'",
        "SELECT n_nationkey, 'LIMIT 1, 2' AS a, 'it''s a / b' AS b FROM nation WHERE n_name <> 'x LIKE y'",
    ),
    "dialect_glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]*'", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]*'"),
}
SAME.pop("orphan_documents_labels")
