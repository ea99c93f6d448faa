"""Registered queries of the relational, profiling and judging operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scaling
from ..functions.canonical import canonical_frame
from ..functions.dialect import Dialect, install_shims, tokenize
from ..operators import compare, graph, profile, ranking, report, verify
from ..sources.catalog import KEYS, TPCH, Catalog
from ..streaming.windows import windowed_counts
from . import relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return keep


def catalog(spark: SparkSession, sf_dir: str, names=tuple(KEYS)) -> Catalog:
    return Catalog.of_parquet(spark, sf_dir, names)


def _tables_in(sql: str) -> list[str]:
    words = {t.text.lower() for t in tokenize(sql) if t.kind == "word"}
    return [t for t in KEYS if t in words]


def _sql_query(sql: str, dialect: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = catalog(spark, sf_dir, _tables_in(sql)).register()
        install_shims(spark)
        text = Dialect(spark, {n: df.schema for n, df in tables.frames.items()}).rewrite(sql) if dialect else sql
        return scaling.run(spark, text)

    return run


for _name, _sql in relational.SAME.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sql_query(_sql), _sql
for _name, (_sql, _duck) in relational.PAIRS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sql_query(_sql), _duck
for _name, (_sql, _duck) in relational.DIALECT.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sql_query(_sql, True), _duck

# Profiles.


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c, kind in df.dtypes if kind == "double"})


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """The DuckDB statistics of columns (name, kind: text, number or other)."""
    parts = []
    for name, kind in columns:
        text = lambda e: e if kind == "text" else "0"  # noqa: B023, E731
        number = lambda e: f"round({e}, 4)" if kind == "number" else "NULL::DOUBLE"  # noqa: B023, E731
        parts.append(
            f"SELECT '{table}' AS table_name, '{name}' AS column_name, count(*) AS row_count, count(*) - count({name}) AS null_count, round((count(*) - count({name})) * 100.0 / count(*), 4) AS null_percent,"
            f" count(DISTINCT {name}) AS distinct_count, CAST({text(f"count(*) FILTER ({name} = '')")} AS BIGINT) AS empty_count, CAST({text(f'count(*) FILTER ({name} <> trim({name}))')} AS BIGINT) AS whitespace_count,"
            f" CAST({text(f"count(*) FILTER ({name} <> '')")} AS BIGINT) AS filled_count, CAST({text(f"count(*) FILTER (regexp_matches({name}, '^[0-9]') AND NOT regexp_matches({name}, '[a-zA-Z]'))")} AS BIGINT) AS numeric_looking_count,"
            f" {number(f'min({name})::DOUBLE')} AS min_value, {number(f'max({name})::DOUBLE')} AS max_value, {number(f'avg({name})')} AS avg_value FROM {table}"
        )
    return " UNION ALL ".join(parts)


_PROFILED = {
    "orders": [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "other"), ("o_orderpriority", "text")],
    "lineitem": [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "other")],
    "customer": [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text")],
    "documents": [("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number")],
}
for _table, _columns in _PROFILED.items():
    QUERIES[f"profile_{_table}"] = lambda spark, sf_dir, t=_table: _rounded(profile.column_stats(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t))
    ORACLE_SQL[f"profile_{_table}"] = _profile_sql(_table, _columns)


@registered("profile_dirty", """
    WITH d AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN ' ' || n_name WHEN n_nationkey % 5 = 1 THEN n_name || ' ' WHEN n_nationkey % 5 = 2 THEN '' END AS a, CAST(n_nationkey AS VARCHAR) || ':00' AS b FROM nation)
    SELECT 'dirty' AS table_name, 'a' AS column_name, 'empty_string' AS type, 'warning' AS severity FROM d HAVING count(*) FILTER (a = '') > 0
    UNION ALL SELECT 'dirty', 'a', 'whitespace', 'critical' FROM d HAVING count(*) FILTER (a <> trim(a)) > 0
    UNION ALL SELECT 'dirty', 'b', 'type_mismatch', 'critical' FROM d HAVING count(*) FILTER (regexp_matches(b, '^[0-9]') AND NOT regexp_matches(b, '[a-zA-Z]')) >= 0.8 * count(*) FILTER (b <> '')""")
def profile_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over a table that was made dirty."""
    key, name = F.col("n_nationkey") % 5, F.col("n_name")
    a = F.when(key == 0, F.concat(F.lit(" "), name)).when(key == 1, F.concat(name, F.lit(" "))).when(key == 2, "")
    dirty = spark.read.parquet(f"{sf_dir}/nation.parquet").select(a.alias("a"), F.concat(F.col("n_nationkey").cast("string"), F.lit(":00")).alias("b"))
    issues = profile.quality_issues(profile.column_stats(dirty, "dirty"), profile.whitespace_examples(dirty, ["a", "b"]))
    return issues.select("table_name", "column_name", "type", "severity")


@registered("null_heavy", "SELECT 'labelled' AS table_name, 'quality' AS column_name, 'null_heavy' AS type FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id HAVING (count(*) - count(quality)) * 100.0 / count(*) > 50")
def null_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return profile.quality_issues(profile.column_stats(labelled, "labelled")).select("table_name", "column_name", "type")


@registered("clean_issues", "SELECT 'x' AS table_name, 'x' AS column_name, 'x' AS type WHERE false")
def clean_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the clean tables: none."""
    tables = catalog(spark, sf_dir, TPCH)
    found = [profile.quality_issues(profile.column_stats(df, name)).select("table_name", "column_name", "type") for name, df in sorted(tables.frames.items())]
    return reduce(DataFrame.unionAll, found)


_TOP = """SELECT 'orders' AS table_name, column_name, value, value_count, round(percent, 4) AS percent, CAST(position AS INTEGER) AS position FROM (
    SELECT column_name, value, count(*) AS value_count, count(*) * 100.0 / (SELECT count(*) FROM orders) AS percent, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS position
    FROM (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY column_name, value) WHERE position <= 15"""


@registered("top_values_orders", _TOP)
def top_values_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _rounded(profile.top_values(df, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


_FKS = [(t, fk) for t in sorted(KEYS) for fk in KEYS[t][1]]


@registered("orphan_check_all_fks", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{fk.column}' AS column_name, '{fk.referenced_table}' AS referenced_table, '{fk.referenced_column}' AS referenced_column, count(*) AS orphan_count FROM {t} c WHERE c.{fk.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {fk.referenced_table} p WHERE p.{fk.referenced_column} = c.{fk.column})" for t, fk in _FKS))
def orphan_check_all_fks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.orphan_counts(catalog(spark, sf_dir))


# Catalog and graph.


@registered("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in KEYS))
def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).row_counts()


@registered("catalog_totals", f"SELECT CAST({len(KEYS)} AS BIGINT) AS total_tables, CAST(" + " + ".join(f"(SELECT count(*) FROM {t})" for t in KEYS) + " AS BIGINT) AS total_rows")
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).totals()


_FK_VALUES = ", ".join(f"('{t}', '{fk.column}', '{fk.referenced_table}', '{fk.referenced_column}')" for t, fk in _FKS)


@registered("fk_edges", f"WITH f(a, b, c, d) AS (VALUES {_FK_VALUES}) SELECT a AS from_table, b AS from_column, c AS to_table, d AS to_column FROM f UNION SELECT c, d, a, b FROM f")
def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fk_edges(catalog(spark, sf_dir))


@registered("join_path_lineitem_region", f"""WITH RECURSIVE f(a, b, c, d) AS (VALUES {_FK_VALUES}), e AS (SELECT a AS x, c AS y FROM f UNION SELECT c, a FROM f),
    walk(node, path, steps) AS (SELECT 'lineitem', 'lineitem', 0 UNION ALL SELECT e.y, walk.path || '>' || e.y, walk.steps + 1 FROM walk JOIN e ON e.x = walk.node
      WHERE walk.steps < 12 AND instr('>' || walk.path || '>', '>' || e.y || '>') = 0)
    SELECT path, steps FROM walk WHERE node = 'region' ORDER BY steps, path LIMIT 1""")
def join_path_lineitem_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path_of(graph.fk_edges(catalog(spark, sf_dir)), "lineitem", "region")


@registered("fk_autocomplete", f"""WITH f(a, b, c, d) AS (VALUES {_FK_VALUES}), s(t) AS (VALUES ('orders'), ('part')), fw AS (SELECT DISTINCT c AS t FROM f WHERE a IN (SELECT t FROM s) AND c NOT IN (SELECT t FROM s)),
    base AS (SELECT t FROM s UNION ALL SELECT t FROM fw)
    SELECT t AS table_name, 'selected' AS reason FROM s UNION ALL SELECT t, 'referenced' FROM fw
    UNION ALL SELECT a, 'bridge' FROM f WHERE c IN (SELECT t FROM base) AND a NOT IN (SELECT t FROM base) GROUP BY a HAVING count(*) >= 2""")
def fk_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.linked_tables_df(catalog(spark, sf_dir), ["orders", "part"])


@registered("field_semantics", f"""WITH f(a, b, c, d) AS (VALUES {_FK_VALUES}) SELECT a AS table_name, b AS column_name, 'foreign_key' AS semantic FROM f
    UNION ALL SELECT * FROM (VALUES ('events', 'event_id', 'primary_key'), ('events', 'user_id', 'id_field'), ('documents', 'doc_id', 'primary_key'), ('embeddings', 'vec_id', 'primary_key'), ('pages', 'page_id', 'primary_key'), ('benchmark', 'item_id', 'primary_key'), ('conversations', 'conv_id', 'id_field')) v""")
def field_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.field_semantics(catalog(spark, sf_dir))


@registered("join_along_path", "SELECT r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_along_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog(spark, sf_dir, TPCH)
    return graph.join_along(tables, graph.join_path(tables, "supplier", "region")).groupBy(F.col("region_r_name").alias("r_name")).agg(F.count(F.lit(1)).alias("n"))


# Judging.


@registered("multiset_compare", """SELECT o_orderstatus, o_orderpriority, n_a, n_b FROM (SELECT o_orderstatus, o_orderpriority, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(1 - a) AS BIGINT) AS n_b FROM
    (SELECT o_orderstatus, o_orderpriority, 1 AS a FROM orders UNION ALL SELECT o_orderstatus, o_orderpriority, 0 FROM orders WHERE o_totalprice > 50000) GROUP BY 1, 2) WHERE n_a <> n_b""")
def multiset_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keep = ["o_orderstatus", "o_orderpriority"]
    return compare.row_differences(orders.select(*keep), orders.filter("o_totalprice > 50000").select(*keep))


@registered("canonical_values", "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS price FROM orders")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = canonical_frame(orders.select("o_orderkey", "o_totalprice"), ["k", "price"])
    return price.select(F.col("k").cast("long").alias("o_orderkey"), "price")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stand-ins for verdicts, enough to roll up."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderstatus") == "F", "exact_match").when(F.col("o_orderstatus") == "O", "semantic_match").otherwise("row_count_error")
    level = F.element_at(F.array(*[F.lit(d) for d in ("simple", "moderate", "challenging")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return orders.select(F.col("o_orderkey").alias("id"), kind.alias("error_type"), (kind != "row_count_error").alias("is_correct"), level.alias("difficulty"))


_VERDICTS = """WITH v AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'exact_match' WHEN 'O' THEN 'semantic_match' ELSE 'row_count_error' END AS error_type,
    list_extract(['simple', 'moderate', 'challenging'], CAST(o_orderkey % 3 + 1 AS INTEGER)) AS difficulty FROM orders) """


@registered("difficulty_rollup", _VERDICTS + "SELECT difficulty, count(*) AS total, count(*) FILTER (error_type <> 'row_count_error') AS correct, round(count(*) FILTER (error_type <> 'row_count_error') * 100.0 / count(*), 4) AS accuracy, count(*) FILTER (error_type = 'row_count_error') AS row_count_error FROM v GROUP BY difficulty")
def difficulty_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.difficulty_breakdown(_verdicts(spark, sf_dir))).select("difficulty", "total", "correct", "accuracy", "row_count_error")


@registered("verdict_summary", _VERDICTS + "SELECT count(*) AS total, count(*) FILTER (error_type = 'exact_match') AS correct_count, count(*) FILTER (error_type = 'semantic_match') AS equivalent_count, round(count(*) FILTER (error_type <> 'row_count_error') * 100.0 / count(*), 4) AS correct_rate FROM v")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(report.summary(_verdicts(spark, sf_dir))).select("total", "correct_count", "equivalent_count", "correct_rate")


@registered("verdict_categories", _VERDICTS + "SELECT CASE error_type WHEN 'exact_match' THEN 'correct_exact_match' WHEN 'semantic_match' THEN 'correct_equivalent' ELSE 'incorrect_row_count' END AS category, count(*) AS n FROM v GROUP BY 1")
def verdict_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy(report.category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


@registered("verify_null_ratio", "SELECT count(*) * 2 AS cells, count(*) * 2 - count(d.doc_id) - count(quality) AS null_cells, round((count(*) * 2 - count(d.doc_id) - count(quality)) * 1.0 / (count(*) * 2), 4) AS null_ratio FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def verify_null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return _rounded(verify.null_share(docs.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")))


@registered("verify_duplicates", "SELECT CAST(c_nationkey AS VARCHAR) AS c0, c_mktsegment AS c1, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1")
def verify_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicate_rows(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_mktsegment"))


@registered("rank", "SELECT s_suppkey, CAST(rank() OVER (ORDER BY s_acctbal DESC) AS BIGINT) AS place FROM supplier")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.placed(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_acctbal", "place", descending=True, ties=True).select("s_suppkey", "place")


@registered("agg_over_all", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (), 4) AS above_mean FROM customer")
def agg_over_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of all rows beside each: one row is broadcast, where a window would gather the table."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return customer.crossJoin(F.broadcast(customer.agg(F.avg("c_acctbal").alias("mean")))).select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean"), 4).alias("above_mean"))


# An extra beyond the batch operators.


@registered("event_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


from . import cases, discovery, mixed  # noqa: E402, F401  register their queries

__all__ = ["ORACLE_SQL", "QUERIES", "catalog", "registered"]
