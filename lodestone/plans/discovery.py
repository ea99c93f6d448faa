"""Queries over what is found in the rows of plain files: keys, merged profiles, heavy values; with their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.canonical import canonical
from ..operators import graph, keys, matching, profile, sketches
from ..sources.catalog import KEYS, Catalog
from ..sources.commits import RecordFolder, write_array_parts
from ..sources.scratch import scratch
from ..streaming import rollups
from .registry import _VERDICTS, _rounded, _verdicts, registered

#: Columns of whole numbers and of texts, by table.
_COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey n_regionkey", "n_name"), "customer": ("c_custkey c_nationkey", "c_name c_mktsegment"), "supplier": ("s_suppkey s_nationkey", "s_name"),
    "part": ("p_partkey p_size", "p_name p_brand p_type"), "orders": ("o_orderkey o_custkey", "o_orderstatus o_orderpriority"), "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber", "l_returnflag l_linestatus"),
    "events": ("event_id user_id", "event_type props"), "documents": ("doc_id n_chars", "text lang source"), "embeddings": ("vec_id label", ""), "pages": ("page_id", "url html"), "benchmark": ("item_id", "text"),
    "labels": ("doc_id quality toxic", ""), "conversations": ("conv_id turn", "role text"),
}


def _plain(spark: SparkSession, sf_dir: str) -> Catalog:
    """All tables without any declared key."""
    return Catalog.of_parquet(spark, sf_dir, tuple(KEYS), keys={})


def _sets_sql() -> str:
    """Every distinct value of every column, and every pair of columns that share one, counted."""
    rows = [(t, c, kind) for t, both in _COLUMNS.items() for kind, names in zip("wt", both) for c in names.split()]
    values = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS kind, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, k in rows)
    counts = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n_rows FROM {t}" for t, c, _ in rows)
    return f"""WITH v AS MATERIALIZED ({values}), r AS ({counts}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY t, c),
    k AS (SELECT t, c, n FROM n JOIN r USING (t, c) WHERE n = n_rows),
    met AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.kind = b.kind AND (a.t <> b.t OR a.c <> b.c) JOIN k ON k.t = b.t AND k.c = b.c GROUP BY ALL),
    found AS (SELECT ta AS table_name, ca AS column_name, tb AS referenced_table, cb AS referenced_column, n.n AS distinct_count, n.n - shared AS missing_count, shared AS covered_count, shared / k.n::DOUBLE AS coverage
      FROM met JOIN n ON n.t = ta AND n.c = ca JOIN k ON k.t = tb AND k.c = cb)"""


@registered("inclusion_dependencies", f"{_sets_sql()} SELECT * FROM found WHERE missing_count = 0")
def inclusion_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inclusions of all tables' columns in unique columns, with their coverage."""
    return keys.inclusions(_plain(spark, sf_dir))


@registered("partial_inclusions", f"{_sets_sql()} SELECT * FROM found WHERE missing_count <= 0.25 * distinct_count")
def partial_inclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusions but for a quarter of a column's values, as in tables with orphans."""
    return keys.inclusions(_plain(spark, sf_dir), 0.25)


_FKS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{fk.column}' AS column_name, '{fk.referenced_table}' AS referenced_table, '{fk.referenced_column}' AS referenced_column" for t in KEYS for fk in KEYS[t][1])


@registered("inferred_foreign_keys", f"{_sets_sql()} SELECT table_name, column_name, referenced_table, referenced_column, coverage FROM found JOIN ({_FKS}) USING (table_name, column_name, referenced_table, referenced_column) WHERE missing_count = 0")
def inferred_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The foreign keys that rows and names tell: those that are declared elsewhere, with the share of the keys that they use."""
    found = keys.inferred_coverage(_plain(spark, sf_dir))
    return spark.createDataFrame([(t, fk.column, fk.referenced_table, fk.referenced_column, covered) for t, fk, covered in found], "table_name string, column_name string, referenced_table string, referenced_column string, coverage double")


@registered("orphans_of_inferred_keys", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{fk.column}' AS column_name, '{fk.referenced_table}' AS referenced_table, '{fk.referenced_column}' AS referenced_column, count(*) AS orphan_count FROM {t} c WHERE c.{fk.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {fk.referenced_table} p WHERE p.{fk.referenced_column} = c.{fk.column})" for t in KEYS for fk in KEYS[t][1]))
def orphans_of_inferred_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphan check on plain files, by the keys that were found in them."""
    return profile.orphan_counts(keys.with_inferred_keys(_plain(spark, sf_dir)))


@registered("join_by_inferred_keys", "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_by_inferred_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined along the path that inferred keys give between two tables of plain files."""
    tables = keys.with_inferred_keys(Catalog.of_parquet(spark, sf_dir, ("lineitem", "orders", "customer", "nation", "region"), keys={}))
    rows = graph.join_along(tables, graph.join_path(tables, "lineitem", "region"))
    return rows.groupBy(rows["region_r_name"].alias("r_name")).count().withColumnRenamed("count", "n")


# Profiles from sketches, heavy values


@registered("merged_profile_orders", """SELECT column_name, row_count, null_count, round(min_value, 4) AS min_value, round(max_value, 4) AS max_value, round(avg_value, 4) AS avg_value, round(deviation, 4) AS deviation, true AS distinct_is_close, median_is_close FROM (
    SELECT 'o_orderkey' AS column_name, count(*) AS row_count, count(*) - count(o_orderkey) AS null_count, min(o_orderkey)::DOUBLE AS min_value, max(o_orderkey)::DOUBLE AS max_value, avg(o_orderkey) AS avg_value, stddev_pop(o_orderkey) AS deviation, true AS median_is_close FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), min(o_custkey), max(o_custkey), avg(o_custkey), stddev_pop(o_custkey), true FROM orders
    UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), avg(o_totalprice), stddev_pop(o_totalprice), true FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), NULL, NULL, NULL, NULL, NULL FROM orders
    UNION ALL SELECT 'o_orderdate', count(*), count(*) - count(o_orderdate), NULL, NULL, NULL, NULL, NULL FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), NULL, NULL, NULL, NULL, NULL FROM orders)""")
def merged_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of orders from sketches of two halves; estimates lie within their stated errors of the exact numbers."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    state = reduce(DataFrame.unionAll, [sketches.file_sketches(df.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == i), "orders") for i in (0, 1)])
    exact = profile.column_stats(df, "orders").select("column_name", F.col("distinct_count").alias("exact"))
    merged = sketches.merged(state)
    rows = merged.collect()  # a row for each column; sketches differ from run to run, so they are made once
    found = spark.createDataFrame(rows, merged.schema).join(exact, "column_name")
    medians = {r["column_name"]: r["quantiles"][2] for r in rows if r["quantiles"] is not None}
    ranks = sketches.ranks_hold(df, medians, 0.5, 3 * sketches.RANK_ERROR)
    close = F.abs(F.col("distinct_count") - F.col("exact")) <= 1 + 4 * sketches.DISTINCT_ERROR * F.col("exact")
    rounded = [F.round(c, 4).alias(c) for c in ("min_value", "max_value", "avg_value", "deviation")]
    return found.join(ranks, "column_name", "left").select("column_name", "row_count", "null_count", *rounded, close.alias("distinct_is_close"), F.col("holds").alias("median_is_close"))


_HEAVY = ("l_partkey", "l_suppkey", "l_orderkey", "l_shipdate")
_VALUE = {"l_shipdate": "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"}


@registered("heavy_values_lineitem", " UNION ALL ".join(f"SELECT * FROM (SELECT 'lineitem' AS table_name, '{c}' AS column_name, {_VALUE.get(c, f'{c}::VARCHAR')} AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT 15)" for c in _HEAVY))
def heavy_values_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent values of columns with many, exactly."""
    return sketches.heavy_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "lineitem", list(_HEAVY))


@registered("heavy_words", "SELECT word AS value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 25")
def heavy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words of all documents: few of very many values, so most are never grouped."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"))).alias("word"))
    return sketches.heavy_hitters(words, "word", 25)


# A running evaluation


def _followed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a stream that has followed the verdicts of all orders, written in three parts, the first of them twice."""
    records, folder = scratch(spark, "records"), scratch(spark, "rollup")
    verdicts = _verdicts(spark, sf_dir).withColumn("sequence", F.lit(1).cast("long"))
    for part in (0, 1, 0, 2):
        verdicts.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part).write.mode("append").json(records)
        rollups.start(spark, records, folder, once=True).awaitTermination()
    return folder


@registered("running_summary", _VERDICTS + "SELECT count(*) AS total, count(*) FILTER (error_type = 'exact_match') AS correct_count, count(*) FILTER (error_type = 'semantic_match') AS equivalent_count, round(count(*) FILTER (error_type <> 'row_count_error') * 100.0 / count(*), 4) AS correct_rate FROM v")
def running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollups.running_summary(spark, _followed(spark, sf_dir))).select("total", "correct_count", "equivalent_count", "correct_rate")


@registered("running_difficulties", _VERDICTS + "SELECT difficulty, count(*) AS total, count(*) FILTER (error_type <> 'row_count_error') AS correct, round(count(*) FILTER (error_type <> 'row_count_error') * 100.0 / count(*), 4) AS accuracy FROM v GROUP BY difficulty")
def running_difficulties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rollups.running_difficulties(spark, _followed(spark, sf_dir))).select("difficulty", "total", "correct", "accuracy")


# Columns matched by values that differ in part


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Columns of lineitem, and the same in another order where every twentieth cell of a column is another value."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    row = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    changed = lambda c, i: F.when(row % 20 == i, F.lit("changed")).otherwise(canonical(F.col(c), items.schema[c].dataType)).alias(f"p_{c}")
    gold = items.select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return gold, items.select(*[changed(c, i) for i, c in enumerate(("l_returnflag", "l_quantity", "l_partkey", "l_suppkey"))])


def _text(c: str) -> str:
    return f"(CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE {c}::VARCHAR END)" if c == "l_quantity" else f"{c}::VARCHAR"


_GOLD, _PRED = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), ("l_returnflag", "l_quantity", "l_partkey", "l_suppkey")
_OVERLAPS = f"""WITH a AS ({" UNION ALL ".join(f"SELECT {i} AS a, {_text(c)} AS v, count(*) AS n FROM lineitem GROUP BY v" for i, c in enumerate(_GOLD))}),
    b AS ({" UNION ALL ".join(f"SELECT {i} AS b, CASE WHEN (l_orderkey * 7 + l_linenumber) % 20 = {i} THEN 'changed' ELSE {_text(c)} END AS v, count(*) AS n FROM lineitem GROUP BY v" for i, c in enumerate(_PRED))}),
    s AS (SELECT a, b, sum(least(a.n, b.n))::DOUBLE / (SELECT count(*) FROM lineitem) AS similarity FROM a JOIN b USING (v) GROUP BY a, b)"""


@registered("column_similarities", f"{_OVERLAPS} SELECT a AS gold_column, b AS pred_column, similarity FROM s")
def column_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the values of every pair of columns overlap, over all rows."""
    found = matching.similarities(*_changed(spark, sf_dir))
    return spark.createDataFrame([(i, j, s) for i, row in enumerate(found) for j, s in enumerate(row) if s], "gold_column int, pred_column int, similarity double")


@registered("column_matching", f"{_OVERLAPS} SELECT a AS gold_column, b AS pred_column, similarity FROM s WHERE (a, b) IN ((0, 2), (1, 3), (2, 1), (3, 0))")
def column_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching of the columns: each meets its own, with a twentieth of its cells changed."""
    match = matching.match_columns(*_changed(spark, sf_dir))
    return spark.createDataFrame([(i, j, s) for i, (j, s) in enumerate(zip(match.pairs, match.similarities))], "gold_column int, pred_column int, similarity double")


# Records of several writers


@registered("committed_records", _VERDICTS + "SELECT error_type, count(*) AS n, sum(id)::BIGINT AS ids FROM v GROUP BY error_type")
def committed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of all orders, committed in four parts, one of them twice, then written by many tasks as one array and read again."""
    folder, target = RecordFolder(spark, scratch(spark, "commits")), scratch(spark, "array")
    verdicts = _verdicts(spark, sf_dir)
    for part in (0, 1, 2, 1, 3):
        folder.commit(verdicts.filter(F.pmod(F.xxhash64("id"), F.lit(4)) == part), f"part-{part}")
    write_array_parts(folder.lines(), target)
    lines = spark.read.text(target).select(F.regexp_replace("value", "^,", "").alias("value")).filter("value NOT IN ('[', ']')")
    rows = lines.select(F.from_json("value", "id LONG, error_type STRING").alias("r")).select("r.*")
    return rows.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
