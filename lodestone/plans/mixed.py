"""Queries over columns whose values have several types, and over what SQLite makes of types, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import storage
from ..functions.dialect import Dialect
from .registry import registered


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_orderstatus, v): of each order a whole number, a price, a text, a number as text or nothing."""
    storage.install(spark)
    key = F.col("o_orderkey") % 5
    v = (
        F.when(key == 0, F.col("o_custkey").cast("variant")).when(key == 1, F.col("o_totalprice").cast("variant")).when(key == 2, F.col("o_orderpriority").cast("variant"))
        .when(key == 3, F.col("o_custkey").cast("string").cast("variant"))
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", v.alias("v"))


#: The same in DuckDB: class and value apart.
_MIXED = """m AS (SELECT o_orderkey, o_orderstatus, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN o_custkey::DOUBLE WHEN 1 THEN o_totalprice END AS number, CASE o_orderkey % 5 WHEN 2 THEN o_orderpriority WHEN 3 THEN o_custkey::VARCHAR END AS letters FROM orders)"""


def _shown(v: Column) -> tuple[Column, Column]:
    """A number, or else a text."""
    number = F.when(storage.storage_class(v).isin("integer", "real"), F.try_variant_get(v, "$", "double"))
    return number.alias("number"), F.when(storage.storage_class(v) == "text", F.try_variant_get(v, "$", "string")).alias("letters")


@registered("mixed_classes", f"WITH {_MIXED} SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'integer' WHEN o_orderkey % 5 = 1 THEN 'real' WHEN kind = 2 THEN 'text' ELSE 'null' END AS class, count(*) AS n FROM m GROUP BY 1")
def mixed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).groupBy(storage.storage_class(F.col("v")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_EXTREME = "(SELECT {pick} FROM m x WHERE x.o_orderstatus = m.o_orderstatus AND kind IS NOT NULL ORDER BY kind {d}, number {d}, letters {d} LIMIT 1)"


@registered("mixed_extremes", f"WITH {_MIXED}, s AS (SELECT DISTINCT o_orderstatus FROM orders) SELECT o_orderstatus, {_EXTREME.format(pick='number', d='ASC')} AS least, {_EXTREME.format(pick='letters', d='DESC')} AS greatest FROM s m")
def mixed_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least value of each status is a number, the greatest a text."""
    found = _values(spark, sf_dir).groupBy("o_orderstatus").agg(storage.least_of(F.col("v")).alias("lo"), storage.greatest_of(F.col("v")).alias("hi"))
    return found.select("o_orderstatus", _shown(F.col("lo"))[0].alias("least"), _shown(F.col("hi"))[1].alias("greatest"))


@registered("mixed_comparison", f"""WITH {_MIXED} SELECT count(*) FILTER (kind = 2 OR number > 100) AS above, count(*) FILTER (kind = 1 AND number = 77) AS equal, count(*) FILTER (kind = 2 AND letters > '5') AS above_text,
  count(*) FILTER (kind = 1 AND number <= 77) AS not_above, count(*) FILTER (number = 77 OR letters = '77') AS with_affinity FROM m""")
def mixed_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against literals, and against a column of numbers, whose affinity turns texts into numbers."""
    v, number = F.col("v"), lambda x: F.lit(x).cast("variant")
    holds = {
        "above": storage.compared(v, ">", number(100), storage.BLOB, storage.NONE), "equal": storage.compared(v, "=", number(77), storage.BLOB, storage.NONE),
        "above_text": storage.compared(v, ">", number("5"), storage.BLOB, storage.NONE), "not_above": storage.compared(v, "<=", number(77), storage.BLOB, storage.NONE),
        "with_affinity": storage.compared(v, "=", number(77), storage.BLOB, storage.NUMERIC),
    }
    return _values(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in holds.items()])


@registered("mixed_join", f"WITH {_MIXED} SELECT s_suppkey, count(*) AS n FROM m JOIN supplier ON m.number = s_suppkey OR m.letters = s_suppkey::VARCHAR GROUP BY s_suppkey")
def mixed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several types joined with a column of numbers."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_suppkey").cast("variant").alias("k"))
    rows = storage.joined(_values(spark, sf_dir), suppliers, "v", "k", storage.BLOB, storage.NUMERIC)
    return rows.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@registered("mixed_counts", f"WITH {_MIXED} SELECT number, letters, count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY number, letters")
def mixed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values with their counts; numbers are one value whether whole or not."""
    counts = storage.counted(_values(spark, sf_dir).filter("v IS NOT NULL"), "v")
    return counts.select(*_shown(F.col("v")), "n")


@registered("mixed_statement", f"WITH {_MIXED} SELECT o_orderstatus, count(*) AS n, min(number) AS least FROM m WHERE kind = 2 AND letters < '5' OR kind = 1 AND number BETWEEN 10 AND 5000 GROUP BY o_orderstatus")
def mixed_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over a mixed column, by the SQLite layer."""
    orders = _values(spark, sf_dir)
    orders.createOrReplaceTempView("mixed_orders")
    text = Dialect(spark, {"mixed_orders": orders.schema}).rewrite("SELECT o_orderstatus, COUNT(*) AS n, MIN(v) AS v FROM mixed_orders WHERE v > 9 AND v < '5' AND typeof(v) = 'text' OR v BETWEEN 10 AND 5000 GROUP BY o_orderstatus")
    return spark.sql(text).select("o_orderstatus", "n", _shown(F.col("v"))[0].alias("least"))


def _statement(name: str, sql: str, oracle: str, *tables: str) -> None:
    @registered(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schemas = {}
        for t in tables:
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            df = df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, kind in df.dtypes if kind.startswith("timestamp")})  # times are texts there
            df.createOrReplaceTempView(t)
            schemas[t] = df.schema
        return spark.sql(Dialect(spark, schemas).rewrite(sql))


_statement(
    "dialect_time_modifiers",
    "SELECT o_orderkey, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS last_day, date(o_orderdate, '+10 days') AS later, strftime('%w', o_orderdate) AS weekday, (strftime('%s', o_orderdate) - strftime('%s', '1990-01-01')) / 86400 AS days FROM orders",
    "SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later, dayofweek(o_orderdate)::VARCHAR AS weekday, (epoch(o_orderdate) - epoch(TIMESTAMP '1990-01-01'))::BIGINT // 86400 AS days FROM orders",
    "orders",
)
_statement(
    "dialect_text_against_numbers",
    "SELECT COUNT(*) AS n FROM orders WHERE strftime('%Y', o_orderdate) > 1995 AND o_orderpriority BETWEEN 1 AND 3 AND strftime('%m', o_orderdate) NOT IN (1, 2) AND o_orderkey < 'abc'",
    "SELECT count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority BETWEEN '1' AND '3'",
    "orders",
)
_statement(
    "dialect_substr_any",
    "SELECT c_custkey, substr(c_name, c_nationkey - 5, 4) AS a, substr(c_name, -3, -2) AS b, substr(c_mktsegment, c_nationkey % 7, -2) AS c FROM customer",
    """SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN substring(c_name, c_nationkey - 5, 4) WHEN c_nationkey = 5 THEN substring(c_name, 1, 3)
      WHEN length(c_name) + c_nationkey - 5 >= 0 THEN substring(c_name, length(c_name) + c_nationkey - 4, 4) ELSE '' END AS a, substring(c_name, length(c_name) - 4, 2) AS b,
      CASE WHEN c_nationkey % 7 <= 1 THEN '' WHEN c_nationkey % 7 = 2 THEN substring(c_mktsegment, 1, 1) ELSE substring(c_mktsegment, c_nationkey % 7 - 2, 2) END AS c FROM customer""",
    "customer",
)
