"""Column statistics and quality rules of tables.

One aggregation per table yields all scalar statistics of all its columns; distinct counts read each column once more,
alone; top values come from one grouping over the unpivoted columns that have few values; each foreign key takes one
anti-join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.canonical import canonical
from ..sources.catalog import Catalog
from ..sources.ddl import ForeignKey, is_numeric_type, is_text_type

#: Rules' limits. Fixed values.
EXAMPLES = 3
MISMATCH_LEAST, MISMATCH_RATIO = 5, 0.8
NULL_HEAVY = 50.0
LOW_CARDINALITY, TOP_VALUES = 30, 15
#: Longer values are counted by their digest.
DIGEST_LENGTH = 32

ISSUE = "table_name string, column_name string, type string, severity string, description string, sql_fix string, affected_ops array<string>, examples array<string>"


@dataclass(frozen=True)
class Profiled:
    """A column to profile, with the type under which it is classified."""

    name: str
    type: str

    @property
    def text(self) -> bool:
        return is_text_type(self.type)

    @property
    def numeric(self) -> bool:
        return is_numeric_type(self.type)


def quoted(name: str) -> str:
    """An identifier in double quotes, for the fixes that are shown."""
    return '"' + name.replace('"', '""') + '"'


def ticked(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_looking(c: Column) -> Column:
    """Starts with a digit and holds no letter: also dates and times, but neither -5 nor .5."""
    return c.rlike("^[0-9]") & ~c.rlike("[a-zA-Z]")


def _columns(df: DataFrame, types: dict[str, str] | None) -> list[Profiled]:
    from ..sources.catalog import sql_type

    atomic = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    return [Profiled(f.name, (types or {}).get(f.name, sql_type(f.dataType))) for f in atomic]


def column_stats(df: DataFrame, table: str, types: dict[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: row_count, null_count, null_percent, distinct_count, empty_count, whitespace_count, filled_count,
    numeric_looking_count, min_value, max_value, avg_value (the last three for numbers only).

    One pass for the sums, and each column once more for exact distinct counts (not if approximate). An empty table gives rows of
    zeros; arrays, maps, structs and binary columns are left out.
    """
    columns = _columns(df, types)
    if not columns:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, row_count long, null_count long, null_percent double, distinct_count long, empty_count long, whitespace_count long, filled_count long, numeric_looking_count long, min_value double, max_value double, avg_value double")
    sums = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = ticked(c.name)
        sums.append(F.count(x).alias(f"set{i}"))
        if approximate:
            sums.append(F.approx_count_distinct(x).alias(f"distinct{i}"))
        if c.text:
            s = x.cast("string")
            sums += [F.count_if(s == "").alias(f"empty{i}"), F.count_if(s != F.trim(s)).alias(f"space{i}"), F.count_if(s != "").alias(f"filled{i}"), F.count_if(numeric_looking(s)).alias(f"looks{i}")]
        if c.numeric:
            sums += [f(x.cast("double")).alias(f"{f.__name__}{i}") for f in (F.min, F.max, F.avg)]
    null = F.lit(None).cast("double")

    def of(i: int, c: Profiled) -> Column:
        text = lambda name: F.col(f"{name}{i}") if c.text else F.lit(0).cast("long")
        number = lambda name: F.col(f"{name}{i}") if c.numeric else null
        missing = F.col("n") - F.col(f"set{i}")
        return F.struct(
            F.lit(c.name).alias("column_name"), F.lit(i).alias("ordinal"), F.col("n").alias("row_count"), missing.alias("null_count"),
            F.coalesce(F.try_divide(missing * 100.0, F.col("n")), F.lit(0.0)).alias("null_percent"),
            (F.col(f"distinct{i}") if approximate else F.lit(0).cast("long")).alias("distinct_count"),
            text("empty").alias("empty_count"), text("space").alias("whitespace_count"), text("filled").alias("filled_count"), text("looks").alias("numeric_looking_count"),
            number("min").alias("min_value"), number("max").alias("max_value"), number("avg").alias("avg_value"),
        )

    one = df.agg(*sums)
    stats = one.select(F.explode(F.array(*[of(i, c) for i, c in enumerate(columns)])).alias("s")).select(F.lit(table).alias("table_name"), "s.*")
    if not approximate:
        distinct = distinct_counts(df, columns)
        stats = stats.join(F.broadcast(distinct), "column_name", "left").withColumn("distinct_count", F.coalesce("_d", F.lit(0).cast("long"))).drop("_d")  # a row for each column
    return stats.orderBy("ordinal").select("table_name", "column_name", "row_count", "null_count", "null_percent", "distinct_count", "empty_count", "whitespace_count", "filled_count", "numeric_looking_count", "min_value", "max_value", "avg_value")


def _reads_only(df: DataFrame) -> bool:
    """Whether a frame is no more than columns and filters of one source."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.children().isEmpty()


def distinct_counts(df: DataFrame, columns: list[Profiled]) -> DataFrame:
    """(column_name, _d): the exact number of distinct non-null values. Long texts are shuffled as their MD5.

    From a file each column is read alone and grouped by its own type; what is costly to compute again is computed once,
    with one row for each column of a row.
    """
    def key(c: Profiled) -> Column:
        x = ticked(c.name)
        return F.when(F.length(x) > DIGEST_LENGTH, F.md5(x.cast("binary"))).otherwise(x) if isinstance(df.schema[c.name].dataType, T.StringType) else x

    if _reads_only(df):
        parts = [df.select(key(c).alias("v")).filter("v IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("_d")).select(F.lit(c.name).alias("column_name"), "_d") for c in columns]
        return reduce(DataFrame.unionAll, parts)
    one = df.agg(*[F.count_distinct(key(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.col(f"d{i}").alias("_d")) for i, c in enumerate(columns)])).alias("p")).select("p.*")


def value_counts(df: DataFrame, columns: list[Profiled] | list[str]) -> DataFrame:
    """(column_name, value, n) for each distinct non-null value of the columns, in canonical text: one grouping for all of them."""
    names = [c if isinstance(c, str) else c.name for c in columns]
    pairs = [F.struct(F.lit(n).alias("column_name"), canonical(ticked(n), df.schema[n].dataType).alias("value")) for n in names]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("value IS NOT NULL")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, table: str, columns: list[str], most_distinct: int = LOW_CARDINALITY, top: int = TOP_VALUES) -> DataFrame:
    """(table_name, column_name, value, value_count, percent, position) of columns with few distinct values; ties go to the smaller value.

    percent is of all rows. Columns beyond most_distinct give no row; those that a sketch finds far beyond are not grouped at all.
    """
    sketch = df.agg(*[F.approx_count_distinct(ticked(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first() if columns else None
    columns = [c for i, c in enumerate(columns) if sketch[f"d{i}"] <= 4 * most_distinct]
    if not columns:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, value string, value_count long, percent double, position int")
    counts = value_counts(df, columns)
    few = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= most_distinct).select("column_name")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    best = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    kept = counts.join(F.broadcast(few), "column_name")  # a row for each column
    ranked = kept.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= top)
    return ranked.crossJoin(F.broadcast(total)).select(F.lit(table).alias("table_name"), "column_name", "value", F.col("n").alias("value_count"), (F.col("n") * 100.0 / F.col("total")).alias("percent"), "position")  # one row


def orphan_counts(catalog: Catalog) -> DataFrame:
    """(table_name, column_name, referenced_table, referenced_column, orphan_count) for each declared foreign key; null keys are no orphans."""
    parts = [orphans(catalog.frames[t], fk, catalog.frames[fk.referenced_table]).agg(F.count(F.lit(1)).alias("orphan_count")).select(F.lit(t).alias("table_name"), F.lit(fk.column).alias("column_name"), F.lit(fk.referenced_table).alias("referenced_table"), F.lit(fk.referenced_column).alias("referenced_column"), "orphan_count") for t, fk in catalog.foreign_keys() if t in catalog.frames and fk.referenced_table in catalog.frames]
    if not parts:
        return catalog.spark.createDataFrame([], "table_name string, column_name string, referenced_table string, referenced_column string, orphan_count long")
    return reduce(DataFrame.unionAll, parts)


def orphans(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """(key) of the child's rows whose key is not in the parent."""
    keys = child.select(ticked(fk.column).alias("key")).filter("key IS NOT NULL")
    return keys.join(parent.select(ticked(fk.referenced_column).alias("parent_key")), F.col("key") == F.col("parent_key"), "left_anti")


def whitespace_examples(df: DataFrame, columns: list[str], most: int = EXAMPLES) -> DataFrame:
    """(column_name, examples): the `most` least values with blanks at an end. Each partition passes on no more than its own `most`."""
    pairs = [F.struct(F.lit(n).alias("column_name"), ticked(n).cast("string").alias("value")) for n in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter(F.col("value") != F.trim("value"))

    def least(batches):
        import pyarrow as pa

        kept: dict[str, list[str]] = {}
        for batch in batches:
            found: dict[str, set[str]] = {}
            for name, value in zip(batch.column("column_name").to_pylist(), batch.column("value").to_pylist()):
                found.setdefault(name, set()).add(value)
            for name, values in found.items():
                kept[name] = sorted(values.union(kept.get(name, ())), key=str.encode)[:most]
        rows = [(name, value) for name, values in kept.items() for value in values]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["column_name", "value"])

    few = long.mapInArrow(least, "column_name string, value string").distinct()
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).filter(F.col("r") <= most)
    return first.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("examples"))


def _issue(kind: str, severity: str, description: Column, fix: Column, ops: list[str]) -> list[Column]:
    return [F.lit(kind).alias("type"), F.lit(severity).alias("severity"), description.alias("description"), fix.alias("sql_fix"), F.array(*[F.lit(o) for o in ops]).alias("affected_ops")]


def quality_issues(stats: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Issues that follow from column_stats: whitespace, type_mismatch (critical), null_heavy, empty_string (warning).

    Empty tables have none. Counts are exact.
    """
    name = F.concat(F.lit('"'), F.replace("column_name", F.lit('"'), F.lit('""')), F.lit('"'))
    long = F.col("column_name")
    ratio = F.try_divide(F.col("numeric_looking_count").cast("double"), F.col("filled_count"))
    rules = [
        (F.col("whitespace_count") > 0, _issue("whitespace", "critical", F.concat(F.lit("Contains values with leading or trailing whitespace ("), F.col("whitespace_count").cast("string"), F.lit(" rows)")), F.concat(F.lit("TRIM("), name, F.lit(")")), ["JOIN", "WHERE", "GROUP BY"])),
        ((F.col("filled_count") >= MISMATCH_LEAST) & (ratio >= MISMATCH_RATIO), _issue("type_mismatch", "critical", F.concat(F.lit("Text column stores numeric values ("), F.round(ratio * 100).cast("int").cast("string"), F.lit("%)")), F.concat(F.lit("CAST("), name, F.lit(" AS REAL)")), ["ORDER BY", "WHERE", "SUM", "AVG"])),
        (F.col("null_percent") > NULL_HEAVY, _issue("null_heavy", "warning", F.concat(F.round("null_percent").cast("int").cast("string"), F.lit("% NULL values ("), F.col("null_count").cast("string"), F.lit("/"), F.col("row_count").cast("string"), F.lit(")")), F.concat(F.lit("WHERE "), name, F.lit(" IS NOT NULL")), ["WHERE", "JOIN", "GROUP BY"])),
        (F.col("empty_count") > 0, _issue("empty_string", "warning", F.concat(F.lit("Contains "), F.col("empty_count").cast("string"), F.lit(" empty string values in addition to NULLs")), F.concat(F.lit("WHERE "), name, F.lit(" IS NOT NULL AND "), name, F.lit(" != ''")), ["WHERE", "GROUP BY"])),
    ]
    fired = F.array_compact(F.array(*[F.when((F.col("row_count") > 0) & when, F.struct(*columns)) for when, columns in rules]))
    issues = stats.select("table_name", long, F.explode(fired).alias("i")).select("table_name", "column_name", "i.*")
    if examples is not None:
        issues = issues.join(examples, "column_name", "left").withColumn("examples", F.when(F.col("type") == "whitespace", F.col("examples")))
    else:
        issues = issues.withColumn("examples", F.lit(None).cast("array<string>"))
    return issues.select("table_name", "column_name", "type", "severity", "description", "sql_fix", "affected_ops", "examples")


def orphan_issues(counts: DataFrame) -> DataFrame:
    target = F.concat("referenced_table", F.lit("."), "referenced_column")
    fix = F.concat(F.lit("JOIN "), "referenced_table", F.lit(" ON "), "table_name", F.lit("."), "column_name", F.lit(" = "), target)
    issue = _issue("orphan", "warning", F.concat(F.col("orphan_count").cast("string"), F.lit(" rows have no match in "), target), fix, ["JOIN"])
    return counts.filter("orphan_count > 0").select("table_name", "column_name", *issue, F.lit(None).cast("array<string>").alias("examples"))


@dataclass
class TableProfile:
    stats: DataFrame
    top: DataFrame
    issues: DataFrame


def profile_table(catalog: Catalog, table: str, approximate: bool = False) -> TableProfile:
    """Statistics, top values of columns with few values, and issues (orphans are per foreign key, in orphan_counts)."""
    df, declared = catalog.frames[table], catalog.tables[table]
    types = {c.name: c.type for c in declared.columns}
    stats = column_stats(df, table, types, approximate)
    names = [c.name for c in _columns(df, types)]
    text = [c.name for c in _columns(df, types) if c.text]
    return TableProfile(stats, top_values(df, table, names), quality_issues(stats, whitespace_examples(df, text) if text else None))
