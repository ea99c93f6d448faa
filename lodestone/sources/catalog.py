"""Tables as temporary views with declared keys, and their metadata as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .ddl import Column, ForeignKey, TableDef

#: Declared keys of the driver's tables: primary key, foreign keys.
KEYS: dict[str, tuple[list[str], list[ForeignKey]]] = {
    "region": (["r_regionkey"], []),
    "nation": (["n_nationkey"], [ForeignKey("n_regionkey", "region", "r_regionkey")]),
    "customer": (["c_custkey"], [ForeignKey("c_nationkey", "nation", "n_nationkey")]),
    "supplier": (["s_suppkey"], [ForeignKey("s_nationkey", "nation", "n_nationkey")]),
    "part": (["p_partkey"], []),
    "orders": (["o_orderkey"], [ForeignKey("o_custkey", "customer", "c_custkey")]),
    "lineitem": ([], [ForeignKey("l_orderkey", "orders", "o_orderkey"), ForeignKey("l_partkey", "part", "p_partkey"), ForeignKey("l_suppkey", "supplier", "s_suppkey")]),
    "events": (["event_id"], []),
    "documents": (["doc_id"], []),
    "embeddings": (["vec_id"], []),
    "pages": (["page_id"], []),
    "benchmark": (["item_id"], []),
    "labels": (["doc_id"], [ForeignKey("doc_id", "documents", "doc_id")]),
    "conversations": ([], []),
}
TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_SQL_NAMES = {T.StringType: "TEXT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.LongType: "BIGINT", T.IntegerType: "INT", T.ShortType: "SMALLINT", T.BooleanType: "BOOLEAN", T.TimestampType: "TIMESTAMP", T.DateType: "DATE"}


def sql_type(kind: T.DataType) -> str:
    """The type name under which a Spark type is classified."""
    return _SQL_NAMES.get(type(kind), "DECIMAL" if isinstance(kind, T.DecimalType) else kind.simpleString().upper())


@dataclass
class Catalog:
    """Named DataFrames and what is declared of them."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, TableDef] = field(default_factory=dict)
    name: str = "database"

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, names, keys=None, name: str = "database") -> "Catalog":
        """Tables <folder>/<name>.parquet."""
        found = cls(spark, name=name)
        for table in names:
            found.add(table, spark.read.parquet(f"{folder}/{table}.parquet"), *(KEYS if keys is None else keys).get(table, ([], [])))
        return found

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, keys=None, name: str = "database") -> "Catalog":
        """All tables <folder>/*.parquet, found through Hadoop's file system, so wherever Spark can read."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = sorted(f.getPath().getName().removesuffix(".parquet") for f in files if f.getPath().getName().endswith(".parquet"))
        return cls.of_parquet(spark, folder, names, keys, name)

    def add(self, name: str, df: DataFrame, primary_key=(), foreign_keys=()) -> None:
        """Adds a table; what a DDL file declared before is kept, and equal foreign keys are kept once."""
        declared = self.tables.get(name, TableDef(name))
        columns = [Column(f.name, sql_type(f.dataType), f.nullable) for f in df.schema.fields]
        for c in columns:
            if old := declared.column(c.name):
                c.type, c.default, c.comment, c.nullable = old.type, old.default, old.comment, old.nullable
        key = list(primary_key) or declared.primary_key
        for c in columns:
            c.primary_key = c.name in key
        self.frames[name] = df
        self.tables[name] = TableDef(name, columns, key, list(dict.fromkeys([*declared.foreign_keys, *foreign_keys])), declared.indexes, declared.comment, declared.description)

    def declare(self, definitions: list[TableDef]) -> None:
        """Declared metadata, for tables that are there or will be added."""
        for d in definitions:
            old = self.frames.get(d.name)
            self.tables[d.name] = d
            if old is not None:
                self.add(d.name, old)

    def register(self) -> "Catalog":
        """All tables as temporary views."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)
        return self

    def foreign_keys(self) -> list[tuple[str, ForeignKey]]:
        return [(t, fk) for t in sorted(self.tables) for fk in self.tables[t].foreign_keys]

    # Metadata as DataFrames; each is as small as the schema, but for the counts' one pass over each table.

    def tables_df(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in sorted(self.frames)], "table_name string")

    def columns_df(self) -> DataFrame:
        rows = [(t, c.name, i, c.type, c.nullable, c.default, c.primary_key) for t in sorted(self.tables) for i, c in enumerate(self.tables[t].columns)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, type string, nullable boolean, default_value string, is_primary_key boolean")

    def foreign_keys_df(self) -> DataFrame:
        rows = [(t, fk.column, fk.referenced_table, fk.referenced_column) for t, fk in self.foreign_keys()]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, referenced_table string, referenced_column string")

    def indexes_df(self) -> DataFrame:
        rows = [(t, i.name, i.columns, i.unique, i.primary) for t in sorted(self.tables) for i in self.tables[t].indexes]
        return self.spark.createDataFrame(rows, "table_name string, index_name string, columns array<string>, is_unique boolean, is_primary boolean")

    def row_counts(self) -> DataFrame:
        """(table_name, row_count) of all tables, as one job; Parquet counts come from the footers."""
        parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in sorted(self.frames.items())]
        if not parts:
            return self.spark.createDataFrame([], "table_name string, row_count long")
        return reduce(DataFrame.unionAll, parts)

    def totals(self) -> DataFrame:
        """One row: number of tables, sum of their rows."""
        return self.row_counts().agg(F.count(F.lit(1)).alias("total_tables"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"))
