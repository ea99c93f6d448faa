"""Where SQL runs: Parquet folders or a JDBC database, behind one interface."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import scaling
from ..functions.dialect import Dialect
from .catalog import Catalog
from .jdbc import JdbcSource


class UnsupportedDatabaseError(ValueError):
    def __init__(self, kind: str):
        super().__init__(f"unsupported database type: {kind}")
        self.kind = kind


class DatabaseConnectionError(RuntimeError):
    """The data could not be opened; judged as db_connection_error, not as an error of the SQL."""


@dataclass
class QueryOutcome:
    """A lazy result, or the error that its analysis raised. Nothing has run yet."""

    df: DataFrame | None
    error: str | None = None
    elapsed_ms: int = 0

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []


class SparkAdapter:
    """Runs SQL on the temporary views of a catalog; sqlite-style text goes through the dialect layer first."""

    kind = "spark"

    def __init__(self, catalog: Catalog, dialect: bool = False):
        self.catalog, self.spark = catalog, catalog.spark
        self.dialect = Dialect(catalog.spark, {n: df.schema for n, df in catalog.frames.items()}) if dialect else None
        catalog.register()

    def query(self, sql: str) -> QueryOutcome:
        began = time.time()
        try:
            df = scaling.run(self.spark, self.dialect.rewrite(sql) if self.dialect else sql)
            return QueryOutcome(unique_columns(df), None, int(1000 * (time.time() - began)))
        except Exception as e:  # analysis or parse errors become data
            return QueryOutcome(None, str(e).splitlines()[0] if str(e) else type(e).__name__, int(1000 * (time.time() - began)))

    def dry_run(self, sql: str) -> str | None:
        """None if the SQL analyzes, else the error. Nothing runs; EXPLAIN would return bad SQL's error as a row."""
        return self.query(sql).error

    def version(self) -> str:
        return self.spark.version


class JdbcAdapter(SparkAdapter):
    """Tables of MySQL or PostgreSQL over Spark's JDBC reader (the driver's jar must be there), with the keys and indexes that the
    database itself tells. Without a list of tables: all of them."""

    def __init__(self, spark: SparkSession, kind: str, host: str, port: int, database: str, user: str, password: str, tables: list[str] | None = None, sslmode: str = "disable"):
        self.kind = kind
        self.source = JdbcSource(spark, kind, jdbc_url(kind, host, port, database, sslmode), {"user": user, "password": password})
        try:
            catalog = self.source.catalog(database, tables)
        except Exception as e:
            raise DatabaseConnectionError(f"database connection error: {str(e).splitlines()[0]}") from e
        super().__init__(catalog)

    def version(self) -> str:
        """The database's own version."""
        return self.source.version()


def jdbc_url(kind: str, host: str, port: int, database: str, sslmode: str = "disable") -> str:
    if kind == "mysql":
        return f"jdbc:mysql://{host}:{port}/{database}"
    return f"jdbc:postgresql://{host}:{port}/{database}?sslmode={sslmode}"


def open_adapter(spark: SparkSession, kind: str, **config):
    """Adapter by database type: `parquet` (folder, tables), `sqlite` (the same with the sqlite dialect), `mysql`, `postgresql`."""
    if kind in ("parquet", "sqlite"):
        try:
            catalog = Catalog.of_parquet(spark, config["folder"], config["tables"], config.get("keys"), config.get("name", "database"))
        except Exception as e:
            raise DatabaseConnectionError(f"database connection error: {str(e).splitlines()[0]}") from e
        return SparkAdapter(catalog, dialect=kind == "sqlite")
    if kind in ("mysql", "postgresql"):
        return JdbcAdapter(spark, kind, **config)
    raise UnsupportedDatabaseError(kind)


def unique_columns(df: DataFrame) -> DataFrame:
    """df with repeated output names told apart by a suffix, ignoring case."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if n == 1 else f"{c}_{n}")
    return df.toDF(*names) if names != df.columns else df
