"""Tables, keys and indexes of a MySQL or PostgreSQL database over Spark's JDBC reader."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, types as T

from .catalog import Catalog
from .ddl import Column, ForeignKey, Index, TableDef

#: Rows of a table that one partition reads on average, and partitions of a table at most.
PARTITION_ROWS, MOST_PARTITIONS = 1_000_000, 512

#: Types of keys that tables are cut by.
_CUT_BY = (T.IntegerType, T.LongType, T.ShortType, T.DecimalType, T.StringType, T.DateType, T.TimestampType)
#: Words of SQL that tables are named by.
_WORDS = frozenset("all and any as between both by case cast check column constraint create cross current_date default desc distinct end except exists from full grant group having in index inner into is join key left like limit natural not null offset on or order outer primary references right select session_user some table then to union unique user using values when where window with".split())

_OWN = {"mysql": "table_schema = DATABASE()", "postgresql": "table_schema = current_schema()"}

#: Statements for what information_schema and the systems' own catalogs tell, by system.
COLUMNS = "SELECT table_name, column_name, ordinal_position, data_type, is_nullable, column_default FROM information_schema.columns WHERE {own}"
PRIMARY_KEYS = (
    "SELECT k.table_name, k.column_name, k.ordinal_position FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k"
    " ON k.constraint_name = t.constraint_name AND k.table_schema = t.table_schema AND k.table_name = t.table_name WHERE t.constraint_type = 'PRIMARY KEY' AND t.{own}"
)
FOREIGN_KEYS = {
    "mysql": "SELECT table_name, column_name, referenced_table_name AS referenced_table, referenced_column_name AS referenced_column FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL AND {own}",
    "postgresql": "SELECT c.conrelid::regclass::text AS table_name, a.attname AS column_name, c.confrelid::regclass::text AS referenced_table, r.attname AS referenced_column FROM pg_constraint c"
    " CROSS JOIN LATERAL unnest(c.conkey, c.confkey) AS k(own, other) JOIN pg_attribute a ON a.attrelid = c.conrelid AND a.attnum = k.own JOIN pg_attribute r ON r.attrelid = c.confrelid AND r.attnum = k.other"
    " WHERE c.contype = 'f' AND c.connamespace = current_schema()::regnamespace",
}
INDEXES = {
    "mysql": "SELECT table_name, index_name, column_name, seq_in_index AS place, 1 - non_unique AS is_unique, CASE WHEN index_name = 'PRIMARY' THEN 1 ELSE 0 END AS is_primary FROM information_schema.statistics WHERE {own}",
    "postgresql": "SELECT t.relname AS table_name, i.relname AS index_name, a.attname AS column_name, k.place, x.indisunique::int AS is_unique, x.indisprimary::int AS is_primary FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid"
    " JOIN pg_class i ON i.oid = x.indexrelid CROSS JOIN LATERAL unnest(x.indkey) WITH ORDINALITY AS k(attnum, place) JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.attnum WHERE t.relnamespace = current_schema()::regnamespace",
}
VERSION = "SELECT version() AS version"


@dataclass
class JdbcSource:
    """One database. query, if given, takes the place of Spark's reader."""

    spark: SparkSession
    kind: str
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    run: Callable[[str], DataFrame] | None = None
    #: Rows with their place in the order of the key, by the database.
    ranked: str = "SELECT {columns}, ROW_NUMBER() OVER (ORDER BY {columns}) AS place FROM {source}"

    def query(self, sql: str) -> DataFrame:
        return self.run(sql) if self.run else self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.properties).load()

    def _rows(self, sql: str) -> list[dict]:
        """What the database's catalog tells: rows of the size of the schema."""
        return [{k.lower(): v for k, v in r.asDict().items()} for r in self.query(sql.replace("{own}", _OWN[self.kind])).collect()]

    def version(self) -> str:
        return self._rows(VERSION)[0]["version"]

    def definitions(self) -> list[TableDef]:
        """Tables with columns, primary keys, foreign keys and indexes, in alphabetical order."""
        tables: dict[str, TableDef] = {}
        for r in sorted(self._rows(COLUMNS), key=lambda r: (r["table_name"], r["ordinal_position"])):
            own = tables.setdefault(r["table_name"], TableDef(r["table_name"]))
            own.columns.append(Column(r["column_name"], r["data_type"].upper(), r["is_nullable"] == "YES", default=r["column_default"]))
        for r in sorted(self._rows(PRIMARY_KEYS), key=lambda r: (r["table_name"], r["ordinal_position"])):
            if r["table_name"] in tables:
                tables[r["table_name"]].primary_key.append(r["column_name"])
        for r in sorted(self._rows(FOREIGN_KEYS[self.kind]), key=lambda r: tuple(map(str, r.values()))):
            if r["table_name"] in tables:
                tables[r["table_name"]].foreign_keys.append(ForeignKey(r["column_name"], r["referenced_table"], r["referenced_column"]))
        found: dict[tuple[str, str], Index] = {}
        for r in sorted(self._rows(INDEXES[self.kind]), key=lambda r: (r["table_name"], r["index_name"], r["place"])):
            index = found.setdefault((r["table_name"], r["index_name"]), Index(r["index_name"], [], bool(r["is_unique"]), bool(r["is_primary"])))
            index.columns.append(r["column_name"])
        for (table, _), index in found.items():
            if table in tables:
                tables[table].indexes.append(index)
        for t in tables.values():
            for c in t.columns:
                c.primary_key = c.name in t.primary_key
        return list(tables.values())

    def quoted(self, name: str) -> str:
        """A name as the database wants it: in quotes unless it is plain lower case and no word of SQL."""
        if re.fullmatch(r"[a-z_][a-z0-9_]*", name) and name not in _WORDS:
            return name
        return self._quote(name)

    def _quote(self, name: str) -> str:
        mark = "`" if self.kind == "mysql" else '"'
        return mark + name.replace(mark, mark * 2) + mark

    def table(self, name: str, key: str | list[str] | None = None) -> DataFrame:
        """A table; read over many connections if it has a key and more rows than one partition takes.

        One key of whole numbers is cut evenly between its ends. Other keys, of texts, times or several columns, are cut where
        the database says that every so many rows end, so skewed ones read evenly as well.
        """
        source, keys = self.quoted(name), [key] if isinstance(key, str) else list(key or ())
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=source, **self.properties)
        df = reader.load()
        kinds = [df.schema[k].dataType for k in keys]
        if not keys or not all(isinstance(k, _CUT_BY) for k in kinds):
            return df
        if len(keys) > 1 or not isinstance(kinds[0], (T.IntegerType, T.LongType, T.ShortType)):
            bounds = self.bounds(source, keys)
            return self.spark.read.jdbc(self.url, source, predicates=self.predicates(keys, bounds), properties=self.properties) if bounds else df
        column = self._quote(keys[0])
        span = self.query(f"SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT(*) AS n FROM {source}").toDF("lo", "hi", "n").first()
        parts = min(MOST_PARTITIONS, -(-(span["n"] or 0) // PARTITION_ROWS))
        if parts < 2:
            return df
        return reader.options(partitionColumn=keys[0], lowerBound=int(span["lo"]), upperBound=int(span["hi"]) + 1, numPartitions=parts).load()

    def bounds(self, source: str, keys: list[str]) -> list[tuple]:
        """The keys of every so many rows in the order of the key, one for each partition but the first; MOST_PARTITIONS at most."""
        n = self.query(f"SELECT COUNT(*) AS n FROM {source}").toDF("n").first()["n"]
        parts = min(MOST_PARTITIONS, -(-n // PARTITION_ROWS))
        if parts < 2:
            return []
        columns = ", ".join(self._quote(k) for k in keys)
        step = -(-n // parts)
        ordered = self.ranked.format(columns=columns, source=source)
        rows = self.query(f"SELECT {columns} FROM ({ordered}) placed WHERE MOD(place - 1, {step}) = 0 AND place > 1").collect()
        return sorted({tuple(r) for r in rows if None not in tuple(r)})

    def predicates(self, keys: list[str], bounds: list[tuple]) -> list[str]:
        """Conditions that hold each row in exactly one of the parts; keys that are null belong to the first."""

        def literal(v) -> str:
            return str(v) if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

        def from_(bound: tuple) -> str:
            """(a, b, ..) >= bound, column by column."""
            parts = []
            for i, (k, v) in enumerate(zip(keys, bound)):
                same = [f"{self._quote(k2)} = {literal(v2)}" for k2, v2 in zip(keys[:i], bound[:i])]
                parts.append("(" + " AND ".join([*same, f"{self._quote(k)} {'>=' if i == len(keys) - 1 else '>'} {literal(v)}"]) + ")")
            return "(" + " OR ".join(parts) + ")"

        null = " OR ".join(f"{self._quote(k)} IS NULL" for k in keys)
        full = " AND ".join(f"{self._quote(k)} IS NOT NULL" for k in keys)
        edges = [from_(b) for b in bounds]
        return [f"{null} OR NOT {edges[0]}", *(f"{full} AND {a} AND NOT {b}" for a, b in zip(edges, edges[1:])), f"{full} AND {edges[-1]}"]

    def catalog(self, name: str, tables: list[str] | None = None) -> Catalog:
        """The tables (all, if none is named) with all that the database tells of them."""
        found = Catalog(self.spark, name=name)
        definitions = [d for d in self.definitions() if tables is None or d.name in tables]
        found.declare(definitions)
        for d in definitions:
            found.add(d.name, self.table(d.name, d.primary_key), d.primary_key)
        return found


__all__ = ["JdbcSource"]
