"""Foreign keys as a graph: edges, join paths, tables that belong to a selection, meaning of fields."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..sources.catalog import Catalog


def fk_edges(catalog: Catalog) -> DataFrame:
    """(from_table, from_column, to_table, to_column), each foreign key in both directions."""
    fks = catalog.foreign_keys_df()
    there = fks.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), F.col("referenced_table").alias("to_table"), F.col("referenced_column").alias("to_column"))
    back = there.select(F.col("to_table").alias("from_table"), F.col("to_column").alias("from_column"), F.col("from_table").alias("to_table"), F.col("from_column").alias("to_column"))
    return there.union(back).distinct()


def shortest_path(catalog: Catalog, start: str, end: str) -> list[str] | None:
    """Tables on a shortest way along foreign keys; [start] if both are one table, None if there is no way. Schemas are small: no job runs."""
    if start == end:
        return [start]
    neighbours: dict[str, set[str]] = {}
    for t, fk in catalog.foreign_keys():
        neighbours.setdefault(t, set()).add(fk.referenced_table)
        neighbours.setdefault(fk.referenced_table, set()).add(t)
    before, queue = {start: None}, deque([start])
    while queue:
        t = queue.popleft()
        for n in sorted(neighbours.get(t, ())):
            if n not in before:
                before[n] = t
                if n == end:
                    path = [n]
                    while before[path[-1]] is not None:
                        path.append(before[path[-1]])
                    return path[::-1]
                queue.append(n)
    return None


def shortest_path_of(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(path, steps) of the shortest path over edges (from_table, to_table), of several the first by its text; no row if there is none.

    The edges are as many as a schema's foreign keys, so they are searched here, breadth first, each table once.
    """
    neighbours: dict[str, set[str]] = {}
    for r in edges.select("from_table", "to_table").distinct().collect():  # at most two rows for each foreign key
        neighbours.setdefault(r["from_table"], set()).add(r["to_table"])
    paths, steps, seen = {start: start}, 0, {start}
    while end not in paths and paths:
        further: dict[str, str] = {}
        for path, t in sorted((p, t) for t, p in paths.items()):
            for n in neighbours.get(t, set()) - seen:
                further.setdefault(n, f"{path}>{n}")
        paths, steps = further, steps + 1
        seen |= set(paths)
    rows = [(paths[end], steps)] if end in paths else []
    return edges.sparkSession.createDataFrame(rows, "path string, steps int")


@dataclass(frozen=True)
class JoinPath:
    tables: list[str]
    clauses: list[str]
    description: str

    def reversed(self) -> "JoinPath":
        tables = self.tables[::-1]
        return JoinPath(tables, self.clauses[::-1], _described(tables))


def _described(tables: list[str]) -> str:
    if len(tables) < 2:
        return "Same table"
    ends = f"{tables[0]} to {tables[-1]}"
    return f"Direct join from {ends}" if len(tables) == 2 else f"Join from {ends} through {', '.join(tables[1:-1])}"


def join_keys(catalog: Catalog, a: str, b: str) -> tuple[str, str] | None:
    """(column of a, column of b) of the first foreign key between two tables, in either direction."""
    for t, fk in catalog.foreign_keys():
        if (t, fk.referenced_table) == (a, b):
            return fk.column, fk.referenced_column
        if (t, fk.referenced_table) == (b, a):
            return fk.referenced_column, fk.column
    return None


def join_path(catalog: Catalog, start: str, end: str) -> JoinPath | None:
    tables = shortest_path(catalog, start, end)
    if tables is None:
        return None
    clauses = []
    for a, b in zip(tables, tables[1:]):
        x, y = join_keys(catalog, a, b)
        clauses.append(f"{a}.{x} = {b}.{y}")
    return JoinPath(tables, clauses, _described(tables))


def join_along(catalog: Catalog, path: JoinPath) -> DataFrame:
    """The joined tables of a path; columns are named table.column with an underscore."""
    def named(t: str) -> DataFrame:
        df = catalog.frames[t]
        return df.toDF(*[f"{t}_{c}" for c in df.columns])

    out = named(path.tables[0])
    for a, b in zip(path.tables, path.tables[1:]):
        x, y = join_keys(catalog, a, b)
        right = named(b)
        out = out.join(right, out[f"{a}_{x}"] == right[f"{b}_{y}"])
    return out


def all_join_paths(catalog: Catalog) -> dict[tuple[str, str], JoinPath]:
    """Paths between all pairs of tables that are connected, in alphabetical order of the pair."""
    names = sorted(catalog.tables)
    found = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if path := join_path(catalog, a, b):
                found[a, b] = path
    return found


def field_semantics(catalog: Catalog) -> DataFrame:
    """(table_name, column_name, semantic): foreign_key, or for names that end in id: primary_key or id_field. Other fields give no row."""
    fks = catalog.foreign_keys_df().select("table_name", "column_name").distinct().withColumn("fk", F.lit(True))
    columns = catalog.columns_df().join(fks, ["table_name", "column_name"], "left")
    meaning = F.when(F.col("fk"), "foreign_key").when(F.lower("column_name").endswith("id"), F.when(F.col("is_primary_key"), "primary_key").otherwise("id_field"))
    return columns.select("table_name", "column_name", meaning.alias("semantic")).filter("semantic IS NOT NULL")


def with_linked_tables(catalog: Catalog, selected: list[str]) -> list[str]:
    """selected, the tables that they reference, and the tables that hold two or more references to all these; sorted.

    References are counted by foreign key, so two keys to one table count twice.
    """
    chosen = set(selected)
    for t in selected:
        for fk in catalog.tables[t].foreign_keys if t in catalog.tables else ():
            if fk.referenced_table in catalog.tables:
                chosen.add(fk.referenced_table)
    for t in sorted(set(catalog.tables) - chosen):
        if sum(fk.referenced_table in chosen for fk in catalog.tables[t].foreign_keys) >= 2:
            chosen.add(t)
    return sorted(chosen)


def linked_tables_df(catalog: Catalog, selected: list[str]) -> DataFrame:
    """(table_name, reason) of with_linked_tables as joins over the foreign keys; reason: selected, referenced or bridge."""
    spark, fks = catalog.spark, catalog.foreign_keys_df()
    own = spark.createDataFrame([(t,) for t in selected], "table_name string")
    forward = fks.join(F.broadcast(own), "table_name", "left_semi").select(F.col("referenced_table").alias("table_name")).distinct().join(own, "table_name", "left_anti")
    base = own.select("table_name", F.lit("selected").alias("reason")).union(forward.select("table_name", F.lit("referenced")))
    hits = fks.join(base.select(F.col("table_name").alias("referenced_table")), "referenced_table", "left_semi").groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    bridges = hits.filter("n >= 2").select("table_name").join(base, "table_name", "left_anti").select("table_name", F.lit("bridge").alias("reason"))
    return base.union(bridges)


#: A small database is given whole to a one-shot prompt. Tables in all, tables selected.
SMALL_DATABASE, SMALL_SELECTION = 6, 2


def safe_selection(catalog: Catalog, selected: list[str]) -> list[str]:
    if len(catalog.tables) <= SMALL_DATABASE and len(selected) <= SMALL_SELECTION:
        return sorted(catalog.tables)
    return selected


def parse_link_output(text: str) -> tuple[list[str], str]:
    """(tables, context) of a linking answer: TABLES: and CONTEXT: sections, or else the first line's names."""
    text = text.strip()
    if "TABLES:" not in text:
        return [t.strip() for t in text.split("\n")[0].split(",") if t.strip()], ""
    after = text.split("TABLES:", 1)[1]
    context = text.split("CONTEXT:", 1)[1].strip() if "CONTEXT:" in text else ""
    line = after.split("CONTEXT:", 1)[0].strip().split("\n")[0]
    return [t.strip() for t in line.split(",") if t.strip()], context


def resolve_selection(catalog: Catalog, names: list[str]) -> list[str]:
    """Names of a linking answer as tables of the catalog, ignoring case and quotes; `all` means all, `none` none."""
    cleaned = [re.sub(r"[`\"'\[\]]", "", n).strip().lower() for n in names]
    if cleaned == ["all"]:
        return sorted(catalog.tables)
    if cleaned == ["none"]:
        return []
    by_name = {t.lower(): t for t in catalog.tables}
    return list(dict.fromkeys(by_name[n] for n in cleaned if n in by_name))
