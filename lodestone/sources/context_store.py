"""The profiled context of a database as one nested document, written and read as JSON."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import all_join_paths
from ..operators.profile import orphan_counts, orphan_issues, profile_table
from ..plans.render import er_diagram
from .catalog import Catalog


def coerce_note(note) -> dict:
    """A note is either plain text or {content, expires_at}."""
    if isinstance(note, str):
        return {"content": note, "expires_at": None}
    return {"content": note.get("content", ""), "expires_at": note.get("expires_at") or None}


def coerce_notes(notes: DataFrame, column: str = "note") -> DataFrame:
    """The same for a column of JSON text: content and expires_at."""
    parsed = F.from_json(column, "content STRING, expires_at STRING")
    plain = F.when(F.col(column).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), column, F.lit("}")), "v STRING")["v"]).otherwise(F.col(column))
    return notes.withColumns({"content": F.coalesce(parsed["content"], plain), "expires_at": parsed["expires_at"]})


def build_context(catalog: Catalog, notes: dict[str, dict[str, object]] | None = None) -> dict:
    """The whole context. What is collected is of the size of the schema, not of the data."""
    counts = {r["table_name"]: r["row_count"] for r in catalog.row_counts().collect()}
    broken = [r.asDict() for r in orphan_issues(orphan_counts(catalog)).collect()]
    tables = {}
    for name in sorted(catalog.frames):
        declared, found = catalog.tables[name], profile_table(catalog, name)
        stats = {r["column_name"]: r.asDict() for r in found.stats.collect()}
        top: dict[str, list] = {}
        for r in found.top.orderBy("column_name", "position").collect():
            top.setdefault(r["column_name"], []).append({"value": r["value"], "count": r["value_count"], "percent": r["percent"]})
        issues = [r.asDict() for r in found.issues.orderBy("column_name", "type").collect()] if counts[name] else []
        tables[name] = {
            "name": name,
            "comment": declared.comment,
            "description": declared.description,
            "row_count": counts[name],
            "primary_key": declared.primary_key,
            "columns": [
                {"name": c.name, "type": c.type, "nullable": c.nullable, "default": c.default, "is_primary_key": c.primary_key, "comment": c.comment, "value_stats": _stats(stats.get(c.name), top.get(c.name, []))}
                for c in declared.columns
            ],
            "indexes": [vars(i) for i in declared.indexes],
            "foreign_keys": [{"column_name": fk.column, "referenced_table": fk.referenced_table, "referenced_column": fk.referenced_column} for fk in declared.foreign_keys],
            "rich_context": {k: coerce_note(v) for k, v in (notes or {}).get(name, {}).items()},
            "quality_issues": issues + [b for b in broken if b["table_name"] == name],
        }
    paths = {f"{a}->{b}": {"tables": p.tables, "clauses": p.clauses, "description": p.description} for (a, b), p in all_join_paths(catalog).items()}
    return {
        "database_name": catalog.name,
        "database_type": "spark",
        "version": catalog.spark.version,
        "collected_at": datetime.now(timezone.utc).isoformat(),
        "schema_diagram": {"format": "mermaid", "description": "Entity-Relationship Diagram", "content": er_diagram(catalog)},
        "tables": tables,
        "total_tables": len(tables),
        "total_rows": sum(counts.values()),
        "join_paths": paths,
    }


def _stats(s: dict | None, top: list) -> dict | None:
    if s is None:
        return None
    span = None if s["min_value"] is None else {"min": s["min_value"], "max": s["max_value"], "avg": s["avg_value"]}
    return {"distinct_count": s["distinct_count"], "null_count": s["null_count"], "null_percent": s["null_percent"], "empty_count": s["empty_count"], "top_values": top, "range": span}


def save_context(spark: SparkSession, context: dict, path: str) -> None:
    """Writes the document as one JSON file in a folder that Spark reaches."""
    spark.createDataFrame([(json.dumps(context, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_context(spark: SparkSession, path: str) -> dict:
    """Reads a document again; notes come back as {content, expires_at}."""
    context = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    for table in context["tables"].values():
        table["rich_context"] = {k: coerce_note(v) for k, v in (table.get("rich_context") or {}).items()}
    return context
