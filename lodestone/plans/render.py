"""Text renderings of a schema and its profile, for prompts. Tables come in alphabetical order."""

from __future__ import annotations

from datetime import datetime, timezone

from ..sources.catalog import Catalog
from ..sources.ddl import simple_type

#: Limits of the compact form. Fixed values.
SHOWN_DISTINCT, SHOWN_VALUES = 15, 8
HIDDEN_KEYS, HIDDEN_SUFFIXES = ("quality_issue", "orphan_issue"), ("_columns", "_indexes", "_rowcount", "_foreignkeys")


def er_diagram(catalog: Catalog) -> str:
    """A Mermaid entity-relationship diagram; equal relations once."""
    lines = ["erDiagram"]
    for t in sorted(catalog.tables):
        lines.append(f"    {t} {{")
        keys = {fk.column for fk in catalog.tables[t].foreign_keys}
        for c in catalog.tables[t].columns:
            mark = " PK" if c.primary_key else " FK" if c.name in keys else ""
            lines.append(f"        {simple_type(c.type)} {c.name}{mark}")
        lines.append("    }")
    relations = dict.fromkeys((fk.referenced_table, t, fk.column) for t, fk in catalog.foreign_keys())
    lines += [f'    {a} ||--o{{ {b} : "has"' for a, b, _ in relations]
    return "\n".join(lines)


def basic_schema(catalog: Catalog) -> str:
    return "\n".join(f"Table {t}:\n" + "".join(f"  - {c.name}: {c.type}\n" for c in catalog.tables[t].columns) for t in sorted(catalog.tables))


def linking_schema(context: dict, tables: list[str] | None = None) -> str:
    """`t (a*, b) | u (c)`, primary keys starred."""
    parts = []
    for name in chosen(context, tables):
        columns = [c["name"] + ("*" if c["is_primary_key"] else "") for c in context["tables"][name]["columns"]]
        parts.append(f"{name} ({', '.join(columns)})")
    return " | ".join(parts)


def chosen(context: dict, tables: list[str] | None) -> list[str]:
    """The wanted tables that there are; all, if none is named."""
    return [t for t in tables if t in context["tables"]] if tables else sorted(context["tables"])


def format_key(key: str) -> str:
    """snake_case as Title Words; capitals within a word stay."""
    return " ".join(w[:1].upper() + w[1:] for w in key.split("_"))


def business_notes(table: dict, now: datetime | None = None) -> list[str]:
    """Notes that are worth showing, tagged if they are out of date."""
    now, out = now or datetime.now(timezone.utc), []
    for key in sorted(table.get("rich_context") or {}):
        if any(h in key for h in HIDDEN_KEYS) or key.endswith(HIDDEN_SUFFIXES):
            continue
        note, tag = table["rich_context"][key], ""
        if note.get("expires_at"):
            try:
                tag = " [EXPIRED]" if datetime.fromisoformat(note["expires_at"].replace("Z", "+00:00")) < now else ""
            except (ValueError, TypeError):
                tag = ""
        out.append(f"{format_key(key)}: {note['content']}{tag}")
    return out


def inline_stats(stats: dict | None) -> str:
    """Values of a column with few of them, else its range."""
    if not stats:
        return ""
    if 0 < stats["distinct_count"] <= SHOWN_DISTINCT and stats["top_values"]:
        values = [f"{v['value']}({v['count']})" for v in stats["top_values"][:SHOWN_VALUES]]
        if len(stats["top_values"]) > SHOWN_VALUES:
            values.append("...")
        return f" values=[{', '.join(values)}]"
    if stats.get("range"):
        return f" range=[{stats['range']['min']:.0f}..{stats['range']['max']:.0f}]"
    return ""


def compact_prompt(context: dict, tables: list[str] | None = None, columns: bool = True, notes: bool = True, now: datetime | None = None) -> str:
    lines = [f"Database: {context['database_name']}", ""]
    for name in chosen(context, tables):
        t = context["tables"][name]
        lines.append(f"Table {name} ({t['row_count']} rows):")
        target = {}
        for fk in t["foreign_keys"]:
            target.setdefault(fk["column_name"], f" → {fk['referenced_table']}.{fk['referenced_column']}")
        for c in t["columns"] if columns else ():
            lines.append(f"  - {c['name']}: {c['type']}{' [PK]' if c['is_primary_key'] else ''}{target.get(c['name'], '')}{inline_stats(c.get('value_stats'))}")
        if notes and t["quality_issues"]:
            lines.append("  ⚠️ Data Quality Issues:")
            lines += [f"    * [{i['severity']}] {i['table_name']}.{i['column_name']}: {i['description']} → Fix: {i['sql_fix']}" for i in t["quality_issues"]]
        if notes and (own := business_notes(t, now)):
            lines.append("  Business Notes:")
            lines += [f"    * {n}" for n in own]
        lines.append("")
    return "\n".join(lines) + "\n"


def full_prompt(context: dict, tables: list[str] | None = None, now: datetime | None = None) -> str:
    """The long form: headings, columns with comments, keys, indexes, join paths, notes, issues."""
    lines = [f"# Database: {context['database_name']} ({context['database_type']})", ""]
    for name in chosen(context, tables):
        t = context["tables"][name]
        lines += [f"## Table: {name}", f"Rows: {t['row_count']}"]
        lines += [t[k] for k in ("description", "comment") if t.get(k)]
        if t["primary_key"]:
            lines.append(f"Primary key: {', '.join(t['primary_key'])}")
        lines.append("Columns:")
        for c in t["columns"]:
            extra = [] if c["nullable"] else ["NOT NULL"]
            extra += [f"DEFAULT {c['default']}"] if c.get("default") else []
            extra += [c["comment"]] if c.get("comment") else []
            lines.append(f"- {c['name']} {c['type']}{' ' + ', '.join(extra) if extra else ''}{inline_stats(c.get('value_stats'))}")
        lines += [f"Foreign key: {fk['column_name']} → {fk['referenced_table']}.{fk['referenced_column']}" for fk in t["foreign_keys"]]
        lines += [f"Index: {i['name']} ({', '.join(i['columns'])})" for i in t["indexes"]]
        lines += [f"Note: {n}" for n in business_notes(t, now)]
        lines += [f"Issue [{i['severity']}]: {i['column_name']}: {i['description']}" for i in t["quality_issues"]]
        lines.append("")
    if context.get("join_paths") and not tables:
        lines += ["## Join paths", *[f"- {k}: {p['description']} ON {' AND '.join(p['clauses'])}" for k, p in sorted(context["join_paths"].items())]]
    return "\n".join(lines) + "\n"


def table_prompt(context: dict, table: str) -> str:
    return full_prompt(context, [table])


def cross_table_summary(context: dict) -> str:
    """Issues that concern joins: orphans, and whitespace or type mismatches that say so; empty without any."""
    lines = []
    for name in sorted(context["tables"]):
        for i in context["tables"][name]["quality_issues"]:
            if i["type"] == "orphan" or i["type"] in ("whitespace", "type_mismatch") and "JOIN" in i["affected_ops"]:
                lines.append(f"- {name}.{i['column_name']}: {i['description']} → {i['sql_fix']}")
    return "\n".join(["Cross-Table Data Quality Warnings:", *lines]) + "\n" if lines else ""


def table_infos(context: dict) -> dict[str, dict]:
    """What linking needs of each table: columns, foreign keys, the best description there is, its critical issues."""
    out = {}
    for name, t in sorted(context["tables"].items()):
        described = t.get("description") or t.get("comment") or next((v["content"] for k, v in sorted((t.get("rich_context") or {}).items()) if not k.endswith(HIDDEN_SUFFIXES)), "")
        critical = [f"{i['column_name']}({i['type']})" for i in t["quality_issues"] if i["severity"] == "critical"]
        out[name] = {"name": name, "columns": [c["name"] for c in t["columns"]], "foreign_keys": t["foreign_keys"], "description": described, "quality": f"⚠️ Quality: {', '.join(critical)}" if critical else ""}
    return out


def join_paths_text(context: dict) -> str:
    return "\n".join(f"{k}: {p['description']}" for k, p in sorted(context["join_paths"].items()))


def semantics_text(rows: list) -> str:
    """Rows of graph.field_semantics as text."""
    return "\n".join(f"{r['table_name']}.{r['column_name']}: {r['semantic']}" for r in sorted(rows, key=lambda r: (r["table_name"], r["column_name"])))
