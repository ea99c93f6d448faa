"""Operations on SQL text: as column expressions where tables of statements are handled, else as plain functions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F


def normalize_sql(sql: Column) -> Column:
    """Lower case, one closing semicolon off, white space collapsed. Literals are put in lower case as well."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sql), ";$", ""), r"\s+", " "))


def normalize_sql_text(sql: str) -> str:
    return " ".join(sql.lower().removesuffix(";").split())


def is_give_up(sql: Column) -> Column:
    """Empty, a comment, a constant placeholder, or neither SELECT nor WITH."""
    s = F.upper(F.trim(F.coalesce(sql, F.lit(""))))
    return s.startswith("--") | s.startswith("/*") | s.rlike(r"^SELECT (0|1|NULL);?$") | ~s.rlike("^(SELECT|WITH)")


def is_give_up_text(sql: str) -> bool:
    s = sql.strip().upper()
    return s.startswith(("--", "/*")) or s.rstrip(";") in ("SELECT 0", "SELECT 1", "SELECT NULL") or not s.startswith(("SELECT", "WITH"))


#: Openings of explanations that end a statement. Fixed values.
PROSE = ("This ", "The ", "Since ", "Note:")
FALLBACK_PROSE = ("This ", "The ", "Note:", "Thought:")


def _until_prose(lines: list[str], openings: tuple[str, ...], blank_ends: bool) -> str:
    kept: list[str] = []
    for line in lines:
        s = line.strip()
        if s.startswith(openings) or blank_ends and not s and kept:
            break
        kept.append(line)
    return "\n".join(kept).strip()


def fallback_sql(text: str) -> str:
    """The last SELECT of a text, up to an empty line or an explanation; empty if there is none worth running."""
    at = text.upper().rfind("SELECT ")
    if at < 0:
        return ""
    sql = _until_prose(text[at:].strip().split("\n"), FALLBACK_PROSE, True).removesuffix(";").strip()
    return "" if is_give_up_text(sql) else sql


def extract_sql(text: str) -> str:
    """The statement in a model's answer; `SELECT 1` if there is none."""
    text = text.partition("Final Answer:")[2] if "Final Answer:" in text else text
    text = re.sub(r"^```(?:sql)?", "", text.strip()).removesuffix("```").strip()
    if (m := re.search(r"`([^`]*)`", text)) and re.search(r"`(SELECT|select)", text):
        text = m[1]
    lines = text.split("\n")
    if len(lines) > 1 and lines[0].strip().upper().startswith(("SELECT", "WITH", "INSERT", "UPDATE", "DELETE")):
        text = _until_prose(lines, PROSE, False)
    sql = text.strip()
    return (fallback_sql(text) or "SELECT 1") if is_give_up_text(sql) else sql


def illegal_alias(sql: Column) -> Column:
    """The first alias that looks like a call, as in AS count(*); null if there is none. CAST(x AS VARCHAR(10)) counts as one too."""
    found = F.regexp_extract(sql, r"(?i)\bAS\s+(\w+\s*\()", 1)
    return F.when(found != "", found)


def paren_balance(sql: Column) -> Column:
    """Opening minus closing parentheses, quoted ones included."""
    return F.length(F.regexp_replace(sql, r"[^(]", "")) - F.length(F.regexp_replace(sql, r"[^)]", ""))


def parens_balanced(sql: Column) -> Column:
    """Whether parentheses balance and none closes before it opens."""
    marks = F.split(F.regexp_replace(sql, r"[^()]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return F.aggregate(marks, start, step, lambda acc: acc["ok"] & (acc["depth"] == 0))


def is_limit_one(sql: Column, compatible: bool = False) -> Column:
    """Whether the text has LIMIT 1; in the compatible form LIMIT 10 counts as well."""
    return F.upper(sql).contains(" LIMIT 1") if compatible else sql.rlike(r"(?i)\sLIMIT\s+1\b(?!\s*,)")


def remove_limit_one(sql: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(sql), r"(?i)\s+LIMIT\s+1\s*;?\s*$", ""))


def query_type(sql: Column) -> Column:
    """Which metadata a statement asks for, from its text; null for others. Any COUNT(*) counts as rowcount."""
    s = F.upper(sql)
    return (
        F.when(s.contains("TABLE_INFO") | s.contains("DESCRIBE") | s.contains("INFORMATION_SCHEMA.COLUMNS"), "columns")
        .when(s.contains("INDEX_LIST") | s.contains("SHOW INDEX") | s.contains("PG_INDEXES"), "indexes")
        .when(s.contains("COUNT(*)"), "rowcount")
        .when(s.contains("FOREIGN_KEY") | s.contains("TABLE_CONSTRAINTS") | s.contains("SHOW CREATE TABLE"), "foreignkeys")
    )


def query_type_text(sql: str) -> str | None:
    """query_type() of one statement."""
    s = sql.upper()
    marks = {"columns": ("TABLE_INFO", "DESCRIBE", "INFORMATION_SCHEMA.COLUMNS"), "indexes": ("INDEX_LIST", "SHOW INDEX", "PG_INDEXES"), "rowcount": ("COUNT(*)",), "foreignkeys": ("FOREIGN_KEY", "TABLE_CONSTRAINTS", "SHOW CREATE TABLE")}
    return next((kind for kind, words in marks.items() if any(w in s for w in words)), None)


def parse_verdict(text: str) -> tuple[str, str]:
    """(verdict, explanation) of a model's answer: JSON, JSON within text, or a keyword."""
    text = re.sub(r"^```(?:json)?", "", text.strip()).removesuffix("```").strip()
    inner = text[text.find("{") : text.rfind("}") + 1]
    for candidate in (text, inner):
        try:
            got = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(got, dict):
            return str(got.get("verdict", "")), str(got.get("explanation", ""))
    for keyword in ("PRED_BETTER", "GOLD_SUSPICIOUS"):
        if keyword in text.upper():
            return keyword, text
    return "GOLD_CORRECT", text


def format_brief(header: list[str], rows: list[list[str]], most: int = 5) -> str:
    """Rows as a short table in text, `(empty)` without header and rows."""
    if not header and not rows:
        return "(empty)"
    lines = ["| " + " | ".join(r) + " |" for r in [header, *rows[:most]]]
    if len(rows) > most:
        lines.append(f"... and {len(rows) - most} more rows")
    return "\n".join(lines) + "\n"
