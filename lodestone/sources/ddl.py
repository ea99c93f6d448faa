"""CREATE TABLE text as declared metadata: columns, keys, foreign keys. Parquet carries none of these."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_CREATE = re.compile(r"\bCREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?", re.I)
_NAME = r'(?:"([^"]+)"|`([^`]+)`|\[([^\]]+)\]|([\w.$]+))'
_CONSTRAINT = re.compile(r"\s*(?:CONSTRAINT\s+\S+\s+)?(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|KEY|INDEX)\b", re.I)


@dataclass(frozen=True)
class ForeignKey:
    column: str
    referenced_table: str
    referenced_column: str


@dataclass
class Column:
    name: str
    type: str = "TEXT"
    nullable: bool = True
    primary_key: bool = False
    default: str | None = None
    comment: str = ""


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool = False
    primary: bool = False


@dataclass
class TableDef:
    name: str
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    comment: str = ""
    description: str = ""

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


def strip_comments(sql: str) -> str:
    """SQL without -- and /* */ comments; quoted text is left alone."""
    out, at = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", sql, re.S):
        out.append(sql[at : m.start()])
        out.append(" " if m[0].startswith(("--", "/*")) else m[0])
        at = m.end()
    return "".join(out) + sql[at:]


def split_items(body: str) -> list[str]:
    """The comma-separated items of a list, at parenthesis depth 0 and outside quotes."""
    items, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            items.append(body[start:i].strip())
            start = i + 1
    items.append(body[start:].strip())
    return [x for x in items if x]


def _body(sql: str, at: int) -> tuple[str, int]:
    """What stands within the parentheses that open at `at`, at any depth."""
    depth, quote = 0, ""
    for i in range(at, len(sql)):
        c = sql[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return sql[at + 1 : i], i + 1
    return sql[at + 1 :], len(sql)


def _names(text: str) -> list[str]:
    return [next(g for g in m.groups() if g) for m in re.finditer(_NAME, text)]


_REFERENCES = re.compile(r"\bREFERENCES\s+" + _NAME + r"\s*(?:\(([^)]*)\))?", re.I)


def parse_ddl(sql: str) -> list[TableDef]:
    """All CREATE TABLE statements of a script. Foreign keys are kept once, whether inline or as table constraints."""
    sql, tables = strip_comments(sql), []
    for m in _CREATE.finditer(sql):
        name = re.compile(_NAME).match(sql, m.end())
        opening = sql.find("(", name.end()) if name else -1
        if opening < 0:
            continue
        table = TableDef(next(g for g in name.groups() if g).split(".")[-1])
        for item in split_items(_body(sql, opening)[0]):
            _item(table, item)
        for c in table.columns:
            if c.primary_key and c.name not in table.primary_key:
                table.primary_key.append(c.name)
        for key in table.primary_key:
            if c := table.column(key):
                c.primary_key = True
        table.foreign_keys = list(dict.fromkeys(table.foreign_keys))
        tables.append(table)
    return tables


def _item(table: TableDef, item: str) -> None:
    if m := _CONSTRAINT.match(item):
        kind = re.sub(r"\s+", " ", m[1].upper())
        opening = item.find("(", m.end())
        names = _names(_body(item, opening)[0]) if opening >= 0 else []
        if kind == "PRIMARY KEY":
            table.primary_key += [n for n in names if n not in table.primary_key]
        elif kind == "FOREIGN KEY" and (ref := _REFERENCES.search(item)):
            target = next(g for g in ref.groups()[:4] if g)
            columns = _names(ref[5]) if ref[5] else names
            table.foreign_keys += [ForeignKey(a, target, b) for a, b in zip(names, columns)]
        return
    name = re.match(_NAME, item)
    if not name:
        return
    rest = item[name.end() :].strip()
    kind = re.match(r"[A-Za-z_][\w ]*?(?:\s*\([^)]*\))?(?=\s+(?:NOT|NULL|PRIMARY|UNIQUE|DEFAULT|REFERENCES|CHECK|COLLATE|AUTOINCREMENT|CONSTRAINT|GENERATED|COMMENT)\b|\s*$)", rest, re.I)
    default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\S+)", rest, re.I)
    own = next(g for g in name.groups() if g)
    table.columns.append(Column(own, (kind[0].strip().upper() if kind else "TEXT"), not re.search(r"\bNOT\s+NULL\b", rest, re.I), bool(re.search(r"\bPRIMARY\s+KEY\b", rest, re.I)), default[1] if default else None))
    if ref := _REFERENCES.search(rest):
        columns = _names(ref[5]) if ref[5] else [own]
        table.foreign_keys.append(ForeignKey(own, next(g for g in ref.groups()[:4] if g), columns[0]))


# Classification of type names. The substrings below.
TEXT_TYPES = ("TEXT", "VARCHAR", "CHAR", "CLOB", "STRING")
NUMERIC_TYPES = ("INT", "REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL")


def is_text_type(name: str) -> bool:
    return any(t in name.upper() for t in TEXT_TYPES)


def is_numeric_type(name: str) -> bool:
    return any(t in name.upper() for t in NUMERIC_TYPES)


def simple_type(name: str) -> str:
    """int, string, text, float, datetime, boolean; string for others."""
    upper = name.upper()
    for short, marks in (("int", ("INT",)), ("string", ("CHAR",)), ("text", ("TEXT", "CLOB")), ("float", ("REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL")), ("datetime", ("DATE", "TIME")), ("boolean", ("BOOL",))):
        if any(m in upper for m in marks):
            return short
    return "string"
