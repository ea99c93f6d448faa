"""Queries over table data for texts, renderings, verification, comparison, files and runs, with their DuckDB oracles.

What is checked follows from the tables' rows, with rows for which it holds and rows for which it does not.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import sqltext
from ..functions.canonical import canonical_frame, loosely_equal, normalized
from ..operators import audit, compare, graph, judge, report, tasks, verify
from ..sources import context_store, judge_files, sinks
from ..sources.adapters import SparkAdapter
from ..sources.catalog import KEYS, Catalog
from ..sources.ddl import parse_ddl, simple_type
from ..sources.scratch import scratch
from . import render
from .generate import Scripted, infer, link, result_fields
from .registry import _FK_VALUES, _verdicts, _VERDICTS, catalog, registered

SMALL = ("nation", "region", "supplier")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(text.split("\n"))], "n int, line string")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def by_python(f, kind: T.DataType | str):
    """A function of one text on a column, a batch at a time."""
    import pandas as pd

    def apply(texts):
        return texts.map(f)

    apply.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, kind)


# Texts of statements.

#: A statement for each nation, by its key modulo 7.
_FORMS = [
    "concat('SELECT  ', n_name, chr(10), ' FROM t;')", "concat('-- ', n_name)", "concat('SELECT count(', n_name, ' AS f(x) FROM t ORDER BY a LIMIT 1')", "'select 1;'",
    "concat('SELECT a FROM t ORDER BY (', n_name, ') LIMIT 10')", "concat('WITH x AS (SELECT 2) SELECT ', n_name, ' FROM x limit 1 ; ')", "concat(')', n_name, '( SELECT COUNT(*) FROM pg_indexes')",
]
_FORM = "CASE n_nationkey % 7 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"
_STATEMENTS = f"WITH s AS (SELECT n_nationkey AS id, {_FORM} AS s FROM nation) "


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", f"{_FORM} AS s")


@registered("normalize_sql", _STATEMENTS + r"SELECT id, trim(regexp_replace(regexp_replace(lower(s), ';$', ''), '\s+', ' ', 'g')) AS sql FROM s")
def normalize_sql(spark, sf_dir):
    return _statements(spark, sf_dir).select("id", sqltext.normalize_sql(F.col("s")).alias("sql"))


@registered("sql_give_up", _STATEMENTS + "SELECT id, id % 7 IN (1, 3, 6) AS gives_up FROM s")
def sql_give_up(spark, sf_dir):
    return _statements(spark, sf_dir).select("id", sqltext.is_give_up(F.col("s")).alias("gives_up"))


@registered("sql_alias", _STATEMENTS + "SELECT id, CASE WHEN id % 7 = 2 THEN 'f(' WHEN id % 7 = 5 THEN NULL END AS alias FROM s")
def sql_alias(spark, sf_dir):
    return _statements(spark, sf_dir).select("id", sqltext.illegal_alias(F.col("s")).alias("alias"))


@registered("sql_parentheses", _STATEMENTS + "SELECT id, CAST(length(replace(s, ')', '')) - length(replace(s, '(', '')) AS INTEGER) AS balance, length(replace(s, ')', '')) = length(replace(s, '(', '')) AND s NOT LIKE ')%' AS balanced FROM s")
def sql_parentheses(spark, sf_dir):
    s = F.col("s")
    return _statements(spark, sf_dir).select("id", sqltext.paren_balance(s).cast("int").alias("balance"), sqltext.parens_balanced(s).alias("balanced"))


@registered("sql_limit_one", _STATEMENTS + r"SELECT id, id % 7 IN (2, 5) AS limit_one, trim(CASE WHEN id % 7 = 2 THEN replace(s, ' LIMIT 1', '') WHEN id % 7 = 5 THEN replace(s, ' limit 1 ; ', '') ELSE s END, chr(32)) AS without FROM s")
def sql_limit_one(spark, sf_dir):
    s = F.col("s")
    return _statements(spark, sf_dir).select("id", sqltext.is_limit_one(s).alias("limit_one"), sqltext.remove_limit_one(s).alias("without"))


@registered("sql_query_type", _STATEMENTS + "SELECT id, CASE WHEN id % 7 = 6 THEN 'indexes' END AS kind FROM s UNION ALL SELECT 100 + id, CASE WHEN id % 2 = 0 THEN 'columns' ELSE 'foreignkeys' END FROM s")
def sql_query_type(spark, sf_dir):
    s = _statements(spark, sf_dir)
    asked = s.select((F.col("id") + 100).alias("id"), F.when(F.col("id") % 2 == 0, "describe t").otherwise("pragma foreign_key_list(t)").alias("s"))
    return s.unionAll(asked).select("id", sqltext.query_type(F.col("s")).alias("kind"))


@registered("sql_extract", """SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 3 THEN 'SELECT 1' ELSE 'SELECT ' || n_name || ' FROM t' END AS sql FROM nation""")
def sql_extract(spark, sf_dir):
    """Answers of a model in four forms, and the statement in each."""
    name = F.col("n_name")
    sql = F.concat(F.lit("SELECT "), name, F.lit(" FROM t"))
    forms = [F.concat(F.lit("Thought: so\nFinal Answer: ```sql\n"), sql, F.lit("\n```")), F.concat(F.lit("It is `"), sql, F.lit("`, I think")), F.concat(sql, F.lit("\nThis lists "), name), F.concat(F.lit("nothing about "), name)]
    text = F.element_at(F.array(*forms), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), by_python(sqltext.extract_sql, "string")(text).alias("sql"))


@registered("sql_fallback", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE 'SELECT ' || n_name || ' FROM t' END AS sql FROM nation")
def sql_fallback(spark, sf_dir):
    sql = F.concat(F.lit("SELECT "), F.col("n_name"), F.lit(" FROM t"))
    forms = [F.concat(F.lit("first SELECT a; then "), sql, F.lit(";\n\nmore")), F.concat(sql, F.lit("\nNote: all")), F.concat(F.lit("no statement for "), F.col("n_name"))]
    text = F.element_at(F.array(*forms), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), by_python(sqltext.fallback_sql, "string")(text).alias("sql"))


@registered("verdict_parse", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'GOLD_SUSPICIOUS' WHEN 1 THEN 'GOLD_CORRECT' WHEN 2 THEN 'PRED_BETTER' ELSE 'GOLD_CORRECT' END AS verdict FROM nation")
def verdict_parse(spark, sf_dir):
    name = F.col("n_name")
    forms = [F.concat(F.lit('{"verdict": "GOLD_SUSPICIOUS", "explanation": "'), name, F.lit('"}')), F.concat(F.lit('so {"verdict": "GOLD_CORRECT"} for '), name), F.concat(name, F.lit(": pred_better")), name]
    text = F.element_at(F.array(*forms), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), by_python(lambda t: sqltext.parse_verdict(t)[0], "string")(text).alias("verdict"))


@registered("brief_format", """SELECT 0 AS n, '| key | name |' AS line UNION ALL (SELECT 1 + n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation ORDER BY n_nationkey LIMIT 5)
    UNION ALL SELECT 6, '... and ' || (count(*) - 5) || ' more rows' FROM nation UNION ALL SELECT 7, ''""")
def brief_format(spark, sf_dir):
    rows = [[str(r[0]), r[1]] for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()]  # 25 rows
    return lines(spark, sqltext.format_brief(["key", "name"], rows))


@registered("result_fields", "SELECT 'n_name' AS field UNION ALL SELECT 'total'")
def result_field_names(spark, sf_dir):
    adapter = SparkAdapter(catalog(spark, sf_dir, ("nation",)))
    return spark.createDataFrame([(c,) for c in result_fields(adapter, "SELECT n_name, count(*) AS total FROM nation GROUP BY n_name")], "field string")


@registered("audit_rules", """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'sort_direction_error' WHEN 1 THEN 'current_timestamp_dependency' WHEN 2 THEN CASE WHEN c_nationkey > 1 THEN 'tie_handling' END
    WHEN 3 THEN 'cast_difference' WHEN 4 THEN 'trim_difference' WHEN 5 THEN CASE WHEN c_acctbal < 0 THEN 'sort_direction_error' END END AS suspicion_type FROM customer""")
def audit_rules(spark, sf_dir):
    return audit.audit(_audited_cases(spark, sf_dir)).select("id", "suspicion_type")


def _audited_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judged case for each customer: by its key modulo 7 one that a rule fits, or, by its other columns, does not."""
    c, kind = read(spark, sf_dir, "customer"), F.col("c_custkey") % 7
    pick = lambda *values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (kind + 1).cast("int"))
    return c.select(
        F.col("c_custkey").alias("id"),
        pick("SELECT a FROM t ORDER BY a ASC LIMIT 1", "SELECT CURRENT_DATE", "SELECT a FROM t ORDER BY b LIMIT 1", "SELECT a FROM t", "SELECT TRIM(a) FROM t", "SELECT a FROM t ORDER BY a DESC", "SELECT a FROM t").alias("gt_sql"),
        pick("SELECT 1", "SELECT 1", "SELECT a FROM t WHERE b = (SELECT MAX(b) FROM t)", "SELECT CAST(a AS REAL) FROM t", "SELECT a FROM t", "SELECT b FROM t", "SELECT b FROM t").alias("pred_sql"),
        pick("Which is the highest?", "now?", "which?", "what?", "what?", F.when(F.col("c_acctbal") < 0, "the fewest?").otherwise("the most?"), "what?").alias("question"),
        F.lit("").alias("evidence"),
        F.when(kind == 2, "row_count").otherwise("data_mismatch").alias("error_type"),
        F.lit(1).alias("gt_rows"),
        F.when(kind == 2, F.col("c_nationkey")).otherwise(1).cast("int").alias("pred_rows"),
        F.lit(True).alias("gt_success"),
        F.lit(True).alias("pred_success"),
    )


@registered("suspicion_counts", """SELECT suspicion_type, count(*) AS n FROM (SELECT CASE c_custkey % 7 WHEN 0 THEN 'sort_direction_error' WHEN 1 THEN 'current_timestamp_dependency' WHEN 2 THEN CASE WHEN c_nationkey > 1 THEN 'tie_handling' END
    WHEN 3 THEN 'cast_difference' WHEN 4 THEN 'trim_difference' WHEN 5 THEN CASE WHEN c_acctbal < 0 THEN 'sort_direction_error' END END AS suspicion_type FROM customer) WHERE suspicion_type IS NOT NULL GROUP BY 1""")
def suspicion_counts(spark, sf_dir):
    return audit.suspicion_breakdown(audit.audit(_audited_cases(spark, sf_dir)))


# Renderings. The oracles put the same lines together from the tables.


def _kind(table: str, column: str) -> str:
    return f"(SELECT CASE WHEN column_type = 'VARCHAR' THEN 'TEXT' WHEN column_type = 'INTEGER' THEN 'INT' ELSE column_type END FROM (DESCRIBE {table}) WHERE column_name = '{column}')"


_COLUMNS = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}
_TEXT_COLUMNS = ("n_name", "r_name", "s_name")


def _stats(table: str, c: str) -> str:
    """SQL for what a prompt shows of a column's values."""
    top = f"SELECT {c} AS v, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS r FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
    span = "''" if c in _TEXT_COLUMNS else f"(SELECT printf(' range=[%.0f..%.0f]', min({c})::DOUBLE, max({c})::DOUBLE) FROM {table})"
    return f"(CASE WHEN (SELECT count(DISTINCT {c}) FROM {table}) <= 15 THEN (SELECT ' values=[' || string_agg(v || '(' || k || ')', ', ' ORDER BY r) FILTER (r <= 8) || CASE WHEN count(*) > 8 THEN ', ...]' ELSE ']' END FROM ({top})) ELSE {span} END)"


def _rows(table: str) -> str:
    return f"(SELECT count(*) FROM {table})"


def _lines_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS n, {p} AS line" for i, p in enumerate(parts))


def _target(table: str, c: str) -> str:
    return next((f" → {fk.referenced_table}.{fk.referenced_column}" for fk in KEYS[table][1] if fk.column == c), "")


def _compact_parts(tables) -> list[str]:
    out = ["'Database: database'", "''"]
    for t in tables:
        out.append(f"'Table {t} (' || {_rows(t)} || ' rows):'")
        out += [f"'  - {c}: ' || {_kind(t, c)} || '{' [PK]' if c in KEYS[t][0] else ''}{_target(t, c)}' || {_stats(t, c)}" for c in _COLUMNS[t]]
        out.append("''")
    return [*out, "''", "''"][:-1]


def _context(spark: SparkSession, sf_dir: str, names=SMALL) -> dict:
    return context_store.build_context(catalog(spark, sf_dir, names))


@registered("prompt_compact", _lines_sql(_compact_parts(SMALL)))
def prompt_compact(spark, sf_dir):
    return lines(spark, render.compact_prompt(_context(spark, sf_dir)))


@registered("prompt_compact_filtered", _lines_sql(_compact_parts(("region",))))
def prompt_compact_filtered(spark, sf_dir):
    return lines(spark, render.compact_prompt(_context(spark, sf_dir), ["region", "nowhere"]))


def _full_parts(tables, paths: bool) -> list[str]:
    out = ["'# Database: database (spark)'", "''"]
    for t in tables:
        out += [f"'## Table: {t}'", f"'Rows: ' || {_rows(t)}"] + ([f"'Primary key: {', '.join(KEYS[t][0])}'"] if KEYS[t][0] else []) + ["'Columns:'"]
        out += [f"'- {c} ' || {_kind(t, c)} || {_stats(t, c)}" for c in _COLUMNS[t]]
        out += [f"'Foreign key: {fk.column}{_target(t, fk.column)}'" for fk in KEYS[t][1]] + ["''"]
    if paths:
        out += ["'## Join paths'"] + [f"'- {p}'" for p in ("nation->region: Direct join from nation to region ON nation.n_regionkey = region.r_regionkey", "nation->supplier: Direct join from nation to supplier ON nation.n_nationkey = supplier.s_nationkey", "region->supplier: Join from region to supplier through nation ON region.r_regionkey = nation.n_regionkey AND nation.n_nationkey = supplier.s_nationkey")]
    return [*out, "''"]


@registered("prompt_full", _lines_sql(_full_parts(SMALL, True)))
def prompt_full(spark, sf_dir):
    return lines(spark, render.full_prompt(_context(spark, sf_dir)))


@registered("prompt_one_table", _lines_sql(_full_parts(("supplier",), False)))
def prompt_one_table(spark, sf_dir):
    return lines(spark, render.table_prompt(_context(spark, sf_dir), "supplier"))


@registered("schema_basic", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '  - ' || column_name || ': ' || CASE WHEN column_type = 'VARCHAR' THEN 'TEXT' WHEN column_type = 'INTEGER' THEN 'INT' ELSE column_type END AS line FROM (DESCRIBE {t})" for t in SMALL))
def schema_basic(spark, sf_dir):
    rows, own = [], ""
    for line in render.basic_schema(catalog(spark, sf_dir, SMALL)).split("\n"):
        own = line[6:-1] if line.startswith("Table ") else own
        rows += [(own, line)] if line.startswith("  - ") else []
    return spark.createDataFrame(rows, "table_name string, line string")


@registered("schema_linking", "SELECT string_agg(t, ' | ' ORDER BY n) AS line FROM (" + " UNION ALL ".join(f"SELECT {i} AS n, '{t} (' || string_agg(column_name || CASE WHEN column_name IN ('{KEYS[t][0][0]}') THEN '*' ELSE '' END, ', ' ORDER BY r) || ')' AS t FROM (SELECT *, row_number() OVER () AS r FROM (DESCRIBE {t}))" for i, t in enumerate(SMALL)) + ")")
def schema_linking(spark, sf_dir):
    return spark.createDataFrame([(render.linking_schema(_context(spark, sf_dir)),)], "line string")


_SIMPLE = "CASE WHEN column_type IN ('INTEGER', 'BIGINT') THEN 'int' WHEN column_type = 'VARCHAR' THEN 'text' WHEN column_type = 'DOUBLE' THEN 'float' ELSE 'datetime' END"


@registered("schema_diagram", " UNION ALL ".join(f"SELECT '        ' || {_SIMPLE} || ' ' || column_name || CASE WHEN column_name IN ({', '.join(repr(k) for k in [*KEYS[t][0], '-'])}) THEN ' PK' WHEN column_name IN ({', '.join(repr(fk.column) for fk in KEYS[t][1]) or repr('-')}) THEN ' FK' ELSE '' END AS line FROM (DESCRIBE {t})" for t in SMALL)
    + """ UNION ALL SELECT '    region ||--o{ nation : "has"' UNION ALL SELECT '    nation ||--o{ supplier : "has"'""")
def schema_diagram(spark, sf_dir):
    text = render.er_diagram(catalog(spark, sf_dir, SMALL))
    return lines(spark, text).filter(F.col("line").startswith("        ") | F.col("line").contains("||")).select("line")


def _dirty(spark: SparkSession, sf_dir: str) -> Catalog:
    """nation with blanks at ends of some names and a number column kept as text."""
    found, key, name = Catalog(spark), F.col("n_nationkey") % 5, F.col("n_name")
    a = F.when(key == 0, F.concat(F.lit(" "), name)).when(key == 1, F.concat(name, F.lit(" "))).when(key == 2, "").otherwise(name)
    found.add("dirty", read(spark, sf_dir, "nation").select(a.alias("a"), F.col("n_nationkey").cast("string").alias("b")))
    return found


_BLANKS = "(SELECT count(*) FROM nation WHERE n_nationkey % 5 IN (0, 1))"


@registered("prompt_cross_table", f"""SELECT 0 AS n, 'Cross-Table Data Quality Warnings:' AS line UNION ALL SELECT 1, '- dirty.a: Contains values with leading or trailing whitespace (' || {_BLANKS} || ' rows) → TRIM("a")' UNION ALL SELECT 2, ''""")
def prompt_cross_table(spark, sf_dir):
    return lines(spark, render.cross_table_summary(context_store.build_context(_dirty(spark, sf_dir))))


@registered("table_infos", """SELECT 'dirty' AS name, 'a,b' AS columns, '⚠️ Quality: a(whitespace), b(type_mismatch)' AS quality UNION ALL SELECT 'nation', string_agg(column_name, ',' ORDER BY r), '' FROM (SELECT *, row_number() OVER () AS r FROM (DESCRIBE nation))""")
def table_infos(spark, sf_dir):
    found = _dirty(spark, sf_dir)
    found.add("nation", read(spark, sf_dir, "nation"), ["n_nationkey"])
    infos = render.table_infos(context_store.build_context(found))
    return spark.createDataFrame([(n, ",".join(i["columns"]), i["quality"]) for n, i in infos.items()], "name string, columns string, quality string")


@registered("business_notes", "SELECT n_nationkey AS id, 'Sales Of ' || replace(n_name, '_', ' ') || ': ' || CAST(n_nationkey AS VARCHAR) || CASE WHEN n_nationkey % 3 = 0 THEN ' [EXPIRED]' ELSE '' END AS note FROM nation WHERE n_nationkey % 4 <> 1 AND instr(n_name, ' ') = 0")
def business_notes(spark, sf_dir):
    """Notes of a table, out of date for every third, hidden by their key for every fourth."""
    from datetime import datetime, timezone

    now, out = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for r in read(spark, sf_dir, "nation").filter("instr(n_name, ' ') = 0").collect():  # 25 rows at most
        i = r["n_nationkey"]
        key = f"sales_of_{r['n_name']}" + ("_rowcount" if i % 4 == 1 else "")
        table = {"rich_context": {key: {"content": str(i), "expires_at": "2023-01-01T00:00:00Z" if i % 3 == 0 else "2025-01-01T00:00:00Z"}}}
        out += [(i, n) for n in render.business_notes(table, now)]
    return spark.createDataFrame(out, "id int, note string")


@registered("table_semantics", "SELECT 0 AS n, 'nation.n_regionkey: foreign_key' AS line UNION ALL SELECT 1, 'supplier.s_nationkey: foreign_key'")
def table_semantics(spark, sf_dir):
    return lines(spark, render.semantics_text(graph.field_semantics(catalog(spark, sf_dir, SMALL)).collect()))


# Catalog, DDL and graph.


@registered("catalog_columns", " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, {_SIMPLE} AS simple FROM (DESCRIBE {t})" for t in ("customer", "lineitem", "nation", "orders", "part")))
def catalog_columns(spark, sf_dir):
    found = catalog(spark, sf_dir, ("customer", "lineitem", "nation", "orders", "part")).columns_df()
    return found.select("table_name", "column_name", "ordinal", by_python(simple_type, "string")("type").alias("simple"))


def _ddl(spark: SparkSession, sf_dir: str, table: str) -> str:
    """CREATE TABLE text for a table, as a database would give it."""
    parts = [f'"{f.name}" {f.dataType.simpleString().upper()} -- a column, no more' for f in read(spark, sf_dir, table).schema.fields]
    parts = [p.replace(" --", ", --") for p in parts]
    parts.append(f"PRIMARY KEY ({', '.join(KEYS[table][0])})" + "".join(f",\n FOREIGN KEY ({fk.column}) REFERENCES {fk.referenced_table} ({fk.referenced_column})" for fk in KEYS[table][1]))
    return f"CREATE TABLE IF NOT EXISTS `{table}` (\n" + "\n".join(parts) + "\n);\n"


@registered("ddl_columns", " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_name = '{KEYS[t][0][0]}' AS is_key FROM (DESCRIBE {t})" for t in SMALL))
def ddl_columns(spark, sf_dir):
    text = "".join(_ddl(spark, sf_dir, t) for t in SMALL)
    return spark.createDataFrame([(t.name, c.name, c.primary_key) for t in parse_ddl(text) for c in t.columns], "table_name string, column_name string, is_key boolean")


@registered("ddl_rebuild", f"WITH f(a, b, c, d) AS (VALUES {_FK_VALUES}) SELECT a AS table_name, b AS column_name, c AS referenced_table, d AS referenced_column FROM f WHERE a IN ('nation', 'supplier')")
def ddl_rebuild(spark, sf_dir):
    """Keys that only a DDL file declares, added to tables that carry none."""
    found = Catalog.of_parquet(spark, sf_dir, SMALL, {})
    found.declare(parse_ddl("".join(_ddl(spark, sf_dir, t) for t in SMALL)))
    return found.foreign_keys_df()


_WALKS = f"""WITH RECURSIVE f(a, b, c, d) AS (VALUES {_FK_VALUES}), g AS (SELECT * FROM f WHERE a IN ('nation', 'supplier', 'customer', 'orders') AND c IN ('region', 'nation', 'customer')), e AS (SELECT a AS x, c AS y FROM g UNION SELECT c, a FROM g),
    walk(first, node, path, steps) AS (SELECT DISTINCT x, x, '>' || x || '>', 0 FROM e UNION ALL SELECT w.first, e.y, w.path || e.y || '>', w.steps + 1 FROM walk w JOIN e ON e.x = w.node WHERE instr(w.path, '>' || e.y || '>') = 0)
    SELECT first || '->' || node AS pair, CAST(min(steps) AS INTEGER) AS steps FROM walk WHERE first < node GROUP BY first, node"""


@registered("all_join_paths", _WALKS)
def all_join_paths(spark, sf_dir):
    paths = graph.all_join_paths(catalog(spark, sf_dir, ("customer", "nation", "orders", "region", "supplier")))
    return spark.createDataFrame([(f"{a}->{b}", len(p.tables) - 1) for (a, b), p in paths.items()], "pair string, steps int")


@registered("reversed_path", "SELECT 'region,nation,customer,orders' AS tables, 'Join from region to orders through nation, customer' AS description")
def reversed_path(spark, sf_dir):
    path = graph.join_path(catalog(spark, sf_dir, ("customer", "nation", "orders", "region")), "orders", "region").reversed()
    return spark.createDataFrame([(",".join(path.tables), path.description)], "tables string, description string")


@registered("linked_selection", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'nation,region' WHEN 1 THEN 'nation,region,supplier' WHEN 2 THEN '' ELSE 'region' END AS tables FROM nation")
def linked_selection(spark, sf_dir):
    """Answers of a linking model, and the tables that they name."""
    found, name = catalog(spark, sf_dir, SMALL), F.col("n_name")
    tables = Catalog(None, tables=found.tables)
    forms = [F.concat(F.lit("TABLES: Nation, `region`\nCONTEXT: about "), name), F.lit("TABLES: all"), F.concat(F.lit("none\n"), name), F.concat(F.lit("region, "), name, F.lit("\nmore"))]
    text = F.element_at(F.array(*forms), (F.col("n_nationkey") % 4 + 1).cast("int"))
    chosen = by_python(lambda t: ",".join(sorted(graph.resolve_selection(tables, graph.parse_link_output(t)[0]))), "string")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), chosen(text).alias("tables"))


@registered("small_database", "SELECT 'nation,region,supplier' AS one, 'nation,region,supplier' AS three, 'nation' AS of_many")
def small_database(spark, sf_dir):
    few, many = catalog(spark, sf_dir, SMALL), catalog(spark, sf_dir)
    pick = lambda c, names: ",".join(graph.safe_selection(c, names))
    return spark.createDataFrame([(pick(few, ["nation"]), pick(few, list(SMALL)), pick(many, ["nation"]))], "one string, three string, of_many string")


# Verification and comparison.


@registered("verify_statements", """SELECT r_regionkey AS id, true AS ok, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) AS row_count,
      CASE WHEN (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) = 0 THEN 'query returned 0 rows'
           WHEN (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) > 1 THEN 'result has duplicate rows' ELSE '' END AS warnings FROM region
    UNION ALL SELECT 100, true, count(*), 'most cells are NULL' FROM nation UNION ALL SELECT 101, false, 0, '' UNION ALL SELECT 102, false, 0, ''""")
def verify_statements(spark, sf_dir):
    adapter = SparkAdapter(catalog(spark, sf_dir, ("nation", "region")))
    texts = [(r["r_regionkey"], f"SELECT n_regionkey FROM nation WHERE n_regionkey = {r['r_regionkey']} AND n_nationkey > 10") for r in adapter.catalog.frames["region"].collect()]  # 5 rows
    texts += [(100, "SELECT n_nationkey, NULL AS a, NULL AS b FROM nation"), (101, "SELECT (n_name FROM nation"), (102, "SELECT nothing FROM nation")]
    found = [(i, verify.verify(adapter, sql)) for i, sql in texts]
    return spark.createDataFrame([(i, v.ok, v.row_count, "; ".join(v.warnings)) for i, v in found], "id int, ok boolean, row_count long, warnings string")


@registered("execute_text", """SELECT 0 AS n, 'n_nationkey | n_name' AS line UNION ALL SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS n, n_nationkey || ' | ' || n_name AS line FROM nation) WHERE n <= 10 UNION ALL SELECT 11, '...'""")
def execute_text(spark, sf_dir):
    return lines(spark, verify.execute(SparkAdapter(catalog(spark, sf_dir, ("nation",))), "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"))


@registered("dry_run", "SELECT 'good' AS statement, true AS analyzes UNION ALL SELECT 'bad', false")
def dry_run(spark, sf_dir):
    adapter = SparkAdapter(catalog(spark, sf_dir, ("nation",)))
    return spark.createDataFrame([("good", adapter.dry_run("SELECT n_name FROM nation") is None), ("bad", adapter.dry_run("SELECT r_name FROM nation") is None)], "statement string, analyzes boolean")


def _variants(spark: SparkSession, sf_dir: str) -> list[tuple[int, DataFrame, DataFrame]]:
    """(region, gold, pred): the nations of a region, and the same in another way or with a fault, by its key."""
    nation, out = read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), []
    for r in range(7):
        gold = read(spark, sf_dir, "nation").filter(F.col("n_regionkey") == r % 5).select("n_nationkey", "n_name")
        pred = [
            gold.select("n_name", "n_nationkey"), gold.select(F.col("n_name").alias("p"), F.col("n_nationkey").alias("q")), gold.filter("n_nationkey > 10"), gold.select("n_name"),
            gold.select("n_nationkey", F.lower("n_name").alias("n_name")), gold.select(F.col("n_nationkey").alias("p"), F.lower("n_name").alias("q")), gold.select(F.concat("n_nationkey", F.lit("%")).alias("n_nationkey"), F.concat(F.lit(" "), "n_name").alias("n_name")),
        ][r]
        out.append((r, gold, pred))
    out.append((7, nation.filter("n_nationkey < 0"), nation.filter("n_nationkey < 0").select("n_name")))
    return out


@registered("compare_variants", """SELECT 0 AS id, true AS equal, '' AS reason, 'exact_column_names' AS strategy, false AS normalized UNION ALL SELECT 1, true, '', 'column_mapping', false
    UNION ALL SELECT 2, false, 'row count mismatch: gold=' || count(*) || ', pred=' || count(*) FILTER (n_nationkey > 10), '', false FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT 3, false, 'column count mismatch: gold=2, pred=1', '', false UNION ALL SELECT 4, count(*) FILTER (n_name <> lower(n_name)) = 0, 'data mismatch', 'exact_column_names', false FROM nation WHERE n_regionkey = 4
    UNION ALL SELECT 5, false, 'column name mismatch and positional data mismatch', 'positional', false UNION ALL SELECT 6, true, '', 'exact_column_names', true UNION ALL SELECT 7, true, '', 'empty', false""")
def compare_variants(spark, sf_dir):
    found = [(i, compare.compare_results(gold, pred)) for i, gold, pred in _variants(spark, sf_dir)]
    return spark.createDataFrame([(i, c.equal, c.reason, c.strategy, c.normalized) for i, c in found], "id int, equal boolean, reason string, strategy string, normalized boolean")


@registered("column_mapping", """SELECT 0 AS gold_column, 2 AS pred_column, true AS found UNION ALL SELECT 1, 0, true UNION ALL SELECT 2, 1, true
    UNION ALL SELECT 10, -1, EXISTS (SELECT 1 FROM lineitem HAVING count(*) FILTER (l_tax <> l_discount) = 0)""")
def column_mapping(spark, sf_dir):
    """Columns of lineitem found again by their values, in another order of columns and rows; and one that is not there."""
    items = read(spark, sf_dir, "lineitem")
    gold = canonical_frame(items.select("l_extendedprice", "l_partkey", "l_returnflag"))
    pred = canonical_frame(items.select("l_partkey", "l_returnflag", "l_extendedprice").orderBy("l_returnflag"))
    rows = [(i, j, True) for i, j in enumerate(compare.map_columns(gold, pred) or [])]
    none = compare.map_columns(canonical_frame(items.select("l_tax")), canonical_frame(items.select("l_discount")))
    return spark.createDataFrame([*rows, (10, -1 if none is None else none[0], none is not None)], "gold_column int, pred_column int, found boolean")


@registered("normalized_compare", "SELECT o_orderkey AS id, o_orderkey % 4 <> 3 AS same FROM orders")
def normalized_compare(spark, sf_dir):
    """Totals and dates against themselves with a percent sign, blanks or a zone; every fourth against something else."""
    kind, total, day = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    a = F.when(kind == 0, F.concat(total, F.lit("%"))).when(kind == 1, F.concat(F.lit(" "), "o_orderstatus", F.lit(" "))).when(kind == 2, F.concat(day, F.lit(" +0000 UTC"))).otherwise(F.concat(total, F.lit("%%")))
    b = F.when(kind == 0, total).when(kind == 1, F.col("o_orderstatus")).when(kind == 2, day).otherwise(total)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), normalized(a).eqNullSafe(normalized(b)).alias("same"))


@registered("loose_values", "SELECT c_custkey AS id, c_custkey % 3 <> 2 OR c_nationkey = 1 AS same FROM customer")
def loose_values(spark, sf_dir):
    """Numbers with a fraction, a unit, or another number behind them."""
    number = F.col("c_nationkey").cast("string")
    other = F.when(F.col("c_custkey") % 3 == 0, F.concat(number, F.lit(".0"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), number, F.lit("kg"))).otherwise(F.lit("1"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), loosely_equal(number, other).alias("same"))


@registered("set_compare", """SELECT 'repeated' AS id, true AS same_set, count(*) = count(DISTINCT c_nationkey) AS same_multiset FROM customer
    UNION ALL SELECT 'missing', (SELECT count(DISTINCT c_nationkey) FROM customer) = (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey > 3), (SELECT count(*) FROM customer WHERE c_nationkey <= 3) = 0""")
def set_compare(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").select("c_nationkey")
    pairs = [("repeated", keys.distinct()), ("missing", keys.filter("c_nationkey > 3"))]
    return spark.createDataFrame([(n, compare.same_set(keys, x), compare.same_multiset(keys, x)) for n, x in pairs], "id string, same_set boolean, same_multiset boolean")


@registered("spj_limit1", """SELECT s AS size, s = (SELECT max(p_size) FROM part) AS correct FROM (SELECT DISTINCT p_size AS s FROM part WHERE p_size >= 48 OR p_size <= 2) UNION ALL SELECT -1, false""")
def spj_limit1(spark, sf_dir):
    """Whether a part of a size is a right answer to `the largest part`; no part is not."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    sizes = [r[0] for r in part.filter("p_size >= 48 OR p_size <= 2").select("p_size").distinct().collect()]  # a few sizes
    parts = [compare.limit_one_strict(part, [(-F.col("p_size")).alias("k")], part.filter(F.col("p_size") == s).orderBy("p_partkey").limit(1)).select(F.lit(s).alias("size"), "correct") for s in [*sizes, -1]]
    return union(parts)


@registered("spj_lenient", """SELECT 'one row' AS id, true AS correct UNION ALL SELECT 'no row', false UNION ALL SELECT 'no limit', false UNION ALL SELECT 'several', (SELECT min(n_name) FROM nation) = (SELECT n_name FROM nation WHERE n_nationkey = 0)""")
def spj_lenient(spark, sf_dir):
    names = read(spark, sf_dir, "nation")
    gold, sql = names.filter("n_nationkey = 0"), "SELECT n_name FROM nation ORDER BY n_regionkey LIMIT 1"
    found = [("one row", sql, names.filter("n_nationkey = 3")), ("no row", sql, names.filter("n_nationkey < 0")), ("no limit", sql[:-8], names.limit(1)), ("several", sql, names.orderBy("n_name"))]
    return spark.createDataFrame([(i, compare.limit_one_compatible(s, gold.select("n_name"), p.select("n_name"))[0]) for i, s, p in found], "id string, correct boolean")


#: Messages, built from a nation's name and key, and what they mean.
_MESSAGES = [
    ("concat('Gold SQL execution error: row count mismatch ', n_name)", "reference_error"), ("concat('predicted SQL execution error: ', n_name)", "execution_error"), ("concat('row count mismatch: gold=1, pred=', n_nationkey)", "row_count_error"),
    ("'column name mismatch and positional data mismatch'", "data_mismatch"), ("concat('column count mismatch ', n_name)", "projection_error"), ("concat('data mismatch ', n_name)", "data_mismatch"), ("'wrong ORDER'", "order_error"), ("concat('', '')", "unknown_error"), ("'strange'", "other_error"),
]
_MESSAGE = "CASE n_nationkey % 9 " + " ".join(f"WHEN {i} THEN {m}" for i, (m, _) in enumerate(_MESSAGES)) + " END"


@registered("classify_errors", "SELECT n_nationkey AS id, CASE n_nationkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_MESSAGES)) + " END AS error_type FROM nation")
def classify_errors(spark, sf_dir):
    return read(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", f"{_MESSAGE} AS reason").select("id", compare.classify_error(F.col("reason")).alias("error_type"))


_JUDGED = """SELECT r_regionkey AS id, 'db' || (r_regionkey % 2) AS db_id, n = m AS is_correct, CASE WHEN n = m THEN 'semantic_match' ELSE 'row_count_error' END AS error_type
    FROM (SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 20) AS m FROM region)
    UNION ALL SELECT 10, 'db0', true, 'exact_match' UNION ALL SELECT 11, 'db0', false, 'execution_error' UNION ALL SELECT 12, 'db0', false, 'reference_error' UNION ALL SELECT 13, 'db1', false, 'ambiguous_query' UNION ALL SELECT 14, 'nowhere', false, 'db_connection_error'"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on statements over the tables: for each region its nations against those with a small key, and one of every other kind."""
    from ..sources.adapters import open_adapter

    cases = [{"id": r, "db_id": f"db{r % 2}", "gt_sql": f"SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = {r}", "pred_sql": f"SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey = {r} AND n_nationkey < 20"} for r in range(5)]
    cases += [{"id": 10, "db_id": "db0", "gt_sql": "SELECT n_name FROM nation;", "pred_sql": "select  N_name from nation"}, {"id": 11, "db_id": "db0", "gt_sql": "SELECT n_name FROM nation", "pred_sql": "SELECT nothing FROM nation"}]
    cases += [{"id": 12, "db_id": "db0", "gt_sql": "SELECT nothing FROM nation", "pred_sql": "SELECT n_name FROM nation"}, {"id": 13, "db_id": "db1", "gt_sql": "SELECT 1", "pred_sql": compare.AMBIGUOUS}, {"id": 14, "db_id": "nowhere", "gt_sql": "SELECT 1", "pred_sql": "SELECT 2"}]
    open_database = lambda db: open_adapter(spark, "parquet", folder=sf_dir if db != "nowhere" else f"{sf_dir}/nowhere", tables=("nation",), keys=KEYS)
    return judge.judge_all(spark, cases, open_database)


@registered("judge_cases", _JUDGED)
def judge_cases(spark, sf_dir):
    return _judged(spark, sf_dir).select("id", "db_id", "is_correct", "error_type")


@registered("report_run", f"WITH v AS ({_JUDGED}) SELECT count(*) AS total, count(*) FILTER (error_type = 'exact_match') AS correct_count, count(*) FILTER (error_type = 'semantic_match') AS equivalent_count, count(*) FILTER (error_type IN ('row_count_error', 'execution_error', 'db_connection_error', 'reference_error')) AS error_count FROM v")
def report_run(spark, sf_dir):
    return report.summary(_judged(spark, sf_dir)).select("total", "correct_count", "equivalent_count", "error_count")


@registered("eval_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS succeeded, round(count(*) FILTER (o_orderstatus <> 'F') * 100.0 / count(*), 4) AS success_rate, round(avg(o_totalprice), 4) AS avg_seconds, CAST(sum(o_custkey) AS BIGINT) AS total_tokens FROM orders")
def eval_summary(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    records = o.select(F.when(F.col("o_orderstatus") != "F", "success").otherwise("error").alias("status"), F.col("o_totalprice").alias("time_seconds"), F.lit(1).alias("llm_calls"), F.col("o_custkey").alias("total_tokens"))
    return report.eval_summary(records).select("total", "succeeded", F.round("success_rate", 4).alias("success_rate"), F.round("avg_seconds", 4).alias("avg_seconds"), F.col("total_tokens").cast("long").alias("total_tokens"))


@registered("select_cases", _VERDICTS + "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM v WHERE difficulty = 'moderate') WHERE r BETWEEN 10 AND 400 ORDER BY id LIMIT 200")
def select_cases(spark, sf_dir):
    return report.select_cases(_verdicts(spark, sf_dir), 10, 400, 200, "moderate").select("id")


# Files of runs: written from table rows, and read again.


def _text_file(spark: SparkSession, name: str, content: str) -> str:
    path = scratch(spark, name)
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return path


@registered("predictions_file", "SELECT 'SELECT ' || n_name || ' FROM t' AS sql, 'db' || n_regionkey AS db_id FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT 'SELECT 1', 'db' || n_regionkey FROM nation WHERE n_nationkey % 3 = 0")
def predictions_file(spark, sf_dir):
    sql = F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("SELECT  "), "n_name", F.lit("\n FROM t ")))
    path = scratch(spark, "predictions")
    sinks.write_predictions(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), sql.alias("generated_sql"), F.concat(F.lit("db"), "n_regionkey").alias("db_id")), path)
    return judge_files.read_sql_lines(spark, path)


@registered("case_lines", "SELECT n_nationkey AS id, n_name AS question, 'good' AS kind FROM nation WHERE n_nationkey % 4 > 0 UNION ALL SELECT -1, '{\"id\": ' || n_name, 'malformed' FROM nation WHERE n_nationkey % 4 = 0")
def case_lines(spark, sf_dir):
    path = scratch(spark, "cases")
    good = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("question")))
    read(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 4 > 0, good).otherwise(F.concat(F.lit('{"id": '), "n_name")).alias("value")).write.text(path)
    bad = judge_files.malformed_lines(spark, path).select(F.lit(-1).alias("id"), F.col("line").alias("question"), F.lit("malformed").alias("kind"))
    return judge_files.read_case_lines(spark, path).select("id", "question", F.lit("good").alias("kind")).unionAll(bad)


@registered("result_array", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS id, 'db' || n_regionkey AS db_name, n_name AS pred_sql FROM nation")
def result_array(spark, sf_dir):
    rows = [{"db_id": f"db{r['n_regionkey']}", "generated_sql": r["n_name"]} for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a benchmark's list: 25 rows
    return judge_files.read_result_array(spark, _text_file(spark, "results", json.dumps(rows))).select("id", "db_name", "pred_sql")


def _judged_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of judged cases, one file each, as a run leaves them: some ids twice, a report among them."""
    folder = scratch(spark, "judged")
    for r in read(spark, sf_dir, "region").collect():  # 5 rows
        i, kind = r["r_regionkey"], ("incorrect_row_count", "incorrect_data_mismatch")[r["r_regionkey"] % 2]
        case = {"id": i, "db_id": "db", "question": r["r_name"], "is_correct": False, "gt_result": {"Success": True, "Rows": [["h"], ["1"]]}, "pred_result": {"Success": True, "Rows": [["h"]] + [["1"]] * i}}
        for copy in range(1 + i % 2):
            _write_file(spark, f"{folder}/{kind}/{kind}_{i}_{copy}.json", json.dumps({**case, "question": case["question"] + "!" * copy}))
    _write_file(spark, f"{folder}/analysis_report.json", json.dumps({"id": 99}))
    return folder


def _write_file(spark: SparkSession, path: str, content: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content.encode()))
    out.close()


@registered("judged_folder", "SELECT r_regionkey AS id, r_name AS question FROM region")
def judged_folder(spark, sf_dir):
    return judge_files.read_judged_folder(spark, _judged_folder(spark, sf_dir)).select("id", "question")


@registered("error_cases", "SELECT r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'row_count' ELSE 'data_mismatch' END AS error_type, 1 AS gt_rows, r_regionkey AS pred_rows FROM region UNION ALL SELECT r_regionkey, 'data_mismatch', 1, r_regionkey FROM region WHERE r_regionkey % 2 = 1")
def error_cases(spark, sf_dir):
    return judge_files.read_error_cases(spark, _judged_folder(spark, sf_dir)).select("id", "error_type", "gt_rows", "pred_rows")


@registered("benchmark_file", "SELECT n_nationkey AS question_id, n_name AS question, 'simple' AS difficulty FROM nation")
def benchmark_file(spark, sf_dir):
    rows = [{"question_id": r["n_nationkey"], "db_id": "db", "question": r["n_name"], "difficulty": "simple"} for r in read(spark, sf_dir, "nation").collect()]  # 25 rows
    return judge_files.read_benchmark(spark, _text_file(spark, "benchmark", json.dumps(rows)), "bird").select("question_id", "question", "difficulty")


@registered("tie_tags", "SELECT CAST(n_nationkey + 1 AS INTEGER) AS id, CASE WHEN n_regionkey = 1 THEN 'limit_1_tied_values' END AS spj_type FROM nation")
def tie_tags(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    tags = judge_files.read_tags(spark, _text_file(spark, "tags", json.dumps([{"db_id": "d", "query": "q", "spj_type": "limit_1_tied_values" if r["n_regionkey"] == 1 else None} for r in rows])))
    return judge_files.merge_tags(read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("id")), tags).select("id", "spj_type")


@registered("classified_files", _VERDICTS + "SELECT CASE error_type WHEN 'exact_match' THEN 'correct_exact_match' WHEN 'semantic_match' THEN 'correct_equivalent' ELSE 'incorrect_row_count' END AS category, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v GROUP BY 1")
def classified_files(spark, sf_dir):
    path = scratch(spark, "classified")
    sinks.write_classified(_verdicts(spark, sf_dir), path)
    return spark.read.json(path).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("long").alias("ids"))


@registered("summary_file", _VERDICTS + "SELECT count(*) AS total, count(*) FILTER (error_type = 'row_count_error') AS error_count, 'row_count_error' AS first_error FROM v")
def summary_file(spark, sf_dir):
    path = scratch(spark, "summary")
    sinks.write_summary(_verdicts(spark, sf_dir), path)
    return spark.read.json(path).select("total", "error_count", F.col("error_counts")[0]["error_type"].alias("first_error"))


@registered("resumed_records", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def resumed_records(spark, sf_dir):
    """A run that stopped after a third of its records, taken up again, as one valid JSON array."""
    path, array = scratch(spark, "records"), scratch(spark, "array")
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    sinks.append_records(records.filter("id % 3 = 0"), path)
    sinks.append_records(sinks.unfinished(records, path), path)
    sinks.write_json_array(spark, path, array)
    return sinks.read_json_array(spark, array, "id LONG, status STRING").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.sum("id").cast("long").alias("total"))


@registered("context_file", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count, {len(_COLUMNS[t])} AS columns FROM {t}" for t in SMALL))
def context_file(spark, sf_dir):
    path = scratch(spark, "context")
    context_store.save_context(spark, _context(spark, sf_dir), path)
    got = context_store.load_context(spark, path)
    return spark.createDataFrame([(n, t["row_count"], len(t["columns"])) for n, t in got["tables"].items()], "name string, row_count long, columns int")


# Runs.


@registered("notes_expired", "SELECT n_nationkey AS id, n_nationkey % 3 = 0 AS expired FROM nation")
def notes_expired(spark, sf_dir):
    from datetime import datetime

    at = F.when(F.col("n_nationkey") % 3 == 0, "2023-01-01T00:00:00Z").when(F.col("n_nationkey") % 3 == 1, "2025-01-01T00:00:00Z").otherwise("some day")
    return tasks.with_expired(read(spark, sf_dir, "nation").withColumn("expires_at", at), datetime(2024, 1, 1)).select(F.col("n_nationkey").alias("id"), "expired")


@registered("notes_upsert", "SELECT n_name AS table_name, CASE WHEN n_regionkey = 2 THEN 'new' ELSE 'old' END AS content FROM nation UNION ALL SELECT r_name, 'new' FROM region")
def notes_upsert(spark, sf_dir):
    def notes(df, name, content):
        return df.select(F.col(name).alias("table_name"), F.lit("k").alias("key"), F.lit(content).alias("content"), F.lit(None).cast("string").alias("expires_at"))

    nation = read(spark, sf_dir, "nation")
    new = notes(nation.filter("n_regionkey = 2"), "n_name", "new").unionAll(notes(read(spark, sf_dir, "region"), "r_name", "new"))
    return tasks.upsert_notes(notes(nation, "n_name", "old"), new).select("table_name", "content")


@registered("task_pool", "SELECT 'r' || r_regionkey AS task, CASE WHEN r_regionkey = 3 THEN 'failed' ELSE 'completed' END AS state, CASE WHEN r_regionkey = 3 THEN NULL ELSE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) END AS result FROM region")
def task_pool(spark, sf_dir):
    """A count for each region as a task of its own; one of them fails."""
    nation, registry = read(spark, sf_dir, "nation"), tasks.TaskRegistry()

    def count(r):
        if r == 3:
            raise ValueError("no such region")
        return nation.filter(F.col("n_regionkey") == r).count()

    tasks.run_all({f"r{r['r_regionkey']}": (lambda k=r["r_regionkey"]: count(k)) for r in read(spark, sf_dir, "region").collect()}, 3, registry)  # 5 rows
    return spark.createDataFrame([(t.id, t.state.value, t.result) for t in registry.tasks.values()], "task string, state string, result long")


@registered("inference_run", "SELECT 'nation,region' AS tables, count(*) AS rows, 'execute_sql,' AS actions FROM nation")
def inference_run(spark, sf_dir):
    """A question answered by a loop with tools; the model's answers are prepared."""
    found = catalog(spark, sf_dir, ("nation", "region"))
    adapter = SparkAdapter(found)
    model = Scripted(["TABLES: nation\nCONTEXT: names", "Thought: look\nAction: execute_sql\nAction Input: SELECT count(*) FROM nation", "Final Answer: SELECT n_name FROM nation"])
    out = infer(model, adapter, context_store.build_context(found), "names?")
    rows = adapter.query(out.sql).df.count()
    return spark.createDataFrame([(",".join(out.tables), rows, ",".join(s.action for s in out.steps))], "tables string, rows long, actions string")


@registered("schema_link", "SELECT 'nation' AS table_name UNION ALL SELECT 'region' UNION ALL SELECT 'supplier'")
def schema_link(spark, sf_dir):
    """The linked tables of a choice, in a database that is not small."""
    found = catalog(spark, sf_dir)
    names, _ = link(Scripted(["TABLES: supplier, region"]), _context(spark, sf_dir), found, "which?", True)
    return spark.createDataFrame([(n,) for n in names], "table_name string")
