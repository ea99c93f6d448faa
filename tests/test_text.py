import pytest
from pyspark.sql import functions as F

from lodestone.functions import sqltext
from lodestone.functions.dialect import Dialect, glob_to_regex
from lodestone.operators import audit, report, verify
from lodestone.sources.adapters import SparkAdapter
from lodestone.sources.catalog import Catalog


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} STRING" for i in range(len(values))))
    return df.select(f(*[F.col(f"v{i}") for i in range(len(values))])).first()[0]


def test_normalize(spark):
    assert one(spark, sqltext.normalize_sql, "SELECT  A\n FROM t;") == "select a from t" == sqltext.normalize_sql_text("SELECT  A\n FROM t;")
    assert one(spark, sqltext.normalize_sql, "SELECT 1;;") == "select 1;"


@pytest.mark.parametrize("sql,gives_up", [("", True), ("-- x", True), ("/* x */", True), ("SELECT 0", True), ("select null;", True), ("DELETE FROM t", True), ("SELECT 10", False), ("WITH a AS (SELECT 1) SELECT * FROM a", False)])
def test_give_up(spark, sql, gives_up):
    assert one(spark, sqltext.is_give_up, sql) == gives_up == sqltext.is_give_up_text(sql)


def test_extract():
    assert sqltext.extract_sql("Thought\nFinal Answer: ```sql\nSELECT a\nFROM t\n```") == "SELECT a\nFROM t"
    assert sqltext.extract_sql("the query is `SELECT a FROM t` here") == "SELECT a FROM t"
    assert sqltext.extract_sql("SELECT a\nFROM t\nThis query is right") == "SELECT a\nFROM t"
    assert sqltext.extract_sql("I think SELECT 1 no\nbut SELECT b FROM u;\n\nThanks") == "SELECT b FROM u"
    assert sqltext.extract_sql("no idea") == "SELECT 1"


def test_static_checks(spark):
    assert one(spark, sqltext.illegal_alias, "SELECT x AS count(*) FROM t") == "count("
    assert one(spark, sqltext.illegal_alias, "SELECT CAST(x AS VARCHAR(10))") == "VARCHAR("  # counts too
    assert one(spark, sqltext.paren_balance, "((a)") == 1
    assert not one(spark, sqltext.parens_balanced, ")(") and one(spark, sqltext.parens_balanced, "(a(b))")
    assert one(spark, sqltext.is_limit_one, "x LIMIT 1") and not one(spark, sqltext.is_limit_one, "x LIMIT 10") and one(spark, lambda c: sqltext.is_limit_one(c, True), "x LIMIT 10")
    assert one(spark, sqltext.remove_limit_one, "SELECT a FROM t limit 1 ;") == "SELECT a FROM t"
    assert [one(spark, sqltext.query_type, s) for s in ("PRAGMA table_info(t)", "SHOW INDEX FROM t", "SELECT count(*) FROM t", "PRAGMA foreign_key_list(t)", "x")] == ["columns", "indexes", "rowcount", "foreignkeys", None]


def test_verdicts_and_brief():
    assert sqltext.parse_verdict('```json\n{"verdict": "PRED_BETTER", "explanation": "e"}\n```') == ("PRED_BETTER", "e")
    assert sqltext.parse_verdict('so {"verdict": "X", "explanation": ""} then')[0] == "X"
    assert sqltext.parse_verdict("clearly gold_suspicious")[0] == "GOLD_SUSPICIOUS" and sqltext.parse_verdict("?")[0] == "GOLD_CORRECT"
    assert sqltext.format_brief([], []) == "(empty)" and sqltext.format_brief(["a"], [["1"], ["2"]], 1) == "| a |\n| 1 |\n... and 1 more rows\n"


@pytest.fixture(scope="module")
def dialect(spark):
    df = spark.createDataFrame([(10, 4, "10", "Abc", 2.0, "2020-05-06"), (9, 2, "9", "xyz", -1.0, "bad"), (7, 0, "abc", None, 0.5, None)], "i INT, j INT, k STRING, s STRING, d DOUBLE, t STRING")
    df.createOrReplaceTempView("x")
    return Dialect(spark, {"x": df.schema})


@pytest.mark.parametrize(
    "sql,rows",
    [
        ("SELECT i / j AS q FROM x ORDER BY i DESC", [2, 4, None]),
        ("SELECT CAST(i AS REAL) / j FROM x WHERE j > 0 ORDER BY i DESC", [2.5, 4.5]),
        ("SELECT i / 4.0 FROM x WHERE i = 10", [2.5]),
        ("SELECT SUM(i) / COUNT(*) FROM x", [8]),
        ("SELECT k FROM x WHERE k > 9", ["abc"]),
        ('SELECT s FROM x WHERE s = "Abc"', ["Abc"]),
        ('SELECT "s" FROM x WHERE s LIKE "ABC"', ["Abc"]),
        ("SELECT s FROM x WHERE s GLOB 'A*'", ["Abc"]),
        ("SELECT IIF(i > 9, 'big', 'small') FROM x ORDER BY i", ["small", "small", "big"]),
        ("SELECT i FROM x ORDER BY i LIMIT 1, 1", [9]),
        ("SELECT CAST('-3.5e2x' AS REAL)", [-350.0]),
        ("SELECT CAST('1.9' AS INTEGER)", [1]),
        ("SELECT CAST('x' AS INTEGER)", [0]),
        ("SELECT CAST(NULL AS REAL)", [None]),
        ("SELECT CAST(d AS INTEGER) FROM x ORDER BY i DESC", [2, -1, 0]),
        ("SELECT STRFTIME('%Y-%m', t) FROM x ORDER BY i DESC", ["2020-05", None, None]),
        ("SELECT DATE(t) FROM x ORDER BY i DESC", ["2020-05-06", None, None]),
        ("SELECT JULIANDAY('2020-01-02') - JULIANDAY('2020-01-01')", [1.0]),
        ("SELECT CAST(STRFTIME('%Y', '2020-01-01') AS INTEGER) - 1990", [30]),
        ("SELECT SUBSTR(s, 0, 2) FROM x WHERE s = 'Abc'", ["A"]),
        ("SELECT SUBSTR(s, -2) FROM x WHERE s = 'Abc'", ["bc"]),
        ("SELECT MAX(i, j) FROM x ORDER BY i", [7, 9, 10]),
        ("SELECT MAX(i) FROM x", [10]),
        ("SELECT 1 AS a UNION SELECT 2 INTERSECT SELECT 2", [2]),
        ("SELECT s || '!' FROM x WHERE s = 'xyz'", ["xyz!"]),
        ("SELECT 'it''s' -- note\n", ["it's"]),
        ("SELECT x.i / x.j FROM x WHERE x.j = 4", [2]),
        ("SELECT (i + j) / (j - 1) FROM x WHERE j = 4", [4]),
    ],
)
def test_dialect(spark, dialect, sql, rows):
    assert [r[0] for r in spark.sql(dialect.rewrite(sql)).collect()] == rows


def test_glob():
    assert glob_to_regex("a*b?[0-9].") == r"(?s)^a.*b.[0-9]\.$"


def test_audit_and_report(spark):
    verdicts = spark.createDataFrame([(1, True, "exact_match", "simple"), (2, True, "semantic_match", "simple"), (3, False, "row_count_error", "hard"), (4, False, "ambiguous_query", "moderate"), (5, False, "reference_error", "moderate"), (6, False, "strange", None)], "id INT, is_correct BOOLEAN, error_type STRING, difficulty STRING")
    s = report.summary(verdicts).first()
    assert s["correct_rate"] == pytest.approx(100 * 2 / 6) and s["lenient_rate"] == pytest.approx(100 * 4 / 6)
    assert [(r["difficulty"], r["total"]) for r in report.difficulty_breakdown(verdicts).collect()] == [("simple", 2), ("moderate", 2), ("unknown", 2)]
    assert [r[0] for r in verdicts.orderBy("id").select(report.category()).collect()] == ["correct_exact_match", "correct_equivalent", "incorrect_row_count", "ambiguous_queries", "incorrect_reference", "incorrect_unknown"]
    assert [r["id"] for r in report.select_cases(verdicts, 2, 4).orderBy("id").collect()] == [2, 3, 4]
    assert [r["id"] for r in report.select_cases(verdicts, difficulty="moderate", limit=1).collect()] == [4]
    records = spark.createDataFrame([("success", 1.0, 2, 0), ("error", 3.0, 4, 0)], "status STRING, time_seconds DOUBLE, llm_calls INT, total_tokens INT")
    assert report.eval_summary(records).first()["success_rate"] == 50.0
    case = spark.createDataFrame([("SELECT a FROM t ORDER BY a DESC", "x", None, "fewest", "data_mismatch", 1, 1, True, True)], "gt_sql STRING, pred_sql STRING, question STRING, evidence STRING, error_type STRING, gt_rows INT, pred_rows INT, gt_success BOOLEAN, pred_success BOOLEAN")
    audited = audit.audit(case)
    assert audited.first()["suspicion_type"] == "sort_direction_error" and audit.suspicion_breakdown(audited).first()["n"] == 1


def test_verify(spark):
    catalog = Catalog(spark)
    catalog.add("t", spark.createDataFrame([(1, None), (1, None), (2, None)], "a INT, b STRING"))
    adapter = SparkAdapter(catalog)
    assert verify.verify(adapter, "SELECT (a FROM t").error == "unbalanced parentheses"
    assert "illegal alias" in verify.verify(adapter, "SELECT a AS f(x) FROM t").error
    assert not verify.verify(adapter, "SELECT nope FROM t").ok
    assert verify.verify(adapter, "SELECT a FROM t WHERE a > 5").warnings == ["query returned 0 rows"]
    found = verify.verify(adapter, "SELECT b, b AS c, a FROM t")
    assert found.row_count == 3 and found.warnings == ["most cells are NULL", "result has duplicate rows"]
    assert verify.execute(adapter, "SELECT a FROM t ORDER BY a DESC LIMIT 1") == "a\n2" and verify.execute(adapter, "SELECT x", dry_run=True).startswith("Error")
