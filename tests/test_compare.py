import pytest
from pyspark.sql import functions as F, types as T

from lodestone.functions.canonical import canonical, loosely_equal, normalized
from lodestone.operators import compare
from lodestone.sources.adapters import SparkAdapter
from lodestone.sources.catalog import Catalog


def frame(spark, rows, schema="a STRING, b INT"):
    return spark.createDataFrame(rows, schema)


def test_equal_after_reordering(spark):
    a = frame(spark, [("x", 1), ("y", 2)])
    got = compare.compare_results(a, frame(spark, [(2, "y"), (1, "x")], "B INT, A STRING"))
    assert got.equal and got.strategy == "exact_column_names"


def test_renamed_columns(spark):
    a = frame(spark, [("x", 1), ("y", 2), ("y", 2)])
    got = compare.compare_results(a, frame(spark, [(2, "y"), (1, "x"), (2, "y")], "p INT, q STRING"))
    assert got.equal and got.strategy == "column_mapping"
    by_order = compare.compare_results(a, frame(spark, [(1, "x"), (2, "y"), (2, "y")], "p INT, q STRING"), row_order=True)
    assert by_order.equal and by_order.strategy == "column_mapping"


def test_positional_mismatch(spark):
    got = compare.compare_results(frame(spark, [("x", 1)]), frame(spark, [("z", 9)], "p STRING, q INT"))
    assert not got.equal and got.reason == "column name mismatch and positional data mismatch" and compare.classify_error_text(got.reason) == "data_mismatch"


def test_duplicates_matter(spark):
    a, b = frame(spark, [("x", 1), ("x", 1), ("y", 1)]), frame(spark, [("x", 1), ("y", 1), ("y", 1)])
    assert not compare.same_multiset(a, b) and compare.same_set(a, b)
    assert {tuple(r) for r in compare.row_differences(a, b).collect()} == {("x", 1, 2, 1), ("y", 1, 1, 2)}
    assert compare.compare_results(a, b).reason == "data mismatch"


def test_counts_come_first(spark):
    assert compare.compare_results(frame(spark, [("x", 1)]), frame(spark, [("x", 1), ("x", 1)])).reason == "row count mismatch: gold=1, pred=2"
    assert compare.compare_results(frame(spark, [("x", 1)]), frame(spark, [])).reason == "row count mismatch: gold=1, pred=0"
    assert compare.compare_results(frame(spark, [("x", 1)]), frame(spark, [("x",)], "a STRING")).reason.startswith("column count mismatch")
    assert compare.compare_results(frame(spark, []), frame(spark, [], "z INT")).equal
    distinct = compare.compare_results(frame(spark, [("x", 1), ("y", 1)]), frame(spark, [("x", 1), ("x", 1)]))
    assert distinct.reason == "data row count mismatch: gold=2, pred=1"


def test_types_and_nulls(spark):
    assert compare.compare_results(frame(spark, [("x", 3), (None, None)]), frame(spark, [("x", 3.0), (None, None)], "a STRING, b DOUBLE")).equal
    assert not compare.compare_results(frame(spark, [(None, 1)]), frame(spark, [("<nil>", 1)])).equal


def test_normalized_pass(spark):
    a = frame(spark, [("50%",), ("2020-01-01 00:00:00 +0000 UTC",), (" a ",)], "a STRING")
    got = compare.compare_results(a, frame(spark, [("a",), ("50",), ("2020-01-01 00:00:00.25",)], "a STRING"))
    assert got.equal and got.normalized


@pytest.mark.parametrize("value,text", [(3.0, "3"), (-0.0, "0"), (0.1, "0.1"), (1e7, "10000000"), (1.5e-5, "0.000015"), (12345678.25, "12345678.25"), (1e20, "100000000000000000000"), (-1e25, "-10000000000000000000000000"), (1e-300, "1.0E-300"), (-2.5e-9, "-0.0000000025"), (float("inf"), "Infinity"), (float("nan"), "NaN"), (None, None)])
def test_canonical_doubles(spark, value, text):
    df = spark.createDataFrame([(value,)], "v DOUBLE")
    assert df.select(canonical(F.col("v"), T.DoubleType())).first()[0] == text


def test_canonical_others(spark):
    df = spark.sql("SELECT true AS t, 1.50BD AS d, 7 AS i, array(1, 2) AS a")
    got = df.select(*[canonical(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(got) == ("true", "1.5", "7", "[1,2]")


def test_loose_values(spark):
    df = spark.createDataFrame([(" 1.0", "1", True), ("12ab", "12", True), ("a", "a ", True), ("a", "b", False), (None, None, True), (None, "a", False)], "a STRING, b STRING, same BOOLEAN")
    assert all(r[0] == r[1] for r in df.select(loosely_equal(F.col("a"), F.col("b")), "same").collect())
    assert spark.createDataFrame([("2020-01-01 10:00:00 UTC",)], "a STRING").select(normalized(F.col("a"))).first()[0] == "2020-01-01 10:00:00"


def test_limit_one(spark):
    gold, other = frame(spark, [("x", 1)]), frame(spark, [("y", 1)])
    assert compare.limit_one_compatible("SELECT a FROM t LIMIT 1", gold, other)[0]  # any one row
    assert compare.limit_one_compatible("SELECT a FROM t LIMIT 1", gold, frame(spark, [("x", 1), ("y", 1)]))[0]
    assert not compare.limit_one_compatible("SELECT a FROM t LIMIT 1", gold, frame(spark, []))[0]
    assert not compare.limit_one_compatible("SELECT a FROM t LIMIT 10", gold, other)[0]
    ranked = frame(spark, [("x", 1), ("y", 1), ("z", 2)])
    strict = lambda pred: compare.limit_one_strict(ranked, [F.col("b")], pred).first()["correct"]
    assert strict(other) and not strict(frame(spark, [("z", 2)])) and not strict(frame(spark, []))


def test_error_cascade(spark):
    for reason, kind in [("Gold SQL execution error: x row count mismatch", "reference_error"), ("syntax error", "execution_error"), ("row count mismatch; column count mismatch", "row_count_error"), ("column name mismatch, value mismatch", "data_mismatch"), ("column name mismatch", "projection_error"), ("value mismatch", "data_mismatch"), ("ORDER by", "order_error"), ("join", "join_error"), ("condition", "condition_error"), ("", "unknown_error"), ("?", "other_error")]:
        df = spark.createDataFrame([(reason,)], "r STRING")
        assert df.select(compare.classify_error(F.col("r"))).first()[0] == kind == compare.classify_error_text(reason)


def test_judge(spark):
    catalog = Catalog(spark)
    catalog.add("t", frame(spark, [("x", 1), ("y", 2)]))
    adapter = SparkAdapter(catalog)
    judge = lambda gold, pred, **more: compare.judge({"id": 1, "gt_sql": gold, "pred_sql": pred, **more}, adapter)
    assert judge("SELECT 1", "AMBIGUOUS_QUERY").error_type == "ambiguous_query"
    assert judge("SELECT 1", "").error_reason == "predicted SQL is empty"
    assert judge("SELECT a FROM t;", "select  A from T").error_type == "exact_match"
    assert judge("SELECT nope FROM t", "SELECT a FROM t").error_type == "reference_error"
    assert judge("SELECT a FROM t", "SELECT nope FROM t").error_type == "execution_error"
    assert judge("SELECT a, b FROM t", "SELECT b, a FROM t ORDER BY 1").error_type == "semantic_match"
    assert judge("SELECT a FROM t", "SELECT a FROM t WHERE b = 1").error_type == "row_count_error"
    assert judge("SELECT a FROM t ORDER BY b LIMIT 1", "SELECT a FROM t WHERE b = 2", spj_type="limit_1_tied_values").error_type == "spj_correct"
    assert judge("SELECT a FROM t", "SELECT cast(a AS INT) FROM t").error_type == "execution_error"


def test_millions_of_equal_values(spark):
    """Signatures of columns add up without overflow, also where one value fills a column."""
    a = spark.range(5_000_000).select(F.lit("same").alias("a"), (F.col("id") % 1000).alias("b"))
    got = compare.compare_results(a, a.select(F.col("b").alias("x"), F.col("a").alias("y")))
    assert got.equal and got.strategy == "column_mapping"
    assert not compare.compare_results(a, a.select((F.col("b") + F.when(F.col("b") == 7, 1).otherwise(0)).alias("x"), F.col("a").alias("y"))).equal
