from lodestone.operators.profile import column_stats, orphan_counts, orphan_issues, profile_table, quality_issues, top_values, whitespace_examples
from lodestone.sources.catalog import Catalog
from lodestone.sources.ddl import ForeignKey


def test_dirty_text(spark):
    df = spark.createDataFrame([(v,) for v in (" a", "a ", "", *[None] * 6, "b")], "c STRING")
    s = column_stats(df, "t").first()
    assert (s["row_count"], s["null_count"], s["null_percent"], s["distinct_count"], s["empty_count"], s["whitespace_count"], s["filled_count"]) == (10, 6, 60.0, 4, 1, 2, 3)
    issues = {r["type"]: r for r in quality_issues(column_stats(df, "t"), whitespace_examples(df, ["c"])).collect()}
    assert set(issues) == {"whitespace", "null_heavy", "empty_string"}
    assert issues["whitespace"]["severity"] == "critical" and issues["whitespace"]["examples"] == [" a", "a "]
    assert issues["whitespace"]["sql_fix"] == 'TRIM("c")' and issues["null_heavy"]["description"] == "60% NULL values (6/10)"


def test_numeric_text(spark):
    def flagged(values):
        df = spark.createDataFrame([(v,) for v in values], "c STRING")
        return [r["type"] for r in quality_issues(column_stats(df, "t")).collect()]

    assert flagged(["12", "3", "2020-01-01", "1:23", "9", "x"]) == ["type_mismatch"]
    assert flagged(["-5", ".5", "1", "2", "3"]) == []  # the first two do not look numeric
    assert flagged(["1", "2", "3", "4"]) == []  # too few


def test_whitespace_count_is_exact(spark):
    df = spark.createDataFrame([(f" v{i}",) for i in range(20)], "c STRING")
    assert column_stats(df, "t").first()["whitespace_count"] == 20


def test_numbers_and_empty_table(spark):
    df = spark.createDataFrame([(1, 2.0), (None, -0.0), (3, 0.0)], "i INT, d DOUBLE")
    i, d = column_stats(df, "t").collect()
    assert (i["min_value"], i["max_value"], i["avg_value"], i["distinct_count"], i["empty_count"]) == (1.0, 3.0, 2.0, 2, 0)
    assert d["distinct_count"] == 2  # -0.0 equals 0.0
    empty = column_stats(df.limit(0), "t").collect()
    assert [r["row_count"] for r in empty] == [0, 0] and quality_issues(column_stats(df.limit(0), "t")).count() == 0
    assert column_stats(df, "t", approximate=True).collect()[0]["distinct_count"] == 2


def test_odd_names_and_nested_columns(spark):
    df = spark.createDataFrame([("a", [1], 1)], "`x y` STRING, arr ARRAY<INT>, `n` INT")
    assert [r["column_name"] for r in column_stats(df, "t").collect()] == ["x y", "n"]


def test_top_values_gate_and_ties(spark):
    df = spark.createDataFrame([(f"v{i % 30:02}", f"w{i % 31:02}") for i in range(31 * 30)], "low STRING, high STRING")
    rows = top_values(df, "t", ["low", "high"]).orderBy("position").collect()
    assert {r["column_name"] for r in rows} == {"low"} and [r["value"] for r in rows] == [f"v{i:02}" for i in range(15)]


def test_orphans_leave_out_nulls(spark):
    catalog = Catalog(spark)
    catalog.add("parent", spark.createDataFrame([(1,), (2,)], "id INT"), ["id"])
    catalog.add("child", spark.createDataFrame([(1,), (2,), (99,), (None,)], "fk INT"), [], [ForeignKey("fk", "parent", "id")])
    counts = orphan_counts(catalog)
    assert counts.first()["orphan_count"] == 1
    assert orphan_issues(counts).first()["affected_ops"] == ["JOIN"]
    assert profile_table(catalog, "child").issues.count() == 0


def test_whitespace_examples_are_the_least(spark):
    rows = [(f" v{i:04d}", None if i % 2 else "clean") for i in range(1000)] + [(" v0000", " x")]
    df = spark.createDataFrame(rows, "a STRING, b STRING").repartition(7)
    got = {r["column_name"]: r["examples"] for r in whitespace_examples(df, ["a", "b"]).collect()}
    assert got == {"a": [" v0000", " v0001", " v0002"], "b": [" x"]}


def test_places_over_a_whole_table(spark):
    from lodestone.operators.ranking import placed

    rows = [(i, float((i * 37) % 101) if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id LONG, v DOUBLE").repartition(5)
    got = {r["id"]: r["p"] for r in placed(df, "v", "p", descending=True, ties=True).collect()}
    known = [v for _, v in rows if v is not None]
    assert all(got[i] == (sum(x > v for x in known) if v is not None else len(known)) + 1 for i, v in rows)
    assert sorted(r["p"] for r in placed(df, "id", "p").collect()) == list(range(1, 2001))
