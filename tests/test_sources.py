import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import context_store, judge_files, sinks
from lodestone.sources.adapters import DatabaseConnectionError, UnsupportedDatabaseError, jdbc_url, open_adapter
from lodestone.sources.catalog import TPCH, Catalog
from lodestone.sources.ddl import ForeignKey, is_numeric_type, is_text_type, parse_ddl, simple_type, split_items, strip_comments

SF = "/root/testdata/sf0.001"

DDL = """
-- a comment, with (parens
CREATE TABLE IF NOT EXISTS "a" (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL DEFAULT 'x,(y', /* gone */ ref INT REFERENCES b(id), price DECIMAL(10, 2));
CREATE TABLE b (
  id INT, `odd name` TEXT, a_id INT,
  PRIMARY KEY (id, a_id), CONSTRAINT fk FOREIGN KEY (a_id) REFERENCES a(id), CHECK (id > (1 + (2))), FOREIGN KEY (a_id) REFERENCES a (id)
);"""


def test_ddl():
    a, b = parse_ddl(DDL)
    assert a.name == "a" and [c.name for c in a.columns] == ["id", "name", "ref", "price"]
    assert a.primary_key == ["id"] and a.columns[0].primary_key
    assert a.columns[1].type == "VARCHAR(20)" and not a.columns[1].nullable and a.columns[1].default == "'x,(y'"
    assert a.columns[3].type == "DECIMAL(10, 2)"
    assert a.foreign_keys == [ForeignKey("ref", "b", "id")]
    assert b.primary_key == ["id", "a_id"] and [c.name for c in b.columns] == ["id", "odd name", "a_id"]
    assert b.foreign_keys == [ForeignKey("a_id", "a", "id")]  # once, though declared twice


def test_ddl_parts():
    assert strip_comments("a -- b\n/* c */ '--d'") == "a  \n  '--d'"
    assert split_items("a, b(c, d), 'e,f'") == ["a", "b(c, d)", "'e,f'"]
    assert parse_ddl("") == [] and parse_ddl("CREATE TABLE") == []


def test_type_names():
    assert is_text_type("varchar(3)") and not is_text_type("INT") and is_numeric_type("BIGINT") and not is_numeric_type("TEXT")
    assert [simple_type(t) for t in ("BIGINT", "VARCHAR(9)", "CLOB", "REAL", "TIMESTAMP", "BOOL", "BLOB")] == ["int", "string", "text", "float", "datetime", "boolean", "string"]


def test_catalog_keeps_declared_metadata(spark):
    catalog = Catalog(spark)
    catalog.declare(parse_ddl("CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT REFERENCES region(r_regionkey))"))
    catalog.add("nation", spark.read.parquet(f"{SF}/nation.parquet"), [], [ForeignKey("n_regionkey", "region", "r_regionkey")])
    assert catalog.tables["nation"].primary_key == ["n_nationkey"] and len(catalog.tables["nation"].foreign_keys) == 1
    assert catalog.row_counts().collect()[0].asDict() == {"table_name": "nation", "row_count": 25}
    assert catalog.totals().first().asDict() == {"total_tables": 1, "total_rows": 25}
    assert [r["column_name"] for r in catalog.columns_df().collect()] == ["n_nationkey", "n_name", "n_regionkey"]


def test_adapters(spark):
    with pytest.raises(UnsupportedDatabaseError):
        open_adapter(spark, "oracle")
    with pytest.raises(DatabaseConnectionError):
        open_adapter(spark, "parquet", folder="/nowhere", tables=["t"])
    adapter = open_adapter(spark, "sqlite", folder=SF, tables=["nation", "region"])
    outcome = adapter.query("SELECT n_name, n_name FROM nation LIMIT 1, 2")
    assert outcome.error is None and outcome.columns == ["n_name", "n_name_2"] and outcome.df.count() == 2
    assert adapter.dry_run("SELECT nope FROM nation") and adapter.dry_run("SELECT 1") is None
    assert adapter.version() == spark.version
    assert jdbc_url("postgresql", "h", 1, "d") == "jdbc:postgresql://h:1/d?sslmode=disable"


def test_result_files(spark, tmp_path):
    results = [{"db_id": "d", "question": "q1", "gold_sql": "SELECT 1", "generated_sql": "SELECT  2\n;", "status": "success", "time_seconds": 1.5, "llm_calls": 2}, {"db_id": "d", "question": "q2", "gold_sql": "SELECT 1", "generated_sql": "", "status": "error", "difficulty": "simple"}]
    (tmp_path / "r.json").write_text(json.dumps(results))
    cases = judge_files.read_result_array(spark, str(tmp_path / "r.json")).orderBy("id").collect()
    assert [(c["id"], c["question"], c["difficulty"]) for c in cases] == [(1, "q1", "unknown"), (2, "q2", "simple")]
    (tmp_path / "c.jsonl").write_text('{"id": 1, "gt_sql": "SELECT 1"}\nnot json\n{"id": 2}\n')
    assert [r["id"] for r in judge_files.read_case_lines(spark, str(tmp_path / "c.jsonl")).orderBy("id").collect()] == [1, 2]
    assert judge_files.read_tags(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "t.json").write_text('[{"db_id": "d", "query": "q", "spj_type": null}, {"db_id": "d", "query": "q", "spj_type": "limit_1_tied_values"}]')
    tagged = judge_files.merge_tags(judge_files.read_result_array(spark, str(tmp_path / "r.json")), judge_files.read_tags(spark, str(tmp_path / "t.json")))
    assert {r["id"]: r["spj_type"] for r in tagged.collect()} == {1: None, 2: "limit_1_tied_values"}
    (tmp_path / "gold.sql").write_text("SELECT 1\tdb_a\n\nSELECT 'a\tb'\tdb_b\n")
    assert sorted((r["sql"], r["db_id"]) for r in judge_files.read_sql_lines(spark, str(tmp_path / "gold.sql")).collect()) == [("SELECT 'a\tb'", "db_b"), ("SELECT 1", "db_a")]


def test_judged_folders(spark, tmp_path):
    for kind, i in (("row_count", 1), ("data_mismatch", 2)):
        folder = tmp_path / f"incorrect_{kind}"
        folder.mkdir()
        (folder / f"incorrect_{kind}_{i}.json").write_text(json.dumps({"id": i, "gt_sql": "a", "pred_sql": "b", "gt_result": {"Success": True, "Error": "", "Rows": [["h"], ["1"]]}, "pred_result": None}, indent=1))
    (tmp_path / "summary_report.json").write_text('{"id": 1}')
    errors = {r["id"]: r for r in judge_files.read_error_cases(spark, str(tmp_path)).collect()}
    assert {i: (r["error_type"], r["gt_rows"], r["pred_rows"], r["gt_success"], r["pred_success"]) for i, r in errors.items()} == {1: ("row_count", 1, 0, True, False), 2: ("data_mismatch", 1, 0, True, False)}
    assert {r["id"] for r in judge_files.read_judged_folder(spark, str(tmp_path)).collect()} == {1, 2}
    for run in ("20260101_000000_react", "20260201_000000_one_shot", "other"):
        os.makedirs(tmp_path / "res" / "bird" / run)
    assert [r["mode"] for r in judge_files.discover_results(str(tmp_path / "res"))] == ["one_shot", "react"]
    assert judge_files.discover_results(str(tmp_path / "nothing")) == []


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([(2, "d", "SELECT  1\n+ 1"), (1, "d", None)], "id INT, db_id STRING, generated_sql STRING")
    sinks.write_predictions(records, str(tmp_path / "p"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert set(lines) == {"SELECT 1 + 1\td", "SELECT 1\td"}
    for _ in range(2):
        sinks.append_records(records, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    verdicts = spark.createDataFrame([(1, True, "exact_match", ""), (2, False, "row_count_error", "x"), (3, True, "spj_correct", "")], "id INT, is_correct BOOLEAN, error_type STRING, error_reason STRING").withColumn("difficulty", F.lit("simple"))
    sinks.write_classified(verdicts, str(tmp_path / "c"))
    assert sorted(f for f in os.listdir(tmp_path / "c") if "=" in f) == ["category=correct_exact_match", "category=incorrect_row_count"]
    sinks.write_summary(verdicts, str(tmp_path / "s"))
    got = spark.read.json(str(tmp_path / "s")).first()
    assert (got["total"], got["correct_count"], got["equivalent_count"], got["error_count"]) == (3, 1, 1, 1)
    assert got["error_counts"][0].asDict() == {"error_type": "row_count_error", "n": 1}


def test_context_round_trip(spark, tmp_path):
    catalog = Catalog.of_parquet(spark, SF, TPCH, name="shop")
    notes = {"orders": {"meaning": "plain text", "old": {"content": "late", "expires_at": "2020-01-01T00:00:00Z"}, "x_columns": "hidden", "quality_issue_1": "hidden"}}
    context = context_store.build_context(catalog, notes)
    context_store.save_context(spark, context, str(tmp_path / "ctx"))
    again = context_store.load_context(spark, str(tmp_path / "ctx"))
    assert again["total_tables"] == 7 and again["total_rows"] == sum(df.count() for df in catalog.frames.values())
    assert again["tables"]["orders"]["rich_context"]["meaning"] == {"content": "plain text", "expires_at": None}
    assert "lineitem->region" in again["join_paths"]

    from lodestone.plans import render

    text = render.compact_prompt(again, ["orders", "nowhere"])
    assert "Table orders" in text and "o_custkey: BIGINT → customer.c_custkey" in text and "values=[" in text and "range=[" in text
    assert "Meaning: plain text" in text and "Old: late [EXPIRED]" in text and "hidden" not in text
    assert render.linking_schema(again, ["region", "nation"]) == "region (r_regionkey*, r_name) | nation (n_nationkey*, n_name, n_regionkey)"
    assert 'region ||--o{ nation : "has"' in render.er_diagram(catalog)
    assert render.cross_table_summary(again) == ""
    assert "## Join paths" in render.full_prompt(again) and "## Table: orders" in render.table_prompt(again, "orders")
    assert render.format_key("order_dATE_x") == "Order DATE X"
    assert "Table nation" in render.basic_schema(catalog)
    assert render.table_infos(again)["orders"]["description"] == "plain text"
    assert "lineitem->region" in render.join_paths_text(again)


def test_notes_as_json_text(spark):
    df = spark.createDataFrame([('"plain"',), ('{"content": "c", "expires_at": "2020-01-01T00:00:00Z"}',), ("raw",), (None,)], "note STRING")
    got = [(r["content"], r["expires_at"]) for r in context_store.coerce_notes(df).collect()]
    assert got == [("plain", None), ("c", "2020-01-01T00:00:00Z"), ("raw", None), (None, None)]
