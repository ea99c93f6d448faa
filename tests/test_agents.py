"""Databases over JDBC, models with time limits, and the agents' tools."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import audit, tasks
from lodestone.plans import generate
from lodestone.sources import jdbc
from lodestone.sources.adapters import SparkAdapter
from lodestone.sources.catalog import Catalog
from lodestone.sources.context_store import build_context


@pytest.fixture
def shop(spark):
    found = Catalog(spark)
    found.add("city", spark.createDataFrame([(1, "Rome"), (2, "Oslo")], "id INT, name STRING"), ["id"])
    found.add("trip", spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id INT, city_id INT"), ["id"])
    return SparkAdapter(found), build_context(found)


@pytest.mark.parametrize("kind", ["mysql", "postgresql"])
def test_database_metadata(spark, kind):
    answers = {
        jdbc.COLUMNS: [("city", "id", 1, "int", "NO", None), ("city", "name", 2, "varchar", "YES", "'x'"), ("trip", "id", 1, "bigint", "NO", None), ("trip", "city_id", 2, "int", "YES", None)],
        jdbc.PRIMARY_KEYS: [("city", "id", 1), ("trip", "id", 1)],
        jdbc.FOREIGN_KEYS[kind]: [("trip", "city_id", "city", "id")],
        jdbc.INDEXES[kind]: [("city", "by_name", "name", 1, 0, 0), ("trip", "PRIMARY", "id", 1, 1, 1)],
        jdbc.VERSION: [("9.9",)],
    }
    names = {jdbc.COLUMNS: "table_name, column_name, ordinal_position, data_type, is_nullable, column_default", jdbc.PRIMARY_KEYS: "table_name, column_name, ordinal_position", jdbc.FOREIGN_KEYS[kind]: "table_name, column_name, referenced_table, referenced_column", jdbc.INDEXES[kind]: "table_name, index_name, column_name, place, is_unique, is_primary", jdbc.VERSION: "version"}
    asked = []

    def run(sql):
        asked.append(sql)
        key = next(k for k in answers if k.replace("{own}", jdbc._OWN[kind]) == sql)
        columns = [c.strip().upper() for c in names[key].split(",")]  # some systems answer in capitals
        whole = ("ORDINAL_POSITION", "PLACE", "IS_UNIQUE", "IS_PRIMARY")
        return spark.createDataFrame(answers[key], ", ".join(f"{c} {'INT' if c in whole else 'STRING'}" for c in columns))

    source = jdbc.JdbcSource(spark, kind, "jdbc:none", run=run)
    city, trip = source.definitions()
    assert [c.name for c in city.columns] == ["id", "name"] and city.primary_key == ["id"] and city.columns[1].default == "'x'" and not city.columns[0].nullable
    assert [(fk.column, fk.referenced_table) for fk in trip.foreign_keys] == [("city_id", "city")]
    assert city.indexes[0].columns == ["name"] and not city.indexes[0].unique and trip.indexes[0].primary
    assert source.version() == "9.9" and all("{own}" not in a for a in asked)


def test_large_tables_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Over the database that Spark brings along."""
    url = f"jdbc:derby:{tmp_path}/shop;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("v")).write.format("jdbc").options(url=url, dbtable="numbers", **options).save()
    except Exception as e:
        pytest.skip(f"no embedded database: {e}")
    monkeypatch.setattr(jdbc, "PARTITION_ROWS", 20)
    source = jdbc.JdbcSource(spark, "postgresql", url, options)
    df = source.table("numbers", "id")
    assert df.rdd.getNumPartitions() == 5 and df.count() == 100 and df.agg(F.sum(df.columns[1])).first()[0] == 9900
    assert source.table("numbers").rdd.getNumPartitions() == 1


def test_tables_with_other_keys_are_read_in_parts(spark, tmp_path, monkeypatch):
    """Text and composite keys, most rows with one beginning, quotes in keys, a name in mixed case."""
    url = f"jdbc:derby:{tmp_path}/shop;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(f"O'Neil {i:04d}" if i % 10 else chr(97 + i % 26) + str(i), i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, part int, v long")
    try:
        df.write.format("jdbc").options(url=url, dbtable='"Some Names"', createTableColumnTypes="name VARCHAR(40)", **options).save()
    except Exception as e:
        pytest.skip(f"no embedded database: {e}")
    monkeypatch.setattr(jdbc, "PARTITION_ROWS", 30)
    # this database numbers rows without an order of its own, so they are ordered first
    source = jdbc.JdbcSource(spark, "postgresql", url, options, ranked="SELECT o.*, ROW_NUMBER() OVER () AS place FROM (SELECT {columns} FROM {source} ORDER BY {columns}) o")
    assert source.quoted("Some Names") == '"Some Names"' and source.quoted("order") == '"order"' and source.quoted("plain_1") == "plain_1"
    for key in (["name"], ["part", "name"], ["name", "v"]):
        got = source.table("Some Names", key)
        sizes = [len(p) for p in got.rdd.glom().collect()]
        assert len(sizes) == 7 and max(sizes) <= 32 and sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str), (key, sizes)


def test_model_phase_of_the_audit(spark):
    rows = [(1, "SELECT CURRENT_DATE", "x", "now?", "", "data_mismatch", 1, 1, True, True), (2, "SELECT a FROM t", "SELECT b FROM t", "which b?", "", "data_mismatch", 1, 1, True, True), (3, "SELECT a FROM t", "SELECT c FROM t", "slow?", "", "data_mismatch", 1, 1, True, True), (4, "SELECT a FROM t", "SELECT d FROM t", "fine?", "", "data_mismatch", 1, 1, True, True), (5, "SELECT a FROM t", "SELECT e FROM t", "fails?", "", "data_mismatch", 1, 1, True, True)]
    cases = audit.audit(spark.createDataFrame(rows, "id INT, gt_sql STRING, pred_sql STRING, question STRING, evidence STRING, error_type STRING, gt_rows INT, pred_rows INT, gt_success BOOLEAN, pred_success BOOLEAN"))

    def model(prompt):
        if "slow?" in prompt:
            time.sleep(5)
        if "fails?" in prompt:
            raise ValueError("no answer")
        return '{"verdict": "PRED_BETTER", "explanation": "b was asked for"}' if "which b?" in prompt else '{"verdict": "GOLD_CORRECT"}'

    began = time.time()
    found = {r["id"]: (r["suspicion_type"], r["phase"]) for r in audit.audit_with_model(cases, model, timeout=1.0).collect()}
    assert found == {1: ("current_timestamp_dependency", "rule"), 2: ("pred_better", "model"), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert time.time() - began < 30


def test_answers_within_their_time():
    out = tasks.ask_all({"quick": "a", "slow": "b"}, lambda p: time.sleep(3) if p == "b" else p.upper(), timeout=0.5)
    assert out["quick"].value == "A" and not out["quick"].timed_out and out["slow"].timed_out and out["slow"].value is None


def test_linking_with_tools(shop):
    adapter, context = shop
    model = generate.Scripted(["Thought: look\nAction: execute_sql\nAction Input: SELECT name FROM city", "TABLES: city\nCONTEXT: names are in city", "Final Answer: SELECT name FROM city"])
    out = generate.infer(model, adapter, context, "names?", rules="bird", link_loop=True)
    assert out.tables == ["city"] and out.sql == "SELECT name FROM city" and out.llm_calls == 3 and not out.error
    assert [s.phase for s in out.steps] == ["link", "link", "react"] and "Rome" in out.steps[0].observation
    assert generate.RULES["bird"] in model.asked[-1] and "names are in city" in model.asked[-1]


def test_several_actions_of_one_answer(shop):
    adapter, context = shop
    model = generate.Scripted(["TABLES: all", "Thought: both\nAction: execute_sql\nAction Input: SELECT count(*) AS n FROM city\nAction: execute_sql\nAction Input: SELECT count(*) AS n FROM trip\nAction: nothing\nAction Input: x", "Final Answer: SELECT id FROM trip"])
    out = generate.infer(model, adapter, context, "ids?")
    assert [s.observation for s in out.steps[:3]] == ["n\n2", "n\n3", "no tool nothing"] and out.sql == "SELECT id FROM trip"


def test_fields_are_described():
    model = generate.Scripted(["- `name`: the city's name\ntotal: number of trips"])
    assert generate.describe_fields(model, "q", "s", ["name", "total", "other"]) == "name: the city's name; total: number of trips; other"


def test_worker_and_coordinator_tools(shop):
    adapter, context = shop
    run, note = generate.worker_tools(adapter, context, "city")
    assert run("SELECT COUNT(*) FROM city").endswith("2") and context["tables"]["city"]["rich_context"]["city_rowcount"]["expires_at"] is None
    assert note('{"key": "meaning", "content": "places"}') == "noted" and note("{}").startswith("Error")
    assert context["tables"]["city"]["rich_context"]["meaning"]["expires_at"].endswith("Z")
    registry = tasks.TaskRegistry()
    (ask,) = generate.coordinator_tools(adapter, registry)
    ask("SELECT 'city' AS t UNION ALL SELECT 'trip' UNION ALL SELECT 'nowhere'")
    ask("SELECT 'city' AS t")
    assert sorted(registry.tasks) == ["city", "trip"]
