import time

import pytest

from lodestone.operators import tasks
from lodestone.plans import generate
from lodestone.sources.adapters import SparkAdapter
from lodestone.sources.catalog import TPCH, Catalog
from lodestone.sources.context_store import build_context
from lodestone.streaming.windows import on_each_batch, windowed_counts

SF = "/root/testdata/sf0.001"


def test_task_states():
    r = tasks.TaskRegistry()
    r.register("a")
    with pytest.raises(ValueError):
        r.register("a")
    with pytest.raises(ValueError):
        r.complete("a")
    with pytest.raises(KeyError):
        r.start("b")
    r.start("a")
    assert not r.all_completed()
    r.complete("a", 5)
    assert r.all_completed() and r.summary()["completed"] == 1 and r.tasks["a"].result == 5


def test_run_all():
    r = tasks.TaskRegistry()
    assert tasks.run_all({"x": lambda: 1, "y": lambda: 1 / 0}, 2, r) == {"x": 1, "y": None}
    assert r.tasks["y"].state is tasks.State.FAILED and "division" in r.tasks["y"].error


def test_timeout(spark):
    done = tasks.run_with_timeout(spark, lambda: spark.range(10).count())
    assert done.value == 10 and not done.timed_out
    late = tasks.run_with_timeout(spark, lambda: time.sleep(1.5), timeout=0.3, slow=0.1)
    assert late.timed_out and late.slow and "timeout" in late.error
    assert tasks.run_with_timeout(spark, lambda: spark.sql("SELECT nope")).error


def test_notes(spark):
    old = tasks.note(spark, "t", "k", "old", days=-1)
    kept = tasks.upsert_notes(old, tasks.note(spark, "t", "k2", "new"))
    assert {(r["key"], r["expired"]) for r in tasks.with_expired(kept).collect()} == {("k", True), ("k2", False)}
    assert tasks.upsert_notes(kept, tasks.note(spark, "t", "k", "newer")).filter("key = 'k'").first()["content"] == "newer"


@pytest.fixture(scope="module")
def shop(spark):
    catalog = Catalog.of_parquet(spark, SF, TPCH, name="shop")
    return SparkAdapter(catalog, dialect=True), build_context(catalog)


def test_one_shot(shop):
    adapter, context = shop
    model = generate.Scripted(["TABLES: nation\nCONTEXT: look", "SELECT n_name FROM nation LIMIT 0, 3"])
    out = generate.infer(model, adapter, context, "names?", loop=False)
    assert out.sql == "SELECT n_name FROM nation LIMIT 0, 3" and not out.error and out.llm_calls == 2
    assert out.tables == ["nation", "region"] and "look" in model.asked[1]
    assert out.record(1, "shop")["status"] == "success"


def test_loop_with_tools(shop):
    adapter, context = shop
    heard = []
    model = generate.Scripted([
        "TABLES: orders", "Thought: try\nAction: execute_sql\nAction Input: SELECT count(*) AS n FROM orders", "Thought: check\nAction: verify_sql\nAction Input: SELECT nope FROM orders",
        "Action: clarify_fields\nAction Input: x", 'Action: update_rich_context\nAction Input: {"table": "orders", "key": "k", "content": "c"}', "Action: nothing\nAction Input: x", "Final Answer: SELECT count(*) AS n FROM orders",
    ])
    out = generate.infer(model, adapter, context, "how many?", fields="n", on_step=heard.append)
    assert out.sql == "SELECT count(*) AS n FROM orders" and len(heard) == 6
    assert [s.observation.split(":")[0].split("\n")[0] for s in heard[:5]] == ["n", "INVALID", "n", "updated", "no tool nothing"]
    assert context["tables"]["orders"]["rich_context"]["k"]["content"] == "c"
    assert generate.result_fields(adapter, out.sql) == ["n"]


def test_failing_answer_is_kept(shop):
    adapter, context = shop
    out = generate.infer(generate.Scripted(["all", "SELECT nope FROM nation"]), adapter, context, "?", loop=False)
    assert out.error and out.record(1, "d")["status"] == "error"


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, late="60 days").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").select("window_start", "event_type", "n").collect())) == sorted(map(tuple, windowed_counts(events).select("window_start", "event_type", "n").collect()))
    seen = []
    query = on_each_batch(stream, lambda df, number: seen.append(df.count()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == events.count()


def test_judge_all(spark):
    from lodestone.operators.judge import judge_all
    from lodestone.operators.report import error_counts
    from lodestone.sources.adapters import open_adapter

    def open_database(db_id):
        return open_adapter(spark, "sqlite", folder=SF if db_id == "shop" else "/nowhere", tables=["nation", "region"])

    cases = [
        {"id": 1, "db_id": "shop", "gt_sql": "SELECT n_name FROM nation", "pred_sql": "SELECT n_name AS x FROM nation ORDER BY 1"},
        {"id": 2, "db_id": "shop", "gt_sql": "SELECT n_name FROM nation", "pred_sql": "SELECT n_name FROM nation WHERE n_nationkey > 3"},
        {"id": 3, "db_id": "gone", "gt_sql": "SELECT 1", "pred_sql": "SELECT 2"},
    ]
    verdicts = judge_all(spark, cases, open_database, 2)
    assert {r["id"]: r["error_type"] for r in verdicts.collect()} == {1: "semantic_match", 2: "row_count_error", 3: "db_connection_error"}
    assert error_counts(verdicts).count() == 3
    late = judge_all(spark, cases[:1], open_database, 1, timeout=0.0)
    assert late.first()["error_type"] == "timeout_error"


def test_folder_catalog(spark):
    assert {"nation", "orders", "events"} <= set(Catalog.of_folder(spark, SF).frames)
