"""Jobs of a run: states, shared notes, and bounded parallel execution with time limits."""

from __future__ import annotations

import enum
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F


class State(enum.Enum):
    REGISTERED = "registered"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"


#: Which state may follow which.
NEXT = {State.REGISTERED: {State.RUNNING}, State.RUNNING: {State.COMPLETED, State.FAILED}, State.COMPLETED: set(), State.FAILED: set()}


@dataclass
class Task:
    id: str
    state: State = State.REGISTERED
    result: object = None
    error: str = ""
    started: float = 0.0
    ended: float = 0.0


@dataclass
class TaskRegistry:
    """Tasks by id, safe for threads."""

    tasks: dict[str, Task] = field(default_factory=dict)
    data: dict[str, object] = field(default_factory=dict)
    lock: threading.RLock = field(default_factory=threading.RLock)

    def register(self, id: str) -> Task:
        with self.lock:
            if id in self.tasks:
                raise ValueError(f"task {id} is registered already")
            task = self.tasks[id] = Task(id)
            return task

    def _move(self, id: str, state: State, **values) -> Task:
        with self.lock:
            if id not in self.tasks:
                raise KeyError(f"no task {id}")
            task = self.tasks[id]
            if state not in NEXT[task.state]:
                raise ValueError(f"task {id} is {task.state.value}, not {state.value} next")
            task.state = state
            for k, v in values.items():
                setattr(task, k, v)
            return task

    def start(self, id: str) -> Task:
        return self._move(id, State.RUNNING, started=time.time())

    def complete(self, id: str, result=None) -> Task:
        return self._move(id, State.COMPLETED, result=result, ended=time.time())

    def fail(self, id: str, error: str) -> Task:
        return self._move(id, State.FAILED, error=error, ended=time.time())

    def all_completed(self) -> bool:
        with self.lock:
            return all(t.state is State.COMPLETED for t in self.tasks.values())

    def summary(self) -> dict[str, int]:
        with self.lock:
            return {s.value: sum(t.state is s for t in self.tasks.values()) for s in State}


#: Days after which a note is out of date. Fixed value.
NOTE_DAYS = 7


def upsert_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes (table_name, key, content, expires_at) with the rows of `new` in place of those of the same table and key."""
    return notes.join(new.select("table_name", "key"), ["table_name", "key"], "left_anti").select(*new.columns).unionByName(new)


def note(spark: SparkSession, table: str, key: str, content: str, days: int | None = NOTE_DAYS, now: datetime | None = None) -> DataFrame:
    """One note as a row; without days it does not expire."""
    now = now or datetime.now(timezone.utc)
    expires = (now + timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ") if days is not None else None
    return spark.createDataFrame([(table, key, content, expires)], "table_name string, key string, content string, expires_at string")


def with_expired(notes: DataFrame, now=None) -> DataFrame:
    """notes with expired: whether expires_at has passed; unreadable or missing times never expire."""
    at = F.lit(now) if now is not None else F.current_timestamp()
    return notes.withColumn("expired", F.coalesce(F.try_to_timestamp("expires_at") < at, F.lit(False)))


@dataclass
class JobOutcome:
    value: object = None
    error: str = ""
    timed_out: bool = False
    slow: bool = False
    seconds: float = 0.0


#: Seconds after which a job is cancelled, and after which it counts as slow; jobs at a time. Fixed values.
TIMEOUT, SLOW, WORKERS = 120.0, 3.0, 8


def run_with_timeout(spark: SparkSession, work, timeout: float = TIMEOUT, slow: float = SLOW) -> JobOutcome:
    """work() in its own job group, cancelled on the cluster when its time is up."""
    from pyspark import InheritableThread

    group, out = uuid.uuid4().hex, JobOutcome()

    def body():
        spark.sparkContext.setJobGroup(group, "judged query", interruptOnCancel=True)
        try:
            out.value = work()
        except Exception as e:
            out.error = str(e).splitlines()[0] if str(e) else type(e).__name__

    thread = InheritableThread(target=body)
    began = time.time()
    thread.start()
    thread.join(timeout)
    if thread.is_alive():
        out.timed_out = True
        spark.sparkContext.cancelJobGroup(group)
        thread.join(10)
        out.error = out.error or f"timeout after {timeout:g} s"
    out.seconds = time.time() - began
    out.slow = out.seconds > slow
    return out


def run_all(works: dict[str, object], workers: int = WORKERS, registry: TaskRegistry | None = None) -> dict[str, object]:
    """Results of independent functions by name, at most `workers` at a time; a failure is kept as the task's error."""
    registry = registry or TaskRegistry()
    for name in works:
        registry.register(name)

    def one(name):
        registry.start(name)
        try:
            result = works[name]()
        except Exception as e:
            registry.fail(name, str(e))
            return None
        registry.complete(name, result)
        return result

    with ThreadPoolExecutor(max(1, min(workers, len(works) or 1))) as pool:
        return dict(zip(works, pool.map(one, works)))


#: Seconds that a model may take for an answer, and answers at a time. Fixed values.
ANSWER_TIMEOUT, ASKING = 60.0, 4


def ask_all(prompts: dict[str, str], generator, workers: int = ASKING, timeout: float = ANSWER_TIMEOUT) -> dict[str, JobOutcome]:
    """A model's answers by name, at most `workers` at a time; an error or a call over its time is told in the outcome.

    A call that is over its time cannot be stopped from here; its thread is left behind and its answer dropped.
    """

    def ask(prompt: str) -> JobOutcome:
        out, began = JobOutcome(), time.time()

        def body():
            try:
                out.value = generator(prompt)
            except Exception as e:
                out.error = str(e) or type(e).__name__

        thread = threading.Thread(target=body, daemon=True)
        thread.start()
        thread.join(timeout)
        if thread.is_alive():
            return JobOutcome(None, f"timeout after {timeout:g} s", True, True, time.time() - began)
        out.seconds = time.time() - began
        return out

    return run_all({name: (lambda p=prompt: ask(p)) for name, prompt in prompts.items()}, workers)
