"""From question to statement: linking, prompt, one answer or a loop with tools. The model is a plug-in; nothing here needs a network."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Protocol

from ..functions.sqltext import extract_sql, query_type_text
from ..operators.graph import parse_link_output, resolve_selection, safe_selection, with_linked_tables
from ..operators.tasks import NOTE_DAYS, TaskRegistry, run_all
from ..operators.verify import execute, verify
from ..sources.adapters import SparkAdapter
from .render import compact_prompt, cross_table_summary, linking_schema, table_infos

MAX_STEPS = 15


class Generator(Protocol):
    """Anything that answers a prompt."""

    def __call__(self, prompt: str) -> str: ...


@dataclass
class Scripted:
    """A generator with prepared answers, then `SELECT 1`; keeps what it was asked."""

    answers: list[str]
    asked: list[str] = field(default_factory=list)

    def __call__(self, prompt: str) -> str:
        self.asked.append(prompt)
        return self.answers[len(self.asked) - 1] if len(self.asked) <= len(self.answers) else "Final Answer: SELECT 1"


@dataclass
class Step:
    step: int
    thought: str = ""
    action: str = ""
    action_input: str = ""
    observation: str = ""
    phase: str = "react"


@dataclass
class Inference:
    question: str
    tables: list[str] = field(default_factory=list)
    sql: str = ""
    steps: list[Step] = field(default_factory=list)
    llm_calls: int = 0
    seconds: float = 0.0
    error: str = ""

    def record(self, id: int, db_id: str, **more) -> dict:
        """The evaluation record of this run."""
        return {"id": id, "db_id": db_id, "question": self.question, "generated_sql": self.sql, "status": "error" if self.error else "success", "error": self.error, "time_seconds": self.seconds, "llm_calls": self.llm_calls, "total_tokens": 0, "selected_tables": self.tables, "react_steps": [vars(s) for s in self.steps], **more}


@dataclass
class Tool:
    """A named function on text."""

    name: str
    description: str
    call: object

    def __call__(self, argument: str) -> str:
        return self.call(argument)


def tools_of(adapter: SparkAdapter, context: dict, fields: str = "") -> list[Tool]:
    """execute_sql, verify_sql, clarify_fields and update_rich_context over one database."""

    def check(sql: str) -> str:
        found = verify(adapter, sql)
        if not found.ok:
            return f"INVALID: {found.error}"
        return f"VALID: {found.row_count} rows; sample {found.sample}" + "".join(f"\nWARNING: {w}" for w in found.warnings)

    def update(argument: str) -> str:
        try:
            got = json.loads(argument)
            notes = context["tables"][got["table"]]["rich_context"]
        except (ValueError, KeyError, TypeError) as e:
            return f"Error: {e}"
        notes[got["key"]] = {"content": got.get("content", ""), "expires_at": got.get("expires_at")}
        return "updated"

    return [
        Tool("execute_sql", "Runs a statement and shows its first rows.", lambda sql: execute(adapter, sql)),
        Tool("verify_sql", "Checks a statement: text, analysis, rows, nulls, duplicates.", check),
        Tool("clarify_fields", "Tells which fields the answer should have.", lambda _: fields or "no fields are prescribed"),
        Tool("update_rich_context", "Adds a note to a table: {table, key, content, expires_at}.", update),
    ]


def link(generator: Generator, context: dict, catalog, question: str, one_shot: bool = True) -> tuple[list[str], str]:
    """Tables for a question: the model's choice, the tables linked to it, and for small databases all of them."""
    infos = table_infos(context)
    listing = "\n".join(f"{n}: {i['description']} {i['quality']}".rstrip() for n, i in infos.items())
    answer = generator(f"Tables:\n{listing}\n\nSchema: {linking_schema(context)}\n\nQuestion: {question}\nAnswer with TABLES: and CONTEXT: lines.")
    names, note = parse_link_output(answer)
    selected = resolve_selection(catalog, names) or sorted(catalog.tables)
    selected = with_linked_tables(catalog, selected)
    return (safe_selection(catalog, selected) if one_shot else selected), note


def link_with_tools(generator: Generator, adapter: SparkAdapter, context: dict, question: str, most: int = 5) -> tuple[list[str], str, list[Step]]:
    """The same by a loop of its own: the model may look at rows before it names tables. Without an answer in time: all tables."""
    tools = [t for t in tools_of(adapter, context) if t.name == "execute_sql"]
    listing = "\n".join(f"{n}: {i['description']} {i['quality']}".rstrip() for n, i in table_infos(context).items())
    prompt = f"Tables:\n{listing}\n\nSchema: {linking_schema(context)}\n\nQuestion: {question}\n{tool_text(tools)}\nEnd with TABLES: and CONTEXT: lines."
    steps: list[Step] = []
    answer = ""
    for number in range(1, most + 1):
        answer = generator(prompt)
        found = [] if "TABLES:" in answer else act(answer, tools, number, "link")
        steps += found or [Step(number, phase="link")]
        if not found:
            break
        prompt += f"\n{answer}\n" + "\n".join(f"Observation: {s.observation}" for s in found)
    names, note = parse_link_output(answer) if "TABLES:" in answer else ([], "")
    selected = resolve_selection(adapter.catalog, names) or sorted(adapter.catalog.tables)
    return with_linked_tables(adapter.catalog, selected), note, steps


def tool_text(tools: list[Tool]) -> str:
    return "Tools:\n" + "\n".join(f"- {t.name}: {t.description}" for t in tools) + "\nUse Thought:, Action:, Action Input:, and end with Final Answer:"


def act(answer: str, tools: list[Tool], number: int, phase: str = "react") -> list[Step]:
    """The steps of an answer's actions; several run at the same time. None, if the answer has no action."""
    by_name, thought = {t.name: t for t in tools}, (re.search(r"Thought:\s*(.*?)(?=\n|\Z)", answer) or [None, ""])[1]
    steps = [Step(number, thought, m[1], m[2].strip(), phase=phase) for m in _ACTION.finditer(answer)]

    def observe(step: Step) -> str:
        if step.action not in by_name:
            return f"no tool {step.action}"
        return by_name[step.action](step.action_input)

    for i, seen in run_all({str(i): (lambda s=s: observe(s)) for i, s in enumerate(steps)}).items() if steps else ():
        steps[int(i)].observation = seen if seen is not None else "Error: the tool failed"
    return steps


#: What answers should keep to, by benchmark.
RULES = {
    "spider": "Select the columns that the question asks for and no others, in its order. Use only tables that are needed. Do not add an order or a limit that the question does not ask for.",
    "bird": "Follow the evidence to the letter, also its formulas. Select what is asked for and no helper columns. Cast to REAL before a ratio or a percentage. Leave out rows without a value where an extreme or a rank is asked for.",
}


def build_prompt(context: dict, tables: list[str], question: str, note: str = "", tools: list[Tool] = (), rules: str = "") -> str:
    parts = [compact_prompt(context, tables), cross_table_summary(context), note, rules]
    if tools:
        parts.append(tool_text(tools))
    return "\n".join(p for p in [*parts, f"Question: {question}"] if p)


_ACTION = re.compile(r"Action:\s*(\w+)\s*\nAction Input:\s*(.*?)(?=\n(?:Observation|Thought|Action):|\Z)", re.S)


def infer(generator: Generator, adapter: SparkAdapter, context: dict, question: str, loop: bool = True, fields: str = "", on_step=None, most: int = MAX_STEPS, rules: str = "", link_loop: bool = False) -> Inference:
    """A statement for a question. on_step, if given, hears of every step. An error while it finally runs is kept, not raised."""
    began, out = time.time(), Inference(question)
    if link_loop:
        out.tables, note, linking = link_with_tools(generator, adapter, context, question)
        out.steps, out.llm_calls = linking, len({s.step for s in linking})
    else:
        out.tables, note = link(generator, context, adapter.catalog, question, not loop)
        out.llm_calls = 1
    tools = tools_of(adapter, context, fields) if loop else []
    prompt = build_prompt(context, out.tables, question, note, tools, RULES.get(rules, rules))
    answer = ""
    for number in range(1, most + 1 if loop else 2):
        answer = generator(prompt)
        out.llm_calls += 1
        acted = act(answer, tools, number) if loop and "Final Answer:" not in answer else []
        steps = acted or [Step(number, (re.search(r"Thought:\s*(.*?)(?=\n|\Z)", answer) or [None, ""])[1])]
        out.steps += steps
        for step in steps if on_step else ():
            on_step(step)
        if not acted:
            break
        prompt += f"\n{answer}\n" + "\n".join(f"Observation: {s.observation}" for s in acted)
    out.sql = extract_sql(answer)
    out.error = adapter.dry_run(out.sql) or ""
    out.seconds = time.time() - began
    return out


def result_fields(adapter: SparkAdapter, sql: str) -> list[str]:
    """Names of a statement's output columns, from its analysis."""
    return adapter.query(sql).columns


def describe_fields(generator: Generator, question: str, sql: str, fields: list[str]) -> str:
    """A description of each output column, as `name: what it holds`, joined by `; `; a field that the model leaves out is told by its name."""
    answer = generator(f"Question: {question}\nSQL: {sql}\nFields: {', '.join(fields)}\nDescribe each field in one line as `field: description`.")
    told = dict((name.strip(" -*`").lower(), text.strip()) for name, _, text in (line.partition(":") for line in answer.split("\n")) if text.strip())
    return "; ".join(f"{f}: {told[f.lower()]}" if f.lower() in told else f for f in fields)


# Tools of the agents that explore a database before questions come.


def worker_tools(adapter: SparkAdapter, context: dict, table: str, now: datetime | None = None) -> list[Tool]:
    """For the worker of one table: execute_sql, which keeps the metadata that a statement asks for as a note of the table, and
    set_rich_context, whose notes go out of date after NOTE_DAYS days."""

    def keep(key: str, content: str, days: int | None) -> None:
        until = (now or datetime.now(timezone.utc)) + timedelta(days=days) if days is not None else None
        context["tables"][table].setdefault("rich_context", {})[key] = {"content": content, "expires_at": until.strftime("%Y-%m-%dT%H:%M:%SZ") if until else None}

    def run(sql: str) -> str:
        seen, kind = execute(adapter, sql), query_type_text(sql)
        if kind and not seen.startswith("Error"):
            keep(f"{table}_{kind}", seen, None)
        return seen

    def note(argument: str) -> str:
        try:
            got = json.loads(argument)
            keep(got["key"], got["content"], got.get("days", NOTE_DAYS))
        except (ValueError, KeyError, TypeError) as e:
            return f"Error: {e}"
        return "noted"

    return [Tool("execute_sql", "Runs a statement and keeps metadata that it asks for.", run), Tool("set_rich_context", "Notes what a table means: {key, content, days}.", note)]


def coordinator_tools(adapter: SparkAdapter, registry: TaskRegistry) -> list[Tool]:
    """For the coordinator: execute_sql, which registers a task for each table that an answer names and that has none yet."""

    def run(sql: str) -> str:
        seen = execute(adapter, sql, most=1000)
        words = set(re.findall(r"\w+", seen.lower()))
        for t in sorted(adapter.catalog.tables) if not seen.startswith("Error") else ():
            if t.lower() in words and t not in registry.tasks:
                registry.register(t)
        return seen

    return [Tool("execute_sql", "Runs a statement; tables in its answer become tasks.", run)]
