"""Where results of things outside the engine come in: program runs by a pluggable runner, prompts, replies of a pluggable model."""

from __future__ import annotations

import re
import resource
import shutil
import subprocess
import sys
import tempfile
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain, groupby
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import outputs_equal
from ..functions.noisy_json import first_object
from ..session import cut
from .verdicts import case_status


class Outcome(NamedTuple):
    stdout: str
    exit_code: int
    timed_out: bool
    over_memory: bool
    time_ms: int


#: Starts a program once and yields an outcome for each input.
Runner = Callable[[str, str, Iterator[str], float], Iterator[Outcome]]


class CompileError(ValueError):
    """The program does not compile; its run has status CE."""


def local_program(memory_mb: int = 512, compiler: str = "g++") -> Runner:
    """A runner of trusted Python and C++ in a process of its own for each input, under a limit of memory, without isolation.

    For other code pass a sandbox's runner. A C++ program is compiled once for all its inputs.
    """

    def limited() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))

    def command(folder: str, code: str, language: str) -> list[str]:
        if language == "python":
            Path(folder, "main.py").write_text(code, encoding="utf-8")
            return [sys.executable, "-I", str(Path(folder, "main.py"))]
        if language == "cpp" and shutil.which(compiler):
            Path(folder, "main.cpp").write_text(code, encoding="utf-8")
            made = subprocess.run([compiler, "-O2", "-std=c++17", "main.cpp", "-o", "main"], cwd=folder, capture_output=True, text=True, timeout=60, check=False)
            if made.returncode:
                raise CompileError(made.stderr[:500])
            return [str(Path(folder, "main"))]
        raise ValueError(f"no local runner for {language}")

    def run(code: str, language: str, inputs: Iterator[str], seconds: float) -> Iterator[Outcome]:
        with tempfile.TemporaryDirectory() as folder:
            program = command(folder, code, language)
            for text in inputs:
                began = time.perf_counter()
                try:
                    done = subprocess.run(program, input=text, capture_output=True, text=True, timeout=seconds, cwd=folder, check=False, preexec_fn=limited)  # noqa: PLW1509
                    # Out of memory shows as an allocation that failed, or as a kill by the system.
                    over = done.returncode != 0 and (re.search("MemoryError|bad_alloc|Cannot allocate memory", done.stderr) is not None or done.returncode == -9)
                    yield Outcome(done.stdout, done.returncode, False, over, int(1000 * (time.perf_counter() - began)))
                except subprocess.TimeoutExpired:
                    yield Outcome("", -1, True, False, int(1000 * (time.perf_counter() - began)))

    return run


local_python = local_program(4096)


def agrees(got: str, want: str, tolerance: float = 1e-6) -> bool:
    """Whether a run may go on: equal tokens, or numbers within the tolerance. The verdict itself is a column of ``compare``."""
    a, b = got.split(), want.split()

    def near(x: str, y: str) -> bool:
        try:
            return abs(float(x) - float(y)) <= tolerance * max(1.0, abs(float(y)))
        except ValueError:
            return False

    return len(a) == len(b) and all(x == y or near(x, y) for x, y in zip(a, b, strict=True))


RUNS = "ord int, stdout string, exit_code int, timed_out boolean, over_memory boolean, time_ms long, expected string, error string"


def _streamed(programs: DataFrame, cases: DataFrame, runner: Runner, abort: bool) -> DataFrame:
    """Runs of each candidate on its cases in order, as both come from the sort: no list of cases is made.

    A candidate's program is the row before its cases. A runner takes inputs as it needs them; a candidate's
    rows that it leaves are passed over.
    """
    kind = programs.schema["candidate"].dataType.simpleString()
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    first = programs.select("candidate", F.lit(None).cast("int").alias("ord"), "language", "code", "seconds", *none("input", "expected"))
    each = programs.select("candidate", "pid").join(cases, "pid").select("candidate", F.col("ord").cast("int").alias("ord"), *none("language", "code"), F.lit(None).cast("double").alias("seconds"), "input", "expected")
    rows = first.unionByName(each).repartition("candidate").sortWithinPartitions("candidate", F.col("ord").asc_nulls_first())
    names = ["candidate", *(f.split()[0] for f in RUNS.split(", "))]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                for row in batch.to_pylist():
                    yield batch.schema.field("candidate").type, row

        for _, candidate in groupby(stream(), lambda x: x[1]["candidate"]):
            key, program = next(candidate)
            ahead = next(candidate, None)
            if ahead is None:
                continue  # no cases
            given = []

            def inputs(ahead=ahead, candidate=candidate, given=given):
                for _, case in chain([ahead], candidate):
                    given.append((case["ord"], case["expected"]))
                    yield case["input"]

            made = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [key, *kinds], strict=True)], names=names)  # noqa: B023, E731
            try:
                for got in runner(program["code"], program["language"], inputs(), program["seconds"]):
                    place, expected = given.pop(0)
                    yield made(program["candidate"], place, *got, expected, None)
                    if abort and not went_well(got, expected):
                        break
            except Exception as e:  # noqa: BLE001  whatever a runner raises belongs in its row
                yield made(program["candidate"], *[None] * 7, f"{type(e).__name__}: {e}")

    return rows.mapInArrow(run, f"candidate {kind}, {RUNS}")


def went_well(got: Outcome, expected: str) -> bool:
    return not (got.timed_out or got.over_memory or got.exit_code) and agrees(got.stdout, expected)


def run_programs(programs: DataFrame, cases: DataFrame, runner: Runner, abort: bool = True, probe: int = 0) -> DataFrame:
    """(candidate, ord, stdout, exit_code, timed_out, over_memory, time_ms, expected, error) of each case run.

    ``programs``: candidate (unique), pid, language, code, seconds. ``cases``: pid, ord, input,
    expected. A candidate's cases run in order in one task; with ``abort`` they stop at
    the first that does not run or whose output differs, even as numbers. With ``probe`` they run in two
    waves: the cases before that number all run first, and the others are sent to and run for those
    candidates only that passed all of them. A runner that raises gives one row with the error and fails no task.
    """
    if not probe:
        return _streamed(programs, cases, runner, abort)
    first = cut(_streamed(programs, cases.where(F.col("ord") < probe), runner, False))
    ran = F.col("error").isNull() & ~F.col("timed_out") & ~F.col("over_memory") & (F.col("exit_code") == 0)
    failed = first.where(~F.coalesce(ran & outputs_equal("stdout", "expected", "float"), F.lit(False))).select("candidate")
    left = programs.join(failed, "candidate", "left_anti")
    return first.unionByName(_streamed(left, cases.where(F.col("ord") >= probe), runner, abort))


def run_status(runs: DataFrame, equal: Column) -> DataFrame:
    """Runs with their status; a program that doesn't compile is CE and one that couldn't be run SE, as their only case."""
    status = case_status(F.col("timed_out"), F.col("over_memory"), F.col("exit_code"), equal)
    failed = F.when(F.col("error").startswith("CompileError"), "CE").otherwise("SE")
    return runs.withColumns({"status": F.when(F.col("error").isNotNull(), failed).otherwise(status), "ord": F.coalesce("ord", F.lit(0))})


class Reply(NamedTuple):
    text: str
    prompt_tokens: int
    completion_tokens: int


#: A model: system prompt, user prompt and budget (LOW or HIGH) to a reply. It must be safe to call again, as tasks are retried.
Model = Callable[[str, str, str], Reply]


class Busy(Exception):
    """Raised by a model that should be asked again later."""


#: Calls that a task has under way at a time, times that a busy model is asked, and the first pause after that, which doubles.
IN_FLIGHT, TRIES, PAUSE = 16, 5, 1.0


def patient(model: Model, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> Model:
    """The model, asked again after growing pauses as long as it is busy."""

    def call(system: str, user: str, budget: str) -> Reply:
        for n in range(tries - 1):
            try:
                return model(system, user, budget)
            except Busy:
                sleep(pause * 2**n)
        return model(system, user, budget)

    return call


def _answer(row: dict, model: Model, needs_object: bool) -> tuple:
    """reply, prompt_tokens, completion_tokens, calls, error of one prompt."""
    text, used, calls, error = None, [0, 0], 0, None
    try:
        for budget in [row["budget"], *(["HIGH"] if row["budget"] == "LOW" and needs_object else [])]:
            got = model(row["system"], row["user"], budget)
            text, calls = got.text, calls + 1
            used = [used[0] + got.prompt_tokens, used[1] + got.completion_tokens]
            if not needs_object or first_object(text) is not None:
                break
    except Exception as e:  # noqa: BLE001  whatever a model raises belongs in its row
        error = f"{type(e).__name__}: {e}"
    return (text, *used, calls, error)


def in_order(work: Callable[[dict], tuple], rows: Iterator[dict], at_once: int) -> Iterator[tuple]:
    """Results in the order of the rows, with at most ``at_once`` of them under way or waiting for those before."""
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for row in rows:
            if len(waiting) == at_once:
                yield waiting.popleft().result()
            waiting.append(pool.submit(work, row))
        while waiting:
            yield waiting.popleft().result()


def asked(prompts: DataFrame, key: list[str], model: Model, needs_object: bool = True, in_flight: int = IN_FLIGHT, tries: int = TRIES, pause: float = PAUSE, most_tokens: int | None = None) -> DataFrame:
    """Each prompt's reply: key, reply, prompt_tokens, completion_tokens, calls, error.

    ``prompts``: key, system, user, budget. A reply on a low budget in which no JSON
    object can be found is asked for once more on the high one. A task keeps up to ``in_flight`` calls under
    way, so the model must bear threads; rows come out in their order. A model that raises ``Busy`` is asked again
    after pauses. Once a task has used ``most_tokens`` its further prompts get an error instead of a call. A model
    that raises gives a row with the error and fails no task.
    """
    fields = [prompts.schema[k] for k in key]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", reply string, prompt_tokens long, completion_tokens long, calls int, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, used = patient(model, tries, pause), [0]

        def work(row: dict) -> tuple:
            if most_tokens is not None and used[0] >= most_tokens:
                return (None, 0, 0, 0, "OverBudget: the task has used its tokens")
            made = _answer(row, call, needs_object)
            used[0] += made[1] + made[2]  # a little late where several calls end together
            return made

        for batch in batches:
            out = list(in_order(work, iter(batch.select(["system", "user", "budget"]).to_pylist()), in_flight))
            columns = list(zip(*out, strict=True)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *made], names=[*key, "reply", "prompt_tokens", "completion_tokens", "calls", "error"])

    return prompts.select(*key, "system", "user", "budget").mapInArrow(run, ddl)


def script(routes: list[tuple[str, str]]) -> Model:
    """A model that answers with the reply of the first keyword that the prompt contains; characters stand for tokens."""

    def answer(system: str, user: str, budget: str) -> Reply:
        text = next((reply for keyword, reply in routes if keyword in system + user), "")
        return Reply(text, len(system) + len(user), len(text))

    return answer


def scripted(prompts: DataFrame, routes: DataFrame) -> DataFrame:
    """Each prompt with the reply of the first route whose keyword it contains; characters stand for tokens.

    ``prompts``: id, prompt. ``routes`` (keyword, reply, ord) is a script of a few rows and is collected into the plan.
    """
    script = sorted((r["ord"], r["keyword"], r["reply"]) for r in routes.limit(1001).collect())
    if len(script) > 1000:
        raise ValueError("a script has at most 1000 routes")
    reply = F.coalesce(F.lit(None).cast("string"), *(F.when(F.contains("prompt", F.lit(k)), F.lit(r)) for _, k, r in script))
    out = prompts.withColumn("reply", reply)
    return out.withColumns({"prompt_tokens": F.length("prompt"), "completion_tokens": F.coalesce(F.length("reply"), F.lit(0))})


def prompt(template: str, **values: Column | str) -> Column:
    """A template with ``{name}`` places filled by columns; all other braces stay as they are."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
    return out
