from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from siftworks.config import load, settings
from siftworks.functions import noisy_json
from siftworks.operators import external, verdicts


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('{"a": 1}', '{"a":1}'), ('Sure:\n```json\n{"a": "}"}\n```', '{"a":"}"}'), ('x {bad} y {"b": {"c": "{"}} z', '{"b":{"c":"{"}}'), ("[1, 2]", None), ("none", None), ("", None), (None, None),
        ('say "hi {" then {"k": "v\\"}"}', '{"k":"v\\"}"}'), ("{" * 1000, None),
    ],
)
def test_objects(spark, given, want):
    rows = spark.createDataFrame([(given,)], "t string")
    assert noisy_json.first_object(given) == want
    assert rows.select(noisy_json.object_text("t")).first()[0] == want


def test_runs(spark):
    programs = spark.createDataFrame([("ok", "p", "python", "print(int(input()) * 2)", 10.0), ("wrong", "p", "python", "print(1)", 10.0), ("crash", "p", "python", "1/0", 10.0), ("odd", "p", "cobol", "", 1.0)], "candidate string, pid string, language string, code string, seconds double")
    cases = spark.createDataFrame([("p", 0, "1", "2"), ("p", 1, "2", "4"), ("p", 2, "3", "6")], "pid string, ord int, input string, expected string")
    got = external.run_programs(programs, cases, external.local_python).collect()
    by = {c: [r for r in got if r["candidate"] == c] for c in ("ok", "wrong", "crash", "odd")}
    assert len(by["ok"]) == 3 and len(by["wrong"]) == 1 and by["crash"][0]["exit_code"] == 1 and "no local runner" in by["odd"][0]["error"]
    rows = spark.createDataFrame([r for r in got if r["error"] is None], "candidate string, ord int, stdout string, exit_code int, timed_out boolean, over_memory boolean, time_ms long, expected string, error string")
    status = verdicts.case_status(F.col("timed_out"), F.col("over_memory"), F.col("exit_code"), F.trim(F.regexp_replace("stdout", "\n", "")) == F.col("expected"))
    rolled = verdicts.first_failure(rows.withColumn("status", status), ["candidate"], "ord")
    assert {r["candidate"]: r["status"] for r in rolled.collect()} == {"ok": "AC", "wrong": "WA", "crash": "RE"}


def test_waves_send_the_rest_to_survivors(spark):
    """100 cases: a program that fails a probe case runs the probe alone, one that fails later stops there."""
    programs = spark.createDataFrame([("ok", "p", "x", "", 1.0), ("early", "p", "x", "fail 1", 1.0), ("late", "p", "x", "fail 40", 1.0), ("raises", "p", "x", "raise", 1.0), ("none", "q", "x", "", 1.0)], "candidate string, pid string, language string, code string, seconds double")
    cases = spark.createDataFrame([("p", i, str(i), str(2 * i)) for i in range(100)], "pid string, ord int, input string, expected string")

    def runner(code, language, inputs, seconds):
        for text in inputs:
            if code == "raise":
                raise RuntimeError("no")
            wrong = code == f"fail {text}"
            yield external.Outcome("0.1" if wrong else str(2 * int(text)), 0, False, False, 1)

    waves = external.run_programs(programs, cases, runner, probe=3)
    assert "collect_list" not in waves._jdf.queryExecution().toString()
    ran = {r["candidate"]: r["count"] for r in waves.groupBy("candidate").count().collect()}
    assert ran == {"ok": 100, "early": 3, "late": 41, "raises": 1}
    plain = external.run_programs(programs, cases, runner).collect()
    assert {c: sorted(r["ord"] for r in plain if r["candidate"] == c) for c in ("ok", "early", "late")} == {"ok": list(range(100)), "early": [0, 1], "late": list(range(41))}
    assert [r["error"] for r in plain if r["candidate"] == "raises"] == ["RuntimeError: no"]
    status = external.run_status(waves.where("error IS NULL"), F.col("stdout") == F.col("expected"))
    totals = programs.join(cases.groupBy("pid").count().withColumnRenamed("count", "cases_total"), "pid")
    rolled = {r["candidate"]: (r["verdict"], r["cases_run"], r["skipped"]) for r in verdicts.two_stage(status, ["candidate"], "ord", 3, totals=totals).collect()}
    assert rolled == {"ok": ("AC", 100, 0), "early": ("WA", 3, 97), "late": ("WA", 41, 59)}


def test_script_and_prompt(spark):
    routes = spark.createDataFrame([("check", "fine", 1), ("solve", "done", 0)], "keyword string, reply string, ord int")
    prompts = spark.createDataFrame([(1, "please solve and check"), (2, "check it"), (3, "none")], "id int, prompt string")
    assert {r["id"]: r["reply"] for r in external.scripted(prompts, routes).collect()} == {1: "done", 2: "fine", 3: None}
    made = prompts.select(external.prompt('{"k": {x}} {prompt}', prompt="prompt", x=F.col("id").cast("string"))).first()[0]
    assert made == '{"k": 1} please solve and check'


def test_calls_in_flight(spark):
    """32 slow prompts take the time of one window, in their order and with the usage of a run one by one."""
    prompts = spark.createDataFrame([(i, "s", f"user {i}", "LOW" if i % 4 else "HIGH") for i in range(32)], "id int, system string, user string, budget string").coalesce(1)

    def model(system, user, budget):
        time.sleep(0.3)
        n = int(user.split()[1])
        if n == 9:
            raise ValueError("no")
        return external.Reply('{"n": %d}' % n if n % 3 or budget == "HIGH" else "nothing", len(user), n)

    external.asked(prompts.limit(1), ["id"], model).collect()  # starts the worker
    began = time.perf_counter()
    together = external.asked(prompts, ["id"], model, in_flight=32).collect()
    took = time.perf_counter() - began
    one_by_one = external.asked(prompts, ["id"], model, in_flight=1).collect()
    assert together == one_by_one and [r["id"] for r in together] == list(range(32))
    assert took < 32 * 0.3 / 3
    assert {r["calls"] for r in together} == {0, 1, 2} and together[9]["error"] == "ValueError: no"


def test_busy_models_are_asked_again():
    pauses, calls = [], []

    def model(system, user, budget):
        calls.append(user)
        if len(calls) < 4:
            raise external.Busy("later")
        return external.Reply("done", 1, 1)

    assert external.patient(model, 5, 0.5, pauses.append)("s", "u", "LOW").text == "done" and pauses == [0.5, 1.0, 2.0]
    calls.clear()
    with pytest.raises(external.Busy):
        external.patient(model, 3, 0.5, pauses.append)("s", "u", "LOW")


def test_budget_of_a_task(spark):
    prompts = spark.createDataFrame([(i, "s", "u", "HIGH") for i in range(20)], "id int, system string, user string, budget string").coalesce(1)
    got = external.asked(prompts, ["id"], lambda system, user, budget: external.Reply("{}", 3, 2), in_flight=1, most_tokens=22).collect()
    assert [r["calls"] for r in got] == [1] * 5 + [0] * 15 and all(r["error"].startswith("OverBudget") for r in got[5:])


def test_window_is_bounded():
    under_way, most, lock = [0], [0], threading.Lock()

    def work(row):
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.001 * (row["i"] % 5))
        with lock:
            under_way[0] -= 1
        return (row["i"],)

    assert list(external.in_order(work, ({"i": i} for i in range(200)), 7)) == [(i,) for i in range(200)] and most[0] <= 7


def test_settings_file(tmp_path):
    (tmp_path / "s.json").write_text('{"output": {"max_cases": 7}}')
    assert load(str(tmp_path / "s.json"), {}).output.max_cases == 7
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("sampling:\n  target: 9\n  categories: [DP, Graph]\n")
    made = load(str(tmp_path / "s.yaml"), {})
    assert made.sampling.target == 9 and made.sampling.categories == ("DP", "Graph")


def test_settings():
    made = settings({"sampling": {"target": 5}}, {"SIFTWORKS_SAMPLING_SEED": "7", "SIFTWORKS_GATES_REQUIRE_STDIO": "false"})
    assert (made.sampling.target, made.sampling.seed, made.gates.require_stdio) == (5, 7, False)
    with pytest.raises(ValueError, match="unknown"):
        settings({"sampling": {"goal": 5}}, {})
    with pytest.raises(ValueError, match="target"):
        settings({"sampling": {"target": 0}}, {})
