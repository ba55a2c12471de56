from __future__ import annotations

import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from siftworks import reports
from siftworks.__main__ import main
from siftworks.operators import agents, external

STEPS = [{"step_id": f"S{i}", "title": "", "content": "O(1) is what this step of the solution takes"} for i in range(1, 8)]
GOOD, BAD = "a, b = map(int, input().split())\nprint(a + b)", "a, b = map(int, input().split())\nprint(a - b)"


def solution(code):
    return json.dumps({"steps": STEPS, "code": {"language": "python", "code": code}})


def scan(**status):
    return json.dumps({"steps": [{"step_id": f"s0{i}", "status": status.get(f"S{i}", "correct"), "confidence": 0.75, "error_type": "E3", "suspicious_claim": "sums are differences"} for i in range(1, 8)]})


def problems(spark, *names):
    rows = [(n, n, f"{n}: add both numbers", 800, GOOD, "python", 5.0, "token") for n in names]
    return spark.createDataFrame(rows, "candidate string, pid string, statement string, rating int, reference string, reference_language string, seconds double, comparison string")


def cases(spark, *names):
    return spark.createDataFrame([(n, i, f"{a} {b}", str(a + b)) for n in names for i, (a, b) in enumerate([(1, 2), (5, 5)])], "pid string, ord int, input string, expected string")


def test_solve_and_repair(spark):
    """One problem is solved at once, one after a repair, one never; one reply can't be read at first."""
    model = external.script(
        [
            ("Mend the solution.\n\nsecond", solution(GOOD)), ("Mend the solution.\n\nthird", solution(BAD)), ("Your last reply was no such object", solution(GOOD)), ("Solve the problem.\n\nfirst", "no json"), ("Solve the problem.", solution(BAD)),
            ("Scan all steps.", scan()), ("Does the code", '{"consistent": true}'),
        ]
    )
    got = {r["candidate"]: r for r in agents.solve_and_repair(problems(spark, "first", "second", "third"), cases(spark, "first", "second", "third"), model, external.local_program(), 2).collect()}
    assert {c: (r["exec_status"], r["process_valid"], r["rounds"], r["quadrant"]) for c, r in got.items()} == {"first": ("AC", True, 0, "full_correct"), "second": ("AC", True, 1, "full_correct"), "third": ("WA", False, 2, "implementation_error")}
    assert got["third"]["failed_index"] == 0 and got["third"]["total"] == 2 and got["first"]["calls"] >= 2
    page = reports.audit_markdown(got["third"].asDict(True))
    assert "WA" in page and "S7" in page and "```python" in page and "&lt;" not in page
    assert reports.audit_html(got["third"].asDict(True)).startswith("<!DOCTYPE html>")


def test_layers(spark):
    """Suspicion is verified closely with its neighbours; a counterexample is confirmed by the reference; budgets are raised for bad replies."""
    replies = [
        ("Scan all steps.", scan(S3="suspicious")), ("Verify step S3", '{"status": "incorrect", "confidence": 0.9, "error_type": "E2"}'), ("Verify step", '{"status": "correct", "confidence": 0.5}'),
        ("Does the code", '{"consistent": false, "mismatches": [{"aspect": "x", "error_type": "e5"}]}'), ("Find a counterexample", '{"claim_holds": false, "input": "2 3", "expected_output": "99"}'),
    ]
    rows = problems(spark, "p").withColumns({"steps": F.map_from_arrays(F.array(*(F.lit(s["step_id"]) for s in STEPS)), F.array(*(F.lit(s["content"]) for s in STEPS))), "code": F.lit(BAD), "language": F.lit("python")})
    of = agents.evidence_layers(rows, external.script(replies), external.local_program())
    assert {(r["step_id"], r["status"]) for r in of["fine"].collect()} == {("S2", "correct"), ("S3", "incorrect"), ("S4", "correct")}
    assert [(r["strength"], r["error_type"]) for r in of["consistency"].collect()] == [(3, "E5")]
    assert [(r["strength"], r["step_id"], r["indicates_invalid"]) for r in of["counterexample"].collect()] == [(5, "S3", True)]
    runs = spark.createDataFrame([("p", "WA")], "candidate string, status string")
    got = agents.audit(rows, runs, external.script(replies), external.local_program()).first()
    assert (got["first_error_step"], got["process_valid"], got["confidence"]) == ("S3", False, 1.0)
    broken = agents.audit(rows, runs, lambda *_: 1 / 0).first()
    assert (broken["first_error_step"], broken["error_type"]) == ("S7", "E7")


def test_budget_is_raised(spark):
    asked = []

    def model(system, user, budget):
        asked.append(budget)
        return external.Reply("{}" if budget == "HIGH" else "thinking ...", 1, 2)

    rows = spark.createDataFrame([(1, "s", "u", "LOW")], "id int, system string, user string, budget string")
    got = external.asked(rows, ["id"], model).first()
    assert (got["reply"], got["calls"], got["completion_tokens"]) == ("{}", 2, 4)


def test_memory_and_compilation(spark):
    runs = spark.createDataFrame([("big", "p", "python", "x = bytearray(10**9)", 5.0), ("slow", "p", "python", "while True: pass", 0.5), ("odd", "p", "cobol", "", 1.0)], "candidate string, pid string, language string, code string, seconds double")
    got = external.run_programs(runs, cases(spark, "p"), external.local_program(256)).collect()
    status = {r["candidate"]: r["status"] for r in external.run_status(spark.createDataFrame(got), F.col("stdout") == F.col("expected")).collect()}
    assert status == {"big": "MLE", "slow": "TLE", "odd": "SE"}


def compiles(folder):
    (folder / "x.cpp").write_text("#include <iostream>\nint main(){}")
    return shutil.which("g++") is not None and subprocess.run(["g++", "x.cpp"], cwd=folder, capture_output=True, check=False).returncode == 0


def test_cpp(spark, tmp_path):
    if not compiles(tmp_path):
        pytest.skip("no compiler")
    code = "#include <iostream>\nint main(){int a,b;std::cin>>a>>b;std::cout<<a+b;}"
    runs = spark.createDataFrame([("good", "p", "cpp", code, 5.0), ("bad", "p", "cpp", "int main({", 5.0)], "candidate string, pid string, language string, code string, seconds double")
    got = external.run_status(external.run_programs(runs, cases(spark, "p"), external.local_program(2048)), F.col("stdout") == F.col("expected")).collect()
    assert {r["candidate"]: r["status"] for r in got} == {"good": "AC", "bad": "CE"}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.md").write_text("add both numbers")
    (tmp_path / "t.json").write_text('[{"input": "1 2", "expected": "3"}]')
    (tmp_path / "c.py").write_text(GOOD)
    (tmp_path / "s.json").write_text(solution(BAD))
    (tmp_path / "m.json").write_text(json.dumps([["Mend", solution(GOOD)], ["Solve the problem.", solution(BAD)], ["Scan", scan()], ["Does the code", '{"consistent": true}']]))
    at = lambda n: str(tmp_path / n)
    main(["judge", "--code", at("c.py"), "--tests", at("t.json")], spark)
    assert json.loads(capsys.readouterr().out)["status"] == "AC"
    main(["evaluate", "--problem", at("p.md"), "--tests", at("t.json"), "--solution", at("s.json"), "--model", at("m.json")], spark)
    assert "WA" in capsys.readouterr().out
    main(["solve", "--problem", at("p.md"), "--tests", at("t.json"), "--model", at("m.json"), "--reference", at("c.py"), "--out", at("r.html")], spark)
    assert "mended in 1 rounds" in (tmp_path / "r.html").read_text()
