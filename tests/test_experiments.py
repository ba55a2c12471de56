"""Experiments end to end on small data sets with a scripted model."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from test_agents import BAD, GOOD, STEPS, cases, problems, scan, solution

from siftworks.__main__ import main
from siftworks.operators import external, metrics
from siftworks.plans import experiments
from siftworks.sources import riegeli

STEP_TEXTS = {s["step_id"]: s["content"] for s in STEPS}


@pytest.fixture
def labelled(tmp_path):
    """Two problems; four labelled variants and a natural one without a label."""
    root, private = tmp_path / "root", tmp_path / "private"
    variant = lambda name, mark, label: {"name": name, "language": "python", "code": GOOD, "steps": STEP_TEXTS | {"S3": f"{mark} O(1) this step of the solution"}, **({"label": label} if label else {})}
    for pid in ("first", "second"):
        (root / pid).mkdir(parents=True)
        (private / pid).mkdir(parents=True)
        (root / pid / "problem.md").write_text(f"{pid}: add both numbers")
        (root / pid / "meta.json").write_text(json.dumps({"difficulty": 800, "tags": ["math"]}))
        (root / pid / "tests.json").write_text(json.dumps([{"input": "1 2", "expected": "3"}, {"input": "5 5", "expected": "10"}]))
        (root / pid / "reference.py").write_text(GOOD)
    (root / "first/variants.json").write_text(json.dumps([variant("correct", "plain", {"kind": "correct", "process_valid": True, "exec_status": "AC"}), variant("natural", "plain", None)]))
    wrong = {"kind": "injected", "process_valid": False, "exec_status": "WA", "first_error": "S3", "error_type": "E3"}
    sly = {"kind": "ac_invalid", "process_valid": False, "exec_status": "AC", "first_error": "S2", "error_type": "E2"}
    (private / "first/variants.json").write_text(json.dumps([variant("injected-1", "wrong", wrong), variant("sly", "wrong", sly)]))
    (private / "second/variants.json").write_text(json.dumps([variant("missed", "unseen", {**sly, "first_error": "S5"})]))
    script = [["Does the code", '{"consistent": true}'], ["wrong O(1)", scan(S3="incorrect")], ["Scan all steps.", scan()]]
    (tmp_path / "script.json").write_text(json.dumps(script))
    return root, private, tmp_path / "script.json"


def test_labelled_variants(spark, labelled, tmp_path, capsys):
    root, private, script = labelled
    main(["variants", "--root", str(root), "--private", str(private), "--model", str(script), "--out", str(tmp_path / "out")], spark)
    told = json.loads(capsys.readouterr().out)["full"]
    # correct is not flagged; both of "wrong" are, at S3; "missed" is not; the natural one counts nowhere.
    assert (told["n"], told["tp"], told["fp"], told["fn"], told["tn"]) == (4, 2, 0, 1, 1)
    assert (told["precision"], told["recall"], told["f1"], told["fpr"]) == (1.0, 0.6667, 0.8, 0.0)
    assert (told["n_steps"], told["first_error_exact"], told["first_error_within_1"]) == (3, 0.3333, 0.6667)
    assert told["error_type_accuracy"] == 0.3333 and (told["abi_precision"], told["abi_recall"]) == (1.0, 0.5)
    # Confusions: E3 as E3, E2 as E3. E3: precision 1/2, recall 1; E2: nothing right.
    assert told["macro_f1"] == pytest.approx((2 / 3 + 0.0) / 2, abs=1e-4)
    assert sorted(os.listdir(tmp_path / "out/evaluator")) == ["first__correct.md", "first__injected-1.md", "first__natural.md", "first__sly.md", "second__missed.md"]
    assert "first wrong step S3" in (tmp_path / "out/evaluator/first__sly.md").read_text()
    assert json.loads((tmp_path / "out/summary.json").read_text())["full"] == told and spark.read.json(str(tmp_path / "out/records")).count() == 5


def test_ablation_of_variants(spark, labelled, tmp_path, capsys):
    root, private, script = labelled
    main(["ablation", "--root", str(root), "--private", str(private), "--model", str(script), "--out", str(tmp_path / "out")], spark)
    told = json.loads(capsys.readouterr().out)
    assert set(told) == {*experiments.CONFIGS, experiments.LOW_BUDGET}
    assert {k: (v["tp"], v["fn"]) for k, v in told.items()} == dict.fromkeys(told, (2, 1))
    assert spark.read.json(str(tmp_path / "out/records")).count() == 5 * 6


def test_hard_rules_spare_layers_but_not_in_the_ablation(spark):
    """A candidate without steps fails a rule; its consistency counts only where rules are left out."""
    rows = problems(spark, "p").withColumns({"steps": F.create_map(F.lit("S1"), F.lit("short")), "code": F.lit(GOOD), "language": F.lit("python")})
    model = external.script([("Does the code", '{"consistent": false, "mismatches": [{"error_type": "e6"}]}'), ("Scan all steps.", scan())])
    got = {r["config"]: (r["first_error_step"], r["error_type"]) for r in experiments.decisions(rows, model, None, experiments.CONFIGS).collect()}
    assert got["full"][0] == "S1" and got["no_structural"] == ("S7", "E6") and got["no_consistency"] == got["full"]


def test_repair_experiment(spark):
    """One problem needs no repair, one is mended by either way, one by the audit alone, one never."""
    model = external.script(
        [
            ("First wrong step", solution(GOOD)), ("Mend the solution.\n\nboth", solution(GOOD)), ("Mend the solution.", solution(BAD)), ("Solve the problem.\n\nfine", solution(GOOD)), ("Solve the problem.\n\nmute", "no json"), ("Solve the problem.", solution(BAD)),
            ("Scan all steps.", scan(S3="incorrect")), ("Does the code", '{"consistent": true}'),
        ]
    )
    names = ("fine", "both", "guided", "mute")
    records = experiments.repair_experiment(problems(spark, *names), cases(spark, *names), model, external.local_program(), 2)
    got = {(r["candidate"], r["strategy"]): (r["solved_round"], r["final_exec"]) for r in records.collect()}
    assert got == {
        ("fine", "one_shot"): (0, "AC"), ("fine", "exec_only"): (0, "AC"), ("fine", "process_guided"): (0, "AC"), ("both", "one_shot"): (None, "WA"), ("both", "exec_only"): (1, "AC"), ("both", "process_guided"): (1, "AC"),
        ("guided", "one_shot"): (None, "WA"), ("guided", "exec_only"): (None, "WA"), ("guided", "process_guided"): (1, "AC"),
    }
    told = {r["strategy"]: r for r in metrics.experiment(records).collect()}
    assert (told["one_shot"]["accepted_rate"], told["exec_only"]["refine_at_1"], told["process_guided"]["refine_at_1"]) == (0.3333, 0.5, 1.0)
    assert told["one_shot"]["tokens"] == 0 and 0 < told["exec_only"]["tokens"] and told["process_guided"]["tokens"] > 0


def test_candidates_are_built_and_checked(spark, labelled, tmp_path, capsys):
    root, _, script = labelled
    replies = [
        ["Put one error", f"## S1\nno\n## S2\nwrong two\n## S3\nwrong three\n## S4\nwrong four\n## S5\nw\n## S6\nw\n## S7\ncode\n```python\n{BAD}\n```"], ["Give step", "## S3\nwrong reason\n## S4\nnot asked for\n"],
        ["Solve the problem.", solution(GOOD)],
    ]
    script.write_text(json.dumps(replies))
    main(["candidates", "--root", str(root), "--private", str(tmp_path / "secret"), "--out", str(tmp_path / "open"), "--model", str(script)], spark)
    page = capsys.readouterr().out
    assert "| kind | injected | 4 |" in page and "| ac_but_invalid | true | 2 |" in page
    shown = spark.read.json(str(tmp_path / "open/variants"))
    assert {r["name"] for r in shown.collect()} == {"correct", "natural"} and "first_error" not in shown.columns
    made = spark.read.json(str(tmp_path / "secret/labels"))
    assert made.where("kind = 'injected'").count() == 4


def test_violations(spark):
    steps = lambda **other: STEP_TEXTS | other
    rows = [
        ("a", "correct", "correct", steps(), GOOD, "AC", None), ("a", "i1", "injected", steps(S2="x"), GOOD, "WA", "S3"), ("a", "s1", "ac_invalid", steps(S3="x", S4="y"), BAD, "AC", "S3"), ("a", "s2", "ac_invalid", steps(S3="x"), GOOD, "AC", "S3"),
        ("b", "correct", "correct", steps(), GOOD, "WA", None), ("b", "i1", "injected", {"S1": STEP_TEXTS["S1"], "S2": "x"}, " ", "WA", "S2"), ("c", "natural", "natural", steps(), GOOD, "AC", None),
    ]
    frame = spark.createDataFrame(rows, "pid string, name string, kind string, steps map<string,string>, code string, exec_status string, first_error string")
    references = spark.createDataFrame([("a", GOOD + "\n"), ("b", GOOD)], "pid string, reference string")
    got = {(r["pid"], r["name"], r["violation"]) for r in experiments.candidate_violations(frame, references).collect()}
    assert got == {
        ("a", "i1", "prefix_changed"), ("a", "s1", "more_than_one_changed"), ("a", "s1", "code_changed"), ("a", "s1", "not_the_reference"), ("b", "correct", "correct_not_accepted"), ("b", "i1", "steps_missing"), ("b", "i1", "no_code"), ("c", "correct", "no_correct"),
    }


def test_solver_run_writes_pages(spark, labelled, tmp_path, capsys):
    root, _, script = labelled
    script.write_text(json.dumps([["Solve the problem.", solution(GOOD)], ["Scan all steps.", scan()], ["Does the code", '{"consistent": true}']]))
    main(["benchmark", "--root", str(root), "--model", str(script), "--out", str(tmp_path / "out"), "--repairs", "1"], spark)
    assert sorted(os.listdir(tmp_path / "out/solver/first")) == ["report.html", "report.md"]
    told = json.loads((tmp_path / "out/summary.json").read_text())
    assert told["rates"][0]["pass_at_1"] == 1.0 and told["refine"]["refine_at_1"] == 0.0 and spark.read.json(str(tmp_path / "out/records")).count() == 2


def test_fields_and_profile_of_record_files(spark, tmp_path, capsys):
    message = lambda i: b"\x0a\x03abc" + b"\x30" + bytes([i % 7]) + b"\xf8\x31\x05"  # noqa: E731  name, source, and field 799
    (tmp_path / "x_train.riegeli-00000-of-00001").write_bytes(b"".join(riegeli.file_parts(iter(map(message, range(300))), 0x7A, 400)))
    main(["fields", "--records", str(tmp_path)], spark)
    page = capsys.readouterr().out
    assert "| 1 | 300 | [2] | [abc] | name |" in page and "| 799 | 300 | [0] | [5] |  |" in page
    main(["profile", "--records", str(tmp_path)], spark)
    page = capsys.readouterr().out
    assert "x_train.riegeli-00000-of-00001" in page and "| 300 |" in page
