from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftworks.operators import enrich, fusion, gate, metrics, sample, select, validate, verdicts

PROBLEM = (
    "split string, shard int, record_index int, description string, public_tests array<struct<input:string,output:string>>, private_tests array<struct<input:string,output:string>>, "
    "generated_tests array<struct<input:string,output:string>>, solutions array<struct<language:long,solution:string>>, source long, time_limit_seconds double, memory_limit_bytes long, input_file string, output_file string, decode_error string"
)


def test_gate(spark):
    case = [("1", "2")] * 25
    rows = [
        ("train", 0, 0, "sum", case, [], [], [(3, "x")], 2, 1.0, None, "", "", None),
        ("train", 0, 1, "print any of them, interactive", [], None, [], [(2, "x")], 0, 9.0, 1, "in.txt", "", None),
        ("train", 0, 2, None, None, None, None, None, None, None, None, None, None, "broken"),
    ]
    out = gate.gate(spark.createDataFrame(rows, PROBLEM))
    got = {r["cc_id"]: r for r in out.collect()}
    assert got["cc-train-000-0000"]["passed"] and got["cc-train-000-0000"]["memory_limit_source"] == "default"
    assert got["cc-train-000-0001"]["reject_reasons"] == ["source_excluded", "no_python3_solution", "non_stdio", "multiple_answers", "interactive", "time_limit_too_large", "too_few_tests"]
    assert got["cc-train-000-0002"]["reject_reasons"] == ["proto_error"]
    counts = {r["metric"]: r["n"] for r in gate.funnel(out).collect()}
    assert counts["records"] == 3 and counts["passed"] == 1 and counts["reason:interactive"] == 1


def test_cascade(spark):
    index = spark.createDataFrame([("k1", "alpha", "first", 1), ("k1", "beta", "second", 2), (None, "beta", "third", 3)], "taco_key string, title string, v string, ord int")
    rows = spark.createDataFrame([(1, "k1", ["beta"]), (2, "zz", ["nothing", "beta"]), (3, None, ["none"])], "id int, k string, t array<string>")
    got = {r["id"]: (r["taco_match"], r["taco_v"]) for r in enrich.cascade(rows, "id", F.col("k"), F.col("t"), index, ["v"], "ord").collect()}
    assert got == {1: ("key", "first"), 2: ("title", "second"), 3: ("none", None)}


def test_coverage(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id int, v string")
    assert tuple(enrich.coverage(rows, rows.na.fill("x"), "v").first()) == (1, 2)


@pytest.mark.parametrize("seed", range(30))
def test_allocation_invariants(seed):
    draw = random.Random(seed)
    supply = {(c, b): draw.choice([0, 1, 3, 20]) for c in "ABCD" for b in "xyz"}
    target, cap = draw.randint(1, 40), draw.randint(2, 12)
    quota = sample.allocate(supply, target, 3, cap)
    assert sum(quota.values()) <= target
    assert all(0 <= n <= supply[c] for c, n in quota.items())


def test_allocation_known():
    assert sum(sample.allocate({("A", "x"): 10, ("B", "x"): 10}, 10, 3).values()) == 10
    assert sample.allocate({("A", "x"): 100, ("B", "x"): 1}, 3, 3) == {("A", "x"): 2, ("B", "x"): 1}
    assert sample.allocate({}, 5) == {}
    assert sample.allocate({("A", "x"): 100, ("B", "x"): 100}, 20, 3, 5) == {("A", "x"): 5, ("B", "x"): 5}


def test_draw(spark):
    rows = spark.createDataFrame([(i, "xy"[i % 2], "AB"[i % 2], ["A", "B"] if i % 3 == 0 else ["AB"[i % 2]]) for i in range(100)], "id int, bin string, category string, categories array<string>")
    got = sample.draw(rows, 30, "id").collect()
    assert len({r["id"] for r in got}) == len(got) == 30
    assert sorted(map(tuple, got)) == sorted(map(tuple, sample.draw(rows, 30, "id").collect()))


def drawn_one_by_one(rows, target, seed=42, least=3, share=0.3):
    """Cells in name order, each taking its first free candidates; then the rest by their own lots."""
    lot = lambda *x: hashlib.md5("\x1f".join(map(str, (seed, *x))).encode()).hexdigest()
    cells = {}
    for i, b, _, categories in rows:
        for c in set(categories):
            cells.setdefault((c, b), []).append((lot(c, b, i), i))
    quota = sample.allocate({k: len(v) for k, v in cells.items()}, target, least, max(1, int(target * share)))
    used, out = set(), []
    for cell in sorted(cells):
        free = [i for _, i in sorted(cells[cell]) if i not in used][: quota[cell]]
        used.update(free)
        out += [(i, "|".join(cell), False) for i in free]
    rest = sorted((lot(i), i, f"{c}|{b}") for i, b, c, _ in rows if i not in used)[: max(0, target - len(out))]
    return sorted(out + [(i, cell, True) for _, i, cell in rest])


@pytest.mark.parametrize("seed,target,share", [(1, 30, 0.3), (2, 90, 1.0), (3, 400, 0.2), (4, 5000, 1.0)])
def test_draw_equals_cell_after_cell(spark, monkeypatch, seed, target, share):
    """Rows of up to five categories compete; no more than the cells' counts come to the driver."""
    draw = random.Random(seed)
    rows = [(i, draw.choice("xxxyz"), "-", draw.sample("ABCDEFG", draw.randrange(1, 6))) for i in range(600)]
    rows = [(i, b, c[0], c) for i, b, _, c in rows]
    frame = spark.createDataFrame(rows, "id int, bin string, category string, categories array<string>")
    collected, collect = [], type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    got = sample.draw(frame, target, "id", share=share)
    assert max(map(len, collected)) <= 21
    monkeypatch.undo()
    assert sorted(map(tuple, got.collect())) == drawn_one_by_one(rows, target, share=share)


def test_bounded_prefix_equals_loop(spark):
    draw = random.Random(1)
    rows = [(g, i, draw.randint(1, 9)) for g in range(40) for i in range(draw.randint(0, 8))]
    want = set()
    for g in range(40):
        total = 0
        for n, (_, i, s) in enumerate(sorted(r for r in rows if r[0] == g)):
            total += s
            if n >= 4 or total > 15:
                break
            want.add((g, i))
    df = spark.createDataFrame(rows, "g int, i int, s int")
    assert {(r["g"], r["i"]) for r in select.bounded_prefix(df, ["g"], ["i"], F.col("s"), 4, 15).collect()} == want


def test_round_robin(spark):
    rows = spark.createDataFrame([(i,) for i in range(23)], "id int")
    got = {r["id"]: r["assigned"] for r in select.round_robin(rows, ["id"], 2, ["a", "b", "c"]).collect()}
    assert got == {i: ["abc"[(2 * i) % 3], "abc"[(2 * i + 1) % 3]] for i in range(23)}


def test_select_cases(spark):
    rows = [("p", "public", 0, "a", "1"), ("p", "public", 1, "a", "1"), ("p", "private", 0, "a", "1"), ("p", "private", 1, "b", "2"), ("p", "generated", 0, "b", "2"), ("p", "generated", 1, "long" * 9, "2")]
    got = select.select_cases(spark.createDataFrame(rows, "pid string, origin string, ord int, input string, output string"), 10, 20).orderBy("position").collect()
    assert [(r["origin"], r["input"]) for r in got[:2]] == [("public", "a"), ("public", "a")]
    assert len(got) == 3 and got[2]["input"] == "b"


def test_rollups(spark):
    rows = spark.createDataFrame([("c", 0, "WA", 5), ("c", 1, "AC", 6), ("c", 2, "TLE", 7), ("d", 0, "AC", 1), ("d", 1, "AC", 2)], "id string, i int, status string, time_ms int")
    got = {r["id"]: r for r in verdicts.first_failure(rows, ["id"], "i", abort=True).collect()}
    assert (got["c"]["status"], got["c"]["failed_index"], got["c"]["n_results"], got["c"]["total"]) == ("WA", 0, 1, 3)
    assert (got["d"]["status"], got["d"]["failed_index"], got["d"]["passed"]) == ("AC", None, 2)
    assert {r["id"]: r["status"] for r in verdicts.worst(rows, ["id"]).collect()} == {"c": "TLE", "d": "AC"}
    staged = {r["id"]: r for r in verdicts.two_stage(rows, ["id"], "i").collect()}
    assert staged["c"]["verdict"] == "WA" and staged["c"]["cases_run"] == 3 and staged["d"]["ok"]
    alone = verdicts.without_cases(spark.createDataFrame([("e",)], "id string"), verdicts.first_failure(rows, ["id"], "i"), ["id"]).first()
    assert alone["status"] == "SE"


def test_solver_and_refine(spark):
    rows = spark.createDataFrame([(True, True, 0), (False, True, 1), (True, True, 1), (False, False, None)], "accepted boolean, process_valid boolean, rounds int")
    got = metrics.solver_rates(rows).first()
    assert (got["pass_at_1"], got["process_valid_rate"], got["dual_correct_rate"]) == (0.5, 0.75, 0.5)
    assert rows.agg(metrics.refine_at_all("rounds", 2)).first()[0] == 0.5
    assert rows.agg(metrics.refine_at_failed("rounds", 1)).first()[0] == 0.6667


def test_detection(spark):
    rows = [(True, True)] * 8 + [(False, True)] * 2 + [(True, False)] * 2 + [(False, False)] * 8 + [(None, True), (None, False)]
    df = spark.createDataFrame(rows, "labelled_invalid boolean, flagged boolean")
    got = metrics.detection(df).first()
    assert (got["n"], got["precision"], got["recall"], got["f1"], got["fpr"]) == (20, 0.8, 0.8, 0.8, 0.2)
    assert metrics.detection(df, compat=True).first()["fp"] == 3


def test_macro_f1(spark):
    df = spark.createDataFrame([("E2", "E2", 4), ("E3", "E3", 2), ("E3", "E7", 2)], "labelled string, predicted string, n long")
    assert abs(metrics.macro_f1(df).first()[0] - 0.5556) < 1e-4


def test_abi_and_first_error(spark):
    rows = [(True, True, False, True)] * 4 + [(False, True, True, True)] + [(True, False, False, True)] * 2
    got = metrics.accepted_but_invalid(spark.createDataFrame(rows, "abi_label boolean, flagged boolean, label_valid boolean, label_accepted boolean")).first()
    assert (got["abi_precision"], got["abi_recall"]) == (0.8, 0.6667)
    pairs = spark.createDataFrame([("S2", "S2"), ("S3", "S2"), ("S5", "S2"), (None, "S2"), ("S2", None)], "p string, l string")
    exact, near = metrics.first_error_match("p", "l")
    assert [tuple(r) for r in pairs.select(exact, near).collect()] == [(True, True), (False, True), (False, False), (False, False), (False, False)]


def test_breakdowns(spark):
    rows = spark.createDataFrame([(["a", "b"], True, "NONE", 100), (["a"], False, "E2", 500)], "tags array<string>, accepted boolean, error_type string, difficulty int").withColumn("process_valid", F.lit(True))
    got = {r["tag"]: (r["n"], r["pass_rate"], r["error_types"]) for r in metrics.tag_breakdown(rows).collect()}
    assert got == {"a": (2, 0.5, {"E2": 1}), "b": (1, 1.0, {})}
    assert {r["bucket"] for r in metrics.difficulty_breakdown(rows, "difficulty").collect()} == {"0-399", "400-799"}


EV = "candidate string, kind string, strength int, step_id string, error_type string, indicates_invalid boolean, pos int"
ST = "candidate string, step_id string, status string, confidence double, error_type string"


def fused(spark, evidence, steps, status):
    runs = spark.createDataFrame([("c", status)], "candidate string, status string")
    return fusion.fuse(spark.createDataFrame(evidence, EV), spark.createDataFrame(steps, ST), runs).first()


def test_fusion(spark):
    ok = [("c", f"S{i}", "correct", 0.9, "NONE") for i in range(1, 8)]
    got = fused(spark, [], ok, "AC")
    assert got["process_valid"] and got["error_type"] == "NONE" and got["confidence"] == 0.9
    got = fused(spark, [], [("c", "S2", "incorrect", 0.9, "E2")], "WA")
    assert (got["process_valid"], got["first_error_step"], got["error_type"]) == (False, "S2", "E2")
    got = fused(spark, [("c", "counterexample", 5, "S6", "E4", True, 0)], ok, "AC")
    assert (got["process_valid"], got["first_error_step"], got["error_type"], got["confidence"]) == (False, "S6", "E4", 1.0)
    got = fused(spark, [], ok, "TLE")
    assert (got["first_error_step"], got["error_type"]) == ("S7", "E5")
    got = fused(spark, [("c", "rule", 4, None, "E1", True, 0)], ok, "AC")
    assert got["process_valid"] is False and got["first_error_step"] is None


def test_fusion_equals_loop(spark):
    draw = random.Random(7)
    rank = lambda s: int(s[1]) - 1 if s else 7
    ev, st, want = [], [], {}
    for c in range(200):
        name, mine, steps = f"c{c}", [], []
        for p in range(draw.randint(0, 4)):
            mine.append((name, draw.choice(list(fusion.PRIORITY)), draw.randint(1, 5), draw.choice([None, "S1", "S3", "S6"]), f"E{draw.randint(1, 8)}", draw.random() < 0.7, p))
        for s in draw.sample(["S1", "S2", "S5", "S7"], draw.randint(0, 3)):
            steps.append((name, s, draw.choice(["correct", "incorrect"]), 0.5, f"E{draw.randint(1, 8)}"))
        bad = [e for e in mine if e[5]]
        first, kind = None, "NONE"
        for e in sorted(bad, key=lambda e: (-fusion.PRIORITY[e[1]], -e[2])):
            if e[3] and (first is None or rank(e[3]) < rank(first)):
                first, kind = e[3], e[4]
        for s in (s for s in steps if s[2] == "incorrect"):
            if first is None or rank(s[1]) < rank(first):
                first, kind = s[1], s[4]
        want[name] = (not bad and not any(s[2] == "incorrect" for s in steps), first, kind)
        ev += mine
        st += steps
    runs = spark.createDataFrame([(k, None) for k in want], "candidate string, status string")
    got = fusion.fuse(spark.createDataFrame(ev, EV), spark.createDataFrame(st, ST), runs).collect()
    assert {r["candidate"]: (r["process_valid"], r["first_error_step"], r["error_type"]) for r in got} == want


def test_rules_quadrant_budget(spark):
    good = {f"S{i}": "a text that is long enough" for i in range(1, 8)} | {"S5": "it is O(n) in time"}
    rows = spark.createDataFrame([(good, "python", "print(sum(map(int, input().split())))"), ({"S1": "x"}, "java", "x" * 30)], "steps map<string,string>, language string, code string")
    got = [r[0] for r in rows.select(fusion.structural_evidence(F.col("steps"), F.col("language"), F.col("code"))).collect()]
    assert got[0] == [] and {e["step_id"] for e in got[1]} == {f"S{i}" for i in range(1, 8)}
    table = spark.createDataFrame([(True, True, False), (True, False, False), (False, True, False), (False, False, True)], "a boolean, v boolean, w boolean")
    assert [r[0] for r in table.select(fusion.quadrant(F.col("a"), F.col("v"), F.col("w"))).collect()] == ["full_correct", "ac_but_invalid", "implementation_error", "reasoning_error"]
    cases = spark.createDataFrame([(0, False, False, None, "verify"), (0, False, False, None, "solve"), (0, True, False, None, "verify"), (0, False, False, 2400, "verify"), (1, False, False, None, "verify")], "r int, c boolean, l boolean, d int, p string")
    assert [r[0] for r in cases.select(fusion.budget(F.col("r"), F.col("c"), F.col("l"), F.col("d"), F.col("p"))).collect()] == ["LOW", "HIGH", "HIGH", "HIGH", "HIGH"]


def test_validation(spark):
    base = {"S1": "a", "S2": "b", "S3": "c"}
    rows = [("p", "correct", "correct", base, "x", None), ("p", "i1", "injected", base | {"S2": "z"}, "y", "S2"), ("p", "i2", "injected", base | {"S1": "z"}, "y", "S2"), ("p", "a1", "ac_invalid", base | {"S2": "z", "S3": "z"}, "q", "S2")]
    got = validate.against_base(spark.createDataFrame(rows, "pid string, name string, kind string, steps map<string,string>, code string, first_error string")).collect()
    assert {(r["name"], r["violation"]) for r in got} == {("i2", "prefix_changed"), ("a1", "more_than_one_changed"), ("a1", "code_changed")}
    labels = spark.createDataFrame([(False, "AC"), (True, "AC"), (None, "AC"), (False, "WA")], "v boolean, s string")
    assert [r[0] for r in labels.select(validate.derived_labels(F.col("v"), F.col("s"))).collect()] == [True, False, False, False]
    both = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None})], "o map<string,string>, e map<string,string>")
    assert both.select(validate.overlay(F.col("o"), F.col("e"))).first()[0] == {"a": "1", "b": None}
    good, bad = validate.quarantined(spark.createDataFrame([("S1", "correct", 3), ("S9", "correct", 9)], "step_id string, status string, strength int"), validate.domain_checks())
    assert good.count() == 1 and bad.first()["broken"] == ["step_id", "strength"]


def test_ablation_equals_layer_by_layer(spark):
    """One pass for all configurations against the layered plan run once for each."""
    draw = random.Random(8)
    step, error = lambda: draw.choice([None, "S1", "S4", "S7"]), lambda: draw.choice([None, "NONE", "E2", "E6"])
    columns = ["candidate", "layer", "kind", "strength", "step_id", "error_type", "indicates_invalid", "pos"]
    evidence = [(f"c{draw.randrange(40)}", draw.choice(["rules", "consistency", "counterexample"]), draw.choice(list(fusion.PRIORITY)), draw.randrange(1, 6), step(), error(), draw.random() < 0.6, i) for i in range(120)]
    verdict = lambda: (draw.choice(["correct", "incorrect", "suspicious", "unverifiable"]), draw.choice([None, 0.3, 0.6, 0.9]), error())
    pairs = sorted({(f"c{draw.randrange(40)}", f"S{draw.randrange(1, 8)}") for _ in range(150)})
    verdicts = [(c, s, verdict(), verdict() if draw.random() < 0.5 else None) for c, s in pairs]
    executions = spark.createDataFrame([(f"c{i}", draw.choice(["AC", "WA", "TLE", None])) for i in range(45)], "candidate string, status string")
    rows = spark.createDataFrame(evidence, "candidate string, layer string, kind string, strength int, step_id string, error_type string, indicates_invalid boolean, pos long")
    one = "struct<status:string,confidence:double,error_type:string>"
    both = spark.createDataFrame(verdicts, f"candidate string, step_id string, scan {one}, fine {one}")
    configs = {"all": {}, "none": dict.fromkeys(fusion.SWITCHES, False), **{f"no_{k}": {k: False} for k in fusion.SWITCHES}}
    got = {}
    for r in fusion.ablate(rows, both, executions, configs).collect():
        got.setdefault(r["config"], []).append(tuple(r[c] for c in ("candidate", "exec_status", "process_valid", "first_error_step", "error_type", "confidence")))
    layer = lambda name: rows.where(F.col("layer") == name).select(*(c for c in columns if c != "layer"))
    of = lambda name: both.where(F.col(name).isNotNull()).select("candidate", "step_id", f"{name}.*")
    for name, switches in configs.items():
        want = fusion.layered(layer("rules"), of("scan"), of("fine"), layer("consistency"), layer("counterexample"), executions, **switches)
        assert sorted(map(str, got[name])) == sorted(str(tuple(r)) for r in want.collect()), name


def test_counts_of_a_write_equal_the_funnel(spark, tmp_path):
    rows = spark.range(500).select("id", F.array_compact(F.array(F.when(F.col("id") % 3 == 0, "a"), F.when(F.col("id") % 5 == 0, "b"), F.when(F.col("id") % 7 == 0, "odd"))).alias("reject_reasons"), (F.col("id") % 2).cast("string").alias("source"))
    rows = rows.withColumn("passed", F.size("reject_reasons") == 0)
    tally = gate.tallied(rows, ("a", "b", "never"), source=("0", "1"))
    spark.sparkContext.setJobGroup("one-scan", "")
    tally.rows.write.json(str(tmp_path / "pool"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-scan"))
    counts = tally.counts()
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-scan")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {r["metric"]: r["n"] for r in gate.funnel(rows).collect()}
    want["reason:other"] = want.pop("reason:odd")
    want |= {f"source:{r['source']}": r["n"] for r in gate.passed_by(rows, "source").collect()}
    assert counts == want and spark.read.json(str(tmp_path / "pool")).count() == 500
