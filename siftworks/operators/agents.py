"""Solving, repairing and auditing with a model: prompts as columns, replies as tables, layers as joins.

A model is a function (``external.Model``), called once for each prompt in the
executors; all else are DataFrame operations, so thousands of problems go through a
round together. Replies are written down as they come, as asking again could give others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import compare, text
from ..functions.noisy_json import object_text
from ..session import cut
from ..sources.dataset_dirs import solutions
from . import external, fusion, validate, verdicts

SOLVER = "You solve programming problems in seven steps: S1 reading, S2 constraints, S3 idea, S4 correctness, S5 complexity, S6 edge cases, S7 code."
SOLVE = 'Solve the problem.\n\n{problem}\n\nReply with one JSON object: {"steps": [{"step_id": "S1", "title": "", "content": ""}], "code": {"language": "python", "code": ""}}.'
NUDGE = "\n\nYour last reply was no such object. Reply with nothing but the JSON object."
REPAIRER = "You mend solutions: keep the steps that are right and write anew from the first wrong one on."
REPAIR = "Mend the solution.\n\n{problem}\n\nSolution: {solution}\nExecution: {status}, first failing case: {failed}\nFirst wrong step: {step} ({kind})\nEvidence: {evidence}\n\nReply with the whole solution as the same JSON object."
REPAIR_BLIND = "Mend the solution.\n\n{problem}\n\nSolution: {solution}\nExecution: {status}, first failing case: {failed}\n\nReply with the whole solution as the same JSON object."
VERIFIER = "You check the steps of a solution."
SCAN = 'Scan all steps.\n\n{problem}\n\nSolution: {solution}\n{reference}\nReply with {"steps": [{"step_id": "S1", "status": "correct|incorrect|suspicious|downstream|unverifiable", "confidence": 0.5, "error_type": "NONE", "suspicious_claim": ""}]}.'
FINE = 'Verify step {step} closely.\n\n{problem}\n\nSolution: {solution}\n{reference}\nReply with {"status": "", "confidence": 0.5, "error_type": "NONE"}.'
CONSISTENCY = 'Does the code do what the steps say?\n\n{problem}\n\nSolution: {solution}\n\nReply with {"consistent": true, "mismatches": [{"aspect": "", "error_type": "E6"}]}.'
COUNTEREXAMPLE = 'Find a counterexample to the claim of step {step}: {claim}\n\n{problem}\n\nSolution: {solution}\n\nReply with {"claim_holds": false, "input": "", "expected_output": ""}.'
#: Claims of one candidate that counterexamples are sought for, and pieces of evidence that a repair is told.
CLAIMS, TOLD = 2, 8

STEP = "step_id string, status string, confidence string, error_type string, suspicious_claim string"


def _solution(steps: Column, code: Column, language: Column) -> Column:
    return F.to_json(F.struct(steps.alias("steps"), F.struct(language.alias("language"), code.alias("code")).alias("code")))


def _prompts(rows: DataFrame, key: list[str], system: str, template: str, budget: Column, **values: Column | str) -> DataFrame:
    return rows.select(*key, F.lit(system).alias("system"), external.prompt(template, **values).alias("user"), budget.alias("budget"))


def _parsed(prompts: DataFrame, model: external.Model, retries: int) -> DataFrame:
    """candidate, steps, code, language and usage; a reply that is no solution is asked for again with a nudge; without one steps are null."""
    out, todo = None, prompts
    for attempt in range(retries + 1):
        got = cut(external.asked(todo, ["candidate"], model, needs_object=False))
        made = solutions(got.withColumn("text", object_text("reply")))
        made = made.select("candidate", F.when(F.size("steps") > 0, F.col("steps")).alias("steps"), "code", "language", "prompt_tokens", "completion_tokens", "calls", "error")
        kept = made if attempt == retries else made.where("steps is not null")
        out = kept if out is None else out.unionByName(kept)
        todo = todo.join(made.where("steps is null").select("candidate"), "candidate", "left_semi").withColumn("user", F.concat("user", F.lit(NUDGE)))
    return cut(out)


def solve(problems: DataFrame, model: external.Model, retries: int = 2) -> DataFrame:
    """A structured solution of each problem (candidate, statement)."""
    return _parsed(_prompts(problems, ["candidate"], SOLVER, SOLVE, F.lit("HIGH"), problem="statement"), model, retries)


def repair(rows: DataFrame, model: external.Model, guided: bool = True, budget: Column | None = None, retries: int = 1) -> DataFrame:
    """Solutions mended by what is known of them: by the audit's first wrong step and evidence, or by the execution alone.

    ``rows``: candidate, statement, steps, code, language, exec_status, failed_index and,
    if guided, first_error_step, error_type, evidence (array of text).
    """
    at = {"problem": "statement", "solution": _solution(F.col("steps"), F.col("code"), F.col("language")), "status": F.coalesce("exec_status", F.lit("not run")), "failed": F.coalesce(F.concat(F.lit("#"), F.col("failed_index").cast("string")), F.lit("-"))}
    if guided:
        at |= {"step": F.coalesce("first_error_step", F.lit("-")), "kind": "error_type", "evidence": F.array_join(F.slice("evidence", 1, TOLD), "; ")}
    high = F.lit("HIGH" if guided else "LOW") if budget is None else budget
    return _parsed(_prompts(rows, ["candidate"], REPAIRER, REPAIR if guided else REPAIR_BLIND, high, **at), model, retries)


def judged(candidates: DataFrame, cases: DataFrame, runner: external.Runner) -> DataFrame:
    """candidate, status, passed, total, failed_index. ``candidates``: candidate, pid, code, language, seconds, comparison; ``cases``: pid, ord, input, expected."""
    runs = cut(external.run_programs(candidates.select("candidate", "pid", "language", "code", "seconds"), cases, runner))
    equal = compare.outputs_equal_by("stdout", "expected", F.col("comparison"))
    runs = external.run_status(runs.join(candidates.select("candidate", "comparison"), "candidate"), equal)
    rolled = verdicts.first_failure(runs.select("candidate", "ord", "status"), ["candidate"], "ord")
    total = cases.groupBy("pid").agg(F.count("*").alias("_total"))
    every = candidates.select("candidate", "pid").join(total, "pid", "left")
    out = verdicts.without_cases(every, rolled, ["candidate"])
    return out.select("candidate", "status", "passed", F.coalesce("_total", F.lit(0)).alias("total"), "failed_index")


def _step_rows(replies: DataFrame) -> DataFrame:
    """Verdicts on steps out of scan replies; of two on one step the last counts."""
    listed = F.from_json(object_text("reply"), f"steps array<struct<{STEP.replace(' string', ':string')}>>")["steps"]
    rows = replies.select("candidate", F.posexplode(listed).alias("_n", "s")).select("candidate", "_n", "s.*")
    number = F.regexp_extract(F.upper(F.trim("step_id")), r"^S0*(\d+)$", 1)
    rows = rows.withColumn("step_id", F.concat(F.lit("S"), number)).where(F.col("step_id").isin(*text.STEPS))
    last = rows.groupBy("candidate", "step_id").agg(F.max_by(F.struct("status", "confidence", "error_type", "suspicious_claim"), "_n").alias("s"))
    return last.select("candidate", "step_id", *_verdict("s."), F.coalesce("s.suspicious_claim", F.lit("")).alias("claim"))


def _verdict(prefix: str) -> list[Column]:
    status = F.lower(F.coalesce(F.col(f"{prefix}status"), F.lit("")))
    return [F.when(status.isin(*validate.STATUSES), status).otherwise("unverifiable").alias("status"), text.clamped_confidence(f"{prefix}confidence").alias("confidence"), text.error_type(F.coalesce(F.col(f"{prefix}error_type"), F.lit(""))).alias("error_type")]


def evidence_layers(candidates: DataFrame, model: external.Model, runner: external.Runner | None = None, adaptive: bool = True, everything: bool = False) -> dict[str, DataFrame]:
    """All layers' evidence on each candidate, as ``fusion.layered`` takes it, and what the model has used.

    ``candidates``: candidate, statement, steps, code, language, rating, reference,
    reference_language, seconds. Fine verification, consistency and counterexamples are
    not sought where a rule has already failed hard, or without suspicion; with ``everything`` a failed rule spares
    nothing. Without ``adaptive`` the scan is asked for on the low budget. A layer whose
    model raises or answers nonsense brings no rows.
    """
    rows = candidates.withColumn("_solution", _solution(F.col("steps"), F.col("code"), F.col("language")))
    given = {"problem": "statement", "solution": "_solution"}
    reference = F.when(F.coalesce("reference", F.lit("")) != "", F.concat(F.lit("Reference, to hold the steps against: "), "reference")).otherwise("")
    found = rows.select("candidate", F.posexplode(fusion.structural_evidence(F.col("steps"), F.col("language"), F.col("code"))).alias("pos", "e"))
    structural = cut(found.select("candidate", "e.*", F.col("pos").cast("long").alias("pos")))
    soft = rows if everything else rows.join(structural.where("indicates_invalid").select("candidate").distinct(), "candidate", "left_anti")

    budget = fusion.budget(F.lit(0), F.lit(False), F.lit(False), F.col("rating"), F.lit("verify")) if adaptive else F.lit("LOW")
    scanned = cut(external.asked(_prompts(rows, ["candidate"], VERIFIER, SCAN, budget, reference=reference, **given), ["candidate"], model))
    steps = cut(validate.padded_steps(_step_rows(scanned), rows.select("candidate")).withColumn("claim", F.coalesce("claim", F.lit(""))))

    suspected = steps.where("status = 'suspicious'").join(soft.select("candidate"), "candidate", "left_semi")
    near = fusion.neighbours(suspected.select("candidate", text.step_rank("step_id").alias("step")), "candidate", "step")
    near = near.select("candidate", F.concat(F.lit("S"), (F.col("step") + 1).cast("string")).alias("step_id"))
    close = _prompts(near.join(rows, "candidate"), ["candidate", "step_id"], VERIFIER, FINE, F.lit("HIGH"), step="step_id", reference=reference, **given)
    answered = cut(external.asked(close, ["candidate", "step_id"], model))
    fine = answered.withColumn("s", F.from_json(object_text("reply"), "status string, confidence string, error_type string")).where("s is not null").select("candidate", "step_id", *_verdict("s."))

    said = cut(external.asked(_prompts(soft, ["candidate"], VERIFIER, CONSISTENCY, F.lit("LOW"), **given), ["candidate"], model))
    told = said.withColumn("c", F.from_json(object_text("reply"), "consistent boolean, mismatches array<struct<error_type:string>>")).where("c is not null")
    clash = fusion.consistency_evidence(F.coalesce(F.col("c.consistent"), F.lit(True)), F.lit(True))
    kind = F.get(F.filter(F.transform("c.mismatches", lambda m: F.upper(m["error_type"])), lambda e: e.isin("E5", "E6")), F.lit(0))
    consistency = told.select("candidate", clash.alias("e"), F.coalesce(kind, F.lit("E6")).alias("error_type")).where("e is not null")
    consistency = consistency.select("candidate", "e.kind", "e.strength", "e.step_id", "error_type", "e.indicates_invalid", F.lit(0).cast("long").alias("pos"))

    columns = ["candidate", "kind", "strength", "step_id", "error_type", "indicates_invalid", "pos"]
    counter, sought = structural.select(columns).limit(0), None
    if runner is not None:
        counter, sought = _counterexamples(rows, fusion.merged_verdicts(steps, fine), steps, model, runner)
    used = scanned
    for more in (answered, said, sought):
        used = used if more is None else used.unionByName(more.select(*scanned.columns))
    return {"structural": structural.select(columns), "scan": steps.drop("claim"), "fine": fine, "consistency": consistency, "counterexample": counter, "usage": verdicts.usage(used, "candidate")}


def _counterexamples(rows: DataFrame, merged: DataFrame, steps: DataFrame, model: external.Model, runner: external.Runner) -> tuple[DataFrame, DataFrame]:
    """Evidence of inputs that break a claim, confirmed by running the reference, or else the model's own answer, and the candidate."""
    claims = merged.where("status in ('suspicious', 'incorrect')").join(steps.where("claim <> ''").select("candidate", "step_id", "claim"), ["candidate", "step_id"])
    nth = F.row_number().over(Window.partitionBy("candidate").orderBy(text.step_rank("step_id")))
    claims = cut(claims.withColumn("_n", nth).where(F.col("_n") <= CLAIMS).join(rows, "candidate"))
    prompts = _prompts(claims, ["candidate", "step_id"], VERIFIER, COUNTEREXAMPLE, F.lit("HIGH"), step="step_id", claim="claim", problem="statement", solution="_solution")
    sought = cut(external.asked(prompts, ["candidate", "step_id"], model))
    made = sought.withColumn("c", F.from_json(object_text("reply"), "claim_holds boolean, input string, expected_output string")).where("not coalesce(c.claim_holds, true) and trim(coalesce(c.input, '')) <> ''")
    made = made.select("candidate", "step_id", F.col("c.input").alias("input"), F.coalesce("c.expected_output", F.lit("")).alias("said"))
    tried = claims.drop("input").join(made, ["candidate", "step_id"]).withColumn("pid", F.concat_ws("/", F.col("candidate").cast("string"), "step_id"))
    cases = tried.select("pid", F.lit(0).alias("ord"), "input", F.lit("").alias("expected"))
    run = lambda code, language: cut(external.run_programs(tried.select(F.col("pid").alias("candidate"), "pid", F.col(language).alias("language"), F.coalesce(code, F.lit("")).alias("code"), "seconds"), cases, runner, abort=False))
    clean = (F.col("exit_code") == 0) & ~F.col("timed_out") & ~F.col("over_memory") & F.col("error").isNull()
    truth = run("reference", "reference_language").where(clean).select(F.col("candidate").alias("pid"), F.col("stdout").alias("truth"))
    own = run("code", "language").select(F.col("candidate").alias("pid"), F.coalesce(clean, F.lit(False)).alias("clean"), F.coalesce("stdout", F.lit("")).alias("got"))
    both = tried.where("coalesce(reference, '') <> ''").select("pid").join(truth, "pid")
    known = tried.join(both, "pid", "left").join(own, "pid", "left")
    want = F.coalesce("truth", "said")
    found = fusion.counterexample_evidence(F.coalesce("clean", F.lit(False)) & (want != ""), compare.outputs_equal(F.coalesce("got", F.lit("")), want), F.col("truth").isNotNull(), F.col("step_id"), F.when(F.col("error_type") == "NONE", "E8").otherwise(F.col("error_type")))
    out = known.select("candidate", found.alias("e"), F.col("_n").cast("long").alias("pos")).select("candidate", "e.*", "pos")
    return out.select("candidate", "kind", "strength", "step_id", "error_type", "indicates_invalid", "pos"), sought


def audit(candidates: DataFrame, runs: DataFrame, model: external.Model, runner: external.Runner | None = None, **switches: bool) -> DataFrame:
    """Decision, quadrant and told evidence of each candidate. ``runs``: candidate, status (null: not run)."""
    of = evidence_layers(candidates, model, runner)
    decided = fusion.layered(*(of[k] for k in ("structural", "scan", "fine", "consistency", "counterexample")), runs, **switches)
    wrong = of["scan"].where("status = 'incorrect' and step_id <> 'S7'").select("candidate").distinct().withColumn("_wrong", F.lit(True))
    every = of["structural"].unionByName(of["consistency"]).unionByName(of["counterexample"]).where("indicates_invalid")
    told = every.select("candidate", F.struct((-F.col("strength")).alias("s"), F.concat_ws(" ", "kind", "step_id", "error_type").alias("t")).alias("e"))
    nth = F.row_number().over(Window.partitionBy("candidate").orderBy("e"))
    told = told.withColumn("_n", nth).where(F.col("_n") <= TOLD).groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]).alias("evidence"))
    out = decided.join(wrong, "candidate", "left").join(told, "candidate", "left").join(of["usage"], "candidate", "left")
    quadrant = F.when(F.col("exec_status").isNotNull(), fusion.quadrant(F.col("exec_status") == "AC", F.col("process_valid"), F.coalesce("_wrong", F.lit(False))))
    return cut(out.withColumns({"quadrant": quadrant, "evidence": F.coalesce("evidence", F.array().cast("array<string>"))}).drop("_wrong"))


def solve_and_repair(problems: DataFrame, cases: DataFrame, model: external.Model, runner: external.Runner, most_repairs: int = 3, guided: bool = True) -> DataFrame:
    """Solve, run, audit, and mend what is not both accepted and valid, round by round.

    ``problems``: candidate, pid, statement, rating, reference, reference_language,
    seconds, comparison. Adds the last solution, its run and audit, and ``rounds`` of repair.
    """
    made, done = solve(problems, model), None
    for round_ in range(most_repairs + 1):
        state = problems.join(made.select("candidate", "steps", "code", "language"), "candidate").withColumns(
            {"steps": F.coalesce("steps", F.create_map().cast("map<string,string>")), "code": F.coalesce("code", F.lit("")), "language": F.coalesce("language", F.lit("python"))}
        )
        state = cut(state)
        ran = cut(judged(state, cases, runner))
        audited = audit(state, ran.select("candidate", "status"), model, runner)
        full = cut(state.join(ran.select("candidate", "passed", "total", "failed_index"), "candidate").join(audited, "candidate").withColumn("rounds", F.lit(round_)))
        good = (F.col("exec_status") == "AC") & F.col("process_valid")
        over = full if round_ == most_repairs else full.where(good)
        done = over if done is None else done.unionByName(over)
        left = full.where(~F.coalesce(good, F.lit(False)))
        if round_ == most_repairs or left.isEmpty():
            break
        conflict = (F.col("exec_status") == "AC") & ~F.col("process_valid")
        made = repair(left, model, guided, fusion.budget(F.lit(round_ + 1), conflict, F.lit(False), F.col("rating"), F.lit("repair")))
        problems = problems.join(left.select("candidate"), "candidate", "left_semi")
    return cut(done)
