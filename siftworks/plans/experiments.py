"""Experiments over a data set: labelled variants evaluated, layers left out, ways to repair compared, candidates built and checked.

Each is a few joins over tables of candidates, so all problems of a set go through a step together; records stay
tables, and only their aggregates come to the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reports
from ..functions import text
from ..operators import agents, candidates, external, fusion, metrics, validate
from ..session import cut
from ..sources import dataset_dirs
from ..sources.stores import write_files

#: Layers of the evaluation that are left out in turn. The last configuration asks the model on the low budget.
CONFIGS = {"full": {}, "no_structural": {"rules": False}, "no_consistency": {"consistency": False}, "no_counterexample": {"counterexample": False}, "no_fine_verify": {"fine": False}}
LOW_BUDGET = "fixed_low_budget"
STRATEGIES = ("one_shot", "exec_only", "process_guided")
LABELS = ("kind", "process_valid", "first_error", "error_type", "exec_status", "ac_but_invalid")
PREDICTED = ("process_valid", "first_error_step", "error_type", "confidence")


def variant_rows(problems: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants as candidates, with their problem and, as ``label_...``, their labels."""
    of = problems.select("pid", "statement", F.col("difficulty").alias("rating"), "reference", "reference_language", F.coalesce("time_limit_seconds", F.lit(2.0)).alias("seconds"))
    labels = [F.col(c).alias(f"label_{c}") for c in LABELS]
    return variants.select("pid", "name", text.candidate_id("pid", "name").alias("candidate"), "steps", "code", "language", *labels).join(of, "pid")


def decisions(rows: DataFrame, model: external.Model, runner: external.Runner | None, configs: dict[str, dict[str, bool]], adaptive: bool = True) -> DataFrame:
    """What is decided on each candidate under each configuration; the layers' evidence is gathered once for all of them.

    Candidates did not run here: their execution belongs to the labels. Where a rule has failed hard, the consistency
    check and fine verification count only with the rules left out.
    """
    of = agents.evidence_layers(rows, model, runner, adaptive, everything=True)
    hard = of["structural"].where("indicates_invalid").select("candidate").distinct().withColumn("hard", F.lit(True))
    layer = lambda name, key: of[key].withColumn("layer", F.lit(name))
    evidence = layer("rules", "structural").unionByName(layer("consistency", "consistency")).unionByName(layer("counterexample", "counterexample"))
    evidence = evidence.join(hard, "candidate", "left").withColumn("hard", F.col("hard").isNotNull() & (F.col("layer") == "consistency"))
    verdict = lambda name: F.struct("status", "confidence", "error_type").alias(name)
    both = of["scan"].select("candidate", "step_id", verdict("scan")).join(of["fine"].select("candidate", "step_id", verdict("fine")), ["candidate", "step_id"], "left")
    both = both.join(hard, "candidate", "left").withColumn("hard", F.col("hard").isNotNull())
    runs = rows.select("candidate", F.lit(None).cast("string").alias("status"))
    return fusion.ablate(evidence, both, runs, configs)


def evaluated(problems: DataFrame, variants: DataFrame, model: external.Model, runner: external.Runner | None = None, ablation: bool = False) -> DataFrame:
    """A record for each variant and configuration: labels beside what was decided. Without ``ablation`` the full one alone."""
    rows = cut(variant_rows(problems, variants))
    made = decisions(rows, model, runner, CONFIGS if ablation else {"full": {}})
    if ablation:
        made = made.unionByName(decisions(rows, model, runner, {LOW_BUDGET: {}}, adaptive=False))
    known = rows.select("candidate", "pid", "name", "rating", *(f"label_{c}" for c in LABELS))
    return cut(known.join(made.select("config", "candidate", *PREDICTED), "candidate"))


def evaluator_metrics(records: DataFrame) -> DataFrame:
    """One row a configuration: detection, first error, error type and accepted-but-invalid, over labelled variants."""
    flagged = ~F.col("process_valid")
    rows = records.select(
        "config", (~F.col("label_process_valid")).alias("labelled_invalid"), flagged.alias("flagged"), F.col("first_error_step").alias("predicted_step"), F.nullif("label_first_error", F.lit("")).alias("labelled_step"),
        F.when(flagged, F.col("error_type")).otherwise("NONE").alias("predicted_type"), F.col("label_error_type").alias("labelled_type"), F.col("label_ac_but_invalid").alias("abi_label"),
        F.coalesce("label_process_valid", F.lit(False)).alias("label_valid"), (F.coalesce("label_exec_status", F.lit("")) == "AC").alias("label_accepted"),
    )
    out = metrics.detection(rows, "config").join(metrics.localisation(rows, "config"), "config")
    out = out.join(metrics.accepted_but_invalid(rows, "config").select("config", "abi_precision", "abi_recall"), "config")
    typed = rows.where(~F.coalesce("labelled_type", F.lit("")).isin("", "NONE") & (F.col("predicted_type") != "NONE"))
    confusion = cut(typed.groupBy("config", F.col("labelled_type").alias("labelled"), F.col("predicted_type").alias("predicted")).agg(F.count("*").alias("n")))
    names = sorted(r["config"] for r in records.select("config").distinct().collect())  # the configurations
    macro = reduce(DataFrame.unionByName, (metrics.macro_f1(confusion.where(F.col("config") == n)).withColumn("config", F.lit(n)) for n in names))
    return out.join(macro, "config")


def repair_experiment(problems: DataFrame, cases: DataFrame, model: external.Model, runner: external.Runner, most: int = 3) -> DataFrame:
    """candidate, pid, strategy, solved_round (0: at once, null: never), final_exec, tokens, calls.

    All strategies start from one solution of each problem: none repairs, one repairs by the execution alone, one by the
    audit's first wrong step. A problem without a readable solution has no record. ``problems`` as for ``solve_and_repair``.
    """
    made = agents.solve(problems, model).where("steps IS NOT NULL").select("candidate", "steps", "code", "language")
    first = cut(problems.join(made, "candidate"))
    ran = lambda rows: agents.judged(rows, cases, runner).select("candidate", F.col("status").alias("exec_status"), "failed_index")
    first = cut(first.join(ran(first), "candidate"))
    none = [F.lit(0).cast("long").alias(c) for c in ("tokens", "calls")]
    record = lambda rows, strategy, solved, *used: rows.select("candidate", "pid", F.lit(strategy).alias("strategy"), solved.cast("int").alias("solved_round"), F.col("exec_status").alias("final_exec"), *used)
    at_once = F.when(F.col("exec_status") == "AC", 0)
    out = [record(first, "one_shot", at_once, *none)]
    for strategy in STRATEGIES[1:]:
        out.append(record(first.where("exec_status = 'AC'"), strategy, at_once, *none))
        left = first.where("exec_status <> 'AC'").withColumns({"tokens": F.lit(0).cast("long"), "calls": F.lit(0).cast("long")})
        for round_ in range(1, most + 1):
            if strategy == "process_guided":
                audited = agents.audit(left.drop("tokens", "calls"), left.select("candidate", F.col("exec_status").alias("status")), model, runner)
                told = audited.select("candidate", "first_error_step", "error_type", "evidence", F.coalesce("total_tokens", F.lit(0)).alias("_t"), F.coalesce(F.col("calls"), F.lit(0)).alias("_c"))
                left = cut(left.join(told, "candidate").withColumns({"tokens": F.col("tokens") + F.col("_t"), "calls": F.col("calls") + F.col("_c")}).drop("_t", "_c"))
                budget = fusion.budget(F.lit(round_), F.lit(False), F.lit(False), F.col("rating"), F.lit("repair"))
                mended = agents.repair(left, model, True, budget)
            else:
                mended = agents.repair(left, model, False)
            used = mended.select("candidate", *(F.col(c).alias(f"_{c}") for c in ("steps", "code", "language")), (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("_t"), F.coalesce(F.col("calls"), F.lit(0)).alias("_c"))
            both = left.drop("exec_status", "failed_index", "first_error_step", "error_type", "evidence").join(used, "candidate")
            # A reply that can't be read leaves the solution as it was; the round is used up.
            fresh = F.col("_steps").isNotNull()
            both = both.withColumns({c: F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("steps", "code", "language")} | {"tokens": F.col("tokens") + F.col("_t"), "calls": F.col("calls") + F.col("_c")})
            state = cut(both.drop("_steps", "_code", "_language", "_t", "_c"))
            full = cut(state.join(ran(state), "candidate"))
            out.append(record(full.where("exec_status = 'AC'"), strategy, F.lit(round_), "tokens", "calls"))
            left = full.where("exec_status <> 'AC'")
            if left.isEmpty():
                break
        out.append(record(left, strategy, F.lit(None), "tokens", "calls"))
    return cut(reduce(DataFrame.unionByName, out))


CANDIDATE = ("candidate", "pid", "name", "kind", "steps", "code", "language", "exec_status", "process_valid", "first_error", "error_type", "ac_but_invalid", "steps_sha256")


def built_candidates(problems: DataFrame, cases: DataFrame, model: external.Model, runner: external.Runner, per_problem: int = 2, invalid: int = 1) -> DataFrame:
    """All four kinds of candidates of every problem with their labels (``CANDIDATE``)."""
    base = candidates.correct(problems, cases, model, runner)
    put = candidates.injected(base, cases, model, runner, per_problem)
    sly = candidates.accepted_invalid(base, cases, model, runner, invalid)
    raw = candidates.natural(problems, cases, model, runner)
    right = base.withColumns(
        {"name": F.lit("correct"), "kind": F.lit("correct"), "candidate": text.candidate_id("pid", F.lit("correct")), "process_valid": F.lit(True), "first_error": F.lit(None).cast("string"), "error_type": F.lit("NONE"), "ac_but_invalid": F.lit(False), "steps_sha256": text.steps_digest("steps")}
    )
    return cut(reduce(DataFrame.unionByName, (rows.select(*CANDIDATE) for rows in (right, put, sly, raw))))


def candidate_violations(rows: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """pid, name, violation: what breaks the rules that make labels credible.

    Changed candidates are held against their problem's correct one (``validate.against_base``); beside that a correct one
    must have been accepted and exist, all seven steps and the code must be there, and the code of an accepted but invalid one
    must be the reference's (``references``: pid, reference).
    """
    changed = F.col("kind").isin("injected", "ac_invalid")
    checks = F.array_compact(
        F.array(
            F.when((F.col("kind") == "correct") & (F.coalesce("exec_status", F.lit("")) != "AC"), "correct_not_accepted"),
            F.when(changed & (F.size(text.missing_sections("steps")) > 0), "steps_missing"),
            F.when(changed & (text.stripped(F.coalesce("code", F.lit(""))) == ""), "no_code"),
        )
    )
    out = rows.select("pid", "name", F.explode(checks).alias("violation"))
    bare = rows.select("pid").distinct().join(rows.where("kind = 'correct'").select("pid"), "pid", "left_anti")
    out = out.unionByName(bare.select("pid", F.lit("correct").alias("name"), F.lit("no_correct").alias("violation")))
    if references is not None:
        own = rows.where("kind = 'ac_invalid'").join(references.select("pid", "reference"), "pid")
        out = out.unionByName(own.where(text.stripped(F.col("code")) != text.stripped(F.col("reference"))).select("pid", "name", F.lit("not_the_reference").alias("violation")))
    return out.unionByName(validate.against_base(rows.select("pid", "name", "kind", "steps", "code", "first_error")))


def write_evaluation(records: DataFrame, root: str) -> dict:
    """A page for each variant of the full configuration, all records as JSON lines, and the metrics as summary.json and summary.md."""
    spark, table = records.sparkSession, cut(evaluator_metrics(records))
    full = records.where("config = 'full'")
    page = full.withColumns({"candidate": F.concat_ws("/", "pid", "name"), "evidence": F.array().cast("array<string>")})
    write_files(reports.pages(page, F.concat(F.lit("evaluator/"), "pid", F.lit("__"), "name", F.lit(".md"))), root)
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/records")
    summary = {r["config"]: {k: v for k, v in r.asDict().items() if k != "config"} for r in table.collect()}
    dataset_dirs.write_text(spark, f"{root}/summary.json", json.dumps(summary, sort_keys=True))
    dataset_dirs.write_text(spark, f"{root}/summary.md", dataset_dirs.markdown("Evaluation of labelled variants", table.orderBy("config")))
    return summary


def write_solver_run(done: DataFrame, root: str) -> dict:
    """A page in Markdown and HTML for each problem, its record, and the rates by difficulty and tag."""
    scored = cut(done.withColumns({"accepted": F.col("exec_status") == "AC", "error_type": F.coalesce("error_type", F.lit("NONE"))}))
    for ending in ("md", "html"):
        write_files(reports.pages(scored, F.concat(F.lit("solver/"), "pid", F.lit(f"/report.{ending}")), ending == "html"), root)
    scored.select("pid", "rating", "exec_status", "process_valid", "first_error_step", "error_type", "confidence", "quadrant", "rounds").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/records")
    rates = scored.select("*", F.when(F.col("accepted"), F.col("rounds")).alias("solved_round"))
    refine = rates.agg(*(metrics.refine_at_all("solved_round", k).alias(f"refine_at_{k}") for k in (1, 2, 3))).first().asDict()
    tables = {"rates": metrics.solver_rates(scored), "by_difficulty": metrics.difficulty_breakdown(scored, "rating"), "by_tag": metrics.tag_breakdown(scored)}
    summary = {k: [r.asDict(True) for r in t.limit(10_000).collect()] for k, t in tables.items()} | {"refine": refine}  # rates, buckets and tags
    dataset_dirs.write_text(done.sparkSession, f"{root}/summary.json", json.dumps(summary, sort_keys=True, ensure_ascii=False))
    return summary
