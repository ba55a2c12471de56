"""Labelled candidate answers of verified problems: correct ones, such with an error put in, accepted but invalid and natural ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut
from . import agents, external, select, validate

WRITER = "You write worked solutions in seven sections, ## S1 to ## S7, with the code in a fenced block."
INJECT = "Put one error of kind {kind} into step {step}, and carry it on into the later steps and the code. Leave the steps before it alone.\n\n{problem}\n\nSolution:\n{solution}\n\nReply with sections {step} to S7."
INVALID = "Give step {step} a wrong reason of kind {kind} and leave all other steps and the code as they are.\n\n{problem}\n\nSolution:\n{solution}\n\nReply with section {step} alone."
KINDS = ("E1", "E2", "E3", "E4", "E5", "E6", "E7", "E8")
#: Steps that errors are put into, in turn; those of accepted but invalid answers are before the code.
INJECTED, INVALID_STEPS = ("S2", "S3", "S4", "S5", "S6"), ("S3", "S4", "S5")


def correct(problems: DataFrame, cases: DataFrame, model: external.Model, runner: external.Runner, attempts: int = 3) -> DataFrame:
    """The first answer of each problem that is accepted and has all steps: the problem's columns, steps, code, language, exec_status, passed, total.

    ``problems``: candidate, pid, statement, seconds, comparison.
    """
    out, todo = None, problems
    for _ in range(attempts):
        made = todo.join(agents.solve(todo, model).where("steps is not null").select("candidate", "steps", "code", "language"), "candidate")
        made = cut(made)
        ran = agents.judged(made, cases, runner).withColumnRenamed("status", "exec_status")
        whole = made.join(ran, "candidate").where((F.col("exec_status") == "AC") & (F.size(text.missing_sections("steps")) == 0))
        whole = cut(whole)
        out = whole if out is None else out.unionByName(whole)
        todo = todo.join(whole.select("candidate"), "candidate", "left_anti")
        if todo.isEmpty():
            break
    return out


def _changed(base: DataFrame, kind: str, template: str, steps: tuple[str, ...], per_problem: int, model: external.Model) -> DataFrame:
    """Base rows with a step and an error each in turn, and the sections that the model wrote."""
    planned = select.round_robin(base, ["pid"], per_problem, list(KINDS), "_kinds")
    planned = select.round_robin(planned.drop("row_index"), ["pid"], per_problem, list(steps), "_steps")
    rows = planned.select(*base.columns, F.posexplode(F.arrays_zip("_kinds", "_steps")).alias("_n", "_p"))
    rows = rows.select(*base.columns, F.coalesce("_p._kinds", F.lit(KINDS[0])).alias("error_type"), F.coalesce("_p._steps", F.lit(steps[0])).alias("first_error"), (F.col("_n") + 1).cast("string").alias("_suffix"))
    rows = rows.withColumns({"name": text.candidate_name(F.lit(kind), F.col("_suffix")), "kind": F.lit(kind)}).withColumn("candidate", text.candidate_id("pid", "name"))
    asked = rows.select("candidate", F.lit(WRITER).alias("system"), external.prompt(template, kind="error_type", step="first_error", problem="statement", solution=text.rendered_sections("steps")).alias("user"), F.lit("HIGH").alias("budget"))
    said = cut(external.asked(asked, ["candidate"], model, needs_object=False))
    return rows.drop("_suffix").join(said.select("candidate", "reply"), "candidate").withColumns({"_patch": text.sections(F.coalesce("reply", F.lit(""))), "_code": text.code_block(F.coalesce("reply", F.lit("")))})


def _from(step: Column, first: Column) -> Column:
    return text.step_rank(step) >= text.step_rank(first)


def injected(base: DataFrame, cases: DataFrame, model: external.Model, runner: external.Runner, per_problem: int = 2) -> DataFrame:
    """Answers with an error from a step on; the steps before are the base's, whatever the model wrote. Those that change nothing there are left out."""
    rows = _changed(base, "injected", INJECT, INJECTED, per_problem, model)
    patch = F.map_filter("_patch", lambda k, _: _from(k, F.col("first_error")))
    rows = rows.withColumns({"_base": F.col("steps"), "steps": text.merged_sections(F.col("steps"), patch), "code": F.when(F.col("_code") != "", F.col("_code")).otherwise(F.col("code"))})
    rows = rows.where(F.get(validate.changed_steps(F.col("_base"), F.col("steps")), F.lit(0)) == F.col("first_error"))
    return labelled(rows.drop("_base", "_patch", "_code", "reply", "exec_status", "passed", "total", "failed_index"), cases, runner, F.lit(False))


def accepted_invalid(base: DataFrame, cases: DataFrame, model: external.Model, runner: external.Runner, per_problem: int = 1) -> DataFrame:
    """Answers of which exactly one step is wrong while the code stays the accepted one."""
    rows = _changed(base, "ac_invalid", INVALID, INVALID_STEPS, per_problem, model)
    patch = F.map_filter("_patch", lambda k, _: k == F.col("first_error"))
    rows = rows.withColumns({"_base": F.col("steps"), "steps": text.merged_sections(F.col("steps"), patch)})
    rows = rows.where(F.size(validate.changed_steps(F.col("_base"), F.col("steps"))) == 1)
    return labelled(rows.drop("_base", "_patch", "_code", "reply", "exec_status", "passed", "total", "failed_index"), cases, runner, F.lit(False))


def natural(problems: DataFrame, cases: DataFrame, model: external.Model, runner: external.Runner) -> DataFrame:
    """Answers as the model gives them, whether accepted or not; whether their process is valid is not known."""
    rows = problems.withColumns({"name": F.lit("natural"), "kind": F.lit("natural"), "candidate": text.candidate_id("pid", F.lit("natural"))})
    rows = rows.join(agents.solve(rows, model).where("steps is not null").select("candidate", "steps", "code", "language"), "candidate")
    return labelled(rows.withColumns({"error_type": F.lit("NONE"), "first_error": F.lit(None).cast("string")}), cases, runner, F.lit(None).cast("boolean"))


def labelled(rows: DataFrame, cases: DataFrame, runner: external.Runner, valid: Column) -> DataFrame:
    """Candidates with what running them gives, and their labels."""
    rows = cut(rows)
    ran = agents.judged(rows, cases, runner).withColumnRenamed("status", "exec_status")
    out = rows.join(ran, "candidate").withColumn("process_valid", valid)
    return cut(out.withColumns({"ac_but_invalid": validate.derived_labels(F.col("process_valid"), F.col("exec_status")), "steps_sha256": text.steps_digest("steps"), "created_at": text.now_iso()}))


def report(rows: DataFrame) -> DataFrame:
    """(column, value, n) over kinds, statuses, error types and first errors, with the counts of accepted-but-invalid and of injections that were accepted all the same."""
    from .metrics import histogram

    counts = histogram(rows, "kind", "exec_status", "error_type", "first_error")
    told = rows.agg(F.count_if("ac_but_invalid").alias("abi"), F.count_if((F.col("kind") == "injected") & (F.col("exec_status") == "AC")).alias("failed"))
    pairs = F.array(F.struct(F.lit("ac_but_invalid").alias("column"), F.lit("true").alias("value"), F.col("abi").alias("n")), F.struct(F.lit("injection").alias("column"), F.lit("accepted").alias("value"), F.col("failed").alias("n")))
    return counts.unionByName(told.select(F.explode(pairs).alias("p")).select("p.*"))
