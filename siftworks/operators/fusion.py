"""Fusion of ranked evidence and step verdicts into a first-error decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STEPS, step_rank, stripped

# ---- Fixed values: weight of each kind of evidence, the error of an absent step, words that justify a logarithm. ----
PRIORITY = {"counterexample": 5, "rule": 4, "sandbox": 4, "reference": 3, "consistency": 3, "semantic": 2}
ABSENT_STEP_ERROR = {"S1": "E1", "S2": "E8", "S3": "E2", "S4": "E3", "S5": "E5", "S6": "E4", "S7": "E7"}
LOG_WORDS = ("二分", "堆", "排序", "分治", "sort", "heap", "binary", "divide", "log")
LANGUAGES = ("python", "cpp")
EVIDENCE = "candidate string, kind string, strength int, step_id string, error_type string, indicates_invalid boolean, pos int"


def priority(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in PRIORITY.items() for x in p)), kind), F.lit(0))


def structural_evidence(steps: Column, language: Column, code: Column) -> Column:
    """Array of evidence rows of the structure rules: absent steps, no complexity, no code, a doubtful logarithm."""
    text = lambda s: F.coalesce(F.try_element_at(steps, F.lit(s)), F.lit(""))
    row = lambda when, step, error, strength=4, invalid=True: F.when(when, F.struct(F.lit("rule").alias("kind"), F.lit(strength).alias("strength"), F.lit(step).alias("step_id"), F.lit(error).alias("error_type"), F.lit(invalid).alias("indicates_invalid")))
    s5, source = text("S5"), F.coalesce(code, F.lit(""))
    short = F.length(stripped(source)) < 20
    named = stripped(s5) != ""
    big_o = s5.rlike(r"O\s*\(")
    claimed = F.array_join(F.regexp_extract_all(s5, F.lit(r"O\s*\(([^)]*)\)"), F.lit(1)), " ")
    loops = F.size(F.regexp_extract_all(source, F.lit(r"\bfor\s+|while\s+"), F.lit(0)))
    s3 = F.lower(text("S3"))
    justified = F.greatest(*(s3.contains(w) for w in LOG_WORDS))
    return F.array_compact(
        F.array(
            *(row(F.length(stripped(text(s))) < 10, s, ABSENT_STEP_ERROR[s]) for s in STEPS),
            row(named & ~big_o, "S5", "E5"),
            row(short, "S7", "E7"),
            row(~short & ~F.coalesce(language.isin(*LANGUAGES), F.lit(False)), "S7", "E7"),
            row(named & big_o & claimed.contains("log") & (loops >= 2) & ~justified, "S5", "E5", 2, False),
        )
    )


def sandbox_evidence(status: Column) -> Column:
    """One evidence row where the execution was not accepted; null otherwise."""
    error = F.when(status.isin("TLE", "MLE"), "E5").otherwise("E7")
    return F.when(status.isNotNull() & (status != "AC"), F.struct(F.lit("sandbox").alias("kind"), F.lit(4).alias("strength"), F.lit("S7").alias("step_id"), error.alias("error_type"), F.lit(True).alias("indicates_invalid")))


def consistency_evidence(consistent: Column, severe: Column) -> Column:
    """One row of strength 3 or 2 for a text that contradicts its code."""
    return F.when(~consistent, F.struct(F.lit("consistency").alias("kind"), F.when(severe, 3).otherwise(2).alias("strength"), F.lit("S7").alias("step_id"), F.lit("E6").alias("error_type"), F.lit(True).alias("indicates_invalid")))


def counterexample_evidence(ran_clean: Column, equal: Column, by_reference: Column, step: Column, error: Column) -> Column:
    """Confirmed only if the candidate ran and differs from the truth; 5 by a reference run, 3 by a model, else weak."""
    confirmed = ran_clean & ~equal
    strength = F.when(confirmed, F.when(by_reference, 5).otherwise(3)).otherwise(2)
    return F.struct(F.lit("counterexample").alias("kind"), strength.alias("strength"), step.alias("step_id"), error.alias("error_type"), confirmed.alias("indicates_invalid"))


def definite(status: Column, confidence: Column, least: float = 0.6) -> Column:
    """Whether a fine verdict takes the place of a scan verdict."""
    return status.isin("correct", "incorrect") & (confidence >= least)


def merged_verdicts(scan: DataFrame, fine: DataFrame, least: float = 0.6) -> DataFrame:
    """Scan verdicts, replaced where a fine verdict is definite and confident enough. Both: candidate, step_id, status, confidence, error_type."""
    f = fine.select("candidate", "step_id", *(F.col(c).alias(f"_{c}") for c in ("status", "confidence", "error_type")))
    use = definite(F.col("_status"), F.col("_confidence"), least)
    joined = scan.join(f, ["candidate", "step_id"], "left")
    return joined.select("candidate", "step_id", *(F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("status", "confidence", "error_type")))


def neighbours(rows: DataFrame, key: str, step: str, reach: int = 1, count: int = len(STEPS)) -> DataFrame:
    """Each step number (from 0) and those within reach of it, distinct, inside the range."""
    around = F.sequence(F.greatest(F.col(step) - reach, F.lit(0)), F.least(F.col(step) + reach, F.lit(count - 1)))
    return rows.where(F.col(step).between(0, count - 1)).select(key, F.explode(around).alias(step)).distinct()


def _against(evidence: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    """What speaks against candidates, failed runs too, as items to be decided on; ``more`` columns come along."""
    sand = runs.where("e is not null").select("candidate", "e.*", F.lit(1 << 62).alias("pos"), *more)
    columns = ["candidate", "kind", "strength", "step_id", "error_type", "indicates_invalid", "pos", *more]
    every = evidence.withColumn("pos", F.col("pos").cast("long")).select(*columns).unionByName(sand.select(*columns)).where("indicates_invalid")
    return every.select("candidate", "step_id", "error_type", F.lit(0).alias("semantic"), (-priority(F.col("kind"))).alias("p"), (-F.col("strength")).alias("s"), "pos", "strength", F.lit(None).cast("double").alias("ok"), *more)


def _steps(verdicts: DataFrame, *more: str) -> DataFrame:
    return verdicts.select(
        "candidate", F.when(F.col("status") == "incorrect", F.col("step_id")).alias("step_id"), "error_type", F.lit(1).alias("semantic"), F.lit(0).alias("p"), F.lit(0).alias("s"), F.lit(0).cast("long").alias("pos"),
        F.lit(None).cast("int").alias("strength"), F.when(F.col("status") == "correct", F.col("confidence")).alias("ok"), *more,
    )


def _found(on: Column) -> Column:
    """The aggregate of a candidate's items that are ``on``: the earliest step first, on one step evidence before verdicts, then
    priority, strength and order."""
    placed = on & F.col("step_id").isNotNull()
    return F.struct(
        F.min_by(F.when(placed, F.struct("step_id", "error_type")), F.when(placed, F.struct(step_rank("step_id"), "semantic", "p", "s", "pos"))).alias("first"),
        F.max(F.when(on, F.col("strength"))).alias("strength"),
        F.count_if(placed & (F.col("semantic") == 1)).alias("n_incorrect"),
        F.count_if(on & (F.col("semantic") == 0)).alias("n_against"),
        F.avg(F.when(on, F.col("ok"))).alias("ok"),
    )


def _decision(found: Column, status: Column) -> list[Column]:
    """The columns of a decision from an aggregate, null where a candidate has no items."""
    against, step = F.coalesce(found["n_against"], F.lit(0)) > 0, found["first"]["step_id"]
    invalid = against | (F.coalesce(found["n_incorrect"], F.lit(0)) > 0)
    kind = F.when(F.coalesce(found["first"]["error_type"], F.lit("NONE")) != "NONE", found["first"]["error_type"]).when(step == "S7", "E7").when(step.isNotNull(), "E8").otherwise("NONE")
    sure = F.when(against, 0.5 + 0.1 * found["strength"]).otherwise(F.coalesce(found["ok"], F.lit(0.5)))
    return [
        status.alias("exec_status"),
        (~invalid).alias("process_valid"),
        step.alias("first_error_step"),
        F.when(invalid, kind).otherwise("NONE").alias("error_type"),
        F.round(F.least(sure, F.lit(1.0)), 2).alias("confidence"),
    ]


def fuse(evidence: DataFrame, verdicts: DataFrame, executions: DataFrame) -> DataFrame:
    """One decision for each candidate of ``executions`` (candidate, status; null status: not run).

    ``evidence``: candidate, kind, strength, step_id, error_type, indicates_invalid, pos.
    ``verdicts``: candidate, step_id, status, confidence, error_type. Evidence against the
    candidate and incorrect steps are united and aggregated by candidate: the earliest
    step wins; on one step evidence before verdicts, then priority, strength and order.
    """
    ran = executions.select("candidate", F.col("status").alias("exec_status"), sandbox_evidence(F.col("status")).alias("e"))
    found = _against(evidence, ran).unionByName(_steps(verdicts)).groupBy("candidate").agg(_found(F.lit(True)).alias("found"))
    return ran.drop("e").join(found, "candidate", "left").select("candidate", *_decision(F.col("found"), F.col("exec_status")))


SWITCHES = ("rules", "semantic", "fine", "consistency", "counterexample", "execution")


def ablate(evidence: DataFrame, verdicts: DataFrame, executions: DataFrame, configs: dict[str, dict[str, bool]]) -> DataFrame:
    """The decision on each candidate under each of several sets of ``SWITCHES`` (on unless false), in one pass.

    ``evidence``: as for ``fuse``, with the ``layer`` of each row (rules, consistency, counterexample).
    ``verdicts``: candidate, step_id, and structs ``scan`` and ``fine`` of status, confidence and error_type, ``fine`` null
    where there is none. Rows of either that are ``hard`` (optional) count only with the rules left out; of a hard verdict
    that is its fine one. Every item carries a bit for each configuration that it survives in, so layers are read and shuffled
    once, and one aggregation by candidate decides for all configurations.
    """
    names = list(configs)
    bits = lambda *wanted: sum(1 << i for i, n in enumerate(names) if all(configs[n].get(k, True) == on for k, on in wanted))
    mask = lambda *wanted: F.lit(bits(*wanted)).cast("long")
    hard = lambda rows: F.coalesce("hard", F.lit(False)) if "hard" in rows.columns else F.lit(False)
    soft_mask = lambda rows, *wanted: F.when(hard(rows), mask(*wanted, ("rules", False))).otherwise(mask(*wanted))
    of_layer = F.coalesce(*(F.when(F.col("layer") == k, soft_mask(evidence, (k, True))) for k in ("rules", "consistency", "counterexample")), F.lit(0).cast("long"))
    ran = executions.select("candidate", "status", sandbox_evidence(F.col("status")).alias("e"), mask(("execution", True)).alias("mask"))
    items = _against(evidence.withColumn("mask", of_layer), ran, "mask")
    use = F.coalesce(definite(F.col("fine.status"), F.col("fine.confidence")), F.lit(False))
    verdict = lambda which, m: F.struct(F.col(f"{which}.status").alias("status"), F.col(f"{which}.confidence").alias("confidence"), F.col(f"{which}.error_type").alias("error_type"), m.alias("mask"))
    closely, all_of = soft_mask(verdicts, ("semantic", True), ("fine", True)), mask(("semantic", True))
    both = F.when(use, F.array(verdict("fine", closely), verdict("scan", all_of.bitwiseXOR(closely)))).otherwise(F.array(verdict("scan", all_of)))
    steps = verdicts.select("candidate", "step_id", F.explode(both).alias("v")).select("candidate", "step_id", "v.*")
    on = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    every = items.unionByName(_steps(steps, "mask")).where("mask <> 0")
    found = every.groupBy("candidate").agg(*(_found(on(i)).alias(f"c{i}") for i in range(len(names))))
    status = lambda n: F.col("status") if configs[n].get("execution", True) else F.lit(None).cast("string")
    each = F.array(*(F.struct(F.lit(n).alias("config"), *_decision(F.col(f"c{i}"), status(n))) for i, n in enumerate(names)))
    return ran.drop("e", "mask").join(found, "candidate", "left").select("candidate", F.explode(each).alias("d")).select("candidate", "d.*")


def quadrant(accepted: Column, process_valid: Column, wrong_before_code: Column) -> Column:
    """Outcome by process; a failed run counts as an implementation error only if no step before the code is wrong."""
    return (
        F.when(accepted & process_valid, "full_correct")
        .when(accepted & ~process_valid, "ac_but_invalid")
        .when(~accepted & ~wrong_before_code, "implementation_error")
        .otherwise("reasoning_error")
    )


def budget(repairs: Column, conflict: Column, low_confidence: Column, rating: Column, phase: Column, threshold: int = 2000) -> Column:
    high = (repairs > 0) | conflict | low_confidence | F.coalesce(rating >= threshold, F.lit(False)) | (phase == "solve")
    return F.when(high, "HIGH").otherwise("LOW")


def layered(structural: DataFrame, scan: DataFrame, fine: DataFrame, consistency: DataFrame, counterexample: DataFrame, executions: DataFrame, /, **switches: bool) -> DataFrame:
    """Fusion with layers switched on and off; a layer that is off brings no rows.

    Switches: ``rules``, ``semantic``, ``fine``, ``consistency``, ``counterexample``, ``execution``; all on by default.
    """
    on = {k: switches.get(k, True) for k in SWITCHES}
    evidence = structural.where(F.lit(on["rules"]))
    for name, rows in (("consistency", consistency), ("counterexample", counterexample)):
        evidence = evidence.unionByName(rows.where(F.lit(on[name])))
    steps = merged_verdicts(scan, fine.where(F.lit(on["fine"]))).where(F.lit(on["semantic"]))
    runs = executions if on["execution"] else executions.withColumn("status", F.lit(None).cast("string"))
    return fuse(evidence, steps, runs)
