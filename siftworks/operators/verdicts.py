"""Roll-ups of per-case results to one verdict for each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- Fixed values: severities of the simple judge. ----
SEVERITY = ("WA", "RE", "TLE")


def case_status(timed_out: Column, over_memory: Column, exit_code: Column, equal: Column) -> Column:
    """One case: time before memory before exit code before the comparison."""
    return F.when(timed_out, "TLE").when(over_memory, "MLE").when(exit_code != 0, "RE").when(equal, "AC").otherwise("WA")


def first_failure(results: DataFrame, keys: list[str], order: str, status: str = "status", abort: bool = False) -> DataFrame:
    """passed, total, status of the first case that is not accepted, and its place (null if all are).

    With ``abort`` only cases up to the first failure count as results; the total stays.
    """
    bad = F.col(status) != "AC"
    out = results.groupBy(*keys).agg(
        F.count_if(~bad).alias("_passed"),
        F.count("*").alias("total"),
        F.min(F.when(bad, F.col(order))).alias("failed_index"),
        F.min_by(F.when(bad, F.col(status)), F.when(bad, F.col(order))).alias("_status"),
    )
    out = out.withColumn("status", F.coalesce("_status", F.lit("AC")))
    if abort:
        upto = results.join(out.select(*keys, "failed_index"), keys).where(F.col("failed_index").isNull() | (F.col(order) <= F.col("failed_index")))
        kept = upto.groupBy(*keys).agg(F.count("*").alias("n_results"), F.count_if(F.col(status) == "AC").alias("passed"))
        return out.drop("_passed", "_status").join(kept, keys)
    return out.select(*keys, F.col("_passed").alias("passed"), "total", "status", "failed_index", F.col("total").alias("n_results"))


def without_cases(candidates: DataFrame, rolled: DataFrame, keys: list[str]) -> DataFrame:
    """All candidates; one without any case is a system error."""
    joined = candidates.join(rolled, keys, "left")
    return joined.withColumns({"status": F.coalesce("status", F.lit("SE")), "passed": F.coalesce("passed", F.lit(0)), "total": F.coalesce("total", F.lit(0))})


def worst(results: DataFrame, keys: list[str], status: str = "status", severity: tuple[str, ...] = SEVERITY) -> DataFrame:
    """passed, total and the worst status; AC where none of the severities occurs."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, severity)), F.col(status)), F.lit(0)), F.lit(0))
    out = results.groupBy(*keys).agg(F.count_if(F.col(status) == "AC").alias("passed"), F.count("*").alias("total"), F.max(rank).alias("_rank"))
    return out.withColumn("status", F.coalesce(F.get(F.array(*map(F.lit, severity)), (F.col("_rank") - 1).cast("int")), F.lit("AC"))).drop("_rank")


def two_stage(results: DataFrame, keys: list[str], order: str, probe: int = 3, most_failures: int = 5, totals: DataFrame | None = None) -> DataFrame:
    """Verification in two stages: the first cases must all pass before the rest count, which stop at the first failure.

    ``results``: keys, order, status, time_ms. Adds verdict, passed, ran, skipped,
    max_ms, total_ms and up to ``most_failures`` failures in order. Where results have only the cases that ran
    (``external.run_programs`` in waves), ``totals`` (keys, cases_total) tells how many there are.
    """
    bad = F.col("status") != "AC"
    firsts = results.groupBy(*keys).agg(
        F.count("*").alias("cases_total"),
        F.min(F.when(bad, F.col(order))).alias("_first"),
        F.max(F.when(F.col(order) < probe, bad)).alias("_probe_failed"),
    )
    if totals is not None:
        firsts = firsts.drop("cases_total").join(totals.select(*keys, "cases_total"), keys)
    # All probe cases run; after them nothing runs past the first failure.
    last = F.when(F.col("_probe_failed"), F.lit(probe - 1)).otherwise(F.col("_first"))
    ran = results.join(firsts.select(*keys, last.alias("_last")), keys).where(F.col("_last").isNull() | (F.col(order) <= F.col("_last")))
    summed = ran.groupBy(*keys).agg(F.count("*").alias("cases_run"), F.count_if(~bad).alias("cases_passed"), F.max("time_ms").alias("max_ms"), F.sum("time_ms").alias("total_ms"))
    # Failures are ranked first, so that no list grows beyond those that are kept.
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "status"))
    failed = ran.where(bad).withColumn("_n", nth).where(F.col("_n") <= most_failures)
    kept = failed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("index"), F.col("status").alias("verdict")))).alias("failures"))
    out = firsts.join(summed, keys).join(kept, keys, "left")
    out = out.withColumn("failures", F.coalesce("failures", F.array().cast(kept.schema["failures"].dataType)))
    verdict = F.coalesce(F.get("failures", F.lit(0))["verdict"], F.lit("AC"))
    return out.withColumns({"verdict": verdict, "ok": verdict == "AC", "skipped": F.col("cases_total") - F.col("cases_run")}).drop("_first", "_probe_failed")


def effective_limit(own: Column, default: float, cap: float) -> Column:
    """The problem's limit or the default, at most the cap; 0 counts as none."""
    return F.least(F.coalesce(F.nullif(own, F.lit(0).cast("double")), F.lit(default)), F.lit(cap))


def usage(rows: DataFrame, *keys: str) -> DataFrame:
    """Tokens and calls as plain sums of columns; accumulators would count retried tasks twice."""
    return rows.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.count("*").alias("calls"))
