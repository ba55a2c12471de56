"""Set differences, base-row comparisons, label overlays and domain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STEPS

STATUSES = ("correct", "incorrect", "suspicious", "downstream", "unverifiable")


def stale(present: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Entities that are present but no longer selected."""
    return present.join(keep.select(key), key, "left_anti")


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return wanted.join(found.select(key), key, "left_anti")


def changed_steps(base: Column, other: Column) -> Column:
    """Steps whose text differs, in order."""
    return F.filter(F.array(*map(F.lit, STEPS)), lambda s: ~F.try_element_at(base, s).eqNullSafe(F.try_element_at(other, s)))


def against_base(variants: DataFrame, base_name: str = "correct") -> DataFrame:
    """Violations of each variant against its problem's base row: prefix, first change, number of changes, code.

    ``variants``: pid, name, kind, steps (map), code, first_error. Only injected and
    ac_invalid variants are held against the base.
    """
    base = variants.where(F.col("name") == base_name).select("pid", F.col("steps").alias("_steps"), F.col("code").alias("_code"))
    rows = variants.where(F.col("kind").isin("injected", "ac_invalid")).join(base, "pid")
    diff = changed_steps(F.col("_steps"), F.col("steps"))
    found = F.array_compact(
        F.array(
            F.when(F.size(diff) == 0, "nothing_changed"),
            F.when(F.get(diff, F.lit(0)) < F.col("first_error"), "prefix_changed"),
            F.when(F.get(diff, F.lit(0)) > F.col("first_error"), "label_not_changed"),
            F.when((F.col("kind") == "ac_invalid") & (F.size(diff) != 1), "more_than_one_changed"),
            F.when((F.col("kind") == "ac_invalid") & ~F.col("code").eqNullSafe(F.col("_code")), "code_changed"),
        )
    )
    return rows.select("pid", "name", F.explode(found).alias("violation"))


def overlay(own: Column, external: Column) -> Column:
    """Map of both, the external one over the own; a key with a null value in it still wins."""
    o = F.coalesce(own, F.create_map().cast("map<string,string>"))
    e = F.coalesce(external, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.array_contains(F.map_keys(e), k)), e)


def derived_labels(valid: Column, status: Column) -> Column:
    """Accepted although invalid; false where validity is unknown."""
    return F.coalesce(~valid & (status == "AC"), F.lit(False))


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all checks, and the others with the names of what they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def domain_checks() -> dict[str, Column]:
    return {"step_id": F.col("step_id").isin(*STEPS), "status": F.col("status").isin(*STATUSES), "strength": F.col("strength").between(1, 5)}


def padded_steps(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """A verdict for each of the seven steps of each candidate; absent ones are unverifiable with confidence 0."""
    every = candidates.select("candidate", F.explode(F.array(*map(F.lit, STEPS))).alias("step_id"))
    out = every.join(verdicts, ["candidate", "step_id"], "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("unverifiable")), "confidence": F.coalesce("confidence", F.lit(0.0)), "error_type": F.coalesce("error_type", F.lit("NONE"))})
