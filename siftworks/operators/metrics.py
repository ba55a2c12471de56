"""Benchmark metrics: rates, detection, localisation, repair, breakdowns. Ratios are rounded to four places, 0.0 on nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import step_rank, width_bucket_label


def ratio(a: Column, b: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), places), F.lit(0.0))


def solver_rates(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``: accepted, process_valid (booleans)."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        ratio(F.count_if("accepted"), n).alias("pass_at_1"),
        ratio(F.count_if("process_valid"), n).alias("process_valid_rate"),
        ratio(F.count_if(F.col("accepted") & F.col("process_valid")), n).alias("dual_correct_rate"),
    )


def refine_at_all(rounds: Column | str, k: int) -> Column:
    """Aggregate: share of all problems repaired in 1 to k rounds; solved at once does not count."""
    r = F.col(rounds) if isinstance(rounds, str) else rounds
    return ratio(F.count_if(r.between(1, k)), F.count("*"))


def refine_at_failed(rounds: Column | str, k: int) -> Column:
    """Aggregate: the same share among problems that first failed; null if none did."""
    r = F.col(rounds) if isinstance(rounds, str) else rounds
    failed = F.count_if(r.isNull() | (r > 0))
    return F.round(F.try_divide(F.count_if(r.between(1, k)), failed), 4)


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; F1 from the unrounded ones."""
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return F.round(p, 4), F.round(r, 4), F.round(f, 4)


def detection(rows: DataFrame, *keys: str, compat: bool = False) -> DataFrame:
    """Confusion counts and rates. ``rows``: labelled_invalid (null: unlabelled), flagged.

    Strict: unlabelled rows count nowhere. Compat: they are not in ``n`` but count as not
    invalid among false positives and true negatives.
    """
    bad, flag = F.col("labelled_invalid"), F.col("flagged")
    good = ~F.coalesce(bad, F.lit(False)) if compat else ~bad
    out = rows.groupBy(*keys).agg(
        F.count("labelled_invalid").alias("n"),
        F.count_if(bad & flag).alias("tp"),
        F.count_if(good & flag).alias("fp"),
        F.count_if(bad & ~flag).alias("fn"),
        F.count_if(good & ~flag).alias("tn"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": f, "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def first_error_match(predicted: Column | str, labelled: Column | str) -> tuple[Column, Column]:
    """Exact, and within one step; false where either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (predicted, labelled))
    known = a.isNotNull() & b.isNotNull()
    return F.coalesce(known & (a == b), F.lit(False)), F.coalesce(known & (F.abs(step_rank(a) - step_rank(b)) <= 1), F.lit(False))


def localisation(rows: DataFrame, *keys: str) -> DataFrame:
    """Rates over rows with a labelled step, and of the type over rows with a labelled type."""
    exact, near = first_error_match("predicted_step", "labelled_step")
    n = F.count("labelled_step")
    typed = F.coalesce(F.col("labelled_type"), F.lit("")).isin("", "NONE")
    return rows.groupBy(*keys).agg(
        n.alias("n_steps"),
        ratio(F.count_if(exact), n).alias("first_error_exact"),
        ratio(F.count_if(near), n).alias("first_error_within_1"),
        ratio(F.count_if(~typed & (F.col("predicted_type") == F.col("labelled_type"))), F.count_if(~typed)).alias("error_type_accuracy"),
    )


def macro_f1(confusion: DataFrame) -> DataFrame:
    """Mean of the classes' rounded F1. ``confusion``: labelled, predicted, n. A class on neither side does not exist."""
    hit = F.when(F.col("labelled") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = confusion.select(F.explode(F.array(F.struct(F.col("labelled").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("s")).select("s.*")
    by = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    f1 = prf(F.col("tp"), F.col("called") - F.col("tp"), F.col("support") - F.col("tp"))[2]
    return by.agg(F.coalesce(F.round(F.avg(f1), 4), F.lit(0.0)).alias("macro_f1"))


def accepted_but_invalid(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``: abi_label, flagged, label_valid, label_accepted."""
    tp, fn = F.count_if(F.col("abi_label") & F.col("flagged")), F.count_if(F.col("abi_label") & ~F.col("flagged"))
    fp = F.count_if(F.col("label_valid") & F.col("flagged") & F.col("label_accepted"))
    out = rows.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r, _ = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"abi_precision": p, "abi_recall": r})


def difficulty_breakdown(rows: DataFrame, difficulty: str, width: int = 400) -> DataFrame:
    """Rates of each bucket; ``rows`` as for ``solver_rates``."""
    n = F.count("*")
    return (
        rows.groupBy(width_bucket_label(difficulty, width).alias("bucket"))
        .agg(
            n.alias("n"),
            ratio(F.count_if("accepted"), n).alias("pass_rate"),
            ratio(F.count_if("process_valid"), n).alias("valid_rate"),
            ratio(F.count_if(F.col("accepted") & F.col("process_valid")), n).alias("full_correct_rate"),
        )
    )


def tag_breakdown(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """Of each tag: rows, pass rate and counts of error types other than NONE, as a map."""
    each = rows.select(F.explode(tags).alias("tag"), "accepted", "error_type")
    typed = each.groupBy("tag", "error_type").agg(F.count("*").alias("n"), F.count_if("accepted").alias("passed"))
    keep = F.col("error_type").isNotNull() & (F.col("error_type") != "NONE")
    entry = F.when(keep, F.struct("error_type", "n"))
    out = typed.groupBy("tag").agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("error_types"))
    return out.withColumn("pass_rate", ratio(F.col("passed"), F.col("n"))).drop("passed")


def experiment(rows: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Of each strategy: problems, accepted share, refine@k among initially failed ones, mean rounds, tokens; null on nothing.

    ``rows``: strategy, solved_round (0: at once, null: never), tokens.
    """
    r = F.col("solved_round")
    return rows.groupBy("strategy").agg(
        F.count("*").alias("n"),
        F.round(F.try_divide(F.count("solved_round"), F.count("*")), 4).alias("accepted_rate"),
        *(refine_at_failed(r, k).alias(f"refine_at_{k}") for k in ks),
        F.round(F.avg(F.when(r > 0, r)), 2).alias("mean_rounds"),
        F.sum("tokens").alias("tokens"),
    )


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of all values, also those that do not occur."""
    known = rows.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` string")
    return known.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def other_than(rows: DataFrame, column: str, default: str, row_id: str) -> DataFrame:
    """The ids of rows whose value is not the default, one a row: their number grows with the input."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != default)).select(column, row_id)


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n) of several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def ablation(build, configs: dict[str, dict[str, bool]]) -> DataFrame:
    """The same plan under several sets of switches, united with a ``config`` column."""
    out = None
    for name, switches in configs.items():
        one = build(**switches).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
