"""Order-dependent selections; every order is an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def bounded_prefix(rows: DataFrame, keys: list[str], order: list[str], size: Column, most_rows: int, most_size: float) -> DataFrame:
    """Of each group the longest prefix with at most so many rows and so much size; nothing if the first row alone is too large.

    Row numbers and running sums only grow, so a filter keeps exactly the prefix, and
    the row limit is pushed before the exchange.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_rows)
    return ranked.withColumn("running_size", F.sum(size).over(running)).where(F.col("running_size") <= most_size).drop("_n")


def ordered_distinct(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; combines before the exchange."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*")


def select_cases(cases: DataFrame, most: int, field_bytes: int, seed: str = "42") -> DataFrame:
    """Cases of each problem: all fitting public ones in order, then the others by hash, texts already chosen left out.

    ``cases``: pid, origin, ord, input, output. Public cases are not compared with each
    other. Adds ``position`` from 0; at most ``most`` rows a problem.
    """
    fit = cases.where((F.octet_length("input") <= field_bytes) & (F.octet_length("output") <= field_bytes))
    public = F.col("origin") == "public"
    lot = F.md5(F.concat_ws("\x1f", F.lit(seed), "pid", "origin", F.col("ord").cast("string")))
    fit = fit.withColumns({"_rank": F.when(public, 0).otherwise(1), "_lot": F.when(public, F.lit("")).otherwise(lot), "_text": F.sha2(F.concat_ws("\x1e", "input", "output"), 256)})
    order = ["_rank", "_lot", "ord"]
    same = Window.partitionBy("pid", "_text").orderBy(*order)
    fit = fit.withColumn("_seen", F.row_number().over(same)).where(public | (F.col("_seen") == 1))
    w = Window.partitionBy("pid").orderBy(*order)
    return fit.withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < most).drop("_rank", "_lot", "_text", "_seen")


def shortest_first(solutions: DataFrame, key: str, code: str, order: str, most: int) -> DataFrame:
    """The first so many attempts of each problem by code length, then by order."""
    w = Window.partitionBy(key).orderBy(F.length(code), order)
    return solutions.withColumn("attempt", F.row_number().over(w) - 1).where(F.col("attempt") < most)


def first_success(attempts: DataFrame, key: str, ok: Column, order: str, *columns: str) -> DataFrame:
    """Of each problem the first attempt that succeeded."""
    return attempts.where(ok).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def round_robin(rows: DataFrame, order: list[str], per_row: int, values: list[str], name: str = "assigned") -> DataFrame:
    """Each row with ``per_row`` values in turn: number (i * per_row + j) modulo the list.

    Row numbers come from range partitions: each numbers its own rows, offset by the
    counts of those before it, so no task sees all rows. The partition of each row is
    written down first, as another run could draw other ranges.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("_p").orderBy(*order)
    numbered = ranged.withColumn("_i", F.row_number().over(w) - 1).join(F.broadcast(before), "_p")
    numbered = numbered.withColumn("row_index", (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long"))
    literal = F.array(*map(F.lit, values))
    items = F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda j: F.get(literal, F.pmod(F.col("row_index") * per_row + j, F.lit(len(values))).cast("int")))
    return numbered.withColumn(name, F.array_distinct(items)).drop("_p", "_i", "count", "_before")


def first_match(items: Column | str, condition) -> Column:
    """The first array element for which the condition holds; null for none."""
    a = F.col(items) if isinstance(items, str) else items
    return F.get(F.filter(a, condition), F.lit(0))
