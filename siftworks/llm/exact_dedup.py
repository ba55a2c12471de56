"""Exact duplicates by sorting the texts themselves, with DataFrame functions only.

A sample of the rows, weighed by bytes, gives splitters; they deal the normalised
texts over ranges of nearly equal bytes, each range is sorted (Spark's external sort),
and every text is compared in full with its neighbour. A splitter holds a bounded
prefix of a text, a hash of all of it, and the number of a row. So the rows of a text that
a third of the table repeats are dealt over as many ranges as their bytes ask for. Only
such texts can lie in two ranges; their runs, one for each range, are brought
together by full text, and everything else is settled where it was sorted.

Texts travel once, to the sort; after the comparison a row is its id, its digest and
the number of its run.

Defined results: a null text counts as empty; texts are equal when they are
identical after lower-casing A-Z; the row of the largest id stays, a null id being less
than all others; of repeated rows (same id and equal text) exactly one stays; an empty
table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: Bytes of a text that a splitter holds, and of its hash and a row's number after that.
PREFIX, HASH, ROW = 48, 8, 8
CONTENT, KEY = PREFIX + HASH, PREFIX + HASH + ROW
#: Sampled rows for each range, as expected; they only balance the ranges.
SAMPLED = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case. Texts of one-byte characters take the function that works on bytes."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _bytes(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _key(norm: str, row: str) -> Column:
    """Order of the ranges: prefix, hash and row number, of ``KEY`` bytes."""
    prefix = F.rpad(F.substring(F.col(norm).cast("binary"), 1, PREFIX), PREFIX, F.lit(bytes(1)))
    return F.concat(prefix, _bytes(F.xxhash64(norm)), _bytes(F.col(row)))


def _splitters(rows: DataFrame, ranges: int) -> list[bytes]:
    """Keys that cut the rows into ``ranges`` of nearly equal bytes; at most ``ranges - 1``."""
    wanted, n = SAMPLED * ranges, rows.count()
    if not n:
        return []
    found = rows.sample(min(1.0, wanted / n), 11).select(_key("_norm", "_row").alias("key"), (F.octet_length("_norm") + 64).alias("weight"))
    sample = sorted((bytes(r["key"]), r["weight"]) for r in found.collect())
    total, held, out = sum(w for _, w in sample), 0, []
    for key, weight in sample:
        if held * ranges >= total * (len(out) + 1):
            out.append(key)
        held += weight
    return out[: ranges - 1]


def _place(key: Column, splitters: list[bytes]) -> Column:
    """How many splitters are at most ``key``: first among every ``step``-th, then among those between."""
    if not splitters:
        return F.lit(0)
    whole, step = F.lit(b"".join(splitters)), int(len(splitters) ** 0.5) + 1
    at = lambda i: F.substr(whole, i * KEY + 1, F.lit(KEY))
    coarse = F.size(F.filter(F.sequence(F.lit(0), F.lit((len(splitters) - 1) // step)), lambda i: at(i * step) <= key))
    low = F.greatest(coarse - 1, F.lit(0)) * step
    fine = F.sequence(low, F.least(low + step, F.lit(len(splitters))) - 1)
    return low + F.size(F.filter(fine, lambda i: at(i) <= key))


def _shared(key: Column, place: Column, splitters: list[bytes]) -> Column:
    """Whether the row's text may lie in two ranges: a splitter beside its range has its content."""
    if not splitters:
        return F.lit(False)
    whole, content = F.lit(b"".join(splitters)), F.substring(key, 1, CONTENT)
    below = F.substr(whole, F.greatest(place - 1, F.lit(0)) * KEY + 1, F.lit(CONTENT))
    above = F.substr(whole, place * KEY + 1, F.lit(CONTENT))
    return (content == below) | (content == above)


def exact_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``ranges`` is the session's number of shuffle partitions by default.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text)).alias("_norm"), F.monotonically_increasing_id().alias("_row"))
    splitters = _splitters(rows, ranges)
    dealt = (
        rows.withColumn("_key", _key("_norm", "_row"))
        .withColumn("_range", _place(F.col("_key"), splitters))
        .select("doc_id", "_norm", "_row", "_range", _shared(F.col("_key"), F.col("_range"), splitters).alias("_shared"))
        .repartitionById(ranges, "_range")
    )
    by_text = Window.partitionBy("_range").orderBy("_norm", F.col("doc_id").desc_nulls_last(), "_row")
    head = ~F.lag("_norm").over(by_text).eqNullSafe(F.col("_norm"))
    compared = dealt.select("*", head.alias("_head"), F.row_number().over(by_text).alias("_at")).select(
        "doc_id", "_range", "_at", "_shared", "_head", F.sha2("_norm", 256).alias("text_sha256"), F.when(F.col("_head") & F.col("_shared"), F.col("_norm")).alias("_text")
    )
    so_far = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_run = Window.partitionBy("_range", "_run")
    runs = cut(
        compared.withColumn("_run", F.sum(F.col("_head").cast("long")).over(so_far)).select(
            "doc_id", "_range", "_run", "_shared", "_head", "text_sha256", "_text", F.max("doc_id").over(in_run).alias("_best"), F.count(F.lit(1)).over(in_run).alias("_n")
        )
    )
    # At most two contents of a range are shared, so this has two rows for each range, of a few numbers each.
    best = F.struct("_best", (-F.col("_range")).alias("r"), (-F.col("_run")).alias("u"))
    groups = runs.where("_shared AND _head").groupBy("_text").agg(F.sum("_n").alias("_all"), F.max(best).alias("_top"), F.collect_list(F.struct("_range", "_run")).alias("_runs"))
    totals = groups.select("_all", "_top", F.explode("_runs").alias("_of")).select(
        "_of._range", "_of._run", "_all", F.col("_top._best").alias("_keep"), ((F.col("_top.r") == -F.col("_of._range")) & (F.col("_top.u") == -F.col("_of._run"))).alias("_holds")
    )
    return runs.join(F.broadcast(totals), ["_range", "_run"], "left").select(
        "doc_id",
        F.when(F.col("_shared"), F.col("_keep")).otherwise(F.col("_best")).alias("keep_id"),
        F.when(F.col("_shared"), F.col("_all")).otherwise(F.col("_n")).alias("group_size"),
        (F.col("_head") & F.coalesce("_holds", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Ids must be unique here; the decisions go to the ids, not the texts."""
    stays = exact_copies(docs, id_column, text).where("kept").select(F.col("doc_id").alias("_stays"))
    return docs.join(stays, docs[id_column].eqNullSafe(F.col("_stays")), "left_semi")


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
