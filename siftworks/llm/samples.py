"""Labelled rows for the learners: a bounded sample, chosen by hash alike at every size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold

#: Labelled rows that a learner fits on. The sample is the rows of least hash, so it does not depend on order or layout.
SAMPLE_ROWS = 20_000
#: Folds for out-of-fold scores within the sample.
FOLDS = 5


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``rows`` labelled documents outside the held-out fold.

    Null ids and null labels are left out. Repeated label rows count once if they agree
    and not at all if they contradict each other. Of several documents of one id the
    least text counts (a null one before all others), so the rows have the sample's bound.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(fold("doc_id", parts) != held)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    chosen = cut(chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(FOLDS)).cast("int")))
    # The chosen ids have a fixed bound, so this side may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Repeats of an id are combined before the exchange.
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "label", "fold")).alias("r")).select("doc_id", "r.*")
