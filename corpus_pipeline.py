"""A corpus pipeline of five stages, each on what the one before it kept.

Quality classification, near-deduplication, decontamination and secret redaction return
the columns of ``documents``; packing returns the pieces of the training sequences. Rows
of a null text are rejected by the first stage if the classifier rejects the empty text;
repeated rows leave one; every other case is defined by the operator of the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm import decontaminate, near_dedup, packing, quality_model, secret_scan
from siftworks.llm.common import discard, shared_path, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MARK = "[secret]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    kept = quality_model.score(docs.select(*COLUMNS), model, COLUMNS)
    return kept.where(F.col("score") >= quality_model.CUT).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of least doc_id."""
    return near_dedup.deduplicated(docs.select(*COLUMNS), COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where("n_hit = 0").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and the length counted anew."""
    clean = secret_scan.scan(docs.select(*COLUMNS), tuple(c for c in COLUMNS if c != "text"), redact=MARK)
    text = F.col("clean_text")
    return clean.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each stage's result is written to the shared folder and read again; it is removed
    when the next one is there. Packing keeps what it needs itself before it returns."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            discard(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, before)
    return packed


#: No SQL: classifier, signatures and packing can't be expressed there; tests hold the stages against brute force.
ORACLE_SQL = None
