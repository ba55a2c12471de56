"""The corpus pipeline over a small copy of the driver's tables, stage by stage."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from siftworks.llm import decontaminate, secret_scan
from siftworks.llm.common import table, written
from siftworks.llm.queries import ORACLE_SQL, QUERIES

from llm_plain import jaccard, shingle_set

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    bench = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    block = decontaminate.Block([(str(i), decontaminate.words_of(t)) for i, t in bench])
    block.order_by_rarity({})
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, DATA), name)
        after = docs.collect()
        if i < 4:
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
            assert {r["doc_id"] for r in after} <= set(before)
        if name == "near_dedup":
            sets = [shingle_set(r["text"]) for r in after]
            assert all(jaccard(sets[a], sets[b]) < 0.8 for a in range(len(sets)) for b in range(a) if sets[a] and sets[b])
        if name == "decontamination":
            hit = {d for d, t in before.items() if t and (w := decontaminate.words_of(t)) and len(block.occurrences(block.numbers(w))[0])}
            assert {r["doc_id"] for r in after} == set(before) - hit
        if name == "secret_scan":
            assert {r["doc_id"] for r in after} == set(before)
            assert all(not secret_scan.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in after if r["text"])
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in after} == set(before)


ODD = [None, "", " ", "!!!", "x" * 30_000, "word " * 2_000, "secret=abcdef12 " * 3, "a\x00b\n\n", "é中文😀"]


def test_odd_documents(spark, tmp_path):
    """Null and repeated ids and texts, long and empty ones, and columns whose names the operators use inside."""
    good = [r for r in table(spark, DATA, "documents").limit(60).collect()]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "h", 0.5, "x") for r in good]
    rows += [(10_000 + i, t, None, None, None, 1, "h", 0.5, "x") for i, t in enumerate(ODD)]
    rows += [(None, good[0]["text"] + " more", "en", "s", 1, 1, "h", 0.5, "x"), (None, None, None, None, None, None, None, None, None), rows[0], rows[0], (rows[1][0], *rows[2][1:])]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, node int, h1 string, score double, _row string"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, DATA, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() <= before or i == 4
        if i < 4:
            assert tuple(sorted(docs.columns)) == tuple(sorted(corpus_pipeline.COLUMNS))
        if name == "near_dedup":
            assert docs.where(docs.doc_id == rows[0][0]).count() <= 1
    assert docs.count() > 20 and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    spark.createDataFrame([], ddl).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, DATA, name).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    given = table(spark, DATA, {"op2": "pages", "op12": "embeddings", "op13": "conversations"}.get(name.split("_")[0], "documents"))
    # A row for each row of the table, at least; of conversations a node for the end of each different one.
    assert got.count() >= (given.select("conv_id").distinct() if name.startswith("op13_") else given).count()
