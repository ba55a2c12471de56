"""Content sort against plain makings: SQL, hot texts over many ranges, odd rows."""

from __future__ import annotations

import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siftworks.llm import exact_dedup

DATA = "/root/testdata/sf0.01"
COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
SCHEMA = "doc_id long, text string, _norm string, _range int, kept string, group_size string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = sorted((i for i in ids if i is not None), reverse=True)
        ordered = known + [None] * (len(ids) - len(known))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ordered[0], len(ids), k == 0, sha) for k, i in enumerate(ordered)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "n", 1, "k", "g") for i, t in rows], SCHEMA).repartition(5)
    return sorted((tuple(r[c] for c in COLUMNS) for r in exact_dedup.exact_copies(docs, **more).collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = duckdb.sql(exact_dedup.OP11_SQL)
    got = exact_dedup.op11_content_sort(spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_hot_texts_over_ranges(spark, ranges):
    draw = random.Random(ranges)
    shared = "The same opening of many texts, longer than what a splitter holds of one. "
    rows = [(i, "hot TEXT" if i % 3 == 0 else shared + str(draw.randrange(150)) if i % 3 == 1 else f"Own {draw.randrange(400)}") for i in range(900)]
    rows += [(None, "Hot text"), (None, "hot text"), (3, "HOT text"), (3, "hot text"), (5000, "own 5000")]
    assert found(spark, rows, ranges=ranges) == plain(rows)


def test_one_row_repeated(spark):
    """Nothing but the row's number tells these apart; they still go to several ranges."""
    rows = [(7, "Again and again")] * 300 + [(None, None)] * 300 + [(8, "")]
    assert found(spark, rows, ranges=9) == plain(rows)


def test_odd_texts(spark):
    texts = [None, "", " ", "ÀÉ", "àé", "İ", "i̇", "ſ", "K", "k", "K", "x" * 300_000, "X" * 300_000, "a\x00b", "A\x00B", "日本語A", "日本語a", "line\nLine", "\x00", "\x00\x00"]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert found(spark, rows, ranges=6) == plain(rows)
    assert found(spark, [], ranges=6) == []


def test_plan_moves_texts_once_and_stays_native(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text"))
    rows = docs.select("doc_id", exact_dedup.normalised(F.col("text")).alias("_norm"), F.monotonically_increasing_id().alias("_row"))
    splitters = exact_dedup._splitters(rows, 8)
    assert len(splitters) == 7 and splitters == sorted(splitters)
    sizes = [r["count"] for r in rows.groupBy(exact_dedup._place(exact_dedup._key("_norm", "_row"), splitters).alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    plan = exact_dedup.exact_copies(docs, ranges=8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, None, "z"), (4, "", None), (None, "b", "n")], "doc_id long, text string, kept string")
    assert sorted(map(str, exact_dedup.without_copies(docs).collect())) == sorted(["Row(doc_id=2, text='a', kept='y')", "Row(doc_id=4, text='', kept=None)", "Row(doc_id=None, text='b', kept='n')"])
