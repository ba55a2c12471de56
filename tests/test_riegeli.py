"""Record files: every split size, the stored index, the sink and its commit."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftworks.sources import riegeli, stores

NAME = "part_train.riegeli-00007-of-99999"


def made(seed=3):
    draw = random.Random(seed)
    rows = [draw.randbytes(draw.choice([0, 1, 40, 900, 5000])) for _ in range(500)]
    return rows + [draw.randbytes(riegeli.STEP - 200), draw.randbytes(3 * riegeli.BLOCK + 17), *[b""] * 70_000, draw.randbytes(100)]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    (folder / NAME).write_bytes(b"".join(riegeli.file_parts(iter(made()), 0x7A, 20_000)))
    (folder / "part_test.riegeli").write_bytes(b"".join(riegeli.file_parts(iter(made(4)), 0, 7_000)))
    (folder / "part_valid.riegeli").write_bytes(b"".join(riegeli.file_parts(iter([]))))
    return str(folder)


def test_ranges_have_every_chunk_once(place):
    for name in os.listdir(place):
        data = open(os.path.join(place, name), "rb").read()
        read = lambda a, b, data=data: data[a:b]
        whole = list(riegeli.chunks(read, len(data)))
        for step in (1, 2, 3, 7, 50):
            step *= riegeli.BLOCK
            assert [c for at in range(0, len(data), step) for c in riegeli.chunks(read, len(data), at, at + step)] == whole
        assert [r for c in whole if c.kind == "simple" for r in riegeli.records(riegeli.body(read, c.begin, c.size), c.records)] == (made() if "train" in name else made(4) if "test" in name else [])


@pytest.mark.parametrize("blocks", [1, 4, 1000])
def test_scan_at_split_sizes(spark, place, blocks):
    got = riegeli.scan_records(spark, place, range_bytes=blocks * riegeli.BLOCK).collect()
    for split, shard, want in (("train", 7, made()), ("test", 0, made(4))):
        mine = sorted((r["record_index"], bytes(r["raw"])) for r in got if r["split"] == split and r["shard"] == shard)
        assert mine == list(enumerate(want))
    assert {r["split"] for r in got} == {"train", "test"}


def test_large_files_are_many_tasks(tmp_path):
    path = tmp_path / "big_train.riegeli"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 5)  # takes no disk
    parts = riegeli.RiegeliReader({"path": str(tmp_path), "pathglobfilter": "*.riegeli*"}).partitions()
    assert len(parts) == -(-((2 << 30) + 5) // riegeli.RANGE_BYTES) and parts[-1].end == (2 << 30) + 5
    assert all(a.end == b.begin for a, b in zip(parts, parts[1:], strict=False))


def test_lookup_reads_wanted_chunks_only(spark, place, tmp_path):
    riegeli.chunk_index(spark, place).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    want = [0, 3, 499, 500, 70_501]
    ids = spark.createDataFrame([("train", 7, i) for i in want] + [("train", 7, 10**9), ("test", 1, 0)], "split string, shard int, record_index int")
    taken = spark.sparkContext.accumulator(0)
    found = riegeli.scan_records(spark, place, ids=ids, index=index, taken=taken)
    assert {r["record_index"]: bytes(r["raw"]) for r in found.collect()} == {i: made()[i] for i in want}
    held = index.where("split = 'train' AND (0 BETWEEN first_record AND first_record + records - 1 OR 3 BETWEEN first_record AND first_record + records - 1 OR 499 BETWEEN first_record AND first_record + records - 1"
                       " OR 500 BETWEEN first_record AND first_record + records - 1 OR 70501 BETWEEN first_record AND first_record + records - 1)")  # fmt: skip
    size, n = held.agg(F.sum("size"), F.count("*")).first()
    # Block headers inside a chunk come along: 24 bytes in 65,536.
    assert size <= taken.value <= size * 1.001 + 24 * n
    assert taken.value < os.path.getsize(os.path.join(place, NAME)) / 2
    assert sorted(riegeli.missing_ids(ids, found)) == [("test", 1, 0), ("train", 7, 10**9)]


def test_lookup_beside_transposed_chunks(spark, tmp_path):
    """A transposed chunk has no records here; the next chunk's first record has the number that its own would have had."""
    parts = list(riegeli.file_parts(iter([b"a", b"b", b"c"]), 0, 1))  # a chunk each, all in the first block
    odd = bytearray(parts[2])
    odd[24] = 0x74
    (tmp_path / "t_train.riegeli").write_bytes(parts[0] + parts[1] + bytes(odd) + parts[3])
    ids = spark.createDataFrame([("train", 0, 0), ("train", 0, 1)], "split string, shard int, record_index int")
    for index in (None, riegeli.chunk_index(spark, str(tmp_path))):
        found = riegeli.scan_records(spark, str(tmp_path), ids=ids, index=index).collect()
        assert {r["record_index"]: bytes(r["raw"]) for r in found} == {0: b"a", 1: b"c"}
    with pytest.raises(Exception, match="transposed"):
        riegeli.scan_records(spark, str(tmp_path), skip_transposed=False).collect()


def test_ranges_that_do_not_meet(spark, tmp_path):
    data = bytearray(b"".join(riegeli.file_parts(iter(made()), 0, 30_000)))
    at = 2 * riegeli.BLOCK
    data[at + 16 : at + 24] = (int.from_bytes(data[at + 16 : at + 24], "little") + 64).to_bytes(8, "little")
    (tmp_path / "x_train.riegeli").write_bytes(data)
    found = riegeli.file_profile(riegeli.scan_chunks(spark, str(tmp_path), range_bytes=riegeli.BLOCK)).first()
    assert found["error"]
    with pytest.raises(Exception, match="chunk|packing|varint|unpacked"):
        riegeli.scan_records(spark, str(tmp_path), range_bytes=riegeli.BLOCK).collect()


def test_sink(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 3).cast("int").alias("shard"), F.col("id").alias("ord"), F.concat(F.lit("r"), F.col("id").cast("string")).cast("binary").alias("raw")
    )
    out = str(tmp_path / "out")
    riegeli.write_records(rows, out, name="x", chunk_bytes=500)
    assert sorted(os.listdir(out)) == sorted(f"x_{s}.riegeli-0000{i}-of-99999" for s in ("test", "train") for i in range(3))
    got = {(r["split"], r["shard"], r["record_index"]): bytes(r["raw"]).decode() for r in riegeli.scan_records(spark, out).collect()}
    want = {}
    for i in range(3000):
        want.setdefault(("test" if i % 5 == 0 else "train", i % 3), []).append(f"r{i}")
    assert got == {(*k, n): r for k, rows in want.items() for n, r in enumerate(rows)}
    profile = riegeli.file_profile(riegeli.scan_chunks(spark, out))
    assert profile.agg(F.sum("records"), F.min("signature_ok"), F.max("error")).first()[:] == (3000, True, None)


def test_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(400).select(F.lit("train").alias("split"), (F.col("id") % 4).cast("int").alias("shard"), F.col("id").alias("ord"), F.when(F.col("id") == 399, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("binary").alias("raw"))
    with pytest.raises(Exception, match="stop"):
        riegeli.write_records(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_stores(tmp_path):
    assert stores.known("/a/b") and stores.known("file:/a/b") and not stores.known("viewfs://store/in")
    staging = stores.Staging(f"file://{tmp_path}/root").begun()
    files = [staging.put("p/one.txt", [b"1", b"2"]), staging.put("two.txt", [b"3"])]
    staging.put("lost.txt", [b"a task that ran twice"])
    staging.publish(files)
    assert (tmp_path / "root/p/one.txt").read_bytes() == b"12" and sorted(os.listdir(tmp_path / "root")) == ["p", "two.txt"]


def test_files_appear_together(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("/a.txt")).alias("name"), F.concat(F.lit("text é "), F.col("id").cast("string")).alias("text"))
    root = tmp_path / "tree"
    stores.write_files(rows, str(root))
    stores.write_files(rows.limit(3).withColumn("text", F.lit("new")), str(root))
    assert len(os.listdir(root)) == 60 and (root / "p7/a.txt").read_text() == "text é 7" and not [x for x in os.listdir(root) if x.startswith("_")]
    assert sum((root / f"p{i}/a.txt").read_text() == "new" for i in range(60)) == 3
    broken = rows.withColumn("text", F.when(F.col("name") == "p59/a.txt", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        stores.write_files(broken, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or os.listdir(tmp_path / "none") == []


def test_unknown_store_makes_no_local_folder(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rows = spark.createDataFrame([("a/b.txt", "x")], "name string, text string")
    with pytest.raises(Exception):  # noqa: B017  whichever of Spark and Arrow refuses it first
        stores.write_files(rows, "nostore://bucket/tree")
    with pytest.raises(pa.ArrowInvalid):
        stores.at("nostore://bucket/tree")
    assert os.listdir(tmp_path) == []
