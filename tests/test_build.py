"""The whole build on small record files: pool, labels, sample, verification, directories, manifest and prune."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from test_sources import chunk, field, shard, simple

from siftworks.config import settings
from siftworks.operators import external
from siftworks.plans import build
from siftworks.sources import dataset_dirs, riegeli

ADD = "a, b = map(int, input().split())\nprint(a + b)\n"


def case(given, want):
    return field(1, 2, given.encode()) + field(2, 2, want.encode())


def problem(name, solutions, n=25, want=lambda a, b: str(a + b), index="A", rating=800, tag="math"):
    tests = b"".join(field(4 if i < 2 else 18, 2, case(f"{i} {i + 1}\n", want(i, i + 1))) for i in range(n))
    codes = b"".join(field(8, 2, field(1, 0, 3) + field(2, 2, s.encode())) for s in solutions)
    return field(1, 2, name.encode()) + field(2, 2, b"add two numbers") + tests + field(6, 0, 2) + codes + field(10, 0, 7) + field(12, 2, index.encode()) + field(14, 0, rating) + field(15, 2, tag.encode()) + field(29, 2, field(1, 0, 5))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("records")
    good = problem("p1 Sum", ["print(0)  # short\n", ADD + "# longer\n"])
    close = problem("Ratio", ["a, b = map(int, input().split())\nprint(a / b)\n"], want=lambda a, b: f"{a / b:.8f}", index="B", rating=1300, tag="greedy")
    wrong = problem("Wrong", ["print(1)\n"], index="C", tag="dp")
    old = problem("Old", ["print raw_input()\n"], index="D", tag="dp")
    few = problem("Few", [ADD], n=3, index="E")
    (root / "code_contests_train.riegeli-00000-of-00002").write_bytes(shard([simple([good, close]), chunk(0x70, 0, b"p")]))
    (root / "code_contests_train.riegeli-00001-of-00002").write_bytes(shard([simple([wrong, old])]))
    (root / "code_contests_test.riegeli-00000-of-00001").write_bytes(shard([simple([few])]))
    return root


def test_shards(spark, folder):
    listed = [(r["split"], r["shard"]) for r in riegeli.shards(spark, str(folder)).orderBy("ord").collect()]
    assert listed == [("train", 0), ("train", 1), ("test", 0)]
    assert [(r["split"], r["shard"]) for r in riegeli.shards(spark, str(folder), train_shards=1).orderBy("ord").collect()] == [("train", 0), ("test", 0)]
    assert riegeli.scan_records(spark, str(folder), train_shards=1).count() == 3
    # Files without a wanted record are not read: one of them would fail.
    (folder / "code_contests_valid.riegeli-00000-of-00001").write_bytes(b"no record file" * 9)
    ids = spark.createDataFrame([("train", 1, 1)], "split string, shard int, record_index int")
    assert riegeli.scan_records(spark, str(folder), ids=ids).count() == 1
    assert riegeli.scan_records(spark, str(folder), ids=ids.limit(0)).count() == 0
    (folder / "code_contests_valid.riegeli-00000-of-00001").unlink()


def test_build(spark, folder, tmp_path):
    labels = [("https://codeforces.com/problemset/problem/7/A", "Sum", "CODEFORCES", "EASY", "['Mathematics']", "[]", None, None)]
    spark.createDataFrame(labels, "url string, name string, source string, difficulty string, tags string, skill_types string, time_limit string, memory_limit string").write.parquet(str(tmp_path / "labels"))
    work = build.Build(spark, str(folder), str(tmp_path / "labels"), str(tmp_path / "work"), settings({"sampling": {"target": 5, "max_per_category_share": 1.0}}, {}), 2.0)
    with pytest.raises(FileNotFoundError, match="run stage pool first"):
        work.enriched()
    pool = {r["name"]: r for r in work.pool().collect()}
    assert len(pool) == 5 and pool["Few"]["reject_reasons"] == ["too_few_tests"] and pool["p1 Sum"]["passed"]
    rows = {r["name"]: r for r in work.enriched().collect()}
    assert len(rows) == 4 and rows["p1 Sum"]["taco_match"] == "key" and rows["Ratio"]["taco_match"] == "none"
    assert work.sampled().count() == 4
    passed, rejects = work.verified(external.local_program())
    got = {r["name"]: (r["comparison"], r["attempt"], r["cases_total"]) for r in passed.collect()}
    assert got == {"p1 Sum": ("token", 1, 25), "Ratio": ("float", 0, 25)}
    assert {r["name"]: (r["reasons"], r["tried"], r["suspected"]) for r in rejects.collect()} == {"Wrong": (["WA"], 1, True), "Old": ([], 0, False)}  # nothing was tried
    public, private = tmp_path / "public", tmp_path / "private"
    (public / "stale").mkdir(parents=True)
    made = work.written(str(public), str(private))
    assert made["stale"] == ["stale"] and (public / "stale").is_dir()
    told = json.loads((public / "manifest.json").read_text())
    assert told["totals"][0]["problems"] == 2 and told["totals"][0]["cases"] == 50 and {r["comparison"]: r["n"] for r in told["modes"]} == {"token": 1, "exact": 0, "float": 1}
    assert told["impact"][0]["with_tags"] == 1
    pid = pool["p1 Sum"]["cc_id"]
    assert sorted(os.listdir(public / pid)) == ["meta.json", "problem.md", "reference.py", "tests.json"] and os.listdir(private / pid) == ["verification.json"]
    meta = json.loads((public / pid / "meta.json").read_text())
    assert meta["tests"]["total"] == 25 and meta["reference"]["verified"] and meta["difficulty"] == 800 and meta["tests"]["by_origin"]["public"] == 2
    # Stages lie bucketed: they are joined without an exchange, also where a session has not written them itself.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for table in spark.catalog.listTables():
        if table.name.startswith("stage_"):
            spark.sql(f"DROP TABLE {table.name}")
    for one, other in (("sample", "results"), ("enrich", "drawn"), ("verify", "records"), ("verify", "drawn")):
        both = work._of(one).join(work._of(other), "cc_id")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString(), (one, other)
        both.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    before = work._versions("sample")
    (tmp_path / f"work/sample/v{before[-1] + 1}").mkdir()  # a write that did not end is passed over
    assert work._versions("sample") == before and work._of("sample").count() == 4
    assert work.counts("pool")["records"] == 5 and told["pool"]["passed"] == 4 and told["match"].items() >= {"rows": 4, "key": 1, "none": 3, "labelled": 1}.items()
    read = dataset_dirs.bundles(spark, str(public), 128).where(F.col("pid") == pid).first()
    assert read["memory_mb"] == 128 and len(read["cases"]) == 25 and read["cases"][0]["input"] == "0 1\n" and read["reference"].startswith("a, b")
    assert work.written(str(public), str(private), prune=True)["stale"] == [] and not (public / "stale").exists()


def test_manifest_refuses_large_tables(spark):
    with pytest.raises(ValueError, match="no small aggregate"):
        dataset_dirs.manifest({}, most=10, rows=spark.range(11))
