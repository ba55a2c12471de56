from __future__ import annotations

import json
import random
import struct

import pytest
import zstandard

from siftworks.sources import dataset_dirs, messages, riegeli, stores


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def field(number, kind, value):
    body = varint(value) if kind == 0 else struct.pack("<f", value) if kind == 5 else varint(len(value)) + value
    return varint(number << 3 | kind) + body


def chunk(kind, n, body):
    return b"\0" * 8 + len(body).to_bytes(8, "little") + b"\0" * 8 + bytes([kind]) + n.to_bytes(7, "little") + len(body).to_bytes(8, "little") + body


def simple(records, packing=0):
    sizes, values = b"".join(varint(len(r)) for r in records), b"".join(records)
    if packing == 0x7A:
        pack = lambda b: varint(len(b)) + zstandard.compress(b)
        sizes, values = pack(sizes), pack(values)
    return chunk(0x72, len(records), bytes([packing]) + varint(len(sizes)) + sizes + values)


def shard(chunks):
    """A file: the stream of chunks, with a block header before every 65512 bytes; the first is the signature."""
    stream = b"".join([b"", *chunks])
    step = riegeli.BLOCK - riegeli.BLOCK_HEADER
    signature = riegeli.SIGNATURE
    stream = signature[24:] + stream
    return b"".join((signature[:24] if at == 0 else b"\x11" * 24) + stream[at : at + step] for at in range(0, len(stream), step))


def test_scan(spark, tmp_path):
    draw = random.Random(5)
    first = [draw.randbytes(n) for n in (65512 - 40 - 40 - 60, 3, 0)]  # the next chunk's header straddles a block
    rest = [draw.randbytes(draw.randint(0, 3000)) for _ in range(120)]
    data = shard([simple(first), chunk(0x70, 0, b"p" * 10), simple(rest[:60], 0x7A), chunk(0x74, 5, b"t"), simple(rest[60:])])
    (tmp_path / "code_contests_train.riegeli-00003-of-00128").write_bytes(data)
    (tmp_path / "code_contests_test.riegeli").write_bytes(shard([simple([b"only"])]))
    got = riegeli.scan_records(spark, str(tmp_path)).collect()
    train = [bytes(r["raw"]) for r in sorted(got, key=lambda r: r["record_index"]) if r["split"] == "train"]
    assert train == first + rest and {r["shard"] for r in got if r["split"] == "train"} == {3}
    assert [bytes(r["raw"]) for r in got if r["split"] == "test"] == [b"only"]
    ids = spark.createDataFrame([("train", 3, 70), ("train", 3, 1), ("train", 3, 9999)], "split string, shard int, record_index int")
    some = riegeli.scan_records(spark, str(tmp_path), ids=ids)
    assert {r["record_index"]: bytes(r["raw"]) for r in some.collect()} == {1: first[1], 70: train[70]}
    assert riegeli.missing_ids(ids, some) == [("train", 3, 9999)]
    profile = {r["path"].rsplit("/", 1)[1]: r for r in riegeli.file_profile(riegeli.scan_chunks(spark, str(tmp_path))).collect()}
    r = profile["code_contests_train.riegeli-00003-of-00128"]
    assert r["signature_ok"] and (r["simple"], r["padding"], r["transposed"], r["file_signature"]) == (3, 1, 1, 1) and r["error"] is None
    (tmp_path / "code_contests_valid.riegeli").write_bytes(data[:70000])
    broken = riegeli.file_profile(riegeli.scan_chunks(spark, str(tmp_path), "*valid*")).first()
    assert "after its file" in broken["error"]


def test_decode(spark):
    test = field(1, 2, b"1 2\n") + field(2, 2, b"3\n")
    good = (
        field(1, 2, "Añ".encode()) + field(2, 2, b"text \xff") + field(4, 2, test) + field(6, 0, 2) + field(7, 0, 9) + field(8, 2, field(1, 0, 3) + field(2, 2, b"code")) + field(19, 2, b"") * 3
        + field(10, 0, 77) + field(12, 2, b"B") + field(13, 5, 1.5) + field(15, 2, b"dp") + field(15, 2, b"math") + field(29, 2, field(1, 0, 2) + field(2, 0, 500000000)) + field(99, 0, 1)
    )
    rows = [("train", 0, 0, good), ("train", 0, 1, b"\x0a\xff"), ("train", 0, 2, b"")]
    raw = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "split string, shard int, record_index int, raw binary")
    got = messages.with_names(messages.decode_problems(raw)).orderBy("record_index").collect()
    a, b, c = got
    assert (a["name"], a["description"], a["source_name"], a["difficulty_name"], a["n_incorrect_solutions"]) == ("Añ", "text �", "CODEFORCES", "C", 3)
    assert a["public_tests"][0]["output"] == "3\n" and a["cf_tags"] == ["dp", "math"] and a["time_limit_seconds"] == 2.5 and a["solutions"][0]["language"] == 3
    assert b["decode_error"] and b["name"] is None
    assert c["decode_error"] is None and c["name"] == "" and c["public_tests"] == [] and c["time_limit_seconds"] is None
    hist = {r["number"]: r for r in messages.field_histogram(raw).collect()}
    assert hist[15]["n"] == 2 and hist[15]["samples"] == ["dp", "math"] and hist[13]["wire_types"] == [5]


@pytest.fixture
def tree(tmp_path):
    public, private = tmp_path / "public", tmp_path / "private"
    for root in (public, private):
        (root / "p1").mkdir(parents=True)
    (public / "manifest.json").write_text("{}")
    (public / "p1/problem.md").write_text("# Sum\nadd")
    (public / "p1/meta.json").write_text(json.dumps({"difficulty": 800, "tags": ["math"], "comparison": "exact", "memory_limit_bytes": 268435456}))
    (public / "p1/tests.json").write_text(json.dumps([{"input": "1 2", "expected": "3"}, {"input": "4"}]))
    (public / "p1/reference.py").write_text("print(3)")
    (public / "p2").mkdir()
    (public / "p1/variants.json").write_text(json.dumps([{"name": "correct", "language": "py", "code": "c", "steps": {"S1": "x"}}]))
    (private / "p1/variants.json").write_text(json.dumps([{"name": "inj", "code": "d", "steps": {}, "label": {"kind": "injected", "first_error": "S2"}}]))
    (private / "p1/labels.json").write_text(json.dumps({"pid": "p1", "labels": {"correct": {"kind": "correct", "process_valid": True, "exec_status": "AC"}, "inj": {"process_valid": False, "exec_status": "AC", "first_error": None}}}))
    return public, private


def test_directories(spark, tree):
    public, private = map(str, tree)
    rows = dataset_dirs.problems(spark, public).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["id"], r["comparison"], r["memory_limit_mb"], r["reference_language"], r["tags"]) == ("p1", "token", 256, "python", ["math"])
    cases = dataset_dirs.test_cases(spark, public).orderBy("ord").collect()
    assert [(c["input"], c["expected"]) for c in cases] == [("1 2", "3"), ("4", "")]
    alone = dataset_dirs.variants(spark, public).collect()
    assert [(v["name"], v["kind"], v["process_valid"]) for v in alone] == [("correct", None, None)]
    both = {v["name"]: v for v in dataset_dirs.variants(spark, public, private).collect()}
    assert both["correct"]["process_valid"] is True and both["correct"]["language"] == "python"
    assert both["inj"]["kind"] == "injected" and both["inj"]["first_error"] is None and both["inj"]["ac_but_invalid"] is True


def test_bundles_keep_labels_private(spark, tree, tmp_path):
    rows = dataset_dirs.variants(spark, *map(str, tree))
    dataset_dirs.write_bundles(rows, str(tmp_path / "o"), str(tmp_path / "s"))
    shown = spark.read.json(str(tmp_path / "o/variants"))
    assert not {"kind", "process_valid", "first_error", "error_type", "exec_status"} & set(shown.columns)
    assert [r["name"] for r in shown.collect()] == ["correct"]
    assert spark.read.json(str(tmp_path / "s/labels")).count() == 2


def test_directories_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """Trees in parts: the driver lists no file, and directories of one name in two parts are two problems."""
    root = tmp_path / "tree"
    files = [(f"{part}/p{i}/{name}", text) for part in (0, 1) for i in range(5) for name, text in (("problem.md", f"{part} {i}"), ("tests.json", json.dumps([{"input": f"{part}"}])), ("meta.json", json.dumps({"difficulty": part * 10 + i})))]
    stores.write_files(spark.createDataFrame([*files, ("0/_hidden/problem.md", "no"), ("0/.h/problem.md", "no"), ("1/p0/tests/problem.txt", "no"), ("1/bare/meta.json", "{}")], "name string, text string"), str(root))
    assert sorted(x.name for x in root.iterdir()) == ["0", "1"]
    want = sorted((f"p{i}", f"{part} {i}", part * 10 + i, None) for part in (0, 1) for i in range(5))
    listed = lambda: dataset_dirs.problems(spark, str(root)).select("pid", "statement", "difficulty", "reference")
    assert listed().inputFiles() == [] and dataset_dirs.test_cases(spark, str(root)).inputFiles() == []
    assert sorted(map(tuple, listed().collect())) == want and dataset_dirs.test_cases(spark, str(root)).count() == 10
    with pytest.raises(FileNotFoundError):
        dataset_dirs.problems(spark, str(tmp_path / "none"))
    monkeypatch.setattr(stores, "known", lambda _: False)  # a store that only Spark opens
    assert sorted(map(tuple, listed().collect())) == want
    monkeypatch.undo()
    stores.remove_files(spark, str(root))
    assert not root.exists()


def test_cases_of_every_form(spark, tmp_path, monkeypatch):
    """Where there is no tests.json the cases are numbered text files, up to their first gap; in any store, and below parts of the tree."""
    root = tmp_path / "tree"
    series = lambda pid, first, second, *numbers: [(f"{pid}/tests/{name.format(n)}", f"{side}{n}\n") for n in numbers for side, name in (("i", first), ("o", second))]
    files = [
        ("a/tests.json", json.dumps([{"input": "x"}, {"expected": "y"}])), *series("a", "input{}.txt", "expected{}.txt", 1), ("b/problem.md", "b"), *series("b", "input{}.txt", "expected{}.txt", *range(1, 13), 14), *series("b", "{}.in", "{}.out", 1),
        *series("7/c", "{}.in", "{}.out", 1, 2, 4), *series("7/c", "input{}.txt", "expected{}.txt", 2), ("7/d/tests/input1.txt", "1\r\n2\r3\n"), ("7/d/tests/expected1.txt", ""), ("7/d/tests/expected2.txt", "o"), *series("e", "input{}.txt", "expected{}.txt", 2),
        ("f/tests.json", "[]"), *series("f", "input{}.txt", "expected{}.txt", 1), ("g/tests/input01.txt", "no"), ("g/tests/input0.txt", "no"), *series("_h", "input{}.txt", "expected{}.txt", 1),
    ]
    stores.write_files(spark.createDataFrame(files, "name string, text string"), str(root))
    want = [("a", 0, "x", ""), ("a", 1, "", "y"), *(("b", n - 1, f"i{n}\n", f"o{n}\n") for n in range(1, 13)), ("c", 0, "i1\n", "o1\n"), ("c", 1, "i2\n", "o2\n"), ("d", 0, "1\n2\n3\n", "")]
    read = lambda at: sorted(map(tuple, dataset_dirs.test_cases(spark, str(at)).collect()))
    assert read(root) == want
    assert read(root / "b") == want[2:14]  # a single problem
    monkeypatch.setattr(stores, "known", lambda _: False)  # a store that only Spark opens
    assert read(root) == want and read(root / "b") == want[2:14]


@pytest.mark.parametrize("known", [True, False])
def test_cases_are_never_dropped(spark, tmp_path, monkeypatch, known):
    """A case of any length is read; what can't be read is an error, not a problem without cases."""
    if not known:
        monkeypatch.setattr(stores, "known", lambda _: False)
    for name, text in {"long/p/tests.json": json.dumps([{"input": "x" * 20_000_001}, {"input": "y"}]), "torn/p/tests.json": '[{"input": "a"}, {"inp', "empty/p/tests.json": "", "lost/p/tests/input1.txt": "a"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True)
        path.write_text(text)
    assert sorted((r["ord"], len(r["input"])) for r in dataset_dirs.test_cases(spark, str(tmp_path / "long")).collect()) == [(0, 20_000_001), (1, 1)]
    for name, said in {"torn": "MALFORMED_RECORD_IN_PARSING", "empty": "p has a tests.json without an array", "lost": "p lacks the expected output of case 1"}.items():
        with pytest.raises(Exception, match=said):
            dataset_dirs.test_cases(spark, str(tmp_path / name)).collect()


def test_moves_are_repeated(tmp_path):
    """A task that moves files and runs again finds them moved; a file that was never there is an error."""
    staging = stores.Staging(str(tmp_path / "tree")).begun()
    files = [staging.put(f"p{i}/a.txt", [b"x"]) for i in range(3)]
    assert staging.move(files[:2]) == 2 and staging.move(files) == 3
    assert all((tmp_path / f"tree/p{i}/a.txt").read_bytes() == b"x" for i in range(3))
    with pytest.raises(OSError):
        staging.move([(f"{files[0][0]}-none", "p9/a.txt")])


def test_solutions(spark):
    full = json.dumps({"problem_id": "p", "steps": [{"step_id": "s01", "title": "", "content": "a"}, {"step_id": "S1", "content": "b"}, {"step_id": "zz", "content": "c"}], "code": {"language": "c++", "code": "int main"}})
    short = json.dumps({"S1": "x", "S7": "y", "code": "print(1)"})
    got = [r for r in dataset_dirs.solutions(spark.createDataFrame([(0, full), (1, short)], "i int, text string")).orderBy("i").collect()]
    assert (got[0]["steps"], got[0]["code"], got[0]["language"]) == ({"S1": "b"}, "int main", "cpp")
    assert (got[1]["steps"], got[1]["code"], got[1]["language"]) == ({"S1": "x", "S7": "y"}, "print(1)", "python")


def test_pool_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, None), ("b", False, ["x"])], "cc_id string, passed boolean, reject_reasons array<string>")
    dataset_dirs.write_pool(rows, str(tmp_path / "pool"))
    assert dataset_dirs.read_pool(spark, str(tmp_path / "pool"), "cc_id string, passed boolean, reject_reasons array<string>", True).collect()[0]["cc_id"] == "a"


def test_numbered_cases(spark, tmp_path):
    tests = tmp_path / "p/tests"
    tests.mkdir(parents=True)
    for n in (1, 2, 4):
        (tests / f"{n}.in").write_text(f"i{n}")
        (tests / f"{n}.out").write_text(f"o{n}")
    got = dataset_dirs.numbered_cases(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["ord"], r["input"]) for r in got] == [(0, "i1"), (1, "i2")]
