"""Batches of messages against the reading of one message at a time."""

from __future__ import annotations

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from siftworks.sources import messages, wire
from siftworks.sources.riegeli import FormatError, number


def field(n, kind, value):
    body = number(value) if kind == 0 else struct.pack("<f", value) if kind == 5 else struct.pack("<d", value) if kind == 1 else number(len(value)) + value
    return number(n << 3 | kind) + body


def random_message(draw):
    text = lambda: draw.choice([b"", b"abc", "é日😀".encode(), b"\xff\xfe bad", draw.randbytes(draw.randrange(300))])
    case = lambda: b"".join(field(draw.choice([1, 2, 9]), 2, text()) for _ in range(draw.randrange(4)))
    code = lambda: field(1, 0, draw.randrange(6)) + field(2, 2, text())
    limit = lambda: field(1, 0, draw.randrange(10)) + field(2, 0, draw.randrange(10**9))
    makers = [
        lambda: field(1, 2, text()), lambda: field(2, 2, text()), lambda: field(draw.choice([4, 5, 18]), 2, case()), lambda: field(6, 0, draw.randrange(9)), lambda: field(8, 2, code()), lambda: field(19, 2, code()),
        lambda: field(10, 0, draw.choice([0, 127, 128, 2**31, 2**63, 2**64 - 5])), lambda: field(13, 5, draw.random()), lambda: field(14, 0, draw.randrange(4000)), lambda: field(15, 2, text()), lambda: field(20, 0, draw.randrange(3)),
        lambda: field(29, 2, limit()), lambda: field(99, 1, 1.5), lambda: field(1, 0, 5), lambda: field(6, 2, b"another wire type"), lambda: field(31, 2, text()),
    ]
    return b"".join(draw.choice(makers)() for _ in range(draw.randrange(40)))


def damaged(draw, data):
    data = bytearray(data)
    if data and draw.random() < 0.5:
        data[draw.randrange(len(data))] = draw.choice([0, 3, 4, 0x80, 0xFF])
    return bytes(data[: draw.randrange(len(data) + 1)])


@pytest.mark.parametrize("keep", [False, True])
def test_batches_equal_single_messages(spark, keep):
    draw = random.Random(9)
    raw = [random_message(draw) for _ in range(300)]
    raw += [damaged(draw, r) for r in raw] + [b"", b"\x00", b"\x08", b"\x0b", b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01", b"\xff" * 12, b"\x0d\x00"]
    frame = spark.createDataFrame([("train", 0, i, bytearray(r)) for i, r in enumerate(raw)], "split string, shard int, record_index int, raw binary").repartition(3)
    got = {r["record_index"]: r.asDict(True) for r in messages.decode_problems(frame, keep).collect()}
    wrong = 0
    for i, r in enumerate(raw):
        mine = got[i]
        error = mine.pop("decode_error")
        for k in ("split", "shard", "record_index"):
            mine.pop(k)
        try:
            want = messages.problem(r, keep)
        except FormatError as e:
            wrong += 1
            assert error == str(e) and set(mine.values()) == {None}
            continue
        assert error is None
        want = {k: want.get(k) for k in mine}
        if want["cf_points"] is not None:
            assert mine.pop("cf_points") == pytest.approx(want.pop("cf_points"))
        assert mine == want
    assert wrong > 100


def test_varints():
    numbers = [0, 1, 127, 128, 300, 2**14, 2**32, 2**63, 2**64 - 1]
    data = b"".join(map(number, numbers))
    at = np.cumsum([0, *(len(number(n)) for n in numbers)])[:-1]
    value, after, good = wire.varints(np.frombuffer(data, np.uint8), at, np.full(len(at), len(data)))
    assert value.tolist() == numbers and good.all() and after.tolist() == [*at[1:].tolist(), len(data)]
    _, _, good = wire.varints(np.frombuffer(b"\x80" * 20, np.uint8), np.array([0, 15]), np.array([20, 20]))
    assert not good.any()


def test_slices_and_nulls():
    batch = pa.RecordBatch.from_pydict({"raw": pa.array([b"x" * 10, None, b"", b"y" * 30, b"z"], pa.binary())})
    parts = list(wire.slices(batch, "raw", 12))
    assert [p.num_rows for p in parts] == [3, 1, 1]
    m = wire.spans(batch.column("raw").slice(1, 3))
    assert (m.end - m.begin).tolist() == [0, 0, 30]
    assert list(wire.slices(batch.slice(0, 0), "raw")) == []
