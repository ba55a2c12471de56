"""Protocol-buffer wire form of a whole Arrow batch at a time.

All messages of a batch are walked side by side: a step reads the next field of each message that is not at
its end, with numpy over the batch's one buffer. A varint is found by its continuation bits. Fields then are
columns (message, number, wire type, span or value) in the order of the buffer; nested messages are spans of the same buffer
and are walked the same way, and lists are built from counts. Texts are cut out of the buffer by their spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Wire type of a value; everything else has wire type 2.
WIRE = {"int": 0, "bool": 0, "float": 5}
#: Bytes of messages that are walked together, one message at least.
SLICE_BYTES = 8 << 20
UNENDED = "a varint has no end"


@dataclass
class Spans:
    """Messages of a buffer, and the record that each belongs to."""

    buffer: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    record: np.ndarray


@dataclass
class Fields:
    message: np.ndarray
    number: np.ndarray
    kind: np.ndarray
    begin: np.ndarray  # of the value
    end: np.ndarray
    value: np.ndarray  # of a varint

    def chosen(self, rows: np.ndarray) -> Fields:
        return Fields(*(getattr(self, f)[rows] for f in ("message", "number", "kind", "begin", "end", "value")))


class Errors:
    """The first error of each record by its place in the buffer."""

    def __init__(self, records: int):
        self.found: dict[int, tuple[int, str]] = {}
        self.records = records

    def add(self, record: np.ndarray, place: np.ndarray, text: list[str]) -> None:
        for r, p, t in zip(record.tolist(), place.tolist(), text, strict=True):
            if r not in self.found or p < self.found[r][0]:
                self.found[r] = (p, t)

    def texts(self) -> list[str | None]:
        return [self.found[r][1] if r in self.found else None for r in range(self.records)]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    size, begin, total = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, n in enumerate(size):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if batch.num_rows:
        yield batch.slice(begin)


def spans(raw: pa.BinaryArray) -> Spans:
    """Each value of a binary column as a message; a null is empty."""
    raw = raw.cast(pa.binary())
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    end = at[1:].copy()
    if raw.null_count:
        gone = raw.is_null().to_numpy(zero_copy_only=False)
        end[gone] = at[:-1][gone]
    return Spans(held, at[:-1], end, np.arange(len(raw)))


def varints(buffer: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (unsigned), the places after them, and whether they end before ``end`` and within ten bytes."""
    value, after, done = np.zeros(len(at), np.uint64), at.copy(), np.zeros(len(at), bool)
    rest = np.arange(len(at))
    for i in range(10):
        rest = rest[at[rest] + i < end[rest]]
        if not len(rest):
            break
        byte = buffer[at[rest] + i]
        value[rest] |= (byte & 0x7F).astype(np.uint64) << np.uint64(7 * i)
        last = byte < 0x80
        after[rest[last]] = at[rest[last]] + i + 1
        done[rest[last]] = True
        rest = rest[~last]
    return value, after, done


def fields(m: Spans, errors: Errors) -> Fields:
    """All fields of all messages, in the order of the buffer; those before an error are among them."""
    at, rows = m.begin.copy(), []
    active = np.flatnonzero(at < m.end)
    while len(active):
        begin, end = at[active], m.end[active]
        tag, after, good = varints(m.buffer, begin, end)
        text = np.full(len(active), "", object)
        text[~good] = UNENDED
        number, kind = tag >> np.uint64(3), (tag & np.uint64(7)).astype(np.int64)
        text[good & (number == 0)] = "field number 0"
        odd = good & (number > 0) & ~np.isin(kind, (0, 1, 2, 5))
        text[odd] = [f"wire type {k}" for k in kind[odd]]
        good &= (number > 0) & ~odd
        value, stop = np.zeros(len(active), np.uint64), after.copy()
        counted = np.flatnonzero(good & ((kind == 0) | (kind == 2)))
        value[counted], stop[counted], ended = varints(m.buffer, after[counted], end[counted])
        text[counted[~ended]], good[counted[~ended]] = UNENDED, False
        start = np.where(kind == 2, stop, after)
        room = (end - start).astype(np.uint64)
        size = np.where(kind == 2, value, np.where(kind == 1, 8, np.where(kind == 5, 4, 0)).astype(np.uint64))
        over = good & (kind != 0) & (size > room)
        text[over] = [f"field {n} ends after its message" for n in number[over]]
        good &= ~over
        size[~good] = 0
        stop = np.where(kind == 0, stop, start + size.astype(np.int64))
        bad = ~good
        if bad.any():
            errors.add(m.record[active[bad]], begin[bad], text[bad].tolist())
        rows.append(Fields(active[good], number[good].astype(np.int64), kind[good], start[good], stop[good], value[good]))
        at[active] = stop
        active = active[good & (stop < end)]
    if not rows:
        none = np.zeros(0, np.int64)
        return Fields(none, none, none, none, none, none.astype(np.uint64))
    every = Fields(*(np.concatenate([getattr(r, f) for r in rows]) for f in ("message", "number", "kind", "begin", "end", "value")))
    return every.chosen(np.lexsort((every.begin, every.message)))


def cut_out(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """Spans of the buffer as binary values."""
    whole = memoryview(np.ascontiguousarray(buffer)).cast("B") if len(buffer) else memoryview(b"")
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    data = b"".join([whole[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def texts(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """Spans as texts; bytes that are no UTF-8 become replacement characters."""
    found = cut_out(buffer, begin, end)
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in found.to_pylist()], pa.string())


def _values(kind: str | dict, f: Fields, m: Spans, errors: Errors) -> pa.Array:
    if isinstance(kind, dict):
        made = decoded(Spans(m.buffer, f.begin, f.end, m.record[f.message]), kind, errors)
        return pa.StructArray.from_arrays(list(made.values()), names=list(made))
    if kind == "text":
        return texts(m.buffer, f.begin, f.end)
    if kind == "float":
        four = m.buffer[f.begin[:, None] + np.arange(4)] if len(f.begin) else np.zeros((0, 4), np.uint8)
        return pa.array(np.ascontiguousarray(four).view("<f4").reshape(-1), pa.float32())
    if kind == "bool":
        return pa.array(f.value != 0)
    return pa.array(f.value.view(np.int64))  # two's complement, as the wire has it


def decoded(m: Spans, shape: dict, errors: Errors, counted: frozenset[str] = frozenset()) -> dict[str, pa.Array]:
    """A column for each field of ``shape`` (number: name and kind; a list for repeated fields, a table for messages).

    Unknown fields and those of another wire type are passed over; the last of a single field counts, absent
    ones are null, absent lists empty. Repeated fields named in ``counted`` are only counted, as ``n_`` and the name.
    """
    f, n, out = fields(m, errors), len(m.begin), {}
    for number, (name, shape_of) in shape.items():
        many = isinstance(shape_of, list)
        kind = shape_of[0] if many else shape_of
        mine = f.chosen(np.flatnonzero((f.number == number) & (f.kind == WIRE.get(kind if isinstance(kind, str) else "", 2))))
        if name in counted:
            out[f"n_{name}"] = pa.array(np.bincount(mine.message, minlength=n).astype(np.int64))
            continue
        values = _values(kind, mine, m, errors)
        if many:
            offsets = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(mine.message, minlength=n), out=offsets[1:])
            out[name] = pa.ListArray.from_arrays(pa.array(offsets), values)
        else:
            last = np.full(n, -1, np.int64)
            last[mine.message] = np.arange(len(mine.message))  # the last of a message stays
            out[name] = values.take(pa.array(last, mask=last < 0))
    return out
