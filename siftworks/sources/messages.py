"""Problem messages in protocol-buffer wire form, decoded by a table of fields."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import literal_map
from . import wire as batches_of
from .riegeli import FormatError, varint

# ---- Fixed values: enumerations and field numbers of the message. ----
SOURCES = {0: "UNKNOWN_SOURCE", 1: "CODECHEF", 2: "CODEFORCES", 3: "HACKEREARTH", 4: "CODEJAM", 6: "ATCODER", 7: "AIZU"}
DIFFICULTIES = {0: "UNKNOWN_DIFFICULTY", 1: "EASY", 2: "MEDIUM", 3: "HARD", 4: "HARDER", 5: "HARDEST", 6: "EXTERNAL"} | {7 + i: c for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUV")}
LANGUAGES = {0: "UNKNOWN_LANGUAGE", 1: "PYTHON", 2: "CPP", 3: "PYTHON3", 4: "JAVA"}

TEST = {1: ("input", "text"), 2: ("output", "text")}
SOLUTION = {1: ("language", "int"), 2: ("solution", "text")}
DURATION = {1: ("seconds", "int"), 2: ("nanos", "int")}
PROBLEM = {
    1: ("name", "text"), 2: ("description", "text"), 4: ("public_tests", [TEST]), 5: ("private_tests", [TEST]), 6: ("source", "int"), 7: ("difficulty", "int"),
    8: ("solutions", [SOLUTION]), 10: ("cf_contest_id", "int"), 12: ("cf_index", "text"), 13: ("cf_points", "float"), 14: ("cf_rating", "int"), 15: ("cf_tags", ["text"]),
    18: ("generated_tests", [TEST]), 19: ("incorrect_solutions", [SOLUTION]), 20: ("is_description_translated", "bool"), 21: ("untranslated_description", "text"),
    29: ("time_limit", DURATION), 30: ("memory_limit_bytes", "int"), 31: ("input_file", "text"), 32: ("output_file", "text"),
}
WIRE = batches_of.WIRE

CASES = "array<struct<input string, output string>>"
CODES = "array<struct<language long, solution string>>"
SCHEMA = (
    f"name string, description string, public_tests {CASES}, private_tests {CASES}, generated_tests {CASES}, source long, difficulty long, solutions {CODES}, incorrect_solutions {CODES}, "
    "n_incorrect_solutions long, cf_contest_id long, cf_index string, cf_points float, cf_rating long, cf_tags array<string>, is_description_translated boolean, untranslated_description string, "
    "time_limit_seconds double, memory_limit_bytes long, input_file string, output_file string"
)
DEFAULTS = {"name": "", "description": "", "source": 0, "difficulty": 0, "n_incorrect_solutions": 0, "is_description_translated": False, "untranslated_description": "", "input_file": "", "output_file": ""}


def wire(data: bytes) -> Iterator[tuple[int, int, object]]:
    """Field number, wire type and raw value of each field in order."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, kind = divmod(tag, 8)
        if not number:
            raise FormatError("field number 0")
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise FormatError(f"field {number} ends after its message")
            if kind != 2:
                value = struct.unpack("<d" if kind == 1 else "<f", value)[0]
        else:
            raise FormatError(f"wire type {kind}")
        yield number, kind, value


def decoded(data: bytes, fields: dict, counted: frozenset[str] = frozenset()) -> dict:
    """The message as a dict; unknown fields and fields of another wire type are passed over, the last of a single field counts.

    Repeated fields named in ``counted`` are only counted, as ``n_`` and the name.
    """
    out: dict = {}
    for number, kind, value in wire(data):
        if number not in fields:
            continue
        name, shape = fields[number]
        many = isinstance(shape, list)
        one = shape[0] if many else shape
        if kind != WIRE.get(one if isinstance(one, str) else "", 2):
            continue
        if name in counted:
            out[f"n_{name}"] = out.get(f"n_{name}", 0) + 1
            continue
        if isinstance(one, dict):
            value = decoded(value, one)
        elif one == "text":
            value = value.decode("utf-8", "replace")
        elif one == "bool":
            value = bool(value)
        elif one == "int":
            value = (value & (1 << 64) - 1 ^ 1 << 63) - (1 << 63)  # two's complement
        if many:
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def problem(data: bytes, keep_incorrect: bool = False) -> dict:
    """A problem with defaults filled in; incorrect solutions are counted unless they are to be kept."""
    got = decoded(data, PROBLEM, frozenset() if keep_incorrect else frozenset({"incorrect_solutions"}))
    limit = got.pop("time_limit", None)
    out = DEFAULTS | {k: [] for k in ("public_tests", "private_tests", "generated_tests", "solutions", "incorrect_solutions", "cf_tags")} | got
    out["time_limit_seconds"] = None if limit is None else limit.get("seconds", 0) + limit.get("nanos", 0) / 1e9
    for tests in ("public_tests", "private_tests", "generated_tests"):
        out[tests] = [{"input": "", "output": ""} | t for t in out[tests]]
    for codes in ("solutions", "incorrect_solutions"):
        out[codes] = [{"language": 0, "solution": ""} | s for s in out[codes]]
    return out


def decode_messages(raw: DataFrame, shape: dict, schema: str, keep: tuple[str, ...] = (), column: str = "raw", counted: frozenset[str] = frozenset()) -> DataFrame:
    """``keep`` columns, the fields of the messages in ``column`` by their table, and ``decode_error``, null where decoding went well.

    ``schema``: names and types of the fields, in any order. A message that can't be decoded has nulls.
    """
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.select(*keep).schema.fields)
    ddl = f"{kept}, {schema}, decode_error string" if keep else f"{schema}, decode_error string"
    target = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for whole in batches:
            for batch in batches_of.slices(whole, column):
                yield _columns(batch, batch.column(column), shape, counted, keep, target)

    return raw.select(*dict.fromkeys([*keep, column])).mapInArrow(run, ddl)


def _columns(batch: pa.RecordBatch, raw: pa.Array, shape: dict, counted: frozenset[str], keep: tuple[str, ...], target: pa.Schema, made=lambda columns: columns) -> pa.RecordBatch:
    errors = batches_of.Errors(len(raw))
    columns = made(batches_of.decoded(batches_of.spans(raw), shape, errors, counted))
    texts = errors.texts()
    if errors.found:
        here = pa.array([None if t else i for i, t in enumerate(texts)], pa.int64())
        columns = {k: v.take(here) for k, v in columns.items()}
    columns |= {"decode_error": pa.array(texts, pa.string())} | {k: batch.column(k) for k in keep}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in target], schema=target)


def _with_defaults(columns: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """A batch of problems as ``problem`` makes one."""
    filled = lambda values, default: pc.fill_null(values, default)

    def nested(lists: pa.ListArray, default: dict) -> pa.ListArray:
        inner = lists.values
        parts = [filled(inner.field(k), v) for k, v in default.items()]
        return pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays(parts, names=list(default)))

    out = {k: filled(v, DEFAULTS[k]) if k in DEFAULTS else v for k, v in columns.items()}
    for name in ("public_tests", "private_tests", "generated_tests"):
        out[name] = nested(out[name], {"input": "", "output": ""})
    for name in ("solutions", "incorrect_solutions"):
        if name in out:
            out[name] = nested(out[name], {"language": 0, "solution": ""})
    limit = out.pop("time_limit")
    nanos = pc.divide(pc.cast(filled(limit.field("nanos"), 0), pa.float64()), 1e9)
    seconds = pc.add(pc.cast(filled(limit.field("seconds"), 0), pa.float64(), safe=False), nanos)
    out["time_limit_seconds"] = pc.if_else(limit.is_valid(), seconds, None)
    n = len(limit)
    out.setdefault("n_incorrect_solutions", pa.array([0] * n, pa.int64()))
    if "incorrect_solutions" not in out:
        out["incorrect_solutions"] = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], out["solutions"].type.value_type))
    return out


def decode_problems(raw: DataFrame, keep_incorrect: bool = False) -> DataFrame:
    """Records of ``scan_records`` as problems, a batch at a time; ``decode_error`` is null where decoding went well."""
    kept = ("split", "shard", "record_index")
    ddl = f"split string, shard int, record_index int, {SCHEMA}, decode_error string"
    target = to_arrow_schema(StructType.fromDDL(ddl))
    counted = frozenset() if keep_incorrect else frozenset({"incorrect_solutions"})

    def run(batches):
        for whole in batches:
            for batch in batches_of.slices(whole, "raw"):
                yield _columns(batch, batch.column("raw"), PROBLEM, counted, kept, target, _with_defaults)

    return raw.mapInArrow(run, ddl)


def named(c: Column, names: dict[int, str]) -> Column:
    """Name of an enumeration value, ``UNKNOWN_n`` where it has none."""
    found = F.try_element_at(literal_map({str(k): v for k, v in names.items()}), c.cast("string"))
    return F.coalesce(found, F.concat(F.lit("UNKNOWN_"), c.cast("string")))


def with_names(problems: DataFrame) -> DataFrame:
    return problems.withColumns({"source_name": named(F.col("source"), SOURCES), "difficulty_name": named(F.col("difficulty"), DIFFICULTIES)})


def field_histogram(raw: DataFrame, samples: int = 4) -> DataFrame:
    """Of each field number: count, wire types, and a few samples (the least by text)."""

    def run(batches):
        for whole in batches:
            for batch in batches_of.slices(whole, "raw"):
                m = batches_of.spans(batch.column(0))
                f = batches_of.fields(m, batches_of.Errors(batch.num_rows))
                sample = batches_of.texts(m.buffer, f.begin, np.minimum(f.end, f.begin + 120)).to_pylist()
                for i in np.flatnonzero(f.kind != 2):
                    k = f.kind[i]
                    sample[i] = str(f.value[i]) if k == 0 else str(struct.unpack("<d" if k == 1 else "<f", m.buffer[f.begin[i] : f.end[i]].tobytes())[0])
                yield pa.RecordBatch.from_arrays([pa.array(f.number.astype(np.int32)), pa.array(f.kind.astype(np.int32)), pa.array(sample, pa.string())], names=["number", "wire_type", "sample"])

    rows = raw.select("raw").mapInArrow(run, "number int, wire_type int, sample string")
    counted = rows.groupBy("number", "wire_type").agg(F.count("*").alias("n"), F.min("sample").alias("least"), F.max("sample").alias("most"))
    return counted.groupBy("number").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("wire_type")).alias("wire_types"), F.slice(F.array_sort(F.array_distinct(F.concat(F.collect_list("least"), F.collect_list("most")))), 1, samples).alias("samples"))


def inspected(raw: DataFrame, fields: dict = PROBLEM, samples: int = 3) -> DataFrame:
    """The field histogram with the name that each number is declared under; null for numbers that are not."""
    declared = literal_map({str(n): name for n, (name, _) in fields.items()})
    return field_histogram(raw, samples).withColumn("declared", F.try_element_at(declared, F.col("number").cast("string")))
