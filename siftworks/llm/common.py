"""Helpers that all operators of this subpackage share.

Texts are handled in Arrow batches (``mapInArrow``), so that null ids keep
their integer type, and a batch is cut into slices of bounded text bytes before
any Python object is made of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..session import checkpoint_root, cut, settled

__all__ = ["among", "checkpoint_root", "cut", "discard", "fold", "map_texts", "shared_path", "slices", "table", "words_of", "written"]

#: Text bytes that one call of a batch function sees at most (one text may be longer).
SLICE_BYTES = 2 << 20

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
WORD_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settled(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing will read any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bits of a filter of ids, from its least to its greatest size: 16 MB, past which it lets more and more rows through.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def among(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that holds for every value of ``ids[column]`` and for few others: a bit for each hash, looked up in the scan.

    It costs no exchange of the rows that are tested. 16 bits a value let 6 % of the others through; the filter stops growing at
    ``MOST_BITS``, so with very many values it passes everything, which is as right. The driver sees one number for each 64 bits.
    """
    n = ids.count()
    if not n:
        return lambda c: F.lit(False)
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 16 * n:
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    rows = ids.select(place(F.col(column)).alias("p")).select(F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    held = np.zeros(bits // 64, "<i8")
    for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        held[r["word"]] = r["bit"]
    whole = F.lit(held.tobytes())

    def test(c: Column) -> Column:
        p = place(c)
        byte = F.conv(F.hex(F.substr(whole, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (p % 8).cast("int")) == 1

    return test


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch with at most ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(size):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None], pa.RecordBatch], dict[str, list | pa.Array]]],
    columns: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    also: tuple[str, ...] = (),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` columns of each row plus the columns that a batch function makes from its texts.

    ``make`` is called once for each task and returns the batch function, which
    takes the texts and the batch and returns a list or array for each name in
    ``columns`` (DDL), as long as the texts. A returned key ``"@"`` holds, for
    each output row, the input row it belongs to; without it rows map one to one.
    ``also`` names further columns that the batch function reads. A made column takes the
    place of a kept one of its name.
    """
    made_names = {f.name for f in _parse_datatype_string(columns).fields}
    keep = tuple(c for c in keep if c not in made_names)
    passed = [df.schema[c] for c in keep]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed), columns])
    fields = _parse_datatype_string(columns).fields
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}
    names = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for whole in batches:
            for batch in slices(whole, text, slice_bytes):
                made = call(batch.column(text).to_pylist(), batch)
                rows = made.get("@")
                base = batch.select(list(keep))
                if rows is not None:
                    base = base.take(pa.array(rows, pa.int64()))
                arrays = [base.column(c) for c in keep]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, kinds[n]) for n in names for x in [made[n]]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.select(*dict.fromkeys([*keep, *also, text])).mapInArrow(run, ddl)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; -1 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)), F.lit(-1))
