"""Riegeli record files: a splittable scan, a stored index of chunks for lookups, and a sink.

A file is 64 KiB blocks that each begin with a 24-byte header. Without those headers the
rest is one stream in which chunks follow each other; offsets called stream places are offsets
in that stream. A block header says where the chunk that it interrupts began and ends, so a
reader can start at any block: a byte range has the chunks that begin in it, and a file of any
size is as many tasks as it has ranges. Chunk headers alone give the index (40 bytes a chunk);
records are then read chunk by chunk, by those byte ranges only.

Only simple chunks hold records here; transposed ones are counted and passed over, unless
asked to fail on them. Hashes in headers are neither checked nor written (zeros).

Files in a store that only Spark's own readers can open come whole through its binary
reader; there a file is one unit of work and has 2 GB at most.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..session import cut
from . import stores

# ---- Fixed values of the format. ----
BLOCK, BLOCK_HEADER, CHUNK_HEADER = 1 << 16, 24, 40
KINDS = {0x73: "file_signature", 0x6D: "file_metadata", 0x70: "padding", 0x72: "simple", 0x74: "transposed"}
SIGNATURE = bytes.fromhex(
    "83af70d10d884a3f0000000000000000400000000000000091bac23c9287e1a90000000000000000e19f13c0e9b1c37273000000000000000000000000000000"
)


class FormatError(ValueError):
    """The file or message is not what the format says."""


#: Bytes of a file that one task walks for chunk headers; a multiple of the block size.
RANGE_BYTES = 1024 * BLOCK
#: Bytes of chunks that one task unpacks.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Chunk:
    begin: int  # in the file
    kind: str
    size: int
    records: int
    decoded: int
    next: int  # in the file: where the chunk after it begins


STEP = BLOCK - BLOCK_HEADER


def file_place(offset: int) -> int:
    """Where a chunk at this stream offset begins in the file: at the block itself if nothing of the block precedes it."""
    block, inside = divmod(offset, STEP)
    return block * BLOCK + (inside + BLOCK_HEADER if inside else 0)


def stream_place(place: int) -> int:
    """The stream offset of a file place; a place in a block header is that block's first byte."""
    block, inside = divmod(place, BLOCK)
    return block * STEP + max(0, inside - BLOCK_HEADER)


def stream_bytes(read: Callable[[int, int], bytes], begin: int, size: int) -> bytes:
    """``size`` bytes of the stream from stream place ``begin``, fewer at the end of the file."""
    if size <= 0:
        return b""
    first, last = begin // STEP * BLOCK + BLOCK_HEADER + begin % STEP, (begin + size - 1) // STEP * BLOCK + BLOCK_HEADER + (begin + size - 1) % STEP
    data = read(first, last + 1)
    head = BLOCK - first % BLOCK  # up to the next block
    if len(data) <= head:
        return data
    return data[:head] + b"".join(data[at + BLOCK_HEADER : at + BLOCK] for at in range(head, len(data), BLOCK))


def first_chunk(read: Callable[[int, int], bytes], block: int) -> int:
    """The file place of the first chunk at or after a block's begin, by what the block's header says."""
    if not block:
        return 0
    header = read(block, block + BLOCK_HEADER)
    if len(header) < BLOCK_HEADER:
        return block + BLOCK  # the file ends in this header
    before, after = (int.from_bytes(header[i : i + 8], "little") for i in (8, 16))
    return block + after if before else block


def chunks(read: Callable[[int, int], bytes], size: int, begin: int = 0, end: int | None = None) -> Iterator[Chunk]:
    """Headers of the chunks that begin in the bytes ``begin`` to ``end`` of a file; ``begin`` is a block's."""
    length = stream_place(size)
    end = size if end is None else min(end, size)
    place = first_chunk(read, begin)
    while place < end and (at := stream_place(place)) + CHUNK_HEADER <= length:
        header = stream_bytes(read, at, CHUNK_HEADER)
        word = lambda a, b: int.from_bytes(header[a:b], "little")  # noqa: B023, E731
        body, records = at + CHUNK_HEADER, word(25, 32)
        if body + word(8, 16) > length:
            raise FormatError(f"the chunk at {place} ends {body + word(8, 16) - length} bytes after its file")
        # A chunk takes at least as many bytes of the file as it has records.
        after = file_place(max(body + word(8, 16), stream_place(place + records)))
        yield Chunk(place, KINDS.get(header[24], hex(header[24])), word(8, 16), records, word(32, 40), after)
        place = after


def body(read: Callable[[int, int], bytes], begin: int, size: int) -> bytes:
    """What the chunk at a file place holds after its header."""
    return stream_bytes(read, stream_place(begin) + CHUNK_HEADER, size)


def varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and the place after it."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            break
        value |= (data[at + i] & 0x7F) << (7 * i)
        if data[at + i] < 0x80:
            return value, at + i + 1
    raise FormatError("a varint has no end")


def unpacked(block: bytes, packing: int) -> bytes:
    if packing == 0:
        return block
    size, at = varint(block, 0)
    if packing == 0x7A:
        out = zstandard.ZstdDecompressor().decompressobj().decompress(block[at:])
    elif packing == 0x62:
        import brotli  # optional; only files packed with it need it

        out = brotli.decompress(block[at:])
    else:
        raise FormatError(f"packing {packing:#x} is not supported")
    if len(out) != size:
        raise FormatError(f"{len(out)} bytes unpacked instead of {size}")
    return out


def records(held: bytes, count: int) -> list[bytes]:
    """Records of a simple chunk's body: sizes first, then all values together."""
    if not held:
        raise FormatError("a simple chunk is empty")
    n, at = varint(held, 1)
    sizes = unpacked(held[at : at + n], held[0])
    values = unpacked(held[at + n :], held[0])
    out, p, begin = [], 0, 0
    for _ in range(count):
        size, p = varint(sizes, p)
        out.append(values[begin : begin + size])
        begin += size
    if begin != len(values):
        raise FormatError("record sizes do not sum up to the values")
    return out


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _shard(c) -> tuple:
    """split and shard of a file name like ``..._train.riegeli-00003-of-00128``."""
    split = F.regexp_extract(c, r"_(train|valid|test)\.riegeli", 1)
    number = F.regexp_extract(c, r"-(\d{5})-of-\d{5}$", 1)
    return split.alias("split"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("shard")


SPLITS = ("train", "valid", "test")


def shards(spark: SparkSession, path: str, pattern: str = "*.riegeli*", train_shards: int | None = None) -> DataFrame:
    """(split, shard, path, ord) of the record files, training files first; of those at most the first ``train_shards``.

    Only the listing is read, no content.
    """
    listed = _files(spark, path, pattern).select("path", *_shard(F.col("path")))
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    nth = F.row_number().over(Window.partitionBy("split").orderBy("shard", "path"))
    out = listed.withColumn("_n", nth)
    if train_shards is not None:
        out = out.where((F.col("split") != "train") | (F.col("_n") <= train_shards))
    return out.select("split", "shard", "path", (F.when(rank == 0, len(SPLITS)).otherwise(rank - 1) * 1_000_000 + F.col("_n")).cast("long").alias("ord"))


HEADERS = "path string, file_size long, signature_ok boolean, begin long, kind string, size long, records long, decoded long, next long, error string"


@dataclass
class Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int


def _headers(path: str, size: int, begin: int, end: int, read: Callable[[int, int], bytes]) -> list[tuple]:
    """Rows of ``HEADERS`` for a byte range; the last one tells where its structure breaks, if it does."""
    signature, rows = read(0, 64) == SIGNATURE if not begin else None, []
    base = (path, size, signature)
    try:
        rows += [(*base, c.begin, c.kind, c.size, c.records, c.decoded, c.next, None) for c in chunks(read, size, begin, end)]
    except FormatError as e:
        rows.append((*base, None, None, None, 0, 0, None, str(e)))
    if not rows and not begin:
        rows.append((*base, None, None, None, 0, 0, None, None))  # an empty file is still a file
    return rows


class RiegeliReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Range]:
        step = max(BLOCK, int(self.options.get("rangebytes", RANGE_BYTES)) // BLOCK * BLOCK)
        if "paths" in self.options:
            files = [f for p in json.loads(self.options["paths"]) for f in stores.listed(p)]
            scheme = {stores.at(p)[1]: p for p in json.loads(self.options["paths"])}
        else:
            root, pattern = self.options["path"], self.options.get("pathglobfilter", "*")
            files = [f for f in stores.listed(root) if fnmatch(f[0].rpartition("/")[2], pattern) and "/_staged-" not in f[0]]
            inside = stores.at(root)[1]
            scheme = {f: root + f[len(inside) :] for f, _ in files}
        return [Range(scheme[f], size, at, min(at + step, size)) for f, size in files for at in range(0, max(size, 1), step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        file = stores.Ranges(partition.path)
        try:
            yield from _headers(partition.path, partition.size, partition.begin, partition.end, file.read)
        finally:
            file.close()


class RiegeliWriter(stores.StagedWriter):
    """Tasks stage a file for each (split, shard) that they meet.

    Rows of a shard must come to one task, in the order of its records (``write_records`` sees to that)."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options["path"])
        self.name, self.chunk = options.get("name", "records"), int(options.get("chunkbytes", 1 << 20))
        self.packing = {"none": 0, "zstd": 0x7A}[options.get("packing", "zstd")]

    def files(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
        for (split, shard), rows in groupby(self._rows(iterator), lambda row: row[:2]):
            yield f"{self.name}_{split}.riegeli-{shard:05d}-of-99999", file_parts((row[2] for row in rows), self.packing, self.chunk)

    @staticmethod
    def _rows(iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        for batch in iterator:
            yield from zip(batch.column("split").to_pylist(), batch.column("shard").to_pylist(), batch.column("raw").to_pylist(), strict=True)


class RiegeliSource(DataSource):
    """``format("riegeli")``: chunk headers of the files below ``path`` (option ``pathGlobFilter``), one task a byte range
    (``rangeBytes``); as a sink, record files of rows (split, shard, raw) (``name``, ``chunkBytes``, ``packing`` zstd or none)."""

    @classmethod
    def name(cls) -> str:
        return "riegeli"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return RiegeliReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RiegeliWriter(dict(self.options))


def number(n: int) -> bytes:
    """A varint."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _packed(block: bytes, packing: int) -> bytes:
    return number(len(block)) + zstandard.compress(block) if packing else block


def file_parts(rows: Iterator[bytes], packing: int = 0x7A, chunk_bytes: int = 1 << 20) -> Iterator[bytes]:
    """A file of simple chunks as it is written, a chunk at a time. Every block header tells of the chunk that it interrupts."""

    def placed(data: bytes, begin: int) -> bytes:
        end, out, at, place = file_place(stream_place(begin) + len(data)), [], 0, begin
        while at < len(data):
            if place % BLOCK == 0:
                out.append(bytes(8) + (place - begin).to_bytes(8, "little") + (end - place).to_bytes(8, "little"))
                place += BLOCK_HEADER
            n = min(len(data) - at, BLOCK - place % BLOCK)
            out.append(data[at : at + n])
            at, place = at + n, place + n
        return b"".join(out)

    def chunk(held: list[bytes], begin: int) -> bytes:
        sizes, values = _packed(b"".join(map(number, map(len, held))), packing), b"".join(held)
        content = bytes([packing]) + number(len(sizes)) + sizes + _packed(values, packing)
        data = bytes(8) + len(content).to_bytes(8, "little") + bytes(8) + bytes([0x72]) + len(held).to_bytes(7, "little") + len(values).to_bytes(8, "little") + content
        return data + bytes(max(0, stream_place(begin + len(held)) - stream_place(begin) - len(data)))

    yield SIGNATURE
    place, held, size = len(SIGNATURE), [], 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size >= chunk_bytes:
            part = placed(chunk(held, place), place)
            yield part
            place, held, size = place + len(part), [], 0
    if held:
        yield placed(chunk(held, place), place)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RiegeliSource)
    return spark


def write_records(rows: DataFrame, path: str, order: str = "ord", name: str = "records", chunk_bytes: int = 1 << 20, packing: str = "zstd") -> None:
    """Record files of rows (split, shard, ``order``, raw): one for each (split, shard), its records in order.

    A shard is written by one task, as it comes from the sort; no more than a chunk is held.
    """
    registered(rows.sparkSession)
    dealt = rows.select("split", F.col("shard").cast("int").alias("shard"), order, "raw").repartition("split", "shard").sortWithinPartitions("split", "shard", order)
    writer = dealt.select("split", "shard", "raw").write.format("riegeli").mode("append")
    writer.option("name", name).option("chunkBytes", str(chunk_bytes)).option("packing", packing).save(stores.qualified(rows.sparkSession, path))


def _whole_files(spark: SparkSession, path: str, pattern: str, paths: list[str] | None) -> DataFrame:
    """Chunk headers of files that only Spark's binary reader opens."""
    content = _files(spark, path, pattern) if paths is None else spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = row["content"]
                found = _headers(row["path"], len(data), 0, len(data), lambda a, b, data=data: data[a:b])
                yield _batch(found, HEADERS)

    return content.mapInArrow(run, HEADERS)


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in ddl.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, k in enumerate(kinds)], names=list(names))


def scan_chunks(spark: SparkSession, path: str, pattern: str = "*.riegeli*", range_bytes: int = RANGE_BYTES, paths: list[str] | None = None) -> DataFrame:
    """One row for each chunk, without its content; ``error`` tells where a file's structure breaks.

    The ranges of a file must meet: a chunk that ends where no other begins is an error too.
    """
    path = stores.qualified(spark, path)
    if not stores.known(path):
        return _whole_files(spark, path, pattern, paths).drop("next")
    if paths is not None and not paths:
        return spark.createDataFrame([], HEADERS).drop("next")
    source = registered(spark).read.format("riegeli").option("path", path).option("pathGlobFilter", pattern).option("rangeBytes", str(range_bytes))
    found = (source if paths is None else source.option("paths", json.dumps(paths))).load()
    in_file = Window.partitionBy("path").orderBy(F.col("begin").asc_nulls_last())  # a row a chunk of one file
    follower = F.lead("begin").over(in_file)
    apart = (F.col("next") != follower) & F.col("error").isNull()
    says = F.concat(F.lit("the chunk at "), F.col("begin").cast("string"), F.lit(" ends at "), F.col("next").cast("string"), F.lit(", the next one begins at "), follower.cast("string"))
    return found.withColumn("error", F.when(apart, says).otherwise(F.col("error"))).drop("next")


def chunk_index(spark: SparkSession, path: str, pattern: str = "*.riegeli*", range_bytes: int = RANGE_BYTES, paths: list[str] | None = None) -> DataFrame:
    """(split, shard, path, begin, size, kind, records, first_record, error) of every chunk that has records, and of every break.

    Store it as a table (``write.parquet``) and lookups read nothing but the chunks that they need.
    """
    before = F.sum(F.when(F.col("kind") == "simple", F.col("records")).otherwise(0)).over(Window.partitionBy("path").orderBy(F.col("begin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    rows = scan_chunks(spark, path, pattern, range_bytes, paths).withColumn("first_record", F.coalesce(before, F.lit(0)))
    return rows.where("records > 0 OR error IS NOT NULL").select(*_shard(F.col("path")), "path", "begin", "size", "kind", "records", "first_record", "error")


def _wanted_chunks(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks that hold a wanted record, with those records: each id falls to the last chunk that begins at or before it."""
    key = ["split", "shard"]
    marks = index.where("kind = 'simple'").select(*key, F.col("first_record").alias("at"), F.lit(0).alias("kind_"), F.struct("path", "begin", "size", "kind", "records", "first_record", "error").alias("c"))
    wanted = ids.select(*key, F.col("record_index").cast("long").alias("at")).distinct().select(*key, "at", F.lit(1).alias("kind_"), F.lit(None).cast(marks.schema["c"].dataType).alias("c"))
    upto = Window.partitionBy(*key).orderBy("at", "kind_")
    placed = marks.unionByName(wanted).withColumn("c", F.last("c", ignorenulls=True).over(upto)).where("kind_ = 1 AND c IS NOT NULL AND at < c.first_record + c.records")
    return placed.groupBy(*key, "c").agg(F.collect_list("at").alias("wanted")).select(*key, "c.*", "wanted")  # at most the chunk's records


def scan_records(
    spark: SparkSession,
    path: str,
    pattern: str = "*.riegeli*",
    ids: DataFrame | None = None,
    skip_transposed: bool = True,
    train_shards: int | None = None,
    index: DataFrame | None = None,
    range_bytes: int = RANGE_BYTES,
    taken: Accumulator | None = None,
) -> DataFrame:
    """(split, shard, record_index, raw) of every record, or of those in ``ids`` (split, shard, record_index).

    Files are chosen by name before any is opened: with ids only those that have a wanted
    record, with ``train_shards`` only the first so many of the training split. Of those the chunk
    headers are read, unless a stored ``index`` (``chunk_index``) is given. Then every task reads chunks by
    their byte ranges, with ids only those that hold a wanted record. ``taken`` adds up the bytes read.
    """
    if index is None:
        paths = None
        if ids is not None or train_shards is not None:
            chosen = shards(spark, path, pattern, train_shards)
            if ids is not None:
                chosen = chosen.join(ids.select("split", "shard"), ["split", "shard"], "left_semi")
            paths = [r[0] for r in chosen.orderBy("ord").select("path").collect()]  # names, which the driver has listed anyway
        index = chunk_index(spark, path, pattern, range_bytes, paths)
    index = cut(index)
    rows = index.withColumn("wanted", F.lit(None).cast("array<long>")) if ids is None else _wanted_chunks(index, ids)
    rows = rows.select("split", "shard", "path", "begin", "size", "kind", "records", "first_record", "error", "wanted")
    schema = "split string, shard int, record_index int, raw binary"

    def of(found: Iterator[tuple[dict, bytes]]) -> Iterator[pa.RecordBatch]:
        for row, held in found:
            span = records(held, row["records"])
            places = range(row["records"]) if row["wanted"] is None else [i - row["first_record"] for i in sorted(row["wanted"])]
            yield _batch([(row["split"], row["shard"], row["first_record"] + i, span[i]) for i in places], schema)

    def usable(row: dict) -> bool:
        if row["error"]:
            raise FormatError(row["error"])
        if row["kind"] == "transposed" and not skip_transposed:
            raise FormatError("a transposed chunk")
        return row["kind"] == "simple"

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bodies():
            file, held = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if not usable(row):
                        continue
                    if held != row["path"]:
                        if file is not None:
                            file.close()
                        file, held = stores.Ranges(row["path"]), row["path"]
                    before = file.taken
                    yield row, body(file.read, row["begin"], row["size"])
                    if taken is not None:
                        taken.add(file.taken - before)
            if file is not None:
                file.close()

        return of(bodies())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bodies():
            for batch in batches:
                for file in batch.to_pylist():
                    for row in file["chunks"]:
                        if usable(row):
                            yield row, body(lambda a, b, data=file["content"]: data[a:b], row["begin"], row["size"])

        return of(bodies())

    if not stores.known(stores.qualified(spark, path)):
        per_file = rows.groupBy("path").agg(F.collect_list(F.struct(*rows.columns)).alias("chunks"))
        names = [r[0] for r in per_file.select("path").collect()]
        content = spark.read.format("binaryFile").load(names).select("path", "content") if names else spark.createDataFrame([], "path string, content binary")
        return content.join(per_file, "path").select("content", "chunks").mapInArrow(whole, schema)
    total = rows.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return rows.repartition(tasks, "path", "begin").sortWithinPartitions("path", "begin").mapInArrow(ranged, schema)


def file_profile(scanned: DataFrame) -> DataFrame:
    """Of each file: chunks, records, decoded bytes, chunks by kind, and the first error."""
    return scanned.groupBy("path", "file_size").agg(
        F.coalesce(F.max("signature_ok"), F.lit(False)).alias("signature_ok"),
        F.count("kind").alias("chunks"),
        F.sum("records").alias("records"),
        F.sum("decoded").alias("decoded_bytes"),
        *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS.values()),
        F.min("error").alias("error"),
    )


def missing_ids(ids: DataFrame, found: DataFrame, most: int = 5) -> list[tuple]:
    """Some wanted ids that no file has, for an error message."""
    key = ["split", "shard", "record_index"]
    return [tuple(r) for r in ids.select(key).join(found.select(key), key, "left_anti").orderBy(key).limit(most).collect()]
