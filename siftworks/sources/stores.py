"""Files of a store read by ranges and written in two steps, from any task.

A place is a path or a URI that Arrow's file systems know (local, S3, GCS, ABFS, HDFS). Files are
written under a staging folder beside their place; when the whole job has gone well they are moved
where they belong (a sink's few files by the driver, a file for each row by tasks), and when not, the
folder goes with all that is in it. A task that fails, or runs twice, leaves nothing that anybody reads.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window

from ..session import cut

#: Files that the driver, or a task, moves at a time; a move is a call to the store.
MOVES = 16
#: Bytes of files, and folders, that a task passes on at a time.
BATCH_BYTES, BATCH_FOLDERS = 2 << 20, 1000
#: Columns of what tasks read of a tree.
KINDS = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


def at(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a place, and the path in it."""
    if re.match(r"file:/", place):
        return fs.LocalFileSystem(), "/" + place[5:].lstrip("/")
    if "://" in place:
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), place


def qualified(spark: SparkSession, place: str) -> str:
    """The place with its scheme, as Spark's readers and writers understand it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def known(place: str) -> bool:
    """Whether tasks can open the place themselves; some stores only Spark's readers know."""
    try:
        at(place)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def listed(place: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a place, or of the place itself if it is a file, by path."""
    system, path = at(place)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)


class Ranges:
    """A file of which parts are read; ``taken`` counts the bytes."""

    def __init__(self, place: str):
        system, path = at(place)
        self._file, self.taken = system.open_input_file(path), 0
        self.size = self._file.size()

    def read(self, begin: int, end: int) -> bytes:
        data = self._file.read_at(max(0, min(end, self.size) - begin), begin) if begin < self.size else b""
        self.taken += len(data)
        return data

    def close(self) -> None:
        self._file.close()


@dataclass(frozen=True)
class Staging:
    """Files on their way to ``root``."""

    root: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    def folder(self) -> tuple[fs.FileSystem, str]:
        system, path = at(self.root)
        return system, f"{path.rstrip('/')}/_staged-{self.job}"

    def begun(self) -> Staging:
        """Makes the folder, in the driver alone: a task that still runs when the job is withdrawn finds none to write to."""
        system, folder = self.folder()
        system.create_dir(folder, recursive=True)
        return self

    def put(self, name: str, parts: Iterable[bytes]) -> tuple[str, str]:
        """Writes a file whose place will be ``root/name``; returns its staged path and that name, for ``publish``."""
        system, folder = self.folder()
        path = f"{folder}/{uuid.uuid4().hex}"
        with system.open_output_stream(path) as out:
            for part in parts:
                out.write(part)
        return path, name

    def move(self, files: Iterable[tuple[str, str]]) -> int:
        """Moves staged files to their places; a file that is there is replaced, one that an earlier try has moved is left."""
        system, path = at(self.root)
        moves = [(staged, f"{path.rstrip('/')}/{name}") for staged, name in files]
        for above in {place.rpartition("/")[0] for _, place in moves}:
            system.create_dir(above, recursive=True)

        def one(staged: str, place: str) -> None:
            try:
                system.move(staged, place)
            except OSError:
                if [f.type for f in system.get_file_info([staged, place])] != [fs.FileType.NotFound, fs.FileType.File]:
                    raise

        if isinstance(system, fs.LocalFileSystem):  # nothing to wait for
            for each in moves:
                one(*each)
        else:
            with ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(lambda each: one(*each), moves))
        return len(moves)

    def publish(self, files: Iterable[tuple[str, str]]) -> None:
        """Moves the files of tasks that went well to their places."""
        self.move(files)
        self.withdraw()

    def withdraw(self) -> None:
        system, folder = self.folder()
        for last in (False, False, True):  # a task may be adding a file just now
            try:
                if system.get_file_info(folder).type != fs.FileType.NotFound:
                    system.delete_dir(folder)
                return
            except OSError:
                if last:
                    raise


class Staged(WriterCommitMessage):
    """The files that a task has staged, with their names."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class StagedWriter(DataSourceArrowWriter):
    """A sink whose files appear when all tasks went well; ``files`` says what a task makes of its rows."""

    def __init__(self, root: str):
        self.staging = Staging(root).begun()

    def files(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterable[bytes]]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return Staged([self.staging.put(name, parts) for name, parts in self.files(iterator)])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.staging.publish(f for m in messages if m is not None for f in m.files)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.staging.withdraw()


def write_files(rows: DataFrame, root: str) -> None:
    """A file for each row (name, text) below the root, all or none; files of those names are replaced.

    Tasks stage the files; when all are staged, tasks move them. The driver sees neither texts nor names.
    """
    staging = Staging(qualified(rows.sparkSession, root)).begun()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            put = [staging.put(name.as_py(), [text.as_py().encode("utf-8", "surrogatepass")]) for name, text in zip(batch.column("name"), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.string()) for side in (zip(*put, strict=True) if put else ([], []))], ["staged", "name"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([staging.move(zip(*(batch.column(c).to_pylist() for c in ("staged", "name")), strict=True))], pa.int64())})

    try:
        staged = cut(rows.select("name", "text").mapInArrow(stage, "staged string, name string"))
        staged.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    finally:
        staging.withdraw()


def _seen(folder: str, system: fs.FileSystem) -> list[fs.FileInfo]:
    """What lies directly in a folder; names with a leading ``_`` or ``.`` are passed over, as Spark's readers do."""
    return [f for f in system.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith((".", "_"))]


def _below(spark: SparkSession, root: str) -> DataFrame:
    """The folders directly below the root, and the root itself (not ``deep``), dealt to tasks; one task lists that single folder."""

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = at(root)
        folders = [(path, False), *((f.path, True) for f in _seen(path, system) if f.type == fs.FileType.Directory)]
        for i in range(0, len(folders), BATCH_FOLDERS):
            some = folders[i : i + BATCH_FOLDERS]
            yield pa.RecordBatch.from_pydict({"folder": pa.array([f for f, _ in some], pa.string()), "deep": pa.array([d for _, d in some], pa.bool_())})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, 1, 1, 1).mapInArrow(run, "folder string, deep boolean").repartition(tasks, "folder")


def _content(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_file(path) as file:
        return file.read()


def _walked(spark: SparkSession, root: str, take: Callable[[fs.FileSystem, str, list[fs.FileInfo]], Iterator[tuple]], columns: dict[str, str]) -> DataFrame:
    """The rows that ``take`` makes of every folder at or below the root, from its path and what lies directly in it; by tasks, which share out what lies directly below the root."""
    system, path = at(root)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        raise FileNotFoundError(root)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = at(root)
        rows, size = [], 0
        for given in batches:
            for first in given.to_pylist():
                left = [first["folder"]]
                while left:
                    folder = left.pop()
                    seen = _seen(folder, system)
                    if first["deep"]:
                        left.extend(f.path for f in seen if f.type == fs.FileType.Directory)
                    for row in take(system, folder, seen):
                        rows.append(row)
                        size += sum(len(v) for v in row if isinstance(v, bytes))
                        if size >= BATCH_BYTES or len(rows) >= BATCH_FOLDERS:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    return _below(spark, root).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in columns.items()))


def _opened(spark: SparkSession, root: str, names: Iterable[str]) -> DataFrame:
    """``path`` and ``content`` of all files below the root whose names match, by Spark's own reader, which lists empty files but passes over them; the driver lists them all."""
    schema = T.StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")
    files = spark.read.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{','.join(names)}}}").load(root).select("path", "content")
    listed = [(re.sub("^([^:/]+):///", r"\1:/", unquote(path)),) for path in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    return files.unionByName(empty.withColumn("content", F.lit(bytearray())))


def read_files(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """Of every folder at or below the root with a file of these names: ``folder``, its path, and the bytes of each file under its name, null where there is none.

    Folders are walked and read by tasks, which share out what lies directly below the root; the driver lists nothing. A tree
    of very many folders has them in parts, ``root/<part>/<folder>``. In a store that only Spark's own readers can open the driver
    lists all files.
    """
    root = qualified(spark, root)
    if not known(root):
        place = _opened(spark, root, names).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        return place.groupBy("folder").agg(*(F.first(F.when(F.col("name") == n, F.col("content")), ignorenulls=True).alias(n) for n in names))

    def take(system: fs.FileSystem, folder: str, seen: list[fs.FileInfo]) -> Iterator[tuple]:
        held = {f.base_name: _content(system, f.path) for f in seen if f.type == fs.FileType.File and f.base_name in names}
        if held:
            yield folder, *map(held.get, names)

    return _walked(spark, root, take, {"folder": "string", **dict.fromkeys(names, "binary")})


def read_series(spark: SparkSession, root: str, whole: str, below: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Of every folder at or below the root (folder, n, first, second): the bytes of its file ``whole`` as ``first``, without ``n``; where
    there is none, a row for each number from 1 to the last before a gap in the names of the files in its folder ``below``.

    ``pairs`` are the names of two files with ``{}`` for the number; the first pair counts of which there is a number 1. ``second`` is null
    where its file is missing. The tree is read as by ``read_files``.
    """
    root = qualified(spark, root)
    if not known(root):
        files = _opened(spark, root, [whole, *(name.format("*") for pair in pairs for name in pair)])
        mark = lambda kind, n, side: F.struct(F.lit(kind).alias("kind"), n.alias("n"), F.lit(side).alias("side"))
        marks = [F.when(F.element_at(F.split("path", "/"), -1) == whole, mark(0, F.lit(1), "first"))]
        for kind, pair in enumerate(pairs, 1):
            for side, name in zip(("first", "second"), pair, strict=True):
                number = F.regexp_extract("path", f"/{re.escape(below)}/{'([1-9][0-9]*)'.join(map(re.escape, name.split('{}')))}$", 1)
                marks.append(F.when(number != "", mark(kind, number.try_cast("int"), side)))
        files = files.select("path", "content", F.coalesce(*marks).alias("m")).where("m.n IS NOT NULL")
        folder = F.regexp_replace("path", F.when(F.col("m.kind") == 0, "/[^/]*$").otherwise("/[^/]*/[^/]*$"), F.lit(""))
        side = lambda name: F.first(F.when(F.col("m.side") == name, F.col("content")), ignorenulls=True).alias(name)
        found = files.groupBy(folder.alias("folder"), F.col("m.kind").alias("kind"), F.col("m.n").alias("n")).agg(side("first"), side("second")).where("first IS NOT NULL")
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy("folder", "kind").orderBy("n"))).where("n = nth")
        found = found.withColumn("least", F.min("kind").over(Window.partitionBy("folder"))).where("kind = least")
        return found.select("folder", F.when(F.col("kind") > 0, F.col("n")).alias("n"), "first", "second")

    def take(system: fs.FileSystem, folder: str, seen: list[fs.FileInfo]) -> Iterator[tuple]:
        held = {f.base_name: f for f in seen}
        if whole in held and held[whole].type == fs.FileType.File:
            yield folder, None, _content(system, held[whole].path), None
        elif below in held and held[below].type == fs.FileType.Directory:
            files = {f.base_name: f.path for f in _seen(held[below].path, system) if f.type == fs.FileType.File}
            first, second = next((pair for pair in pairs if pair[0].format(1) in files), pairs[0])
            for n in itertools.takewhile(lambda n: first.format(n) in files, itertools.count(1)):
                other = files.get(second.format(n))
                yield folder, n, _content(system, files[first.format(n)]), other and _content(system, other)

    return _walked(spark, root, take, {"folder": "string", "n": "int", "first": "binary", "second": "binary"})


def remove_files(spark: SparkSession, root: str) -> None:
    """Removes a tree: tasks what lies in the folders directly below the root, the driver what is left."""
    root = qualified(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = at(root)
        for given in batches:
            gone = [f["folder"] for f in given.to_pylist() if f["deep"] and system.get_file_info(f["folder"]).type != fs.FileType.NotFound]
            for folder in gone:
                system.delete_dir(folder)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(gone)], pa.int64())})

    _below(spark, root).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    system, path = at(root)
    system.delete_dir(path)
