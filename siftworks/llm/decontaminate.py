"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (an item of fewer words is
one window). The windows are sets of word shingles; the corpus frequency of each
shingle, counted over all documents, orders a window's shingles by rarity. As a
window must be contained whole, a prefix of one shingle is enough: a document can
hold the window only if it holds that window's rarest shingle. Such a shared
shingle also fixes where the window must begin (positional bound) and end (length
bound); the words at that place are then compared one by one.

Items are a query set: they are read in blocks of bounded size, every block goes
over all documents, and what it finds travels along with the row, without a shuffle. If
there are several blocks, the documents with what was found so far are written to the shared
folder after each and read again for the next, so a task holds one block at a time.

Defined results: null and wordless texts have no words and are never hit; items
without words match nothing; items of one id count once; a null item id is named
``null``; repeated documents each get their own row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, shared_path, table, words_of, written

WINDOW = 10
#: Words of a shingle. Three word numbers under 2**21 fit one 64-bit key exactly.
SHINGLE = 3
#: Columns of the result and those used inside; a kept column of such a name gives way.
MADE = ("n_words", "n_hit", "hit_ranges", "items", "_hits", "_items", "_h", "_i", "_t")
#: Pairs of a place and a window that are held at a time (about 60 bytes each).
CANDIDATES = 1 << 18
#: Words of the items in one block; a block is what is broadcast, about 100 bytes a word.
BLOCK_WORDS = 400_000


class Block:
    """Windows of some items: their words as numbers, and for each window the shingle it is looked up by."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(ids[i : i + window], set()).add(item)
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.zeros((len(self.windows), window), np.int64)
        for i, w in enumerate(self.windows):
            self.words[i, : len(w)] = w
        self.keys = np.empty(0, np.int64)

    def shingles(self, window: tuple[int, ...]) -> list[int]:
        s = min(SHINGLE, len(window))
        return [_key(window[i : i + s]) for i in range(len(window) - s + 1)]

    def all_shingles(self) -> np.ndarray:
        return np.unique(np.array([k for w in self.windows for k in self.shingles(w)], np.int64))

    def order_by_rarity(self, count: dict[int, int]) -> None:
        """Chooses each window's prefix: its rarest shingle, the smaller key and earlier place on a tie."""
        rows = []
        for i, w in enumerate(self.windows):
            keys = self.shingles(w)
            rows.append((*min((count.get(k, 0), k, at) for at, k in enumerate(keys))[1:], i))
        rows.sort()
        self.keys, self.at, self.window = (np.array([r[j] for r in rows], np.int64) for j in range(3))
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.length})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and window of each window that the numbered words hold; at most one of a length at each place.

        Candidates are looked at in parts of bounded size, and word after word, so that what does not fit goes early.
        """
        n = len(ids)
        begins, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in self.sizes:
            places, keys = _keys(ids, size)
            lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            some = np.flatnonzero(hi > lo)
            upto = np.cumsum(hi[some] - lo[some])
            total = int(upto[-1]) if len(some) else 0
            for part in range(0, total, CANDIDATES):
                nth = np.arange(part, min(part + CANDIDATES, total))
                at = np.searchsorted(upto, nth, "right")
                row = hi[some[at]] - (upto[at] - nth)
                begin, window = places[some[at]] - self.at[row], self.window[row]
                fits = (begin >= 0) & (begin + self.length[window] <= n)
                begin, window = begin[fits], window[fits]
                for step in range(self.words.shape[1]):
                    inside = step < self.length[window]
                    same = ~inside | (ids[np.minimum(begin + step, n - 1)] == self.words[window, step])
                    begin, window = begin[same], window[same]
                begins.append(begin)
                found.append(window)
        return np.concatenate(begins), np.concatenate(found)


def _key(ids: tuple[int, ...]) -> int:
    key = 0
    for i in ids:
        key = key << 21 | i
    return key


def _keys(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the shingles of ``size`` words that are all known."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = ids > 0
    whole = known[:n].copy()
    for j in range(1, size):
        whole &= known[j : n + j]
    places = np.flatnonzero(whole)
    keys = ids[places]
    for j in range(1, size):
        keys = keys << 21 | ids[places + j]
    return places, keys


def _counted(docs: DataFrame, block: Block) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents (at most one row a shingle)."""
    wanted = block.all_shingles()
    sizes = sorted({min(SHINGLE, int(n)) for n in block.length})
    shared = docs.sparkSession.sparkContext.broadcast((block.number, wanted, sizes))

    def run(batches):
        number, wanted, sizes = shared.value
        total = np.zeros(len(wanted), np.int64)
        get = number.get
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
                for size in sizes:
                    _, keys = _keys(ids, size)
                    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    np.add.at(total, at[wanted[at] == keys], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen]), pa.array(total[seen])], names=["key", "n"])

    rows = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in rows.collect()}


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW):
    """The items in blocks; one block is in the driver's memory at a time.

    An item of more words than a block has goes in overlapping parts: each of its windows is in one of them.
    """
    block_words = min(block_words, (1 << 21) - 1 - window)  # so that word numbers fit a shingle's key
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        item = "null" if row["item_id"] is None else str(row["item_id"])
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + step + window - 1]
            if held and size + len(part) > block_words:
                yield Block(held, window)
                held, size = [], 0
            held.append((item, part))
            size += len(part)
    if held:
        yield Block(held, window)


def _pass(found: DataFrame, block: Block | None, carried: tuple[str, ...], last: bool) -> DataFrame:
    """Counts words and adds one block's hits and items to each row; the text goes on only where it is still needed."""
    shared = found.sparkSession.sparkContext.broadcast(block)

    def make():
        block: Block | None = shared.value

        def call(texts, batch):
            hits, items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            n_words = []
            for i, text in enumerate(texts):
                words = words_of(text)
                n_words.append(len(words))
                if not words or block is None:
                    continue
                begin, which = block.occurrences(block.numbers(words))
                if len(begin):
                    ranges = np.stack([begin, begin + block.length[which]], axis=1).ravel()
                    hits[i] = _merged([*hits[i], *ranges.tolist()])
                    items[i] = sorted({*items[i], *(x for w in np.unique(which) for x in block.owners[w])})
            out = {"n_words": n_words, "_h": hits, "_i": items}
            return out if last else out | {"_t": batch.column("text")}

        return call

    columns = "n_words long, _h array<int>, _i array<string>" + ("" if last else ", _t string")
    made = map_texts(found, make, columns, carried, also=("_hits", "_items"))
    renamed = [F.col("_h").alias("_hits"), F.col("_i").alias("_items")]
    return made.select(*carried, "n_words", *renamed, *([] if last else [F.col("_t").alias("text")]))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` of every document, with its words, hit words as ranges, and the ids of the items found in it."""
    keep = tuple(c for c in keep if c not in MADE)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    found = docs.withColumns({"_hits": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})
    carried = tuple(c for c in keep if c != "text")
    left = blocks(benchmark, block_words, window)
    block, before = next(left, None), None
    while True:
        if block is not None:
            block.order_by_rarity(_counted(docs, block))
        following = next(left, None)
        last = following is None and "text" not in keep
        found = _pass(found, block, carried, last)
        if following is None:
            break
        path = shared_path(docs.sparkSession, "decontamination")
        docs = found = written(found, "decontamination", path)
        if before:
            discard(docs.sparkSession, before)
        block, before = following, path
    ends = F.col("_hits")
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.size(ends) - 2, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.get(ends, i + 1) - F.get(ends, i)
    )
    return found.select(
        *keep,
        "n_words",
        F.when(F.size(ends) > 0, n_hit).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.col("_hits").alias("hit_ranges"),
        F.col("_items").alias("items"),
    )


def _merged(flat: list[int]) -> list[int]:
    """Ranges as a flat list begin, end, begin, end ..., sorted, overlaps joined."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def op4_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB: every document window of every item window's length is looked up as text.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT rid, dw.k, i, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
