"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

The packing is decided on the histogram of piece lengths, which has at most
``capacity`` entries however large the corpus is: a bin is filled greedily with the
longest piece that fits, then its smallest piece is exchanged for two unpacked
pieces that fill the widened gap more tightly, and the finished pattern of lengths
is repeated as often as the histogram allows. Pieces then take their places by
their rank among pieces of equal length.

Ranks come from counts per (length, part), with as many parts as the length has rows
for, so a length that a third of all rows share is numbered by many tasks.

What the driver sends out is the patterns. Each of them leaves some length with less
than half of its rest, so a length k ends at most log2(4096 / k) + 2 patterns, and a bin
has at most 90 distinct lengths: 14,000 patterns and 41 MB at the very most, whatever the
rows; 0.3 to 1.5 MB as measured. Counts per part are at most 16 for each length, and one
for each further million rows.

Defined results: null and empty texts are the closing id alone (length 1); strings of
special tokens in a text are those tokens, as the tokenizer has it; repeated rows are
packed one by one; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_texts, table

CAPACITY = 4096
CLOSING = 1
TOKENIZER = "word_bpe_49k.json"
#: Rows of one length that one part numbers; a length of more than a few rows has some parts all the same.
PART_ROWS, FEW_ROWS, FEW_PARTS = 1_000_000, 256, 16
#: Distinct words whose ids a process remembers in each of two generations.
REMEMBERED = 150_000

# Characters whose handling is the same in every version of Unicode: texts made of
# these are split here, all others by the tokenizer itself.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-įı-ɏ]*\Z")
def _classes() -> np.ndarray:
    """White space 0, letter 1, number 2, other 3, of the characters that ``_PLAIN`` allows."""
    kinds = np.full(0x250, 3, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        kinds[c] = 0 if ch.isspace() and c not in range(0x1C, 0x20) else 1 if ch.isalpha() else 2 if ch.isnumeric() else 3
    return kinds


_CLASS = _classes()
#: What follows an apostrophe that begins a word of its own (fixed values of the tokenizer's pattern).
_AFTER_APOSTROPHE = ("s", "t", "m", "d", "re", "ve", "ll")
_MIX = np.random.default_rng(8).integers(1 << 63, size=0x250, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of lower-cased plain text, as the tokenizer splits it: letters together, numbers one by
    one, anything else together, and some endings with the apostrophe before them."""
    kind = _CLASS[codes]
    before = np.concatenate([[0], kind[:-1]])
    begins = (kind > 0) & ((kind != before) | (kind == 2))
    quotes = np.flatnonzero(begins & (codes == 0x27))
    if len(quotes):
        padded = np.concatenate([codes, [0, 0, 0]])
        for ending in _AFTER_APOSTROPHE:
            n = len(ending)
            at = quotes[np.all([padded[quotes + 1 + j] == ord(ch) for j, ch in enumerate(ending)], axis=0)]
            begins[at + 1] = False
            rest = at + 1 + n
            rest = rest[rest < len(codes)]
            begins[rest[kind[rest] == 1]] = True
            quotes = np.setdiff1d(quotes, at, assume_unique=True)
    edges = np.flatnonzero(begins | (kind == 0))
    first = np.flatnonzero(begins)
    at = np.searchsorted(edges, first, "right")
    return first, np.concatenate([edges, [len(codes)]])[at]


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (_BASE, _BACK))


def alike(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct words, the place of one of each; for all words, which of those they equal.

    Words are told apart by a polynomial hash, and every word is then compared with its
    representative, so equal means equal.
    """
    power, inverse = _powers(1 << max(20, len(codes).bit_length()))
    sums = _MIX[codes]
    sums *= power[: len(codes)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sums)])
    hashes = (sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)
    _, of, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - first
    # Places are 32-bit: a slice of text is far smaller, and one text has at most 2**31 bytes.
    inner = np.arange(size.sum(), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    here, twin = (np.repeat(x.astype(np.int32), size) + inner for x in (first, first[of][which]))
    same = np.array_equal(size, size[of][which]) and np.array_equal(codes[here], codes[twin])
    return (of, which) if same else (np.arange(len(first)), np.arange(len(first)))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer never merges across the words it splits a text into, so the ids of a
    text are those of its words, and each distinct word is encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. They are encoded as one text, which is cheaper, and told apart by their last tokens."""
        ids = np.frombuffer(self.whole([" ".join(words)])[0], "<u4")
        ends = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
        if len(ends) != len(words) + 1 or ends[-1] != len(ids):
            return self.whole(words)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in pairwise(ends)]

    def splits(self, text: str) -> bool:
        """Whether the text is split here: known characters, and no special token in it."""
        return bool(_PLAIN.match(text)) and not any(t in text for t in self.special)

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; what goes on occurring is remembered."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, words))
        fresh = []
        for i in (i for i, x in enumerate(found) if x is None):
            if (ids := older.get(words[i])) is not None:
                known[words[i]] = found[i] = ids
            else:
                fresh.append(i)
        for k in range(0, len(fresh), 1_000):
            part = fresh[k : k + 1_000]
            for i, ids in zip(part, self.words([words[i] for i in part]), strict=True):
                known[words[i]] = found[i] = ids
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if t and self.splits(t)]
        out = [b"" if not t else None for t in texts]
        if plain:
            # All plain texts as one, with a space between; a text's words are those up to its end.
            flat = "\n".join([texts[i] for i in plain]).lower()
            codes = np.frombuffer(flat.encode("utf-32-le"), "<u4")
            first, end = split(codes)
            of, which = alike(codes, first, end)
            ids = self.ids_of([flat[a:b] for a, b in zip(first[of].tolist(), end[of].tolist(), strict=True)])
            size = np.array([len(x) // 4 for x in ids], np.int64)
            all_ids = np.frombuffer(b"".join(ids), "<u4")
            begin = (np.cumsum(size) - size)[which]
            size = size[which]
            made = all_ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
            upto = np.concatenate([[0], np.cumsum(size)])
            edges = np.cumsum([len(texts[i]) + 1 for i in plain])
            last = upto[np.searchsorted(first, edges)]
            for i, a, b in zip(plain, [0, *last[:-1].tolist()], last.tolist(), strict=True):
                out[i] = made[4 * a : 4 * b]
        return [self.whole([t])[0] if x is None else x for t, x in zip(texts, out, strict=True)]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for a worker process, so that its tasks share the vocabulary and the words it knows."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each piece of each document: its place, length and crc32; only documents over ``capacity`` are cut."""

    def make():
        encoder = _encoder(path)
        closing = np.array([CLOSING], "<u4").tobytes()

        def call(texts, _):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids += closing
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            return {"@": rows, "piece": piece, "start": start, "length": length, "ids_crc32": crc}

        return call

    return map_texts(docs, make, "piece int, start long, length long, ids_crc32 long", keep)


def best_two_fit(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in count.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    while True:
        live = np.flatnonzero(left)
        if not len(live):
            return out
        own = left.copy()  # what is left while this bin is being filled
        bin_, gap = [], capacity
        while gap > 0:
            i = np.searchsorted(live, gap, "right") - 1
            while i >= 0 and not own[live[i]]:
                i -= 1
            if i < 0:
                break
            bin_.append(int(live[i]))
            own[live[i]] -= 1
            gap -= int(live[i])
        if gap and len(bin_) > 1:
            small = bin_[-1]
            own[small] += 1
            pair = _best_pair(own, live, small, gap + small)
            if pair:
                bin_[-1:] = pair
        uses = np.bincount(bin_, minlength=capacity + 1)
        kinds = np.flatnonzero(uses)
        times = int((left[kinds] // uses[kinds]).min())
        left[kinds] -= times * uses[kinds]
        out.append((tuple(sorted(bin_, reverse=True)), times))


def _best_pair(own: np.ndarray, live: np.ndarray, small: int, room: int) -> list[int] | None:
    """Two lengths with the largest sum over ``small`` and at most ``room``; None if no pair is tighter."""
    fit = live[(live < room) & (own[live] > 0)]
    if not len(fit):
        return None
    j = np.searchsorted(fit, room - fit, "right") - 1  # the longest partner of each
    same = (j >= 0) & (fit[j] == fit) & (own[fit] < 2)
    j = np.where(same, j - 1, j)
    ok = j >= 0
    if not ok.any():
        return None
    sums = np.where(ok, fit + fit[np.maximum(j, 0)], 0)
    k = int(sums.argmax())
    if sums[k] <= small:
        return None
    return [int(fit[k]), int(fit[j[k]])]


def pack(found: DataFrame, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pieces with their sequence and their offset in it; they (no texts) are kept in the shared folder meanwhile."""
    names = [*keep, "piece", "start", "length", "ids_crc32"]
    # Rows get a number of their own before they are kept: it deals equal rows over the parts, and stays as it is.
    found = cut(found.select(*names, F.monotonically_increasing_id().alias("_row")))
    count = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most one row for each length
    parts_of = {n: max(-(-c // PART_ROWS), min(FEW_PARTS, -(-c // FEW_ROWS))) for n, c in count.items()}
    parts = found.sparkSession.createDataFrame(list(parts_of.items()), "length long, _parts int")
    dealt = found.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    before: dict[int, np.ndarray] = {}  # of each part of a length: pieces of that length in earlier parts
    for r in dealt.groupBy("length", "_part").count().collect():
        before.setdefault(r[0], np.zeros(parts_of[r[0]] + 1, np.int64))[r[1] + 1] = r[2]
    before = {n: x.cumsum() for n, x in before.items()}
    # Each length of a pattern takes a run of ranks: first rank, first sequence, offset, uses of the pattern.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in best_two_fit(count, capacity):
        offset = 0
        for length, same in groupby(lengths):
            n = len(list(same))
            runs.setdefault(length, []).append((used.get(length, 0), sequence, offset, times))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    table_of = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}
    shared = found.sparkSession.sparkContext.broadcast((table_of, before))
    order = Window.partitionBy("length", "_part").orderBy(*keep, "piece", "ids_crc32", "_row")
    ranked = dealt.withColumn("_n", F.row_number().over(order)).select(*names, "_part", "_n")

    def run(batches):
        places, before = shared.value
        for batch in batches:
            length, part, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_part", "_n"))
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            order = np.argsort(length, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(length[order])) + 1).tolist(), len(order)]
            for a, b in pairwise(edges):
                if a == b:
                    continue
                rows = order[a:b]
                own = int(length[rows[0]])
                first, sequence, offset, times = places[own]
                rank = before[own][part[rows]] + n[rows] - 1
                i = np.searchsorted(first, rank, "right") - 1
                nth, use = np.divmod(rank - first[i], times[i])
                seq[rows] = sequence[i] + use
                off[rows] = offset[i] + nth * own
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema)
    return ranked.mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokenizes, cuts and packs."""
    return pack(pieces(docs, path or tokenizer_path(), capacity, keep), capacity, keep)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
