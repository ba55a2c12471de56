"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed greedily
into the longest phrases that a language's automaton accepts; phrases times the
bits of a pointer into the reference, per character, estimate the cross entropy.
The language with the least wins.

All texts of a batch are parsed in step: they are cut into equal blocks, and one numpy
operation moves all blocks by one character. A block's parse begins at its first
character, and is then begun anew where the block before it really ends its last phrase,
until both parses meet, as they soon do. So the phrases are those of one parse of the
whole text, whatever the blocks.

Defined results: a null text and a text without letters are ``und`` with score 0;
so is every text when nothing can be learned; on equal entropy the least language
name wins; rows of null language or null id teach nothing; of several texts of one id
and language the least teaches; repeated rows get equal results; extra columns are not
read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fold, map_texts, table

#: The bounds of the labelled sample: languages of most documents, documents of least hash of each, characters of a
#: language in all, and characters from one document, which start at a place chosen by hash.
LANGUAGES, DOCUMENTS, CHARACTERS, PER_DOCUMENT = 1_000, 128, 40_000, 2_048
#: Characters of all languages together; more than 75 languages share them.
ALL_CHARACTERS = 3_000_000
#: Bytes that the dense tables of a worker take at most; what would be over that is kept as sorted edges (36 bytes a character).
DENSE_BYTES = 192 << 20
#: Characters of a block. No result depends on it.
BLOCK = 1_024
#: Text bytes that are parsed in step; fewer would leave numpy little to do at once.
PARSED_BYTES = 8 << 20


def normalised(text: str) -> np.ndarray:
    """Lower-cased letters as code points; each run of anything else is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    low = codes < 0x250
    letter = np.zeros(len(codes), bool)
    letter[low] = _LOW[codes[low]]
    if not low.all():
        kinds, inverse = np.unique(codes[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in kinds])[inverse]
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return codes[keep]


_LOW = np.array([chr(c).isalpha() for c in range(0x250)])


class Automaton:
    """The suffix automaton of some texts: state and column to state, 0 for none.

    A small alphabet makes a dense table. One that would take more than ``dense_bytes`` is kept as its sorted
    edges, of which there are at most three a character: slower to look up, with the same results.
    """

    def __init__(self, texts: list[np.ndarray], dense_bytes: int = 1 << 26) -> None:
        letters = np.unique(np.concatenate([*texts, np.array([32])]))
        self.letters = letters
        self.size = int(sum(map(len, texts)))
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for text in texts:
            last = 0
            for c in np.searchsorted(letters, text).tolist():
                # The usual online construction, also right when a text restarts at the root.
                if c in step[last]:
                    q = step[last][c]
                    if length[q] == length[last] + 1:
                        last = q
                        continue
                    clone = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[last] + 1)
                    link[q] = clone
                    p = last
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    last = clone
                    continue
                new = len(step)
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    if length[q] == length[p] + 1:
                        link[new] = q
                    else:
                        clone = len(step)
                        step.append(dict(step[q]))
                        link.append(link[q])
                        length.append(length[p] + 1)
                        link[q] = link[new] = clone
                        while p >= 0 and step[p].get(c) == q:
                            step[p][c] = clone
                            p = link[p]
                last = new
        self.width = len(letters) + 1  # the last column is for letters the language has not
        number = sum(map(len, step))
        key = np.fromiter((s * self.width + c for s, moves in enumerate(step) for c in moves), np.int64, number)
        target = np.fromiter((t for moves in step for t in moves.values()), np.int32, number)
        self.dense = len(step) * self.width * 4 <= min(dense_bytes, (1 << 31) - 1)
        if self.dense:
            self.table = np.zeros(len(step) * self.width, np.int32)
            self.table[key] = target * self.width  # states are kept as offsets into the table
        else:
            order = np.argsort(key)
            self.keys, self.targets = key[order], target[order]

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The state after each one's next letter, 0 where there is none."""
        if self.dense:
            return self.table[state + column]
        key = state.astype(np.int64) * self.width + column
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], 0)

    def nbytes(self) -> int:
        return self.table.nbytes if self.dense else self.keys.nbytes + self.targets.nbytes

    def columns(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, self.width - 1).astype(np.int32)

    def phrases(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Phrases of each text ``codes[begin:end]``; texts are in order and adjoin."""
        columns = self.columns(codes)
        marks = np.zeros(len(codes) + 1, bool)  # where a phrase begins, by the parse so far
        blocks = -(-(end - begin) // BLOCK)
        text = np.repeat(np.arange(len(begin)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = begin[text] + BLOCK * nth
        last = np.minimum(first + BLOCK, end[text])
        leaves = self._parsed(columns, marks, first, last, end[text])
        later = np.flatnonzero(nth > 0)
        while True:
            enters = leaves[later - 1]
            # Blocks whose parse doesn't begin where the block before ends its last phrase; a phrase may span blocks.
            spanned = enters >= last[later]
            leave = np.where(spanned, enters, leaves[later])
            wrong = ~spanned & ~marks[enters]
            stale = spanned | wrong | (enters > first[later])
            for k, e in zip(later[stale], np.minimum(enters, last[later])[stale], strict=True):
                marks[first[k] : e] = False
            again = later[wrong]
            if len(again):
                leave[wrong] = self._parsed(columns, marks, enters[wrong], last[again], end[text[again]], leaves[again])
            if (leave == leaves[later]).all():
                break
            leaves[later] = leave
        counted = np.concatenate([[0], np.cumsum(marks[:-1])])
        return counted[end] - counted[begin]

    def _parsed(self, columns, marks, at, last, end, left=None) -> np.ndarray:
        """Marks the phrases of blocks parsed from ``at`` on; returns where the first phrase past ``last`` begins (at most
        the text's end). With ``left``, the ends of an earlier parse, a parse stops where it meets that one."""
        out = np.array(end, np.int64)
        lane, pos, state = np.arange(len(at)), at.astype(np.int64), np.zeros(len(at), np.int32)
        while len(lane):
            live = pos < end
            if not live.all():
                lane, pos, state, last, end = (x[live] for x in (lane, pos, state, last, end))
            c = columns[pos]
            following = self.step(state, c)
            missed = following == 0
            fresh = missed | (state == 0)  # a phrase begins; an unknown letter is one of its own
            stop = fresh & (pos >= last)
            out[lane[stop]] = pos[stop]
            if left is not None:
                met = fresh & ~stop & marks[pos]
                out[lane[met]] = left[lane[met]]
                stop |= met
                marks[pos[~fresh & (pos < last)]] = False
            state = np.where(missed, self.step(np.zeros_like(state), c), following)
            if stop.any():
                marks[pos[fresh & ~stop]] = True
                go = ~stop
                lane, pos, state, last, end = (x[go] for x in (lane, pos, state, last, end))
            else:
                marks[pos[fresh]] = True
            pos = pos + 1
        return out


@lru_cache(1)
def _automata(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> list[tuple[str, Automaton]]:
    each = DENSE_BYTES // max(1, len(samples))
    return [(lang, Automaton([normalised(t) for t in texts], each)) for lang, texts in samples]


def parse(texts: list[str | None], automata: list[tuple[str, Automaton]]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    codes = [normalised(t) if t else np.empty(0, np.int64) for t in texts]
    length = np.array([len(c) for c in codes])
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not automata or not length.any():
        return names, scores
    flat = np.concatenate(codes)
    first = np.cumsum(length) - length
    bits = np.stack([np.log2(a.size + 2) * a.phrases(flat, first, first + length) for _, a in automata], axis=1)
    best = bits.argmin(axis=1)  # names are in order, so the least wins a tie
    # Chance of the best language if each bit of difference counted a quarter, as phrases overlap.
    chance = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / 4).sum(axis=1)
    for i in np.flatnonzero(length):
        names[i], scores[i] = automata[best[i]][0], float(chance[i])
    return names, scores


def learn(docs: DataFrame, parts: int = 5, held: int = 0) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Sample texts of each language from labelled rows outside the held-out fold; at most the sample's bounds come to the driver."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(fold("doc_id", parts) != held)
    ids = rows.select("lang", "doc_id").distinct()
    langs = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    chosen = ids.join(F.broadcast(langs), "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= DOCUMENTS)
    chosen = cut(chosen.select("doc_id", "lang"))  # at most LANGUAGES times DOCUMENTS rows
    room = F.greatest(F.length("text") - PER_DOCUMENT, F.lit(0)) + 1
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit(4)), room.cast("long")).cast("int")
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    once = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # repeats are combined before the exchange
    found: dict[str, list[tuple[int, str]]] = {}
    for r in once.select("lang", F.xxhash64("doc_id", F.lit(3)).alias("h"), F.col("text").substr(place, F.lit(PER_DOCUMENT)).alias("t")).collect():
        found.setdefault(r["lang"], []).append((r["h"], r["t"]))
    out = []
    for lang, held_texts in sorted(found.items()):
        each = max(1, min(CHARACTERS, ALL_CHARACTERS // len(found)) // len(held_texts))
        kept = tuple(t[:each] for _, t in sorted(held_texts) if any(c.isalpha() for c in t[:each]))
        if kept:
            out.append((lang, kept))
    return tuple(out)


def identify(docs: DataFrame, samples: tuple[tuple[str, tuple[str, ...]], ...], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # texts of bounded size; each worker builds the automata once

    def make():
        automata = _automata(shared.value)

        def call(texts, _):
            names, scores = parse(texts, automata)
            return {"lang_pred": names, "score": pa.array(scores, pa.float64())}

        return call

    return map_texts(docs, make, "lang_pred string, score double", keep, slice_bytes=PARSED_BYTES)


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
