"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram over a language's
common words are compared with that language's references by Jensen-Shannon distance.
The references are averages over all documents that pass the base rules: characters by
class, and the words that most documents of the language use. A document is rejected if
it is too far from its reference and long enough to tell. What chance alone makes of a
text of its length, and of a reference of that many words, is added to the distance
allowed; a language's character classes are averaged with those of all documents, which
weigh as much as ten of its own. So a language of few documents has a reference that
tells little and rejects little, at every size by the same rule.

Defined results: a null text has no words and fails the base rules; a document without
a language is held against the references of the ``LANGUAGES`` most common languages and the
nearest counts; one whose language has no passing document is held against the character classes of
all documents alone; without any reference the base rules decide alone; repeated rows get equal results; extra columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_texts, slices, table, words_of
from .text_stats import CLASSES, SYMBOLS, class_counts, duplicate_lines, repeated_words, split_words

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
#: Common words of a reference.
COMMON = 64
#: Documents of a language that the mean of all documents weighs as much as.
POOLED = 10
#: Languages of most documents whose references are broadcast (1,000: 6 MB); documents of others are joined with theirs.
LANGUAGES = 1_000
#: A document is rejected if a Jensen-Shannon distance (base 2, 0 to 1) is over this and what
#: chance alone makes of a text of its length.
FAR_CLASSES, FAR_WORDS = 0.25, 0.10
#: Shorter documents are not judged by the histogram: characters, and words.
GUARD_CHARS, GUARD_WORDS = 100, 80


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of ``p`` to ``q``; both sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def by_chance(cells: int, draws: int) -> float:
    """About the distance of ``draws`` independent draws to the distribution over ``cells`` that they come from."""
    return math.sqrt(cells / (8 * math.log(2) * draws))


@dataclass
class Reference:
    """Mean share of each character class, common words, their mean shares (rest last), and words it was made from."""

    classes: np.ndarray
    words: list[bytes]
    shares: np.ndarray
    size: int


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    if not text:
        return 0, 0, 0, 0, 0, True
    words = split_words(text)
    repeated = repeated_words(words)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, duplicate_lines(text), repeated, fails(words, repeated)


def fails(words: list[str], repeated: int) -> bool:
    return len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)


class References(dict):
    """A reference for each of the most common languages, and one of all documents' character classes under None (no words).

    ``others``: the rows that other languages' references are made of, by language (lang, rows), or None; ``mean``: the
    documents' mean share of each class.
    """

    others: DataFrame | None = None
    mean: np.ndarray | None = None


ROWS = "array<struct<kind:int,word:binary,share:double,n:int>>"


def _reference(found: list, mean: np.ndarray) -> Reference:
    """The reference that a language's rows make: class sums (kind from 0), its documents and words, and common words (kind -1)."""
    classes_n = len(CLASSES)
    sums_ = {r["kind"]: r["share"] for r in found if r["kind"] >= 0}
    n = sums_[classes_n]
    common = sorted((r for r in found if r["kind"] < 0), key=lambda r: r["n"])
    shares = np.array([r["share"] / n for r in common])
    kinds = np.array([sums_.get(i, 0.0) for i in range(classes_n)]) + POOLED * mean
    return Reference(kinds / kinds.sum(), [bytes(r["word"]) for r in common], np.append(shares, max(0.0, 1 - shares.sum())), int(sums_[classes_n + 1]))


def references(docs: DataFrame) -> References:
    """What documents are held against, made of all that pass the base rules."""
    classes_n = len(CLASSES)

    def run(batches):
        total: dict[str, dict[bytes, list[float]]] = {}
        classes: dict[str, np.ndarray] = {}
        size = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if not text or lang is None:
                        continue
                    split = split_words(text)
                    if len(split) < LEAST_WORDS or fails(split, repeated_words(split)):
                        continue
                    held = classes.get(lang)
                    if held is None:
                        held = classes[lang] = np.zeros(classes_n + 2)
                    words = words_of(text)
                    held[:-2] += class_counts(text) / len(text)
                    held[-2:] += 1, len(words)
                    own = total.setdefault(lang, {})
                    size -= len(own)
                    part = 1 / max(1, len(words))
                    for w, n in Counter(words).items():
                        row = own.get(w)
                        if row is None:
                            own[w] = [1, n * part]
                        else:
                            row[0] += 1
                            row[1] += n * part
                    size += len(own)
                    if size > 300_000:  # partial sums may go out at any time
                        yield sums(total, {})
                        total, size = {}, 0
        yield sums(total, classes)

    def sums(total, classes):
        lang = [*(k for k, v in total.items() for _ in v), *(k for k, v in classes.items() for _ in v)]
        word = [*(w for v in total.values() for w in v), *(None for v in classes.values() for _ in v)]
        rows = [r for v in total.values() for r in v.values()]
        kind = [*(-1 for _ in rows), *(i for v in classes.values() for i in range(len(v)))]
        docs_ = [*(r[0] for r in rows), *(0 for v in classes.values() for _ in v)]
        share = [*(r[1] for r in rows), *(float(x) for v in classes.values() for x in v)]
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(kind, pa.int32()), pa.array(docs_, pa.int64()), pa.array(share, pa.float64())],
            names=["lang", "word", "kind", "docs", "share"],
        )

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, word binary, kind int, docs long, share double")
    rows = rows.groupBy("lang", "kind", "word").agg(F.sum("docs").alias("docs"), F.sum("share").alias("share"))
    # The words of most documents, and the few rows of class sums; ranks are limited before the exchange.
    order = Window.partitionBy("lang").orderBy(F.col("kind") < 0, F.col("docs").desc(), "word")
    top = cut(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= COMMON + classes_n + 2))
    pooled = {r["kind"]: r["share"] for r in top.where(F.col("kind").between(0, classes_n)).groupBy("kind").agg(F.sum("share").alias("share")).collect()}
    if not pooled:
        return References()
    mean = np.array([pooled.get(i, 0.0) for i in range(classes_n)]) / pooled[classes_n]
    ranked = top.where(F.col("kind") == classes_n).orderBy(F.desc("share"), "lang")
    kept = [r["lang"] for r in ranked.limit(LANGUAGES + 1).select("lang").collect()]
    more, kept = len(kept) > LANGUAGES, kept[:LANGUAGES]
    known = F.col("lang").isin(kept)
    by: dict[str, list] = {}
    for r in top.where(known).collect():
        by.setdefault(r["lang"], []).append(r)
    out = References({None: Reference(mean / mean.sum(), [], np.ones(1), 0)})
    out |= {lang: _reference(found, mean) for lang, found in sorted(by.items())}
    out.mean = mean
    if more:  # at most as many rows a language as it has classes and common words
        out.others = cut(top.where(~known).groupBy("lang").agg(F.collect_list(F.struct("kind", "word", "share", "n")).cast(ROWS).alias("rows")))
    return out


def judge(docs: DataFrame, refs: dict[str | None, Reference], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base columns, both distances (null where a guard holds) and the verdict."""
    others = getattr(refs, "others", None)
    if others is None:
        return _judged(docs, dict(refs), None, keep)
    common = F.col("lang").isNull() | F.col("lang").isin([k for k in refs if k is not None])
    rest = docs.where(~common).join(others.withColumnRenamed("rows", "_reference"), "lang", "left")
    return _judged(docs.where(common), dict(refs), None, keep).unionByName(_judged(rest, dict(refs), refs.mean, keep))


def _judged(docs: DataFrame, refs: dict[str | None, Reference], mean: np.ndarray | None, keep: tuple[str, ...]) -> DataFrame:
    """With ``mean``, a document's reference is made of the rows that it brings along (``_reference``)."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def make():
        refs = dict(shared.value)
        place = {lang: {w: i for i, w in enumerate(r.words)} for lang, r in refs.items()}
        every = [k for k in refs if k is not None] or list(refs)

        def distances(text: str, lang: str | None) -> tuple[float | None, float | None, bool]:
            kinds, words = class_counts(text), words_of(text)
            kinds = kinds / kinds.sum()
            best = (None, None, False)
            for i, k in enumerate(every if lang is None else [lang if lang in refs else None] if refs else []):
                ref = refs[k]
                a = float(jensen_shannon(kinds, ref.classes)) if len(text) >= GUARD_CHARS else None
                b = None
                if len(words) >= GUARD_WORDS and ref.size:
                    at = place[k]
                    p = np.bincount(np.fromiter((at.get(w, len(at)) for w in words), np.int64, len(words)), minlength=len(ref.shares)) / len(words)
                    b = float(jensen_shannon(p, ref.shares))
                if not i or (b or 0) + (a or 0) < (best[1] or 0) + (best[0] or 0):
                    far = a is not None and a > FAR_CLASSES + by_chance(len(CLASSES), len(text))
                    far |= b is not None and b > FAR_WORDS + by_chance(COMMON + 1, len(words)) + by_chance(COMMON + 1, ref.size)
                    best = (a, b, far)
            return best

        def call(texts, batch):
            if mean is not None:
                for lang, found in zip(batch.column("lang").to_pylist(), batch.column("_reference"), strict=True):
                    if lang not in refs and found.is_valid:
                        refs[lang] = _reference(found.as_py(), mean)
                        place[lang] = {w: i for i, w in enumerate(refs[lang].words)}
            rows = [base(t) for t in texts]
            far = [distances(t, lang) if t and not r[-1] else (None, None, True) for t, lang, r in zip(texts, batch.column("lang").to_pylist(), rows, strict=True)]
            out = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), map(list, zip(*rows, strict=True)), strict=True))
            out["class_distance"], out["word_distance"], failed = map(list, zip(*far, strict=True))
            out["kept"] = [not r[-1] and not f for r, f in zip(rows, failed, strict=True)]
            return out

        return call

    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return map_texts(docs, make, columns, keep, also=("lang",) if mean is None else ("lang", "_reference"))


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
