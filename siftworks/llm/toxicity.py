"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings (``stem*``) that more toxic than
clean labelled documents hold, ordered by a likelihood-ratio test on document counts.
Features are lexicon densities by tier, nearness of hits to second-person words,
capitals, punctuation and obfuscation rates. Rows of the labelled sample get features
from a lexicon learned without their own fold, and the trees' out-of-fold margins
calibrate the scores.

Defined results: a null text scores as an empty one; without labels of both classes
the score is the labels' rate (0.5 without any); equal texts count once when the
lexicon is learned; equal gains go by the entry; a null id is scored and never held out; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fold, map_texts, slices, table
from .learn import Isotonic, Trees
from .samples import FOLDS, labelled
from .text_stats import class_counts

CUT = 0.3
#: Entries of a lexicon, and its tiers by rank.
ENTRIES, TIERS = 256, (16, 64, 256)
#: Lengths of word beginnings that a lexicon may hold.
STEMS = (4, 5, 6)
#: Toxic documents that an entry must occur in, and the logarithm of its rate in toxic over that in clean documents.
SUPPORT, LEAST_WEIGHT = 3, 1.0
#: Words between a hit and a second-person word that still count as near.
NEAR = 5

_WORD = re.compile(r"[^\W\d_]+")
#: Letter runs with a digit or sign amid them, as in l0ser or st*pid.
#: A run is tried once, from its beginning, so long runs take linear time.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0134579@$!*]++[^\W\d_]++)+")
_SPELT = re.compile(r"\b(?:[^\W\d_][ ._*-]){3,}[^\W\d_]\b")
_PLAIN = str.maketrans("0134579@$!", "oieastgasi")
#: Second-person words of the languages at hand (fixed values).
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te ton ta tes vous votre vos toi tú ti usted ustedes vosotros tus su".split())

FEATURES = ("tier_16", "tier_64", "tier_256", "hits", "strongest", "weight", "weight_rate", "near_second_person", "second_person", "upper", "digit", "stop", "symbol", "other_punct", "exclaim", "masked", "spelt", "log_words")


def plain_words(text: str) -> tuple[list[str], int, int]:
    """Lower-cased words with masked letters put back, and how many words were masked or spelt out."""
    low = text.lower()
    words = _WORD.findall(low)
    masked = [m for m in _MASKED.findall(low)]
    spelt = _SPELT.findall(low) if masked or "." in low or "-" in low or "*" in low or "_" in low else []
    words += [m.translate(_PLAIN).replace("*", "") for m in masked]
    words += [re.sub(r"[ ._*-]", "", m) for m in spelt]
    return words, len(masked), len(spelt)


def keys_of(words: set[str]) -> set[str]:
    out = set(words)
    for w in words:
        for n in STEMS:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


def features(text: str | None, lexicon: dict[str, tuple[float, int]]) -> list[float]:
    """The numbers named in ``FEATURES``. ``lexicon``: entry to (weight, rank)."""
    if not text:
        return [0.0] * len(FEATURES)
    words, masked, spelt = plain_words(text)
    n = max(1, len(words))
    hit: dict[str, tuple[float, int]] = {}
    for w in set(words):
        best = lexicon.get(w)
        for k in STEMS:
            if len(w) > k and (e := lexicon.get(w[:k] + "*")) and (best is None or e[1] < best[1]):
                best = e
        if best:
            hit[w] = best
    tiers = [0.0] * len(TIERS)
    weight = strongest = near = total = 0.0
    if hit:
        person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        at = [i for i, w in enumerate(words) if w in hit]
        total = len(at)
        for i in at:
            e = hit[words[i]]
            for j, top in enumerate(TIERS):
                tiers[j] += e[1] < top
        weight = sum(e[0] for e in hit.values())
        strongest = max(e[0] for e in hit.values())
        if person:
            p = np.array(person)
            j = np.searchsorted(p, at)
            gap = np.minimum(np.abs(p[np.minimum(j, len(p) - 1)] - at), np.abs(p[np.maximum(j - 1, 0)] - at))
            near = float((gap <= NEAR).sum()) / n
    classes = class_counts(text) / max(1, len(text))
    return [
        *(100 * t / n for t in tiers), total, strongest, weight, 100 * weight / n, 100 * near, 100 * sum(w in SECOND_PERSON for w in words) / n,
        classes[1], classes[2], classes[4], classes[5], classes[6], text.count("!") / len(text), 100 * masked / n, 100 * spelt / n, float(np.log1p(len(words))),
    ]


def _counted(sample: DataFrame) -> DataFrame:
    """Per key: documents of each fold, toxic (t0 ...) and clean (c0 ...). Equal texts count once."""
    once = sample.groupBy(F.xxhash64("text").alias("k"), F.md5("text").alias("m")).agg(F.min_by(F.struct("text", "label", "fold"), "doc_id").alias("r"))
    names = [f"{x}{k}" for x in "tc" for k in range(FOLDS)]

    def sums(total):
        columns = list(zip(*total.values(), strict=True)) if total else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(total, pa.string()), *(pa.array(c, pa.int32()) for c in columns)], names=["key", *names])

    def run(batches):
        total: dict[str, list[int]] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                if len(total) > 100_000:  # partial sums may go out at any time
                    yield sums(total)
                    total = {}
                for text, label, of in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                    at = of if label else FOLDS + of
                    for key in keys_of(set(plain_words(text or "")[0])):
                        row = total.get(key)
                        if row is None:
                            row = total[key] = [0] * (2 * FOLDS)
                        row[at] += 1
        yield sums(total)

    rows = once.select("r.text", "r.label", "r.fold").mapInArrow(run, "key string, " + ", ".join(f"{n} int" for n in names))
    return rows.groupBy("key").agg(*(F.sum(n).cast("long").alias(n) for n in names))


def lexicons(counted: DataFrame, docs: np.ndarray) -> list[dict[str, tuple[float, int]]]:
    """Entry to (weight, rank) of a lexicon without each fold, and of one with all of them last.

    ``docs``: documents of each fold, toxic then clean. The gain of every key is worked out
    in the cluster, by likelihood ratio; only the best of each lexicon come to the driver.
    """
    made = []
    for out in (*range(FOLDS), None):
        folds = [k for k in range(FOLDS) if k != out]
        sums = {"t": sum((F.col(f"t{k}") for k in folds), F.lit(0)), "c": sum((F.col(f"c{k}") for k in folds), F.lit(0))}
        sizes = {"nt": F.lit(int(sum(docs[k] for k in folds))), "nc": F.lit(int(sum(docs[FOLDS + k] for k in folds)))}
        made.append(F.struct(F.lit(len(made)).alias("i"), *(c.alias(n) for n, c in (sums | sizes).items())))
    t, c, nt, nc = map(F.col, ("t", "c", "nt", "nc"))
    rows = counted.select("key", F.explode(F.array(*made)).alias("e")).select("key", "e.*").where((t >= F.least(F.lit(SUPPORT), nt)) & (nt > 0) & (nc > 0))
    rows = rows.withColumns({"p": (t + 0.5) / (nt + 1), "q": (c + 0.5) / (nc + 1), "m": (t + c + 1) / (nt + nc + 2)}).withColumn("weight", F.log(F.col("p") / F.col("q")))
    entropy = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    gain = entropy(t, nt, F.col("p")) + entropy(c, nc, F.col("q")) - entropy(t, nt, F.col("m")) - entropy(c, nc, F.col("m"))
    rows = rows.where(F.col("weight") > LEAST_WEIGHT).select("i", "key", "weight", gain.alias("gain"))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("gain"), "key"))).where(F.col("n") <= ENTRIES)
    found: list[dict[str, tuple[float, int]]] = [{} for _ in made]
    for r in best.select("i", "key", "weight", "n").collect():
        found[r["i"]][r["key"]] = (r["weight"], r["n"] - 1)
    return found


@dataclass
class ToxicityModel:
    lexicon: dict[str, tuple[float, int]]
    trees: Trees
    calibrate: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrate(self.trees.margin(x))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2) -> ToxicityModel:
    sample = cut(labelled(docs, labels, label, parts, held).where("text is not null"))
    sizes = {(r["label"], r["fold"]): r["count"] for r in sample.groupBy("label", "fold").count().collect()}
    n = np.array([sizes.get((1 - i // FOLDS, i % FOLDS), 0) for i in range(2 * FOLDS)])
    found = lexicons(_counted(sample), n)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def make():
        lexicons = shared.value

        def call(texts, batch):
            of = batch.column("fold").to_pylist()
            return {"x": [features(t, lexicons[k]) for t, k in zip(texts, of, strict=True)]}

        return call

    entries = found[-1]
    found = map_texts(sample, make, "x array<double>", ("label", "fold")).toPandas()  # bounded by the sample
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    y, of = found["label"].to_numpy(float), found["fold"].to_numpy()
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (of == k).any():
            margin[of == k] = Trees().fit(x[of != k], y[of != k]).margin(x[of == k])
    return ToxicityModel(entries, Trees().fit(x, y), Isotonic.fit(margin, y))


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model: ToxicityModel = shared.value

        def call(texts, _):
            x = np.array([features(t, model.lexicon) for t in texts], float).reshape(len(texts), -1)
            return {"score": pa.array(model.score(x))}

        return call

    return map_texts(docs, make, "score double", keep)


def op9_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
