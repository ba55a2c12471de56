"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Document statistics are standardised and mapped to cosines of random projections,
which approximate a Gaussian kernel. Every partition of the labelled sample sums its
own normal equations for each fold; the sums are added and solved. Out-of-fold scores
(weights from all other folds) calibrate the final ones.

Defined results: a null text scores as an empty one; without usable labels of both
classes the score is the labels' rate (0.5 without any); documents of a null id are
scored and never held out; repeated rows get equal scores; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, map_texts, table
from .learn import Isotonic, ridge
from .samples import FOLDS, labelled
from .text_stats import STATISTICS, statistics

FEATURES = 256
BANDWIDTH = 4.0
PENALTY = 1.0
CUT = 0.3


@dataclass
class Fourier:
    """cos(xW + b) of standardised statistics, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    features: int = FEATURES
    seed: int = 5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(self.seed)
        w = draw.normal(0, 1 / BANDWIDTH, (x.shape[1], self.features))
        b = draw.uniform(0, 2 * np.pi, self.features)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / self.features) * np.cos(z @ w + b), np.ones((len(x), 1))])


@dataclass
class QualityModel:
    fourier: Fourier
    weights: np.ndarray
    calibrate: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrate(self.fourier(x) @ self.weights)


def _measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def make():
        return lambda texts, _: {"stats": [statistics(t) for t in texts]}

    return map_texts(docs, make, "stats array<double>", keep)


def normal_equations(sample: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrices and moments of each fold, summed by partition; the sample's bound bounds the partitions.

    The partial sums are added in the cluster by matrix row, so the driver gets one
    matrix a fold.
    """
    size = fourier.features + 1

    def run(batches):
        gram, moment = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            y = batch.column("label").to_numpy(zero_copy_only=False)
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            z = fourier(x)
            for k in range(FOLDS):
                gram[k] += z[of == k].T @ z[of == k]
                moment[k] += z[of == k].T @ y[of == k]
        rows = np.concatenate([gram, moment[:, :, None]], axis=2).reshape(FOLDS * size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v"), strict=True):
                v = v.values.to_numpy()
                total[i] = total[i] + v if i in total else v
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "v"])

    parts = sample.coalesce(8).mapInArrow(run, "i int, v array<double>").repartition(8, "i")
    out = np.zeros((FOLDS * size, size + 1))
    for r in parts.mapInArrow(add, "i int, v array<double>").collect():
        out[r["i"]] = r["v"]
    out = out.reshape(FOLDS, size, size + 1)
    return out[:, :, :-1], out[:, :, -1]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held: int = 0) -> QualityModel:
    sample = cut(_measured(labelled(docs, labels, label, parts, held), ("label", "fold")))
    rows = sample.agg(
        F.count("*").alias("n"),
        F.array(*(F.coalesce(F.avg(F.get("stats", F.lit(i))), F.lit(0.0)) for i in range(len(STATISTICS)))).alias("mean"),
        F.array(*(F.coalesce(F.stddev_pop(F.get("stats", F.lit(i))), F.lit(1.0)) for i in range(len(STATISTICS)))).alias("scale"),
    ).first()
    scale = np.array(rows["scale"])
    fourier = Fourier(np.array(rows["mean"]), np.where(scale > 1e-9, scale, 1.0))
    if not rows["n"]:
        return QualityModel(fourier, np.zeros(fourier.features + 1), Isotonic(np.zeros(1), np.full(1, 0.5)))
    gram, moment = normal_equations(sample, fourier)
    weights = ridge(gram.sum(0), moment.sum(0), PENALTY)
    others = np.stack([ridge(gram.sum(0) - gram[k], moment.sum(0) - moment[k], PENALTY) for k in range(FOLDS)])

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(batch.num_rows, -1)
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            score = np.einsum("ij,ij->i", fourier(x), others[of]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column("label")], names=["score", "label"])

    pairs = sample.mapInArrow(run, "score double, label int").toPandas()  # bounded by the sample
    return QualityModel(fourier, weights, Isotonic.fit(pairs["score"].to_numpy(), pairs["label"].to_numpy()))


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model: QualityModel = shared.value

        def call(texts, _):
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), -1)
            return {"score": pa.array(model.score(x))}

        return call

    return map_texts(docs, make, "score double", keep)


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
