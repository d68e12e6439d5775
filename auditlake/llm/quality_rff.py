"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Random cosines of the standardised statistics approximate a Gaussian kernel.
Each partition sums its own normal equations; the sums are added up in a second
round and solved once.  Ridge scores of a separate fold, counted in bins, give
the isotonic curve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stored
from .stats import FEATURES, document_stats, matrix, one_label

COSINES = 256
WIDTH = 3.0
#: Score bins of the calibration, over -0.5 to 1.5.
BINS = 2048
#: Tasks that add up the partitions' normal equations.
ADDERS = 8


@dataclass
class Kernel:
    """Standardisation and the random projection; a function of the seed and the moments only."""

    mean: np.ndarray
    spread: np.ndarray
    seed: int = 7

    def __post_init__(self):
        random = np.random.default_rng(self.seed)
        self.weights = random.normal(0, 1 / WIDTH, (len(self.mean), COSINES))
        self.phase = random.uniform(0, 2 * np.pi, COSINES)

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -5, 5)
        return np.column_stack([np.sqrt(2 / COSINES) * np.cos(scaled @ self.weights + self.phase), scaled, np.ones(len(x))])


def isotonic(score: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing rates by pooling neighbours: (mean score, rate) of each pool."""
    pools: list[list[float]] = []
    for s, p, c in zip(score, positive, count, strict=True):
        pools.append([s * c, p, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([a / c for a, _, c in pools]), np.array([(p + 0.25) / (c + 0.5) for _, p, c in pools])


def _sums(kernel: Kernel):
    def run(batches):
        total = None
        for batch in batches:
            z = kernel.features(matrix(batch))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            part = np.column_stack([z.T @ z, z.T @ y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _add(batches):
    total = None
    for batch in batches:
        for raw in batch.column("sums").to_pylist():
            part = np.frombuffer(raw)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def solve(rows: DataFrame, kernel: Kernel, ridge: float = 1.0) -> np.ndarray:
    """Ridge coefficients from (features, label) rows; the driver gets ``ADDERS`` sums at most."""
    parts = rows.mapInArrow(_sums(kernel), "sums binary").repartition(ADDERS).mapInArrow(_add, "sums binary").collect()
    width = COSINES + len(FEATURES) + 1
    total = sum((np.frombuffer(r.sums).reshape(width, width + 1) for r in parts), np.zeros((width, width + 1)))
    return np.linalg.solve(total[:, :-1] + ridge * np.eye(width), total[:, -1])


def quality_scores(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Fold ``held`` (crc32 of the id modulo ``folds``) is never learned from; the
    next fold calibrates and the others fit.  The score is the calibrated chance
    of quality 1.  Null and empty texts have zero statistics and the score that
    these get; without any label all scores are one half.  Null ids belong to no
    fold.  Repeated rows get one result each, as do repeated ids with other texts.
    """
    stats = stored(document_stats(docs), "quality-stats")
    known = stats.join(one_label(labels, "quality", crc_mod("doc_id", folds) != held), "doc_id").withColumn("fold", crc_mod("doc_id", folds)).select("fold", "label", *FEATURES)
    known = stored(known, "quality-known")
    moments = known.agg(F.count("*").alias("n"), *(F.avg(f).alias(f"m_{f}") for f in FEATURES), *(F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES)).first()
    shape = "doc_id long, held_out boolean, score double, predicted int"
    flagged = stats.select("doc_id", F.col("doc_id").isNotNull().alias("has_id"), (crc_mod("doc_id", folds) == held).alias("held_out"), *FEATURES)
    if not moments.n:
        return flagged.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    kernel = Kernel(np.array([moments[f"m_{f}"] for f in FEATURES]), np.array([max(moments[f"s_{f}"], 1e-6) for f in FEATURES]))
    calibrating = F.col("fold") == (held + 1) % folds
    weights = solve(known.where(~calibrating), kernel)

    def binned(batches):
        for batch in batches:
            raw = kernel.features(matrix(batch)) @ weights
            code = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            count, positive = np.bincount(code, minlength=BINS), np.bincount(code, y, minlength=BINS)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(positive[some].astype(np.int64))], ["bin", "n", "positive"])

    bins = known.where(calibrating).mapInArrow(binned, "bin long, n long, positive long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).toPandas().sort_values("bin")
    if len(bins):
        at, rate = isotonic((bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, bins["positive"].to_numpy(float), bins["n"].to_numpy(float))
    else:
        at, rate = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def run(batches):
        for batch in batches:
            raw = kernel.features(matrix(batch)) @ weights
            # The slight slope keeps the ridge order where the curve is flat.
            score = np.clip(0.999 * np.interp(raw, at, rate) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return flagged.drop("has_id").mapInArrow(run, shape)
