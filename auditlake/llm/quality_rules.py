"""Gradient-boosted trees over document statistics, with monotone features.

Trees are complete and flattened into node arrays (feature, threshold, value),
so a batch is scored level by level with array lookups only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts
from .stats import COUNTS, FEATURES, _stats_batch, document_stats, labelled_sample

#: Labelled rows that a fit takes at most.
FIT_ROWS = 20_000


@dataclass
class Trees:
    """Node arrays of all trees: inner nodes by level, then leaf values."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # goes right where x > threshold
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        every = np.arange(trees)
        for _ in range((inner + 1).bit_length() - 1):
            right = np.take_along_axis(x, self.feature[every, at], axis=1) > self.threshold[every, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[every, at - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0, least: float = 3.0) -> Trees:
    """Logistic boosting on quantile bins.

    A split on a feature with a sign is allowed only if its sides' values are
    ordered that way, and their midpoint bounds all values below it.  With one
    class or no rows the trees are constant.
    """
    n, d = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    if not n or y.min() == y.max():
        return Trees(feature, threshold, leaf, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    coded = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        value = {0: 0.0}
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            place = node - first
            best = [(1e-9, -1, 0, 0.0, 0.0)] * width
            for j in range(d):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                cell = place * k + coded[:, j]
                g = np.bincount(cell, gradient, width * k).reshape(width, k).cumsum(1)
                h = np.bincount(cell, weight, width * k).reshape(width, k).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gr, hr = gt - gl, ht - hl
                low = np.array([bounds[first + i][0] for i in range(width)])[:, None]
                high = np.array([bounds[first + i][1] for i in range(width)])[:, None]
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                parent = np.clip(gt / (ht + ridge), low, high)
                score = lambda v, g, h: 2 * v * g - v * v * (h + ridge)
                gain = score(vl, gl, hl) + score(vr, gr, hr) - score(parent, gt, ht)
                allowed = (hl >= least) & (hr >= least) & (signs[j] * (vr - vl) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                for i in range(width):
                    c = int(gain[i].argmax())
                    if gain[i, c] > best[i][0]:
                        best[i] = (gain[i, c], j, c, vl[i, c], vr[i, c])
            right = np.zeros(n, bool)
            for i, (_, j, c, vl, vr) in enumerate(best):
                at = first + i
                low, high = bounds[at]
                left_bounds = right_bounds = (low, high)
                if j < 0:
                    value[2 * at + 1] = value[2 * at + 2] = value[at]
                else:
                    feature[t, at], threshold[t, at] = j, cuts[j][c]
                    mine = place == i
                    right[mine] = coded[mine, j] > c
                    value[2 * at + 1], value[2 * at + 2] = vl, vr
                    if signs[j]:
                        middle = (vl + vr) / 2
                        left_bounds, right_bounds = ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
                bounds[2 * at + 1], bounds[2 * at + 2] = left_bounds, right_bounds
            node = 2 * node + 1 + right
        leaf[t] = [rate * value[inner + i] for i in range(leaves)]
        margin += leaf[t][node - inner]
    return Trees(feature, threshold, leaf, base)


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Trees:
    """Fit on a bounded sample of labelled documents (labels: doc_id, quality)."""
    rows = document_stats_with(labelled_sample(docs, labels, "quality", most)).toPandas()
    return fit(rows[list(FEATURES)].to_numpy(float).reshape(len(rows), len(FEATURES)), rows["label"].to_numpy(float), list(FEATURES.values()))


def document_stats_with(rows: DataFrame) -> DataFrame:
    """Statistics of (doc_id, text, label) rows with the label kept."""
    shape = ", ".join(["doc_id long", "label int", *(f"{c} long" for c in COUNTS), *(f"{f} double" for f in FEATURES)])
    return arrow_map(rows.select("doc_id", "text", "label"), lambda batch: _stats_batch(batch) | {"label": batch.column("label")}, shape)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = FIT_ROWS) -> DataFrame:
    """Counts of every document, base_failed, kept and quality_score.

    base_failed: fewer than 50 words, or more than half of them in repeated
    three-word windows.  kept: not base_failed and scored at least
    ``threshold``.  Null and empty texts have zero counts and fail the base
    rule.  Without labels the trees are constant at one half and keep all that
    passes the base rule.  Repeated rows get one result each.
    """
    trees = train(docs, labels, most)

    def run(batch: pa.RecordBatch) -> dict:
        found = _stats_batch(batch)
        score = trees.probability(np.column_stack([found[f] for f in FEATURES]))
        n, repeats = np.array(found["n_words"]), np.array(found["n_repeat_words"])
        failed = (n < 50) | (100 * repeats > 50 * n)
        return {k: found[k] for k in ("doc_id", *COUNTS)} | {"base_failed": failed, "kept": ~failed & (score >= threshold), "quality_score": score}

    shape = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "quality_score double"])
    return arrow_map(texts(docs), run, shape)
