"""Bounded labelled samples, folds, and the training steps that both classifiers share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.lineage import cut, new_path, remove

#: Most labelled documents that a classifier is fitted on, of either label, and most bytes of their texts per label.
MOST_ONES, MOST_ZEROS, MOST_BYTES = 5_000, 8_000, 16_000_000


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5. Fold 0 is held out, fold 1 calibrates. Null counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")


def sample(
    docs: DataFrame, labels: DataFrame, column: str, ones: int = MOST_ONES, zeros: int = MOST_ZEROS, most_bytes: int = MOST_BYTES
) -> tuple[pa.Table, float]:
    """Up to ``ones`` + ``zeros`` labelled documents (text, lang, label, fold) outside fold 0, whose texts have up to
    ``most_bytes`` bytes per label, and log odds that correct for taking the labels at different rates.

    The documents are those with the least hashes of doc_id, so the sample does not depend on partitioning. Of several
    rows with one doc_id the one with the least hash of its text counts. A document with several labels counts with the
    largest; null labels are left out, and so are texts over ``most_bytes``. What the driver takes is bounded by the three numbers, whatever the tables hold.
    """
    given = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(column).cast("int").alias("label"))
        .withColumn("fold", fold(F.col("doc_id")))
        .where("fold <> 0")
    )
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = given.where("label = 1").orderBy(*order).limit(ones).union(given.where("label = 0").orderBy(*order).limit(zeros))
    met = docs.select("doc_id", "text", F.col("lang").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most ones + zeros rows
    first = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text", "lang"), "text", "lang")).alias("_row")
    path = new_path(docs.sparkSession, "sample")
    rows = cut(met.groupBy("doc_id", "label", "fold").agg(first).select("doc_id", "label", "fold", "_row.*"), path)
    total, taken, last = {0: 0, 1: 0}, {0: 0, 1: 0}, {}
    for r in rows.select("label", F.xxhash64("doc_id").alias("h"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("h", "doc_id").collect():
        if total[r["label"]] is None:
            continue
        if r["n"] > most_bytes:
            continue
        if total[r["label"]] + r["n"] > most_bytes:
            total[r["label"]] = None  # the rest of this label is beyond the bound
            continue
        total[r["label"]] += r["n"]
        taken[r["label"]] += 1
        last[r["label"]] = r["h"]
    small, inside = F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes, F.lit(False)
    for label, h in last.items():
        inside = inside | ((F.col("label") == label) & (F.xxhash64("doc_id") <= h))
    kept = rows.where(inside & small).select("text", "lang", "label", "fold", F.xxhash64("doc_id").alias("h"))
    table = kept.toArrow().combine_chunks().sort_by("h").drop_columns(["h"]).combine_chunks()  # one order, one model
    remove(docs.sparkSession, path)
    rate = [max(1, taken[label]) / max(1, counts.get(label, 0), taken[label]) for label in (0, 1)]
    return table, float(np.log(rate[0] / rate[1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps on a dictionary of arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.003) -> None:
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.weights[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a fixed grid; 1 without both labels."""
    if len(set(labels.tolist())) < 2:
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    return min(np.geomspace(0.25, 8, 41).tolist(), key=loss)


def best_threshold(scores: np.ndarray, labels: np.ndarray, default: float) -> float:
    """The cut with the best F1, halfway to the next lower score; the default with fewer than 5 of either label."""
    if min(labels.sum(), (1 - labels).sum()) < 5:
        return default
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # a cut falls between different scores
    at = int(np.argmax(f1))
    cut = (s[at] + s[at + 1]) / 2 if at + 1 < len(s) else s[at]
    return float(np.clip(cut, 1e-6, 1 - 1e-6))
