"""Quality: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of other signs. Every
of 65,536 token buckets has a sparse random index vector; its word vector is the sum of the
index vectors of the tokens up to two places away, over all documents. Each scan task adds up
one table of fixed size and the tables are summed in two streaming steps, so memory
depends on the table alone. Word vectors are damped, centred by their frequency-weighted
mean, brought to unit length, and joined with the tokens' own index vectors.

A document is pooled to the mean and the spread of its word vectors, the mean product of
neighbours, and its length. A two-layer numpy network is fitted on a bounded sample of
labelled documents (see ``labelled.sample``); a fold that took no part gives the
temperature of its probabilities.

The score depends on the text alone (and on the corpus through the word vectors).

Rows: a null or empty text is scored like a text without tokens. Repeated rows stay,
extra columns are ignored, an empty table gives an empty result. Without labels of both
kinds the score is the share of ones among the labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm import labelled
from glosswork.llm.shared import small_batches
from glosswork.llm.wordkit import blocks

BUCKETS, SIZE, PLACES, REACH = 1 << 16, 32, 2, 2
PARTS = 64
HIDDEN, EPOCHS, BATCH = 32, 40, 128
ACCEPT = 0.3
SIGNS = np.full(256, 2, np.uint8)
SIGNS[[0x20, *range(0x09, 0x0E)]] = 0
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@lru_cache(maxsize=1)
def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, PLACES coordinates and their signs."""
    r = np.random.default_rng(5)
    return r.integers(0, SIZE, (BUCKETS, PLACES)), r.choice(np.array([-1.0, 1.0]), (BUCKETS, PLACES))


def token_ids(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows: bucket of each token, and each row's first token."""
    for block in blocks(col, 250_000):
        w = block.words(SIGNS)
        yield (w.hashes() % np.uint64(BUCKETS)).astype(np.int64), w.first


def add_contexts(total: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
    """Adds the index vectors of each token's neighbours to its bucket's row; total is flat, of integers."""
    place, sign = _index_vectors()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cells, signs = [], []
    for o in range(1, REACH + 1):
        same = row[o:] == row[:-o]
        left, right = ids[:-o][same], ids[o:][same]
        for word, context in ((left, right), (right, left)):
            cells.append((word[:, None] * SIZE + place[context]).ravel())
            signs.append(sign[context].ravel())
    cells, signs = np.concatenate(cells), np.concatenate(signs)
    if len(cells) * 4 > len(total):
        total += np.bincount(cells, signs, len(total)).astype(total.dtype)
    else:
        np.add.at(total, cells, signs.astype(total.dtype))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, counts, some = np.zeros(BUCKETS * SIZE, np.int32), np.zeros(BUCKETS, np.int32), False
    for batch in batches:
        for ids, first in token_ids(batch.column(0)):
            add_contexts(total, ids, first)
            counts += np.bincount(ids, minlength=BUCKETS).astype(np.int32)
            some = True
    if some:
        task = TaskContext.get()
        # the salt spreads rows over tasks; a repeated task sends them to the same ones
        yield _packed(np.hstack([total.reshape(BUCKETS, SIZE), counts[:, None]]), task.partitionId() if task else 0)


def _packed(table: np.ndarray, salt: int) -> pa.RecordBatch:
    """PARTS rows of a table of integers, each in the narrowest width that holds it."""
    rows = []
    for x in np.split(table, PARTS):
        top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        kind = next((k for k in (np.int8, np.int16, np.int32) if top <= np.iinfo(k).max), np.int64)
        rows.append(bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes())
    return pa.RecordBatch.from_pydict(
        {"part": pa.array(range(PARTS), pa.int32()), "salt": pa.array([int(salt)] * PARTS, pa.int32()), "data": pa.array(rows, pa.binary())}
    )


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(2)):
            x = _unpacked(data.as_py())
            if part in sums:
                sums[part] += x
            else:
                sums[part] = x
    for part, x in sums.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "salt": pa.array([0], pa.int32()), "data": pa.array([b"\x08" + x.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, BUCKETS rows, from all documents."""
    schema = "part int, salt int, data binary"
    tables = small_batches(docs).select("text").mapInArrow(_partial, schema)
    spread = tables.repartition("part", "salt").mapInArrow(_summed, schema)
    rows = spread.repartition("part").mapInArrow(_summed, schema).collect()  # PARTS rows of fixed size
    raw = np.zeros((PARTS, BUCKETS // PARTS * (SIZE + 1)))
    for r in rows:
        raw[r["part"]] = _unpacked(r["data"])
    raw = raw.reshape(BUCKETS, SIZE + 1)
    return finished_vectors(raw[:, :SIZE], raw[:, SIZE])


def finished_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    mean = sums / np.maximum(counts, 1)[:, None]
    centre = counts @ mean / max(1.0, counts.sum())
    mean = (mean - centre) * (counts > 0)[:, None]
    mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    place, sign = _index_vectors()
    own = np.zeros((BUCKETS, SIZE))
    for j in range(PLACES):
        np.add.at(own, (np.arange(BUCKETS), place[:, j]), sign[:, j] / PLACES)
    return np.hstack([mean, own]).astype(np.float32)


def pooled(vectors: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = np.diff(first)
    out = np.zeros((len(n), 3 * vectors.shape[1] + 2), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    v, d = vectors[ids], vectors.shape[1]
    at, size = first[full], n[full][:, None].astype(np.float32)
    mean = np.add.reduceat(v, at, axis=0) / size
    spread = np.add.reduceat(v * v, at, axis=0) / size - mean**2
    near = np.zeros_like(v)
    np.multiply(v[1:], v[:-1], out=near[1:])
    near[at] = 0
    out[full, :d] = mean * 4
    out[full, d : 2 * d] = np.sqrt(np.maximum(spread, 0)) * 4
    out[full, 2 * d : 3 * d] = np.add.reduceat(near, at, axis=0) / size * 16
    out[full, 3 * d] = np.log1p(size[:, 0])
    out[full, 3 * d + 1] = 1
    return out


class Network:
    """Two layers over pooled features, with a temperature."""

    def __init__(self, inputs: int, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.net = {
            "w1": r.normal(0, inputs**-0.5, (inputs, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.centre, self.width = np.zeros(inputs, np.float32), np.ones(inputs, np.float32)
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.width @ self.net["w1"] + self.net["b1"], 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (self._hidden(x) @ self.net["w2"] + self.net["b2"][0]).astype(np.float64) + self.shift

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return labelled.sigmoid(self.logits(x) / self.scale)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 17) -> None:
        r = np.random.default_rng(seed)
        self.centre, self.width = x.mean(axis=0), x.std(axis=0) + 0.05
        adam = labelled.Adam(self.net, 0.003)
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for lo in range(0, len(order), BATCH):
                rows = order[lo : lo + BATCH]
                adam.step(self.gradients(x[rows], y[rows]))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss with its penalty on the weights."""
        a = (x - self.centre) / self.width
        h = np.maximum(a @ self.net["w1"] + self.net["b1"], 0)
        p = labelled.sigmoid(h @ self.net["w2"] + self.net["b2"][0])
        d = ((p - y) / len(y)).astype(self.net["w2"].dtype)
        dh = d[:, None] * self.net["w2"] * (h > 0)
        return {
            "w1": a.T @ dh + 1e-3 * self.net["w1"],
            "b1": dh.sum(axis=0),
            "w2": h.T @ d + 1e-3 * self.net["w2"],
            "b2": d.sum(keepdims=True),
        }


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and a network fitted on the labelled sample."""
    vectors = word_vectors(docs)
    rows, shift = labelled.sample(docs, labels, column)
    y = np.asarray(rows.column("label"), dtype=np.float32)
    net = Network(3 * vectors.shape[1] + 2)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return vectors, net
    x = np.concatenate([pooled(vectors, *ids) for ids in token_ids(rows.column("text").combine_chunks())])
    calibrate = np.asarray(rows.column("fold")) == 1
    if len(set(y[~calibrate].tolist())) < 2 or len(set(y[calibrate].tolist())) < 2:
        calibrate[:] = False
    net.fit(x[~calibrate], y[~calibrate])
    net.shift = shift
    if calibrate.any():
        net.scale = labelled.temperature(net.logits(x[calibrate]), y[calibrate])
    return vectors, net


def scorer(docs: DataFrame, labels: DataFrame):
    """A function of Arrow text columns to scores."""
    vectors, net = train(docs, labels)

    def scores(col: pa.Array) -> np.ndarray:
        parts = [net.scores(pooled(vectors, *ids)) for ids in token_ids(col)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return scores


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    scores = scorer(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores(batch.column(1)), pa.float64())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double").select(
        "doc_id",
        (labelled.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least ``least``."""
    scores = scorer(docs, labels)
    at = docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= least))

    return docs.mapInArrow(passing, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """The op2 contract over the whole documents table."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
