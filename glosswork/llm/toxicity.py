"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is a run of letters, digits and non-ASCII bytes in lower case. Its embedding joins
a row picked by the hash of the word and one picked by the hash of its first bytes, so
inflected and compounded forms share a part. Filters of widths 1 to 3 run over the
embeddings of a text, each filter's maximum over the whole text is taken, and a logistic
layer gives the score. Trained in numpy on a bounded sample of labelled documents (see
``labelled.sample``). One coordinate of each row, another for other buckets, starts at the
smoothed log odds of its bucket among the training documents, and each filter starts at one
coordinate, so the maxima tell how many different telling words a text has. Training goes on
until the loss on a fold that takes no part in it has not fallen for PATIENCE epochs, or for
EPOCHS epochs, and the weights with the least loss count. The logits are scaled by a temperature and moved so that 0.5 is the cut with the best F1; each language gets
the threshold with the best F1. All three use a fold that took no part in training.

The score depends on the text alone; the language only picks ``threshold``.

Rows: a null or empty text is scored like a text without words. A language that is null
or was not calibrated gets the overall threshold. Repeated rows stay, extra columns are
ignored, an empty table gives an empty result. Without labels of both kinds the score is
the share of ones among the labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm import labelled
from glosswork.llm.shared import small_batches
from glosswork.llm.wordkit import blocks, lower_latin

WORD_ROWS, PREFIX_ROWS, HALF = 1 << 17, 1 << 16, 8
PREFIX_BYTES = 6
WIDTHS, FILTERS = (1, 2, 3), 8  # FILTERS of each width
EPOCHS, PATIENCE, BATCH = 30, 3, 64
LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def word_ids(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: bucket of each word, bucket of its first bytes, and each row's first word."""
    for block in blocks(col, 500_000):
        block.data = lower_latin(block.data)
        w = block.words(LETTERS)
        whole, start = w.hashes(), w.hashes(PREFIX_BYTES)
        yield (whole % np.uint64(WORD_ROWS)).astype(np.int32), (start % np.uint64(PREFIX_ROWS)).astype(np.int32), w.first


class Model:
    """Weights, and the scores of texts."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.words = r.normal(0, 0.05, (WORD_ROWS, HALF)).astype(np.float32)
        self.prefixes = r.normal(0, 0.05, (PREFIX_ROWS, HALF)).astype(np.float32)
        width = 2 * HALF
        self.net = {f"w{k}": r.normal(0, 0.1, (k, width, FILTERS)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            for f in range(FILTERS):
                self.net[f"w{k}"][:, [f % HALF, HALF + f % HALF], f] += 0.5 / k
            self.net[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.net["out"] = np.full(len(WIDTHS) * FILTERS, 0.3 / len(WIDTHS), np.float32)
        self.net["bias"] = np.zeros(1, np.float32)
        self.scale, self.shift, self.constant = 1.0, 0.0, None

    def _embed(self, words: np.ndarray, prefixes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of all rows, each row followed by zeros; where each row starts, and the place of each word."""
        pad = max(WIDTHS) - 1
        n = np.diff(first)
        start = first[:-1] + (pad + 1) * np.arange(len(n))  # at least one place per row, with no word in it if need be
        x = np.zeros((len(words) + (pad + 1) * len(n), 2 * HALF), self.words.dtype)
        at = np.arange(len(words)) + np.repeat(start - first[:-1], n)
        x[at, :HALF] = self.words[words]
        x[at, HALF:] = self.prefixes[prefixes]
        return x, start, at

    def _conv(self, x: np.ndarray, k: int, start: np.ndarray) -> np.ndarray:
        """The filters of width k at each place; where they would reach into the next row they never are the maximum."""
        z = x[: len(x) - k + 1] @ self.net[f"w{k}"][0]
        for j in range(1, k):
            z += x[j : len(x) - k + 1 + j] @ self.net[f"w{k}"][j]
        for j in range(1, k):
            z[start[1:] - j] = -np.inf
        return z

    def logits(self, words: np.ndarray, prefixes: np.ndarray, first: np.ndarray) -> np.ndarray:
        x, start, _ = self._embed(words, prefixes, first)
        top = [np.maximum.reduceat(self._conv(x, k, start), start, axis=0) + self.net[f"b{k}"] for k in WIDTHS]
        h = np.maximum(np.concatenate(top, axis=1), 0)
        return (h @ self.net["out"] + self.net["bias"][0]).astype(np.float64)

    def scores(self, col: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(col), self.constant)
        parts = [labelled.sigmoid((self.logits(*ids) + self.shift) / self.scale) for ids in word_ids(col)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def start_rows(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Puts smoothed log odds of each bucket into one coordinate of its row."""
        for side, table in ((0, self.words), (1, self.prefixes)):
            counts = np.zeros((2, len(table)))
            for ids, y in zip(texts, labels):
                counts[int(y), np.unique(ids[side])] += 1
            n = np.bincount(labels.astype(int), minlength=2)
            odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
            seen = counts.sum(0)
            odds = np.where((seen >= 3) & (odds > 0), odds * (1 - 1 / np.maximum(seen, 1)), 0)  # few texts tell little
            table[np.arange(len(table)), np.arange(len(table)) * 2654435761 % (1 << 32) % HALF] += odds.astype(np.float32)

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, held: np.ndarray, seed: int = 11) -> int:
        """Trains on the texts that are not ``held`` (a mask) until those stop improving; the number of epochs."""
        r = np.random.default_rng(seed)
        learn, watch = np.flatnonzero(~held), np.flatnonzero(held)
        self.start_rows([texts[i] for i in learn], labels[learn])
        adam = labelled.Adam(self.net, 0.005)
        ones = max(1, labels[learn].sum()), max(1, (1 - labels[learn]).sum())
        weight = np.where(labels == 1, len(learn) / (2 * ones[0]), len(learn) / (2 * ones[1]))
        squares = {"words": np.full(WORD_ROWS, 0.1, np.float32), "prefixes": np.full(PREFIX_ROWS, 0.1, np.float32)}
        best, kept, since = self._loss(texts, labels, weight, watch), self._weights(), 0
        for epoch in range(EPOCHS):
            order = r.permutation(learn)
            for lo in range(0, len(order), BATCH):
                self._train(texts, labels, weight, order[lo : lo + BATCH], adam, squares)
            now = self._loss(texts, labels, weight, watch)
            if now < best or not len(watch):
                best, kept, since = now, self._weights(), 0
            else:
                since += 1
            if since == PATIENCE or not len(watch) and epoch == 3:
                break
        self.words, self.prefixes, self.net = kept
        return epoch + 1

    def _weights(self) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        return self.words.copy(), self.prefixes.copy(), {k: v.copy() for k, v in self.net.items()}

    def _loss(self, texts, labels, weight, rows) -> float:
        """The weighted log loss of some texts, at the best temperature: how well they are told apart."""
        if not len(rows):
            return 0.0
        z = np.concatenate([self.logits(*_joined(texts, rows[lo : lo + 512])) for lo in range(0, len(rows), 512)])
        losses = [float(np.mean(weight[rows] * (np.logaddexp(0, z / t) - labels[rows] * z / t))) for t in np.geomspace(0.25, 8, 21)]
        return min(losses)

    def gradients(self, texts, labels, weight, rows) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]:
        """Of the weighted log loss of some texts: by the network's weights, and for each table its rows with theirs."""
        words, prefixes, first = _joined(texts, rows)
        x, start, at = self._embed(words, prefixes, first)
        end = np.append(start[1:], len(x))
        tops, places = [], []
        for k in WIDTHS:
            z = self._conv(x, k, start)
            place = np.stack([a + z[a : min(b, len(z))].argmax(axis=0) for a, b in zip(start, end)])
            places.append(place)
            tops.append(np.take_along_axis(z, place, axis=0) + self.net[f"b{k}"])
        h = np.maximum(np.concatenate(tops, axis=1), 0)
        p = labelled.sigmoid(h @ self.net["out"] + self.net["bias"][0])
        d = ((p - labels[rows]) * weight[rows] / len(rows)).astype(self.words.dtype)
        grads = {"out": h.T @ d + 1e-4 * self.net["out"], "bias": d.sum(keepdims=True)}
        dh = d[:, None] * self.net["out"] * (h > 0)
        dx_at, dx = [], []
        for i, k in enumerate(WIDTHS):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"b{k}"] = g.sum(axis=0)
            grads[f"w{k}"] = np.stack([np.einsum("df,dfe->ef", g, x[places[i] + j]) for j in range(k)])
            for j in range(k):
                dx_at.append((places[i] + j).ravel())
                dx.append((g[:, :, None] * self.net[f"w{k}"][j].T).reshape(-1, x.shape[1]))
        word_at = np.full(len(x), -1)
        word_at[at] = np.arange(len(words))
        hit = word_at[np.concatenate(dx_at)]
        grad = np.concatenate(dx)[hit >= 0]
        hit = hit[hit >= 0]
        tables = {}
        for name, ids, part in (("words", words, grad[:, :HALF]), ("prefixes", prefixes, grad[:, HALF:])):
            rows_hit, back = np.unique(ids[hit], return_inverse=True)
            total = np.zeros((len(rows_hit), HALF), part.dtype)
            np.add.at(total, back, part)
            tables[name] = rows_hit, total
        return grads, tables

    def _train(self, texts, labels, weight, rows, adam, squares) -> None:
        grads, tables = self.gradients(texts, labels, weight, rows)
        adam.step(grads)
        for name, (rows_hit, total) in tables.items():
            squares[name][rows_hit] += (total**2).mean(axis=1)
            getattr(self, name)[rows_hit] -= 0.02 * total / np.sqrt(squares[name][rows_hit])[:, None]


def _joined(texts, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words of some texts, and where each text begins."""
    first = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in rows])])
    return np.concatenate([texts[i][0] for i in rows]), np.concatenate([texts[i][1] for i in rows]), first


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> tuple[Model, dict[str, float], float]:
    """A fitted model, the threshold of each calibrated language, and the overall threshold."""
    rows, shift = labelled.sample(docs, labels, column)
    y = np.asarray(rows.column("label"), dtype=np.float32)
    model = Model()
    if len(set(y.tolist())) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model, {}, 0.5
    texts = []
    for words, prefixes, first in word_ids(rows.column("text").combine_chunks()):
        texts += [(words[a:b], prefixes[a:b]) for a, b in zip(first[:-1], first[1:])]
    calibrate = np.asarray(rows.column("fold")) == 1
    if len(set(y[~calibrate].tolist())) < 2:
        calibrate[:] = False
    learn = np.flatnonzero(~calibrate)
    model.fit(texts, y, calibrate)
    # the fit weighs both labels alike: shift back to their shares in the sample, and from there to all labels
    model.shift = float(np.log(max(1, y[learn].sum()) / max(1, (1 - y[learn]).sum()))) + shift
    held = np.flatnonzero(calibrate) if min(y[calibrate].sum(), (1 - y[calibrate]).sum()) >= 5 else np.arange(len(y))
    logits = np.concatenate([model.logits(texts[i][0], texts[i][1], np.array([0, len(texts[i][0])])) for i in held]) + model.shift
    model.scale = labelled.temperature(logits, y[held])
    cut = labelled.best_threshold(labelled.sigmoid(logits / model.scale), y[held], 0.5)
    move = model.scale * float(np.log(cut / (1 - cut)))
    model.shift -= move
    scores = labelled.sigmoid((logits - move) / model.scale)
    by_language = {}
    languages = np.array(rows.column("lang").to_pylist(), dtype=object)[held]
    for language in {x for x in languages.tolist() if x is not None}:
        own = languages == language
        by_language[language] = labelled.best_threshold(scores[own], y[held][own], 0.5)
    return model, by_language, 0.5


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and flagged (score at or above its language's threshold)."""
    model, by_language, overall = train(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "lang": batch.column(2), "score": pa.array(model.scores(batch.column(1)), pa.float64())}
            )

    kind = dict(docs.dtypes)["doc_id"]
    out = small_batches(docs).select("doc_id", "text", F.col("lang").cast("string")).mapInArrow(scored, f"doc_id {kind}, lang string, score double")
    threshold = F.lit(overall)
    for language, value in sorted(by_language.items()):
        threshold = F.when(F.col("lang") == language, F.lit(value)).otherwise(threshold)
    return out.select(
        "doc_id",
        (labelled.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold.alias("threshold"),
        (F.col("score") >= threshold).alias("flagged"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """The op1 contract over the whole documents table."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
