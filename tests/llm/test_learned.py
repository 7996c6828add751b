"""Classifiers: awkward rows, folds, held-out accuracy, and what scores may depend on."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork.llm import labelled, quality, toxicity
from tests.llm.helpers import documents, empty, make

SF = "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(scores, labels, column):
    return scores.join(labels.groupBy("doc_id").agg(F.max(column).alias("y")), "doc_id").where("held_out").toPandas()


def test_quality_held_out(tables):
    docs, labels = tables
    rows = held_out(quality.score_documents(docs, labels), labels, "quality")
    assert (rows["predicted"] == rows["y"]).mean() > 0.95 and rows["score"].between(0, 1).all()


def test_toxicity_held_out(tables):
    docs, labels = tables
    rows = held_out(toxicity.score_documents(docs, labels), labels, "toxic")
    english = rows.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id").query("lang == 'en'")
    assert (english["predicted"] == english["y"]).mean() > 0.95 and rows["score"].between(0, 1).all()


def test_held_out_labels_do_not_matter(spark, tables):
    docs, labels = tables
    docs = docs.limit(300).cache()
    turned = labels.withColumn("toxic", F.when(labelled.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn(
        "quality", F.when(labelled.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    for operator in (toxicity.score_documents, quality.score_documents):
        a = {r["doc_id"]: r["score"] for r in operator(docs, labels).collect()}
        b = {r["doc_id"]: r["score"] for r in operator(docs, turned).collect()}
        assert a == b


def test_fold(spark):
    got = {r["doc_id"]: r["f"] for r in make(spark).select("doc_id", labelled.fold(F.col("doc_id")).alias("f")).collect()}
    assert all(f == zlib.crc32(b"" if d is None else str(d).encode()) % 5 for d, f in got.items())


@pytest.mark.parametrize("operator", [toxicity.score_documents, quality.score_documents])
def test_awkward_rows(spark, operator):
    given = labels_of(spark, [(i, i % 2, i % 2) for i in range(1, 12)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, None), (500, 1, 1)])
    for labels in (given, labels_of(spark, []), labels_of(spark, [(1, 1, 1)])):
        got = operator(make(spark), labels).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in documents())
        assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert operator(empty(spark), given).count() == 0


def test_scores_depend_on_the_text_alone(spark, tables):
    docs, labels = tables
    docs = docs.limit(200).cache()
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("elsewhere")})
    a = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.score_documents(other, labels).collect()}
    assert a == b


# against plain loops


def plain_toxicity(model, words, prefixes):
    """The logit of one text, word by word and filter by filter."""
    x = [np.concatenate([model.words[a], model.prefixes[b]]).astype(float) for a, b in zip(words, prefixes)]
    x += [np.zeros(2 * toxicity.HALF)] * max(toxicity.WIDTHS)  # filters may reach past the last word
    total, out = float(model.net["bias"][0]), model.net["out"].astype(float)
    for i, k in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            starts = range(len(x) - k + 1)
            best = max(sum(float(x[s + j] @ model.net[f"w{k}"][j][:, f]) for j in range(k)) for s in starts)
            total += max(0.0, best + float(model.net[f"b{k}"][f])) * out[i * toxicity.FILTERS + f]
    return total


def random_texts(model, r, lengths):
    return [(r.integers(0, 50, n).astype(np.int32), r.integers(0, 30, n).astype(np.int32)) for n in lengths]


def test_toxicity_forward_equals_plain_loops():
    r = np.random.default_rng(2)
    model = toxicity.Model()
    model.words[:50] = r.normal(0, 1, (50, toxicity.HALF))
    model.prefixes[:30] = r.normal(0, 1, (30, toxicity.HALF))
    texts = random_texts(model, r, [0, 1, 2, 3, 7, 20, 0])
    first = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])])
    got = model.logits(np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts]), first)
    assert np.allclose(got, [plain_toxicity(model, *t) for t in texts], atol=1e-4)
    alone = [model.logits(*t, np.array([0, len(t[0])]))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-5)  # neighbours in a batch do not matter


def test_toxicity_gradients_equal_differences():
    r = np.random.default_rng(4)
    model = toxicity.Model()
    for name in ("words", "prefixes"):
        setattr(model, name, r.normal(0, 1, getattr(model, name).shape))
    model.net = {name: w.astype(float) for name, w in model.net.items()}
    for k in toxicity.WIDTHS:  # off the kink of a filter whose maximum is its padding
        model.net[f"b{k}"] += r.normal(0, 0.3, toxicity.FILTERS)
    texts = random_texts(model, r, [4, 9, 1, 6])
    labels, weight, rows = np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0]), np.arange(4)

    def loss():
        z = np.array([float(model.logits(*t, np.array([0, len(t[0])]))[0]) for t in texts])
        return float(np.mean(weight * (np.logaddexp(0, z) - labels * z))) + 0.5e-4 * float((model.net["out"].astype(float) ** 2).sum())

    grads, tables = model.gradients(texts, labels, weight, rows)

    def slope(array, at, by=1e-6):
        kept = array[at]
        array[at] = kept + by
        up = loss()
        array[at] = kept - by
        down = loss()
        array[at] = kept
        return (up - down) / (2 * by)

    for name, g in grads.items():
        for at in [tuple(int(r.integers(0, n)) for n in g.shape) for _ in range(6)]:
            assert abs(slope(model.net[name], at) - g[at]) < 1e-5, name
    for name, (ids, g) in tables.items():
        for i in range(0, len(ids), 3):
            c = int(r.integers(0, toxicity.HALF))
            assert abs(slope(getattr(model, name), (ids[i], c)) - g[i, c]) < 1e-5, name


def test_toxicity_filters_add_to_the_start():
    """Two-word phrases are toxic, their words are not: the start, which knows single words only, cannot tell them apart."""
    r = np.random.default_rng(6)

    def text(toxic):
        words = [f"w{i}" for i in r.integers(0, 60, 25)]
        pairs = ("black", "white") if toxic else ("white", "black")
        at = int(r.integers(0, 20))
        return " ".join(words[:at] + list(pairs) + words[at:])

    labels = np.array([i % 2 for i in range(600)], np.float32)
    col = pa.array([text(y) for y in labels])
    texts = [(w[a:b], p[a:b]) for w, p, first in toxicity.word_ids(col) for a, b in zip(first[:-1], first[1:])]
    held = np.arange(600) >= 500
    watched = (np.arange(600) >= 400) & ~held
    given = np.flatnonzero(~held)

    def accuracy(model):
        z = np.array([model.logits(*texts[i], np.array([0, len(texts[i][0])]))[0] for i in np.flatnonzero(held)])
        return ((z > np.median(z)) == (labels[held] == 1)).mean()

    start, fitted = toxicity.Model(), toxicity.Model()
    start.start_rows([texts[i] for i in range(400)], labels[:400])
    epochs = fitted.fit([texts[i] for i in given], labels[given], watched[given])  # as ``train`` does
    assert accuracy(start) < 0.65 and accuracy(fitted) > 0.85 and 4 < epochs <= toxicity.EPOCHS


def test_toxicity_stops_when_the_watched_texts_do_not_improve():
    r = np.random.default_rng(7)
    texts = [(r.integers(0, 900, 12).astype(np.int32), r.integers(0, 900, 12).astype(np.int32)) for _ in range(120)]
    labels, held = r.integers(0, 2, 120).astype(np.float32), np.arange(120) % 3 == 0  # noise: nothing to learn
    assert toxicity.Model().fit(texts, labels, held) < toxicity.EPOCHS


def test_quality_forward_and_gradients_equal_plain_loops():
    r = np.random.default_rng(8)
    net = quality.Network(12)
    for name in net.net:
        net.net[name] = net.net[name].astype(np.float64)
    x, y = r.normal(0, 1, (9, 12)), (r.random(9) > 0.5).astype(float)
    net.centre, net.width = x.mean(0), x.std(0) + 0.05

    def logit(row):
        h = [max(0.0, sum((row[i] - net.centre[i]) / net.width[i] * net.net["w1"][i, j] for i in range(12)) + net.net["b1"][j]) for j in range(quality.HIDDEN)]
        return sum(a * b for a, b in zip(h, net.net["w2"])) + net.net["b2"][0]

    assert np.allclose(net.logits(x), [logit(row) for row in x])

    def loss():
        z = net.logits(x)
        return float(np.mean(np.logaddexp(0, z) - y * z)) + 0.5e-3 * sum(float((net.net[n] ** 2).sum()) for n in ("w1", "w2"))

    for name, g in net.gradients(x, y).items():
        for at in [tuple(int(r.integers(0, n)) for n in g.shape) for _ in range(8)]:
            kept = net.net[name][at]
            net.net[name][at] = kept + 1e-6
            up = loss()
            net.net[name][at] = kept - 1e-6
            down = loss()
            net.net[name][at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5, name


def test_pooling_equals_plain_loops():
    r = np.random.default_rng(9)
    vectors = r.normal(0, 1, (40, 6)).astype(np.float32)
    ids = [r.integers(0, 40, n) for n in (0, 1, 2, 9)]
    first = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    got = quality.pooled(vectors, np.concatenate(ids).astype(np.int64), first)
    for row, i in zip(got, ids):
        want = np.zeros(20)
        if len(i):
            v = vectors[i].astype(float)
            want[:6], want[6:12] = v.mean(0) * 4, v.std(0) * 4
            want[12:18] = sum((a * b for a, b in zip(v[1:], v[:-1])), np.zeros(6)) / len(i) * 16
            want[18], want[19] = np.log1p(len(i)), 1
        assert np.allclose(row, want, atol=1e-3)


def test_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, "same id " + "x" * (i % 7)) for i in range(500)] + [(i, "y" * 100) for i in range(2, 60)], "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(1, 60)])
    rows, shift = labelled.sample(docs, labels, "quality", 10, 12)
    assert rows.num_rows <= 22 and rows.column_names == ["text", "lang", "label", "fold"]
    few, _ = labelled.sample(docs, labels, "quality", 10, 12, most_bytes=350)
    assert all(sum(len(t) for t, y in zip(few["text"].to_pylist(), few["label"].to_pylist()) if y == label) <= 350 for label in (0, 1))
    none, _ = labelled.sample(docs, labels, "quality", 10, 12, most_bytes=50)
    assert [t[:8] for t in none.column("text").to_pylist()] == ["same id "]  # the others are over the bound by themselves
    again, same = labelled.sample(docs.repartition(5), labels, "quality", 10, 12)
    assert again.equals(rows) and same == shift


def test_word_vectors_cover_all_documents(spark):
    texts = ["one two three two", "two three", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    place, sign = quality._index_vectors()
    total, counts = np.zeros((quality.BUCKETS, quality.SIZE)), np.zeros(quality.BUCKETS)
    ids = {w: int(next(quality.token_ids(pa.array([w])))[0][0]) for w in ("one", "two", "three")}
    for t in texts:
        w = [ids[x] for x in (t or "").split()]
        for i, a in enumerate(w):
            counts[a] += 1
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    np.add.at(total[a], place[w[j]], sign[w[j]])
    assert np.allclose(quality.word_vectors(df), quality.finished_vectors(total, counts))


def test_repeated_tasks_send_rows_to_the_same_partitions(spark):
    docs = spark.createDataFrame([(f"a b c {i}",) for i in range(40)], "text string").repartition(3)
    tables = docs.mapInArrow(quality._partial, "part int, salt int, data binary").select("part", "salt", F.spark_partition_id().alias("p"))
    first, again = ({tuple(r) for r in tables.collect()} for _ in range(2))
    assert first == again and all(salt == p for _, salt, p in first)


def test_best_threshold_and_temperature():
    scores, labels = np.array([0.1, 0.2, 0.3, 0.35, 0.4, 0.6, 0.7, 0.8, 0.9, 0.95]), np.array([0, 0, 0, 0, 0, 1, 1, 1, 1, 1])
    assert labelled.best_threshold(scores, labels, 0.5) == 0.5 and labelled.best_threshold(scores[:4], labels[:4], 0.7) == 0.7
    assert labelled.temperature(np.array([9.0, -9.0, 9.0, -9.0]), np.array([1.0, 0.0, 0.0, 1.0])) > 4
