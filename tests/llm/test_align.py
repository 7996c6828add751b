"""Alignment against both libraries run on whole texts and merged token by token."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from glosswork.llm import align
from tests.llm import helpers

SF = "/root/testdata/sf0.001"
CASES = [
    " ", "  ", "a ", "a  ", " a", "\n", "\n\n a\n", "a\r\n b", "a\xa0 b", "a\xa0  ", "x　y  z", "\tfoo\t\tbar\n", "don't 's 12 %%", "日本語 テキスト。\n次", "😀 😀", "<0x41> <s> <|endoftext|> x", "a\x85 b\x1c c",
    "a​ b .​ c", "﻿x ﻿ y", "a▁b", "naïve é é  x", "x\x00y \x00", "‎ a\x0b\x0c b", "\r\r\n a \r b", "a \n b", "  a b  c", "a᠎ b", "ﬁ ½ Ǆ", "x" * 300, "ab cd " * 40 + "▁",
]


@pytest.fixture(scope="module")
def pair():
    return align.tokenizers(public_tokenizers.path(align.A_NAME), public_tokenizers.path(align.B_NAME))


def whole(pair, text):
    """Ids and byte ends of both sides of a whole text; none if the bytes differ."""
    if not text:
        return None
    sides = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.a_bytes), (pair.b.encode(text), pair.b_bytes)
    if any(b"".join(table[i] for i in ids) != (" " + text).encode() for ids, table in sides):
        return None
    return [(ids, np.cumsum([len(table[i]) for i in ids]).tolist()) for ids, table in sides]


def merged(pair, text):
    """(links, groups as text) of two token sequences that end together, by one walk over both."""
    found = whole(pair, text)
    if found is None:
        return [], []
    (a, a_end), (b, b_end) = found
    i = j = 0
    links, groups, own = [], [], ([], [])
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        x, y = a_end[i], b_end[j]
        if x <= y:
            own[0].append(a[i])
            i += 1
        if y <= x:
            own[1].append(b[j])
            j += 1
        if x == y:
            groups.append("|".join(",".join(map(str, side)) for side in own))
            own = ([], [])
    return links, groups


def want(pair, rows):
    made = {d: merged(pair, t) for d, t in rows}
    counts = Counter(x for links, _ in made.values() for x in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for d, (links, groups) in made.items():
        n_a, n_b = (sum(len(g.split("|")[side].split(",")) for g in groups) for side in (0, 1))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((d, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_every_document(spark, pair):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = align.op13(spark, SF).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == want(pair, zip(docs.doc_id, docs.text))


def test_cases_in_small_chunks(spark, pair, monkeypatch):
    monkeypatch.setattr(align, "SEGMENTS", 7)
    rows = [*enumerate(CASES), (500, None), (501, ""), (502, " ".join(CASES[:19]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, align.align_documents(df, size=300).select(COLUMNS).collect())) == want(pair, rows)


@pytest.mark.parametrize("part", [1, 3, 50])
def test_long_texts_are_split_where_both_cut(pair, monkeypatch, part):
    monkeypatch.setattr(align, "PART", part)
    text = " ".join(CASES).replace("▁", "") * 3
    chunk = align._Chunk()
    chunk.add(pair, 1, text)
    parts, occurs, _ = chunk.aligned(pair)
    texts = [t for p in parts for t in p.texts]
    assert b"".join(texts[i] for i in occurs)[:-1].decode() == ";".join(merged(pair, text)[1])


def test_whole_texts_if_the_vocabulary_joins_words(pair, monkeypatch):
    monkeypatch.setattr(pair, "by_segment", False)
    chunk = align._Chunk()
    for i, text in enumerate(CASES):
        chunk.add(pair, i, text)
    row = chunk.row(pair, 1, align.pa.int64())
    digests = row.column("digests")[0].as_py()
    assert digests == [r[-1] for r in want(pair, enumerate(CASES))]


def test_both_encoders_of_a_agree_on_every_token(pair):
    """The faster encoder takes a whole piece for one token; merges must lead there too."""
    tokens = []
    for raw in pair.a_bytes.values():
        try:
            tokens.append(raw.decode())
        except UnicodeDecodeError:
            continue
    tokens = [t for t in tokens if align.PLAIN(t)]
    assert len(tokens) > 20_000
    assert [pair.fast.encode_ordinary(t) for t in tokens] == [e.ids for e in pair.a.encode_batch(tokens, add_special_tokens=False)]


def test_overlaps_against_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(300):
        total = int(r.integers(1, 30))
        a, b = (np.diff(np.concatenate([[0], np.sort(r.choice(total, int(r.integers(0, total)), replace=False)) + 0, [total]])) for _ in range(2))
        a, b = a[a > 0], b[b > 0]
        low, high, border = align.overlaps(a, b)
        ends = [np.cumsum(x) for x in (a, b)]
        starts = [e - x for e, x in zip(ends, (a, b))]
        for i in range(len(a)):
            assert [j for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]] == list(range(low[i], high[i]))
            assert border[i] == (ends[0][i] in ends[1])


def test_groups_as_rows(spark, pair):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, "null id"), (98, None)]
    found = align.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id", "start").collect()
    for d, text in rows:
        own = [r for r in found if r.doc_id == d]
        assert [",".join(map(str, r.a_ids)) + "|" + ",".join(map(str, r.b_ids)) for r in own] == merged(pair, text)[1]
        assert all(x.stop == y.start for x, y in zip(own, own[1:])) and (not own or own[-1].stop == len(f" {text}".encode()))


def test_pair_counts(spark, pair):
    rows = [(1, "one two one"), (2, "two, one"), (3, None)]
    counts = Counter(x for _, t in rows for x in merged(pair, t)[0])
    found = align.pair_counts(align.chunks(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))).collect()
    assert {(r.a_id, r.b_id): r["count"] for r in found} == counts
    assert all(r.best == (r["count"] == max(n for (_, b), n in counts.items() if b == r.b_id)) for r in found)


def test_awkward_rows(spark, pair):
    docs = helpers.make(spark)
    got = sorted(map(tuple, align.align_documents(docs).select(COLUMNS[1:]).collect()))
    texts = [(i, r[1]) for i, r in enumerate(helpers.documents())]
    assert got == sorted(r[1:] for r in want(pair, texts))
    assert align.align_documents(helpers.empty(spark)).count() == 0
    strings = spark.createDataFrame([("k1", "a b"), (None, "c")], "doc_id string, text string")
    assert {r.doc_id for r in align.align_documents(strings).collect()} == {"k1", None}


def test_a_chunk_row_takes_few_bytes_per_word(pair):
    """Memory beside the chunk's own: a word that repeats costs less than eight numbers, whatever is summed over it."""
    chunk = align._Chunk()
    for i in range(200):
        chunk.add(pair, i, " ".join(f"w{(i * 7 + k) % 997}" for k in range(2000)))
    tracemalloc.start()
    row = chunk.row(pair, 1, align.pa.int64())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row.num_rows == 1 and len(chunk.occurs) == 400_000
    assert peak < 64 * len(chunk.occurs), peak / len(chunk.occurs)
