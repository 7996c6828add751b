"""The pipeline's stages and the registered queries."""

import hashlib
from array import array
from collections import Counter

import pytest

import corpus_pipeline
from glosswork.llm import registry, shared
from tests.llm.helpers import empty, make

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(shared.cut(stage(spark, out[-1], SF)))
    return out


def test_stages_keep_columns_and_shrink(stages):
    columns = stages[0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontaminate", "encode"]
    assert all(s.columns == columns for s in stages[1:-1])
    n = [s.count() for s in stages]
    assert n[0] > n[1] > n[2] >= n[3] >= n[4] == n[5] > n[0] // 2


def test_no_benchmark_item_is_left(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r["text"] for r in stages[4].collect()]
    assert any(i in r["text"] for r in stages[0].collect() for i in items) and not any(i in t for t in texts for i in items)


def test_no_passage_repeats(stages):
    seen = {}
    for r in sorted(stages[3].collect(), key=lambda r: r["doc_id"]):
        assert r["n_chars"] == len(r["text"])
    for r in sorted(stages[3].collect(), key=lambda r: r["doc_id"]):
        w = r["text"].split()
        for i in range(len(w) - 99):
            assert seen.setdefault(tuple(w[i : i + 100]), r["doc_id"]) == r["doc_id"]


def test_tokens_are_those_of_the_library(stages):
    import public_tokenizers as P
    import tiktoken

    from glosswork.llm.bpe import read_ranks

    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for r in stages[5].collect():
        ids = array("I", oracle.encode_ordinary(text[r["doc_id"]])).tobytes()
        assert bytes(r["ids"]) == ids and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()


def test_awkward_rows_and_empty_table(spark):
    """Every stage keeps some of the rows and all columns; each kept row was there before; nothing comes of nothing."""
    for given in (make(spark), empty(spark)):
        docs, before = given, Counter(r["doc_id"] for r in given.collect())
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            now = Counter(r["doc_id"] for r in docs.collect())
            assert now <= before and (docs.columns == given.columns or i == 4)
            before = now
        assert bool(before) == bool(given.count()) and max(before.values(), default=1) == 1  # of equal rows one is left


def test_registered_queries():
    names = set(registry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(registry.oracle_sql()) <= names


def test_oracles_are_sql():
    from glosswork.llm import registry as own

    assert all(isinstance(sql, str) for sql in own.oracle_sql().values())


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in shared.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and roots[101] == 100
