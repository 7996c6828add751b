"""Every query with an oracle against DuckDB, the others for rows, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from glosswork.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: For each query without an oracle: the columns that name a row (distinct together; none where pages repeat), and the
#: least number of rows.
KEYS = {
    "agg16_verification_metrics": (["article_id"], 20), "evl05_report": (["markdown"], 1), "ext01_page_inputs": ([], 30), "ext07_public_results": (["article_id"], 20),
    "htm01_parse_pages": (["page_id"], 50), "htm03_article_trees": (["page_id"], 50), "htm06_links": (["page_id", "url", "link_text"], 50), "ret04_retrieve_hybrid": (["case_id", "rank"], 4),
    "ret13_deterministic_judgments": (["case_id", "chunk_id"], 4), "ret14_judged_rerank": (["case_id", "rank"], 4), "ret17_prompts": (["case_id"], 4), "ret21_context_diversity": (["case_id"], 4),
    "sim04_sequence_ratio": (["item_id"], 30), "src08_ingest_pages": (["content_hash"], 20), "str18_preprocess": (["doc_id"], 200), "sup18_selection_parts": (["case_id", "rank"], 4), "top07_candidate_dedupe": (["case_id", "rank"], 10),
    "top10_coverage_mmr": (["case_id", "rank"], 4), "ver01_verified_events": (["article_id", "event_id"], 10),
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.integer, np.floating)):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_case_without_event_types(spark, tmp_path):
    """Case d50's contexts have no event type at all: SQL has no row of it."""
    texts = {0: "tionnt wordone wordtwo wordthree", 1: "tionnt wordone lichkeit", 50: "nothing known herein", 51: "nothing known anywhere"}
    documents = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values()), "source": "s"})
    documents.to_parquet(tmp_path / "documents.parquet")
    name = "ret21_case_diversity"
    want = duckdb.connect().execute(registry.oracle_sql()[name].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).fetchdf()
    assert list(want.case_id) == ["d0"]
    assert rows(registry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    """What SQL cannot follow: rows that are there, named once, without holes; models in test_models check the values."""
    keys, least = KEYS[name]
    rows = registry.queries()[name](spark, SF).toPandas()
    assert len(rows) >= least and not rows[keys].isna().any().any() and not (keys and rows.duplicated(keys).any())
    for ranked in [c for c in rows.columns if c == "rank"]:
        assert (rows.groupby("case_id")[ranked].max() == rows.groupby("case_id")[ranked].count()).all()  # 1, 2, 3, ...
    for share in [c for c in rows.columns if c.endswith(("_rate", "_coverage", "groundedness_score", "ratio"))]:
        assert rows[share].dropna().between(0, 1).all()


def test_every_query_without_an_oracle_is_described():
    assert set(KEYS) == set(registry.queries()) - set(registry.oracle_sql())


def test_oracles_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
