"""Queries over rows that the given tables do not have, against their SQL."""

import duckdb
import pandas as pd
import pytest

from glosswork.plans import registry
from tests.test_oracles import rows

TEXTS = ["one line of words", "", " \n ", "\n\nsecond line of words\nthird", " " * 40 + "far from the margin", None, "first line\nsecond", "no such text"]


def both(spark, folder, name, **tables):
    """Rows of a query over tables in a folder, and those of its SQL."""
    duck = duckdb.connect()
    for t, frame in tables.items():
        frame.to_parquet(folder / f"{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = registry.queries()[name](spark, str(folder)).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got), rows(want)


def documents(texts, ids=None):
    frame = pd.DataFrame({"doc_id": ids or range(1, len(texts) + 1), "text": pd.Series(texts, dtype=object), "lang": "en", "source": "s"})
    return frame.assign(n_chars=[len(t or "") for t in texts])


@pytest.mark.parametrize("name", ["pat01_patterns", "agg22_pattern_counts", "str25_retrieval_text", "val01_val02_issue_counts"])
def test_blank_and_repeated_documents(spark, tmp_path, name):
    ids = [*range(1, len(TEXTS) + 1), 1, 1, 2]
    got, want = both(spark, tmp_path, name, documents=documents([*TEXTS, TEXTS[0], TEXTS[0], TEXTS[1]], ids))
    assert got == want


def test_vectors_are_scaled_in_their_own_precision(spark, tmp_path):
    vectors = pd.DataFrame({"vec_id": [1, 2], "embedding": [pd.Series([0.076, -0.2765], dtype="float32").to_numpy(), pd.Series([0.0005, 0.5], dtype="float32").to_numpy()]})
    got, want = both(spark, tmp_path, "db05_vector_literal", embeddings=vectors)
    assert got == want
