"""Small document tables with the cases that every operator must define."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, word string, shard int"

BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall green trees and sing quiet songs".split()


def documents():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, and clashing extra columns."""
    passage = " ".join(BASE)
    rows = [
        (1, passage + " one", "en", "a", 10),
        (2, "start here " + passage + " two", "en", "a", 11),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", None, 4),
        (6, "Und " * 40, "de", "b", 160),
        (7, passage + " one", "fr", "a", 10),
        (7, passage + " one", "fr", "a", 10),
        (None, passage + " one", "en", "a", 10),
        (9, "\n".join(["same line here"] * 3 + ["ünïcode wörds ÀÉ %%% &&& 日本語 😀"]), "es", "c", 7),
        (10, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "c", 150_000),
        (11, "short", "en", "c", 5),
    ]
    return [(*r, 0.5, "clash", 3) for r in rows]


def make(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)
