"""Inline dictionaries and derived articles that queries and oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators import dictionaries as D
from glosswork.session import table

#: ticker, company_name, aliases, sector
COMPANIES = [
    ("THE", "Thtion", ["anblewh", "Erentin"], "ENERGY"),
    ("DER", "Einachie", ["ungheit"], "BANKING"),
    ("UND", "Lichung", [], "ENERGY"),
    ("EAU", "Éeuxmentre", ["eaupaè"], "RETAIL"),
    ("LAS", "Ciónazde", ["óncies"], "RETAIL"),
    ("OFA", "Hewhon", ["thatsh"], ""),
    ("ING", "Ingstre", ["ertithe"], "TECH"),
]
#: event_type, event_subtype, keyword, polarity_hint, priority
KEYWORDS = [
    ("CONTRACT", "SIGNED", "tionnt", "positive", 3),
    ("CONTRACT", "AWARDED", "éreau", "positive", 3),
    ("DIVIDEND", "CASH", "lichkeit", "neutral", 2),
    ("DIVIDEND", "", "ciónde", "neutral", 2),
    ("LEGAL_RISK", "LAWSUIT", "idiot", "negative", 5),
    ("LEGAL_RISK", "FINE", "worthless", "negative", 4),
    ("EXPANSION", "PLANT", "ouonré", "positive", 1),
]


def companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*c, None, None, None, None, None) for c in COMPANIES], D.COMPANY)


def given_companies(spark: SparkSession, sf_dir: str, tickers: int | None = None) -> DataFrame:
    """Suppliers as companies, their nation as alias; with ``tickers`` so many of these are shared by all."""
    key = F.col("s_suppkey") if tickers is None else F.col("s_suppkey") % tickers
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.concat(F.lit("S"), key).alias("ticker"), F.col("s_name").alias("company_name"), F.array("n_name", F.lower("n_name"), F.lit(" ")).alias("aliases"),
        F.when(F.col("s_acctbal") > 5000, F.col("n_name")).alias("sector"), F.when(F.col("s_suppkey") % 3 == 0, "HSX").alias("exchange"), F.when(F.col("s_suppkey") % 2 == 0, "DELISTED").alias("status"),
    )


def given_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as keywords."""
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("event_type"), F.col("p_brand").alias("event_subtype"), F.col("p_name").alias("keyword"), F.lit("neutral").alias("polarity_hint"), F.col("p_size").cast("int").alias("priority")
    )


GIVEN_SQL = """
c AS (SELECT s_suppkey, s_name, n_name, CASE WHEN s_acctbal > 5000 THEN n_name END AS sector, CASE WHEN s_suppkey % 3 = 0 THEN 'HSX' END AS exchange, CASE WHEN s_suppkey % 2 = 0 THEN 'DELISTED' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, "") for k in KEYWORDS], D.KEYWORD)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("article_id"), "doc_id", "text", "source", F.lit("vi").alias("language"), F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id").alias("url")
    )


def _values(rows: list[tuple]) -> str:
    def one(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
        return str(v) if isinstance(v, int) else f"'{v}'"

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


COMPANY_SQL = f"companies(ticker, company_name, aliases, sector) AS (VALUES {_values(COMPANIES)})"
KEYWORD_SQL = f"keywords(event_type, event_subtype, keyword, polarity_hint, priority) AS (VALUES {_values(KEYWORDS)})"
