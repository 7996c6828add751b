"""Retrieval queries from articles and from gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T

NO_TEXTS = "array<string>"


def _texts(name: str, df: DataFrame, upper: bool = False) -> Column:
    c = F.coalesce(F.col(name), F.array().cast(NO_TEXTS)) if name in df.columns else F.array().cast(NO_TEXTS)
    return F.transform(c, F.upper) if upper else c


def _words(*parts: Column) -> Column:
    return F.trim(F.array_join(F.concat(*parts), " "))


def _query(kind: Column | str, text: Column, weight: float, keywords: Column, types: Column, subtypes: Column, intent: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("query_type"),
        text.alias("raw_text"),
        F.lit(weight).alias("weight"),
        keywords.alias("event_keywords"),
        types.alias("event_type_hints"),
        subtypes.alias("event_subtype_hints"),
        (none if intent is None else F.concat(F.lit("event:"), intent)).alias("intent_key"),
        (none if intent is None else intent).alias("intent_event_type"),
    )


def build_queries(articles: DataFrame, mode: str = "legacy") -> DataFrame:
    """Up to four views of each article (title, tickers, companies, types), else its first 80 words; ``event_intent``
    adds one query per event type. The first of queries with the same normalised text stays."""
    if mode not in ("legacy", "event_intent"):
        raise ValueError(f"unknown query mode {mode!r}")
    title = T.normalize_text(F.col("title")) if "title" in articles.columns else F.lit("")
    rows = articles.select(
        F.coalesce(F.nullif(F.col("article_id").cast("string"), F.lit("")), F.lit("input")).alias("article_id"),
        title.alias("_title"),
        T.normalize_text(F.col("text")).alias("_text"),
        _texts("tickers_hint", articles, True).alias("tickers"),
        _texts("company_names_hint", articles).alias("company_names"),
        _texts("event_keywords", articles).alias("_keywords"),
        _texts("event_type_hints", articles, True).alias("_types"),
        _texts("event_subtype_hints", articles, True).alias("_subtypes"),
        *([F.col("event_keyword_matches")] if "event_keyword_matches" in articles.columns else []),
    )
    k, y, s = F.col("_keywords"), F.col("_types"), F.col("_subtypes")
    one = F.array(F.col("_title"))
    views = [
        _query("title", F.col("_title"), 1.0, k, y, s),
        _query("ticker_event", _words(F.col("tickers"), k, one), 1.0, k, y, s),
        _query("company_event", _words(F.col("company_names"), k), 0.85, k, y, s),
        _query("event_type", _words(y, s, k), 0.65, k, y, s),
    ]
    found = F.filter(F.array(*views), lambda q: q["raw_text"] != "")
    body = F.array_join(F.slice(T.split_blank(F.col("_text")), 1, 80), " ")
    fallback = F.when(F.col("_text") != "", F.array(_query("body_fallback", body, 0.7, k, y, s))).otherwise(F.slice(F.array(views[0]), 1, 0))
    rows = rows.withColumn("_queries", T.let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(fallback)))
    if mode == "event_intent":
        rows = rows.withColumn("_queries", F.concat("_queries", _intents(rows)))
    each = rows.select("article_id", "tickers", "company_names", F.posexplode("_queries").alias("position", "_q")).select(
        "article_id", "position", "tickers", "company_names", "_q.*"
    )
    return _finished(each)


def _intents(rows: DataFrame) -> Column:
    if "event_keyword_matches" in rows.columns:
        of = lambda t: F.filter("event_keyword_matches", lambda m: F.upper(m["event_type"]) == t)
        words = lambda t: F.array_distinct(F.filter(F.transform(of(t), lambda m: T.settle(m["keyword"])), lambda w: w != ""))
        subs = lambda t: F.array_distinct(F.filter(F.transform(of(t), lambda m: F.upper(m["event_subtype"])), lambda w: w != ""))
    else:
        words = subs = lambda t: F.array().cast(NO_TEXTS)

    def some(a: Column, b: Column) -> Column:
        return F.when(F.size(a) > 0, a).otherwise(b)

    def intent(t: Column) -> Column:
        kw, sub = some(words(t), F.col("_keywords")), some(subs(t), F.col("_subtypes"))
        text = _words(F.col("tickers"), F.col("company_names"), F.array(t), sub, kw, F.filter(F.array("_title"), lambda x: x != ""))
        return _query(F.concat(F.lit("event_intent_"), F.lower(t)), text, 0.95, kw, F.array(t), sub, t)

    return F.transform("_types", intent)


def _finished(each: DataFrame) -> DataFrame:
    digest = F.substring(F.sha1(F.concat_ws(":", "article_id", "query_type", "raw_text")), 1, 10)
    rows = each.select(
        F.concat_ws("_", "article_id", "query_type", digest).alias("query_id"), "*", T.normalize_text(F.col("raw_text")).alias("text")
    ).drop("raw_text")
    return dedupe_queries(rows)


def dedupe_queries(queries: DataFrame) -> DataFrame:
    """The first query of each normalised text per article; empty ones go."""
    rows = queries.withColumn("_key", F.lower(T.normalize_text(F.col("text")))).where("_key <> ''")
    order = Window.partitionBy("article_id", "_key").orderBy("position")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_key", "_n")


def build_gold_queries(events: DataFrame) -> DataFrame:
    """One query per gold event (article_id, event_index, ticker, company_name, event_type, event_subtype, event_summary, evidence_span)."""
    some = lambda *c: F.filter(F.array(*c), lambda x: F.coalesce(x, F.lit("")) != "")
    ticker, kind, sub = F.upper("ticker"), F.upper("event_type"), F.upper("event_subtype")
    named = F.coalesce(F.nullif(kind, F.lit("")), F.format_string("%02d", "event_index"))
    rows = events.select(
        "article_id",
        F.col("event_index").alias("position"),
        F.format_string("gold_event_%02d", "event_index").alias("query_type"),
        F.trim(F.array_join(some(ticker, F.col("company_name"), kind, sub, F.col("event_summary"), F.col("evidence_span")), " ")).alias("raw_text"),
        F.lit(1.0).alias("weight"),
        some(ticker).alias("tickers"),
        some(F.col("company_name")).alias("company_names"),
        F.array().cast(NO_TEXTS).alias("event_keywords"),
        some(kind).alias("event_type_hints"),
        some(sub).alias("event_subtype_hints"),
        F.concat(F.lit("gold_event:"), named).alias("intent_key"),
        F.nullif(kind, F.lit("")).alias("intent_event_type"),
    )
    return _finished(rows)
