"""Reranking by relevance judgments, pointwise and listwise, with a deterministic stand-in for the judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import json as J
from glosswork.functions import text as T

# Scores of relevance labels and weights of the listwise blend.
LABEL_SCORES = {"HIGH": 0.92, "MEDIUM": 0.72, "LOW": 0.45, "IRRELEVANT": 0.05}
LIST_HYBRID, LIST_MODEL = 0.35, 0.65


def judgment_score(score: Column, label: Column) -> Column:
    """The numeric score within 0..1, else that of the label, else 0."""
    known = F.create_map(*[F.lit(x) for kv in LABEL_SCORES.items() for x in kv])
    clamped = F.when(score.isNotNull(), F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(clamped, F.element_at(known, F.upper(F.coalesce(label, F.lit("IRRELEVANT")))), F.lit(0.0))


def deterministic_judgments(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, chunk_id, relevance_label, relevance_score) from the overlap of each candidate's hints with the case's first query."""
    first = queries.groupBy(F.col("article_id").alias("case_id")).agg(F.min_by(F.struct("tickers", "event_type_hints"), "position").alias("_q"))
    hints = chunks.select("chunk_id", F.transform("tickers_hint", F.upper).alias("_t"), F.transform("event_type_hints", F.upper).alias("_y"), (F.size("event_keywords") > 0).alias("_k"))
    rows = candidates.select("case_id", "chunk_id").join(first, "case_id").join(hints, "chunk_id")
    company = F.arrays_overlap(F.transform("_q.tickers", F.upper), "_t")
    kind = F.arrays_overlap(F.transform("_q.event_type_hints", F.upper), "_y")
    event = F.col("_k") | (F.size("_y") > 0)
    label = F.when(company & kind & event, "HIGH").when(company | kind, "MEDIUM").when(event, "LOW").otherwise("IRRELEVANT")
    rows = rows.select("case_id", "chunk_id", label.alias("relevance_label"))
    return rows.withColumn("relevance_score", judgment_score(F.lit(None), F.col("relevance_label")))


def apply_judgments(candidates: DataFrame, judgments: DataFrame, hybrid_weight: float = 0.40, model_weight: float = 0.60) -> DataFrame:
    """Blend of score and judgment, ranked anew (ties by the old rank)."""
    rows = candidates.join(judgments.select("case_id", "chunk_id", "relevance_label", "relevance_score"), ["case_id", "chunk_id"], "left")
    model = judgment_score(F.col("relevance_score"), F.col("relevance_label"))
    rows = rows.withColumn("score", F.round(hybrid_weight * F.col("score") + model_weight * model, 6)).withColumn("_old", F.col("rank"))
    order = Window.partitionBy("case_id").orderBy(F.col("score").desc(), F.col("_old"))
    return rows.withColumn("rank", F.row_number().over(order)).drop("_old", "relevance_label", "relevance_score")


def candidate_aliases(rank: Column, chunk_id: Column) -> Column:
    """The names that a judge may use for a candidate: 1, C1, C001 or its id."""
    return F.array(rank.cast("string"), F.concat(F.lit("C"), rank), F.format_string("C%03d", rank), chunk_id.cast("string"))


def parse_listwise(raw: Column) -> Column:
    """The array of ids that a judge's output lists, null if it lists none."""
    value = J.extract_json(raw)
    as_array = F.try_variant_get(value, "$", "array<string>")
    keys = ["ranked_candidate_ids", "ranked_ids", "ranking", "ranked_chunk_ids"]
    lists = [F.try_variant_get(value, f"$.{k}", "array<string>") for k in keys]
    picked = F.coalesce(as_array, *[F.when(F.size(x) > 0, x) for x in lists])
    return F.when(F.size(picked) > 0, picked)


def apply_listwise(candidates: DataFrame, orders: DataFrame, top_n: int) -> DataFrame:
    """The first top_n candidates in the order of the judge's ids (case_id, ids), those it left out after them, then the rest
    with their old rank and score. The shown score blends old score and place; it does not set the order."""
    head = candidates.where(F.col("rank") <= top_n)
    listed = orders.select("case_id", F.posexplode("ids").alias("_place", "_id"))
    named = head.select("case_id", "chunk_id", F.explode(candidate_aliases(F.col("rank"), F.col("chunk_id"))).alias("_id"))
    place = named.join(listed, ["case_id", "_id"]).groupBy("case_id", "chunk_id").agg(F.min("_place").alias("_place"))
    rows = head.join(place, ["case_id", "chunk_id"], "left")
    case = Window.partitionBy("case_id")
    new = F.row_number().over(case.orderBy(F.col("_place").asc_nulls_last(), "rank"))
    rows = rows.withColumns({"_new": new, "_n": F.count("*").over(case), "_top": F.max("score").over(case)})
    shown = LIST_HYBRID * F.col("score") / F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top")) + LIST_MODEL * (F.col("_n") - F.col("_new") + 1) / F.col("_n")
    moved = rows.withColumns({"rank": F.col("_new").cast("int"), "score": F.round(shown, 6)}).drop("_new", "_n", "_top", "_place")
    return moved.unionByName(candidates.where(F.col("rank") > top_n))


def deterministic_order(judgments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case_id, ids): candidates by falling judgment, ties by rank, named by their rank."""
    rows = judgments.join(candidates.select("case_id", "chunk_id", "rank"), ["case_id", "chunk_id"])
    key = F.struct((-judgment_score(F.col("relevance_score"), F.col("relevance_label"))).alias("s"), F.col("rank"))
    ordered = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(key)).alias("_o"))
    return ordered.select("case_id", F.transform("_o", lambda o: o["rank"].cast("string")).alias("ids"))


def prompt(candidates: DataFrame, queries: DataFrame, most_chars: int = 600) -> DataFrame:
    """(case_id, prompt): a JSON request with the first query and the candidates in order."""
    first = queries.groupBy(F.col("article_id").alias("case_id")).agg(F.min_by(F.struct("query_id", "text", "query_type"), "position").alias("query"))
    item = F.struct("rank", "chunk_id", "score", T.truncate_chars(F.col("text"), most_chars).alias("text"))
    listed = candidates.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    return listed.join(first, "case_id").select("case_id", F.to_json(F.struct("query", "candidates")).alias("prompt"))
