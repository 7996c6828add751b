"""Evaluation of predicted events against gold: matching, class, slot and document metrics, errors, ablation rows.

Events are rows: article_id, event_index, event_id, ticker, company_name, event_type, event_subtype, event_summary,
evidence_span, event_arguments (map<string,string>), impact_sentiment; predicted events also have config_name.
Documents are rows: article_id, document_label, n_events; predictions also config_name, json_valid, schema_valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import similarity as S
from glosswork.functions import text as T
from glosswork.lineage import cut

THRESHOLD = 0.25
# Weights of an event match, error codes.
WHO, KIND, EVIDENCE, ARGUMENTS = 0.35, 0.35, 0.20, 0.10
CODES = {
    "missed": "E_MISSED_EVENT", "extra": "E_EXTRA_EVENT", "no_event": "E_NO_EVENT_FALSE_POSITIVE", "ticker": "E_WRONG_TICKER", "type": "E_WRONG_EVENT_TYPE",
    "impact": "E_WRONG_IMPACT", "unsupported": "E_UNSUPPORTED_ARGUMENT", "evidence": "E_BAD_EVIDENCE", "json": "E_INVALID_JSON", "schema": "E_SCHEMA_VIOLATION",
}
FIELDS = ["event_id", "ticker", "company_name", "event_type", "event_subtype", "event_summary", "evidence_span", "event_arguments", "impact_sentiment"]


def _forms() -> Column:
    """The forms in which an event is compared, made once per event and not once per pair."""
    forms = {
        "ticker": T.normalize_value(F.col("ticker")),
        "company": T.normalize_value(F.col("company_name")),
        "company_words": S.word_set(F.col("company_name")),
        "type": T.normalize_value(F.col("event_type")),
        "evidence_words": S.word_set(F.col("evidence_span")),
        "summary_words": S.word_set(F.col("event_summary")),
        "slots": S.slots(F.col("event_arguments")),
    }
    return F.struct(*[c.alias(name) for name, c in forms.items()])


def pair_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every pair of a gold and a predicted event of one article, with score and its parts. Articles have few events."""
    g = gold.select("article_id", F.col("event_index").alias("gold_index"), F.struct(*FIELDS).alias("gold"), _forms().alias("_g"))
    p = predicted.select("config_name", "article_id", F.col("event_index").alias("pred_index"), F.struct(*FIELDS).alias("pred"), _forms().alias("_p"))
    rows = p.join(g, "article_id")
    a, b = (lambda f: F.col(f"_g.{f}")), (lambda f: F.col(f"_p.{f}"))
    company = S.name_match(a("company"), b("company"), a("company_words"), b("company_words"))
    rows = rows.withColumns(
        {
            "ticker_or_company": F.greatest(S.same_value(a("ticker"), b("ticker")), company),
            "same_type": S.same_value(a("type"), b("type")),
            "evidence_overlap": F.greatest(*[S.word_overlap(a(f), b(f)) for f in ("evidence_words", "summary_words")]),
            "argument_overlap": S.argument_overlap(a("slots"), b("slots")),
        }
    ).drop("_g", "_p")
    total = WHO * F.col("ticker_or_company") + KIND * F.col("same_type") + EVIDENCE * F.col("evidence_overlap") + ARGUMENTS * F.col("argument_overlap")
    return rows.withColumn("score", F.round(total, 6))


def greedy(pairs: Column) -> Column:
    """From structs with gold_index and pred_index, in order: those whose two sides are both still free."""
    free = lambda s, p: ~F.exists(s, lambda q: (q["gold_index"] == p["gold_index"]) | (q["pred_index"] == p["pred_index"]))
    return F.aggregate(pairs, F.slice(pairs, 1, 0), lambda s, p: F.when(free(s, p), F.concat(s, F.array(p))).otherwise(s))


def match_events(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One-to-one matches per configuration and article: best score first, ties by gold, then predicted index.

    The pairs themselves go through the choice, so no score is computed a second time for a join back.
    """
    at = {c: F.col(c).cast("int") for c in ("gold_index", "pred_index")}
    rest = [c for c in pairs.columns if c not in ("config_name", "article_id", "gold_index", "pred_index")]
    # maps have no order: the struct is sorted by its first three fields, which are distinct within an article
    row = F.struct((-F.col("score")).alias("order"), *[c.alias(n) for n, c in at.items()], F.struct(*rest).alias("rest"))
    less = lambda a, b: F.when(F.struct(a["order"], a["gold_index"], a["pred_index"]) < F.struct(b["order"], b["gold_index"], b["pred_index"]), -1).otherwise(1)
    listed = pairs.where(F.col("score") >= threshold).groupBy("config_name", "article_id").agg(F.array_sort(F.collect_list(row), less).alias("_p"))
    chosen = listed.select("config_name", "article_id", F.explode(greedy(F.col("_p"))).alias("_m"))
    return chosen.select("config_name", "article_id", "_m.gold_index", "_m.pred_index", "_m.rest.*")


def sides(gold: DataFrame, predicted: DataFrame, matches: DataFrame, configs: DataFrame) -> DataFrame:
    """All events of every configuration in three kinds: match, gold (unmatched), pred (unmatched), with both events where there."""
    none = F.lit(None)
    g = configs.crossJoin(gold)  # configurations are few; each is held against all gold
    g = g.select("config_name", "article_id", F.col("event_index").alias("gold_index"), F.struct(*FIELDS).alias("gold"))
    p = predicted.select("config_name", "article_id", F.col("event_index").alias("pred_index"), F.struct(*FIELDS).alias("pred"))
    m = matches.select("config_name", "article_id", "gold_index", "pred_index", "gold", "pred", "evidence_overlap")
    kind = p.schema["pred"].dataType
    missed = g.join(m, ["config_name", "article_id", "gold_index"], "left_anti")
    extra = p.join(m, ["config_name", "article_id", "pred_index"], "left_anti")
    return (
        m.select("config_name", "article_id", F.lit("match").alias("kind"), "gold", "pred", "evidence_overlap")
        .unionByName(missed.select("config_name", "article_id", F.lit("gold").alias("kind"), "gold", none.cast(kind).alias("pred"), none.cast("double").alias("evidence_overlap")))
        .unionByName(extra.select("config_name", "article_id", F.lit("pred").alias("kind"), none.cast(kind).alias("gold"), "pred", none.cast("double").alias("evidence_overlap")))
    )


def class_counts(rows: DataFrame, field: str) -> DataFrame:
    """(config_name, label, tp, fp, fn) of a field over ``sides``; blank labels are left out."""
    a, b = F.coalesce(F.col(f"gold.{field}"), F.lit("")), F.coalesce(F.col(f"pred.{field}"), F.lit(""))
    same = (F.col("kind") == "match") & (a == b)
    votes = F.array(
        F.struct(a.alias("label"), same.cast("int").alias("tp"), F.lit(0).alias("fp"), (~same).cast("int").alias("fn")),
        F.struct(F.when(same, "").otherwise(b).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
    )
    each = rows.select("config_name", F.explode(votes).alias("v")).select("config_name", "v.*").where("label <> ''")
    return each.groupBy("config_name", "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision and recall, rounded to 6 places before they make F1."""
    p, r = S.safe_divide(tp, tp + fp), S.safe_divide(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": S.safe_divide(2 * p * r, p + r)}


def per_class(counts: DataFrame) -> DataFrame:
    return counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_micro(counts: DataFrame, name: str) -> DataFrame:
    f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    rows = counts.withColumn("_f1", f1).groupBy("config_name").agg(S.mean_or_zero(F.col("_f1")).alias(f"{name}_macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return rows.withColumn(f"{name}_micro_f1", prf(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]).drop("tp", "fp", "fn")


def best_prediction(predictions: DataFrame) -> DataFrame:
    """Per configuration and article the prediction with valid JSON, valid schema and most events; the first of equals (by ``position``)."""
    rank = F.struct(F.col("json_valid").cast("int"), F.col("schema_valid").cast("int"), F.col("n_events"), -F.col("position"))
    row = F.struct(*predictions.columns)
    return predictions.groupBy("config_name", "article_id").agg(F.max_by(row, rank).alias("_r")).select("_r.*")


def aligned_documents(gold: DataFrame, predictions: DataFrame, configs: DataFrame) -> DataFrame:
    """Gold and prediction of every article that either side has, per configuration; the missing side is NO_EVENT without events."""
    g = configs.crossJoin(gold.select("article_id", F.col("document_label").alias("gold_label"), F.col("n_events").alias("gold_events")))
    p = predictions.select("config_name", "article_id", F.col("document_label").alias("pred_label"), F.col("n_events").alias("pred_events"), "json_valid", "schema_valid")
    rows = g.join(p, ["config_name", "article_id"], "full_outer")
    return rows.select(
        "config_name",
        "article_id",
        *[F.coalesce(c, F.lit("NO_EVENT")).alias(c) for c in ("gold_label", "pred_label")],
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gold_events", "pred_events")],
        F.coalesce("json_valid", F.lit(True)).alias("json_valid"),
        F.coalesce("schema_valid", F.lit(True)).alias("schema_valid"),
    )


def has_event(label: Column, n: Column) -> Column:
    return (label == "HAS_EVENT") & (n > 0)


def document_metrics(documents: DataFrame) -> DataFrame:
    """Confusion counts of event detection, accuracy, precision, recall, F1, and rates of valid output."""
    g, p = has_event(F.col("gold_label"), F.col("gold_events")), has_event(F.col("pred_label"), F.col("pred_events"))
    n = F.count("*")
    rows = documents.groupBy("config_name").agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"),
        S.safe_divide(F.count_if("json_valid"), n).alias("json_validity_rate"), S.safe_divide(F.count_if("schema_valid"), n).alias("schema_compliance_rate"),
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    parts = {f"event_detection_{k}": v for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()}
    return rows.withColumns({"event_detection_accuracy": S.safe_divide(F.col("tp") + F.col("tn"), total), **parts})


def accuracy(rows: DataFrame, field: str, name: str) -> DataFrame:
    """Share of matches with the same value, among matches with a gold value."""
    a, b = T.normalize_value(F.col(f"gold.{field}")), T.normalize_value(F.col(f"pred.{field}"))
    m = rows.where("kind = 'match'").withColumns({"_a": a, "_b": b})
    return m.groupBy("config_name").agg(S.safe_divide(F.count_if((F.col("_a") != "") & (F.col("_a") == F.col("_b"))), F.count_if(F.col("_a") != "")).alias(name))


def slot_metrics(rows: DataFrame) -> DataFrame:
    """Slots of matched events: a matching value is a true positive, a wrong one counts as missed and as extra."""
    m = rows.where("kind = 'match'").select("config_name", S.slots(F.col("gold.event_arguments")).alias("g"), S.slots(F.col("pred.event_arguments")).alias("p"))
    tp = F.size(F.filter(F.map_keys("g"), lambda k: F.coalesce(S.slot_match(F.element_at("g", k), F.element_at("p", k)), F.lit(False))))
    each = m.select("config_name", tp.alias("tp"), F.size("g").alias("ng"), F.size("p").alias("np"))
    sums = each.groupBy("config_name").agg(F.sum("tp").alias("tp"), (F.sum("np") - F.sum("tp")).alias("fp"), (F.sum("ng") - F.sum("tp")).alias("fn"))
    return sums.withColumns({f"slot_{k}": v for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def errors(documents: DataFrame, rows: DataFrame, unsupported: DataFrame | None = None) -> DataFrame:
    """(config_name, article_id, event_id, error_code, gold_event_type, pred_event_type, details), one row per error.

    A predicted event in an article without gold events counts at the document and again per event.
    """
    blank = F.lit("")

    def row(df: DataFrame, code, event=blank, gold=blank, pred=blank, details=blank) -> DataFrame:
        code = F.lit(CODES[code]) if isinstance(code, str) else code
        text = lambda c: F.coalesce(c, blank)
        return df.select("config_name", "article_id", text(event).alias("event_id"), code.alias("error_code"), text(gold).alias("gold_event_type"), text(pred).alias("pred_event_type"), text(details).alias("details"))

    g, p = has_event(F.col("gold_label"), F.col("gold_events")), has_event(F.col("pred_label"), F.col("pred_events"))
    out = row(documents.where(~F.col("json_valid")), "json").union(row(documents.where(~F.col("schema_valid")), "schema")).union(row(documents.where(~g & p), "no_event"))
    gold, pred = F.col("gold.event_type"), F.col("pred.event_type")
    out = out.union(row(rows.where("kind = 'gold'"), "missed", F.col("gold.event_id"), gold))
    with_gold = documents.select("config_name", "article_id", g.alias("_has"))
    extra = rows.where("kind = 'pred'").join(with_gold, ["config_name", "article_id"], "left")
    code = F.when(F.coalesce("_has", F.lit(False)), CODES["extra"]).otherwise(CODES["no_event"])
    out = out.union(row(extra, code, pred=pred))
    same = lambda f: S.exact_match(F.col(f"gold.{f}"), F.col(f"pred.{f}")) > 0
    wrong = F.array_compact(
        F.array(
            F.when((T.normalize_value(F.col("gold.ticker")) != "") & ~same("ticker"), CODES["ticker"]),
            F.when(~same("event_type"), CODES["type"]),
            F.when(~same("impact_sentiment"), CODES["impact"]),
            F.when(F.coalesce("evidence_overlap", F.lit(0.0)) <= 0, CODES["evidence"]),
        )
    )
    matched = rows.where("kind = 'match'").withColumn("_code", F.explode(wrong))
    out = out.union(row(matched, F.col("_code"), F.col("gold.event_id"), gold, pred))
    if unsupported is not None:
        out = out.union(row(unsupported, "unsupported", F.col("event_id"), details=F.col("field")))
    return out


def error_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("error_code").agg(F.count("*").alias("count")).orderBy("error_code")


HALLUCINATION = ["unsupported_field_rate", "evidence_coverage", "unsupported_event_rate", "groundedness_score"]


def hallucination(predictions: DataFrame) -> DataFrame:
    """Per configuration, means over the predictions with any verification metric (columns of HALLUCINATION, run metrics already
    put over those of the report). The rate after verification is 0 by definition."""
    any_metric = F.coalesce(*[F.col(c).cast("string") for c in HALLUCINATION]).isNotNull()
    mean = lambda c: S.mean_or_zero(F.when(any_metric, S.tolerant_double(F.col(c))))
    return predictions.groupBy("config_name").agg(
        F.count("*").alias("run_count"), F.count_if(any_metric).alias("run_count_with_verification"), mean("unsupported_field_rate").alias("pre_verification_hallucination_rate"),
        F.lit(0.0).alias("post_verification_hallucination_rate"), *[mean(c).alias(c) for c in HALLUCINATION[1:]],
    )


def evaluate(gold_events: DataFrame, gold_documents: DataFrame, pred_events: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """All results, for every configuration in one pass: metrics, matches, per_event_type, errors, documents."""
    configs = predictions.select("config_name").distinct()
    matches = cut(match_events(pair_scores(gold_events, pred_events)))  # five results read them
    rows = sides(gold_events, pred_events, matches, configs)
    documents = aligned_documents(gold_documents, predictions, configs)
    types, impacts = class_counts(rows, "event_type"), class_counts(rows, "impact_sentiment")
    metrics = document_metrics(documents).drop("tp", "fp", "fn", "tn")
    for part in [
        macro_micro(types, "event_type"), macro_micro(impacts, "impact_sentiment"), accuracy(rows, "ticker", "ticker_accuracy"),
        accuracy(rows, "event_subtype", "event_subtype_accuracy"), slot_metrics(rows).drop("tp", "fp", "fn"),
    ]:
        metrics = metrics.join(part, "config_name", "left")
    metrics = metrics.fillna(0.0)
    return {"metrics": metrics, "matches": matches, "per_event_type": per_class(types), "errors": errors(documents, rows), "documents": documents}


def outcomes(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """Articles per configuration and outcome: schema_error, empty, perfect, partial or no_match."""
    n = matches.groupBy("config_name", "article_id").agg(F.count("*").alias("_m"))
    rows = documents.join(n, ["config_name", "article_id"], "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    kind = (
        F.when(~F.col("json_valid") | ~F.col("schema_valid"), "schema_error")
        .when((F.col("gold_events") == 0) & (F.col("pred_events") == 0), "empty")
        .when((F.col("_m") == F.col("gold_events")) & (F.col("_m") == F.col("pred_events")), "perfect")
        .when(F.col("_m") > 0, "partial")
        .otherwise("no_match")
    )
    return rows.groupBy("config_name", kind.alias("outcome")).agg(F.count("*").alias("n"))


def best_config(rows: DataFrame) -> DataFrame:
    """The configuration with the best type F1, then slot F1, groundedness and detection F1; ties by name."""
    keys = ["event_type_macro_f1", "slot_f1", "groundedness_score", "event_detection_f1"]
    return rows.orderBy(*[S.tolerant_double(F.col(k)).desc() for k in keys if k in rows.columns], "config_name").limit(1)


def worst_types(rows: DataFrame, n: int = 8) -> DataFrame:
    return rows.orderBy("f1", F.col("fn").desc(), F.col("fp").desc(), "label").limit(n)


def with_hallucination(metrics: DataFrame, extra: DataFrame) -> DataFrame:
    """Metric rows left-joined with hallucination rows; where both have a column the latter counts."""
    both = [c for c in metrics.columns if c in extra.columns and c != "config_name"]
    rows = metrics.join(extra.select("config_name", *[F.col(c).alias(f"_{c}") if c in both else F.col(c) for c in extra.columns if c != "config_name"]), "config_name", "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in both}).drop(*[f"_{c}" for c in both]) if both else rows
