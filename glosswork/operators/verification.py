"""Evidence verification of draft extractions, the rule extractor, and pattern records.

Draft events are rows: article_id, event_index, event_id, event_type, event_subtype, ticker, company_name, impact_sentiment,
evidence_span, event_arguments (map<string,string>), confidence. Articles have title, text and hint arrays. Contexts are rows:
article_id, position, chunk_id, title, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import json as J
from glosswork.functions import similarity as S
from glosswork.functions import text as T
from glosswork.lineage import cut
from glosswork.operators.validation import Taxonomy, grounding_text

EVIDENCE, ARGUMENT = 0.82, 0.78
# The arguments of which an event type needs one, caps of confidence, types with a sign, confidence bonuses.
CORE = {
    "MA": ["buyer", "seller", "target_company", "stake_percentage", "transaction_value"],
    "CONTRACT": ["partner", "project", "product", "package_name", "contract_value"],
    "CAPITAL": ["share_volume", "issue_price", "capital_before", "capital_after", "bond_value"],
    "LEADERSHIP": ["person", "role", "action"],
    "EXPANSION": ["project", "location", "investment_value", "capacity", "market"],
    "LEGAL_RISK": ["legal_authority", "violation", "case_name", "penalty_value"],
    "PARTNERSHIP": ["partner", "agreement_type", "partnership_scope", "project"],
    "LICENSE_APPROVAL": ["legal_authority", "approval_type", "project", "license_id"],
    "BUSINESS_RESULT": ["period", "revenue", "profit", "growth_rate", "cause"],
    "ASSET_TRANSACTION": ["asset_name", "asset_type", "buyer", "seller", "transaction_value"],
    "DEBT_CREDIT": ["lender", "borrower", "loan_value", "credit_limit", "bond_code"],
    "DIVIDEND_SHAREHOLDER": ["dividend_type", "dividend_rate", "record_date", "payment_date"],
    "PRODUCT_SERVICE": ["product", "launch_date", "market", "price_change"],
    "MARKET_LISTING": ["exchange", "ticker", "listing_date", "status", "reason"],
    "ESG_OPERATIONAL_RISK": ["incident_type", "location", "impact_scope", "legal_authority"],
}
CAP_UNSUPPORTED, CAP_CORE, CAP_POSITIVE_RISK, CAP_NEGATIVE_GROWTH = 0.7, 0.75, 0.65, 0.7
GROWTH = ["CONTRACT", "EXPANSION", "PARTNERSHIP"]
BASE, PER_TYPE, PER_TICKER, PER_EVIDENCE, PER_KEYWORD, MOST = 0.52, 0.15, 0.10, 0.12, 0.06, 0.92
POSITIVE, NEGATIVE = ["CAPITAL", "CONTRACT", "EXPANSION", "LICENSE_APPROVAL", "MA", "PARTNERSHIP"], ["LEGAL_RISK"]

SUPPORTED = ("SUPPORTED", "PARTIALLY_SUPPORTED")


def _supported(match: Column) -> Column:
    return match["support"].isin(*SUPPORTED)


def unsupported_fields(predictions: DataFrame) -> DataFrame:
    """(config_name, article_id, event_id, field) of the unsupported fields in verification reports (``report``: VARIANT);
    entries that are no objects are left out."""
    items = F.try_variant_get("report", "$.unsupported_fields", "array<variant>")
    each = predictions.select("config_name", "article_id", F.explode(items).alias("_i")).where(J.is_object(F.col("_i")))
    return each.select("config_name", "article_id", J.field(F.col("_i"), "event_id").alias("event_id"), J.field(F.col("_i"), "field").alias("field"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores: comparing windows costs far more than moving the rows."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "article_id", *keys)


def evidence_support(events: DataFrame, articles: DataFrame, contexts: DataFrame | None = None, threshold: float = EVIDENCE) -> DataFrame:
    """events with ``evidence``: the article's match if it supports the span, else the first supporting context in order,
    else the best of all. Contexts are compared only where the article gives no support."""
    text = articles.select("article_id", grounding_text(F.col("title"), F.col("text")).alias("_text"))
    rows = _dealt(events.join(text, "article_id", "left"), "event_index").withColumn("evidence", S.find_text_match(T.normalize_text(F.col("evidence_span")), F.coalesce("_text", F.lit("")), threshold))
    rows = rows.withColumn("evidence_source", F.when(_supported(F.col("evidence")), "article")).drop("_text")
    if contexts is None:
        return rows
    key = ["article_id", "event_index"]
    open_ = rows.where("evidence_source IS NULL").select(*key, "evidence_span", F.col("evidence.score").alias("_score"))
    c = contexts.select("article_id", "position", "chunk_id", grounding_text(F.col("title"), F.col("text")).alias("_text"))
    found = open_.join(c, "article_id").withColumn("_m", S.find_text_match(T.normalize_text(F.col("evidence_span")), F.col("_text"), threshold))
    best = found.groupBy(*key).agg(
        F.min_by(F.when(_supported(F.col("_m")), F.struct("_m", "chunk_id")), F.when(_supported(F.col("_m")), F.col("position"))).alias("_first"),
        F.max_by(F.struct("_m", "chunk_id"), F.struct("_m.score", -F.col("position"))).alias("_best"),
    )
    out = rows.join(best, key, "left")
    other = F.coalesce("_first", F.when(F.col("_best._m.score") > F.col("evidence.score"), F.col("_best")))
    return out.withColumn("evidence_source", F.coalesce("evidence_source", F.when(F.col("_first").isNotNull(), F.concat(F.lit("context:"), "_first.chunk_id")))).withColumn(
        "evidence", F.coalesce(other["_m"], F.col("evidence"))
    ).drop("_first", "_best")


def argument_support(events: DataFrame, articles: DataFrame, threshold: float = ARGUMENT) -> DataFrame:
    """(article_id, event_index, key, value, match) of each filled argument, against evidence, title and text."""
    text = articles.select("article_id", grounding_text(F.col("title"), F.col("text")).alias("_text"))
    each = events.select("article_id", "event_index", "evidence_span", F.explode("event_arguments").alias("key", "value"))
    each = each.withColumn("value", J.flat_text("value")).where(T.has_value(F.col("value"))).join(text, "article_id", "left")
    each = _dealt(each, "event_index", "key")
    whole = F.concat_ws("\n", "evidence_span", F.coalesce("_text", F.lit("")))
    return each.select("article_id", "event_index", "key", "value", S.find_text_match(F.col("value"), whole, threshold).alias("match"))


def verify(events: DataFrame, articles: DataFrame, taxonomy: Taxonomy, contexts: DataFrame | None = None) -> dict[str, DataFrame]:
    """events kept, with unsupported arguments and subtypes as null, capped confidence and warnings; dropped events with
    reason; field checks; and metrics per article."""
    key = ["article_id", "event_index"]
    typed = events.withColumns({"event_type": F.upper(F.trim("event_type")), "event_subtype": T.nullable_upper(F.col("event_subtype"))})
    bad_subtype = F.col("event_subtype").isNotNull() & ~F.array_contains(taxonomy.allowed_subtypes(F.col("event_type")), F.col("event_subtype"))
    typed = typed.withColumn("_repaired", F.coalesce(bad_subtype, F.lit(False)).cast("int")).withColumn("event_subtype", F.when(~bad_subtype, F.col("event_subtype")))
    known = taxonomy.known(F.col("event_type"))
    # fuzzy matching is the dear part, and four results read it: written once
    checked = cut(evidence_support(typed.where(known), articles, contexts))
    kept = checked.where(_supported(F.col("evidence")))
    fuzzy = F.col("evidence.match_type") == "fuzzy"
    kept = kept.withColumn("evidence_span", F.when(fuzzy, F.col("evidence.matched_text")).otherwise(F.col("evidence_span"))).withColumn("_repaired", F.col("_repaired") + F.coalesce(fuzzy.cast("int"), F.lit(0)))
    arguments = cut(argument_support(kept, articles))
    lost = arguments.where(~_supported(F.col("match"))).groupBy(*key).agg(F.collect_set("key").alias("_lost"))
    out = kept.join(lost, key, "left").withColumn("_lost", F.coalesce("_lost", F.array().cast("array<string>")))
    filled = F.map_filter(F.transform_values("event_arguments", lambda k, v: F.when(F.array_contains("_lost", k), F.lit(None).cast("string")).otherwise(v)), lambda k, v: T.has_value(v))
    out = out.withColumn("event_arguments", F.transform_values("event_arguments", lambda k, v: F.when(F.array_contains("_lost", k), F.lit(None).cast("string")).otherwise(v)))
    groups = F.create_map(*[x for k, v in CORE.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    core = F.try_element_at(groups, F.col("event_type"))
    no_core = F.coalesce(core.isNotNull() & ~F.arrays_overlap(F.map_keys(filled), core), F.lit(False))
    risk = (F.col("event_type") == "LEGAL_RISK") & (F.col("impact_sentiment") == "POSITIVE")
    shrink = F.col("event_type").isin(*GROWTH) & (F.col("impact_sentiment") == "NEGATIVE")
    cap = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(1e9))
    limit = F.least(cap(F.size("_lost") > 0, CAP_UNSUPPORTED), cap(no_core, CAP_CORE), cap(risk, CAP_POSITIVE_RISK), cap(shrink, CAP_NEGATIVE_GROWTH))
    notes = F.array_compact(
        F.array(
            F.when(no_core, F.concat("event_id", F.lit(":missing_core_argument_for_"), F.lower("event_type"))),
            F.when(risk, F.concat("event_id", F.lit(":legal_risk_positive_sentiment_needs_review"))),
            F.when(shrink, F.concat("event_id", F.lit(":negative_growth_event_needs_strong_evidence"))),
        )
    )
    out = out.withColumn("warnings", notes).withColumn("confidence", F.when(F.col("confidence").isNotNull(), F.round(F.least(F.col("confidence"), limit), 6)))
    dropped = typed.where(~known).select(*key, "event_id", F.lit("invalid_event_type").alias("reason")).unionByName(
        checked.where(~_supported(F.col("evidence"))).select(*key, "event_id", F.lit("evidence_span_unsupported").alias("reason"))
    )
    checks = checked.select(*key, F.lit("evidence_span").alias("field"), F.col("evidence.support").alias("support")).unionByName(
        arguments.select(*key, F.concat(F.lit("event_arguments."), "key").alias("field"), F.col("match.support").alias("support"))
    )
    return {"events": out.drop("_lost"), "dropped": dropped, "checks": checks, "metrics": metrics(events, out, checks, dropped)}


def metrics(draft: DataFrame, kept: DataFrame, checks: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per article: evidence coverage, unsupported rates, retention, repairs, groundedness (partial support counts half)."""
    n = F.count("*")
    is_evidence = F.col("field") == "evidence_span"
    a = checks.groupBy("article_id").agg(
        S.safe_divide(F.count_if(is_evidence & F.col("support").isin(*SUPPORTED)), F.count_if(is_evidence)).alias("evidence_coverage"),
        S.safe_divide(F.count_if(F.col("support") == "UNSUPPORTED"), n).alias("unsupported_field_rate"),
        F.round((F.count_if(F.col("support") == "SUPPORTED") + 0.5 * F.count_if(F.col("support") == "PARTIALLY_SUPPORTED")) / n, 6).alias("groundedness_score"),
    )
    d = draft.groupBy("article_id").agg(n.alias("_draft"))
    k = kept.groupBy("article_id").agg(n.alias("_kept"), F.sum("_repaired").alias("schema_repair_count"))
    x = dropped.groupBy("article_id").agg(n.alias("_dropped"))
    rows = d.join(a, "article_id", "left").join(k, "article_id", "left").join(x, "article_id", "left").fillna(0)
    return rows.select(
        "article_id", "evidence_coverage", "unsupported_field_rate", S.safe_divide(F.col("_dropped"), F.col("_draft")).alias("unsupported_event_rate"),
        S.safe_divide(F.col("_kept"), F.col("_draft")).alias("verified_event_retention_rate"), "schema_repair_count", "groundedness_score",
    )


def verified_label(original: Column, n_events: Column) -> Column:
    return F.when(n_events > 0, "HAS_EVENT").when(original == "UNCERTAIN", "UNCERTAIN").otherwise("NO_EVENT")


def rule_extract(articles: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """One event per article that has a known event type and a company among its hints: type, subtype, evidence, sentiment, confidence."""
    kinds = [k for k in taxonomy.subtypes if k != "UNKNOWN"]
    kind = F.get(F.filter(F.transform("event_type_hints", F.upper), lambda t: t.isin(*kinds)), 0)
    paragraphs = F.filter(F.transform(F.split(T.normalize_text(F.col("text")), "\n"), T.strip), lambda p: p != "")
    rows = articles.withColumn("event_type", kind).withColumn("_p", paragraphs)
    first_hit = F.get(F.filter("_p", lambda p: F.exists("event_keywords", lambda k: F.contains(F.lower(p), F.lower(k)))), 0)
    title = T.normalize_text(F.col("title")) if "title" in articles.columns else F.lit("")
    rows = rows.withColumn("evidence_span", F.coalesce(first_hit, F.get("_p", F.lit(0)), title)).withColumn("ticker", F.get("tickers_hint", F.lit(0)))
    grounded = (F.size("tickers_hint") > 0) | (F.size("company_names_hint") > 0)
    allowed = taxonomy.allowed_subtypes(F.col("event_type"))
    subtype = F.coalesce(F.get(F.filter(F.transform("event_subtype_hints", F.upper), lambda s: F.array_contains(allowed, s)), 0), F.when(F.col("event_type") == "OTHER", F.array_min(allowed)))
    some = lambda c, v: F.when(c, v).otherwise(0.0)
    score = BASE + PER_TYPE + some(F.col("ticker").isNotNull(), PER_TICKER) + some(F.col("evidence_span") != "", PER_EVIDENCE) + some(F.size("event_keywords") > 0, PER_KEYWORD)
    partner = F.when(F.col("event_type").isin("CONTRACT", "PARTNERSHIP"), F.get("company_names_hint", F.lit(1)))
    role = F.when(F.col("event_type") == "LEADERSHIP", F.lit("lanh dao"))
    body = T.normalize_text(F.col("text"))
    places = F.filter(F.array(*[F.locate(k, F.lower(body)) for k in ("du an", "nhà máy", "nha may")]), lambda i: i > 0)
    project = F.when(F.col("event_type").isin("EXPANSION", "LICENSE_APPROVAL"), F.trim(F.translate(F.substring(body, F.get(places, 0), F.lit(90)), "", "")))
    filled = F.map_filter(F.create_map(F.lit("partner"), partner, F.lit("project"), project, F.lit("role"), role), lambda k, v: v.isNotNull())
    return rows.where(F.col("event_type").isNotNull() & grounded).select(
        "article_id", F.lit(0).alias("event_index"), F.concat("article_id", F.lit("_e01")).alias("event_id"), "ticker", F.get("company_names_hint", F.lit(0)).alias("company_name"),
        "event_type", subtype.alias("event_subtype"), F.when(title != "", title).otherwise(F.substring("evidence_span", 1, 180)).alias("event_summary"), "evidence_span",
        filled.alias("event_arguments"), F.when(F.col("event_type").isin(*POSITIVE), "POSITIVE").when(F.col("event_type").isin(*NEGATIVE), "NEGATIVE").otherwise("NEUTRAL").alias("impact_sentiment"),
        F.round(F.least(F.lit(MOST), score), 2).alias("confidence"),
    )


def patterns(events: DataFrame, articles: DataFrame) -> DataFrame:
    """One pattern per gold event: id, excerpt (the first paragraph that holds the evidence), text, and issues. Of articles
    that share an id one counts."""
    a = articles.select("article_id", "text", "source", *([F.col("title")] if "title" in articles.columns else [F.lit(None).cast("string").alias("title")]))
    a = T.one_of_each(a, "article_id")
    rows = events.join(a, "article_id", "left").withColumn("evidence_span", T.normalize_text(F.col("evidence_span")))
    paragraph = F.get(F.filter(F.split(T.normalize_text(F.col("text")), "\n"), lambda p: (F.col("evidence_span") != "") & F.contains(F.lower(p), F.lower("evidence_span"))), 0)
    words = F.array_join(F.slice(T.split_blank(T.normalize_text(F.col("text"))), 1, 120), " ")
    excerpt = F.coalesce(F.nullif(T.strip(paragraph), F.lit("")), F.nullif("evidence_span", F.lit("")), words, F.lit(""))
    rows = rows.withColumn("input_excerpt", excerpt).withColumn("pattern_id", T.digest_id("pattern_", F.concat_ws(":", "article_id", "event_id", F.lit("event"))))
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat_ws(
        "\n", F.lit("Document label: HAS_EVENT"), F.concat(F.lit("Title/source: "), blank("title"), F.lit(" | "), blank("source")), F.concat(F.lit("Ticker/company: "), blank("ticker"), F.lit(" | "), blank("company_name")),
        F.concat(F.lit("Event type/subtype: "), blank("event_type"), F.lit(" | "), blank("event_subtype")), F.concat(F.lit("Impact sentiment: "), blank("impact_sentiment")),
        F.concat(F.lit("Evidence: "), F.coalesce(F.nullif("evidence_span", F.lit("")), F.col("input_excerpt"))), F.concat(F.lit("Summary: "), blank("event_summary")), F.concat(F.lit("Arguments: "), F.to_json("event_arguments")),
    )
    issues = F.array_compact(F.array(F.when(blank("evidence_span") == "", F.lit("missing_evidence")), F.when(blank("input_excerpt") == "", F.lit("missing_input_excerpt")), F.when(blank("event_type") == "", F.lit("invalid_event_type"))))
    return rows.select("pattern_id", "article_id", "event_id", F.lit("event").alias("pattern_kind"), "event_type", "event_subtype", "evidence_span", "input_excerpt", T.normalize_text(text).alias("pattern_text"), issues.alias("validation_errors"))


def no_event_patterns(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """One pattern per NO_EVENT document."""
    rows = documents.where("document_label = 'NO_EVENT'").join(articles.select("article_id", "text"), "article_id", "left")
    words = F.array_join(F.slice(T.split_blank(T.normalize_text(F.col("text"))), 1, 120), " ")
    return rows.select(T.digest_id("pattern_", F.concat_ws(":", "article_id", F.lit("no_event"), F.lit("no_event"))).alias("pattern_id"), "article_id", F.lit("no_event").alias("pattern_kind"), words.alias("input_excerpt"))


def attach_patterns(patterns: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pattern_id, chunk_id, match_strategy, match_score): chunks of the article that hold the evidence, of every level; else the
    document chunk, else the first chunk. NO_EVENT patterns go to the document chunk. Patterns of articles without chunks give no row."""
    fold = lambda c: F.lower(T.ascii_fold(F.coalesce(c, F.lit(""))))
    p = patterns.select("pattern_id", "pattern_kind", "article_id", fold(F.col("evidence_span")).alias("_e"))
    pairs = p.join(chunks.select("article_id", "chunk_id", "chunk_level", "text"), "article_id")
    held = (F.col("pattern_kind") != "no_event") & (F.col("_e") != "") & F.contains(fold(F.col("text")), F.col("_e"))
    chunk, is_doc, none = F.struct("chunk_id", "chunk_level"), F.col("chunk_level") == "document", F.col("pattern_kind") == "no_event"
    found = pairs.select("pattern_id", "pattern_kind", chunk.alias("_c"), F.struct(~is_doc, F.col("chunk_id")).alias("_order"), held.alias("_held"))
    each = found.groupBy("pattern_id", "pattern_kind").agg(F.collect_list(F.when(F.col("_held"), F.col("_c"))).alias("_all"), F.min_by("_c", "_order").alias("_one"))

    def row(c: Column, strategy: Column, score: Column) -> Column:
        return F.struct(c["chunk_id"].alias("chunk_id"), strategy.alias("match_strategy"), score.alias("match_score"))

    has_doc = F.col("_one.chunk_level") == "document"
    strategy = F.when(none, "document_no_event").when(has_doc, "document_fallback").otherwise("first_chunk_fallback")
    one = F.when(~none | has_doc, F.array(row(F.col("_one"), strategy, F.when(none, 1.0).otherwise(0.0))))
    all_held = F.transform("_all", lambda c: row(c, F.concat(F.lit("evidence_"), c["chunk_level"]), F.lit(1.0)))
    return T.exploded(each, F.when(F.size("_all") > 0, all_held).otherwise(one), "_row", "pattern_id").select("pattern_id", "_row.*")


def pattern_counts(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.count("*").alias("n"), F.count_if(F.col("pattern_kind") == "event").alias("n_event"), F.count_if(F.size("validation_errors") > 0).alias("n_rejected"))


def prompt_rows(articles: DataFrame, instruction: str, budgets: tuple[int, ...] = (6000, 3000, 1500, 600)) -> DataFrame:
    """(article_id, prompt): the instruction and the article as JSON, with the longest text that keeps the prompt within the largest budget."""
    most = budgets[0] + len(instruction) + 400
    tries = [F.concat(F.lit(instruction + "\n"), F.to_json(F.struct("article_id", T.truncate_chars(F.col("text"), b).alias("text")))) for b in budgets]
    fits = [F.when(F.char_length(t) <= most, t) for t in tries]
    return articles.select("article_id", F.coalesce(*fits, tries[-1]).alias("prompt"))


def invoke(prompts: DataFrame, model, retries: int = 2, pause_seconds: float = 0.0) -> DataFrame:
    """(article_id, raw_output, error, attempts, latency_ms): ``model(prompt)`` per row, tried again on errors after
    ``pause_seconds`` times the number of tries so far; the last error becomes the row."""

    def run(frames):
        import time

        import pandas as pd

        for frame in frames:
            rows = []
            for key, prompt in zip(frame["article_id"], frame["prompt"]):
                answer, error, began, tries = None, None, time.perf_counter(), 0
                while tries <= retries and answer is None:
                    if tries:
                        time.sleep(pause_seconds * tries)
                    tries += 1
                    try:
                        answer, error = str(model(prompt)), None
                    except Exception as e:  # recorded in the row
                        error = str(e)
                rows.append((key, answer, error, tries, round((time.perf_counter() - began) * 1000, 3)))
            yield pd.DataFrame(rows, columns=["article_id", "raw_output", "error", "attempts", "latency_ms"])

    kind = dict(prompts.dtypes)["article_id"]
    return prompts.select("article_id", "prompt").mapInPandas(run, f"article_id {kind}, raw_output string, error string, attempts int, latency_ms double")
