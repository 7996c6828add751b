"""Label documents (VARIANT): normalisation, typed issues, teacher records, gold routing, repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import json as J
from glosswork.functions import similarity as S
from glosswork.functions import text as T

# Keys of label documents, events and model info, document labels and sentiments.
TOP_KEYS = [
    "article_id", "document_label", "events", "label_reason", "model_info", "warnings",
]
EVENT_KEYS = [
    "company_name", "confidence", "event_arguments", "event_id", "event_reason", "event_subtype", "event_summary", "event_type", "evidence_span",
    "impact_sentiment", "published_at", "source_url", "ticker",
]
MODEL_KEYS = [
    "model_name", "prompt_version", "run_id",
]
DOCUMENT_LABELS = ["HAS_EVENT", "NO_EVENT", "UNCERTAIN"]
SENTIMENTS = ["POSITIVE", "NEGATIVE", "NEUTRAL", "MIXED", "UNKNOWN"]
GROUNDED = 0.82


@dataclass(frozen=True)
class Taxonomy:
    """Event types with subtypes and argument fields; small, kept as literals in the expressions."""

    subtypes: dict[str, tuple[str, ...]]
    arguments: dict[str, tuple[str, ...]]
    document_labels: tuple[str, ...] = tuple(DOCUMENT_LABELS)
    sentiments: tuple[str, ...] = tuple(SENTIMENTS)

    @classmethod
    def of(cls, rows: DataFrame) -> "Taxonomy":
        """From the rows of dictionaries.load_event_taxonomy."""
        found = rows.collect()
        labels = tuple(found[0]["document_labels"] or DOCUMENT_LABELS) if found else tuple(DOCUMENT_LABELS)
        sentiments = tuple(found[0]["impact_sentiments"] or SENTIMENTS) if found else tuple(SENTIMENTS)
        return cls({r["event_type"]: tuple(r["subtypes"]) for r in found}, {r["event_type"]: tuple(r["argument_fields"]) for r in found}, labels, sentiments)

    def _map(self, values: dict[str, tuple[str, ...]]) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]).cast("array<string>"))]) if values else F.create_map().cast("map<string,array<string>>")

    def known(self, kind: Column) -> Column:
        return F.coalesce(kind.isin(*self.subtypes), F.lit(False)) if self.subtypes else F.lit(False)

    def allowed_subtypes(self, kind: Column) -> Column:
        return F.coalesce(F.try_element_at(self._map(self.subtypes), kind), F.array().cast("array<string>"))

    def allowed_arguments(self, kind: Column) -> Column:
        return F.coalesce(F.try_element_at(self._map(self.arguments), kind), F.array().cast("array<string>"))


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _issue(condition: Column, path: Column | str, code: str, severity: str = "error") -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))


ISSUES = "array<struct<path:string,code:string,severity:string>>"


def grounding_text(title: Column, text: Column) -> Column:
    return F.array_join(F.filter(F.array(F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), lambda p: p != ""), "\n")


def evidence_grounded(evidence: Column, text: Column, threshold: float = GROUNDED) -> Column:
    """Whether the text holds the evidence, as written or folded, or has a sentence like it. Only the rest reaches Python."""
    e, t = T.normalize_text(evidence), T.normalize_text(text)
    fe, ft = F.lower(T.ascii_fold(e)), F.lower(T.ascii_fold(t))
    held = F.contains(t, e) | F.contains(ft, fe)
    close = S.best_sentence_ratio(fe, F.when(held | (e == ""), F.lit(None).cast("string")).otherwise(ft)) >= threshold
    return (F.coalesce(evidence, F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "") & (held | F.coalesce(close, F.lit(False)))


def ticker_grounded(ticker: Column, hints: Column, text: Column) -> Column:
    upper = F.upper(ticker)
    return F.array_contains(F.transform(F.coalesce(hints, F.array().cast("array<string>")), F.upper), upper) | F.regexp_like(
        F.upper(text), F.concat(F.lit(r"(?<![A-Z0-9])\Q"), upper, F.lit(r"\E(?![A-Z0-9])"))
    )


def document_issues(label: Column, article_id: Column, taxonomy: Taxonomy) -> Column:
    """Issues of the document level; label is a VARIANT object."""
    keys = J.keys(label)
    kind = T.nullable_upper(J.field(label, "document_label"))
    n_events = F.coalesce(F.size(J.field(label, "events", "array<variant>")), F.lit(0))
    is_list = _kind(J.field(label, "events", "variant")).startswith("ARRAY")
    strings = F.coalesce(F.size(F.filter(J.field(label, "warnings", "array<variant>"), lambda w: _kind(w) != "STRING")) == 0, F.lit(False))
    info = J.field(label, "model_info", "variant")
    reason = J.field(label, "label_reason", "variant")
    return F.array_compact(
        F.array(
            _issue(F.size(F.array_except(_list(TOP_KEYS), keys)) > 0, "$", "missing_required_fields"),
            _issue(F.size(F.array_except(keys, _list(TOP_KEYS))) > 0, "$", "unexpected_fields"),
            _issue(~J.field(label, "article_id").eqNullSafe(article_id), "article_id", "article_id_mismatch"),
            _issue(~F.coalesce(kind.isin(*taxonomy.document_labels), F.lit(False)), "document_label", "invalid_document_label"),
            _issue((_kind(reason) != "STRING") | (F.trim(J.field(label, "label_reason")) == ""), "$.label_reason", "missing_required_string"),
            _issue(~is_list, "events", "events_not_array"),
            _issue((kind == "NO_EVENT") & (n_events > 0), "events", "no_event_has_events"),
            _issue((kind == "HAS_EVENT") & (n_events == 0), "events", "has_event_without_events"),
            _issue(~strings, "warnings", "warnings_not_string_array"),
            _issue(~J.is_object(info), "model_info", "model_info_not_object"),
            _issue(J.is_object(info) & (F.size(F.array_except(_list(MODEL_KEYS), J.keys(info))) > 0), "model_info", "missing_model_info_fields"),
        )
    )


def exploded_events(labels: DataFrame) -> DataFrame:
    """One row per event of labels (article_id, label): event (VARIANT), index and the normalised fields."""
    rows = labels.select("*", F.posexplode(J.field(F.col("label"), "events", "array<variant>")).alias("event_index", "event"))
    e = F.col("event")
    upper = {c: T.nullable_upper(J.field(e, c)) for c in ("event_type", "event_subtype", "impact_sentiment", "ticker")}
    plain = {c: J.field(e, c) for c in ("event_id", "company_name", "event_summary", "event_reason", "evidence_span", "source_url", "published_at")}
    return rows.withColumns(upper | plain | {"confidence": J.field(e, "confidence", "double"), "event_arguments": J.entries(J.field(e, "event_arguments", "variant"))})


def event_issues(events: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(article_id, event_index, path, code, severity) of events joined with title, text and tickers_hint."""
    e = F.col("event")
    path = F.concat(F.lit("events["), F.col("event_index"), F.lit("]"))
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    text = grounding_text(F.col("title"), F.col("text"))
    first = events.groupBy("article_id", "event_id").agg(F.min("event_index").alias("_first"))
    rows = events.join(first, ["article_id", "event_id"], "left").withColumn("_text", text)
    rows = rows.withColumn("_grounded", evidence_grounded(F.col("evidence_span"), F.col("_text")))
    keys, arguments = J.keys(e), J.field(e, "event_arguments", "variant")
    subtype, confidence = J.field(e, "event_subtype", "variant"), J.field(e, "confidence", "variant")
    numeric = _kind(confidence).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
    required = [_issue((_kind(J.field(e, c, "variant")) != "STRING") | (F.trim(F.col(c)) == ""), at(c), "missing_required_string") for c in ("event_summary", "event_reason", "evidence_span", "source_url")]
    nullable = [_issue(~_kind(J.field(e, c, "variant")).isin("VOID", "STRING"), at(c), "invalid_nullable_string") for c in ("ticker", "company_name", "published_at")]
    known = taxonomy.known(F.col("event_type"))
    extra = F.transform(
        F.when(known & J.is_object(arguments), F.array_except(J.keys(arguments), taxonomy.allowed_arguments(F.col("event_type")))).otherwise(F.array().cast("array<string>")),
        lambda k: _issue(F.lit(True), F.concat(at("event_arguments."), k), "non_taxonomy_argument_field", "warning"),
    )
    odd = F.transform(
        F.when(known & J.is_object(arguments), F.filter(J.keys(arguments), lambda k: ~k.rlike("^[a-z][a-z0-9_]*$"))).otherwise(F.array().cast("array<string>")),
        lambda k: _issue(F.lit(True), F.concat(at("event_arguments."), k), "argument_key_not_snake_case", "warning"),
    )
    fixed = F.array(
        _issue(F.size(F.array_except(_list(EVENT_KEYS), keys)) > 0, path, "missing_required_fields"),
        _issue(F.size(F.array_except(keys, _list(EVENT_KEYS))) > 0, path, "unexpected_fields"),
        _issue((_kind(J.field(e, "event_id", "variant")) != "STRING") | (F.trim("event_id") == ""), at("event_id"), "missing_event_id"),
        _issue((F.trim("event_id") != "") & (F.col("_first") < F.col("event_index")), at("event_id"), "duplicate_event_id"),
        _issue(~known, at("event_type"), "invalid_event_type"),
        _issue(~_kind(subtype).isin("VOID", "STRING"), at("event_subtype"), "invalid_event_subtype"),
        _issue(F.col("event_subtype").isNotNull() & F.col("event_type").isNotNull() & ~F.array_contains(taxonomy.allowed_subtypes(F.col("event_type")), F.col("event_subtype")), at("event_subtype"), "invalid_event_subtype_for_type"),
        _issue(~F.coalesce(F.col("impact_sentiment").isin(*taxonomy.sentiments), F.lit(False)), at("impact_sentiment"), "invalid_impact_sentiment"),
        *nullable, *required,
        _issue(~numeric | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), at("confidence"), "invalid_confidence"),
        _issue(~J.is_object(arguments), at("event_arguments"), "event_arguments_not_object"),
        _issue((_kind(J.field(e, "evidence_span", "variant")) == "STRING") & ~F.col("_grounded"), at("evidence_span"), "evidence_not_grounded"),
        _issue((F.coalesce("ticker", F.lit("")) != "") & ~ticker_grounded(F.col("ticker"), F.col("tickers_hint"), F.col("_text")), at("ticker"), "ticker_not_grounded"),
    )
    issues = F.concat(F.array_compact(fixed), extra, odd)
    return rows.select("article_id", "event_index", F.explode_outer(issues).alias("_i")).where("_i IS NOT NULL").select("article_id", "event_index", "_i.*")


def validate(labels: DataFrame, articles: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """(article_id, path, code, severity) of all issues of labels (article_id, label) against their articles, one of each id."""
    a = articles.select("article_id", *[F.col(c) if c in articles.columns else F.lit(None).cast(k).alias(c) for c, k in (("title", "string"), ("text", "string"), ("tickers_hint", "array<string>"))])
    a = T.one_of_each(a, "article_id")
    top = labels.select("article_id", F.explode(document_issues(F.col("label"), F.col("article_id"), taxonomy)).alias("_i")).select("article_id", "_i.*")
    events = exploded_events(labels).join(a, "article_id", "left")
    return top.unionByName(event_issues(events, taxonomy).select("article_id", "path", "code", "severity"))


def teacher_records(outputs: DataFrame, articles: DataFrame, taxonomy: Taxonomy, accept_all: bool = True) -> DataFrame:
    """(article_id, label, validation_status, n_errors, route) of raw outputs (article_id, raw_output).

    route: gold or rejected. Lenient mode takes every label that parses.
    """
    parsed = J.parse_whole(F.col("raw_output"))
    rows = outputs.withColumn("label", parsed).withColumn("article_id", F.coalesce(F.nullif("article_id", F.lit("")), J.field(F.col("label"), "article_id"), F.lit("")))
    known = articles.select("article_id").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "article_id", "left")
    usable = rows.where("_known AND label IS NOT NULL")
    issues = validate(usable.select("article_id", "label"), articles, taxonomy).where("severity = 'error'").groupBy("article_id").agg(F.count("*").alias("n_errors"))
    out = rows.join(issues, "article_id", "left")
    bad = (
        F.when(F.col("article_id") == "", "missing_article_id")
        .when(F.col("_known").isNull(), "unknown_article_id")
        .when(F.col("label").isNull(), "invalid_json")
    )
    n = F.coalesce("n_errors", F.lit(0))
    status = F.when(bad.isNotNull(), "FAIL").when(n == 0, "PASS").when(F.lit(accept_all), "AUTO_ACCEPTED_WITH_ISSUES").otherwise("FAIL")
    return out.select(
        "article_id", "label", status.alias("validation_status"), n.alias("n_errors"), bad.alias("rejection"),
        F.when(status == "FAIL", "rejected").otherwise("gold").alias("route"),
    )


def labeling_counts(records: DataFrame) -> DataFrame:
    """(kind, name, n) of teacher records: by status, rejection, document label and event type."""
    def counted(kind: str, name: Column, rows: DataFrame = records) -> DataFrame:
        return rows.select(name.alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")

    events = exploded_events(records.where("label IS NOT NULL").select("article_id", "label"))
    return (
        counted("status", F.col("validation_status")).union(counted("rejection", F.col("rejection")))
        .union(counted("document_label", T.nullable_upper(J.field(F.col("label"), "document_label"))))
        .union(counted("event_type", F.col("event_type"), events))
    )


def run_id(outputs: DataFrame, prefix: str = "m02_") -> DataFrame:
    """One row: an id that depends on all records, by a hash of their hashes in order."""
    each = outputs.select(F.sha1(F.to_json(F.struct(*sorted(outputs.columns)))).alias("h"))
    total = each.agg(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    return total.select(F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(":", "s", "n")), 1, 12)).alias("run_id"))


def repaired(outputs: DataFrame) -> DataFrame:
    """(article_id, label, repaired): parsed output, repaired output, or an UNCERTAIN document where nothing parses."""
    direct, mended = J.parse_whole(F.col("raw_output")), J.repair_object(F.col("raw_output"))
    uncertain = F.parse_json(
        F.to_json(F.struct(F.col("article_id"), F.lit("UNCERTAIN").alias("document_label"), F.lit("Output could not be parsed.").alias("label_reason"), F.array().cast("array<string>").alias("events"), F.array(F.lit("json_repair_failed")).alias("warnings")))
    )
    how = F.when(direct.isNotNull(), "none").when(mended.isNotNull(), "extracted").otherwise("fallback")
    return outputs.select("article_id", F.coalesce(direct, mended, uncertain).alias("label"), how.alias("repaired"))
