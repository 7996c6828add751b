"""Queries of event matching, metrics, errors and reports, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.lineage import cut
from glosswork.operators import evaluation as E
from glosswork.operators import reports
from glosswork.plans.text_queries import value
from glosswork.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


# Gold and predicted events, derived from labels and documents alike in Spark and in SQL. Each event is
# (condition, index, ticker, type, subtype, summary, evidence, amount, place, sentiment) over the joined row.
_GOLD = [
    ("quality = 1", "0", "concat('K', doc_id % 7)", "concat('T', doc_id % 4)", "concat('s', doc_id % 3)", "lang", "substr(text, 1, 60)", "doc_id % 5", "lang", "CASE WHEN toxic = 1 THEN 'NEGATIVE' ELSE 'POSITIVE' END"),
    ("doc_id % 3 = 0", "1", "concat('K', (doc_id + 1) % 7)", "concat('T', (doc_id + 1) % 4)", "''", "source", "substr(text, 61, 60)", "doc_id % 4", "source", "'NEUTRAL'"),
]
_PRED = {
    "base": [
        ("doc_id % 5 <> 0", "0", "CASE WHEN doc_id % 4 = 0 THEN 'X' ELSE concat('K', doc_id % 7) END", "concat('T', (doc_id + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END) % 4)", "'s1'", "lang", "substr(text, 1, 40)", "doc_id % 5", "'zz'", "'POSITIVE'"),
        ("doc_id % 6 = 0", "1", "'ZZ'", "'T9'", "''", "'none'", "'nothing here'", "9", "'zz'", "'NEUTRAL'"),
    ],
    "flow": [
        ("quality = 1 AND doc_id % 7 <> 0", "0", "concat('K', doc_id % 7)", "concat('T', doc_id % 4)", "concat('S', doc_id % 3)", "lang", "substr(text, 1, 60)", "doc_id % 5", "upper(lang)", "'POSITIVE'"),
        ("doc_id % 3 = 0", "1", "concat('k', (doc_id + 1) % 7)", "concat('T', (doc_id + 1) % 4)", "''", "source", "substr(text, 61, 50)", "doc_id % 4", "source", "'NEUTRAL'"),
    ],
}
_NAMED = {
    "article_id": "concat('d', doc_id)", "event_index": "{1}", "event_id": "concat('e', doc_id, '_', {1})", "ticker": "{2}", "company_name": "concat('Company ', source)", "event_type": "{3}",
    "event_subtype": "{4}", "event_summary": "{5}", "evidence_span": "{6}", "impact_sentiment": "{9}",
}


def _columns(r: tuple) -> list[str]:
    return [f"{e.format(*r)} AS {n}" for n, e in _NAMED.items()]


def _base(spark, sf_dir):
    """Labels with what the events below take of their documents; read once, as the events are made in several branches."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return cut(table(spark, sf_dir, "labels").join(d, "doc_id"))


def _events(base, rows, config=None):
    out = None
    for r in rows:
        e = base.where(r[0]).selectExpr(*([f"'{config}' AS config_name"] if config else []), *_columns(r), f"map('amount', string({r[7]}), 'place', {r[8]}) AS event_arguments")
        out = e if out is None else out.unionByName(e)
    return out


def data(spark, sf_dir):
    """gold events, gold documents, predicted events, predictions."""
    base = _base(spark, sf_dir)
    gold = _events(base, _GOLD)
    pred = _events(base, _PRED["base"], "base").unionByName(_events(base, _PRED["flow"], "flow"))
    n = gold.groupBy("article_id").agg(F.count("*").alias("n_events"))
    documents = base.select(F.concat(F.lit("d"), "doc_id").alias("article_id")).join(n, "article_id", "left").select(
        "article_id", F.when(F.col("n_events") > 0, "HAS_EVENT").otherwise("NO_EVENT").alias("document_label"), F.coalesce("n_events", F.lit(0)).alias("n_events")
    )
    m = pred.groupBy("config_name", "article_id").agg(F.count("*").alias("n_events"))
    made = base.where("doc_id % 11 <> 0").select(F.explode(F.array(F.lit("base"), F.lit("flow"))).alias("config_name"), F.concat(F.lit("d"), "doc_id").alias("article_id"), "doc_id")
    predictions = made.join(m, ["config_name", "article_id"], "left").select(
        "config_name", "article_id", F.when(F.col("n_events") > 0, "HAS_EVENT").otherwise("NO_EVENT").alias("document_label"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
        (F.col("doc_id") % 13 != 0).alias("json_valid"), (F.col("doc_id") % 9 != 0).alias("schema_valid"), F.lit(0).alias("position"),
    )
    return gold, documents, pred.join(predictions.select("config_name", "article_id"), ["config_name", "article_id"], "left_semi"), predictions


def _events_sql(rows, config=None) -> str:
    head = f"'{config}' AS config_name, " if config else ""
    return " UNION ALL ".join(f"SELECT {head}doc_id, {', '.join(_columns(r))}, CAST({r[7]} AS VARCHAR) AS amount, {r[8]} AS place FROM b WHERE {r[0]}" for r in rows)


_DATA = f"""
b AS (SELECT l.doc_id, quality, toxic, text, lang, source FROM labels l JOIN documents d USING (doc_id)), g AS ({_events_sql(_GOLD)}),
p AS (SELECT * FROM ({_events_sql(_PRED['base'], 'base')} UNION ALL {_events_sql(_PRED['flow'], 'flow')}) WHERE doc_id % 11 <> 0),
gd AS (SELECT 'd' || b.doc_id AS article_id, count(g.event_id) AS n FROM b LEFT JOIN g ON g.doc_id = b.doc_id GROUP BY b.doc_id),
pd AS (SELECT c AS config_name, 'd' || b.doc_id AS article_id, b.doc_id, count(p.event_id) AS n FROM b CROSS JOIN (VALUES ('base'), ('flow')) v(c) LEFT JOIN p ON p.doc_id = b.doc_id AND p.config_name = c WHERE b.doc_id % 11 <> 0 GROUP BY ALL)
"""


def _set(c: str) -> str:
    return f"list_distinct(regexp_extract_all({value(c)}, '[a-z0-9]+'))"


def _overlap(a: str, b: str) -> str:
    x, y = _set(a), _set(b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE round(len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))), 6) END"


_SCORES = f"""
sc AS (SELECT p.config_name, p.article_id, g.event_index AS gi, p.event_index AS pi, g.ticker AS gt, p.ticker AS pt, g.event_type AS gy, p.event_type AS py, g.event_subtype AS gs, p.event_subtype AS ps, g.impact_sentiment AS gm, p.impact_sentiment AS pm,
  g.event_id AS gid, g.amount AS ga, p.amount AS pa, g.place AS gp, p.place AS pp,
  1.0 AS who, CASE WHEN {value('g.event_type')} = {value('p.event_type')} THEN 1.0 ELSE 0.0 END AS same_type, greatest({_overlap('g.evidence_span', 'p.evidence_span')}, {_overlap('g.event_summary', 'p.event_summary')}) AS evidence,
  round((CASE WHEN {value('g.amount')} = {value('p.amount')} THEN 1 ELSE 0 END + CASE WHEN {value('g.place')} = {value('p.place')} THEN 1 ELSE 0 END) / 2.0, 6) AS args FROM p JOIN g ON g.article_id = p.article_id),
s AS (SELECT *, round(0.35 * who + 0.35 * same_type + 0.20 * evidence + 0.10 * args, 6) AS score FROM sc)
"""
#: At most two events on either side: the best pair, then the best of the pairs that share no side with it.
_MATCH = """
m1 AS (SELECT *, row_number() OVER (PARTITION BY config_name, article_id ORDER BY score DESC, gi, pi) AS k FROM s WHERE score >= 0.25), f1 AS (SELECT * FROM m1 WHERE k = 1),
m2 AS (SELECT m1.*, row_number() OVER (PARTITION BY m1.config_name, m1.article_id ORDER BY m1.k) AS k2 FROM m1 JOIN f1 ON f1.config_name = m1.config_name AND f1.article_id = m1.article_id WHERE m1.gi <> f1.gi AND m1.pi <> f1.pi),
m AS (SELECT * EXCLUDE (k) FROM f1 UNION ALL SELECT * EXCLUDE (k, k2) FROM m2 WHERE k2 = 1)
"""
_LOST = """
mg AS (SELECT v.c AS config_name, g.* FROM g CROSS JOIN (VALUES ('base'), ('flow')) v(c) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.config_name = v.c AND m.article_id = g.article_id AND m.gi = g.event_index)),
mp AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.config_name = p.config_name AND m.article_id = p.article_id AND m.pi = p.event_index))
"""
_ALL = f"WITH {_DATA}, {_SCORES}, {_MATCH}, {_LOST}"


def _parts(spark, sf_dir):
    gold, documents, pred, predictions = data(spark, sf_dir)
    configs = predictions.select("config_name").distinct()
    matches = cut(E.match_events(E.pair_scores(gold, pred)))
    return E.sides(gold, pred, matches, configs), E.aligned_documents(documents, predictions, configs), matches, predictions


def _documents(spark, sf_dir):
    """The aligned documents alone: no event is matched for them."""
    _, documents, _, predictions = data(spark, sf_dir)
    return E.aligned_documents(documents, predictions, predictions.select("config_name").distinct())


@query("evl01_match_scores", f"WITH {_DATA}, {_SCORES} SELECT config_name, article_id, gi AS gold_index, pi AS pred_index, score, evidence AS evidence_overlap, args::DOUBLE AS argument_overlap FROM s")
def _evl01(spark, sf_dir):
    gold, _, pred, _ = data(spark, sf_dir)
    return E.pair_scores(gold, pred).select("config_name", "article_id", "gold_index", "pred_index", "score", "evidence_overlap", "argument_overlap")


@query("top12_greedy_match", _ALL + "SELECT config_name, article_id, gi AS gold_index, pi AS pred_index FROM m")
def _top12(spark, sf_dir):
    return _parts(spark, sf_dir)[2].select("config_name", "article_id", "gold_index", "pred_index")


@query(
    "set05_complement_split",
    _ALL + "SELECT config_name, 'match' AS kind, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT config_name, 'gold', count(*) FROM mg GROUP BY 1 UNION ALL SELECT config_name, 'pred', count(*) FROM mp GROUP BY 1",
)
def _set05(spark, sf_dir):
    return _parts(spark, sf_dir)[0].groupBy("config_name", "kind").agg(F.count("*").alias("n"))


def _votes(g: str, p: str, field: str) -> str:
    return f"""
, v AS (SELECT config_name, {g} AS label, CASE WHEN {g} = {p} THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN {g} = {p} THEN 0 ELSE 1 END AS fn FROM m UNION ALL SELECT config_name, {p}, 0, 1, 0 FROM m WHERE {g} <> {p}
  UNION ALL SELECT config_name, {field}, 0, 0, 1 FROM mg UNION ALL SELECT config_name, {field}, 0, 1, 0 FROM mp),
c AS (SELECT config_name, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM v WHERE label <> '' GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 6) END AS recall FROM c),
x AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE round(2 * precision * recall / (precision + recall), 6) END AS f1 FROM r)
"""


@query("agg09_agg10_class_prf", _ALL + _votes("gy", "py", "event_type") + "SELECT * FROM x")
def _agg09(spark, sf_dir):
    return E.per_class(E.class_counts(_parts(spark, sf_dir)[0], "event_type"))


_MICRO = """
, t AS (SELECT config_name, round(avg(f1), 6) AS macro, sum(tp) / sum(tp + fp) AS pr, sum(tp) / sum(tp + fn) AS re FROM x GROUP BY 1)
SELECT config_name, macro AS impact_macro_f1, round(2 * round(pr, 6) * round(re, 6) / (round(pr, 6) + round(re, 6)), 6) AS impact_micro_f1 FROM t
"""


@query("agg12_macro_micro_f1", _ALL + _votes("gm", "pm", "impact_sentiment") + _MICRO)
def _agg12(spark, sf_dir):
    return E.macro_micro(E.class_counts(_parts(spark, sf_dir)[0], "impact_sentiment"), "impact")


_DOCS = """
, a AS (SELECT v.c AS config_name, gd.article_id, gd.n AS gn, coalesce(pd.n, 0) AS pn, coalesce(doc_id % 13 <> 0, true) AS jv, coalesce(doc_id % 9 <> 0, true) AS sv FROM gd CROSS JOIN (VALUES ('base'), ('flow')) v(c) LEFT JOIN pd ON pd.article_id = gd.article_id AND pd.config_name = v.c)
"""


@query("jn11_set02_aligned_documents", f"WITH {_DATA} {_DOCS} SELECT config_name, article_id, CASE WHEN gn > 0 THEN 'HAS_EVENT' ELSE 'NO_EVENT' END AS gold_label, CASE WHEN pn > 0 THEN 'HAS_EVENT' ELSE 'NO_EVENT' END AS pred_label, gn AS gold_events, pn AS pred_events, jv AS json_valid, sv AS schema_valid FROM a")
def _jn11(spark, sf_dir):
    return _documents(spark, sf_dir)


_CONF = f"WITH {_DATA} {_DOCS}, k AS (SELECT config_name, count(*) FILTER (WHERE gn > 0 AND pn > 0) AS tp, count(*) FILTER (WHERE gn = 0 AND pn > 0) AS fp, count(*) FILTER (WHERE gn > 0 AND pn = 0) AS fn, count(*) FILTER (WHERE gn = 0 AND pn = 0) AS tn, round(avg(CASE WHEN jv THEN 1.0 ELSE 0.0 END), 6) AS json_validity_rate, round(avg(CASE WHEN sv THEN 1.0 ELSE 0.0 END), 6) AS schema_compliance_rate FROM a GROUP BY 1)"


@query(
    "agg11_binary_metrics",
    _CONF + """ SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS event_detection_accuracy, round(tp / (tp + fp), 6) AS event_detection_precision, round(tp / (tp + fn), 6) AS event_detection_recall,
    round(2 * round(tp / (tp + fp), 6) * round(tp / (tp + fn), 6) / (round(tp / (tp + fp), 6) + round(tp / (tp + fn), 6)), 6) AS event_detection_f1 FROM k""",
)
def _agg11(spark, sf_dir):
    return E.document_metrics(_documents(spark, sf_dir))


@query(
    "agg14_accuracies",
    _ALL + f"SELECT config_name, round(count(*) FILTER (WHERE {value('gt')} = {value('pt')}) / count(*), 6) AS ticker_accuracy, round(count(*) FILTER (WHERE gs <> '' AND {value('gs')} = {value('ps')}) / count(*) FILTER (WHERE gs <> ''), 6) AS event_subtype_accuracy FROM m GROUP BY 1",
)
def _agg14(spark, sf_dir):
    rows = _parts(spark, sf_dir)[0]
    return E.accuracy(rows, "ticker", "ticker_accuracy").join(E.accuracy(rows, "event_subtype", "event_subtype_accuracy"), "config_name")


@query(
    "agg15_slot_metrics",
    _ALL + f""", k AS (SELECT config_name, CAST(sum(CASE WHEN {value('ga')} = {value('pa')} THEN 1 ELSE 0 END + CASE WHEN {value('gp')} = {value('pp')} THEN 1 ELSE 0 END) AS BIGINT) AS tp, 2 * count(*) AS n FROM m GROUP BY 1)
    SELECT config_name, tp, n - tp AS fp, n - tp AS fn, round(tp / n, 6) AS slot_precision, round(tp / n, 6) AS slot_recall, round(tp / n, 6) AS slot_f1 FROM k""",
)
def _agg15(spark, sf_dir):
    return E.slot_metrics(_parts(spark, sf_dir)[0])


_ERRORS = _ALL + _DOCS + f""", e AS (SELECT config_name, 'E_INVALID_JSON' AS error_code FROM a WHERE NOT jv UNION ALL SELECT config_name, 'E_SCHEMA_VIOLATION' FROM a WHERE NOT sv UNION ALL SELECT config_name, 'E_NO_EVENT_FALSE_POSITIVE' FROM a WHERE gn = 0 AND pn > 0
UNION ALL SELECT config_name, 'E_MISSED_EVENT' FROM mg UNION ALL SELECT mp.config_name, CASE WHEN gd.n > 0 THEN 'E_EXTRA_EVENT' ELSE 'E_NO_EVENT_FALSE_POSITIVE' END FROM mp LEFT JOIN gd ON gd.article_id = mp.article_id
UNION ALL SELECT config_name, 'E_WRONG_TICKER' FROM m WHERE {value('gt')} <> {value('pt')} UNION ALL SELECT config_name, 'E_WRONG_EVENT_TYPE' FROM m WHERE gy <> py UNION ALL SELECT config_name, 'E_WRONG_IMPACT' FROM m WHERE gm <> pm UNION ALL SELECT config_name, 'E_BAD_EVIDENCE' FROM m WHERE evidence <= 0)
"""


@query("evl03_article_errors", _ERRORS + "SELECT config_name, error_code, count(*) AS n FROM e GROUP BY 1, 2")
def _evl03(spark, sf_dir):
    rows, documents, _, _ = _parts(spark, sf_dir)
    return E.errors(documents, rows).groupBy("config_name", "error_code").agg(F.count("*").alias("n"))


@query("agg07_error_counts", _ERRORS + "SELECT error_code, count(*) AS count FROM e GROUP BY 1")
def _agg07(spark, sf_dir):
    rows, documents, _, _ = _parts(spark, sf_dir)
    return E.error_counts(E.errors(documents, rows))


@query("evl02_evaluate_configs")
def _evl02(spark, sf_dir):
    return E.evaluate(*data(spark, sf_dir))["metrics"]


@query("top13_best_config")
def _top13(spark, sf_dir):
    return E.best_config(E.evaluate(*data(spark, sf_dir))["metrics"]).select("config_name", "event_type_macro_f1")


@query("agg17_outcomes", _ALL + _DOCS + """, q AS (SELECT config_name, article_id, count(*) AS mm FROM m GROUP BY 1, 2)
SELECT a.config_name, CASE WHEN NOT jv OR NOT sv THEN 'schema_error' WHEN gn = 0 AND pn = 0 THEN 'empty' WHEN coalesce(mm, 0) = gn AND coalesce(mm, 0) = pn THEN 'perfect' WHEN mm > 0 THEN 'partial' ELSE 'no_match' END AS outcome, count(*) AS n
FROM a LEFT JOIN q USING (config_name, article_id) GROUP BY 1, 2""")
def _agg17(spark, sf_dir):
    _, documents, matches, _ = _parts(spark, sf_dir)
    return E.outcomes(documents, matches)


@query("top14_worst_types", _ALL + _votes("gy", "py", "event_type") + "SELECT config_name, label, f1, fn, fp FROM x QUALIFY row_number() OVER (ORDER BY f1, fn DESC, fp DESC, label) <= 3")
def _top14(spark, sf_dir):
    return E.worst_types(_agg09(spark, sf_dir), 3).select("config_name", "label", "f1", "fn", "fp")


@query(
    "agg19_best_prediction",
    "WITH r AS (SELECT 'c' || (event_id % 3) AS config_name, 'u' || user_id AS article_id, event_id % 7 <> 0 AS jv, event_id % 5 <> 0 AS sv, event_id % 4 AS n, event_id FROM events) SELECT config_name, article_id, event_id AS position FROM r QUALIFY row_number() OVER (PARTITION BY config_name, article_id ORDER BY jv DESC, sv DESC, n DESC, event_id) = 1",
)
def _agg19(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("event_id") % 3).alias("config_name"), F.concat(F.lit("u"), "user_id").alias("article_id"), (F.col("event_id") % 7 != 0).alias("json_valid"),
        (F.col("event_id") % 5 != 0).alias("schema_valid"), (F.col("event_id") % 4).alias("n_events"), F.col("event_id").alias("position"),
    )
    return E.best_prediction(e).select("config_name", "article_id", "position")


@query(
    "agg08_hallucination",
    "SELECT 'c' || (event_id % 3) AS config_name, count(*) AS run_count, count(*) FILTER (WHERE event_id % 4 <> 0) AS run_count_with_verification, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 6) AS pre_verification_hallucination_rate, 0.0::DOUBLE AS post_verification_hallucination_rate, "
    "round(avg(CASE WHEN event_id % 4 <> 0 THEN value / 2 END), 6) AS evidence_coverage, 0.0::DOUBLE AS unsupported_event_rate, round(avg(CASE WHEN event_id % 4 <> 0 THEN value / 4 END), 6) AS groundedness_score FROM events GROUP BY 1",
)
def _agg08(spark, sf_dir):
    some = F.col("event_id") % 4 != 0
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("event_id") % 3).alias("config_name"), F.when(some, F.col("value")).alias("unsupported_field_rate"), F.when(some, F.col("value") / 2).alias("evidence_coverage"),
        F.lit(None).cast("double").alias("unsupported_event_rate"), F.when(some, F.col("value") / 4).alias("groundedness_score"),
    )
    return E.hallucination(e)


@query("jn13_metrics_with_hallucination")
def _jn13(spark, sf_dir):
    m = E.evaluate(*data(spark, sf_dir))["metrics"]
    h = spark.createDataFrame([("base", 0.5), ("flow", 0.25)], "config_name string, groundedness_score double")
    return E.with_hallucination(m, h).select("config_name", "groundedness_score", "event_detection_f1")


@query("agg18_predictions_by_config", f"WITH {_DATA} SELECT config_name, count(*) AS n FROM pd GROUP BY 1")
def _agg18(spark, sf_dir):
    return data(spark, sf_dir)[3].groupBy("config_name").agg(F.count("*").alias("n"))


@query("agg20_top_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8")
def _agg20(spark, sf_dir):
    return reports.top_counts(table(spark, sf_dir, "part"), "p_brand", 8)


@query("agg20_melt", "SELECT n_nationkey, 'n_regionkey' AS metric, n_regionkey::DOUBLE AS value FROM nation UNION ALL SELECT n_nationkey, 'double_key', 2.0 * n_nationkey FROM nation")
def _melt(spark, sf_dir):
    return reports.melted(table(spark, sf_dir, "nation").withColumn("double_key", 2 * F.col("n_nationkey")), ["n_nationkey"], ["n_regionkey", "double_key"])


@query("evl05_report")
def _evl05(spark, sf_dir):
    """A rendered report, as one row."""
    result = E.evaluate(*data(spark, sf_dir))
    text = reports.report("Evaluation", {"Metrics": result["metrics"], "Errors": E.error_counts(result["errors"])})
    return spark.createDataFrame([(text, reports.bars(result["metrics"], "config_name", "event_type_macro_f1", "Type F1"))], "markdown string, chart string")


@query("binary_metrics_by_rule", "SELECT count(*) FILTER (WHERE quality = 0 AND s) AS tp, count(*) FILTER (WHERE quality = 1 AND s) AS fp, count(*) FILTER (WHERE quality = 0 AND NOT s) AS fn, count(*) FILTER (WHERE quality = 1 AND NOT s) AS tn FROM (SELECT quality, regexp_matches(text, '[#*$%&|<>]') AS s FROM labels JOIN documents USING (doc_id))")
def _binary(spark, sf_dir):
    rows = _base(spark, sf_dir).select("quality", F.col("text").rlike("[#*$%&|<>]").alias("s"))
    return rows.agg(*[F.count_if((F.col("quality") == q) & (F.col("s") == s)).alias(n) for n, q, s in (("tp", 0, True), ("fp", 1, True), ("fn", 0, False), ("tn", 1, False))])
