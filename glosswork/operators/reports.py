"""Rendering of small aggregates: Markdown tables, SVG bars, recommendations. Inputs are results of aggregations."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_table(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> str:
    """A Markdown table of a small result."""
    names = columns or df.columns
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    for row in df.select(*names).collect():
        lines.append("| " + " | ".join(f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in row) + " |")
    return "\n".join(lines) + "\n"


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    parts = [f"# {title}\n"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n{body if isinstance(body, str) else markdown_table(body)}")
    return "\n".join(parts)


def bars(df: DataFrame, label: str, value: str, title: str, width: int = 640) -> str:
    """An SVG bar chart of a small result."""
    rows = [(str(r[0]), float(r[1] or 0)) for r in df.select(label, value).collect()]
    top = max((v for _, v in rows), default=1.0) or 1.0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 24 * len(rows)}"><text x="8" y="20">{escape(title)}</text>']
    for i, (name, v) in enumerate(rows):
        y = 36 + 24 * i
        out.append(f'<text x="8" y="{y + 12}">{escape(name)}</text><rect x="200" y="{y}" width="{(width - 280) * v / top:.1f}" height="16"/><text x="{width - 70}" y="{y + 12}">{v:.4f}</text>')
    return "".join(out) + "</svg>"


def suite(metrics: DataFrame, hallucination: DataFrame, errors: DataFrame, per_type: DataFrame, documents: DataFrame, best: DataFrame, counts: DataFrame) -> dict[str, str]:
    """The evaluation's reports by file name: summary, batch, verification, schema errors, recommendations, index, and figures."""
    by_code = errors.groupBy("error_code").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "error_code")
    schema = errors.where("error_code IN ('E_INVALID_JSON', 'E_SCHEMA_VIOLATION')").groupBy("config_name", "error_code").agg(F.count("*").alias("count")).orderBy("config_name", "error_code")
    outcome = documents.groupBy("config_name").agg(F.count("*").alias("articles"), F.count_if("json_valid").alias("valid_json"), F.count_if("schema_valid").alias("valid_schema")).orderBy("config_name")
    worst = per_type.orderBy("f1", F.col("fn").desc(), F.col("fp").desc(), "label").limit(8)
    out = {
        "eval_summary.md": report("Evaluation", {"Metrics": metrics, "Best configuration": best.select("config_name"), "Errors": by_code}),
        "extraction_batch_summary.md": report("Extraction batch", {"Documents": outcome, "Event types with the lowest F1": worst}),
        "verification_summary.md": report("Verification", {"Hallucination": hallucination}),
        "schema_error_summary.md": report("Schema errors", {"By configuration": schema}),
        "improvement_recommendations.md": report("Recommendations", {"Next": "\n".join(f"- {x}" for x in recommendations(best, counts)) + "\n"}),
        "figures/extraction_metrics.svg": bars(metrics, "config_name", "event_detection_f1", "Event detection F1"),
        "figures/event_type_f1.svg": bars(per_type.groupBy("label").agg(F.avg("f1").alias("f1")).orderBy("label"), "label", "f1", "F1 by event type"),
        "figures/error_distribution.svg": bars(by_code, "error_code", "count", "Errors"),
        "figures/grounding_metrics.svg": bars(hallucination, "config_name", "groundedness_score", "Groundedness"),
    }
    return out | {"report_index.md": "# Reports\n\n" + "".join(f"- {name}\n" for name in sorted(out))}


def top_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values by falling count, ties by value; the first n of them for a figure."""
    rows = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)
    return rows if n is None else rows.limit(n)


def melted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """One row per id and value column."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, "metric", "value")


# Below these levels a report recommends work on the part named.
LEVELS = [
    ("event_detection_f1", 0.75, "Improve event detection"),
    ("event_type_macro_f1", 0.70, "Improve event type classification"),
    ("slot_f1", 0.60, "Improve argument extraction"),
    ("json_validity_rate", 0.95, "Improve JSON validity"),
    ("groundedness_score", 0.80, "Improve evidence grounding"),
]


def recommendations(best: DataFrame, counts: DataFrame) -> list[str]:
    """What to work on, from the best configuration's metrics (one row) and the counts of errors."""
    row = next(iter(best.collect()), None)
    found = [text for name, level, text in LEVELS if row is not None and name in best.columns and (row[name] or 0) < level]
    common = counts.orderBy(F.col("count").desc(), "error_code").limit(3).collect()
    return found + [f"Most frequent error: {r['error_code']} ({r['count']})" for r in common] or ["No priority found"]
