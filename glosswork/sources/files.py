"""Scans and sinks: JSON lines, CSV, HTML snapshots, manifests, predictions, reports. All paths go through Hadoop file systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.globStatus(p)) if any(c in path for c in "*?[") else fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A strict scan: a missing file is empty, a bad line fails the query."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_numbered(spark: SparkSession, path: str) -> DataFrame:
    """A permissive scan: line_number, value (variant) and error. Values that are no objects are wrapped as {"value": ...}.

    Line numbers are those of the file, by the order of its bytes.
    """
    text = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    # ids rise with file and place; the count of lines per input partition makes them gapless without one big sort
    part = F.shiftright("_at", 33)
    sizes = text.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    lines = text.withColumn("_part", part).join(F.broadcast(before), "_part")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    blank = F.trim("value") == ""
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(parsed)
    value = F.when(kind.startswith("OBJECT"), parsed).otherwise(F.try_parse_json(F.concat(F.lit('{"value":'), "value", F.lit("}"))))
    return lines.where(~blank).select(
        number.alias("line_number"), value.alias("value"), F.when(parsed.isNull(), "invalid JSON").alias("error"), F.col("value").alias("line")
    )


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """A page in a total order, and the count of all rows."""
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def read_csv(spark: SparkSession, path: str, optional: bool = True) -> DataFrame | None:
    """A CSV file with a header, all columns as text; None if it is missing and optional."""
    if optional and not exists(spark, path):
        return None
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def utf8(content: Column) -> Column:
    """Bytes as UTF-8 text, with a replacement sign for what is no UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def read_html_dir(spark: SparkSession, path: str) -> DataFrame:
    """path and html of each snapshot. Order by path where the first of several counts."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return pages.select("path", utf8(F.col("content")).alias("html"))


def decode_response(content: Column, charset: Column) -> Column:
    """Bytes as text by the charset of the response; latin-1 or none counts as UTF-8."""
    return F.when(F.lower(charset).isin("utf-16", "utf-16le", "utf-16be"), F.decode(content, "utf-16")).otherwise(utf8(content))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, by one aggregate (no window sort)."""
    value = F.struct(*df.columns)
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(F.max_by(value, rank).alias("_row")).select("_row.*")


MANIFEST = "html_path string, source_url string, source string, downloaded_at string, status_code int"
CANDIDATE = "url string, source string, ticker_hint string, keyword_hint string, discovered_at string, link_text string, score int, seed_url string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each file."""
    df = read_jsonl(spark, path, MANIFEST).withColumn("_at", F.monotonically_increasing_id())
    return latest(df, ["html_path"], [F.col("_at")]).drop("_at")


def upsert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the records of new in place of those with the same path, to be written in path order."""
    return old.join(new.select("html_path"), "html_path", "left_anti").unionByName(new).orderBy("html_path")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CANDIDATE)


def fetch(candidates: DataFrame, get, schema: str = "url string, status_code int, body string, error string") -> DataFrame:
    """One row per candidate; ``get(url)`` returns (status, body) or raises. Failures become rows."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    status, body = get(url)
                    rows.append((url, status, body, None))
                except Exception as e:  # the failure is the row
                    rows.append((url, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "status_code", "body", "error"]).astype({"status_code": "Int32"})

    return candidates.select("url").mapInPandas(run, schema)


def reset_snapshots(spark: SparkSession, folder: str, manifest: str | None = None) -> int:
    """Deletes the HTML snapshots of a folder and their manifest; the number of snapshots. For folders that a crawl fills anew."""
    fs, p = _path(spark, f"{folder.rstrip('/')}/*.html")
    found = [s.getPath() for s in (fs.globStatus(p) or [])]
    for snapshot in found:
        fs.delete(snapshot, False)
    if manifest is not None:
        fs, p = _path(spark, manifest)
        fs.delete(p, True)
    return len(found)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with fields in order of name; overwrites."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


def append_run_log(spark: SparkSession, path: str, event: str, payload: dict) -> None:
    import json

    row = spark.createDataFrame([(json.dumps({"event": event, **payload}, sort_keys=True, ensure_ascii=False),)], "value string")
    row.write.mode("append").text(path)


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """path, size, kind and time of each file below a folder, without reading the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), F.col("modificationTime").alias("modified"))


def report_snapshots(spark: SparkSession, path: str, most: int = 2_000_000) -> DataFrame:
    """path, text of the first ``most`` bytes, whether it was cut, and the value if it is JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = utf8(F.substring("content", 1, most))
    json = F.when(F.col("path").endswith(".json") & (F.col("length") <= most), F.try_parse_json(text))
    return files.select("path", F.col("length").alias("size"), text.alias("text"), (F.col("length") > most).alias("truncated"), json.alias("value"))


LABEL_KEYS = ("label", "gold", "prediction", "final_output", "verified_output")


def label_payload(record: Column) -> Column:
    """The label object (variant) of a record: the first object among its label fields, else the record itself."""
    options = [F.when(F.schema_of_variant(F.try_variant_get(record, f"$.{k}", "variant")).startswith("OBJECT"), F.try_variant_get(record, f"$.{k}", "variant")) for k in LABEL_KEYS]
    return F.coalesce(*options, record)


def first_value(record: Column, *paths: str) -> Column:
    """The first value at the paths that is not empty, as text; empty if none."""
    return F.coalesce(*[F.nullif(F.try_variant_get(record, p, "string"), F.lit("")) for p in paths], F.lit(""))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """article_id and label (variant): the last record of each article; records without an id are left out."""
    lines = read_jsonl_numbered(spark, path).where("error IS NULL")
    label = label_payload(F.col("value"))
    rows = lines.select(
        F.coalesce(F.nullif(first_value(label, "$.article_id"), F.lit("")), first_value(F.col("value"), "$.article_id")).alias("article_id"),
        F.to_json(label).alias("label"),
        "line_number",
    ).where("article_id <> ''")
    return latest(rows, ["article_id"], [F.col("line_number")]).drop("line_number").withColumn("label", F.parse_json("label"))


def _predictions(rows: DataFrame, default_config: str) -> DataFrame:
    record, label = F.col("value"), label_payload(F.col("value"))
    issues = F.coalesce(F.try_variant_get(record, "$.validation_issues", "array<variant>"), F.array().cast("array<variant>"))
    return rows.select(
        F.coalesce(F.nullif(first_value(label, "$.article_id"), F.lit("")), first_value(record, "$.article_id", "$.query_article_id")).alias("article_id"),
        F.coalesce(F.nullif(first_value(record, "$.config_name", "$.experiment_config", "$.run_config_name", "$.ablation_config"), F.lit("")), F.lit(default_config)).alias("config_name"),
        F.coalesce(F.nullif(first_value(record, "$.run_id"), F.lit("")), first_value(label, "$.model_info.run_id")).alias("run_id"),
        label.alias("prediction"),
        F.col("json_valid"),
        (F.col("json_valid") & ~F.exists(issues, lambda i: F.coalesce(F.try_variant_get(i, "$.severity", "string") == "error", F.lit(False)))).alias("schema_valid"),
        F.col("source_path"),
    )


def read_predictions(spark: SparkSession, path: str | None = None, runs_dir: str | None = None, default_config: str = "default") -> DataFrame:
    """Predictions of a file (lines, or one JSON array or object) and of ``*/result.json`` run folders; files that are no JSON are rows too."""
    parts = []
    if path and exists(spark, path):
        if path.endswith(".jsonl"):
            lines = read_jsonl_numbered(spark, path).select("value", F.lit(True).alias("json_valid"))
        else:
            whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
            many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
            lines = whole.select(F.explode(many).alias("value"), F.lit(True).alias("json_valid"))
        parts.append(lines.withColumn("source_path", F.lit(path)))
    if runs_dir and exists(spark, f"{runs_dir}/*/result.json"):
        whole = spark.read.option("wholetext", True).text(f"{runs_dir}/*/result.json").withColumn("source_path", F.input_file_name())
        value = F.try_parse_json("value")
        parts.append(whole.select(F.coalesce(value, F.parse_json(F.lit("{}"))).alias("value"), value.isNotNull().alias("json_valid"), "source_path"))
    if not parts:
        empty = spark.createDataFrame([], "value string, json_valid boolean, source_path string")
        parts.append(empty.withColumn("value", F.parse_json("value")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _predictions(rows, default_config)
