"""Jobs made of operators: their registry with prerequisites, and the end-to-end runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.lineage import cut
from glosswork.operators import chunking, dictionaries, evaluation, extraction, index, ingest, querying, reports, retrieval, tables, validation, verification
from glosswork.sources import files

#: Each step and the steps whose output it reads.
STEPS = {
    "ingest": [],
    "label": ["ingest"],
    "prepare": ["ingest"],
    "patterns": ["label", "prepare"],
    "retrieve": ["prepare"],
    "extract": ["retrieve"],
    "verify": ["extract"],
    "evaluate": ["verify", "label"],
}


def plan(selected: list[str], done: set[str] = frozenset()) -> list[str]:
    """The selected steps in order; raises if a prerequisite is neither selected nor done."""
    unknown = [s for s in selected if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    order = [s for s in STEPS if s in selected]
    for s in order:
        missing = [p for p in STEPS[s] if p not in selected and p not in done]
        if missing:
            raise ValueError(f"{s} needs {missing}")
    return order


RUN = "run_id string, steps array<string>, status string, created_at timestamp, finished_at timestamp, error string"


def create_run(spark: SparkSession, path: str, selected: list[str], run_id: str) -> DataFrame:
    """Adds a queued run with its planned steps to the table of runs; the table."""
    row = spark.createDataFrame([(run_id, plan(selected, set(STEPS)))], "run_id string, steps array<string>")
    row = row.select("run_id", "steps", F.lit("queued").alias("status"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    row.write.mode("append").parquet(path)
    return spark.read.schema(RUN).parquet(path)


def reconcile_runs(runs: DataFrame, at) -> DataFrame:
    """Runs that a stopped process left open (queued or running) as interrupted at the given time; the others as they are."""
    open_ = F.col("status").isin("queued", "running")
    return runs.withColumns({
        "finished_at": F.when(open_, F.lit(at).cast("timestamp")).otherwise(F.col("finished_at")), "error": F.when(open_, "interrupted before it ended").otherwise(F.col("error")),
        "status": F.when(open_, "interrupted").otherwise(F.col("status")),
    })


def run_ingest(spark: SparkSession, html_dir: str, company_csv: str, keyword_csv: str, out: str, manifest: str | None = None) -> DataFrame:
    """HTML snapshots to clean articles with hints, and their quality counts."""
    raw = ingest.parse_pages(files.read_html_dir(spark, html_dir), files.read_manifest(spark, manifest) if manifest else None)
    clean = ingest.clean_articles(raw, dictionaries.load_company_dictionary(spark, company_csv), dictionaries.load_event_keywords(spark, keyword_csv))
    tables.write_table(clean, f"{out}/articles")
    return spark.read.parquet(f"{out}/articles")


def run_prepare(spark: SparkSession, articles: DataFrame, out: str, dimension: int = 128) -> None:
    """Chunks, postings with corpus statistics, embeddings and the vector manifest."""
    tables.write_table(chunking.build_chunks(articles), f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    hints = [F.col(c) for c in ("tickers_hint", "company_names_hint", "event_keywords", "event_type_hints")]
    whole = chunks.withColumn("embedding_text", T.retrieval_text(F.col("title"), F.col("text"), *hints))
    tokens = T.tokens(F.col("embedding_text"))
    tables.write_table(index.postings(whole, "chunk_id", tokens), f"{out}/postings")
    tables.write_table(index.document_frequencies(whole, tokens), f"{out}/frequencies")
    tables.write_table(index.corpus_stats(whole, tokens), f"{out}/statistics")
    cache = f"{out}/embedding_cache"
    known = spark.read.parquet(cache) if files.exists(spark, cache) else spark.createDataFrame([], "embedding_model string, chunk_hash string, vector array<double>")
    embed = lambda df: index.hash_embeddings(df, "chunk_id", T.tokens(F.col("embedding_text"), False), dimension)
    tables.write_table(index.embed_with_cache(whole, known, embed), f"{out}/embeddings")
    records = spark.read.parquet(f"{out}/embeddings")
    tables.write_table(index.updated_cache(known, records), cache)
    tables.write_table(index.vector_manifest(chunks, records), f"{out}/manifest")


def run_retrieve(spark: SparkSession, articles: DataFrame, out: str, config: str = "metadata_aware_hybrid") -> DataFrame:
    """Ranked contexts of every article, in one batch."""
    c = retrieval.CONFIGS[config]
    chunks = spark.read.parquet(f"{out}/chunks")
    vectors = spark.read.parquet(f"{out}/embeddings").select("chunk_id", "vector")
    queries = querying.build_queries(articles, c.query_mode)
    dimension = vectors.select(F.max(F.size("vector"))).first()[0] or 128
    query_vectors = index.hash_embeddings(queries, "query_id", T.tokens(F.col("text"), False), dimension)
    return retrieval.retrieve(queries, chunks, c, vectors, query_vectors)


def run_extract_verify(articles: DataFrame, taxonomy: validation.Taxonomy, contexts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rule extractor over all articles, then verification."""
    rows = articles if "title" in articles.columns else articles.withColumn("title", F.lit(None).cast("string"))
    return verification.verify(verification.rule_extract(rows, taxonomy), rows, taxonomy, contexts)


def run_label(articles: DataFrame, taxonomy: validation.Taxonomy, outputs: DataFrame, out: str) -> DataFrame:
    """Teacher outputs (article_id, raw_output) to gold and rejected records as tables; the records."""
    records = validation.teacher_records(outputs, articles, taxonomy).withColumn("label", F.to_json("label"))
    tables.write_table(records, f"{out}/teacher_records")
    kept = articles.sparkSession.read.parquet(f"{out}/teacher_records")
    tables.write_table(kept.where("route = 'gold'"), f"{out}/gold")
    tables.write_table(kept.where("route = 'rejected'"), f"{out}/rejected")
    return kept


def run_patterns(articles: DataFrame, gold: DataFrame, out: str) -> DataFrame:
    """Pattern library of gold records (article_id, label as JSON text) and the chunks it is attached to; the patterns."""
    labels = gold.select("article_id", F.parse_json("label").alias("label"))
    found = verification.patterns(validation.exploded_events(labels), articles)
    tables.write_table(found, f"{out}/patterns")
    kept = articles.sparkSession.read.parquet(f"{out}/patterns")
    tables.write_table(verification.attach_patterns(kept, articles.sparkSession.read.parquet(f"{out}/chunks")), f"{out}/pattern_chunks")
    return kept


def run_all(spark: SparkSession, html_dir: str, company_csv: str, keyword_csv: str, taxonomy_json: str, out: str, outputs: DataFrame | None = None) -> DataFrame:
    """Snapshots to extracted and verified events: (step, table, n) of everything written below ``out``.

    With teacher ``outputs`` (article_id, raw_output) labels, patterns and an evaluation of the rule extractor follow.
    """
    taxonomy = validation.Taxonomy.of(dictionaries.load_event_taxonomy(spark, taxonomy_json))
    articles = run_ingest(spark, html_dir, company_csv, keyword_csv, out)
    run_prepare(spark, articles, out)
    tables.write_table(run_retrieve(spark, articles, out), f"{out}/contexts")
    written = {"ingest": ["articles"], "prepare": ["chunks", "postings", "embeddings"], "retrieve": ["contexts"]}
    found = extraction.run_batch(articles, taxonomy)
    for name in ("documents", "events", "checks", "traces"):
        tables.write_table(found[name], f"{out}/extraction_{name}")
    written["extract"] = [f"extraction_{n}" for n in ("documents", "events", "checks", "traces")]
    if outputs is not None:
        run_label(articles, taxonomy, outputs, out)
        gold = spark.read.parquet(f"{out}/gold")
        run_patterns(articles, gold, out)
        events, documents = labelled(gold.select("article_id", F.parse_json("label").alias("label")))
        made = spark.read.parquet(f"{out}/extraction_events").withColumn("config_name", F.lit("rules"))
        predictions = spark.read.parquet(f"{out}/extraction_documents").select(
            F.lit("rules").alias("config_name"), "article_id", "document_label", "n_events", F.lit(True).alias("json_valid"), F.lit(True).alias("schema_valid"), F.lit(0).alias("position")
        )
        run_evaluate(events, documents, made, predictions, f"{out}/evaluation")
        written |= {"label": ["gold", "rejected"], "patterns": ["patterns", "pattern_chunks"], "evaluate": ["evaluation/metrics", "evaluation/errors"]}
    rows = [(step, name, spark.read.parquet(f"{out}/{name}").count()) for step, names in written.items() for name in names]
    return spark.createDataFrame(rows, "step string, table string, n long")


def labelled(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and documents of labels (article_id, label as variant, and further columns), as the evaluation takes them."""
    more = [c for c in labels.columns if c != "label"]
    events = validation.exploded_events(labels).select(*more, *evaluation.FIELDS, "event_index")
    n = F.size(F.coalesce(F.try_variant_get("label", "$.events", "array<variant>"), F.array().cast("array<variant>")))
    return events, labels.select(*more, T.nullable_upper(F.try_variant_get("label", "$.document_label", "string")).alias("document_label"), n.alias("n_events"))


def run_evaluate_files(spark: SparkSession, gold_path: str, out: str, predictions_path: str | None = None, runs_dir: str | None = None, config: str = "default") -> str:
    """Gold JSON lines against a file of predictions or a folder of runs: ``run_evaluate`` of the best prediction that each
    configuration has for each article."""
    found = files.read_predictions(spark, predictions_path, runs_dir, config).where("article_id <> ''")
    rows = found.select("config_name", "article_id", F.col("prediction").alias("label"), "json_valid", "schema_valid", F.monotonically_increasing_id().alias("position"))
    _, documents = labelled(rows.withColumn("text", F.to_json("label")))
    best = cut(evaluation.best_prediction(documents))
    events, _ = labelled(best.select("config_name", "article_id", F.parse_json("text").alias("label")))
    gold_events, gold_documents = labelled(files.read_gold(spark, gold_path))
    return run_evaluate(gold_events, gold_documents, events, best.drop("text"), out)


def run_evaluate(gold_events: DataFrame, gold_documents: DataFrame, predicted: DataFrame, predictions: DataFrame, out: str) -> str:
    """Metrics and errors of every configuration as tables, and the report text."""
    result = evaluation.evaluate(gold_events, gold_documents, predicted, evaluation.best_prediction(predictions))
    for name in ("metrics", "per_event_type", "documents", "errors"):
        tables.write_table(result[name], f"{out}/{name}")
    counts = evaluation.error_counts(result["errors"])
    best = evaluation.best_config(result["metrics"])
    advice = "\n".join(f"- {x}" for x in reports.recommendations(best, counts)) + "\n"
    return reports.report("Evaluation", {"Metrics": result["metrics"], "Best configuration": best.select("config_name"), "Errors": counts, "Next": advice})
