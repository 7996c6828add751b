"""Command line: ``python -m glosswork`` lists, runs or explains queries, plans jobs, searches articles."""

from __future__ import annotations

import argparse

from glosswork.session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glosswork")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    for name, text in [("run", "rows of a query"), ("explain", "its physical plan")]:
        p = commands.add_parser(name, help=text)
        p.add_argument("query")
        p.add_argument("sf_dir")
        p.add_argument("--rows", type=int, default=20)
    p = commands.add_parser("plan", help="steps of a job in order")
    p.add_argument("steps", nargs="+")
    p = commands.add_parser("ingest", help="HTML folder to clean articles")
    for name in ("html_dir", "company_csv", "keyword_csv", "out"):
        p.add_argument(name)
    p = commands.add_parser("prepare", help="chunks and indexes of clean articles")
    p.add_argument("articles")
    p.add_argument("out")
    p = commands.add_parser("retrieve", help="contexts of clean articles from prepared indexes")
    p.add_argument("articles")
    p.add_argument("out")
    p.add_argument("--config", default="metadata_aware_hybrid")
    p = commands.add_parser("audit", help="counts and duplicates of the dictionaries")
    for name in ("company_csv", "keyword_csv"):
        p.add_argument(name)
    p = commands.add_parser("prompts", help="teacher prompts of clean articles, as JSON lines")
    for name in ("articles", "out"):
        p.add_argument(name)
    p = commands.add_parser("label", help="teacher outputs (JSON lines of article_id, raw_output) to gold and rejected records")
    for name in ("articles", "outputs", "taxonomy", "out"):
        p.add_argument(name)
    p = commands.add_parser("patterns", help="pattern library of gold records")
    for name in ("articles", "out"):
        p.add_argument(name)
    p = commands.add_parser("extract", help="events of clean articles by rules, verified")
    for name in ("articles", "taxonomy", "out"):
        p.add_argument(name)
    p = commands.add_parser("sync", help="replaces, in a table kept in buckets, all rows of the keys of a source table")
    for name in ("target", "source", "key"):
        p.add_argument(name)
    p = commands.add_parser("health", help="whether the session answers and the paths are there")
    p.add_argument("paths", nargs="*")
    p = commands.add_parser("evaluate", help="metrics, errors and the report of predictions (a file or a folder of runs) against gold JSON lines")
    for name in ("gold", "out"):
        p.add_argument(name)
    p.add_argument("--predictions")
    p.add_argument("--runs")
    p.add_argument("--config", default="default")
    p = commands.add_parser("tail", help="new lines of run logs below a folder, until the given runs have ended")
    for name in ("logs", "out", "checkpoint"):
        p.add_argument(name)
    p.add_argument("runs", nargs="*")
    p.add_argument("--most", type=float, default=3600.0, help="seconds")
    p = commands.add_parser("run-all", help="HTML folder to verified events, and an evaluation where teacher outputs are given")
    for name in ("html_dir", "company_csv", "keyword_csv", "taxonomy", "out"):
        p.add_argument(name)
    p.add_argument("--outputs")
    given = parser.parse_args(args)

    from glosswork.plans import jobs, registry

    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if given.command == "plan":
        print("\n".join(jobs.plan(given.steps)))
        return 0
    spark = local_session()
    if given.command in ("run", "explain"):
        df = registry.queries()[given.query](spark, given.sf_dir)
        df.show(given.rows, False) if given.command == "run" else df.explain("formatted")
    elif given.command == "ingest":
        print(jobs.run_ingest(spark, given.html_dir, given.company_csv, given.keyword_csv, given.out).count())
    elif given.command == "prepare":
        jobs.run_prepare(spark, spark.read.parquet(given.articles), given.out)
    elif given.command == "retrieve":
        jobs.run_retrieve(spark, spark.read.parquet(given.articles), given.out, given.config).select("case_id", "rank", "chunk_id", "score").orderBy("case_id", "rank").show(100, False)
    else:
        return _work(spark, given)
    return 0


def _work(spark, given) -> int:
    """The commands of labeling, patterns, extraction, tables and the whole run."""
    from glosswork.operators import dictionaries, extraction, tables, validation, verification
    from glosswork.plans import jobs
    from glosswork.sources import files

    outputs = lambda path: files.read_jsonl(spark, path, "article_id string, raw_output string")
    taxonomy = lambda: validation.Taxonomy.of(dictionaries.load_event_taxonomy(spark, given.taxonomy))
    if given.command == "audit":
        dictionaries.audit(dictionaries.load_company_dictionary(spark, given.company_csv), dictionaries.load_event_keywords(spark, given.keyword_csv)).show(1000, False)
    elif given.command == "prompts":
        files.write_jsonl(verification.prompt_rows(spark.read.parquet(given.articles), "Label the article."), given.out)
    elif given.command == "label":
        jobs.run_label(spark.read.parquet(given.articles), taxonomy(), outputs(given.outputs), given.out).groupBy("validation_status", "route").count().show()
    elif given.command == "patterns":
        print(jobs.run_patterns(spark.read.parquet(given.articles), spark.read.parquet(f"{given.out}/gold"), given.out).count())
    elif given.command == "extract":
        found = extraction.run_batch(spark.read.parquet(given.articles), taxonomy())
        for name in ("documents", "events", "checks", "traces"):
            tables.write_table(found[name], f"{given.out}/extraction_{name}")
    elif given.command == "sync":
        tables.sync(spark.read.parquet(given.source), given.target, [given.key])
    elif given.command == "evaluate":
        print(jobs.run_evaluate_files(spark, given.gold, given.out, given.predictions, given.runs, given.config))
    elif given.command == "tail":
        from glosswork.streaming import log_tail

        return 0 if log_tail.follow(spark, given.logs, given.out, given.checkpoint, given.runs, most=given.most) else 1
    elif given.command == "health":
        return 0 if tables.healthcheck(spark, *given.paths) else 1
    else:
        jobs.run_all(spark, given.html_dir, given.company_csv, given.keyword_csv, given.taxonomy, given.out, outputs(given.outputs) if given.outputs else None).show(100, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
