"""Jobs end to end on a few pages, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from glosswork.__main__ import main
from glosswork.operators import validation
from glosswork.plans import jobs
from glosswork.sources import files


def test_plan():
    assert jobs.plan(["prepare", "ingest"]) == ["ingest", "prepare"]
    assert jobs.plan(["retrieve"], {"prepare"}) == ["retrieve"]
    for bad in (["verify"], ["nope"]):
        with pytest.raises(ValueError):
            jobs.plan(bad)


def test_from_pages_to_verified_events(spark, tmp_path):
    pages = tmp_path / "html"
    pages.mkdir()
    body = "".join(f"<p>{t}</p>" for t in ["FPT ky hop dong lon voi doi tac nuoc ngoai trong nam nay.", "Doanh thu tang manh. " * 12, "Co dong dong thuan. " * 10])
    for name in ("cafef_1", "cafef_2", "hnx_3"):
        text = body if name != "hnx_3" else body.replace("FPT", "VNM").replace("hop dong", "nha may")
        (pages / f"{name}.html").write_text(f"<html><head><title>{name[:5]} tin</title></head><body>{text}</body></html>", encoding="utf-8")
    (tmp_path / "c.csv").write_text("ticker,company_name,aliases,sector\nFPT,FPT Corp,,TECH\nVNM,Vinamilk,,FOOD\n")
    (tmp_path / "k.csv").write_text("event_type,event_subtype,keyword,polarity_hint,priority,notes\nCONTRACT,SIGNED,hợp đồng,positive,2,\nEXPANSION,PLANT,nhà máy,positive,1,\n", encoding="utf-8")
    out = str(tmp_path / "out")
    articles = jobs.run_ingest(spark, str(pages), str(tmp_path / "c.csv"), str(tmp_path / "k.csv"), out)
    rows = {r["source"]: r for r in articles.collect()}
    assert set(rows) == {"cafef", "hnx"}  # cafef_2 repeats cafef_1
    assert rows["cafef"]["tickers_hint"] == ["FPT"] and rows["cafef"]["event_type_hints"] == ["CONTRACT"]
    jobs.run_prepare(spark, articles, out, 32)
    jobs.run_prepare(spark, articles, out, 32)
    assert spark.read.parquet(f"{out}/embeddings").where("cache_hit").count() == spark.read.parquet(f"{out}/chunks").count()
    found = jobs.run_retrieve(spark, articles, out).where("rank = 1").collect()
    assert {r["case_id"]: r["article_id"] for r in found} == {a["article_id"]: a["article_id"] for a in rows.values()}
    taxonomy = validation.Taxonomy({"CONTRACT": ("SIGNED",), "EXPANSION": ("PLANT",)}, {})
    result = jobs.run_extract_verify(articles, taxonomy)
    assert result["events"].count() == 2 and result["dropped"].count() == 0
    assert files.list_reports(spark, out).where(F.col("kind") == "parquet").count() > 0


def test_the_whole_run_and_its_reports(spark, tmp_path, capsys):
    import json

    pages = tmp_path / "html"
    pages.mkdir()
    fill = "".join(f"<p>{'Co dong dong thuan voi ke hoach. ' * 6}</p>" for _ in range(2))
    for i, (name, text) in enumerate([("FPT", "ky hop dong lon"), ("VNM", "xay nha may moi"), ("HPG", "khong co gi")]):
        (pages / f"cafef_{i}.html").write_text(f"<html><head><title>Tin {name}</title></head><body><p>{name} {text} trong nam nay.</p>{fill}</body></html>", encoding="utf-8")
    (tmp_path / "c.csv").write_text("ticker,company_name,aliases,sector\nFPT,FPT Corp,,TECH\nVNM,Vinamilk,,FOOD\nHPG,Hoa Phat,,STEEL\n")
    (tmp_path / "k.csv").write_text("event_type,event_subtype,keyword,polarity_hint,priority,notes\nCONTRACT,SIGNED,hợp đồng,positive,2,\nEXPANSION,PLANT,nhà máy,positive,1,\n", encoding="utf-8")
    rules = {"CONTRACT": {"subtypes": ["SIGNED"], "argument_fields": []}, "EXPANSION": {"subtypes": ["PLANT"], "argument_fields": ["project"]}}
    (tmp_path / "t.json").write_text(json.dumps({"schema_version": "v1", "document_labels": ["HAS_EVENT", "NO_EVENT", "UNCERTAIN"], "impact_sentiments": ["POSITIVE", "NEUTRAL"], "common_argument_fields": [], "event_types": rules}))
    args = [str(tmp_path / x) for x in ("html", "c.csv", "k.csv", "t.json", "out")]
    first = {(r["step"], r["table"]): r["n"] for r in jobs.run_all(spark, *args).collect()}
    assert first[("ingest", "articles")] == 3 and first[("extract", "extraction_events")] == 2 and first[("extract", "extraction_traces")] == 12
    drafts = {r["article_id"]: r for r in spark.read.parquet(f"{args[-1]}/extraction_events").collect()}
    event = lambda r: {"event_id": r["event_id"], "ticker": r["ticker"], "company_name": r["company_name"], "event_type": r["event_type"], "event_subtype": r["event_subtype"], "event_summary": "s", "event_reason": "r",
                       "event_arguments": {}, "impact_sentiment": "POSITIVE", "evidence_span": r["evidence_span"], "source_url": "u", "published_at": None, "confidence": 0.9}
    rows = []
    for a in spark.read.parquet(f"{args[-1]}/articles").collect():
        e = [event(drafts[a["article_id"]])] if a["article_id"] in drafts else []
        label = {"article_id": a["article_id"], "document_label": "HAS_EVENT" if e else "NO_EVENT", "label_reason": "why", "events": e, "warnings": [], "model_info": {"model_name": "m", "prompt_version": "p", "run_id": "r"}}
        rows.append((a["article_id"], json.dumps(label)))
    outputs = spark.createDataFrame(rows, "article_id string, raw_output string")
    second = {(r["step"], r["table"]): r["n"] for r in jobs.run_all(spark, *args, outputs).collect()}
    assert second[("label", "gold")] == 3 and second[("label", "rejected")] == 0 and second[("patterns", "patterns")] == 2 and second[("evaluate", "evaluation/errors")] == 0
    m = spark.read.parquet(f"{args[-1]}/evaluation/metrics").first()
    assert m["event_detection_f1"] == m["event_type_macro_f1"] == 1.0
    outputs.write.json(str(tmp_path / "outputs"))
    capsys.readouterr()
    assert main(["label", f"{args[-1]}/articles", str(tmp_path / "outputs"), args[3], args[-1]]) == 0 and "gold" in capsys.readouterr().out
    assert main(["audit", args[1], args[2]]) == 0 and "TECH" in capsys.readouterr().out
    assert main(["health", args[0]]) == 0 and main(["health", f"{args[0]}-none"]) == 1
    assert main(["extract", f"{args[-1]}/articles", args[3], args[-1]]) == 0 and main(["patterns", f"{args[-1]}/articles", args[-1]]) == 0


def test_a_batch_with_model_outputs_keeps_errors_in_traces(spark):
    from glosswork.operators import extraction, verification

    articles = spark.createDataFrame([("a", "FPT ky hop dong lon"), ("b", "VNM"), ("c", "HPG")], "article_id string, text string")
    articles = articles.withColumns({c: F.array().cast("array<string>") for c in ("tickers_hint", "company_names_hint", "event_keywords", "event_type_hints", "event_subtype_hints")})

    def model(prompt):
        if prompt == "c":
            raise RuntimeError("down")
        return "no json" if prompt == "b" else '{"article_id": "a", "document_label": "HAS_EVENT", "events": [{"event_id": "e", "event_type": "contract", "evidence_span": "ky hop dong lon", "event_arguments": {}, "confidence": 0.5}]}'

    outputs = verification.invoke(articles.select("article_id", F.col("article_id").alias("prompt")), model, 1)
    found = extraction.run_batch(articles, validation.Taxonomy({"CONTRACT": ("SIGNED",)}, {}), outputs)
    documents = {r["article_id"]: r for r in found["documents"].collect()}
    assert [documents[k]["document_label"] for k in "abc"] == ["HAS_EVENT", "UNCERTAIN", "UNCERTAIN"] and documents["c"]["error"] == "down"
    status = {(r["article_id"], r["node"]): r["status"] for r in found["traces"].collect()}
    assert status[("c", "extraction")] == "error" and status[("b", "validation_repair")] == "error" and status[("a", "extraction")] == "success"
    off = extraction.run_batch(articles, validation.Taxonomy({"CONTRACT": ("SIGNED",)}, {}), outputs, verify=False)
    assert off["checks"].count() == 0 and off["events"].count() == 1


def test_report_suite(spark):
    from glosswork.operators import evaluation, reports
    from glosswork.plans.evaluation_queries import data

    gold, documents, events, predictions = data(spark, "/root/testdata/sf0.001")
    result = evaluation.evaluate(gold, documents, events, predictions)
    h = spark.createDataFrame([("base", 0.5), ("flow", 0.75)], "config_name string, groundedness_score double")
    out = reports.suite(result["metrics"], h, result["errors"], result["per_event_type"], result["documents"], evaluation.best_config(result["metrics"]), evaluation.error_counts(result["errors"]))
    assert len(out) == 10 and "flow" in out["eval_summary.md"] and "E_INVALID_JSON" in out["schema_error_summary.md"] and out["figures/event_type_f1.svg"].startswith("<svg")
    assert all(f"- {name}" in out["report_index.md"] for name in out if name != "report_index.md")


def test_command_line(capsys):
    assert main(["list"]) == 0 and "q_bm25_topk" in capsys.readouterr().out
    assert main(["plan", "ingest", "prepare"]) == 0 and capsys.readouterr().out.split() == ["ingest", "prepare"]


def test_evaluate_and_tail_commands(spark, tmp_path, capsys):
    event = {"event_type": "CONTRACT", "event_subtype": "SIGNED", "ticker": "FPT", "evidence_span": "ky hop dong", "event_arguments": {"partner": "x"}, "impact_sentiment": "POSITIVE"}
    label = lambda a, *events: {"article_id": a, "document_label": "HAS_EVENT" if events else "NO_EVENT", "events": list(events)}
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps(label(a, *e)) for a, e in (("a", [event]), ("b", []), ("c", [event]))))
    lines = [{"config_name": "one", "prediction": label("a", event)}, {"config_name": "one", "prediction": label("b")}, {"config_name": "one", "prediction": label("c")}, {"config_name": "one", "prediction": label("c", event)}]
    lines.append({"config_name": "two", "prediction": label("a"), "validation_issues": [{"severity": "warning"}, {"severity": "error"}]})
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)))
    out = str(tmp_path / "out")
    assert main(["evaluate", str(tmp_path / "gold.jsonl"), out, "--predictions", str(tmp_path / "p.jsonl")]) == 0
    assert "Best configuration" in capsys.readouterr().out
    found = {r["config_name"]: r for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert found["one"]["event_detection_f1"] == found["one"]["event_type_macro_f1"] == 1.0 and found["two"]["event_detection_recall"] == 0.0
    assert found["one"]["schema_compliance_rate"] == 1.0 > found["two"]["schema_compliance_rate"]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "r.log").write_text('{"event": "x", "run_id": "r1", "status": "success"}\n')
    places = [str(logs), str(tmp_path / "lines"), str(tmp_path / "state")]
    assert main(["tail", *places, "r1"]) == 0 and main(["tail", *places, "r2", "--most", "0"]) == 1


def test_sync_rewrites_only_touched_buckets(spark, tmp_path):
    from glosswork.operators import tables

    path = str(tmp_path / "t")
    rows = spark.range(2000).select("id", F.lit("old").alias("v"))
    tables.sync(rows.unionByName(rows), path, ["id"])  # two rows of each key
    listed = lambda: {str(p.relative_to(path)) for p in (tmp_path / "t").rglob("*.parquet")}
    before = listed()
    assert len({p.split("/")[0] for p in before}) == tables.BUCKETS
    tables.sync(spark.createDataFrame([(3, "new"), (3, "new"), (3, "more"), (5000, "new")], "id long, v string"), path, ["id"])
    changed = {p.split("/")[0] for p in before ^ listed()}
    assert 1 <= len(changed) <= 2
    got = tables.read_buckets(spark, path)
    assert sorted(r.v for r in got.where("id = 3").collect()) == ["more", "new", "new"] and got.count() == 2 * 1999 + 3 + 1
    tables.sync(spark.createDataFrame([], "id long, v string"), path, ["id"])
    assert got.count() == 4002 and set(got.columns) == {"id", "v"}
    rows.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        tables.sync(rows, str(tmp_path / "plain"), ["id"])


def test_a_sync_that_fails_leaves_the_table(spark, tmp_path):
    from glosswork.operators import tables

    path = str(tmp_path / "t")
    tables.sync(spark.range(100).select("id", F.lit("old").alias("v")), path, ["id"])
    bad = spark.range(50).select("id", F.when(F.col("id") == 40, F.raise_error(F.lit("no"))).otherwise(F.lit("new")).cast("string").alias("v"))
    with pytest.raises(Exception, match="no"):
        tables.sync(bad, path, ["id"])
    assert tables.read_buckets(spark, path).where("v = 'old'").count() == 100
    tables.write_table(spark.range(3), str(tmp_path / "w"))
    (tmp_path / "w").rename(tmp_path / "w.last")  # as a stop between the two renames leaves it
    assert tables.recover(spark, str(tmp_path / "w")) and not tables.recover(spark, str(tmp_path / "w")) and spark.read.parquet(str(tmp_path / "w")).count() == 3
