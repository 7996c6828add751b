"""Queries of loaders, sinks, fetching, run folders, reports and control tables, with their oracles.

Files are made from the tables, written below the shared folder, and read back through the loader under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import html as H
from glosswork.functions import text as T
from glosswork.lineage import new_path
from glosswork.operators import dictionaries, index, ingest, tables, verification
from glosswork.plans import jobs
from glosswork.plans.text_queries import norm
from glosswork.session import table
from glosswork.sources import files

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


@query("src04_optional_csv", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, true AS missing_is_none FROM region")
def _src04(spark, sf_dir):
    path = new_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "region"), path, ["r_regionkey", "r_name"])
    missing = files.read_csv(spark, f"{path}/no-such-file.csv")
    return files.read_csv(spark, path).withColumn("missing_is_none", F.lit(missing is None))


@query(
    "src05_company_file",
    """
SELECT upper('t' || n_nationkey) AS ticker, n_name AS company_name, n_name || ' A|' || lower(n_name) AS aliases, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'S' || (n_nationkey % 3) END AS sector, CAST(NULL AS VARCHAR) AS exchange
FROM nation WHERE n_nationkey % 5 <> 0
""",
)
def _src05(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    rows = n.select(
        F.concat(F.lit(" t"), k, F.lit(" ")).alias("ticker"), F.when(k % 5 == 0, "").otherwise(F.col("n_name")).alias("company_name"),
        F.concat("n_name", F.lit(" A| |"), F.lower("n_name"), F.lit("|")).alias("aliases"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("S"), k % 3)).alias("sector"),
    )
    path = new_path(spark, "companies")
    files.write_csv(rows, path)
    found = dictionaries.load_company_dictionary(spark, path).unionByName(dictionaries.load_company_dictionary(spark, f"{path}-missing"))
    return found.select("ticker", "company_name", F.array_join("aliases", "|").alias("aliases"), "sector", "exchange")


@query(
    "src06_keyword_file",
    """
SELECT upper(p_brand) AS event_type, 'S' || (p_partkey % 4) AS event_subtype, p_name AS keyword, CASE WHEN p_partkey % 2 = 0 THEN 'neutral' ELSE 'positive' END AS polarity_hint,
       CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE CAST(p_size AS INTEGER) END AS priority FROM part WHERE p_partkey % 11 <> 0
""",
)
def _src06(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.lower("p_brand").alias("event_type"), F.concat(F.lit("s"), k % 4).alias("event_subtype"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("keyword"),
        F.when(k % 2 == 0, "").otherwise("positive").alias("polarity_hint"), F.when(k % 7 == 0, "high").otherwise(F.col("p_size").cast("string")).alias("priority"), F.lit("a, \"b\"").alias("notes"),
    )
    path = new_path(spark, "keywords")
    files.write_csv(rows, path)
    return dictionaries.load_event_keywords(spark, path).select("event_type", "event_subtype", "keyword", "polarity_hint", "priority")


@query("src07_taxonomy_file", "SELECT r_name AS event_type, array_to_string(list_sort(list(n_name)), '|') AS subtypes, 'a|b|z' AS argument_fields, 'HAS_EVENT|NO_EVENT' AS labels FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def _src07(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    kinds = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.collect_list("n_name").alias("subtypes"))
    rule = F.struct("subtypes", F.array(F.lit("b"), F.lit("a")).alias("argument_fields"))
    whole = kinds.agg(F.map_from_entries(F.collect_list(F.struct("r_name", rule))).alias("event_types"))
    path = new_path(spark, "taxonomy")
    text = whole.select(F.to_json(F.struct(F.lit("v1").alias("schema_version"), F.array(F.lit("HAS_EVENT"), F.lit("NO_EVENT")).alias("document_labels"), F.array(F.lit("z"), F.lit("a")).alias("common_argument_fields"), "event_types")).alias("value"))
    text.write.text(path)
    rows = dictionaries.load_event_taxonomy(spark, path)
    return rows.select("event_type", F.array_join("subtypes", "|").alias("subtypes"), F.array_join("argument_fields", "|").alias("argument_fields"), F.array_join("document_labels", "|").alias("labels"))


@query("src10_manifest_merge", "SELECT 'p' || page_id AS html_path, url AS source_url, CASE WHEN page_id % 2 = 0 THEN 200 ELSE 404 END::INTEGER AS status_code FROM pages WHERE page_id % 3 <> 0 OR page_id % 2 = 0")
def _src10(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.concat(F.lit("p"), "page_id").alias("html_path"), F.col("url").alias("source_url"), F.lit("s").alias("source"), F.lit("2024").alias("downloaded_at"), F.lit(404).alias("status_code"))
    path = new_path(spark, "manifest")
    files.write_jsonl(rows.where("page_id % 3 <> 0").drop("page_id"), path)
    new = rows.where("page_id % 2 = 0").withColumn("status_code", F.lit(200)).drop("page_id")
    return files.upsert_manifest(files.read_manifest(spark, path), new).select("html_path", "source_url", "status_code")


@query(
    "src11_src12_src13_fetched",
    "SELECT url, CASE WHEN contains(url, '?') THEN NULL ELSE 200 END::INTEGER AS status_code, CASE WHEN contains(url, '?') THEN NULL ELSE md5(reverse(url)) END AS digest, CASE WHEN contains(url, '?') THEN 'refused' END AS error FROM pages",
)
def _src11(spark, sf_dir):
    def get(url: str) -> tuple[int, str]:
        if "?" in url:
            raise ValueError("refused")
        return 200, url[::-1]

    path = new_path(spark, "candidates")
    files.write_jsonl(table(spark, sf_dir, "pages").select("url", F.lit("web").alias("source"), F.lit(3).alias("score")), path)
    got = files.fetch(files.read_candidates(spark, path), get)
    return got.select("url", "status_code", F.md5("body").alias("digest"), "error")


@query("src14_decoded_bodies", "SELECT doc_id, md5(text) AS digest FROM documents")
def _src14(spark, sf_dir):
    wide = F.col("doc_id") % 2 == 0
    body = F.when(wide, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    charset = F.when(wide, "UTF-16").when(F.col("doc_id") % 3 == 0, "latin-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(files.decode_response(body, charset)).alias("digest"))


@query(
    "src17_src18_src19_run_folders",
    """
SELECT CASE WHEN r_regionkey = 4 THEN '' ELSE 'a' || r_regionkey END AS article_id, CASE WHEN r_regionkey = 4 THEN 'standard' WHEN r_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS config_name,
       CASE WHEN r_regionkey = 4 THEN '' WHEN r_regionkey = 3 THEN 'model-run' ELSE 'run' || r_regionkey END AS run_id, r_regionkey <> 4 AS json_valid FROM region
UNION ALL SELECT 'n' || n_nationkey, 'file', '', true FROM nation
""",
)
def _src17(spark, sf_dir):
    """Results of run folders, one of them broken, and a file that is one JSON array."""
    base = new_path(spark, "runs")
    for r in table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")).collect():  # five rows
        k = r["k"]
        run = '"model_info": {"run_id": "model-run"}' if k == 3 else '"warnings": []'
        named = "" if k == 3 else f'"run_id": "run{k}", '
        label = f'{{"article_id": "a{k}", "document_label": "NO_EVENT", {run}}}'
        put(spark, f"{base}/{k}/result.json", "{broken" if k == 4 else f'{{{named}"experiment_config": "{("even", "odd")[k % 2]}", "final_output": {label}}}')
    whole = table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("n"), "n_nationkey").alias("article_id"), F.lit("file").alias("config_name")))).alias("value"))
    whole.coalesce(1).write.text(f"{base}-file")
    found = files.read_predictions(spark, f"{base}-file", base, "standard")
    return found.select("article_id", "config_name", "run_id", "json_valid")


def _reports(spark, sf_dir) -> str:
    base = new_path(spark, "reports")
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows
        kind = ("json", "MD", "csv")[r["r_regionkey"] % 3]
        put(spark, f"{base}/deep/r{r['r_regionkey']}.{kind}", f'{{"name": "{r["r_name"]}"}}' if kind == "json" else r["r_name"] * 3)
    return base


_KIND = "CASE r_regionkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'md' ELSE 'csv' END"
_SIZE = "CASE WHEN r_regionkey % 3 = 0 THEN length(r_name) + 12 ELSE 3 * length(r_name) END"


@query("src20_top18_report_files", f"SELECT r_regionkey AS place, {_KIND} AS kind, CAST({_SIZE} AS BIGINT) AS size FROM region ORDER BY place LIMIT 3 OFFSET 1")
def _src20(spark, sf_dir):
    """A page of the report files in order of their names."""
    found = files.list_reports(spark, _reports(spark, sf_dir)).withColumn("place", F.regexp_extract("path", r"r(\d+)\.", 1).cast("long"))
    return files.page(found.select("place", "kind", "size"), ["place"], 3, 1)[0]


@query("db09_report_snapshots", f"SELECT r_regionkey AS place, CAST({_SIZE} AS BIGINT) AS size, {_SIZE} > 20 AS truncated, CASE WHEN r_regionkey % 3 = 0 AND {_SIZE} <= 20 THEN r_name END AS name FROM region")
def _db09(spark, sf_dir):
    found = files.report_snapshots(spark, _reports(spark, sf_dir), most=20)
    name = F.try_variant_get("value", "$.name", "string")
    return found.select(F.regexp_extract("path", r"r(\d+)\.", 1).cast("long").alias("place"), "size", "truncated", name.alias("name"))


@query("snk01_sorted_fields", """SELECT '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' AS line FROM region""")
def _snk01(spark, sf_dir):
    path = new_path(spark, "lines")
    files.write_jsonl(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return spark.read.text(path).toDF("line")


@query("snk02_snk03_snk04_csv_lines", "SELECT 'r_name,r_regionkey' AS line UNION ALL SELECT r_name || ',' || r_regionkey FROM region")
def _snk02(spark, sf_dir):
    path = new_path(spark, "table")
    files.write_csv(table(spark, sf_dir, "region").coalesce(1), path, ["r_name", "r_regionkey"])
    return spark.read.text(path).toDF("line")


@query("snk09_run_log", """SELECT '{"event": "step", "name": "' || r_name || '", "run_id": "r' || r_regionkey || '"}' AS line FROM region""")
def _snk09(spark, sf_dir):
    path = new_path(spark, "log")
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # five rows, one append each
        files.append_run_log(spark, path, "step", {"run_id": f"r{r['r_regionkey']}", "name": r["r_name"]})
    return spark.read.text(path).toDF("line")


@query(
    "snk10_cache_update",
    "SELECT 'h' || vec_id AS chunk_hash, round(CAST(embedding[1] AS DOUBLE), 6) + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS first FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0",
)
def _snk10(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("m").alias("embedding_model"), F.concat(F.lit("h"), "vec_id").alias("chunk_hash"), F.array(F.round(F.col("embedding")[0].cast("double"), 6)).alias("vector"))
    new = v.where("vec_id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: x + 1))
    return index.updated_cache(v.where("vec_id % 2 = 0"), new).select("chunk_hash", F.col("vector")[0].alias("first"))


@query("emb05_embedding_shape", "SELECT 'm' AS embedding_model, 64 AS embedding_dimension UNION ALL SELECT 'local_hash_embedding_v1', 128")
def _emb05(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.lit("m").alias("embedding_model"), F.size("embedding").alias("embedding_dimension"))
    return index.embedding_shape(v).union(index.embedding_shape(v.where("embedding_dimension < 0")))


@query("db06_pattern_sync", "SELECT 'pattern_' || substr(sha1('d' || doc_id || ':e:event'), 1, 16) AS pattern_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _db06(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", T.digest_id("pattern_", F.concat_ws(":", F.concat(F.lit("d"), "doc_id"), F.lit("e"), F.lit("event"))).alias("pattern_id"))
    old, new = (p.where(f"doc_id % {k} = 0").select("pattern_id", F.lit(s).alias("state")) for k, s in ((2, "old"), (3, "new")))
    path = new_path(spark, "patterns")
    tables.write_table(old, path)
    tables.write_table(tables.upsert(spark.read.parquet(path), new, ["pattern_id"]), path)
    return spark.read.parquet(path)


@query("db10_db11_bootstrap", "SELECT r_regionkey, r_name || ';x' AS name, 2 AS statements, true AS healthy FROM region")
def _db10(spark, sf_dir):
    path = f"{sf_dir}/region.parquet"
    n = tables.bootstrap(spark, f"CREATE OR REPLACE TEMP VIEW boot_region AS SELECT r_regionkey, concat(r_name, ';x') AS name FROM parquet.`{path}`; CREATE OR REPLACE TEMP VIEW boot_one AS SELECT 1 AS one;")
    healthy = tables.healthcheck(spark, path) and not tables.healthcheck(spark, f"{path}-missing")
    return spark.table("boot_region").withColumns({"statements": F.lit(n), "healthy": F.lit(healthy)})


@query(
    "job01_job02_runs",
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'interrupted' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status,
       CASE WHEN event_id % 4 < 2 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE ts END AS finished_at, CASE WHEN event_id % 4 < 2 THEN 'interrupted before it ended' END AS error FROM events
""",
)
def _job01(spark, sf_dir):
    k = F.col("event_id") % 4
    status = F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "succeeded").otherwise("failed")
    runs = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.when(k > 1, F.col("ts")).alias("finished_at"), F.lit(None).cast("string").alias("error"))
    return jobs.reconcile_runs(runs, "2030-01-01 00:00:00").select("event_id", "status", "finished_at", "error")


@query("job01_queued_run", "SELECT 'run of ' || r_name AS run_id, 'ingest|prepare|retrieve' AS steps, 'queued' AS status, true AS created, count(*) AS n_nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _job01b(spark, sf_dir):
    """A run for each region, in one table of runs."""
    path, regions = new_path(spark, "runs"), table(spark, sf_dir, "region")
    for r in regions.select("r_name").collect():  # five rows
        runs = jobs.create_run(spark, path, ["retrieve", "ingest", "prepare"], f"run of {r['r_name']}")
    nations = regions.join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.concat(F.lit("run of "), "r_name").alias("run_id")).agg(F.count("*").alias("n_nations"))
    return runs.join(nations, "run_id").select("run_id", F.array_join("steps", "|").alias("steps"), "status", F.col("created_at").isNotNull().alias("created"), "n_nations")


@query(
    "job03_steps",
    "SELECT step, needs, count(*) AS n_orders FROM (VALUES (6, 'evaluate', 'verify,label'), (4, 'extract', 'retrieve'), (0, 'ingest', ''), (5, 'label', 'ingest'), (7, 'patterns', 'label,prepare'), (1, 'prepare', 'ingest'), "
    "(2, 'retrieve', 'prepare'), (3, 'verify', 'extract')) t(place, step, needs) JOIN orders ON o_orderkey % 8 = place GROUP BY ALL",
)
def _job03(spark, sf_dir):
    """The steps in a valid order, with what each needs; each order asks for one of them."""
    place = {"ingest": 0, "prepare": 1, "retrieve": 2, "verify": 3, "extract": 4, "label": 5, "evaluate": 6, "patterns": 7}
    order = jobs.plan(list(jobs.STEPS))
    assert all(order.index(need) < order.index(step) for step in order for need in jobs.STEPS[step])
    steps = spark.createDataFrame([(place[s], s, ",".join(jobs.STEPS[s])) for s in order], "place int, step string, needs string")
    asked = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).cast("int").alias("place"))
    return asked.join(steps, "place").groupBy("step", "needs").agg(F.count("*").alias("n_orders"))


@query("sup03_reset_snapshots", "SELECT count(*) AS n_before, count(*) AS n_deleted, CAST(0 AS BIGINT) AS n_after FROM region")
def _sup03(spark, sf_dir):
    base = new_path(spark, "html")
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():  # five rows
        put(spark, f"{base}/p{r['r_regionkey']}.html", "<p>x</p>")
    put(spark, f"{base}/kept.txt", "kept")
    before = files.read_html_dir(spark, base).count()
    deleted = files.reset_snapshots(spark, base, f"{base}/manifest.jsonl")
    after = files.read_html_dir(spark, base).count()
    return spark.createDataFrame([(before, deleted, after)], "n_before long, n_deleted long, n_after long")


@query("sup23_chunks_from_lines", "SELECT 'c' || doc_id AS chunk_id, 'd' || doc_id AS article_id, 'document' AS chunk_level, length(text) AS n FROM documents")
def _sup23(spark, sf_dir):
    path = new_path(spark, "chunks")
    files.write_jsonl(table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("article_id"), F.lit("document").alias("chunk_level"), "text"), path)
    return files.read_jsonl(spark, path, "chunk_id string, article_id string, chunk_level string, text string").select("chunk_id", "article_id", "chunk_level", F.char_length("text").cast("long").alias("n"))


# Pages made of documents: each text as one paragraph, with entities for the signs of markup.
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def built_pages(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    html = F.expr(
        f"""concat('<html><head><title>  Doc {{}} ', doc_id, '</title><meta name="author" content="', source, '"><meta property="article:published_time" content="2024-01-0', doc_id % 9 + 1, '"></head>',
        '<body><h1>Head</h1><script>no()</script><div class="x article-content"><p>', {_ESCAPED}, '</p><li>end &amp; item</li></div><article><p>short</p></article><a href="/d/', doc_id, '?b=1&amp;a=2#f">see <b>', lang, '</b></a></body></html>')"""
    )
    return d.select("doc_id", html.alias("html"), F.concat(F.lit("http://Host.example.com/p/"), "doc_id").alias("url"))


_BUILT = "SELECT doc_id, 'Doc {{}} ' || doc_id AS title, '2024-01-0' || (doc_id % 9 + 1) AS published_at, source AS author, md5({body}) AS body"
_BODY = f"trim({norm()} || chr(10) || 'end & item', ' ' || chr(10))"


@query("htm01_htm04_built_pages", _BUILT.format(body=f"{_BODY} || chr(10) || 'short'").replace("{{}}", "{}") + " FROM documents")
def _htm01(spark, sf_dir):
    p = built_pages(spark, sf_dir).withColumn("a", H.parse_article("html"))
    return p.select("doc_id", "a.title", "a.published_at", "a.author", F.md5("a.body_text").alias("body"))


@query("htm03_built_trees", "SELECT doc_id, 'Doc {} ' || doc_id AS title, '2024-01-0' || (doc_id % 9 + 1) AS published_at, source AS author, length(trim(text)) > 0 AS filled, true AS ends FROM documents")
def _htm03(spark, sf_dir):
    p = built_pages(spark, sf_dir).withColumn("a", H.parse_article_tree("html"))
    return p.select("doc_id", "a.title", "a.published_at", "a.author", (F.char_length("a.body_text") > 10).alias("filled"), F.col("a.body_text").endswith("end & item").alias("ends"))


@query("htm06_built_links", "SELECT doc_id, 'http://host.example.com/d/' || doc_id || '?a=2&b=1' AS url, 'see ' || lang AS link_text FROM documents")
def _htm06(spark, sf_dir):
    links = built_pages(spark, sf_dir).select("doc_id", F.explode(H.links("html", "url")).alias("l"))
    return links.select("doc_id", T.canonical_url(F.col("l.href")).alias("url"), "l.link_text")


@query(
    "src08_ext01_ingested",
    f"""
WITH p AS (SELECT doc_id, {_BODY} || chr(10) || 'short' AS body FROM documents), k AS (SELECT *, 'sha256:' || sha256(lower(body)) AS h FROM p WHERE length(body) >= 300)
SELECT h AS content_hash, count(*) - 1 AS n_duplicates FROM k GROUP BY h
""",
)
def _src08(spark, sf_dir):
    """Built pages through parsing, the length filter and content deduplication (texts without the rewrites of numbers and units)."""
    raw = ingest.parse_pages(built_pages(spark, sf_dir).select(F.concat(F.lit("/w/src_"), "doc_id", F.lit(".html")).alias("path"), "html"))
    rows = ingest.with_status(raw).where("parse_status = 'success'").withColumn("content_hash", T.text_hash(F.col("text")))
    return ingest.first_per_hash(rows, "path").select("content_hash", "n_duplicates")


@query(
    "sup02_discovered",
    "SELECT 'http://e' || page_id || '.com/news/' || page_id || '.html' AS url, 'Tin ABC ' || page_id AS link_text, 7 AS score, 1::BIGINT AS candidate_count FROM pages",
)
def _sup02(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://e"), "page_id", F.lit(".com/")).alias("seed_url"))
    html = F.expr("concat('<a href=\"/news/', page_id, '.html\">Tin ABC ', page_id, '</a><a href=\"http://other.org/news/1.html\">Tin</a><a href=\"/a.css\"></a>')")
    seeds = p.select(F.lit("s").alias("source"), "seed_url", F.lit("2024-01-01").alias("discovered_at"), html.alias("html"))
    found, counts = ingest.discover(seeds, ["tin"], most=None)
    return found.join(counts.select("seed_url", "candidate_count"), "seed_url").select("url", "link_text", F.col("score").cast("int").alias("score"), "candidate_count")


@query(
    "sup09_unsupported_fields",
    "SELECT 'c' AS config_name, 'd' || event_id AS article_id, 'e1' AS event_id, 'event_arguments.' || event_type AS field FROM events WHERE event_id % 3 = 0",
)
def _sup09(spark, sf_dir):
    item = F.struct(F.lit("e1").alias("event_id"), F.concat(F.lit("event_arguments."), "event_type").alias("field"))
    report = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"unsupported_fields": ["text", '), F.to_json(item), F.lit("]}"))).when(F.col("event_id") % 3 == 1, '{"unsupported_fields": "none"}').otherwise("{}")
    rows = table(spark, sf_dir, "events").select(F.lit("c").alias("config_name"), F.concat(F.lit("d"), "event_id").alias("article_id"), F.parse_json(report).alias("report"))
    return verification.unsupported_fields(rows)


@query(
    "lab02_udf02_model_rows",
    "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE lower(substr(text, 1, 20)) END AS raw_output, CASE WHEN item_id % 3 = 0 THEN 'refused' END AS error, CASE WHEN item_id % 3 = 0 THEN 3 ELSE 1 END::INTEGER AS attempts FROM benchmark",
)
def _lab02(spark, sf_dir):
    def model(prompt: str) -> str:
        key, _, text = prompt.partition("\t")
        if int(key) % 3 == 0:
            raise RuntimeError("refused")
        return text[:20].lower()

    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("article_id"), F.concat("item_id", F.lit("\t"), "text").alias("prompt"))
    return verification.invoke(prompts, model).select(F.col("article_id").alias("item_id"), "raw_output", "error", "attempts")
