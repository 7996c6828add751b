"""Queries of ingestion, dictionaries, chunking, pages and indexes, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.functions import html as H
from glosswork.functions import text as T
from glosswork.operators import chunking, dictionaries, index, ingest
from glosswork.plans import fixtures
from glosswork.plans.text_queries import canonical_sql, kept_tokens_sql, norm, tokens_sql
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


_HIT = (
    f"{fixtures.COMPANY_SQL}, n AS (SELECT doc_id, {norm()} AS t FROM documents), hits AS (SELECT doc_id, ticker, company_name, sector FROM n, companies c "
    "WHERE regexp_matches(t, '(^|[^A-Z0-9])' || ticker || '([^A-Z0-9]|$)') OR len(list_filter(list_concat([company_name], aliases), "
    "lambda a: contains(lower(t), lower(a)) OR contains(lower(strip_accents(t)), lower(strip_accents(a))))) > 0)"
)
_LIST = "coalesce(array_to_string(list_sort(list({d} {c}) FILTER (WHERE {c} <> '')), '|'), '')"


def _joined(*names: str):
    return [F.array_join(n, "|").alias(n) for n in names]


@query(
    "jn01_company_hints",
    f"WITH {_HIT} SELECT n.doc_id, {_LIST.format(d='DISTINCT', c='ticker')} AS tickers_hint, {_LIST.format(d='DISTINCT', c='company_name')} AS company_names_hint, "
    f"{_LIST.format(d='DISTINCT', c='sector')} AS sector_hints FROM n LEFT JOIN hits ON hits.doc_id = n.doc_id GROUP BY n.doc_id",
)
def _jn01(spark, sf_dir):
    rows = dictionaries.company_hints(fixtures.articles(spark, sf_dir), fixtures.companies(spark))
    return rows.select("doc_id", *_joined("tickers_hint", "company_names_hint", "sector_hints"))


_KEY = (
    f"{fixtures.KEYWORD_SQL}, n AS (SELECT doc_id, {norm()} AS t FROM documents), hits AS (SELECT doc_id, k.* FROM n, keywords k "
    "WHERE contains(lower(strip_accents(t)), lower(strip_accents(keyword))))"
)


@query(
    "jn02_keyword_matches",
    f"WITH {_KEY} SELECT doc_id, event_type, event_subtype, keyword, polarity_hint, priority, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, event_type, keyword) - 1 AS pos FROM hits",
)
def _jn02(spark, sf_dir):
    rows = dictionaries.keyword_hints(fixtures.articles(spark, sf_dir), fixtures.keywords(spark))
    return rows.select("doc_id", F.posexplode_outer("event_keyword_matches").alias("pos", "m")).where("m IS NOT NULL").select("doc_id", "m.*", F.col("pos").cast("long").alias("pos"))


@query(
    "jn03_sup01_keyword_hints",
    f"WITH {_KEY} SELECT n.doc_id, {_LIST.format(d='DISTINCT', c='keyword')} AS event_keywords, {_LIST.format(d='DISTINCT', c='event_type')} AS event_type_hints, "
    f"{_LIST.format(d='DISTINCT', c='event_subtype')} AS event_subtype_hints FROM n LEFT JOIN hits ON hits.doc_id = n.doc_id GROUP BY n.doc_id",
)
def _jn03(spark, sf_dir):
    rows = dictionaries.keyword_hints(fixtures.articles(spark, sf_dir), fixtures.keywords(spark))
    return rows.select("doc_id", *_joined("event_keywords", "event_type_hints", "event_subtype_hints"))


@query(
    "jn04_sector_hints",
    f"WITH {_HIT} SELECT doc_id, array_to_string(list_sort(list(DISTINCT sector)), '|') AS sector_hints FROM hits WHERE sector <> '' GROUP BY doc_id",
)
def _jn04(spark, sf_dir):
    found = dictionaries.company_hints(fixtures.articles(spark, sf_dir), fixtures.companies(spark)).select("doc_id", "tickers_hint")
    return dictionaries.sector_hints(found, fixtures.companies(spark), "doc_id").select("doc_id", *_joined("sector_hints"))


@query(
    "agg02_dictionary_audit",
    f"""
WITH {fixtures.GIVEN_SQL}
SELECT 'duplicate_ticker' AS kind, 'S' || (s_suppkey % 7) AS name, count(*) AS n FROM c GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_keyword', p_type || '/' || p_brand || '/' || p_name, count(*) FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'sector', coalesce(sector, 'UNKNOWN'), count(*) FROM c GROUP BY 2
UNION ALL SELECT 'event_type', p_type, count(*) FROM part GROUP BY 2
""",
)
def _agg02(spark, sf_dir):
    return dictionaries.audit(fixtures.given_companies(spark, sf_dir, 7), fixtures.given_keywords(spark, sf_dir))


@query("flt01_min_length", "SELECT doc_id, CASE WHEN length(text) < 300 THEN 'too_short' ELSE 'success' END AS parse_status FROM documents")
def _flt01(spark, sf_dir):
    return ingest.with_status(fixtures.articles(spark, sf_dir)).select("doc_id", "parse_status")


_HASH = f"'sha256:' || sha256(lower({norm()}))"


@query(
    "top05_content_dedupe",
    f"SELECT min(doc_id) AS doc_id, h AS content_hash, count(*) - 1 AS n_duplicates FROM (SELECT doc_id, {_HASH} AS h FROM documents) GROUP BY h",
)
def _top05(spark, sf_dir):
    # every other text as another source may have it: a letter decomposed, an entity
    raw = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit("ñ"), F.lit("&ntilde;"))
    rows = fixtures.articles(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, raw).otherwise(F.col("text")).alias("text"))
    return ingest.first_per_hash(rows.select("doc_id", T.text_hash(F.col("text")).alias("content_hash")), "doc_id")


@query(
    "agg01_quality_summary",
    f"""
WITH r AS (SELECT doc_id, text, source, CASE WHEN length(text) < 300 THEN 'too_short' ELSE 'success' END AS s FROM documents),
c AS (SELECT any_value(text ORDER BY doc_id) AS t FROM (SELECT doc_id, text, {_HASH} AS h FROM r WHERE s = 'success') GROUP BY h)
SELECT (SELECT count(*) FROM r) AS n_raw, (SELECT round(avg(CASE WHEN s = 'success' THEN 1.0 ELSE 0.0 END), 6) FROM r) AS parse_success_rate,
       count(*) AS n_clean, round(avg((len(regexp_extract_all(t, '\\p{{L}}')) - len(regexp_extract_all(t, '[A-Za-z]'))) / len(regexp_extract_all(t, '\\p{{L}}'))), 6) AS mean_marked_ratio
FROM c
""",
)
def _agg01(spark, sf_dir):
    raw = ingest.with_status(fixtures.articles(spark, sf_dir))
    rows = raw.where("parse_status = 'success'").withColumn("content_hash", T.text_hash(F.col("text")))
    s = ingest.quality_summary(raw, ingest.first_per_hash(rows, "doc_id"))
    return s.select("n_raw", F.round("parse_success_rate", 6).alias("parse_success_rate"), "n_clean", F.round("mean_marked_ratio", 6).alias("mean_marked_ratio"))


@query("agg01_source_distribution", "SELECT 'source' AS kind, source AS name, count(*) AS n FROM documents GROUP BY source")
def _agg01b(spark, sf_dir):
    return ingest.quality_counts(fixtures.articles(spark, sf_dir))


@query("flt02_indexable", "SELECT doc_id FROM documents WHERE lang = 'en' AND trim(text) <> ''")
def _flt02(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("article_id"), "text", F.when(F.col("lang") == "en", "VI").otherwise(F.col("lang")).alias("language"))
    return chunking.indexable(rows).select("doc_id")


@query("flt03_source_filter", "SELECT doc_id, source FROM documents WHERE lower(source) IN ('src1', 'src2')")
def _flt03(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("source").isin("src1", "src2")).select("doc_id", "source")


_COUNT = r"len(regexp_extract_all({t}, '[\p{{L}}\p{{M}}\p{{N}}_]+'))"


@query(
    "chk06_document_chunks",
    rf"""
WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array({norm()}, '\n+'), lambda x: x <> '') AS ps FROM documents),
t AS (SELECT doc_id, ps, array_to_string(ps, chr(10)) AS whole FROM p WHERE len(ps) > 0),
c AS (SELECT doc_id, ps, CASE WHEN len(regexp_extract_all(whole, '\S+')) <= 620 THEN whole ELSE array_to_string(regexp_extract_all(whole, '\S+')[1:620], ' ') END AS x FROM t)
SELECT 'd' || doc_id || '_document_0000' AS chunk_id, md5(x) AS digest, 'sha256:' || sha256(lower(x)) AS chunk_hash, CAST({_COUNT.format(t='x')} AS INTEGER) AS text_word_count, CAST(len(ps) - 1 AS INTEGER) AS paragraph_end FROM c
""",
)
def _chk06(spark, sf_dir):
    return chunking.document_chunks(fixtures.articles(spark, sf_dir)).select("chunk_id", F.md5("text").alias("digest"), "chunk_hash", "text_word_count", "paragraph_end")


@query(
    "chk07_paragraph_chunks",
    rf"""
WITH p AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array({norm()}, '\n+'), lambda x: x <> '')) AS x, generate_subscripts(list_filter(regexp_split_to_array({norm()}, '\n+'), lambda x: x <> ''), 1) - 1 AS i FROM documents)
SELECT 'd' || doc_id || '_paragraph_' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS chunk_id, 'd' || doc_id || '_document_0000' AS parent_chunk_id, 'sha256:' || sha256(lower(x)) AS chunk_hash,
       CAST({_COUNT.format(t='x')} AS INTEGER) AS text_word_count, CAST(i AS INTEGER) AS paragraph_start FROM p
""",
)
def _chk07(spark, sf_dir):
    """Paragraphs of any length as one chunk each (the slicing of long ones is in chk05)."""
    rows = chunking.paragraph_chunks(fixtures.articles(spark, sf_dir), most=1 << 30)
    return rows.select("chunk_id", "parent_chunk_id", "chunk_hash", "text_word_count", "paragraph_start")


@query("chk05_sliced_paragraphs")
def _chk05(spark, sf_dir):
    return chunking.paragraph_chunks(fixtures.articles(spark, sf_dir), most=60, overlap=12).select("chunk_id", "chunk_hash", "text_word_count", "paragraph_start")


@query("chk03_section_chunks")
def _chk03(spark, sf_dir):
    return chunking.section_chunks(fixtures.articles(spark, sf_dir)).select("chunk_id", "chunk_hash", "text_word_count", "paragraph_start", "paragraph_end")


@query("chk01_build_chunks")
def _chk01(spark, sf_dir):
    return chunking.build_chunks(fixtures.articles(spark, sf_dir)).select("chunk_id", "article_id", "chunk_level", "chunk_index", "chunk_hash", "parent_chunk_id")


@query("agg04_chunk_summary")
def _agg04(spark, sf_dir):
    return chunking.chunk_summary(chunking.build_chunks(fixtures.articles(spark, sf_dir)))


@query(
    "agg05_corpus_statistics",
    f"WITH t AS (SELECT doc_id, {kept_tokens_sql()} AS w FROM documents) SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM t) GROUP BY term",
)
def _agg05(spark, sf_dir):
    return index.document_frequencies(table(spark, sf_dir, "documents"), T.tokens(F.col("text"), domain=False))


@query(
    "snk06_postings",
    f"WITH t AS (SELECT doc_id, {kept_tokens_sql()} AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) GROUP BY doc_id, w, term",
)
def _snk06(spark, sf_dir):
    return index.postings(table(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text"), domain=False))


@query(
    "emb01_hash_embedding",
    f"""
WITH t AS (SELECT doc_id, unnest({tokens_sql()}) AS w FROM documents),
s AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 32 AS b, sum(CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY doc_id)
SELECT doc_id, CAST(b AS INTEGER) AS bucket, round(v / norm, 8) AS value FROM s JOIN n USING (doc_id) WHERE v <> 0
""",
)
def _emb01(spark, sf_dir):
    v = index.hash_embeddings(table(spark, sf_dir, "documents"), "doc_id", T.tokens(F.col("text"), False, False), 32)
    return v.select("doc_id", F.posexplode_outer("vector").alias("bucket", "v")).where("v <> 0").select("doc_id", "bucket", F.col("v").alias("value"))


@query(
    "emb02_cached_embeddings",
    f"""
WITH d AS (SELECT doc_id, 'sha256:' || sha256(lower({norm()})) AS h FROM documents), c AS (SELECT DISTINCT h FROM d WHERE doc_id % 2 = 0)
SELECT 'c' || doc_id AS chunk_id, d.h AS chunk_hash, c.h IS NOT NULL AS cache_hit, 'emb_' || substr(sha1('local_hash_embedding_v1:c' || doc_id), 1, 16) AS embedding_id, 16 AS embedding_dimension
FROM d LEFT JOIN c ON d.h = c.h
""",
)
def _emb02(spark, sf_dir):
    """Embeddings of all documents, where the vectors of even doc_ids are in the cache."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("article_id"), F.col("text").alias("embedding_text"))

    def embed(frame, key="chunk_id"):
        return index.hash_embeddings(frame, key, T.tokens(F.col("embedding_text"), False, False), 16)

    even = d.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("embedding_text"))
    cache = even.join(embed(even, "doc_id"), "doc_id").select(F.lit(index.HASH_MODEL).alias("embedding_model"), T.text_hash(F.col("embedding_text")).alias("chunk_hash"), "vector")
    out = index.embed_with_cache(chunks, cache, embed)
    return out.select("chunk_id", "chunk_hash", "cache_hit", "embedding_id", "embedding_dimension")


@query(
    "snk07_vector_manifest",
    "SELECT count(*) AS n_chunks, count(*) FILTER (WHERE doc_id % 3 <> 0) AS n_embeddings, count(*) AS n_document FROM documents",
)
def _snk07(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.lit("document").alias("chunk_level"))
    made = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), F.lit("m").alias("embedding_model"), F.lit(8).alias("embedding_dimension"))
    return index.vector_manifest(chunks, made).select("n_chunks", "n_embeddings", "n_document")


@query("db05_vector_literal", "SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:2], lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',') || ']' AS literal FROM embeddings")
def _db05(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 2), lambda x: F.round(x * F.lit(1000.0).cast("float")).cast("long"))  # in the precision of the vectors, as in SQL
    return table(spark, sf_dir, "embeddings").select("vec_id", index.vector_literal(v).alias("literal"))


@query("htm01_parse_pages")
def _htm01(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("a", H.parse_article("html"))
    return p.select("page_id", "a.title", "a.published_at", "a.author", "a.body_text", F.array_join("a.warnings", "|").alias("warnings"))


@query("htm02_page_titles", "SELECT page_id, trim(regexp_extract(html, '<title>([^&<]*)', 1)) AS title FROM pages")
def _htm02(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^&<]*)", 1)).alias("title"))


@query("htm06_links")
def _htm06(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(H.links("html", "url")).alias("l"))
    return links.select("page_id", T.canonical_url(F.col("l.href")).alias("url"), "l.link_text").distinct()


_PATH = "lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1))"


@query(
    "htm07_article_urls",
    rf"""SELECT page_id, NOT ({_PATH} IN ('', '/') OR regexp_matches({_PATH}, '/tag/|/topic/|/video/|/photo/|/rss|/search') OR regexp_matches({_PATH}, '\.(jpg|jpeg|png|gif|webp|pdf|css|js)$')
    OR (regexp_matches({_PATH}, '\.html?$') AND NOT contains(trim({_PATH}, '/'), '/') AND NOT regexp_matches({_PATH}, '\d{{4,}}')))
    AND regexp_matches({_PATH}, '(\d{{4,}}|\.htm|\.html|/news/|/tin-|/bai-|/doanh-nghiep/)') AS is_article FROM pages""",
)
def _htm07(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.is_article_url(F.col("url")).alias("is_article"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query("htm08_sites", f"SELECT page_id, {_HOST} AS site, {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') AS same FROM pages")
def _htm08(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.site(F.col("url")).alias("site"), H.same_site(F.col("url"), F.lit("https://www.example.com/x")).alias("same"))


@query(
    "htm09_candidate_scores",
    f"SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 2 ELSE 0 END + CASE WHEN contains(lower(url), 'ref=') THEN 2 ELSE 0 END + 2 + CASE WHEN {SQL['htm07_article_urls'].split('SELECT page_id, ')[1].split(' AS is_article')[0]} THEN 3 ELSE 0 END AS score FROM pages",
)
def _htm09(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.candidate_score(F.lit("see ABC now"), F.col("url"), ["/en/", "ref="]).alias("score"))


@query("htm05_path_source", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'src' || (page_id % 5) ELSE 'local' END AS source FROM pages")
def _htm05(spark, sf_dir):
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/a_b/src"), F.col("page_id") % 5, F.lit("_page.html"))).otherwise("/a_b/page.html")
    return table(spark, sf_dir, "pages").select("page_id", H.source_of_path(path).alias("source"))


@query(
    "top04_candidates",
    f"""
WITH c AS (SELECT {canonical_sql()} AS url, page_id % 7 AS score, printf('2024-01-%02d', 1 + page_id % 28) AS discovered_at, page_id FROM pages),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, discovered_at DESC) AS k FROM c)
SELECT url, CAST(score AS INTEGER) AS score, discovered_at FROM b WHERE k = 1
""",
)
def _top04(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select(
        T.canonical_url(F.col("url")).alias("url"), (F.col("page_id") % 7).cast("int").alias("score"), F.format_string("2024-01-%02d", 1 + F.col("page_id") % 28).alias("discovered_at")
    )
    return ingest.rank_candidates(c)


@query("src08_ingest_pages")
def _src08(spark, sf_dir):
    """Pages through parsing, filtering, deduplication and hints."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/web/src"), F.col("page_id") % 3, F.lit("_"), "page_id", F.lit(".html")).alias("path"), "html")
    rows = ingest.clean_articles(ingest.parse_pages(pages), fixtures.companies(spark), fixtures.keywords(spark))
    return rows.select("article_id", "source", "url", "title", "content_hash", "text_char_count", *_joined("tickers_hint", "event_type_hints"))
