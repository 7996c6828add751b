"""Operators that SQL cannot express, against independent models in plain Python."""

import html
import json
import math
import random
import re
import time
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.functions import html as H
from glosswork.functions import json as J
from glosswork.functions import similarity as S
from glosswork.functions import text as T
from glosswork.operators import chunking, dictionaries, evaluation, index, querying, ranking_metrics, rerank, retrieval, tables, validation, verification
from glosswork.sources import files
from glosswork.streaming import log_tail


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


# text


def normal(text):
    x = unicodedata.normalize("NFC", text).replace("\xa0", " ")
    x = re.sub(r"[ \t\r\f\v]+", " ", x)
    x = re.sub(r"\n\s*\n+", "\n\n", x)
    return "\n".join(line.strip() for line in x.splitlines()).strip()


CASES = ["", "  a \t b\r\n c  ", "x\n\n \n\ny", "Đại hội\xa0cổ đông ", "é combining", "a b", "tab\tand\x0bvt", "\n\nlead", "trail \n"]


RAW = [
    "M&amp;A &copy; 2 &lt;b&gt; &#8220;x&#8221; &nbsp;&notit; &amp;amp;", "Vi\u0065\u0302\u0323t", "Vie\u0323\u0302t Nam", "\u1112\u1161\u11ab", "\u212b \u0958 \ufb1d", "a\u0327\u0301 \u09c7\u09be",
    "&& & a&b", "ﬁne ½ ㎏ ﷺ", "", None,
]


def test_normalize_text(spark):
    assert column(spark, CASES + RAW, T.normalize_text) == [normal(html.unescape(c or "")) for c in CASES + RAW]
    assert column(spark, CASES, T.settle) == [normal(c) for c in CASES]
    assert column(spark, ["x &amp;amp;lt; y"], lambda c: T.normalize_text(c, 3)) == ["x < y"]
    hashes = column(spark, ["Việt", unicodedata.normalize("NFD", "Việt"), "VI&#7878;T"], T.text_hash)
    assert len(set(hashes)) == 1


def test_resolving_lane_misses_nothing(spark):
    """Every sign alone and after a letter: what the native lane lets through, resolving would not change."""
    signs = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}|a{c}|\u1100{c}|\u09c7{c}" for c in signs]
    lane = column(spark, texts, lambda c: c.rlike(T.unsettled()))
    assert [t for t, touched in zip(texts, lane) if not touched and unicodedata.normalize("NFC", t) != t] == []
    assert sum(lane) < 6_000


def test_settle_tests_every_blank(spark):
    """Texts that look settled are left alone, so each sign that settling changes has to be seen."""
    signs = " \t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2007\u200a\u2028\u2029\u202f\u205f\u3000\n"
    texts = [f"{a}{x}{b}" for x in [*signs, "  ", "\n\n", "\n\n\n", " \n", "\n ", "\n \n"] for a, b in (("a", "b"), ("", "b"), ("a", ""), ("é", "\n"))]
    assert column(spark, texts, T.settle) == column(spark, texts, lambda c: T._settled(c))


def fold(t):
    t = t.replace("đ", "d").replace("Đ", "D")
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_ascii_fold(spark):
    words = ["Đặng Thị Hồng", "crème brûlée", "straße", "ÅNGSTRÖM", "ｆｕｌｌ", "日本", "ﬁne ½ of ﬃ㎏", "한국어 ﷺ Ǆ", "𝐁𝟚 x", "", None, "½.", "(½", "ﬁ\\ﬁ", "½\x01½[", "*ﬁ+"]
    assert column(spark, words, T.ascii_fold) == [None if w is None else fold(w) for w in words]


def test_folding_many_letters_is_quick(spark):
    """Letters that become several are looked up once per text, not once per place."""
    texts = ["ﬁ½한 x" * 5000 + str(i) for i in range(8)]
    column(spark, ["ﬁ"], T.ascii_fold)
    began = time.perf_counter()
    got = column(spark, texts, T.ascii_fold)
    assert time.perf_counter() - began < 3
    assert got == [fold(t) for t in texts]


def test_every_letter_folds(spark):
    signs = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(signs[i : i + 7]) for i in range(0, len(signs), 7)] + [f"x{c}y" for c in signs[:0x3000]]
    assert column(spark, texts, T.ascii_fold) == [fold(t) for t in texts]


def test_canonical_url_of_malformed_escapes(spark):
    urls = ["HTTP://Ex.org/a/?b=%zz&a=1%", "http://x/?q=a%20b%2&utm_x=1", "http://x/?q=*~+", "http://x?k=%C3%A9&k", None]
    want = ["http://ex.org/a?a=1%25&b=%25zz", "http://x/?q=a+b%252".replace("x/?", "x?"), "http://x?q=%2A~+", "http://x?k=&k=%C3%A9", ""]
    assert column(spark, urls, T.canonical_url) == want


def test_domain_rewrites(spark):
    text = ["HĐQT của CTCP ABC", "lãi 1.200,5 tỷ và 3,5% ; 1.234.567 cp", "500 vnd, 20 tr. đ", "x1.200 12.34"]
    assert column(spark, text, T.preprocess) == [
        "hội đồng quản trị của công ty cổ phần ABC",
        "lãi 1200.5 tỷ và 3.5% ; 1234567 cổ phiếu",
        "500 đồng, 20 triệu đồng",
        "x1.200 12.34",
    ]


def test_tokens(spark):
    got = column(spark, ["Công ty A.B đã ký hợp đồng 1.5 va the"], T.tokens)
    assert got == [["cong", "ty", "a.b", "ky", "hop", "dong", "1.5", "the"]]


def test_canonical_url(spark):
    urls = ["HTTPS://Www.Ex.com/A/b/?utm_source=x&b=2&a=1&fbclid=z#frag", "http://e.com", "http://e.com/?x=&y=a%20b", "/rel/path/"]
    assert column(spark, urls, T.canonical_url) == ["https://www.ex.com/A/b?a=1&b=2", "http://e.com", "http://e.com?x=&y=a+b", "/rel/path"]


def test_truncate_and_first(spark):
    assert column(spark, ["abcdef", "ab"], lambda c: T.truncate_chars(c, 4)) == ["abcd...", "ab"]
    assert column(spark, ["abcdef"], lambda c: T.truncate_chars(c, 5, "within")) == ["ab..."]
    assert column(spark, ["  ", " x "], lambda c: T.first_text(c, F.lit("y"))) == ["y", "x"]


# similarity


def test_sequence_ratio_and_windows(spark):
    pairs = [("hop dong moi", "ky hop dong moi voi doi tac"), ("abc", ""), ("x" * 250, "x" * 300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(S.sequence_ratio("a", "b")).collect()] == [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    got = column(spark, ["a b c d"], lambda c: S.windows(c, F.lit(4)))[0]
    assert got == ["a b c d", "a b", "b c", "c d", "a b c", "b c d", "a b c d"]


def best(query, text):
    fold = lambda s: " ".join("".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("đ", "d")) if not unicodedata.combining(c)).split())
    found = (0.0, None)
    n = len(query.split())
    for sentence in filter(None, (p.strip() for p in re.split(r"[\n\r]+|(?<=[.!?;:])\s+", text))):
        words = sentence.split()
        options = [sentence]
        if len(words) > 2:
            options += [" ".join(words[i : i + k]) for k in range(max(2, n - 3), min(len(words), n + 5) + 1) for i in range(len(words) - k + 1)]
        for o in options:
            r = SequenceMatcher(None, query, fold(o)).ratio()
            if r > found[0]:
                found = (r, o)
    return found


@given(st.lists(st.sampled_from("ky hop dong mới voi Đối tác lon trong nam nay.".split()), min_size=1, max_size=14), st.lists(st.sampled_from("ky hop dong moi doi tac nam".split()), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_best_window(text, query):
    text, query = " ".join(text), " ".join(query)
    assert S._best_window(query, text) == best(query, text)


def test_find_text_match(spark):
    df = spark.createDataFrame([("Ký hợp đồng", "Công ty ky hop dong lon"), ("ký hợp đòng lớn nhất", "cong ty ky hop dong lon nhat nam"), ("không liên quan gì", "abc def"), ("", "abc")], "q string, t string")
    got = [r[0] for r in df.select(S.find_text_match(F.col("q"), F.col("t"), 0.82)).collect()]
    assert [g["support"] for g in got] == ["SUPPORTED", "SUPPORTED", "UNSUPPORTED", "UNSUPPORTED"] and got[0]["match_type"] == "exact"


# pages


def parsed(spark, pages, parse):
    return [r["a"].asDict() for r in spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", parse("html").alias("a")).orderBy("i").collect()]


def test_article_parser(spark):
    pages = [
        '<html><head><title> T &amp; x</title><meta property="article:published_time" content="2024"></head><body><p>one <b>two</b> three</p><li>item</li><p></p></body>',
        "", '<meta name="og:title" content="M"><title>t</title>', None, '<time datetime="2020-01-01">first</time><time>second</time><h1> </h1><h1>head  line</h1><p>a<br>b</p>',
    ]
    page, empty, meta, null, times = parsed(spark, pages, H.parse_article)
    assert page["title"] == "T & x" and page["published_at"] == "2024" and page["warnings"] == []
    assert page["body_text"].split("\n")[-1] == "item"
    assert empty["warnings"] == null["warnings"] == ["missing_title", "missing_published_at", "empty_body"]
    assert meta["title"] == "M"
    assert times["published_at"] == "2020-01-01" and times["title"] == "head line" and times["body_text"] == "a" and times["warnings"] == []


def test_links_end_at_the_closing_tag_or_the_next_link(spark):
    html = '<a href="/x">one <b>two</b></a> between <a href="y">lost <a href="http://e.com/z">kept</a> <a name="n">no link</a>'
    rows = spark.createDataFrame([(html, "http://e.com/d/")], "html string, base string").select(H.links("html", "base").alias("l")).first()["l"]
    assert [tuple(r) for r in rows] == [("http://e.com/x", "one two"), ("http://e.com/d/y", ""), ("http://e.com/z", "kept")]


def test_article_urls(spark):
    urls = {"http://e.com/": False, "http://e.com/tag/x12345": False, "http://e.com/a.jpg": False, "http://e.com/page.html": False, "http://e.com/page-20240101.html": True, "http://e.com/a/page.htm": True, "http://e.com/news/x": True, "http://e.com/about": False}
    assert column(spark, list(urls), H.is_article_url) == list(urls.values())


# chunking


def packed(sizes, target, most, overlap):
    groups, current, words = [], [], 0

    def tail(group):
        out, n = [], 0
        for i in reversed(group):
            if overlap <= 0 or n >= overlap:
                break
            out.insert(0, i)
            n += sizes[i]
        return out

    for i, n in enumerate(sizes):
        if current and words + n > most:
            groups.append(current)
            current = tail(current)
            words = sum(sizes[j] for j in current)
        current = [*current, i]
        words += n
        if words >= target:
            groups.append(current)
            current = tail(current)
            words = sum(sizes[j] for j in current)
    if current and (not groups or groups[-1] != current):
        groups.append(current)
    return [(g[0], g[-1]) for g in groups]


@given(st.lists(st.integers(1, 60), max_size=30), st.integers(20, 90), st.integers(40, 120), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_packing(sizes, target, most, overlap):
    assert chunking.pack(sizes, target, most, overlap) == packed(sizes, target, most, overlap)


def test_chunk_levels(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) + "." for i in range(6)) + "\n" + ". ".join(" ".join(f"s{i}y{j}" for j in range(20)) for i in range(8))
    df = spark.createDataFrame([("a1", text, "Title"), ("a2", " ", None), ("", "x", None)], "article_id string, text string, title string")
    rows = chunking.build_chunks(df, 60, 80, 10).collect()
    ids = [r["chunk_id"] for r in rows]
    assert len(set(ids)) == len(ids) and {r["article_id"] for r in rows} == {"a1"}
    paragraphs = sorted((r for r in rows if r["chunk_level"] == "paragraph"), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in paragraphs] == list(range(len(paragraphs))) and len(paragraphs) > 7
    assert all(r["text_word_count"] <= 80 for r in paragraphs) and all(r["parent_chunk_id"] == "a1_document_0000" for r in paragraphs)


# retrieval


def test_hash_embedding_forms_agree(spark):
    df = spark.createDataFrame([(1, "hop dong moi ky hop dong"), (2, ""), (3, "a")], "k int, text string")
    tokens = T.tokens(F.col("text"), False, False)
    a = {r["k"]: r["vector"] for r in index.hash_embeddings(df, "k", tokens, 16).collect()}
    b = {r["k"]: r["v"] for r in df.select("k", index.hash_embedding(tokens, 16).alias("v")).collect()}
    assert a == b and not any(a[2])


def test_dense_top_k_ties_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<double>")
    got = index.dense_top_k(df, "id", "v", q, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 3] and got[0]["cosine"] == 1.0


def test_candidate_dedupe_is_sequential(spark):
    rows = [("c", 1, "a", "h1", 0.9), ("c", 2, "a", "h2", 0.8), ("c", 3, "a", "h3", 0.7), ("c", 4, "b", "h3", 0.6), ("c", 5, "b", "h1", 0.5)]
    df = spark.createDataFrame(rows, "case_id string, chunk_id long, article_id string, chunk_hash string, score double")
    got = {r["chunk_id"]: r["rank"] for r in retrieval.dedupe_candidates(df, 2).collect()}
    assert got == {1: 1, 2: 2, 4: 3}  # h3 counts as taken only once it is accepted


def test_first_candidates_are_those_of_all_pairs(spark):
    r = __import__("random").Random(4)
    pick = lambda xs: [x for x in xs if r.random() < 0.3]
    words = [f"w{i}" for i in range(30)]
    rows = [
        (i, f"a{i % 40}", r.choice(["paragraph", "document"]), " ".join(r.choices(words, k=r.choice([5, 9, 12]))), r.choice(["hnx", "x"]), f"h{r.randrange(60)}", pick("AB"), pick(["ca", "cb"]), pick(["k1", "k2"]), pick(["Y", "Z"]))
        for i in range(200)
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, article_id string, chunk_level string, text string, source string, chunk_hash string, tickers_hint array<string>, company_names_hint array<string>, event_keywords array<string>, event_type_hints array<string>")
    cases = [
        (f"q{i}", f"c{i // 2}", i % 2, r.choice(["w1 w2", "w3 w4 w5", "none"]), 0.5 + i % 2 / 2, pick("AB"), pick(["CA"]), pick(["k1", "k2"]), pick("YZ"), f"view{i % 2}", r.choice(["Y", None]))
        for i in range(24)
    ]
    queries = spark.createDataFrame(cases, "query_id string, article_id string, position int, text string, weight double, tickers array<string>, company_names array<string>, event_keywords array<string>, event_type_hints array<string>, query_type string, intent_event_type string")
    for n, limit in ((5, 3), (8, 1), (20, 2)):
        config = retrieval.Config("x", bm25_weight=0.3, metadata_weight=0.4, recency_weight=0.5, rule_weight=0.3, use_rule_rerank=True, top_k_stage1=6, per_article_limit=limit)
        want = retrieval.dedupe_candidates(retrieval.scored(retrieval.stage1(queries, chunks, config), chunks, config), limit).where(F.col("rank") <= n)
        got = retrieval.first_candidates(queries, chunks, config, n)
        assert sorted(got.columns) == sorted(want.columns)
        columns = ["case_id", "chunk_id", "rank", "score", "matched_query_types", "matched_intent_event_types"]
        as_set = lambda df: {tuple(map(str, x)) for x in df.select(columns).collect()}
        assert as_set(got) == as_set(want) and got.count() == want.count()


def test_hint_scores_by_class(spark):
    """Pairs are made where chunks lie, without an exchange; totals of classes are those of the pairs."""
    r = random.Random(5)
    pick = lambda xs: [x for x in xs if r.random() < 0.4]
    rows = [(i, r.choice(["paragraph", "document"]), "w " * r.choice([5, 9]), pick("AB"), pick(["ca"]), pick(["k1", "k2", "k3"]), pick("YZ")) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_level string, text string, tickers_hint array<string>, company_names_hint array<string>, event_keywords array<string>, event_type_hints array<string>")
    cases = [(f"q{i}", f"c{i // 2}", i % 2, r.choice(["w", "x"]), 0.5, pick("AB"), pick(["CA"]), pick(["k1", "k2", "k3"]), pick("YZ"), f"view{i % 2}", r.choice(["Y", None])) for i in range(40)]
    queries = spark.createDataFrame(cases, "query_id string, article_id string, position int, text string, weight double, tickers array<string>, company_names array<string>, event_keywords array<string>, event_type_hints array<string>, query_type string, intent_event_type string")

    def score(q, c):
        lower = lambda xs: {x.lower() for x in xs}
        k = len(lower(q[7]) & lower(c[5])) / len(q[7]) if q[7] else 0
        md = min(1, 0.45 * bool(set(q[5]) & set(c[3])) + 0.25 * bool(lower(q[6]) & lower(c[4])) + 0.2 * k + 0.1 * bool(set(q[8]) & set(c[6])))
        shift = 0.1 * (c[1] == "paragraph" and bool(c[5])) - 0.1 * (len(c[2].split()) < 8)
        return round(md, 6), round(max(0, min(1, md + shift)), 6)

    want = {(q[0], c[0]): s for q in cases for c in rows if any(s := score(q, c))}
    pairs = retrieval.metadata_rule_scores(queries, chunks)
    assert {(x[0], x[1]): (round(x[2], 6), round(x[3], 6)) for x in pairs.select("query_id", "chunk_id", "metadata_score", "rule_score").collect()} == want
    lines = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(lines) if "Join" in line)
    assert "BroadcastHashJoin [_kind" in lines[last] and not any("Exchange" in line or "Aggregate" in line for line in lines[:last])
    sums = {x[0]: (x[1], round(x[2], 2)) for x in retrieval.metadata_overlaps(queries, chunks).select("query_id", "n", "total").collect()}
    positive = [(q, md) for (q, _), (md, _) in want.items() if md > 0]
    assert sums == {q: (sum(x == q for x, _ in positive), round(sum(md for x, md in positive if x == q), 2)) for q in {x for x, _ in positive}}
    config = retrieval.Config("x", bm25_weight=0.3, metadata_weight=0.4, rule_weight=0.3, use_rule_rerank=True, top_k_stage1=6)
    names = ["bm25_score", "dense_score", "metadata_score", "rule_score"]
    all_rows = retrieval.stage1(queries, chunks, config).groupBy("case_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])
    rounded = lambda df: {x[0]: [x[1], *[round(v, 6) for v in x[2:]]] for x in df.select("case_id", "n", *names).collect()}
    assert rounded(retrieval.stage1_sums(queries, chunks, config)) == rounded(all_rows)


def test_hints_take_small_batches(spark):
    """Texts go to Python a thousand at a time: a worker and the JVM hold a batch of each at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    companies = spark.createDataFrame([("ABC", "Name", [], "", None, None, None, None, None)], dictionaries.COMPANY)
    dictionaries.company_hints(spark.createDataFrame([("x",)], "text string"), companies)
    assert int(spark.conf.get(key)) == 1000


def test_chunks_are_made_once_for_a_summary(spark):
    articles = spark.createDataFrame([("a", "one two\nthree", "s"), ("b", "x " * 1500, "t")], "article_id string, text string, source string")
    out = chunking.chunk_summary(chunking.build_chunks(articles))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["kind"], r["name"]): r["n"] for r in out.collect()}
    assert got["level", "document"] == 2 and got["source", "s"] == 1 and got["rate", "chunks_per_article"] == sum(n for (k, _), n in got.items() if k == "level") / 2


def test_patterns_meet_chunks_once(spark):
    patterns = spark.createDataFrame([("p1", "event", "a", "THREE"), ("p2", "event", "a", "four"), ("p3", "no_event", "a", ""), ("p4", "no_event", "b", ""), ("p5", "event", "b", "y")], "pattern_id string, pattern_kind string, article_id string, evidence_span string")
    chunks = spark.createDataFrame([("a", "a_d", "document", "one thrée"), ("a", "a_p", "paragraph", "three"), ("b", "b_p2", "paragraph", "x"), ("b", "b_p1", "paragraph", "x")], "article_id string, chunk_id string, chunk_level string, text string")
    out = verification.attach_patterns(patterns, chunks)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    want = {("p1", "a_d", "evidence_document", 1.0), ("p1", "a_p", "evidence_paragraph", 1.0), ("p2", "a_d", "document_fallback", 0.0), ("p3", "a_d", "document_no_event", 1.0), ("p5", "b_p1", "first_chunk_fallback", 0.0)}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)


def test_hybrid_searches_take_every_fiftieth_document(spark):
    from glosswork.plans import retrieval_queries

    sf = "/root/testdata/sf0.001"
    wanted = {f"d{r[0]}" for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 50 = 0 AND trim(text) <> ''").select("doc_id").collect()}
    for name in ("ret04_retrieve_hybrid", "ret17_prompts"):
        assert {r["case_id"] for r in retrieval_queries.QUERIES[name](spark, sf).collect()} == wanted


def plain_mmr(rows, config):
    """The choice of coverage_mmr with sets and loops."""
    left, counts, chosen, top = list(rows), {}, [], max(r[3] for r in rows) or 1.0
    likeness = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while left and len(chosen) < rows[0][6]:
        full = [r for r in left if rows[0][7] > 1 and r[4] and all(counts.get(t, 0) >= config.max_per_event_type for t in r[4])]
        scored = []
        for r in [r for r in left if r not in full] or left:
            value = config.mmr_lambda * r[3] / top + (1 - config.mmr_lambda) * (1 - max((likeness(set(r[5]), set(c[5])) for c in chosen), default=0.0))
            value -= retrieval.OVERFLOW_PENALTY * max((max(0, counts.get(t, 0) - config.max_per_event_type + 1) for t in r[4]), default=0)
            value += retrieval.COVERAGE_BONUS * any(not counts.get(t) for t in r[4])
            scored.append((-value, r[2], r))
        best = min(scored, key=lambda x: x[:2])[2]
        chosen.append(best)
        left.remove(best)
        for t in best[4]:
            counts[t] = counts.get(t, 0) + 1
    return [r[1] for r in chosen]


def test_coverage_choice_equals_plain_loops():
    r = random.Random(4)
    config = retrieval.CONFIGS["multi_event_aware_hybrid"]
    for n_types in (0, 1, 3):
        for _ in range(20):
            kinds = ["MA", "DIVIDEND", "CONTRACT", "LEGAL"]
            rows = [("c", f"k{i}", i + 1, r.random(), r.sample(kinds, r.randrange(3)), r.sample("abcdefghijklmnop", r.randrange(9)), 6, n_types) for i in range(r.randrange(1, 20))]
            frame = pd.DataFrame(rows, columns=["case_id", "chunk_id", "rank", "score", "_types", "_tokens", "_k", "_n"])
            got = retrieval.coverage_mmr(frame, config)
            assert got["chunk_id"].tolist() == plain_mmr(rows, config)
            novelty = (1 - config.mmr_lambda) * (1 - got["diversity_penalty"])
            parts = config.mmr_lambda * got["normalized_relevance"] + novelty + got["coverage_bonus"] - got["event_overflow_penalty"]
            assert (abs(parts - got["selection_score"]) < 1e-5).all()
            seen, by_chunk = set(), {x[1]: set(x[4]) for x in rows}
            for c, new, bonus, penalty in zip(got["chunk_id"], got["covered_new_event_types"], got["coverage_bonus"], got["diversity_penalty"]):
                assert new == sorted(by_chunk[c] - seen) and (bonus > 0) == bool(new)
                done = [set(x[5]) for x in rows if x[1] in got["chunk_id"].tolist()[: got["chunk_id"].tolist().index(c)]]
                own = next(set(x[5]) for x in rows if x[1] == c)
                assert abs(penalty - max((len(own & d) / len(own | d) for d in done if own and d), default=0.0)) < 1e-6
                seen |= by_chunk[c]


def test_containing_keeps_every_evidence_of_a_case(spark):
    ev = [("a", "the red fox runs fast"), ("a", "one blue whale sings loud"), ("a", "fox"), ("b", "e sing"), ("b", "zzz"), ("c", ""), ("c", None), ("d", "Đỏ"), ("a", "the red fox runs fast")]
    ch = [(1, "see The Red fox runs fast now"), (2, "one blue whale sings loud"), (3, "do here: ĐÓ là đo"), (4, None)]
    got = ranking_metrics.containing(spark.createDataFrame(ev, "k string, evidence string"), spark.createDataFrame(ch, "c int, text string"), "k", "c").collect()
    from collections import Counter

    assert Counter(tuple(x) for x in got) == Counter([("a", 1), ("a", 2), ("b", 2), ("d", 3)])


def test_first_per_hash_keeps_one_of_equal_first_rows(spark):
    from glosswork.operators import ingest

    df = spark.createDataFrame([(1, "h", "x"), (1, "h", "y"), (2, "h", "z"), (None, "g", "w")], "k int, content_hash string, text string")
    got = {r["content_hash"]: r for r in ingest.first_per_hash(df, "k").collect()}
    assert got["h"]["k"] == 1 and got["h"]["text"] in "xy" and got["h"]["n_duplicates"] == 2 and got["g"]["n_duplicates"] == 0
    assert ingest.first_per_hash(df, "k").columns == ["k", "content_hash", "text", "n_duplicates"]


def test_dense_top_k_in_parts(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    v = [(i, [float(x) for x in r.normal(size=4)]) for i in range(200)]
    df = spark.createDataFrame(v, "id int, v array<double>")
    q = df.where("id % 5 = 0").select("id", "v").toDF("query_id", "vector")
    whole = sorted(tuple(x) for x in index.dense_top_k(df, "id", "v", q, 3).select("query_id", "id", "rank").collect())
    monkeypatch.setattr(index, "PART_BYTES", 300)
    assert sorted(tuple(x) for x in index.dense_top_k(df, "id", "v", q, 3).select("query_id", "id", "rank").collect()) == whole and len(whole) == 120


def test_coverage_keeps_the_minority_type():
    rows = [("c", f"m{i}", i + 1, 1 - i / 100, ["MA"], ["same", "words", str(i)], 4, 2) for i in range(8)] + [("c", "d", 9, 0.5, ["DIVIDEND"], ["other"], 4, 2)]
    frame = pd.DataFrame(rows, columns=["case_id", "chunk_id", "rank", "score", "_types", "_tokens", "_k", "_n"])
    got = retrieval.coverage_mmr(frame, retrieval.CONFIGS["multi_event_aware_hybrid"])
    assert "d" in set(got["chunk_id"]) and len(got) == 4 and got["chunk_id"].iloc[0] == "m0"


def test_query_views(spark):
    schema = "article_id string, title string, text string, tickers_hint array<string>, company_names_hint array<string>, event_keywords array<string>, event_type_hints array<string>, event_subtype_hints array<string>"
    df = spark.createDataFrame([("a", "Title", "Body", ["fpt"], ["FPT Corp"], ["ký"], ["contract"], ["signed"]), ("b", "", "only body " * 60, [], [], [], [], [])], schema)
    rows = querying.build_queries(df, "event_intent").collect()
    a = {r["query_type"]: r for r in rows if r["article_id"] == "a"}
    assert list(sorted(a)) == ["company_event", "event_intent_contract", "event_type", "ticker_event", "title"]
    assert a["ticker_event"]["text"] == "FPT ký Title" and a["event_intent_contract"]["text"] == "FPT FPT Corp CONTRACT SIGNED ký Title"
    b = [r for r in rows if r["article_id"] == "b"]
    assert len(b) == 1 and b[0]["query_type"] == "body_fallback" and len(b[0]["text"].split()) == 80


def test_listwise_aliases(spark):
    raws = ['["2", "C1"]', '{"ranking": ["C002"]}', "text [1] more", "nothing", '{"ranked_ids": []}']
    assert column(spark, raws, rerank.parse_listwise) == [["2", "C1"], ["C002"], ["1"], None, None]


def test_config_floor():
    c = retrieval.with_preselect(retrieval.CONFIGS["hybrid"], 20)
    assert (c.top_k_stage1, c.top_k_final) == (50, 20)


# evaluation


@given(st.lists(st.tuples(st.sampled_from([0.3, 0.5, 0.9]), st.integers(0, 3), st.integers(0, 3)), max_size=10, unique_by=lambda p: p[1:]))
@settings(max_examples=25, deadline=None)
def test_greedy_matching(spark, pairs):
    df = spark.createDataFrame([([(-s, g, p) for s, g, p in pairs],)], "x array<struct<order:double,gold_index:int,pred_index:int>>")
    got = [(r["gold_index"], r["pred_index"]) for r in df.select(evaluation.greedy(F.array_sort("x"))).first()[0]]
    want, used_g, used_p = [], set(), set()
    for s, g, p in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if g not in used_g and p not in used_p:
            want.append((g, p))
            used_g.add(g)
            used_p.add(p)
    assert got == want


# JSON, validation, verification


def test_json_repair(spark):
    raws = ['{"a": 1}', "```json\n{\"a\": 2}\n```", 'note {"a": 3} end', "[1]", "no", None]
    assert column(spark, raws, lambda c: J.field(J.repair_object(c), "a", "int")) == [1, 2, 3, None, None, None]
    assert column(spark, raws, lambda c: J.field(J.parse_whole(c), "a", "int")) == [1, 2, None, None, None, None]


TAXONOMY = validation.Taxonomy({"CONTRACT": ("SIGNED",)}, {"CONTRACT": ("partner",)})


def test_validation_of_a_good_and_a_broken_label(spark):
    good = '{"article_id":"a","document_label":"HAS_EVENT","label_reason":"r","warnings":[],"model_info":{"model_name":"m","prompt_version":"p","run_id":"r"},"events":[{"event_id":"e1","ticker":"FPT","company_name":null,"event_type":"contract","event_subtype":"signed","event_summary":"s","event_reason":"r","event_arguments":{"partner":"x"},"impact_sentiment":"positive","evidence_span":"FPT ký hợp đồng","source_url":"u","published_at":null,"confidence":0.5}]}'
    broken = '{"article_id":"zz","document_label":"NO_EVENT","events":[{"event_type":"X"}],"more":1}'
    labels = spark.createDataFrame([("a", good), ("b", broken)], "article_id string, raw string").select("article_id", F.parse_json("raw").alias("label"))
    articles = spark.createDataFrame([("a", "T", "Hôm nay FPT ky hop dong lớn.", ["FPT"]), ("b", "", "x", [])], "article_id string, title string, text string, tickers_hint array<string>")
    rows = validation.validate(labels, articles, TAXONOMY).collect()
    assert [r for r in rows if r["article_id"] == "a"] == []
    codes = {r["code"] for r in rows}
    assert {"missing_required_fields", "unexpected_fields", "article_id_mismatch", "no_event_has_events", "invalid_event_type", "event_arguments_not_object", "missing_event_id", "invalid_confidence"} <= codes


def test_verification_scenarios(spark):
    articles = spark.createDataFrame([("a", "FPT news", "FPT ký hợp đồng với ABC. Giá trị 500 tỷ.")], "article_id string, title string, text string")
    event = lambda i, span, partner, kind="CONTRACT", sentiment="POSITIVE": ("a", i, f"e{i}", kind, "SIGNED", "FPT", "FPT", sentiment, span, {"partner": partner}, 0.9)
    rows = [event(0, "FPT ký hợp đồng với ABC", "ABC"), event(1, "hoàn toàn không có trong bài viết này", "ABC"), event(2, "FPT ky hop dong voi ABC", "Samsung Electronics"), event(3, "FPT", "ABC", "BOGUS"), event(4, "Giá trị 500 tỷ", "ABC", sentiment="NEGATIVE")]
    schema = "article_id string, event_index int, event_id string, event_type string, event_subtype string, ticker string, company_name string, impact_sentiment string, evidence_span string, event_arguments map<string,string>, confidence double"
    out = verification.verify(spark.createDataFrame(rows, schema), articles, TAXONOMY)
    kept = {r["event_index"]: r for r in out["events"].collect()}
    assert set(kept) == {0, 2, 4} and kept[0]["confidence"] == 0.9
    assert kept[2]["event_arguments"]["partner"] is None and kept[2]["confidence"] == 0.7
    assert kept[4]["confidence"] == 0.7 and "negative_growth" in kept[4]["warnings"][0]
    assert {r["event_index"]: r["reason"] for r in out["dropped"].collect()} == {1: "evidence_span_unsupported", 3: "invalid_event_type"}
    m = out["metrics"].first()
    assert m["unsupported_event_rate"] == 0.4 and m["verified_event_retention_rate"] == 0.6


def test_evidence_from_contexts(spark):
    articles = spark.createDataFrame([("a", None, "something else")], "article_id string, title string, text string")
    contexts = spark.createDataFrame([("a", 0, "c0", None, "nothing"), ("a", 1, "c1", None, "the wanted span is here"), ("a", 2, "c2", None, "the wanted span")], "article_id string, position int, chunk_id string, title string, text string")
    events = spark.createDataFrame([("a", 0, "wanted span")], "article_id string, event_index int, evidence_span string")
    row = verification.evidence_support(events, articles, contexts).first()
    assert row["evidence_source"] == "context:c1" and row["evidence"]["support"] == "SUPPORTED"


def test_pattern_fallbacks(spark):
    chunks = spark.createDataFrame([("a", "a_document_0000", "document", "whole text here"), ("a", "a_paragraph_0000", "paragraph", "text here"), ("b", "b_paragraph_0000", "paragraph", "x")], "article_id string, chunk_id string, chunk_level string, text string")
    patterns = spark.createDataFrame([("p1", "event", "a", "TEXT here"), ("p2", "event", "a", "absent"), ("p3", "event", "b", "absent"), ("p4", "no_event", "a", None), ("p5", "event", "zz", "x")], "pattern_id string, pattern_kind string, article_id string, evidence_span string")
    got = {(r["pattern_id"], r["chunk_id"], r["match_strategy"]) for r in verification.attach_patterns(patterns, chunks).collect()}
    assert got == {("p1", "a_document_0000", "evidence_document"), ("p1", "a_paragraph_0000", "evidence_paragraph"), ("p2", "a_document_0000", "document_fallback"), ("p3", "b_paragraph_0000", "first_chunk_fallback"), ("p4", "a_document_0000", "document_no_event")}


def test_model_calls_become_rows(spark):
    prompts = spark.createDataFrame([("a", "good"), ("b", "bad")], "article_id string, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return prompt.upper()

    assert {tuple(r)[:4] for r in verification.invoke(prompts, model).collect()} == {("a", "GOOD", None, 1), ("b", None, "no", 3)}


# files and tables


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "companies.csv"
    path.write_text("﻿ticker,company_name,aliases,sector\nfpt,FPT Corp,FPT Software| FPT Telecom ,TECH\n,No ticker,,\nabc,,x,\n", encoding="utf-8")
    rows = dictionaries.load_company_dictionary(spark, str(path)).collect()
    assert [(r["ticker"], r["aliases"], r["sector"]) for r in rows] == [("FPT", ["FPT Software", "FPT Telecom"], "TECH")]
    assert dictionaries.load_company_dictionary(spark, str(tmp_path / "none.csv")).count() == 0
    assert dictionaries.load_event_keywords(spark, str(tmp_path / "none.csv")).count() == 11


def test_taxonomy_file(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"schema_version": "1", "document_labels": ["HAS_EVENT"], "common_argument_fields": ["date"], "event_types": {"MA": {"subtypes": ["B", "A"], "argument_fields": ["buyer"]}}}')
    row = dictionaries.load_event_taxonomy(spark, str(tmp_path / "t.json")).first()
    assert (row["event_type"], row["subtypes"], row["argument_fields"]) == ("MA", ["A", "B"], ["buyer", "date"])


def test_jsonl_modes(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{bad\n[1]\n')
    rows = files.read_jsonl_numbered(spark, str(path)).orderBy("line_number").collect()
    assert [(r["line_number"], r["error"]) for r in rows] == [(1, None), (3, "invalid JSON"), (4, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(path), "a int").collect()


def test_run_folders(spark, tmp_path):
    for name, body in [("r1", '{"run_id": "r1", "final_output": {"article_id": "a", "events": []}, "config_name": "c"}'), ("r2", "not json")]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(body)
    rows = {r["article_id"]: r for r in files.read_predictions(spark, None, str(tmp_path)).collect()}
    assert rows["a"]["config_name"] == "c" and rows["a"]["json_valid"] and not rows[""]["json_valid"] and rows[""]["config_name"] == "default"


def test_table_overwrite_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3).withColumn("v", F.lit("old")), path)
    new = tables.upsert(spark.read.parquet(path), spark.createDataFrame([(2, "new"), (9, "new")], "id long, v string"), ["id"])
    tables.write_table(new, path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(0, "old"), (1, "old"), (2, "new"), (9, "new")}


def test_statements_and_health(spark, tmp_path):
    assert tables.split_statements("a; b ';' c;\n d ") == ["a", "b ';' c", "d"]
    assert tables.healthcheck(spark, str(tmp_path)) and not tables.healthcheck(spark, str(tmp_path / "none"))


def log_line(event, run="r", **more):
    return json.dumps({"event": event, "run_id": run, **more}) + "\n"


def test_log_tail_goes_on(spark, tmp_path):
    """Appended lines, lines still being written, new files, blank and broken lines; each line once."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (folder / "deeper").mkdir(parents=True)
    a, b = folder / "a.log", folder / "deeper" / "b.log"

    def tailed():
        log_tail.run_available(log_tail.tail(spark, str(folder), split=64), out, state)
        rows = spark.read.parquet(out).collect()
        return sorted((r["event"] or r["line"], r["after_final"]) for r in rows)

    a.write_text(log_line("e0") + '{"event": "e1", "run')
    assert tailed() == [("e0", False)]
    with a.open("a") as file:
        file.write('_id": "r"}\n\nno json\n' + log_line("e2", message="é" * 100))
    b.write_text(log_line("other", "q", status="failed") + log_line("late", "q"))
    first = [("", False), ("e0", False), ("e1", False), ("e2", False), ("late", True), ("no json", False), ("other", False)]
    assert tailed() == first and tailed() == first  # nothing new: nothing again
    with b.open("a") as file:
        file.write(log_line("later", "q") + log_line("own", "s"))
    assert tailed() == sorted([*first, ("later", True), ("own", False)])
    assert [(r.run_id, r.final_status) for r in log_tail.finals(spark, state).collect()] == [("q", "failed")]


def test_every_split_of_a_log_gives_each_line_once(tmp_path):
    made = random.Random(2)
    text = "".join("x" * made.randrange(9) + "\n" for _ in range(40))
    path = tmp_path / "a.log"
    path.write_text(text)
    for split in (1, 2, 7, 50, 10_000):
        reader = log_tail.LogReader(str(tmp_path), split)
        for first in (0, len("".join(text.splitlines(True)[:7]))):
            parts = reader.partitions({str(path): first}, reader.latestOffset())
            found = [x for p in parts for x in log_tail.lines(p)]
            assert [line for _, line in found] == text[first:].split("\n")[:-1]
            assert all(text[at : at + len(line)] == line and text[at - 1 : at] in ("", "\n") for at, line in found)


def test_follow_ends_with_the_last_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text(log_line("x", "1", status="success") + log_line("y", "2", status="running"))
    places = str(folder), str(tmp_path / "out"), str(tmp_path / "state")
    assert log_tail.follow(spark, *places, runs=["1"]) and not log_tail.follow(spark, *places, runs=["1", "2"], wait=0.1, most=0.1)
    with (folder / "a.log").open("a") as file:
        file.write(log_line("z", "2", status="canceled"))
    assert log_tail.follow(spark, *places, runs=["1", "2"])
    assert sorted(r["event"] for r in spark.read.parquet(places[1]).collect()) == ["x", "y", "z"]


def test_article_tree_picks_the_longest_container(spark):
    page = '<html><head><meta name="author" content=" A "><title>t</title></head><body><article><p>short</p></article><div class="x detail-content"><p>a <b>long</b> paragraph<br>of text</p><ul><li>item</li></ul><script>no()</script></div><time datetime="2024-01-01">x</time></body></html>'
    got, open_, empty = parsed(spark, [page, "<p>unclosed <div>x", ""], H.parse_article_tree)
    assert got["body_text"] == "a long paragraph of text\nitem" and got["author"] == "A" and got["published_at"] == "2024-01-01"
    assert open_["body_text"] and empty["warnings"] == ["missing_title", "missing_published_at", "empty_body"]


def test_external_normalizer_keeps_codes(spark):
    def shout(text):
        if "fail" in text:
            raise ValueError("no")
        return text.lower().replace("xin", "XIN")

    run = T.external_normalizer(shout)
    assert column(spark, ["Xin FPT_A Chào", "fail HNX"], lambda c: T.preprocess(c, run)) == ["XIN FPT_A chào", "fail HNX"]


def test_nodes_run_on_after_errors():
    from glosswork.operators import extraction

    state, trace = extraction.run_nodes({"a": 1}, {"one": lambda s: {"b": s["a"] + 1}, "two": lambda s: 1 / 0, "three": lambda s: {"c": s["b"]}})
    assert state == {"a": 1, "b": 2, "c": 2} and [t["status"] for t in trace] == ["ok", "error", "ok"]


# retrieval per task


def bm25_model(docs, queries, k):
    tf = {d: {w: ws.count(w) for w in ws} for d, ws in docs.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in t for t in tf.values()) for q in queries.values() for w in q}
    out = []
    for q, words in queries.items():
        scores = {}
        for d, t in tf.items():
            total = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * len(docs[d]) / mean)) for w in words if w in t)
            if total > 0:
                scores[d] = round(total, 6)
        ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, d, s, r) for r, (d, s) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_bm25_of_many_queries(spark, monkeypatch, small):
    """Copies (ties at the cut), repeated query terms, empty documents and terms that no document has."""
    if small:  # several parts, blocks of a few documents, buffers that are emptied
        monkeypatch.setattr(index, "PART_BYTES", 900)
        monkeypatch.setattr(index, "MOST_LITERALS", 5)
    made = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = {f"d{i:03}": made.choices(words, [1 / (j + 1) for j in range(30)], k=made.randint(0, 25)) for i in range(150)}
    docs |= {f"e{i:03}": docs["d007"] for i in range(40)}
    queries = {f"q{i}": made.choices([*words, "none"], k=made.randint(1, 6)) for i in range(25)}
    frame = spark.createDataFrame(list(docs.items()), "id string, ws array<string>").repartition(3)
    asked = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws], "query_id string, term string")
    got = index.bm25_top_k(frame, "id", F.col("ws"), asked, 7).collect()
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got) == bm25_model(docs, queries, 7)


def test_held_rows_are_the_best_ones(spark):
    made = np.random.default_rng(2)
    held, rows = index._Held(3, 4), []
    held.most = 20
    for _ in range(50):
        q, s = made.integers(0, 3, 9), np.round(made.random(9), 1)
        ids = [f"k{i:02}" for i in made.integers(0, 60, 9)]
        floor = held.add(q, s, pa.array(ids))
        rows += list(zip(q.tolist(), s.tolist(), ids))
    want = [x for one in range(3) for x in sorted((r for r in rows if r[0] == one), key=lambda r: (-r[1], r[2]))[:4]]
    q, s, ids = held.best()
    assert list(zip(q.tolist(), s.tolist(), ids.to_pylist())) == want and (floor > 0.5).all()


def test_dense_widths(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, None), (6, []), (7, [-1.0, 0.0, 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(vectors, "id int, v array<double>").coalesce(1)
    queries = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 2.0]), ("c", None)], "query_id string, vector array<double>")
    got = sorted((r.query_id, r["rank"], r.id, r.cosine) for r in index.dense_top_k(df, "id", "v", queries, 4).collect())
    assert got == [("a", 1, 3, 1.0), ("a", 2, 1, 0.0), ("a", 3, 2, 0.0), ("a", 4, 4, 0.0), ("b", 1, 2, 1.0), ("b", 2, 1, 0.0), ("b", 3, 3, 0.0), ("b", 4, 4, 0.0)]
    all_rows = {(r.query_id, r.id) for r in index.dense_top_k(df, "id", "v", queries, 9).collect()}
    assert ("a", 7) in all_rows and ("a", 5) not in all_rows


def test_hash_embeddings_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None)], "k int, t string")
    out = index.hash_embeddings(df, "k", F.split("t", " "), 16)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: sum(x != 0 for x in r.vector) for r in out.collect()}[3] == 0


def test_equal_texts_are_embedded_once(spark):
    chunks = spark.createDataFrame([(f"c{i}", "a", t) for i, t in enumerate(["x", "x", "y", "z", "X "])], "chunk_id string, article_id string, embedding_text string")
    cache = spark.createDataFrame([("m", "y", [2.0]), ("m", "y", [1.0])], "embedding_model string, t string, vector array<double>")
    cache = cache.select("embedding_model", T.text_hash(F.col("t")).alias("chunk_hash"), "vector")
    asked = []

    def embed(df):
        asked.append(sorted(r.chunk_id for r in df.collect()))
        return df.select("chunk_id", F.array(F.length("embedding_text").cast("double")).alias("vector"))

    got = {r.chunk_id: (r.vector, r.cache_hit) for r in index.embed_with_cache(chunks, cache, embed, "m").collect()}
    assert asked == [["c0", "c3"]] and got["c2"] == ([1.0], True) and got["c0"] == got["c1"] == got["c4"] == ([1.0], False)


# dictionaries


def hint_model(text, companies, keywords):
    """What the definition says, entry by entry."""
    plain = normal(html.unescape(text or ""))
    low = fold(plain).lower()
    tickers, names = set(), set()
    for ticker, name, aliases, _ in companies:
        named = any(w and (w.lower() in plain.lower() or fold(w).lower() in low) for w in (name, *(aliases or [])))
        if named or re.search(rf"(?<![A-Z0-9]){re.escape(ticker)}(?![A-Z0-9])", plain):
            tickers.add(ticker)
            names.add(name)
    sectors = {s for t, _, _, s in companies if t in tickers and s}
    matched = {}
    for kind, sub, word, polarity, priority in keywords:
        if fold(word).lower() and fold(word).lower() in low:
            matched[(kind, sub, word)] = (kind, sub, word, polarity, priority)
    matches = sorted(matched.values(), key=lambda m: (-m[4], m[0], m[2]))
    columns = [sorted({m[2] for m in matches}), sorted({m[0] for m in matches}), sorted({m[1] for m in matches if m[1]})]
    return sorted(tickers), sorted(names), sorted(sectors), matches, *columns


def hinted_rows(spark, texts, companies, keywords):
    c = spark.createDataFrame([(*x, None, None, None, None, None) for x in companies], dictionaries.COMPANY)
    k = spark.createDataFrame([(*x, "") for x in keywords], dictionaries.KEYWORD)
    rows = dictionaries.attach_hints(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), c, k).orderBy("i").collect()
    names = ["tickers_hint", "company_names_hint", "sector_hints", "event_keyword_matches", "event_keywords", "event_type_hints", "event_subtype_hints"]
    return [tuple([tuple(m) for m in r[n]] if n == "event_keyword_matches" else r[n] for n in names) for r in rows]


COMPANIES = [("VN", "Việt Nam Ltd", ["vina", ""], "A"), ("VN", "Other", [], "B"), ("AB1", "Đặng & Co", None, None), ("M&A", "ﬁne", ["½ shop"], ""), ("X", "x", [], "C")]
KEYWORDS = [("T", "S", "hợp đồng", "p", 1), ("U", "", "vina", "n", 5), ("T", "S", "hợp đồng", "last", 7), ("T", "R", "hợp đồng", "q", 7), ("T", "", "M&A", "q", 2), ("W", "z", "ﬁ", "", 2)]


def test_hints_of_single_cases(spark):
    texts = ["VN", "VNM", "aVN", "1VN VN", "viet nam ltd", "VI&#7878;T NAM LTD", "dang &amp; co", "fine", "1⁄2 shop", "M&amp;A", "Hợp đồng", "hop dong vina", "AB1.", "", None, "xAB12 AB1"]
    assert hinted_rows(spark, texts, COMPANIES, KEYWORDS) == [hint_model(t, COMPANIES, KEYWORDS) for t in texts]


@pytest.mark.parametrize("part_bytes", [2_000_000, 700])
def test_hints_on_made_up_texts(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(dictionaries, "PART_BYTES", part_bytes)
    made = random.Random(9)
    word = lambda: "".join(made.choices("abéĐÉx1 ", k=made.randint(1, 4)))
    companies = [("".join(made.choices("AB1", k=made.randint(1, 3))), word(), [word() for _ in range(made.randrange(3))], made.choice(["", "S", "T"])) for _ in range(40)]
    keywords = [(made.choice("TU"), made.choice(["", "s"]), word().strip() or "a", made.choice("pn"), made.randrange(3)) for _ in range(40)]
    texts = ["".join(made.choices(["a", "b", "é", "Đ", "1", "A", "B", " ", "É", "x", "\n"], k=made.randint(0, 30))) for _ in range(120)]
    got, want = hinted_rows(spark, texts, companies, keywords), [hint_model(t, companies, keywords) for t in texts]
    assert got == want


def test_hints_cost_little_more_with_many_entries(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    made, times = random.Random(1), {}
    for n in (100, 20_000):
        rows = [("T", "s", "".join(made.choices("abcdefghijklmnop", k=12)), "p", 1, "") for _ in range(n)]
        found = dictionaries.keyword_hints(docs, spark.createDataFrame(rows, dictionaries.KEYWORD))
        times[n] = []
        for _ in range(3):
            start = time.time()
            found.write.format("noop").mode("overwrite").save()
            times[n].append(time.time() - start)
    assert min(times[20_000]) < 1.5 * min(times[100]) + 0.5


# fuzzy evidence


def plain_best_window(query, text):
    """Every window compared, in order."""
    wanted, best, found = len(query.split()), 0.0, None
    for sentence in filter(None, (part.strip() for part in re.split(r"[\n\r]+|(?<=[.!?;:])\s+", text))):
        words = sentence.split()
        spans = [(0, len(words))]
        if wanted and len(words) > 2:
            spans += [(i, i + n) for n in range(max(2, wanted - 3), min(len(words), wanted + 5) + 1) for i in range(len(words) - n + 1)]
        for k, (i, j) in enumerate(spans):
            option = " ".join(filter(None, map(S._fold, words[i:j])))
            ratio = SequenceMatcher(None, query, option).ratio()
            if ratio > best:
                best, found = ratio, " ".join(words[i:j]) if k else sentence
    return best, found


def test_best_window_loses_none():
    made = random.Random(12)
    words = ["ab", "ba", "aab", "c", "é", "xyz", "b", "́", "Đa", "acb.", "bb;", "ca", "abc", "cab"]
    for i in range(600):
        text = "".join(made.choice(words) + made.choice([" ", " ", " ", "\n", "  "]) for _ in range(made.randrange(0, 30)))
        query = S._fold(" ".join(made.choices(words, k=made.randrange(1, 8)))) or "a"
        assert S._best_window(query, text) == plain_best_window(query, text), (query, text)


def test_best_window_of_documents_costs_less():
    docs = [t for t in pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text if t and 300 < len(t) < 4000][:12]
    queries = [S._fold(" ".join(t.split()[5:25])[:-3] + "zzz qq") for t in docs]
    spent = []
    for search in (plain_best_window, S._best_window):
        start = time.process_time()
        results = [search(q, t) for q in queries[:2] for t in docs[:5]]
        spent.append((time.process_time() - start, results))
    assert spent[0][1] == spent[1][1] and spent[1][0] < spent[0][0]
