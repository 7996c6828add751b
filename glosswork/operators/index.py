"""Lexical and vector indexes: postings with corpus statistics, hash embeddings, exact dense top-k."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from glosswork.functions import text as T
from glosswork.lineage import cut

K1, B = 1.5, 0.75
#: Bytes of query vectors that one scan takes to every task; most words that a plan holds as literals.
PART_BYTES, MOST_LITERALS = 16_000_000, 4_000
HASH_MODEL = "local_hash_embedding_v1"


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, dl, term, tf) of every term; documents are counted by themselves, without a shuffle by term."""
    rows = docs.select(key, tokens.alias("_tokens")).withColumn("dl", F.size("_tokens"))
    return T.exploded(rows, F.col("_tokens"), "term", key, "dl").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n_docs and average length, empty documents included."""
    return docs.select(F.size(tokens).alias("dl")).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def document_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df)."""
    return T.exploded(docs, F.array_distinct(tokens), "term").groupBy("term").agg(F.count("*").alias("df"))


def only_wanted(tokens: Column, wanted: DataFrame, most: int = MOST_LITERALS) -> Column:
    """tokens without those that are not in ``wanted`` (one column of words), as a test in the scan; all tokens where
    there are more than ``most`` words: the join that follows then drops the others."""
    words = [r[0] for r in wanted.limit(most + 1).collect()]
    return tokens if len(words) > most else F.filter(tokens, lambda t: t.isin(words))


def bm25_top_k(docs: DataFrame, key: str, tokens: Column, queries: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """(query_id, key, score, rank): the k best matches of each query, ties by key. queries: (query_id, term), a repeated
    term counts again; scores are rounded to ``digits`` places, if given, before they are compared.

    The texts are read and tokenised once: each row's length and those of its tokens that a query has are written down,
    and lengths and frequencies come from there. Then each task scores its own documents for all queries and hands on its
    own best k per query, so that matches are never shuffled. A scan takes PART_BYTES of weighted query terms to every
    task; more queries take more scans, and each part's best are written down.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)[key]
    asked = cut(queries.groupBy("query_id", "term").agg(F.count("*").alias("n")))
    rows = docs.select(key, tokens.alias("_tokens"))
    rows = cut(rows.select(key, F.size("_tokens").alias("dl"), only_wanted(F.col("_tokens"), asked.select("term").distinct()).alias("_tokens")))
    n_docs, avg_dl = rows.agg(F.count("*"), F.avg("dl")).first()
    df = rows.select(F.explode(F.array_distinct("_tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, "term").select("query_id", "term", (F.col("n") * idf).alias("weight"))
    size = weighted.agg(F.sum(F.octet_length("term").cast("long") + 40)).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    weighted = cut(weighted.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")))
    best, schema = None, f"query_id {kinds[0]}, {key} {kinds[1]}, score double"
    for p in range(parts):
        part = weighted.where(F.col("_part") == p).select("query_id", "term", "weight").toArrow().combine_chunks()
        found = rows.mapInArrow(_best_matches(part, k, key, float(avg_dl or 1), digits), schema)
        found = found if parts == 1 else cut(top_k(found, key, k).drop("rank"))
        best = found if best is None else best.union(found)
    return top_k(best, key, k)


#: Scores that a task holds at once (documents times queries).
BLOCK_SCORES = 1_000_000


def _best_matches(weighted: pa.Table, k: int, key: str, avg_dl: float, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = weighted.column("query_id").combine_chunks().dictionary_encode() if len(weighted) else None
        if names is None:
            return
        words = weighted.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(np.asarray(words.indices), kind="stable")
        of_query, weight = np.asarray(names.indices)[order].astype(np.int64), np.asarray(weighted.column("weight"))[order]
        degree = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
        first, n_q = np.cumsum(degree) - degree, len(names.dictionary)
        held, floor = _Held(n_q, k), np.zeros(n_q)
        step = max(1, BLOCK_SCORES // n_q)
        for batch in batches:
            lists, dl = batch.column(2), np.asarray(batch.column(1), np.float64)
            size = np.where(np.asarray(lists.is_valid()), np.diff(np.asarray(lists.offsets)), 0)
            found = pc.index_in(lists.flatten(), value_set=words.dictionary)
            term = np.asarray(found.fill_null(-1)).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)[term >= 0]
            cells, tf = np.unique(doc * len(degree) + term[term >= 0], return_counts=True)  # by document, then term: equal documents get equal sums
            doc, term = np.divmod(cells, len(degree))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avg_dl))
            for low in range(0, len(size), step):
                x, y = np.searchsorted(doc, [low, low + step])
                n, many = min(step, len(size) - low), degree[term[x:y]]
                at = np.arange(int(many.sum())) + np.repeat(first[term[x:y]] - (np.cumsum(many) - many), many)
                sums = np.bincount(np.repeat((doc[x:y] - low) * n_q, many) + of_query[at], np.repeat(part[x:y], many) * weight[at], n * n_q)
                scores = sums.reshape(n, n_q) if digits is None else np.round(sums.reshape(n, n_q), digits)
                least = np.partition(scores, n - k, axis=0)[n - k] if n > k else 0
                d, q = np.nonzero((scores > 0) & (scores >= np.maximum(least, floor)))
                floor = held.add(q, scores[d, q], batch.column(0).take(pa.array(low + d)))
        q, score, ids = held.best()
        for low in range(0, len(q), 50_000):
            some = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(q[some])), ids.slice(low, 50_000), pa.array(score[some])], names=["query_id", key, "score"])

    return run


class _Held:
    """The best k rows per query so far; ties by key."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.most = k, 2 * n_queries * k + 100_000
        self.rows: list[tuple] = []
        self.count, self.floor = 0, np.zeros(n_queries)

    def add(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> np.ndarray:
        """The least score that can still come among the best, per query."""
        self.rows.append((q, score, ids))
        self.count += len(q)
        if self.count > self.most:
            q, score, ids = self.best()
            self.rows, self.count = [(q, score, ids)], len(q)
            full = np.bincount(q, minlength=len(self.floor)) >= self.k
            least = np.full(len(self.floor), np.inf)
            np.minimum.at(least, q, score)
            self.floor[full] = least[full]
        return self.floor

    def best(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0), pa.array([])
        table = pa.table({"q": np.concatenate([r[0] for r in self.rows]), "s": np.concatenate([r[1] for r in self.rows]), "k": pa.chunked_array([r[2] for r in self.rows])})
        table = table.sort_by([("q", "ascending"), ("s", "descending"), ("k", "ascending")])
        q = np.asarray(table.column("q"))
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        table = table.filter(pa.array(keep)).combine_chunks()
        return np.asarray(table.column("q")), np.asarray(table.column("s")), table.column("k").combine_chunks()


def top_k(scores: DataFrame, key: str, k: int, score: str = "score", by: str = "query_id") -> DataFrame:
    """The k best rows of each query, ties by key, with their rank."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bucket(digest: Column, dimension: int) -> Column:
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension).cast("int")


def _sign(digest: Column) -> Column:
    return F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hash_embedding(tokens: Column, dimension: int = 128) -> Column:
    """Signed token counts in hash buckets, unit length, rounded to 8 places; zeros without tokens.

    Built-in functions alone, for short texts: each bucket filters the signed buckets of all tokens, which takes tokens
    times ``dimension`` comparisons. ``hash_embeddings`` is linear.
    """
    pairs = F.transform(tokens, lambda t: F.struct(_bucket(F.sha2(t, 256), dimension).alias("b"), _sign(F.sha2(t, 256)).alias("s")))

    def sums(of: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dimension - 1)),
            lambda b: F.aggregate(F.filter(of, lambda p: p["b"] == b), F.lit(0.0), lambda s, p: s + p["s"]),
        )

    return T.let(T.let(pairs, sums), _unit)


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return T.let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: F.round(x / n, 8))).otherwise(v))


@lru_cache(maxsize=200_000)
def _place(token: str, dimension: int) -> int:
    """Twice the bucket of a token, one more if its sign is negative."""
    digest = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "big") % dimension * 2 + digest[4] % 2


@lru_cache(maxsize=8)
def _bucket_sums(dimension: int):
    @F.arrow_udf(ArrayType(DoubleType()))
    def run(tokens: pa.Array) -> pa.Array:
        words = tokens.flatten().dictionary_encode()
        places = np.array([_place(w, dimension) for w in words.dictionary.to_pylist()], np.int64)[np.asarray(words.indices)]
        size = np.where(np.asarray(tokens.is_valid()), np.diff(np.asarray(tokens.offsets)), 0)
        cells = np.repeat(np.arange(len(size)), size) * dimension + places // 2
        sums = np.bincount(cells, 1.0 - 2.0 * (places % 2), len(size) * dimension)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * dimension, pa.int32()), pa.array(sums, pa.float64()))

    return run


def hash_embeddings(docs: DataFrame, key: str, tokens: Column, dimension: int = 128) -> DataFrame:
    """(key, vector) of every row, without a shuffle: each batch sums the signs of its tokens by document and bucket.

    Null tokens count as none; tokens are never null.
    """
    return docs.select(key, _bucket_sums(dimension)(tokens).alias("v")).select(key, _unit(F.col("v")).alias("vector"))


def embed_with_cache(chunks: DataFrame, cache: DataFrame, embed, model: str = HASH_MODEL) -> DataFrame:
    """Embedding records of chunks (chunk_id, article_id, embedding_text): taken from the cache (embedding_model,
    chunk_hash, vector) where model and hash are there, made by ``embed(frame)`` (-> chunk_id, vector) elsewhere."""
    keyed = chunks.withColumn("chunk_hash", T.text_hash(F.col("embedding_text")))
    # of several cached vectors of one text the least; equal texts without one are embedded once, for the least chunk_id
    usable = cache.where(F.col("embedding_model") == model).groupBy("chunk_hash").agg(F.min("vector").alias("vector"))
    found = cut(keyed.join(usable, "chunk_hash", "left"))
    hit = found.where("vector IS NOT NULL").withColumn("cache_hit", F.lit(True))
    miss = found.where("vector IS NULL").drop("vector")
    texts = cut(miss.groupBy("chunk_hash").agg(F.min_by("embedding_text", "chunk_id").alias("embedding_text"), F.min_by("article_id", "chunk_id").alias("article_id"), F.min("chunk_id").alias("chunk_id")))
    made = miss.join(texts.select("chunk_hash", F.col("chunk_id").alias("_of")), "chunk_hash")
    made = made.join(embed(texts).select(F.col("chunk_id").alias("_of"), "vector"), "_of").drop("_of").withColumn("cache_hit", F.lit(False))
    out = hit.unionByName(made)
    return out.select(
        T.digest_id("emb_", F.concat(F.lit(f"{model}:"), F.col("chunk_id"))).alias("embedding_id"), "chunk_id", "article_id",
        F.lit(model).alias("embedding_model"), F.size("vector").alias("embedding_dimension"), "chunk_hash", "vector",
        F.lit("success").alias("status"), "cache_hit",
    )


def updated_cache(cache: DataFrame, records: DataFrame) -> DataFrame:
    """One vector per model and hash, new ones first."""
    fresh = records.select("embedding_model", "chunk_hash", "vector").dropDuplicates(["embedding_model", "chunk_hash"])
    return cache.select("embedding_model", "chunk_hash", "vector").join(fresh, ["embedding_model", "chunk_hash"], "left_anti").unionByName(fresh)


def dense_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, query_key: str = "query_id") -> DataFrame:
    """Exact cosine top-k: (query_key, key, cosine, rank), ties by key. Where the widths of a vector and a query differ, or a
    component is null or not finite, or a norm is 0, the cosine is 0; null vectors are left out.

    Each scan task multiplies its vectors with the queries and hands on its own best k per query, so the shuffle does
    not grow with the vectors in a task. A scan takes PART_BYTES of query vectors to every task; with more queries the
    vectors are scanned once per part, and each part's best are written down before the next is collected.
    """
    kinds = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
    schema = f"{query_key} {kinds[0]}, {key} {kinds[1]}, cosine double"
    rows = queries.select(query_key, F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    size = rows.agg(F.sum(F.size("vector").cast("long") * 8 + 8)).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    if parts > 1:
        rows = cut(rows.withColumn("_part", F.pmod(F.xxhash64(query_key), F.lit(parts)).cast("int")).repartition("_part"))
    best = None
    for p in range(parts):
        part = (rows if parts == 1 else rows.where(F.col("_part") == p)).select(query_key, "vector").toArrow().combine_chunks()
        found = vectors.select(key, F.col(vector).cast("array<double>").alias("_vector")).where("_vector IS NOT NULL").mapInArrow(_best(part, k, query_key, key), schema)
        found = found if parts == 1 else cut(top_k(found, key, k, "cosine", query_key).drop("rank"))
        best = found if best is None else best.union(found)
    return top_k(best, key, k, "cosine", query_key)


def _matrices(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: the places of the lists of that width, and these at unit length (zeros where that cannot be)."""
    out, widths = {}, np.diff(np.asarray(lists.offsets))
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        x = np.asarray(lists.take(pa.array(at)).flatten().fill_null(np.nan), np.float64).reshape(len(at), width)
        x = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0.0)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        out[width] = at, x / np.where(n > 0, n, 1)
    return out


def _best(queries: pa.Table, k: int, query_key: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = queries.column(query_key).combine_chunks() if len(queries) else pa.array([])
        by_width = _matrices(queries.column("vector").combine_chunks()) if len(queries) else {}
        for batch in batches:
            found = _matrices(batch.column(1))
            for width, (of, q) in by_width.items():
                at, x = found.get(width, (np.zeros(0, int), np.zeros((0, width))))
                for lo in range(0, len(q), 256):
                    c = np.zeros((len(q[lo : lo + 256]), batch.num_rows))
                    c[:, at] = q[lo : lo + 256] @ x.T
                    least = np.sort(c, axis=1)[:, -min(k, c.shape[1])][:, None]
                    row, col = np.nonzero(c >= least - 1e-12)  # ties at the cut go on too
                    if len(at) < batch.num_rows:  # of those that are all 0 the first are enough
                        row, col = _few(row, col, c[row, col], batch.column(0), k)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(of[lo + row])), batch.column(0).take(pa.array(col)), pa.array(c[row, col])], names=[query_key, key, "cosine"]
                    )

    return run


def _few(row: np.ndarray, col: np.ndarray, cosine: np.ndarray, keys: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by cosine, ties by key."""
    table = pa.table({"row": row, "cosine": cosine, "key": keys.take(pa.array(col)), "col": col})
    table = table.sort_by([("row", "ascending"), ("cosine", "descending"), ("key", "ascending")])
    row = np.asarray(table.column("row"))
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], np.asarray(table.column("col"))[keep]


def embedding_shape(records: DataFrame) -> DataFrame:
    """One row: model and dimension of the records (the least where they differ); those of the hash model without records."""
    return records.agg(F.coalesce(F.min("embedding_model"), F.lit(HASH_MODEL)).alias("embedding_model"), F.coalesce(F.min("embedding_dimension"), F.lit(128)).alias("embedding_dimension"))


def vector_manifest(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: counts, distinct models and dimensions, and chunks by level, of chunks left-joined with embeddings."""
    joined = chunks.select("chunk_id", "chunk_level").join(embeddings.select("chunk_id", "embedding_model", "embedding_dimension"), "chunk_id", "left")
    return joined.agg(
        F.count("*").alias("n_chunks"),
        F.count("embedding_model").alias("n_embeddings"),
        F.array_sort(F.collect_set("embedding_model")).alias("models"),
        F.array_sort(F.collect_set("embedding_dimension")).alias("dimensions"),
        F.count_if(F.col("chunk_level") == "document").alias("n_document"),
        F.count_if(F.col("chunk_level") == "section").alias("n_section"),
        F.count_if(F.col("chunk_level") == "paragraph").alias("n_paragraph"),
    )


def vector_literal(vector: Column) -> Column:
    """The text form of a vector: [1.0,2.0]."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))
