"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all fingerprints within half the radius of itself.
Two fingerprints within the radius share at least one of these variants, so grouping
by variant finds every link. All members of one group lie within the radius of each
other; a group is linked to its least member, which keeps every component whole
without listing pairs. A group has at most as many members as the half-radius ball
(65 for radius 2), so no key can grow with the data.

Rows: any column may be null. A null text counts as empty; a text without words has
fingerprint zero and links like any other. Rows with a null doc_id keep their row and
get the least non-null doc_id of their component (null if there is none). Repeated
rows stay. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glosswork.llm.shared import components, cut, small_batches
from glosswork.llm.wordkit import blocks

SEED = 42
SHINGLE = 3
RADIUS = 2
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LANES = np.uint64(0x0101010101010101)


def _majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row of hashes: the bits set in over half of them. Eight byte lanes count at once."""
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    n = count[full]
    parts = -(-n // 255)  # a byte lane holds up to 255
    piece = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(first[full], parts) + piece * 255
    top = np.cumsum(parts) - parts
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), top, axis=0)
        for j in range(8):
            out[full] |= (2 * sums[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints_of(col: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = []
    for block in blocks(col):
        block.data = FOLD[block.data]
        w = block.words()
        text, start, end = w.joined()
        n = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
        rows = np.repeat(np.arange(len(n)), n)
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(first[-1]) - first[rows] + w.first[rows]
        last = np.minimum(at + shingle - 1, w.first[rows + 1] - 1)
        pieces = map(text.__getitem__, map(slice, start[at].tolist(), end[last].tolist()))
        h = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, int(first[-1]))
        out.append(_majority(h, first))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints_of(batch.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], names=["doc_id", "text_hash", "fp"])


def ball(fp: Column, radius: int, bits: int = 64) -> Column:
    """The array of all values within ``radius`` bits of fp."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in signed])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints: each ball's members to its least one.

    Members of a ball of an odd radius may be one bit too far apart. There, all are tied to the least of those within
    radius // 2 of the centre, which none is too far from; two that are close have a centre to which one of them is as near.
    """
    from pyspark.sql import Window

    spread = distinct.select("fp", F.explode(ball(F.col("fp"), (radius + 1) // 2)).alias("variant"))
    inner = F.bit_count(F.col("fp").bitwiseXOR(F.col("variant"))) <= radius // 2
    least = F.min(F.when(inner, F.col("fp")) if radius % 2 else F.col("fp")).over(Window.partitionBy("variant"))
    return (
        spread.select(F.col("fp").alias("b"), least.alias("a"))
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .distinct()
    )


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash (xxhash64), fp (long) and component_id of every row of docs (doc_id, text)."""
    slim = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = cut(slim.mapInArrow(_fingerprint_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(distinct, radius))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    label = member.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = member.join(label, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "text_hash", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10(spark, sf_dir: str) -> DataFrame:
    """The op10 contract over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id.

    A row goes by its doc_id and text, so another text under the same doc_id stays unless its own component has a
    smaller doc_id. Rows with a null doc_id stay: nothing tells which of them came first.
    """
    found = simhash_components(docs, radius).where("doc_id > component_id")
    drop = found.select(F.col("doc_id").alias("_later_doc"), F.col("text_hash").alias("_later_text")).distinct()
    return docs.join(drop, (docs["doc_id"] == drop["_later_doc"]) & (F.xxhash64(docs["text"]) == drop["_later_text"]), "left_anti")
