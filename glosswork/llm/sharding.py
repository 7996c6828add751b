"""Longest-processing-time sharding of groups that must stay together.

Groups are rows with equal texts (null is its own group). Sorted by falling size, each
goes to the shard with the least load so far, found through a heap.

The heap runs on the driver, over a number of units that does not grow with the table:
a group of at least 1/UNITS of all bytes is a unit of its own (there are at most UNITS
of these), and smaller groups are gathered by a hash of their text into UNITS bins, each
a unit. So shards differ by about one unit, or by what the largest group forces.
Only the table of units is broadcast: at most 2 * UNITS rows of a digest and a number.

Slots count the rows of a shard from 0 without gaps, in order of hash cells of the rows
and of doc_id, text and further columns inside a cell; the number of cells is fixed and
their sizes are summed before ranking, so no task orders a whole shard.

Rows: nulls in any column are allowed; a null text has size 1. Repeated rows get slots
of their own. Extra columns are ignored. An empty table gives an empty result. Equal
sizes are taken in order of their unit's digest.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
UNITS = 1 << 15
CELLS = 512


def longest_first(sizes: list[tuple], shards: int) -> dict:
    """(key, size) pairs to shards: falling size, ties by key, least-loaded shard first, ties by its number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    digest = F.when(F.col("text").isNull(), F.lit("")).otherwise(F.sha2("text", 256))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        digest.alias("digest"),
        F.pmod(F.xxhash64(digest), F.lit(units)).cast("int").alias("bin"),
        F.xxhash64("doc_id", "text").alias("order"),
    )
    groups = rows.groupBy("digest", "bin").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    own = F.col("bytes") * units >= F.lit(total).cast("decimal(38,0)")
    sized = groups.groupBy(F.when(own, F.col("digest")).alias("alone"), F.when(~own, F.col("bin")).alias("bin")).agg(F.sum("bytes").alias("bytes"))
    loads = [((r["alone"] or "", -1 if r["bin"] is None else r["bin"]), r["bytes"]) for r in sized.collect()]
    plan = longest_first(loads, shards)
    alone = spark.createDataFrame([(k[0], s) for k, s in plan.items() if k[1] < 0], "digest string, own_shard int")
    bins = spark.createDataFrame([(k[1], s) for k, s in plan.items() if k[1] >= 0], "bin int, bin_shard int")
    placed = (
        rows.join(F.broadcast(alone), "digest", "left")
        .join(F.broadcast(bins), "bin", "left")
        .withColumn("shard", F.coalesce("own_shard", "bin_shard"))
        .withColumn("cell", F.pmod(F.col("order"), F.lit(CELLS)).cast("int"))
    )
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard",
        "cell",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"),
    )
    inside = Window.partitionBy("shard", "cell").orderBy("order", "doc_id", "digest")
    return (
        placed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(before), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot"))
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """The op7 contract over the whole documents table, under the law ``bytes``."""
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
