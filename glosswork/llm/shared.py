"""Helpers that several operators share: Arrow batch size, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.lineage import cut, new_path, remove, shared_dir
from glosswork.session import BATCH_ROWS, small_batches

__all__ = ["BATCH_ROWS", "components", "cut", "new_path", "remove", "shared_dir", "small_batches"]

def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list that is not itself a root; root is the least node that it reaches.

    Alternates large-star and small-star steps until the edges stand still. Each
    step groups by node with partial aggregation and joins back, so a hub with very
    many neighbours is split by the adaptive skew join. Each round's table is deleted
    once the next one is written. Nulls in either column are ignored. Raises if the
    edges still change after ``rounds`` rounds.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, *spent: str) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        out = cut(df, path)
        for old in spent:
            remove(spark, old)
        return out, path

    now, path = written(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now, path = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
