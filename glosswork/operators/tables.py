"""Table service over Parquet: keyed upsert and replacement, search and pages, views, catalog checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.lineage import cut
from glosswork.sources.files import exists, latest


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows of source in place of those with the same keys."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source)


def replace_by_key(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """All rows of each key in source replace all rows of that key in target (delete, then insert)."""
    return upsert(target, source, [key])


def write_table(df: DataFrame, path: str) -> None:
    """A staged overwrite: the new files are complete before the old ones go. Readers never see half a table; a stop
    between the two renames leaves the old one beside its place, and ``recover`` or the next write puts it back."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged, old = f"{path.rstrip('/')}.next", f"{path.rstrip('/')}.last"
    df.write.mode("overwrite").parquet(staged)
    recover(spark, path)
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(staged), hadoop(path))
    fs.delete(hadoop(old), True)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts a table back that a stopped ``write_table`` has left beside its place; whether it had to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = f"{path.rstrip('/')}.last"
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(hadoop(path)) and fs.exists(hadoop(old)) and bool(fs.rename(hadoop(old), hadoop(path)))


#: Buckets of a table that is synchronised by key; the name of its partition column begins with MARK and tells their number.
BUCKETS, MARK = 64, "bucket_of_"


def _in_buckets(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return df.withColumn(f"{MARK}{n}", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def _write_buckets(df: DataFrame, path: str, n: int, **options: str) -> None:
    """Rows go to tasks by bucket; Spark splits a bucket that is too large for one."""
    df.hint("rebalance", f"{MARK}{n}").write.mode("overwrite").options(**options).partitionBy(f"{MARK}{n}").parquet(path)


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], n: int = BUCKETS) -> None:
    """A new table for ``sync``: partitions are buckets of the keys' hash."""
    _write_buckets(_in_buckets(df, keys, n), path, n)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.startswith(MARK)])


def sync(source: DataFrame, path: str, keys: Sequence[str], n: int = BUCKETS) -> None:
    """All rows of each key in source replace all rows of that key in the table, which is made if it is not there.

    Only the buckets that the keys of source fall into are read and written, by dynamic partition overwrite: the new
    files are complete before a bucket's old ones go. A stop meanwhile leaves each bucket old or new, and the same sync
    once more ends the work. The list of touched buckets, at most ``n`` numbers, comes to the driver. A key with very many
    rows is no problem: the anti-join is split where it is skewed, and so is the bucket when it is written.
    """
    spark = source.sparkSession
    if not exists(spark, path):
        return write_buckets(source, path, keys, n)
    target = spark.read.parquet(path)
    column = next((c for c in target.columns if c.startswith(MARK)), None)
    if column is None:
        raise ValueError(f"{path} is not kept in buckets; write it with write_buckets once")
    n = int(column.removeprefix(MARK))
    source = cut(_in_buckets(source, keys, n))
    touched = [r[0] for r in source.select(column).distinct().collect()]
    if touched:
        merged = upsert(target.where(F.col(column).isin(touched)), source.select(target.columns), list(keys))
        _write_buckets(merged, path, n, partitionOverwriteMode="dynamic")


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows where any column, as lower-case text, is LIKE %text%; an empty text is no filter, % and _ are wild."""
    wanted = text.strip().lower()
    if not wanted:
        return df
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.lower(F.col(c).cast("string")).like(f"%{wanted}%")
    return df.where(F.coalesce(condition, F.lit(False)))


@dataclass(frozen=True)
class Entity:
    """How a table is listed: key, shown and searched columns, order."""

    key: str
    shown: tuple[str, ...]
    searched: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]  # column and whether it falls
    masked: tuple[str, ...] = ()


def list_records(df: DataFrame, entity: Entity, text: str = "", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the found rows in a total order, and their count (one row)."""
    found = search(df, entity.searched, text)
    order = [F.col(c).desc() if falls else F.col(c) for c, falls in entity.order] + [F.col(entity.key)]
    return found.select(*entity.shown).orderBy(*order).offset(offset).limit(limit), found.agg(F.count("*").alias("total"))


def get_record(df: DataFrame, entity: Entity, key) -> DataFrame:
    """The row with that key, long columns masked."""
    row = df.where(F.col(entity.key) == key).limit(1)
    return row.withColumns({c: F.concat(F.lit("<"), F.size(c).cast("string"), F.lit(" values>")) for c in entity.masked})


def alias_rows(companies: DataFrame) -> DataFrame:
    """(ticker, alias, alias_norm, position): name and aliases, the first of equal folded forms."""
    names = F.concat(F.array("company_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = companies.select("ticker", F.posexplode(names).alias("position", "alias")).withColumn("alias_norm", F.lower(T.ascii_fold(T.normalize_text(F.col("alias")))))
    rows = rows.where("alias_norm <> ''")
    first = Window.partitionBy("ticker", "alias_norm").orderBy("position")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def company_payload(companies: DataFrame) -> DataFrame:
    """Companies with the defaults of the dictionary table."""
    return companies.withColumns({"exchange": F.coalesce("exchange", F.lit("UNKNOWN")), "status": F.coalesce("status", F.lit("ACTIVE"))})


def search_view(companies: DataFrame, aliases: DataFrame, key: str = "ticker") -> DataFrame:
    """Each company with its aliases in order; an empty array without any."""
    grouped = aliases.groupBy(key).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return companies.join(grouped, key, "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def search_aliases(view: DataFrame, text: str, columns: Sequence[str], order: str, limit: int | None = None) -> DataFrame:
    """Rows where a column or any alias is LIKE %text%, in order."""
    like = f"%{text.strip().lower()}%"
    condition = F.exists("aliases", lambda a: F.lower(a).like(like))
    for c in columns:
        condition = condition | F.lower(F.col(c)).like(like)
    rows = view.where(condition).orderBy(order)
    return rows if limit is None else rows.limit(limit)


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return latest(df, [key], order)


def semi_synced(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that have chunks, and successful embeddings: what the store takes."""
    return documents.join(chunks.select("article_id"), "article_id", "left_semi"), embeddings.where("status = 'success'")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows that a foreign key would refuse."""
    return child.join(parent.select(F.col(parent_key or key).alias(key)), key, "left_anti")


def summary(spark: SparkSession) -> DataFrame:
    """Tables and views of the catalog, by name."""
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean").orderBy("name")


def healthcheck(spark: SparkSession, *paths: str) -> bool:
    """Whether the session answers and all paths are there."""
    return spark.sql("SELECT 1").first()[0] == 1 and all(exists(spark, p) for p in paths)


def split_statements(script: str) -> list[str]:
    """SQL statements between semicolons, not those inside quotes."""
    out, start, quote = [], 0, ""
    for i, c in enumerate(script):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            out.append(script[start:i])
            start = i + 1
    return [s.strip() for s in [*out, script[start:]] if s.strip()]


def bootstrap(spark: SparkSession, script: str) -> int:
    """Runs a DDL script; the number of its statements."""
    statements = split_statements(script)
    for s in statements:
        spark.sql(s)
    return len(statements)
