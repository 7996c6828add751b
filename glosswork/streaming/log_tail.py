"""Tail of growing JSON-line run logs as a stream, and event-time counts.

A file goes on from the byte where the last batch ended, so lines appended to a file that was read before arrive
once. Only complete lines are taken; the rest of a line that is still being written comes with the next batch. The
source keeps one offset per file in the stream's checkpoint and deals the new bytes over tasks, SPLIT bytes each.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from glosswork.sources.files import exists

LOG = "event string, run_id string, level string, step string, status string, message string"
LINES = "path string, position bigint, line string"
# The statuses with which a run ends.
FINAL = ["success", "failed", "canceled", "interrupted"]
#: Bytes of one task; bytes that are read at once.
SPLIT, READ = 64_000_000, 1 << 20


@dataclass
class Range(InputPartition):
    """The lines that begin at bytes from ``start`` on and before ``stop``, of those between ``first`` and ``end``."""

    path: str
    first: int
    start: int
    stop: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def complete(files: fs.FileSystem, path: str, size: int, known: int) -> int:
    """Where the last complete line of a file's first ``size`` bytes ends; ``known`` if none ends after it."""
    with files.open_input_file(path) as file:
        at = size
        while at > known:
            low = max(known, at - READ)
            found = file.read_at(at - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return known


def lines(part: Range) -> Iterator[tuple[int, str]]:
    """Byte position and text of the lines of a range; bytes that are no UTF-8 are replaced."""
    files, path = _open(part.path)
    with files.open_input_file(path) as file:
        at, rest, begin = part.start, b"", part.start
        if part.start > part.first:  # the line that reaches into this range belongs to the range before
            at = begin = part.start - 1
            rest = None
        while at < part.end:
            data = file.read_at(min(READ, part.end - at), at)
            if not data:  # the file was cut short meanwhile
                return
            at += len(data)
            if rest is None:
                cut = data.find(b"\n")
                if cut < 0:
                    continue
                begin, rest, data = at - len(data) + cut + 1, b"", data[cut + 1 :]
            pieces = (rest + data).split(b"\n")
            for piece in pieces[:-1]:
                if begin >= part.stop:
                    return
                yield begin, piece.decode("utf-8", "replace").removesuffix("\r")
                begin += len(piece) + 1
            rest = pieces[-1]
            if begin >= part.stop:
                return


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split, self.ends = path, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = _open(self.path)
        head = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        out = dict(self.ends)
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            if info.is_file and not info.base_name.startswith((".", "_")):
                known = self.ends.get(head + info.path, 0)
                out[head + info.path] = complete(files, info.path, info.size, known) if info.size > known else known
        self.ends = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            out += [Range(path, first, low, min(low + self.split, stop), stop) for low in range(first, stop, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names, rows, size = ["path", "position", "line"], [], 0
        for position, line in lines(partition):
            rows.append((partition.path, position, line))
            size += len(line)
            if len(rows) == 10_000 or size > 4 * READ:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``spark.readStream.format("log_lines").load(folder)``; option ``split``: bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"].rstrip("/"), int(self.options.get("split", SPLIT)))


def tail(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """New lines of the log files below a folder, each once, as parsed columns, with file, byte position and raw line.

    A line that is no JSON object has nulls in the parsed columns."""
    spark.dataSource.register(LogSource)
    new = spark.readStream.format("log_lines").option("split", split).load(path)
    return new.select(F.from_json("line", LOG).alias("r"), "path", "position", "line").select("r.*", "path", "position", "line")


def run_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Everything there is now, then stop; a later call goes on from the checkpoint.

    Each batch writes its rows, and the runs that end in it, to a folder of its own, so a batch that is done again
    after a stop replaces what it wrote. ``after_final`` marks rows that a run's log has behind its final status. Runs
    meet their ends by an equi-join, which splits a run with very many rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, ends = batch.sparkSession, f"{checkpoint}/ends"
        final = batch.where(F.col("run_id").isNotNull() & F.col("status").isin(FINAL))
        final.groupBy("run_id", "path").agg(F.min("position").alias("final_at"), F.min_by("status", "position").alias("final_status")).write.mode("overwrite").parquet(f"{ends}/batch={number}")
        known = finals(spark, checkpoint).groupBy("run_id", "path").agg(F.min("final_at").alias("_final_at"))
        rows = batch.join(known, ["run_id", "path"], "left").withColumn("after_final", F.coalesce(F.col("position") > F.col("_final_at"), F.lit(False)))
        rows.select(*batch.columns, "after_final").write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def finals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """run_id, path, final_at (byte position) and final_status of the runs that have ended, of every batch."""
    kind = "run_id string, path string, final_at bigint, final_status string"
    if not exists(spark, f"{checkpoint}/ends"):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{checkpoint}/ends")


def follow(spark: SparkSession, path: str, output: str, checkpoint: str, runs: list[str], wait: float = 0.5, most: float = 3600.0) -> bool:
    """Tails until all ``runs`` have a final status (True), or for ``most`` seconds (False)."""
    began = time.time()
    while True:
        run_available(tail(spark, path), output, checkpoint)
        left = set(runs) - {r[0] for r in finals(spark, checkpoint).where(F.col("run_id").isin(runs)).select("run_id").distinct().collect()} if runs else set()
        if not left:
            return True
        if time.time() - began > most:
            return False
        time.sleep(wait)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per event type and window; events later than ``late`` are left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
