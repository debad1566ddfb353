"""Run reports as a stream: the latest row per source, and counts over the present state."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import reports


def report_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 8) -> DataFrame:
    """The report log as a stream of files with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_latest(stream: DataFrame, state: str, checkpoint: str, buckets: int = 64, key: str = "source", order: str = "log_id"):
    """Start a query that keeps the latest row per key in `state`, a folder that all executors share.

    Each micro-batch is reduced to its own latest rows (map-side combined) and merged with those buckets of the state only
    that it touches; a bucket is written anew as a whole under the batch's number, so a batch that is repeated after a failure
    overwrites its own output. Read the state with `current`.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = reports.latest(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` rows
        if not touched:
            return
        old = current(spark, state, before=number)
        if old is not None:
            new = new.unionByName(old.where(F.col("bucket").isin(touched)).select(*new.columns))
        keep = tuple(c for c in new.columns if c not in (key, order))
        reports.latest(new, key, order, keep).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """The present state: of each bucket the rows of the last batch that wrote it. None if nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    rows = spark.read.option("basePath", state).parquet(state)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["bucket", "batch"]).drop("batch")


def status_counts(state: DataFrame) -> DataFrame:
    """Counts over the present state: a source whose status changed counts under the new one only."""
    return reports.status_counts(state)


#: Bytes before the offset by which a rewritten file is recognised.
MARK = 128


class Tail:
    """Complete lines appended to a text file since the last call, for one file on the driver; only what is new is read.

    Starts at the end of the file; a line that is not complete yet is kept back, the rest of one that began before the start is
    skipped. A file that was replaced, shortened or rewritten is read again from its beginning; `was_reset` then is true.
    """

    def __init__(self, path: str, whole: bool = False):
        self.path, self.offset, self.rest, self.mark, self.known, self.was_reset = path, 0, b"", b"", None, False
        self.skip = False
        if not whole:
            size, stat = self._look()
            if stat is not None:
                data = self._from(max(0, size - MARK))
                self.offset, self.known, self.mark = size, stat, data
                self.skip = bool(data) and not data.endswith(b"\n")

    def _look(self) -> tuple[int, tuple[int, int] | None]:
        try:
            s = os.stat(self.path)
            return s.st_size, (s.st_dev, s.st_ino)
        except FileNotFoundError:
            return 0, None

    def _from(self, start: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(start)
            return f.read()

    def lines(self) -> list[str]:
        size, stat = self._look()
        self.was_reset = False
        if stat is None:
            self.was_reset = self.known is not None
            self.offset, self.rest, self.mark, self.known, self.skip = 0, b"", b"", None, False
            return []
        # what was read last, and what came behind it
        data = self._from(self.offset - len(self.mark)) if size >= self.offset else b""
        if self.known is not None and (stat != self.known or size < self.offset or not data.startswith(self.mark)):
            self.offset, self.rest, self.mark, self.skip, self.was_reset = 0, b"", b"", False, True
            data = self._from(0)
        new = data[len(self.mark) :]
        self.offset, self.known, self.mark = self.offset + len(new), stat, data[-MARK:]
        *done, self.rest = (self.rest + new).split(b"\n")
        if self.skip and done:
            done, self.skip = done[1:], False
        elif self.skip:
            self.rest = b""
        return [line.decode("utf-8", "replace") for line in done]
