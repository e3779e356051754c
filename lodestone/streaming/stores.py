"""Streams into stores that a repeated batch leaves as they are: run records by upsert, logs by append, vectors batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.sources.shared import Folder
from lodestone.sources.stores import RUNS, missing_vectors, upserted_runs

BUCKETS = 64


class RunStore:
    """Run records in folders path/batch=N/bucket=B; of a bucket's finished versions the newest counts.

    A batch writes only the buckets that its jobs fall into, under its own number, and is finished with its _SUCCESS file. So a
    batch that comes again changes nothing, one that broke off is written anew, and readers never see half of one. One stream writes a store.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.folder = Folder(spark, self.path)

    def batches(self) -> list[int]:
        """Finished batches, oldest first."""
        found = [int(n.split("=")[1]) for n in self.folder.names() if n.startswith("batch=")]
        return sorted(n for n in found if self.folder.has(f"batch={n}/_SUCCESS"))

    def _versions(self, before: int | None = None) -> dict[str, str]:
        newest = {}
        for batch in self.batches():
            if before is None or batch < before:
                newest |= {b: f"{self.path}/batch={batch}/{b}" for b in self.folder.names(f"batch={batch}") if b.startswith("bucket=")}
        return newest

    def read(self, buckets: set[str] | None = None, before: int | None = None) -> DataFrame:
        """The records, or those of some buckets as they were before a batch."""
        paths = [p for b, p in self._versions(before).items() if buckets is None or b in buckets]
        return self.spark.read.schema(RUNS).parquet(*paths) if paths else self.spark.createDataFrame([], RUNS)

    def upsert(self, new: DataFrame, batch: int) -> bool:
        """Take a batch in; whether it was new. Rows without a job_id are left out."""
        if batch in self.batches():
            return False
        bucket = F.pmod(F.xxhash64("job_id"), F.lit(self.buckets)).cast("int")
        new = new.filter("job_id IS NOT NULL")
        touched = {f"bucket={r.b}" for r in new.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` numbers
        kept = upserted_runs(self.read(touched, batch), new).withColumn("bucket", bucket)
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        return True

    def vacuum(self) -> int:
        """Remove bucket versions that newer ones replace; returns how many. Not while readers are on older ones."""
        live, gone = set(self._versions().values()), 0
        for batch in self.batches():
            for name in self.folder.names(f"batch={batch}"):
                if name.startswith("bucket=") and f"{self.path}/batch={batch}/{name}" not in live:
                    self.folder.remove(f"batch={batch}/{name}")
                    gone += 1
        return gone

    def follow(self, updates: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Upsert a stream of run records, batch by batch."""
        writer = updates.writeStream.foreachBatch(lambda rows, n: self.upsert(rows, n)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def job_updates(events: DataFrame) -> DataFrame:
    """Run records out of an append-only log (job_id, ts, kind, stage, progress, error): status, times and stage as each event leaves them.

    kind is queued, started, progress, finished or failed. Works on a stream: a row an event, which upserts put together.
    """
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ended = F.col("kind").isin("finished", "failed")
    status = F.when(F.col("kind") == "queued", "queued").when(F.col("kind") == "finished", "succeeded").when(F.col("kind") == "failed", "failed").otherwise("running")
    made = {
        "status": status, "started_at": F.when(F.col("kind") == "started", at), "finished_at": F.when(ended, at), "created_at": F.when(F.col("kind") == "queued", at),
        "updated_at": at, "query": F.lit(None).cast("string"), "run_kind": F.lit("run"),
    }
    rows = events.select("job_id", "stage", F.col("progress").cast("double").alias("progress"), "error", *[c.alias(n) for n, c in made.items()]).withColumnRenamed("run_kind", "kind")
    return rows.select([c.split()[0] for c in RUNS.split(", ")])


Embed = Callable[[DataFrame], DataFrame]


def build_vectors(papers: DataFrame, path: str, key: str, embed: Embed, checkpoint: str) -> StreamingQuery:
    """Embed a stream of papers (key, title, abstract) into path/batch=N, all that is there now. embed: (key, text) -> (key, embedding).

    A batch is a few input files (maxFilesPerTrigger of the stream). Its vectors are written under its number before the
    checkpoint takes it as done, so a build that is stopped loses the batch under way at most, and one that comes again is
    overwritten, not added. Papers whose vector an earlier batch has are not embedded again.
    """

    def add(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        folder = Folder(spark, path)
        done = [f"{path}/{b}" for b in folder.names() if b.startswith("batch=") and b != f"batch={n}" and folder.has(f"{b}/_SUCCESS")]
        known = spark.read.parquet(*done).select(key) if done else spark.createDataFrame([], f"`{key}` {dict(rows.dtypes)[key]}")
        todo = missing_vectors(rows.dropDuplicates([key]), known, key).select(key, "text")
        embed(todo).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return papers.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vectors of all finished batches, or None without any."""
    folder = Folder(spark, path)
    done = [f"{path}/{b}" for b in folder.names() if b.startswith("batch=") and folder.has(f"{b}/_SUCCESS")]
    return spark.read.parquet(*done) if done else None
