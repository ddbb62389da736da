"""The periodic jobs as Structured Streaming queries.

Sweeps and queues are single-writer micro-batches over versioned snapshots: a late row that is earlier than a known one
must win, so no watermark drops it. Health windows are event-time windows with a watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import dedup
from ..session import shared_dir

#: Seconds from the end of a run to the next one (fixed values), for cycle.run().
EVERY = {"enqueue": 60, "work": 15, "extract": 300, "dedup": 60, "reap": 120}


def read_files(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def read_table_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stream of a Parquet table that is a folder of files or one file (which a stream can only take from its folder)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    schema = spark.read.parquet(f"{folder}/{name}").schema
    if single:
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return read_files(spark, f"{folder}/{name}", schema)


class Snapshots:
    """A table as numbered folders; a batch writes the next one and a reader takes the last whole one.

    The number is that of the micro-batch, so a batch that is run again overwrites its own folder only. The folder before
    the one that a batch reads is removed: that batch can't be run again any more.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema
        self.last: int | None = None

    def read(self, before: int | None = None) -> DataFrame:
        n = self.last if before is None else before - 1
        if n is None or n < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{n}")

    def write(self, n: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{n}")
        self.last = n
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{n - 2}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


def run_on_snapshots(stream: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType, folder: str | None = None, every: int | None = None) -> tuple[StreamingQuery, Snapshots]:
    """Each micro-batch makes the next snapshot: step(snapshot, batch). every: seconds; None takes what is there and ends."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/rivulet/stream-{uuid.uuid4().hex}"
    table = Snapshots(spark, f"{folder}/table", schema)

    def batch(df: DataFrame, n: int) -> None:
        table.write(n, step(table.read(before=n), df))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=f"{every} seconds")
    return writer.start(), table


def dedup_step(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Known and new articles (the first row of an id stays) after a sweep."""
    fresh = batch.dropDuplicates(["id"]).join(snapshot.select("id"), "id", "left_anti")
    return dedup.sweep(snapshot.unionByName(fresh.select(snapshot.columns)))


def enqueue_step(job_type: str, now: Column) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Jobs (source_id, job_type, state, scheduled_at) after requests (source_id): one live job for each source at most."""

    def step(jobs: DataFrame, batch: DataFrame) -> DataFrame:
        live = jobs.filter(F.col("state").isin("pending", "running") & (F.col("job_type") == job_type)).select("source_id")
        fresh = batch.select("source_id").distinct().join(live, "source_id", "left_anti")
        rows = fresh.select("source_id", F.lit(job_type).alias("job_type"), F.lit("pending").alias("state"), now.alias("scheduled_at"))
        return jobs.unionByName(rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in jobs.schema.fields]))

    return step


def health(events: DataFrame, size: str = "6 hours", late: str = "1 hour", time: str = "created_at", every: str | None = None) -> DataFrame:
    """window_start, n, n_errors, avg_ms, max_ms of a log by windows, one after another or a new one `every` so often; works
    on streams and on tables.

    Partial aggregation before the shuffle; state is one row for each open window.
    """
    marked = events.withWatermark(time, late) if events.isStreaming else events
    failed = F.col("error").isNotNull()
    agg = marked.groupBy(F.window(time, size, every).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_errors"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return agg.select(F.col("w.start").alias("window_start"), "n", "n_errors", "avg_ms", "max_ms")


def write_health(stream: DataFrame, folder: str | None = None) -> tuple[StreamingQuery, str]:
    """Closed windows appended as Parquet, each once."""
    folder = folder or f"{shared_dir(stream.sparkSession)}/rivulet/health-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    return q, f"{folder}/out"


def near_pairs_stream(left: DataFrame, right: DataFrame, hours: int = dedup.WINDOW_HOURS, radius: int = dedup.RADIUS) -> DataFrame:
    """loser, winner of two streams of fingerprints (id, published_at, simhash) by a stream-stream join with watermarks.

    A pair that meets in several bands counts in the first of them.

    For feeds in which no row comes later than the window; the snapshot sweep has no such limit.
    """
    from ..functions.simhash import bands, distance

    def cut(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "published_at", "simhash")]).withWatermark(f"{p}_published_at", f"{hours} hours")
        return named.withColumn("b", F.explode(bands(F.col(f"{p}_simhash")))).withColumn("band", F.col("b.band")).withColumn("bits", F.col("b.bits")).drop("b")

    inside = F.expr(f"w_published_at <= l_published_at AND w_published_at > l_published_at - INTERVAL {hours} HOURS")
    met = cut(left, "l").join(cut(right, "w"), ["band", "bits"]).filter(inside & (F.col("band") == dedup.first_band(F.col("l_simhash"), F.col("w_simhash"))))
    earlier = F.struct("w_published_at", "w_id") < F.struct("l_published_at", "l_id")
    return met.filter(earlier & (distance(F.col("w_simhash"), F.col("l_simhash")) <= radius)).select(F.col("l_id").alias("loser"), F.col("w_id").alias("winner"))


RATE = "host string, id long, start double"


def rate_limit_stream(requests: DataFrame, gap: float = 3.0) -> DataFrame:
    """host, id, start of a stream of requests (host, id, arrival in seconds): a start waits for the one before it.

    The state of a host is the end of its last gap, one number for each host.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(frames).sort_values(["arrival", "id"])
        starts = []
        for t in rows["arrival"]:
            starts.append(max(t, free))
            free = starts[-1] + gap
        state.update((free,))
        yield pd.DataFrame({"host": key[0], "id": rows["id"], "start": starts})

    return requests.groupBy("host").applyInPandasWithState(step, RATE, "free double", "append", GroupStateTimeout.NoTimeout)
