"""The durable job queue as snapshot -> snapshot functions. `now` is always a parameter.

Jobs: id, source_id, job_type, state, attempt, max_attempts, scheduled_at, started_at, finished_at, locked_by,
locked_until, last_error. pending -> running -> succeeded | pending | dead; an expired lease counts as a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEED, ARTICLE = "fetch_feed", "fetch_article"
LEASE_SECONDS = {FEED: 300, ARTICLE: 900}
BATCH = 10
RETRY_BASE, RETRY_MAX = 60, 3600
ERROR = 2000


def _plus(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def live(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("state").isin("pending", "running"))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    return sources.filter(F.col("enabled") & F.col("feed_url").isNotNull() & (F.col("next_crawl_at") <= now))


def enqueue_due(jobs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """source_id, job_type, scheduled_at of new feed jobs: due sources without a pending or running one."""
    taken = live(jobs).filter(F.col("job_type") == FEED).select("source_id").distinct()
    due = due_sources(sources, now).select(F.col("id").alias("source_id"))
    return due.join(taken, "source_id", "left_anti").select("source_id", F.lit(FEED).alias("job_type"), F.lit("pending").alias("state"), now.alias("scheduled_at"))


def enqueue_extraction(jobs: DataFrame, sources: DataFrame, articles: DataFrame, content: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """New extraction jobs: enabled sources with at least one article that waits for content."""
    waiting = articles.filter((F.col("status") != "duplicate") & (F.col("extract_attempts") < max_attempts)).join(content.select(F.col("article_id").alias("id")), "id", "left_anti").select("source_id")
    taken = live(jobs).filter(F.col("job_type") == ARTICLE).select("source_id").distinct()
    own = sources.filter("enabled").select(F.col("id").alias("source_id"))
    return own.join(waiting, "source_id", "left_semi").join(taken, "source_id", "left_anti").select("source_id", F.lit(ARTICLE).alias("job_type"), F.lit("pending").alias("state"), now.alias("scheduled_at"))


def _changed(jobs: DataFrame, columns: list[str], hit: Column, values: dict[str, Column]) -> DataFrame:
    """jobs with the new values where `hit`, each in the type it had."""
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    return jobs.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in values else F.col(c) for c in columns])


def _freed(values: dict[str, Column]) -> dict[str, Column]:
    return values | {c: F.lit(None) for c in ("locked_by", "locked_until")}


def claimable(jobs: DataFrame, job_type: str, now: Column) -> DataFrame:
    return jobs.filter((F.col("state") == "pending") & (F.col("job_type") == job_type) & (F.col("scheduled_at") <= now) & (F.col("attempt") < F.col("max_attempts")))


def claim(jobs: DataFrame, worker: str, job_type: str, now: Column, batch: int = BATCH, lease: int | None = None, workers: int = 1, shard: int = 0) -> DataFrame:
    """The snapshot after one worker took the oldest claimable jobs; ties by id.

    With several workers each takes from its own shard of ids, so that no two take the same job.
    """
    own = claimable(jobs, job_type, now).filter(F.pmod(F.col("id"), F.lit(workers)) == shard)
    taken = F.broadcast(own.orderBy("scheduled_at", "id").limit(batch).select("id", F.lit(True).alias("_taken")))
    until = _plus(now, F.lit(LEASE_SECONDS[job_type] if lease is None else lease))
    held = {"state": F.lit("running"), "attempt": F.col("attempt") + 1, "started_at": now, "locked_by": F.lit(worker), "locked_until": until}
    return _changed(jobs.join(taken, "id", "left"), jobs.columns, F.coalesce("_taken", F.lit(False)), held)


def claimed(jobs: DataFrame, sources: DataFrame, worker: str) -> DataFrame:
    """The running jobs of a worker with what it needs to know of their sources."""
    s = sources.select(F.col("id").alias("source_id"), "slug", "feed_url", "config", "http_etag", "http_last_modified")
    return jobs.filter((F.col("state") == "running") & (F.col("locked_by") == worker)).join(s, "source_id", "left")


def succeed(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Jobs of ids are done: no lease and no error is left."""
    joined = jobs.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    done = _freed({"state": F.lit("succeeded"), "finished_at": now, "last_error": F.lit(None)})
    return _changed(joined, jobs.columns, F.coalesce("_hit", F.lit(False)), done)


def retry_or_dead(attempt: Column, max_attempts: Column) -> Column:
    return F.when(attempt >= max_attempts, "dead").otherwise("pending")


def fail(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """failures: id, error, retry_at. Dead after the last attempt, else pending again at retry_at."""
    f = failures.select("id", F.left("error", F.lit(ERROR)).alias("_error"), F.col("retry_at").alias("_retry"), F.lit(True).alias("_hit"))
    dead = F.col("attempt") >= F.col("max_attempts")
    later = F.when(dead, F.col("scheduled_at")).otherwise(F.col("_retry"))
    values = _freed({"state": retry_or_dead(F.col("attempt"), F.col("max_attempts")), "finished_at": F.when(dead, now), "scheduled_at": later, "last_error": F.col("_error")})
    return _changed(jobs.join(f, "id", "left"), jobs.columns, F.coalesce("_hit", F.lit(False)), values)


def fail_with_backoff(jobs: DataFrame, failures: DataFrame, now: Column, seed: int) -> DataFrame:
    """failures: id, error. As fail(), each retried after job_delay() of its attempts with a jitter drawn by id and seed."""
    spread = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    known = failures.join(jobs.select("id", "attempt"), "id")
    return fail(jobs, known.select("id", "error", _plus(now, job_delay(F.col("attempt"), jitter(spread))).alias("retry_at")), now)


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over become pending, or dead if they have no attempt left; an error is kept."""
    hit = (F.col("state") == "running") & (F.col("locked_until") < now)
    dead = F.col("attempt") >= F.col("max_attempts")
    values = {"state": retry_or_dead(F.col("attempt"), F.col("max_attempts")), "finished_at": F.when(dead, now).otherwise(F.col("finished_at")), "last_error": F.coalesce("last_error", F.lit("lease expired"))}
    return _changed(jobs, jobs.columns, F.coalesce(hit, F.lit(False)), _freed(values))


def job_delay(attempt: Column, jitter: Column | None = None, base: int = RETRY_BASE, most: int = RETRY_MAX) -> Column:
    """Seconds until the next try: base doubled for each attempt, capped, times a jitter of 0.5 to 1, at least 1."""
    plain = F.least(base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(most)))
    return F.greatest((plain * (F.lit(1.0) if jitter is None else jitter)).cast("long"), F.lit(1).cast("long"))


def source_delay(failures: Column, base: int = RETRY_BASE, most: int = RETRY_MAX) -> Column:
    """Seconds that a failing source rests: base doubled up to ten times, capped."""
    return F.least(base * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(10))), F.lit(float(most))).cast("long")


def jitter(draw: Column) -> Column:
    """0.5 to 1 from a draw of 0 to 1."""
    return draw * 0.5 + 0.5


def record_outcome(sources: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """outcomes: id, kind (success, failure, deferred), seconds (of a deferral). Reschedules the sources.

    Success: next crawl after the interval, no failures. Failure: one more failure, rest by source_delay(). Deferred, as
    by robots rules: later, and not counted as a failure.
    """
    o = outcomes.select("id", F.col("kind").alias("_kind"), F.col("seconds").alias("_seconds"))
    joined = sources.join(o, "id", "left")
    failures = F.when(F.col("_kind") == "success", 0).when(F.col("_kind") == "failure", F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    wait = F.when(F.col("_kind") == "success", F.col("crawl_interval_sec").cast("long")).when(F.col("_kind") == "failure", source_delay(F.col("consecutive_failures") + 1)).when(F.col("_kind") == "deferred", F.col("_seconds").cast("long"))
    v = {
        "next_crawl_at": F.when(wait.isNotNull(), _plus(now, wait)).otherwise(F.col("next_crawl_at")),
        "consecutive_failures": failures,
        "last_crawled_at": F.when(F.col("_kind").isin("success", "failure"), now).otherwise(F.col("last_crawled_at")),
    }
    return joined.select(*[v[c].cast(sources.schema[c].dataType).alias(c) if c in v else F.col(c) for c in sources.columns])


def log_rows(attempts: DataFrame, now: Column) -> DataFrame:
    """One row for each HTTP attempt, for an append; errors are clipped."""
    return attempts.select("job_id", "source_id", "http_status", F.lit(None).cast("long").alias("bytes"), "duration_ms", "items_found", "items_new", F.left("error", F.lit(ERROR)).alias("error"), now.alias("created_at"))


def append_log(attempts: DataFrame, now: Column, path: str) -> DataFrame:
    """The rows of log_rows() appended to the log table at path, by day; returns the table as it is then."""
    rows = log_rows(attempts, now).withColumn("day", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("day").parquet(path)
    return attempts.sparkSession.read.schema(rows.schema).parquet(path)


def counts_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))
