"""Integrity rules of the data model as queries that list violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE_KINDS = ("rss", "atom", "html", "api")
ARTICLE_STATES = ("discovered", "fetching", "extracted", "published", "failed", "duplicate")
JOB_STATES = ("pending", "running", "succeeded", "failed", "dead")

SOURCE_RULES = {
    "interval at least 60": lambda: F.col("crawl_interval_sec") >= 60,
    "rate positive": lambda: F.col("rate_limit_per_min") > 0,
    "feed kinds have a feed": lambda: ~F.col("kind").isin("rss", "atom") | F.col("feed_url").isNotNull(),
    "kind known": lambda: F.col("kind").isin(*SOURCE_KINDS),
    "config is an object": lambda: F.trim("config").startswith("{") & F.try_parse_json("config").isNotNull(),
    "language of two letters": lambda: F.length("language") == 2,
}
ARTICLE_RULES = {
    "word count not negative": lambda: F.col("word_count").isNull() | (F.col("word_count") >= 0),
    "not its own duplicate": lambda: ~F.col("duplicate_of_id").eqNullSafe(F.col("id")) | F.col("id").isNull(),
    "a duplicate has a target": lambda: (F.col("status") != "duplicate") | F.col("duplicate_of_id").isNotNull(),
    "attempts not negative": lambda: F.col("extract_attempts") >= 0,
    "status known": lambda: F.col("status").isin(*ARTICLE_STATES),
}
JOB_RULES = {
    "attempts within bounds": lambda: F.col("attempt").between(0, F.col("max_attempts")),
    "state known": lambda: F.col("state").isin(*JOB_STATES),
}


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """rule, n: how many rows break each rule (a rule that gives null is kept). One pass."""
    names = list(rules)
    checks = [F.count_if(~F.coalesce(rules[n](), F.lit(True))).alias(f"c{i}") for i, n in enumerate(names)]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)]))
    return df.agg(*checks).select(pairs.alias("r")).select("r.rule", "r.n")


def not_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once; keys with a null are no keys."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(known).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key has no row in parent; null keys are no orphans."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def live_jobs_over_one(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("state").isin("pending", "running")).groupBy("source_id", "job_type").agg(F.count("*").alias("n")).filter("n > 1")


def out_of_unit(df: DataFrame, column: str) -> DataFrame:
    c: Column = F.col(column)
    return df.filter(c.isNotNull() & ~c.between(0, 1))


def health_by_source(log: DataFrame) -> DataFrame:
    """source_id, n, success_rate, p50_ms, p99_ms, max_ms of a crawl log. The percentiles interpolate between two attempts."""
    ok = F.count_if(F.col("error").isNull()) / F.count("*")
    p = lambda q: F.percentile("duration_ms", F.lit(q))
    return log.groupBy("source_id").agg(F.count("*").alias("n"), ok.alias("success_rate"), p(0.5).alias("p50_ms"), p(0.99).alias("p99_ms"), F.max("duration_ms").alias("max_ms"))


def queue_depth(jobs: DataFrame, now: Column) -> DataFrame:
    """job_type, pending, due, running, expired, oldest_due: what waits, and since when, for each kind of job."""
    due = (F.col("state") == "pending") & (F.col("scheduled_at") <= now)
    expired = (F.col("state") == "running") & (F.col("locked_until") < now)
    return jobs.groupBy("job_type").agg(
        F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(due).alias("due"), F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.coalesce(expired, F.lit(False))).alias("expired"), F.min(F.when(due, F.col("scheduled_at"))).alias("oldest_due"),
    )


def hosts_by_source(urls: DataFrame, host: Column) -> DataFrame:
    """source_id, urls, hosts: over how many hosts the addresses of a source are spread."""
    return urls.groupBy("source_id").agg(F.count("*").alias("urls"), F.countDistinct(host).alias("hosts"))


def sampled(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """The rows whose key falls into so many of a hundred shares by MD5: the same rows at every run and in every engine."""
    share = F.conv(F.left(F.md5(key.cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long") % 100
    return df.filter(share < percent)
