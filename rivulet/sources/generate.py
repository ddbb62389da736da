"""The synthetic article table for benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, SOURCES, DAYS = 500_000, 50, 730
TOPICS = ("databases", "kotlin", "linux", "security", "ai")


def articles(spark: SparkSession, rows: int = ROWS, as_of: str = "2026-01-01 00:00:00") -> DataFrame:
    """rows articles over 50 sources within two years: 92 % published, 4 % failed, 4 % duplicate. A function of the row number alone."""
    n = F.col("id")
    bucket = n % 100
    status = F.when(bucket < 92, "published").when(bucket < 96, "failed").otherwise("duplicate")
    # a full-period step through the minutes of the two years spreads the dates
    minute = (n * 7919) % (DAYS * 1440)
    return spark.range(1, rows + 1).select(
        "id",
        (n % SOURCES + 1).alias("source_id"),
        F.concat(F.lit("https://bench.example/"), F.md5(n.cast("string").cast("binary"))).alias("canonical_url"),
        F.concat(F.lit("Article "), n.cast("string"), F.lit(" about "), F.element_at(F.array(*map(F.lit, TOPICS)), (n % len(TOPICS) + 1).cast("int"))).alias("title"),
        status.alias("status"),
        (F.expr(f"TIMESTAMP_NTZ '{as_of}'") - F.make_dt_interval(mins=minute.cast("int"))).alias("published_at"),
        (200 + n % 1800).cast("int").alias("word_count"),
    )
