"""What the operators share: tables in the shared folder, skew-aware joins, connected components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..operators.skew import attach
from ..session import shared_dir, written


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, so that reused workers keep models between tasks."""
    return sys.__dict__.setdefault("_rivulet_cache", {})


#: Rows that may share one copy of a large row in spread_join().
SHARE = 1000

#: Small rows that one task joins without any dealing, whatever their keys.
FEW_ROWS = 1 << 13

#: Rows of an Arrow batch where whole texts go to Python: a few MB each, in the JVM's direct memory and in the worker.
BATCH_ROWS = 1000


#: Bytes of an Arrow batch: very long texts, or lists, come a few at a time.
BATCH_BYTES = 16 << 20


def small_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, if they are larger. Results are lazy, so it stays so."""
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    if df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        conf.set(size, BATCH_BYTES)


def new_path(spark: SparkSession, label: str) -> str:
    """A name in the folder that driver and executors share, removed when the process ends."""
    return written(spark, f"{shared_dir(spark)}/rivulet/{label}-{uuid.uuid4().hex}")


def plus(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with columns more, by name and DDL type."""
    return StructType([*df.schema.fields, *[StructField(n, DataType.fromDDL(t)) for n, t in columns.items()]])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_joins(left: DataFrame, right: DataFrame, key: str, sides: dict[str, str], share: int = SHARE) -> DataFrame:
    """left (small rows, a written table) joined with the large rows of right (which has each key once) for each of sides.

    sides: column of left -> prefix that the other columns of right get. Nothing is broadcast but numbers: a key with more
    than `share` rows in left gets a copy of its row of right for each such share, among which its rows of left are dealt.
    """
    dealt = left
    need = {}
    for side in sides:
        often = left.groupBy(side).agg(F.count("*").alias("n"))
        need[side] = materialise(often.withColumn(f"_{side}", F.ceil(F.col("n") / share).cast("int")), "join-counts")
        dealt = attach(dealt, need[side], side, "n").withColumn(f"_{side}", F.pmod(F.xxhash64(*left.columns), F.col(f"_{side}")).cast("int"))
    dealt = materialise(dealt, "join-dealt")
    for side, prefix in sides.items():
        own = right.select(F.col(key).alias(side), *[F.col(c).alias(f"{prefix}{c}") for c in right.columns if c != key])
        copies = own.join(need[side].drop("n"), side).withColumn(f"_{side}", F.explode(F.sequence(F.lit(0), F.col(f"_{side}") - 1)))
        dealt = dealt.join(copies, [side, f"_{side}"])
    return dealt.drop(*[f"_{side}" for side in sides])


def _follow(p: DataFrame) -> DataFrame:
    """node, parent of the parent, and the parent before. A parent of very many nodes is split by AQE's skew join."""
    up = p.select(F.col("node").alias("before"), F.col("parent").alias("next"))
    return p.select("node", F.col("parent").alias("before")).join(up, "before").select("node", F.col("next").alias("parent"), "before")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges a, b of one task -> node, root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (nodes, [find(x) for x in nodes])], ["node", "root"])


def connected_components(edges: DataFrame, alone: int = 0) -> DataFrame:
    """(node, root) for every node of edges (a, b, longs); root is the smallest node that can be reached.

    Rounds of hooking: each node takes its smallest neighbour as parent, if that is smaller; parents are followed to the
    end by pointer doubling; edges are then rewritten between the roots. A round leaves only local minima as roots, so
    the number of rounds is logarithmic. Minima are pre-aggregated before the shuffle; each step is written to the
    shared folder. Up to `alone` distinct edges are united in one task instead: rounds over few edges take a dozen plans, which
    the driver keeps memory for.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    e = materialise(e, "cc-edges")
    if alone and e.count() <= alone:
        return materialise(e.coalesce(1).mapInArrow(_united, "node long, root long"), "cc-roots")
    roots = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        p = materialise(p.select("node", F.least("node", "m").alias("parent")), "cc-parents")
        while True:
            # two doublings for each written table
            q = _follow(_follow(p.select("node", "parent"))).select("node", "parent", (F.col("parent") != F.col("before")).alias("moved"))
            q = materialise(q, "cc-jump")
            moved = not q.filter("moved").isEmpty()
            p = q.drop("moved")
            if not moved:
                break
        if roots is None:
            roots = p.select("node", F.col("parent").alias("root"))
        else:
            up = p.select(F.col("node").alias("root"), "parent")
            roots = roots.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        to = lambda c: p.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        e = e.join(to("a"), "a").join(to("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).filter("a < b").distinct()
        e = materialise(e, "cc-edges")
    if roots is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialise(roots, "cc-roots")
