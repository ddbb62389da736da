"""Session settings shared by every entry point."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def build(master: str | None = None, partitions: int | None = None, app: str = "rivulet") -> SparkSession:
    """A session with UTC time and AQE. On a cluster the master and sizes come from spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return make_importable(b.getOrCreate())


def make_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package, whatever folder the driver runs in.

    On a cluster the package is installed or sent with --py-files; the extra path entry is then harmless.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, path]) if path else ROOT
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it comes in fewer than half of that (one small file, mostly).

    For tables that expensive functions run over. A table of many files has more partitions than that and is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session may do without: it gets a folder of this process, which is removed at its end. Elsewhere that would
    split the data over the machines, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="rivulet-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return _LOCAL


_LOCAL: str | None = None
#: Tables written in this process, by session; removed with forget_written() or when the process ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


def written(spark: SparkSession, path: str) -> str:
    """Note a table that only this run needs."""
    if not _WRITTEN:
        atexit.register(forget_written)
    _WRITTEN.append((spark, path))
    return path


def forget_written() -> None:
    """Remove the noted tables from the shared folder. What was not computed to the end by now can't be any more."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: nothing can be reached any more
            _WRITTEN.clear()


def store(df: DataFrame, label: str) -> DataFrame:
    """df as a written table in the shared folder: what it took to compute is not done again, nor lost with an executor."""
    path = written(df.sparkSession, f"{shared_dir(df.sparkSession)}/rivulet/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
