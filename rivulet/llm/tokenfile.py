"""Operator 3: token ids of documents in Simple-8b files, in ascending doc_id order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simple8b
from .common import new_path, small_batches
from .tokens import Encoder

#: Rows tokenised at once in a Python worker.
ROWS = 500


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write one file for each range of doc_ids into a folder; returns the manifest.

    Without a folder the files lie in the shared one and are removed when the process ends.

    Manifest: part int (ascending with doc_id), path, n_docs, n_ids long. Null and empty texts are the end id alone; a null
    doc_id comes first; rows with the same doc_id each are a document, ordered by a hash of the text and, where that ties, by
    the text; repeated rows have equal ids. Texts of any length are written whole. An empty table gives an empty manifest.
    Other columns are ignored, whatever their names. Texts are dealt out by ranges of doc_id and that hash, so neither a hot
    source nor one id with very many rows is one task's. A lost task writes the same file again and moves it into place whole.
    """
    small_batches(docs)
    folder = folder or new_path(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = Encoder.of(tokenizer, True)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/part-{part:06d}.s8b"
        with simple8b._open(path, "w") as f:
            out = simple8b.Writer(f)

            def feed(batch: pa.RecordBatch) -> None:
                for lo in range(0, batch.num_rows, ROWS):
                    piece = batch.slice(lo, ROWS)
                    for doc, ids in zip(piece.column(0).to_pylist(), encoder(piece.column(1).to_pylist()), strict=True):
                        out.add(doc, np.append(ids, np.asarray(end_id, ids.dtype)))

            feed(first)
            for batch in batches:
                feed(batch)
            out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(out.docs)], "n_ids": [out.n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    # one row for each partition, as read_token_files() needs them on the driver anyway
    manifest = "part int, path string, n_docs long, n_ids long"
    return docs.sparkSession.createDataFrame(placed.mapInArrow(write, manifest).collect(), manifest)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian uint32) of each document, from the files.

    Only the sums of the files are brought to the driver: one row for each partition of the writer.
    """
    spark = manifest.sparkSession
    files = sorted((r["part"], r["path"], r["n_ids"]) for r in manifest.collect())
    base, rows = 0, []
    for part, path, n in files:
        rows.append((part, path, base))
        base += n
    listed = spark.createDataFrame(rows, "part int, path string, base long")
    if rows:
        listed = listed.repartitionByRange(len(rows), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with simple8b._open(row["path"], "r") as f:
                    docs, starts, ids, held = [], [], [], 0
                    for doc, start, x in simple8b.Reader(f).documents():
                        docs.append(doc)
                        starts.append(row["base"] + start)
                        ids.append(x.astype("<u4").tobytes())
                        held += len(ids[-1])
                        if held > 4 << 20:
                            yield _rows(docs, starts, ids)
                            docs, starts, ids, held = [], [], [], 0
                    if docs:
                        yield _rows(docs, starts, ids)

    return listed.mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(docs: list, starts: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])


def digest(read: DataFrame) -> DataFrame:
    """The ids of each document as n_tokens and ids_crc32; crc32 is computed in the JVM."""
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
