"""Operator 5: packing by concatenate and cut.

Pass one tokenises each partition and keeps a running sum, so each document knows its start among the ids of its
partition; the totals of the partitions, one number each, are summed up on the driver. Pass two adds the start of the
partition and cuts at the multiples of the sequence length. Pieces that touch an edge of their sequence without filling
it are the boundary records: only they are brought together when whole sequences are wanted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .tokens import Encoder

ROWS = 500
#: Bytes of ids in an output batch.
OUT = 4 << 20


def tokenise(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int) -> DataFrame:
    """part, local_start, doc_id, n_tokens, ids (little-endian, 2 or 4 bytes each), written to the shared folder.

    Null text is empty: it becomes the end id alone. Repeated rows are documents of their own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(tokenizer, spaced)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                piece = batch.slice(lo, ROWS)
                ids = [np.append(x, np.asarray(end_id, x.dtype)) for x in encoder(piece.column(1).to_pylist())]
                size = np.array([len(x) for x in ids], np.int64)
                start = at + np.cumsum(size) - size
                at += int(size.sum())
                width = encoder.dtype().itemsize
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(start), piece.column(0), pa.array(size), pa.array([x.astype(f"<u{width}").tobytes() for x in ids], pa.binary())],
                    ["part", "local_start", "doc_id", "n_tokens", "ids"],
                )

    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(encode, "part int, local_start long, doc_id long, n_tokens long, ids binary"), "pack-tokens")


def cut(tokens: DataFrame, length: int = 2048) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (uint32), doc_tokens, sequence_id, offset, boundary.

    boundary: the piece shares its sequence with others.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each partition of pass one
    base, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = at
        at += r["n"]
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, boundary boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            parts, locals_, docs, sizes = (batch.column(k).to_pylist() for k in range(4))
            for i, raw in enumerate(batch.column(4)):
                n, at = sizes[i], base[parts[i]] + locals_[i]
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4")
                done = 0
                while done < n:
                    offset = (at + done) % length
                    take = min(n - done, length - offset)
                    out.append((docs[i], done, take, ids[done : done + take].tobytes(), n, (at + done) // length, offset, take < length))
                    done += take
                    held += 4 * take
                    if held > OUT:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return tokens.select("part", "local_start", "doc_id", "n_tokens", "ids").mapInArrow(pieces, schema)


def pack(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, length: int = 2048) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of `length` ids; only the last one has padding. See cut() for the rows.

    Null and empty texts are the end id alone; texts of any length are cut as often as it takes; rows with null doc_id are
    packed too; repeated rows and rows with the same doc_id, which nothing puts in order, are documents of their own; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    return cut(tokenise(docs, tokenizer, spaced, end_id), length)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (uint32, `length` of them), n_tokens, doc_ids. A group has at most `length` pieces."""
    alone = pieces.filter("not boundary").select("sequence_id", "ids", F.lit(length).cast("long").alias("n_tokens"), F.array("doc_id").alias("doc_ids"))
    met = pieces.filter("boundary").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"), F.sum("length").alias("n_tokens"))
    pad = F.unhex(F.lit(int(pad_id).to_bytes(4, "little").hex()))
    whole = met.select(
        "sequence_id",
        F.aggregate("p", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        "n_tokens",
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
    )
    whole = whole.withColumn("ids", F.concat("ids", F.unhex(F.repeat(F.hex(pad), (F.lit(length) - F.col("n_tokens")).cast("int")))))
    return alone.unionByName(whole)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
