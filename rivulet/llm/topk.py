"""Operator 7: exact top-k by inner product with a columnar branch and bound.

Candidates lie in blocks in vertical layout, one row for each dimension, dealt by norm. Queries lie in blocks too; each pair
of blocks is a piece of work. First all queries meet the block of the largest norms: the k-th best score there is a bar that
holds for every other block, and a block whose largest norm cannot reach the bar of any query of a block is not sent to it.
For a query the products are added up dimension block by dimension block. After each step a candidate
can gain at most the product of the norms of what remains of both vectors; candidates that cannot reach the k-th best
score known so far are dropped and the survivors compacted, so later dimensions are read for few candidates. Dimensions
go in order of their mass among the candidates of a block, the heaviest first, so that little remains early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, spread_joins

#: Vectors in a block of candidates and of queries.
CANDIDATES = 8192
QUERIES = 1024
#: Query blocks that share a copy of the first block, and shares that the list of blocks of one length is sent in.
PER_COPY, SPREAD = 32, 64
#: Dimensions added in one step.
STEP = 16
#: Products of larger components might not be exact in double; such rows lie in blocks of their own, scored with Python integers.
LARGE = 1 << 20


def valid(vector: str = "embedding"):
    """Neither null nor with null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad)


class Best:
    """The k best (score, id) of each query, by score descending and id ascending."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None) -> None:
        """floor: scores that k candidates of each query are known to reach, elsewhere."""
        self.k = k
        self.floor = np.full(queries, -np.inf) if floor is None else floor
        self.score: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def bar(self, q: int) -> float:
        """A score under this can't be among the k best."""
        own = self.score[q]
        return max(self.floor[q], own[-1][0]) if len(own) == self.k else self.floor[q]

    def add(self, q: int, scores: list[int], ids: list[int]) -> None:
        own = self.score[q] + list(zip(scores, ids, strict=True))
        own.sort(key=lambda x: (-x[0], x[1]))
        self.score[q] = own[: self.k]


def search(queries: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> int:
    """Offer all candidates of a block to all queries. queries: n x d; columns: d x m; both hold whole numbers as double.

    ids are vec_ids; rows name rows, so that a query does not meet its own row. Returns how many products were added up.
    """
    dims = np.argsort(-np.square(columns).sum(axis=1), kind="stable") if columns.size else np.arange(len(columns))
    columns, queries = columns[dims], queries[:, dims]
    steps = [slice(lo, lo + STEP) for lo in range(0, len(columns), STEP)]
    # norms of what remains after each step
    mass_c = np.stack([np.sqrt(np.square(columns[s.stop :]).sum(axis=0)) for s in steps]) if steps else np.zeros((0, columns.shape[1]))
    mass_q = np.stack([np.sqrt(np.square(queries[:, s.stop :]).sum(axis=1)) for s in steps]) if steps else np.zeros((0, len(queries)))
    work = 0
    first = queries[:, steps[0]] @ columns[steps[0]] if steps else np.zeros((len(queries), columns.shape[1]))
    for q in range(len(queries)):
        score = first[q]
        live: np.ndarray | None = None  # all
        own = rows != query_rows[q]
        if not own.all():
            live = np.flatnonzero(own)
            score = score[live]
        for n, s in enumerate(steps):
            if n:
                part = columns[s] if live is None else columns[s][:, live]
                score = score + queries[q, s] @ part
                work += part.size
            # what the others can reach is known from the lower bounds as well: the k-th best of score - gain
            gain = mass_q[n, q] * (mass_c[n] if live is None else mass_c[n, live]) * (1 + 1e-9)
            bar = best.bar(q)
            if len(score) > best.k and n + 1 < len(steps):
                low = score - gain
                bar = max(bar, np.partition(low, len(low) - best.k)[len(low) - best.k] - 1e-6)
            stay = score + gain >= bar - 1e-6
            if not stay.all():
                live = np.flatnonzero(stay) if live is None else live[stay]
                score = score[stay]
        if len(score) > best.k:
            at = np.flatnonzero(score >= np.partition(score, len(score) - best.k)[len(score) - best.k])
            live = at if live is None else live[at]
            score = score[at]
        own_ids = ids if live is None else ids[live]
        if len(score) > best.k:  # many ties: the smallest ids
            top = np.lexsort((own_ids, -score))[: best.k]
            score, own_ids = score[top], own_ids[top]
        best.add(q, [int(x) for x in score], own_ids.tolist())
    return work


def _exact(queries: np.ndarray, query_rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """As search(), with Python integers; scores outside 64 bits count as the nearest such number."""
    whole = np.vectorize(int, otypes=[object])
    c = whole(columns) if columns.size else columns.astype(object)
    for q, v in enumerate(whole(queries) if queries.size else queries):
        own = np.flatnonzero(rows != query_rows[q])
        scores = np.clip(v @ c[:, own], -(1 << 63), (1 << 63) - 1).tolist() if len(own) else []
        best.add(q, scores, ids[own].tolist())


#: Numbers of a block take two bytes each if they fit, else four, else eight.
_KINDS = (np.int16, np.int32, np.float64)


def _packed(values: np.ndarray) -> bytes:
    most = np.abs(values).max() if values.size else 0
    kind = next(k for k in _KINDS if k is np.float64 or most <= np.iinfo(k).max)
    return bytes([_KINDS.index(kind)]) + np.ascontiguousarray(values).astype(kind).tobytes()


def _unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, _KINDS[raw[0]], offset=1).astype(np.float64).reshape(dim, -1) if dim else np.zeros((0, 0))


BLOCK = "dim int, wide boolean, block long, n long, most double, columns binary, ids binary, rows binary"


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (dim, wide, norm, vec_id, row, whole) -> blocks of one dim and kind, their numbers in vertical layout."""
    part, made = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        dim, n = table["dim"][0].as_py(), table.num_rows
        flat = table["whole"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
        made += 1
        number = (part << 32) + made
        values = {"dim": dim, "wide": table["wide"][0].as_py(), "block": number, "n": n, "most": table["norm"].to_numpy().max(), "columns": _packed(flat.T), "ids": table["vec_id"].to_numpy().tobytes(), "rows": table["row"].to_numpy().tobytes()}
        return pa.RecordBatch.from_pylist([values], _SCHEMA)

    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            while lo < hi:
                if held and ((held[0].column(0)[0], held[0].column(1)[0]) != (batch.column(0)[lo], batch.column(1)[lo])):
                    yield block()
                take = min(hi - lo, size - sum(b.num_rows for b in held))
                held.append(batch.slice(lo, take))
                lo += take
                if sum(b.num_rows for b in held) == size:
                    yield block()
    if held:
        yield block()


_SCHEMA = pa.schema([("dim", pa.int32()), ("wide", pa.bool_()), ("block", pa.int64()), ("n", pa.int64()), ("most", pa.float64()), ("columns", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary())])


def _blocks(rows: DataFrame, size: int, label: str) -> DataFrame:
    """Rows by length and kind, and by norm, the largest first; equal norms are parted by a hash, so no range is hot."""
    order = ["dim", "wide", F.desc("norm"), F.xxhash64("row")]
    dealt = rows.select("dim", "wide", "norm", "vec_id", "row", "whole").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(dealt.mapInArrow(lambda it: _pack(it, size), BLOCK), label)


def _work(batches: Iterator[pa.RecordBatch], k: int, schema: str) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks -> the best candidates of each query in that block; with `q_floor`, none below it."""
    seeding = schema == "floor"
    for batch in batches:
        for r in batch.to_pylist():
            n, dim = r["q_n"], r["dim"]
            queries = _unpacked(r["q_columns"], dim).T
            columns = _unpacked(r["columns"], dim)
            q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q_rows, rows = np.frombuffer(r["q_rows"], np.int64), np.frombuffer(r["rows"], np.int64)
            best = Best(n, k, np.frombuffer(r["q_floor"]) if r.get("q_floor") else None)
            if r["q_wide"] or r["wide"]:
                _exact(queries, q_rows, columns, ids, rows, best)
            else:
                search(queries, q_ids, q_rows, columns, ids, rows, best)
            if seeding:
                floor = np.array([float(own[-1][0]) if len(own) == k else -np.inf for own in best.score])
                norm = np.sqrt(np.square(queries).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(norm > 0, floor / norm, np.where(floor > 0, np.inf, -np.inf)).min() if n else np.inf
                yield pa.RecordBatch.from_pylist([{"q_block": r["q_block"], "q_floor": floor.tobytes(), "need": float(need)}], pa.schema([("q_block", pa.int64()), ("q_floor", pa.binary()), ("need", pa.float64())]))
                continue
            out = [(int(q_rows[q]), int(q_ids[q]), i, s) for q in range(n) for s, i in best.score[q] if s >= best.floor[q]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [], []))], ["query_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int = 5, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (vec_id, embedding) with the largest inner products.

    is_query: a condition on vec_id. Components x count as floor(256 x). A query meets every row but its own; ties go to
    the smaller vec_id. Rows with null vec_id or a vector that is not valid(), or empty, take no part; repeated rows are rows
    of their own, as queries too; vectors of any length are looked at whole, and vectors of different lengths do not meet; an
    empty table gives no rows; other columns are ignored, whatever their names. Query blocks are a stated set: each meets
    each block of candidates that can hold one of its k best once.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).filter(F.col("vec_id").isNotNull() & valid())
    rows = rows.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: _floor(x)).alias("whole"), F.monotonically_increasing_id().alias("row"))
    norm = F.sqrt(F.aggregate("whole", F.lit(0.0), lambda acc, x: acc + x * x))
    wide = F.exists("whole", lambda x: F.abs(x) > LARGE)
    small_batches(vectors)
    rows = materialise(rows.filter("dim > 0").select("*", norm.alias("norm"), wide.alias("wide")), "topk-rows")
    c = _blocks(rows, candidates, "topk-candidates")
    q = _blocks(rows.filter(is_query), queries, "topk-queries").toDF("dim", *[f"q_{x.split()[0]}" for x in BLOCK.split(", ")[1:]])

    small = c.select("dim", "wide", "block", "most")
    # the bars: all queries of a length meet one block of it; only plain numbers have a bar
    first = materialise(small.filter("not wide").groupBy("dim").agg(F.max_by("block", "most").alias("block")).join(c.drop("most", "wide"), ["dim", "block"]), "topk-first")
    asking = materialise(q.filter("not q_wide").select("dim", "q_block"), "topk-asking")
    met = spread_joins(asking, first.drop("block"), "dim", {"dim": ""}, share=PER_COPY).withColumn("wide", F.lit(False)).join(q.drop("dim"), "q_block")
    floors = materialise(met.mapInArrow(lambda it: _work(it, k, "floor"), "q_block long, q_floor binary, need double"), "topk-floors")
    # pairs of block numbers, without those that cannot matter; then the blocks themselves
    lists = small.groupBy("dim", F.pmod(F.xxhash64("block"), F.lit(SPREAD)).alias("s")).agg(F.collect_list(F.struct("block", "wide", "most")).alias("to"))
    many = q.select("dim", "q_block").join(floors.select("q_block", "need"), "q_block", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
    pairs = many.join(lists, ["dim", "s"]).select("dim", "q_block", "need", F.explode("to").alias("to"))
    pairs = pairs.filter(F.col("need").isNull() | F.col("to.wide") | (F.col("to.most") * (1 + 1e-9) + 1e-6 >= F.col("need"))).select("dim", "q_block", F.col("to.block").alias("block"))
    pairs = materialise(pairs, "topk-pairs")
    full = q.drop("dim").join(floors.select("q_block", "q_floor"), "q_block", "left")
    # of the two blocks of a pair the queries, which are smaller, are sent to the candidates
    met = pairs.join(full, "q_block").join(c.drop("dim", "most"), "block")
    found = met.mapInArrow(lambda it: _work(it, k, "best"), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(x):
    """floor(256 x) as a double that holds a whole number; floor() of a double would go through long."""
    y = x.cast("double") * 256
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
