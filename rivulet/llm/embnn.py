"""Operator 10: near-duplicate vectors by spherical-cap filters with structured random product codes.

There are TURNS product codes, each with a random rotation of its own. A vector is normed, turned and cut into blocks.
Each block has random unit words; a filter direction is one word of each block, so a code of b blocks of c words has c^b
directions. List decoding finds all whose inner product with the vector is at least the cap: partial sums are
extended block by block and dropped once the best words of the remaining blocks could not lift them to the cap. Vectors that
share a filter are compared exactly, in double precision. Several small codes find more than a large one, for how many
directions of one code exceed the cap varies much from vector to vector.

The number of directions follows the number of vectors (level()), and the cap is set so that a random vector is in about
FILTERS of them: so a filter has some hundred members whatever the size of the table. Equal vectors are first merged into one
with a multiplicity. A filter with more members than TILE is cut into groups that are compared two by two, so no task holds
more than two groups. A pair counts only in the smallest filter that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, connected_components, materialise, worker_cache
from .simhash import _forest

THRESHOLD = 0.95
TURNS = 10
#: Directions of a code for up to SMALL vectors, and how many filters a random vector is in; the tests measure the recall.
SMALL, DIRECTIONS, FILTERS = 100_000, 1600, 24
#: No cap is narrower than this, so that two vectors at the threshold can share one; in few dimensions that takes fewer words.
NARROW = 0.87
#: Vectors of fewer dimensions than this for each block have fewer blocks.
BLOCK_DIMS = 8
SEED = 20
TILE = 1024


def level(n: int) -> int:
    """How often four times the directions are needed for n vectors, so that a filter keeps its number of members."""
    k = 0
    while SMALL * 4**k < n:
        k += 1
    return k


class Code:
    """Rotation, words and cap for vectors of one dimension, from a seed."""

    def __init__(self, dim: int, seed: int = SEED, level: int = 0) -> None:
        rng = np.random.default_rng([seed, dim])
        blocks = max(1, min(2 if level <= 2 else 3, dim // BLOCK_DIMS))
        self.code = round((DIRECTIONS * 4 ** min(level, 8 if blocks > 1 else 3)) ** (1 / blocks))
        self.size = self.code**blocks
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, blocks + 1).astype(int)
        self.words = []
        for lo, hi in zip(self.cuts, self.cuts[1:], strict=False):
            w = rng.standard_normal((self.code, hi - lo))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks))
        # narrower caps share less, so there are more of them
        share = FILTERS * (1 + level / 8) / TURNS
        x = rng.standard_normal((256, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        self.cap = self._cap(x, share)
        if self.cap > NARROW and blocks == 1:
            self.cap = NARROW
            self.code = self.size = min(self.code, max(1, -(-int(share * len(x) * self.code) // len(self.decode(x)[0]))))
            self.words = [self.words[0][: self.code]]

    def _cap(self, x: np.ndarray, share: float) -> float:
        """The cap that random vectors exceed in `share` directions of this code on average, by halving."""
        about = NormalDist().inv_cdf(1 - share / self.size) / np.sqrt(x.shape[1])  # if products were normal
        lo, hi = 0.6 * about, min(1.3 * about, 1.0)
        for _ in range(12):
            self.cap = (lo + hi) / 2
            if len(self.decode(x)[0]) > len(x) * share:
                lo = self.cap
            else:
                hi = self.cap
        return hi

    @staticmethod
    def of(dim: int, level: int) -> list[Code]:
        cache = worker_cache()
        if ("caps", dim, level) not in cache:
            cache["caps", dim, level] = [Code(dim, SEED + turn, level) for turn in range(TURNS)]
        return cache["caps", dim, level]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows and filters of all pairs of a unit vector and a direction with an inner product of at least the cap.

        A vector with none gets its best direction, so that it meets at least its copies.
        """
        x = unit @ self.turn
        scores = [x[:, lo:hi] @ w.T for (lo, hi), w in zip(zip(self.cuts, self.cuts[1:], strict=False), self.words, strict=True)]
        rest = np.zeros(len(x))
        left = [rest]
        for s in reversed(scores[1:]):
            rest = rest + s.max(axis=1)
            left.append(rest)
        row, sums, code = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for s, bound in zip(scores, reversed(left), strict=True):
            grown = sums[:, None] + s[row]
            i, j = np.nonzero(grown + bound[row][:, None] >= self.cap)
            row, sums, code = row[i], grown[i, j], code[i] * self.code + j
        lost = np.setdiff1d(np.arange(len(x)), row)
        if len(lost):
            best = np.zeros(len(lost), np.int64)
            for s in scores:
                best = best * self.code + s[lost].argmax(axis=1)
            row, code = np.concatenate([row, lost]), np.concatenate([code, best])
        order = np.lexsort((code, row))
        return row[order], code[order]


def decode_all(unit: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """rows and filters of all codes, ascending."""
    codes = Code.of(unit.shape[1], level)
    got = [c.decode(unit) for c in codes]
    row = np.concatenate([r for r, _ in got])
    first = np.cumsum([0] + [c.size for c in codes])
    number = np.concatenate([f + first[k] for k, (_, f) in enumerate(got)])
    order = np.lexsort((number, row))
    return row[order], number[order]


def valid(vector: str = "embedding"):
    """Not null or empty, without null or non-finite components, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0)


def _normed(flat: np.ndarray) -> np.ndarray:
    """Unit vectors in double; scaled first, so that no square overflows or vanishes."""
    flat = flat.astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _bytes(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of flat, up to each of ends, as binary values."""
    offsets = np.concatenate([[0], ends * flat.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _stretches(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all binary values one after another, and where each begins and the last one ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _decode(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """node, n, dim, embedding -> node, n, dim, vector (its bytes), filters (ascending) and marks (their bytes)."""
    for batch in batches:
        dims = batch.column(2).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                piece = piece.filter(pa.array(dims[lo : lo + 2048] == dim))
                m = piece.num_rows
                if not m:
                    continue
                flat = piece.column(3).flatten().to_numpy(zero_copy_only=False).reshape(m, dim)
                row, code = decode_all(_normed(flat), level)
                ends = np.cumsum(np.bincount(row, minlength=m))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(code))
                vector = _bytes(flat.reshape(-1), np.arange(1, m + 1) * dim)
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], vector, lists, _bytes(code, ends)], ["node", "n", "dim", "vector", "filters", "marks"])


class _Groups:
    """Runs of rows with equal keys, over batches that may cut them."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in self.keys])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            cuts = [0, *cuts.tolist(), batch.num_rows]
            for n, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                piece = batch.slice(lo, hi - lo)
                if n == 0 and held:
                    last = held[-1].slice(held[-1].num_rows - 1)
                    if any(last.column(k)[0].as_py() != piece.column(k)[0].as_py() for k in self.keys):
                        yield pa.Table.from_batches(held)
                        held = []
                elif held:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(piece)
        if held:
            yield pa.Table.from_batches(held)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each place (dim, filter, r, s) that has more than one; places whose keys are equal are told apart."""
    for table in _Groups(["key"])(batches):
        if table.num_rows < 2:
            continue
        batch = table.combine_chunks().to_batches()[0]
        place = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("dim", "filter", "r", "s")], axis=1)
        if (place == place[0]).all():
            yield batch
            continue
        _, at = np.unique(place, axis=0, return_inverse=True)
        for k in range(at.max() + 1):
            own = batch.filter(pa.array(at.ravel() == k))
            if own.num_rows > 1:
                yield own


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (dim, filter, r, s, node, side, n, vector, marks, key) sorted by key -> degrees (a, null, n) and links (a, b, null)."""
    for batch in _places(batches):
        here = batch.column("filter")[0].as_py()
        node, side, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "side", "n"))
        dim = batch.column("dim")[0].as_py()
        raw, cuts = _stretches(batch.column("vector"))
        unit = _normed(raw.view(np.float32 if cuts[1] == 4 * dim else np.float64).reshape(-1, dim))
        raw, cuts = _stretches(batch.column("marks"))
        flat, offsets = raw.view(np.int64), cuts // 8
        split = batch.column("r")[0].as_py() != batch.column("s")[0].as_py()
        left = np.flatnonzero(side == 0) if split else np.arange(len(node))
        right = np.flatnonzero(side == 1) if split else left
        if not len(left) or not len(right):
            continue
        degree = np.zeros(len(node), np.int64)
        found_a, found_b = [], []
        for lo in range(0, len(left), 512):
            own = left[lo : lo + 512]
            cos = unit[own] @ unit[right].T
            i, j = np.nonzero(cos >= threshold - 1e-9)
            i, j = own[i], right[j]
            if not split:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            for at in range(0, len(i), 1 << 14):
                a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                ok[ok] = _first_shared(flat, offsets, a[ok], b[ok]) == here
                a, b = a[ok], b[ok]
                np.add.at(degree, a, n[b])
                np.add.at(degree, b, n[a])
                if len(a):
                    x, y = _forest(node, node, a, b)
                    found_a.append(x)
                    found_b.append(y)
        some = np.flatnonzero(degree)
        if len(some):
            a = np.concatenate([node[some], *found_a])
            b = np.concatenate([np.zeros(len(some), np.int64), *found_b])
            count = np.concatenate([degree[some], np.zeros(len(a) - len(some), np.int64)])
            link = np.arange(len(a)) >= len(some)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~link), pa.array(count, mask=link)], ["a", "b", "n"])


def _first_shared(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value that the lists of a and b share, for each pair; both lists ascend and share one at least."""
    i, j = offsets[a].astype(np.int64), offsets[b].astype(np.int64)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = flat[i[live]], flat[j[live]]
        same = x == y
        out[live[same]] = x[same]
        i[live] += x < y
        j[live] += x > y
        live = live[~same]
    return out


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    n_links counts the other rows with a cosine of at least threshold, as found by the filters; component_id is the
    smallest vec_id in reach. Vectors that are not valid() link with nothing. Repeated rows and equal vectors are linked
    with each other; a row with null vec_id has null component_id if alone. An empty table gives no rows; other columns
    are ignored, whatever their names. Vectors of different lengths never link. Of vec_ids that tie there is nothing to
    choose: repeated ids are rows of their own. A vector may have any length; it is looked at whole.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    # equal vectors are known by two hashes, 128 bits together: what is grouped and joined by is no vector
    same = F.struct(F.xxhash64("embedding", F.lit(1)).alias("h1"), F.xxhash64("embedding", F.lit(2)).alias("h2"))
    rows = rows.withColumn("ok", F.coalesce(valid(), F.lit(False))).withColumn("same", same)
    table = materialise(rows, "caps-rows")
    good = table.filter("ok").drop("ok")
    merged = good.groupBy("same").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    merged = materialise(merged.withColumn("node", F.monotonically_increasing_id()), "caps-distinct")
    depth = level(merged.count())
    kind = "float" if merged.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    shape = merged.select("node", "n", F.size("embedding").alias("dim"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    coded = materialise(shape.mapInArrow(lambda it: _decode(it, depth), "node long, n long, dim int, vector binary, filters array<long>, marks binary"), "caps-coded")
    member = coded.select("dim", F.explode("filters").alias("filter"))
    # only filters with more than a tile of members are cut; they are few, as each has so many
    crowd = member.groupBy("dim", "filter").count().filter(F.col("count") > tile)
    crowd = materialise(crowd.select("dim", "filter", F.ceil(F.col("count") / tile).cast("int").alias("g")), "caps-crowd")
    open_ = coded.select("node", "n", "dim", "vector", "marks", F.explode("filters").alias("filter")).join(crowd, ["dim", "filter"], "left")
    parts = F.coalesce("g", F.lit(1))
    met = open_.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("dim", "filter", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("s"), "node", (F.col("own") > F.col("other")).cast("int").alias("side"), "n", "vector", "marks")
    # of a pair of groups the smaller one is the left side; one long to sort by is sorted fastest
    keyed = met.withColumn("key", F.xxhash64("dim", "filter", "r", "s")).repartition("key").sortWithinPartitions("key")
    found = materialise(keyed.mapInArrow(lambda it: _verify(it, threshold), "a long, b long, n long"), "caps-found")
    degree = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.filter("b is not null").select("a", "b"))
    each = merged.drop("embedding", "same").join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = materialise(each, "caps-each")
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    each = each.join(least, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    full = materialise(merged.select("node", "same", "n").join(each, "node").drop("node"), "caps-vectors")
    linked = attach(good.select("vec_id", "same"), full, "same", "n").select("vec_id", "n_links", "component_id")
    alone = table.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
