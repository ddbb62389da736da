"""Rows against rows in tiles: what is compared is all pairs, what is moved grows with the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store

#: Tiles of one bucket at most, so that a row is sent to so many pieces of its bucket at most: beyond that, tiles grow.
MOST = 24
#: Pairs that a kernel looks at in one step: rows of the left tile by those of the right one.
ROWS, COLUMNS = 32, 2048
#: Pairs whose flags are looked at together, as one word.
RUN = 8


def meetings(rows: DataFrame, group: list[str], key: str, columns: dict[str, Column | tuple], tile: int, label: str, beside: bool = True, most: int = MOST) -> DataFrame:
    """Pairs of tiles that meet, grouped: each group of the result has one row (a tile with itself) or two.

    rows have the columns of group, `bucket` (long) and key. Rows of a group and bucket are dealt by key into tiles of some
    `tile` rows, into `most` tiles at most; a tile meets each tile of its bucket and, if beside, of the next bucket once.
    Rows of the result: the keys of a piece, the tile's place (`first`: the tile that is named first), and columns as lists; a column given with
    a function is what that makes of its list.
    """
    names = [*group, "bucket"]
    counts = rows.groupBy(*names).agg(F.count("*").alias("n"))
    counts = store(counts.select(*names, F.least(F.ceil(F.col("n") / tile), F.lit(most)).cast("int").alias("parts")), f"{label}-counts")
    dealt = rows.join(F.broadcast(counts) if not group else counts, names).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    lists = [(c[1](F.collect_list(c[0])) if isinstance(c, tuple) else F.collect_list(c)).alias(name) for name, c in columns.items()]
    tiles = store(dealt.groupBy(*names, "part").agg(*lists), f"{label}-tiles")
    steps = (-1, 0, 1) if beside else (0,)
    met = tiles.withColumn("to", F.explode(F.array(*[F.col("bucket") + d for d in steps])))
    sizes = counts.select(*group, F.col("bucket").alias("to"), F.col("parts").alias("to_parts"))
    met = met.join(sizes, [*group, "to"]).withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))
    mine, other = F.struct("bucket", "part"), F.struct(F.col("to").alias("bucket"), F.col("to_part").alias("part"))
    piece = [*group, F.least(mine, other).alias("one"), F.greatest(mine, other).alias("two")]
    met = met.select(*piece, (mine <= other).alias("first"), *columns)
    pieces = counts.agg(F.sum(F.col("parts") * (F.col("parts") + 1) * (1.5 if beside else 0.5)).cast("long").alias("n")).first()["n"] or 1
    cores = rows.sparkSession.sparkContext.defaultParallelism
    keys = [*group, "one", "two"]
    return met.repartition(max(1, min(pieces, 16 * cores)), *keys).groupBy(*keys)


def sides(piece: pa.Table, columns: tuple[str, ...]) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """The columns of both tiles of a piece, and whether they are the same tile."""
    firsts = piece.column("first").to_pylist()
    read = lambda r: [piece.column(c)[r].values.to_numpy(zero_copy_only=False) for c in columns]
    if len(firsts) == 1:
        return read(0), read(0), True
    return read(firsts.index(True)), read(firsts.index(False)), False


def within(x: list[np.ndarray], y: list[np.ndarray], limit: np.ndarray | int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, bits) of the pairs that differ in `limit` bits at most; limit: a number, or one for each of x.

    x, y: words of 64 bits, the first ones of all rows, then the second ones. same: each pair of one tile once, none with itself.
    """
    n, m = len(x[0]), len(y[0])
    words = [(np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)) for a, b in zip(x, y, strict=True)]
    most = np.broadcast_to(np.asarray(limit, np.uint8), (n,))
    place, room = np.arange(RUN), ROWS * COLUMNS
    both, one, far, near = (np.empty(room, t) for t in (np.uint64, np.uint8, np.uint8, bool))
    for lo in range(0, n, ROWS):
        hi = min(lo + ROWS, n)
        for left in range(lo // COLUMNS * COLUMNS if same else 0, m, COLUMNS):
            right = min(left + COLUMNS, m)
            shape, size = (hi - lo, right - left), (hi - lo) * (right - left)
            both_, one_, far_, near_ = (b[:size].reshape(shape) for b in (both, one, far, near))
            for k, (a, b) in enumerate(words):
                np.bitwise_xor(a[lo:hi, None], b[None, left:right], out=both_)
                np.bitwise_count(both_, out=one_ if k else far_)
                if k:
                    np.add(far_, one_, out=far_)
            np.less_equal(far_, most[lo:hi, None], out=near_)
            # hits are rare: places are looked for in the runs that have some
            end = -(-size // RUN) * RUN
            near[size:end] = False
            runs = np.flatnonzero(near[:end].view(np.uint64))
            if not len(runs):
                continue
            at = (runs[:, None] * RUN + place).reshape(-1)
            at = at[near[at]]
            i, j = lo + at // shape[1], left + at % shape[1]
            if same:
                keep = i < j
                i, j, at = i[keep], j[keep], at[keep]
            if len(i):
                yield i, j, far[at]
