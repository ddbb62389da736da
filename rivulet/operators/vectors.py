"""Related articles and semantic duplicates by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from . import tiles

#: Vectors of a tile, tiles of a bucket of time at most, rows multiplied at once, and pairs checked at once.
TILE, PARTS, STEP, CHECKED = 1024, 8, 256, 65_536
RELATED, CANDIDATES, WINDOW_DAYS, SAME = 8, 5, 3, 0.92


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def related(vectors: DataFrame, vec_id: int, k: int = RELATED, where: Column | None = None, model: str | None = None, articles: DataFrame | None = None) -> DataFrame:
    """id, similarity of the k nearest other vectors of the same model; where filters before the search, so none of the k
    is lost to it.

    vectors: id, model, vector. model: whose vector of vec_id asks; None where it has only one. articles (id, status): only
    vectors of published articles answer. The query is one row; every other row is scored where it lies and each task keeps k.
    """
    asks = vectors.filter(F.col("id") == vec_id)
    if model is not None:
        asks = asks.filter(F.col("model") == model)
    q = F.broadcast(asks.select("model", F.col("vector").alias("_q")).orderBy("model").limit(1))
    pool = vectors.filter(F.col("id") != vec_id)
    if where is not None:
        pool = pool.filter(where)
    if articles is not None:
        pool = pool.join(articles.filter(F.col("status") == "published").select("id"), "id", "left_semi")
    scored = pool.join(q, "model").select("id", cosine(F.col("vector"), F.col("_q")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def semantic_candidates(vectors: DataFrame, days: int = WINDOW_DAYS, k: int | None = CANDIDATES, least: float = SAME, tile: int = TILE) -> DataFrame:
    """id, other, similarity, rank: for each row the k nearest rows (None: all) of the same model within `days` days, of at
    least `least`.

    vectors: id, model, published_at, vector. Rows lie in tiles of one model and bucket of time; a tile meets those of its own
    bucket and of the buckets beside it, each two in a piece of work of their own, once for both ways round. A bucket has
    PARTS tiles at most, so what is moved grows with the rows. Products are taken in double in numpy, and a row keeps its k
    best of each piece. Rows with another number of dimensions, with null or with zero vectors meet nothing.
    """
    width = days * 86400 * 1_000_000
    near = _meetings(vectors, width, tile).applyInArrow(lambda piece: _near(piece, width, least, k), "id long, other long, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    ranked = near.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _meetings(vectors: DataFrame, width: int, tile: int):
    """Pairs of tiles of one model and number of dimensions, `width` microseconds to a bucket."""
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    known = F.col("vector").isNotNull() & F.col("id").isNotNull() & at.isNotNull() & F.col("model").isNotNull() & (F.size("vector") > 0)
    rows = store(vectors.filter(known).select("id", "model", at.alias("at"), F.size("vector").alias("dim"), F.col("vector").alias("v"), F.floor(at / width).alias("bucket")), "vector-rows")
    # collected as they are: floats take half of what doubles do, and become doubles where they are compared
    return tiles.meetings(rows, ["model", "dim"], "id", {"ids": F.col("id"), "ats": F.col("at"), "v": (F.col("v"), F.flatten)}, tile, "vector", most=PARTS)


def _hits(piece: pa.Table, width: int, least: float) -> tuple[np.ndarray, ...]:
    """ids, times, other ids, other times, cosines of the pairs of a piece that are near enough, both ways round."""
    dim = piece.column("dim")[0].as_py()
    x, y, same = tiles.sides(piece, ("ids", "ats", "v"))
    vx, vy = (side[2].astype(np.float64).reshape(-1, dim) for side in (x, y))
    nx, ny = np.linalg.norm(vx, axis=1), np.linalg.norm(vy, axis=1)
    out: list[tuple[np.ndarray, ...]] = []
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = vx / nx[:, None], vy / ny[:, None]
        for lo in range(0, len(ux), STEP):
            # looked for by products of unit vectors; what is near is computed again, pair by pair, so equal vectors give equal numbers
            i, j = np.nonzero(ux[lo : lo + STEP] @ uy.T >= least - 1e-9)
            i = i + lo
            fit = (np.abs(x[1][i] - y[1][j]) <= width) & (x[0][i] != y[0][j])
            i, j = i[fit], j[fit]
            s = np.concatenate([np.einsum("nd,nd->n", vx[i[n : n + CHECKED]], vy[j[n : n + CHECKED]]) for n in range(0, len(i), CHECKED)] or [np.zeros(0)]) / (nx[i] * ny[j])
            i, j, s = i[s >= least], j[s >= least], s[s >= least]
            out.append((x[0][i], x[1][i], y[0][j], y[1][j], s))
            if not same:
                out.append((y[0][j], y[1][j], x[0][i], x[1][i], s))
    kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
    return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, kind) for c, kind in enumerate(kinds))


def _near(piece: pa.Table, width: int, least: float, k: int | None) -> pa.Table:
    i, _, j, _, s = _hits(piece, width, least)
    if k is not None and len(i):
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        best = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        i, j, s = i[best], j[best], s[best]
    return pa.table({"id": i, "other": j, "similarity": s})


def _earliest(piece: pa.Table, width: int, least: float) -> pa.Table:
    """Of each row's near and earlier rows the first one, by time and id."""
    i, p, j, q, _ = _hits(piece, width, least)
    before = (q < p) | ((q == p) & (j < i))
    i, j, q = i[before], j[before], q[before]
    order = np.lexsort((j, q, i))
    i, j, q = i[order], j[order], q[order]
    first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    return pa.table({"id": i[first], "at": q[first], "other": j[first]})


def semantic_winners(vectors: DataFrame, least: float = SAME, days: int = WINDOW_DAYS, tile: int = TILE) -> DataFrame:
    """id, winner: the earliest of the near rows that come before a row. A row leaves a piece with one winner at most."""
    width = days * 86400 * 1_000_000
    found = _meetings(vectors, width, tile).applyInArrow(lambda piece: _earliest(piece, width, least), "id long, at long, other long")
    return found.groupBy("id").agg(F.min(F.struct("at", "other")).alias("w")).select("id", F.col("w.other").alias("winner"))
