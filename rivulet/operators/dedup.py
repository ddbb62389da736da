"""Layered deduplication of articles: exact by content hash, near by fingerprint within 48 hours, one-hop flattening.

An article is a row with id, published_at, status, content_hash, simhash, duplicate_of_id. Every step is a function from
snapshot to snapshot, so a sweep can be repeated at will: a second one changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.simhash import bands, distance
from ..session import store
from . import tiles
from .skew import attach

DUPLICATE = "duplicate"
WINDOW_HOURS = 48
RADIUS = 3
#: Slices of the window of time that near_winners() walks through one by one.
SLICES = 48
#: Fingerprints of a tile of the histogram, and its largest distance (a fixed value: what the analysis shows).
TILE = 4096
HISTOGRAM = 20


def first_by_group(df: DataFrame, key: Column, name: str = "winner") -> DataFrame:
    """key, winner (id of the earliest row by published_at, id) and n for each non-null key.

    One partial aggregate and no sort: a key with very many rows sends one row from each task.
    """
    return df.filter(key.isNotNull()).groupBy(key.alias("group_key")).agg(F.min(F.struct("published_at", "id")).alias("first"), F.count("*").alias("n")).select("group_key", F.col("first.id").alias(name), "n")


def exact_winners(articles: DataFrame) -> DataFrame:
    """id, winner of every row that loses to an earlier row with the same content hash. No time window.

    Hashes with over 1/1000 of the rows are looked up by broadcast, so their rows are not brought together.
    """
    live = articles.filter(F.col("content_hash").isNotNull() & (F.col("status") != DUPLICATE))
    live = store(live.select("id", "published_at", F.col("content_hash").alias("group_key")), "live-hashes")
    groups = store(first_by_group(live, F.col("group_key")).filter("n > 1"), "hash-groups")
    return attach(live.drop("published_at"), groups, "group_key", "n").filter("id <> winner").select("id", "winner")


def demote(articles: DataFrame, winners: DataFrame) -> DataFrame:
    """The snapshot after the rows of winners (id, winner) became duplicates."""
    w = winners.select("id", F.col("winner").alias("_winner"))
    joined = articles.join(w, "id", "left")
    hit = F.col("_winner").isNotNull()
    return joined.withColumn("status", F.when(hit, DUPLICATE).otherwise(F.col("status"))).withColumn("duplicate_of_id", F.coalesce("_winner", "duplicate_of_id")).drop("_winner").select(articles.columns)


def near_pairs(articles: DataFrame, radius: int = RADIUS, hours: int = WINDOW_HOURS) -> DataFrame:
    """loser, winner, distance: an earlier live row within `radius` bits and less than `hours` before.

    Rows that share one of four 16-bit bands and a window of time meet in an equi-join: `hours` or less apart they are
    in the same bucket or in neighbouring ones. Equal fingerprints share all bands, so each pair counts in its first
    common band only. The result is the list of all pairs; near_winners() does without it.
    """
    live = articles.filter(F.col("simhash").isNotNull() & (F.col("status") != DUPLICATE)).select("id", "published_at", "simhash")
    seconds = hours * 3600
    bucket = F.floor(F.unix_micros(F.col("published_at").cast("timestamp")) / (seconds * 1_000_000))
    cut = live.withColumn("bucket", bucket).withColumn("b", F.explode(bands(F.col("simhash")))).select("*", "b.band", "b.bits").drop("b")
    loser = cut.select(*[F.col(c).alias(f"l_{c}") for c in ("id", "published_at", "simhash")], "band", "bits", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"))
    met = loser.join(cut, ["band", "bits", "bucket"])
    earlier = F.struct("published_at", "id") < F.struct("l_published_at", "l_id")
    inside = F.col("published_at") > F.col("l_published_at") - F.make_dt_interval(hours=F.lit(hours))
    d = distance(F.col("simhash"), F.col("l_simhash"))
    first = first_band(F.col("simhash"), F.col("l_simhash"))
    return met.filter(earlier & inside & (d <= radius) & (F.col("band") == first)).select(F.col("l_id").alias("loser"), F.col("id").alias("winner"), d.alias("distance"), F.col("published_at").alias("winner_published_at"))


def first_band(a: Column, b: Column) -> Column:
    """The first band in which two fingerprints are equal."""
    x = a.bitwiseXOR(b)
    equal = lambda k: F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) == 0
    return F.when(equal(0), 0).when(equal(1), 1).when(equal(2), 2).otherwise(3)


def near_winners(articles: DataFrame, radius: int = RADIUS, hours: int = WINDOW_HOURS) -> DataFrame:
    """id, winner: for each loser the earliest, not the nearest, of the rows that it loses to.

    No pairs of rows are made. Rows with one fingerprint and time count once; fingerprints are paired once for each
    window of time. The earliest row after a moment x is the running minimum of the rows from the latest down to x: those
    of x's own slice of time are walked through in order, those of later slices are known from one row for each slice.
    """
    span = hours * 3_600_000_000
    slice_ = max(span // SLICES, 1)
    when = F.unix_micros(F.col("published_at").cast("timestamp"))
    live = articles.filter(F.col("simhash").isNotNull() & (F.col("status") != DUPLICATE)).select("id", "simhash", when.alias("at"))
    live = store(live.withColumn("spot", F.struct("simhash", "at")), "live-fingerprints")
    spots = store(live.groupBy("spot").agg(F.min("id").alias("first"), F.count("*").alias("n")), "fingerprint-times")
    seen = spots.select("spot.simhash", "spot.at", "first", F.floor(F.col("spot.at") / span).alias("bucket"))
    units = seen.select("simhash", "bucket").distinct().withColumn("b", F.explode(bands(F.col("simhash")))).select("simhash", "bucket", "b.band", "b.bits")
    mine = units.select("simhash", "bucket", "band", "bits", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket2"))
    other = units.select(F.col("simhash").alias("simhash2"), F.col("bucket").alias("bucket2"), "band", "bits")
    close = (distance(F.col("simhash"), F.col("simhash2")) <= radius) & (F.col("band") == first_band(F.col("simhash"), F.col("simhash2")))
    near = mine.join(other, ["band", "bits", "bucket2"]).filter(close).select("simhash", "bucket", "simhash2", "bucket2")
    of = seen.select(F.col("simhash").alias("simhash2"), F.col("bucket").alias("bucket2"), "at", "first")
    entries = near.join(of, ["simhash2", "bucket2"]).groupBy("simhash", "bucket", "at").agg(F.min("first").alias("first"))
    entries = store(entries.withColumn("slice", F.floor(F.col("at") / slice_)), "near-entries")

    group = ["simhash", "bucket"]
    down = Window.partitionBy(*group).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = entries.groupBy(*group, "slice").agg(F.min(F.struct("at", "first")).alias("least"))
    probes = seen.select(*group, (F.col("at") - span).alias("x"), F.col("at").alias("own"))
    probes = probes.withColumn("slice", F.floor(F.col("x") / slice_))
    # a slice that only probes have takes its later rows from the same running minimum
    steps = slices.select(*group, "slice", "least").unionByName(probes.select(*group, "slice").distinct(), allowMissingColumns=True)
    later = steps.groupBy(*group, "slice").agg(F.min("least").alias("least")).select(*group, "slice", F.min("least").over(down).alias("later"))
    line = entries.select(*group, "slice", "at", F.lit(1).alias("row"), F.struct("at", "first").alias("e"), F.lit(None).cast("long").alias("own"))
    line = line.unionByName(probes.select(*group, "slice", F.col("x").alias("at"), F.lit(0).alias("row"), F.lit(None).cast("struct<at:bigint,first:bigint>").alias("e"), "own"))
    # from the latest down; at one time a probe comes before the rows, as a winner is later than x
    walk = Window.partitionBy(*group, "slice").orderBy(F.desc("at"), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = line.withColumn("least", F.min("e").over(walk)).filter("row = 0").select(*group, "slice", "own", "least")
    found = inside.join(later, [*group, "slice"]).select(F.struct("simhash", F.col("own").alias("at")).alias("spot"), F.coalesce("least", "later").alias("w"))
    best = store(found.join(spots, "spot").select("spot", F.col("w.at").alias("w_at"), F.col("w.first").alias("winner"), "n"), "near-best")
    losers = attach(live.select("id", "spot"), best, "spot", "n")
    return losers.filter(F.struct("w_at", "winner") < F.struct("spot.at", "id")).select("id", "winner")


def flatten(articles: DataFrame) -> DataFrame:
    """One hop: a duplicate of a duplicate points to that one's target, unless that is the row itself."""
    up = articles.filter((F.col("status") == DUPLICATE) & F.col("duplicate_of_id").isNotNull()).select(F.col("id").alias("duplicate_of_id"), F.col("duplicate_of_id").alias("_next"))
    joined = articles.join(up, "duplicate_of_id", "left")
    hop = (F.col("status") == DUPLICATE) & F.col("_next").isNotNull() & (F.col("_next") != F.col("id"))
    return joined.withColumn("duplicate_of_id", F.when(hop, F.col("_next")).otherwise(F.col("duplicate_of_id"))).drop("_next").select(articles.columns)


def sweep(articles: DataFrame, radius: int = RADIUS, hours: int = WINDOW_HOURS) -> DataFrame:
    """exact, near, flatten; each sees what the one before it did."""
    return flatten(demote(*_with(demote(*_with(articles, exact_winners)), lambda a: near_winners(a, radius, hours))))


def _with(articles: DataFrame, winners) -> tuple[DataFrame, DataFrame]:
    return articles, winners(articles)


def sweep_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """demoted and repointed rows between two snapshots."""
    b = before.select("id", F.col("status").alias("s0"), F.col("duplicate_of_id").alias("d0"))
    joined = after.select("id", "status", "duplicate_of_id").join(b, "id")
    fresh = (F.col("status") == DUPLICATE) & (F.col("s0") != DUPLICATE)
    moved = (F.col("s0") == DUPLICATE) & ~F.col("duplicate_of_id").eqNullSafe(F.col("d0"))
    return joined.agg(F.count_if(fresh).alias("demoted"), F.count_if(moved).alias("repointed"))


def collision_plan(articles: DataFrame, canonical: Column) -> DataFrame:
    """id, new_url, winner, loses for rows whose canonical URL differs or collides: the earliest row takes the URL.

    Losers keep their old URL and become duplicates of the winner.
    """
    live = articles.filter(F.col("status") != DUPLICATE).withColumn("new_url", canonical)
    groups = first_by_group(live, F.col("new_url"))
    return live.join(groups, live["new_url"] == groups["group_key"]).select("id", "new_url", "winner", (F.col("id") != F.col("winner")).alias("loses"), F.col("n").alias("group_size"))


def hamming_histogram(fps: DataFrame, most: int = HISTOGRAM, tile: int = TILE) -> DataFrame:
    """distance, pairs: how many pairs of rows have fingerprints at each distance up to `most`. Exact at any distance.

    Distinct fingerprints are dealt into tiles; each two tiles are a piece of work of their own, in which exclusive-or and
    bit counts run in numpy, and only pairs within `most` are looked at further. A piece gives one row for each distance. Equal fingerprints are counted from their multiplicity.
    What is compared grows with the square of the distinct fingerprints, as a histogram of all pairs has to.
    """
    distinct = store(fps.filter(F.col("simhash").isNotNull()).groupBy("simhash").agg(F.count("*").alias("n")).withColumn("bucket", F.lit(0).cast("long")), "distinct-fingerprints")
    pieces = tiles.meetings(distinct, [], "simhash", {"simhash": F.col("simhash"), "n": F.col("n")}, tile, "fingerprint", beside=False)
    near = pieces.applyInArrow(lambda piece: _distances(piece, most), "distance int, pairs long")
    same = distinct.select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("pairs")).filter("pairs > 0")
    return near.unionByName(same).groupBy("distance").agg(F.sum("pairs").alias("pairs"))


def _distances(piece: pa.Table, most: int) -> pa.Table:
    x, y, same = tiles.sides(piece, ("simhash", "n"))
    total = np.zeros(65, np.int64)
    plain = bool((x[1] == 1).all() and (y[1] == 1).all())
    for i, j, far in tiles.within(x[:1], y[:1], most, same):
        if plain:
            total += np.bincount(far, minlength=65)
        else:
            np.add.at(total, far, x[1][i] * y[1][j])
    some = np.flatnonzero(total)
    return pa.table({"distance": pa.array(some.astype(np.int32)), "pairs": pa.array(total[some])})


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def rank_by_first(df: DataFrame, key: str) -> DataFrame:
    """The window form of first_by_group(): every row with its group's first id and size. Needs a sort of each group."""
    w = Window.partitionBy(key)
    return df.withColumn("first_id", F.first("id").over(w.orderBy("published_at", "id"))).withColumn("group_size", F.count("*").over(w))
