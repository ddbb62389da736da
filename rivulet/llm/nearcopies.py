"""Near copies by the Jaccard similarity of word shingles, for stages that drop them.

Two texts are linked if their sets of word shingles have a similarity of AT_LEAST. Equal sets count as one. Links are found
by operator 9's method: fingerprints of the sets meet in tiles by exclusive-or and bit counts, at a RADIUS that 0.9999 of
the pairs of similarity 0.8 are within (more of more similar ones). Pairs within it whose sketches, one bit of each of BANDS *
ROWS minimum hashes, are far apart are none, nor are sets whose sizes are not within AT_LEAST of each other: they never meet.
All others are checked on the sets themselves, as 64-bit hashes. In a group of copies each is paired with the one in the
middle, so a group of n near copies gives about n checks, not n².

An exact check follows for what lies beyond the radius, or was paired with the middle only. Texts share one of BANDS keys,
each over ROWS minimum hashes, with probability 1 - (1 - 0.8^ROWS)^BANDS, 0.9999, if their similarity is 0.8. Members of keys
that are in several components are checked against one of them, the one that shares its keys with most others. Those that
still are in several meet once more: two sets of similarity 0.8 share one of their rarest shingles (prefix
filter), at places from which their overlap can still be reached (positional filter). What was edited too much to be linked
differs in its rarest shingles from all others and meets nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, SHARE, attach, connected_components, materialise, plus, small_batches, spread_joins
from .simhash import SEED, first_of_each, majority, named, near_pairs

WORDS = 5
#: The least similarity, as a fraction, so that it is compared in integers.
AT_LEAST = (4, 5)
ROWS = 5
BANDS = 24
#: Bits that fingerprints of linked sets differ in at most. At 0.8 each differs with probability acos(2 * 0.8 / 1.8) / pi.
RADIUS = 22
#: Bits of the sketches likewise, of BANDS * ROWS: each differs with probability 0.1 at 0.8.
SKETCH_RADIUS = 30
#: Rows of a prefix shingle on one side that meet all others in one task.
TILE = 1024
#: Links, 2 MB of them, that one task connects.
ALONE = 1 << 17
#: Shingles whose minimum hashes are taken at once.
CHUNK = 2048
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, ROWS * BANDS, np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of the distinct shingles, cut as those of simhash.fingerprint(). Fewer words: one shingle of all."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    n = max(len(tokens) - words + 1, 1)
    cut = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(xxh64_intdigest, cut, repeat(SEED)), np.uint64, n))


def _least(h: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set of shingles."""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for lo in range(0, len(h), CHUNK):
        low = np.minimum(low, (_TIMES[:, None] * h[None, lo : lo + CHUNK]).min(axis=1))
    return low


def _banded(low: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def keys(h: np.ndarray) -> list[int]:
    """The keys of a set of shingles, as unsigned integers; each band has its own seed."""
    return _banded(_least(h))


def sketch(low: np.ndarray) -> np.ndarray:
    """One bit of each minimum hash, in two words."""
    bits = np.zeros(128, np.uint8)
    bits[: len(low)] = (low >> np.uint64(24)) & np.uint64(1)
    return np.packbits(bits, bitorder="little").view(np.uint64)


def step(size: int) -> int:
    """The step of a set's size: sets that are similar enough are one apart at most."""
    return int(np.log(size) / np.log(AT_LEAST[1] / AT_LEAST[0]))


def _with_keys(docs: DataFrame, words: int) -> DataFrame:
    """docs with the hash of the shingle set of `text` in fp, its keys, its fingerprint in print, its sketch in s0 and s1 and its step."""
    from xxhash import xxh64_intdigest

    at = docs.columns.index("text")
    more = {"fp": "long", "keys": "array<long>", "print": "long", "s0": "long", "s1": "long", "step": "int"}
    schema = plus(docs, **more)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, flat, prints, bits, steps = [], [], [], [], []
            for x in batch.column(at):
                h = shingles(x.as_py(), words)
                low = _least(h)
                fp.append(xxh64_intdigest(h.tobytes(), SEED))
                flat += _banded(low)
                prints.append(majority(h))
                bits.append(sketch(low))
                steps.append(step(len(h)))
            own, flat, prints = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in (fp, flat, prints))
            s = np.array(bits, np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(fp) + 1, dtype=np.int32) * BANDS, flat)
            columns = [own, lists, prints, pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(steps, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *more])

    small_batches(docs)
    return docs.mapInArrow(work, schema)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """texts (fp, text): fp and its shingle set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "set"])

    return texts.select("fp", "text").mapInArrow(work, "fp long, set array<long>")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, a_set, b_set (ascending) -> the a, b whose sets are similar enough."""
    num, den = AT_LEAST
    for batch in batches:
        sides = []
        for k in (2, 3):
            c = batch.column(k)
            sides.append((c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()))
        (va, oa), (vb, ob) = sides
        keep = np.zeros(batch.num_rows, bool)
        for r in range(batch.num_rows):
            x, y = va[oa[r] : oa[r + 1]], vb[ob[r] : ob[r + 1]]
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep[r] = both * den >= (len(x) + len(y) - both) * num
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, a written table) whose sets are similar enough. Either side may hold one member very often.

    If none is in over SHARE pairs there is nothing to spread, and two joins do: the driver keeps memory for each plan and
    exchange, however few its rows.
    """
    own = sets.select("fp", "set")
    if pairs.count() <= SHARE or all(pairs.groupBy(c).count().agg(F.max("count")).first()[0] <= SHARE for c in ("a", "b")):
        side = lambda c: own.select(F.col("fp").alias(c), F.col("set").alias(f"{c}_set"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    else:
        met = spread_joins(pairs, own, "fp", {"a": "a_", "b": "b_"}).select("a", "b", "a_set", "b_set")
    return met.mapInArrow(_similar, "a long, b long")


def components(reps: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, root) of the similar sets of reps (fp, rid, keys, print, s0, s1, step, a written table) that are linked; texts: rid, text."""
    near = near_pairs(reps.select(F.col("fp").alias("node"), "print", "s0", "s1", "step"), RADIUS, SKETCH_RADIUS)
    rows = reps.select("fp", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    met = materialise(attach(rows, materialise(shared, "near-keys"), "key", "n", FEW_ROWS), "near-met")
    wide = met.groupBy("fp").agg(F.sum("size").alias("wide"))
    own = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(wide, "fp", "full")
    own = materialise(own, "near-own")
    sets = materialise(_sets(texts.join(reps.select("fp", "rid").join(own, "fp"), "rid"), words), "near-sets")
    roots = connected_components(_checked(near, sets), ALONE)
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "wide", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "near-rooted")

    apart = _apart(met.select("key", "fp"), rooted)
    if apart.isEmpty():
        return rooted.select(F.col("fp").alias("node"), "root")
    pivots = apart.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("wide", "fp", "root")).alias("p")).select("key", "n", F.col("p.fp").alias("b"), F.col("p.root").alias("b_root"))
    led = attach(apart, materialise(pivots, "near-pivots"), "key", "n", FEW_ROWS).filter("root <> b_root")
    stars = materialise(led.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct(), "near-stars")
    rooted = _merged(rooted, _checked(stars, sets))

    open_ = materialise(_apart(apart.select("key", "fp"), rooted).select("fp", "root").distinct(), "near-open")
    if not open_.isEmpty():
        rooted = _merged(rooted, _checked(_prefix_pairs(open_, sets), sets))
    return rooted.select(F.col("fp").alias("node"), "root")


def _merged(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """rooted (fp, root and others, a written table) after links (a, b) have connected its components, written."""
    root = lambda c: rooted.select(F.col("fp").alias(c), F.col("root").alias(f"{c}_root"))
    more = connected_components(links.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), ALONE)
    up = more.select(F.col("node").alias("root"), F.col("root").alias("up"))
    return materialise(rooted.join(up, "root", "left").withColumn("root", F.coalesce("up", "root")).drop("up"), "near-rooted")


def _apart(met: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of met (key, fp) whose key has members in more than one component, with what rooted says of fp, written."""
    dealt = materialise(met.join(rooted, "fp"), "near-dealt")
    mixed = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "n")
    return materialise(attach(dealt, materialise(mixed, "near-mixed"), "key", "n", FEW_ROWS), "near-apart")


def _prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, written) of members (fp, root) with different roots, among them all whose sets are similar enough.

    Shingles go by their number of members, rarest first. A pair of sizes x and y needs an overlap of AT_LEAST (x + y) /
    (1 + AT_LEAST); a shingle at the places i and j of the two leaves 1 + min(x - i, y - j) at most, counted from 1.
    """
    num, den = AT_LEAST
    each = materialise(sets.join(members, "fp").select("fp", "root", F.size("set").alias("size"), F.explode("set").alias("s")), "near-shingles")
    often = materialise(each.groupBy("s").agg(F.count("*").alias("n")).withColumn("often", F.col("n")), "near-often")
    order = F.array_sort(F.collect_list(F.struct("often", "s")))
    line = attach(each, often, "s", "n", FEW_ROWS).groupBy("fp", "root", "size").agg(order.alias("line"))
    # at most so many shingles of a set can be missing from a similar one, and one more
    head = line.select("fp", "root", "size", F.posexplode(F.slice("line", F.lit(1), F.col("size") - F.ceil(F.col("size") * num / den).cast("int") + 1)).alias("at", "x"))
    head = materialise(head.select("fp", "root", "size", "at", "x.s", "x.often").filter("often > 1"), "near-prefixes")
    tiles = F.ceil(F.col("often") / TILE).cast("int")
    side = lambda c: [F.col(n).alias(f"{c}{m}") for n, m in (("fp", ""), ("root", "_root"), ("size", "_size"), ("at", "_at"))]
    left = head.select("s", *side("a"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    right = head.select("s", *side("b"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"))
    reach = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    near = (F.col("a_root") < F.col("b_root")) & (reach * (num + den) >= (F.col("a_size") + F.col("b_size")) * num)
    return materialise(left.join(right, ["s", "tile"]).filter(near).select("a", "b").distinct(), "near-pairs")


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs, all columns, of which one row for each component of links stays: the one with the smallest doc_id.

    Null and empty texts have the same set. Rows that share the smallest doc_id, and null doc_ids: see first_of_each().
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column of the input can clash
    text, doc_id = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    marked = _with_keys(plain.select("*", F.col(text).cast("string").alias("text")), words).drop("text")
    table = materialise(marked.withColumn("rid", F.monotonically_increasing_id()), "near-docs")
    of_set = ["keys", "print", "s0", "s1", "step"]
    prints = table.select(F.col(doc_id).cast("long").alias("doc_id"), "fp", "rid", *of_set)
    group = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("rid", *of_set)).alias("r"))
    reps = materialise(group.select("fp", "least", "n", "r.*"), "near-fps")
    found = components(reps, table.select("rid", F.col(text).cast("string").alias("text")), words)
    comp = named(reps.select("fp", "least", "n"), found)
    return first_of_each(table.drop(*of_set), prints.drop(*of_set), comp).toDF(*names)
