"""Operator 9: SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are sorted into classes by the population counts of their four 16-bit quarters; a class is cut into
tiles of at most about TILE. Two fingerprints within RADIUS bits have quarter counts that differ by RADIUS at most in
sum, so tile pairs beyond that are never formed; the others are compared whole, with exclusive-or and bit counts in
numpy. Copies share a fingerprint and cost nothing. A tile pair returns the forest of its links, not all of them.

At a wide radius quarter counts part nothing, so near_pairs() has classes by the count of the whole fingerprint and by a step
of the caller's, and as links then are no copies yet, it returns pairs to be checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, attach, connected_components, materialise, plus, small_batches

WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a tile, 512 KB: of every two tiles that may be near one is copied to the other.
TILE = 65536
#: Class code: quarter counts to the base 17.
BASE = (1, 17, 289, 4913)
#: Files of a table whose size has a bound.
BOUNDED = 4
#: Rows of a tile compared with another tile at once; bounds the working memory at 8 TILE bytes times this.
ROWS = 64
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: near_pairs(): least and most rows of a tile, and the share of all rows that it has between these.
WIDE_TILE = (4096, 131072)
WIDE_SHARE = 32
#: near_pairs(): rows and columns compared at once, which a core's cache holds.
BLOCK = (16, 4096)
#: near_pairs(): a node with at most so many near ones is paired with all of them, others with the one in their middle.
FEW = 4
#: near_pairs(): population counts of a class.
COUNTS = 16
#: near_pairs(): hits of a tile pair that are held; if there are more, they are found twice.
HELD = 1 << 20


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of a text: a bit is set if it is set in over half the hashes. No words: zero."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only and splits at 0x20, 0x09-0x0D
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    if n < 1:
        shingles, n = [b" ".join(tokens)], 1
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some unsigned 64-bit hashes."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(h), CHUNK):
        part = h[lo : lo + CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, words: int = WORDS, name: str = "fp") -> DataFrame:
    """docs with the fingerprint of `text` as a signed long in a column more."""
    at = docs.columns.index("text")
    schema = plus(docs, **{name: "long"})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, name])

    small_batches(docs)
    return docs.mapInArrow(work, schema)


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts with a sum of at most radius; one of each two opposite ones, and zero."""
    return [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[j]) as links to the smallest member of each connected group."""
    nodes, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_a, out_b = [], []
        lists = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(0), batch.column(1))]
        same = batch.column(2).to_pylist()
        (va, oa), (vb, ob) = lists
        for r in range(batch.num_rows):
            a, b = va[oa[r] : oa[r + 1]], vb[ob[r] : ob[r + 1]]
            hit_i, hit_j = [], []
            for lo in range(0, len(a), ROWS):
                far = np.bitwise_count(a[lo : lo + ROWS, None] ^ b[None, :])
                i, j = np.nonzero(far <= radius)
                if same[r]:
                    up = i + lo < j
                    i, j = i[up], j[up]
                if len(i):
                    hit_i.append(i + lo)
                    hit_j.append(j)
                    if sum(map(len, hit_i)) > 1 << 20:  # keep a forest of what was found so far
                        x, y = _forest(a, b, np.concatenate(hit_i), np.concatenate(hit_j))
                        out_a.append(x)
                        out_b.append(y)
                        hit_i, hit_j = [], []
            if hit_i:
                x, y = _forest(a, b, np.concatenate(hit_i), np.concatenate(hit_j))
                out_a.append(x)
                out_b.append(y)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).view(np.int64)) for o in (out_a, out_b)], ["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fps (fp long, distinct, read twice): links (a, b) that connect exactly the fingerprints within radius bits."""
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int")
    classed = fps.select("fp", sum(quarter(k) * BASE[k] for k in range(4)).alias("cls"))
    # at most 17^4 classes, so their counts can be broadcast
    count = materialise(classed.groupBy("cls").agg(F.count("*").alias("n")).coalesce(BOUNDED), "simhash-classes")
    tiles = classed.join(F.broadcast(count), "cls").groupBy("cls", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile)).alias("tile")).agg(F.collect_list("fp").alias("fps"))
    tiles = materialise(tiles, "simhash-tiles")
    digit = lambda c, k: F.floor(c / BASE[k]).cast("int") % 17
    own = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(s)]) for s in _steps(radius)])
    near = F.filter(own, lambda s: _all(*[(digit(F.col("cls"), k) + s[f"d{k}"]).between(0, 16) for k in range(4)]))
    to = F.transform(near, lambda s: F.col("cls") + sum(s[f"d{k}"] * BASE[k] for k in range(4)))
    parts = count.select(F.col("cls").alias("to"), F.ceil(F.col("n") / tile).alias("parts"))
    pairs = count.select("cls", F.explode(to).alias("to")).join(F.broadcast(parts), "to")
    pairs = materialise(pairs.coalesce(BOUNDED), "simhash-class-pairs").groupBy("cls").agg(F.collect_list(F.struct("to", "parts")).alias("to"))
    # each two tiles are a key of their own tile: no class, however full, meets in one task
    left = tiles.join(pairs, "cls").select(F.col("cls").alias("a_cls"), F.col("tile").alias("a_tile"), F.col("fps").alias("a"), F.explode("to").alias("to"))
    first = F.when(F.col("a_cls") == F.col("to.to"), F.col("a_tile")).otherwise(F.lit(0).cast("long"))
    left = left.select("a_cls", "a_tile", "a", F.col("to.to").alias("cls"), F.explode(F.sequence(first, F.col("to.parts") - 1)).alias("tile"))
    met = left.join(tiles, ["cls", "tile"])
    met = met.select("a", F.col("fps").alias("b"), ((F.col("a_cls") == F.col("cls")) & (F.col("a_tile") == F.col("tile"))).alias("same"))
    return met.mapInArrow(lambda it: _compare(it, radius), "a long, b long")


def _all(*conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _hits(a: list[np.ndarray], b: list[np.ndarray], same: bool, radius: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Places i, j of near rows of two tiles (node, print, s0, s1), and how many bits their sketches differ in."""
    rows, cols = BLOCK
    xor, far = np.empty(BLOCK, np.uint64), np.empty(BLOCK, np.uint8)
    for lo in range(0, len(a[1]), rows):
        p = a[1][lo : lo + rows, None]
        for k in range(lo // cols * cols if same else 0, len(b[1]), cols):
            q = b[1][None, k : k + cols]
            x, c = xor[: p.shape[0], : q.shape[1]], far[: p.shape[0], : q.shape[1]]
            np.bitwise_count(np.bitwise_xor(p, q, out=x), out=c)
            i, j = np.divmod(np.flatnonzero(c <= radius), q.shape[1])
            i, j = i + lo, j + k
            if same:
                i, j = i[i < j], j[i < j]
            d = np.bitwise_count(a[2][i] ^ b[2][j]) + np.bitwise_count(a[3][i] ^ b[3][j])
            if (near := d <= most).any():
                yield i[near], j[near], d[near]


def _thinned(a: list[np.ndarray], b: list[np.ndarray], same: bool, radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of two tiles: node, how many near ones it has, the heaviest of them, its weight, and all of them if they are FEW.

    The weight of a row is the sum of the nearness of its near rows: in a group of copies it is the largest for what they
    were copied from.
    """
    degree, weight = ([np.zeros(len(t[0]), np.int64) for t in (a, b)] for _ in range(2))
    held, n = [], 0
    for i, j, d in _hits(a, b, same, radius, most):
        for side, at in enumerate((i, j)):
            np.add.at(degree[0 if same else side], at, 1)
            np.add.at(weight[0 if same else side], at, most + 1 - d.astype(np.int64))
        n += len(i)
        held = [*held, (i, j)] if n <= HELD else []
    if not n:
        return
    if same:
        degree[1], weight[1] = degree[0], weight[0]
    order = [np.argsort(w, kind="stable") for w in weight]
    rank = [np.argsort(o) for o in order]
    best = [np.full(len(t[0]), -1) for t in (a, b)]
    few = [([], []), ([], [])]
    for i, j, *_ in held if n <= HELD else _hits(a, b, same, radius, most):
        for side, (at, to) in enumerate(((i, j), (j, i))):
            own = 0 if same else side
            np.maximum.at(best[own], at, rank[1 - side][to])
            all_ = degree[own][at] <= FEW
            few[own][0].append(at[all_])
            few[own][1].append((b, a)[side][0][to[all_]])
    for side, (own, other) in enumerate(((a, b), (b, a))[: 1 if same else 2]):
        at, nodes = (np.concatenate(c) for c in few[side])
        near = np.flatnonzero(degree[side])
        to = order[1 - side][best[side][near]]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(own[0]))[near])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(nodes[np.argsort(at, kind="stable")]))
        columns = [own[0][near], degree[side][near], weight[1 - side][to], other[0][to]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["a", "n", "w", "b", "few"])


def _meet(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for c in (batch.column(0), batch.column(1)):
            fields = [c.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
            sides.append(([fields[0], *[f.view(np.uint64) for f in fields[1:]]], c.offsets.to_numpy()))
        same = batch.column(2).to_pylist()
        (fa, oa), (fb, ob) = sides
        for r in range(batch.num_rows):
            yield from _thinned([f[oa[r] : oa[r + 1]] for f in fa], [f[ob[r] : ob[r + 1]] for f in fb], same[r], radius, most)


def near_pairs(items: DataFrame, radius: int, most: int, tile: int | None = None) -> DataFrame:
    """items (node, print, s0, s1, longs, step, a written table; nodes are distinct): pairs (a < b, written) of near nodes.

    Near are nodes whose prints differ in at most radius bits, whose sketches s0, s1 differ in at most `most` and whose steps
    (few, from 0) differ by one at most. A node with more than FEW near ones is paired with the one in the middle of them only.
    """
    spark = items.sparkSession
    kinds = 64 // COUNTS + 1
    classed = items.withColumn("cls", (F.col("step") * kinds + F.floor(F.bit_count("print") / COUNTS)).cast("int"))
    count = {r["cls"]: r["n"] for r in classed.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # some for each step
    tile = tile or min(max(sum(count.values()) // WIDE_SHARE, WIDE_TILE[0]), WIDE_TILE[1])
    parts = {c: -(-n // tile) for c, n in count.items()}
    dealt = classed.join(F.broadcast(spark.createDataFrame([*parts.items()], "cls int, parts int")), "cls")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = materialise(dealt.groupBy("cls", "tile").agg(F.collect_list(F.struct("node", "print", "s0", "s1")).alias("rows")), "wide-tiles")
    # counts of two classes that lie d classes apart differ by COUNTS * (d - 1) + 1 at least
    reach = lambda c, t: t // kinds - c // kinds <= 1 and COUNTS * (abs(t % kinds - c % kinds) - 1) + 1 <= radius
    pairs = spark.createDataFrame([(c, t, parts[t]) for c in parts for t in parts if c <= t and reach(c, t)], "cls int, to int, parts int")
    left = tiles.join(F.broadcast(pairs), "cls")
    first = F.when(F.col("cls") == F.col("to"), F.col("tile")).otherwise(F.lit(0))
    left = left.select(F.col("cls").alias("a_cls"), F.col("tile").alias("a_tile"), F.col("rows").alias("a"), F.col("to").alias("cls"), F.explode(F.sequence(first, F.col("parts") - 1)).alias("tile"))
    # a number of its own, as AQE would put much work into few tasks by its few bytes
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = left.repartition(n, "cls", "tile").join(tiles.repartition(n, "cls", "tile").hint("merge"), ["cls", "tile"])
    met = met.select("a", F.col("rows").alias("b"), ((F.col("a_cls") == F.col("cls")) & (F.col("a_tile") == F.col("tile"))).alias("same"))
    found = materialise(met.mapInArrow(lambda it: _meet(it, radius, most), "a long, n long, w long, b long, few array<long>"), "wide-hits")
    each = found.groupBy("a").agg(F.sum("n").alias("n"), F.max(F.struct("w", "b"))["b"].alias("b"), F.flatten(F.collect_list("few")).alias("few"))
    pairs = each.select("a", F.explode(F.when(F.col("n") <= FEW, F.col("few")).otherwise(F.array("b"))).alias("b"))
    return materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "wide-pairs")


def components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """prints (doc_id, fp, a written table): fp, component_id and n (rows with that fp) for each fingerprint."""
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-fps")
    return named(fps, connected_components(links(fps.select("fp"), radius, tile)))


def named(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """fps (fp, least doc_id, n, a written table) and the roots of linked ones: fp, component_id and n, written."""
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"), F.count("*").alias("fps"))
    single = rooted.join(least.filter("fps > 1").drop("fps", "rows"), "root", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    return materialise(single.select("fp", "component_id", "n"), "simhash-components")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id in reach. Null and empty texts have fingerprint zero, which links like any other;
    a null doc_id is never a component_id unless its component has no other; repeated rows give repeated rows; an empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialise(with_fingerprint(rows, words).select("doc_id", "fp"), "simhash-prints")
    return attach(prints, components(prints, radius), "fp", "n").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, of which one row for each component stays: the one with the smallest doc_id.

    Among rows with the same smallest doc_id the first written one stays; rows with null doc_id come last.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column of the input can clash
    text = plain.select("*", F.col(f"c{names.index('text')}").cast("string").alias("text"))
    marked = with_fingerprint(text, words).drop("text").withColumn("rid", F.monotonically_increasing_id())
    table = materialise(marked, "simhash-docs")
    prints = table.select(F.col(f"c{names.index('doc_id')}").cast("long").alias("doc_id"), "fp", "rid")
    return first_of_each(table, prints, components(prints, radius)).toDF(*names)


def first_of_each(table: DataFrame, prints: DataFrame, comp: DataFrame) -> DataFrame:
    """The row of table (rid, fp and others, written) with the smallest doc_id of each component, without rid and fp.

    prints: doc_id, fp, rid. Among rows with the same smallest doc_id the first written one stays; rows with null doc_id
    come last.
    """
    best = attach(prints, comp.withColumn("key", F.col("component_id")), "fp", "n", FEW_ROWS)
    # a component is named by its smallest doc_id; fingerprints without any doc_id are named by themselves
    name = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    keep = best.groupBy(name.alias("name")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    return table.join(keep.select(F.col("first.rid").alias("rid")), "rid", "left_semi").drop("rid", "fp")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
