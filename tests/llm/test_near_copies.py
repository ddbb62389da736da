"""The near-duplicate stage of the pipeline against planted near copies and exact similarities."""

import random

import numpy as np
import pytest

from rivulet.llm import nearcopies


def similarity(a, b):
    return len(a & b) / len(a | b)


def plain_sets(texts):
    def cut(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])

    return [cut(t) for t in texts]


def plain_kept(rows):
    """doc_ids that are the smallest of their component, by all pairs."""
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index.get(x, ())}:
            if similarity(s, sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            index.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_recall_of_keys_at_the_threshold():
    """2,000 pairs of similarity 0.80 to 0.82: at least 0.999 share a key (1 - (1 - 0.8^5)^24 is 0.9999)."""
    rng = random.Random(3)
    met = 0
    for _ in range(2000):
        n = rng.randrange(30, 300)
        words = [str(rng.getrandbits(40)) for _ in range(n)]
        shared = nearcopies.shingles(" ".join(words))
        more = len(shared) // 4
        far = nearcopies.shingles(" ".join(str(rng.getrandbits(40)) for _ in range(more + 4)))
        both = [set(shared.tolist()), set(shared.tolist()) | set(far.tolist())]
        assert 0.8 <= similarity(*both) < 0.83
        a, b = (nearcopies.keys(np.array(sorted(s), np.uint64)) for s in both)
        met += any(x == y for x, y in zip(a, b, strict=True))
    assert met >= 1998


def test_planted_near_copies_go(spark):
    """Groups of copies with a few words changed, one of them large: links as by all pairs, though up to 17 bits apart."""
    rng = random.Random(8)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 250))]
        for k in range(60 if g == 0 else 4):
            own = list(base)
            for _ in range(0 if k == 0 else rng.randrange(1, max(2, len(own) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "one two", "One  TWO", "one two three"])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(4)
    kept = nearcopies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_equals_all_pairs(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = cp.near_duplicates(spark, docs, f"/root/testdata/{sf}")
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_links_come_from_the_fingerprints(spark):
    """Operator 9's tiles link pairs of similarity 0.80 to 0.83 and a large group of near copies, where no keys are shared."""
    rng = random.Random(5)
    groups = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 300))] for _ in range(300)]
    texts = []
    for g, base in enumerate(groups):
        texts.append(" ".join(base))
        for _ in range(200 if g == 0 else 1):
            # a word changed changes five shingles of each
            own = list(base)
            for k in range(max((len(base) - 4) // 50, 1)):
                own[20 + 25 * k % (len(own) - 40)] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(own))
    docs = nearcopies.materialise(spark.createDataFrame([*enumerate(texts)], "rid long, text string").repartition(4), "test-docs")
    marked = nearcopies._with_keys(docs, nearcopies.WORDS)
    first = [0, *range(201, len(texts), 2)]
    alone = nearcopies.materialise(marked.drop("text").withColumn("keys", nearcopies.F.array("rid")), "test-reps")
    node = {r["rid"]: r["fp"] for r in alone.collect()}
    root = {r["node"]: r["root"] for r in nearcopies.components(alone, docs).collect()}
    sets = plain_sets(texts)
    pairs = [(0, k) for k in range(1, 201)] + [(k, k + 1) for k in first[1:]]
    pairs = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) >= 0.8]
    together = sum(root.get(node[a], a) == root.get(node[b], b) for a, b in pairs)
    assert len(pairs) > 400 and together >= 0.995 * len(pairs)
    assert len({root[node[k]] for k in first if node[k] in root}) == len([k for k in first if node[k] in root])


def test_tiles_at_a_wide_radius(spark):
    """Every pair of few near ones is returned, whatever the tiles; in a large group each is paired with the middle."""
    from rivulet.llm import simhash

    rng = random.Random(6)
    rows = []
    for _ in range(60):
        fp, s, step = rng.getrandbits(64), rng.getrandbits(64), rng.randrange(6)
        for _ in range(3):
            rows.append((len(rows), fp ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 12))), s ^ (1 << rng.randrange(64)), 0, step + rng.randrange(3)))
    fp, n = rng.getrandbits(64), len(rows)
    rows.append((n, fp, 0, (1 << 40) - 1, 9))
    rows += [(n + 1 + k, fp ^ (1 << k % 64) ^ (1 << rng.randrange(64)), 0, sum(1 << b for b in rng.sample(range(40, 64), 4)) | (1 << 40) - 1, 9) for k in range(100)]
    signed = [(r[0], *[x - (1 << 64) if x >> 63 else x for x in r[1:]]) for r in rows]
    items = nearcopies.materialise(spark.createDataFrame(signed, "node long, print long, s0 long, s1 long, step int"), "test-items")
    d = lambda a, b: (rows[a][1] ^ rows[b][1]).bit_count()
    far = lambda a, b: sum((rows[a][k] ^ rows[b][k]).bit_count() for k in (2, 3))
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if d(a, b) <= 22 and far(a, b) <= 20 and abs(rows[a][4] - rows[b][4]) <= 1}
    for tile in (None, 16):
        got = {(r["a"], r["b"]) for r in simhash.near_pairs(items, 22, 20, tile).collect()}
        assert {p for p in got if p[1] < n} == want
        assert len({p for p in got if p[0] == n}) == 100
        assert len({p for p in got if p[0] >= n}) <= 101


def test_few_plans_for_a_small_table(spark):
    """The driver keeps memory for each plan: 62 of them for 1,000 documents took it over its limit in the pipeline."""
    plans = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = plans()
    nearcopies.one_of_each(docs).write.format("noop").mode("overwrite").save()
    assert plans() - before <= 52


def test_few_links_are_connected_in_one_task(spark):
    from rivulet.llm import common

    rng = random.Random(7)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(k + 1, k) for k in range(1000, 1100)] + [(7, 7)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    rounds, one = ({r["node"]: r["root"] for r in common.connected_components(edges, n).collect()} for n in (0, 1000))
    assert one == rounds and len(one) > 200
    assert common.connected_components(edges.limit(0), 1000).count() == 0


@pytest.mark.parametrize("n", [30, nearcopies.SHARE + 200])
def test_pairs_are_checked_alike_few_or_crowded(spark, n):
    rng = random.Random(9)
    own = {k: sorted({*range(rng.randrange(10), 40)}) for k in range(n)}
    sets = nearcopies.materialise(spark.createDataFrame([*own.items()], "fp long, set array<long>").repartition(3), "test-sets")
    pairs = nearcopies.materialise(spark.createDataFrame([(0, k) for k in range(1, n)], "a long, b long"), "test-pairs")
    got = {(r["a"], r["b"]) for r in nearcopies._checked(pairs, sets).collect()}
    assert got == {(0, k) for k in range(1, n) if similarity({*own[0]}, {*own[k]}) >= 0.8}


def test_a_small_left_side_is_joined_once(spark):
    from rivulet.operators.skew import attach

    left = spark.createDataFrame([(k % 7, k) for k in range(300)] + [(None, -1)], "key long, x long")
    right = spark.createDataFrame([(k, k * 10, 50) for k in range(7)], "key long, v long, n long")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    few = attach(left, right, "key", "n", 1000)
    assert rows(few) == rows(attach(left, right, "key", "n")) and len(rows(few)) == 300
    assert "Union" not in few._jdf.queryExecution().optimizedPlan().toString()
