"""What is compared in tiles: against all pairs, with tiles so small that many meet."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from rivulet.operators import search, vectors

T0 = datetime(2024, 1, 1)


def grams_of(title):
    return {p[i : i + 3] for w in title.split() for p in (f"  {w} ",) for i in range(len(p) - 2)}


@pytest.mark.parametrize("tile", [7, 4096])
def test_title_pairs_equal_all_pairs_whatever_the_tiles(spark, tile):
    rng = random.Random(5)
    words = ["the", "ing", "ther", "ation", "ends", "over", "onan", "reth", "stan", "dein"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(90)]
    rows = [(i, rng.choice(titles), T0 + timedelta(hours=rng.randrange(150))) for i in range(160)]
    want = set()
    for a, t, p in rows:
        for b, u, q in rows:
            if a < b and abs(p - q) < timedelta(hours=48):
                x, y = grams_of(t), grams_of(u)
                if len(x & y) / len(x | y) >= 0.6:
                    want.add((a, b, round(len(x & y) / len(x | y), 9)))
    got = search.title_pairs(spark.createDataFrame(rows, "id long, title string, published_at timestamp_ntz"), 0.6, tile=tile).collect()
    assert len(got) == len(want) and {(r["a"], r["b"], round(r["similarity"], 9)) for r in got} == want


@pytest.mark.parametrize("tile", [5, 1024])
def test_semantic_candidates_and_winners_equal_all_pairs_whatever_the_tiles(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 6))
    rows = [(i, "m" if i % 3 else "n", T0 + timedelta(hours=int(rng.integers(0, 300))), (base[i % 12] + rng.standard_normal(6) * 0.2 * (i % 2)).astype(np.float32).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, model string, published_at timestamp_ntz, vector array<float>")
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    near, winners = {}, {}
    for a, m, p, v in rows:
        own = [(b, q, cos(v, w)) for b, o, q, w in rows if b != a and o == m and abs(p - q) <= timedelta(days=3)]
        near[a] = [b for b, _, s in sorted(own, key=lambda r: (-round(r[2], 9), r[0])) if s >= 0.9][:5]
        earlier = [(q, b) for b, q, s in own if s >= 0.9 and (q, b) < (p, a)]
        if earlier:
            winners[a] = min(earlier)[1]
    got = {}
    for r in sorted(vectors.semantic_candidates(df, least=0.9, tile=tile).collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["other"])
    assert got == {a: b for a, b in near.items() if b}
    assert {r["id"]: r["winner"] for r in vectors.semantic_winners(df, 0.9, tile=tile).collect()} == winners


def test_words_of_documents_are_grouped_without_a_sort(spark):
    rows = [(1, "A b, a été", "b c", "c c a"), (1, "c", None, "b"), (2, "", "", "x_1"), (3, None, None, None)]
    d = spark.createDataFrame(rows, "id long, title string, summary string, body string")
    got = search.document_words(d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.words_by_document(search.postings(d)).collect()))
    assert {(r["id"], r["lexeme"]): (r["n"], r["first_pos"], r["best_weight"]) for r in got.collect()}[1, "c"] == (8, 1, "A")
    assert all("SortAggregate" not in df._jdf.queryExecution().executedPlan().toString() for df in (got, search.words_by_document(search.postings(d))))
