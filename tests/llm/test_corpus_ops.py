"""Operators on whole tables: language, SimHash, mixing, chat, top-k, vector links, the pipeline; against brute force."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rivulet.llm import chat, common, embnn, langid, mixing, queries, simhash, topk

WORDS = queries.tokenizer("word_bpe_49k.json")

# ---------------------------------------------------------------- components


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(1500, 1560)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p if p[0] != p[1]}
    assert got == plain_components(nodes, [p for p in links if p[0] != p[1]])
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_joins_hot_and_other_keys(spark):
    left = spark.createDataFrame([(0, k) for k in range(3000)] + [(k, k) for k in range(1, 2500)] + [(None, -1)], "key long, x long")
    right = left.groupBy("key").agg(F.count("*").alias("n")).filter("key is not null").withColumn("v", F.col("key") * 2)
    got = common.attach(left, right, "key", "n").collect()
    assert len(got) == 5499 and all(r["v"] == 2 * r["key"] for r in got)


# ---------------------------------------------------------------- language


def test_ppm_code_lengths_are_exact():
    """The bits of a byte against PPM written out with sets and dictionaries."""
    text = "the rain in spain, the brain in vain. été à la fête"
    p = langid.Ppm([text.encode()])
    data = langid.PREFIX + text.encode()
    count = {}
    for i in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER + 1):
            c = count.setdefault(data[i - k : i], {})
            c[data[i]] = c.get(data[i], 0) + 1

    def plain(context, x):
        prob, out = 1.0, set()
        for k in range(langid.ORDER, -1, -1):
            c = count.get(context[langid.ORDER - k :])
            if c is None:
                continue
            own = {s: n for s, n in c.items() if s not in out}
            total = sum(own.values()) + len(own)
            if x in own:
                return -np.log2(prob * own[x] / total)
            if own:
                prob *= len(own) / total
            out |= set(c)
        return -np.log2(prob / (256 - len(out)))

    rng = random.Random(1)
    alphabet = b"thraine ,.vs\n\xc3\xa9zQ"
    grams = [bytes(rng.choice(alphabet) for _ in range(langid.ORDER + 1)) for _ in range(2000)]
    bits = p.bits(np.array([int.from_bytes(g, "big") for g in grams], np.uint64))
    assert np.allclose(bits, [plain(g[:-1], g[-1]) for g in grams])


def test_scores_do_not_depend_on_neighbours_or_chunks(monkeypatch):
    m = langid.Model({"en": ["the rain in spain falls"] * 3, "fr": ["la pluie en espagne tombe"] * 3})
    texts = ["the rain", "la pluie", "x", "é" * 50, "\x00\x01 odd zz", "the rain in spain " * 40]
    whole = m.lengths([t.encode() for t in texts])
    assert np.allclose(whole, np.concatenate([m.lengths([t.encode()]) for t in texts]))
    by_gram = np.array([[sum(p.bits(np.array([int.from_bytes((langid.PREFIX + t.encode())[i : i + 4], "big") for i in range(len(t.encode()))], np.uint64))) for p in m.ppm] for t in texts])
    assert np.allclose(whole, by_gram, rtol=1e-5)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.allclose(whole, m.lengths([t.encode() for t in texts]))


def test_language_query_equals_ppm_written_out(spark, sf):
    """Every byte of every text in every language by dictionaries over the query's own sample: language, score and ties."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample = langid.sample(docs)
    assert sum(map(len, sample.values())) > 50
    counts = {}
    for lang, texts in sample.items():
        count = counts[lang] = {}
        for t in texts:
            data = b"\n" * 3 + t.encode()
            for i in range(3, len(data)):
                for k in range(4):
                    c = count.setdefault(data[i - k : i], {})
                    c[data[i]] = c.get(data[i], 0) + 1

    def bits(count, gram, known):
        if gram not in known:
            prob, out = 1.0, set()
            for k in (3, 2, 1, 0):
                own = {s: n for s, n in count.get(gram[3 - k : 3], {}).items() if s not in out}
                total = sum(own.values()) + len(own)
                if gram[3] in own:
                    prob *= own[gram[3]] / total
                    break
                if own:
                    prob *= len(own) / total
                out |= set(own)
            else:
                prob /= 256 - len(out)
            known[gram] = -np.log2(prob)
        return known[gram]

    known = {lang: {} for lang in counts}
    want = {}
    for r in docs.collect():
        data = b"\n" * 3 + (r["text"] or "").encode()
        if not any(c.isalpha() for c in r["text"] or ""):
            want[r["doc_id"]] = ("und", 0.0)
            continue
        mean = {lang: sum(bits(c, data[i - 3 : i + 1], known[lang]) for i in range(3, len(data))) / (len(data) - 3) for lang, c in counts.items()}
        best = min(sorted(mean), key=mean.get)
        want[r["doc_id"]] = (best, 1 / sum(2 ** ((mean[best] - m) * langid.STRETCH) for m in mean.values()))
    for r in queries.op8_language(spark, sf).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-4)


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_language(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark):
    rows = [(1, "the rain in spain", "en"), (2, None, "en"), (3, "", "fr"), (4, "12 34 !?", None), (None, "la pluie", "fr"), (5, "la pluie en espagne", "fr"), (5, "la pluie en espagne", "fr"), (6, "the " * 50_000, None)]
    rows = [(d, t, g, "clash") for d, t, g in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    more = spark.createDataFrame([(k, t, g, "x") for k, (t, g) in enumerate([("the rain in spain stays in the plain", "en"), ("la pluie en espagne tombe", "fr")] * 8, 100)], docs.schema)
    model = langid.train(docs.unionByName(more))
    got = sorted(langid.identify(docs, model).collect(), key=lambda r: r["doc_id"] or 0)
    assert [r["lang_pred"] == "und" for r in got] == [False, False, True, True, True, False, False, False]
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    kept = langid.keep_identified(docs, model)
    assert kept.count() == 5 and kept.columns == docs.columns
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(blank, langid.train(blank)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text, words=3):
    out, cur = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c in " \t\n\x0b\x0c\r":
            out, cur = ([*out, cur] if cur else out), ""
        else:
            cur += c
    out = [*out, cur] if cur else out
    if not out:
        return 0
    sh = [" ".join(out[i : i + words]) for i in range(len(out) - words + 1)] or [" ".join(out)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_simhash(rows, words=3):
    fps = {t: plain_fingerprint(t, words) for _, t in rows}
    values = sorted(set(fps.values()))
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    root = plain_components(values, links)
    least = {}
    for d, t in rows:
        least[root[fps[t]]] = min(d, least.get(root[fps[t]], d))
    return sorted((d, f"{fps[t]:016x}", least[root[fps[t]]]) for d, t in rows)


def test_simhash_query_equals_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert sorted(map(tuple, queries.op9_simhash(spark, sf).collect())) == plain_simhash(rows)


def test_simhash_links_with_small_tiles(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    values = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(12)} | set(range(40)) | {2**64 - 1}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(signed, "fp long"), tile=4).collect()]
    links = [(a % 2**64, b % 2**64) for a, b in links]
    assert all((a ^ b).bit_count() <= 3 * len(values) for a, b in links)
    want = plain_components(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3])
    assert plain_components(values, links) == want


def test_simhash_odd_rows(spark):
    rows = [(5, None), (4, " \t"), (9, "One two  THREE four"), (8, "one two three four"), (7, "one two"), (7, "one two"), (None, "one two"), (None, "alone here now you see"), (3, "word " * 60_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(5, 4), (4, 4), (9, 8), (8, 8), (7, 7), (None, 7), (None, None)} <= got
    kept = simhash.one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(((r["doc_id"] or 0) for r in kept.collect())) == [0, 3, 4, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


def test_mixing_reaches_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    labelled = mixing.domain_of(spark.read.parquet(f"{sf}/labels.parquet"))
    mixed, domains, report = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), labelled, WORDS)
    rows = mixed.collect()
    t, p, r = (np.array([x[c] for x in rows]) for c in ("mix_tokens", "mix_p", "mix_rate"))
    assert len(rows) == 1000 and (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    reached = (t * r) @ p
    want = np.array([report["target"][d] for d in domains])
    assert np.abs(reached - want).max() < 0.002 * t.sum()
    assert np.allclose(reached, [report["reached"][d] for d in domains])


def test_fit_equals_dense_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    t = rng.integers(1, 500, 200)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "mix_tokens long, mix_p array<double>").repartition(5)
    rates, report = mixing.fit(table, ["a", "b", "c"], targets={"a": 0.7, "b": 0.3}, most=3.0)
    natural = t @ p
    goal = natural.sum() * np.array([0.7, 0.3, 0])
    r = np.ones(200)
    for _ in range(20_000):
        r = np.clip(r - rates.step * (p @ (((t * r) @ p - goal) / natural)), 0, 3.0)
    loss = lambda x: (((t * x) @ p - goal) ** 2 / natural).sum()
    assert loss(rates(p)) <= loss(r) + 0.01 * loss(np.ones(200)) and rates(p).min() >= 0 and rates(p).max() <= 3
    assert report["steps"] == len(rates.history)


def plain_posterior(model, text):
    """Logistic regression on the presence of words and the form of the text, written out."""
    text = text or ""
    words = re.findall(r"[^\W\d_]+", text.lower())
    letters, n, m, lines = sum(len(w) for w in words), max(len(text), 1), max(len(words), 1), text.split("\n")
    form = [np.log1p(n) / 12, letters / n, len({*text.lower().split()}) / max(len(text.split()), 1), len({*lines}) / len(lines), min(letters / m / 12, 2), min(text.count("|") / m, 1), min(sum(c in "0123456789" for c in text) / n * 4, 1), min(sum(c in ".!?" for c in text) / m * 4, 1)]
    size = len(model.vocabulary)
    x = np.zeros(size + len(form) + 1)
    for w in {*words} & {*model.vocabulary}:
        x[model.vocabulary[w]] = 1
    x[size:-1], x[-1] = form, 1
    z = np.exp(x @ model.weights - (x @ model.weights).max())
    return z / z.sum()


def test_mixing_query_equals_its_dense_version(spark, sf):
    """Tokens by the tokenizer, posteriors written out, rates by plain projected gradient to the end, copies by the hash."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = mixing.train(docs, mixing.domain_of(spark.read.parquet(f"{sf}/labels.parquet")))
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rows = sorted(docs.select("doc_id", "text", u.alias("u")).collect())
    tok = Tokenizer.from_file(WORDS)
    t = np.array([max(1, len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows])
    p = np.array([plain_posterior(model, r["text"]) for r in rows])
    natural = t @ p
    w = np.array([mixing.TARGETS[d] for d in model.domains])
    goal = natural.sum() * w / w.sum()
    r, step = np.ones(len(t)), 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p / np.sqrt(np.outer(natural, natural))).max()
    for _ in range(50_000):
        r = np.maximum(r - step * (p @ ((p.T @ (t * r) - goal) / natural)), 0)
    got = sorted(queries.op4_mixing(spark, sf).collect())
    assert [x["doc_id"] for x in got] == [x["doc_id"] for x in rows] and [x["n_tokens"] for x in got] == t.tolist()
    assert np.allclose([[x[f"p_{d}"] for d in model.domains] for x in got], p)
    rate = np.array([x["rate"] for x in got])
    # rates of the least squares are not unique, the totals are: both meet the targets, and one step further moves nothing
    for own in (r, rate):
        assert np.abs(p.T @ (t * own) - goal).max() < 2e-4 * natural.sum(), (p.T @ (t * own), goal)
    assert np.abs(np.maximum(rate - step * (p @ ((p.T @ (t * rate) - goal) / natural)), 0) - rate).max() < 0.01
    assert np.corrcoef(r, rate)[0, 1] > 0.98
    assert [x["copies"] for x in got] == [int(np.floor(v + x["u"])) for v, x in zip(rate, rows, strict=True)]
    for k, d in enumerate(model.domains):
        assert len({x[f"target_{d}"] for x in got}) == 1 and got[0][f"target_{d}"] == pytest.approx(goal[k])
        assert got[0][f"reached_{d}"] == pytest.approx(float(p.T[k] @ (t * rate)))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = mixing.domain_of(spark.read.parquet(f"{sf}/labels.parquet"))
    fit, test = labels.filter("doc_id % 4 <> 2"), labels.filter("doc_id % 4 = 2")
    model = mixing.train(docs, fit)
    rows = docs.join(test, "doc_id").select("text", "domain").collect()
    hit = [model.domains[int(np.argmax(model.posterior(r["text"])))] == r["domain"] for r in rows]
    most = max(np.mean([r["domain"] == d for r in rows]) for d in model.domains)
    assert np.mean(hit) > most


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", "c"), (2, None, "c"), (None, "", "c"), (3, "x " * 30_000, None), (3, "x", None)], "doc_id long, text string, mix_p string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (2, None, 0), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    mixed, _, _ = mixing.mix(docs, mixing.domain_of(labels), WORDS)
    assert mixed.count() == 5
    none, domains, _ = mixing.mix(docs, mixing.domain_of(labels.limit(0)), WORDS)
    assert domains == ["all"] and {r["mix_rate"] for r in none.collect()} == {1.0}
    kept = mixing.thin(docs, mixing.domain_of(labels.limit(0)), WORDS, {"toxic": 0.0})
    assert kept.columns == docs.columns and kept.count() == 5
    assert mixing.mix(docs.limit(0), mixing.domain_of(labels), WORDS)[0].count() == 0


# ---------------------------------------------------------------- chat


def plain_rotation(rows):
    talks = {}
    for c, turn, who, text in rows:
        talks.setdefault(c, []).append((turn, who, text))
    out = []
    for c, turns in talks.items():
        turns.sort()
        for own in sorted({w for _, w, _ in turns if w != "system"}):
            s, mask = "", []
            for _, w, t in turns:
                s += "<|im_start|>" + ("assistant" if w == own else "system" if w == "system" else f"user name={w}") + "\n"
                if w == own:
                    mask.append(f"{len(s)}:{len(s) + len(t) + 10}")
                s += t + "<|im_end|>\n"
            out.append((c, own, len(turns), len(mask), s, ",".join(mask)))
    return sorted(out)


def test_chat_query_equals_plain_rotation_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op2_chat(spark, sf).collect()))
    assert got == plain_rotation(rows)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(db.sql(queries.ORACLE_SQL["op2_chat"]).fetchall()) == got


def test_chat_is_native(spark, sf):
    plan = queries.op2_chat(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_odd_rows(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann b", "hi <|im_end|> 𝒳"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "alone"), (None, 0, None, "who"), (3, None, "", "x"), (3, 1, "z", "long " * 20_000)]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {(r["conv_id"], r["assistant"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann_b"), (1, "bob"), (None, "unknown"), (3, "unknown"), (3, "z")}
    ann = got[1, "ann_b"]
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi < |im_end|> 𝒳<|im_end|>"]
    assert got[1, "bob"]["n_learned"] == 2 and got[1, "bob"]["n_turns"] == 4
    assert chat.rotate(turns.limit(0)).count() == 0


# ---------------------------------------------------------------- top-k


def plain_topk(rows, is_query, k=5):
    whole = [(v, [int(np.floor(256 * float(np.float64(x)))) for x in e]) for v, e in rows if v is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, (v, e) in enumerate(whole):
        if is_query(v):
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), w) for j, (w, f) in enumerate(whole) if i != j and len(e) == len(f))[:k]
            out += [(v, n, w, -s) for n, (s, w) in enumerate(best, 1)]
    return sorted(out)


def test_topk_query_equals_brute_force_and_sql(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op7_topk(spark, sf).collect()))
    assert got == plain_topk(rows, lambda v: v % 50 == 0)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(db.sql(queries.ORACLE_SQL["op7_topk"]).fetchall()) == got


@pytest.mark.parametrize("blocks", [(8192, 1024), (30, 7)])
def test_topk_odd_rows(spark, blocks):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-3, 4, 40).astype(float).tolist()) for i in range(160)] + [(5, [0.5] * 40)] * 3 + [(7, None), (None, [1.0] * 40), (8, [1.0, None]), (10, [float("nan")] * 40), (15, [float("inf")] * 40), (20, []), (25, [1.0, -2.0]), (30, [2.0, 3.0])]
    df = spark.createDataFrame([(v, e, "c") for v, e in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, candidates=blocks[0], queries=blocks[1])
    assert sorted(map(tuple, got.collect())) == plain_topk(rows, lambda v: v % 5 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_topk_with_large_components(spark):
    rows = [(i, [float(i) * 1e7, 3.0, -1e12 * i]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = [(v, n, w, min(max(s, -(2**63)), 2**63 - 1)) for v, n, w, s in plain_topk(rows, lambda v: v % 2 == 0)]
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 2 == 0).collect()))
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in wide]


def test_search_drops_candidates_early():
    rng = np.random.default_rng(0)
    c = np.floor(256 * rng.standard_normal((64, 4000)) / 8)
    c[:16] *= 6
    best = topk.Best(20, 5)
    q = c[:, :20].T.copy()
    work = topk.search(q, np.arange(20), np.arange(20), c, np.arange(4000), np.arange(4000), best)
    assert work < 0.2 * 20 * 48 * 4000
    s = q @ c
    s[np.arange(20), np.arange(20)] = -np.inf
    assert all([x[0] for x in best.score[k]] == sorted(s[k].astype(object), reverse=True)[:5] for k in range(20))


# ---------------------------------------------------------------- vector links


def plain_links(rows, threshold=0.95):
    good = [(v, np.array(e, float)) for v, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = np.stack([e / np.abs(e).max() for _, e in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    root = plain_components(range(len(good)), list(zip(*np.nonzero(close), strict=True)))
    least = {}
    for k, (v, _) in enumerate(good):
        least[root[k]] = min(v, least.get(root[k], v))
    return sorted((v, int(close[k].sum()), least[root[k]], v == least[root[k]]) for k, (v, _) in enumerate(good))


def test_vector_query_equals_brute_force_and_sql(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op10_vectors(spark, sf).collect()))
    assert got == plain_links(rows)


@pytest.mark.parametrize(("dim", "level"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (32, 0), (64, 0), (128, 0), (384, 0), (768, 0), (8, 3), (24, 4), (64, 2), (64, 3), (64, 5), (64, 7), (384, 4)])
def test_vector_recall_at_the_threshold(dim, level):
    """Pairs of cosine 0.95 to 0.96 in random directions meet in a filter, whatever the dimensions and the size of the table."""
    n = 800
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    c = rng.uniform(0.95, 0.96, (n, 1))
    y = c * x + np.sqrt(1 - c * c) * z
    lists, size = [], 0
    for v in (x, y):
        row, code = embnn.decode_all(v / np.linalg.norm(v, axis=1, keepdims=True), level)
        size += len(row)
        lists.append([set(s.tolist()) for s in np.split(code, np.searchsorted(row, np.arange(1, n)))])
    recall = np.mean([bool(a & b) for a, b in zip(*lists, strict=True)])
    assert recall > 0.98 and size < 2 * n * 60, (recall, size / 2 / n)


def test_filters_keep_their_size():
    """Four times the vectors have four times the directions."""
    assert [embnn.level(n) for n in (0, 100_000, 100_001, 400_000, 400_001, 10**9)] == [0, 0, 1, 1, 2, 7]
    sizes = [embnn.Code(64, level=k).size for k in range(6)]
    assert all(3.8 < b / a < 4.2 for a, b in zip(sizes, sizes[1:], strict=False))


def test_list_decoding_finds_all_directions():
    code = embnn.Code(64)
    x = np.random.default_rng(2).standard_normal((50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, number = code.decode(x)
    turned = x @ code.turn
    a, b = (turned[:, lo:hi] @ w.T for (lo, hi), w in zip(zip(code.cuts, code.cuts[1:], strict=False), code.words, strict=True))
    every = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    want = {(i, j) for i, j in zip(*np.nonzero(every >= code.cap), strict=True)}
    lost = set(range(50)) - {i for i, _ in want}
    assert {(i, j) for i, j in zip(row.tolist(), number.tolist(), strict=True) if i not in lost} == want


@pytest.mark.parametrize("tile", [1024, 8])
def test_vector_odd_rows(spark, tile):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 16))
    rows = [(int(100 + i), (base[i % 12] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(150)]
    rows += [(3, rows[0][1])] * 2 + [(2, [10 * v for v in rows[5][1]]), (1, [1e-300] * 16), (4, [1e300] * 16), (6, [1.0, 2.0]), (5, [2.0, 4.0])]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (905, [float("inf")] * 16)]
    df = spark.createDataFrame([(v, e, "c") for v, e in rows + bad], "vec_id long, embedding array<double>, n string").repartition(3)
    got = sorted(map(tuple, embnn.link_vectors(df, tile=tile).collect()))
    long = [r for r in rows if len(r[1]) == 16]
    want = plain_links(long) + plain_links([r for r in rows if len(r[1]) == 2]) + [(v, 0, v, True) for v, _ in bad]
    assert got == sorted(want)
    assert embnn.link_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_its_plain_version(spark, sf):
    import corpus_pipeline as cp

    from tests.llm.test_near_copies import plain_kept

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    rows = sorted((r for r in docs.collect()), key=lambda r: r["doc_id"])
    lang, _, bits = model.predict([r["text"] for r in rows])
    rows = [r for r, g, b in zip(rows, lang, bits, strict=True) if g != "und" and b <= langid.MAX_BITS]
    first = cp.language(spark, docs, sf)
    assert first.columns == docs.columns and sorted(r["doc_id"] for r in first.collect()) == [r["doc_id"] for r in rows]
    # similarity 0.8 of five-word shingles, by all pairs
    keep = set(plain_kept([(r["doc_id"], r["text"]) for r in rows]))
    second = cp.near_duplicates(spark, first, sf)
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == keep
    third = cp.secrets(spark, second, sf)
    assert {r["doc_id"] for r in third.collect()} == keep
    from rivulet.llm import secretscan

    assert not any(secretscan.find(r["text"])[1] for r in third.collect())
    fourth = cp.mixture(spark, third, sf)
    left = {r["doc_id"] for r in fourth.collect()}
    assert left <= keep and fourth.columns == docs.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0").collect()} & keep
    assert len(clean & left) > 0.9 * len(clean) and len(toxic & left) <= 0.5 * max(len(toxic & keep), 1)
    from tests.llm.test_text_ops import check_pieces

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in fourth.collect()}
    check_pieces(cp.packed(spark, fourth, sf).collect(), ids)
    assert sorted({r["doc_id"] for r in cp.run(spark, sf).collect()}) == sorted(left)


def test_pipeline_on_odd_and_empty_tables(spark, sf, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, ties, and columns with the names of inner ones."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    long = "the rain in spain stays mainly in the plain and " * 20_000
    rows = [(None, None, "en", "s", 0), (None, "", "en", "s", 0), (None, "words without an id, token=abcdef1234", None, None, None), (900_001, long, "en", "s", len(long)), (900_002, None, None, None, None), (900_003, "12 34", "en", "s", 5)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(docs.limit(7)).unionByName(docs.limit(7))
    for name in ("fp", "rid", "mix_p", "mix_tokens", "c0", "part", "n", "text2", "keys"):
        odd = odd.withColumn(name, F.lit("clash"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None)], labels.schema)).unionByName(labels.limit(3))
    for name, d, lab in (("odd", odd, odd_labels), ("empty", odd.limit(0), labels.limit(0)), ("unlabelled", odd, labels.limit(0))):
        folder = str(tmp_path / name)
        d.coalesce(3).write.parquet(f"{folder}/documents.parquet")
        lab.coalesce(1).write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in cp.STAGES[:-1]:
            out = common.materialise(stage(spark, now, folder), f"test-{step}")
            assert out.columns == d.columns and out.count() <= now.count()
            now = out
        got = cp.run(spark, folder).collect()
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert sorted({r["doc_id"] or -1 for r in got}) == sorted({i or -1 for i in ids}) and (name != "empty" or not got)
        if name != "empty":
            assert 900_001 in ids and 900_002 not in ids and 900_003 not in ids and len(set(ids)) == len(ids)
            assert all("abcdef1234" not in (r["text"] or "") for r in now.collect())
