"""Operator 4: soft-membership mixing to target weights.

A classifier fitted on the labelled table gives each document a posterior over domains. Rates r >= 0, one for each
document, are fitted so that the expected tokens of each domain, sum_i r_i t_i p_id, match the targets T_d in weighted
least squares, starting from r = 1:

    minimise  1/2 sum_d (sum_i r_i t_i p_id - T_d)^2 / N_d        N_d: expected tokens of domain d at r = 1

by accelerated projected gradient with the metric t_i, so that documents of one posterior keep one rate whatever their
length: from a point y a little ahead of r, r_i <- clip(y_i - step * sum_d p_id (E_d(y) - T_d) / N_d). A step needs the
totals E_d only, which each partition adds up for itself; the history of residuals (a few numbers a step) gives each
document its rate, so no rate is stored before the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, plus, small_batches, worker_cache
from .tokens import Encoder, Growing

#: The bounded training sample: so many labelled documents of each domain, first in order of a hash of their ids, among
#: those of at most so many characters.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
#: The sample is gathered from so many shares by hash, each of which gives four times its part at most.
SALTS = 64
#: Words of the classifier: those with the largest chi-square between domains.
WORDS = 1500
SHAPE = 8
#: Target weights of the query, by domain.
TARGETS = {"high": 0.6, "low": 0.35, "toxic": 0.05}
#: The largest rate: no bound, as the method has none.
MOST = float("inf")
#: The fit ends when every domain is within TOLERANCE of all tokens of its target, or when two steps move nothing any more.
#: MAX_STEPS is a stop for the case that neither comes; the report tells what was reached.
MAX_STEPS = 200
TOLERANCE = 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain of a labelled table (doc_id, quality, toxic): toxic, high or low. Rows with a null are left out."""
    d = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    known = F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return labels.filter(known).select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("domain"))


def _form(text: str, letters: float, words: float, different: float) -> list[float]:
    """Numbers on the form of a text with so many letters in words, so many words, and such a share of different pieces
    between white space; each about 0 to 1."""
    n, m = max(len(text), 1), max(words, 1)
    lines = text.split("\n")
    return [
        math.log1p(n) / 12,
        letters / n,
        different,
        len(set(lines)) / len(lines),
        min(letters / m / 12, 2.0),
        min(text.count("|") / m, 1.0),
        min(sum(map(text.count, "0123456789")) / n * 4, 1.0),
        min((text.count(".") + text.count("!") + text.count("?")) / m * 4, 1.0),
    ]


def _shape(text: str, words: list[str]) -> list[float]:
    pieces = text.lower().split()
    return _form(text, sum(map(len, words)), len(words), len(set(pieces)) / max(len(pieces), 1))


class Classifier:
    """Multinomial logistic regression on the presence of words and the form of the text."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.domains = sorted({d for _, d in rows})
        kinds = len(self.domains)
        self.vocabulary: dict[str, int] = {}
        self.weights = np.zeros((SHAPE + 1, kinds))
        if kinds < 2:
            return
        y = np.array([self.domains.index(d) for _, d in rows], np.int64)
        split = [self._split(t) for t, _ in rows]
        sets = [set(w) for w in split]
        seen: list[Counter] = [Counter() for _ in self.domains]
        for k, s in zip(y.tolist(), sets, strict=True):
            seen[k].update(s)
        size = np.bincount(y, minlength=kinds).astype(float)
        total = Counter()
        for c in seen:
            total.update(c)
        often = [w for w, n in total.items() if n >= 5]
        table = np.array([[c[w] for c in seen] for w in often], float).reshape(-1, kinds)
        expect = table.sum(axis=1, keepdims=True) * size / max(size.sum(), 1)
        chi = np.where(expect > 0, (table - expect) ** 2 / np.maximum(expect, 1e-9), 0).sum(axis=1)
        top = sorted(range(len(often)), key=lambda i: (-chi[i], often[i]))[:WORDS]
        self.vocabulary = {often[i]: k for k, i in enumerate(top)}
        x = np.zeros((len(rows), len(top) + SHAPE + 1))
        for i, (s, w) in enumerate(zip(sets, split, strict=True)):
            x[i, [self.vocabulary[v] for v in s & self.vocabulary.keys()]] = 1
            x[i, -SHAPE - 1 : -1] = _shape(rows[i][0], w)
        x[:, -1] = 1
        self._fit(x, y, kinds)

    def _fit(self, x: np.ndarray, y: np.ndarray, kinds: int, steps: int = 300, ridge: float = 2e-4) -> None:
        """Accelerated gradient on the mean log loss; the step is the inverse of its curvature bound."""
        goal = np.eye(kinds)[y]
        v = np.ones(x.shape[1])
        for _ in range(20):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v)
        step = 1 / (0.5 * np.linalg.norm(x @ v) ** 2 / len(x) + ridge)
        w = ahead = np.zeros((x.shape[1], kinds))
        for n in range(steps):
            z = x @ ahead
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            new = ahead - step * (x.T @ (p - goal) / len(x) + ridge * ahead)
            ahead = new + n / (n + 3) * (new - w)
            w = new
        self.weights = w

    @staticmethod
    def _split(text: str) -> list[str]:
        return _WORD.findall(text.lower())

    def posterior(self, text: str | None) -> list[float]:
        """The posterior of each domain."""
        text = text or ""
        words = self._split(text)
        x = self.weights[-SHAPE - 1 : -1].T @ np.array(_shape(text, words)) + self.weights[-1]
        own = [self.vocabulary[v] for v in self.vocabulary.keys() & set(words)]
        if own:
            x = x + self.weights[own].sum(axis=0)
        p = np.exp(x - x.max())
        return (p / p.sum()).tolist()


class _Words:
    """What the classifier needs to know of each piece of text that an encoder has numbered, once per Python process.

    Texts that the encoder cuts at white space are then described by gathering: their pieces are looked up once for the
    tokens and for the words. Only words of the vocabulary are kept.
    """

    def __init__(self, encoder: Encoder, model: Classifier) -> None:
        self.pieces, self.model = encoder.pieces, model
        self.words, self.letters, self.size, self.at, self.flat = (Growing(np.int32) for _ in range(5))

    @staticmethod
    def of(encoder: Encoder, model: Classifier) -> _Words:
        cache = worker_cache()
        own = cache.get("mix-words")
        if own is None or own.pieces is not encoder.pieces or own.model is not model:
            own = cache["mix-words"] = _Words(encoder, model)
        own._learn()
        return own

    def _learn(self) -> None:
        known = self.words.n
        fresh = list(islice(self.pieces, known, None)) if len(self.pieces) > known else []
        # most pieces are a word, or a word and a stop; -2: look closer
        get = self.model.vocabulary.get
        hit = np.fromiter((get(p, -1) if p.isalpha() else get(p[:-1], -1) if p[-1] in ",." and p[:-1].isalpha() else -2 for p in fresh), np.int64, len(fresh))
        length = np.fromiter(map(len, fresh), np.int64, len(fresh))
        stop = np.fromiter((p[-1] in ",." for p in fresh), np.int64, len(fresh))
        words, letters, size = np.ones(len(fresh), np.int64), length - stop, (hit >= 0).astype(np.int64)
        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(hit == -2).tolist():
            own = _WORD.findall(fresh[i])
            words[i], letters[i] = len(own), sum(map(len, own))
            found[i] = [v for v in map(get, own) if v is not None]
            size[i] = len(found[i])
        ends = np.cumsum(size)
        flat = np.zeros(int(size.sum()), np.int64)
        flat[(ends - size)[hit >= 0]] = hit[hit >= 0]
        for i, own in found.items():
            flat[ends[i] - size[i] : ends[i]] = own
        self.at.extend(self.flat.n + ends - size)
        self.flat.extend(flat)
        self.size.extend(size)
        self.letters.extend(letters)
        self.words.extend(words)

    def posteriors(self, texts: list[str], rows: list[np.ndarray]) -> np.ndarray:
        """Of texts whose pieces have these numbers."""
        weights, docs = self.model.weights, len(texts)
        piece, length = np.concatenate(rows), np.array([len(r) for r in rows])
        doc = np.repeat(np.arange(docs), length)
        words = np.bincount(doc, self.words.all[piece], docs)
        letters = np.bincount(doc, self.letters.all[piece], docs)
        different = np.array([len(set(r.tolist())) for r in rows]) / length
        form = np.array([_form(t, *v) for t, *v in zip(texts, letters.tolist(), words.tolist(), different.tolist(), strict=True)]).reshape(docs, SHAPE)
        x = form @ weights[-SHAPE - 1 : -1] + weights[-1]
        some = self.size.all[piece] > 0
        piece, doc = piece[some], doc[some]
        size = self.size.all[piece].astype(np.int64)
        ends = np.cumsum(size)
        place = self.flat.all[np.repeat(self.at.all[piece] - (ends - size), size) + np.arange(size.sum())].astype(np.int64)
        pair = np.unique(np.repeat(doc, size) * WORDS + place)  # each word of each text once
        own, place = pair // WORDS, pair % WORDS
        for k in range(x.shape[1]):
            x[:, k] += np.bincount(own, weights[place, k], docs)
        p = np.exp(x - x.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def describe(model: Classifier, encoder: Encoder, texts: list[str | None]) -> tuple[np.ndarray, list[list[float]]]:
    """Tokens, at least 1, and posteriors of texts."""
    fast, rows, whole = encoder.cut(texts)
    counts = np.maximum(encoder.counts(len(texts), fast, rows, whole), 1)
    out: list[list[float] | None] = [None] * len(texts)
    if fast:
        for i, p in zip(fast, _Words.of(encoder, model).posteriors([texts[i] for i in fast], rows).tolist(), strict=True):
            out[i] = p
    return counts, [model.posterior(t) if p is None else p for t, p in zip(texts, out, strict=True)]


def train(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Classifier:
    """Fit on the bounded sample (see SAMPLE_DOCS). labelled: doc_id, domain; a doc_id with two domains counts for both.

    Chosen by ids alone: each of SALTS shares by hash of a domain gives its first ids, and of those, whose number is bounded
    by the sample, the driver takes the first; at most sample_docs texts for each domain come to the driver.
    """
    keys = labelled.distinct().withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("domain", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id")
    heads = keys.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= -(-4 * sample_docs // SALTS)).select("domain", "h", "doc_id").collect()
    ids, taken = [], Counter()
    for r in sorted(heads, key=lambda r: (r["h"], r["doc_id"])):
        taken[r["domain"]] += 1
        if taken[r["domain"]] <= sample_docs:
            ids.append((r["doc_id"], r["domain"]))
    if not ids:
        return Classifier([])
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, domain string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= sample_chars)
    got = own.join(F.broadcast(wanted), "doc_id").select("doc_id", "domain", "text").collect()
    rows, seen = [], Counter()
    for r in sorted(got, key=lambda r: (r["doc_id"], r["domain"], r["text"])):
        seen[r["doc_id"], r["domain"]] += 1
        if seen[r["doc_id"], r["domain"]] == 1:  # one row for each id, should ids repeat
            rows.append((r["text"], r["domain"]))
    return Classifier(rows)


def with_posterior(docs: DataFrame, model: Classifier, tokenizer: str) -> DataFrame:
    """All columns of docs, `mix_tokens` long (ids by a file of SCHEMES[False] or any other, at least 1) and `mix_p`
    array<double> (in the order of model.domains)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = plus(docs, mix_tokens="long", mix_p="array<double>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        encoder = Encoder.of(tokenizer, False, counting=True)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            counts, posteriors = describe(own, encoder, texts)
            more = [pa.array(counts), pa.array(posteriors, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "mix_tokens", "mix_p"])

    small_batches(docs)
    return docs.mapInArrow(work, schema)


class Rates:
    """The rate of a document from its posterior and the history of weighted residuals."""

    def __init__(self, step: float, most: float) -> None:
        self.step, self.most = step, most
        self.history: list[np.ndarray] = []

    def _replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates after all steps so far, and the point ahead of them at which the next residual is taken."""
        r = ahead = np.ones(len(p))
        for k, g in enumerate(self.history):
            new = np.clip(ahead - self.step * (p @ g), 0, self.most)
            ahead = new + k / (k + 3) * (new - r)
            r = new
        return r, ahead

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return self._replay(p)[0]

    def ahead(self, p: np.ndarray) -> np.ndarray:
        return self._replay(p)[1]


def _totals(table: DataFrame, kinds: int, value: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all documents of value(tokens, posteriors); a few numbers from each partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, kinds)
                total += value(t, p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "x"])

    got = table.select("mix_tokens", "mix_p").mapInArrow(work, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["k"]] = r["x"]
    return out


def fit(table: DataFrame, domains: list[str], targets: dict[str, float] | None = None, multiply: dict[str, float] | None = None, most: float = MOST) -> tuple[Rates, dict]:
    """Rates for a written table with mix_tokens and mix_p.

    targets: weights of the domains; the tokens of all documents are dealt out by them. multiply: instead, factors on the
    tokens that each domain has now. Domains that are not named have weight 0, or factor 1. Rates are at most `most`.
    Returns the rates and a report: expected tokens before and after and the targets, by domain, and the steps.
    """
    kinds = len(domains)
    sums = _totals(table, kinds, lambda t, p: np.concatenate([t @ p, np.einsum("i,ij,ik->jk", t, p, p).ravel()]), kinds + kinds * kinds)
    natural, gram = np.maximum(sums[:kinds], 1e-9), sums[kinds:].reshape(kinds, kinds)
    if targets is not None:
        w = np.array([max(targets.get(d, 0.0), 0.0) for d in domains])
        goal = natural.sum() * w / w.sum() if w.sum() else natural
    else:
        goal = natural * np.array([(multiply or {}).get(d, 1.0) for d in domains])
    scaled = gram / np.sqrt(np.outer(natural, natural))
    rates = Rates(1 / max(np.linalg.eigvalsh(scaled).max(), 1e-9), most)
    at, still = natural, 0
    while len(rates.history) < MAX_STEPS and still < 2 and np.abs(at - goal).max() > TOLERANCE * natural.sum():
        rates.history.append((at - goal) / natural)
        before, at = at, _totals(table, kinds, lambda t, p: (t * rates.ahead(p)) @ p, kinds)
        still = still + 1 if np.abs(at - before).max() < TOLERANCE / 20 * natural.sum() else 0
    reached = _totals(table, kinds, lambda t, p: (t * rates(p)) @ p, kinds)
    named = lambda x: dict(zip(domains, x.tolist(), strict=True))
    return rates, {"natural": named(natural), "target": named(goal), "reached": named(reached), "steps": len(rates.history)}


def with_rate(table: DataFrame, rates: Rates) -> DataFrame:
    """table with `mix_rate`, and `mix_copies`: the rate rounded up or down by a hash of doc_id, so that it is right on average."""
    names = table.columns
    at = names.index("mix_p")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p))], [*names, "mix_rate"])

    u = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return table.mapInArrow(work, plus(table, mix_rate="double")).withColumn("mix_copies", F.floor(F.col("mix_rate") + u).cast("long"))


def mix(docs: DataFrame, labelled: DataFrame, tokenizer: str, targets: dict[str, float] = TARGETS, most: float = MOST) -> tuple[DataFrame, list[str], dict]:
    """doc_id, mix_tokens, mix_p, mix_rate, mix_copies of every row of docs (doc_id, text); the domains; the report of fit().

    Null and empty texts count one token and get the posterior of an empty text; texts of any length are read whole;
    doc_id may be null; repeated rows, and rows that tie in all else, are rows of their own with equal rates; other columns,
    whatever their names, are ignored. Without labels there is one domain, `all`, and every rate is 1. An empty table gives
    no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = _or_all(train(docs, labelled))
    table = materialise(with_posterior(rows, model, tokenizer).drop("text"), "mix-posteriors")
    rates, report = fit(table, model.domains, targets=targets if model.domains != ["all"] else {"all": 1.0}, most=most)
    return with_rate(table, rates), model.domains, report


def _or_all(model: Classifier) -> Classifier:
    if not model.domains:
        model.domains, model.weights = ["all"], np.zeros((SHAPE + 1, 1))
    return model


def thin(docs: DataFrame, labelled: DataFrame, tokenizer: str, multiply: dict[str, float]) -> DataFrame:
    """The rows of docs, all columns, of which each stays with its rate, at most 1; multiply: see fit().

    Null, empty and very long texts, repeated rows, ties, missing labels and empty tables: as in mix(). Rows with equal
    doc_id stay or go together if their rates are equal. No column of docs can clash.
    """
    names = docs.columns
    model = _or_all(train(docs, labelled))
    at = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values()).select("*", F.col(at["text"]).cast("string").alias("text"), F.col(at["doc_id"]).alias("doc_id"))
    table = materialise(with_posterior(plain, model, tokenizer).drop("text"), "mix-documents")
    rates, _ = fit(table, model.domains, multiply=multiply, most=1.0)
    return with_rate(table, rates).filter("mix_copies >= 1").select(*at.values()).toDF(*names)
