"""Operator 8: language identification by prediction by partial matching (PPM) over bytes, with frozen statistics.

For each language the contexts of up to ORDER bytes and the bytes that followed them are counted once. The code length of
a byte is exact PPM with escape method C and full exclusion: in the longest known context it is count / (n + q); escape
costs q / (n + q), and the symbols of that context are excluded below; at the end the remaining byte values are equally
likely. With frozen statistics the code length depends on the last ORDER bytes and the byte alone, so it is computed once
for each such gram, and texts are scored by lookups in numpy.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, worker_cache

ORDER = 3
#: The bounded training sample: so many labelled documents of each language, the first in order of a hash of their ids,
#: among those of at most so many characters.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 20_000
#: The sample is gathered from so many shares by hash, each of which gives four times its part at most.
SALTS = 64
#: So many languages are learned at most, those with most rows in the sample's shares, by name where they tie.
LANGS = 256
#: A text is rejected as not in any learned language if its best code takes more bits a byte than this.
MAX_BITS = 6.5
#: The score is the posterior of the language for a stretch of so many bytes of average code length.
STRETCH = 32
PREFIX = b"\n" * ORDER
#: Bigrams that get a row in the lookup table.
COMMON = 2048
CHUNK = 1 << 19


class Ppm:
    """The frozen context trees of one language."""

    def __init__(self, texts: list[bytes]) -> None:
        grams: list[np.ndarray] = [np.zeros(0, np.uint64)] * (ORDER + 1)
        parts: list[list[np.ndarray]] = [[] for _ in grams]
        for t in texts:
            b = np.frombuffer(PREFIX + t, np.uint8).astype(np.uint64)
            n = len(b) - ORDER
            key = np.zeros(n, np.uint64)
            for back in range(ORDER + 1):
                key = key | (b[ORDER - back : ORDER - back + n] << np.uint64(8 * back))
                parts[back].append(key)
        self.keys, self.counts = [], []
        for k in range(ORDER + 1):
            grams[k] = np.concatenate(parts[k]) if parts[k] else np.zeros(0, np.uint64)
            u, c = np.unique(grams[k], return_counts=True)
            self.keys.append(u)
            self.counts.append(c.astype(np.float64))
        self.ctx, self.n, self.q, self.seen = [], [], [], []
        for k in range(ORDER + 1):
            ctx, first = np.unique(self.keys[k] >> np.uint64(8), return_index=True)
            self.ctx.append(ctx)
            self.n.append(np.add.reduceat(self.counts[k], first) if len(first) else np.zeros(0))
            self.q.append(np.diff(np.append(first, len(self.keys[k]))).astype(np.float64))
            if k and len(first):  # what the symbols of this context count in the next shorter one
                lower = self.keys[k] & np.uint64((1 << 8 * k) - 1)
                self.seen.append(np.add.reduceat(self.counts[k - 1][np.searchsorted(self.keys[k - 1], lower)], first))
            else:
                self.seen.append(np.zeros(len(first)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram of ORDER + 1 bytes."""
        out = np.zeros(len(grams))
        live = np.arange(len(grams))
        out_seen, out_q = np.zeros(len(grams)), np.zeros(len(grams))
        for k in range(ORDER, -1, -1):
            if not len(live) or not len(self.ctx[k]):
                continue
            key = grams[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.ctx[k], c), len(self.ctx[k]) - 1)
            known = self.ctx[k][at] == c
            at, rows, key = at[known], live[known], key[known]
            total = self.n[k][at] - out_seen[rows]
            fresh = self.q[k][at] - out_q[rows]
            g = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            hit = self.keys[k][g] == key
            out[rows[hit]] -= np.log2(self.counts[k][g[hit]] / (total + fresh)[hit])
            esc = ~hit & (fresh > 0)
            out[rows[esc]] -= np.log2(fresh[esc] / (total + fresh)[esc])
            out_seen[rows], out_q[rows] = self.seen[k][at], self.q[k][at]
            done = np.zeros(len(grams), bool)
            done[rows[hit]] = True
            live = live[~done[live]]
        out[live] += np.log2(256 - out_q[live])
        return out


class Model:
    """One Ppm for each language; scores texts with a table of code lengths that fills as grams turn up."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.id = uuid.uuid4().hex
        self.langs = sorted(samples)
        coded = {k: [t.encode() for t in samples[k]] for k in self.langs}
        self.ppm = [Ppm(coded[k]) for k in self.langs]
        pairs = np.zeros(65536, np.int64)
        for texts in coded.values():
            for t in texts:
                b = np.frombuffer(PREFIX + t, np.uint8).astype(np.int64)
                pairs += np.bincount(b[:-1] * 256 + b[1:], minlength=65536)
        top = np.argsort(-pairs, kind="stable")[: COMMON - 1]
        top = top[pairs[top] > 0]
        self.row = np.zeros(65536, np.int32)
        self.row[top] = np.arange(1, len(top) + 1)
        self.back = np.zeros(COMMON, np.int64)
        self.back[1 : len(top) + 1] = top

    def _start(self) -> None:
        self.table = np.full(COMMON * COMMON, -1, np.int32)
        self.cost = np.zeros((1, len(self.langs)), np.float32)  # row 0 is no cost

    def _exact(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([p.bits(grams) for p in self.ppm], axis=1).astype(np.float32)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        if not hasattr(self, "table"):
            self._start()
        total = np.zeros((len(texts), len(self.langs)))
        joined = np.frombuffer(b"".join([x for t in texts for x in (PREFIX, t)] + [PREFIX]), np.uint8)
        size = np.array([len(t) + ORDER for t in texts], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        for lo in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
            hi = min(lo + CHUNK, int(ends[-1]))
            b = joined[lo : hi + ORDER].astype(np.uint16)
            pair = (b[:-1] << 8) | b[1:]
            r = self.row[pair]
            a, z = r[: hi - lo], r[2 : 2 + hi - lo]
            slot = a * COMMON + z
            row = self.table[slot]
            rare = (a == 0) | (z == 0)
            fresh = np.unique(slot[(row < 0) & ~rare])
            if len(fresh):
                grams = (self.back[fresh // COMMON].astype(np.uint64) << np.uint64(16)) | self.back[fresh % COMMON].astype(np.uint64)
                self.table[fresh] = len(self.cost) + np.arange(len(fresh), dtype=np.int32)
                self.cost = np.concatenate([self.cost, self._exact(grams)])
                row = self.table[slot]
            row[rare] = 0
            # the grams that end in the next text's prefix cost nothing
            a, z = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi + ORDER, "left") + 1
            tail = (ends[a:z, None] - np.arange(1, ORDER + 1)).ravel()
            tail = tail[(tail >= lo) & (tail < hi)] - lo
            row[tail] = 0
            cost = self.cost[row]
            if rare.any():
                rare[tail] = False
                where = np.flatnonzero(rare)
                grams = (pair[where].astype(np.uint64) << np.uint64(16)) | pair[where + 2].astype(np.uint64)
                u, inv = np.unique(grams, return_inverse=True)
                cost[where] = self._exact(u)[inv]
            inside = starts[(starts > lo) & (starts < hi)]
            cuts = np.concatenate([[lo], inside])
            sums = np.add.reduceat(cost, cuts - lo, axis=0, dtype=np.float64)
            np.add.at(total, np.searchsorted(starts, cuts, "right") - 1, sums)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score and bits a byte of each text; `und`, 0 and null without text, letters or model."""
        lang, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        own = [i for i, t in enumerate(texts) if t and _has_letter(t)]
        if not self.langs or not own:
            return lang, score, bits
        coded = [texts[i].encode() for i in own]
        total = self.lengths(coded)
        mean = total / np.array([len(t) for t in coded])[:, None]
        best = mean.argmin(axis=1)
        gain = np.exp2((mean.min(axis=1, keepdims=True) - mean) * STRETCH)
        post = 1 / gain.sum(axis=1)
        for i, k, p, m in zip(own, best.tolist(), post.tolist(), mean.min(axis=1).tolist(), strict=True):
            lang[i], score[i], bits[i] = self.langs[k], p, m
        return lang, score, bits


_ASCII = re.compile("[A-Za-z]")


def _has_letter(text: str) -> bool:
    return _ASCII.search(text) is not None or any(map(str.isalpha, text))


def held_out():
    """The documents that are never learned from: crc32 of doc_id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, langs: int = LANGS) -> dict[str, list[str]]:
    """The bounded sample (see SAMPLE_DOCS, LANGS) of docs (doc_id, text, lang) that are not held out, by language.

    It is chosen by ids alone: each of SALTS shares by hash of a language gives its first ids, so that a language with most
    rows is not gathered in one task; of those, whose number is bounded by the sample, the driver takes the first. Only
    their texts, at most sample_docs x sample_chars characters for each language, come to the driver. Empty texts and
    texts without a letter are not learned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fit = rows.filter(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull() & (F.length("text") <= sample_chars) & F.col("text").rlike(r"\p{L}"))
    part = fit.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)))
    order = Window.partitionBy("lang", "salt").orderBy("h", "doc_id")
    heads = materialise(part.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= -(-4 * sample_docs // SALTS)).select("lang", "h", "doc_id"), "language-heads")
    most = heads.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs)
    by_hash = heads.join(F.broadcast(most.select("lang")), "lang", "left_semi").collect()
    keep: set[tuple[str, int]] = set()
    taken: Counter = Counter()
    for r in sorted(by_hash, key=lambda r: (r["h"], r["doc_id"])):
        if (r["lang"], r["doc_id"]) not in keep and taken[r["lang"]] < sample_docs:
            taken[r["lang"]] += 1
            keep.add((r["lang"], r["doc_id"]))
    samples: dict[str, list[str]] = {}
    if not keep:
        return samples
    wanted = docs.sparkSession.createDataFrame(sorted({(d,) for _, d in keep}), "doc_id long")
    got = fit.join(F.broadcast(wanted), "doc_id", "left_semi").select("lang", "text", "doc_id").collect()
    for r in sorted(got, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        own = samples.setdefault(r["lang"], [])
        if (r["lang"], r["doc_id"]) in keep and len(own) < sample_docs:
            own.append(r["text"])
    return {k: v for k, v in samples.items() if v}


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on the sample() of docs."""
    return Model(sample(docs, sample_docs, sample_chars))


def _shared(spark, model: Model):
    """The model for each Python worker once; its size is bounded by the sample."""
    sent = spark.sparkContext.broadcast(model)
    key = ("ppm", model.id)

    def get() -> Model:
        cache = worker_cache()
        if key not in cache:
            for old in [k for k in cache if k[0] == "ppm"]:
                del cache[old]
            cache[key] = sent.value
        return cache[key]

    return get


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (of the best code, a byte) of docs (doc_id, text).

    Null text and text without a letter, empty text among it, give `und` with score 0 and null bits; texts of any length are
    scored whole; of languages that tie the first by name is taken; doc_id may be null; repeated rows give repeated rows; an
    empty table gives no rows; other columns, lang and source among them, are ignored whatever their names.
    """
    get = _shared(docs.sparkSession, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                lang, score, bits = get().predict(piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits"])

    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, bits double")


def keep_identified(docs: DataFrame, model: Model, max_bits: float = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language: not `und`, and its best code is short enough.

    Null, empty and very long texts, ties and repeated rows: as in identify(). An empty table gives no rows.
    """
    get = _shared(docs.sparkSession, model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                lang, _, bits = get().predict(piece.column(at).to_pylist())
                yield piece.filter(pa.array([x != "und" and b <= max_bits for x, b in zip(lang, bits, strict=True)], pa.bool_()))

    small_batches(docs)
    return docs.mapInArrow(work, docs.schema)
