"""64-bit fingerprints of bodies: weighted three-word shingles, each bit by vote; distance and bands as Columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import MIN_HASHABLE

# fixed values: separators of tokens, and the parameters of FNV-1a (64 bits) and of the splitmix64 finalizer
SEPARATORS = " \n\t,.;:!?\"'()[]{}<>/\\|—–-…“”‘’"
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))
SHINGLE, MIN_TOKENS, MIN_FEATURES = 3, 10, 8
BANDS = 4

_TO_SPACE = {ord(c): " " for c in SEPARATORS}


#: Texts hashed side by side.
ROWS = 256


def _hashes(units: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """FNV-1a over units[start : start + length] for many stretches side by side, the longest ones first."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    h = np.full(len(start), FNV_START, np.uint64)
    live = len(start)
    for j in range(int(length[0]) if len(length) else 0):
        if length[live - 1] <= j:
            live = int(np.searchsorted(-length, -j, "left"))
        h[:live] = (h[:live] ^ units[start[:live] + j]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def fingerprints(norms: list[str | None]) -> list[int | None]:
    """Of normalized bodies, as signed 64-bit numbers; null where a body is too short or has too few features."""
    out: list[int | None] = [None] * len(norms)
    rows, counts, texts = [], [], []
    for i, norm in enumerate(norms):
        if norm is not None and len(norm) >= MIN_HASHABLE:
            words = [w for w in norm.lower().translate(_TO_SPACE).split(" ") if w]
            if len(words) >= MIN_TOKENS:
                rows.append(i)
                counts.append(len(words))
                texts.extend(words)
    if not rows:
        return out
    # one blank after each word: a window is then one stretch of UTF-16 units
    units = np.frombuffer((" ".join(texts) + " ").encode("utf-16-le"), np.uint16)
    ends = np.flatnonzero(units == 0x20) + 1
    starts = np.concatenate([[0], ends[:-1]])
    last = np.cumsum(counts)
    first = last - counts
    at = np.concatenate([np.arange(a, b - SHINGLE + 1) for a, b in zip(first, last, strict=True)])
    with np.errstate(over="ignore"):
        z = _hashes(units.astype(np.uint64), starts[at], ends[at + SHINGLE - 1] - starts[at])
        for shift, factor in MIX:
            z = z ^ (z >> np.uint64(shift))
            if factor:
                z = z * np.uint64(factor)
    lo = 0
    for i, n in zip(rows, counts, strict=True):
        own = z[lo : lo + n - SHINGLE + 1]
        lo += n - SHINGLE + 1
        if len(np.unique(own)) >= MIN_FEATURES:
            ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0])
    return out


def fingerprint(norm: str | None) -> int | None:
    return fingerprints([norm])[0]


def with_simhash(df: DataFrame, norm: str = "norm", name: str = "simhash") -> DataFrame:
    """df with the fingerprint of a column of normalized bodies; bodies go to Python in Arrow batches and do not come back."""

    @F.arrow_udf("bigint")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([f for lo in range(0, len(part), ROWS) for f in fingerprints(part.slice(lo, ROWS).to_pylist())], pa.int64())

    return df.withColumn(name, of(F.col(norm)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def bands(fp: Column) -> Column:
    """(band number, 16 bits): fingerprints within BANDS - 1 bits share one of them at least."""
    width = 64 // BANDS
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits")) for i in range(BANDS)])
