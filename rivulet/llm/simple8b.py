"""Token-ID files: Simple-8b words with per-block offsets, escapes and a document table.

A word holds a 4-bit selector in its top bits and `count` values of `width` bits in the other 60, first value lowest.
Selectors (fixed values of the scheme): counts 60 30 20 15 12 10 8 7 6 5 4 3 2 1, widths 1 2 3 4 5 6 7 8 10 12 15 20 30 60.
Each position takes the largest count whose values all fit. A block is BLOCK ids and starts a new word, so blocks can be
decoded by themselves and all blocks of a file at once. Values of 2^60 and more are escapes: zero in the words, and
(position, value) in a list of the file.

File: magic, words, block table (first word of each block, one more at the end), escape positions and values, doc ids,
doc null flags, doc starts (one more at the end), JSON with the counts, length of that JSON (8 bytes), magic.
All integers are little-endian.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

MAGIC = b"RVS8B001"
BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = np.uint64(1 << 60)
#: Bit lengths of 16-bit values.
SHORT = np.repeat(np.arange(17, dtype=np.uint8), [1] + [1 << k for k in range(16)])
#: Blocks encoded at once; bounds the working memory.
BATCH = 512


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of each value below 2^60, as uint8."""
    if len(v) and int(v.max()) < 1 << 16:
        return SHORT[v.astype(np.uint16)]
    n = np.zeros(v.shape, np.uint8)
    for k in range(60 if len(v) and int(v.max()) >= 1 << 32 else 32):
        step = v >= np.uint64(1 << k)
        if not step.any():
            break
        n += step
    return n


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, words in each block, positions and values of escapes. ids: uint64, any number."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where = np.flatnonzero(ids >= ESCAPE)
    what = ids[where].copy()
    blocks = -(-len(ids) // BLOCK)
    pad = int(COUNTS[0])
    grid = np.zeros((blocks, BLOCK + pad), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[: len(ids)] = ids
    full[where] = 0
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    need = _bits(grid.ravel()).reshape(grid.shape)
    # the most bits that the next n values need, for each n by doubling; past the end of a block values need none
    most = {1: need}

    def window(n: int) -> np.ndarray:
        if n not in most:
            half = max(k for k in most if k < n)
            a, rest = most[half], n - half
            b = window(rest) if rest in most else most[half]
            shift = half if rest in most else rest
            w = np.zeros_like(need)
            w[:, :-shift] = b[:, shift:]
            most[n] = np.maximum(a, w)
        return most[n]

    select = np.full(need.shape, len(COUNTS) - 1, np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):
        fits = window(int(COUNTS[s])) <= WIDTHS[s]
        select[fits] = s
    length = np.full(blocks, BLOCK, np.int64)
    length[-1] = len(ids) - (blocks - 1) * BLOCK
    # all blocks walk from word to word together; a place is block * width + position
    width = BLOCK + pad
    flat_select = select.ravel()
    jump = COUNTS[flat_select].astype(np.uint8)
    at = np.arange(blocks) * width
    end = at + length
    steps: list[np.ndarray] = []
    while len(at):
        steps.append(at)
        at = at + jump[at]
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    base = np.sort(np.concatenate(steps))
    sel, block = flat_select[base], base // width
    words = sel.astype(np.uint64) << np.uint64(60)
    flat = grid.ravel()
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        at, packed = base[own], np.zeros(len(own), np.uint64)
        for k in range(int(COUNTS[s])):
            packed |= flat[at + k] << np.uint64(k * int(WIDTHS[s]))
        words[own] |= packed
    return words, np.bincount(block, minlength=blocks), where, what


def decode_blocks(words: np.ndarray, per_block: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of whole blocks, without escapes; n_ids: how many there are in all."""
    if not n_ids:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    block = np.repeat(np.arange(len(per_block)), per_block)
    before = np.cumsum(count) - count
    first = np.cumsum(per_block) - per_block
    start = before - before[first][block]  # in its block
    out = np.zeros(len(per_block) * BLOCK + int(COUNTS[0]), np.uint64)
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        w, n = WIDTHS[s], int(COUNTS[s])
        mask = np.uint64((1 << int(w)) - 1)
        pos = start[own]
        base = block[own] * BLOCK + pos
        for k in range(n):
            inside = pos + k < BLOCK
            v = (words[own] >> np.uint64(k * int(w))) & mask
            if inside.all():
                out[base + k] = v
            else:
                out[base[inside] + k] = v[inside]
    return out[:n_ids]


@contextmanager
def _open(path: str, mode: str) -> Iterator:
    """A file on any file system that pyarrow knows, also by Spark's names for them (s3a, s3n); a plain path is local."""
    from pyarrow import fs

    scheme, sep, rest = path.partition("://")
    path = f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else path
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "r":
        with system.open_input_file(name) as f:
            yield f
        return
    system.create_dir(name.rpartition("/")[0], recursive=True)
    import uuid

    draft = f"{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft, compression=None) as f:
        yield f
    system.move(draft, name)  # a repeated task puts the same file there again


class Writer:
    """Appends documents to one file; holds at most BATCH blocks of ids."""

    def __init__(self, f) -> None:
        self.f = f
        f.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_words = self.n_coded = 0
        self.per_block: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        self.what: list[np.ndarray] = []
        self.docs: list[int] = []
        self.null: list[bool] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.waiting.append(ids.astype(np.uint64))
        self.n_waiting += len(ids)
        if self.n_waiting >= BATCH * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for lo in range(0, whole, BATCH * BLOCK):
            words, per_block, where, what = encode_blocks(ids[lo : min(lo + BATCH * BLOCK, whole)])
            self.f.write(words.astype("<u8").tobytes())
            self.per_block.append(per_block)
            self.where.append(where + self.n_coded + lo)
            self.what.append(what)
            self.n_words += len(words)
        self.n_coded += whole
        self.waiting = [ids[whole:]]
        self.n_waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        per_block = np.concatenate([np.zeros(0, np.int64), *self.per_block])
        table = np.concatenate([[0], np.cumsum(per_block)]).astype("<u8")
        where = np.concatenate([np.zeros(0, np.int64), *self.where]).astype("<u8")
        what = np.concatenate([np.zeros(0, np.uint64), *self.what]).astype("<u8")
        for x in (table, where, what, np.array(self.docs, "<i8"), np.array(self.null, "u1"), np.array(self.starts, "<u8")):
            self.f.write(x.tobytes())
        meta = json.dumps({"block": BLOCK, "ids": self.n_ids, "words": self.n_words, "blocks": len(per_block), "escapes": len(where), "docs": len(self.docs)}).encode()
        self.f.write(meta + len(meta).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads any range of ids of one file, decoding only the blocks that hold it."""

    def __init__(self, f) -> None:
        self.f = f
        size = f.size() if callable(getattr(f, "size", None)) else f.seek(0, 2)
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a token-id file")
        n = int.from_bytes(tail[:8], "little")
        self.meta = m = json.loads(self._at(size - 16 - n, n))
        if m["block"] != BLOCK:
            raise ValueError(f"block size {m['block']}")
        at = 8 + 8 * m["words"]

        def take(dtype: str, k: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(self._at(at, k * np.dtype(dtype).itemsize), dtype)
            at += x.nbytes
            return x

        self.table = take("<u8", m["blocks"] + 1).astype(np.int64)
        self.where = take("<u8", m["escapes"]).astype(np.int64)
        self.what = take("<u8", m["escapes"])
        self.docs = take("<i8", m["docs"])
        self.null = take("u1", m["docs"]).astype(bool)
        self.starts = take("<u8", m["docs"] + 1).astype(np.int64)

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """uint64 ids from start to stop (exclusive)."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        a, b = start // BLOCK, -(-stop // BLOCK)
        words = np.frombuffer(self._at(8 + 8 * int(self.table[a]), 8 * int(self.table[b] - self.table[a])), "<u8")
        first = a * BLOCK
        out = decode_blocks(words, np.diff(self.table[a : b + 1]), min(b * BLOCK, self.meta["ids"]) - first)
        lo, hi = np.searchsorted(self.where, [first, first + len(out)])
        out[self.where[lo:hi] - first] = self.what[lo:hi]
        return out[start - first : stop - first]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in this file, ids) of each document; about BATCH blocks are held at a time."""
        n, i = len(self.docs), 0
        while i < n:
            lo = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.starts, lo + BATCH * BLOCK, "right")) - 1)
            j = min(j, n)
            ids = self.ids(lo, int(self.starts[j]))
            for k in range(i, j):
                yield None if self.null[k] else int(self.docs[k]), int(self.starts[k]), ids[int(self.starts[k]) - lo : int(self.starts[k + 1]) - lo]
            i = j
