"""Tokenising with the tokenizers library, each distinct word once per Python process.

Two schemes of tokenizer files (SCHEMES) are known to cut a text into words before any merge, and no word reaches from a
visible character over white space into the next one. So a text of plain characters is cut at white space, each piece is
encoded by the library once and remembered, and the ids of the pieces are put one after another. Texts with other
characters, with special token strings or with white space in odd places are encoded whole by the library, and so is every
text if the file follows neither scheme. The ids are those of the library in all cases; the tests compare them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import worker_cache

#: ASCII without control characters, and the letters of Latin-1 and Latin Extended A and B but for dotted capital I,
#: whose lower case is two characters. None of them composes with another.
ODD = re.compile("[^\t\n\r\x0b\x0c\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]")

#: The characters that byte-level BPE has for the bytes from 0x80 (fixed values of that scheme): those without a visible
#: Latin-1 character of their own follow U+0142 in order of bytes; 0xAD is the last of them.
BYTES = {b: (chr(b) if b > 0xA0 and b != 0xAD else chr(0x143) if b == 0xAD else chr(0x122 + b - 0x80)) for b in range(0x80, 0x100)}

_LEVEL = {"type": "ByteLevel", "add_prefix_space": False}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: spaced -> what a file has to say on normalising, cutting and merging for texts to be cut at white space (fixed values).
SCHEMES = {
    True: (None, [_LEVEL | {"use_regex": True}], None),
    False: ([{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}], [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, _LEVEL | {"use_regex": False}], "</w>"),
}

#: Pieces remembered by each Python process; about 150 bytes each.
MAX_PIECES = 600_000


class _Pieces(dict):
    """piece -> its number; new pieces are noted for the library."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Growing:
    """An array with room at its end."""

    def __init__(self, dtype: np.dtype) -> None:
        self.all, self.n = np.zeros(1 << 16, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros(self.n + len(values), self.all.dtype)])
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)


def scheme(path: str) -> bool | None:
    """Which of SCHEMES a tokenizer file follows; None for neither."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)

    def steps(part: dict | None, key: str) -> list | None:
        return None if part is None else [{k: v for k, v in p.items() if k != "trim_offsets"} for p in (part[key] if part["type"] == "Sequence" else [part])]

    model = told["model"]
    own = (steps(told.get("normalizer"), "normalizers"), steps(told.get("pre_tokenizer"), "pretokenizers"), model.get("end_of_word_suffix"))
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and not told.get("truncation")
    return next((spaced for spaced, want in SCHEMES.items() if plain and own == want), None)


class Encoder:
    """Ids of texts for one tokenizer file. `spaced`: the tokenizer keeps the space before a word (byte-level BPE).
    `counting`: only how many ids a piece has is remembered, for counts()."""

    def __init__(self, path: str, spaced: bool, counting: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaced, self.counting = spaced, counting
        self.known = scheme(path) is spaced
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32
        self.stops = {c: self.tok.encode(c, add_special_tokens=False).ids for c in (",", ".")}
        self._reset()

    @staticmethod
    def of(path: str, spaced: bool, counting: bool = False) -> Encoder:
        cache = worker_cache()
        key = ("encoder", path, spaced, counting)
        if key not in cache:
            cache[key] = Encoder(path, spaced, counting)
        return cache[key]

    def _reset(self) -> None:
        self.pieces = _Pieces()
        self.flat, self.at, self.size = Growing(self.dtype), Growing(np.int32), Growing(np.int32)

    def _plain(self, text: str) -> bool:
        if not self.known or ODD.search(text) or any(s in text for s in self.special):
            return False
        if not self.spaced:
            return True
        return not ("  " in text or "\n\n" in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text)

    def _measure(self) -> None:
        """Count the ids of the new pieces."""
        new, self.pieces.new = self.pieces.new, []
        model, lead = self.tok.model.tokenize, "\u0120" if self.spaced else ""
        size: list[int] = []
        rest: list[int] = []
        for piece in new:
            stop = piece[-1:] in (",", ".")
            core = piece[:-1] if stop else piece
            if core.isalpha():
                size.append(len(model(lead + (core if core.isascii() else core.encode().decode("latin-1").translate(BYTES)))) + stop)
            else:
                rest.append(len(size))
                size.append(0)
        sizes = np.array(size, np.int64)
        if rest:
            of = self._words([new[i] for i in rest]).word_ids
            sizes[rest] = np.bincount(np.array(of, np.int64), minlength=len(rest))
        self.size.extend(sizes)

    def _words(self, words: list[str]):
        """The library's encoding of pieces as words of their own."""
        if self.spaced:
            words = [w if w[:1] == "\n" else w[1:] if w[:1] == "\0" else " " + w for w in words]
        return self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)

    def _learn(self) -> None:
        """Encode the new pieces. A piece is a word with the white space before it; most are letters and one stop."""
        new, self.pieces.new = self.pieces.new, []
        model, lead, stops = self.tok.model.tokenize, "\u0120" if self.spaced else "", self.stops
        flat: list[int] = []
        at: list[int] = []
        rest: list[int] = []
        for piece in new:
            end = piece[-1:]
            core = piece[:-1] if end in stops else piece
            if not core.isalpha():
                rest.append(len(at))
                at.append(len(flat))
                continue
            at.append(len(flat))
            flat += [t.id for t in model(lead + (core if core.isascii() else core.encode().decode("latin-1").translate(BYTES)))]
            if end in stops:
                flat += stops[end]
        starts = np.array(at, np.int64)
        size = np.diff(starts, append=len(flat))
        own = np.array(flat, np.int64)
        if rest:  # their ids lie behind those of the others
            enc = self._words([new[i] for i in rest])
            n = np.bincount(np.array(enc.word_ids, np.int64), minlength=len(rest))
            size[rest], starts[rest] = n, len(flat) + np.cumsum(n) - n
            own = np.concatenate([own, np.array(enc.ids, np.int64)])
        self.at.extend(self.flat.n + starts)
        self.size.extend(size)
        self.flat.extend(own)

    def cut(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], dict[int, list[int]]]:
        """Which texts are cut at white space, the numbers of their pieces, and the ids of the other texts."""
        if len(self.pieces) > MAX_PIECES:
            self._reset()
        fast: list[int] = []
        rows: list[np.ndarray] = []
        whole: dict[int, list[int]] = {}
        get = self.pieces.__getitem__
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._plain(text):
                whole[i] = self.tok.encode(text, add_special_tokens=False).ids
                continue
            if self.spaced:
                parts = text.replace("\n", " \n").split(" ")
                if parts[0]:
                    parts[0] = "\0" + parts[0]
                else:
                    parts = parts[1:]
            else:
                parts = text.lower().split()
            if parts:
                rows.append(np.fromiter(map(get, parts), np.int32, len(parts)))
                fast.append(i)
        if self.pieces.new:
            self._measure() if self.counting else self._learn()
        return fast, rows, whole

    def counts(self, n: int, fast: list[int], rows: list[np.ndarray], whole: dict[int, list[int]]) -> np.ndarray:
        """How many ids each of n texts has, without special tokens; the rest is what cut() gave for them."""
        out = np.zeros(n, np.int64)
        for i, ids in whole.items():
            out[i] = len(ids)
        if rows:
            size = self.size.all[np.concatenate(rows)].astype(np.int64)
            length = np.array([len(r) for r in rows])
            out[fast] = np.add.reduceat(size, np.cumsum(length) - length)
        return out

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text without special tokens; null is empty."""
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        fast, rows, whole = self.cut(texts)
        for i, ids in whole.items():
            out[i] = np.asarray(ids, self.dtype)
        if rows:
            row = np.concatenate(rows)
            size = self.size.all[row]
            ends = np.cumsum(size, dtype=np.int64)
            take = np.repeat(self.at.all[row] - (ends - size), size)
            take += np.arange(len(take), dtype=take.dtype)
            flat = self.flat.all[take]
            cuts = ends[np.cumsum([len(r) for r in rows]) - 1]
            start = 0
            for i, end in zip(fast, cuts.tolist(), strict=True):
                out[i] = flat[start:end]
                start = end
        return out
