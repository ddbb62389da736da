"""Operator 6: secrets. Patterns propose values; a password guess-cost decides on values in credential context.

Base kinds (assign, access, hex) follow their contract exactly and always stay. The further kind `credential` is the
whole value after a credential word (those of assign, pwd, passphrase, client_secret, ...), or inside a URL's user part, if guessing it
costs at least 10^MIN_LOG10 tries. The cost is a dynamic program over the whole value, however long: the cheapest
segmentation into
  words         rank in WORDS, any spelling in case or with common digit-for-letter swaps
  dates         1900 to 2029 with or without separators
  repeats       one unit of 1 to 4 characters, over and over, as far as it goes
  keyboard      walks along neighbouring keys, and runs of the alphabet or of digits, as far as they go
  brute force   as many tries as the class of characters has, for each character
The costs of the segments are multiplied, and each segment after the first costs KINDS more, as its kind has to be guessed
too. So the program has no table of segment counts, and its time grows with the length of the value alone. It runs from the end
of the value, and so gives the cost of every later start in the same stretch of text at once.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .spans import Span, redact

BASE = ("assign", "access", "hex")
MORE = ("credential",)
ORDER = BASE + MORE
MIN_LOG10 = 8.0
#: Kinds of segments that a guesser chooses from.
KINDS = 5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(r"password|passwd|secret|token|api_?key|pwd|pass|passphrase|passcode|pin|credentials?|auth|bearer|private_?key|access_?key|secret_?key|client_?secret|auth_?token", re.I | re.A)
#: A credential word, what parts it from its value, and the first six characters of that. Possessive, so that no run of
#: blanks is gone through twice.
_KEYWORD = re.compile(rf"""(?<![A-Za-z0-9])(?:{_CONTEXT.pattern})["']?(?P<gap>\x20*+(?:(?:=>|[:=])\x20*+|(?<=\x20)))["']?(?P<value>[!-&(-~]{{6}})""", re.I | re.A)
_BEHIND = re.compile(r"[^!-&(-~]")
_URL = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]+:(?P<value>[^\s/@]{6,})@")
_QUOTE = re.compile(r'''(?<!\\)"''')
_TRAIL = frozenset("\"'`,;.)]}>")
_PLACEHOLDER = re.compile(r"\$\{|\{\{|%|your_|example", re.I)
_PLACEHOLDERS = re.compile(r"none|null|true|false|undefined|change_?me", re.I)

# fixed values: common words of guessed passwords, most common first
WORDS = (
    "password 123456 qwerty admin welcome letmein dragon monkey football iloveyou master sunshine princess shadow superman "
    "michael login starwars hello freedom whatever trustno batman zaq secret summer winter spring autumn love money pass "
    "access flower hottie loveme cheese computer internet killer pepper ginger soccer hockey baseball jordan hunter ranger "
    "buster thomas robert tigger charlie andrew daniel george jessica ashley nicole matrix silver orange purple yellow "
    "banana coffee cookie chocolate maggie mustang harley corvette ferrari mercedes porsche diamond golden test user root "
    "guest default server database oracle mysql postgres system manager office company changeme temp demo public private "
    "key token api client app data dev prod stage web the and you"
).split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_SWAPS = str.maketrans("@430157$!", "aaeoistsi")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_YEAR, _MONTH, _DAY = r"(?:19\d\d|20[0-2]\d)", r"(?:1[0-2]|0[1-9]|[1-9])", r"(?:[12]\d|3[01]|0[1-9]|[1-9])"
_DATE = re.compile(rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}|{_DAY}([-/._]?){_MONTH}\2{_YEAR}|{_YEAR}")
DAYS = 130 * 365


def _neighbours() -> dict[str, frozenset[str]]:
    at = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row)}
    return {c: frozenset(d for d, (s, j) in at.items() if d != c and abs(s - r) <= 1 and abs(j - k) <= 1) for c, (r, k) in at.items()}


_NEXT = _neighbours()


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _case(own: str) -> int:
    """In how many ways as common as this one a word is written in large and small letters."""
    if own.islower() or not any(c.isalpha() for c in own):
        return 1
    return 2 if own.isupper() or own.istitle() else 2 ** sum(c.isupper() for c in own)


def suffix_costs(s: str) -> list[float]:
    """log10 of the guesses for s[i:], for each i."""
    n, low = len(s), s.lower()
    if len(low) != n:  # a character whose small form is two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    plain = low.translate(_SWAPS)
    join, key, turn = math.log10(KINDS), math.log10(47), math.log10(4) / 2
    best = [0.0] * (n + 1)
    then = [0.0] * (n + 1)  # what follows a segment that ends here
    brute = 0.0  # the cheapest way from here that begins inside a brute-force segment
    same = [0, 0, 0, 0]  # how far each character equals the one 1, 2, 3, 4 places behind it
    walk = turns = up = down = 0  # steps of a walk along keys, its turns, steps of runs
    last = None  # the step that a walk from the next character begins with
    for i in range(n - 1, -1, -1):
        brute = _brute(s[i]) + (min(brute, then[i + 1]) if i + 1 < n else 0.0)
        cost = brute
        for j in range(i + 2, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j]) or (_RANK.get(plain[i:j], 0) * 4)
            if rank:
                cost = min(cost, math.log10(rank * _case(s[i:j])) + then[j])
        if s[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if m := _DATE.fullmatch(s, i, j):
                    cost = min(cost, math.log10(130 if j - i == 4 else DAYS * (4 if m[1] or m[2] else 1)) + then[j])
        for unit in range(1, 5):
            same[unit - 1] = same[unit - 1] + 1 if i + unit < n and s[i] == s[i + unit] else 0
            times = same[unit - 1] // unit + 1
            if times >= (3 if unit == 1 else 2):
                cost = min(cost, sum(map(_brute, s[i : i + unit])) + math.log10(times) + then[i + unit * times])
        step = ord(low[i + 1]) - ord(low[i]) if i + 1 < n else 0
        if i + 1 < n and low[i + 1] in _NEXT.get(low[i], ()):
            turns = turns + (step != last) if walk else 1
            walk, last = walk + 1, step
        else:
            walk = turns = 0
        if walk >= 2:
            cost = min(cost, key + math.log10(walk + 1) + min(turns, walk + 1) * turn + then[i + walk + 1])
        plain_step = i + 1 < n and low[i + 1].isalnum()
        up = up + 1 if plain_step and step == 1 else 0
        down = down + 1 if plain_step and step == -1 else 0
        for run, ways in ((up, 36), (down, 72)):
            if run >= 2:
                cost = min(cost, math.log10(ways * (run + 1)) + then[i + run + 1])
        best[i] = cost
        then[i] = join + cost
    return best


def guess_cost(value: str) -> float:
    """log10 of the number of guesses for a value; 0 for an empty one."""
    return suffix_costs(value)[0]


def base_spans(text: str) -> list[Span]:
    """The three base kinds; matches that fail their length are dropped and not tried again from another start."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if _worth(text) else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _worth(text: str) -> bool:
    return ":" in text or "=" in text


class _Values:
    """Ends and costs of values of one text. What two values share is looked at once, so that any text takes linear time."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.run_end = self.scheme = -1
        self.start = self.end = 0
        self.costs: list[float] = [0.0]

    def whole(self, start: int) -> int:
        """Where the stretch of value characters ends."""
        if start >= self.run_end:
            m = _BEHIND.search(self.text, start)
            self.run_end = m.start() if m else len(self.text)
        return self.run_end

    def has_address(self, start: int, end: int) -> bool:
        if 0 <= self.scheme < start or self.scheme < 0:
            at = self.text.find("://", start)
            self.scheme = at if at >= 0 else len(self.text)
        return self.scheme + 3 <= end

    def cost(self, start: int, end: int) -> float:
        if end != self.end or start < self.start:
            self.start, self.end, self.costs = start, end, suffix_costs(self.text[start:end])
        return self.costs[start - self.start]

    def scored(self, start: int, end: int, said: bool) -> tuple[int, int, float] | None:
        """start, end and cost of a value, if it costs enough. said: a colon or the like says that it is one."""
        text = self.text
        if text[start - 1] == '"' and (m := _QUOTE.search(text, start, end)):
            end = m.start()  # a quoted value ends at its quote
        while end > start and text[end - 1] in _TRAIL:
            end -= 1
        if end - start < 6 or _PLACEHOLDER.match(text, start, end) or _PLACEHOLDERS.fullmatch(text, start, end) or _CONTEXT.fullmatch(text, start, end):
            return None
        if self.has_address(start, end) or (text[start] == "<" and text[end : end + 1] == ">"):
            return None
        if not said and not any(c.isdigit() for c in text[start:end]):
            return None  # "pass something" in prose
        cost = self.cost(start, end)
        return (start, end, cost) if cost >= MIN_LOG10 else None


def credentials(text: str) -> list[tuple[int, int, float]]:
    """start, end and cost of the values in credential context that cost enough.

    After a value that is not taken the search goes on at its start, so that "auth: bearer ..." finds what follows.
    """
    out, at, values = [], 0, _Values(text)
    while m := _KEYWORD.search(text, at):
        start = m.start("value")
        one = values.scored(start, values.whole(start), bool(m["gap"].strip()))
        at = one[1] if one else start
        if one:
            out.append(one)
    if "://" in text:
        values = _Values(text)
        for m in _URL.finditer(text):
            if one := values.scored(m.start("value"), m.end("value"), True):
                out.append(one)
    return out


def find(text: str | None) -> tuple[list[Span], list[Span], list[float]]:
    """base spans; all spans, the base ones first; for each the log10 guess cost of its value.

    A credential that lies in a base span or in another credential is left out.
    """
    if not text:
        return [], [], []
    base = base_spans(text)
    costs = [guess_cost(_ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b]) for kind, a, b in base]
    spans = list(base)
    own = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in own], []  # the furthest end of the base spans up to each one
    for _, b in own:
        reach.append(max(b, reach[-1]) if reach else b)
    furthest = -1
    for a, b, cost in sorted(credentials(text), key=lambda c: (c[0], -c[1])):
        k = bisect_right(starts, a)
        if b > furthest and not (k and reach[k - 1] >= b):
            spans.append(("credential", a, b))
            costs.append(cost)
            furthest = b
    return base, spans, costs


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,cost:double,base:boolean>>, redacted string"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64()), ("base", pa.bool_())]))


def _structs(text: str | None) -> list[dict]:
    base, spans, costs = find(text)
    return [{"kind": k, "start": a, "end": b, "cost": c, "base": i < len(base)} for i, ((k, a, b), c) in enumerate(zip(spans, costs, strict=True))]


def detect(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, spans and the redacted text of docs (doc_id, text).

    Null text has no spans and stays null, empty text has none; texts and values of any length are searched whole, in time
    that grows with their length; doc_id may be null; repeated rows give repeated rows; there are no ties, as each row is
    looked at by itself; an empty table gives no rows; other columns, whatever their names, are ignored. with_text=False
    leaves redacted null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                texts = piece.column(1).to_pylist()
                spans = [_structs(t) for t in texts]
                clean = [redact(t, [(s["start"], s["end"]) for s in own], "[SECRET]") if with_text and t is not None else None for t, own in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, _KIND), pa.array(clean, pa.string())], ["doc_id", "spans", "redacted"])

    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by [SECRET] in text, and n_chars, where there is such a column, counted anew.

    All rows and columns stay, whatever their names; rows without secrets, with null or with empty text stay as they are.
    Repeated rows are redacted alike; texts of any length are searched whole; an empty table gives no rows.
    """
    names = docs.columns
    at = names.index("text")
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [find(t)[1] for t in texts]
            if not any(found):
                yield batch
                continue
            columns = batch.columns
            fresh = [redact(t, [(a, b) for _, a, b in own], "[SECRET]") if own else t for t, own in zip(texts, found, strict=True)]
            columns[at] = pa.array(fresh, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = columns[k].to_pylist()
                columns[k] = pa.array([len(t) if own else n for t, own, n in zip(fresh, found, old, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs)
    return docs.mapInArrow(work, schema)
