"""Operator 1: personal data. Patterns propose, checksums confirm, context words adjust the score.

Base kinds (email, ip, card, phone) follow their contract exactly and always stay; they have a score as well. Further
kinds stay with a score of at least `keep`:
  iban    two letters, two check digits, 11 to 30 letters or digits, single spaces between groups; mod-97 is 1
  nanp    telephone numbers without a plus, as 555-123-4567 or (555) 123-4567; only beside a context word
  ssn     three, two and four digits with hyphens, no reserved area; only beside a context word
  ipv6    eight groups of hex digits, or fewer with ::, as the ipaddress module reads them
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .spans import Span, redact

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "nanp", "ssn", "ipv6")
ORDER = {k: i for i, k in enumerate(BASE + MORE)}

#: Score without context, and words within WINDOW code points before a span (AFTER behind it) that raise or lower it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "nanp": 0.3, "ssn": 0.3, "ipv6": 0.5}
WINDOW, AFTER, RAISE, LOWER = 48, 16, 0.35, 0.35
WORDS = {
    "email": "email e-mail mail contact courriel correo kontakt",
    "ip": "ip address addr host server client login adresse dirección",
    "card": "card credit debit visa mastercard amex payment carte tarjeta karte kreditkarte",
    "phone": "phone tel telephone call mobile cell fax whatsapp téléphone teléfono telefon",
    "iban": "iban account bank transfer konto compte cuenta",
    "nanp": "phone tel telephone call mobile cell fax whatsapp téléphone teléfono telefon",
    "ssn": "ssn social security",
    "ipv6": "ip ipv6 address addr host server client",
}
AGAINST = {"ip": "version release section chapter", "card": "order isbn serial tracking", "nanp": "order isbn serial tracking", "ssn": "order isbn serial part", "iban": "example sample", "ipv6": "time clock"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NANP = re.compile(r"(?<![+0-9A-Za-z-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![0-9A-Za-z-])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_WORD = re.compile(r"[^\W\d_][\w-]*")
_LISTED = {k: frozenset(v.split()) for k, v in WORDS.items()}
_AGAINST = {k: frozenset(v.split()) for k, v in AGAINST.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[Span]:
    """One look at each @: the local part is the run before it, for the class of the local part does not hold @."""
    lo, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > lo and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        lo = m.end() if m else at + 1
        at = text.find("@", lo)


def base_spans(text: str) -> list[Span]:
    """The four base kinds; matches that fail their check are dropped and not tried again from another start."""
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _more(text: str) -> list[Span]:
    out: list[Span] = []
    for m in _IBAN.finditer(text):
        # the groups may run on into other capitals; the longest head that checks is the number
        raw = m.group()
        for end in range(len(raw), 14, -1):
            code = raw[:end].replace(" ", "")
            if raw[end - 1] != " " and (end == len(raw) or raw[end] == " ") and 15 <= len(code) <= 34 and mod97(code):
                out.append(("iban", m.start(), m.start() + end))
                break
    out += [("nanp", m.start(), m.end()) for m in _NANP.finditer(text)]
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            out.append(("ssn", m.start(), m.end()))
    if "::" in text or text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            if sum(c != ":" for c in m.group()) >= 4:
                try:
                    ipaddress.IPv6Address(m.group())
                except ValueError:
                    continue
                out.append(("ipv6", m.start(), m.end()))
    return out


def score(text: str, span: Span) -> float:
    kind, a, b = span
    near = {w.lower() for w in _WORD.findall(text, max(0, a - WINDOW), a)} | {w.lower() for w in _WORD.findall(text, b, b + AFTER)}
    s = SCORE[kind] + RAISE * bool(near & _LISTED[kind]) - LOWER * bool(near & _AGAINST.get(kind, frozenset()))
    return min(1.0, max(0.0, s))


def find(text: str | None, keep: float = 0.5) -> tuple[list[Span], list[Span], list[float]]:
    """base spans; all spans (base ones first, then the others that stay); a score for each of all."""
    if not text:
        return [], [], []
    base = base_spans(text)
    own = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in own], []  # the furthest end of the base spans up to each one
    for _, b in own:
        reach.append(max(b, reach[-1]) if reach else b)
    spans, scores = list(base), [score(text, s) for s in base]
    if _has_digit(text):
        for s in _more(text):
            v = score(text, s)
            k = bisect_left(starts, s[2])  # base spans that begin before this one ends
            if v >= keep and not (k and reach[k - 1] > s[1]):
                spans.append(s)
                scores.append(v)
    return base, spans, scores


_DIGIT = re.compile("[0-9]")


def _has_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>, redacted string"


def detect(docs: DataFrame, keep: float = 0.5, with_text: bool = True) -> DataFrame:
    """doc_id, spans and the redacted text of docs (doc_id, text).

    Null text has no spans and stays null, empty text has none; texts of any length are searched whole, in time that grows
    with their length; doc_id may be null; repeated rows give repeated rows; there are no ties, as each row is looked at by
    itself; an empty table gives no rows; other columns, whatever their names, are ignored. with_text=False leaves redacted
    null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))), ("redacted", pa.string())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                spans, texts = [], []
                for text in piece.column(1).to_pylist():
                    base, found, scores = find(text, keep)
                    spans.append([{"kind": s[0], "start": s[1], "end": s[2], "score": v, "base": i < len(base)} for i, (s, v) in enumerate(zip(found, scores, strict=True))])
                    texts.append(redact(text, [(a, b) for _, a, b in found], "[PII]") if with_text and text is not None else None)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, schema.field(1).type), pa.array(texts, pa.string())], schema=schema)

    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)
