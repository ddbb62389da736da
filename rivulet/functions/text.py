"""Text functions as Columns: normal form, content hash, counts, unaccented form, trigrams."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bodies under this length have no hash and no fingerprint.
MIN_HASHABLE = 500
ZERO_WIDTH = "​‌‍⁠﻿"
SUMMARY = 280
ERROR = 2000
FTS_BODY = 200_000


def _accents() -> tuple[str, str]:
    """Latin letters with marks and what is left without them, from the Unicode tables, and the barred d."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and base.isascii():
            src.append(chr(c))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accents()


def normalize_plain(text: Column) -> Column:
    """Null is empty; no zero-width characters; runs of white space are one space; no space at the ends."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{ZERO_WIDTH}]+", "")
    # a single space, by far the most frequent run, is left alone
    return F.trim(F.regexp_replace(bare, r"[\s ]{2,}|[^\S ]| ", " "))


def content_hash(norm: Column) -> Column:
    """SHA-256 of a normalized body as binary; null under the floor."""
    return F.when(F.length(norm) >= MIN_HASHABLE, F.unhex(F.sha2(norm, 256)))


def word_count(norm: Column) -> Column:
    """Words of a normalized body: spaces and one; empty is 0."""
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("int")


def summarize(plain: Column) -> Column:
    """At most 280 characters of plain text, the last one an ellipsis if it was cut; blank is null."""
    text = F.trim(plain)
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(SUMMARY - 1)), r"\s+$", ""), F.lit("…"))
    return F.when(text == "", F.lit(None)).when(F.length(text) > SUMMARY, cut).otherwise(text)


def clip_error(text: Column) -> Column:
    return F.left(text, F.lit(ERROR))


def unaccent(text: Column) -> Column:
    """Latin letters without their marks; null stays null. Texts of ASCII letters alone are not walked through."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, ACCENTED, PLAIN)).otherwise(text)


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores in lower case, in order; no stemming and no stop words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def trigrams(text: Column) -> Column:
    """The set of trigrams of the words of a text, each word with two blanks before it and one behind."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets, 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def time_ago(then: Column, now: Column) -> Column:
    """just now, Nm ago, Nh ago, Nd ago; each step rounds half up."""
    seconds = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(then.cast("timestamp")) / 1e6
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m ago")).when(hours < 24, say(hours, "h ago")).otherwise(say(days, "d ago"))
