"""URL functions as Columns: canonical form, identity, host, cursor text. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that name a visit, not a page (keys in lower case)
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "yclid", "mc_cid", "mc_eid", "igshid", "ref_src", "ref_url", "_hsenc", "_hsmi", "spm")
TRACKING_PREFIX = "utm_"
DEFAULT_PORTS = {"http": "80", "https": "443"}
_SPACE = r"[\s  -    　  \u0085\u001c-\u001f]"


def trim_all(text: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces only."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def _port(authority: Column) -> Column:
    return F.regexp_extract(authority, r":([0-9]+)$", 1)


def _is_tracking(pair: Column) -> Column:
    key = F.lower(F.substring_index(pair, "=", 1))
    return key.startswith(TRACKING_PREFIX) | key.isin(*TRACKING)


def clean_query(query: Column) -> Column:
    """The pairs of a query string without tracking keys, in a stable order of their keys; empty if none is left."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~_is_tracking(p))
    keyed = F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("key"), i.alias("at"), p.alias("pair")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["pair"]), "&")


def canonicalize(url: Column) -> Column:
    """One spelling for all spellings of an address.

    Scheme and host in lower case, no user part, no default port, no fragment, no trailing slashes (the root stays as it
    is written), no tracking parameters, the others by key. What is not an absolute URL with a host stays as it is, trimmed.
    """
    raw = trim_all(url)
    scheme, host = F.lower(_part(raw, "PROTOCOL")), F.lower(_part(raw, "HOST"))
    port = _port(_part(raw, "AUTHORITY"))
    default = F.lit(False)
    for s, p in DEFAULT_PORTS.items():
        default = default | ((scheme == s) & (port == p))
    path = F.coalesce(_part(raw, "PATH"), F.lit(""))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    query = clean_query(F.coalesce(_part(raw, "QUERY"), F.lit("")))
    built = F.concat(scheme, F.lit("://"), host, F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isNull() | host.isNull() | (host == ""), raw).otherwise(built)


def url_hash(canonical: Column) -> Column:
    """The identity of an address: SHA-256 as binary(32)."""
    return F.unhex(F.sha2(canonical, 256))


def uuid_of(canonical: Column) -> Column:
    """A UUID (version 3 form) that an address always has again: from the MD5 of it."""
    h = F.md5(canonical.cast("binary"))
    part = lambda at, n: F.substr(h, F.lit(at), F.lit(n))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def host_of(url: Column) -> Column:
    """Host in lower case without port; null if there is none."""
    return F.lower(_part(url, "HOST"))


def origin_of(url: Column) -> Column:
    """scheme://host, the key of robots rules; the port is no part of it."""
    return F.concat(_part(url, "PROTOCOL"), F.lit("://"), host_of(url))


def base_of(url: Column) -> Column:
    """scheme://host:port without user and password: where a host's files are asked for."""
    return F.concat(_part(url, "PROTOCOL"), F.lit("://"), F.regexp_replace(_part(url, "AUTHORITY"), "^.*@", ""))


def robots_path(url: Column) -> Column:
    """Path (at least /) and query, as robots patterns see them; null if the URL can't be parsed."""
    path = _part(url, "PATH")
    query = _part(url, "QUERY")
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query.isNull(), "").otherwise(F.concat(F.lit("?"), query)))


def iso_instant(ts: Column) -> Column:
    """A UTC timestamp as ISO text with no, three or six digits of a second."""
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.left(micros, F.lit(3)))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def cursor(published_at: Column, row_id: Column) -> Column:
    """An opaque page token: base64url without padding of `instant|id`."""
    text = F.concat(iso_instant(published_at), F.lit("|"), row_id.cast("string"))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))
