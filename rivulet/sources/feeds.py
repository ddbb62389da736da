"""Feeds: RSS and Atom parsing, conditional HTTP fetches, pages, robots files and seeds as DataFrames."""

from __future__ import annotations

import gzip
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_tz, mktime_tz
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USER_AGENT = "RivuletBot/1.0"
FEED_ACCEPT = "application/rss+xml, application/atom+xml, application/xml;q=0.9, */*;q=0.8"
TIMEOUT = 20
MAX_PAGE = 8 << 20

ENTRY = pa.struct([("entry_idx", pa.int32()), ("link", pa.string()), ("title", pa.string()), ("description", pa.string()), ("contents", pa.list_(pa.string())), ("published", pa.timestamp("us", "UTC")), ("updated", pa.timestamp("us", "UTC"))])
ENTRIES_DDL = "array<struct<entry_idx:int,link:string,title:string,description:string,contents:array<string>,published:timestamp,updated:timestamp>>"


def parse_date(raw: str | None) -> datetime | None:
    """RFC 822 or ISO 8601 in UTC; a weekday is not looked at, for feeds get it wrong."""
    if not raw or not raw.strip():
        return None
    raw = raw.strip()
    try:
        t = datetime.fromisoformat(raw)
        return (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC)
    except ValueError:
        pass
    parts = parsedate_tz(re.sub(r"^[A-Za-z]+,\s*", "", raw))
    try:
        return datetime.fromtimestamp(mktime_tz(parts), UTC) if parts else None
    except (ValueError, OverflowError, OSError):
        return None


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def _inner(e: ElementTree.Element) -> str:
    """Text of an element; markup of XHTML content is kept."""
    if len(e):
        return (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e)
    return e.text or ""


def parse_feed(body: bytes) -> list[dict]:
    """Entries of an RSS 0.9x, 1.0, 2.0 or Atom document in feed order. The encoding is that of the XML prolog or mark.

    Raises ElementTree.ParseError for what is not XML.
    """
    root = ElementTree.fromstring(body.lstrip())
    out = []
    for e in (x for x in root.iter() if _name(x) in ("item", "entry")):
        got: dict = {"entry_idx": len(out), "link": None, "title": None, "description": None, "contents": [], "published": None, "updated": None}
        for c in e:
            name, space = _name(c), c.tag.rpartition("}")[0].lower() if isinstance(c.tag, str) else ""
            if name == "link":
                if c.get("href") is None:
                    got["link"] = got["link"] or c.text
                elif c.get("rel", "alternate") == "alternate":
                    got["link"] = got["link"] or c.get("href")
            elif name == "title" and "media" not in space:
                got["title"] = got["title"] or _inner(c)
            elif name in ("description", "summary") and "media" not in space:
                got["description"] = got["description"] or _inner(c)
            elif name in ("encoded", "content") and "media" not in space:
                got["contents"].append(_inner(c))
            elif name in ("pubdate", "published", "issued", "date"):
                got["published"] = got["published"] or parse_date(c.text)
            elif name in ("updated", "modified"):
                got["updated"] = got["updated"] or parse_date(c.text)
        out.append(got)
    return out


def with_entries(feeds: DataFrame, body: str = "content") -> DataFrame:
    """feeds with `entries` (null if the body is no XML) from a column of bytes."""

    @F.arrow_udf(ENTRIES_DDL)
    def parse(parts: pa.Array) -> pa.Array:
        out = []
        for x in parts:
            try:
                out.append(parse_feed(x.as_py()) if x.is_valid else None)
            except ElementTree.ParseError:
                out.append(None)
        return pa.array(out, pa.list_(ENTRY))

    return feeds.withColumn("entries", parse(F.col(body)))


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, entries of feed documents in a folder; through Spark's file reader, so any store will do."""
    return with_entries(spark.read.format("binaryFile").load(path).select("path", "content")).drop("content")


def read_feeds_xml(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """The same by Spark's XML reader, one row for each item, for large files of one kind of feed."""
    schema = "title string, link string, description string, pubDate string, guid string"
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def native_date(raw: Column) -> Column:
    """RFC 822 dates as timestamps by built-in functions, the weekday taken off first."""
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]+,\s*", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z")])


def request(url: str, accept: str, agent: str | None, timeout: int | None, etag: str | None = None, modified: str | None = None, most: int | None = None) -> dict:
    """One GET. Validators go out as they came in. Returns status, body (unzipped bytes), etag, last_modified, error.

    304 is an answer, not an error. A body over `most` bytes is an error; the status is looked at after the body is read.
    """
    headers = {"User-Agent": agent or USER_AGENT, "Accept": accept, "Accept-Encoding": "gzip, deflate"}
    if etag and etag.strip():
        headers["If-None-Match"] = etag
    if modified and modified.strip():
        headers["If-Modified-Since"] = modified
    out = {"status": None, "body": None, "etag": None, "last_modified": None, "error": None}
    try:
        try:
            r = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout or TIMEOUT)  # noqa: S310
        except urllib.error.HTTPError as e:
            r = e
        with r:
            body = r.read(most + 1) if most else r.read()
            out["status"] = r.status if hasattr(r, "status") else r.code
            out["etag"], out["last_modified"] = r.headers.get("ETag"), r.headers.get("Last-Modified")
            if most and len(body) > most:
                return out | {"error": f"body over {most} bytes"}
            coding = (r.headers.get("Content-Encoding") or "").lower()
            if coding == "gzip":
                body = gzip.decompress(body)
            elif coding == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
            if most and len(body) > most:
                return out | {"error": f"body over {most} bytes"}
            if out["status"] != 304 and not 200 <= out["status"] < 300:
                return out | {"error": f"HTTP {out['status']}"}
            return out | {"body": body if out["status"] != 304 else None}
    except (OSError, ValueError, EOFError, zlib.error) as e:
        return out | {"error": f"{type(e).__name__}: {e}"[:2000]}


FETCHED = "id long, kind string, status int, content binary, etag string, last_modified string, error string, duration_ms int"
ROBOTS_ACCEPT, ROBOTS_TIMEOUT, MAX_ROBOTS = "text/plain, */*", 15, 2 << 20


def _politely(rows: DataFrame) -> DataFrame:
    """Rows of one host in one task, if they name their host; each waits the gap of the one before it (see _waits)."""
    return rows.repartition("host").sortWithinPartitions("host") if "host" in rows.columns else rows


class _Waits:
    """Sleeps so that requests to one host begin at least the gap apart that the host asks for."""

    def __init__(self) -> None:
        self.free: dict[str, float] = {}

    def __call__(self, row: dict) -> None:
        host = row.get("host")
        if host is not None:
            time.sleep(max(0.0, self.free.get(host, 0.0) - time.monotonic()))
            self.free[host] = time.monotonic() + (row.get("gap_seconds") or 0.0)


def fetch_feeds(sources: DataFrame) -> DataFrame:
    """id, kind (fetched, not_modified, failed), status, content, etag, last_modified, error, duration_ms for each source.

    sources: id, feed_url, user_agent, timeout_sec, http_etag, http_last_modified, and host and gap_seconds if requests are to
    be spaced. Failures are rows; one bad source does not fail the others.
    """
    schema = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("status", pa.int32()), ("content", pa.binary()), ("etag", pa.string()), ("last_modified", pa.string()), ("error", pa.string()), ("duration_ms", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = _Waits()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                wait(r)
                began = time.monotonic()
                g = request(r["feed_url"], FEED_ACCEPT, r["user_agent"], r["timeout_sec"], r["http_etag"], r["http_last_modified"])
                kind = "failed" if g["error"] else "not_modified" if g["status"] == 304 else "fetched"
                rows.append({"id": r["id"], "kind": kind, "status": g["status"], "content": g["body"], "etag": g["etag"], "last_modified": g["last_modified"], "error": g["error"], "duration_ms": int(1000 * (time.monotonic() - began))})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    names = ["id", "feed_url", "user_agent", "timeout_sec", "http_etag", "http_last_modified", *[c for c in ("host", "gap_seconds") if c in sources.columns]]
    return _politely(sources.select(*names)).mapInArrow(work, FETCHED)


def fetch_robots(origins: DataFrame, agent: str = USER_AGENT) -> DataFrame:
    """origin, http_status, body of the robots file of each row of origins (origin, base). No answer is a null status.

    base: scheme://host:port to ask at; the origin, which rules are known by, has no port.
    """
    schema = pa.schema([("origin", pa.string()), ("http_status", pa.int32()), ("body", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = request(f"{base}/robots.txt", ROBOTS_ACCEPT, agent, ROBOTS_TIMEOUT, most=MAX_ROBOTS)
                rows.append({"origin": origin, "http_status": g["status"], "body": g["body"].decode("utf-8", "replace") if g["body"] is not None else None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return origins.select("origin", "base").mapInArrow(work, "origin string, http_status int, body string")


def fetch_pages(pages: DataFrame) -> DataFrame:
    """id, html, error of pages (id, url, and host and gap_seconds if requests are to be spaced), decoded as html.decode() does."""
    from ..functions.html import decode

    schema = pa.schema([("id", pa.int64()), ("html", pa.string()), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = _Waits()
        for batch in batches:
            for r in batch.to_pylist():
                wait(r)
                try:
                    row = {"id": r["id"], "html": decode(fetch_page(r["url"])), "error": None}
                except OSError as e:
                    row = {"id": r["id"], "html": None, "error": str(e)[:2000]}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return _politely(pages).mapInArrow(work, "id long, html string, error string")


def fetch_page(url: str, timeout: int = TIMEOUT) -> bytes:
    """The undecoded body of a page, at most 8 MiB; raises OSError for any failure."""
    g = request(url, "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", None, timeout, most=MAX_PAGE)
    if g["error"] or g["body"] is None:
        raise OSError(g["error"] or f"HTTP {g['status']}")
    return g["body"]


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """path, html of stored pages, decoded by mark or meta charset."""
    from ..functions.html import decode

    @F.arrow_udf("string")
    def text(parts: pa.Array) -> pa.Array:
        return pa.array([decode(x.as_py()) if x.is_valid else None for x in parts], pa.string())

    return spark.read.format("binaryFile").load(path).select("path", text(F.col("content")).alias("html"))


SEED = "slug string, name string, homepageUrl string, kind string, feedUrl string, language string, crawlIntervalSec int, rateLimitPerMin int, config string"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """The seed list as rows of the source table, defaults filled in; unknown keys ignored; a config that is not an
    object drops its row."""
    raw = spark.read.schema(SEED).option("multiLine", True).json(path)
    config = F.coalesce("config", F.lit("{}"))
    rows = raw.filter(F.col("slug").isNotNull() & F.trim(config).startswith("{"))
    return rows.select(
        "slug", "name", F.col("homepageUrl").alias("homepage_url"), "kind", F.col("feedUrl").alias("feed_url"), F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("crawlIntervalSec", F.lit(900)).alias("crawl_interval_sec"), F.coalesce("rateLimitPerMin", F.lit(20)).alias("rate_limit_per_min"), F.lit(True).alias("enabled"), config.alias("config"), F.lit(0).alias("consecutive_failures"),
    )
