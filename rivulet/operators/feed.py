"""Keyset-paginated feeds."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

DEFAULT_LIMIT, MAX_LIMIT = 30, 100


class BadCursor(ValueError):
    """A page token that was not made by encode_cursor()."""


def clamp(limit: int | None) -> int:
    return max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))


def encode_cursor(published_at: datetime, row_id: int) -> str:
    t = published_at if published_at.tzinfo is None else published_at.astimezone(UTC).replace(tzinfo=None)
    text = t.strftime("%Y-%m-%dT%H:%M:%S")
    if t.microsecond:
        micros = f"{t.microsecond:06d}"
        text += "." + (micros[:3] if micros.endswith("000") else micros)
    return base64.urlsafe_b64encode(f"{text}Z|{row_id}".encode()).decode().rstrip("=")


def decode_cursor(raw: str) -> tuple[datetime, int]:
    try:
        text = base64.b64decode(raw + "=" * (-len(raw) % 4), altchars=b"-_", validate=True).decode()
        instant, sep, row_id = text.partition("|")
        if not sep or not instant.endswith("Z"):
            raise BadCursor(raw)
        return datetime.fromisoformat(instant[:-1]), int(row_id)
    except (ValueError, binascii.Error, UnicodeDecodeError) as e:
        raise BadCursor(f"malformed cursor: {raw!r}") from e


def after(published_at: Column, row_id: Column, at: datetime, at_id: int, kind: DataType) -> Column:
    """(published_at, id) < (at, at_id). The plain bound beside the row comparison is what reaches the Parquet scan.

    kind: the type of published_at; the literal is cast to it, for a cast of the column would keep it from the scan.
    """
    t = F.expr(f"TIMESTAMP_NTZ '{at.isoformat(sep=' ')}'").cast(kind)
    return (published_at <= t) & ((published_at < t) | (row_id < F.lit(at_id)))


def page(articles: DataFrame, sources: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """The next rows of the feed, newest first: published articles with slug and name of their source.

    articles: id, source_id, canonical_url, title, summary, image_url, published_at, status. Each article's source is known by
    a foreign key, so the page is cut before the join and at most `limit` rows look for theirs. Should some have none, the
    page is refilled: an inner join drops such rows, so the next articles take their places.
    """
    n = clamp(limit)
    own = articles.filter(F.col("status") == "published")
    if cursor is not None:
        own = own.filter(after(F.col("published_at"), F.col("id"), *decode_cursor(cursor), articles.schema["published_at"].dataType))
    newest = (F.desc("published_at"), F.desc("id"))
    named = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"), F.col("name").alias("source_name"))
    top = own.select("id", "source_id", "published_at").orderBy(*newest).limit(n)
    homeless = top.join(named, "source_id", "left_anti").limit(1)
    if not homeless.isEmpty():
        own = own.join(named.select("source_id"), "source_id", "left_semi")
    kept = ("id", "title", "summary", "canonical_url", "image_url", "published_at", "source_slug", "source_name")
    return F.broadcast(own.orderBy(*newest).limit(n)).join(named, "source_id").select(*kept).orderBy(*newest)


def feed(articles: DataFrame, sources: DataFrame, cursor: str | None = None, limit: int | None = None) -> dict:
    """One response: items, and nextCursor if the page is full."""
    rows = [r.asDict() for r in page(articles, sources, limit, cursor).collect()]
    full = len(rows) == clamp(limit)
    return {"items": rows, "nextCursor": encode_cursor(rows[-1]["published_at"], rows[-1]["id"]) if full else None}


#: JSON names of the columns of a page (fixed values of the read API).
JSON_NAMES = {"id": "id", "title": "title", "summary": "summary", "canonical_url": "canonicalUrl", "image_url": "imageUrl", "published_at": "publishedAt", "source_slug": "sourceSlug", "source_name": "sourceName"}


def respond(articles: DataFrame, sources: DataFrame, query: str = "") -> tuple[int, str]:
    """Status and JSON body for GET /api/articles?limit=&cursor=: 400 for a cursor or limit that can't be read."""
    asked = dict(parse_qsl(query, keep_blank_values=True))
    try:
        limit = int(asked["limit"]) if asked.get("limit") else None
        got = feed(articles, sources, asked.get("cursor") or None, limit)
    except ValueError as e:
        return 400, json.dumps({"error": str(e)})
    stamp = lambda v: v.isoformat() + "Z" if isinstance(v, datetime) else v
    items = [{JSON_NAMES[k]: stamp(v) for k, v in r.items()} for r in got["items"]]
    return 200, json.dumps({"items": items, "nextCursor": got["nextCursor"]}, ensure_ascii=False)


def server(articles: DataFrame, sources: DataFrame, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """The read API over HTTP; the caller starts it with serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            path, _, query = self.path.partition("?")
            status, body = respond(articles, sources, query) if path == "/api/articles" else (404, json.dumps({"error": "not found"}))
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def iterate(articles: DataFrame, sources: DataFrame, limit: int | None = None) -> Iterator[dict]:
    """All responses of a reader that follows nextCursor."""
    cursor = None
    while True:
        got = feed(articles, sources, cursor, limit)
        yield got
        cursor = got["nextCursor"]
        if cursor is None:
            return


def per_source(articles: DataFrame, k: int = 20) -> DataFrame:
    """The newest k rows of each source; ties by id. Spark limits each task's groups before the shuffle."""
    order = Window.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("id"))
    return articles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def offset_page(articles: DataFrame, offset: int, limit: int) -> DataFrame:
    """The page that keyset paging replaces: reads and sorts what it skips."""
    return articles.filter(F.col("status") == "published").orderBy(F.desc("published_at"), F.desc("id")).offset(offset).limit(limit)


def page_with_tags(articles: DataFrame, bridge: DataFrame, tags: DataFrame, limit: int) -> DataFrame:
    """A page of articles first, then its tags by two outer joins.

    The page has MAX_LIMIT rows at most, so it is sent to the bridge rows; how many tags it has is not bounded, so those are
    joined as Spark finds best.
    """
    top = articles.filter(F.col("status") == "published").orderBy(F.desc("published_at"), F.desc("id")).limit(clamp(limit)).select("id", "published_at")
    own = bridge.join(F.broadcast(top.select(F.col("id").alias("article_id"))), "article_id", "left_semi")
    tagged = top.join(own, top["id"] == own["article_id"], "left").drop("article_id")
    return tagged.join(tags, "tag_id", "left")
