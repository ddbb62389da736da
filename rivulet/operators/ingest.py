"""Feed entries to article snapshots: cleaning, idempotent upserts, content upserts, seeds and validators.

There is no MERGE target in plain Parquet, so an upsert is snapshot + batch -> snapshot, and a changed-row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..session import store

ARTICLE = "id long, source_id long, canonical_url string, url_hash binary, title string, summary string, content_hash binary, word_count int, status string, published_at timestamp, duplicate_of_id long, extract_attempts int, version int"


def _blank_to_null(c: Column) -> Column:
    t = urls.trim_all(c)
    return F.when(t == "", None).otherwise(t)


def clean_entries(entries: DataFrame, now: Column) -> DataFrame:
    """Entries (source_id, entry_idx, link, title, description, contents array, published, updated, max_items,
    full_content) to upsert rows, in feed order.

    Only the first max_items entries of a source are looked at; without a link an entry is dropped; a blank title is the
    link; the date is published, else updated, else now. A body is taken only from sources that declare full content, and
    stored only above the hash floor.
    """
    order = Window.partitionBy("source_id").orderBy("entry_idx")
    capped = entries.withColumn("_n", F.row_number().over(order)).filter(F.col("max_items").isNull() | (F.col("_n") <= F.col("max_items")))
    link = _blank_to_null(F.col("link"))
    bodies = F.array_compact(F.concat(F.coalesce("contents", F.array().cast("array<string>")), F.array("description")))
    # the longest, the first of equals
    longest = F.reduce(bodies, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))
    rows = capped.filter(link.isNotNull()).select(
        "source_id",
        "entry_idx",
        urls.canonicalize(link).alias("canonical_url"),
        F.coalesce(_blank_to_null(F.col("title")), link).alias("title"),
        F.col("description"),
        F.coalesce("published", "updated", now).alias("published_at"),
        F.when(F.coalesce("full_content", F.lit(False)), longest).alias("body_html"),
    )
    rows = html.with_text(html.with_text(rows, "description", "_summary"), "body_html", "_norm")
    hashed = text.content_hash(F.col("_norm"))
    return rows.select(
        "source_id", "entry_idx", "canonical_url", urls.url_hash(F.col("canonical_url")).alias("url_hash"), "title", text.summarize(F.col("_summary")).alias("summary"), "published_at",
        hashed.alias("content_hash"), F.when(hashed.isNotNull(), text.word_count(F.col("_norm"))).alias("word_count"), F.when(hashed.isNotNull(), F.col("_norm")).alias("text_plain"), F.when(hashed.isNotNull(), F.col("body_html")).alias("html"),
    )


def fold_batch(batch: DataFrame) -> DataFrame:
    """One row for each url_hash: source and date of the first entry, title and summary of the last, last known hash."""
    at = F.struct("source_id", "entry_idx")
    known = F.when(F.col("content_hash").isNotNull(), at)
    return batch.groupBy("url_hash").agg(
        F.min_by("canonical_url", at).alias("canonical_url"), F.min_by("source_id", at).alias("source_id"), F.min_by("published_at", at).alias("published_at"),
        F.max_by("title", at).alias("title"), F.max_by(F.struct("summary"), at)["summary"].alias("summary"), F.max_by("content_hash", known).alias("content_hash"), F.max_by("word_count", known).alias("word_count"),
    )


def upsert(existing: DataFrame, batch: DataFrame, next_id: int) -> DataFrame:
    """The snapshot after the batch (one row for each url_hash), with `change`: insert, update, or none.

    New rows are published and get ids from next_id on, in order of their hash. Old rows take title and summary, and a
    hash and word count where the batch has one; date, source and status never change. Equal values change nothing.
    """
    mine = existing.select(*[F.col(c).alias(f"o_{c}") for c in existing.columns])
    b = batch.select(*[F.col(c).alias(f"b_{c}") for c in ("url_hash", "canonical_url", "source_id", "published_at", "title", "summary", "content_hash", "word_count")])
    joined = mine.join(b, F.col("o_url_hash") == F.col("b_url_hash"), "full_outer")
    old, new = F.col("o_url_hash").isNotNull(), F.col("b_url_hash").isNotNull()
    merged = {"title": F.col("b_title"), "summary": F.col("b_summary"), "content_hash": F.coalesce("b_content_hash", "o_content_hash"), "word_count": F.coalesce("b_word_count", "o_word_count")}
    differs = F.lit(False)
    for c, v in merged.items():
        differs = differs | ~v.eqNullSafe(F.col(f"o_{c}"))
    change = F.when(~old, "insert").when(new & differs, "update").otherwise("none")
    fresh = {"id": F.lit(None).cast("long"), "status": F.lit("published"), "extract_attempts": F.lit(0), "version": F.lit(0), "duplicate_of_id": F.lit(None).cast("long")}
    columns = []
    for f in existing.schema.fields:
        c = f.name
        if c in merged:
            value = F.when(~old, F.col(f"b_{c}")).when(change == "update", merged[c]).otherwise(F.col(f"o_{c}"))
        elif c == "version":
            value = F.when(~old, 0).when(change == "update", F.col("o_version") + 1).otherwise(F.col("o_version"))
        elif c in ("url_hash", "canonical_url", "source_id", "published_at"):
            value = F.coalesce(f"o_{c}", f"b_{c}")
        elif c in fresh:
            value = F.when(~old, fresh[c]).otherwise(F.col(f"o_{c}"))
        else:
            value = F.col(f"o_{c}")
        columns.append(value.cast(f.dataType).alias(c))
    out = joined.select(*columns, change.alias("change"))
    return number_new(out, next_id)


def change_counts(upserted: DataFrame) -> DataFrame:
    """source_id, written, updated, unchanged, bodied: what an upsert did, by source."""
    n = lambda c: F.count_if(F.col("change") == c)
    return upserted.groupBy("source_id").agg(n("insert").alias("written"), n("update").alias("updated"), n("none").alias("unchanged"), F.count("content_hash").alias("bodied"))


def number_new(rows: DataFrame, next_id: int, order: str = "url_hash") -> DataFrame:
    """Consecutive ids in order of a column for rows without one, without gathering them in one task.

    The new rows are written once, by ranges of the order column, each with the number of its range: where a range begins
    is sampled, so ranges made twice need not be the same. The written ranges are counted, the counts summed up on the
    driver (one for each range), and each range is numbered by itself. Rows with equal values of the column get ids of
    their own.
    """
    ranged = rows.filter("id is null").repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    fresh = store(ranged, "new-rows")
    counts = sorted((r["_part"], r["n"]) for r in fresh.groupBy("_part").agg(F.count("*").alias("n")).collect())
    if not counts:
        return rows
    base, starts = next_id, []
    for part, n in counts:
        starts.append((part, base))
        base += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _base long"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    numbered = fresh.join(start, "_part").withColumn("id", F.col("_base") + rank).select(rows.columns)
    return rows.filter("id is not null").unionByName(numbered)


def upsert_content(content: DataFrame, articles: DataFrame, batch: DataFrame, extractor: str) -> DataFrame:
    """content (article_id, text_plain, html, extractor) after bodies (canonical_url, text_plain, html) by URL hash.

    A URL without an article stores nothing; an equal text changes nothing.
    """
    ids = articles.select("url_hash", F.col("id").alias("article_id"))
    b = batch.filter(F.col("text_plain").isNotNull()).select(urls.url_hash(F.col("canonical_url")).alias("url_hash"), F.col("text_plain").alias("b_text"), F.col("html").alias("b_html"))
    b = b.join(ids, "url_hash").select("article_id", "b_text", "b_html", F.lit(extractor).alias("b_extractor"))
    joined = content.join(b, "article_id", "full_outer")
    take = F.col("b_text").isNotNull() & ~F.col("b_text").eqNullSafe(F.col("text_plain"))
    pick = lambda new, old: F.when(take, F.col(new)).otherwise(F.col(old)).alias(old)
    return joined.select("article_id", pick("b_text", "text_plain"), pick("b_html", "html"), pick("b_extractor", "extractor"), F.when(take, F.when(F.col("text_plain").isNull(), "insert").otherwise("update")).otherwise("none").alias("change"))


def store_extraction(articles: DataFrame, extracted: DataFrame) -> DataFrame:
    """articles after extraction results (id, content_hash, word_count): known values are kept where there is no new one."""
    e = extracted.select("id", F.col("content_hash").alias("_hash"), F.col("word_count").alias("_words"))
    joined = articles.join(e, "id", "left")
    return joined.withColumn("content_hash", F.coalesce("_hash", "content_hash")).withColumn("word_count", F.coalesce("_words", "word_count")).select(articles.columns)


def store_validators(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """sources after responses (id, etag, last_modified): each validator is kept where the response has none."""
    s = seen.select("id", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
    joined = sources.join(s, "id", "left")
    return joined.withColumn("http_etag", F.coalesce("_etag", "http_etag")).withColumn("http_last_modified", F.coalesce("_modified", "http_last_modified")).select(sources.columns)


def insert_absent(existing: DataFrame, seeds: DataFrame, key: str = "slug") -> DataFrame:
    """existing and those seeds whose key it does not have; rows that exist are never updated."""
    fresh = seeds.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def pending_extraction(articles: DataFrame, content: DataFrame, max_attempts: int = 3, per_source: int = 20) -> DataFrame:
    """The newest articles of each source that have no content yet: not duplicates, fewer than max_attempts tries."""
    open_ = articles.filter((F.col("status") != "duplicate") & (F.col("extract_attempts") < max_attempts))
    left = open_.join(content.select(F.col("article_id").alias("id")), "id", "left_anti")
    order = Window.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("id"))
    return left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_source).drop("rank")


def fingerprint_backlog(articles: DataFrame, content: DataFrame) -> DataFrame:
    """id, text_plain of articles without a fingerprint whose text is long enough for one. All of them, not a batch."""
    long = content.filter(F.length("text_plain") >= text.MIN_HASHABLE).select(F.col("article_id").alias("id"), "text_plain")
    return articles.filter(F.col("simhash").isNull()).select("id").join(long, "id")


def bump_attempts(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Counted before the try, so that a page that kills its worker is not tried for ever."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(1))
    return articles.join(hit, "id", "left").withColumn("extract_attempts", F.col("extract_attempts") + F.coalesce("_hit", F.lit(0))).select(articles.columns)
