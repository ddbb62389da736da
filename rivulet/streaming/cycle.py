"""The crawl as a cycle over snapshot tables: enqueue, work, extract, dedup and reap, each after its own delay.

Tables lie in one folder as numbered snapshots; a step reads the last ones and writes the next. One process runs a cycle;
claims are written before anything is fetched, so that a lease tells of a worker that died, and the reaper takes its jobs
back. What was fetched is written once and not fetched again if a task is repeated after that.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text
from ..functions.simhash import with_simhash
from ..functions.urls import base_of, host_of, origin_of
from ..operators import dedup, ingest, politeness, queue
from ..session import shared_dir, store
from ..sources import config, feeds

JOB = "id long, source_id long, job_type string, state string, attempt int, max_attempts int, scheduled_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, locked_by string, locked_until timestamp_ntz, last_error string"
SOURCE = "id long, slug string, feed_url string, enabled boolean, next_crawl_at timestamp_ntz, last_crawled_at timestamp_ntz, consecutive_failures int, crawl_interval_sec int, config string, http_etag string, http_last_modified string"
ARTICLE = "id long, source_id long, canonical_url string, url_hash binary, title string, summary string, content_hash binary, word_count int, status string, published_at timestamp_ntz, duplicate_of_id long, extract_attempts int, version int, simhash long, updated_at timestamp_ntz"
CONTENT = "article_id long, text_plain string, html string, extractor string"
ROBOTS = "origin string, http_status int, body string, fetched_at timestamp_ntz"
LOG = "job_id long, source_id long, http_status int, bytes long, duration_ms int, items_found int, items_new int, error string, created_at timestamp_ntz"
TABLES = {"jobs": JOB, "sources": SOURCE, "articles": ARTICLE, "content": CONTENT, "robots": ROBOTS, "log": LOG}
MAX_ATTEMPTS = 5
#: What extracted bodies are marked with, and how many snapshots of a table are kept.
EXTRACTOR, KEEP = "readability", 2


class Tables:
    """Tables by name as numbered snapshots in a folder; the last KEEP of each are kept."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/rivulet/cycle-{uuid.uuid4().hex}"
        self.last = dict.fromkeys(TABLES, -1)

    def __getitem__(self, name: str) -> DataFrame:
        n = self.last[name]
        return self.spark.createDataFrame([], TABLES[name]) if n < 0 else self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/v{n}")

    def __setitem__(self, name: str, df: DataFrame) -> None:
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        n = self.last[name] + 1
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").parquet(f"{self.folder}/{name}/v{n}")
        self.last[name] = n
        if n >= KEEP:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v{n - KEEP}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


    def append(self, name: str, df: DataFrame) -> None:
        """Rows more in the last snapshot of a table that only grows."""
        if self.last[name] < 0:
            self[name] = df
            return
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(f"{self.folder}/{name}/v{self.last[name]}")


def touched(before: DataFrame, after: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """after with updated_at = now in rows that are new or differ from before in any column but updated_at."""
    columns = [c for c in after.columns if c not in (key, "updated_at")]
    old = before.select(F.col(key), F.struct(*columns).alias("_old"), F.col("updated_at").alias("_at"))
    joined = after.drop("updated_at").join(old, key, "left")
    same = F.col("_old").isNotNull() & F.struct(*columns).eqNullSafe(F.col("_old"))
    return joined.withColumn("updated_at", F.when(same, F.col("_at")).otherwise(now)).select(after.columns)


def _stamp(at: datetime) -> Column:
    return F.lit(at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at).cast("timestamp_ntz")


class Cycle:
    """The five steps. `now` of a step is when it begins; seed is that of the jitter."""

    def __init__(self, tables: Tables, worker: str = "worker", agent: str = feeds.USER_AGENT, gap: float = politeness.DEFAULT_GAP, seed: int = 0) -> None:
        self.t, self.spark, self.worker, self.agent, self.gap, self.seed = tables, tables.spark, worker, agent, gap, seed

    # ------------------------------------------------------------ enqueue and reap

    def enqueue(self, at: datetime) -> int:
        """Feed jobs for due sources and extraction jobs for those with articles that wait; returns how many."""
        now, jobs = _stamp(at), self.t["jobs"]
        fresh = queue.enqueue_due(jobs, self.t["sources"], now).unionByName(queue.enqueue_extraction(jobs, self.t["sources"], self.t["articles"], self.t["content"], now))
        rows = fresh.select(F.lit(None).cast("long").alias("id"), "*", F.lit(0).alias("attempt"), F.lit(MAX_ATTEMPTS).alias("max_attempts"))
        rows = store(rows, "new-jobs")
        n = rows.count()
        if n:
            first = (jobs.agg(F.max("id").alias("m")).first()["m"] or 0) + 1
            self.t["jobs"] = jobs.unionByName(ingest.number_new(rows, first, "source_id"), allowMissingColumns=True)
        return n

    def reap(self, at: datetime) -> int:
        jobs, now = self.t["jobs"], _stamp(at)
        n = jobs.filter((F.col("state") == "running") & (F.col("locked_until") < now)).count()
        if n:
            self.t["jobs"] = queue.reap(jobs, now)
        return n

    # ------------------------------------------------------------ robots

    def _decided(self, urls: DataFrame, at: datetime) -> DataFrame:
        """urls (url and others, a written table) with allowed, gap_seconds, recheck. Robots files whose time is over are fetched."""
        now = _stamp(at)
        known = politeness.with_rules(self.t["robots"], self.agent.split("/")[0])
        origins = urls.select(origin_of(F.col("url")).alias("origin"), base_of(F.col("url")).alias("base")).filter("origin is not null").groupBy("origin").agg(F.min("base").alias("base"))
        missing = origins.join(known.filter(F.col("expires_at") > now).select("origin"), "origin", "left_anti")
        got = store(feeds.fetch_robots(missing, self.agent).withColumn("fetched_at", now), "robots")
        kept = self.t["robots"].join(got.select("origin"), "origin", "left_anti")
        self.t["robots"] = kept.unionByName(got)
        rules = store(politeness.with_rules(self.t["robots"], self.agent.split("/")[0]).select("origin", "rules", "expires_at"), "rules")
        decided = politeness.decide(urls, rules.select("origin", "rules"), gap=self.gap)
        until = rules.select(F.col("origin").alias("_o"), politeness.recheck_seconds(F.col("expires_at"), now).alias("recheck"))
        return store(decided.join(until, origin_of(F.col("url")) == F.col("_o"), "left").drop("_o"), "decided")

    # ------------------------------------------------------------ feeds

    def work(self, at: datetime) -> int:
        """Claim, fetch, ingest, finish: one batch of feed jobs; returns how many."""
        now = _stamp(at)
        self.t["jobs"] = queue.claim(self.t["jobs"], self.worker, queue.FEED, now)
        mine = store(queue.claimed(self.t["jobs"], self.t["sources"], self.worker).filter(F.col("job_type") == queue.FEED), "claimed")
        n = mine.count()
        if not n:
            return 0
        c = config.decode(F.col("config"))
        asked = mine.filter("trim(feed_url) <> ''").withColumn("c", c).withColumn("url", F.col("feed_url"))
        decided = self._decided(store(asked, "asked"), at)
        polite = decided.filter("allowed").select(F.col("source_id").alias("id"), "feed_url", F.col("c.userAgent").alias("user_agent"), F.col("c.requestTimeoutSec").alias("timeout_sec"), "http_etag", "http_last_modified", host_of(F.col("url")).alias("host"), "gap_seconds")
        got = store(feeds.with_entries(feeds.fetch_feeds(polite)), "fetched")

        limits = asked.select("source_id", F.col("c.maxItems").alias("max_items"), F.coalesce("c.feedHasFullContent", F.lit(False)).alias("full_content"))
        entries = got.filter("kind = 'fetched'").select(F.col("id").alias("source_id"), F.explode("entries").alias("e")).select("source_id", "e.*").join(limits, "source_id")
        cleaned = store(ingest.clean_entries(entries, now), "cleaned")
        batch = ingest.fold_batch(cleaned)
        first = (self.t["articles"].agg(F.max("id").alias("m")).first()["m"] or 0) + 1
        before = self.t["articles"]
        after = store(ingest.upsert(before, batch, first), "upserted")
        self.t["articles"] = touched(before, after.drop("change"), now)
        last = F.max_by(F.struct("text_plain", "html"), F.struct("source_id", "entry_idx"))
        bodies = cleaned.filter("content_hash is not null").groupBy("canonical_url").agg(last.alias("b")).select("canonical_url", "b.*")
        self.t["content"] = ingest.upsert_content(self.t["content"], self.t["articles"], bodies, "feed").drop("change")

        written = after.filter("change = 'insert'").groupBy("source_id").agg(F.count("*").cast("int").alias("items_new"))
        found = entries.groupBy("source_id").agg(F.count("*").cast("int").alias("items_found"))
        fetched = got.select(F.col("id").alias("source_id"), "kind", F.col("status").alias("http_status"), "duration_ms", F.length("content").cast("long").alias("bytes"), "error")
        blocked = decided.filter("not allowed").select("source_id", F.lit("deferred").alias("kind"), F.lit("blocked by robots.txt").alias("error"), F.col("recheck").alias("seconds"))
        homeless = mine.join(asked.select("id"), "id", "left_anti").select("source_id", F.lit("failed").alias("kind"), F.lit("source has no feed_url").alias("error"))
        ends = fetched.unionByName(blocked, allowMissingColumns=True).unionByName(homeless, allowMissingColumns=True)
        counted = ends.join(found, "source_id", "left").join(written, "source_id", "left")
        none = F.when(F.col("kind") != "failed", F.lit(0))
        ends = store(counted.withColumn("items_found", F.coalesce("items_found", none)).withColumn("items_new", F.coalesce("items_new", none)).join(mine.select(F.col("id").alias("job_id"), "source_id"), "source_id"), "ends")

        done, failed = ends.filter("kind <> 'failed'"), ends.filter("kind = 'failed'")
        jobs = queue.succeed(self.t["jobs"], done.select(F.col("job_id").alias("id")), now)
        self.t["jobs"] = queue.fail_with_backoff(jobs, failed.select(F.col("job_id").alias("id"), "error"), now, self.seed)
        kind = F.when(F.col("kind").isin("fetched", "not_modified"), "success").when(F.col("kind") == "deferred", "deferred").otherwise("failure")
        sources = queue.record_outcome(self.t["sources"], ends.select(F.col("source_id").alias("id"), kind.alias("kind"), F.coalesce("seconds", F.lit(0)).alias("seconds")), now)
        self.t["sources"] = ingest.store_validators(sources, got.filter("kind = 'fetched'").select("id", "etag", "last_modified"))
        self._log(ends, now)
        return n

    def _log(self, ends: DataFrame, now: Column) -> None:
        rows = queue.log_rows(ends, now)
        sized = rows.drop("bytes").join(ends.select("job_id", "bytes"), "job_id") if "bytes" in ends.columns else rows
        self.t.append("log", sized.select([f.split()[0] for f in LOG.split(", ")]))

    # ------------------------------------------------------------ pages

    def extract(self, at: datetime) -> dict[str, int]:
        """Claim extraction jobs, count the tries, fetch pages, keep bodies; returns extracted, blocked, failed."""
        now = _stamp(at)
        self.t["jobs"] = queue.claim(self.t["jobs"], self.worker, queue.ARTICLE, now)
        mine = store(queue.claimed(self.t["jobs"], self.t["sources"], self.worker).filter(F.col("job_type") == queue.ARTICLE).select("id", "source_id"), "claimed")
        if mine.isEmpty():
            return {"extracted": 0, "blocked": 0, "failed": 0}
        waiting = ingest.pending_extraction(self.t["articles"], self.t["content"]).join(mine.select("source_id"), "source_id", "left_semi")
        waiting = store(waiting.select("id", "source_id", F.col("canonical_url").alias("url")), "waiting")
        # counted before the try: a page that kills its worker is not tried for ever
        self.t["articles"] = touched(self.t["articles"], ingest.bump_attempts(self.t["articles"], waiting), now)
        decided = self._decided(waiting, at)
        pages = store(feeds.fetch_pages(decided.filter("allowed").select("id", "url", host_of(F.col("url")).alias("host"), "gap_seconds")), "pages")
        found = store(html.with_extract(pages.filter("html is not null"), "html").filter("extracted is not null").select("id", F.col("extracted.text").alias("t"), F.col("extracted.html").alias("html")), "extracted")
        h = text.content_hash(F.col("t"))
        self.store_extraction(found.select("id", "t", "html", h.alias("content_hash"), F.when(h.isNotNull(), text.word_count(F.col("t"))).alias("word_count")), now)
        counts = decided.join(found.select("id", F.lit(True).alias("_ok")), "id", "left")
        counts = store(counts.groupBy("source_id").agg(F.count("*").cast("int").alias("items_found"), F.count_if(F.coalesce("_ok", F.lit(False))).cast("int").alias("items_new"), F.count_if(~F.col("allowed")).alias("blocked")), "extraction-counts")
        self.t["jobs"] = queue.succeed(self.t["jobs"], mine.select("id"), now)
        ends = mine.select(F.col("id").alias("job_id"), "source_id").join(counts, "source_id").select("job_id", "source_id", F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("int").alias("duration_ms"), "items_found", "items_new", F.lit(None).cast("string").alias("error"))
        self._log(ends, now)
        total = counts.agg(F.sum("items_found").alias("n"), F.sum("items_new").alias("extracted"), F.sum("blocked").alias("blocked")).first()
        n, extracted, blocked = (total[k] or 0 for k in ("n", "extracted", "blocked"))
        return {"extracted": extracted, "blocked": blocked, "failed": n - extracted - blocked}

    def store_extraction(self, found: DataFrame, now: Column) -> None:
        """Both halves of an extraction (id, t, html, content_hash, word_count): the article's hash and the content row."""
        before = self.t["articles"]
        self.t["articles"] = touched(before, ingest.store_extraction(before, found), now)
        bodies = found.join(before.select("id", "canonical_url"), "id").select("canonical_url", F.col("t").alias("text_plain"), "html")
        self.t["content"] = ingest.upsert_content(self.t["content"], before, bodies, EXTRACTOR).drop("change")

    # ------------------------------------------------------------ duplicates

    def dedup(self, at: datetime) -> dict[str, int]:
        """Missing fingerprints, then a sweep; returns fingerprinted, demoted, repointed."""
        now, before = _stamp(at), self.t["articles"]
        backlog = ingest.fingerprint_backlog(before, self.t["content"])
        prints = store(with_simhash(backlog, "text_plain", "_simhash").select("id", "_simhash"), "prints")
        marked = before.join(prints, "id", "left").withColumn("simhash", F.coalesce("_simhash", "simhash")).select(before.columns)
        marked = store(marked, "marked")
        after = store(dedup.sweep(marked), "swept")
        self.t["articles"] = touched(before, after, now)
        counts = dedup.sweep_counts(marked, after).first()
        return {"fingerprinted": prints.filter("_simhash is not null").count(), "demoted": counts["demoted"], "repointed": counts["repointed"]}


def run(cycle: Cycle, every: dict[str, float], rounds: int | None = None, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> list[tuple[str, object]]:
    """Run the steps of `every` (step: seconds from the end of a run to the next one). rounds: end after so many runs.

    A step that fails is reported and runs again after its delay; the others go on.
    """
    due = dict.fromkeys(every, 0.0)
    done: list[tuple[str, object]] = []
    while rounds is None or len(done) < rounds:
        step = min(due, key=lambda s: (due[s], list(every).index(s)))
        wait = due[step] - clock()
        if wait > 0:
            sleep(wait)
        try:
            told = getattr(cycle, step)(datetime.fromtimestamp(clock(), UTC))
        except Exception as e:  # one broken step must not end the others
            told = e
        done.append((step, told))
        due[step] = clock() + every[step]
    return done
