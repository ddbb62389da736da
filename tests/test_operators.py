"""Dedup, feed, queue, politeness, ingest, search, vectors, streams: against plain versions and as properties."""

import gzip
import random
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import dedup, feed, ingest, politeness, queue, search
from rivulet.plans import registry
from rivulet.sources import config, feeds
from rivulet.streaming import jobs as streams

T0 = datetime(2024, 1, 1)
ARTICLE = "id long, published_at timestamp_ntz, status string, content_hash string, simhash long, duplicate_of_id long"


# ---------------------------------------------------------------- the registry against its SQL


def rows_of(result):
    norm = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(([norm(v) for v in r] for r in result), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    got = rows_of(map(tuple, df.select(*columns).collect()))
    assert got == rows_of(db.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert got or name == "semantic_winners"  # no two vectors of the smallest table are that near


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


# ---------------------------------------------------------------- dedup


def random_articles(seed, n=120):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    out = []
    for i in range(n):
        fp = None if rng.random() < 0.1 else rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        fp = fp - 2**64 if fp is not None and fp >= 2**63 else fp
        out.append((i, T0 + timedelta(hours=rng.randrange(200), seconds=rng.choice([0, 0, 1])), rng.choice(["published"] * 9 + ["duplicate"]), rng.choice([None, f"h{rng.randrange(30)}", f"u{i}"]), fp, None))
    return [(*r[:5], 0 if r[2] == "duplicate" else None) for r in out]


def plain_sweep(rows):
    state = {r[0]: list(r) for r in rows}
    live = lambda: [r for r in state.values() if r[2] != "duplicate"]
    groups = {}
    for r in live():
        if r[3] is not None:
            groups.setdefault(r[3], []).append(r)
    for g in groups.values():
        first = min(g, key=lambda r: (r[1], r[0]))
        for r in g:
            if r is not first:
                r[2], r[5] = "duplicate", first[0]
    before = [r for r in live() if r[4] is not None]
    found = {}
    for r in before:
        w = [o for o in before if (o[1], o[0]) < (r[1], r[0]) and o[1] > r[1] - timedelta(hours=48) and ((o[4] ^ r[4]) & (2**64 - 1)).bit_count() <= 3]
        if w:
            found[r[0]] = min(w, key=lambda o: (o[1], o[0]))[0]
    for i, w in found.items():
        state[i][2], state[i][5] = "duplicate", w
    hop = {i: state[r[5]][5] for i, r in state.items() if r[2] == "duplicate" and r[5] in state and state[r[5]][2] == "duplicate" and state[r[5]][5] not in (None, i)}
    for i, t in hop.items():
        state[i][5] = t
    return sorted((r[0], r[2], r[5]) for r in state.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_equals_the_plain_version(spark, seed):
    rows = random_articles(seed)
    df = spark.createDataFrame(rows, ARTICLE)
    assert sorted((r["id"], r["status"], r["duplicate_of_id"]) for r in dedup.sweep(df).collect()) == plain_sweep(rows)


def test_sweep_is_idempotent_and_late_originals_win(spark):
    rows = [(2, T0 + timedelta(hours=1), "published", "h", None, None), (3, T0 + timedelta(hours=2), "published", "h", None, None)]
    once = dedup.sweep(spark.createDataFrame(rows, ARTICLE))
    again = dedup.sweep(once)
    assert [r["demoted"] for r in dedup.sweep_counts(once, again).collect()] == [0]
    late = once.unionByName(spark.createDataFrame([(1, T0, "published", "h", None, None)], ARTICLE))
    assert sorted((r["id"], r["duplicate_of_id"]) for r in dedup.sweep(late).collect()) == [(1, None), (2, 1), (3, 1)]


def test_near_pairs_equal_brute_force_and_plan_an_equi_join(spark):
    rows = [r for r in random_articles(7, 200) if r[4] is not None and r[2] != "duplicate"]
    df = spark.createDataFrame(rows, ARTICLE)
    pairs = dedup.near_pairs(df)
    got = sorted((r["loser"], r["winner"], r["distance"]) for r in pairs.collect())
    want = [(a[0], b[0], ((a[4] ^ b[4]) & (2**64 - 1)).bit_count()) for a in rows for b in rows if (b[1], b[0]) < (a[1], a[0]) and b[1] > a[1] - timedelta(hours=48)]
    assert got == sorted(p for p in want if p[2] <= 3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("tile", [7, 4096])
def test_hamming_histogram(spark, tile):
    rows = [(None if r[4] is None else r[4],) for r in random_articles(3, 150)]
    fps = [r[0] for r in rows if r[0] is not None]
    want = {}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            d = ((a ^ b) & (2**64 - 1)).bit_count()
            want[d] = want.get(d, 0) + 1
    for most in (dedup.HISTOGRAM, 64):
        got = dedup.hamming_histogram(spark.createDataFrame(rows, "simhash long"), most, tile).collect()
        assert {r["distance"]: r["pairs"] for r in got} == {d: n for d, n in want.items() if d <= most}


def test_ten_thousand_near_copies_in_one_window(spark):
    """Each row loses to the first one of its 48 hours; as pairs these would be 50 million."""
    rows = [(i, T0 + timedelta(seconds=17 * i), "published", None, 1 << (i % 3) if i % 2 else 0, None) for i in range(10_000)]
    got = {r["id"]: r["winner"] for r in dedup.near_winners(spark.createDataFrame(rows, ARTICLE)).collect()}
    first = lambda i: next(k for k in range(max(0, i - 48 * 3600 // 17 - 1), i + 1) if 17 * (i - k) < 48 * 3600)
    assert got == {i: first(i) for i in range(1, 10_000)}


def test_hot_hash_and_null_rows(spark):
    rows = [(i, T0, "published", "h" if i % 2 else None, None, None) for i in range(4000)] + [(9999, None, "published", "h", None, None)]
    got = {r["id"]: r["winner"] for r in dedup.exact_winners(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert len(got) == 2000 and set(got.values()) == {9999}  # a row without a date comes first
    assert dedup.exact_winners(spark.createDataFrame([], ARTICLE)).count() == 0 and dedup.near_winners(spark.createDataFrame([], ARTICLE)).count() == 0


# ---------------------------------------------------------------- feed


def test_pages_partition_the_feed(spark, sf):
    a, s = registry.articles(spark, sf).cache(), registry.customers(spark, sf).cache()
    a = a.filter("id < 400")
    pages = list(feed.iterate(a, s, 37))
    ids = [r["id"] for p in pages for r in p["items"]]
    want = [r["id"] for r in a.join(s.select(F.col("id").alias("source_id")), "source_id").filter("status = 'published'").orderBy(F.desc("published_at"), F.desc("id")).collect()]
    assert ids == want and len(set(ids)) == len(ids) and pages[-1]["nextCursor"] is None


def test_full_last_page_gives_one_empty_page(spark, sf):
    a, s = registry.articles(spark, sf).filter("status = 'published'").limit(6).cache(), registry.customers(spark, sf)
    a = spark.createDataFrame(a.collect(), a.schema)
    assert [len(p["items"]) for p in feed.iterate(a, s, 3)] == [3, 3, 0]


def test_cursor_round_trip_and_bad_tokens():
    for t in (T0, T0 + timedelta(milliseconds=5), T0 + timedelta(microseconds=7)):
        assert feed.decode_cursor(feed.encode_cursor(t, 42)) == (t, 42)
    for bad in ("", "???", "bm8", feed.encode_cursor(T0, 1)[:-6], "MjAyNHwx"):
        with pytest.raises(feed.BadCursor):
            feed.decode_cursor(bad)
    assert [feed.clamp(x) for x in (None, 0, 7, 1000)] == [30, 1, 7, 100]


def test_cursor_bound_reaches_the_scan(spark, sf):
    plan = registry.feed_keyset_page(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" in plan.split("PushedFilters: ")[1] or "LessThanOrEqual(o_orderdate" in plan, plan


# ---------------------------------------------------------------- politeness


@pytest.mark.parametrize("seed", range(3))
def test_schedule_equals_its_recurrence(spark, seed):
    rng = random.Random(seed)
    rows = [(f"h{rng.randrange(4)}", i, float(rng.randrange(60)), float(rng.choice([3, 3, 5, 10]))) for i in range(150)]
    got = {r["id"]: r["start"] for r in politeness.schedule(spark.createDataFrame(rows, "host string, id long, arrival double, gap double")).collect()}
    free = {}
    for h, i, t, g in sorted(rows, key=lambda r: (r[2], r[1])):
        start = max(t, free.get(h, t))
        assert abs(got[i] - start) < 1e-9
        free[h] = start + g


ROBOTS = """
# comment
Disallow: /before-any-agent
User-agent: a
User-agent: B
Allow: /ok   # tail
Disallow: /
Crawl-delay: 2
Sitemap: https://x/y
User-agent: *
Disallow:
User-agent: b
Crawl-delay: x
"""


def test_robots_groups(spark):
    files = spark.createDataFrame([("https://a", 200, ROBOTS, T0), ("https://b", 200, ROBOTS, T0), ("https://c", 200, "", T0), ("https://d", 200, None, T0), ("https://e", None, None, T0)], "origin string, http_status int, body string, fetched_at timestamp_ntz")

    def rules(agent):
        return {r["origin"][-1]: r["rules"] for r in politeness.with_rules(files, agent).collect()}

    assert rules("A")["a"]["disallows"] == ["/"] and rules("a")["b"]["crawl_delay"] == 2.0
    b = rules("b")["a"]
    assert b["allows"] == ["/ok"] and b["crawl_delay"] is None and b["matched_agent"] == "b"
    other = rules("other")
    assert other["a"]["matched_agent"] == "*" and other["a"]["disallows"] == []
    assert other["c"]["matched_agent"] is None and other["d"]["disallows"] == [] and other["e"]["disallows"] == ["/"]


def test_robots_match_takes_linear_time(spark):
    """Many stars against a long path that almost matches: a backtracking matcher would not come back."""
    df = spark.createDataFrame([("/" + "*a" * 200 + "*b", "/" + "a" * 20_000)], "p string, path string")
    began = time.time()
    assert df.select(politeness.longest_match(F.array("p"), F.col("path"))).first()[0] == -1 and time.time() - began < 20


def test_robots_patterns(spark):
    cases = [("/a", "/abc", True), ("/a$", "/abc", False), ("/a$", "/a", True), ("/*.pdf$", "/x/y.pdf", True), ("/*.pdf$", "/x/y.pdf?z", False), ("/a*c", "/abbbc/d", True), ("/a.b", "/aXb", False), ("/a*b*$", "/axb/c", True), ("/*aa$", "/aaa", True), ("*", "/", True), ("/a*a$", "/a", False), ("/x*y*z$", "/xyzz", True), ("/(x)+[y]", "/(x)+[y]z", True), ("", "/", False)]
    df = spark.createDataFrame(cases, "p string, path string, want boolean")
    got = df.select((politeness.longest_match(F.array("p"), F.col("path")) >= 0).alias("got"), "want", "p").collect()
    assert all(r["got"] == r["want"] for r in got), got


# ---------------------------------------------------------------- queue


def test_workers_never_claim_the_same_job(spark, sf):
    j, now = registry.jobs(spark, sf), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    for w in range(4):
        j = queue.claim(j, f"w{w + 1}", queue.FEED, now, batch=15, workers=4, shard=w)
    got = j.filter("locked_by like 'w%' and locked_by <> 'w0'").groupBy("locked_by").agg(F.count("*").alias("n"), F.collect_set(F.col("id") % 4).alias("m")).collect()
    assert sum(r["n"] for r in got) == 60 and all(len(r["m"]) == 1 for r in got)


# ---------------------------------------------------------------- ingest and sources


ENTRY = "source_id long, entry_idx int, link string, title string, description string, contents array<string>, published timestamp_ntz, updated timestamp_ntz, max_items int, full_content boolean"


def test_entries_are_cleaned_and_bodies_gated(spark):
    long = "<p>" + "word " * 200 + "</p>"
    rows = [
        (1, 0, " https://a.example/x?utm_source=f ", " ", "<b>hi</b> &amp; bye", None, None, T0, None, None),
        (1, 1, "  ", "no link", None, None, T0, None, None, None),
        (2, 0, "https://a.example/y", "t", "short", ["tiny", long], T0, T0, 1, True),
        (2, 1, "https://a.example/z", "over the cap", None, None, T0, T0, 1, True),
        (3, 0, "https://a.example/w", "t", None, None, None, None, None, True),
    ]
    now = F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'")
    got = {r["canonical_url"]: r for r in ingest.clean_entries(spark.createDataFrame(rows, ENTRY), now).collect()}
    assert sorted(got) == ["https://a.example/w", "https://a.example/x", "https://a.example/y"]
    x, y, w = got["https://a.example/x"], got["https://a.example/y"], got["https://a.example/w"]
    assert x["title"] == "https://a.example/x?utm_source=f" and x["summary"] == "hi & bye" and x["published_at"] == T0 and x["content_hash"] is None
    assert y["word_count"] == 200 and y["text_plain"].startswith("word word") and w["published_at"] == datetime(2024, 3, 1)


def test_ingest_twice_changes_nothing_the_second_time(spark):
    schema = "id long, source_id long, canonical_url string, url_hash binary, title string, summary string, content_hash binary, word_count int, status string, published_at timestamp_ntz, duplicate_of_id long, extract_attempts int, version int"
    rows = [(1, 0, "https://a.example/1", "one", "s", None, T0, None, None, None), (1, 1, "https://a.example/1#again", "one b", "s2", None, T0 + timedelta(days=1), None, None, None), (2, 0, "https://a.example/2", "two", None, None, T0, None, None, None)]
    batch = ingest.fold_batch(ingest.clean_entries(spark.createDataFrame(rows, ENTRY), F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'")))
    first = ingest.upsert(spark.createDataFrame([], schema), batch, 100)
    table = spark.createDataFrame(first.collect(), first.schema)
    assert sorted((r["id"], r["title"], r["published_at"], r["status"], r["change"]) for r in table.collect())[0][0] == 100
    one = [r for r in table.collect() if r["canonical_url"].endswith("/1")][0]
    assert (one["title"], one["summary"], one["published_at"], one["version"]) == ("one b", "s2", T0, 0)
    assert {r["change"] for r in ingest.upsert(table.drop("change"), batch, 200).collect()} == {"none"}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_new_ids_are_distinct_and_no_row_is_lost(spark, tmp_path, adaptive):
    n, old = 400_000, 1000
    key = F.unhex(F.sha2(F.col("k").cast("string"), 256))
    spark.range(n + old).select(F.when(F.col("id") < old, F.col("id")).alias("id"), F.col("id").alias("k")).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for source in (spark.read.parquet(str(tmp_path / "rows")), spark.range(n + old).select(F.when(F.col("id") < old, F.col("id")).alias("id"), F.col("id").alias("k"))):
            got = ingest.number_new(source.withColumn("url_hash", key), 10_000).select("id", "k", "url_hash").cache()
            new = got.filter(f"k >= {old}")
            one = new.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("k").alias("rows"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
            assert tuple(one) == (n, n, n, 10_000, 10_000 + n - 1) and got.filter(f"k < {old} and id = k").count() == old
            ordered = new.orderBy("id").select("url_hash").limit(2000).collect()
            assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)
            got.unpersist()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_config_defaults_on_any_bad_value(spark):
    rows = [('{"maxItems": 3, "x": 1}',), ('{"maxItems": "lots", "userAgent": "u"}',), ("nonsense",), ("{}",), ("[1]",)]
    got = spark.createDataFrame(rows, "c string").select(config.decode(F.col("c")).alias("c")).collect()
    assert [r["c"]["maxItems"] for r in got] == [3, None, None, None, None] and got[1]["c"]["userAgent"] is None


def test_feed_documents():
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="s"/><link href="https://x/1"/><summary>S</summary><content type="html">&lt;p&gt;C&lt;/p&gt;</content><updated>2024-01-02T03:04:05+01:00</updated></entry></feed>"""
    (e,) = feeds.parse_feed(atom.encode())
    assert (e["link"], e["title"], e["description"], e["contents"], e["published"]) == ("https://x/1", "T", "S", ["<p>C</p>"], None) and e["updated"].hour == 2
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>é</title><pubDate>Mon, 14 Jul 2026 09:00:00 GMT</pubDate></item></channel></rss>'.encode("latin-1")
    assert feeds.parse_feed(latin)[0]["title"] == "é" and feeds.parse_feed(latin)[0]["published"].day == 14
    assert feeds.parse_date("14 Jul 2026 09:00:00 +0200").hour == 7 and feeds.parse_date("nonsense") is None


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body, status, headers = b"<rss><channel><item><title>t</title></item></channel></rss>", 200, {"ETag": 'W/"v1"'}
            if self.headers.get("If-None-Match") == 'W/"v1"':
                body, status = b"", 304
            elif self.path == "/gz":
                body, headers = gzip.compress(body), {"Content-Encoding": "gzip"}
            elif self.path == "/gone":
                status = 410
            elif self.path == "/big":
                body = b"x" * 3000
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_conditional_fetch(spark, server):
    rows = [(1, f"{server}/a", None, 5, None, None), (2, f"{server}/a", None, 5, 'W/"v1"', None), (3, f"{server}/gone", None, 5, None, None), (4, f"{server}/gz", "ua", 5, None, None), (5, "http://127.0.0.1:9/none", None, 1, None, None)]
    df = spark.createDataFrame(rows, "id long, feed_url string, user_agent string, timeout_sec int, http_etag string, http_last_modified string")
    got = {r["id"]: r for r in feeds.with_entries(feeds.fetch_feeds(df)).collect()}
    assert [got[i]["kind"] for i in range(1, 6)] == ["fetched", "not_modified", "failed", "fetched", "failed"]
    assert got[1]["etag"] == 'W/"v1"' and got[4]["entries"][0]["title"] == "t" and "410" in got[3]["error"]
    assert feeds.request(f"{server}/big", "*/*", None, 5, most=1000)["error"]
    with pytest.raises(OSError):
        feeds.fetch_page(f"{server}/gone")


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"slug":"a","name":"A","homepageUrl":"h","kind":"rss","feedUrl":"f","config":{"maxItems":3},"later":1},{"slug":"b","name":"B","homepageUrl":"h","kind":"html","config":[1]}]')
    rows = feeds.read_seeds(spark, str(tmp_path / "s.json")).collect()
    assert [(r["slug"], r["crawl_interval_sec"], r["config"]) for r in rows] == [("a", 900, '{"maxItems":3}')]


def test_xml_reader_and_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>a</title><link>l</link><pubDate>Mon, 14 Jul 2026 09:00:00 GMT</pubDate></item></channel></rss>")
    x = feeds.read_feeds_xml(spark, str(tmp_path / "f.xml"))
    assert x.select("title", feeds.native_date(F.col("pubDate")).alias("d")).first()["d"] == datetime(2026, 7, 14, 9)
    assert feeds.read_feed_files(spark, str(tmp_path / "f.xml")).first()["entries"][0]["title"] == "a"
    (tmp_path / "p.html").write_bytes("<meta charset=latin1>é".encode("latin-1"))
    assert feeds.read_page_files(spark, str(tmp_path / "p.html")).first()["html"].endswith("é")


# ---------------------------------------------------------------- search


def test_query_syntax():
    q = search.parse_query('spark "open source" -java OR été ""')
    assert q.branches == [[(["spark"], True), (["open", "source"], True), (["java"], False)], [(["été"], True)]] and q.terms() == ["open", "source", "spark", "été"]
    assert search.parse_query("::: --- \"").branches == [] and search.parse_query("été", plain=True).terms() == ["ete"]


def test_search_phrases_accents_and_snippets(spark):
    rows = [(1, "Open source news", "about open source tools", "x"), (2, "Source mind", "no", "open mind and a source ends"), (3, "Mã nguồn mở", "tiếng Việt", "nội dung")]
    d = spark.createDataFrame([(*r, "published", T0) for r in rows], "id long, title string, summary string, body string, status string, published_at timestamp_ntz")
    ids = lambda raw: [r["id"] for r in search.search(d, raw).collect()]
    assert ids('"open source"') == [1] and ids("open source")[0] == 1 and set(ids("open")) == {1, 2} and ids("open -tools") == [2] and ids("ma nguon") == [3] and ids("") == []
    assert set(ids("-open")) == {3}
    vector = {r["id"]: {(p["lexeme"], p["pos"], p["weight"]) for p in r["tsv"]} for r in search.with_vector(d).collect()}
    index = {}
    for r in search.postings(d).collect():
        index.setdefault(r["id"], set()).add((r["lexeme"], r["pos"], r["weight"]))
    assert vector == index and ("nguon", 5, "A") in vector[3]
    assert "<mark>open</mark> <mark>source</mark>" in search.search(d, "open source").first()["snippet"]


def test_cover_density_prefers_close_words():
    near = search.cover_density([("a", 1, "C"), ("b", 2, "C")], ["a", "b"])
    far = search.cover_density([("a", 1, "C"), ("b", 9, "C")], ["a", "b"])
    assert 0 < far < near < 1 and search.cover_density([("a", 1, "A")], ["a", "b"]) == 0
    assert search.cover_density([("a", 1, "A")], ["a"]) == 0.5


# ---------------------------------------------------------------- streams


def test_late_batches_win_in_the_stream(spark, tmp_path):
    schema = spark.createDataFrame([], ARTICLE).schema
    spark.createDataFrame([(2, T0 + timedelta(hours=1), "published", "h", None, None)], ARTICLE).coalesce(1).write.parquet(str(tmp_path / "in"))
    for n, rows in enumerate([[], [(1, T0, "published", "h", None, None)]]):
        if rows:
            spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q, snap = streams.run_on_snapshots(streams.read_files(spark, str(tmp_path / "in"), schema), streams.dedup_step, schema, str(tmp_path / "state"))
        q.awaitTermination()
        snap.last = n if snap.last is None else snap.last
    assert sorted((r["id"], r["duplicate_of_id"]) for r in snap.read().collect()) == [(1, None), (2, 1)]


def test_stream_join_equals_batch_pairs(spark, tmp_path):
    rows = [(r[0], r[1], r[4]) for r in random_articles(9, 60) if r[4] is not None and r[2] != "duplicate"]
    spark.createDataFrame(rows, "id long, published_at timestamp, simhash long").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    read = lambda: streams.read_files(spark, str(tmp_path / "in"), schema)
    q = streams.near_pairs_stream(read(), read()).writeStream.format("memory").queryName("near").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = [(r["loser"], r["winner"]) for r in spark.table("near").collect()]
    want = dedup.near_pairs(spark.createDataFrame([(*r, "published") for r in rows], "id long, published_at timestamp, simhash long, status string"))
    assert sorted(got) == sorted((r["loser"], r["winner"]) for r in want.collect())  # each pair once


def test_rate_limit_stream_equals_the_window(spark, tmp_path):
    rows = [(f"h{i % 2}", i, float(i // 3)) for i in range(20)]
    spark.createDataFrame(rows, "host string, id long, arrival double").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = streams.rate_limit_stream(streams.read_files(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("rate").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    want = politeness.schedule(spark.createDataFrame(rows, "host string, id long, arrival double").withColumn("gap", F.lit(3.0)))
    assert {r["id"]: r["start"] for r in spark.table("rate").collect()} == {r["id"]: r["start"] for r in want.collect()}
    assert np.isfinite([r["start"] for r in spark.table("rate").collect()]).all()


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch, tmp_path):
    from rivulet import session

    class Elsewhere:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Elsewhere)
    path = str(tmp_path / "gone")
    spark.range(3).write.parquet(session.written(spark, path))
    monkeypatch.setattr(session, "_WRITTEN", session._WRITTEN[-1:])
    session.forget_written()
    assert not (tmp_path / "gone").exists()


def test_failures_are_retried_with_jitter(spark, sf):
    j, now = registry.jobs(spark, sf), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    failures = j.filter("state = 'running'").select("id", F.lit("boom").alias("error"))
    got = queue.fail_with_backoff(j, failures, now, seed=3).join(failures.select("id"), "id").filter("state = 'pending'").select("attempt", F.expr("scheduled_at - TIMESTAMP_NTZ '2024-02-01 00:00:00'").alias("wait")).collect()
    assert len({r["wait"] for r in got}) > 10
    for r in got:
        whole = min(60 * 2 ** max(r["attempt"] - 1, 0), 3600)
        assert whole // 2 <= r["wait"].total_seconds() <= whole


def test_read_api(spark, sf):
    import json
    import urllib.request

    a, s = registry.articles(spark, sf).cache(), registry.customers(spark, sf).cache()
    httpd = feed.server(a, s)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{httpd.server_port}/api/articles"
    try:
        first = json.load(urllib.request.urlopen(f"{url}?limit=3"))
        more = json.load(urllib.request.urlopen(f"{url}?limit=3&cursor={first['nextCursor']}"))
        assert len(first["items"]) == 3 and not {i["id"] for i in first["items"]} & {i["id"] for i in more["items"]}
        assert {"sourceSlug", "publishedAt", "canonicalUrl"} <= set(first["items"][0])
        assert feed.respond(a, s, "cursor=???")[0] == 400 and feed.respond(a, s, "limit=x")[0] == 400
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"http://127.0.0.1:{httpd.server_port}/other")
    finally:
        httpd.shutdown()


def test_page_refills_when_sources_are_missing(spark, sf):
    a, s = registry.articles(spark, sf).filter("id < 400"), registry.customers(spark, sf)
    known = s.filter("id % 3 = 0")
    got = [r["id"] for r in feed.page(a, known, 20).collect()]
    want = a.filter("status = 'published'").join(known.select(F.col("id").alias("source_id")), "source_id").orderBy(F.desc("published_at"), F.desc("id")).limit(20)
    assert got == [r["id"] for r in want.collect()]


def test_related_keeps_to_model_and_published(spark):
    from rivulet.operators import vectors

    rows = [(1, "m", [1.0, 0.0]), (2, "m", [1.0, 0.1]), (3, "other", [1.0, 0.0]), (4, "m", [1.0, 0.05]), (1, "other", [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, model string, vector array<double>")
    a = spark.createDataFrame([(1, "published"), (2, "published"), (3, "published"), (4, "duplicate")], "id long, status string")
    assert [r["id"] for r in vectors.related(v, 1, articles=a, model="m").collect()] == [2]
    assert [r["id"] for r in vectors.related(v, 1, model="m").collect()] == [4, 2]
