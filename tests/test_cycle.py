"""The crawl cycle against a local server: polite, conditional, resumable, and idempotent."""

import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from rivulet.operators import queue
from rivulet.streaming import cycle, jobs

T0 = datetime(2024, 3, 1)
PROSE = "".join(f"<p>Sentence {i} of a body, with commas, and words enough to be taken for prose by anybody.</p>" for i in range(12))
ITEM = "<item><title>T{n}</title><link>{base}/a{n}</link><description>d{n}</description></item>"


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            base = f"http://{self.headers['Host']}"
            body, status, headers = b"", 200, {}
            if self.path == "/robots.txt":
                body = b"User-agent: *\nDisallow: /closed\n"
            elif self.path == "/feed":
                headers = {"ETag": '"1"'}
                if self.headers.get("If-None-Match") == '"1"':
                    status = 304
                else:
                    items = "".join(ITEM.format(n=n, base=base) for n in range(3)) + ITEM.format(n="closed", base=base).replace("/aclosed", "/closed/a")
                    body = f"<rss><channel>{items}</channel></rss>".encode()
            elif self.path.startswith("/a"):
                body = f"<html><body><article>{PROSE if self.path != '/a2' else '<p>short</p>'}</article></body></html>".encode()
            else:
                status = 500
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
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_cycle_from_feed_to_duplicates(spark, tmp_path, server):
    base, seen = server
    t = cycle.Tables(spark, str(tmp_path / "state"))
    rows = [(1, "good", f"{base}/feed", True, T0, None, 0, 900, "{}", None, None), (2, "closed", f"{base}/closed/feed", True, T0, None, 0, 900, "{}", None, None), (3, "broken", f"{base}/broken", True, T0, None, 0, 900, '{"maxItems":1}', None, None), (4, "off", f"{base}/feed", False, T0, None, 0, 900, "{}", None, None)]
    t["sources"] = spark.createDataFrame(rows, cycle.SOURCE)
    c = cycle.Cycle(t, gap=0.0)
    assert c.enqueue(T0) == 3 and c.enqueue(T0) == 0  # one live job for each source
    assert c.work(T0) == 3
    state = {r["source_id"]: r for r in t["jobs"].collect()}
    assert [state[k]["state"] for k in (1, 2, 3)] == ["succeeded", "succeeded", "pending"] and state[3]["scheduled_at"] > T0
    s = {r["id"]: r for r in t["sources"].collect()}
    assert s[1]["http_etag"] == '"1"' and s[1]["next_crawl_at"] == T0 + timedelta(seconds=900)
    assert s[2]["consecutive_failures"] == 0 and s[2]["next_crawl_at"] == T0 + timedelta(hours=24) and s[3]["consecutive_failures"] == 1
    log = {r["source_id"]: r for r in t["log"].collect()}
    assert (log[1]["items_found"], log[1]["items_new"], log[1]["http_status"]) == (4, 4, 200) and log[2]["error"] == "blocked by robots.txt" and "500" in log[3]["error"]
    assert "/closed/feed" not in seen and seen.count("/robots.txt") == 1
    articles = {r["title"]: r for r in t["articles"].collect()}
    assert len(articles) == 4 and len({r["id"] for r in articles.values()}) == 4 and {r["updated_at"] for r in articles.values()} == {T0}

    later = T0 + timedelta(seconds=901)
    assert c.enqueue(later) == 2  # the feed that is due again, and its pages
    assert c.work(later) >= 1
    assert {r["http_status"] for r in t["log"].filter("source_id = 1").collect()} == {200, 304}
    assert {r["updated_at"] for r in t["articles"].collect()} == {T0}  # nothing changed
    assert c.extract(later) == {"extracted": 2, "blocked": 1, "failed": 1}
    got = {r["title"]: r for r in t["articles"].collect()}
    assert got["T0"]["word_count"] > 100 and got["T0"]["content_hash"] == got["T1"]["content_hash"] and got["T2"]["content_hash"] is None
    assert {r["extract_attempts"] for r in got.values()} == {1} and "/closed/a" not in seen
    assert {r["extractor"] for r in t["content"].collect()} == {cycle.EXTRACTOR} and t["content"].count() == 2

    assert c.dedup(later) == {"fingerprinted": 2, "demoted": 1, "repointed": 0}
    got = {r["title"]: r for r in t["articles"].collect()}
    assert sorted(r["status"] for r in got.values()) == ["duplicate", "published", "published", "published"] and got["T0"]["simhash"] == got["T1"]["simhash"]
    assert c.dedup(later) == {"fingerprinted": 0, "demoted": 0, "repointed": 0}

    # a worker that dies leaves its lease; the reaper takes the job back
    t["jobs"] = queue.claim(t["jobs"].withColumn("scheduled_at", F.lit(T0).cast("timestamp_ntz")), "dead", queue.FEED, F.lit(later).cast("timestamp_ntz"))
    assert c.reap(later) == 0 and c.reap(later + timedelta(seconds=301)) == t["jobs"].filter("last_error is not null and state = 'pending'").count() > 0


def test_steps_run_after_their_own_delays():
    now, slept = [0.0], []

    class Fake:
        def __getattr__(self, step):
            def run(at):
                now[0] += 5
                if step == "dedup":
                    raise RuntimeError("broken")
                return at.timestamp()

            return run

    def sleep(s):
        slept.append(s)
        now[0] += s

    done = cycle.run(Fake(), jobs.EVERY, rounds=12, clock=lambda: now[0], sleep=sleep)
    assert [s for s, _ in done[:5]] == list(jobs.EVERY) and isinstance(dict(done)["dedup"], RuntimeError)
    work = [told for s, told in done if s == "work"]
    assert all(b - a >= jobs.EVERY["work"] for a, b in zip(work, work[1:], strict=False)) and sum(s == "work" for s, _ in done) > sum(s == "extract" for s, _ in done)
