"""Scalar functions: URLs, texts, fingerprints, HTML."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rivulet.functions import html, simhash, text, urls

URLS = [
    ("https://Example.COM/Path", "https://example.com/Path"),
    ("HTTP://example.com:80/a", "http://example.com/a"),
    ("https://example.com:443/a", "https://example.com/a"),
    ("https://example.com:8443/a", "https://example.com:8443/a"),
    ("https://example.com/a/", "https://example.com/a"),
    ("https://example.com/a///", "https://example.com/a"),
    ("https://example.com/", "https://example.com/"),
    ("https://example.com", "https://example.com"),
    ("https://example.com/a#frag", "https://example.com/a"),
    ("https://example.com/a?utm_source=x&UTM_Medium=y&id=3", "https://example.com/a?id=3"),
    ("https://example.com/a?b=2&a=1&b=1", "https://example.com/a?a=1&b=2&b=1"),
    ("https://example.com/a?fbclid=1", "https://example.com/a"),
    ("https://example.com/a?ref=x&page=2", "https://example.com/a?page=2&ref=x"),
    ("https://example.com/a?B=1&a=2", "https://example.com/a?B=1&a=2"),
    ("https://user:pw@example.com/a", "https://example.com/a"),
    ("https://example.com/a%20b?q=%C3%A9", "https://example.com/a%20b?q=%C3%A9"),
    ("https://www.example.com/a", "https://www.example.com/a"),
    ("  https://example.com/a\t", "https://example.com/a"),
    ("not a url", "not a url"),
    ("/relative/path?utm_source=x", "/relative/path?utm_source=x"),
    ("mailto:a@b.cd", "mailto:a@b.cd"),
    ("", ""),
]


def test_canonicalize_and_its_idempotence(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "i int, u string")
    once = df.withColumn("c", urls.canonicalize(F.col("u")))
    got = {r["i"]: (r["c"], r["d"]) for r in once.withColumn("d", urls.canonicalize(F.col("c"))).collect()}
    for i, (u, want) in enumerate(URLS):
        assert got[i] == (want, want), u


def test_canonicalize_is_native(spark):
    plan = spark.createDataFrame([("x",)], "u string").select(urls.canonicalize(F.col("u")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_hosts_and_robots_paths(spark):
    df = spark.createDataFrame([("https://A.example:8080/x?y=1",), ("https://a.example",), ("::",), (None,)], "u string")
    got = df.select(urls.host_of(F.col("u")).alias("h"), urls.origin_of(F.col("u")).alias("o"), urls.robots_path(F.col("u")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("a.example", "https://a.example", "/x?y=1"), ("a.example", "https://a.example", "/"), (None, None, None), (None, None, None)]


def test_plain_normal_form_hash_and_counts(spark):
    rows = [("  a​ b\n\nc d ",), (None,), ("x " * 300,), ("y" * 499,), ("y" * 500,)]
    n = text.normalize_plain(F.col("t"))
    got = spark.createDataFrame(rows, "t string").select(n.alias("n"), text.word_count(n).alias("w"), text.content_hash(n).alias("h")).collect()
    assert [(r["n"][:9], r["w"], r["h"] is None) for r in got] == [("a b c d", 4, True), ("", 0, True), ("x x x x x", 300, False), ("y" * 9, 1, True), ("y" * 9, 1, False)]


def test_unaccent_summaries_and_trigrams(spark):
    df = spark.createDataFrame([("Đường phố Hà Nội, été",)], "t string")
    assert df.select(text.unaccent(F.col("t"))).first()[0] == "Duong pho Ha Noi, ete"
    s = spark.createDataFrame([("a" * 280,), ("b" * 270 + " " * 9 + "c" * 20,), ("  ",)], "t string").select(text.summarize(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in s] == ["a" * 280, "b" * 270 + "…", None]
    g = spark.createDataFrame([("Cat cat",)], "t string").select(text.trigrams(F.col("t"))).first()[0]
    assert set(g) == {"  c", " ca", "cat", "at "}


def test_time_ago(spark):
    rows = [("2024-01-01 00:00:00", w) for w in ()]
    cases = [(20, "just now"), (40, "1m ago"), (59 * 60, "59m ago"), (90 * 60, "2h ago"), (23 * 3600, "23h ago"), (36 * 3600, "2d ago")]
    df = spark.createDataFrame(rows + [(s,) for s, _ in cases], "s int")
    now = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    got = df.select(text.time_ago(now - F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")), now).alias("a")).collect()
    assert [r["a"] for r in got] == [a for _, a in cases]


# ---------------------------------------------------------------- fingerprints


def plain_simhash(t):
    if t is None or len(t) < 500:
        return None
    words, cur = [], ""
    for c in t.lower():
        if c in simhash.SEPARATORS:
            words, cur = [*words, cur] if cur else words, ""
        else:
            cur += c
    words = [*words, cur] if cur else words
    if len(words) < 10:
        return None
    mask, weight = 2**64 - 1, {}
    for i in range(len(words) - 2):
        h = simhash.FNV_START
        for w in words[i : i + 3]:
            raw = (w + " ").encode("utf-16-le")
            for k in range(0, len(raw), 2):
                h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * simhash.FNV_PRIME) & mask
        for shift, factor in simhash.MIX:
            h ^= h >> shift
            h = h * factor & mask if factor else h
        weight[h] = weight.get(h, 0) + 1
    if len(weight) < 8:
        return None
    out = 0
    for b in range(64):
        if sum(n if h >> b & 1 else -n for h, n in weight.items()) > 0:
            out |= 1 << b
    return out - 2**64 if out >= 2**63 else out


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["mã", "nguồn", "mở", "cộng", "đồng", "lập", "trình", "việt", "data", "spark", "𝒳y", "window"]) + rng.choice(["", "", ",", ".", " –"]) for _ in range(n))


def test_fingerprint_equals_the_plain_version():
    texts = [prose(s, n) for s, n in ((1, 120), (2, 400), (3, 1000))] + ["a b " * 200, "x" * 600, "short", "", None, "one two three four five six seven eight nine " * 20]
    for t in texts:
        assert simhash.fingerprint(t) == plain_simhash(t)


def test_fingerprint_is_near_for_small_edits_and_far_for_others():
    d = lambda a, b: ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) & (2**64 - 1)).bit_count()
    a = prose(5, 3000)
    assert d(a, a + " one sentence more at the end of it") <= 3 and d(a, a.upper()) == 0
    assert d(a, prose(6, 3000)) > 5


def test_simhash_column(spark):
    df = spark.createDataFrame([(1, prose(1, 300)), (2, None), (3, "short")], "id int, norm string")
    assert {r["id"]: r["simhash"] for r in simhash.with_simhash(df).collect()} == {1: plain_simhash(prose(1, 300)), 2: None, 3: None}


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""),
        ("  ", ""),
        ("plain  text", "plain text"),
        ("<p>one<p>two", "one two"),
        ("<b>bo</b>ld &amp; <i>it</i>", "bold & it"),
        ("a<br>b", "a b"),
        ("<script>var x='</p>';</script>seen<style>p{}</style>", "seen"),
        ("x​y﻿ z&nbsp;w", "xy z w"),
        ("<ul><li>a<li>b</ul>c", "a b c"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<div>a</div><div>b</div>", "a b"),
        ("<<<>>>", "<<<>>>"),
        ("mã&#7879;t", "mãệt"),
    ],
)
def test_html_text(raw, want):
    assert html.normalize(raw) == want


PROSE = "<p>" + "</p><p>".join(f"This is paragraph {i}, with several commas, some thought, and enough words to count as prose." for i in range(6)) + "</p>"


def test_extract_takes_the_prose_and_leaves_the_chrome():
    page = f"<html><body class='no-sidebar'><nav><a href='/'>Home</a></nav><div class='sidebar'><p>Other stories, links, and more of the kind you know</p></div><div id='main'>{PROSE}</div><footer>About us</footer></body></html>"
    got = html.extract(page)
    assert got[2] == "readability" and got[0].startswith("This is paragraph 0") and "Home" not in got[0] and "Other stories" not in got[0] and got[3] == 0.0


def test_extract_keeps_a_large_block_with_a_junk_name():
    page = f"<html><body><div class='sidebar-1'><article>{PROSE}</article></div><div class='newsletter'>Subscribe</div></body></html>"
    assert html.extract(page)[0].startswith("This is paragraph 0")


def test_extract_refuses_link_lists_and_short_pages():
    links = "<html><body><ul>" + "".join(f"<li><div><a href='/{i}'>A headline that is long enough to count, number {i}</a></div></li>" for i in range(40)) + "</ul></body></html>"
    assert html.extract(links) is None
    assert html.extract("<html><body><p>Checking your browser before you go on, please wait</p></body></html>") is None
    assert html.extract("") is None and html.extract(None) is None and html.extract("\x00<<<") is None


def test_extract_takes_linear_time_on_large_pages():
    """A deep page, unclosed junk and stray end tags; eight times the size takes about eight times as long."""
    shapes = ("<div><p>some words of prose here, that are long enough to count ", "</i><b>x<p class=menu>", "<div><a>t</a></span>")
    for shape in shapes:
        took = []
        for mb in (1, 8):
            began = time.time()
            html.extract(shape * (mb * 2**20 // len(shape)))
            took.append(time.time() - began)
        assert took[0] < 10 and took[1] < 16 * max(took[0], 0.5), (shape, took)


def test_a_candidate_that_is_a_link_is_all_link():
    inside = " ".join(f"<p>Words of number {i}, long enough to count as prose in a page of its own.</p>" for i in range(9))
    assert html.extract(f"<html><body><a href='/x'>{inside}</a></body></html>") is None


def test_extract_falls_back_to_the_article_element():
    body = "no paragraph here but a long run of text without any block inside " * 10
    assert html.extract(f"<html><body><article>{body}</article></body></html>")[2] == "semantic-fallback"


def test_decode_by_mark_and_meta():
    assert html.decode("﻿é".encode()) == "é" and html.decode("é".encode("utf-16")) == "é"
    assert html.decode(b"<meta charset='windows-1252'>\xe9") == "<meta charset='windows-1252'>é"
    assert html.decode("<meta charset=nonsense>é".encode()) == "<meta charset=nonsense>é"


def test_html_columns(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html.with_extract(html.with_text(pages), "html").select("text_plain", "extracted").collect()
    assert all(r["text_plain"] for r in got) and sum(r["extracted"] is not None for r in got) > 25
    assert all(r["extracted"]["text"] in r["text_plain"] or len(r["extracted"]["text"]) <= len(r["text_plain"]) for r in got if r["extracted"])


def test_registered_names(spark):
    from rivulet.functions import register

    register(spark)
    assert spark.sql("SELECT html_text('<b>a</b>') AS t, body_simhash('x') AS s").first().asDict() == {"t": "a", "s": None}
