"""Robots rules and the gap between requests to one host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import origin_of, robots_path

MAX_CHARS = 500 * 1024
SUCCESS_TTL, FAILURE_TTL, MIN_RECHECK = 24 * 3600, 30 * 60, 60
DEFAULT_GAP = 3.0
RULES = "struct<allows:array<string>,disallows:array<string>,crawl_delay:double,matched_agent:string>"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_robots(files: DataFrame, agent: str) -> DataFrame:
    """key, rules of files (key, body; each once): the rules of robots files for one agent, as RFC 9309 groups them.

    A group is one or more consecutive user-agent lines and the rules up to the next such line; rules before any agent are
    nobody's. All groups that name the agent count together, else all groups of `*`, else everything is allowed. Empty
    values say nothing; of several delays the last one counts. Each file is numbered, grouped and gathered by itself.
    """
    lines = files.select("key", F.posexplode(F.split(F.left("body", F.lit(MAX_CHARS)), r"\r\n|\r|\n")).alias("at", "line"))
    cut = F.split(F.regexp_replace("line", "#.*$", ""), ":", 2)
    pairs = lines.select("key", "at", F.lower(_stripped(cut[0])).alias("field"), _stripped(F.get(cut, F.lit(1))).alias("value")).filter("value is not null and field <> ''")
    # one shuffle: all windows and the gathering are by file
    file = Window.partitionBy("key")
    names = F.col("field") == "user-agent"
    before = F.lag(names, 1, False).over(file.orderBy("at"))
    grouped = pairs.withColumn("first", (names & ~before).cast("int")).withColumn("group", F.sum("first").over(file.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    called = F.when(names, F.when(F.lower("value") == agent.lower(), 0).when(F.col("value") == "*", 1))
    ranked = grouped.withColumn("called", called).withColumn("best", F.min("called").over(file))
    ours = ranked.withColumn("ours", F.max(F.coalesce(F.col("called") == F.col("best"), F.lit(False))).over(Window.partitionBy("key", "group")))
    rule = lambda field: F.transform(F.array_sort(F.collect_list(F.when(F.col("ours") & (F.col("field") == field) & (F.col("value") != ""), F.struct("at", "value")))), lambda r: r["value"])
    delay = F.max(F.when(F.col("ours") & (F.col("field") == "crawl-delay"), F.struct("at", "value")))["value"]
    seconds = F.when(delay.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), delay.cast("double"))
    name = F.when(F.min("best") == 0, F.lit(agent.lower())).when(F.min("best") == 1, F.lit("*"))
    rules = F.struct(rule("allow").alias("allows"), rule("disallow").alias("disallows"), seconds.alias("crawl_delay"), name.alias("matched_agent"))
    return ours.groupBy("key").agg(rules.alias("rules"))


def with_rules(robots: DataFrame, agent: str) -> DataFrame:
    """robots (origin, http_status, body, fetched_at) with rules, and expires_at.

    2xx: the rules of the file. 4xx: everything is allowed. Other answers, or none: nothing is, for half an hour. Files
    with the same text, as many hosts have, are read once.
    """
    ok, open_ = F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), F.coalesce(F.col("http_status").between(400, 499), F.lit(False))
    keyed = robots.withColumn("_key", F.when(ok, F.sha2("body", 256)))  # lines and joins carry the hash, not the file
    files = parse_robots(keyed.filter("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first("body").alias("body")), agent)
    free = F.from_json(F.lit('{"allows":[],"disallows":[]}'), RULES)
    closed = F.from_json(F.lit('{"allows":[],"disallows":["/"]}'), RULES)
    ttl = F.when(ok | open_, SUCCESS_TTL).otherwise(FAILURE_TTL)
    known = keyed.join(files.select(F.col("key").alias("_key"), F.col("rules").cast(RULES).alias("_rules")), "_key", "left").drop("_key")
    chosen = F.when(ok, F.coalesce("_rules", free)).when(open_, free).otherwise(closed)
    return known.withColumn("rules", chosen).drop("_rules").withColumn("expires_at", F.col("fetched_at") + F.make_dt_interval(secs=ttl.cast("decimal(18,6)")))


def matches(pattern: Column, path: Column) -> Column:
    """Whether a robots pattern matches a path: a prefix, * for anything, $ at the end for the end.

    The stretches between the stars are looked for one after another, each at its first place behind the one before; that
    finds a match if there is any, in one walk along the path.
    """
    anchored = pattern.endswith("$")
    parts = F.split(F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern), r"\*")
    head, n = parts[0], F.size(parts)
    tail = F.element_at(parts, -1)
    between = F.slice(parts, 2, F.greatest(F.when(anchored, n - 2).otherwise(n - 1), F.lit(0)))

    def behind(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, path, at)
        return F.when((at == 0) | (part == ""), at).when(found == 0, 0).otherwise(found + F.length(part))

    reached = F.aggregate(between, F.when(path.startswith(head), F.length(head) + 1).otherwise(0), behind)
    ends = path.endswith(tail) & (F.length(path) - F.length(tail) + 1 >= reached)
    return F.when(anchored & (n == 1), path == head).otherwise((reached > 0) & (~anchored | ends))


def longest_match(patterns: Column, path: Column) -> Column:
    """The length of the longest pattern that matches, or -1."""
    hit = F.filter(patterns, lambda p: (p != "") & matches(p, path))
    return F.coalesce(F.array_max(F.transform(hit, lambda p: F.length(p))), F.lit(-1))


def is_allowed(rules: Column, path: Column) -> Column:
    """The longest matching rule decides, and allow wins a tie."""
    return longest_match(rules["allows"], path) >= longest_match(rules["disallows"], path)


def decide(urls: DataFrame, rules: DataFrame, url: str = "url", gap: float = DEFAULT_GAP) -> DataFrame:
    """urls with allowed, gap_seconds. rules: origin, rules. No rules or no origin: not allowed."""
    r = rules.select(F.col("origin").alias("_origin"), F.col("rules").alias("_rules"))
    joined = urls.withColumn("_o", origin_of(F.col(url))).join(r, F.col("_o") == F.col("_origin"), "left")
    path = robots_path(F.col(url))
    allowed = F.col("_rules").isNotNull() & path.isNotNull() & is_allowed(F.col("_rules"), path)
    return joined.withColumn("allowed", allowed).withColumn("gap_seconds", F.greatest(F.lit(gap), F.coalesce(F.col("_rules")["crawl_delay"], F.lit(gap)))).drop("_o", "_origin", "_rules")


def recheck_seconds(expires_at: Column, now: Column) -> Column:
    """What is left of the rules' time, at least a minute; half an hour if there are none."""
    left = F.floor((F.unix_micros(expires_at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000)
    return F.when(expires_at.isNull(), FAILURE_TTL).otherwise(F.greatest(left, F.lit(MIN_RECHECK))).cast("long")


def schedule(requests: DataFrame, host: str = "host", arrival: str = "arrival", gap: str = "gap", tie: str = "id") -> DataFrame:
    """requests with start: each waits for the one before it to the same host, start_i = max(arrival_i, start_(i-1) + gap_(i-1)).

    Closed form: with S_i the gaps of the requests before, start_i = S_i + running max of (arrival - S).
    """
    order = Window.partitionBy(host).orderBy(arrival, tie)
    before = F.coalesce(F.sum(gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = requests.withColumn("_s", before)
    return shifted.withColumn("start", F.max(F.col(arrival) - F.col("_s")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s")).drop("_s")
