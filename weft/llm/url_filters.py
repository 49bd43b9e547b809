"""URL filters: a temporal join of captures with dated list entries, in DataFrame operations alone.

List events (list, kind, key, action add or remove, at) become validity intervals: the last event of an entry
at or before a moment says whether it is active then. A capture is judged by the entries that were active when it
was fetched. Kinds: domain (the host and all hosts below), host (this host), prefix (host and leading path segments; without a path, the host).
Keys are normalized as captures are.

Scale: the lists meet distinct hosts, not captures; a capture is joined only if its host (or a prefix of its URL) is listed at all, by host
and salt, so one popular host is spread over SALTS tasks per key and AQE splits the rest. Results
meet their captures in one aggregation whose keys are the captures. Only id, url and time are read.

Nulls and repeats: a null or unreadable url matches nothing; a capture without a time is judged by no entry; a null page_id is
carried. Captures that repeat id, url and time are one row with their number in n_captures. Events
of one entry at one time: remove wins; repeated events count once; events with a null in list, key or time are void.
An empty list blocks nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm._shared import only, salts

SALTS = 16
KINDS = ("domain", "host", "prefix")


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit(""))


def entry_key(kind: Column, key: Column) -> Column:
    """A list key as captures are normalized: host in lower case without user, port and final dot; a prefix's path without empty segments."""
    found = F.regexp_extract(F.lower(key), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    site = F.regexp_replace(found, r"\.$", "")
    parts = F.filter(F.split(F.regexp_extract(key, r"^[^/]*(.*)$", 1), "/", -1), lambda p: p != "")
    return F.when(kind == "prefix", F.concat_ws("/", F.concat(F.array(site), parts))).otherwise(site)


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, key (normalized), active_from, active_to (null: still active)."""
    sound = events.where(F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove"))
    sound = sound.withColumn("key", entry_key(F.col("kind"), F.col("key")))
    last = sound.groupBy("list", "kind", "key", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "kind", "key").orderBy("at")
    before = F.lag("action").over(order)
    turns = last.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("action")))
    return turns.withColumn("active_to", F.lead("at").over(order)).where("action = 'add'").select("list", "kind", "key", F.col("at").alias("active_from"), "active_to")


def _levels(host_: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host_, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _prefixes(host_: Column, path_: Column) -> Column:
    """host, host/first, host/first/second and so on."""
    parts = F.filter(F.split(path_, "/", -1), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat_ws("/", F.concat(F.array(host_), F.slice(parts, F.lit(1), i))))


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, n_captures, n_entries, lists (sorted), blocked. captures: page_id, url, fetched_at."""
    entries = intervals(events)
    seen = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "fetched_at")
    sited = seen.withColumn("host", host(F.col("url")))
    active = (F.col("active_from") <= F.col("fetched_at")) & (F.col("active_to").isNull() | (F.col("fetched_at") < F.col("active_to")))
    salt = F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS))
    spread = lambda df: df.withColumn("salt", salts(SALTS))
    found = ["page_id", "url", "fetched_at", "list", "kind", "key"]

    hosts = sited.where("host <> ''").select("host").distinct()
    keys = hosts.select("host", F.explode(_levels(F.col("host"))).alias("key")).withColumn("kind", F.explode(F.when(F.col("key") == F.col("host"), F.array(F.lit("domain"), F.lit("host"))).otherwise(F.array(F.lit("domain")))))
    listed = keys.join(entries, ["kind", "key"])
    by_host = sited.where("host <> ''").withColumn("salt", salt).join(spread(listed), ["host", "salt"]).where(active).select(*found)

    rules = entries.where("kind = 'prefix'")
    sites = spread(rules.select(F.substring_index("key", "/", 1).alias("host")).distinct())
    narrow = sited.where("host <> ''").withColumn("salt", salt).join(sites, ["host", "salt"], "left_semi")
    by_prefix = narrow.withColumn("key", F.explode(_prefixes(F.col("host"), path(F.col("url"))))).join(spread(rules), ["key", "salt"]).where(active).select(*found)

    none = [F.lit(None).cast("string").alias(c) for c in ("list", "kind", "key")]
    rows = seen.select("page_id", "url", "fetched_at", *none, F.lit(1).alias("own")).unionByName(by_host.union(by_prefix).distinct().withColumn("own", F.lit(0)))
    out = rows.groupBy("page_id", "url", "fetched_at").agg(F.sum("own").cast("long").alias("n_captures"), F.count("list").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    return out.withColumn("blocked", F.col("n_entries") > 0)


def _digit(k: int) -> Column:
    """The k-th hex digit of a host's MD5."""
    return F.expr(f"instr('0123456789abcdef', substr(md5(host), {k}, 1)) - 1")


def list_events(pages: DataFrame) -> DataFrame:
    """The dated lists of the registered query, by a rule over the hosts of the pages (days after 2024-01-01)."""
    hosts = pages.select(host(F.col("url")).alias("host")).where("host <> ''").distinct()
    top, key = F.substring_index("host", ".", -2), F.col("host")
    a, day = _digit(1), (_digit(2) * 16 + _digit(3))
    rules = [
        ("malware", "host", key, "add", day, a < 6),
        ("malware", "host", key, "remove", day + 60, a < 4),
        ("malware", "host", key, "add", day + 120, a < 2),
        ("ads", "domain", top, "add", _digit(4) * 8, a == 7),
        ("ads", "domain", top, "remove", _digit(4) * 8 + 100, a == 8),
        ("spam", "prefix", F.concat(key, F.lit("/en")), "add", _digit(5) * 20, a >= 9),
        ("spam", "prefix", F.concat(key, F.lit("/en")), "remove", _digit(5) * 20 + 150, a >= 12),
    ]
    cells = [F.when(on, F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), k.alias("key"), F.lit(action).alias("action"), at.cast("int").alias("at"))) for name, kind, k, action, at, on in rules]
    return hosts.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.*")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, fetched on day page_id % 366: what lists it stood on then."""
    pages = only(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
    captures = pages.withColumn("fetched_at", F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return judge(captures, list_events(pages))


OP2_SQL = r"""
WITH c AS (SELECT page_id, url, (page_id % 366)::INTEGER AS fetched_at, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '') AS host,
  regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT host, string_split(host, '.') AS l, list_transform([1, 2, 3, 4, 5], lambda k: instr('0123456789abcdef', md5(host)[k]) - 1) AS x FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
e AS (
  SELECT 'malware' AS list, 'host' AS kind, host AS key, 'add' AS action, x[2] * 16 + x[3] AS day FROM h WHERE x[1] < 6
  UNION ALL SELECT 'malware', 'host', host, 'remove', x[2] * 16 + x[3] + 60 FROM h WHERE x[1] < 4
  UNION ALL SELECT 'malware', 'host', host, 'add', x[2] * 16 + x[3] + 120 FROM h WHERE x[1] < 2
  UNION ALL SELECT 'ads', 'domain', array_to_string(l[-2:], '.'), 'add', x[4] * 8 FROM h WHERE x[1] = 7
  UNION ALL SELECT 'ads', 'domain', array_to_string(l[-2:], '.'), 'remove', x[4] * 8 + 100 FROM h WHERE x[1] = 8
  UNION ALL SELECT 'spam', 'prefix', host || '/en', 'add', x[5] * 20 FROM h WHERE x[1] >= 9
  UNION ALL SELECT 'spam', 'prefix', host || '/en', 'remove', x[5] * 20 + 150 FROM h WHERE x[1] >= 12),
t AS (SELECT list, kind, key, day, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, key ORDER BY day) AS until FROM t),
m AS (
  SELECT DISTINCT c.page_id, c.url, c.fetched_at, i.list, i.kind, i.key FROM c JOIN i ON i.action = 'add' AND i.day <= c.fetched_at AND (i.until IS NULL OR c.fetched_at < i.until) AND c.host <> ''
    AND CASE i.kind WHEN 'host' THEN c.host = i.key WHEN 'domain' THEN c.host = i.key OR ends_with(c.host, '.' || i.key) ELSE starts_with(c.host || c.path || '/', i.key || '/') END),
g AS (SELECT page_id, url, fetched_at, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched_at, count(*)::BIGINT AS n_captures, coalesce(any_value(n_entries), 0)::BIGINT AS n_entries, coalesce(any_value(lists), '') AS lists, coalesce(any_value(n_entries), 0) > 0 AS blocked
FROM c LEFT JOIN g ON g.page_id IS NOT DISTINCT FROM c.page_id AND g.url IS NOT DISTINCT FROM c.url GROUP BY ALL
"""
