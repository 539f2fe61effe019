"""URL filters over dated lists: entries become validity intervals, an as-of join evaluates every capture.

A list is a log of dated entries: a pattern is added or removed at a time. A pattern is a domain, which covers its
subdomains, or a host with a path prefix in whole segments. Intervals are cut into periods, and captures and intervals
meet by pattern and period, so neither a pattern with a long history nor a host with a third of all captures puts all
its combinations into one place: only the entries of the capture's own period are compared with it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 30 * 86_400  # seconds
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host without port and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """Every pattern that covers the URL: the host, its parent domains, and the host with each path prefix."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda p: p != "")
    paths = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts)), F.lit(2), F.size(parts)),
                        lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``pattern``, ``since``, ``until`` (null: still valid) from ``list``, ``pattern``, ``at``, ``added``.

    Times are epoch seconds; an interval holds its start and not its end. Of several entries of a pattern at one
    time, a removal wins. Repeated additions don't start anew. Rows with a null in any of these columns are ignored.
    """
    known = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND added IS NOT NULL")
    states = known.groupBy("list", "pattern", "at").agg(F.min("added").alias("added"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    changes = states.withColumn("before", F.lag("added", 1, False).over(order)).where("added <> before")
    return changes.withColumn("until", F.lead("at").over(order)).where("added").select(
        F.col("list"), "pattern", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """All rows and columns of ``captures`` (with ``url`` and ``fetched_at``, epoch seconds) and ``n_rules``,
    ``lists``, ``rule``, ``rule_since``: how many intervals were active, the lists they are of, and the longest
    pattern with its start (of equal patterns the list first by name).

    A null URL or time and a URL without a host match nothing: 0, no lists, null rule. Repeated rows are evaluated
    alike. Without captures there are no rows, without entries nothing matches.
    """
    asked = captures.where(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).select(
        "url", "fetched_at").distinct()
    bounds = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()  # one row
    low, high = (0, 0) if bounds[0] is None else bounds
    active = intervals(entries).where((F.col("since") <= high) & F.coalesce(F.col("until") > low, F.lit(True)))
    slot = lambda t: F.floor(t / F.lit(period))
    active = active.withColumn("slot", F.explode(F.sequence(
        slot(F.greatest(F.col("since"), F.lit(low))),
        slot(F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high))))))
    probes = asked.select("url", "fetched_at", slot(F.col("fetched_at")).alias("slot"),
                          F.explode(keys_of(F.col("url"))).alias("pattern"))
    hits = probes.join(active, ["pattern", "slot"]).where(
        (F.col("since") <= F.col("fetched_at")) & F.coalesce(F.col("fetched_at") < F.col("until"), F.lit(True)))
    best = F.min_by(F.struct("pattern", "since"), F.struct(-F.length("pattern"), "list", "pattern"))
    found = hits.groupBy(F.col("url").alias("__url"), F.col("fetched_at").alias("__at")).agg(
        F.count("*").alias("__n"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("__lists"),
        best.alias("__best"))
    joined = captures.join(found, (captures["url"] == found["__url"]) & (captures["fetched_at"] == found["__at"]), "left")
    return joined.select(*[captures[c] for c in captures.columns], F.coalesce("__n", F.lit(0)).alias("n_rules"),
                         F.coalesce("__lists", F.lit("")).alias("lists"), F.col("__best.pattern").alias("rule"),
                         F.col("__best.since").alias("rule_since"))


# The tables have neither fetch times nor lists, so the query derives both from pages by rule: a capture's time from
# its page_id, and four dated entries, alternately adding and removing, for a third of the hosts, of the parent
# domains, and of the hosts with their first path segment.
_START, _YEAR = 1_704_067_200, 31_536_000


def _code(text: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(salt))), 1, 6), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(_START) + F.pmod(F.col("page_id") * 7_919, F.lit(_YEAR))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    keys = pages.select(host_of(F.col("url")).alias("host"), keys_of(F.col("url")).alias("keys")).where("keys IS NOT NULL")
    first = F.get(F.filter("keys", lambda k: F.contains(k, F.lit("/"))), 0)
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    patterns = keys.select(F.explode(F.array("host", parent, first)).alias("pattern")).where(
        "pattern IS NOT NULL").distinct().where(_code(F.col("pattern"), "") % 3 == 0)
    return patterns.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        F.when(_code(F.col("pattern"), "list") % 2 == 0, "ads").otherwise("abuse").alias("list"), "pattern",
        (F.lit(_START) + _code(F.concat("pattern", F.col("k").cast("string")), "at") % 365 * 86_400).alias("at"),
        (F.col("k") % 2 == 0).alias("added"))


def verdicts(pages: DataFrame) -> DataFrame:
    return evaluate(captures_of(pages), entries_of(pages))


ORACLE_SQL = r"""
WITH cap AS (
  SELECT page_id, url, 1704067200 + page_id * 7919 % 31536000 AS fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
    [p FOR p IN string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/') IF p <> ''] AS parts
  FROM pages
), keyed AS (
  SELECT page_id, url, fetched_at, host, parts, string_split(host, '.') AS labels FROM cap WHERE host <> ''
), probes AS (
  SELECT DISTINCT page_id, url, fetched_at, pattern FROM (
    SELECT page_id, url, fetched_at, unnest(list_concat(
      [array_to_string(labels[i:], '.') FOR i IN range(1, len(labels) + 1)],
      [host || '/' || array_to_string(parts[:i], '/') FOR i IN range(1, len(parts) + 1)])) AS pattern FROM keyed)
), patterns AS (
  SELECT DISTINCT pattern FROM (
    SELECT unnest([host, regexp_replace(host, '^[^.]*\.', ''), CASE WHEN len(parts) > 0 THEN host || '/' || parts[1] END]) AS pattern
    FROM keyed)
  WHERE pattern IS NOT NULL AND ('0x' || substr(md5(pattern), 1, 6))::BIGINT % 3 = 0
), entries AS (
  SELECT CASE WHEN ('0x' || substr(md5(pattern || 'list'), 1, 6))::BIGINT % 2 = 0 THEN 'ads' ELSE 'abuse' END AS list, pattern,
    1704067200 + ('0x' || substr(md5(pattern || k || 'at'), 1, 6))::BIGINT % 365 * 86400 AS ts, k % 2 = 0 AS added
  FROM patterns, range(4) r(k)
), states AS (SELECT list, pattern, ts, bool_and(added) AS added FROM entries GROUP BY list, pattern, ts),
changes AS (
  SELECT *, lead(ts) OVER (PARTITION BY list, pattern ORDER BY ts) AS until FROM (
    SELECT *, lag(added, 1, false) OVER (PARTITION BY list, pattern ORDER BY ts) AS before FROM states) WHERE added <> before
), hits AS (
  SELECT p.page_id, c.list, c.pattern, c.ts AS since FROM probes p JOIN changes c ON p.pattern = c.pattern AND c.added
    AND c.ts <= p.fetched_at AND (c.until IS NULL OR p.fetched_at < c.until)
), found AS (
  SELECT page_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
    first(pattern ORDER BY length(pattern) DESC, list, pattern) AS rule, first(since ORDER BY length(pattern) DESC, list, pattern) AS since
  FROM hits GROUP BY page_id
)
SELECT c.page_id, c.url, c.fetched_at, coalesce(f.n, 0) AS n_rules, coalesce(f.lists, '') AS lists, f.rule, f.since AS rule_since
FROM cap c LEFT JOIN found f ON c.page_id = f.page_id
"""
