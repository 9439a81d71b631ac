"""URL filters: a temporal join of captures with dated list entries.

Entries of one pattern, in order of date, become validity intervals: each holds
from its day until the next entry's. A capture is looked up under every suffix
of its host and every path prefix, and an as-of join finds the entries active
on the day it was fetched; the longest pattern decides.

DataFrame functions only. Intervals are cut at the months that captures have and
joined on (pattern key, month) with the day as a range condition: entries are
dated by day, so at most 32 intervals meet a capture in a month, however long a
pattern's history. A pattern's key is a digest chained over its path segments,
so a url of many segments gives as many short keys and never copies of itself.
Lookups are made once per distinct url and day, and both joins exchange their
sides for themselves, so adaptive execution can split a host or url that holds
a third of all captures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import free_names, spread_join, table

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url):
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def patterns_of(url):
    """Candidate patterns of a url: its host, the host's suffixes of two labels
    or more, and the host with each prefix of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(segments)), lambda i: i > 0),
                           lambda i: F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(suffixes, prefixes)))


def _chained(host, segments):
    """Keys of ``host`` and of host/prefix for each path prefix: digests chained
    over the segments, so that a key is as short for a long path as for none."""
    return F.aggregate(segments, F.array(F.md5(host.cast("binary"))), lambda keys, s: F.concat(
        keys, F.array(F.md5(F.concat(F.element_at(keys, -1), F.lit("/"), s).cast("binary")))))


def keys_of(url):
    """Keys of a url's candidate patterns (``patterns_of``)."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                           lambda i: F.md5(F.array_join(F.slice(labels, i, F.size(labels)), ".").cast("binary")))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    paths = _chained(host, segments)
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(suffixes, F.slice(paths, 2, F.size(paths)))))


def key_of_pattern(pattern):
    """The key that a url matched by ``pattern`` has among its own; a pattern with
    empty path segments matches no url."""
    parts = F.split(pattern, "/")
    key = F.element_at(_chained(parts[0], F.slice(parts, 2, F.size(parts))), -1)
    return F.when(~F.exists(F.slice(parts, 2, F.size(parts)), lambda s: s == ""), key)


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, listed_on, until): the interval of each entry, ``until``
    exclusive, null while open. Entries of one pattern and day count once, allow
    before block before clear; rows with a null in any column are no entry."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ("clear", "block", "allow")]), F.col("action"))
    days = (entries.select("pattern", "action", F.col("listed_on").cast("date").alias("listed_on")).dropna()
            .filter(rank > 0).groupBy("pattern", "listed_on").agg(F.max_by("action", rank).alias("action")))
    return days.withColumn("until", F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on")))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with host, blocked, pattern, action and listed_on of the
    deciding entry (null where none is active).

    ``entries``: pattern (host suffix, or host/path prefix), action (block,
    allow, or clear: no longer listed) and listed_on. A null or malformed url has
    no host and a null day no active entry: such rows pass unblocked. Repeated
    captures each get the decision. With empty captures or entries nothing is
    blocked. A very long url has one short key a path prefix. Of active entries
    the one with the longest pattern decides, then the greater pattern. Any day of
    the calendar will do; an interval is cut at the months that captures have.
    Other columns pass through; ones named like a result column are replaced.
    """
    new = ["host", "blocked", "pattern", "action", "listed_on"]
    passed = [c for c in captures.columns if c not in new]
    url, day, u, best = free_names(captures, "__url", "__day", "__u", "__best")
    rows = captures.drop(*[c for c in new if c not in (url_col, day_col)]).withColumns(
        {url: F.col(url_col), day: F.col(day_col).cast("date")}).withColumn(u, F.md5(F.col(url).cast("binary")))
    month = lambda d: F.trunc(d, "month")
    # the captures' months: the calendar bounds them
    seen = rows.select(month(day).cast("string").alias("m")).dropna().distinct().orderBy("m")
    months = F.split(F.lit(",".join(r.m for r in seen.collect())), ",")
    held = validity(entries).filter(F.col("action") != "clear").withColumn("m", F.explode(F.filter(
        F.transform(months, lambda m: m.try_cast("date")),
        lambda m: (m >= month(F.col("listed_on"))) & (F.col("until").isNull() | (m < F.col("until"))))))
    active = held.withColumn("key", key_of_pattern(F.col("pattern"))).filter(F.col("key").isNotNull())
    asked = (rows.select(url, u, F.col(day).alias("day")).dropna().groupBy(u, "day").agg(F.first(url).alias("x"))
             .select(F.col(u).alias("u"), "day", month("day").alias("m"), F.explode(keys_of(F.col("x"))).alias("key")))
    hits = spread_join(asked, active, ["key", "m"]).filter(
        (F.col("listed_on") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    found = hits.groupBy(F.col("u").alias(u), F.col("day").alias(day)).agg(F.max(F.struct(
        F.length("pattern").alias("n"), "pattern", "action", "listed_on")).alias(best))
    out = spread_join(rows, found, [u, day], "left")
    return out.select(*[F.col(f"`{c}`") for c in passed], host_of(F.col(url)).alias("host"),
                      F.coalesce(F.col(f"{best}.action") == "block", F.lit(False)).alias("blocked"),
                      *[F.col(f"{best}.{c}").alias(c) for c in ("pattern", "action", "listed_on")])


def _number(text):
    """24 bits of the md5, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """List entries derived from the pages' own patterns: a third of all hosts,
    host suffixes and path prefixes get up to four dated entries."""
    n = F.col("n")
    found = pages.select(F.explode(patterns_of(F.col("url"))).alias("pattern")).distinct()
    events = (found.withColumn("n", _number(F.col("pattern"))).filter(n % 3 == 0)
              .withColumn("k", F.explode(F.sequence(F.lit(0), n % 4))))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("clear")), (F.floor(n / 12) + F.col("k")).cast("int") % 3 + 1)
    day = F.date_add(F.lit("2023-11-01").cast("date"), (F.floor(n / 36).cast("int") + 97 * F.col("k")) % 500)
    return events.select("pattern", action.alias("action"), day.alias("listed_on"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the derived list; a page counts as fetched on a day of
    2024 given by its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return filter_urls(captures, dated_list(pages))


_HOST_SQL = f"regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.+$', '')"
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, url, {_HOST_SQL} AS host, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on,
         list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
q AS (
  SELECT page_id, url, host, fetched_on, CASE WHEN coalesce(host, '') = '' THEN [] ELSE list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                   lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(list_slice(segs, 1, i), '/')))) END AS pats
  FROM p),
l AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS INTEGER) AS n
  FROM (SELECT DISTINCT unnest(pats) AS pattern FROM q)),
e AS (
  SELECT pattern, (['block', 'allow', 'clear'])[(n // 12 + k) % 3 + 1] AS action,
         CAST(DATE '2023-11-01' + CAST((n // 36 + 97 * k) % 500 AS INTEGER) AS DATE) AS listed_on
  FROM (SELECT pattern, n, unnest(range(0, n % 4 + 1)) AS k FROM l WHERE n % 3 = 0)),
d AS (
  SELECT pattern, listed_on, arg_max(action, list_position(['clear', 'block', 'allow'], action)) AS action
  FROM e GROUP BY pattern, listed_on),
v AS (
  SELECT *, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS until FROM d),
h AS (
  SELECT c.page_id, v.pattern, v.action, v.listed_on,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC, v.pattern DESC) AS r
  FROM (SELECT page_id, fetched_on, unnest(pats) AS pattern FROM q) c JOIN v
    ON v.pattern = c.pattern AND v.listed_on <= c.fetched_on AND (v.until IS NULL OR c.fetched_on < v.until)
  WHERE v.action <> 'clear')
SELECT q.page_id, q.url, q.fetched_on, q.host, coalesce(h.action = 'block', false) AS blocked,
       h.pattern, h.action, h.listed_on
FROM q LEFT JOIN h ON h.page_id = q.page_id AND h.r = 1
"""
