"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

A list holds (key, day, action) events. A key is a domain (``example.com``: that host and all under it) or a
domain with a path (``example.com/ads``: that path and all under it, at ``/``). Hosts are compared in lower case,
paths as they are written; action is ``add`` or ``remove``. An entry is active from
an ``add`` to the key's next event; events of one key and day count as one, an ``add`` if any is. A capture
is blocked if any key that it falls under is active on the day of its fetch; the longest such key is named,
of equally long ones the first.

Captures are reduced to distinct (url, day), each gives its keys (suffixes of its host, prefixes of its
path), and these meet the intervals of the same key and ``SPAN`` of days: an equality join with a range
condition instead of a search through a key's history in one task. A list counted small is broadcast; with
a larger one Spark splits a host that holds much of the captures.

Null or hostless urls and captures without a day are never blocked; events with a null key, day or action,
or an unknown action, are ignored. Repeated captures give repeated rows. Empty captures or an empty list
give an empty or unblocked result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small

#: Days of a bucket of the join.
SPAN = 64

LIST_SCHEMA = "key string, day date, action string"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Host and its suffixes, then the host's and the suffixes' paths."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    every = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(F.length(host_of(url)) > 0, every)


def key_of(entry: Column) -> Column:
    """A list entry as a key: its host in lower case, its path as written, without a slash at the end."""
    host = F.substring_index(entry, "/", 1)
    return F.rtrim(F.concat(F.lower(host), F.substring(entry, F.length(host) + 1, F.length(entry))), F.lit("/"))


def intervals(events: DataFrame) -> DataFrame:
    """(key, since, until) of the days on which each key is active; ``until`` is exclusive, null: still active."""
    e = events.select(key_of(F.col("key")).alias("key"), F.col("day").cast("date").alias("day"), "action")
    e = e.filter(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    e = e.groupBy("key", "day").agg(F.max(F.col("action") == "add").alias("on"))
    return e.select("key", F.col("day").alias("since"), "on", F.lead("day").over(Window.partitionBy("key").orderBy("day")).alias("until")).filter("on").drop("on")


def url_filter(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """One row per capture: id, day, host, whether it is blocked, and by which entry, active since when."""
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(day_col).cast("date").alias("_day"))
    seen = rows.select("_url", "_day").distinct()
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / SPAN)
    last = rows.agg(F.max("_day")).first()[0]
    asked = seen.select("_url", "_day", bucket(F.col("_day")).alias("_b"), F.explode(keys_of(F.col("_url"))).alias("_key"))
    valid = intervals(events).withColumn("_to", F.coalesce(F.date_sub("until", 1), F.greatest(F.lit(last).cast("date"), F.col("since"))))
    valid = cut(valid.select("key", "since", "until", F.explode(F.sequence(bucket(F.col("since")), bucket(F.col("_to")))).alias("_vb")))
    hits = asked.join(small(valid), (F.col("_key") == F.col("key")) & (F.col("_b") == F.col("_vb")) & (F.col("_day") >= F.col("since")) & (F.col("_day") < F.coalesce("until", F.date_add("_day", 1))))
    best = hits.groupBy("_url", "_day").agg(F.min(F.struct((-F.length("key")).alias("n"), "key", "since")).alias("_hit"))
    best = cut(best.select(F.col("_url").alias("_u"), F.col("_day").alias("_d"), "_hit"))
    out = rows.join(best, (F.col("_url") == F.col("_u")) & (F.col("_day") == F.col("_d")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_day").alias("fetched"), host_of(F.col("_url")).alias("host"), F.col("_hit").isNotNull().alias("blocked"), F.col("_hit.key").alias("entry"), F.col("_hit.since").alias("active_since"))


# The dated list of the query.
EVENTS = [
    ("casino-win.example.com", "2024-01-15", "add"),
    ("casino-win.example.com", "2024-04-01", "remove"),
    ("casino-win.example.com", "2024-09-01", "add"),
    ("cheap-pills.example.com", "2024-02-10", "add"),
    ("free-bets.example.com", "2024-03-05", "add"),
    ("free-bets.example.com", "2024-11-20", "remove"),
    ("example.org", "2024-06-01", "add"),
    ("example.org", "2024-06-15", "remove"),
    ("example.net/de", "2024-05-01", "add"),
    ("example.net/de", "2024-08-01", "remove"),
    ("m.casino-win.example.com", "2024-03-01", "add"),
    ("M.Ththth.Example.net/en", "2024-02-01", "add"),
    ("example.com/EN", "2024-01-01", "add"),
    ("example.com/Fr/", "2024-01-01", "add"),
]


def fetched_day(page_id: Column) -> Column:
    """The query's fetch day: the table has none, so the id names a day of 2024."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(366)).cast("int"))


def derived_events(pages: DataFrame) -> DataFrame:
    """A dated list as long as the table has hosts and first folders: two thirds of them are listed on a day of 2024, half of these go later.

    The day and what happens follow from the smallest id of a host's (or folder's) pages.
    """
    host, folder = host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), r"^(/[^/]+)/", 1)
    keys = pages.select("page_id", F.explode(F.array(host, F.when(folder != "", F.concat(host, folder)))).alias("key")).filter("key <> ''")
    keys = keys.groupBy("key").agg(F.min("page_id").alias("m")).filter("m % 3 < 2")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    added = F.col("m") * 7 % 300
    event = lambda d, action: F.struct(d.alias("day"), F.lit(action).alias("action"))
    gone = F.when(F.col("m") % 2 == 0, event(day(added + 20 + F.col("m") % 45), "remove"))
    return keys.select("key", F.explode(F.filter(F.array(event(day(added), "add"), gone), lambda e: e.isNotNull())).alias("e")).select("key", "e.day", "e.action")


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"
ORACLE = f"""
WITH fixed(entry, day, action) AS (VALUES {", ".join(f"('{k}', DATE '{d}', '{a}')" for k, d, a in EVENTS)}),
hosts AS (SELECT page_id, rtrim({_HOST}, '.') AS host, regexp_extract({_PATH}, '^(/[^/]+)/', 1) AS folder FROM pages),
listed AS (SELECT key, min(page_id) AS m FROM (SELECT page_id, host AS key FROM hosts UNION ALL SELECT page_id, host || folder FROM hosts WHERE folder <> '') WHERE key <> '' GROUP BY key HAVING min(page_id) % 3 < 2),
given AS (SELECT * FROM fixed UNION ALL SELECT key, (DATE '2024-01-01' + (m * 7 % 300)::INTEGER)::DATE, 'add' FROM listed UNION ALL SELECT key, (DATE '2024-01-01' + (m * 7 % 300 + 20 + m % 45)::INTEGER)::DATE, 'remove' FROM listed WHERE m % 2 = 0),
e AS (SELECT rtrim(lower(split_part(entry, '/', 1)) || substr(entry, length(split_part(entry, '/', 1)) + 1), '/') AS key, day, action FROM given),
p AS (SELECT page_id, (DATE '2024-01-01' + (page_id % 366)::INTEGER)::DATE AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
    row_number() OVER () AS r FROM pages),
k AS (SELECT DISTINCT p.r, e.key, p.fetched FROM p, e WHERE CASE WHEN contains(e.key, '/') THEN
      (host = split_part(e.key, '/', 1) OR host LIKE '%.' || split_part(e.key, '/', 1)) AND (path || '/') LIKE substr(e.key, strpos(e.key, '/')) || '/%'
      ELSE host = e.key OR host LIKE '%.' || e.key END),
l AS (SELECT k.r, k.key, e.day, e.action FROM k JOIN e ON e.key = k.key AND e.day <= k.fetched QUALIFY row_number() OVER (PARTITION BY k.r, k.key ORDER BY e.day DESC, e.action) = 1),
b AS (SELECT r, key, day FROM l WHERE action = 'add' QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(key) DESC, key) = 1)
SELECT page_id, fetched, host, b.r IS NOT NULL AS blocked, b.key AS entry, b.day AS active_since FROM p LEFT JOIN b USING (r)
"""
