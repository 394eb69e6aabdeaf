"""URL filters by a temporal list join (built-in functions only).

A list is a history: dated entries that block or allow a pattern, or retract it.
Each entry holds from its date until the pattern's next entry in the same list,
so the history becomes validity intervals. A capture is judged against the
entries that are active at its fetch time: among them a URL entry beats a host
entry, a host beats a domain, a longer domain beats a shorter one, then the later
entry wins, then ``block``.

Captures outnumber hosts by far, so patterns first meet the distinct hosts and
URLs; what a host meets becomes one timeline of (from, to, verdict), and a capture
finds its place in it by an as-of join: one match, nothing to aggregate again.

Defined results: a null or hostless URL, and a null fetch time, match nothing and
are kept; entries without pattern or date are ignored, repeated ones count once;
each capture row gives one row; an empty list keeps everything; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import HOT_SHARE, copied, deal, hot_parts, join_spread, settle

#: The lists of the registered query: (list, kind, pattern, action, date).
DEFAULT_ENTRIES = [
    ("gambling", "domain", "casino-win.example.com", "block", "2024-01-10"),
    ("gambling", "domain", "casino-win.example.com", "retract", "2024-05-01"),
    ("gambling", "domain", "casino-win.example.com", "block", "2024-08-15"),
    ("gambling", "domain", "free-bets.example.com", "block", "2024-03-01"),
    ("pharma", "domain", "cheap-pills.example.com", "block", "2023-06-01"),
    ("pharma", "host", "www.cheap-pills.example.com", "allow", "2024-09-01"),
    ("pharma", "host", "www.cheap-pills.example.com", "retract", "2024-10-01"),
    ("trackers", "domain", "ads-track.example.com", "block", "2024-02-01"),
    ("trackers", "host", "m.ads-track.example.com", "allow", "2024-06-01"),
    ("trackers", "url", "m.ads-track.example.com/en/9823", "block", "2024-07-01"),
    ("policy", "domain", "example.org", "block", "2024-11-01"),
    ("policy", "domain", "example.org", "retract", "2024-11-15"),
]
#: Up to so many intervals or stretches of timelines (under 200 bytes each) are broadcast.
BROADCAST_ROWS = 20_000
#: Kinds by precedence, the weakest first.
KINDS = ("domain", "host", "url")


def entries_frame(spark: SparkSession, entries: list[tuple] | None = None) -> DataFrame:
    rows = spark.createDataFrame(DEFAULT_ENTRIES if entries is None else entries, "list string, kind string, pattern string, action string, day string")
    return rows.withColumn("since", F.to_timestamp("day")).drop("day")


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_of(url: Column) -> Column:
    """Host and path, without scheme, query, fragment and closing slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, action, list, since, until) of the entries that say something; ``until`` may be null."""
    dated = entries.filter(F.col("pattern").isNotNull() & F.col("since").isNotNull() & F.col("kind").isin(*KINDS))
    dated = dated.select("list", "kind", F.lower("pattern").alias("pattern"), "action", "since").distinct()
    # of entries for one moment the last by name holds: a retraction beats a block, a block an allowance
    one = dated.groupBy("list", "kind", "pattern", "since").agg(F.max("action").alias("action"))
    history = Window.partitionBy("list", "kind", "pattern").orderBy("since")
    return one.withColumn("until", F.lead("since").over(history)).filter(F.col("action").isin("block", "allow"))


def timelines(keys: DataFrame, active: DataFrame) -> DataFrame:
    """(key, begins, ends, list, action): for each key of (key, pattern, rank), the winner of each stretch of time."""
    entry = F.concat_ws(" ", "kind", "pattern").alias("entry")
    asked, listed = keys.select("key", "rank", entry), active.select(entry, "action", "list", "since", "until")
    if active.count() <= BROADCAST_ROWS:
        met = asked.join(F.broadcast(listed), "entry")
    else:
        # very many hosts share a pattern such as a top-level domain
        met = join_spread(settle(asked, "url-asked"), listed, "entry", "key")
    met = settle(met.drop("entry"), "url-met")
    points = met.select("key", F.col("since").alias("begins")).unionByName(met.filter(F.col("until").isNotNull()).select("key", F.col("until").alias("begins"))).distinct()
    stretch = points.withColumn("ends", F.lead("begins").over(Window.partitionBy("key").orderBy("begins")))
    over = stretch.join(met.withColumnRenamed("key", "m_key"), (F.col("key") == F.col("m_key")) & (F.col("since") <= F.col("begins")) & (F.col("until").isNull() | (F.col("until") > F.col("begins"))))
    best = over.groupBy("key", "begins", "ends").agg(F.max(F.struct("rank", "since", "action", "list")).alias("best"))
    return best.select("key", "begins", "ends", F.col("best.rank").alias("rank"), F.col("best.since").alias("since"), F.col("best.list").alias("list"), F.col("best.action").alias("action"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id, url, fetched, host, list, action, kept) for every capture; the first column keeps the name ``id_col``."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("fetched"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("page", page_of(F.col("url")))
    active = settle(intervals(entries), "url-intervals")

    hosts = rows.select(F.col("host").alias("key")).filter(F.col("key").isNotNull()).distinct()
    labels = F.split("key", r"\.")
    suffixes = hosts.select("key", F.posexplode(F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("drop", "pattern"), F.size(labels).alias("n"))
    domains = suffixes.select("key", "pattern", F.lit("domain").alias("kind"), (F.col("n") - F.col("drop")).alias("rank"))
    exact = hosts.select("key", F.col("key").alias("pattern"), F.lit("host").alias("kind"), F.lit(1000).alias("rank"))
    by_host = timelines(domains.unionByName(exact), active)
    # a URL entry stands above all host entries: its timeline holds URL entries only
    urls = active.filter(F.col("kind") == "url").select(F.col("pattern").alias("key"), "pattern", "kind", F.lit(2000).alias("rank")).distinct()
    by_url = timelines(urls, active)

    def asof(left: DataFrame, key: str, line: DataFrame, name: str) -> DataFrame:
        there = settle(line.select(*[F.col(c).alias(f"{name}_{c}") for c in line.columns]), f"url-{name}")
        begun = F.col("fetched") >= F.col(f"{name}_begins")
        during = begun & (F.col(f"{name}_ends").isNull() | (F.col("fetched") < F.col(f"{name}_ends")))
        match = (F.col(key) == F.col(f"{name}_key")) & during
        if there.count() <= BROADCAST_ROWS:
            return left.join(F.broadcast(there), match, "left")
        # captures of hot hosts are dealt out and their timelines copied; those without a host meet nothing
        hot = F.broadcast(hot_parts(left.filter(F.col(key).isNotNull()), key).withColumnRenamed(key, "hot"))
        marked = left.join(hot, F.col(key) == F.col("hot"), "left").drop("hot")
        marked = marked.withColumn("parts", F.when(F.col(key).isNull(), HOT_SHARE).otherwise(F.col("parts")))
        lines = copied(there.join(hot, F.col(f"{name}_key") == F.col("hot"), "left").drop("hot")).withColumnRenamed("part", "copy")
        return deal(marked, "id", "url", "fetched").join(lines, match & (F.col("part") == F.col("copy")), "left").drop("part", "copy")

    found = asof(asof(rows, "page", by_url, "u"), "host", by_host, "h")
    action = F.coalesce("u_action", "h_action")
    return found.select(F.col("id").alias(id_col), F.col("url").alias("url"), "fetched", "host", F.coalesce("u_list", "h_list").alias("list"), action.alias("action"), F.coalesce(action != "block", F.lit(True)).alias("kept"))


def stand_in_time(page_id: Column) -> Column:
    """The pages table has no fetch time: hour ``37 * page_id`` of 2024, around the year."""
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(page_id * 37, F.lit(8784)) * 3600)


_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', timestamp '{e}')" for a, b, c, d, e in DEFAULT_ENTRIES)
ORACLE = rf"""
with e(list, kind, pattern, action, since) as (values {_VALUES}),
i as (select *, lead(since) over (partition by list, kind, pattern order by since) as until from e),
a as (select * from i where action in ('block', 'allow')),
p as (select page_id, url, timestamp '2024-01-01' + to_hours((((page_id * 37) % 8784 + 8784) % 8784)::bigint) as fetched,
             nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') as host,
             regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path from pages),
m as (select page_id, max_by(a.action, (case kind when 'url' then 2000 when 'host' then 1000 else len(string_split(pattern, '.')) end, since, a.action, a.list)) as action,
             max_by(a.list, (case kind when 'url' then 2000 when 'host' then 1000 else len(string_split(pattern, '.')) end, since, a.action, a.list)) as list
      from p join a on fetched >= since and (until is null or fetched < until)
       and (kind = 'url' and pattern = host || path or kind = 'host' and pattern = host or kind = 'domain' and (host = pattern or ends_with(host, '.' || pattern)))
      group by page_id)
select page_id, url, fetched, host, list, action, coalesce(action <> 'block', true) as kept from p left join m using (page_id)
"""
