"""Registered queries over record stores, requests and replies, with their SQL.

An event stands for what a device's user did, or for a message of a worker.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import records, requests
from tallygrid.plans import sheets
from tallygrid.plans.catalog import _read, query
from tallygrid.sources import store

_KIND = "case when event_id % 23 = 0 then 'clear' when event_type in ('error', 'signup') then 'delete' else 'append' end"


@query(f"""
with recursive a as (select user_id as u, event_id, {_KIND} as kind, event_id % 7 as pos, row_number() over (partition by user_id order by event_id) as k from events),
s(u, k, kept) as (
    select u, 0::bigint, []::bigint[] from (select distinct u from a)
    union all
    select s.u, a.k, case a.kind when 'clear' then [] when 'append' then list_append(kept, event_id)
                     else case when pos < len(kept) then kept[:pos] || kept[pos + 2:] else kept end end
    from s join a on a.u = s.u and a.k = s.k + 1)
select u as device_id, (unnest(range(1, len(kept) + 1)) - 1)::int as place, unnest(kept) as seq from (select u, arg_max(kept, k) as kept from s group by u)""")
def replayed_store(spark, sf_dir):
    """What every device's store has after all its user did, in order: appends, deletes by position, clears."""
    kind = F.when(F.col("event_id") % 23 == 0, F.lit(records.CLEAR)).when(F.col("event_type").isin("error", "signup"), F.lit(records.DELETE)).otherwise(F.lit(records.APPEND))
    actions = _read(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 7).alias("position"))
    return records.replayed(actions)


@query(f"select id, saved, name, worksheet, size, device_id from ({sheets._SAVED})")
def stored_records(spark, sf_dir):
    """Records written to a store, then read, appended to and written to the same store, and read again."""
    saved = sheets._captures(spark, sf_dir)
    path, even = store.scratch(spark, "records"), F.col("photo.size") % 2 == 0
    for part in (saved.filter(even), saved.filter(~even)):
        answer = store.replace(store.load(spark, path, saved.schema).unionByName(part), path)
        if not answer.saved:
            raise OSError(answer.error)
    return store.load(spark, path, saved.schema).select(
        "id", F.col("savedAt").alias("saved"), F.col("studentName").alias("name"), F.col("worksheetLabel").alias("worksheet"), "photo.size", "device_id",
    )


@query("""
with q as (select event_id as key, user_id as id, ts as at from events where event_type in ('view', 'click')),
p as (select event_id as r, user_id as id, ts as at, case when event_type = 'error' then 'code ' || (event_id % 5) end as error from events where event_type in ('error', 'purchase')),
m as (select p.r, p.at as replied, p.error, max(struct_pack(at := q.at, key := q.key)) as q from p join q on q.id = p.id and q.at <= p.at group by all),
f as (select q.key, count(*) as replies, min(struct_pack(at := replied, bad := error is not null, error := error)) as f from m where epoch_us(replied) - epoch_us(q.at) <= 14400000000 group by q.key)
select q.key, q.id, case when f is null then 'unanswered' when f.bad then 'failed' when epoch_us(f.at) - epoch_us(q.at) > 1800000000 then 'late' else 'answered' end as status,
       coalesce(replies, 0) > 1 as repeated, coalesce(replies, 0) as replies, epoch_us(f.at) as replied, f.error as error
from q left join f using (key)""")
def matched_replies(spark, sf_dir):
    """Views and clicks as requests, errors and purchases as replies, half an hour as the limit and four hours as the horizon."""
    events = _read(spark, sf_dir, "events")
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp").alias("at")
    asked = events.filter(F.col("event_type").isin("view", "click")).select(F.col("event_id").alias("key"), F.col("user_id").alias("id"), at)
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("code "), (F.col("event_id") % 5).cast("string")))
    given = events.filter(F.col("event_type").isin("error", "purchase")).select(F.col("user_id").alias("id"), at, error.alias("error"))
    return requests.matched(asked, given, 1800, 4 * 3600).withColumn("replied", F.unix_micros("replied")).drop("at")
