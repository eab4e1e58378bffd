"""Queries of the streams: the events as a stream in order of time, run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vacantia.sources.scratch import scratch_dir
from vacantia.sources.tables import table
from vacantia.sources.time_ranges import time_range_stream, write_ranges
from vacantia.sources.versioned import VersionedTable
from vacantia.streaming import streams


#: Seconds of a range of the feed, and ranges a batch at least.
RANGE_SECONDS, RANGES = 5 * 86_400, 1


def _feed(s, d, close=False):
    """A stream of the events of a data directory in order of ranges of their time. ``close`` adds a
    row a day after the last event, in a range of its own: the watermark then passes every window and
    session of events, and that row's own is never complete."""
    base = f"{scratch_dir(s)}/stream-{uuid.uuid4().hex}"
    rows = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    write_ranges(rows, "ts", f"{base}/in", RANGE_SECONDS)
    if close:
        # a range's length later, so no event shares its range
        last = rows.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(max(RANGE_SECONDS, 86_400)))).alias("ts")).where("ts IS NOT NULL")
        last = last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        write_ranges(last, "ts", f"{base}/in", RANGE_SECONDS)
    return time_range_stream(s, f"{base}/in", rows.schema, f"{base}/checkpoint", RANGES), base


def _run(s, stream, base):
    streams.run_to_table(stream, f"{base}/out", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out")


def _texts(df, *times):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in times})


def _upserted(s, d):
    """Latest event of each user: repeats of an event id are dropped, then users are upserted."""
    stream, base = _feed(s, d)
    target = VersionedTable(s, f"{base}/target")
    first = streams.first_of_id(stream, "event_id", "ts", "1 day")
    streams.drain(streams.stream_upsert(first, target, ["user_id"], "ts", f"{base}/checkpoint"))
    return target.read().select("user_id", "event_id", "event_type", "value")


def _health(s, d):
    stream, base = _feed(s, d, close=True)
    return _texts(_run(s, streams.stream_health(stream, "ts", "event_type", F.col("value") > 100, "1 hour", "10 minutes"), base), "start")


def _sessions(s, d):
    stream, base = _feed(s, d, close=True)
    return _texts(_run(s, streams.stream_sessions(stream, "ts", "user_id", "30 minutes", "10 minutes"), base), "start", "end")


QUERIES = {
    "t01_stream_upsert": (_upserted, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1"),
    "t02_stream_health": (
        _health,
        "SELECT *, CASE WHEN failed / n >= 0.5 THEN 'critical' WHEN failed / n >= 0.2 THEN 'warning' ELSE 'ok' END AS level FROM "
        "(SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, count(*) FILTER (value > 100) AS failed FROM events GROUP BY ALL)",
    ),
    "t03_stream_sessions": (
        _sessions,
        "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS end, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM "
        "(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, nth",
    ),
}
