"""Queries over event streams, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parolumi.session import scratch_dir
from parolumi.sources import tables as T
from parolumi.streaming import sessions as S

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _named(sessions):
    return sessions.select("user_id", F.date_format("start", _TIME).alias("started"), F.date_format("end", _TIME).alias("ended"), "events", "value")


def stream_sessions(spark, d):
    """Sessions of the users' events, read as a stream of files to its end; then one row
    with a time behind all data ends the stream, so that open sessions are closed, too."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a pattern, since a stream takes a plain path for a folder
    events = spark.readStream.schema(T.table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    ended = S.with_end(events, f"{base}/end")
    sessions = _named(S.sessions(ended, "user_id"))
    S.drain(sessions, f"{base}/out", f"{base}/state")
    S.end_of_stream(events, f"{base}/end", "user_id", "ts", -1)
    S.drain(sessions, f"{base}/out", f"{base}/state")
    return spark.read.schema(sessions.schema).parquet(f"{base}/out")


def user_sessions(spark, d):
    return _named(S.sessions(T.table(spark, d, "events"), "user_id"))


def event_windows(spark, d):
    """Events by windows of ten minutes."""
    w = S.tumbling(T.table(spark, d, "events"), width="10 minutes")
    return w.select(F.date_format("start", _TIME).alias("started"), "n")


def confidence_by_event(spark, d):
    """Mean and rate of doubtful values by type of event."""
    e = T.table(spark, d, "events").where("value is not null")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.exp(-F.col("value") / 100)), 6).alias("mean_conf"), F.round(F.avg((F.col("value") > 30).cast("int")), 6).alias("low_rate"))


QUERIES = {f.__name__: f for f in (stream_sessions, user_sessions, event_windows, confidence_by_event)}

_SESSIONS = """with e as (select user_id, ts, value, lag(ts) over (partition by user_id order by ts) as p from events where user_id is not null and ts is not null), s as (select *, sum(case when p is null or ts >= p + interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as g from e)
 select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as started, strftime(max(ts) + interval 30 minutes, '%Y-%m-%d %H:%M:%S.%f') as ended, count(*)::BIGINT as events, round(sum(value), 4) as value from s group by user_id, g"""

ORACLES = {
    "user_sessions": _SESSIONS,
    "stream_sessions": _SESSIONS,
    "event_windows": "select strftime(time_bucket(interval 10 minutes, ts), '%Y-%m-%d %H:%M:%S.%f') as started, count(*)::BIGINT as n from events where ts is not null group by 1",
    "confidence_by_event": "select event_type, count(*)::BIGINT as n, round(avg(exp(-value / 100)), 6) as mean_conf, round(avg((value > 30)::INT), 6) as low_rate from events where value is not null group by 1",
}
