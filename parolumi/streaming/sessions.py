"""Event streams: sessions, commits and their errors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str = "ts", width: str = "0.5 seconds", late: str = "1 minute") -> DataFrame:
    """Events counted in windows of fixed width; batch or stream."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key's events with gaps below ``gap``; as a stream, a session comes
    out once the watermark has passed its end. Rows with a null key or time are left out."""
    kept = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    out = kept.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", F.round("value", 4).alias("value"))


def commits(events: DataFrame) -> DataFrame:
    """Committed, non-empty texts of a realtime event log."""
    return events.where((F.col("message_type") == "committed_transcript") & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def errors(events: DataFrame) -> DataFrame:
    """The error side channel of the same log, for a sink of its own."""
    return events.where((F.col("message_type") == "error") | (F.coalesce("error", F.lit("")) != ""))


SEGMENT_SCHEMA = "stream string, segment bigint, start_s double, end_s double, text string, n_words int"


def stream_segments(tokens: DataFrame, gap: float = 0.8, idle: str = "10 minutes") -> DataFrame:
    """The segmentation of ``operators.segmenting`` on a stream of tokens (stream, ts, pos,
    text, start_s, end_s, speaker), exact: the state of a stream is its open segment. A
    segment comes out when the next one begins, the last one when the stream has been
    silent for ``idle`` of event time. Tokens of one micro-batch are put in order of pos."""
    stops = ("։", "?", "!", ".", "…")

    def text_of(words: list[str]) -> str:
        import re

        return re.sub(r"\s+([։?!.,…])", r"\1", " ".join(words)).strip()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, number = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []

        def close() -> None:
            nonlocal open_, number
            out.append((key[0], number, open_[0]["s"], open_[-1]["e"], text_of([w["t"] for w in open_]), len(open_)))
            open_, number = [], number + 1

        if state.hasTimedOut:
            if open_:
                close()
            state.remove()
        else:
            for w in pd.concat(list(frames)).sort_values("pos").itertuples():
                clean = lambda x: None if x is None or x != x else x
                now = {"t": w.text, "s": clean(w.start_s), "e": clean(w.end_s), "k": clean(w.speaker)}
                if open_:
                    before = open_[-1]
                    silence = now["s"] - before["e"] if now["s"] is not None and before["e"] is not None else 0.0
                    if before["t"].endswith(stops) or before["k"] != now["k"] or round(silence, 6) >= gap:
                        close()
                open_.append(now)
            state.update((json.dumps(open_, ensure_ascii=False), number))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + pd.Timedelta(idle).value // 1_000_000)
        yield pd.DataFrame(out, columns=["stream", "segment", "start_s", "end_s", "text", "n_words"])

    return (
        tokens.withWatermark("ts", "0 seconds")
        .groupBy("stream")
        .applyInPandasWithState(step, SEGMENT_SCHEMA, "open string, number bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )


#: A time behind all data, to which the end of a stream moves the watermark.
END_OF_TIME = "9000-01-01 00:00:00"


def with_end(stream: DataFrame, folder: str) -> DataFrame:
    """``stream`` and, behind it, the rows of files that come to ``folder``, which is made."""
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def end_of_stream(stream: DataFrame, folder: str, key: str, time: str, name: object) -> None:
    """Writes the row that ends ``stream`` (see ``with_end``): key ``name``, which no data have,
    and a time behind all data, so that the watermark closes whatever is still open."""
    spark = stream.sparkSession
    kinds = dict(stream.dtypes)
    cols = [F.lit(name).cast(t).alias(c) if c == key else F.lit(END_OF_TIME).cast(t).alias(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    spark.range(1).select(*cols).coalesce(1).write.mode("append").parquet(folder)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
