"""The consent gate on streams: every upload gets its verdict from state that event time drives.

Sessions, uploads and clock ticks are one stream with one watermark.  Borrowers are hashed into as many buckets as there are
state partitions, and state is kept for each bucket and slot of six hours: the sessions that can still decide an upload,
and the uploads that wait.  (One state per borrower would hold a row or two and cost a Python call each.)  An upload waits until
the watermark has reached it, as an earlier session may come late until then; its borrower's latest session of the last 60
minutes decides, and without one it is refused.  Timers wake a key for its next waiting upload and once more when its slot
is over, which ends its state.  A session near the end of its slot is also sent to the next one, so a slot needs no other.

Nothing is paired in the output: one row per upload.  Rows later than the lateness behind the newest event are dropped by the
watermark, sessions and uploads alike, and counted in the query's progress.  Ticks only move the watermark, so that the last
uploads of a quiet or ending stream are answered too.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vocab import CONSENT_MINUTES
from ..operators.consent import FLAGS, VALID_MICROS, open_sessions, slot_of, with_verdict

# Functions sent to Python workers travel by value: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATENESS = "10 minutes"
SLOT_MINUTES = 360
STATE = (
    "opener array<long>, session_at array<long>, session_id array<long>, flags array<int>, "
    "sender array<long>, upload_at array<long>, upload_id array<long>, doc_type array<string>"
)
VERDICT = "upload_id long, borrower_id long, doc_type string, uploaded_micros long, session_id long, session_micros long, flags int"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as a file stream (the pattern matches one file or a growing set)."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def gate_events(uploads: DataFrame, consents: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Sessions, uploads and ticks in one shape: bucket, slot, borrower_id, at, micros, kind, id, doc_type, flags."""
    buckets = int(uploads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(FLAGS)), F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)

    def shaped(rows: DataFrame, kind: str, number, doc_type, flags, slot) -> DataFrame:
        return rows.select(
            F.pmod(F.xxhash64("borrower_id"), F.lit(buckets)).alias("bucket"), slot.alias("slot"), "borrower_id", "at",
            F.unix_micros("at").alias("micros"), F.lit(kind).alias("kind"), number.cast("long").alias("id"),
            doc_type.alias("doc_type"), flags.alias("flags"),
        )

    slot = slot_of(F.col("at"), SLOT_MINUTES)
    until = slot_of(F.col("at") + F.expr(f"INTERVAL {CONSENT_MINUTES} MINUTES"), SLOT_MINUTES)
    opened = open_sessions(consents).withColumn("at", F.col("created_at").cast("timestamp"))
    sent = uploads.withColumn("at", F.col("uploaded_at").cast("timestamp"))
    events = shaped(opened, "session", F.col("session_id"), none("string"), bits, F.explode(F.sequence(slot, until)))
    events = events.unionByName(shaped(sent, "upload", F.col("upload_id"), F.col("doc_type"), F.lit(0), slot))
    if ticks is not None:
        clock = ticks.select(F.col("at").cast("timestamp").alias("at"), none("long").alias("borrower_id"))
        events = events.unionByName(shaped(clock, "tick", none("long"), none("string"), F.lit(0), F.lit(0).cast("long")))
    return events


def decide(uploads: list[tuple], sessions: list[tuple], valid: int) -> list[tuple]:
    """Rows of VERDICT for uploads (borrower, time, id, type); sessions (borrower, time, id, flags) are sorted."""
    of: dict = {}
    for session in sessions:
        of.setdefault(session[0], []).append(session)
    out = []
    for borrower, at, upload, kind in uploads:
        own = of.get(borrower, [])
        place = bisect_right(own, at, key=lambda s: s[1])
        found = own[place - 1] if place and at - own[place - 1][1] <= valid else (None, None, None, None)
        out.append((upload, borrower, kind, at, found[2], found[1], found[3]))
    return out


def still_needed(sessions: list[tuple], reached: int, valid: int) -> list[tuple]:
    """Of sorted sessions those ahead of the watermark, and each borrower's last one behind it while it is valid."""
    last = {s[0]: s for s in sessions if s[1] <= reached and reached - s[1] <= valid}
    return [s for s in sessions if s[1] > reached or last.get(s[0]) is s]


def columns_of(rows: list[tuple]) -> list[list]:
    return [list(column) for column in zip(*rows)] if rows else [[], [], [], []]


def follower(valid: int, slot_millis: int):
    """State function of one bucket of borrowers and slot."""
    names = [c.split()[0] for c in VERDICT.split(", ")]

    def follow(key, frames, state):
        ends = (int(key[1]) + 1) * slot_millis
        watermark = state.getCurrentWatermarkMs()
        reached = watermark * 1000
        sessions, waiting = [], []
        if state.exists:
            kept = state.get
            sessions, waiting = list(zip(*kept[:4])), list(zip(*kept[4:]))
        if not state.hasTimedOut:
            for frame in frames:
                new = frame[frame["kind"] == "session"]
                sessions += zip(*(new[c].astype("int64").tolist() for c in ("borrower_id", "micros", "id", "flags")))
                new = frame[frame["kind"] == "upload"]
                waiting += zip(*(new[c].astype("int64").tolist() for c in ("borrower_id", "micros", "id")), new["doc_type"].tolist())
        sessions.sort()
        ready = decide([u for u in waiting if u[1] <= reached], sessions, valid)
        waiting = [u for u in waiting if u[1] > reached]
        sessions = still_needed(sessions, reached, valid)
        if waiting or (sessions and watermark < ends):
            state.update((*columns_of(sessions), *columns_of(waiting)))
            wake = min((u[1] // 1000 for u in waiting), default=ends)
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        elif state.exists:
            state.remove()
        if ready:
            found = pd.DataFrame(ready, columns=names)
            yield found.astype({c: "Int64" for c in names if c != "doc_type"})

    return follow


def gate(uploads: DataFrame, consents: DataFrame, ticks: DataFrame | None = None, lateness: str = LATENESS) -> DataFrame:
    """One row per upload: upload_id, borrower_id, doc_type, uploaded_at, session (or NULL), status, reason."""
    events = gate_events(uploads, consents, ticks).withWatermark("at", lateness)
    follow = follower(VALID_MICROS, SLOT_MINUTES * 60_000)
    found = events.groupBy("bucket", "slot").applyInPandasWithState(follow, VERDICT, STATE, "append", "EventTimeTimeout")
    flags = [F.getbit("flags", F.lit(i)).cast("boolean").alias(f) for i, f in enumerate(FLAGS)]
    session = F.when(
        F.col("session_id").isNotNull(), F.struct("session_id", F.timestamp_micros("session_micros").alias("created_at"), *flags)
    )
    return with_verdict(found.select(
        "upload_id", "borrower_id", "doc_type", F.timestamp_micros("uploaded_micros").alias("uploaded_at"), session.alias("session")
    ))


def clock_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks as a file stream; the folder is made if need be."""
    spark.createDataFrame([], "at timestamp").write.mode("append").parquet(folder)
    return spark.readStream.schema("at timestamp").parquet(folder)


def tick(spark: SparkSession, folder: str, at) -> None:
    """Tell the stream that event time has come to ``at``."""
    spark.createDataFrame([(at,)], "at timestamp").write.mode("append").parquet(folder)


def closing_tick(events: DataFrame, lateness: str = LATENESS):
    """A time by which every event is behind the watermark, or None without events."""
    last = F.max(F.col("at")) + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 SECOND")
    return events.agg(last.alias("at")).first().at


def verdicts(start: Callable[[], DataFrame], spark: SparkSession, ticks: str, closing) -> DataFrame:
    """Verdicts of a bounded replay: all data, then a closing tick, on one checkpoint."""
    from .runner import drain, drain_again

    first = drain(start(), "consent")
    if closing is None:
        return first.frame
    tick(spark, ticks, closing)
    return drain_again(start(), first).frame
