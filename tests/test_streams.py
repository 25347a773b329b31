"""The consent gate over several micro-batches, with rows out of order and rows too late, against the batch gate."""

import datetime as dt
import random

import pytest

from creditloom.operators.consent import match_uploads
from creditloom.sources.files import fresh_dir
from creditloom.streaming import consent_stream as CS, runner

START = dt.datetime(2024, 3, 1, 5, 0, tzinfo=dt.timezone.utc)
SESSION = "session_id long, borrower_id long, created_at timestamp, consent_bank boolean, consent_salary boolean, consent_utility boolean, consent_dpdpa boolean"
UPLOAD = "upload_id long, borrower_id long, uploaded_at timestamp, doc_type string"
ROW = ["upload_id", "borrower_id", "doc_type", "session.session_id", "status", "reason"]


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


class Feed:
    """Two file streams that grow batch by batch, and one checkpoint."""

    def __init__(self, spark):
        self.spark = spark
        self.folders = {k: fresh_dir(spark, k) for k in ("uploads", "sessions", "clock")}
        self.sink = None
        for name, schema in (("uploads", UPLOAD), ("sessions", SESSION)):
            spark.createDataFrame([], schema).write.parquet(self.folders[name])

    def stream(self):
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(self.folders[name])
        return CS.gate(read("uploads", UPLOAD), read("sessions", SESSION), CS.clock_folder(self.spark, self.folders["clock"]))

    def batch(self, uploads=(), sessions=(), tick=None):
        for name, schema, rows in (("uploads", UPLOAD, uploads), ("sessions", SESSION, sessions)):
            if rows:
                self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(self.folders[name])
        if tick:
            CS.tick(self.spark, self.folders["clock"], tick)
        self.sink = runner.drain_again(self.stream(), self.sink) if self.sink else runner.drain(self.stream(), "gate")
        return {r.upload_id: r for r in self.sink.frame.select(*ROW).collect()}


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def session(number, borrower, minutes, salary=True, bank=True):
    return (number, borrower, at(minutes), bank, salary, False, True)


def test_verdicts_come_when_time_has_passed(spark):
    feed = Feed(spark)
    got = feed.batch([(1, 7, at(10), "bank"), (2, 8, at(10), "bank")], [session(50, 7, 5), session(52, 9, 30)])
    assert got[1].session_id == 50 and got[2].status == 401  # the newest event is at 30, the watermark at 20
    # on time though out of order: a session at 22 for an upload at 25 that came before it
    got = feed.batch([(3, 9, at(25), "salary")], [session(53, 9, 22, salary=False)])
    assert set(got) == {1, 2}
    # too late (the watermark is at 20): neither the session nor the upload counts
    got = feed.batch([(4, 8, at(12), "bank")], [session(54, 9, 19)])
    assert set(got) == {1, 2}
    got = feed.batch(tick=at(40))
    assert got[3].session_id == 53 and got[3].reason == "Salary consent required"
    # 60 minutes are the limit, to the second; a session whose bank consent is missing is none
    got = feed.batch([(5, 9, at(90), "bank"), (6, 9, at(90.02), "bank"), (7, 7, at(91), "bank")], [session(55, 7, 90.5, bank=False)])
    got = feed.batch(tick=at(120))
    assert got[5].session_id == 52 and got[6].status == got[7].status == 401 and set(got) == {1, 2, 3, 5, 6, 7}


def test_random_batches_equal_the_batch_gate(spark):
    """A third of all rows belong to one borrower; rows of a batch come up to nine minutes out of order."""
    rng = random.Random(5)
    borrower = lambda: 1 if rng.random() < 0.33 else rng.randint(2, 12)
    events = []
    for i in range(700):
        minutes = rng.random() * 1000
        if rng.random() < 0.3:
            row = ("sessions", session(i, borrower(), round(minutes, 1), rng.random() < 0.7, rng.random() < 0.9))
        else:
            row = ("uploads", (i, borrower(), at(round(minutes, 1)), rng.choice(["bank", "salary", "utility"])))
        events.append((minutes + rng.random() * 9, row))
    events.sort(key=lambda e: e[0])
    feed = Feed(spark)
    for start in range(0, 700, 240):
        part = [row for _, row in events[start : start + 240]]
        got = feed.batch([r for kind, r in part if kind == "uploads"], [r for kind, r in part if kind == "sessions"])
    assert len(got) < sum(kind == "uploads" for _, (kind, _) in events)
    got = feed.batch(tick=at(1100))
    uploads = spark.createDataFrame([r for _, (kind, r) in events if kind == "uploads"], UPLOAD)
    sessions = spark.createDataFrame([r for _, (kind, r) in events if kind == "sessions"], SESSION)
    want = {r.upload_id: r for r in match_uploads(uploads, sessions).select(*ROW).collect()}
    assert got == want and {r.status for r in want.values()} == {200, 401, 403}
    assert feed.sink.frame.count() == len(want)


def test_state_keeps_what_can_still_decide():
    rows = [(1, t, t, 0) for t in (10, 20, 30, 70)] + [(2, 15, 9, 0), (3, 65, 8, 0)]
    assert CS.still_needed(sorted(rows), 60, 40) == [(1, 30, 30, 0), (1, 70, 70, 0), (3, 65, 8, 0)]
    found = CS.decide([(1, 25, 100, "bank"), (1, 61, 101, "bank"), (9, 1, 102, "bank"), (2, 15, 103, "x")], sorted(rows), 40)
    assert [(u[0], u[4]) for u in found] == [(100, 20), (101, 30), (102, None), (103, 9)]
