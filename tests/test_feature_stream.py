"""The incremental feature table equals the batch features after any batches, retries and folds."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators.ledger import bank_features
from creditloom.sources.files import fresh_dir
from creditloom.streaming.feature_stream import FeatureTable, maintain

SHAPE = "account_id long, txn_id long, txn_date date, amount double, txn_type string, narration string, closing_balance double"


@pytest.fixture(scope="module")
def lines(spark):
    """A third of the rows belong to one account; some balances, dates and amounts are missing."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(900):
        account = 1 if rng.uniform() < 0.33 else int(rng.integers(2, 30))
        day = dt.date(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 300)))
        text = str(rng.choice(["SALARY CREDIT", "EMI PAYMENT", "UPI", None]))
        rows.append((
            account, i, None if i % 97 == 0 else day, None if i % 89 == 0 else float(np.round(rng.uniform(1, 500), 2)),
            str(rng.choice(["CR", "DR"])), text, None if i % 5 == 0 else float(np.round(rng.normal(0, 900), 2)),
        ))
    return spark.createDataFrame(rows, SHAPE).persist()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_batches_add_up(spark, lines):
    table = FeatureTable(spark, fresh_dir(spark, "features"), fold_after=3)
    assert table.current() is None
    for batch in range(5):
        table.absorb(lines.where(F.col("txn_id") % 5 == batch), batch)
        want = bank_features(lines.where(F.col("txn_id") % 5 <= batch))
        assert rows_of(table.current()) == rows_of(want)
    assert table.commits() == ([3, 4], 2)


def test_a_batch_that_runs_again_counts_once(spark, lines):
    table = FeatureTable(spark, fresh_dir(spark, "features"))
    first, second = lines.where("txn_id < 400"), lines.where("txn_id >= 400")
    table.absorb(first, 0)
    table.absorb(first, 0)  # committed: nothing happens
    # a batch whose folders were written and whose commit was lost is simply written again
    FeatureTable(spark, table.folder).absorb(second, 1)
    lost = table.folder + "/commits"
    spark.createDataFrame([(0, None)], "batch long, base long").write.mode("overwrite").parquet(lost)
    assert rows_of(table.current()) == rows_of(bank_features(first))
    table.absorb(second, 1)
    assert rows_of(table.current()) == rows_of(bank_features(lines))


def test_only_touched_accounts_are_computed(spark, lines):
    table = FeatureTable(spark, fresh_dir(spark, "features"))
    table.absorb(lines, 0)
    table.absorb(lines.where("account_id in (1, 7)").withColumn("txn_id", F.col("txn_id") + 10_000), 1)
    written = spark.read.parquet(f"{table.folder}/features/batch=1")
    assert {r.account_id for r in written.collect()} == {1, 7}
    table.absorb(lines.where("false"), 2)
    assert table.commits() == ([0, 1], None)


def test_a_stream_goes_on_where_it_stopped(spark, lines):
    folder, state = fresh_dir(spark, "lines"), fresh_dir(spark, "state")
    table = FeatureTable(spark, fresh_dir(spark, "features"), fold_after=2)
    lines.where("txn_id < 500").repartition(2, "txn_id").write.parquet(folder)
    stream = lambda: spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(folder)
    maintain(stream(), table, state)
    assert rows_of(table.current()) == rows_of(bank_features(lines.where("txn_id < 500")))
    lines.where("txn_id >= 500").coalesce(1).write.mode("append").parquet(folder)
    maintain(stream(), table, state)
    assert rows_of(table.current()) == rows_of(bank_features(lines))


def test_a_bucket_is_one_file(spark, lines):
    """Days of one bucket are written together, however many tasks made them."""
    table = FeatureTable(spark, fresh_dir(spark, "features"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.absorb(lines, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(f"{table.folder}/days/batch=0").select("bucket", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("bucket").count().where("count > 1").count() == 0


def test_a_batch_of_the_ledger_has_a_file_for_each_core(spark, tmp_path, monkeypatch):
    from creditloom.plans import learner_plans as P

    rows = [(i % 7, i, dt.date(2023, 1, 1) + dt.timedelta(days=i % 50), float(i), "CR", "UPI", None) for i in range(500)]
    monkeypatch.setattr(P.views, "ledger", lambda s, d: s.createDataFrame(rows, SHAPE))
    seen = []
    monkeypatch.setattr(P.FS, "maintain", lambda stream, features, state: maintain(stream, Counted(features, seen), state))
    monkeypatch.setattr(P.FS.FeatureTable, "current", lambda self: None)
    P._streamed_bank_features(spark, "unused")
    assert len(seen) == P.LEDGER_BATCHES and min(seen) > 1


class Counted:
    """Files in each batch."""

    def __init__(self, features, seen):
        self.seen = seen

    def absorb(self, lines, batch):
        self.seen.append(lines.select(F.input_file_name()).distinct().count())
