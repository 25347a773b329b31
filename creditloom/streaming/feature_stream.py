"""Bank features kept up to date from a stream of ledger rows.

Every micro-batch is rolled up to partial sums by account and day and written under its batch id.  Partials of one day add up
whatever batch they came in, so rows may arrive in any order.  Only the accounts of a batch are computed again, from
all their partials; their new feature rows are written under the same id.  A commit row comes last: readers see committed
batches only, and a batch that is run again overwrites its own folders, so nothing counts twice.

Partials lie in hash buckets of accounts, and a batch reads only the buckets it touches.  After a number of batches the
partials and the latest feature rows are folded into a base, so that a batch reads a bounded number of folders.  (Commit rows stay:
one small file a batch.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ledger import bank_features_of, coerce_ledger, daily_rollup, merged_days

BUCKETS, FOLD_AFTER = 64, 16
COMMIT = "batch long, base long"


@dataclass(frozen=True)
class FeatureTable:
    """The folder of one incremental feature table."""

    spark: SparkSession
    folder: str
    fold_after: int = FOLD_AFTER

    def commits(self) -> tuple[list[int], int | None]:
        """Committed batches since the last base, and that base."""
        path = f"{self.folder}/commits"
        self.spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(path)
        rows = sorted((r.batch, -1 if r.base is None else r.base) for r in self.spark.read.schema(COMMIT).parquet(path).distinct().collect())
        base = max((b for _, b in rows), default=-1)
        return [n for n, _ in rows if n > base], None if base < 0 else base

    def parts(self, kind: str, batches: list[int], base: int | None) -> DataFrame | None:
        """The rows of the base and of batches, with the batch they come from."""
        paths = [(n, f"{self.folder}/{kind}/batch={n}") for n in batches] + ([(base, f"{self.folder}/{kind}-base/batch={base}")] if base is not None else [])
        out = None
        for n, path in paths:
            rows = self.spark.read.parquet(path).withColumn("batch", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        return out

    def absorb(self, lines: DataFrame, batch: int) -> None:
        """Take in the ledger rows of one micro-batch; to be handed to ``foreachBatch``."""
        batches, base = self.commits()
        if batch in batches or (base is not None and batch <= base):
            return
        days = daily_rollup(coerce_ledger(lines)).withColumn("bucket", F.pmod(F.xxhash64("account_id"), F.lit(BUCKETS)).cast("int"))
        mine = f"{self.folder}/days/batch={batch}"
        days.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(mine)  # a file for each bucket
        fresh = self.spark.read.schema(days.schema).parquet(mine)
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
        if touched:
            known = self.parts("days", [*batches, batch], base).where(F.col("bucket").isin(touched))
            known = known.join(fresh.select("account_id").distinct(), "account_id", "left_semi")
            features = bank_features_of(merged_days(known))
            features.write.mode("overwrite").parquet(f"{self.folder}/features/batch={batch}")
            batches = [*batches, batch]
            if len(batches) >= self.fold_after:
                self.fold(batches, base, batch)
                base = batch
            self.spark.createDataFrame([(batch, base)], COMMIT).write.mode("append").parquet(f"{self.folder}/commits")

    def fold(self, batches: list[int], base: int | None, batch: int) -> None:
        """Write all partials and the latest feature rows as one base."""
        days = merged_days(self.parts("days", batches, base), "bucket")
        days.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/days-base/batch={batch}")
        self.latest(batches, base).write.mode("overwrite").parquet(f"{self.folder}/features-base/batch={batch}")

    def latest(self, batches: list[int], base: int | None) -> DataFrame | None:
        rows = self.parts("features", batches, base)
        if rows is None:
            return None
        names = [c for c in rows.columns if c not in ("account_id", "batch")]
        best = rows.groupBy("account_id").agg(F.max_by(F.struct(*names), "batch").alias("f"))
        return best.select("account_id", "f.*")

    def current(self) -> DataFrame | None:
        """The latest committed feature row of every account, or None before the first one."""
        return self.latest(*self.commits())


def maintain(lines: DataFrame, features: FeatureTable, state: str) -> None:
    """Take in what a ledger stream has, batch by batch; going on with the same ``state`` takes in what has come since."""
    query = (
        lines.writeStream.foreachBatch(features.absorb)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
