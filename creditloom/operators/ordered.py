"""Running totals and exact quantiles over a whole column, without a global sort in one task.

Rows are first folded to distinct values.  Values fall into fixed, ordered
buckets; bucket totals (a bounded table) give each bucket its start, and a window
inside the bucket finishes the running total.  The bucket of a value depends on
the value alone, so two evaluations of the same plan always agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS_PER_OCTAVE = 1024


def bucket_of(value: str) -> Column:
    """Monotone bucket of a double: finer near zero, about 1000 per doubling."""
    v = F.col(value)
    return F.signum(v).cast("int") * F.floor(F.lit(float(BUCKETS_PER_OCTAVE)) * F.log2(1 + F.abs(v)))


def cumulate(df: DataFrame, group: str, value: str, measures: dict[str, Column]) -> DataFrame:
    """Per group and distinct value: the measures, their running and their group totals."""
    base = df.groupBy(group, value).agg(*[m.alias(k) for k, m in measures.items()])
    base = base.withColumn("_bucket", bucket_of(value))
    totals = base.groupBy(group, "_bucket").agg(*[F.sum(k).alias(f"_{k}") for k in measures])
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(group)
    starts = totals.select(
        group,
        "_bucket",
        *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_start_{k}") for k in measures],
        *[F.sum(f"_{k}").over(whole).alias(f"total_{k}") for k in measures],
    )
    inside = W.partitionBy(group, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return base.join(starts, [group, "_bucket"]).select(
        group,
        value,
        *measures,
        *[(F.col(f"_start_{k}") + F.sum(k).over(inside)).alias(f"cum_{k}") for k in measures],
        *[f"total_{k}" for k in measures],
    )


def quantiles(table: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per group from a ``cumulate`` table with measure ``n``.

    Only the rows that hold a wanted rank survive, at most two per quantile.
    """
    last = F.col("total_n") - 1
    first_rank, end_rank = F.col("cum_n") - F.col("n"), F.col("cum_n")
    wanted = F.transform(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: F.struct(
            p.alias("p"), F.floor(p * last).alias("low"), F.least(F.floor(p * last) + 1, last).alias("high"),
            (p * last - F.floor(p * last)).alias("share"),
        ),
    )
    holds = lambda r: (r >= first_rank) & (r < end_rank)
    hits = (
        table.withColumn("_w", F.filter(wanted, lambda w: holds(w["low"]) | holds(w["high"])))
        .where(F.size("_w") > 0)
        .select(
            group,
            F.inline(
                F.transform(
                    "_w",
                    lambda w: F.struct(
                        w["p"].alias("p"), w["share"].alias("share"),
                        F.when(holds(w["low"]), F.col(value)).alias("low"),
                        F.when(holds(w["high"]), F.col(value)).alias("high"),
                    ),
                )
            ),
        )
    )
    per = hits.groupBy(group, "p").agg(
        F.max("share").alias("share"), F.max("low").alias("low"), F.max("high").alias("high")
    )
    edge = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    return per.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", edge.alias("e")))), lambda x: x["e"]).alias("edges")
    )
