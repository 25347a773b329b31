"""Feature assembly: one row per borrower from bank, salary and utility features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import number
from ..functions.vocab import FEATURES

KEY = "account_id"


def join_sources(bank: DataFrame, salary: DataFrame, utility: DataFrame, key: str = KEY) -> DataFrame:
    """bank (mandatory) left-joined with salary and utility, each kept as a struct."""
    packed = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    return (
        packed(bank, "bank")
        .join(packed(salary, "salary"), key, "left")
        .join(packed(utility, "utility"), key, "left")
    )


def present(source: str) -> Column:
    return F.col(source).isNotNull()


def model_features(joined: DataFrame) -> DataFrame:
    """The five model features by name, missing values as NULL."""
    return joined.select(
        KEY,
        number("bank.credit_debit_ratio").alias("credit_debit_ratio"),
        number("bank.cashflow_cv").alias("cashflow_cv"),
        number("salary.net_to_gross_ratio").alias("net_to_gross_ratio"),
        number("utility.utility_stability").alias("utility_stability"),
        number("bank.min_balance_l3m").alias("min_balance"),
        present("bank").alias("has_bank"),
        present("salary").alias("has_salary"),
        present("utility").alias("has_utility"),
    )


def model_features_alt(joined: DataFrame) -> DataFrame:
    """Second mapping: the discipline flag stands in for utility stability, 0 where absent."""
    flag = F.when(present("utility"), F.coalesce(number("utility.payment_discipline_flag"), F.lit(0.0)))
    return model_features(joined.withColumn("utility", F.col("utility").withField("utility_stability", flag)))


def by_doc_type(parts: dict[str, DataFrame]) -> DataFrame:
    """Feature rows of each document type under its tag, columns aligned by name."""
    out = None
    for kind, df in parts.items():
        tagged = df.withColumn("doc_type", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def with_reject_inference(labeled: DataFrame, unlabeled: DataFrame | None, strategy: str = "parceling") -> DataFrame:
    """Append unlabeled applicants with label -1."""
    if unlabeled is None:
        return labeled
    if strategy != "parceling":
        raise ValueError(f"unknown reject inference strategy: {strategy}")
    return labeled.unionByName(unlabeled.withColumn("default", F.lit(-1)))


def unpivot_features(df: DataFrame, *keep: str, features=FEATURES) -> DataFrame:
    """Long form (keep..., feature, value)."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]
    return df.select(*keep, F.inline(F.array(*pairs)))


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every double column and double array."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out.append(number(f.name).alias(f.name))
        elif kind in ("array<double>", "array<float>"):
            out.append(F.transform(f.name, number).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
