"""Consent windows: which uploads fall inside a valid session.

An upload belongs to the latest session its borrower opened at most 60 minutes
before.  Joining all uploads of a borrower with all sessions would pair them up
quadratically, so both sides are laid on one time line instead, cut into short
slots: every slot knows its own sessions and the last session of each slot in the
hour before, and a window per (borrower, slot) carries the latest one forward.  A
busy borrower spreads over many slots, and a slot with more than its share of all
rows over several pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vocab import CONSENT_MINUTES
from . import segmented as G

VALID_MICROS = CONSENT_MINUTES * 60 * 1_000_000
SLOT_MINUTES = 5
FLAGS = ("consent_bank", "consent_salary", "consent_utility", "consent_dpdpa")


def slot_of(ts: Column, minutes: int = SLOT_MINUTES) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (minutes * 60 * 1_000_000))


def open_sessions(consents: DataFrame) -> DataFrame:
    """Consent requests that create a session: bank and data-protection consent are mandatory."""
    return consents.where(F.col("consent_bank") & F.col("consent_dpdpa"))


def match_uploads(uploads: DataFrame, consents: DataFrame, min_rows: int = G.MIN_ROWS) -> DataFrame:
    """Every upload with its session (or NULL), status and reason."""
    session = F.struct("session_id", "created_at", *FLAGS)
    none = lambda kind: F.lit(None).cast(kind)
    point = F.struct(F.col("created_at").alias("at"), F.col("session_id").alias("seq"), session.alias("session"))
    opened = open_sessions(consents).select("borrower_id", slot_of(F.col("created_at")).alias("slot"), point.alias("p"))
    later = F.transform(F.sequence(F.lit(1), F.lit(CONSENT_MINUTES // SLOT_MINUTES)), lambda i: F.col("slot") + i)
    carried = (
        opened.groupBy("borrower_id", "slot")
        .agg(F.max_by("p", F.struct("p.at", "p.seq")).alias("p"))
        .select("borrower_id", F.explode(later).alias("slot"), "p")
    )
    marks = opened.unionByName(carried).select(
        "borrower_id", "slot", "p.at", F.lit(0).alias("kind"), "p.seq", "p.session",
        none("bigint").alias("upload_id"), none("string").alias("doc_type"),
    )
    sent = uploads.select(
        "borrower_id", slot_of(F.col("uploaded_at")).alias("slot"), F.col("uploaded_at").alias("at"),
        F.lit(1).alias("kind"), F.col("upload_id").alias("seq"),
        none(marks.schema["session"].dataType).alias("session"), "upload_id", "doc_type",
    )
    slot, place = ["borrower_id", "slot"], ["at", "kind", "seq"]
    timeline = G.with_pieces(marks.unionByName(sent), slot, place, min_rows)
    piece = [*slot, G.PIECE]
    session = F.when(F.col("kind") == 0, F.col("session"))
    # Bounded by the number of pieces; a piece without sessions of its own has a start as well.
    starts = timeline.where(F.col(G.PIECE) > 0).groupBy(*piece).agg(F.max_by(session, F.when(F.col("kind") == 0, F.struct(*place))).alias("end"))
    starts = starts.select(
        *piece, F.last("end", ignorenulls=True).over(W.partitionBy(*slot).orderBy(G.PIECE).rowsBetween(W.unboundedPreceding, -1)).alias("start")
    )
    line = W.partitionBy(*piece).orderBy(*place).rowsBetween(W.unboundedPreceding, 0)
    timeline = timeline.join(F.broadcast(starts), piece, "left").withColumn(
        "session", F.coalesce(F.last("session", ignorenulls=True).over(line), "start")
    )
    fresh = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("session.created_at").cast("timestamp"))
    valid = F.when(fresh <= VALID_MICROS, F.col("session"))
    return with_verdict(
        timeline.where(F.col("kind") == 1).select(
            "upload_id", "borrower_id", "doc_type", F.col("at").alias("uploaded_at"), valid.alias("session")
        )
    )


def with_verdict(uploads: DataFrame) -> DataFrame:
    """401 without a valid session, 403 without the consent for this document type, else 200."""
    allowed = (
        F.when(F.col("doc_type") == "bank", F.col("session.consent_bank"))
        .when(F.col("doc_type") == "salary", F.col("session.consent_salary"))
        .when(F.col("doc_type") == "utility", F.col("session.consent_utility"))
        .otherwise(False)
    )
    none = F.col("session").isNull()
    status = F.when(none, 401).when(~allowed, 403).otherwise(200)
    reason = F.when(none, F.lit("Invalid session")).when(
        ~allowed, F.concat(F.initcap("doc_type"), F.lit(" consent required"))
    )
    return uploads.withColumn("status", status).withColumn("reason", reason)
