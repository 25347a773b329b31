"""Text risk: TF-IDF and logistic regression whose vocabulary, idf and weights are tables.

Nothing here grows on the driver with the vocabulary.  A document is rows (key, term, x), dealt once by a hash of the document
over blocks, where they stay: no step shuffles them.  A plain gradient step sends a block the values of the terms that it holds
(``wants``), or those of its documents; only sums by term come out of the blocks.

``fit`` finds weights by limited-memory quasi-Newton steps in the form that needs only inner products: the last steps and
gradient changes are vectors over the terms, and the driver turns the small matrix of their inner products into the
coefficients of the next direction.  As margins are linear in the weights, one pass over the documents tries every step length
at once.  It takes many steps, so blocks, vectors and margins are held as arrays (``text_blocks``): two jobs a step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, ready_to_checkpoint
from .text_blocks import TextMatrix

WORD = r"(?U)\b\w\w+\b"
MEMORY, STEPS, TOLERANCE = 5, 60, 1e-9
LENGTHS = [2.0**k for k in range(4, -15, -1)]
BLOCK_DOCS, BLOCK_CHARS = 8192, 1 << 26  # at most, about; blocks are a multiple of the cores
PART_CHARS = 1 << 27  # text for each part of the vocabulary, likewise


@contextmanager
def joined_in_blocks(spark: SparkSession):
    """Joins on (block, ...) leave a side alone that is already dealt by block, for the jobs run inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Lists of words go to Python in smaller batches than the default, for the jobs planned inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def term_counts(docs: DataFrame, key: str, text: str, stop: Sequence[str], *by: str) -> DataFrame:
    """key, term, tf of every word that is no stop word; ``by`` names columns that the key decides, which are kept."""
    return (
        docs.select(*by, F.col(key).alias("key"), F.explode(words_of(text)).alias("term"))
        .where(~F.col("term").isin(list(stop)))
        .groupBy(*by, "key", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def inverse_frequencies(counts: DataFrame, n_docs: int) -> DataFrame:
    """term, idf = ln((1 + n) / (1 + documents with the term)) + 1."""
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return seen.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1).alias("idf"))


def sent(values: DataFrame, blocks: int) -> DataFrame:
    """Values for the rows of each block, brought to where the block is."""
    return values.repartitionById(blocks, "block").hint("shuffle_hash")


def unit_rows(counts: DataFrame, wants: DataFrame, blocks: int) -> DataFrame:
    """block, key, tid, term, x: tf x idf of known terms, each document scaled to length 1."""
    known = wants.select("block", "term", "tid", "idf")
    values = counts.join(sent(known, blocks), ["block", "term"]).select("block", "key", "tid", "term", (F.col("tf") * F.col("idf")).alias("v"))
    norms = values.groupBy("block", "key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return values.join(sent(norms, blocks), ["block", "key"]).select("block", "key", "tid", "term", (F.col("v") / F.col("norm")).alias("x"))


def wanted(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """block, term, tid, idf: the known terms of each block."""
    return cut_lineage(rows.select("block", "term").distinct().join(terms.select("term", "tid", "idf"), "term"))


def blocks_of(entries: DataFrame) -> int:
    return entries.rdd.getNumPartitions()


def term_sums(entries: DataFrame, docs: DataFrame, value: Column) -> DataFrame:
    """tid, total: each term's sum of x times a value of the document."""
    values = docs.select("block", "key", value.alias("r"))
    return entries.join(sent(values, blocks_of(entries)), ["block", "key"]).groupBy("tid").agg(F.sum(F.col("x") * F.col("r")).alias("total"))


def doc_sums(entries: DataFrame, wants: DataFrame, weights: DataFrame, value: Column) -> DataFrame:
    """block, key, total: each document's sum of x times a value of the term."""
    values = wants.select("block", "tid").join(weights.select("tid", value.alias("r")), "tid")
    return entries.join(sent(values, blocks_of(entries)), ["block", "tid"]).groupBy("block", "key").agg(F.sum(F.col("x") * F.col("r")).alias("total"))


def chance(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


@dataclass(frozen=True)
class TextRisk:
    """Terms with idf and weight, the intercept, and the loss reached."""

    terms: DataFrame
    intercept: float
    loss: float
    stop: tuple[str, ...]

    def apply(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows with prob; words that training has not seen are left out."""
        counts = term_counts(docs, key, text, self.stop).join(self.terms.select("term", "idf", "w"), "term")
        v = F.col("tf") * F.col("idf")
        found = counts.groupBy(F.col("key").alias(key)).agg((F.sum(v * F.col("w")) / F.sqrt(F.sum(v * v))).alias("total"))
        joined = docs.join(found, key, "left")
        return joined.withColumn("prob", chance(F.coalesce("total", F.lit(0.0)) + self.intercept)).drop("total")


def training_tables(train: DataFrame, key: str, text: str, label: str, stop: Sequence[str]):
    """Documents (key, y, block), idf (term, idf, tid), and entries (block, key, tid, term, x), which every step reads.

    Documents and idf are checkpointed; the entries are held, dealt by block, until the caller lets them go (``unpersist``).
    """
    spark = train.sparkSession
    docs = cut_lineage(train.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).distinct())
    n = docs.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = cores * max(1, math.ceil(n / (cores * BLOCK_DOCS)))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    texts = train.select(F.col(key).alias("key"), F.col(text).alias("text")).select(block, "key", "text")
    texts = texts.repartitionById(blocks, "block")
    with joined_in_blocks(spark):
        counts = term_counts(texts, "key", "text", stop, "block").persist()
        idf = cut_lineage(inverse_frequencies(counts, n).withColumn("tid", F.monotonically_increasing_id()))
        entries = unit_rows(counts, wanted(counts, idf), blocks).persist()
        entries.count()
        counts.unpersist()
    return docs.select("key", "y", block), idf, entries


def gradient_steps(
    docs: DataFrame, entries: DataFrame, idf: DataFrame, steps: int, rate: float, c: float = 1.0, intercept: float = 0.0
) -> tuple[DataFrame, float]:
    """Weights (term, idf, w) and intercept after plain gradient steps from zero weights and the given intercept."""
    weights = idf.withColumn("w", F.lit(0.0))
    with joined_in_blocks(docs.sparkSession):
        wants = wanted(entries, idf)
        for _ in range(steps):
            margin = docs.join(doc_sums(entries, wants, weights, F.col("w")), ["block", "key"], "left")
            errors = cut_lineage(margin.select("block", "key", (chance(F.coalesce("total", F.lit(0.0)) + intercept) - F.col("y")).alias("e")))
            slope = term_sums(entries, errors, F.col("e"))
            moved = F.col("w") - rate * (F.col("w") / c + F.coalesce("total", F.lit(0.0)))
            weights = cut_lineage(weights.join(slope, "tid", "left").select("tid", "term", "idf", moved.alias("w")))
            intercept -= rate * errors.agg(F.sum("e")).first()[0]
    return weights.select("term", "idf", "w"), intercept


def direction(products: np.ndarray, steps: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction by the vectors s1.., y1.., g, from their inner products.

    The two-loop recursion, with every vector held as its coefficients.
    """
    size = 2 * steps + 1
    out = np.zeros(size)
    out[-1] = -1.0
    scale = np.zeros(steps)
    for i in reversed(range(steps)):
        scale[i] = out @ products[:, i] / products[i, steps + i]
        out[steps + i] -= scale[i]
    if steps:
        out *= products[steps - 1, 2 * steps - 1] / products[2 * steps - 1, 2 * steps - 1]
    for i in range(steps):
        out[i] += scale[i] - out @ products[:, steps + i] / products[i, steps + i]
    return out


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", c: float = 1.0, stop: Sequence[str] | None = None) -> TextRisk:
    """Minimum of the sum of losses plus |w|^2 / 2C (the intercept is free).  Rows of one key are one document."""
    stop = english_stop_words() if stop is None else list(stop)
    if train.isEmpty():
        raise ValueError("no training rows")
    held = matrix(train, key, text, label, stop)
    try:
        return minimum(held, c, stop)
    finally:
        held.release()


def matrix(train: DataFrame, key: str, text: str, label: str, stop: Sequence[str]) -> TextMatrix:
    """The training part as arrays by block of documents."""
    spark = train.sparkSession
    rows, chars = train.agg(F.count(F.lit(1)), F.sum(F.length(text))).first()
    cores = spark.sparkContext.defaultParallelism
    rounds = lambda size, most: max(1, math.ceil((size or 0) / (cores * most)))
    blocks, parts = cores * max(rounds(rows, BLOCK_DOCS), rounds(chars, BLOCK_CHARS)), cores * rounds(chars, PART_CHARS)
    texts = train.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("double").alias("y"))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")
    ready_to_checkpoint(spark)
    with small_batches(spark):
        labels, whole = F.collect_set(F.struct("y")).alias("labels"), F.concat_ws("\n", F.collect_list("text")).alias("text")
        documents = dealt.groupBy("block", "key").agg(labels, whole)
        words = documents.select("block", F.isnull("key").alias("unknown"), "labels", words_of("text").alias("words"))
        return TextMatrix(words, blocks, parts, stop)


def minimum(held: TextMatrix, c: float, stop: Sequence[str]) -> TextRisk:
    """The model of the training part by quasi-Newton steps; ``fit`` states the aim."""
    if not held.labelled:
        raise ValueError("no training rows")
    lengths, level_g = np.array(LENGTHS), held.level
    level = np.array([level_g, 0.0])  # the intercept's part of the vectors s.., y.., g, w
    loss, share, length = held.documents * np.log(2.0), None, 0.0
    for _ in range(STEPS):
        # Gradient at w; with it the change since the last one.
        if share is not None:
            level = after_step(level, share, length, level_g)
        found = held.gradient(share, length, c, MEMORY) + np.zeros((len(level), len(level)))
        square, crossed = found[:-1, :-1], found[:-1, -1]
        # The direction, the margins along it, and the best of many step lengths.
        aim = direction(square + np.outer(level[:-1], level[:-1]), len(level) // 2 - 1)
        sums = held.search(aim, float(aim @ level[:-1]), length, lengths)
        losses = sums[:, 0] + (found[-1, -1] + 2 * lengths * (aim @ crossed) + lengths**2 * (aim @ square @ aim)) / (2 * c)
        best = int(np.argmin(losses))
        share = None
        if not losses[best] < loss * (1 - TOLERANCE):
            break
        share, length, loss, level_g = aim, LENGTHS[best], losses[best], sums[best, 1]
    if share is not None:
        level = after_step(level, share, length, level_g)
    return TextRisk(cut_lineage(held.weights(share, length)), float(level[-1]), float(loss), tuple(stop))


def after_step(level: np.ndarray, share: np.ndarray, length: float, level_g: float) -> np.ndarray:
    """The intercept's part of the vectors after a step, as ``text_blocks.moved`` has it for the terms."""
    steps, move = len(level) // 2 - 1, length * (share @ level[:-1])
    first = max(0, steps + 1 - MEMORY)
    return np.array([*level[first:steps], move, *level[steps + first : 2 * steps], level_g - level[-2], level_g, level[-1] + move])
