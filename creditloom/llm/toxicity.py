"""Toxicity severity by cumulative-link (proportional odds) regression on sparse word features.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight vector for all ordered thresholds.  x holds log(1 + count) of
each word and each word's beginning in the whole text.  The labels only say whether a text is toxic, so training grades
toxic texts by how many distinct words typical of toxic texts they hold (1: up to MILD, 2: up to STRONG, 3: more).
The L1 penalty leaves weights on telling words only; expected severity is the mean grade.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features, textbatch
from .common import drawn

#: The bounded training sample: labelled rows of each class at most, chosen by a hash.
SAMPLE_ROWS = 4000
GRADES, MILD, STRONG = 4, 3, 6
PREFIX = 6
TELLING_ROWS, TELLING_RATIO = 5, 8.0
PENALTY, STEPS = 1e-4, 400


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class OrdinalModel:
    """known: sorted word hashes with their weights; cuts: ordered thresholds between grades."""

    known: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def chances(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = sigmoid(self.cuts[None, :] - score[:, None])
        full = np.column_stack((np.zeros(len(score)), below, np.ones(len(score))))
        return np.diff(full, axis=1)

    @classmethod
    def fit(cls, row: np.ndarray, word: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, known: np.ndarray) -> OrdinalModel:
        """Accelerated proximal gradient on the penalised log likelihood of entries (row, word, value)."""
        n, grades = len(grade), GRADES
        share = weight / weight.sum()
        seen = np.array([share[grade <= j].sum() for j in range(grades - 1)])
        cuts = np.log(np.clip(seen, 1e-4, 1 - 1e-4) / (1 - np.clip(seen, 1e-4, 1 - 1e-4)))
        cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(len(cuts)))
        w = np.zeros(len(known))
        head, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3))
        state = np.concatenate((w, [head], gaps))
        mean, square = np.zeros_like(state), np.zeros_like(state)
        for step in range(1, STEPS + 1):
            w, cuts = state[: len(known)], state[len(known)] + np.concatenate(([0], np.cumsum(np.exp(state[len(known) + 1 :]))))
            score = np.bincount(row, weights=value * w[word], minlength=n)
            wide = np.concatenate(([-np.inf], cuts, [np.inf]))
            up, low = sigmoid(np.clip(wide[grade + 1], -60, 60) - score), sigmoid(np.clip(wide[grade], -60, 60) - score)
            up, low = np.where(grade == grades - 1, 1.0, up), np.where(grade == 0, 0.0, low)
            p = np.maximum(up - low, 1e-12)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            back = share * (d_up - d_low)  # of the loss by the score
            g_w = np.bincount(word, weights=value * back[row], minlength=len(known))
            g_cut = np.array([(share * ((grade == j + 1) * d_low - (grade == j) * d_up)).sum() for j in range(grades - 1)])
            spread = np.exp(state[len(known) + 1 :])
            g_gap = np.array([g_cut[j + 1 :].sum() for j in range(grades - 2)]) * spread
            gradient = np.concatenate((g_w, [g_cut.sum()], g_gap))
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            rate = 0.03 / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            state = state - rate * mean / (1 - 0.9**step)
            w = state[: len(known)]
            state[: len(known)] = np.sign(w) * np.maximum(np.abs(w) - rate[: len(known)] * PENALTY, 0)
        w, cuts = state[: len(known)], state[len(known)] + np.concatenate(([0], np.cumsum(np.exp(state[len(known) + 1 :]))))
        kept = np.abs(w) > 1e-6
        return cls(known[kept], w[kept], cuts)


def severity(row: np.ndarray, name: np.ndarray, n_names: int, toxic: np.ndarray) -> np.ndarray:
    """Training grades: 0 for texts that are not toxic, else by the number of distinct telling words.

    (row, name) are the distinct words of each text, words as numbers below ``n_names``.
    """
    bad = np.bincount(name, weights=toxic[row], minlength=n_names)
    good = np.bincount(name, minlength=n_names) - bad
    ratio = ((bad + 0.5) / (toxic.sum() + 1)) / ((good + 0.5) / ((1 - toxic).sum() + 1))
    telling = (bad >= TELLING_ROWS) & (ratio >= TELLING_RATIO)
    n = np.bincount(row, weights=telling[name], minlength=len(toxic))
    return np.where(toxic == 0, 0, np.where(n <= MILD, 1, np.where(n <= STRONG, 2, 3))).astype(np.int64)


def terms(data: np.ndarray, offsets: np.ndarray):
    """Hashes and owners of all words and of their first PREFIX bytes, which inflected forms share."""
    word, owner, starts, ends = features.tokens(data, offsets)
    cut = textbatch.hashes(textbatch.ascii_lower(data), starts, np.minimum(ends, starts + PREFIX))
    return np.concatenate((word, textbatch.mix(cut ^ np.uint64(0x5BD1E995)))), np.concatenate((owner, owner))


def word_counts(batches):
    """Task function: toxic, and the distinct word hashes and counts of each text."""
    import pyarrow as pa

    for batch in batches:
        for part in textbatch.slices(batch, 1):
            hashed, owner = terms(*textbatch.flat(part.column(1)))
            order = np.lexsort((hashed, owner))
            hashed, owner = hashed[order], owner[order]
            new = np.ones(len(hashed), bool)
            new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(hashed))).astype(np.float32)
            ends = np.searchsorted(owner[first], np.arange(part.num_rows + 1))
            cut = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            words, counts = hashed[first], count
            yield pa.record_batch(
                [part.column(0), pa.array([words[c].tobytes() for c in cut], pa.binary()), pa.array([counts[c].tobytes() for c in cut], pa.binary())],
                names=["toxic", "words", "counts"],
            )


def fit(docs: DataFrame, labels: DataFrame) -> OrdinalModel | None:
    """A model from a bounded sample of the labelled documents; None without both classes.

    ``labels`` needs doc_id and toxic (0 or 1); rows with a NULL in either, and documents without text, are not used.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    clean = clean.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {int(r.toxic): r["count"] for r in clean.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    placed = clean.withColumn("place", F.xxhash64("doc_id"))
    some = [drawn(placed.where(F.col("toxic") == t), SAMPLE_ROWS).select("doc_id", "toxic") for t in (0, 1)]
    some = F.broadcast(some[0].unionByName(some[1]))  # 2 * SAMPLE_ROWS short rows
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(some, "doc_id").select("toxic", "text")
    rows = texts.mapInArrow(word_counts, "toxic double, words binary, counts binary").limit(4 * SAMPLE_ROWS).collect()
    if len({r.toxic for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.toxic, bytes(r.words)))
    toxic = np.array([r.toxic for r in rows])
    size = np.array([len(r.words) // 8 for r in rows])
    counts = np.concatenate([np.frombuffer(r.counts, np.float32) for r in rows])
    words = np.concatenate([np.frombuffer(r.words, np.uint64) for r in rows])
    del rows
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    known, name, often = np.unique(words, return_inverse=True, return_counts=True)
    name = name.astype(np.int32)
    del words
    grade = severity(row, name, len(known), toxic)
    common = often >= TELLING_ROWS
    place = np.cumsum(common) - 1
    used = common[name]
    sampled = {t: max(1, int((toxic == t).sum())) for t in (0, 1)}
    weight = np.where(toxic == 1, totals[1] / sampled[1], totals[0] / sampled[0])
    value = np.log1p(counts[used].astype(float))
    return OrdinalModel.fit(row[used], place[name[used]], value, grade, weight, known[common])


def graded(model: OrdinalModel, texts):
    """Score of each text of an Arrow array."""
    data, offsets = textbatch.flat(texts)
    score = np.zeros(len(offsets) - 1)
    lookup = features.Lookup(model.known)
    start, limit = 0, textbatch.SLICE_BYTES
    while start < len(score):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        part = offsets[start : stop + 1] - offsets[start]
        hashed, owner = terms(data[offsets[start] : offsets[stop]], part)
        at, place = lookup.find(hashed)
        who, word, count = features.counted(owner[at], place, len(model.known))
        np.add.at(score, start + who, model.weights[word] * np.log1p(count))
        start = stop
    return score


def assess(model: OrdinalModel | None, text: Column) -> Column:
    """Struct of grade (0 to 3), expected_severity, p_toxic and toxic of each whole text.

    NULL and empty texts have no words and get what the thresholds alone say; without a model all is 0.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    if model is None:
        return F.struct(F.lit(0).alias("grade"), F.lit(0.0).alias("expected_severity"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))

    def run(texts):
        chance = model.chances(graded(model, texts))
        p_toxic = 1 - chance[:, 0]
        grade = np.where(p_toxic >= 0.5, 1 + chance[:, 1:].argmax(1), 0)
        columns = [pa.array(grade, pa.int32()), pa.array(chance @ np.arange(chance.shape[1])), pa.array(p_toxic), pa.array(p_toxic >= 0.5)]
        return pa.StructArray.from_arrays(columns, ["grade", "expected_severity", "p_toxic", "toxic"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, "struct<grade:int,expected_severity:double,p_toxic:double,toxic:boolean>")(text)
