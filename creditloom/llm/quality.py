"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each text gives shares and lengths (letters, capitals, symbols, repeated words and lines, ...), which are taken to logit or log
scale.  Each class has its mean and its covariance, shrunk towards the pooled one and towards that one's diagonal.
The score is the difference of the two log densities, from Mahalanobis distances with Cholesky factors that are computed once and
travel with the model, turned into a probability by a logistic curve.

All labelled rows are used: tasks hand on sums, never rows.  Shrinkage and curve are chosen by folds; a fold's model comes
from the sums of the others, and its scores from counts in fixed bins.  Equal texts lie in one fold.

Defined results: NULL and empty texts have the statistics of no words; texts over 1 MB are read in pieces cut after white space,
so that memory is bounded; a document labelled twice has the label of the majority (0 in a tie); labels other than 0 and 1
are left out; without rows of both labels every score is the smoothed share of label 1.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch
from .common import written

PIECE_BYTES = 1 << 20
FOLDS = 4
#: Shrinkage of a class's covariance towards the pooled one, and of both towards the diagonal, that the folds choose from.
TOWARDS_POOLED, TOWARDS_DIAGONAL = (0.0, 0.1, 0.3, 0.6, 1.0), (0.01, 0.05, 0.2, 0.5)
FLOOR = 1e-3  # of a share, and of a variance
BINS, WIDTH = 400, 0.08  # of log(1 + |difference|), both signs
ACCEPTED = 0.7
#: Statistics in order; those from ``letters`` on are shares.
NAMES = (
    "words", "distinct", "lines", "word_length", "line_words", "sentence_words",
    "letters", "capitals", "digits", "symbols", "spaces", "beyond_ascii", "controls", "doubled_symbols",
    "capital_words", "upper_words", "bare_words", "short_words", "marked_words", "repeated_words", "repeated_lines", "next_same", "top_word",
)
COUNTS = (
    "bytes", "letters", "capitals", "digits", "symbols", "spaces", "beyond_ascii", "controls", "doubled_symbols", "sentences", "lines",
    "words", "word_bytes", "capital_words", "upper_words", "bare_words", "short_words", "marked_words", "next_same",
)


def between(data: np.ndarray, low: int, high: int) -> np.ndarray:
    return (data >= low) & (data <= high)


def totals(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of flags in each span."""
    run = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return run[ends] - run[starts]


def tally(owner: np.ndarray, value: np.ndarray, count: np.ndarray):
    """Distinct (owner, value) with summed counts."""
    if not len(owner):
        return owner, value, count
    order = np.lexsort((value, owner))
    owner, value, count = owner[order], value[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))))
    return owner[first], value[first], np.add.reduceat(count, first)


def counted(data: np.ndarray, offsets: np.ndarray):
    """Counts of each text (row), and (text, hash, count) of its distinct words and lines."""
    n = len(offsets) - 1
    upper, lower, far = between(data, 65, 90), between(data, 97, 122), data >= 128
    letter, digit, gap = upper | lower | far, between(data, 48, 57), ~textbatch.not_space(data)
    control = (data < 32) & ~gap | (data == 127)
    symbol = ~(letter | digit | gap | control)
    twice = np.zeros(len(data), bool)
    twice[1:] = symbol[1:] & (data[1:] == data[:-1])
    twice[offsets[:-1][offsets[:-1] < len(data)]] = False
    ends_sentence = (data == 46) | (data == 33) | (data == 63)
    sizes = {"bytes": np.diff(offsets)}
    flags = {"letters": letter, "capitals": upper, "digits": digit, "symbols": symbol, "spaces": gap, "beyond_ascii": far}
    flags |= {"controls": control, "doubled_symbols": twice, "sentences": ends_sentence}
    for name, flag in flags.items():
        sizes[name] = totals(flag, offsets[:-1], offsets[1:])
    starts, stops, owner = textbatch.spans(textbatch.not_space(data), offsets)
    length, letters, capitals = stops - starts, totals(letter, starts, stops), totals(upper, starts, stops)
    of_words = {
        "words": np.ones(len(starts), bool),
        "capital_words": upper[starts] if len(starts) else np.zeros(0, bool),
        "upper_words": (capitals == letters) & (letters > 1),
        "bare_words": letters == 0,
        "short_words": length <= 3,
        "marked_words": totals(symbol, starts, stops) > 1,
    }
    word = textbatch.hashes(textbatch.ascii_lower(data), starts, stops)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    of_words["next_same"] = same
    for name, flag in of_words.items():
        sizes[name] = np.bincount(owner, weights=flag, minlength=n)
    sizes["word_bytes"] = np.bincount(owner, weights=length, minlength=n)
    first, last, place = textbatch.spans(data != 10, offsets)
    sizes["lines"] = np.bincount(place, minlength=n)
    words = tally(owner, word, np.ones(len(word), np.int64))
    lines = tally(place, textbatch.hashes(data, first, last), np.ones(len(first), np.int64))
    return np.column_stack([sizes[c] for c in COUNTS]).astype(float), words, lines


def pieces(data: np.ndarray):
    """Cut a long text after white space into pieces of PIECE_BYTES, or inside a word that is longer."""
    start = 0
    while start < len(data):
        stop = min(len(data), start + PIECE_BYTES)
        if stop < len(data):
            gaps = np.flatnonzero(~textbatch.not_space(data[start:stop]))
            stop = start + int(gaps[-1]) + 1 if len(gaps) else stop
        yield data[start:stop]
        start = stop


def measured(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text, in the order of NAMES."""
    if len(offsets) == 2 and len(data) > PIECE_BYTES:
        counts, kept = np.zeros((1, len(COUNTS))), [None, None]
        for piece in pieces(data):
            more, *tables = counted(piece, np.array([0, len(piece)]))
            counts += more
            for i, t in enumerate(tables):
                kept[i] = t if kept[i] is None else tally(*(np.concatenate(x) for x in zip(kept[i], t, strict=True)))
        words, lines = kept
    else:
        counts, words, lines = counted(data, offsets)
    n = len(offsets) - 1
    c = {name: counts[:, i] for i, name in enumerate(COUNTS)}
    distinct = np.bincount(words[0], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, words[0], words[2])
    top = np.where(c["words"] > 1, top - 1, 0)
    repeated = c["lines"] - np.bincount(lines[0], minlength=n)
    lengths = [c["words"], distinct, c["lines"], c["word_bytes"] / np.maximum(c["words"], 1), c["words"] / np.maximum(c["lines"], 1), c["words"] / (c["sentences"] + 1)]
    of = lambda part, whole: c[part] / np.maximum(c[whole], 1)
    shares = [of("letters", "bytes"), of("capitals", "letters")]
    shares += [of(part, "bytes") for part in ("digits", "symbols", "spaces", "beyond_ascii", "controls")]
    shares += [of("doubled_symbols", "symbols"), *(of(p, "words") for p in ("capital_words", "upper_words", "bare_words", "short_words", "marked_words"))]
    shares += [(c["words"] - distinct) / np.maximum(c["words"], 1), repeated / np.maximum(c["lines"], 1), of("next_same", "words"), top / np.maximum(c["words"], 1)]
    shares = np.clip(np.column_stack(shares), 0, 1)
    return np.column_stack((np.log1p(np.column_stack(lengths)), np.log((shares + FLOOR) / (1 - shares + FLOOR))))


def statistics(text: Column) -> Column:
    """Array of the transformed statistics of each whole text."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def run(texts):
        batch = pa.record_batch([texts], names=["text"])
        rows = [measured(*textbatch.flat(part.column(0))) for part in textbatch.slices(batch, 0, PIECE_BYTES)]
        flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
        places = np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.array(flat))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, "array<double>")(text)


@dataclass
class Moments:
    """Row count, sum and sum of outer products of vectors."""

    n: float
    total: np.ndarray
    outer: np.ndarray

    def without(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.outer - other.outer)

    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    def scatter(self) -> np.ndarray:
        return self.outer - np.outer(self.total, self.total) / max(self.n, 1)


@dataclass
class Discriminant:
    """For each class its mean, the inverse of its Cholesky factor and the log determinant; slope and level of the curve."""

    means: np.ndarray
    inverses: np.ndarray
    halves: np.ndarray
    slope: float = 1.0
    level: float = 0.0

    @classmethod
    def of(cls, classes: list[Moments], pooled_share: float, diagonal_share: float) -> Discriminant:
        scatters = [m.scatter() for m in classes]
        pooled = sum(scatters) / max(sum(m.n for m in classes) - 2, 1)
        diagonal = np.diag(np.maximum(np.diag(pooled), FLOOR))
        inverses, halves = [], []
        for m, scatter in zip(classes, scatters, strict=True):
            own = (1 - pooled_share) * scatter / max(m.n - 1, 1) + pooled_share * pooled
            factor = np.linalg.cholesky((1 - diagonal_share) * own + diagonal_share * diagonal)
            inverses.append(np.linalg.inv(factor))
            halves.append(np.log(np.diag(factor)).sum())
        return cls(np.array([m.mean() for m in classes]), np.array(inverses), np.array(halves))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, as sign * log(1 + size)."""
        density = [-0.5 * (((x - m) @ inverse.T) ** 2).sum(1) - half for m, inverse, half in zip(self.means, self.inverses, self.halves, strict=True)]
        apart = density[1] - density[0]
        return np.sign(apart) * np.log1p(np.abs(apart))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (self.slope * self.difference(x) + self.level)))


def rows_of(column, width: int = len(NAMES)) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def moments(train: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments of each (fold, label): one row of sums a task, added up on the cluster."""
    import pyarrow as pa

    p = len(NAMES)

    def run(batches):
        kept = np.zeros((FOLDS, 2, 1 + p + p * p))
        for batch in batches:
            x, fold, label = rows_of(batch.column("x")), np.asarray(batch.column("fold")), np.asarray(batch.column("label"))
            for f in range(FOLDS):
                for k in range(2):
                    some = x[(fold == f) & (label == k)]
                    kept[f, k] += np.concatenate(([len(some)], some.sum(0), (some.T @ some).ravel()))
        yield pa.record_batch([pa.array(np.repeat(np.arange(FOLDS * 2), kept.shape[2])), pa.array(np.tile(np.arange(kept.shape[2]), FOLDS * 2)), pa.array(kept.ravel())], names=["part", "place", "value"])

    sums = train.mapInArrow(run, "part long, place long, value double").groupBy("part", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((FOLDS * 2, 1 + p + p * p))
    for r in sums.collect():
        out[r.part, r.place] = r.value
    return {(i // 2, i % 2): Moments(v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for i, v in enumerate(out)}


def histograms(train: DataFrame, models: list[list[Discriminant]]) -> np.ndarray:
    """Counts by (candidate, label, bin) of each row's difference under the candidate's model that has not seen its fold."""
    import pyarrow as pa

    size = (len(models), 2, 2 * BINS + 1)

    def run(batches):
        kept = np.zeros(size)
        for batch in batches:
            x, fold, label = rows_of(batch.column("x")), np.asarray(batch.column("fold")), np.asarray(batch.column("label"))
            for c, by_fold in enumerate(models):
                for f, model in enumerate(by_fold):
                    at = fold == f
                    place = np.clip(np.round(model.difference(x[at]) / WIDTH), -BINS, BINS).astype(int) + BINS
                    np.add.at(kept[c], (label[at], place), 1)
        full = np.flatnonzero(kept)
        yield pa.record_batch([pa.array(full), pa.array(kept.ravel()[full])], names=["place", "value"])

    sums = train.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size).ravel()
    for r in sums.collect():
        out[r.place] = r.value
    return out.reshape(size)


def curve(counts: np.ndarray) -> tuple[float, float, float]:
    """Slope, level and mean loss of a logistic curve through (label, bin) counts, by Newton steps with a small penalty."""
    at = np.arange(-BINS, BINS + 1) * WIDTH
    n, ones = counts.sum(0), counts[1]
    slope, level = 0.5, 0.0
    for _ in range(50):
        p = 0.5 * (1 + np.tanh(0.5 * (slope * at + level)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p * n - ones) * at).sum() + slope, (p * n - ones).sum() + level])
        hessian = np.array([[(w * at * at).sum() + 1, (w * at).sum()], [(w * at).sum(), w.sum() + 1]])
        step = np.linalg.solve(hessian, g)
        slope, level = max(slope - step[0], 1e-3), level - step[1]
    p = np.clip(0.5 * (1 + np.tanh(0.5 * (slope * at + level))), 1e-12, 1 - 1e-12)
    return slope, level, float(-(counts[1] * np.log(p) + counts[0] * np.log(1 - p)).sum() / max(n.sum(), 1))


def labelled(found: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics, fold and label of the labelled rows."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg((F.avg(label) > 0.5).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")
    return found.select("doc_id", "x").join(known, "doc_id").select("x", fold, "label")


def fit(found: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | float:
    """The model from documents (doc_id, x) and their labels; a constant score where one class has fewer than two rows."""
    train = written(labelled(found, labels, label), "quality")
    parts = moments(train)
    whole = [Moments(*(sum(getattr(parts[f, k], a) for f in range(FOLDS)) for a in ("n", "total", "outer"))) for k in range(2)]
    if min(m.n for m in whole) < 2:
        return (whole[1].n + 1) / (whole[0].n + whole[1].n + 2)
    choices = [(a, b) for a in TOWARDS_POOLED for b in TOWARDS_DIAGONAL]
    models = [[Discriminant.of([whole[k].without(parts[f, k]) for k in range(2)], *c) for f in range(FOLDS)] for c in choices]
    fits = [curve(h) for h in histograms(train, models)]
    best = min(range(len(choices)), key=lambda i: fits[i][2])
    model = Discriminant.of(whole, *choices[best])
    model.slope, model.level = fits[best][:2]
    return model


def rated(model: Discriminant | float, x: Column) -> Column:
    """Score from 0 to 1 of statistics."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    if isinstance(model, float):
        return F.lit(model)

    def run(x):
        return pa.array(np.clip(model.score(rows_of(x)), 0.0, 1.0))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return arrow_udf(run, "double")(x)
