"""Language identification with a byte convolutional network trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; each filter's largest response in
a window goes to a softmax over the languages.  A filter of width w holds one weight per offset and byte value, so a
response is a sum of w table rows and training needs the gradient at the largest response only.
A text is cut into windows from start to end, and its windows vote with their probabilities by length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, written
from .textbatch import flat

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The bounded training sample: texts of each language at most, windows taken from each of them, and texts of all languages about.
SAMPLE_ROWS, SAMPLE_WINDOWS, ALL_ROWS = 800, 4, 160_000
STEP_BYTES = 1 << 20  # a multiple of WINDOW
BLOCK = 64  # windows computed at a time, so that intermediate tables stay in the cache


@dataclass
class ByteNetwork:
    """tables: for each width an array (offset, byte, filter); padding is byte 0."""

    labels: list[str]
    tables: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """For each width the responses (window, position, filter)."""
        n, size = windows.shape
        out = []
        for table in self.tables:
            width, _, filters = table.shape
            span = size - width + 1
            total = table[0].take(windows[:, :span], axis=0)
            for k in range(1, width):
                total += table[k].take(windows[:, k : k + span], axis=0)
            out.append(total)
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for i in range(0, len(windows), BLOCK):
            pooled = np.concatenate([r.max(1) for r in self.responses(windows[i : i + BLOCK])], 1)
            out[i : i + BLOCK] = softmax(np.maximum(pooled, 0) @ self.weights + self.bias)
        return out

    @classmethod
    def train(cls, windows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
        """Adam on the cross entropy, languages weighted alike."""
        rng = np.random.default_rng(seed)
        net = cls(
            labels,
            [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
            rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
            np.zeros(len(labels), np.float32),
        )
        share = 1 / np.maximum(np.bincount(target, minlength=len(labels)), 1)
        params = [*net.tables, net.weights, net.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, y = windows[pick], target[pick]
                responses = net.responses(x)
                best = [r.argmax(1) for r in responses]
                pooled = np.concatenate([np.take_along_axis(r, b[:, None], 1)[:, 0] for r, b in zip(responses, best, strict=True)], 1)
                active = np.maximum(pooled, 0)
                p = softmax(active @ net.weights + net.bias)
                p[np.arange(len(y)), y] -= 1
                p *= (share[y] / share[y].sum())[:, None]
                back = (p @ net.weights.T) * (pooled > 0)
                grads = []
                for j, (table, b) in enumerate(zip(net.tables, best, strict=True)):
                    g = np.zeros_like(table)
                    part = back[:, j * FILTERS : (j + 1) * FILTERS]
                    for k in range(table.shape[0]):
                        byte = np.take_along_axis(x, b + k, 1)
                        np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [active.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return net


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """All windows of all texts (the last one of a text padded), the text of each, and its bytes."""
    size = np.diff(offsets)
    count = -(-size // window)
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + number * window
    length = np.minimum(offsets[text + 1] - start, window)
    at = start[:, None] + np.arange(window)
    padded = np.concatenate((data, np.zeros(window, np.uint8)))
    out = padded[at]
    out[np.arange(window) >= length[:, None]] = 0
    return out, text, length


def guess(net: ByteNetwork, texts):
    """Label and score of each text of an Arrow array; texts without bytes get no label and score 0."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    votes = np.zeros((n, len(net.labels)))
    i = 0
    while i < n:  # texts of about STEP_BYTES at a time, a longer one in pieces of whole windows
        stop = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1)
        for first in range(int(offsets[i]), int(offsets[stop]), STEP_BYTES):
            last = min(first + STEP_BYTES, int(offsets[stop]))
            part = np.clip(offsets[i : stop + 1], first, last) - first
            windows, text, length = cut(data[first:last], part)
            np.add.at(votes, i + text, net.probabilities(windows) * length[:, None])
        i = stop
    total = votes.sum(1)
    best = votes.argmax(1)
    score = np.where(total > 0, votes[np.arange(n), best] / np.maximum(total, 1e-12), 0.0)
    return best, np.minimum(score, 1.0), total > 0


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, text: str, label: str) -> list[tuple[str, bytes]]:
    """Windows of a bounded sample: for each label the SAMPLE_ROWS distinct texts that a hash puts first, SAMPLE_WINDOWS each.

    Copies count once.  Every label has a bound of its own, and none is left out: with more labels than ALL_ROWS / SAMPLE_ROWS
    each gives fewer texts.
    """
    rows = docs.where(F.col(label).isNotNull() & lettered(F.col(text))).select(F.col(text).alias("text"), F.col(label).alias("label"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("text", "label"), F.lit(1 << 62)))
    texts = written(rows.select("label", "place").distinct(), "places")
    counts = texts.groupBy("label").agg(F.count("*").alias("n"))
    n_labels = counts.count()
    most = max(1, min(SAMPLE_ROWS, ALL_ROWS // max(1, n_labels)))
    reach = 2 * most + 50  # texts expected in the share, so that hardly ever fewer than ``most`` are
    share = F.least(F.lit(1.0), F.lit(float(reach)) / F.col("n")) * float(1 << 62)
    places: dict = {}
    shares = if_small(counts.select("label", share.alias("share")), n_labels, ALL_ROWS)
    for r in texts.join(shares, "label").where(F.col("place") <= F.col("share")).select("label", "place").collect():
        places.setdefault(r.label, []).append(r.place)
    if not places:
        return []
    bounds = docs.sparkSession.createDataFrame([(x, sorted(p)[:most][-1]) for x, p in sorted(places.items())], "label string, bound long")
    body = F.encode(F.lower("text"), "UTF-8")
    size = F.octet_length(F.lower("text"))
    starts = [F.pmod(F.hash("place", F.lit(k)), F.greatest(size - WINDOW, F.lit(1))) for k in range(SAMPLE_WINDOWS)]
    parts = F.array(*[F.substring(body, s.cast("int") + 1, F.lit(WINDOW)) for s in starts])
    drawn = rows.join(if_small(bounds, n_labels, ALL_ROWS), "label").where(F.col("place") <= F.col("bound")).select("label", "place", parts.alias("parts"))
    drawn = drawn.groupBy("label", "place").agg(F.first("parts").alias("parts"))
    return [(r.label, bytes(p)) for r in sorted(drawn.collect(), key=lambda r: (r.place, r.label)) for p in r.parts]


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> ByteNetwork | None:
    """A network for the labels of ``docs``, or None when no row has a label and a letter."""
    drawn = sample(docs, text, label)
    if not drawn:
        return None
    labels = sorted({x for x, _ in drawn})
    windows = np.zeros((len(drawn), WINDOW), np.uint8)
    for i, (_, part) in enumerate(drawn):
        windows[i, : len(part)] = np.frombuffer(part, np.uint8)
    number = {x: i for i, x in enumerate(labels)}
    return ByteNetwork.train(windows, np.array([number[x] for x, _ in drawn]), labels)


def identify(net: ByteNetwork | None, text: Column) -> Column:
    """Struct of label and score for each whole text: ``und`` and 0 where the text is NULL or has no letter, or nothing was learned."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    nothing = F.struct(F.lit(UNKNOWN).alias("label"), F.lit(0.0).alias("score"))
    if net is None:
        return nothing

    def run(texts):
        best, score, found = guess(net, texts)
        names = pa.array([net.labels[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(score)], ["label", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    predict = arrow_udf(run, "struct<label:string,score:double>")
    return F.when(lettered(text), predict(F.when(lettered(text), F.lower(text)))).otherwise(nothing)
