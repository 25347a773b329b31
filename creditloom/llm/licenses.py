"""Licence families of paragraphs: sparse word n-gram logistic regression, a calibrated unknown class, template comparison.

The classifier is trained on the templates below, varied at random (words lost, swapped, inserted, cut off), against
paragraphs of the corpus and against paragraphs that only use licence words.  A temperature fitted on
held-out variants calibrates its probabilities, and the acceptance threshold is the one that held-out unknown
paragraphs stay below.  A predicted family counts as confirmed when enough of some template's word pairs stand
in the paragraph.  Notices that are wrapped over several lines are proposed by the word pairs of the templates, looked
for across the line feeds between two lines with words, and classified in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features, textbatch
from .common import drawn

UNKNOWN = "unknown"
#: Notices and opening sentences of public licences.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}
#: Sentences that use licence words and grant nothing.
DECOYS = (
    "The driver showed a valid license and registration to the officer.",
    "Our general terms apply to the public sale of free tickets, version and date may change.",
    "She works for the Apache Corporation and teaches at MIT in the summer.",
    "A fishing license is required under state law for any person on the lake.",
    "The software foundation published a notice without warranty claims this year.",
    "This work was published in the hope that readers find it useful.",
    "The copyright office is open to the general public, free of charge.",
)
NGRAM, WINDOW, STRIDE = 3, 48, 24
#: Bounded training sample: corpus paragraphs, and random variants of each template.
CORPUS_PARAGRAPHS, VARIANTS = 3000, 60
CONFIRMED_AT, REJECTED = 0.5, 0.995


@dataclass
class LicenceModel:
    families: list[str]  # the last one is UNKNOWN
    known: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    pairs: list[tuple[int, np.ndarray]]  # family, sorted word-pair hashes of a template


def placed(data: np.ndarray, offsets: np.ndarray):
    """Hash, document and line of every word; lines are counted from 0 in each document."""
    word, doc, starts, _ = features.tokens(data, offsets)
    breaks = np.flatnonzero(data == 10)
    return word, doc, np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[doc])


def windows(word: np.ndarray, doc: np.ndarray, line: np.ndarray):
    """Windows of all lines of all texts: word hashes, window of each, and document and line of each window.

    A paragraph of up to WINDOW words is one window; longer ones give one every STRIDE words, so a notice inside a
    long paragraph fills most of a window.
    """
    if not len(word):
        none = np.zeros(0, np.int64)
        return word, none, none, none
    new = np.ones(len(word), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(word)))
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    para = np.repeat(np.arange(len(begin)), count)
    number = np.arange(len(para)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[para] + number * STRIDE
    length = np.minimum(begin[para] + size[para] - start, WINDOW)
    owner = np.repeat(np.arange(len(para)), length)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + start[owner]
    return word[at], owner, doc[begin[para]], line[begin[para]]


def wrapped(pairs: list[np.ndarray], word: np.ndarray, doc: np.ndarray, line: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of the places that may hold a wrapped notice, from its first to its last word pair.

    A place has CONFIRMED_AT of a template's pairs at least within WINDOW words, lies in successive lines that all have
    words, and touches two of them.  Of starts in reach of each other the one with most pairs counts.
    """
    if len(word) < 2:
        return []
    new = (doc[1:] != doc[:-1]) | (line[1:] > line[:-1] + 1)
    block = np.concatenate(([0], np.cumsum(new)))
    found = features.ngrams(word, block, 2)[0][len(word) :]
    place = np.flatnonzero(~new)
    names = np.unique(np.concatenate(pairs))
    known, name = features.Lookup(names).find(found)
    place = place[known]
    out = []
    for own in pairs:
        need = max(1, int(np.ceil(CONFIRMED_AT * len(own))))
        mine = np.flatnonzero(np.isin(name, np.searchsorted(names, own)))
        at, which = place[mine], name[mine]
        if len(at) < need:
            continue
        first, last = at[: len(at) - need + 1], at[need - 1 :]
        best = (0, 0, 0)
        for i in np.flatnonzero((last - first <= WINDOW - 2) & (block[first] == block[last])).tolist():
            stop = int(np.searchsorted(at, at[i] + WINDOW - 1))
            stop = min(stop, int(np.searchsorted(block[at], block[at[i]], "right")))
            count, end = len(set(which[i:stop].tolist())), int(at[stop - 1]) + 1
            if count < need or line[at[i]] == line[end]:
                continue
            if best[0] and at[i] > best[2]:
                out.append(best[1:])
                best = (0, 0, 0)
            if count >= best[0]:
                best = (count, int(at[i]), end)
        if best[0]:
            out.append(best[1:])
    return sorted(set(out))


def scores(model: LicenceModel, lookup: features.Lookup, word: np.ndarray, owner: np.ndarray, n: int):
    """Class probabilities of each window, and whether it has any known n-gram beside the bias."""
    hashed, who = features.ngrams(word, owner, NGRAM)
    total = np.bincount(who, minlength=n)
    at, place = lookup.find(hashed)
    raw = np.zeros((n, len(model.families)))
    np.add.at(raw, who[at], model.weights[place])
    raw = (raw / np.sqrt(np.maximum(total, 1))[:, None] + model.bias) / model.temperature
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    hashed, _ = features.ngrams(words, np.zeros(len(words), np.int64), 2)
    return np.unique(hashed[len(words) :] if len(words) > 1 else hashed)


def wrapped_notices(model: LicenceModel, lookup: features.Lookup, word: np.ndarray, doc: np.ndarray, line: np.ndarray):
    """document, first and last line, (similarity, probability, family) of each wrapped notice; of those that overlap, the most similar."""
    places = wrapped([pairs for _, pairs in model.pairs], word, doc, line)
    if not places:
        return []
    own = [word[a : b + 1] for a, b in places]
    p = scores(model, lookup, np.concatenate(own), np.repeat(np.arange(len(own)), [len(w) for w in own]), len(own))
    best = p[:, :-1].argmax(1)
    rows = [(similarity(model, int(f), w), float(c[f]), model.families[f], *at) for f, c, w, at in zip(best, p, own, places, strict=True) if c[f] >= model.threshold]
    kept: list[tuple] = []
    for row in sorted(rows, reverse=True):
        if row[0] >= CONFIRMED_AT and all(row[4] < a or row[3] > b for *_, a, b in kept):
            kept.append(row)
    return sorted((int(doc[a]), int(line[a]), int(line[b]), (close, chance, family)) for close, chance, family, a, b in kept)


def similarity(model: LicenceModel, family: int, words: np.ndarray) -> float:
    """Largest share of a template's word pairs that the window has, over the family's templates."""
    own = pair_hashes(words)
    return max((float(np.isin(pairs, own).mean()) for f, pairs in model.pairs if f == family), default=0.0)


def varied(rng: np.random.Generator, words: list[bytes], fill: list[bytes]) -> list[bytes]:
    """A random variant: a few words lost, swapped or inserted, foreign words before and after, or the end cut off."""
    out = [w for w in words if rng.random() > 0.06]
    if len(out) > 2 and rng.random() < 0.3:
        i = int(rng.integers(len(out) - 1))
        out[i], out[i + 1] = out[i + 1], out[i]
    pick = lambda n: [fill[i] for i in rng.integers(0, len(fill), n)] if fill else []
    if rng.random() < 0.3:
        i = int(rng.integers(len(out) + 1))
        out[i:i] = pick(1)
    if len(out) > 12 and rng.random() < 0.3:
        out = out[: int(rng.integers(10, len(out)))]
    before, after = rng.integers(0, 5, 2) if rng.random() < 0.5 else (0, 0)
    return pick(before) + out + pick(after)


def train(corpus: list[str], seed: int = 11) -> LicenceModel:
    """Softmax regression on n-gram presence over the square root of the number of n-grams, with an L2 penalty."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    fill = sorted({w for p in corpus[:500] for w in p.encode().split()[:20]})
    plain = [(families.index(f), t) for f, texts in TEMPLATES.items() for t in texts]
    texts: list[tuple[int, bytes]] = []
    for family, text in plain:
        words = text.encode().split()
        texts += [(family, b" ".join(varied(rng, words, fill))) for _ in range(VARIANTS)] + [(family, text.encode())] * 3
    every = [w for _, t in plain for w in t.encode().split()]
    for text in DECOYS:
        texts += [(len(families) - 1, b" ".join(varied(rng, text.encode().split(), fill))) for _ in range(VARIANTS)]
    for _ in range(10 * VARIANTS):  # licence words in no order, among others
        mixed = [every[i] for i in rng.integers(0, len(every), 8)] + [fill[i] for i in rng.integers(0, len(fill), 8)] if fill else [every[i] for i in rng.integers(0, len(every), 8)]
        texts.append((len(families) - 1, b" ".join(mixed[i] for i in rng.permutation(len(mixed)))))
    data, offsets = features.flat_texts([t.encode() for _, t in plain])
    word, owner, _, _ = features.tokens(data, offsets)
    pairs = [(f, pair_hashes(word[owner == i])) for i, (f, _) in enumerate(plain)]
    blank = LicenceModel(families, np.zeros(0, np.uint64), np.zeros((0, len(families))), np.zeros(len(families)), 1.0, 0.5, pairs)
    for p in corpus:  # the sample itself may hold notices; those teach nothing
        own, _, _, _ = features.tokens(*features.flat_texts([p.encode()]))
        if max(similarity(blank, f, own[:200]) for f in range(len(families) - 1)) < 0.3:
            texts.append((len(families) - 1, b" ".join(p.encode().split()[:WINDOW])))
    target = np.array([f for f, _ in texts])
    data, offsets = features.flat_texts([t for _, t in texts])
    word, owner, _, _ = features.tokens(data, offsets)
    hashed, who = features.ngrams(word, owner, NGRAM)
    names, name, often = np.unique(hashed, return_inverse=True, return_counts=True)
    used = (often >= 3)[name]
    place = (np.cumsum(often >= 3) - 1)[name[used]]
    known, row = names[often >= 3], who[used]
    value = 1 / np.sqrt(np.maximum(np.bincount(who, minlength=len(texts)), 1))
    held = rng.random(len(texts)) < 0.25
    weights, bias = np.zeros((len(known), len(families))), np.zeros(len(families))
    share = np.where(held, 0, 1 / np.bincount(target, weights=~held, minlength=len(families))[target])
    share /= share.sum()
    goal = np.eye(len(families))[target]
    m_w, v_w = np.zeros_like(weights), np.zeros_like(weights)

    def logits():
        raw = np.zeros((len(texts), len(families)))
        np.add.at(raw, row, weights[place])
        return raw * value[:, None] + bias

    def soft(x):
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for step in range(1, 121):
        back = (soft(logits()) - goal) * share[:, None]
        g = np.zeros_like(weights)
        np.add.at(g, place, back[row] * value[row][:, None])
        g += 1e-6 * weights
        m_w += 0.1 * (g - m_w)
        v_w += 0.01 * (g * g - v_w)
        weights -= 0.3 * (m_w / (1 - 0.9**step)) / (np.sqrt(v_w / (1 - 0.99**step)) + 1e-8)
        bias -= 2.0 * back.sum(0)
    final = logits()[held]
    losses = [(-np.log(np.maximum(soft(final / t)[np.arange(held.sum()), target[held]], 1e-12)).mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)]
    temperature = min(losses)[1]
    p = soft(final / temperature)[:, :-1].max(1)
    threshold = float(np.clip(np.quantile(p[target[held] == len(families) - 1], REJECTED), 0.5, 0.95))
    return LicenceModel(families, known, weights, bias, temperature, threshold, pairs)


def fit(docs: DataFrame, text: str = "text") -> LicenceModel:
    """A model whose unknown class has seen a bounded sample of the corpus' paragraphs, chosen by a hash of the text."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    rows = drawn(rows.withColumn("place", F.xxhash64("text")), CORPUS_PARAGRAPHS // 3)
    parts = rows.select("place", F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda p: F.substring(p, 1, 600)).alias("parts"))
    corpus = [p for r in sorted(parts.collect(), key=lambda r: (r.place, r.parts)) for p in r.parts if p.strip()]
    return train(corpus[:CORPUS_PARAGRAPHS])


FOUND = "array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"


def found_in(model: LicenceModel, texts):
    """Licence paragraphs of each text of an Arrow array, by paragraph number."""
    import pyarrow as pa

    lookup = features.Lookup(model.known)
    order = np.argsort(model.known)
    ranked = LicenceModel(model.families, model.known[order], model.weights[order], model.bias, model.temperature, model.threshold, model.pairs)
    data, offsets = textbatch.flat(texts)
    n = len(offsets) - 1
    out: list[list] = [[] for _ in range(n)]
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + textbatch.SLICE_BYTES, "right")) - 1)
        part = offsets[start : stop + 1] - offsets[start]
        words, doc_of, line_of = placed(data[offsets[start] : offsets[stop]], part)
        word, owner, doc, para = windows(words, doc_of, line_of)
        p = scores(ranked, lookup, word, owner, len(doc))
        best = p[:, :-1].argmax(1) if len(doc) else np.zeros(0, np.int64)
        hit = np.flatnonzero(p[np.arange(len(doc)), best] >= model.threshold)
        edge = np.searchsorted(owner, np.arange(len(doc) + 1))
        seen: dict = {}
        for i in hit:
            close = similarity(model, int(best[i]), word[edge[i] : edge[i + 1]])
            row = (close, float(p[i, best[i]]), model.families[best[i]])
            key = (int(doc[i]), int(para[i]))
            seen[key] = max(seen.get(key, row), row)
        rows = {(*key, row[2]): row for key, row in seen.items()}
        for d, first, last, row in wrapped_notices(ranked, lookup, words, doc_of, line_of):
            inside = [(d, k, f) for k in range(first, last + 1) for f in model.families if (d, k, f) in rows]
            if any(f == row[2] and rows[d, k, f][0] >= row[0] for d, k, f in inside):
                continue  # one line holds it as well
            for key in inside:
                if rows[key][0] < row[0]:  # a part of this notice
                    del rows[key]
            rows[d, first, row[2]] = row
        for (d, paragraph, _), (close, chance, family) in sorted(rows.items()):
            out[start + d].append({"paragraph": paragraph, "family": family, "probability": chance, "similarity": close, "confirmed": close >= CONFIRMED_AT})
        start = stop
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))
    return pa.array(out, kind)


def licences(model: LicenceModel, text: Column) -> Column:
    """Array of (paragraph, family, probability, similarity, confirmed) of each whole text; NULL and empty texts have none.

    Paragraphs are lines counted from 0, blank ones too; those below the threshold are unknown and not listed.  A notice
    wrapped over several lines has the number of its first line and stands for the less similar parts found in its lines.
    A line can have two families: its own, and that of a wrapped notice that starts in it.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def run(texts):
        return found_in(model, texts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, FOUND)(text)


def scan(docs: DataFrame, model: LicenceModel, unconfirmed: bool = False) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed: one row for each paragraph with a licence family.

    Predictions that no template confirms are left out unless asked for.
    """
    found = docs.select("doc_id", F.explode(licences(model, F.col("text"))).alias("x")).select("doc_id", "x.*")
    return found if unconfirmed else found.where("confirmed")
