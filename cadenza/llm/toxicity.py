"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (4 to 6 code points, A-Z as a-z, white space as blanks) it holds,
hashed to a fixed number of slots. Each present feature has the value of its log-count ratio: the log of its
smoothed share among toxic texts over that among others. Logistic regression on those values gives the weights: every
feature of a training text has one, the penalty keeps those of weak ratios small, and both classes weigh alike however
few texts one of them has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm import textbytes as tb
from cadenza.llm.fit import minimise
from cadenza.llm.labels import fitted, sample, with_scores
from cadenza.llm.workspace import Workspace

#: Labelled documents of each class that the model is fitted on.
TRAIN_ROWS = 3_000
GRAMS = (4, 5, 6)
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
SMOOTHING = 4.0
#: Steps of the fit, at most.
ROUNDS = 60
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[9:14] = 32
_STEP = tb.U64(0x9E3779B97F4A7C15)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a random 64-bit value of every code point, first code point of each text and the total); a blank before and after each text."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, dtype=np.uint8)
    inside = np.ones(len(padded), dtype=bool)
    inside[offsets[:-1] + 2 * np.arange(n)] = False
    inside[offsets[1:] + 2 * np.arange(n) + 1] = False
    padded[inside] = _CLEAN[data]
    follows = (padded & 0xC0) == 0x80
    starts = np.flatnonzero(~follows)
    value = tb._TABLE[padded[starts]]
    size = np.diff(np.append(starts, len(padded)))
    at = np.flatnonzero(size > 1)
    for k in range(1, int(size.max(initial=1))):
        at = at[size[at] > k]
        value[at] = tb.mix(value[at]) + tb._TABLE[padded[starts[at] + k]]
    return value, np.searchsorted(starts, offsets + 2 * np.arange(n + 1))


def features(data: np.ndarray, offsets: np.ndarray):
    """For each text the distinct slots (int32, unordered) of its n-grams, in order of the texts."""
    value, of = characters(data, offsets)
    slots, h, factor = [], np.zeros(len(value), dtype=np.uint64), 1
    for k in range(1, GRAMS[-1] + 1):  # the hash of k code points grows into that of k + 1
        h = h[: len(value) - k + 1] + value[k - 1 :] * tb.U64(factor)
        factor = factor * int(_STEP) % 2**64
        if k in GRAMS:
            x = h ^ (h >> tb.U64(31))
            x *= tb.U64(0xBF58476D1CE4E5B9 + 2 * k)
            slots.append((x >> tb.U64(64 - SLOT_BITS)).astype(np.int32))
    place, turn = np.zeros(SLOTS, dtype=np.int32), np.arange(0, dtype=np.int32)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        own = np.concatenate([s[a : max(a, b - k + 1)] for k, s in zip(GRAMS, slots, strict=True)])
        if len(own) > len(turn):
            turn = np.arange(len(own), dtype=np.int32)
        place[own] = turn[: len(own)]  # of equal slots the last one's turn stays, so one of them is kept
        yield own[place[own] == turn[: len(own)]]


class GramClassifier:
    """Weights by slot (already scaled by the log-count ratios) and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = tb.utf8(column)
        out = [self.bias + float(self.weights[slot].sum(dtype=np.float64)) for _, _, part, at in tb.runs(data, offsets) for slot in features(part, at)]
        return 1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -500, 500)))


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of features held by so many toxic and clean texts: log of the smoothed share among the toxic over that among the clean.

    The smoothing of the larger class grows with it, so that a feature that no text holds has a ratio of zero.
    """
    p = (toxic + SMOOTHING) / n_toxic
    q = (clean + SMOOTHING * n_clean / n_toxic) / n_clean
    return np.log(p) - np.log(q)


def fit(texts: list[str], labels: list[int], l2: float = 1e-2) -> GramClassifier:
    """Fit on texts with labels 0 and 1. With one class only (or none) the model says that class (or one half)."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return GramClassifier(np.zeros(SLOTS), 0.0 if not labels else (4.0 if labels[0] else -4.0))
    data, offsets = tb.utf8(pa.array(texts, pa.large_string()))
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    held = np.zeros((2, SLOTS), dtype=np.int32)
    blocks = []  # first text, last + 1, distinct slots of each text one after another, their bounds
    for first, last, part, at in tb.runs(data, offsets):
        own = list(features(part, at))
        for slot, label in zip(own, labels[first:last], strict=True):
            held[int(label), slot] += 1
        blocks.append((first, last, np.concatenate(own), np.cumsum([0, *map(len, own)])))
    names = np.flatnonzero(held.any(axis=0))
    value = log_count_ratios(held[1, names], held[0, names], int((y == 1).sum()), int((y == 0).sum()))
    rank = np.zeros(SLOTS, dtype=np.int32)
    rank[names] = np.arange(len(names))
    for _, _, slot, _ in blocks:
        slot[:] = rank[slot]
    del held, rank, data

    def loss(v):
        w, s, g = (value * v[:-1]).astype(np.float32), np.full(len(y), v[-1]), np.zeros(len(names))
        for first, last, col, at in blocks:
            s[first:last] += np.diff(np.append(0, np.cumsum(w[col], dtype=np.float64))[at])
        e = share * (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y)
        for first, last, col, at in blocks:
            g += np.bincount(col, weights=np.repeat(e[first:last], np.diff(at)), minlength=len(names))
        return share @ (np.logaddexp(0, s) - y * s) + l2 / 2 * (v[:-1] @ v[:-1]), np.append(value * g + l2 * v[:-1], e.sum())

    v = minimise(loss, np.zeros(len(names) + 1), rounds=ROUNDS, memory=5)
    weights = np.zeros(SLOTS)
    weights[names] = v[:-1] * value
    return GramClassifier(weights, float(v[-1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted.

    Labels of rows whose crc32(id as text) mod ``folds`` is ``fold`` are never learnt from; the fit takes at most
    ``rows`` labelled documents of each class. Null and empty texts hold no feature and get the score of the
    bias; every row is scored whole, repeated ones alike. Without labels every score is one half.
    """
    spark = docs.sparkSession
    chosen = sample(docs, labels, label, folds, fold, rows, doc_id, text)
    model = spark.sparkContext.broadcast(fitted(chosen, fit, Workspace(spark, "toxicity")))
    return with_scores(docs, lambda column: model.value(column), doc_id, text, folds, fold)
