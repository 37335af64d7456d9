"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features describe the line and its neighbours; a transition
weight for each pair of labels ties a line to the line before. Only documents are labelled, so the lines' own
labels are estimated first: every line of a good document is good, a bad one holds at least one bad line, and
which ones is settled by alternating between a line's own probability and a refit (multiple-instance
learning). Training then maximises the conditional likelihood of those line labels. Scoring computes the
forward-backward marginals of every line, weighs them by line length and maps their mean to a probability by
a logistic curve fitted on the same training documents.
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
TRAIN_ROWS = 1_500
OWN = 12
#: Rounds of settling the lines' labels, at most.
SETTLING = 10
#: Own features, those of the line before and after, a bias and two marks for the first and last line.
FEATURES = 3 * OWN + 3
_UPPER, _LOWER_ = tb.byte_class((65, 90)), tb.byte_class((97, 122), (0x80, 0xFF))
_DIGIT, _SPACE = tb.byte_class((48, 57)), ~tb.NON_SPACE
_SYMBOL = tb.byte_class((0x21, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, byte length, first line of each text and the total). Lines end at LF; an empty text has one empty line."""
    n = len(offsets) - 1
    ends = np.flatnonzero(data == 10)
    text_of_end = np.searchsorted(offsets, ends, "right") - 1
    last = offsets[1:]
    stop = np.concatenate([ends, last])
    text = np.concatenate([text_of_end, np.arange(n)])
    order = np.lexsort((np.concatenate([np.zeros(len(ends)), np.ones(n)]), stop, text))
    stop, text = stop[order], text[order]
    first = np.searchsorted(text, np.arange(n + 1))
    start = np.empty_like(stop)
    start[1:] = stop[:-1] + 1
    start[first[:-1]] = offsets[:-1]
    length = np.maximum(stop - start, 0)

    def count(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (upto[stop] - upto[start]).astype(np.float64)

    size = np.maximum(length, 1)
    ws, we, _ = tb.word_spans(data, offsets, tb.NON_SPACE & (np.arange(256) != 10))
    line_of = np.searchsorted(start, ws, "right") - 1
    words = np.bincount(line_of, minlength=len(stop)).astype(np.float64)
    letters = np.bincount(line_of, weights=we - ws, minlength=len(stop))
    h = tb.span_hashes(data, ws, we)
    same = np.zeros(len(h), dtype=bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, weights=same, minlength=len(stop))
    pair = np.unique(np.stack([line_of.astype(np.uint64), h]), axis=1)[0].astype(np.int64) if len(h) else np.zeros(0, np.int64)
    distinct = np.bincount(pair, minlength=len(stop))
    edge = np.bincount(line_of, weights=_SYMBOL[data[we - 1]] if len(h) else None, minlength=len(stop)) if len(h) else np.zeros(len(stop))
    some = np.maximum(words, 1)
    own = np.stack(
        [
            count(_UPPER[data]) / size,
            count(_LOWER_[data]) / size,
            count(_DIGIT[data]) / size,
            count(_SYMBOL[data]) / size,
            count(data == 124) / some,
            count(data == 33) / some,
            edge / some,
            repeats / some,
            distinct / some * np.minimum(1, words / 8),
            np.minimum(letters / some, 40) / 10,
            np.log1p(words) / 5,
            (words == 0).astype(np.float64),
        ],
        axis=1,
    )
    x = np.zeros((len(stop), FEATURES))
    x[:, :OWN] = own
    inner = np.ones(len(stop), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    x[at, OWN : 2 * OWN] = own[at - 1]
    x[at - 1, 2 * OWN : 3 * OWN] = own[at]
    x[:, -3] = 1
    x[first[:-1], -2] = 1
    x[first[1:] - 1, -1] = 1
    return x, length, first


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, summed P(label before, label), summed log partition, of chains cut at ``first``.

    score: (lines, 2) emission scores, trans: (2, 2). All chains of a length rank advance together, so the loop
    runs over positions within a text, not over lines.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    head, size = first[:-1][order], size[order]
    alpha, beta = score.copy(), np.zeros_like(score)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest + 1), "left")  # texts with more lines than the position
    for t in range(1, longest):
        at = head[: live[t]] + t
        alpha[at] += np.logaddexp(alpha[at - 1, 0][:, None] + trans[0], alpha[at - 1, 1][:, None] + trans[1])
    for t in range(longest - 1, 0, -1):
        at = head[: live[t]] + t
        w = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(trans[:, 0] + w[:, :1], trans[:, 1] + w[:, 1:])
    z = np.logaddexp(alpha[first[1:] - 1, 0], alpha[first[1:] - 1, 1])
    zl = np.repeat(z, np.diff(first))
    p = np.exp(alpha + beta - zl[:, None])
    inner = np.ones(len(score), dtype=bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    both = alpha[at - 1][:, :, None] + trans[None] + (score[at] + beta[at])[:, None, :] - zl[at][:, None, None]
    return p[:, 1], np.exp(both).sum(axis=0), float(z.sum())


class LineField:
    """The fitted model: emission weights for bad and good, transitions, and the curve of the document score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, curve: tuple[float, float]):
        self.weights, self.trans, self.curve = weights, trans, curve

    def means(self, column: pa.Array) -> np.ndarray:
        """Length-weighted mean of the lines' P(good)."""
        out = []
        data, offsets = tb.utf8(column)
        for _, _, part, at in tb.runs(data, offsets):
            x, length, first = line_features(part, at)
            good = marginals(x @ self.weights, self.trans, first)[0]
            w = length + 1e-9
            upto = np.concatenate([[0], np.cumsum(good * w)])
            mass = np.concatenate([[0], np.cumsum(w)])
            out.append((upto[first[1:]] - upto[first[:-1]]) / (mass[first[1:]] - mass[first[:-1]]))
        return np.concatenate(out) if out else np.zeros(0)

    def __call__(self, column: pa.Array) -> np.ndarray:
        m = np.clip(self.means(column), 1e-6, 1 - 1e-6)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.log(m / (1 - m)) + b)))


def settle_lines(own: np.ndarray, first: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Labels of the lines (1 good) from the features of each line alone and the labels of the documents.

    Lines of good documents are good. Of a bad document the lines that the last fit takes for bad are bad, and the
    likeliest one in any case; the first fit takes all of them. Ends when no label changes.
    """
    x = np.concatenate([own, np.ones((len(own), 1))], axis=1)
    document = np.repeat(np.arange(len(y)), np.diff(first))
    free = y[document] == 0
    gold = y[document].copy()
    per, v = 1.0 / len(first), np.zeros(x.shape[1])
    for _ in range(SETTLING):

        def loss(v, gold=gold):
            s = x @ v
            p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            return (np.logaddexp(0, s) - gold * s).sum() * per + l2 * per / 2 * (v @ v), x.T @ (p - gold) * per + l2 * per * v

        v = minimise(loss, v, rounds=40)
        s = x @ v
        worst = np.zeros(len(s), dtype=bool)
        worst[np.lexsort((s, document))[first[:-1]]] = True  # the likeliest bad line of every document
        new = np.where(free & ((s < 0) | worst), 0, 1)
        if (new == gold).all():
            break
        gold = new
    return gold


def fit(texts: list[str], labels: list[int], l2: float = 1.0) -> LineField:
    """Fit on texts with labels 0 and 1. With one class only (or none) the model says that class (or one half)."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        b = 0.0 if not labels else (4.0 if labels[0] else -4.0)
        return LineField(np.zeros((FEATURES, 2)), np.zeros((2, 2)), (0.0, b))
    column = pa.array(texts, pa.large_string())
    parts = [line_features(part, at) for _, _, part, at in tb.runs(*tb.utf8(column))]
    x = np.concatenate([p[0] for p in parts])
    lines = np.concatenate([np.diff(p[2]) for p in parts])
    first = np.concatenate([[0], np.cumsum(lines)])
    del parts
    gold = settle_lines(x[:, :OWN], first, y)
    inner = np.flatnonzero(np.diff(np.repeat(np.arange(len(y)), lines), prepend=-1) == 0)
    steps = np.bincount(2 * gold[inner - 1] + gold[inner], minlength=4).reshape(2, 2).astype(np.float64)
    per = 1.0 / len(first)

    def loss(v):
        w, t = np.stack([np.zeros(FEATURES), v[:FEATURES]], axis=1), v[FEATURES:].reshape(2, 2)
        s = x @ w
        good, pairs, z = marginals(s, t, first)
        value = (z - s[np.arange(len(s)), gold].sum() - (steps * t).sum()) * per + l2 * per / 2 * (v @ v)
        g = np.concatenate([x.T @ (good - gold), (pairs - steps).ravel()]) * per + l2 * per * v
        return value, g

    v = minimise(loss, np.zeros(FEATURES + 4), rounds=60)
    model = LineField(np.stack([np.zeros(FEATURES), v[:FEATURES]], axis=1), v[FEATURES:].reshape(2, 2), (1.0, 0.0))
    m = np.clip(model.means(column), 1e-6, 1 - 1e-6)
    m = np.log(m / (1 - m))
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    def curve(c):
        p = 1 / (1 + np.exp(-(c[0] * m + c[1])))
        e = weight * (p - y)
        return -(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() + 1e-3 * (c @ c), np.array([e @ m, e.sum()]) + 2e-3 * c

    c = minimise(curve, np.array([1.0, 0.0]))
    model.curve = float(c[0]), float(c[1])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted.

    Labels of rows whose crc32(id as text) mod ``folds`` is ``fold`` are never learnt from; the fit takes at most
    ``rows`` labelled documents of each class. Null and empty texts are one empty line and get its score; every
    row is scored, repeated ones alike. Without labels every score is one half.
    """
    spark = docs.sparkSession
    chosen = sample(docs, labels, label, folds, fold, rows, doc_id, text)
    model = spark.sparkContext.broadcast(fitted(chosen, fit, Workspace(spark, "quality")))
    return with_scores(docs, lambda column: model.value(column), doc_id, text, folds, fold)
