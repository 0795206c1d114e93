"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (A-Z lower-cased). For each feature, the smoothed share
among toxic texts over that among others gives a log-count ratio r. A logistic regression is then fitted on
features of value r instead of 1, and a score is one sparse dot product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import bytesvec as bv
from .linear import SAMPLE_ROWS, Model, keep_scored, score_documents, train_on_sample

BITS = 20
#: n-grams of any place, and n-grams that begin with white space: the beginnings of words.
ANYWHERE, WORD_STARTS = (6,), (9,)
CUT = 0.3


def char_ngrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of code points, text after text."""
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(bv.HEADS[raw], out=heads[1:])
    chars = np.frombuffer(bv.LOWER[raw].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = heads[at]
    h = bv.mix(chars.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    values, owners = [], []
    space = (chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D))
    for n in ANYWHERE + WORD_STARTS:
        places, value = bv.windows(h, owner, n)
        if n in WORD_STARTS:
            begins = space[places]
            places, value = places[begins], value[begins]
        values.append((value >> np.uint64(64 - BITS)).astype(np.uint32))
        owners.append(owner[places])
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return values[order], owners[order]


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.03, decay: float = 1e-4, smooth: float = 1.0) -> Model:
    """(weights of features, bias, norm): naive Bayes ratios times logistic weights fitted by AdaGrad steps.

    rows is used up. Rows pass in a fixed shuffled order. Features of a single row keep weight 0.
    """
    size = 1 << BITS
    p, q = np.full(size, smooth), np.full(size, smooth)
    for f, t in zip(rows, y):
        (p if t else q)[f] += 1
    for k, f in enumerate(rows):  # in place: the sample is the largest thing in memory here
        rows[k] = f[p[f] + q[f] > 2 * smooth + 1]
    n1, n0 = y.sum(), len(y) - y.sum()
    r = np.log(p / (n1 + 2 * smooth)) - np.log(q / (n0 + 2 * smooth))
    w, g2 = np.zeros(size), np.full(size, 1e-3)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    bias, b2 = prior, 1.0
    order = np.random.default_rng(1).permutation(len(y))
    for _ in range(epochs):
        for k in order:
            f = rows[k]
            x = r[f]
            z = bias + float(w[f] @ x)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]
            g = err * x + decay * w[f]
            g2[f] += g * g
            w[f] -= rate * g / np.sqrt(g2[f])
            b2 += err * err
            bias -= rate * err / np.sqrt(b2)
    return (w * r).astype(np.float32), bias, 0.0


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    return train_on_sample(docs, labels, "toxic", char_ngrams, BITS, fit, rows)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= cut).

    docs needs doc_id and text, labels doc_id and toxic; other columns are ignored. The classifier is fitted on
    at most `rows` labelled documents whose crc32(doc_id) mod 4 isn't 2, and scores every whole text. A null
    or empty text gets the bias alone; null labels teach nothing; a null doc_id isn't held out. Rows that
    repeat are scored alike; a very long text is scored whole. Where the sample doesn't have both labels, every score is
    0.5. An empty table gives an empty result.
    """
    return score_documents(docs, train(docs, labels, rows), char_ngrams, BITS, cut)


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they are, with a score below cut; every row where the sample doesn't have both labels,
    as nothing can be learnt from it."""
    return keep_scored(docs, train(docs, labels, rows), char_ngrams, BITS, lambda s: s < cut)
