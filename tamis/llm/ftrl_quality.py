"""Quality: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

A text is the set of its hashed words and word pairs (words split at ASCII white space, as they are written,
so that case and symbols count) and of one feature for any word said three times running. Each feature has the value 1 / sqrt(number of features). Training makes
proximal FTRL steps with per-coordinate rates, L1 and L2 terms; features that never earn more than the L1
term stay exactly 0. A score is a sparse dot product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import bytesvec as bv
from .linear import SAMPLE_ROWS, Model, keep_scored, score_documents, train_on_sample

BITS = 20
CUT = 0.7
NORM = 0.5
_AGAIN = np.uint64(0xF1EA5EED00000001)


def word_ngrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs, text after text."""
    starts, ends, owner = bv.word_spans(raw, at, bv.SPACED)
    h = bv.span_hashes(raw, starts, ends)
    places, pairs = bv.windows(h, owner, 2)
    again = np.flatnonzero((h[2:] == h[1:-1]) & (h[1:-1] == h[:-2]) & (owner[2:] == owner[:-2]))
    values = np.concatenate([bv.mix(h), pairs, bv.mix(np.full(len(again), _AGAIN))])
    owners = np.concatenate([owner, owner[places], owner[again]])
    order = np.argsort(owners, kind="stable")
    return (values[order] >> np.uint64(64 - BITS)).astype(np.uint32), owners[order]


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 15, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.1) -> Model:
    """(weights, bias, norm) by FTRL-proximal steps over the rows in a fixed shuffled order; the bias isn't penalised.

   
    """
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)

    def weights(zf: np.ndarray, nf: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zf) <= l1, 0.0, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(nf)) / alpha + l2))

    bias, b2 = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 1.0
    order = np.random.default_rng(2).permutation(len(y))
    for _ in range(epochs):
        for k in order:
            f = rows[k]
            x = len(f) ** -NORM if len(f) else 0.0
            zf, nf = z[f], n[f]
            w = weights(zf, nf)
            err = 1 / (1 + np.exp(-np.clip(bias + x * w.sum(), -30, 30))) - y[k]
            g = err * x
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
            b2 += err * err
            bias -= 0.1 * err / np.sqrt(b2)
    return weights(z, n).astype(np.float32), bias, NORM


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    return train_on_sample(docs, labels, "quality", word_ngrams, BITS, fit, rows)


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: better), predicted (1 if score >= cut).

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. The classifier is fitted on
    at most `rows` labelled documents whose crc32(doc_id) mod 4 isn't 2, and scores every whole text. A null
    or empty text gets the bias alone; null labels teach nothing; a null doc_id isn't held out. Rows that
    repeat are scored alike; a very long text is scored whole. Where the sample doesn't have both labels, every score is
    0.5. An empty table gives an empty result.
    """
    return score_documents(docs, train(docs, labels, rows), word_ngrams, BITS, cut)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they are, with a score of at least cut; every row where the sample doesn't have both labels,
    as nothing can be learnt from it."""
    return keep_scored(docs, train(docs, labels, rows), word_ngrams, BITS, lambda s: s >= cut)
