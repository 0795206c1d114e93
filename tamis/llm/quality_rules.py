"""Quality rules by distribution divergence.

A text's characters fall into a few classes and its words into a list of common words of some languages.
Both histograms are compared with references by the Jensen-Shannon distance (base 2, so 0 to 1). The
references are the summed histograms of all documents of a language, so every language's is made from the
whole table. A text is judged by its nearest reference, whatever its own language column says, and only if it is
long enough for a histogram to mean something.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import arrow_limits, staged, tidy

# Common function words of the reference languages.
COMMON_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu den auf für im sich des dem auch es",
    "en": "the of and to in is that it for was on are as with be by this at from or",
    "es": "de la el que en y los del se las por un con no una su para es al lo",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec",
}

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Shorter texts are not judged by the method.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: A text of n words fails when it is farther than base + slack / sqrt(n) from its reference: histograms of few
#: words scatter more.
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.235, 0.5
MAX_WORD_DISTANCE, WORD_SLACK = 0.12, 2.0

#: Marks that end words and sentences; one may follow a common word.
STOP = ".,;:!?'\"()-"

_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "beyond")
_N = len(CLASSES) + len(_WORDS) + 1


def _class_table() -> np.ndarray:
    t = np.full(256, 5, np.int64)
    t[0x61:0x7B] = 0
    t[0x41:0x5B] = 1
    t[0x30:0x3A] = 2
    t[[0x20, *range(0x09, 0x0E)]] = 3
    t[[ord(c) for c in STOP]] = 4
    t[0x80:] = 6
    return t


_CLASS = _class_table()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _word_hash_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common words, alone and with a mark that may follow, and their numbers."""
    keys, numbers = [], []
    for k, w in enumerate(_WORDS):
        for tail in ["", *STOP]:
            b = np.frombuffer((w + tail).encode(), np.uint8)
            keys.append(bv.span_hashes(b, np.array([0]), np.array([len(b)]))[0])
            numbers.append(k)
    order = np.argsort(np.array(keys, np.uint64))
    return np.array(keys, np.uint64)[order], np.array(numbers)[order]


_KEYS, _NUMBERS = _word_hash_table()


def _run_measures(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base measures (texts, 5), histograms (texts, classes + words + rest)) of a run."""
    n = len(at) - 1
    starts, ends, owner = bv.word_spans(raw, at, bv.SPACED)
    heads = bv.HEADS[raw]
    base = np.zeros((n, 5), np.int64)
    base[:, 0] = np.bincount(owner, minlength=n)
    base[:, 1] = bv.per_text(heads & bv.SPACED[raw], at)
    base[:, 2] = bv.per_text(_SYMBOL[raw], at)

    # Lines with a word that equal an earlier line: all such lines less the distinct ones.
    ls, le, lo = bv.line_spans(raw, at)
    inside = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(bv.SPACED[raw], out=inside[1:])
    some = inside[le] > inside[ls]
    ls, le, lo = ls[some], le[some], lo[some]
    key = bv.mix(bv.span_hashes(raw, ls, le) + lo.astype(np.uint64) * bv.PLACE[60])
    _, first = np.unique(key, return_index=True)
    base[:, 3] = np.bincount(lo, minlength=n) - np.bincount(lo[first], minlength=n)

    # Words inside 3-word windows that occur more than once in their text.
    h = bv.span_hashes(raw, starts, ends)
    places, grams = bv.windows(h, owner, 3)
    if len(places):
        key = bv.mix(grams + owner[places].astype(np.uint64) * bv.PLACE[61])
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = places[counts[inverse] > 1]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[again + k] = True
        base[:, 4] = np.bincount(owner[covered], minlength=n)

    hist = np.zeros((n, _N), np.int64)
    text = np.repeat(np.arange(n), np.diff(at))
    c = _CLASS[raw]
    hist[:, : len(CLASSES)] = np.bincount((text * len(CLASSES) + c)[heads], minlength=n * len(CLASSES)).reshape(n, -1)
    low = bv.span_hashes(bv.LOWER[raw], starts, ends)
    place = np.searchsorted(_KEYS, low)
    place[place == len(_KEYS)] = 0
    number = np.where(_KEYS[place] == low, _NUMBERS[place], len(_WORDS))
    hist[:, len(CLASSES) :] = np.bincount(owner * (len(_WORDS) + 1) + number, minlength=n * (len(_WORDS) + 1)).reshape(n, -1)
    return base, hist


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_run_measures(raw, at) for _, _, raw, at in bv.text_runs(batch.column(1))]
        if not parts:
            continue
        base = np.concatenate([p[0] for p in parts])
        hist = np.concatenate([p[1] for p in parts]).astype(np.int32)
        n = len(base)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * _N + 1, _N, dtype=np.int32)), pa.array(hist.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(base[:, k]) for k in range(5)), lists], names=["doc_id", "lang", *_BASE, "hist"])


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) of the rows of p from q; rows without counts: 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)
        d = np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))
    return np.where(total[:, 0] > 0, d, 0.0)


def nearest(hist: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class distance, word distance) of each histogram from the reference that is nearest by their sum."""
    k = len(CLASSES)
    best = np.zeros((2, len(hist)))
    for i, ref in enumerate(references):
        d = np.stack([js_distance(hist[:, :k], ref[:k]), js_distance(hist[:, k:], ref[k:])])
        best = d if i == 0 else np.where(d.sum(axis=0) < best.sum(axis=0), d, best)
    return best[0], best[1]


def _judge_rows(references: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            words, repeated = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 5))
            hist = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, _N).astype(float)
            by_class, by_word = nearest(hist, references)
            failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)
            long = (hist[:, : len(CLASSES)].sum(axis=1) >= GUARD_CHARS) & (words >= GUARD_WORDS) & (len(references) > 0)
            slack = 1 / np.sqrt(np.maximum(words, 1))
            far = long & ((by_class > MAX_CLASS_DISTANCE + CLASS_SLACK * slack) | (by_word > MAX_WORD_DISTANCE + WORD_SLACK * slack))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(failed), pa.array(~failed & ~far), pa.array(by_class), pa.array(by_word)], names=["doc_id", *_BASE, "base_failed", "kept", "class_distance", "word_distance"])

    return run


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance.

    docs needs doc_id, text and lang; other columns are ignored. A null text has no words and fails the base
    rules. A null or unknown lang adds to no reference, and its texts are judged by the nearest one like all
    others. Without any reference (an empty table, no known lang) the base rules alone decide.
    """
    arrow_limits(docs.sparkSession)
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _BASE) + ", hist array<int>"
    measured = staged(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(tidy(_measure_rows), schema), "measures")
    sums = [F.sum(F.col("hist")[k].cast("long")).alias(f"h{k}") for k in range(_N)]
    known = measured.where(F.col("lang").isin(list(COMMON_WORDS)))
    rows = known.groupBy("lang").agg(*sums).orderBy("lang").collect()  # one row per reference language
    references = np.array([[float(r[f"h{k}"]) for k in range(_N)] for r in rows]).reshape(len(rows), _N)
    out = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", base_failed boolean, kept boolean, class_distance double, word_distance double"
    return measured.select("doc_id", *_BASE, "hist").mapInArrow(tidy(_judge_rows(references)), out)
