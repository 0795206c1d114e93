"""Linear text classifiers on hashed binary features: bounded training samples, sparse scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import arrow_limits, crc_fold, tidy

#: Rows of the fold that no classifier may learn from.
HELD_OUT = 2
#: Bounds of the labelled sample that a classifier is fitted on: documents, and bytes of their features (4 each).
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 256 << 20

#: (weights of features, bias, norm)
Model = tuple[np.ndarray, float, float]
#: A feature function takes (bytes, offsets) of a run of texts and gives the feature numbers and their texts.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct_features(column: pa.Array, features: Features, bits: int) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    seen = np.zeros(1 << bits, np.int64)
    for i, j, raw, at in bv.text_runs(column):
        f, owner = features(raw, at)
        bounds = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            own = f[bounds[k] : bounds[k + 1]]
            place = np.arange(len(own))
            seen[own] = place  # the last of equal features wins
            yield own[seen[own] == place]


def train_on_sample(docs: DataFrame, labels: DataFrame, label: str, features: Features, bits: int, fit: Callable, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """fit(features of texts, labels) on at most `rows` labelled documents outside the held-out fold, picked among
    those of docs in the order of a hash of doc_id, as many as have most_bytes of features. Only 0 and 1 are labels; a
    doc_id labelled twice counts as its larger label, and of texts that share a doc_id one is taken. The sample is
    gathered and fitted by one task on an executor, so that only the weights pass through the driver. None if the sample
    doesn't have both labels: there is nothing to learn.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    y = labels.select("doc_id", F.col(f"`{label}`").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").where(crc_fold() != HELD_OUT)
    y = y.groupBy("doc_id").agg(F.max("y").cast("int").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = [(r.doc_id, r.y) for r in y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]  # at most `rows` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.sort(f).astype(np.uint32).tobytes() for f in distinct_features(batch.column(2), features, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "y", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for i, t, f in zip(*(batch.column(k).to_pylist() for k in range(3))):
                size += len(f)
                if size <= most_bytes:
                    sample.append((i, t, np.frombuffer(f, np.uint32)))
        sample.sort(key=lambda row: row[0])
        weights, bias, norm = fit([f for _, _, f in sample], np.array([t for _, t, _ in sample], float))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64()), pa.array([norm], pa.float64())], names=["weights", "bias", "norm"])

    if len({t for _, t in picked}) < 2:
        return None
    ids = spark.createDataFrame(picked, "doc_id long, y int")
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")  # at most `rows` ids are sent out
    table = chosen.mapInArrow(tidy(extract), "doc_id long, y int, f binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("f").alias("f"))
    model = table.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(tidy(learn), "weights binary, bias double, norm double").first()
    return np.frombuffer(bytes(model.weights), np.float32), model.bias, model.norm


def _score_rows(model, features: Features, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, norm = model.value
        for batch in batches:
            scores = [score(f, weights, bias, norm) for f in distinct_features(batch.column(1), features, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(f: np.ndarray, weights: np.ndarray, bias: float, norm: float) -> float:
    """Logistic score of one text's features, each of value len(f) ** -norm."""
    z = bias + (float(weights[f].sum(dtype=np.float64)) * len(f) ** -norm if len(f) else 0.0)
    return 1 / (1 + np.exp(-z)) if z >= 0 else np.exp(z) / (1 + np.exp(z))


def score_documents(docs: DataFrame, model: Model | None, features: Features, bits: int, cut: float) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= cut). Without a model every score is 0.5."""
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model or (np.zeros(1 << bits, np.float32), 0.0, 0.0))  # 2**bits float32 weights
    scored = docs.select("doc_id", "text").mapInArrow(tidy(_score_rows(sent, features, bits)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_scored(docs: DataFrame, model: Model | None, features: Features, bits: int, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns as they are, whose scores `keep` accepts; all of them without a model."""
    if model is None:
        return docs
    arrow_limits(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, norm = sent.value
        for batch in batches:
            scores = np.array([score(f, weights, bias, norm) for f in distinct_features(batch.column(at), features, bits)])
            yield batch.filter(pa.array(keep(scores).astype(bool)))

    return docs.mapInArrow(tidy(run), docs.schema)
