"""Repeated lines across documents.

1. Each text gives a row (key hash, doc_id, position) for every line whose key is long enough.
2. Rows are range-partitioned and sorted by (hash, doc_id descending, position), so that every partition is a
   stream of runs. The first document of a run (the largest doc_id) keeps the line; once enough distinct
   documents of a run have passed, the others lose it. Only those few first documents are held back.
3. A run that touches the end of a partition may go on in the next one, so that a hot line is shared by many
   partitions. Its rows leave the stream undecided and are settled by an aggregation per hash (partial sums
   first) and a join.
4. Dropped positions are gathered per document into a compressed bitmap of the lines to keep. Texts don't move
   until a caller applies the bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import arrow_limits, key_filter, maybe_in, staged, tidy

MIN_CHARS = 40
MIN_DOCS = 5

_ROW = "low long, high long, doc_id long, pos int, text_hash long, n_lines int"
_SALT = np.uint64(0xA24BAED4963EE407)


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, raw, at in bv.text_runs(batch.column(1)):
                starts, ends, owner = bv.line_spans(raw, at)
                inside = np.zeros(len(raw) + 1, np.int64)
                b = bv.LOWER[raw]
                # First and last byte that isn't white space, of each line.
                solid = np.flatnonzero(bv.SPACED[b])
                lo = np.searchsorted(solid, starts)
                hi = np.searchsorted(solid, ends)
                np.cumsum(bv.HEADS[b], out=inside[1:])
                some = np.flatnonzero(hi > lo)
                s, e = solid[lo[some]], solid[hi[some] - 1] + 1
                long = inside[e] - inside[s] >= min_chars
                some, s, e = some[long], s[long], e[long]
                low = bv.span_hashes(b, s, e)
                # A second hash of the same bytes, by salted weights of the first and the ends' bytes.
                high = bv.mix(bv.span_hashes(b ^ np.uint8(0x55), s, e) ^ _SALT)
                line = some - np.searchsorted(owner, owner)[some]
                n = np.bincount(owner, minlength=j - i)
                doc = owner[some] + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(ids[doc].astype(np.int64)), pa.array(line.astype(np.int32)), pa.array(hashes[doc].astype(np.int64)), pa.array(n[owner[some]].astype(np.int32))],
                    names=["low", "high", "doc_id", "pos", "text_hash", "n_lines"],
                )

    return run


def _stream(min_docs: int):
    """Sorted rows in, rows (..., state) out; state 1: dropped, 0: undecided. Rows that stay are left out."""

    names = [c.split()[0] for c in _ROW.split(", ")]

    def decide(t: list[np.ndarray], edge_first: bool, edge_last: bool) -> pa.RecordBatch | None:
        low, high, doc = t[0], t[1], t[2]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        docs = np.add.reduceat(other.astype(np.int64), starts)
        drop = (docs[run] >= min_docs) & (doc != doc[starts][run])
        state = np.where(drop, 1, 2).astype(np.int8)
        if edge_first:
            state[run == 0] = 0
        if edge_last:
            state[run == run[-1]] = 0
        out = state < 2
        if not out.any():
            return None
        return pa.RecordBatch.from_arrays([*(pa.array(c[out]) for c in t), pa.array(state[out])], names=[*names, "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last run so far, not known to be whole
        first = True  # the held run is the partition's first
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                t = [np.concatenate(x) for x in zip(held, t)]
            last = (t[0] == t[0][-1]) & (t[1] == t[1][-1])
            cut = int(np.argmax(last)) if last[-1] else len(last)
            if cut:
                done = decide([c[:cut] for c in t], first, False)
                first = False
                if done is not None:
                    yield done
            held = [c[cut:] for c in t]
            if first and len(held[0]) > 10_000:  # a hot run from the partition's start on: undecided anyway
                yield pa.RecordBatch.from_arrays([*(pa.array(c[:-1]) for c in held), pa.array(np.zeros(len(held[0]) - 1, np.int8))], names=[*names, "state"])
                held = [c[-1:] for c in held]
            elif not first and len(held[0]) > 50_000:
                # A hot run that began here and may go on in the next partition: undecided too.
                yield pa.RecordBatch.from_arrays([*(pa.array(c[:-1]) for c in held), pa.array(np.zeros(len(held[0]) - 1, np.int8))], names=[*names, "state"])
                held, first = [c[-1:] for c in held], True
        if held is not None:
            done = decide(held, first, True)
            if done is not None:
                yield done

    return run


def _bitmap_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, bool)
            keep[np.array(gone, np.int64)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep_bitmap"])


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Which lines to keep: (doc_id, text_hash, n_lines, n_dropped, keep_bitmap) per document that loses a line.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least min_chars code
    points in at least min_docs distinct doc_ids are dropped everywhere but in the largest of these doc_ids.
    keep_bitmap is zlib-compressed, most significant bit first. text_hash is xxhash64 of the text, so that rows
    repeating a doc_id are told apart; a doc_id counts once, however often it holds a line. Rows with a null
    doc_id or a null text neither count nor lose lines. An empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    lines = staged(rows.mapInArrow(tidy(_line_rows(min_chars)), _ROW), "lines")
    order = [F.col("low"), F.col("high"), F.col("doc_id").desc(), F.col("pos")]
    along = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    decided = staged(along.mapInArrow(tidy(_stream(min_docs)), _ROW + ", state byte"), "decided")
    open_rows = decided.where("state = 0").drop("state")
    key = ["low", "high"]
    # A document counts once per key: first per (key, document), then per key.
    per_key = open_rows.groupBy(*key, "doc_id").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    per_key = staged(per_key, "hotlines")  # a table of its own, so that adaptive execution may split the join on a hot key
    late = open_rows.join(per_key, key).where("doc_id <> keeper")
    gone = decided.where("state = 1").select("doc_id", "text_hash", "n_lines", "pos").unionByName(late.select("doc_id", "text_hash", "n_lines", "pos"))
    per_doc = gone.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return per_doc.mapInArrow(tidy(_bitmap_rows), "doc_id long, text_hash long, n_lines long, n_dropped long, keep_bitmap binary")


def kept_text(text: str | None, keep_bitmap: bytes | None) -> str:
    """The text without the lines that the bitmap drops; all of it if there is no bitmap."""
    text = text or ""
    if keep_bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8))[: len(lines)]
    return "\n".join(x for x, k in zip(lines, keep) if k)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped, sha = [], [], []
        for text, gone, bitmap in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            n.append((text or "").count("\n") + 1)
            dropped.append(gone or 0)
            sha.append(hashlib.sha256(kept_text(text, bitmap).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' rows as (text, doc: all columns as a struct, n_dropped, keep_bitmap); bitmaps are null where nothing goes.

    Only rows that may have a bitmap, told by a key filter, are shuffled to look theirs up.
    """
    ids = ["_i", "_h"]
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"))
    marks = staged(bitmaps.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "n_dropped", "keep_bitmap"), "bitmaps")
    found = key_filter(marks, ids)
    stay = maybe_in(whole, ids, found, outside=True).select("doc", F.lit(None).cast("long").alias("n_dropped"), F.lit(None).cast("binary").alias("keep_bitmap"))
    return stay.unionByName(maybe_in(whole, ids, found).join(marks, ids, "left").select("doc", "n_dropped", "keep_bitmap"))


def kept_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of docs: doc_id, n_lines (a null or empty text is one empty line), n_dropped, kept_sha256."""
    docs = docs.select("doc_id", "text")
    marked = with_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs))
    return marked.select("doc.doc_id", "doc.text", "n_dropped", "keep_bitmap").mapInArrow(tidy(_digest_rows), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else kept_text(t, m) for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], names=["new_text", "doc"])


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the repeated lines cut out of text, and n_chars (if there is such a column) counted anew."""
    marked = with_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs))
    struct = marked.schema["doc"].dataType.simpleString()
    new = marked.select("doc.text", "keep_bitmap", "doc").mapInArrow(tidy(_kept_rows), f"new_text string, doc {struct}")
    fresh = {"text": F.col("new_text"), "n_chars": F.when(F.col("new_text").isNotNull(), F.length("new_text").cast("long"))}
    return new.select(*(fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
