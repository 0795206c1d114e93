"""Documents that contain passages of a benchmark: a prefix-filtered containment join on word windows.

1. A benchmark item becomes its windows of WINDOW consecutive words (a shorter item is one window). Equal windows are
   one, with a list of the items that own it, so that common short items cost no more than one of them.
2. Words of the benchmark are counted over all documents. The words of a window are ordered by rarity; as a
   window must be contained whole, its necessary prefix is its rarest word alone.
3. A document's words are looked up among these prefix words only. A hit fixes where the window would have
   to start (position bound) and needs the words before and after it (length bound).
4. Survivors are verified on all words of the window, each by a 64-bit hash.

The benchmark is worked on in blocks of at most block_words words, which are sent to all executors; a larger
benchmark takes a scan of the documents per block, and the hits are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import arrow_limits, staged, tidy

WINDOW = 10
#: Words of the benchmark in one block: 8 bytes each for hashes, and about twice as much for windows.
BLOCK_WORDS = 2_000_000
#: Places of a run times windows that are looked at together, and item ids that are put out together.
STEP = 200_000


def _word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = bv.LOWER[raw]
    starts, ends, owner = bv.word_spans(b, at, bv.ALNUM)
    return bv.span_hashes(b, starts, ends), owner


class Windows:
    """The distinct windows of a block of benchmark items, indexed by the rarest word of each.

    Window w has the words flat[first[w] : first[w] + size[w]] and the owners owner[owned[w] : owned[w + 1]].
    """

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int):
        self.items = [i for i, _ in items]
        n = np.array([len(w) for _, w in items], np.int64)
        self.flat = np.concatenate([w for _, w in items]) if len(items) else np.zeros(0, np.uint64)
        size = np.minimum(n, window)
        many = np.where(n > 0, n - size + 1, 0)
        owner = np.repeat(np.arange(len(n)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        first, size = (np.cumsum(n) - n)[owner] + nth, size[owner]
        # Words are compared by their 64-bit hashes, and so are windows.
        key = size.astype(np.uint64)
        for k in range(int(size.max(initial=0))):
            inside = k < size
            key[inside] = bv.mix(key[inside] * np.uint64(0x9E3779B97F4A7C15) + self.flat[first[inside] + k])
        order = np.lexsort((owner, key))
        fresh = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + np.uint64(1)))
        self.first, self.size = first[order[fresh]], size[order[fresh]]
        group = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(order))))
        once = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(owner[order], prepend=-1) != 0))
        self.owner = owner[order][once]
        self.owned = np.searchsorted(group[once], np.arange(len(fresh) + 1))
        self.vocab = np.unique(self.flat)

    def order(self, counts: np.ndarray) -> None:
        """Take each window's rarest word (ties: the earliest place) as its prefix."""
        rarity = counts[np.searchsorted(self.vocab, self.flat)]
        self.lead_place = np.zeros(len(self.size), np.int64)
        least = rarity[self.first] if len(self.size) else self.first
        for k in range(1, int(self.size.max(initial=0))):
            some = np.flatnonzero(k < self.size)
            here = rarity[self.first[some] + k]
            less = here < least[some]
            self.lead_place[some[less]], least[some[less]] = k, here[less]
        lead = self.flat[self.first + self.lead_place]
        self.by_lead = np.argsort(lead, kind="stable")
        self.lead = lead[self.by_lead]

    def hits(self, h: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(document words hit, distinct (text, window) pairs) in a run of texts' words."""
        hit = np.zeros(len(h) + 1, np.int64)
        none = np.zeros((0, 2), np.int64)
        if not len(self.lead) or not len(h):
            return hit[:-1] > 0, none
        left = np.searchsorted(self.lead, h)
        left[left == len(self.lead)] = 0
        at = np.flatnonzero(self.lead[left] == h)
        left = left[at]
        many = np.searchsorted(self.lead, h[at], "right") - left
        n = np.bincount(owner, minlength=texts)
        end = np.cumsum(n)
        begin = end - n
        pairs = []
        # In parts of about STEP places times windows.
        cuts = np.unique(np.searchsorted(np.cumsum(many), np.arange(STEP, int(many.sum()) + STEP, STEP)))
        for part in np.split(np.arange(len(at)), cuts):
            pos = np.repeat(at[part], many[part])
            nth = np.arange(len(pos)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            w = self.by_lead[np.repeat(left[part], many[part]) + nth]
            start = pos - self.lead_place[w]
            text = owner[pos]
            ok = (start >= begin[text]) & (start + self.size[w] <= end[text])
            start, w, text = start[ok], w[ok], text[ok]
            for k in range(int(self.size[w].max(initial=0))):
                ok = (k >= self.size[w]) | (h[np.minimum(start + k, len(h) - 1)] == self.flat[np.minimum(self.first[w] + k, len(self.flat) - 1)])
                start, w, text = start[ok], w[ok], text[ok]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + self.size[w], -1)
            pairs.append(np.unique(np.stack([text, w], axis=1), axis=0))
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else none
        return np.cumsum(hit)[:-1] > 0, found

    def ids(self, windows: np.ndarray) -> list[int]:
        """The sorted distinct ids of the items that own some of these windows; a null id is none."""
        owners = np.unique(np.concatenate([self.owner[self.owned[w] : self.owned[w + 1]] for w in windows.tolist()]))
        return sorted({self.items[k] for k in owners.tolist()} - {None})


def _blocks(bench: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The benchmark's items as word hashes, in blocks of bounded size, streamed to the driver one by one."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for i, j, raw, at in bv.text_runs(batch.column(1)):
                h, owner = _word_hashes(raw, at)
                words += [x.tobytes() for x in np.split(h, np.searchsorted(owner, np.arange(1, j - i)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])

    block, n = [], 0
    for row in bench.select("item_id", "text").where("text IS NOT NULL").mapInArrow(tidy(hashed), "item_id long, words binary").toLocalIterator():
        words = np.frombuffer(bytes(row.words), np.uint64)
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((row.item_id, words))
        n += len(words)
    yield block


def _count_words(vocab):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        total = np.zeros(len(v), np.int64)
        for batch in batches:
            for _, _, raw, at in bv.text_runs(batch.column(0)):
                h, _ = _word_hashes(raw, at)
                if not len(v):
                    continue
                place = np.searchsorted(v, h)
                place[place == len(v)] = 0
                total += np.bincount(place[v[place] == h], minlength=len(v))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    return run


def _found(w: Windows, batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, which of them are hit, windows that occur) of each text of a batch."""
    for i, j, raw, offsets in bv.text_runs(batch.column(at)):
        h, owner = _word_hashes(raw, offsets)
        hit, pairs = w.hits(h, owner, j - i)
        first = np.searchsorted(owner, np.arange(j - i + 1))
        mine = np.searchsorted(pairs[:, 0], np.arange(j - i + 1))
        for k in range(j - i):
            yield int(first[k + 1] - first[k]), hit[first[k] : first[k + 1]], pairs[mine[k] : mine[k + 1], 1]


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def _answer_rows(index):
    """The answers where one block holds the whole benchmark; texts with the windows of the one before share its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = index.value
        none = _digest([])
        for batch in batches:
            words, hits, counts, shas = [], [], [], []
            last, n_last, sha_last = None, 0, none
            for n, hit, own in _found(w, batch, 1):
                words.append(n)
                hits.append(int(hit.sum()))
                if len(own) and (key := own.tobytes()) != last:
                    ids = w.ids(own)
                    last, n_last, sha_last = key, len(ids), _digest(ids)
                counts.append(n_last if len(own) else 0)
                shas.append(sha_last if len(own) else none)
            yield _answers(batch.column(0), pa.array(words, pa.int64()), hits, counts, shas)

    return run


def _answers(doc_id: pa.Array, n_words: pa.Array, hits: list[int], counts: list[int], shas: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, n_words, pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array([x > 0 for x in hits], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _hit_rows(index):
    """Per text: the stretches of words hit and the items found in this block of the benchmark."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = index.value
        for batch in batches:
            n_words, spans, items, held, done = [], [], [], 0, 0

            def flush() -> pa.RecordBatch:
                nonlocal n_words, spans, items, held, done
                part = batch.slice(done, len(n_words))  # noqa: B023
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])
                done += len(n_words)
                n_words, spans, items, held = [], [], [], 0
                return out

            for n, hit, own in _found(w, batch, 1):
                n_words.append(n)
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                items.append(w.ids(own) if len(own) else [])
                held += len(items[-1])
                if held > STEP:
                    yield flush()
            if n_words:
                yield flush()

    return run


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, shas, counts = [], [], []
        for spans, items in zip(batch.column(2), batch.column(3)):
            n = reach = 0
            for s in sorted((s["start"], s["end"]) for part in spans.as_py() for s in part):
                n += max(0, s[1] - max(s[0], reach))
                reach = max(reach, s[1])
            ids = list({i for part in items.as_py() for i in part})
            hits.append(n)
            counts.append(len(ids))
            shas.append(_digest(ids))
        yield _answers(batch.column(0), batch.column(1), hits, counts, shas)


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _indexes(docs: DataFrame, bench: DataFrame, window: int, block_words: int) -> Iterator:
    """A broadcast index for each block of the benchmark, its words counted over all documents."""
    spark = docs.sparkSession
    for block in _blocks(bench, block_words):
        index = Windows(block, window)
        vocab = spark.sparkContext.broadcast(index.vocab)
        # At most one row per word of the block: its size is bounded by block_words.
        seen = docs.select("text").mapInArrow(tidy(_count_words(vocab)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(index.vocab), np.int64)
        counts[seen.column("place").to_numpy()] = seen.column("n").to_numpy()
        index.order(counts)
        yield spark.sparkContext.broadcast(index)


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside any occurrence of a benchmark window), n_items (items
    with occurring windows), items_sha256 (of their ids), contaminated (n_hit > 0).

    docs needs doc_id and text, bench item_id and text; other columns are ignored. A null text has no words; an
    item with a null text or without words has no windows; windows of an item with a null id hit words, but the
    item isn't counted. Rows that repeat an item_id are one item. An empty benchmark leaves every count at 0; an empty
    docs gives an empty result. Rows that repeat are answered alike; a very long text is looked at whole.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    indexes = list(_indexes(docs, bench, window, block_words))
    if len(indexes) == 1:
        return rows.mapInArrow(tidy(_answer_rows(indexes[0])), _OUT)
    parts = [rows.mapInArrow(tidy(_hit_rows(i)), "doc_id long, text_hash long, n_words long, spans array<struct<start:long,end:long>>, items array<long>") for i in indexes]
    # One row per block: at most as many per text as there are blocks.
    every = [staged(p, "hits") for p in parts]
    some = every[0].where("size(spans) > 0")
    for p in every[1:]:
        some = some.unionByName(p.where("size(spans) > 0"))
    per_text = some.groupBy("doc_id", "text_hash").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    base = every[0].select("doc_id", "text_hash", "n_words")
    joined = base.join(per_text, [base.doc_id.eqNullSafe(per_text.doc_id), base.text_hash == per_text.text_hash], "left")
    empty = F.expr("array()")
    return joined.select(base.doc_id, "n_words", F.coalesce("spans", empty.cast("array<array<struct<start:long,end:long>>>")).alias("spans"), F.coalesce("items", empty.cast("array<array<long>>")).alias("items")).mapInArrow(tidy(_merge_rows), _OUT)


def _clean_rows(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = index.value
        for batch in batches:
            yield batch.filter(pa.array([not len(own) for _, _, own in _found(w, batch, at)], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns as they are, in which no benchmark window occurs. Null texts stay; equal rows stay
    or go together; an empty benchmark drops nothing."""
    arrow_limits(docs.sparkSession)
    indexes = list(_indexes(docs, bench, window, block_words))
    out = docs
    for k, index in enumerate(indexes):
        out = out.mapInArrow(tidy(_clean_rows(index, docs.columns.index("text"))), docs.schema)
        if k < len(indexes) - 1:
            out = staged(out, "clean")  # a worker holds one block of the benchmark at a time
    return out
