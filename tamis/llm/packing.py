"""Packing of token sequences along a space-filling curve.

1. A text is tokenised (each distinct piece of it once per task); its token counts, hashed into COORDINATES buckets, are its vector. Random directions
   project the vector to DIMS numbers, and the Hilbert key of that point is the document's place on the curve.
2. The encoded documents are written once and range-sorted by (key, doc_id): documents of one key (copies)
   spread over partitions by their ids, so no key is a hot spot.
3. Every partition is streamed in order and cut into sequences of LENGTH ids; documents are cut where a
   sequence is full. The rest of a partition, shorter than a sequence, is cut into powers of two, which need
   no padding. So no sequence holds padding, and neighbours on the curve share sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bytesvec as bv
from .common import arrow_limits, staged, tidy

LENGTH = 2048
END_ID = 1
COORDINATES = 256
DIMS, BITS = 3, 16
#: Texts are encoded in runs of about so many bytes; the more, the fewer distinct pieces per word.
RUN_BYTES = 2 << 20
#: Distinct pieces of text whose ids a task remembers.
CACHE_PIECES = 800_000

#: Ids in one row of the encoded table: longer documents are several rows, so that rows are of like sizes.
CHUNK_IDS = 4096

# The form of tokenizer files whose texts may be encoded piece by piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_DIRECTIONS = np.random.default_rng(5).normal(size=(COORDINATES, DIMS))
_encoders: dict[str, "Encoder"] = {}


def _classes() -> np.ndarray:
    c = np.full(256, 3, np.uint8)  # 3: symbols
    c[[0x20, *range(0x09, 0x0E)]] = 0
    c[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
    c[0x30:0x3A] = 2
    return c


_CLASS = _classes()


class Encoder:
    """Token ids of texts by a tokenizer that takes white space for a separator and splits runs of letters, single
    digits and runs of symbols before its merges. Such a piece is encoded once and remembered.

    Space-separated chunks that hold anything less plain (apostrophes, letters beyond U+00FF, combining or other
    marks, what may be a special token) are pieces as a whole, so that the tokenizer itself decides on them. A tokenizer
    of another form (its file's normalizer or pre_tokenizer differs) gets every text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.by_pieces = (form.get("normalizer"), form.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER)
        self.last = np.zeros(self.tok.get_vocab_size(), bool)  # ids that end a piece
        for token, k in self.tok.get_vocab().items():
            self.last[k] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _remember(self, keys: list[int], ids: list[np.ndarray] | np.ndarray, sizes: np.ndarray) -> None:
        flat = ids if isinstance(ids, np.ndarray) else np.concatenate([*ids, np.zeros(0, self.kind)])
        n, total = len(self.known), self.used + len(flat)
        while total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(keys) > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.pool[self.used : total] = flat
        self.at[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.known.update(zip(keys, range(n, n + len(keys))))
        self.used = total

    def _learn(self, keys: list[int], pieces: list[bytes], plain: list[bool]) -> None:
        own = [k for k, x in zip(keys, plain) if x]
        if own:
            text = b" ".join([p for p, x in zip(pieces, plain) if x]).decode()
            ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                self._remember(own, ids, np.diff(ends, prepend=0))
            else:  # not a tokenizer of the expected kind
                plain = [False] * len(keys)
        rest = [(k, p.decode()) for k, p, x in zip(keys, pieces, plain) if not x]
        if rest:
            ids = [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast([p for _, p in rest], add_special_tokens=False)]
            self._remember([k for k, _ in rest], ids, np.array([len(x) for x in ids], np.int64))

    def encode_run(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a run."""
        if not self.by_pieces:
            texts = [raw[s:e].tobytes().decode() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            return [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        starts, ends, plain = pieces(raw, at)
        if not len(starts):
            return [np.zeros(0, self.kind)] * (len(at) - 1)
        owner = np.searchsorted(at, starts, "right") - 1
        b = bv.LOWER[raw]
        odd = np.repeat(~plain, ends - starts)
        if odd.any():  # special tokens are told by case
            inside = np.arange(int((ends - starts).sum())) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + np.repeat(starts, ends - starts)
            b[inside[odd]] = raw[inside[odd]]
        h = bv.span_hashes(b, starts, ends)
        inverse, unique = pd.factorize(h)
        first = np.empty(len(unique), np.int64)
        first[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
        if len(self.known) + len(unique) > CACHE_PIECES:
            self.clear()
        keys = unique.tolist()
        number = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0).tolist()
        for part in (new[k : k + 20_000] for k in range(0, len(new), 20_000)):
            f = first[part]
            self._learn([keys[k] for k in part], [raw[s:e].tobytes() for s, e in zip(starts[f].tolist(), ends[f].tolist())], plain[f].tolist())
        number[new] = [self.known[keys[k]] for k in new]
        place = number[inverse]
        size = self.size[place].astype(np.int64)
        total = np.cumsum(size)
        ids = self.pool[np.arange(int(total[-1])) + np.repeat(self.at[place] - (total - size), size)]
        cut = np.concatenate([[0], total])[np.searchsorted(owner, np.arange(len(at)))]
        return [ids[cut[k] : cut[k + 1]] for k in range(len(at) - 1)]


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and plainness of the pieces of a run of texts."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    n = len(raw)
    kind = _CLASS[raw]
    after = np.append(raw[1:], 0)
    # Letters from U+00C0 to U+00FF are plain: 0xC3 and a second byte other than those of the two signs there.
    lead = (raw == 0xC3) & (after != 0x97) & (after != 0xB7)
    second = np.append(False, lead[:-1])
    odd = (raw == 0x27) | ((raw >= 0x80) & ~lead & ~second) | ((raw == 0x3C) & (after == 0x7C))
    chunk_starts, chunk_ends, _ = bv.word_spans(raw, at, bv.SPACED)
    if not len(chunk_starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    inside = np.zeros(n, bool)
    if odd.any():
        total = np.zeros(n + 1, np.int32)
        np.cumsum(odd, out=total[1:])
        whole = total[chunk_ends] > total[chunk_starts]
        for s, e in zip(chunk_starts[whole].tolist(), chunk_ends[whole].tolist()):
            inside[s:e] = True
    first = np.zeros(n + 1, bool)
    first[chunk_starts] = True
    change = (kind != np.append(0, kind[:-1])) | (kind == 2)
    start = (kind > 0) & (first[:-1] | (change & ~inside))
    last = np.zeros(n + 1, bool)
    last[chunk_ends] = True
    last[:n] |= start & ~first[:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last)
    return starts, ends, ~inside[starts]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates below 2**bits (the transposed-bits construction)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work: from the highest bit down, invert or exchange the lower bits
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray encode
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Place of each document on the curve."""
    points = np.zeros((len(ids), DIMS), np.int64)
    for k, v in enumerate(ids):
        if len(v):
            # Multiplicative hashing of ids into coordinates; counts are damped and normalised.
            c = np.log1p(np.bincount((v.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=COORDINATES))
            z = c @ _DIRECTIONS / np.sqrt((c * c).sum())
            points[k] = np.clip((z + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(points)


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = [x for _, _, raw, at in bv.text_runs(batch.column(1), RUN_BYTES) for x in tok.encode_run(raw, at)]
            keys = curve_keys(ids)
            docs, places, sizes, starts, chunks = [], [], [], [], []
            for doc, key, v in zip(batch.column(0).to_pylist(), keys.tolist(), ids):
                v = np.append(v, np.array([END_ID], v.dtype))
                for k in range(0, len(v), CHUNK_IDS):
                    docs.append(doc)
                    places.append(key)
                    sizes.append(len(v))
                    starts.append(k)
                    chunks.append(v[k : k + CHUNK_IDS].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (docs, places, sizes, starts)), pa.array(chunks, pa.binary())],
                names=["doc_id", "curve_key", "doc_tokens", "start", "ids"],
            )
        tok.clear()

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """Cuts a stream of documents into sequences."""

    def __init__(self, partition: int, length: int):
        self.length, self.sequence, self.fill = length, partition << 33, 0
        self.open: list[tuple] = []  # pieces of the sequence that isn't full yet: doc_id, start, ids, doc_tokens
        self.done: list[tuple] = []

    def add(self, doc_id, doc_tokens: int, start: int, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while at < n:
            take = min(n - at, self.length - self.fill)
            self.open.append((doc_id, start + at, ids[at : at + take], doc_tokens))
            self.fill += take
            at += take
            if self.fill == self.length:
                self._close()

    def _close(self) -> None:
        offset = 0
        for doc_id, start, ids, n in self.open:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.open, self.fill = [], 0
        self.sequence += 1

    def finish(self) -> None:
        """Cut what is left into sequences of powers of two."""
        rest, left = self.open, self.fill
        self.open, self.fill = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc_id, start, ids, n = rest.pop(0)
                take = min(room, len(ids))
                self.open.append((doc_id, start, ids[:take], n))
                room -= take
                if take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[take:], n))
            self._close()

    def batch(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        columns = list(zip(*rows)) if rows else [[]] * 7
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _pack_rows(length: int, wide: bool):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), length)
        for batch in batches:
            for doc_id, n, start, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                packer.add(doc_id, n, start, np.frombuffer(ids, kind))
                if len(packer.done) >= 5000:
                    yield packer.batch()
        packer.finish()
        if packer.done:
            yield packer.batch()

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pack the documents' token ids into sequences; one row per piece (see PIECES).

    docs needs doc_id and text; other columns are ignored, whatever their names. path: the tokenizer's file,
    present on every executor. A null or empty text is the id END_ID alone. Each row is a document of its own,
    so repeated rows are packed as often as they occur, and null doc_ids stay null. Very long documents span
    as many sequences as they need. An empty table gives no pieces. sequence_id is unique, not gapless.
    """
    arrow_limits(docs.sparkSession)
    wide = encoder(path).kind is np.uint32
    encoded = docs.select("doc_id", "text").mapInArrow(tidy(_encode_rows(path)), "doc_id long, curve_key long, doc_tokens long, start long, ids binary")
    encoded = staged(encoded, "encoded")
    order = ["curve_key", "doc_id", "doc_tokens", "start"]
    along = encoded.repartitionByRange(*order).sortWithinPartitions(*order)
    return along.select("doc_id", "doc_tokens", "start", "ids").mapInArrow(tidy(_pack_rows(length, wide)), PIECES)
