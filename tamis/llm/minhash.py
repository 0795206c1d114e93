"""Near-duplicate documents by one-permutation MinHash.

1. Every text becomes its set of word shingles. Texts with equal sets form a class at once (a 128-bit
   digest of the set); everything later works on classes, so large groups of copies cost nothing more.
2. A class gets a one-permutation MinHash signature: shingle hashes fall into BINS bins by their leading
   bits, the smallest in a bin is its value, and an empty bin borrows from a bin drawn by a hash of its own
   number and the attempt (optimal densification).
3. Bands of the signature give bucket keys. A bucket ties its members to its smallest class only (a star:
   n - 1 edges, never all pairs). Connected components of the stars are candidate groups: any two classes
   that share a bucket are in the same group.
4. Inside a group, similarities are counted exactly on full shingle sets. A group of more than one block (of
   bounded shingles and members) first has all its members compared with one hub, in a single pass; those linked to it
   are one component and are not compared with each other. Every pair of blocks that is left is a task of its own, so
   no group has to fit one task. Of the links found, a task returns a spanning forest, not all pairs.
5. Components of these links are the answer.

Only texts of candidate classes move, one for each class: a key filter of bounded size drops the others where they are
read. They are written once, with their group, and read from there by all that follows. Where the filter is full (above
some 10 million candidates), more texts take part in that one shuffle; the rows stay the same.

With 32 bands of 6 rows a pair of similarity 0.85 shares no bucket with probability 3e-7 (0.8: 6e-5).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import arrow_limits, components, key_filter, maybe_in, staged, tidy, unstage

BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Shingles and members in one block of a candidate group; a task holds two blocks.
BLOCK_SHINGLES = 500_000
BLOCK_ROWS = 256

_TRIES = 4096
_draw = np.random.default_rng(77)
#: _DONOR[i, t]: the bin that empty bin i asks at attempt t.
_DONOR = _draw.integers(0, BINS, (BINS, _TRIES), dtype=np.uint8)
_BAND = _draw.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words split at ASCII white space, A-Z lower-cased.

    A text with fewer words than a shingle has its whole sequence as the only one; without words it has none.
    """
    for i, j, raw, at in bv.text_runs(column):
        b = bv.LOWER[raw]
        starts, ends, owner = bv.word_spans(b, at, bv.SPACED)
        h = bv.span_hashes(b, starts, ends)
        places, value = bv.windows(h, owner, size)
        cut = np.searchsorted(owner[places], np.arange(j - i + 1))
        first = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            if cut[k] < cut[k + 1]:
                yield np.unique(value[cut[k] : cut[k + 1]])
            elif first[k] < first[k + 1]:
                own = h[first[k] : first[k + 1]]
                yield bv.mix((own * bv.PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty set, densified."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[bins[first]] = shingles[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    reach = 32
    while len(empty):
        hit = full[_DONOR[empty, :reach]]
        found = hit.any(axis=1)
        out[empty[found]] = out[_DONOR[empty[found], hit[found].argmax(axis=1)]]
        empty = empty[~found]
        if reach == _TRIES and len(empty):  # not met in practice: 4096 draws from 192 bins miss one with 5e-10
            out[empty] = shingles[0]
            break
        reach = min(_TRIES, reach * 16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys (texts, BANDS) of signatures (texts, BINS); the band's number is part of the key."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    return bv.mix((rows * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _SALT)


def _digest_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, low, high, sigs, none = [], [], [], [], np.zeros(BINS, np.uint64)
            for s in shingle_sets(batch.column(1), size):
                counts.append(len(s))
                low.append(int(bv.mix(s).sum(dtype=np.uint64)))
                high.append(int(bv.mix(s ^ _SALT).sum(dtype=np.uint64)))
                sigs.append(signature(s) if len(s) else none)
            if not counts:
                continue
            keys = band_keys(np.stack(sigs)).view(np.int64)
            keys[np.array(counts) == 0] = 0
            n = len(counts)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), as_long(low), as_long(high), bands], names=["doc_id", "text_hash", "n_shingles", "low", "high", "bands"])

    return run


class _Forest:
    """Union-find over 0..n-1 with smallest roots."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def exact_links(sets: list[np.ndarray], percent: int, split: int | None = None, part: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union.

    split: only pairs across that place are compared (two blocks); None: all pairs of the list.
    Intersections are exact counts: set memberships of the shingles that occur more than once are a 0/1
    matrix, and a product of two slices of it holds the counts of part x part pairs.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    same = np.flatnonzero(np.diff(flat[order]) == 0)
    shared = np.zeros(len(flat), bool)
    shared[order[same]] = shared[order[same + 1]] = True
    del order, same
    flat, owner = flat[shared], owner[shared]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    forest, found = _Forest(n), []

    def slices(lo: int, hi: int) -> list[tuple[int, int]]:
        return [(k, min(k + part, hi)) for k in range(lo, hi, part)]

    if split is None:
        blocks = slices(0, n)
        todo = [(x, y) for i, x in enumerate(blocks) for y in blocks[i:]]
    else:
        todo = [(x, y) for x in slices(0, split) for y in slices(split, n)]
    for x, y in todo:
        # Slices that are one component already have nothing to add.
        roots = {forest.find(k) for k in (*range(*x), *range(*y))}
        if len(roots) == 1 and x != y:
            continue
        a, b = flat[bounds[x[0]] : bounds[x[1]]], flat[bounds[y[0]] : bounds[y[1]]]
        oa, ob = owner[bounds[x[0]] : bounds[x[1]]] - x[0], owner[bounds[y[0]] : bounds[y[1]]] - y[0]
        vocab = np.intersect1d(a, b) if x != y else np.unique(a)
        inter = np.zeros((x[1] - x[0], y[1] - y[0]), np.float32)
        for v in range(0, len(vocab), 8192):  # counts stay below 2**24, so float32 sums are exact
            words = vocab[v : v + 8192]
            left = _members(a, oa, words, inter.shape[0])
            right = left if x == y else _members(b, ob, words, inter.shape[1])
            inter += left @ right.T
        union = size[x[0] : x[1], None] + size[None, y[0] : y[1]] - inter
        close = (100 * inter.astype(np.float64) >= percent * union.astype(np.float64)) & (union > 0)
        for i, j in zip(*np.nonzero(close)):
            i, j = int(i) + x[0], int(j) + y[0]
            if i != j and forest.join(i, j):
                found.append((i, j))
    return found


def _members(flat: np.ndarray, owner: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    place = np.searchsorted(words, flat)
    place[place == len(words)] = 0
    hit = words[place] == flat
    out = np.zeros((n, len(words)), np.float32)
    out[owner[hit], place[hit]] = 1
    return out


def _link_rows(size: int, percent: int):
    """Rows (task key..., half, node, text), sorted by task: a spanning forest of each task's links."""

    def emit(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: r[0])
        halves = [r[0] for r in rows]
        split = halves.index(1) if halves[0] != halves[-1] else None
        if split is None and rows[0][3]:  # a pair of blocks of which one is empty
            return []
        return [(rows[i][1], rows[j][1]) for i, j in exact_links([r[2] for r in rows], percent, split)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            halves, nodes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out: list[tuple[int, int]] = []
            for key, half, node, s in zip(keys, halves, nodes, shingle_sets(batch.column(5), size)):
                if key != task:
                    if len(rows) > 1:
                        out += emit(rows)
                    task, rows = key, []
                rows.append((half, node, s, key[1] != key[2]))
            if out:
                yield _edges(out)
        if len(rows) > 1 and (out := emit(rows)):
            yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _spoke_rows(size: int, percent: int):
    """Rows (root, hub, hub_text, node, text), sorted by root: the nodes that are linked to their group's hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, hub_set = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            hubs, nodes = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for k, s in enumerate(shingle_sets(batch.column(4), size)):
                r = batch.column(0)[k].as_py()
                if r != root:
                    root, hub_set = r, next(shingle_sets(batch.column(2).slice(k, 1), size))
                n = len(np.intersect1d(s, hub_set, assume_unique=True))
                if nodes[k] != hubs[k] and n and 100 * n >= percent * (len(s) + len(hub_set) - n):
                    out.append((nodes[k], hubs[k]))
            if out:
                yield _edges(out)

    return run


def _spokes(member: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) of large groups' members to their hub: the member that shares most buckets with others."""
    keyed = member.select("root", "node").join(classes.select("node", "bands"), "node").select("root", "node", F.explode("bands").alias("key"))
    held = staged(keyed.groupBy("root", "key").agg(F.count(F.lit(1)).alias("n")), "buckets")
    degree = keyed.join(held, ["root", "key"]).groupBy("root", "node").agg(F.sum("n").alias("degree"))
    best = degree.groupBy("root").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("node"))
    hub = staged(member.join(best, ["root", "node"]).select("root", F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hubs")
    both = member.join(hub, "root").select("root", "hub", "hub_text", "node", "text").sortWithinPartitions("root")
    links = staged(both.mapInArrow(tidy(_spoke_rows(size, percent)), "u long, v long"), "spokes")
    unstage(held, hub)
    return links


def _candidates(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """A staged table (root, node, n_shingles, text): one text of each class that shares a bucket with another class."""
    # Stars: each bucket ties its members to its smallest one. Buckets of one class leave before the join.
    member = classes.select("node", F.explode("bands").alias("key"))
    centre = staged(member.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "centre"), "centres")
    shared = maybe_in(member, ["key"], key_filter(centre, ["key"]))
    stars = shared.join(centre, "key").where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    groups = components(stars)
    chosen = staged(groups.join(classes.select("node", "n_shingles", "first_id", "text_hash"), "node"), "chosen")

    texts = docs.select(F.col("doc_id").alias("first_id"), "text", F.xxhash64("text").alias("text_hash"))
    texts = maybe_in(texts, ["first_id", "text_hash"], key_filter(chosen, ["first_id", "text_hash"]))
    # Rows that repeat doc_id and text are one text.
    texts = texts.groupBy("first_id", "text_hash").agg(F.first("text").alias("text"))
    found = staged(texts.join(chosen, ["first_id", "text_hash"]).select("root", "node", "n_shingles", "text"), "candidates")
    unstage(centre, chosen, groups)
    return found


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Group documents whose word-shingle sets have 100 * intersection >= percent * union, transitively.

    docs needs doc_id and text; other columns are ignored, whatever their names. Returns one row per input
    row: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id (smallest doc_id reachable,
    itself included), kept (doc_id = component_id).

    A null or wordless text has an empty set and is linked with nothing. A row with a null doc_id is linked
    with nothing either: its component_id is null and it is kept. Rows that repeat a doc_id are answered one
    by one, each by its own text. A very long text is one member of its block, whole. An empty table gives an
    empty result.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.mapInArrow(tidy(_digest_rows(size)), "doc_id long, text_hash long, n_shingles long, low long, high long, bands array<long>")
    rows = staged(rows, "signatures")

    # One class per set; its number is a hash of the set's digest. Equal sets have equal bands.
    node = F.xxhash64("low", "high", "n_shingles").alias("node")
    live = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = live.groupBy(node).agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.min_by("bands", "doc_id").alias("bands"))
    classes = staged(classes, "classes")
    cand = _candidates(docs, classes)

    # Groups of more than one block: what is linked to the group's hub needs no comparison among itself.
    total = cand.groupBy("root").agg(F.sum("n_shingles").alias("n"), F.count(F.lit(1)).alias("members"))
    large = staged(total.where((F.col("n") > block_shingles) | (F.col("members") > block_rows)).select("root"), "large")
    spokes = None
    sized = cand.select("root", "node", "n_shingles")
    if large.n_rows:
        spokes = _spokes(cand.join(large, "root", "left_semi"), classes, size, percent)
        core = spokes.select(F.col("u").alias("node")).union(spokes.select(F.col("v").alias("node"))).distinct().withColumn("core", F.lit(True))
        sized = sized.join(core, "node", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    else:
        sized = sized.withColumn("core", F.lit(False))

    # Tasks: one per group, or one per pair of blocks. Blocks 0 to open - 1 hold what isn't core and meet every
    # block, themselves included; the other blocks hold the core and meet only those.
    def share(which: Column) -> Column:
        shingles, members = (F.coalesce(F.sum(F.when(which, x)), F.lit(0)) for x in (F.col("n_shingles"), F.lit(1)))
        return F.greatest(F.ceil(shingles / block_shingles), F.ceil(members / block_rows)).cast("int")

    counts = staged(sized.groupBy("root").agg(share(~F.col("core")).alias("open"), share(F.col("core")).alias("closed")).where("open > 0"), "blocks")
    dealt = sized.join(counts, "root")
    own = F.when(F.col("core"), F.col("closed")).otherwise(F.col("open"))
    dealt = dealt.withColumn("block", (F.pmod(F.xxhash64("node", F.lit(11)), own) + F.when(F.col("core"), F.col("open")).otherwise(0)).cast("int"))
    meets = F.when(F.col("core"), F.col("open")).otherwise(F.col("open") + F.col("closed"))
    place = dealt.select("node", "block", meets.alias("meets"))
    dealt = cand.join(place, "node").select("root", "node", "text", "block", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other"))
    work = dealt.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("half"), "node", "text")
    work = work.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    found = work.mapInArrow(tidy(_link_rows(size, percent)), "u long, v long")
    links = components(found if spokes is None else found.unionByName(spokes))
    unstage(cand, large, counts, *([spokes] if spokes is not None else []))

    first = classes.select("node", "first_id")
    linked = links.join(first, "node")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = linked.join(lowest, "root").select("node", "least_id")
    answer = first.join(named, "node", "left").select("node", F.coalesce("least_id", "first_id").alias("class_id"))
    answer = staged(answer, "answer")  # so that adaptive execution may split the join on a class of many copies
    unstage(classes, links)
    out = live.select("doc_id", "text_hash", "n_shingles", node).join(answer, "node").select("doc_id", "text_hash", "n_shingles", F.col("class_id").alias("component_id"))
    alone = rows.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_per_group(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """docs, all columns as they are, with one document of each near-duplicate group: that of the smallest doc_id.

    Rows with a null doc_id or an empty set stay. Rows that repeat both doc_id and text are one document, of
    which one row stays.
    """
    marks = staged(near_duplicates(docs, percent, size), "marks")
    ids = ["_i", "_h"]
    gone = staged(marks.where("NOT kept").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct(), "gone")
    again = staged(marks.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).count().where("count > 1").select(*ids), "again")
    unstage(marks)
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"))
    # Rows that surely stay never move; only the few that a filter lets through are looked up.
    marked = staged(gone.union(again), "marked")
    filtered = key_filter(marked, ids)
    stay, asked = maybe_in(whole, ids, filtered, outside=True), maybe_in(whole, ids, filtered)
    kept = stay.select("doc").unionByName(asked.join(gone, ids, "left_anti").join(again, ids, "left_anti").select("doc"))
    if again.n_rows:
        kept = kept.unionByName(asked.join(again, ids).groupBy(*ids).agg(F.first("doc").alias("doc")).select("doc"))
    return kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
