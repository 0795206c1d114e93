"""Helpers shared by the corpus operators: staged tables, Arrow limits, key filters, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import reach, shared_folder

#: Upper bound for one Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000

#: Upper bound of a key filter: 8 MB to each executor.
FILTER_BITS = 1 << 26


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that very long texts don't pile up in a worker, and let workers
    import this package."""
    reach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, name: str, digest: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors.

    The result's n_rows and, on demand, its digest (a sum of row hashes) are counted by the writing tasks, each once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tamis-{name}-{uuid.uuid4().hex}"
    hashes = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")) if digest else F.lit(None)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), hashes.alias("digest")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at, out.n_rows, out.digest = path, seen.get["n"], seen.get["digest"]
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no plan reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def key_filter(keys: DataFrame, columns: list[str], most_bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of the rows of keys (a staged table): one row with an array of 64-bit words.

    16 bits a key, but never more than most_bits, so what is broadcast is bounded whatever the number of keys; beyond
    the bound the filter lets more rows through, and the join behind it does the work. Null keys are not in it.
    """
    spark = keys.sparkSession
    bits = min(most_bits, 1 << max(10, (16 * keys.n_rows).bit_length()))
    places = keys.select(*columns).dropna().select(F.explode(F.array(*_places([F.col(c) for c in columns], F.lit(bits)))).alias("p"))
    words = places.select(F.shiftright("p", 6).alias("word"), _bit(F.col("p")).alias("bit"))
    every = words.union(spark.range(bits >> 6).select("id", F.lit(0).cast("long")))
    dense = every.groupBy("word").agg(F.bit_or("bit").alias("bit")).agg(F.sort_array(F.collect_list(F.struct("word", "bit"))).alias("_words"))
    return dense.select(F.transform("_words", lambda x: x["bit"]).alias("_words"))


def _places(columns: list[Column], bits: Column) -> list[Column]:
    """Four places of a key among so many bits; sums of shifted hashes, so that none overflows."""
    h = [F.xxhash64(F.lit(k), *columns) for k in range(2)]
    return [F.pmod(F.shiftright(h[0], 3) + k * F.shiftright(h[1], 4), bits) for k in range(4)]


def maybe_in(df: DataFrame, columns: list[str], filter_row: DataFrame, outside: bool = False) -> DataFrame:
    """Rows of df whose columns, in the order of the keys', may be among the filter's keys; outside: the others, which
    surely aren't. Each row is tested against the one broadcast row, in generated code; nothing is shuffled."""
    words, held = F.col("_words"), F.lit(True)
    for p in _places([df[f"`{c}`"] for c in columns], F.size(words).cast("long") * 64):
        held = held & (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0)
    return df.join(F.broadcast(filter_row), held, "left_anti" if outside else "left_semi")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def release() -> None:
    """Give freed memory of a Python worker back to the system: workers live on and share an executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that gives its memory back when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges(u, v): one row (node, root) per node, root = its smallest node.

    Alternates large-star and small-star contractions. Both are written as a minimum per node (partial
    aggregation first, so a node of very high degree is no hot spot) and a join back to the edges. The minima
    are staged, so that both sides of that join are plain shuffles, which adaptive execution splits when one
    key dominates. No edge list is ever gathered on the driver. The result reads one staged table (unstage it after use).
    A round about halves the longest path, so 40 rounds settle any graph that fits a cluster; if not, it raises.
    Edges with a null end are ignored; self-loops only name their node.
    """
    links = (
        edges.where("u IS NOT NULL AND v IS NOT NULL")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = staged(links, "cc", digest=True)
    for _ in range(rounds):
        # Large star: every neighbour above a node is tied to the smallest one around that node.
        both = links.where("u <> v").select("u", "v").union(links.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        least = staged(least, "cc")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and the neighbours below it are tied to the smallest of them.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(below, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = staged(small, "cc", digest=True)
        done = (new.n_rows, new.digest) == (links.n_rows, links.digest)
        unstage(links, least)
        links = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    named = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = named.union(roots)
    out._staged_at = links._staged_at
    return out


def crc_fold(column: str = "doc_id", folds: int = 4):
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
