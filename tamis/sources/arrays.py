"""NumPy arrays as tables, and the discovery of files that hold families, shards and records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of an array that one task reads.
ROWS_PER_TASK = 65_536


def _element(dtype: np.dtype) -> tuple[str, type]:
    """The SQL type and NumPy type that hold numbers of an array without loss (half floats as float)."""
    if dtype.kind in "iu" and dtype != np.uint64 or dtype.kind == "b":
        return "long", np.int64
    if dtype.kind == "f":
        return ("double", np.float64) if dtype.itemsize > 4 else ("float", np.float32)
    raise ValueError(f"arrays of {dtype} are not read")


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rowsPerTask", ROWS_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        n = np.load(self.path, mmap_mode="r").shape[0]  # the header alone is read
        return [_Rows(k, min(k + self.step, n)) for k in range(0, n, self.step)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        a = np.load(self.path, mmap_mode="r")
        for lo in range(partition.start, partition.end, 4096):
            part = np.ascontiguousarray(a[lo : min(lo + 4096, partition.end)], _element(a.dtype)[1])
            part = part.reshape(len(part), -1)
            at = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.ListArray.from_arrays(at, pa.array(part.ravel()))], names=["row", "vec"])


class NpySource(DataSource):
    """spark.read.format("npy").load(path): (row, vec) of a .npy file on a mount that executors share; vec is an array of
    float, double or long by the file's type, of one element where the file has one dimension.

    The file is mapped, and each task reads its own range of rows.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"row long, vec array<{_element(np.load(self.options['path'], mmap_mode='r').dtype)[0]}>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rowsPerTask", rows_per_task).load(path)


def write_npy(df: DataFrame, row: str, vector: str, path: str, dtype: str = "float32") -> None:
    """A two-dimensional .npy file on a mount that executors share. row must run from 0 to n - 1, and vectors be of one
    length: other input is an error.

    The driver writes the header and sizes the file; tasks map it and fill in their rows. A task that runs twice writes
    the same bytes.
    """
    size = F.size(vector)
    n, rows, least, most, shortest, longest = df.agg(F.count(F.lit(1)), F.count_distinct(row), F.min(row), F.max(row), F.min(size), F.max(size)).first()
    if n and (rows != n or least != 0 or most != n - 1):
        raise ValueError("rows must be numbered from 0 to n - 1")
    if n and (shortest != longest or shortest < 0 or df.where(F.col(vector).isNull()).limit(1).count()):
        raise ValueError("vectors must be of one length")
    np.lib.format.open_memmap(path, mode="w+", dtype=dtype, shape=(n, longest or 0)).flush()

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.lib.format.open_memmap(path, mode="r+")
        for frame in frames:
            if len(frame) and out.shape[1]:
                out[frame["row"].to_numpy()] = np.stack(frame["vec"].to_numpy())
        out.flush()
        yield pd.DataFrame({"n": [0]})

    if n:
        df.select(F.col(row).alias("row"), F.col(vector).alias("vec")).mapInPandas(fill, "n long").count()


def write_npz(df: DataFrame, path: str, order: list[str], most_rows: int = 1_000_000) -> None:
    """One .npz file with an array per column, rows by the given order. It is for tables of one row per cluster or family:
    more than most_rows are an error, as the driver holds them all."""
    rows = df.orderBy(*order).limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    stacked = {c: np.stack(rows[c].to_numpy()) if len(rows) and isinstance(rows[c].iloc[0], (list, np.ndarray)) else rows[c].to_numpy() for c in rows}
    # Texts as fixed-width characters: object arrays would need pickle to be read.
    np.savez(path, **{c: a.astype(str) if a.dtype == object else a for c, a in stacked.items()})


def read_npz(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(row, names...): arrays of one .npz file side by side, all or the named ones; they must be of one length. Numbers,
    texts, and two-dimensional numbers (as arrays). One task of the driver reads it: see write_npz for what it is for."""
    with np.load(path, allow_pickle=False) as z:
        arrays = {n: z[n] for n in names or z.files}
    if len({len(a) for a in arrays.values()}) != 1:
        raise ValueError("arrays of different lengths")
    kind = lambda a: "string" if a.dtype.kind == "U" else _element(a.dtype)[0]
    schema = ", ".join(["row long", *(f"`{n}` " + (f"array<{kind(a)}>" if a.ndim > 1 else kind(a)) for n, a in arrays.items())])
    return spark.createDataFrame(list(zip(range(len(next(iter(arrays.values())))), *(a.tolist() for a in arrays.values()))), schema)


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths below a folder that match a pattern; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")


def family_files(spark: SparkSession, folder: str) -> DataFrame:
    """(family, path): from the family_files map of a manifest.json if there is one, else every other JSON file of the
    folder by its name."""
    found = listing(spark, folder, "*.json").where(~F.col("path").rlike(r"/manifest\.json$"))
    named = found.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("family"), "path")
    manifest = listing(spark, folder, "manifest.json").limit(1).collect()
    if manifest:
        text = spark.read.text(manifest[0].path, wholetext=True)
        files = text.select(F.explode(F.from_json(F.get_json_object("value", "$.family_files"), "map<string,string>")).alias("family", "file"))
        if not files.isEmpty():
            return files.select("family", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")).alias("path"))
    return named


def shard_files(spark: SparkSession, folder: str, pattern: str, shard: str = r"/(part[-_]?\d+|\d+)/") -> DataFrame:
    """(shard, path): files of a tree by the directory that names their shard, however deep it is."""
    s = F.regexp_extract("path", shard, 1)
    return listing(spark, folder, pattern).select(s.alias("shard"), "path").where("shard <> ''")


def read_zipped_csv(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Rows of the first member of a zip archive with the given name, wherever it is inside; one task per archive.

    Missing values are empty fields.
    """
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    name = next((n for n in sorted(z.namelist()) if n.rsplit("/", 1)[-1] == member), None)
                    if name is not None:
                        with z.open(name) as f:
                            yield from (chunk.reindex(columns=columns) for chunk in pd.read_csv(f, chunksize=10_000))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
