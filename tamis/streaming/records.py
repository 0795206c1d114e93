"""Records as a stream of files: appended once each, however often a batch is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def append_once(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to a Parquet folder, in a partition that bears its number.

    A batch that is run again after a failure writes its own partition anew, so that no record is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(stream: DataFrame, time: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """(window, key, n, mean) over event time; records later than `late` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
