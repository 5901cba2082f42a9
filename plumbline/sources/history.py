"""A history that grows by batches: only changes are written, and a batch that comes again changes nothing.

A history is a folder with two tables.  ``rows/batch=<id>`` holds what a batch added, as CSV with a header, quoted as RFC 4180
says.  ``last/batch=<id>`` holds one row: the order and the key of the last row that was known after that batch.  Both are
written by overwriting their own partition alone, and Spark moves staged files into place when all are complete, so a batch
that is repeated, after a failure or twice by mistake, leaves the same files as one run.  Where a batch begins is read from the
batch before, never from itself.  Batches of one history come one after the other, with growing ids, as a stream's do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.ranges import change_log

CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def there(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists, in whatever store it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _last_before(spark: SparkSession, folder: str, batch: int, kinds: str):
    """The ``last`` row of the newest batch before this one."""
    if not there(spark, f"{folder}/last"):
        return None
    before = spark.read.schema(f"order struct<{kinds}>, key string, batch long").parquet(f"{folder}/last").filter(F.col("batch") < batch)
    return before.orderBy(F.desc("batch")).first()


def append(rows: DataFrame, folder: str, batch: int, order: Sequence[str], key: str) -> None:
    """Adds to the history what ``rows`` has after the last known row, as far as ``key`` changes from row to row.

    ``order`` tells rows apart and grows from batch to batch; rows that are not after the last known one came before.  A null key
    equals a null key.
    """
    spark = rows.sparkSession
    kinds = ", ".join(f"{c}: {rows.schema[c].dataType.simpleString()}" for c in order)
    last = _last_before(spark, folder, batch, kinds)
    place = F.struct(*order)
    new = rows.withColumn("_key", F.col(key).cast("string"))
    if last is not None and last["order"] is not None:
        known = spark.createDataFrame([(last["order"],)], f"order struct<{kinds}>")
        new = new.filter(place > known.select("order").scalar())
    changes = change_log(new, order, "_key", None if last is None or last["order"] is None else (last["key"],)).drop("_key")
    put = lambda df: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
    put(changes).options(**CSV).csv(f"{folder}/rows")
    end = new.agg(F.max_by(F.struct(place.alias("order"), F.col("_key").alias("key")), place).alias("e")).select("e.order", "e.key")
    if last is not None:
        fallback = spark.createDataFrame([(last["order"], last["key"])], f"order struct<{kinds}>, key string")
        end = end.filter("order IS NOT NULL").unionByName(fallback).orderBy(F.desc_nulls_last("order")).limit(1)
    put(end.coalesce(1)).parquet(f"{folder}/last")


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of a history with their ``batch``."""
    return spark.read.schema(StructType([*schema.fields]).add("batch", "long")).options(**CSV).csv(f"{folder}/rows")


def sink(stream: DataFrame, folder: str, order: Sequence[str], key: str) -> DataStreamWriter:
    """A stream's writer into a history: each micro-batch is a batch, and one that is run again is not written twice."""
    return stream.writeStream.foreachBatch(lambda rows, batch: append(rows, folder, batch, order, key))
