"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; its lineage ends there, and so do the constraints that a plan drags along."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, for tables between stages: the session's ``spark.checkpoint.dir``.

    Where that setting is empty a temporary folder is made, but under a local master only: on a cluster no other machine would
    see it.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="plumbline-")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that no later step reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in Arrow batches of at most ``BATCH_BYTES``, a longer row alone.

    The engine's own bound (64 MB, or 10,000 rows) is held several times over by a task: as rows, as Arrow and as strings.  It
    has no bearing on results.  A lower bound of the session's own stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]?)[a-z]*", spark.conf.get(name).strip().lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit or "b") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _trim():
    """The C library's malloc_trim, or something that does nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def release() -> None:
    """Gives memory that is free again, Arrow's and the C library's, back to the system.

    A Python worker serves many tasks and would else go on holding what its largest batches took, in pieces.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(pdf: pd.DataFrame, text: str = "text", size: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """``pdf`` in runs of rows whose texts have about ``size`` characters together (a longer text is a run of its own).

    After the last run free memory is released.
    """
    upto = np.cumsum([len(t) if t is not None else 0 for t in pdf[text]], dtype=np.int64)
    begin = 0
    while begin < len(pdf):
        limit = size + (upto[begin - 1] if begin else 0)
        end = max(begin + 1, int(np.searchsorted(upto, limit, side="right")))
        yield pdf.iloc[begin:end]
        begin = end
    release()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def md5_int(*parts: Column, digits: int = 13) -> Column:
    """A portable hash: the first hex digits of the MD5 of ``a:b:…`` as a non-negative long (null counts as ``~``)."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("long")


FILTER_BITS = 1 << 23


def _bit(key: Column, bits: int = FILTER_BITS) -> Column:
    return F.pmod(key, F.lit(bits)) + 1


def bitmap_of(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """The set of ``key`` (long) values modulo ``bits`` as pages (_page, _bits) of 32768 bits; 1 MB at most by default."""
    return cut(
        keys.select(_bit(key, bits).alias("_b"))
        .groupBy(F.bitmap_bucket_number("_b").alias("_page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_bits"))
    )


def with_membership(df: DataFrame, key: Column, pages: DataFrame, bits: int = FILTER_BITS, name: str = "_maybe") -> DataFrame:
    """``df`` with a column that is false only where ``key`` isn't in the bitmap; decided on the map side."""
    at = F.bitmap_bit_position("_b")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return (
        df.withColumn("_b", _bit(key, bits))
        .withColumn("_page", F.bitmap_bucket_number("_b"))
        .join(F.broadcast(pages), "_page", "left")
        .withColumn("_at", at)
        .withColumn("_byte", byte)
        .withColumn(name, F.coalesce(hit, F.lit(False)))
        .drop("_b", "_page", "_at", "_byte", "_bits")
    )


HOT_ROWS, HOT_KEYS = 2048, 10_000


def skewed_join(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (one row a key) where very many rows of ``big``, a materialised table, may share a key.

    The most frequent keys, ``HOT_KEYS`` at most and of more than ``HOT_ROWS`` rows each, are dealt over salts by ``spread``, and
    their row of ``small`` goes to each salt.
    """
    counts = big.groupBy(key).count().filter(F.col("count") > HOT_ROWS)
    top = counts.orderBy(F.desc("count"), key).limit(HOT_KEYS).collect()
    if not top:
        return big.join(small, key, how)
    kind = big.schema[key].dataType.simpleString()
    hot = F.broadcast(big.sparkSession.createDataFrame([(r[key], -(-r["count"] // HOT_ROWS)) for r in top], f"`{key}` {kind}, _salts int"))
    dealt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), "_salts")).cast("int")
    left = big.join(hot, key, "left").withColumn("_salt", dealt).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    right = small.join(hot, key, "left").withColumn("_salt", copies).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node in ``edges`` (a, b: long).

    Large-star and small-star steps take turns until the edges stand still: all of a component's nodes then point at its
    smallest.  Minima are aggregated before the shuffle; a hub's edges (16 bytes each) meet its minimum in a join that adaptive
    execution splits once they are large.
    """
    now = cut(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct())
    state = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Edges of a node that is its own minimum stay as they are; the others now hang from the minimum.
        large = large.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == state:
            break
        state = got
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    tops = now.select(F.col("b").alias("a")).distinct().join(roots, "a", "left_anti")
    return roots.unionByName(tops.select("a", F.col("a").alias("component"))).withColumnRenamed("a", "node")


def bitmap_array(keys: DataFrame, key: Column, bits: int) -> np.ndarray:
    """The same set as bytes, bit i of byte j standing for 8 j + i; bits / 8 bytes, whatever the number of keys."""
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in bitmap_of(keys, key, bits).collect():
        page = np.frombuffer(r["_bits"], dtype=np.uint8)
        at = (r["_page"] - 1) * len(page)
        out[at : at + len(page)] = page[: len(out) - at]
    return out
