"""Sharding by weighted rendezvous hashing.

Every shard draws a number for the record key, u in (0, 1), and scores ``weight / -ln(u)``; the record goes to the
shard with the highest score.  A shard that is added takes records only into itself, since the other scores stay.
The draw is the MD5 of ``key:shard``, so any engine can repeat it.

Slots number the rows of a shard from 0 without gaps.  Nothing sorts a whole shard: rows are numbered inside
``slot_buckets`` hash buckets of each shard, and the bucket counts (shards x buckets rows, a proven bound) are summed
up to offsets.  Rows equal in key, text hash and size are one row with a count until their slots are known, and a count
of more than ``CHUNK`` is dealt out in parts.

Defined cases: a null key is the key ``~``; a null text has no bytes; equal rows get neighbouring slots, and are never sorted; an empty table
gives an empty result; a very long text is measured where it is read and never shuffled; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import md5_int, text_or_empty

DIGITS = 13
SLOT_BUCKETS = 256
CHUNK = 10_000


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) of ``key`` among ``len(weights)`` shards; equal scores go to the larger shard number."""
    span = float(16**DIGITS)

    def score(shard: int, weight: float) -> Column:
        u = (md5_int(key, F.lit(shard), digits=DIGITS) + F.lit(0.5)) / F.lit(span)
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("s"), F.lit(shard).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def shard_table(
    df: DataFrame,
    weights: Sequence[float],
    grown_weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    slot_buckets: int = SLOT_BUCKETS,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``df``."""
    body = text_or_empty("text")
    grown = rendezvous_shard(F.col("doc_id"), grown_weights) if grown_weights else F.lit(None).cast("int")
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        grown.alias("grown_shard"),
    )
    # With the text in the hash, a key of very many rows fills many buckets.
    bucket = F.pmod(md5_int(F.col("doc_id"), F.lit("slot"), F.col("text_crc32"), digits=8), F.lit(slot_buckets))
    alike = [*rows.columns, "bucket"]
    groups = rows.withColumn("bucket", bucket).groupBy(*alike).agg(F.count("*").alias("n"))
    counts = groups.groupBy("shard", "bucket").agg(F.sum("n").alias("count"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = groups.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"])
    first = (F.col("offset") + F.col("before")).cast("long").alias("first")
    placed = begun.select("doc_id", "size", "text_crc32", "shard", "grown_shard", first, "n")
    part = lambda begin: F.explode(F.sequence(begin, F.least(begin + CHUNK, F.col("n")) - 1))
    zero = F.lit(0).cast("long")
    few = placed.filter(F.col("n") <= CHUNK).withColumn("i", part(zero))
    chunks = placed.filter(F.col("n") > CHUNK).withColumn("c", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    many = chunks.repartition("doc_id", "c").withColumn("i", part(F.col("c"))).drop("c")
    return few.unionByName(many).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("i")).alias("slot"), "grown_shard")
