"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of white space became one space.  A first scan keeps length and prefix
hash of every text (16 bytes a row).  Rows are grouped by length, the survivors by length and prefix hash; a second
scan hashes the full content only of rows whose group survived both.  The survivors' keys reach that scan as a bitmap
of fixed size (1 MB), so no text is shuffled to find out who survived; a false positive only
costs a hash, the grouping by full SHA-256 that follows is exact.

Defined cases: a null text counts as empty and empty texts are equal; of equal texts the smallest doc_id stays, a null
doc_id sorting last; of rows that also share the doc_id exactly one stays; an empty table gives an empty result; other
columns, whatever their names and types, are not looked at; a very long text is normalised and hashed where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, cut, skewed_join, text_or_empty, with_membership

WHITE = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 256


def _profiled(df: DataFrame, text: str) -> DataFrame:
    norm = F.regexp_replace(text_or_empty(text), WHITE, " ")
    return df.withColumn("_norm", norm).withColumns(
        {
            "_len": F.length("_norm"),
            "_pre": F.xxhash64(F.substring(F.col("_norm"), 1, PREFIX_CHARS)),
        }
    )


def _flagged(df: DataFrame, text: str) -> DataFrame:
    """``df`` with _norm, _len, _pre and _maybe: whether another row may have the same length and prefix."""
    profile = cut(_profiled(df.select(F.col(text)), text).select("_len", "_pre"))
    lengths = profile.groupBy("_len").count().filter("count > 1").select("_len")
    keys = profile.groupBy("_len", "_pre").count().filter("count > 1").join(lengths, "_len", "left_semi")
    key = F.xxhash64("_len", "_pre")
    return with_membership(_profiled(df, text), key, bitmap_of(keys, key))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows whose group fell apart before the full hash, unless ``digest_all`` asks for it too.
    """
    rows = _flagged(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    sha = F.unhex(F.sha2("_norm", 256))
    slim = cut(
        rows.select(
            "doc_id",
            F.monotonically_increasing_id().alias("_row"),
            "_maybe",
            (sha if digest_all else F.when(F.col("_maybe"), sha)).alias("_sha"),
        )
    )
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    groups = slim.filter("_maybe").groupBy("_sha").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    several = groups.filter("_n > 1")  # the others keep their only row
    joined = skewed_join(slim.filter("_maybe"), several, "_sha", F.col("_row"), "left")
    single = slim.filter("NOT _maybe").withColumns(
        {"_first": F.lit(None).cast(groups.schema["_first"].dataType), "_n": F.lit(None).cast("long")}
    )
    return joined.select(*single.columns).unionByName(single).select(
        "doc_id",
        F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_first.d")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_first.r") == F.col("_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all its columns.

    Only rows that may have an equal are shuffled, and of those one per group and map task (partial minimum).
    """
    rows = _flagged(
        df.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text")), "_text"
    )
    alone = rows.filter("NOT _maybe").select("_row")
    order = F.struct(F.col("_doc").isNull().alias("n"), F.col("_doc").alias("d"), F.monotonically_increasing_id().alias("r"))
    marked = rows.filter("_maybe").withColumns({"_sha": F.unhex(F.sha2("_norm", 256)), "_order": order})
    first = marked.groupBy("_len", "_sha").agg(F.min_by("_row", "_order").alias("_row"))
    return alone.unionByName(first.select("_row")).select("_row.*")
