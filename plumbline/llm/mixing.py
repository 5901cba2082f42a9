"""Mixing sources to target weights with hash-threshold histograms.

A text's size is its number of words.  Sources, sorted by code point with null last, weigh 1, 2, 3, 1, 2, 3, … and share
the budget (all sizes); a target stops at ``MAX_EPOCHS`` times its source's size and the excess goes to the others by
weight until none is above.  A source whose target is e whole passes and a rest takes every text e times and, for the
rest, the texts whose hash lies below a threshold.  The threshold comes from histograms: words by source and hash bucket,
the boundary bucket of each source alone split again on the next hash bits, and so on for ``LEVELS`` levels.  What is left
then is one hash: a row, or rows equal in doc_id and text.  These are numbered, partition by partition, and as many are taken
as come nearest to the rest.  No row is sorted.  Reruns agree, because the hash depends on doc_id and text only.

Defined cases: a null text has no words; a source of size 0 has target 0; rows equal in doc_id and text, null ids too, are alike:
where the cut falls among them it is their number that is taken, and of those that differ in other columns any may be the
ones; an empty table gives an empty result; a very long text is counted where it is read; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, md5_int, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
LEVEL_BITS = 12
LEVELS = 4
SALTS, FEW_SOURCES = 16, 10_000


def source_targets(per_source: DataFrame) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    The water level at which capped targets spend the whole budget is found from running sums over the sources in order
    of the level at which each is capped; the table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = per_source.withColumn("w", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    capped = weighed.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("at", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    earlier = Window.orderBy("at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    )
    fits = capped.withColumn("level", level)
    # The first source in this order that stays under its cap fixes the level of all that follow.
    chosen = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(everything)["level"]
    return fits.withColumn("chosen", chosen).select(
        "source",
        "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least(F.col("cap").cast("double"), F.coalesce(F.col("chosen"), F.col("at")) * F.col("w")))
        .alias("target"),
    )


def _with_source(big: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join by source, null-safe, with a materialised table of a row per source.

    The table is counted: up to ``FEW_SOURCES`` rows are broadcast.  More are copied to SALTS salts and joined by shuffle, so
    that no source meets in one task.
    """
    few = per_source.count() <= FEW_SOURCES
    salts = F.explode(F.sequence(F.lit(0), F.lit(0 if few else SALTS - 1)))
    copies = per_source.withColumn("_salt", salts).withColumnsRenamed({"source": "_source", "_salt": "_copy"})
    salted = big.withColumn("_salt", F.lit(0) if few else F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
    on = salted["source"].eqNullSafe(copies["_source"]) & (salted["_salt"] == copies["_copy"])
    return salted.join(F.broadcast(copies) if few else copies, on, "left").drop("_salt", "_copy", "_source")


def _digit(level: int) -> Column:
    """The hash bits that level ``level`` splits by."""
    return F.shiftright(F.col("h"), LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND((1 << LEVEL_BITS) - 1)


def thresholds(slim: DataFrame) -> DataFrame:
    """source, source_size, target, epochs, upto and more from rows (source, size, h).

    Hashes below ``upto`` are taken once more, and ``more`` rows of the hash ``upto`` itself.
    """
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    state = cut(
        targets.withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("upto", F.lit(0).cast("long"))
    )
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = slim
        if level:  # refine the boundary bucket only
            inside = _with_source(slim, state.select("source", "upto")).filter(
                F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("upto", shift + LEVEL_BITS)
            )
        histogram = inside.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        running = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = histogram.withColumn("through", F.sum("words").over(running)).withColumnRenamed("source", "_source")
        joined = state.join(sums, state["source"].eqNullSafe(sums["_source"]), "left")
        # The buckets that fit whole, and the first one that doesn't: the boundary.
        before = F.coalesce(F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))), F.lit(0))
        boundary = F.min(F.when(F.col("through") > F.col("rest"), F.struct("digit", "words", "rows")))
        found = joined.groupBy("source", "source_size", "target", "epochs", "rest", "upto").agg(
            before.alias("before"), boundary.alias("b"), (F.max("digit") + 1).alias("last")
        )
        digit = F.coalesce(F.col("b.digit"), F.col("last"), F.lit(0)).cast("long")
        rest = F.col("rest") - F.col("before")
        upto = F.col("upto") + F.shiftleft(digit, shift)
        each = F.col("b.words") / F.col("b.rows")  # at the last level the boundary's rows are alike
        whole = F.floor(rest / each)
        more = F.coalesce(whole + F.when(each < 2 * (rest - whole * each), 1).otherwise(0), F.lit(0)).cast("long")
        state = cut(found.select("source", "source_size", "target", "epochs", rest.alias("rest"), upto.alias("upto"), more.alias("more")))
    return state.drop("rest")


def _taken(rows: DataFrame, state: DataFrame, *columns: str) -> DataFrame:
    """``columns``, source_size, target, epochs and times (how often it is taken) of every row (source, h, …)."""
    met = _with_source(rows, state)
    last = (F.col("h") == F.col("upto")) & (F.col("more") > 0) & (F.col("epochs") < MAX_EPOCHS)
    wanted = [*columns, "source_size", "target"]
    once = F.when((F.col("h") < F.col("upto")) & (F.col("epochs") < MAX_EPOCHS), 1).otherwise(0)
    most = met.filter(~last).select(*wanted, (F.col("epochs") + once).alias("times"))
    # Rows of the last hash are numbered within each partition, after those of the partitions before.
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    edge = cut(met.filter(last).select(*wanted, "epochs", "more", name.alias("_name"), F.spark_partition_id().alias("_part")))
    counts = edge.groupBy("_name", "_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = edge.withColumn("_id", F.monotonically_increasing_id()).join(counts.withColumn("_before", before), ["_name", "_part"])
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_name", "_part").orderBy("_id"))
    numbered = placed.withColumn("_number", number)
    return most.unionByName(numbered.select(*wanted, (F.col("epochs") + F.when(F.col("_number") <= F.col("more"), 1).otherwise(0)).alias("times")))


def _sized(df: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), text_or_empty(text).alias("text"))
    return rows.select(
        "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), _hash("doc_id", "text").alias("h")
    )


def _hash(doc_id: str, text: str) -> Column:
    """A row's number: its id and its text decide, so that rows of one id, or of none, part."""
    return md5_int(F.col(doc_id), F.md5(text_or_empty(text)), digits=LEVEL_BITS * LEVELS // 4)


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``df``."""
    slim = cut(_sized(df, doc_id, source, text))
    taken = (F.col("times") * F.col("size")).cast("long").alias("taken")
    return _taken(slim, thresholds(slim), "doc_id", "size").select("doc_id", "size", "source_size", "target", taken)


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix with all columns of ``df``: a row taken n times stands n times, one not taken goes.

    Thresholds and passes per source (one row per source) decide each row where it is; no text is shuffled.
    """
    state = thresholds(cut(_sized(df, doc_id, source, text)))
    rows = df.select(F.struct("*").alias("_row"), F.col(source).alias("source"), _hash(doc_id, text).alias("h"))
    found = _taken(rows, state, "_row").filter(F.col("times") > 0)
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("_row.*")
