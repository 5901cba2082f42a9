import hashlib
import math
import zlib

from pyspark.sql import functions as F

from plumbline.llm import sharding


def shard(key, weights):
    def score(j, w):
        h = int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16)
        return w / -math.log((h + 0.5) / 16**13)

    return max(range(len(weights)), key=lambda j: (score(j, weights[j]), j))


def test_against_hashlib(docs):
    rows = [(i, "é" * (i % 5) if i % 7 else None) for i in range(300)]
    got = {r.doc_id: r for r in sharding.shard_table(docs(rows), [1.0] * 16, [1.0] * 17).collect()}
    for d, t in rows:
        r, data = got[d], (t or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (shard(d, [1.0] * 16), shard(d, [1.0] * 17))
        assert r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in got.values()}:
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))


def test_weights_decide_the_shares(spark):
    df = spark.range(6000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 3.0]).alias("s"))
    share = df.filter("s = 1").count() / 6000
    assert 0.72 < share < 0.78


def test_repeated_rows_null_keys_and_empty_tables(docs):
    df = docs([(1, "a"), (1, "a"), (None, "b"), (None, None)])
    got = sharding.shard_table(df, [1.0] * 4).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1 and all(r.grown_shard is None for r in got)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_table(df.limit(0), [1.0] * 4).collect() == []


def test_very_many_equal_rows_are_dealt_in_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from plumbline.llm import sharding

    df = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") < 70_000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    monkeypatch.setattr(sharding, "CHUNK", 1000)
    rows = sharding.shard_table(df, [1.0] * 4, [1.0] * 5)
    per = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert sum(r.n for r in per) == 100_000 and all(r.d == r.n and (r.lo, r.hi) == (0, r.n - 1) for r in per)
    hot = rows.filter("doc_id = 5").agg(F.count("*").alias("n"), (F.max("slot") - F.min("slot")).alias("span")).first()
    assert (hot.n, hot.span) == (70_000, 69_999)
