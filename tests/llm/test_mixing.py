import random

from pyspark.sql import functions as F

from plumbline.llm import mixing


def targets(sizes):
    """Resharing by hand: cap, hand out the excess by weight, again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def corpus(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "tiny", None]) if i % 97 else "tiny", "w " * r.randint(0, 40)) for i in range(3000)]
    rows += [(5000 + i, "one", "x y") for i in range(2)] + [(6000, "void", None), (6001, "void", "")]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(-1))


def test_targets_and_taken(spark, monkeypatch):
    rows, df = corpus(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, source = targets(sizes), {d: s for d, s, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s]
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, got))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)  # many sources are joined by shuffle
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, got))


def test_rows_stand_as_often_as_they_are_taken(spark):
    _, df = corpus(spark)
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(df).collect() if r.size}
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    counts = {r.doc_id: r["count"] for r in rows.filter(F.trim("text") != "").groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in times.items() if n}


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.mix(df.limit(0)).collect() == [] == mixing.mixed_rows(df.limit(0)).collect()


def test_equal_rows_are_cut_near_the_target(spark):
    """Sources of copies of one row, and of one id with several rows: what is taken misses the target by half a row at most."""
    rows = [(1, "a", "five words in this row")] * 100 + [(2, "b", "x y z")] * 700 + [(None, "c", "one two")] * 50 + [(i, "d", "w " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, source string, text string, _name int").repartition(5)
    got = mixing.mix(df).collect()
    size = {"a": 5, "b": 3, "c": 2}
    words = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in "abcd"}
    want = targets(words)
    for s, each in size.items():
        taken = sum(r.taken for r in got if r.source_size == words[s])
        assert abs(taken - want[s]) <= each / 2 and len({r.taken for r in got if r.source_size == words[s]}) <= 2
    assert len(got) == len(rows)
    kept = mixing.mixed_rows(df)
    assert kept.columns == df.columns and {r.source: r.n for r in kept.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}["b"] == sum(r.taken for r in got if r.source_size == words["b"])


def test_very_many_equal_rows(spark):
    """100,000 copies of one row in several partitions, numbered without a window over them all."""
    df = spark.range(0, 100_000, 1, 8).select(F.lit(1).alias("doc_id"), F.lit("a").alias("source"), F.lit("x y").alias("text"))
    df = df.unionByName(spark.range(30_000).select(F.col("id").cast("int").alias("doc_id"), F.lit("b").alias("source"), F.lit("z").alias("text")))
    found = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    assert len(found) == 2 and all(abs(r.n - r.target) <= 1 for r in found)
