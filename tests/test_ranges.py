import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranges
from plumbline.operators.asof import as_of
from plumbline.operators.ratchets import hotspot


def changes(keys):
    return [i for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]


@pytest.mark.parametrize("parts", [1, 3, 9, 40])
def test_change_log_over_borders(spark, parts):
    """Runs of one key that reach over borders of ranges, nulls, and more ranges than rows."""
    r = random.Random(parts)
    for n in (0, 1, 5, 60):
        keys = [r.choice(["a", "b", None]) for _ in range(n)]
        keys[10:45] = ["a"] * len(keys[10:45])
        df = spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)], "at long, k string, _part2 string").repartition(4)
        got = sorted(x["at"] for x in ranges.change_log(df, ["at"], "k", parts=parts).collect())
        assert got == changes(keys)


def test_change_log_after_a_known_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "at long, k string")
    at = lambda before: sorted(x["at"] for x in ranges.change_log(df, ["at"], "k", before).collect())
    assert (at(None), at(("a",)), at(("b",)), at((None,))) == ([1, 3], [3], [1, 3], [1, 3])


def test_no_window_stands_over_the_whole_table(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    for made in (ranges.change_log(df, ["id"], "k", parts=5), ranges.row_numbers(df, ["id"], parts=5)):
        plan = made._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan and "Window" in plan


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_row_numbers_and_value_at(spark, parts):
    r = random.Random(parts)
    values = [r.choice([1.5, 2.5, -3.0, None]) if r.random() < 0.5 else r.random() for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    want = {i: k for k, (_, _, i) in enumerate(sorted((v is not None, v or 0, i) for i, v in enumerate(values)), 1)}
    assert {x.i: x.number for x in ranges.row_numbers(df, ["v", "i"], parts=parts).collect()} == want
    known = sorted(v for v in values if v is not None)
    for percent in (1, 50, 90, 100):
        place = (len(known) * percent + 99) // 100
        assert ranges.value_at(df, "v", F.expr(f"(n * {percent} + 99) div 100"), parts).first()["value"] == known[place - 1]
    assert ranges.value_at(df.limit(0), "v", F.col("n"), parts).collect() == []


def test_hotspot_with_many_values_equals_the_histogram(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(300)], "k long, n long")
    pick = lambda many, low: sorted(tuple(r) for r in hotspot(df, "n", 90, low, many_values=many).collect())
    assert pick(True, 3) == pick(False, 3) and len(pick(True, 3)) == 31 and pick(True, 990) == pick(False, 990)
    assert hotspot(df.limit(0), "n", many_values=True).collect() == []


@pytest.mark.parametrize("parts", [1, 5, 25])
def test_as_of_equals_brute_force(spark, parts):
    """One key with most rows, so that it fills several ranges; null keys, null times, equal times."""
    r = random.Random(parts)
    start = datetime(2024, 1, 1)
    when = lambda: None if r.random() < 0.05 else start + timedelta(minutes=r.randrange(300))
    key = lambda: r.choice(["hot"] * 8 + ["a", "b", None, "left"])
    left = [(i, key(), when()) for i in range(150)]
    right = [(k, when(), i % 7, None if i % 5 == 0 else f"v{i}") for i in range(60) if (k := key()) != "left"]
    right += [("hot", start + timedelta(minutes=100), 3, "tie"), ("hot", start + timedelta(minutes=100), 9, "tie")]
    want = {}
    for i, k, t in left:
        held = [(at, n is not None, n, v is not None, v or "") for kk, at, n, v in right if kk == k and t is not None and at is not None and at <= t]
        best = max(held) if held else None
        want[i] = (k, t, best[2] if best else None, (best[4] if best[3] else None) if best else None)
    a = spark.createDataFrame(left, "i long, k string, t timestamp_ntz")
    b = spark.createDataFrame(right, "k string, t timestamp_ntz, n long, v string")
    got = {x.i: (x.k, x.t, x.n, x.v) for x in as_of(a, b, ["k"], "t", ["n", "v"], parts).collect()}
    assert got == want
    assert as_of(a, b.limit(0), ["k"], "t", ["n", "v"], parts).filter("n IS NULL").count() == len(left)
    assert as_of(a.limit(0), b, ["k"], "t", ["n"], parts).collect() == []


def test_numbers_within_groups_over_many_ranges(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int")
    for parts in (None, 1, 7):
        groups = {}
        for g, v in sorted(rows, key=lambda r: r[1]):
            groups.setdefault(g, []).append(v)
        expected = sorted(((g or "", v, i) for g, vs in groups.items() for i, v in enumerate(vs, 1)))
        found = ranges.numbers_within(df, ["g"], ["v"], parts=parts).collect()
        assert sorted((r.g or "", r.v, r.number) for r in found) == expected
    assert ranges.numbers_within(df.limit(0), ["g"], ["v"]).count() == 0
