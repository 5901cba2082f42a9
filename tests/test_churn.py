import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.sources import churn

SCHEMA = "path string, at timestamp_ntz"
FIRST = date(2024, 3, 1)


def full(rows, today, window):
    return Counter(p for p, t in rows if t is not None and today - timedelta(days=window) < t.date() <= today)


def current(spark, folder, today, frame, most_days=0):
    found = churn.current(spark, folder, today, frame.select("path").schema, most_days)
    return None if found is None else {r.path: r.n for r in found.collect()}


@pytest.mark.parametrize("days", [[0, 1, 2, 3], [5, 9, 9, 12, 30], [4, 60]])
def test_advances_equal_the_full_count(spark, tmp_path, days):
    """Single days, gaps shorter and longer than the window, and a day taken twice."""
    r = random.Random(len(days))
    rows = [(r.choice(["a", "b", "c", None]), None if r.random() < 0.02 else datetime(2024, 2, 25) + timedelta(hours=r.randrange(1400))) for _ in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for n in days:
        today = FIRST + timedelta(days=n)
        churn.advance(frame, str(tmp_path), today, 7, ["path"], "at")
        want = full(rows, today, 7)
        assert (current(spark, str(tmp_path), today, frame) or {}) == dict(want)


def test_an_advance_reads_only_what_came_and_what_left(spark, tmp_path):
    """After the first state the old days may be gone from the changes: counts of the days that leave are in the store."""
    rows = [("x", datetime(2024, 3, 1) + timedelta(hours=5 * i)) for i in range(60)]
    churn.advance(spark.createDataFrame(rows[:40], SCHEMA), str(tmp_path), date(2024, 3, 8), 5, ["path"], "at")
    late = [row for row in rows if row[1].date() > date(2024, 3, 8)]
    frame = spark.createDataFrame(late, SCHEMA)
    churn.advance(frame, str(tmp_path), date(2024, 3, 10), 5, ["path"], "at")
    assert current(spark, str(tmp_path), date(2024, 3, 10), frame) == dict(full([r for r in rows[:40] if r[1].date() <= date(2024, 3, 8)] + late, date(2024, 3, 10), 5))


def test_a_state_is_used_while_it_is_fresh(spark, tmp_path):
    frame = spark.createDataFrame([("x", datetime(2024, 3, 1, 12))], SCHEMA)
    assert current(spark, str(tmp_path), FIRST, frame) is None
    churn.advance(frame, str(tmp_path), FIRST, 5, ["path"], "at")
    assert current(spark, str(tmp_path), FIRST, frame) == {"x": 1}
    later = FIRST + timedelta(days=2)
    assert current(spark, str(tmp_path), later, frame) is None and current(spark, str(tmp_path), later, frame, 2) == {"x": 1}


def test_age_in_whole_minutes(spark):
    stamp = lambda s: F.lit(s).cast("timestamp")
    ages = [churn.age_minutes(stamp("2024-03-01 00:00:30"), stamp(t)) for t in ("2024-03-01 00:10:29", "2024-03-01 00:10:30", "2024-02-29 23:59:30", None)]
    assert tuple(spark.range(1).select(*[a.alias(str(i)) for i, a in enumerate(ages)]).first()) == (9, 10, -1, None)
