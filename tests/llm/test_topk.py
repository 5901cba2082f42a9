import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk


def brute(rows, k, every):
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(fine)]
    out = []
    for n, q, v in ints:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, x)), i) for m, i, x in ints if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))


@pytest.mark.parametrize("pivots,block,clusters", [(16, 50, 5), (64, 20_000, 0), (3, 7, 1)])
def test_equal_to_brute_force(spark, monkeypatch, pivots, block, clusters):
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    r = np.random.default_rng(pivots)
    x = r.normal(size=(400, 8)).astype(np.float32)
    if clusters:
        x = (r.normal(size=(clusters, 8))[r.integers(0, clusters, 400)] * 6 + x * 0.2).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(1000 + i, x[0].tolist()) for i in range(60)]  # a third of all equal
    rows += [(2000, None), (2010, [float("nan")] * 8), (2020, [None] + [1.0] * 7), (2030, [float("inf")] * 8), (2040, []), (2050, x[1].tolist()[:5]), (2060, [1e7] + [0.0] * 7), (10, x[3].tolist())]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, n_pivots=pivots, block_rows=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10)


def test_bounds_leave_cells_out():
    class Cell:
        def __init__(self, cell, queries):
            self.cell, self.n, self.away, self.nearest = cell, 10, 1.0, [0.1] * 6
            self.queries, self.query_away, self.query_norm = queries, 1.0, 10.0

    pivots = np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]])
    assert topk._reach(pivots, [Cell(0, 1), Cell(1, 0), Cell(2, 0)], 5) == {0: [0]}


def test_few_rows_and_empty_tables(spark):
    one = table(spark, [(0, [1.0, 2.0])])
    assert topk.top_k(one, F.lit(True)).collect() == []
    assert topk.top_k(one.limit(0), F.lit(True)).collect() == []
    two = table(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])])
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 3 * 256 * 256)]


def test_large_components_stay(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e7, 0.0]), (2, [3e9, -3e9]), (3, [2.0, 0.0])]
    got = topk.top_k(table(spark, rows), F.lit(True)).collect()
    assert sorted(map(tuple, got)) == sorted((q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, 5, 1))
