"""Exact top-k search by a Voronoi kNN join.

Vectors are cut into Voronoi cells around pivots.  Per cell a summary holds the number of vectors, the largest distance to
the pivot, the k smallest of these distances and the largest query norm.  From the summaries alone follow, for the
queries of cell i, a floor that k inner products surely reach and, for every data cell j, a ceiling that none exceeds:

    q.x = q.p + q.(x - p),   so   |q.x - q.p| <= |q| d(x, p),   and   |q.p - p_i.p| <= d(q, p_i) |p|.

A data cell goes to the query cells whose floor its ceiling reaches.  Query cells that need the same data cells form one
group, which gets one copy of each for every ``QUERY_ROWS`` queries.  A cell's data are dealt over blocks of about
``BLOCK_ROWS`` rows, so a cell that holds a third of all rows is many tasks; each block gives its k best for each query and
the blocks' lists meet per query.

Components are integers, floor(scale x) of the given ones; scores are exact integer inner products.  Pivots are the vectors
with the smallest hash of vec_id, a bounded sample of ``LEAST_PIVOTS`` to ``MOST_PIVOTS`` that grows with the square root of
the rows: they decide the work, not the result.

Defined cases: a vector that is null or holds a null or a non-finite component takes no part; a shorter vector, an empty one
too, counts as ended by zeros; components and scores beyond 64 bits count as the nearest long; equal scores go to the smaller
vec_id; of repeated rows each is a query and a candidate of its own; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 5
LEAST_PIVOTS, MOST_PIVOTS = 64, 512
BLOCK_ROWS = 20_000
QUERY_ROWS = 4096
#: The largest double below 2 ** 63.
LARGEST = 9223372036854774784.0
#: Slack of the bounds against rounding in floating point.
SLACK = 1e-6


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale x) of every component as long; null if the vector takes no part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    scaled = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(vector.isNotNull() & F.forall(vector, fine), F.transform(vector, lambda x: F.floor(scaled(x)).cast("long")))


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    first = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).collect()
    return np.unique(np.array([r.v for r in first], dtype=np.float64), axis=0) if first else np.zeros((0, 0))


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with the nearest pivot's number and the distance to it."""
    norms = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                square = (x**2).sum(axis=1)[:, None] + norms - 2 * x @ pivots.T
                cell = square.argmin(axis=1)
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pdf.assign(cell=cell.astype("int32"), away=away, norm=np.sqrt((x**2).sum(axis=1)))

    names = "uid long, vec_id long, is_query boolean, v array<long>, cell int, away double, norm double"
    return rows.mapInPandas(run, names)


def _reach(pivots: np.ndarray, cells: list, k: int) -> dict[int, list[int]]:
    """For each query cell the data cells that may hold one of the k best of a query in it."""
    data = {r.cell: r for r in cells if r.n}
    reach = {}
    for r in cells:
        if not r.queries:
            continue
        floors, ceilings = [], {}
        for j, d in data.items():
            p = pivots[j]
            middle, lean = float(pivots[r.cell] @ p), r.query_away * float(np.linalg.norm(p))
            ceilings[j] = middle + lean + r.query_norm * d.away
            floors += [middle - lean - r.query_norm * near for near in d.nearest]
        # One of the nearest vectors may be the query's own row, hence the (k + 1)-th floor.
        floor = sorted(floors, reverse=True)[k] if len(floors) > k else -np.inf
        reach[r.cell] = [j for j, c in ceilings.items() if c >= floor - SLACK * (1 + abs(floor))]
    return reach


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    n_pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner product for every query row of ``df``."""
    rows = df.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(vec_id).cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        quantised(F.col(vector), scale).alias("v"),
    ).filter("v IS NOT NULL")
    spark = df.sparkSession
    count, width = rows.agg(F.count("*"), F.greatest(F.max(F.size("v")), F.lit(1))).first()
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))) if count else rows
    pivots = _pivots(rows, n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(count**0.5) // 2)))
    out = "query_id long, rank int, vec_id long, score long"
    if not len(pivots):
        return spark.createDataFrame([], out)
    placed = cut(_assigned(rows, pivots))
    nearest = Window.partitionBy("cell", "part").orderBy("away")
    # k + 1 smallest distances of each cell, first within parts so that no cell meets in one task.
    parts = placed.withColumn("part", F.pmod("uid", F.lit(64)))
    near = parts.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).groupBy("cell").agg(
        F.slice(F.array_sort(F.collect_list("away")), 1, k + 1).alias("nearest")
    )
    query = F.col("is_query")
    summary = placed.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.max("away").alias("away"),
        F.count(F.when(query, 1)).alias("queries"),
        F.max(F.when(query, F.col("away"))).alias("query_away"),
        F.max(F.when(query, F.col("norm"))).alias("query_norm"),
    )
    cells = summary.join(near, "cell").collect()  # a row for each pivot at most
    reach = _reach(pivots, cells, k)
    blocks = {r.cell: max(1, -(-r.n // block_rows)) for r in cells}
    asks = {r.cell: r.queries for r in cells}
    groups: dict[tuple, list[int]] = {}
    for i, to in reach.items():
        groups.setdefault(tuple(to), []).append(i)
    members, routes = [], []
    for to, cells_of in groups.items():
        q_blocks = -(-sum(asks[i] for i in cells_of) // QUERY_ROWS)
        members += [(i, cells_of[0], q_blocks) for i in cells_of]
        routes += [(cells_of[0], j, blocks[j], q_blocks) for j in to]
    if not routes:
        return spark.createDataFrame([], out)
    # A row per pair of cells at most.
    routed = F.broadcast(spark.createDataFrame(routes, "q_group int, cell int, blocks int, q_blocks int"))
    grouped = F.broadcast(spark.createDataFrame(members, "q_cell int, q_group int, q_blocks int"))
    on = ["q_group", "cell", "block", "q_block"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    data = placed.select("uid", "vec_id", "v", "cell").join(routed, "cell").select(
        "q_group", "cell", share("blocks").alias("block"), each("q_blocks").alias("q_block"), "uid", "vec_id", "v"
    )
    asked = placed.filter(query).select("uid", "vec_id", "v", F.col("cell").alias("q_cell")).join(grouped, "q_cell")
    queries = asked.select("uid", "vec_id", "v", "q_group", share("q_blocks").alias("q_block")).join(
        routed.select("q_group", "cell", "blocks"), "q_group"
    )
    queries = queries.select("q_group", "cell", each("blocks").alias("block"), "q_block", "uid", "vec_id", "v").toDF(
        *on, *[f"query_{c}" for c in ("uid", "vec_id", "v")]
    )

    def solve(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        best = [np.zeros((0, 4), dtype=np.int64)]
        q = q.rename(columns=lambda c: c.removeprefix("query_"))
        if len(q) and len(x):
            xs, ids, uids = np.stack(x["v"].to_numpy()), x["vec_id"].to_numpy(), x["uid"].to_numpy()
            order = np.argsort(ids, kind="stable")
            xs, ids, uids = xs[order], ids[order], uids[order]
            # Products of floats are exact as long as no sum can pass 2 ** 53.
            largest = float(np.abs(xs.astype(np.float64)).max()) * float(np.abs(np.stack(q["v"].to_numpy()).astype(np.float64)).max()) * xs.shape[1]
            exact = largest < 2**53
            kind = np.float64 if exact else np.int64 if largest < 2**62 else object  # Python's whole numbers have no limit
            xt = xs.T.astype(kind)
            for i in range(0, len(q), 256):
                part = q.iloc[i : i + 256]
                qs = np.stack(part["v"].to_numpy())
                scores = qs.astype(kind) @ xt
                scores = (np.clip(scores, -(2**63), 2**63 - 1) if kind is object else scores).astype(np.int64)
                for uid, vid, s in zip(part["uid"], part["vec_id"], scores):
                    least = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else s.min()
                    at = np.flatnonzero(s >= least)
                    at = at[uids[at] != uid]
                    at = at[np.lexsort((ids[at], -s[at]))][:k]
                    best.append(np.column_stack([np.full(len(at), uid), np.full(len(at), vid), ids[at], s[at]]))
        return pd.DataFrame(np.concatenate(best), columns=["uid", "query_id", "vec_id", "score"])

    local = queries.groupBy(*on).cogroup(data.groupBy(*on)).applyInPandas(solve, "uid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
