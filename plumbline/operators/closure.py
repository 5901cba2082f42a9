"""What edges lead to: all pairs of a node and what it reaches, and the ends of chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def _edges(edges: DataFrame, child: str, parent: str, within: Sequence[str]) -> DataFrame:
    named = edges.select(*within, F.col(child).alias("_child"), F.col(parent).alias("_parent"))
    return named.filter("_child IS NOT NULL AND _parent IS NOT NULL AND _child <> _parent").distinct()


def closure(edges: DataFrame, child: str, parent: str, within: Sequence[str] = (), to: DataFrame | None = None) -> DataFrame:
    """within…, child, parent: every node with all nodes that its edges lead to, directly or over others; never with itself.

    ``within`` are columns that both ends of an edge share.  ``to`` (within…, parent) keeps to the pairs that end at these nodes,
    and to the work for them.  The evaluation is semi-naive: a round extends only the pairs that the round before found, by
    one edge at their lower end, and goes on with those not known yet.  So a cycle ends, and there are as many rounds as the
    longest way has edges.  Edges with a null end lead nowhere.
    """
    within = list(within)
    base = written(_edges(edges, child, parent, within))
    wanted = base if to is None else base.join(to.select(*within, F.col(parent).alias("_parent")).distinct(), [*within, "_parent"], "left_semi")
    new = written(wanted.select(*within, "_child", "_parent"))
    known = new
    while not new.isEmpty():
        lower = base.select(*within, F.col("_child").alias("_below"), F.col("_parent").alias("_child"))
        longer = new.join(lower, [*within, "_child"]).filter("_below <> _parent").select(*within, F.col("_below").alias("_child"), "_parent").distinct()
        new = written(longer.join(known, [*within, "_child", "_parent"], "left_anti"))
        known = known.unionByName(new)
    return known.select(*within, F.col("_child").alias(child), F.col("_parent").alias(parent))


def chain_ends(edges: DataFrame, child: str, parent: str, within: Sequence[str] = ()) -> DataFrame:
    """within…, child, end: the last node of the chain that begins with each node's only edge.

    A round doubles the steps, so a chain of n edges takes log2(n) rounds; only nodes that aren't at their end yet go into the
    next one.  Before the last of a chain's nodes comes to its end all those nearer to it have, so a round in which none does
    leaves nothing but cycles.  Nodes of a cycle, and nodes that lead into one, have no end and no row.  Of several edges of one
    node the one to the smallest parent counts.
    """
    within = list(within)
    named = edges.select(*within, F.col(child).alias("_child"), F.col(parent).alias("_end")).filter("_child <> _end")
    now = written(named.groupBy("_child", *within).agg(F.min("_end").alias("_end")))
    # A first pass finds the nodes that are at an end; an end is no node.  Tables of nodes grow with the input, so however small
    # their files look they are never sent to the driver and to all tasks.
    nodes = now.select(*within, F.col("_child").alias("_end"), F.lit(True).alias("_on"))
    moved = written(now.join(nodes.hint("merge"), ["_end", *within], "left").select(*within, "_child", "_end", F.col("_on").isNull().alias("_last")))
    done, known = moved.filter("_last").drop("_last"), moved
    while True:
        now = moved.filter("NOT _last")
        if now.isEmpty() or moved.filter("_last").isEmpty():
            return done.select(*within, F.col("_child").alias(child), F.col("_end").alias("end"))
        after = known.select(*within, F.col("_child").alias("_end"), F.col("_end").alias("_next"), "_last")
        moved = written(now.drop("_last").join(after.hint("merge"), ["_end", *within]).select(*within, "_child", F.col("_next").alias("_end"), "_last", F.col("_end").alias("_over")))
        done = done.unionByName(moved.filter("_last").select(*within, "_child", "_end"))
        # A node that goes on now points where the node it went over pointed before.  So what the next round looks up is a node of
        # this round, or one that was at its end already and that a node of this round went over: earlier rounds aren't read again.
        ended = moved.filter("_last").select(*within, F.col("_over").alias("_child"), "_end", "_last").distinct()
        known = moved.drop("_over").unionByName(ended)
