import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import trees
from plumbline.rules.code import counted_calls


def forest(r, sizes):
    """Rows (scope, tree, node, parent, ordinal, mark); numbers of nodes and children are in no order."""
    rows = []
    for t, n in enumerate(sizes):
        ids = r.sample(range(1000), n)
        used = {}
        for i, node in enumerate(ids):
            parent = None if i == 0 or r.random() < 0.05 else ids[r.randrange(max(0, i - 3), i)]
            free = [o for o in range(3 * n) if o not in used.setdefault(parent, set())]
            used[parent].add(o := r.choice(free))
            rows.append(("s", t, node, parent, o, r.random() < 0.15))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_labels_and_sweeps_equal_walks(spark, seed):
    r = random.Random(seed)
    rows = forest(r, [1, 2, 30, 80])
    want, place, children, marks = {}, 0, {}, {}
    for _, t, n, p, o, m in rows:
        children.setdefault((t, p), []).append((o, n))
        marks[t, n] = m

    def walk(t, n, under):
        nonlocal place
        place += 1
        pre, below = place, False
        for _, c in sorted(children.get((t, n), [])):
            below |= walk(t, c, under or marks[t, n])
        want[t, n] = (pre, place, under, below)
        return below or marks[t, n]

    for t in range(4):
        for _, root in sorted(children.get((t, None), [])):
            walk(t, root, False)
    schema = "scope string, tree long, node long, parent long, ordinal int, mark boolean"
    lost = [("s", 9, 1, 77, 0, True), ("s", 9, 2, 3, 0, True), ("s", 9, 3, 2, 0, True)]  # without a parent, and a circle
    labelled = trees.labels(spark.createDataFrame(rows + lost, schema).repartition(3), ["scope", "tree"])
    found = trees.encloses(trees.enclosed(labelled, F.col("mark"), "up"), F.col("mark"), "down").collect()
    got = {(x.tree, x.node): (x.pre, x.end, x.up, x.down) for x in found}
    assert {k: v for k, v in got.items() if k[0] == 9} == {(9, i): (None, None, None, None) for i in (1, 2, 3)}
    assert {k: v for k, v in got.items() if k[0] != 9} == want


def test_empty_forest(spark):
    empty = spark.createDataFrame([], "tree long, node long, parent long, ordinal int")
    assert trees.enclosed(trees.labels(empty, ["tree"]), F.lit(True)).collect() == []


BODIES = {
    "plain": ([(0, None, "body", None), (1, 0, "call", "Run"), (2, 1, "new", "Order")], {"Run", "Order"}),
    "nameof": ([(0, None, "body", None), (1, 0, "nameof", None), (2, 1, "call", "Run"), (3, 0, "typeof", None), (4, 3, "new", "Order"), (5, 0, "call", "Go")], {"Go"}),
    "swallowed": ([(0, None, "try", None), (1, 0, "block", None), (2, 1, "call", "Run"), (3, 0, "catch", None), (4, 3, "call", "Log")], {"Log"}),
    "swallowed type": ([(0, None, "try", None), (1, 0, "block", None), (2, 1, "other", None), (5, 2, "call", "Run"), (3, 0, "catch", "Exception")], None),
    "other type": ([(0, None, "try", None), (1, 0, "block", None), (2, 1, "call", "Run"), (3, 0, "catch", "IOException")], {"Run"}),
    "thrown on": ([(0, None, "try", None), (1, 0, "block", None), (2, 1, "call", "Run"), (3, 0, "catch", None), (4, 3, "other", None), (5, 4, "throw", None)], {"Run"}),
    "second swallows": ([(0, None, "try", None), (1, 0, "block", None), (2, 1, "call", "Run"), (3, 0, "catch", "A"), (6, 3, "throw", None), (4, 0, "catch", "Exception")], None),
    "outer swallows": ([(0, None, "try", None), (1, 0, "block", None), (2, 1, "try", None), (3, 2, "block", None), (4, 3, "call", "Run"), (5, 2, "catch", None), (6, 5, "throw", None), (7, 0, "catch", None), (8, 7, "call", "Log")], {"Log"}),
    "inner throw counts": ([(0, None, "try", None), (1, 0, "block", None), (2, 1, "call", "Run"), (3, 0, "catch", None), (4, 3, "try", None), (5, 4, "block", None), (6, 5, "throw", None)], {"Run"}),
    "finally": ([(0, None, "try", None), (1, 0, "block", None), (2, 0, "catch", None), (3, 0, "finally", None), (4, 3, "call", "Run")], {"Run"}),
}


def test_calls_that_count(spark):
    rows = [("t.cs", test, n, p, n, kind, name) for test, (nodes, _) in BODIES.items() for n, p, kind, name in nodes]
    nodes = spark.createDataFrame(rows, "path string, test string, node int, parent int, ordinal int, kind string, name string")
    got = {x.test: set(x.invoked) for x in counted_calls(nodes).collect()}
    assert got == {test: names for test, (_, names) in BODIES.items() if names}


def test_trees_in_rows_are_not_labelled(spark, monkeypatch):
    """Small trees take one shuffle of their nodes and no sweep; large ones are swept; nodes that no root leads to count for neither."""
    from plumbline.rules import code

    rows = [(f"{c}.cs", test, n, p, n, kind, name) for c in "ab" for test, (nodes, _) in BODIES.items() for n, p, kind, name in nodes]
    rows += [("a.cs", "lost", 0, None, 0, "body", None), ("a.cs", "lost", 1, 0, 1, "call", "Run"), ("a.cs", "lost", 5, 4, 0, "call", "No"), ("a.cs", "lost", 6, 7, 0, "new", "No"), ("a.cs", "lost", 7, 6, 0, "call", "No")]
    nodes = spark.createDataFrame(rows, "path string, test string, node int, parent int, ordinal int, kind string, name string")
    want = {(f"{c}.cs", test): names for c in "ab" for test, (_, names) in BODIES.items() if names} | {("a.cs", "lost"): {"Run"}}
    swept = []
    sweep = code._swept_calls
    monkeypatch.setattr(code, "_swept_calls", lambda df: swept.append(df) or sweep(df))
    for bound, n in ((1 << 17, 0), (6, 1), (0, 1)):
        monkeypatch.setattr(trees, "TREE_NODES", bound)
        swept.clear()
        assert {(x.path, x.test): set(x.invoked) for x in counted_calls(nodes).collect()} == want and len(swept) == n
    of = nodes.filter("path = 'b.cs'").select("path", "test")
    assert {(x.path, x.test): set(x.invoked) for x in counted_calls(nodes, of).collect()} == {k: v for k, v in want.items() if k[0] == "b.cs"}


def test_forest_equals_walking_up():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    tree, node, parent, mark = [], [], [], []
    for t in range(60):
        size = rng.choice([1, 2, 7, 40])
        names = rng.sample(range(1000), size)
        for i, name in enumerate(names):
            far = rng.choice([None, None, 5000, rng.choice(names)]) if rng.random() < 0.2 else names[i - 1 if t % 2 else rng.randrange(i)] if i else None
            tree.append(t), node.append(name), parent.append(far), mark.append(rng.random() < 0.1)
    up = {(t, n): p for t, n, p in zip(tree, node, parent)}
    marked = {(t, n) for t, n, m in zip(tree, node, mark) if m}
    above, below, placed = [], {k: False for k in up}, []
    for t, n in zip(tree, node):
        way, p = [], up[t, n]
        while p is not None and (t, p) in up and p not in way:
            way.append(p)
            p = up[t, p]
        placed.append(p is None)
        above.append(any((t, w) in marked for w in way))
        for w in way:
            below[t, w] |= (t, n) in marked
    forest = trees.Forest(np.array(tree), pa.array(node), pa.array(parent))
    there = np.array(placed)
    assert (forest.placed == there).all()
    assert (forest.enclosed(np.array(mark)) == np.array(above))[there].all()
    assert (forest.encloses(np.array(mark)) == np.array([below[t, n] for t, n in zip(tree, node)]))[there].all()
