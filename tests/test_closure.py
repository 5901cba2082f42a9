import random

import pytest

from plumbline.operators import closure
from plumbline.plans.diagnostics import with_message
from plumbline.rules import names, run, structure


def reach(edges):
    out = set()
    for n in {a for a, _ in edges}:
        seen, stack = set(), [n]
        while stack:
            top = stack.pop()
            for x in [b for a, b in edges if a == top and b not in seen]:
                seen.add(x)
                stack.append(x)
        out |= {(n, x) for x in seen if x != n}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_closure_equals_search(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(20), r.randrange(20)) for _ in range(r.choice([5, 25, 45]))}  # with circles and loops
    rows = [(s, a, b) for s in ("x", "y") for a, b in edges if s == "x" or a % 2] + [("x", None, 3), ("x", 3, None)] + [("x", a, b) for a, b in edges]
    df = spark.createDataFrame(rows, "scope string, c long, p long")
    want = {("x", *e) for e in reach([(a, b) for a, b in edges if a != b])} | {("y", *e) for e in reach([(a, b) for a, b in edges if a % 2 and a != b])}
    got = [tuple(x) for x in closure.closure(df, "c", "p", ["scope"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    to = spark.createDataFrame([("x", 3), ("y", 4), ("x", 99)], "scope string, p long")
    some = {tuple(x) for x in closure.closure(df, "c", "p", ["scope"], to).collect()}
    assert some == {w for w in want if (w[0], w[2]) in {("x", 3), ("y", 4)}}
    assert closure.closure(df.limit(0), "c", "p", ["scope"]).collect() == []


def test_a_long_chain_and_circles(spark):
    chain = [(i, i + 1) for i in range(70)]
    df = spark.createDataFrame([*chain, (100, 101), (101, 102), (102, 100), (103, 100), (5, 5), (None, 1)], "c long, p long")
    ends = {x.c: x.end for x in closure.chain_ends(df, "c", "p").collect()}
    assert ends == {i: 70 for i in range(70)}
    assert closure.chain_ends(df.limit(0), "c", "p").collect() == []


def test_cycles_take_no_rounds_of_their_own(spark, monkeypatch):
    """As many tables as the longest chain needs, whatever the number of rows; nodes at their end aren't written again; no broadcast."""
    rows = [(10 * i + j, 10 * i + j + 1) for i in range(300) for j in range(5)] + [(10 * i + j, 10 * i + 6 + (j + 1) % 3) for i in range(300) for j in (6, 7, 8)]
    tables, plans, write = [], [], closure.written
    monkeypatch.setattr(closure, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), tables.append(write(df)))[1] or tables[-1])
    found = closure.chain_ends(spark.createDataFrame(rows, "c long, p long"), "c", "p").collect()
    assert {(x.c, x.end) for x in found} == {(10 * i + j, 10 * i + 5) for i in range(300) for j in range(5)}
    assert [t.count() for t in tables] == [2400, 2400, 2100, 1800, 1200, 900][: len(tables)] and len(tables) <= 6
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_a_round_reads_the_table_of_the_last_one_only(spark, monkeypatch):
    """What ended in earlier rounds isn't read again; ends that many chains go over, in several scopes, are found all the same."""
    r = random.Random(3)
    edges = {(s, i): i - 1 if i % 40 else i + 5000 for s in "ab" for i in range(1, 400)}
    edges |= {(s, i): r.choice([7, 7, 7, r.randrange(1, 400), r.randrange(500, i + 1), i + 1]) for s in "abc" for i in range(500, 900)}

    def end(s, n):
        seen = set()
        while edges.get((s, n), n) != n and n not in seen:  # an edge to itself is none
            seen.add(n)
            n = edges[s, n]
        return None if n in seen else n

    want = {(s, n): end(s, n) for (s, n), p in edges.items() if p != n and end(s, n) is not None}
    rows = [(*k, v) for k, v in edges.items()] + [(*k, v + 9000) for k, v in edges.items() if k[1] % 3 == 0 and v != k[1]] + [("a", None, 7), ("a", 950, None), (None, 3, 2), (None, 2, 1)]
    read, write = [], closure.written
    monkeypatch.setattr(closure, "written", lambda df: read.append({f.rsplit("/", 1)[0] for f in df.inputFiles()}) or write(df))
    found = closure.chain_ends(spark.createDataFrame(rows, "s string, c long, p long"), "c", "p", ["s"]).collect()
    assert sorted((x.s, x.c, x.end) for x in found if x.s) == sorted((*k, v) for k, v in want.items())
    assert {(x.c, x.end) for x in found if x.s is None} == {(3, 2), (2, 1)}  # no scope is shared with another row's
    assert len(read) > 6 and [len(x) for x in read] == [0, *[1] * (len(read) - 1)]


TYPES = "project string, path string, name string, kind string, interfaces array<string>, base string, start_line int"


def test_a_provider_behind_base_types_is_found(spark):
    """Over a base interface, over a base class, over both, over types of another assembly; an interface itself is no finding."""
    folder = "M/Models/Data/Providers/"
    rows = [
        ("AModule", f"{folder}IOrders.cs", "IOrders", "interface", [], None, 1), ("AModule", f"{folder}IItems.cs", "IItems", "interface", ["IOrders"], None, 1),
        ("AModule", "M/Direct.cs", "Direct", "class", ["IOrders"], None, 1), ("AModule", "M/Wide.cs", "Wide", "class", ["IWide"], "Root", 1),
        ("AModule", "M/IWide.cs", "IWide", "interface", ["IItems"], None, 1), ("AModule", "M/Sub.cs", "Sub", "class", [], "Wide", 1),
        ("AModule", "M/Round.cs", "Round", "class", ["Round"], "Sub", 1), ("AModule", "M/Other.cs", "Other", "struct", ["IOther"], None, 1),
        ("BModule", "M/Sub.cs", "Sub", "class", [], "Wide", 1), ("AModule", "M/Far.cs", "Far", "class", [], "External", 1),
    ]
    facts = {"type_decl": spark.createDataFrame(rows, TYPES)}
    found = {(r.project, r.subject): r.args["interface"] for r in structure.provider_in_module(facts, {}).collect()}
    assert found == {("AModule", "Direct"): "IOrders", ("AModule", "Wide"): "IItems", ("AModule", "Sub"): "IItems", ("AModule", "Round"): "IItems"}
    facts["supertype"] = spark.createDataFrame([("AModule", "External", "IOrders")], "project string, name string, parent string")
    more = run(facts, {}, ["ARCH004"])
    assert {r.subject for r in more.collect()} == {"Direct", "Wide", "Sub", "Round", "Far"}
    assert "IOrders" in with_message(more.filter("subject = 'Far'")).first().message


def test_names_imposed_by_roots_of_overrides(spark):
    """The root decides: an external one imposes the name over any number of own overrides, an own one doesn't."""
    members = [("P", f"m{i}", "method", "Go", "f.cs", i) for i in range(8)] + [("Q", "x", "method", "Go", "f.cs", 1), ("P", "r1", "method", "Go", "g.cs", 1), ("P", "r2", "method", "Go", "g.cs", 2)]
    facts = {
        "member": spark.createDataFrame(members, "project string, member_id string, kind string, name string, path string, line int"),
        "overrides": spark.createDataFrame(
            [("P", "m0", "m1"), ("P", "m1", "m2"), ("P", "m2", "x"), ("P", "m3", "m4"), ("P", "m6", "m4"), ("P", "r1", "r2"), ("P", "r2", "r1")],
            "project string, member_id string, overridden string"),
        "implements": spark.createDataFrame([("P", "m5", "y"), ("P", "m6", "y"), ("P", "m7", "m4"), ("Q", "x", "q")], "project string, member_id string, interface_member string"),
    }
    assert {tuple(r) for r in names.imposed(facts).collect()} == {("P", "m0"), ("P", "m1"), ("P", "m2"), ("P", "m5"), ("Q", "x")}
    found = run(facts, {"min_method_name_length": "3"}, ["ARCH015"]).collect()
    assert sorted((r.project, r.path, r.line) for r in found) == [("P", "f.cs", 3), ("P", "f.cs", 4), ("P", "f.cs", 6), ("P", "f.cs", 7), ("P", "g.cs", 1), ("P", "g.cs", 2)]


def test_what_is_declared_is_joined_once(spark):
    """However many tables the ends of chains come from; null keys and rows that come twice are as they were."""
    rows = [("P", f"m{i}", f"m{i + 1}") for i in range(20)] + [("P", "m20", "x"), ("P", "m20", "x"), ("P", "n", None), (None, "m1", "m2"), ("Q", "q", "r"), ("R", "s", "s")]
    members = [("P", f"m{i}") for i in range(21)] * 2 + [("Q", "q"), ("Q", "r"), ("Q", None), (None, "m2"), ("R", "s"), ("R", "t")]
    direct = [("P", "n", "y"), ("Q", "t", "y"), ("Q", "t", "z"), ("Q", "u", None), (None, "v", "m2"), ("R", "s", "y"), ("Q", "w", "r")]
    facts = {
        "member": spark.createDataFrame(members, "project string, member_id string"),
        "overrides": spark.createDataFrame(rows, "project string, member_id string, overridden string"),
        "implements": spark.createDataFrame(direct, "project string, member_id string, interface_member string"),
    }
    found = names.imposed(facts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and len(found.inputFiles()) > 3
    assert sorted(map(tuple, found.collect()), key=str) == sorted([*[("P", f"m{i}") for i in range(21)], (None, "m1"), ("Q", "t"), ("Q", "u"), (None, "v")], key=str)


def test_generated_files_count_for_their_project(spark):
    rows = [("A", "M/T.cs", "T1", "class", [], None, 1), ("B", "M/T.cs", "T2", "class", [], None, 1)]
    files = spark.createDataFrame([("A", "M/T.cs", True), ("B", "M/T.cs", False)], "project string, path string, is_generated boolean")
    facts = {"type_decl": spark.createDataFrame(rows, TYPES), "source_file": files}
    assert {r.subject for r in run(facts, {"min_class_name_length": "9"}, ["ARCH014"]).collect()} == {"T2"}
