import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.text import lines_of
from plumbline.operators import blocks, budgets, conventions, duplicates, gates, ratchets, sequences


def test_convention_needs_support_and_ratio(spark):
    rows = [(i, "Provider", "Providers") for i in range(4)] + [(4, "Provider", "Services")]
    df = spark.createDataFrame(rows, "id int, suffix string, folder string")
    found = conventions.modal_convention(df, ["id"], ["suffix"], ["folder"], 3, 75).collect()
    assert [(r.id, r.actual, r.expected, r.matching, r.total) for r in found] == [(4, "Services", "Providers", 4, 5)]
    assert not conventions.modal_convention(df, ["id"], ["suffix"], ["folder"], 10, 75).collect()
    assert not conventions.modal_convention(df, ["id"], ["suffix"], ["folder"], 3, 90).collect()
    assert not conventions.modal_convention(df, ["id"], ["suffix"], ["folder"], 3, 75, [("Provider", "folder")]).collect()
    assert not conventions.modal_convention(df, ["id"], ["suffix"], ["folder"], 3, 75, changed=df.filter("id = 1")).collect()


def test_most_specific_group_decides(spark):
    rows = [(i, "XY", "Y", "one") for i in range(5)] + [(i + 10, None, "Y", "two") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, wide string, narrow string, t string")
    assert not conventions.modal_convention(df, ["id"], ["wide", "narrow"], ["t"], 5, 80).collect()


def test_modal_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a")], "g string, v string")
    assert conventions.modal_values(df, ["g"], "v").first().expected == "a"


def test_ratchet(spark):
    head = spark.createDataFrame([("C", 1), ("C", 3), ("D", 1)], "k string, m int")
    now = spark.createDataFrame([("C", 3), ("D", 3), ("E", 9)], "k string, m int")
    assert [(r.k, r.before, r.after) for r in ratchets.ratchet(head, now, ["k"], "m").collect()] == [("D", 1, 3)]
    assert not ratchets.ratchet(head, now, ["k"], "m", 2).collect()


def test_nearest_rank(spark):
    counts = spark.createDataFrame([(i, i) for i in range(1, 11)], "k int, n int")
    assert ratchets.percentile_threshold(counts, "n", 90).first().threshold == 9
    assert ratchets.percentile_threshold(counts.filter("n < 3"), "n", 90).first().threshold == 3
    assert not ratchets.hotspot(counts.limit(0), "n").collect()


def test_near_duplicates_and_copies(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, a.replace("w59", "x")), (3, a), (4, " ".join(f"v{i}" for i in range(60))), (5, "too short")]
    df = spark.createDataFrame(rows, "id int, t string")
    pairs = duplicates.near_duplicate(df, "id", F.split("t", " "), similarity=80).collect()
    assert [(r.a, r.b, r.similarity) for r in pairs] == [(1, 2, 98)]
    assert sorted((r.id, r.first, r.copies) for r in duplicates.exact_duplicates(df, "id", F.col("t")).collect()) == [(1, 1, 2), (3, 1, 2)]


def test_repeated_shingles_count(spark):
    df = spark.createDataFrame([(1, "a " * 20 + "a"), (2, "a " * 10 + "a")], "id int, t string")
    assert not duplicates.near_duplicate(df, "id", F.split("t", " "), similarity=80).collect()
    assert duplicates.near_duplicate(df, "id", F.split("t", " "), similarity=40).first().similarity == 41


def windows(spark, text):
    df = spark.createDataFrame([("f", text)], "path string, text string")
    return [(r.line, r.window) for r in blocks.line_windows(df, ["path"], lines_of(F.col("text"))).orderBy("line").collect()]


def test_windows_survive_indentation_and_break_at_trivial_lines(spark):
    assert windows(spark, "a b\nc\nd") == windows(spark, "  a\tb\n\tc\n d  ")
    assert windows(spark, "a\nb\n}\nc\nd") == []
    assert [n for n, _ in windows(spark, "{\na\nb\nc\nd\n")] == [2, 3]


def test_greedy_suppression(spark):
    df = spark.createDataFrame([("f", x) for x in (3, 4, 5, 6, 7, 9)], "path string, line int")
    assert sorted(r.line for r in blocks.greedy_suppress(df, ["path"], "line").collect()) == [3, 6, 9]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), max_size=25))
def test_suppressed_positions_keep_their_distance(spark, xs):
    df = spark.createDataFrame([("f", x) for x in xs], "path string, line long")
    kept = sorted(r.line for r in blocks.greedy_suppress(df, ["path"], "line").collect())
    assert all(b - a >= 3 for a, b in zip(kept, kept[1:])) and (not xs or kept[0] == min(xs))


def test_newest_removal_wins(spark):
    removed = spark.createDataFrame([("w", "old", 5), ("w", "new", 1)], "window string, sha string, ago int")
    assert blocks.newest_windows(removed, ["ago"], ["sha", "ago"]).first().sha == "new"


def test_order_and_logs(spark):
    df = spark.createDataFrame([("C", 1, "Save"), ("C", 2, "Delete"), ("C", 3, "Zap"), ("D", 1, "A")], "t string, i int, n string")
    assert [(r.n, r.previous) for r in sequences.order_violation(df, ["t"], ["i"], "n").collect()] == [("Delete", "Save")]
    log = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "ts int, k string").withColumn("u", F.lit(1))
    assert [r.ts for r in sequences.change_log_dedup(log, ["u"], ["ts"], "k").orderBy("ts").collect()] == [1, 3, 5]


def test_layers_chains_steps(spark):
    conf = spark.createDataFrame([("k", "1", 0, 9), ("k", "2", 1, 1), ("k", "3", 1, 2)], "key string, value string, depth int, ord int")
    assert sequences.layered_config(conf).first().value == "3"
    hits = spark.createDataFrame([(1, None), (2, 1), (3, 2), (5, 4)], "id int, up int")
    assert sorted(r.id for r in sequences.chain_top(hits, ["id"], ["up"]).collect()) == [1, 5]


def test_budgets(spark):
    df = spark.createDataFrame([(1000, 30), (1000, 10), (0, 5)], "baseline int, added int")
    assert [r.added for r in budgets.over_budget(df, 2).collect()] == [30]
    ratio = spark.createDataFrame([(200, 10), (200, 50), (20, 0), (0, 120)], "production int, tests int")
    assert [r.tests for r in budgets.ratio_gate(ratio, "tests", "production", 20).collect()] == [10]
    assert sorted(r.tests for r in budgets.ratio_gate(ratio, "tests", "production", 20, 10).collect()) == [0, 10]
    assert budgets.ratio_gate(ratio, "tests", "production", 0).count() == 0
    assert budgets.ratio_gate(ratio, "tests", "production", 20, 0).count() == 2  # nothing is divided by zero


def test_gates(spark):
    need = spark.createDataFrame([(1, "a"), (1, "b")], "p int, f string")
    have = spark.createDataFrame([(1, "a"), (2, "b")], "p int, f string")
    assert [r.f for r in gates.required_group(need, have, ["p", "f"]).collect()] == ["b"]
    own = spark.createDataFrame([("T",), ("U",)], "n string")
    known = spark.createDataFrame([("T", "z"), ("T", "a")], "n string, owner string")
    assert [(r.n, r.owner) for r in gates.name_collision(own, known, "n", "owner").collect()] == [("T", "a")]
    assert not gates.name_collision(own, known, "n", "owner", ["T"]).collect()


def test_barrier_first_rule_wins(spark):
    refs = spark.createDataFrame([("My.Portal", "My.Domain", "a/X.cs"), ("My.Portal", "Other", "a/Y.cs")], "s string, t string, p string")
    rules = [("Portal", "Domain"), ("My.Portal", "My")]
    assert [r.rule for r in gates.barrier(refs, "s", "t", rules, "p").collect()] == ["Portal>Domain"]
    assert not gates.barrier(refs, "s", "t", rules, "p", ["x.cs"]).collect()
    assert not gates.barrier(refs, "s", "t", [], "p").collect()


def test_pattern_barrier(spark):
    df = spark.createDataFrame([("OrderModule", ["List", "OrderDataModel"]), ("Other", ["OrderDataModel"])], "c string, t array<string>")
    assert [r.c for r in gates.pattern_barrier(df, "c", "t", [("*Module", "*DataModel")]).collect()] == ["OrderModule"]


def test_link_gate(spark):
    schema = "type_name string, name string, arity int, body_hash string, body_lines long"
    now = spark.createDataFrame([("C", "Add", 2, "n", 9), ("C", "Old", 1, "s", 9), ("C", "Grew", 1, "b", 9), ("C", "Tiny", 0, "t", 1)], schema)
    head = spark.createDataFrame([("C", "Old", 1, "s", 9), ("C", "Grew", 1, "a", 2)], schema)
    due = gates.accountable_members(now, head, ["type_name", "name", "arity"], 5)
    assert sorted(r.name for r in due.collect()) == ["Add", "Grew"]
    tests = spark.createDataFrame([("C", "t1", ["Add"]), ("C", "t2", ["X"])], "type_name string, test string, called array<string>")
    left = gates.link_gate(due, tests, "type_name", "name", "called", "test").collect()
    assert [(r.name, r.evidences) for r in left] == [("Grew", 2)]


def test_best_match(spark):
    df = spark.createDataFrame([("OrderDataModel",), ("Model",), ("x",)], "n string")
    rules = [{"s": "Model"}, {"s": "DataModel"}]
    got = gates.best_match(df, rules, lambda r: F.endswith("n", F.lit(r["s"])), lambda r: len(r["s"])).collect()
    assert [r.rule for r in got] == [1, 0, None]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(0, 11), max_size=3)), max_size=25))
def test_first_partner_is_that_of_all_pairs(spark, variants):
    """Variants of three texts, some words replaced: the first partner found without all pairs is the first of all pairs."""
    rows = []
    for i, (base, places) in enumerate(variants):
        words = [f"t{base}w{j}" for j in range(30)]
        for j in places:
            words[j] = f"x{i}"
        rows.append((i, i % 2, " ".join(words)))
    df = spark.createDataFrame(rows, "id int, p int, t string")
    for within in (None, "p"):
        pairs = duplicates.near_duplicate(df, "id", F.split("t", " "), similarity=60, within=within)
        expected = {(r.a, r.b, r.similarity) for r in duplicates.first_report(pairs, [F.col("a")]).collect()}
        first = duplicates.first_near_duplicate(df, "id", F.split("t", " "), similarity=60, within=within, ahead=2)
        assert {(r.a, r.b, r.similarity) for r in first.collect()} == expected


def test_partner_behind_candidates_that_fail(spark):
    """Many share the head of a text and no more; the one that is similar comes after them."""
    head = [f"h{j}" for j in range(20)]
    rows = [(i, " ".join(head + [f"r{i}x{j}" for j in range(8)])) for i in range(12)]
    rows += [(20, " ".join(head + [f"s{j}" for j in range(8)])), (21, " ".join([*head, *(f"s{j}" for j in range(7)), "end"]))]
    df = spark.createDataFrame(rows, "id int, t string")
    found = duplicates.first_near_duplicate(df, "id", F.split("t", " "), similarity=90)
    assert [(r.a, r.b) for r in found.collect()] == [(20, 21)]
    assert duplicates.first_near_duplicate(df.limit(0), "id", F.split("t", " ")).count() == 0


def test_a_frequent_ending_stays_in_all_tasks(spark):
    """Who is judged is settled before rows are spread, and conventions are sent to the rows, so no task gathers an ending's rows."""
    df = spark.range(2000).select(F.col("id"), F.lit("Model").alias("suffix"), F.when(F.col("id") % 100 == 0, "odd").otherwise("same").alias("folder"), F.lit("x").alias("base"))
    changed = df.filter("id % 50 = 0")
    found = conventions.modal_convention(df, ["id"], ["suffix"], ["folder", "base"], 5, 90, changed=changed)
    assert sorted((r.id, r.trait, r.expected, r.matching, r.total) for r in found.collect()) == [(i, "folder", "same", 1980, 2000) for i in range(0, 2000, 100)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "Join Inner" in joins[0] and "strategy=broadcast" in joins[0] and "Join LeftSemi" in joins[1]
    assert plan.index("Join LeftSemi") > plan.index("Generate explode")


def test_shingles_are_counted_in_their_row_and_shuffled_once(spark, monkeypatch):
    rows = spark.createDataFrame([(0, [3, 1, 3, 3, 2]), (1, []), (2, None), (3, [7])], "id int, x array<bigint>")
    found = {r.id: r.b and [(e["shingle"], e["c"]) for e in r.b] for r in rows.select("id", duplicates.bag(F.col("x")).alias("b")).collect()}
    assert found == {0: [(1, 1), (2, 1), (3, 3)], 1: None, 2: None, 3: [(7, 1)]}
    plans = []
    monkeypatch.setattr(duplicates, "written", lambda df: plans.append(df) or df)
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 3} " * 3) for i in range(9)], "id long, text string")
    duplicates._bags(docs, "id", F.split("text", " "), 5, 80, 0, None)
    plans[0].collect()
    final = plans[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # What all occurrences go through: one shuffle by shingle, read twice.
    assert "hashpartitioning(id" in final and sum("Exchange hashpartitioning(shingle" in x and "Reused" not in x for x in final.splitlines()) == 1
    assert "ReusedExchange" in final


@pytest.mark.parametrize("slots", [1 << 24, 16])
def test_only_prefixes_leave_their_row(spark, monkeypatch, slots):
    """Of a content only its rarest shingles are shuffled, and no pair is lost, even if all shingles share a few slots."""
    monkeypatch.setattr(duplicates, "SLOTS", slots)
    monkeypatch.setattr(duplicates, "PAGE", min(slots, 1 << 16) // 2)
    r = random.Random(2)
    rows = []
    for i in range(40):  # few different words, so that strangers share shingles, too
        words = [r.choice("abc") for _ in range(60)] if i % 4 == 0 else rows[-1][2].split()
        for _ in range(r.randint(0, 2)):
            words = [*words]
            words[r.randrange(len(words))] = r.choice("abcd")
        rows.append((i, "p" if i < 30 else None if i > 36 else "q", " ".join(words)))
    df = spark.createDataFrame([*rows, (None, "p", rows[0][2])], "id int, p string, t string")
    for within in (None, "p"):
        first, want = {}, set()
        for i, p, t in rows:
            first.setdefault((p if within else 0, t), i)
        bags = {i: (w, Counter(zip(*[t.split()[j:] for j in range(5)]))) for (w, t), i in first.items()}
        for a, (w, x) in bags.items():
            for b, (v, y) in bags.items():
                percent = (x & y).total() * 100 // max(x.total(), y.total())
                if a < b and w == v and w is not None and percent >= 80:
                    want.add((a, b, percent))
        got = {tuple(p) for p in duplicates.near_duplicate(df, "id", F.split("t", " "), within=within).collect()}
        assert got == want and want
    contents = duplicates._contents(df, "id", F.split("t", " "), 5, 0, None)
    kept, n = duplicates._prefixes(contents, 5, 80).selectExpr("sum(size(prefix))", "sum(n)").first()
    assert kept <= n * 0.25
