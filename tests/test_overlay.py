import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.patterns import is_named, name_pattern
from plumbline.functions.types import may_name, nominal_names
from plumbline.rules import run
from plumbline.sources import overlay
from plumbline.sources.config import parse_settings


def brute(path, layers):
    """layers: folder to text."""
    parts, out = path.split("/")[:-1], {}
    for k in range(len(parts), -1, -1):
        folder = "/".join(parts[:k])
        if folder in layers:
            rows, root = parse_settings(layers[folder] or "")
            out = {k: v for k, v, _ in rows} | out
            if root:
                break
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_every_file_has_the_settings_of_the_way_up(spark, monkeypatch, limit):
    monkeypatch.setattr(overlay, "BROADCAST_CHARS", limit)
    r = random.Random(5)
    folders = ["", "a", "a/b", "a/b/c", "d", "d/e", "A", "ab"]
    layers = {}
    for f in folders:
        lines = [f"{r.choice(['indent', 'Width', 'eol'])} {r.choice(['=', ' = '])}{r.choice(['1', '2', '', 'x = y'])}" for _ in range(r.randint(0, 4))]
        lines += r.choice([["[*.md]", "indent = no"], ["[*.{vb,cs}]", "width = 5"], ["[*]", "root = true"], []])
        layers[f] = "\r\n".join((["root = true"] if f in ("a/b", "d") else ["# root = true"]) + lines)
    layers["ab"] = None
    paths = [f"{f}/f{i}.cs".lstrip("/") for i, f in enumerate(folders + ["a/b/c/d/e", "x/y", "a/x", "d/e/f"])] + ["a//b/two.cs", "a/b/f2.cs"]
    files = spark.createDataFrame([(f"{f}/.settings".lstrip("/"), t) for f, t in layers.items()], "path string, text string")
    frame = spark.createDataFrame([(p, "own") for p in paths] + [(None, "own")], "path string, folder string")
    got = {x.path: x.settings for x in overlay.effective(frame, overlay.layers(files)).collect()}
    assert got.pop(None) == {}
    assert got == {p: brute(p.replace("//", "/"), layers) for p in paths}


def test_no_layers_and_no_files(spark):
    files = spark.createDataFrame([("a/b.cs",)], "path string")
    none = overlay.layers(spark.createDataFrame([], "path string, text string"))
    assert [x.settings for x in overlay.effective(files, none).collect()] == [{}]
    assert overlay.effective(files.limit(0), none).collect() == []


def test_several_files_of_one_folder(spark):
    files = spark.createDataFrame([("a/2.ini", "x = 2\ny = 2"), ("a/1.ini", "x = 1\nz = 1\nroot = true")], "path string, text string")
    row = overlay.layers(files).first()
    assert (row.folder, row.is_root, row.settings) == ("a", True, {"x": "2", "y": "2", "z": "1"})


TYPES = {
    "int": ["Int32"], "Order[]": ["Order"], "Order?": ["Order"], "List<Order[][]>": ["List", "Order"], "global::A.B.Order": ["Order"],
    "Dictionary<string, List<Shop.Order?>>": ["Dictionary", "String", "List", "Order"], "T": [], "List<T>": ["List"], "dynamic": [], "int*": [],
    "Order*[]": [], "Span<Order>*": [], "Func<Order*, Item>": ["Func", "Item"], "A<Order>.B<Item>.C": ["C"], "A<Order>.B<Item>": ["B", "Item"],
    "(Order first, List<Item> second)": ["ValueTuple", "Order", "List", "Item"], "(Order, (Item a, T))[]": ["ValueTuple", "Order", "ValueTuple", "Item"],
    "Order[,,]": ["Order"], "Pair<Order[,], Item>": ["Pair", "Order", "Item"], "@event": ["event"], "": [], "List<": ["List"], ">>>": [], "ThisT<TT>": ["ThisT", "TT"],
}


def test_names_inside_types(spark):
    df = spark.createDataFrame([(t, ["T"]) for t in [*TYPES, None]], "t string, p array<string>")
    got = {r[0]: r[1] for r in df.select("t", nominal_names(df["t"], df["p"])).collect()}
    assert got == {**TYPES, None: None}
    assert df.select(nominal_names(df["t"])).filter("t = 'List<T>'").first()[0] == ["List", "T"]
    deep = "A<" * 60 + "Order" + ">" * 60
    assert spark.createDataFrame([(deep,)], "t string").select(nominal_names(F.col("t"))).first()[0] == ["A"] * 60 + ["Order"]


def test_only_texts_that_may_hold_a_forbidden_name_are_read(spark):
    """A name may be spelled by a keyword or a tuple's bracket; a text without it is never one that uses the name."""
    patterns = ["*Order", "Order", "Ord*", "*rde*", "Int32", "*Int32", "String", "Value*", "ValueTuple", "*T", "event", "*", "**", "dynamic", "nobody"]
    df = spark.createDataFrame([(t, p) for t in [*TYPES, None, "Int32", "A.@", "@", "(a b)", "x (y)"] for p in [["T"], None, ["T", None]]], "t string, p array<string>")
    used = lambda p: F.exists(nominal_names(df["t"], df["p"]), lambda n: name_pattern(n, p))
    uses = [F.coalesce(used(p), F.lit(False)) for p in patterns]
    rows = df.select("t", nominal_names(df["t"], df["p"]).alias("names"), F.array(*uses).alias("uses"), F.array(*[F.coalesce(may_name(df["t"], p), F.lit(False)) for p in patterns]).alias("may")).collect()
    for row in rows:
        assert row.uses == [any(is_named(n, p) for n in row.names or []) for p in patterns], row
        assert all(may or not use for may, use in zip(row.may, row.uses, strict=True)), row
    assert sum(use for row in rows for use in row.uses) < sum(may for row in rows for may in row.may) < sum(len(row.may) for row in rows) / 3


def test_a_rule_sees_whether_a_text_may_matter_before_it_reads_names(spark):
    rows = [(t, o, k, e) for t in [*TYPES, None, ""] for o in ["AModule", "ModuleB", "Other", "", None] for k, e in [("class", None), ("class", True), ("interface", False), (None, False)]]
    facts = {"parameter": spark.createDataFrame([("P", "f.cs", 1, o, k, "Run", t, ["T"], e) for t, o, k, e in rows],
             "project string, path string, line int, type_name string, type_kind string, method string, type_text string, type_parameters array<string>, is_error boolean")}
    found = run(facts, {"method_argument_type_barrier": "*Module>*rder,Int32;Module*>Value*;X>*"}, ["ARCH016"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    (judged,) = [x for x in plan.splitlines() if "Filter" in x]
    assert "Contains(" in judged.split("regexp_extract_all")[0]
    want = []
    for t, names in TYPES.items():
        want += ["AModule.Run *Module>*rder"] * any(n.endswith("rder") for n in names) or ["AModule.Run *Module>Int32"] * ("Int32" in names)
        want += ["ModuleB.Run Module*>Value*"] * any(n.startswith("Value") for n in names)
    assert sorted(f"{r.subject} {r.args['rule']}" for r in found.collect()) == sorted(want) and len(set(want)) == 3
