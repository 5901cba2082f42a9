import pyarrow as pa

from plumbline import rules
from plumbline.sources import config, diffs


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_numstat(spark):
    got = diffs.numstat(lines(spark, "3\t1\ta.cs", "-\t-\tb.bin", "x", "7\t0\tdir/c d.cs")).collect()
    assert [(r.path, r.added) for r in got] == [("a.cs", 3), ("dir/c d.cs", 7)]


def test_side_tables(spark):
    assert [r.n for r in diffs.side_table(lines(spark, "5|a", "bad", "1|b|c"), ["n", "path"]).collect()] == ["5"]
    row = diffs.removed_table(lines(spark, "h|abc|fix a|b now|3")).first()
    assert (row.hash, row.sha, row.subject, row.ago) == ("h", "abc", "fix a|b now", 3)
    assert diffs.removed_table(lines(spark, "h|abc|s|soon")).first().ago == 0


def test_diff_lines_are_numbered_on_the_new_side(spark):
    patch = "commit abcdef1234 Fix it\n+++ b/C.cs\n@@ -10,2 +20,3 @@\n ctx\n-old\n+one\n+two\n@@ -40 +51 @@\n+three"
    rows = diffs.diff_lines(spark.createDataFrame([("s", patch)], "source string, text string")).collect()
    assert [(r.sign, r.new_line, r.text, r.sha, r.ago) for r in rows] == [
        ("-", 21, "old", "abcdef1", 1), ("+", 21, "one", "abcdef1", 1), ("+", 22, "two", "abcdef1", 1), ("+", 51, "three", "abcdef1", 1)]


def test_settings(spark):
    near = "a = 1\n[*.cs]\nb = 2\n[*.md]\nc = 3\n[*.{cs,vb}]\nd = 4"
    far = "root = true\na = 9\n[*]\ne = 5"
    got = {r.key: (r.value, r.depth) for r in config.config_rows(spark, [near, far, "x = 1"]).collect() if r.key != "a" or r.depth == 0}
    assert got == {"a": ("1", 0), "b": ("2", 0), "d": ("4", 0), "e": ("5", -1)}


def test_option_parsers():
    assert config.bounded_int({"k": "7"}, "k", 3, 1, 9) == 7
    assert [config.bounded_int({"k": v}, "k", 3, 1, 9) for v in ("0", "10", "x", "")] == [3, 3, 3, 3]
    assert config.pairs("A>B; C > D;;x") == [("A", "B"), ("C", "D")]
    assert config.assignments("P=a,b;Q=") == [("P", ["a", "b"])]
    assert config.current_prompt("", "env") == "" and config.current_prompt(None, " env ") == "env"


def test_runs_and_files_that_are_not_tracked(spark):
    log = "commit abcdef123 Drop it\n--- a/C.cs\n+++ b/C.cs\n@@ -1,4 +1 @@\n-var a = 1;\n-var b = 2;\n-return a;\n\x1efff000999\x1folder\n@@ -1 +1 @@\n-x();"
    text = spark.createDataFrame([("s", log)], "source string, text string")
    removed = diffs.removed_runs(diffs.diff_lines(text))
    assert sorted((r.sha, r.subject, r.ago, r.lines) for r in removed.collect()) == [("abcdef1", "Drop it", 1, ["var a = 1;", "var b = 2;", "return a;"]), ("fff0009", "older", 2, ["x();"])]
    assert diffs.removed_runs(diffs.diff_lines(text), newest=1).count() == 1
    patch = spark.createDataFrame([("s", "+++ b/D.cs\n@@ -9 +9,3 @@\n+var a = 1;\n+var  b = 2;\n+return a;\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone")], "source string, text string")
    files = spark.createDataFrame([("E.cs", "one\nvar a = 1;\nvar b = 2;\nreturn a;\n"), ("F.cs", None), ("G.cs", "")], "path string, text string")
    added = diffs.added_runs(diffs.diff_lines(patch)).unionByName(diffs.whole_files(files))
    found = rules.run({"removed_text": removed, "added_text": added}, {}, ["ARCH027"]).collect()
    assert sorted((r.path, r.line, r.args["sha"]) for r in found) == [("D.cs", 9, "abcdef1"), ("E.cs", 2, "abcdef1")]
    tracked = diffs.numstat(spark.createDataFrame([("3\t1\tA.cs",), ("-\t-\tb.png",)], "value string"))
    counts = diffs.added_counts(tracked, files)
    assert sorted(map(tuple, counts.collect())) == [("A.cs", 3), ("E.cs", 4), ("F.cs", 0), ("G.cs", 0)]
    mine = diffs.in_project(counts, spark.createDataFrame([("P", "a.CS"), ("P", "a.cs"), ("Q", "x.cs")], "project string, path string"))
    assert [(r.path, r.project) for r in mine.collect()] == [("A.cs", "P")]


def test_patches_share_batches(spark, monkeypatch):
    """Rows of many short texts come in one batch and those of a long one in several; runs are those of the lines."""
    taken = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, f, schema: taken.append(f) or df)
    head = "commit 1234567 s\n+++ b/a.cs\n@@ -1 +4 @@\n"
    texts = [head + "+x\n+y\n-z\n q\n-w"] * 50 + [None, "", head + "+v\n" * 900]
    df = spark.createDataFrame([(None if i == 3 else 2**60 + i, t) for i, t in enumerate(texts)], "source long, text string")
    diffs.diff_lines(df), diffs.diff_runs(df)
    monkeypatch.setattr(diffs, "BATCH_ROWS", 250)
    read = pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()], pa.schema([("source", pa.int64()), ("text", pa.string())]))
    lines, runs = (list(f(iter([read]))) for f in taken)
    assert [len(b) for b in lines] == [250, 250, 250, 250, 100] and [len(b) for b in runs] == [151]
    rows = [r for b in lines for r in b.to_pylist()]
    assert {r["source"] for r in rows} == {None if i == 3 else 2**60 + i for i in range(53) if i not in (50, 51)}
    first = [(r["sign"], r["first_line"], r["lines"]) for r in runs[0].to_pylist()[:3]]
    assert first == [("+", 4, ["x", "y"]), ("-", 6, ["z"]), ("-", 7, ["w"])] and len(runs[0].to_pylist()[-1]["lines"]) == 900
    assert [(r["sign"], r["new_line"], r["text"], r["seq"]) for r in rows[:4]] == [("+", 4, "x", 0), ("+", 5, "y", 1), ("-", 6, "z", 2), ("-", 7, "w", 3)]
