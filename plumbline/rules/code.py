"""Rules on bodies, their history and their tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexer as L
from ..functions import patterns as P
from ..functions import text as X
from ..operators import blocks, conventions, duplicates, gates, ratchets, sequences
from ..operators.trees import Forest, enclosed, encloses, in_rows, labels, large_trees
from ..plans.diagnostics import report
from ..sources.config import bounded_int, items, pairs
from ..sources.tables import written

#: Attributes that mark tests, attributes that switch them off, and beginnings of assertions.
TEST_ATTRIBUTES = ("Fact", "Theory", "Test", "TestCase", "TestCaseSource", "TestMethod", "DataTestMethod")
IGNORING = ("Ignore", "Explicit")
TRAITS = ("folder", "namespace", "kind", "sealed", "static", "accessibility", "base")


def concatenations(facts: dict, options: dict) -> DataFrame:
    """Built-in ``+`` on strings that isn't constant, and ``+=``; a chain is reported once, at its top."""
    plus = (F.col("kind") == "binary") & (F.col("operator") == "+") & ~F.coalesce("is_constant", F.lit(False))
    compound = (F.col("kind") == "compound_assignment") & (F.col("operator") == "+=")
    hits = facts["operation"].filter((plus | compound) & F.col("is_builtin") & (F.col("result_type") == "string"))
    top = sequences.chain_top(hits, ["project", "path", "op_id"], ["project", "path", "parent_op_id"])
    return report(top, "ARCH017", F.col("operator"), F.col("path"), F.col("line"), F.col("project"))


def interpolations(facts: dict, options: dict) -> DataFrame:
    hits = facts["operation"].filter("kind = 'interpolation' AND n_holes > 0 AND NOT coalesce(is_constant, false)")
    return report(hits, "ARCH018", F.lit("$"), F.col("path"), F.col("line"), F.col("project"))


#: What readings may weigh, in bytes, to be sent to every task.
READINGS_SENT = 64 << 20


def from_source(members: DataFrame) -> DataFrame:
    """Members with what their ``body``, the source text, tells: complexity, body_hash, body_lines and tokens (its kinds).

    Columns of these names that are there already give way; a member without a body has complexity 0 and nulls.  Bodies that are
    equal, as most are on both sides of a change and in generated code, are read once: reading costs far more than moving.
    """
    own = members.drop("complexity", "body_hash", "body_lines", "tokens")
    session = own.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    # Few texts may lie together in one small partition; they are dealt over all tasks before they are read.
    texts = own.select("body").filter("body IS NOT NULL").distinct().repartition(tasks)
    found = F.col("_tokens")
    read = written(texts.withColumn("_tokens", L.tokens(L.lexemes(F.col("body")))).select(
        F.sha2("body", 256).alias("_key"), X.cyclomatic(L.branches(found)).alias("complexity"), L.body_hash(found).alias("body_hash"),
        L.token_lines(found).alias("body_lines"), found["kind"].alias("tokens"),
    ))
    weight = read.agg((F.count("*") * 256 + F.coalesce(F.sum(F.size("tokens")), F.lit(0)) * 24).alias("bytes")).first()["bytes"]
    # Members without a body find nothing, each under a key of its own, so that they make no crowd.
    none = F.concat(F.lit("-"), F.xxhash64(*[c for c, t in own.dtypes if not t.startswith(("map", "variant"))]).cast("string"))
    keyed = own.withColumn("_key", F.coalesce(F.sha2("body", 256), none)).drop("body")
    joined = keyed.join(F.broadcast(read) if weight <= READINGS_SENT else read.hint("merge"), "_key", "left").drop("_key")
    return joined.withColumn("complexity", F.coalesce("complexity", F.lit(0).cast("long")))


def duplicate_bodies(facts: dict, options: dict) -> DataFrame:
    """A later body that repeats an earlier one: each is reported once, with the first pair in order of length and place."""
    least = bounded_int(options, "duplicate_code_min_tokens", 30, 1)
    percent = bounded_int(options, "duplicate_code_similarity_percent", 90, 1, 100)
    place = F.struct(F.size("tokens").alias("n"), F.col("path").alias("path"), F.col("line").alias("line"))
    bodies = facts["member"].filter(F.col("tokens").isNotNull() & (F.size("tokens") >= least)).select(
        F.xxhash64("project", "path", "type_name", "name", "arity", "line").alias("id"), "project", "path", "line", place.alias("place"),
        X.display_name(F.col("type_name"), F.col("name")).alias("display"), F.transform("tokens", lambda t: t.cast("string")).alias("tokens"),
    )
    first = F.min_by("id", F.struct("place", "id"))
    keyed = bodies.withColumn("body", F.sha2(F.array_join("tokens", " "), 256))
    classes = keyed.groupBy("project", "body").agg(first.alias("first"), F.min("id").alias("class"), F.count("*").alias("n"))
    members = keyed.select("project", "body", "id").join(classes, ["project", "body"])
    exact = members.filter("n > 1 AND id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(100).cast("long").alias("similarity"))
    near = duplicates.near_duplicate(bodies, "id", F.col("tokens"), 5, percent, least, True, "project")
    # Equal bodies are equally long, so whichever member is the duplicate, its first pair is with the first of the other class.
    either = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    firsts = classes.select(F.col("class").alias("a"), "first")
    others = members.select(F.col("class").alias("b"), "id")
    near = either.join(firsts, "a").join(others, "b").select(F.col("first").alias("a"), F.col("id").alias("b"), "similarity")
    found = exact.unionByName(near)
    info = bodies.select("id", "project", "path", "line", "place", "display")
    for side in ("a", "b"):
        found = found.join(info.select(*[F.col(c).alias(f"{side}_{c}") for c in info.columns]), F.col(side) == F.col(f"{side}_id"))
    found = found.filter(F.col("a_project") == F.col("b_project"))
    # The pair's order is that of (tokens, file, line); the later one in the source is the duplicate.
    i, j = F.least("a_place", "b_place"), F.greatest("a_place", "b_place")
    later = F.struct("a_path", "a_line") > F.struct(F.col("b_path").alias("a_path"), F.col("b_line").alias("a_line"))
    pick = lambda c, x: F.when(later == F.lit(x), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    sides = found.select(
        i.alias("i"), j.alias("j"), "similarity", F.col("a_project").alias("project"), pick("id", True).alias("dup"),
        pick("display", True).alias("display"), pick("path", True).alias("path"), pick("line", True).alias("line"),
        pick("display", False).alias("original"),
    )
    order = Window.partitionBy("dup").orderBy("i", "j", "original")
    reported = sides.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return report(reported, "ARCH019", F.col("display"), F.col("path"), F.col("line"), F.col("project"), original=F.col("original"), similarity=F.col("similarity"))


def complexity(facts: dict, options: dict) -> DataFrame:
    """A member more complex than before; an error instead of a warning in a file that changes very often."""
    allowed = bounded_int(options, "complexity_ratchet_allowed_increase", 0, 0)
    keys = ["type_name", "name", "arity"]
    methods = facts["member"].filter("kind = 'method'")
    worse = ratchets.ratchet(facts["head_member"].select(*keys, "complexity"), methods.select("project", "path", "line", *keys, "complexity"), keys, "complexity", allowed)
    worse = worse.withColumn("key", F.upper("path"))
    if "churn" in facts:
        counts = facts["churn"].groupBy(F.upper("path").alias("key")).agg(F.sum("n").alias("n"))
        hot = ratchets.hotspot(counts, "n", bounded_int(options, "hotspot_churn_percentile", 90, 1, 99))
        worse = ratchets.ratchet_hotspot(worse, hot, "key", "n", "ARCH022", "ARCH023")
    else:
        worse = worse.withColumn("n", F.lit(0)).withColumn("level", F.lit("ARCH022"))
    return report(
        worse, F.col("level"), X.display_name(F.col("type_name"), F.col("name")), F.col("path"), F.col("line"), F.col("project"),
        before=F.col("before"), after=F.col("after"), churn=F.col("n"),
    )


def traits(types: DataFrame) -> DataFrame:
    """Top-level types with their traits and the last two words (wide) and the last word (narrow) of their names."""
    words = X.camel_words(F.col("name"))
    suffixes = X.camel_suffixes(F.col("name"))
    sealed = F.col("is_sealed") & ~F.col("is_static")
    return types.filter(~F.coalesce("is_nested", F.lit(False)) & (F.size(words) >= 2)).select(
        "project", "path", "name", "arity", "start_line",
        F.when(F.size(suffixes) == 2, suffixes[0]).alias("wide"), F.element_at(suffixes, -1).alias("narrow"),
        X.folder_display(X.dir_parts(F.col("path"))).alias("folder"),
        F.element_at(F.split(F.coalesce("namespace", F.lit("")), r"\.", -1), -1).alias("namespace"),
        "kind", sealed.alias("sealed"), F.col("is_static").alias("static"), "accessibility", "base",
    )


def inferred_conventions(facts: dict, options: dict) -> DataFrame:
    """Changed types that differ from what types of their project with their name's ending do."""
    governed = [s for s, _ in pairs(options.get("model_conventions"), "=")] or items(options.get("model_suffix"))
    ignore = pairs(options.get("convention_ignore")) + [(s, "folder") for s in governed]
    changed = facts["changed"].select(F.upper("path").alias("key")).distinct()
    types = traits(facts["type_decl"])
    judged = types.withColumn("key", F.upper("path")).join(changed, "key", "left_semi")
    entity = ["project", "path", "name", "arity", "start_line"]
    found = conventions.modal_convention(
        types, entity, ["wide", "narrow"], TRAITS, bounded_int(options, "convention_min_support", 5, 2),
        bounded_int(options, "convention_min_ratio", 90, 51, 100), ignore, judged, conventions.telling_trait, ["project"],
    )
    args = {c: F.col(c) for c in ("trait", "actual", "expected", "matching", "total")}
    return report(found, "ARCH024", F.col("name"), F.col("path"), F.col("start_line"), F.col("project"), suffix=F.col("group"), **args)


#: What a node is to the calls that count.
THROW, CATCH, BLOCK, MENTION, CALL = 1, 2, 3, 4, 5


def counted_calls(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """path, test, invoked: the names that the tests' bodies call or create; with ``of`` (path, test) those of these tests.

    nodes: path, test, node, parent, ordinal, kind, name, a row per node of a body.  What stands in ``nameof`` or ``typeof`` is
    mentioned, not called; what stands in the block of a ``try`` that catches everything and throws nothing on can't fail the test.
    A ``catch`` catches everything if it names no type or Exception; its ``throw`` may stand anywhere below it.
    """
    tree = ["path", "test"]
    large = written(large_trees(nodes, tree))
    some = not large.isEmpty()
    small = nodes.join(large, tree, "left_anti") if some else nodes
    kind, name = F.col("kind"), F.col("name")
    sort = (
        F.when(kind == "throw", THROW).when((kind == "catch") & (name.isNull() | (name == "Exception")), CATCH).when(kind == "block", BLOCK)
        .when(kind.isin("nameof", "typeof"), MENTION).when(kind.isin("call", "new") & name.isNotNull(), CALL).otherwise(0).cast("byte")
    )
    rows = in_rows(small, tree, "node", "parent", sort.alias("sort"), F.when(kind.isin("call", "new"), name).alias("name"))
    asked = rows if of is None else rows.join(of.select(*tree).distinct(), tree, "left_semi")
    kinds = dict(nodes.dtypes)
    calls = asked.mapInArrow(_counted, f"path {kinds['path']}, test {kinds['test']}, invoked array<string>")
    calls = calls.select(*tree, F.array_distinct("invoked").alias("invoked"))
    if some:
        wide = nodes.join(large, tree, "left_semi")
        calls = calls.unionByName(_swept_calls(wide if of is None else wide.join(of.select(*tree).distinct(), tree, "left_semi")))
    return written(calls)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("nodes")
        node, parent, sort, name = lists.flatten().flatten()
        tree = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        forest = Forest(tree, node, parent)
        sort = sort.to_numpy(zero_copy_only=False)
        silent = np.zeros(forest.n + 2, dtype=bool)
        silent[forest.parent[: forest.n][(sort == CATCH) & forest.placed & ~forest.encloses(sort == THROW)]] = True
        silent[forest.n :] = False
        # A try's block is silent if one of its catches is, and so is all that stands below it.
        quiet = (sort == BLOCK) & silent[forest.parent[: forest.n]]
        counts = ((sort == CALL) & forest.placed & ~forest.enclosed(quiet | (sort == MENTION))).nonzero()[0]
        number = np.bincount(tree[counts], minlength=len(lists))
        ends = np.concatenate([[0], np.cumsum(number)])
        # Nodes of a tree are neighbours, so those that count are in the order of the trees.
        invoked = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), name.take(pa.array(counts)))
        found = pa.RecordBatch.from_arrays([batch.column("path"), batch.column("test"), invoked], ["path", "test", "invoked"])
        yield found.filter(pa.array(number > 0))


def _swept_calls(nodes: DataFrame) -> DataFrame:
    """The same for trees of any size, by interval labels."""
    tree = ["path", "test"]
    labelled = written(labels(nodes, tree))
    catches = encloses(labelled, F.col("kind") == "throw").filter("kind = 'catch' AND NOT encloses AND (name IS NULL OR name = 'Exception')")
    silent = catches.select(*tree, "parent", F.lit(True).alias("silent")).distinct()
    marked = labelled.join(silent, [*tree, "parent"], "left").withColumn("silent", (F.col("kind") == "block") & F.coalesce("silent", F.lit(False)))
    found = enclosed(marked, F.col("silent") | F.col("kind").isin("nameof", "typeof"))
    calls = found.filter(F.col("kind").isin("call", "new") & ~F.col("enclosed") & F.col("name").isNotNull())
    return calls.groupBy(*tree).agg(F.collect_set("name").alias("invoked"))


def proving(options: dict) -> Column:
    """Of tests: whether they changed, run and assert."""
    names = items(options.get("test_attribute_names")) or list(TEST_ATTRIBUTES)
    attribute = F.exists("attributes", lambda a: P.any_of([F.endswith(a["name"], F.lit(n)) for n in names]))
    off = F.exists("attributes", lambda a: a["name"].isin(*IGNORING) | F.array_contains(a["named_args"], "Skip"))
    changed = F.col("head_hash").isNull() | (F.col("head_hash") != F.col("body_hash"))
    return attribute & ~off & changed & F.col("has_assertion")


def evidence(tests: DataFrame, options: dict) -> DataFrame:
    """type_name, test, called of tests that changed, run, assert and call something; a row per type the file refers to."""
    kept = tests.filter(proving(options) & (F.size("invoked") > 0))
    return kept.select(F.explode("type_refs").alias("type_name"), F.concat_ws("|", "path", "test").alias("test"), F.col("invoked").alias("called"))


def tested_changes(facts: dict, options: dict) -> DataFrame | None:
    """Changed members of changed files that no changed test of their type calls."""
    floor = bounded_int(options, "test_link_min_added_lines", 0, 0)
    if not floor:
        return None
    excluded = items(options.get("test_link_exclude_paths"))
    patterns = items(options.get("test_file_patterns")) or list(P.TEST_FILES)
    changed = facts["changed"].select(F.upper("path").alias("key")).distinct()
    members = facts["member"].filter(
        F.col("kind").isin("method", "ctor") & F.coalesce("has_body", F.lit(True)) & F.col("accessibility").isNotNull()
        & (F.col("accessibility") != "private") & ~P.contains_any(F.col("path"), patterns)
        & ~P.any_of([F.contains(F.upper("path"), F.lit(e.upper())) for e in excluded])
    ).withColumn("key", F.upper("path")).join(changed, "key", "left_semi")
    members = members.withColumn("called_name", F.when(F.col("kind") == "ctor", F.col("type_name")).otherwise(F.col("name")))
    due = gates.accountable_members(members, facts["head_member"], ["type_name", "name", "arity"], floor)
    tests = facts["test_method"].withColumn("key", F.upper("path")).join(changed, "key", "left_semi")
    if "test_node" in facts:
        asked = tests.filter(proving(options))
        tests = asked.drop("invoked").join(counted_calls(facts["test_node"], asked), ["path", "test"])
    found = gates.link_gate(due, evidence(tests, options), "type_name", "called_name", "called", "test")
    subject = X.display_name(F.col("type_name"), F.col("name"))
    return report(found, "ARCH025", subject, F.col("path"), F.col("line"), F.col("project"), evidences=F.col("evidences"))


def reappearing(facts: dict, options: dict) -> DataFrame:
    """Added blocks of three meaningful lines that a commit removed.

    removed_text: sha, subject, ago, lines (array) a row per removed run; added_text: path, first_line, lines, per added run.
    """
    removed = blocks.line_windows(facts["removed_text"], ["sha", "subject", "ago"], F.col("lines"))
    newest = blocks.newest_windows(removed.withColumn("at", F.col("line")), ["ago", "at"], ["sha", "subject", "ago"])
    added = blocks.line_windows(facts["added_text"], ["path"], F.col("lines"), F.col("first_line"))
    hits = blocks.reappearing_blocks(newest, added)
    kept = blocks.greedy_suppress(hits.select("path", "line").distinct(), ["path"], "line", 3)
    found = hits.join(kept, ["path", "line"], "left_semi")
    return report(
        found, "ARCH027", F.col("path"), F.col("path"), F.col("line"), None, sha=X.short_sha(F.col("sha")),
        subject_line=F.col("subject"), ago=F.col("ago"),
    )


RULES = {
    "ARCH017": (("operation",), concatenations),
    "ARCH018": (("operation",), interpolations),
    "ARCH019": (("member",), duplicate_bodies),
    "ARCH022": (("member", "head_member"), complexity),
    "ARCH024": (("type_decl", "changed"), inferred_conventions),
    "ARCH025": (("member", "head_member", "test_method", "changed"), tested_changes),
    "ARCH027": (("removed_text", "added_text"), reappearing),
}
