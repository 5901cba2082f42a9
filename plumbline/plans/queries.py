"""The generic operators bound to the star schema, the event log and the corpora."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions import patterns as P
from ..functions import text as X
from ..functions.types import nominal_names
from ..operators import blocks, budgets, closure, conventions, duplicates, gates, ranges, ratchets, sequences, trees
from ..operators.asof import as_of
from ..sources import churn, diffs, history, overlay, tables
from ..sources.tables import table
from .registry import query

# --- conventions ------------------------------------------------------------------------------------------------------


@query("""
    WITH r AS (SELECT conv_id, turn, turn % 2 AS parity, role FROM conversations),
         c AS (SELECT parity, role, count(*) AS n FROM r GROUP BY 1, 2),
         m AS (SELECT parity, role AS expected, n AS matching, sum(n) OVER (PARTITION BY parity) AS total,
                      row_number() OVER (PARTITION BY parity ORDER BY n DESC, role) AS k FROM c)
    SELECT conv_id, turn, parity::VARCHAR AS "group", 'role' AS trait, role AS actual, expected, matching::BIGINT AS matching,
           total::BIGINT AS total
    FROM r JOIN m USING (parity)
    WHERE k = 1 AND total >= 5 AND matching >= 5 AND matching * 100 >= total * 60 AND role <> expected""")
def convention_role(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("parity", F.col("turn") % 2)
    return conventions.modal_convention(turns, ["conv_id", "turn"], ["parity"], ["role"], 5, 60)


@query("""
    WITH d AS (SELECT doc_id, source, lang, CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS size FROM documents),
         u AS (SELECT doc_id, source, 'lang' AS trait, coalesce(lang, '') AS actual FROM d
               UNION ALL SELECT doc_id, source, 'size', coalesce(size, '') FROM d),
         c AS (SELECT source, trait, actual, count(*) AS n FROM u WHERE source IS NOT NULL GROUP BY ALL),
         m AS (SELECT source, trait, actual AS expected, n AS matching, sum(n) OVER (PARTITION BY source, trait) AS total,
                      row_number() OVER (PARTITION BY source, trait ORDER BY n DESC, actual) AS k FROM c)
    SELECT doc_id, source AS "group", trait, actual, expected, matching::BIGINT AS matching, total::BIGINT AS total
    FROM u JOIN m USING (source, trait)
    WHERE k = 1 AND total >= 5 AND matching >= 5 AND matching * 100 >= total * 55 AND actual <> expected
      AND doc_id IN (SELECT doc_id FROM labels)""")
def convention_multi_trait(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", "source", "lang", F.when(F.col("n_chars") < 1500, "short").otherwise("long").alias("size")
    )
    return conventions.modal_convention(
        docs, ["doc_id"], ["source"], ["lang", "size"], 5, 55, changed=table(spark, d, "labels")
    )


@query("""
    WITH p AS (SELECT p_partkey, p_brand || '/' || p_type AS fine, p_type AS coarse, split_part(p_name, ' ', 2) AS noun FROM part),
         u AS (SELECT p_partkey, 0 AS level, fine AS "group", noun FROM p UNION ALL SELECT p_partkey, 1, coarse, noun FROM p),
         c AS (SELECT level, "group", noun, count(*) AS n FROM u GROUP BY ALL),
         m AS (SELECT level, "group", noun AS expected, n AS matching, sum(n) OVER (PARTITION BY level, "group") AS total,
                      row_number() OVER (PARTITION BY level, "group" ORDER BY n DESC, noun) AS k FROM c),
         j AS (SELECT p_partkey, "group", noun AS actual, expected, matching, total,
                      row_number() OVER (PARTITION BY p_partkey ORDER BY level) AS first
               FROM u JOIN m USING (level, "group")
               WHERE k = 1 AND total >= 5 AND matching >= 5 AND matching * 100 >= total * CASE level WHEN 0 THEN 30 ELSE 30 END)
    SELECT p_partkey, "group", 'noun' AS trait, actual, expected, matching::BIGINT AS matching, total::BIGINT AS total
    FROM j WHERE first = 1 AND actual <> expected""")
def convention_two_level(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(
        "p_partkey",
        F.concat_ws("/", "p_brand", "p_type").alias("fine"),
        F.col("p_type").alias("coarse"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"),
    )
    return conventions.modal_convention(parts, ["p_partkey"], ["fine", "coarse"], ["noun"], 5, 30)


# --- ratchets ---------------------------------------------------------------------------------------------------------

_CUT = "TIMESTAMP_NTZ '2024-01-16 00:00:00'"


def _worse(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", "value", "ts")
    keys = ["user_id", "event_type"]
    after = ratchets.max_baseline(events.filter(F.expr(f"ts >= {_CUT}")), keys, "value")
    return ratchets.ratchet(events.filter(F.expr(f"ts < {_CUT}")), after, keys, "value", 10)


_WORSE_SQL = """
    WITH b AS (SELECT user_id, event_type, max(value) AS before FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
         a AS (SELECT user_id, event_type, max(value) AS after FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL),
         w AS (SELECT user_id, event_type, after, before FROM a JOIN b USING (user_id, event_type) WHERE after > before + 10)"""
_HOT_SQL = """
         c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
         r AS (SELECT user_id, n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS m FROM c),
         t AS (SELECT greatest(min(n), 3) AS threshold FROM r WHERE k >= (m * 90 + 99) // 100),
         h AS (SELECT user_id, n, threshold FROM c, t WHERE n >= threshold)"""


@query(_WORSE_SQL + " SELECT * FROM w")
def ratchet_value(spark: SparkSession, d: str) -> DataFrame:
    return _worse(spark, d)


@query("WITH " + _HOT_SQL + " SELECT * FROM h")
def hotspot_users(spark: SparkSession, d: str) -> DataFrame:
    return ratchets.hotspot(ratchets.churn(table(spark, d, "events"), ["user_id"]), "n", 90, 3)


@query(_WORSE_SQL + "," + _HOT_SQL + """
    SELECT user_id, event_type, after, before, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'warning' ELSE 'error' END AS level
    FROM w LEFT JOIN h USING (user_id)""")
def ratchet_hotspot(spark: SparkSession, d: str) -> DataFrame:
    return ratchets.ratchet_hotspot(_worse(spark, d), hotspot_users(spark, d), "user_id", "n", "warning", "error")


@query("""SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1""")
def churn_by_window(spark: SparkSession, d: str) -> DataFrame:
    recent = F.expr("ts >= TIMESTAMP_NTZ '2024-01-24 00:00:00'")
    return ratchets.churn(table(spark, d, "events"), ["user_id"], recent)


@query("""SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL""")
def max_baseline(spark: SparkSession, d: str) -> DataFrame:
    return ratchets.max_baseline(table(spark, d, "events"), ["user_id", "event_type"], "value")


# --- duplicates -------------------------------------------------------------------------------------------------------

def _tokens() -> Column:
    return F.split(F.lower(F.col("text")), " ", -1)


_NEAR_SQL = """
    WITH c AS (SELECT min(doc_id) AS id, string_split(lower(text), ' ') AS t FROM documents
               WHERE text IS NOT NULL GROUP BY string_split(lower(text), ' ')),
         s AS (SELECT id, len(t) - 4 AS n, array_to_string(t[i:i + 4], chr(1)) AS shingle
               FROM c, unnest(generate_series(1, len(t) - 4)) g(i) WHERE len(t) >= 5),
         k AS (SELECT id, n, shingle, count(*) AS c FROM s GROUP BY ALL),
         o AS (SELECT x.id AS a, y.id AS b, sum(least(x.c, y.c)) * 100 // greatest(x.n, y.n) AS similarity
               FROM k x JOIN k y ON x.shingle = y.shingle AND x.id < y.id
                    AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80 GROUP BY x.id, y.id, x.n, y.n),
         p AS (SELECT a, b, similarity::BIGINT AS similarity FROM o WHERE similarity >= 80)"""


@query(_NEAR_SQL + """,
         m AS (SELECT DISTINCT min(doc_id) OVER (PARTITION BY lower(text)) AS a, doc_id AS b FROM documents WHERE text IS NOT NULL)
    SELECT a, b, similarity, false AS is_copy FROM p UNION ALL SELECT a, b, 100::BIGINT, true FROM m WHERE a < b""")
def near_duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the first documents of their classes (equal but for case), and every other document with the first of its class."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    near = duplicates.near_duplicate(docs, "doc_id", _tokens()).withColumn("is_copy", F.lit(False))
    members = duplicates.copies(docs, "doc_id", F.lower("text"))
    return near.unionByName(members.select("a", "b", F.lit(100).cast("long").alias("similarity"), F.lit(True).alias("is_copy")))


@query(_NEAR_SQL + """
    SELECT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY a) AS k FROM p) WHERE k = 1""")
def near_duplicate_first(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.first_near_duplicate(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", _tokens())


@query("""
    WITH g AS (SELECT text, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT doc_id, first, copies FROM documents JOIN g USING (text) WHERE copies > 1""")
def exact_duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_duplicates(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", F.col("text"))


# --- blocks -----------------------------------------------------------------------------------------------------------

_BLOCK_SQL = r"""
    WITH RECURSIVE l AS (
           SELECT doc_id, i, trim(regexp_replace(x, '[ \t\r\n\f\v]+', ' ', 'g')) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
                unnest(ls) WITH ORDINALITY u(x, i)),
         f AS (SELECT doc_id, i, line, NOT regexp_full_match(line, '[{}();,]*') AS meant FROM l),
         w AS (SELECT doc_id, i AS line, line || chr(10) || lead(line, 1) OVER s || chr(10) || lead(line, 2) OVER s AS win,
                      meant AND lead(meant, 1) OVER s AND lead(meant, 2) OVER s AS ok
               FROM f WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
         n AS (SELECT win, max(doc_id) AS origin FROM w WHERE ok AND doc_id < 500 GROUP BY 1),
         h AS (SELECT doc_id, line, origin FROM w JOIN n USING (win) WHERE ok AND doc_id >= 500)"""


@query(_BLOCK_SQL + " SELECT * FROM h")
def reappearing_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = X.lines_of(F.col("text"))
    removed = blocks.line_windows(docs.filter("doc_id < 500"), ["doc_id"], lines)
    added = blocks.line_windows(docs.filter("doc_id >= 500"), ["doc_id"], lines)
    # The largest doc_id stands for the newest removal.
    newest = blocks.newest_windows(removed.select((-F.col("doc_id")).alias("ago"), F.col("doc_id").alias("origin"), "window"), ["ago"], ["origin"])
    return blocks.reappearing_blocks(newest, added).select("doc_id", "line", "origin")


@query(_BLOCK_SQL + """,
         o AS (SELECT doc_id, list(line ORDER BY line) AS ls FROM h GROUP BY 1),
         g AS (SELECT doc_id, ls, 1 AS k, ls[1] AS line FROM o
               UNION ALL
               SELECT doc_id, ls, k + 1, list_filter(ls, lambda x: x >= line + 3)[1] FROM g
               WHERE len(list_filter(ls, lambda x: x >= line + 3)) > 0)
    SELECT doc_id, line FROM g""")
def reappearing_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return blocks.greedy_suppress(reappearing_blocks(spark, d), ["doc_id"], "line", 3)


# --- order, logs, layers, chains --------------------------------------------------------------------------------------


@query("""
    SELECT conv_id, turn, text, previous FROM (
        SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
        FROM conversations WHERE role = 'user') WHERE text < previous""")
def order_violation_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return sequences.order_violation(turns, ["conv_id"], ["turn"], "text")


@query("""
    SELECT * FROM (SELECT p_brand, p_partkey, p_name, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS previous
                   FROM part WHERE NOT regexp_matches(p_name, '(ring|widget)$')) WHERE p_name < previous""")
def order_violation_filtered(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    return sequences.order_violation(parts.filter(~F.rlike("p_name", F.lit("(ring|widget)$"))), ["p_brand"], ["p_partkey"], "p_name")


@query("""
    SELECT user_id, event_id, event_type FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    WHERE p IS NULL OR p <> event_type""")
def change_log_dedup(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return sequences.change_log_dedup(events, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("""SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC)::INT AS ago FROM orders""")
def commits_ago(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return sequences.steps_ago(orders, ["o_custkey"], [F.desc("o_orderdate")]).drop("o_orderdate")


# Files named after pages, and settings files in their folders: com/example/<host>/<language>/<number>.cs.
_PAGE_PATHS = """
    SELECT page_id, regexp_replace(host, '^.*[.]', '') || '/' || regexp_extract(host, '([^.]+)[.][^.]+$', 1) || '/' || split_part(host, '.', 1) || '/' || coalesce(lang, 'xx')
           || '/' || CAST(page_id % 3 AS {s}) || '/p' || CAST(page_id AS {s}) || '.cs' AS path
    FROM (SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, nullif(regexp_extract(url, '//[^/]+/([a-z]+)/', 1), '') AS lang FROM pages)"""


@query(f"""
    WITH f AS ({_PAGE_PATHS.format(s="VARCHAR")}), p AS (SELECT page_id, path, string_split(path, '/')[:-2] AS dirs FROM f),
         l AS (SELECT d AS folder, max(page_id) AS n FROM (SELECT page_id, array_to_string(dirs[:k], '/') AS d, k FROM p, unnest(range(0, 6)) g(k)) WHERE length(d) % 3 <> 1 GROUP BY 1),
         y AS (SELECT folder, n, n % 4 = 0 AS is_root FROM l),
         r AS (SELECT folder, is_root, key, value FROM (
                   SELECT folder, is_root, 'indent' AS key, (n % 5)::VARCHAR AS value FROM y
                   UNION ALL SELECT folder, is_root, 'width', (100 + n % 7)::VARCHAR FROM y WHERE n % 2 = 0
                   UNION ALL SELECT folder, is_root, 'eol', CASE WHEN n % 3 = 0 THEN '' ELSE 'lf=' || n END FROM y WHERE n % 3 < 2)),
         w AS (SELECT page_id, path, k, array_to_string(dirs[:k], '/') AS folder FROM p, unnest(range(0, len(dirs) + 1)) g(k)),
         o AS (SELECT page_id, max(k) AS root FROM w JOIN y USING (folder) WHERE is_root GROUP BY 1),
         e AS (SELECT w.page_id, path, key, value, row_number() OVER (PARTITION BY w.page_id, key ORDER BY k DESC) AS first
               FROM w JOIN r USING (folder) LEFT JOIN o ON o.page_id = w.page_id WHERE k >= coalesce(root, 0))
    SELECT page_id, path, key, value FROM e WHERE first = 1""")
def layered_config(spark: SparkSession, d: str) -> DataFrame:
    """The settings of every file, from settings files in the folders above it, read and laid over each other."""
    files = spark.sql(_PAGE_PATHS.format(s="STRING").replace("FROM pages", "FROM {pages}"), pages=table(spark, d, "pages"))
    parts = X.dir_parts(F.col("path"))
    above = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = files.select("page_id", F.explode(above).alias("folder")).filter(F.length("folder") % 3 != 1).groupBy("folder").agg(F.max("page_id").alias("n"))
    text = F.concat(
        F.when(F.col("n") % 4 == 0, "ROOT = true\n").otherwise("# no root\n"), F.lit("indent = 9\n[*]\nroot = true\n[*.{cs,vb}]\nIndent="), (F.col("n") % 5).cast("string"), F.lit("\n"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("width = "), (100 + F.col("n") % 7).cast("string"), F.lit("\r\n"))).otherwise("; width = 1\n"),
        F.when(F.col("n") % 3 == 0, "eol =\n").when(F.col("n") % 3 == 1, F.concat(F.lit("eol = lf="), F.col("n").cast("string"), F.lit("\n"))).otherwise(""), F.lit("[*.csproj]\nwidth = 7\n"),
    )
    made = overlay.layers(folders.select(F.concat_ws("/", F.nullif("folder", F.lit("")), F.lit(".settings")).alias("path"), text.alias("text")))
    found = overlay.effective(files, made).select("page_id", "path", F.explode("settings"))
    return found.filter("key <> 'root'")


@query("""
    WITH RECURSIVE e AS (SELECT p_brand AS scope, p_partkey AS child, parent FROM part, unnest([p_partkey // 2, p_partkey // 3, CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 7 END]) u(parent)
                         WHERE parent IS NOT NULL AND parent <> p_partkey),
         r AS (SELECT scope, child, parent FROM e UNION SELECT e.scope, e.child, r.parent FROM r JOIN e ON e.scope = r.scope AND e.parent = r.child)
    SELECT scope, child, parent FROM r WHERE child <> parent""")
def is_a_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that each part leads to by edges to a half, a third and, in a circle, upwards, within its brand."""
    k = F.col("p_partkey")
    parents = F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"), F.when(k % 50 == 0, k + 7))
    edges = table(spark, d, "part").select(F.col("p_brand").alias("scope"), k.alias("child"), F.explode(parents).alias("parent"))
    return closure.closure(edges, "child", "parent", ["scope"])


@query("""
    WITH RECURSIVE e AS (SELECT p_partkey AS child, CASE WHEN p_partkey % 97 = 5 THEN p_partkey + 3 ELSE p_partkey - 1 - p_partkey % 4 END AS parent FROM part WHERE p_partkey % 40 > 3),
         r AS (SELECT child, parent, 1 AS n FROM e UNION ALL SELECT r.child, e.parent, n + 1 FROM r JOIN e ON e.child = r.parent WHERE n < 60)
    SELECT child, parent AS "end" FROM r WHERE parent NOT IN (SELECT child FROM e)""")
def chain_ends(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = table(spark, d, "part").filter(k % 40 > 3)
    return closure.chain_ends(parts.select(k.alias("child"), F.when(k % 97 == 5, k + 3).otherwise(k - 1 - k % 4).alias("parent")), "child", "parent")


@query("""
    SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""")
def global_change_log(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the type over the whole log, which is one group."""
    return ranges.change_log(table(spark, d, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"], "event_type").drop("ts")


@query("""SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS number FROM events""")
def global_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranges.row_numbers(table(spark, d, "events").select("value", "event_id"), ["value", "event_id"]).drop("value")


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
         r AS (SELECT price, row_number() OVER (ORDER BY price) AS k, count(*) OVER () AS m FROM c),
         t AS (SELECT greatest(price, 3) AS threshold FROM r WHERE k = (m * 99 + 99) // 100)
    SELECT l_orderkey, l_linenumber, price, threshold FROM c, t WHERE price >= threshold""")
def hotspot_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    return ratchets.hotspot(lines, "price", 99, 3, many_values=True)


@query("""
    WITH l AS (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events)
    SELECT event_id, event_type, value, ts, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 0 ELSE 1 END::BIGINT AS batch FROM l WHERE p IS NULL OR p <> event_type""")
def history_append(spark: SparkSession, d: str) -> DataFrame:
    """A log appended in two batches that overlap, the second of them twice, and read again."""
    folder = f"{tables.shared_folder(spark)}/history-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "event_type", "value", "ts")
    early, late = events.filter(F.expr("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")), events.filter(F.expr("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    for batch, rows in ((0, early), (1, late), (1, late)):
        history.append(rows, folder, batch, ["ts", "event_id"], "event_type")
    return history.read(spark, folder, events.schema)


@query("""SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2""")
def churn_advanced(spark: SparkSession, d: str) -> DataFrame:
    """Changes in a window of ten days, kept over three advances of the day, one of them twice."""
    folder = f"{tables.shared_folder(spark)}/churn-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("user_id", "event_type", "ts")
    for day in (18, 23, 23, 28):
        churn.advance(events, folder, date(2024, 1, day), 10, ["user_id", "event_type"], "ts")
    return churn.current(spark, folder, date(2024, 1, 28), events.select("user_id", "event_type").schema)


@query("""
    WITH n AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS a, upper(split_part(p_name, ' ', 2)) AS b FROM part)
    SELECT p_partkey, array_to_string(CASE p_partkey % 10
               WHEN 0 THEN [a] WHEN 1 THEN ['List', a] WHEN 2 THEN ['Dictionary', 'String', 'List', b, a] WHEN 3 THEN [b] WHEN 4 THEN [] WHEN 5 THEN ['ValueTuple', a, 'Int32', 'Func', b]
               WHEN 6 THEN ['Span', b] WHEN 7 THEN ['Map', b] WHEN 8 THEN ['Inner', 'Int64', 'Boolean'] ELSE ['Task', 'ValueTuple', b, 'ValueTuple', a, 'Object'] END, ',') AS names FROM n""")
def nominal_type_names(spark: SparkSession, d: str) -> DataFrame:
    """The names in type texts made of the parts' words."""
    word = lambda i: F.upper(F.split_part("p_name", F.lit(" "), F.lit(i)))
    shapes = ["N.{a}?[]", "System.List<{a}[,]>", "Dictionary<string, global::X.List<{b}?[]>, {a}>", "Outer<{a}, List<T>>.{b}", "{a}<int>*[]", "({a} first, int second, Func<T, {b}> third)",
              "Span<{b}>", "Map<T, dynamic, {b}, {a}*>", "A.B<{a}>.C<{b}>.Inner<long, bool>", "Task<({b}, ({a} x, object y)[])>"]
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(F.col("p_partkey") % 10 == i, F.replace(F.replace(F.lit(shape), F.lit("{a}"), word(1)), F.lit("{b}"), word(2))).otherwise(text)
    return table(spark, d, "part").select("p_partkey", F.array_join(nominal_names(text, F.array(F.lit("T"))), ",").alias("names"))


@query("""
    WITH o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 37 % 43200 AS BIGINT)) AS ts FROM orders),
         e AS (SELECT user_id, ts, max({'event_type': event_type, 'value': value}) AS s FROM events GROUP BY 1, 2)
    SELECT o_orderkey, o.user_id, o.ts, s.event_type AS event_type, s.value AS value FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.ts >= e.ts""")
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last event of a user at the time of each order."""
    minutes = "make_dt_interval(0, 0, cast(o_orderkey * 37 % 43200 as int), 0)"
    asked = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + {minutes}").alias("ts"))
    return as_of(asked, table(spark, d, "events").select("user_id", "ts", "event_type", "value"), ["user_id"], "ts", ["event_type", "value"])


@query("""
    WITH RECURSIVE n AS (SELECT p_partkey // 100 AS tree, p_partkey % 100 AS node, CASE WHEN p_partkey % 100 > 0 THEN (p_partkey % 100 - 1) // 2 END AS parent, p_name FROM part),
         u AS (SELECT tree, node, parent AS above FROM n WHERE parent IS NOT NULL UNION ALL SELECT u.tree, u.node, n.parent FROM u JOIN n ON n.tree = u.tree AND n.node = u.above WHERE n.parent IS NOT NULL),
         p AS (SELECT tree, node, row_number() OVER (ORDER BY tree, path) AS pre FROM (
                   SELECT n.tree, n.node, coalesce(list_sort(list(u.above) FILTER (u.above IS NOT NULL)), []) || [n.node] AS path FROM n LEFT JOIN u ON u.tree = n.tree AND u.node = n.node GROUP BY 1, 2)),
         s AS (SELECT tree, above AS node, count(*) AS below, count(*) FILTER (p_name LIKE '%ring') AS rings FROM u JOIN n USING (tree, node) GROUP BY 1, 2),
         a AS (SELECT u.tree, u.node, count(*) FILTER (p_name LIKE 'red%') AS reds FROM u JOIN n ON n.tree = u.tree AND n.node = u.above GROUP BY 1, 2)
    SELECT tree, node, pre, pre + coalesce(below, 0) AS "end", coalesce(reds, 0) > 0 AS under_red, coalesce(rings, 0) > 0 AS over_ring
    FROM p LEFT JOIN s USING (tree, node) LEFT JOIN a USING (tree, node)""")
def interval_labels(spark: SparkSession, d: str) -> DataFrame:
    """Parts as nodes of binary trees: their intervals, whether a red part is above and whether a ring is below."""
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select(
        F.expr("p_partkey div 100").alias("tree"), (k % 100).alias("node"), F.when(k % 100 > 0, F.expr("(p_partkey % 100 - 1) div 2")).alias("parent"), (k % 100).alias("ordinal"), "p_name"
    )
    labelled = tables.written(trees.labels(nodes, ["tree"]))
    found = trees.encloses(trees.enclosed(labelled, F.startswith("p_name", F.lit("red")), "under_red"), F.endswith("p_name", F.lit("ring")), "over_ring")
    return found.select("tree", "node", "pre", "end", "under_red", "over_ring")


@query("""
    WITH h AS (SELECT conv_id, turn FROM conversations WHERE length(text) > 300)
    SELECT conv_id, turn FROM h WHERE NOT EXISTS (SELECT 1 FROM h p WHERE p.conv_id = h.conv_id AND p.turn = h.turn - 1)""")
def chain_top(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "conversations").filter(F.length("text") > 300).select("conv_id", "turn", (F.col("turn") - 1).alias("above"))
    return sequences.chain_top(hits, ["conv_id", "turn"], ["conv_id", "above"]).drop("above")


# --- budgets ----------------------------------------------------------------------------------------------------------


def _growth(spark: SparkSession, d: str, *scope: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate")
    if scope:
        customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
        orders = orders.join(customers, "o_custkey")
    new = F.expr("o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'")
    return orders.groupBy(*scope).agg(
        F.count(F.when(~new, 1)).alias("baseline"), F.count(F.when(new, 1)).alias("added")
    )


_GROWTH_SQL = """
    WITH g AS (SELECT c_mktsegment AS segment, count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS baseline,
                      count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS added
               FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
         b AS (SELECT *, CASE WHEN baseline > 0 THEN greatest(1, (baseline * 9 + 99) // 100) ELSE 0 END AS budget FROM g)"""


@query(_GROWTH_SQL + " SELECT * FROM b WHERE budget > 0 AND added > budget")
def budget_project(spark: SparkSession, d: str) -> DataFrame:
    return budgets.over_budget(_growth(spark, d, "segment"), 9)


@query("""
    WITH g AS (SELECT count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS baseline,
                      count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS added FROM orders),
         b AS (SELECT *, CASE WHEN baseline > 0 THEN greatest(1, (baseline * 2 + 99) // 100) ELSE 0 END AS budget FROM g)
    SELECT * FROM b WHERE budget > 0 AND added > budget""")
def budget_global(spark: SparkSession, d: str) -> DataFrame:
    return budgets.over_budget(_growth(spark, d), 2)


@query(_GROWTH_SQL + """
    SELECT *, round_even(added * 100 / nullif(budget, 0), 0)::BIGINT AS usage, budget > 0 AND added > budget AS over FROM b""")
def gauge(spark: SparkSession, d: str) -> DataFrame:
    return budgets.gauge(_growth(spark, d, "segment"), 9)


@query("""
    WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS tests, count(*) FILTER (event_type = 'click') AS production
               FROM events GROUP BY 1)
    SELECT *, tests * 100 // nullif(production, 0) AS percent FROM g
    WHERE production >= 10 AND tests * 100 // nullif(production, 0) < 80""")
def ratio_gate(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("tests"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("production"),
    )
    return budgets.ratio_gate(counts, "tests", "production", 80, 10)


@query(r"""
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_full_match(l, '\s*'))) AS lines
    FROM documents WHERE text IS NOT NULL AND len(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_full_match(l, '\s*'))) > 20""")
def loc_limit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", X.non_blank_lines(F.col("text")).alias("lines"))
    return docs.filter("lines > 20")


# --- gates and barriers -----------------------------------------------------------------------------------------------


@query("""
    WITH u AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS word, len(string_split(text, chr(10))) AS body_lines
               FROM conversations WHERE role = 'user'),
         a AS (SELECT * FROM u WHERE body_lines >= 2),
         e AS (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations WHERE role = 'assistant'),
         n AS (SELECT conv_id, count(*) AS evidences FROM e GROUP BY 1)
    SELECT conv_id, turn, word, body_lines::BIGINT AS body_lines, coalesce(evidences, 0) AS evidences
    FROM a LEFT JOIN n USING (conv_id)
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = a.conv_id AND list_contains(e.words, a.word))""")
def link_gate(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    members = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.split_part("text", F.lit(" "), F.lit(1)).alias("word"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("body_lines"), F.sha2("text", 256).alias("body_hash"),
    )
    head = members.select("conv_id", "word", "body_lines", "body_hash").limit(0)  # nothing was there before
    evidence = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("test"), F.split("text", " ", -1).alias("called"))
    due = gates.accountable_members(members, head, ["conv_id", "word"], 2).drop("body_hash")
    return gates.link_gate(due, evidence, "conv_id", "word", "called", "test")


@query("""
    WITH n AS (SELECT DISTINCT c_nationkey AS nation FROM customer), p AS (SELECT DISTINCT o_orderpriority AS priority FROM orders)
    SELECT nation, priority FROM n, p
    WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey
                      WHERE c_nationkey = nation AND o_orderpriority = priority AND o_totalprice > 490000)""")
def required_group(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"), "o_totalprice"
    )
    priorities = orders.agg(F.collect_set("priority").alias("all")).withColumn("one", F.lit(1))  # five values
    required = customers.select("nation", F.lit(1).alias("one")).distinct().join(F.broadcast(priorities), "one").select(
        "nation", F.explode("all").alias("priority")
    )
    existing = orders.filter("o_totalprice > 490000").join(customers, "c_custkey").select("nation", "priority")
    return gates.required_group(required, existing, ["nation", "priority"])


def _module() -> Column:
    return F.regexp_extract("url", r"^https?://([^/?#]+)", 1)


def _segment() -> Column:
    return F.regexp_extract("url", r"^https?://[^/?#]+/([^/?#]*)", 1)


@query(r"""
    WITH r AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS module,
                      regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS target FROM pages),
         m AS (SELECT *, upper(module) AS m, upper(target) AS t FROM r),
         x AS (SELECT *, CASE WHEN (m = 'EXAMPLE.COM' OR m LIKE 'EXAMPLE.COM.%' OR m LIKE '%.EXAMPLE.COM') AND t = 'FR' THEN 'example.com>fr'
                              WHEN (m = 'EXAMPLE.NET' OR m LIKE 'EXAMPLE.NET.%' OR m LIKE '%.EXAMPLE.NET') AND t = 'EN' THEN 'example.net>en' END AS rule FROM m)
    SELECT page_id, module, target, rule FROM x WHERE rule IS NOT NULL AND NOT upper(url) LIKE '%/825'""")
def barrier(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "pages").select("page_id", "url", _module().alias("module"), _segment().alias("target"))
    rules = [("example.com", "fr"), ("example.net", "en")]
    return gates.barrier(refs, "module", "target", rules, "url", ["825"]).drop("url")


@query("""
    SELECT p_partkey, p_brand, CASE WHEN p_brand LIKE 'Brand#1%' AND len(list_filter(string_split(p_name, ' '), lambda w: ends_with(w, 'ring'))) > 0
                                    THEN 'Brand#1*>*ring'
                                    WHEN ends_with(p_brand, '2') AND list_contains(string_split(p_name, ' '), 'red') THEN '*2>red' END AS rule
    FROM part
    WHERE (p_brand LIKE 'Brand#1%' AND len(list_filter(string_split(p_name, ' '), lambda w: ends_with(w, 'ring'))) > 0)
       OR (ends_with(p_brand, '2') AND list_contains(string_split(p_name, ' '), 'red'))""")
def type_barrier(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.split("p_name", " ", -1).alias("words"))
    return gates.pattern_barrier(parts, "p_brand", "words", [("Brand#1*", "*ring"), ("*2", "red")]).drop("words")


@query("""
    SELECT p_partkey, p_name, ends_with(p_name, 'ring') AS suffix, starts_with(p_name, 'red') AS prefix,
           contains(p_name, 'e w') AS contained, p_name = 'red widget' AS exact FROM part""")
def name_pattern(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", "p_name", P.name_pattern(name, "*ring").alias("suffix"), P.name_pattern(name, "red*").alias("prefix"),
        P.name_pattern(name, "*e w*").alias("contained"), P.name_pattern(name, "red widget").alias("exact"),
    )


def _path() -> Column:
    return F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)


_PATH_SQL = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"


@query(rf"""
    SELECT page_id, regexp_full_match(p, 'fr/[^/]*') AS in_fr, regexp_full_match(p, '(.*/)?[^/]*5') AS ends_five,
           regexp_full_match(p, '([^/]+/)*8[^/]*') AS deep
    FROM (SELECT page_id, ltrim({_PATH_SQL}, '/') AS p FROM pages)""")
def glob_paths(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.ltrim(_path(), F.lit("/")).alias("path"))
    path, name = F.col("path"), X.file_name(F.col("path"))
    return pages.select(
        "page_id", P.glob_match(path, name, "fr/*").alias("in_fr"), P.glob_match(path, name, "*5").alias("ends_five"),
        P.glob_match(path, name, "**/8*").alias("deep"),
    )


@query(rf"""
    SELECT page_id, dirs FROM (SELECT page_id, list_filter(string_split({_PATH_SQL}, '/'), lambda x: x <> '')[:-2] AS d FROM pages),
        LATERAL (SELECT array_to_string(d, '/') AS dirs) WHERE len(d) > 0 AND upper(d[-1]) = 'FR'""")
def folder_suffix(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", X.dir_parts(_path()).alias("parts"))
    return pages.filter(P.folder_suffix(F.col("parts"), "fr")).select("page_id", F.array_join("parts", "/").alias("dirs"))


@query(rf"""
    SELECT page_id, CASE WHEN regexp_matches('/' || p, '/(?i:example)/(?i:en)/[^/]*$') THEN 0 WHEN regexp_matches('/' || p, '/(?i:en)/[^/]*$') THEN 1
                         WHEN regexp_matches('/' || p, '/(?i:fr)/[^/]*$') THEN 2 ELSE -1 END::INT AS rule
    FROM (SELECT page_id, 'example' || regexp_replace({_PATH_SQL}, '/+$', '') AS p FROM pages)""")
def best_match_deepest(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"folder": "example/en"}, {"folder": "en"}, {"folder": "fr"}]
    clean = F.concat(F.lit("example"), F.regexp_replace(_path(), "/+$", ""))
    pages = table(spark, d, "pages").select("page_id", X.dir_parts(clean).alias("parts"))
    test = lambda r: P.folder_suffix(F.col("parts"), r["folder"])
    found = gates.best_match(pages, rules, test, lambda r: len(P.folder_parts(r["folder"])))
    return found.select("page_id", F.coalesce("rule", F.lit(-1)).alias("rule"))


@query("""
    SELECT p_partkey, p_name, CASE WHEN ends_with(p_name, 'red ring') THEN 2 WHEN ends_with(p_name, 'ring') THEN 1
                                   WHEN ends_with(p_name, 'g') THEN 0 ELSE -1 END::INT AS rule FROM part""")
def best_match_longest_suffix(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"suffix": "g"}, {"suffix": "ring"}, {"suffix": "red ring"}]
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    test = lambda r: F.endswith("p_name", F.lit(r["suffix"]))
    return gates.best_match(parts, rules, test, lambda r: len(r["suffix"])).withColumn("rule", F.coalesce("rule", F.lit(-1)))


@query("""SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part WHERE length(p_name) < 9
          UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE length(s_name) < 19""")
def name_length(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").filter(F.length("p_name") < 9).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    suppliers = table(spark, d, "supplier").filter(F.length("s_name") < 19)
    return parts.unionByName(suppliers.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(r"""
    WITH l AS (SELECT DISTINCT doc_id, x AS text FROM documents, unnest(string_split(text, chr(10))) u(x) WHERE length(x) > 10),
         k AS (SELECT x AS text, min(item_id) AS item_id FROM benchmark, unnest(string_split(text, chr(10))) u(x) GROUP BY 1)
    SELECT doc_id, text, item_id FROM l JOIN k USING (text) WHERE doc_id NOT IN (7, 8)""")
def name_collision(spark: SparkSession, d: str) -> DataFrame:
    line = F.explode(F.split("text", "\n", -1)).alias("text")
    own = table(spark, d, "documents").select("doc_id", line).filter(F.length("text") > 10).distinct()
    known = table(spark, d, "benchmark").select("item_id", line)
    return gates.name_collision(own, known, "text", "item_id", [7, 8], "doc_id").select("doc_id", "text", "item_id")


@query("""SELECT page_id, url FROM pages WHERE contains(lower('/' || url), '/en/') OR contains(lower('/' || url), 'ref=')""")
def test_file_classifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url").filter(P.contains_any(F.col("url"), ["/en/", "ref="]))


@query("""
    SELECT user_id, '"user ' || user_id || ', all",' || n || ',' || coalesce(last, '') AS line
    FROM (SELECT user_id, count(*) AS n, max_by(event_type, event_id) AS last FROM events GROUP BY 1)""")
def history_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("last"))
    who = F.format_string("user %d, all", "user_id")
    return rows.select("user_id", X.csv_line(who, F.col("n"), F.col("last")).alias("line"))


_NAMES = "CASE p_partkey % 5 WHEN 0 THEN 'XML' || a || b WHEN 1 THEN 'i' || a || 'Model' WHEN 2 THEN a WHEN 3 THEN a || 'To' || upper(b) || 'Text' ELSE lower(a) || b || 'A' || a || '2' END"


@query(f"""
    WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM (SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS a, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS b FROM part)),
         c AS (SELECT p_partkey, name, i, name[i] AS ch, name[i - 1] AS before, name[i + 1] AS after FROM n, unnest(generate_series(1, length(name))) g(i)),
         f AS (SELECT *, i = 1 OR (regexp_full_match(ch, '\\p{{Lu}}') AND (NOT regexp_full_match(before, '\\p{{Lu}}') OR regexp_full_match(after, '\\p{{Ll}}'))) AS cut FROM c),
         g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY p_partkey ORDER BY i) AS w FROM f),
         p AS (SELECT p_partkey, w, string_agg(ch, '' ORDER BY i) AS word FROM g GROUP BY 1, 2),
         l AS (SELECT p_partkey, list(word ORDER BY w) AS ws FROM p WHERE regexp_matches(word, '^\\p{{Lu}}') GROUP BY 1)
    SELECT p_partkey, suffix FROM l, unnest(CASE WHEN len(ws) >= 3 THEN [ws[-2] || ws[-1], ws[-1]] WHEN len(ws) = 2 THEN [ws[-1]] ELSE [] END) u(suffix)""")
def camel_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """The suffixes of CamelCase names made of the parts' words."""
    word = lambda i: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(i)))
    names = table(spark, d, "part").select("p_partkey", word(1).alias("a"), word(2).alias("b")).select("p_partkey", F.expr(_NAMES).alias("name"))
    return names.select("p_partkey", F.explode(X.camel_suffixes(F.col("name"))).alias("suffix"))


#: Every line of a document as a line of a patch: its number, its sign and its text.
_PATCHED = """
    l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    p AS (SELECT doc_id, i, ['+', '-', ' '][(i + doc_id // 2) // 2 % 3 + 1] AS sign, ' ' || regexp_replace(x, '\\r$', '') AS text FROM l),
    c AS (SELECT *, doc_id % 90 + 1 + count(*) FILTER (sign <> '-') OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN sign = '-' THEN 0 ELSE 1 END AS new_line FROM p)"""


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A patch per document, as version control prints it."""
    sign = lambda i: F.try_element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.floor((i + 1 + F.expr("doc_id div 2")) / 2) % 3 + 1).cast("int"))
    body = F.array_join(F.transform(X.lines_of(F.col("text")), lambda x, i: F.concat(sign(i), F.lit(" "), x)), "\n")
    head = F.format_string("commit %07d subject %d\ndiff --git a/d.cs b/d.cs\n--- a/d%d.cs\n+++ b/d%d.cs\n@@ -1,9 +%d,9 @@ class D\n", "doc_id", "doc_id", "doc_id", "doc_id", F.col("doc_id") % 90 + 1)
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("source"), F.concat(head, body).alias("text"))


@query(f"""
    WITH {_PATCHED} SELECT 'd' || doc_id || '.cs' AS path, new_line::INT AS new_line, sign, text FROM c WHERE sign <> ' '""")
def diff_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Added and removed lines of patches made of the documents, with their place on the new side."""
    return diffs.diff_lines(_patches(spark, d)).select("path", "new_line", "sign", "text")


@query(f"""
    WITH {_PATCHED}, g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, sign ORDER BY i) AS run FROM c WHERE sign <> ' ')
    SELECT doc_id, sign, min(new_line)::INT AS first_line, string_agg(text, chr(10) ORDER BY i) AS lines FROM g GROUP BY doc_id, sign, run""")
def patch_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of added and of removed lines of the same patches."""
    runs = diffs.diff_runs(_patches(spark, d))
    return runs.select(F.col("source").alias("doc_id"), "sign", "first_line", F.array_join("lines", "\n").alias("lines"))


@query("""
    WITH t AS (SELECT 'Src/F' || o_orderkey % 500 || '.cs' AS path, o_orderkey % 40 AS added FROM orders WHERE o_orderkey % 13 > 0 AND o_orderkey % 17 > 0),
         u AS (SELECT 'src/f' || page_id || '.CS' AS path, CASE WHEN page_id % 10 = 0 OR html = '' THEN 0
                   ELSE len(regexp_extract_all(html, chr(10))) + CASE WHEN html[-1] = chr(10) THEN 0 ELSE 1 END END AS added FROM pages),
         m AS (SELECT DISTINCT 'P' || p_partkey % 7 AS project, upper('src/f' || p_partkey % 800 || '.cs') AS key FROM part)
    SELECT project, count(*) AS files, sum(added)::BIGINT AS added FROM (FROM t UNION ALL FROM u) x JOIN m ON m.key = upper(x.path) GROUP BY 1""")
def added_by_project(spark: SparkSession, d: str) -> DataFrame:
    """Added lines of a numstat's files, binary and malformed ones skipped, and of untracked files, by the projects that list them."""
    k = F.col("o_orderkey")
    line = F.when(k % 13 == 0, F.format_string("-\t-\tSrc/F%d.cs", k % 500)).when(k % 17 == 0, F.lit("3\tno path")).otherwise(F.format_string("%d\t2\tSrc/F%d.cs", k % 40, k % 500))
    tracked = diffs.numstat(table(spark, d, "orders").select(line.alias("value")))
    pages = table(spark, d, "pages")
    untracked = pages.select(F.format_string("src/f%d.CS", "page_id").alias("path"), F.when(F.col("page_id") % 10 > 0, F.col("html")).alias("text"))
    p = F.col("p_partkey")
    members = table(spark, d, "part").select(F.format_string("P%d", p % 7).alias("project"), F.format_string("SRC/f%d.cs", p % 800).alias("path"))
    found = diffs.in_project(diffs.added_counts(tracked, untracked), members)
    return found.groupBy("project").agg(F.count("*").alias("files"), F.sum("added").alias("added"))


#: A document as source text: some letters and pairs of letters become quotes, escapes and the ends of comments.
_CODE = r"translate(replace(replace(replace(coalesce(text, ''), 'ra', '/*'), 'to', '*/'), 'sl', '//'), 'qzxjk', concat('\"', chr(39), chr(92), '@#'))".replace(r"\"", '"')
#: The rules of strings again, without back references and possessive loops, which other engines' patterns lack.
_STRINGS = (
    r'\$*"""+[\s\S]*?(?:"""+|\z)',
    r'(?:\$@|@\$|@)"[^"]*(?:""[^"]*)*(?:"|\z)',
    r'\$"(?:[^"\\{\r\n]|\\[^\r\n]|\{\{|\{[^{}"\r\n]*(?:"[^"\r\n]*"[^{}"\r\n]*)*\}|\{)*"?',
    r'"[^"\\\r\n]*(?:\\[^\r\n][^"\\\r\n]*)*"?',
)
_LEXEMES = "|".join([*lexer.RULES[:5], *_STRINGS, *lexer.RULES[9:]]).replace("'", "''")


@query(rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_CODE}, '{_LEXEMES}') AS l FROM documents),
         e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d),
         f AS (SELECT *, len(regexp_extract_all(x, '\r\n?|\n')) AS ends, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS line FROM e),
         t AS (SELECT *, CASE WHEN list_contains({list(lexer.KEYWORDS)}, x) THEN x WHEN regexp_matches(x, '^@?[\p{{L}}\p{{Nl}}_]') THEN 'name' WHEN regexp_matches(x, '^\.?[0-9]') THEN 'number'
                      WHEN regexp_matches(x, '^(\$+@?|@\$)"') THEN 'interpolated' WHEN regexp_matches(x, '^@?"') THEN 'string' WHEN x LIKE '''_%' THEN 'char' ELSE x END AS kind
               FROM f WHERE NOT regexp_matches(x, '^([ \t\f\x0B\r\n]|//|/\*|#.)'))
    SELECT doc_id, count(i) AS n_tokens, count(DISTINCT line) AS n_lines, count(*) FILTER (kind = 'string') AS n_strings, count(*) FILTER (kind = 'char') AS n_chars,
           sha256(coalesce(string_agg(kind || chr(1) || ltrim(x, '@'), chr(2) ORDER BY i), '')) AS body_hash
    FROM d LEFT JOIN t USING (doc_id) GROUP BY doc_id""")
def lexed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, their lines and the body's hash of documents that are read as source text."""
    read = table(spark, d, "documents").select("doc_id", lexer.lexemes(F.expr(_CODE)).alias("x"))
    read = read.select("doc_id", lexer.tokens(F.col("x")).alias("t"))
    of = lambda k: F.size(F.filter("t", lambda t: t["kind"] == k)).cast("long").alias(f"n_{k}s")
    found = (F.size("t").cast("long").alias("n_tokens"), lexer.token_lines(F.col("t")).alias("n_lines"), of("string"), of("char"))
    return read.select("doc_id", *found, lexer.body_hash(F.col("t")).alias("body_hash"))
