"""Every code rule over facts that are derived from the tables, with the rule's SQL over the same facts.

A fact is one SELECT that both engines run: only arrays are spelled differently (``array(…)`` here).
"""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..rules import size
from ..sources.tables import table
from .registry import QUERIES, SQL

_WORD = "upper(substr(split_part(p_name, ' ', {n}), 1, 1)) || substr(split_part(p_name, ' ', {n}), 2)"
#: name: (tables, SELECT) of each fact; ``{table}`` stands for a table.
FACTS = {
    "type_decl": (("part",), f"""
        SELECT k, project, project || '/' || dir || '/' || CASE WHEN k % 11 = 0 THEN 'Other' ELSE name END || '.cs' AS path, name,
               CAST(k % 2 AS INT) AS arity, project || '.' || CASE WHEN k % 10 = 0 THEN 'Odd' ELSE 'Main' END AS namespace, kind,
               k % 13 = 0 AS is_nested, k % 19 <> 3 AS is_sealed, k % 17 = 0 AS is_static,
               CASE WHEN k % 12 = 5 THEN 'internal' ELSE 'public' END AS accessibility, CASE WHEN k % 14 = 0 THEN 'Odd' ELSE 'Base' END AS base,
               array('I' || w1 || 'Provider', 'I' || w2 || 'Other') AS interfaces, CAST(k + 1 AS INT) AS start_line, k % 45 AS non_blank_lines
        FROM (SELECT *, CASE kind WHEN 'interface' THEN 'I' || w1 || 'Provider' ELSE w1 || w2 || suffix END AS name
              FROM (SELECT p_partkey AS k, {_WORD.format(n=1)} AS w1, {_WORD.format(n=2)} AS w2,
                           CASE p_partkey % 4 WHEN 0 THEN 'Shop.Core' WHEN 1 THEN 'Shop.Portal' WHEN 2 THEN 'Shop.Domain'
                                ELSE 'M' || CAST(p_partkey % 100 AS STRING) || 'Module' END AS project,
                           CASE p_partkey % 7 WHEN 0 THEN 'src/Models/Business' WHEN 1 THEN 'src/Features' WHEN 2 THEN 'Models/Data/Providers'
                                WHEN 3 THEN 'src/Models' WHEN 4 THEN 'models/business' ELSE 'Services' END AS dir,
                           CASE p_partkey % 9 WHEN 0 THEN 'interface' WHEN 1 THEN 'enum' WHEN 2 THEN 'record' WHEN 3 THEN 'struct' ELSE 'class' END AS kind,
                           CASE p_partkey % 5 WHEN 0 THEN 'BusinessModel' WHEN 1 THEN 'Provider' WHEN 2 THEN 'DataModel' WHEN 3 THEN 'Model' ELSE 'Helper' END AS suffix
                    FROM {{part}}))"""),
    "member": (("lineitem",), """
        SELECT 'P' || CAST(o % 7 AS STRING) AS project, CASE WHEN o % 23 = 0 THEN 'tests/T' ELSE 'src/T' END || CAST(o AS STRING) || '.cs' AS path,
               'T' || CAST(o AS STRING) || CASE o % 3 WHEN 0 THEN 'DataModel' ELSE 'Thing' END AS type_name,
               CASE WHEN o % 10 = 0 THEN 'struct' ELSE 'class' END AS type_kind,
               CASE p % 4 WHEN 0 THEN 'property' WHEN 1 THEN 'variable' WHEN 2 THEN 'ctor' ELSE 'method' END AS kind,
               CASE p % 7 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'ItemId' WHEN 2 THEN 'Go' WHEN 3 THEN 'Total' WHEN 4 THEN 'Zed' WHEN 5 THEN 'x' ELSE 'Middle' END AS name,
               CAST(l AS INT) AS arity, CAST(l AS INT) AS ordinal, CAST(l * 10 AS INT) AS line,
               CASE p % 5 WHEN 0 THEN 'private' WHEN 1 THEN NULL ELSE 'public' END AS accessibility, p % 6 <> 0 AS has_body, q AS complexity,
               q AS non_blank_lines, q AS body_lines, CAST(p % 50 AS STRING) AS body_hash, p % 8 = 0 AS imposed_externally,
               'm' || CAST(o AS STRING) || '.' || CAST(l AS STRING) AS member_id
        FROM (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""),
    "overrides": (("lineitem",), """
        SELECT 'P' || CAST(o % 7 AS STRING) AS project, 'm' || CAST(o AS STRING) || '.' || CAST(l AS STRING) AS member_id,
               CASE WHEN o % 31 = 0 AND l = 2 THEN 'm' || CAST(o AS STRING) || '.3' WHEN l > 1 THEN 'm' || CAST(o AS STRING) || '.' || CAST(l - 1 AS STRING) ELSE 'x' || CAST(p % 9 AS STRING) END AS overridden
        FROM (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey, l_linenumber) WHERE p % 4 <> 1"""),
    "implements": (("lineitem",), """
        SELECT 'P' || CAST(o % 7 AS STRING) AS project, 'm' || CAST(o AS STRING) || '.' || CAST(l AS STRING) AS member_id,
               CASE WHEN p % 2 = 0 THEN 'x' ELSE 'm' END || CAST(o AS STRING) || '.1' AS interface_member
        FROM (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey, l_linenumber) WHERE p % 3 = 0"""),
    "test_node": (("orders",), """
        SELECT 'tests/T' || CAST(k AS STRING) || 'Tests.cs' AS path, 'Test' || CAST(k AS STRING) AS test, node,
               CASE node WHEN 0 THEN NULL WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 5 WHEN 7 THEN 4 WHEN 8 THEN 3 WHEN 9 THEN 3 ELSE 0 END AS parent, node AS ordinal,
               CASE WHEN node = 1 AND c % 3 > 0 THEN 'try' WHEN node = 5 AND c % 5 > 0 THEN 'nameof' WHEN node = 8 AND c % 4 <> 1 THEN 'throw' WHEN node = 2 THEN 'block' WHEN node = 3 THEN 'catch'
                    WHEN node IN (4, 6, 8, 9) THEN 'call' WHEN node = 7 THEN 'new' ELSE 'other' END AS kind,
               CASE WHEN node = 3 AND c % 6 = 2 THEN 'IOException' WHEN node = 3 AND c % 6 <> 4 THEN 'Exception' WHEN node = 4 THEN 'Total' WHEN node = 7 AND c % 2 = 0 THEN 'Alpha'
                    WHEN node IN (6, 7) THEN 'Middle' WHEN node = 9 THEN 'Go' END AS name
        FROM (SELECT o_orderkey AS k, o_custkey AS c, explode(sequence(0, 9)) AS node FROM {orders} WHERE o_orderkey % 5 > 0)"""),
    "supertype": (("part",), f"""
        SELECT 'M' || CAST(p_partkey % 100 AS STRING) || 'Module' AS project, 'I' || w2 || 'Other' AS name,
               CASE WHEN p_partkey % 3 = 0 THEN 'I' || w1 || 'Provider' ELSE 'I' || w2 || 'Root' END AS parent
        FROM (SELECT p_partkey, {_WORD.format(n=1)} AS w1, {_WORD.format(n=2)} AS w2 FROM {{part}}) WHERE p_partkey % 4 = 3
        UNION ALL SELECT 'M' || CAST(p_partkey % 100 AS STRING) || 'Module', 'Base', 'IBaseProvider' FROM {{part}} WHERE p_partkey % 20 = 3
        UNION ALL SELECT 'M' || CAST(p_partkey % 100 AS STRING) || 'Module', 'IBaseProvider', 'I' || {_WORD.format(n=1)} || 'Provider' FROM {{part}} WHERE p_partkey % 40 = 3
        UNION ALL SELECT 'M' || CAST(p_partkey % 100 AS STRING) || 'Module', 'I' || {_WORD.format(n=1)} || 'Provider', 'IBaseProvider' FROM {{part}} WHERE p_partkey % 80 = 3"""),
    "head_member": (("lineitem",), """
        SELECT 'T' || CAST(o AS STRING) || CASE o % 3 WHEN 0 THEN 'DataModel' ELSE 'Thing' END AS type_name,
               CASE p % 7 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'ItemId' WHEN 2 THEN 'Go' WHEN 3 THEN 'Total' WHEN 4 THEN 'Zed' WHEN 5 THEN 'x' ELSE 'Middle' END AS name,
               CAST(l AS INT) AS arity, q + p % 9 - 4 AS complexity, CAST(p % 50 - o % 2 AS STRING) AS body_hash, q - p % 13 AS body_lines
        FROM (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber)
        WHERE o % 4 <> 0"""),
    "body": (("documents",), """
        SELECT coalesce(source, '') AS project, 'd' || CAST(doc_id AS STRING) || '.cs' AS path, 'D' AS type_name, 'class' AS type_kind, 'method' AS kind,
               'B' || CAST(doc_id AS STRING) AS name, CAST(0 AS INT) AS arity, CAST(1 AS INT) AS line,
               transform(split(text, ' '), w -> CAST(length(w) * 2 + CASE WHEN w < 'l' THEN 1 ELSE 0 END AS INT)) AS tokens
        FROM {documents} WHERE text IS NOT NULL"""),
    "source_file": (("pages",), """
        SELECT 'Web' || CAST(page_id % 5 AS STRING) || '.Contracts' AS project,
               'Web' || CAST(page_id % 5 AS STRING) || '/' || CASE page_id % 3 WHEN 0 THEN 'Models' WHEN 1 THEN 'Models/Entities' ELSE 'obj' END || '/F' || CAST(page_id AS STRING)
                   || CASE page_id % 4 WHEN 0 THEN 'Dto.cs' WHEN 1 THEN 'Request.cs' WHEN 2 THEN 'Helper.cs' ELSE '.txt' END AS path, page_id % 7 = 0 AS is_generated
        FROM {pages}"""),
    "numstat": (("orders",), """
        SELECT 'P' || CAST(o_custkey % 9 AS STRING) AS project, 'f' || CAST(o_orderkey AS STRING) || '.cs' AS path, o_orderkey % 40 AS added, o_orderkey % 11 = 0 AS is_test FROM {orders}"""),
    "baseline": (("customer",), """SELECT 'P' || CAST(c_custkey % 9 AS STRING) AS project, c_custkey % 90 * 40 AS lines FROM {customer}"""),
    "reference": (("lineitem",), """
        SELECT CASE l_suppkey % 3 WHEN 0 THEN 'My.Portal' WHEN 1 THEN 'Portal.Web' ELSE 'My.Core' END AS project, 'src/F' || CAST(l_orderkey % 50 AS STRING) || '.cs' AS path,
               CAST(l_linenumber AS INT) AS line, 'S' || CAST(l_partkey % 20 AS STRING) AS to_symbol,
               CASE l_partkey % 4 WHEN 0 THEN 'My.Domain' WHEN 1 THEN 'domain' WHEN 2 THEN 'My.Domain.Types' ELSE 'Dominant' END AS to_assembly FROM {lineitem}"""),
    "parameter": (("lineitem",), """
        SELECT 'P' AS project, 'src/F.cs' AS path, CAST(l_orderkey AS INT) AS line, CASE l_suppkey % 3 WHEN 0 THEN 'OrderModule' WHEN 1 THEN 'ModuleBase' ELSE 'OrderService' END AS type_name,
               CASE WHEN l_suppkey % 5 = 0 THEN 'interface' ELSE 'class' END AS type_kind, 'Run' || CAST(l_linenumber AS STRING) AS method, 'x' AS name,
               array(CASE WHEN l_partkey % 2 = 0 THEN 'List' ELSE 'Order' END, CASE l_partkey % 5 WHEN 0 THEN 'OrderDataModel' WHEN 1 THEN 'ViewState' ELSE 'Int32' END) AS nominal_names,
               CASE l_partkey % 2 WHEN 0 THEN 'System.Collections.List<' ELSE 'global::Shop<Never>.Order<T, dynamic, ' END || CASE l_partkey % 5 WHEN 0 THEN 'OrderDataModel?[,]' WHEN 1 THEN 'Ui.ViewState[][]' ELSE 'int' END || '>?' AS type_text,
               array('T') AS type_parameters, l_partkey % 17 = 0 AS is_error FROM {lineitem}"""),
    "operation": (("lineitem",), """
        SELECT 'P' AS project, 'F' || CAST(o AS STRING) || '.cs' AS path, CAST(l AS INT) AS line, CAST(l AS INT) AS op_id, CAST(l - 1 AS INT) AS parent_op_id,
               CASE p % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'compound_assignment' ELSE 'interpolation' END AS kind,
               CASE p % 3 WHEN 0 THEN CASE WHEN p % 5 = 0 THEN '-' ELSE '+' END WHEN 1 THEN '+=' ELSE NULL END AS operator, p % 7 <> 0 AS is_builtin, p % 8 = 0 AS is_constant,
               CASE WHEN p % 11 = 0 THEN 'int' ELSE 'string' END AS result_type, CAST(p % 4 AS INT) AS n_holes
        FROM (SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""),
    "assembly_type": (("supplier", "part"), f"""
        SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Shop.Base' WHEN 1 THEN 'shop.Extra' ELSE 'Other.Lib' END AS assembly,
               'N.' || w1 || w2 || 'Helper' || CASE WHEN s_suppkey % 2 = 1 THEN '`1' ELSE '' END AS metadata_name, CASE WHEN s_suppkey % 7 = 0 THEN 'internal' ELSE 'public' END AS accessibility
        FROM {{supplier}} JOIN (SELECT p_partkey, {_WORD.format(n=1)} AS w1, {_WORD.format(n=2)} AS w2 FROM {{part}}) p ON p_partkey = s_suppkey"""),
    "churn": (("events",), """SELECT 'SRC/T' || CAST(user_id * 3 AS STRING) || '.cs' AS path, count(*) AS n FROM {events} GROUP BY user_id"""),
    "changed_types": (("part",), ""),  # below: it reads type_decl
    "changed": (("orders",), """
        SELECT 'SRC/t' || CAST(o_orderkey AS STRING) || '.cs' AS path FROM {orders} WHERE o_orderkey % 3 > 0
        UNION ALL SELECT 'Tests/T' || CAST(o_orderkey AS STRING) || 'Tests.cs' FROM {orders} WHERE o_orderkey % 5 > 0"""),
    "removed_text": (("documents",), """
        SELECT 'sha' || CAST(doc_id AS STRING) || 'abcdef' AS sha, 'subject ' || CAST(doc_id AS STRING) AS subject, CAST(1000000 - doc_id AS INT) AS ago, split(coalesce(text, ''), '\n') AS lines
        FROM {documents} WHERE doc_id % 2 = 0"""),
    "added_text": (("documents",), """
        SELECT 'd' || CAST(doc_id AS STRING) || '.cs' AS path, CAST(doc_id % 50 + 1 AS INT) AS first_line, split(coalesce(text, ''), '\n') AS lines FROM {documents} WHERE doc_id % 2 = 1"""),
}
FACTS["changed_types"] = (("part",), f"SELECT upper(path) AS path FROM ({FACTS['type_decl'][1]}) WHERE k % 3 = 0")
#: Bodies as source text, with what a reader must not count in a string and in comments; ``k`` tells how many branches there are.
_BODY = """'{ string s = "if (a && b) ? c : d"; // while (x)' || chr(10) || '/* case 1: ' || chr(10) || ' */' || CASE WHEN k % 3 = 0 THEN ' if (a && b || c) { }' ELSE '' END
    || repeat(' while (x) { y(); }', CAST(k % 4 AS INT)) || CASE WHEN k % 5 = 0 THEN ' do { } while (z);' ELSE '' END || ' int? n = a?.b ?? c; var r = n switch {'
    || repeat(' 1 => x => 2,', CAST(k % 6 AS INT)) || ' _ => 0 };' || CASE WHEN k % 7 = 0 THEN ' return p ? q : r;' ELSE ' goto case 3;' END || ' }'"""
FACTS["member_source"] = (("lineitem",), f"""
    SELECT 'P' || CAST(o % 7 AS STRING) AS project, 'src/T' || CAST(o AS STRING) || '.cs' AS path, 'T' || CAST(o AS STRING) AS type_name, 'Go' AS name, CAST(l AS INT) AS arity,
           CAST(l * 10 AS INT) AS line, 'method' AS kind, k, CASE WHEN k % 11 > 0 THEN {_BODY.replace("{", "{{").replace("}", "}}")} END AS body
    FROM (SELECT l_orderkey AS o, l_linenumber AS l, CAST(min(l_partkey) AS BIGINT) AS k FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber)""")
FACTS["head_source"] = (("lineitem",), f"""
    SELECT 'T' || CAST(o AS STRING) AS type_name, 'Go' AS name, CAST(l AS INT) AS arity, k, {_BODY.replace("{", "{{").replace("}", "}}")} AS body
    FROM (SELECT l_orderkey AS o, l_linenumber AS l, CAST(min(l_suppkey) AS BIGINT) AS k FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) WHERE o % 4 > 0""")
_TESTS = """
    SELECT 'tests/T' || CAST(o_orderkey AS STRING) || 'Tests.cs' AS path, 'Test' || CAST(o_orderkey AS STRING) AS test, {attributes} AS attributes, o_custkey % 9 <> 0 AS has_assertion,
           CAST(o_custkey AS STRING) AS body_hash, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_custkey AS STRING) ELSE 'x' END AS head_hash,
           array('T' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN 'DataModel' ELSE 'Thing' END) AS type_refs,
           array('Total', CASE WHEN o_custkey % 2 = 0 THEN 'Middle' ELSE 'Alpha' END) AS invoked FROM {{orders}}"""
_MARK = "CASE o_custkey % 5 WHEN 0 THEN 'Helper' ELSE 'XunitFact' END"
TEST_METHOD = {
    "spark": _TESTS.format(attributes=f"array(named_struct('name', {_MARK}, 'named_args', array(CASE WHEN o_custkey % 6 = 0 THEN 'Skip' ELSE 'Name' END)))"),
    "sql": _TESTS.format(attributes=f"[{{{{'name': {_MARK}, 'named_args': [CASE WHEN o_custkey % 6 = 0 THEN 'Skip' ELSE 'Name' END]}}}}]"),
}


def facts(spark: SparkSession, d: str, *names: str, **renamed: str) -> dict[str, DataFrame]:
    """Facts by name; ``renamed`` gives a rule's name of a fact and the one it has here."""
    out = {}
    for name, own in {**{n: n for n in names}, **renamed}.items():
        needs, select = (("orders",), TEST_METHOD["spark"]) if own == "test_method" else FACTS[own]
        out[name] = spark.sql(select, **{t: table(spark, d, t) for t in needs})
    return out


def _ctes(*names: str) -> str:
    def portable(select: str) -> str:
        for a, b in (("array(", "list_value("), ("transform(split(text, ' '), w ->", "list_transform(string_split(text, ' '), lambda w:"), ("split(coalesce", "string_split(coalesce"), ("'\n'", "chr(10)"), ("explode(sequence(", "unnest(generate_series(")):
            select = select.replace(a, b)
        return select.replace("{{", "\0").replace("}}", "\1").replace("{", "").replace("}", "").replace("\0", "{").replace("\1", "}")

    one = lambda n: TEST_METHOD["sql"] if n == "test_method" else FACTS[n][1]
    return ", ".join(f"{n} AS ({portable(one(n))})" for n in names)


def _rule(name: str, rule: str, sql: str, uses: str, options: dict | None = None, args: str = "", **renamed: str) -> None:
    """Registers the query ``name``: what ``rule`` reports, its arguments as columns; ``uses`` lists the facts it gets."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = rules.run(facts(spark, d, *uses.split(), **renamed), options or {}, [rule])
        own = [F.try_element_at("args", F.lit(a)).alias(a) for a in args.split()]
        return found.select("rule_id", "severity", "project", "path", "line", "subject", *own)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"WITH RECURSIVE {_ctes(*uses.split(), *renamed.values())} {sql}"


def _row(of: str, subject: str, /, path: str = "path", line: str = "line", project: str = "project", severity: str = "error", **args: str) -> str:
    more = "".join(f", CAST({v} AS VARCHAR) AS {k}" for k, v in args.items())
    return f"SELECT '{of}' AS rule_id, '{severity}' AS severity, {project} AS project, {path} AS path, CAST({line} AS INT) AS line, {subject} AS subject{more}"


_PLACED = "kind IN ('class', 'enum', 'record', 'record struct')"
_rule("arch001_type_folder", "ARCH001", f"""
    {_row("ARCH001", "name", line="start_line", folder="CASE WHEN name LIKE '%BusinessModel' THEN 'Models/Business' ELSE 'src>Models' END")} FROM type_decl
    WHERE {_PLACED} AND name LIKE '%Model' AND NOT regexp_matches(upper(path), CASE WHEN name LIKE '%BusinessModel' THEN '(^|/)MODELS/BUSINESS/[^/]*$' ELSE '(^|/)SRC/MODELS/[^/]*$' END)""",
    "type_decl", {"model_conventions": "Model=src>Models;BusinessModel=Models/Business"}, "folder")
_rule("arch002_type_file", "ARCH002", f"{_row('ARCH002', 'name', line='start_line')} FROM type_decl WHERE {_PLACED} AND regexp_extract(path, '([^/]*)\\.[^.]*$', 1) <> name", "type_decl")
_rule("arch003_folder_suffixes", "ARCH003a", f"""
    {_row("ARCH003", "name", line="start_line", expected="CASE WHEN deep THEN 'BusinessModel, Helper' ELSE 'Model' END")}
    FROM (SELECT *, regexp_matches(upper(path), '(^|/)MODELS/BUSINESS/[^/]*$') AS deep FROM type_decl) WHERE {_PLACED}
      AND CASE WHEN deep THEN name NOT LIKE '%BusinessModel' AND name NOT LIKE '%Helper' ELSE regexp_matches(upper(path), '(^|/)MODELS/[^/]*$') AND name NOT LIKE '%Model' END""",
    "type_decl", {"model_folder_allowed_suffixes": "Models=Model;Models/Business=BusinessModel,Helper"}, "expected")
_rule("arch003_project_files", "ARCH003b", f"""
    {_row("ARCH003", "regexp_extract(path, '([^/]*)$', 1)", line="NULL", expected="CASE WHEN project LIKE 'Web1%' THEN '**/Models/*.cs' ELSE '*Dto.cs, *Request.cs' END")} FROM source_file
    WHERE NOT is_generated AND NOT CASE WHEN project LIKE 'Web1%' THEN regexp_full_match(path, '(.*/)?Models/[^/]*\\.cs') ELSE regexp_full_match(path, '.*(Dto|Request)\\.cs') END""",
    "source_file", {"project_allowed_files": "Web1*=**/Models/*.cs;*.Contracts=*Dto.cs,*Request.cs"}, "expected")
_PROVIDERS = "p AS (SELECT DISTINCT project, name FROM type_decl WHERE kind = 'interface' AND project LIKE '%Module' AND regexp_matches(path, '(^|/)Models/Data/Providers/[^/]*$'))"
_rule("arch003_module_provider", "ARCH003c", f""", {_PROVIDERS} {_row("ARCH003", "project", path="NULL::VARCHAR", line="NULL", expected="'an interface in Models/Data/Providers'")}
    FROM (SELECT DISTINCT project FROM type_decl WHERE project LIKE '%Module') WHERE project NOT IN (SELECT project FROM p)""", "type_decl", args="expected")  # fmt: skip
_rule("arch004_provider_in_module", "ARCH004", f""", {_PROVIDERS},
      e AS (SELECT project, name, unnest(interfaces) AS parent FROM type_decl UNION SELECT project, name, base FROM type_decl UNION SELECT * FROM supertype),
      r AS (SELECT e.project, e.name, e.parent FROM e JOIN p ON p.project = e.project AND p.name = e.parent WHERE e.name <> e.parent
            UNION SELECT e.project, e.name, r.parent FROM r JOIN e ON e.project = r.project AND e.parent = r.name WHERE e.name <> r.parent)
    {_row("ARCH004", "t.name", path="t.path", line="t.start_line", project="t.project", interface="min(r.parent)")}
    FROM type_decl t JOIN r ON r.project = t.project AND r.name = t.name WHERE t.kind <> 'interface' AND t.project LIKE '%Module' GROUP BY t.project, t.path, t.name, t.start_line""",
    "type_decl supertype", args="interface")
_ORDERED = """, o AS (SELECT *, lag(name) OVER (PARTITION BY project, path, type_name ORDER BY ordinal) AS previous FROM member WHERE type_kind = 'class' AND kind = '{kind}' {more})
    {row} FROM o WHERE name < previous"""
_rule("arch005_property_order", "ARCH005", _ORDERED.format(kind="property", more="AND type_name LIKE '%DataModel' AND NOT regexp_matches(name, '(Id|Ids|IDs)$')", row=_row("ARCH005", "name", previous="previous")), "member", args="previous")
_rule("arch011_method_order", "ARCH011", _ORDERED.format(kind="method", more="", row=_row("ARCH011", "name", previous="previous")), "member", args="previous")
_rule("arch006_type_size", "ARCH006", f"{_row('ARCH006', 'name', line='start_line', lines='non_blank_lines', max='20')} FROM type_decl WHERE kind IN ('class', 'record', 'record struct') AND non_blank_lines > 20", "type_decl", args="lines max")
_rule("arch007_method_size", "ARCH007", f"{_row('ARCH007', 'name', lines='non_blank_lines', max='40')} FROM member WHERE kind = 'method' AND non_blank_lines > 40", "member", {"loc_max_lines_per_method": "40"}, "lines max")
_GROWTH = ", b AS (SELECT {key} sum(lines) AS baseline FROM baseline {by}), a AS (SELECT {key} sum(added) AS added FROM numstat {by})"
_BUDGET = "greatest(1, (baseline * {p} + 99) // 100)"
_rule("arch008_solution_growth", "ARCH008", f"""{_GROWTH.format(key="", by="")} {_row("ARCH008", "'solution'", path="NULL::VARCHAR", line="NULL", project="NULL::VARCHAR", added="added", budget=_BUDGET.format(p=7))}
    FROM a, b WHERE baseline > 0 AND added > {_BUDGET.format(p=7)}""", "baseline numstat", {"loc_budget_percent_global": "7"}, "added budget")  # fmt: skip
_rule("arch009_project_growth", "ARCH009", f"""{_GROWTH.format(key="project,", by="GROUP BY 1")} {_row("ARCH009", "project", path="NULL::VARCHAR", line="NULL", added="added", budget=_BUDGET.format(p=11))}
    FROM a JOIN b USING (project) WHERE baseline > 0 AND added > {_BUDGET.format(p=11)}""", "baseline numstat", {"loc_budget_percent_project": "11"}, "added budget")  # fmt: skip
_rule("arch010_required_folders", "ARCH010", f"""{_row("ARCH010", "project", path="NULL::VARCHAR", line="NULL", folder="folder")}
    FROM (SELECT DISTINCT project FROM source_file WHERE NOT is_generated AND path LIKE '%.cs' AND NOT contains(lower(path), '/obj/')) JOIN (VALUES ('Web1.Contracts', 'Models'), ('Web1.Contracts', 'Lost'), ('Web2.Contracts', 'Entities'), ('Web2.Contracts', 'Other')) r(project, folder) USING (project)
    WHERE NOT EXISTS (SELECT 1 FROM source_file s WHERE s.project = r.project AND NOT s.is_generated AND s.path LIKE '%.cs' AND NOT contains(lower(s.path), '/obj/') AND regexp_matches(upper(s.path), '(^|/)' || upper(folder) || '/[^/]*$'))""",
    "source_file", {"required_project_folders": "Web1.Contracts=Models,Lost;Web2.Contracts=Entities,Other;Web1.Contracts=Never;None=X"}, "folder")
_IS = "(upper({c}) = '{m}' OR upper({c}) LIKE '{m}.%' OR upper({c}) LIKE '%.{m}')"
_rule("arch012_module_barrier", "ARCH012", f"""{_row("ARCH012", "to_symbol", rule="CASE WHEN " + _IS.format(c="project", m="PORTAL") + " THEN 'Portal>Domain' ELSE 'Core>Domain' END")} FROM reference
    WHERE ({_IS.format(c="project", m="PORTAL")} OR {_IS.format(c="project", m="CORE")}) AND {_IS.format(c="to_assembly", m="DOMAIN")} AND path NOT IN ('src/F3.cs', 'src/F14.cs')""",
    "reference", {"module_reference_barrier": "Portal>Domain;Core>Domain", "module_reference_barrier_exceptions": "f3.cs;SRC/F14.cs"}, "rule")
for _n, _id, _fact, _where, _at in (("arch013_variable_name", "ARCH013", "member", "kind = 'variable'", "line"), ("arch014_class_name", "ARCH014", "type_decl", "kind = 'class'", "start_line")):
    _least = 14 if _fact == "type_decl" else 4
    _rule(_n, _id, f"{_row(_id, 'name', line=_at, min=str(_least))} FROM {_fact} WHERE {_where} AND length(name) < {_least}", _fact, {f"min_{_n.split('_')[1]}_name_length": str(_least)}, "min")
_rule("arch015_method_name", "ARCH015", f"""
    , c AS (SELECT project, member_id, overridden AS target, 1 AS steps FROM overrides
            UNION ALL SELECT c.project, c.member_id, o.overridden, steps + 1 FROM c JOIN overrides o ON o.project = c.project AND o.member_id = c.target WHERE steps < 50),
      n AS (SELECT project, member_id, target FROM c WHERE NOT EXISTS (SELECT 1 FROM overrides o WHERE o.project = c.project AND o.member_id = c.target)
            UNION ALL SELECT project, member_id, interface_member FROM implements i WHERE NOT EXISTS (SELECT 1 FROM overrides o WHERE o.project = i.project AND o.member_id = i.member_id)),
      x AS (SELECT project, member_id FROM n WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.project = n.project AND m.member_id = n.target))
    {_row("ARCH015", "name", min="4")} FROM member m WHERE kind = 'method' AND length(name) < 4 AND NOT EXISTS (SELECT 1 FROM x WHERE x.project = m.project AND x.member_id = m.member_id)""",
    "member overrides implements", {"min_method_name_length": "4"}, "min")
_rule("arch015_flagged_names", "ARCH015", f"{_row('ARCH015', 'name', min='4')} FROM member WHERE kind = 'method' AND NOT imposed_externally AND length(name) < 4", "member", {"min_method_name_length": "4"}, "min")
_FIRST = "CASE WHEN type_name LIKE '%Module' AND len(list_filter(nominal_names, lambda x: x LIKE '%DataModel')) > 0 THEN '*Module>*DataModel' WHEN type_name LIKE 'Module%' AND len(list_filter(nominal_names, lambda x: contains(x, 'iew'))) > 0 THEN 'Module*>*iew*' END"
_rule("arch016_parameter_barrier", "ARCH016", f"""{_row("ARCH016", "type_name || '.' || method", rule="rule")} FROM (SELECT *, {_FIRST} AS rule FROM parameter WHERE type_kind = 'class' AND NOT is_error) WHERE rule IS NOT NULL""",
    "parameter", {"method_argument_type_barrier": "*Module>*DataModel;Module*>*iew*"}, "rule")
_rule("arch017_concatenation", "ARCH017", f""", h AS (SELECT * FROM operation WHERE is_builtin AND result_type = 'string' AND ((kind = 'binary' AND operator = '+' AND NOT is_constant) OR (kind = 'compound_assignment' AND operator = '+=')))
    {_row("ARCH017", "operator")} FROM h WHERE NOT EXISTS (SELECT 1 FROM h u WHERE u.project = h.project AND u.path = h.path AND u.op_id = h.parent_op_id)""", "operation")  # fmt: skip
_rule("arch018_interpolation", "ARCH018", f"{_row('ARCH018', chr(39) + '$' + chr(39))} FROM operation WHERE kind = 'interpolation' AND n_holes > 0 AND NOT is_constant", "operation")
_rule("arch019_near_duplicate_bodies", "ARCH019", f"""
    , b AS (SELECT *, len(tokens) AS n FROM body WHERE len(tokens) >= 30),
      k AS (SELECT project, path, n, w, count(*) AS c FROM (SELECT project, path, n, unnest(list_transform(generate_series(1, n - 4), lambda i: tokens[i:i + 4])) AS w FROM b) GROUP BY ALL),
      q AS (SELECT x.project, x.path AS a, y.path AS b, x.n AS n_a, y.n AS n_b, CAST(sum(least(x.c, y.c)) AS BIGINT) AS shared
            FROM k x JOIN k y ON x.project = y.project AND x.w = y.w AND (x.n, x.path) < (y.n, y.path) AND y.n * 90 <= x.n * 100 GROUP BY ALL),
      o AS (SELECT *, shared * 100 // (n_b - 4) AS similarity FROM q),
      r AS (SELECT *, row_number() OVER (PARTITION BY project, greatest(a, b) ORDER BY n_a, a, n_b, b) AS first FROM o WHERE similarity >= 90)
    {_row("ARCH019", "'D.B' || greatest(a, b)[2:-4]", path="greatest(a, b)", line="1", original="'D.B' || least(a, b)[2:-4]", similarity="similarity")} FROM r WHERE first = 1""",
    "", args="original similarity", member="body")
_rule("arch020_known_types", "ARCH020", f"""{_row("ARCH020", "t.name", path="t.path", line="t.start_line", project="t.project", assembly="min(a.assembly)")}
    FROM type_decl t JOIN assembly_type a ON a.accessibility = 'public' AND upper(split_part(a.assembly, '.', 1)) = upper(split_part(t.project, '.', 1))
         AND split_part(a.metadata_name, '.', -1) = t.name || CASE WHEN t.arity > 0 THEN '`' || t.arity ELSE '' END
    WHERE NOT t.is_nested AND t.name <> 'BigCrateHelper' GROUP BY t.k, t.name, t.path, t.start_line, t.project""", "type_decl assembly_type", {"duplicate_type_name_exceptions": "BigCrateHelper"}, "assembly")  # fmt: skip
_rule("arch021_test_share", "ARCH021", f"""{_row("ARCH021", "'tests'", path="NULL::VARCHAR", line="NULL", project="NULL::VARCHAR", percent="t * 100 // p", min="20")}
    FROM (SELECT sum(added) FILTER (is_test) AS t, sum(added) FILTER (NOT is_test) AS p FROM numstat) WHERE p >= 50 AND t * 100 // p < 20""", "numstat", {"min_test_lines_percent": "20"}, "percent min")  # fmt: skip
_rule("arch022_complexity", "ARCH022", f"""
    , h AS (SELECT type_name, name, arity, max(complexity) AS before FROM head_member GROUP BY ALL), c AS (SELECT upper(path) AS key, sum(n) AS n FROM churn GROUP BY 1),
      t AS (SELECT greatest(3, (list(n ORDER BY n))[(count(*) * 90 + 99) // 100]) AS least FROM c), w AS (SELECT m.*, before FROM member m JOIN h USING (type_name, name, arity) WHERE m.kind = 'method' AND complexity > before + 1)
    SELECT CASE WHEN n IS NULL THEN 'ARCH022' ELSE 'ARCH023' END AS rule_id, CASE WHEN n IS NULL THEN 'warning' ELSE 'error' END AS severity, project, path, line, type_name || '.' || name AS subject,
           before::VARCHAR AS before, complexity::VARCHAR AS after, coalesce(n, 0)::BIGINT::VARCHAR AS churn
    FROM w LEFT JOIN (SELECT key, n FROM c, t WHERE n >= least) x ON x.key = upper(path)""", "member head_member churn", {"complexity_ratchet_allowed_increase": "1"}, "before after churn")  # fmt: skip
_rule("arch022_from_source", "ARCH022", f"""
    , m AS (SELECT *, CASE WHEN body IS NULL THEN 0 ELSE 3 + CASE WHEN k % 3 = 0 THEN 3 ELSE 0 END + k % 4 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + k % 6 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END END AS c FROM member_source),
      h AS (SELECT *, 3 + CASE WHEN k % 3 = 0 THEN 3 ELSE 0 END + k % 4 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + k % 6 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS b FROM head_source)
    {_row("ARCH022", "type_name || '.' || name", severity="warning", before="b", after="c")} FROM m JOIN h USING (type_name, name, arity) WHERE c > b + 2""",
    "", {"complexity_ratchet_allowed_increase": "2"}, "before after", member="member_source", head_member="head_source")
_rule("arch024_inferred_conventions", "ARCH024", f"""
    , y AS (SELECT *, regexp_extract_all(name, '[A-Z][a-z0-9]*') AS ws, string_split(path, '/')[:-2] AS dirs FROM type_decl WHERE NOT is_nested),
      s AS (SELECT k, project, path, name, start_line, unnest([{{'level': 0, 'grp': CASE WHEN len(ws) > 2 THEN ws[-2] || ws[-1] END}}, {{'level': 1, 'grp': ws[-1]}}], recursive := true),
                   [{{'trait': 'folder', 'actual': array_to_string(dirs[-2:], '/')}}, {{'trait': 'namespace', 'actual': split_part(namespace, '.', -1)}}, {{'trait': 'kind', 'actual': kind}},
                    {{'trait': 'sealed', 'actual': (is_sealed AND NOT is_static)::VARCHAR}}, {{'trait': 'static', 'actual': is_static::VARCHAR}}, {{'trait': 'accessibility', 'actual': accessibility}}, {{'trait': 'base', 'actual': base}}] AS ts FROM y WHERE len(ws) >= 2),
      u AS (SELECT k, project, path, name, start_line, level, grp, unnest(ts, recursive := true) FROM s WHERE grp IS NOT NULL),
      c AS (SELECT project, level, grp, trait, actual, count(*) AS n FROM u GROUP BY ALL),
      m AS (SELECT project, level, grp, trait, actual AS expected, n AS matching, sum(n) OVER v AS total, row_number() OVER (v ORDER BY n DESC, actual) AS first FROM c WINDOW v AS (PARTITION BY project, level, grp, trait)),
      g AS (SELECT * FROM m WHERE first = 1 AND total >= 5 AND matching >= 5 AND matching * 100 >= total * 60 AND NOT (grp = 'Provider' AND trait = 'base')
                 AND CASE WHEN trait IN ('sealed', 'static') THEN expected = 'true' WHEN trait IN ('base', 'folder', 'namespace') THEN expected <> '' ELSE true END),
      j AS (SELECT u.*, expected, matching, total, row_number() OVER (PARTITION BY k, trait ORDER BY u.level) AS place FROM u JOIN g USING (project, level, grp, trait) WHERE upper(path) IN (SELECT path FROM changed_types))
    {_row("ARCH024", "name", line="start_line", severity="warning", suffix="grp", trait="trait", actual="actual", expected="expected", matching="matching", total="total")} FROM j WHERE place = 1 AND actual <> expected""",
    "type_decl", {"convention_min_ratio": "60", "convention_ignore": "Provider>base", "model_suffix": " "}, "trait actual expected matching total suffix", changed="changed_types")
_rule("arch025_tested_changes", "ARCH025", f"""
    , c AS (SELECT DISTINCT upper(path) AS key FROM changed), h AS (SELECT type_name, name, arity, arg_max(body_hash, body_lines) AS hash, max(body_lines) AS lines FROM head_member GROUP BY ALL),
      d AS (SELECT m.*, CASE WHEN m.kind = 'ctor' THEN type_name ELSE m.name END AS called FROM member m LEFT JOIN h USING (type_name, name, arity)
            WHERE kind IN ('method', 'ctor') AND has_body AND accessibility <> 'private' AND NOT regexp_matches(lower('/' || path), '/tests/|\\.tests/|tests\\.cs|test\\.cs|spec\\.cs') AND NOT contains(upper(path), 'T7')
              AND upper(path) IN (FROM c) AND CASE WHEN hash IS NULL THEN m.body_lines >= 5 ELSE hash <> m.body_hash AND m.body_lines - lines >= 5 END),
      e AS (SELECT path, test, unnest(type_refs) AS type_name, invoked FROM test_method WHERE upper(path) IN (FROM c) AND attributes[1].name LIKE '%Fact' AND NOT list_contains(attributes[1].named_args, 'Skip')
            AND (head_hash IS NULL OR head_hash <> body_hash) AND has_assertion),
      n AS (SELECT type_name, count(*) AS evidences FROM e GROUP BY 1)
    {_row("ARCH025", "d.type_name || '.' || d.name", evidences="coalesce(evidences, 0)")} FROM d LEFT JOIN n USING (type_name)
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.type_name = d.type_name AND list_contains(e.invoked, d.called))""",
    "member head_member changed test_method", {"test_link_min_added_lines": "5", "test_link_exclude_paths": "t7"}, "evidences")
_rule("arch025_counted_calls", "ARCH025", f"""
    , c AS (SELECT DISTINCT upper(path) AS key FROM changed), h AS (SELECT type_name, name, arity, arg_max(body_hash, body_lines) AS hash, max(body_lines) AS lines FROM head_member GROUP BY ALL),
      d AS (SELECT m.*, CASE WHEN m.kind = 'ctor' THEN type_name ELSE m.name END AS called FROM member m LEFT JOIN h USING (type_name, name, arity)
            WHERE kind IN ('method', 'ctor') AND has_body AND accessibility <> 'private' AND NOT regexp_matches(lower('/' || path), '/tests/|\\.tests/|tests\\.cs|test\\.cs|spec\\.cs')
              AND upper(path) IN (FROM c) AND CASE WHEN hash IS NULL THEN m.body_lines >= 5 ELSE hash <> m.body_hash AND m.body_lines - lines >= 5 END),
      u AS (SELECT path, test, node, parent AS above FROM test_node WHERE parent IS NOT NULL
            UNION SELECT u.path, u.test, u.node, n.parent FROM u JOIN test_node n ON n.path = u.path AND n.test = u.test AND n.node = u.above WHERE n.parent IS NOT NULL),
      s AS (SELECT c.path, c.test, c.parent FROM test_node c WHERE c.kind = 'catch' AND coalesce(c.name, 'Exception') = 'Exception'
              AND NOT EXISTS (SELECT 1 FROM u JOIN test_node t USING (path, test, node) WHERE u.path = c.path AND u.test = c.test AND u.above = c.node AND t.kind = 'throw')),
      q AS (SELECT path, test, node FROM test_node n WHERE kind IN ('nameof', 'typeof') OR (kind = 'block' AND EXISTS (SELECT 1 FROM s WHERE s.path = n.path AND s.test = n.test AND s.parent = n.parent))),
      i AS (SELECT path, test, list(DISTINCT name) AS invoked FROM test_node n WHERE kind IN ('call', 'new') AND name IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM u JOIN q ON q.path = u.path AND q.test = u.test AND q.node = u.above WHERE u.path = n.path AND u.test = n.test AND u.node = n.node) GROUP BY 1, 2),
      e AS (SELECT path, test, unnest(type_refs) AS type_name, i.invoked FROM test_method JOIN i USING (path, test) WHERE upper(path) IN (FROM c) AND attributes[1].name LIKE '%Fact'
            AND NOT list_contains(attributes[1].named_args, 'Skip') AND (head_hash IS NULL OR head_hash <> body_hash) AND has_assertion),
      n AS (SELECT type_name, count(*) AS evidences FROM e GROUP BY 1)
    {_row("ARCH025", "d.type_name || '.' || d.name", evidences="coalesce(evidences, 0)")} FROM d LEFT JOIN n USING (type_name)
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.type_name = d.type_name AND list_contains(e.invoked, d.called))""",
    "member head_member changed test_method test_node", {"test_link_min_added_lines": "5"}, "evidences")
_WINDOWS = """SELECT * EXCLUDE (ls), w[1] AS i, array_to_string(ls[w[1]:w[1] + 2], chr(10)) AS win FROM (
        SELECT * EXCLUDE (lines), list_transform(lines, lambda x: trim(regexp_replace(x, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))) AS ls FROM {t}), unnest(list_transform(generate_series(1, len(ls) - 2), lambda i: [i])) g(w)
    WHERE NOT regexp_full_match(ls[w[1]], '[{{}}();,]*') AND NOT regexp_full_match(ls[w[1] + 1], '[{{}}();,]*') AND NOT regexp_full_match(ls[w[1] + 2], '[{{}}();,]*')"""
_rule("arch027_reappearing_blocks", "ARCH027", f"""
    , r AS ({_WINDOWS.format(t="removed_text")}), a AS ({_WINDOWS.format(t="added_text")}), n AS (SELECT win, min(ago) AS ago, arg_min(sha, ago) AS sha, arg_min(subject, ago) AS subject FROM r GROUP BY 1),
      h AS (SELECT path, first_line + i - 1 AS line, sha, subject, ago FROM a JOIN n USING (win)), o AS (SELECT path, list(line ORDER BY line) AS ls FROM h GROUP BY 1),
      g AS (SELECT path, ls, ls[1] AS line FROM o UNION ALL SELECT path, ls, list_filter(ls, lambda x: x >= line + 3)[1] FROM g WHERE len(list_filter(ls, lambda x: x >= line + 3)) > 0)
    {_row("ARCH027", "path", project="NULL::VARCHAR", severity="warning", sha="left(sha, 7)", subject_line="subject", ago="ago")} FROM h JOIN (SELECT path, line FROM g) USING (path, line)""",
    "removed_text added_text", args="sha subject_line ago")


def rule_gauge(spark: SparkSession, d: str) -> DataFrame:
    return size.gauge(facts(spark, d, "baseline", "numstat"), {"loc_budget_percent_global": "7", "loc_budget_percent_project": "11"})


def rule_history(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("ask, "), "event_type").alias("prompt"), F.array(F.col("event_type")).alias("paths"),
        (F.col("user_id") % 2).alias("production"), F.lit(0).alias("tests"), F.lit(20).alias("budget"), F.lit(5).alias("usage"), F.lit(False).alias("over"), "event_id",
    )
    first = events.groupBy("ts").agg(F.min_by(F.struct(*[c for c in events.columns if c != "ts"]), "event_id").alias("e")).select("ts", "e.*")
    return size.history(first).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "line")


_GAUGE_SQL = """SELECT {scope} AS scope, baseline, added, {budget} AS budget, CAST(round_even(added * 100 / nullif({budget}, 0), 0) AS BIGINT) AS usage, {budget} > 0 AND added > {budget} AS over FROM {source}"""
QUERIES.update(rule_gauge=rule_gauge, rule_history=rule_history)
SQL["rule_gauge"] = (
    f"WITH {_ctes('baseline', 'numstat')}, b AS (SELECT project, sum(lines)::BIGINT AS baseline FROM baseline GROUP BY 1), a AS (SELECT project, sum(added)::BIGINT AS added FROM numstat GROUP BY 1), "
    "j AS (SELECT project, baseline, coalesce(added, 0) AS added FROM b LEFT JOIN a USING (project)), w AS (SELECT (SELECT sum(baseline) FROM b)::BIGINT AS baseline, (SELECT sum(added) FROM a)::BIGINT AS added) "
    + _GAUGE_SQL.format(scope="'solution'", budget=f"({_BUDGET.format(p=7)})::BIGINT", source="w") + " UNION ALL "
    + _GAUGE_SQL.format(scope="project", budget=f"(CASE WHEN baseline > 0 THEN {_BUDGET.format(p=11)} ELSE 0 END)::BIGINT", source="j")
)
SQL["rule_history"] = """
    WITH e AS (SELECT date_trunc('second', ts) AS ts, arg_min(event_type, event_id) AS kind, arg_min(user_id % 2, event_id) AS production FROM events GROUP BY 1),
         l AS (SELECT *, lag((kind, production)) OVER (ORDER BY ts) AS before FROM e)
    SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ',"ask, ' || kind || '",1,' || production || ',0,20,5,false' AS line
    FROM l WHERE before IS NULL OR before <> (kind, production)"""
