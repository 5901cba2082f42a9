"""Code-conformance rules over fact tables.

A rule is a function of the facts (DataFrames by name) and the options (a flat map of strings) that returns diagnostics.
Facts, with the columns the rules read:

source_file  project, path, n_lines, is_generated, is_test
type_decl    project, path, name, arity, namespace, kind, is_nested, is_sealed, is_static, accessibility, base,
             interfaces (array), start_line, non_blank_lines
member       project, path, type_name, type_kind, kind, name, arity, ordinal, line, accessibility, has_body, complexity,
             non_blank_lines, body_lines, body_hash, tokens (array of kinds), imposed_externally, member_id; instead of
             complexity, body_lines, body_hash and tokens it may have body, the source text (so may head_member)
supertype    project, name, parent: is-a edges besides those of type_decl, of types declared elsewhere (optional)
overrides    project, member_id, overridden           implements  project, member_id, interface_member
             (both optional: with them ARCH015 finds imposed names itself; without, ``imposed_externally`` tells)
parameter    project, path, line, type_name, type_kind, method, name, nominal_names (array), or instead of it type_text
             and type_parameters (array), is_error
reference    project, path, line, to_symbol, to_assembly
operation    project, path, line, op_id, parent_op_id, kind, operator, is_builtin, is_constant, result_type, n_holes
assembly_type  assembly, metadata_name, accessibility
head_member  type_name, name, arity, complexity, body_hash, body_lines
test_method  path, test, attributes (array of struct name, named_args), has_assertion, body_hash, head_hash, type_refs
             (array), invoked (array)
test_node    path, test, node, parent, ordinal, kind, name: the tree of a test's body (optional; with it ``invoked`` is found
             from the calls that count)
numstat      project, path, added, is_test          baseline  project, lines
churn        path, n                                changed   path
removed_text / added_text   lines of either side (see ``code.reappearing``)
"""

from pyspark.sql import DataFrame

from . import code, names, references, size, structure

RULES = {**structure.RULES, **size.RULES, **references.RULES, **names.RULES, **code.RULES}


def written_by_hand(facts: dict) -> dict:
    """The facts without those of generated files, as ``source_file`` tells."""
    files = facts.get("source_file")
    if files is None or "is_generated" not in files.columns:
        return facts
    made = files.filter("is_generated").select("project", "path").distinct()

    def kept(name: str, df: DataFrame) -> DataFrame:
        if "path" not in df.columns or name in ("numstat", "churn", "changed"):
            return df
        # A generated file of one project says nothing of a file of that path in another.
        return df.join(made, ["project", "path"], "left_anti") if "project" in df.columns else df.join(made.select("path").distinct(), "path", "left_anti")

    return {n: kept(n, df) for n, df in facts.items()}


def run(facts: dict, options: dict[str, str], only: list[str] | None = None):
    """The union of all rules' diagnostics; a rule whose options are unset, or whose facts are missing, stays silent."""
    facts = written_by_hand(facts)
    for name in ("member", "head_member"):
        if name in facts and "body" in facts[name].columns:
            facts = {**facts, name: code.from_source(facts[name])}
    out = None
    for rule, (needs, f) in RULES.items():
        if (only is None or rule in only) and all(n in facts for n in needs):
            found = f(facts, options)
            if found is not None:
                out = found if out is None else out.unionByName(found)
    return out
