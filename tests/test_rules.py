import pytest
from pyspark.sql import functions as F

from plumbline import rules
from plumbline.plans.diagnostics import MESSAGES, SCHEMA, with_message
from plumbline.rules import size

TYPE = ("project string, path string, name string, arity int, namespace string, kind string, is_nested boolean, is_sealed boolean, is_static boolean, "
        "accessibility string, base string, interfaces array<string>, start_line int, non_blank_lines long")  # fmt: skip
MEMBER = ("project string, path string, type_name string, type_kind string, kind string, name string, arity int, ordinal int, line int, accessibility string, "
          "has_body boolean, complexity long, non_blank_lines long, body_lines long, body_hash string, tokens array<int>, imposed_externally boolean")  # fmt: skip


@pytest.fixture
def types(spark):
    def make(*rows):
        base = dict(project="P", path="Business/Models/X.cs", name="X", arity=0, namespace="A.B", kind="class", is_nested=False, is_sealed=False,
                    is_static=False, accessibility="public", base="", interfaces=[], start_line=1, non_blank_lines=5)
        return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], TYPE)

    return make


@pytest.fixture
def members(spark):
    def make(*rows):
        base = dict(project="P", path="C.cs", type_name="C", type_kind="class", kind="method", name="M", arity=0, ordinal=1, line=1, accessibility="public",
                    has_body=True, complexity=1, non_blank_lines=3, body_lines=9, body_hash="h", tokens=None, imposed_externally=False)
        return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], MEMBER)

    return make


def ids(facts, options=None, *only):
    found = rules.run(facts, options or {}, list(only))
    return sorted((r.rule_id, r.subject) for r in found.collect()) if found is not None else []


def test_placement(types):
    opts = {"model_conventions": "BusinessModel=Models/Business"}
    bad = types({"name": "OrderBusinessModel", "path": "Features/OrderBusinessModel.cs"}, {"name": "EBusinessModel", "kind": "enum", "path": "Features/EBusinessModel.cs"})
    good = types({"name": "OrderBusinessModel", "path": "src/models/business/OrderBusinessModel.cs"}, {"name": "IBusinessModel", "kind": "interface"})
    assert len(ids({"type_decl": bad}, opts, "ARCH001")) == 2 and not ids({"type_decl": good}, opts, "ARCH001")


def test_file_names(types):
    df = types({"name": "A", "path": "d/A.cs"}, {"name": "B", "path": "d/A.cs"})
    assert ids({"type_decl": df}, None, "ARCH002") == [("ARCH002", "B")]


def test_allowed_suffixes_and_files(types, spark):
    df = types({"name": "Helper", "path": "Models/Helper.cs"}, {"name": "OrderModel", "path": "Models/OrderModel.cs"})
    assert ids({"type_decl": df}, {"model_folder_allowed_suffixes": "Models=Model"}, "ARCH003a") == [("ARCH003", "Helper")]
    files = spark.createDataFrame([("HR.Contracts", "OrderDto.cs", False), ("HR.Contracts", "Helper.cs", False), ("X", "Helper.cs", False)], "project string, path string, is_generated boolean")
    assert ids({"source_file": files}, {"project_allowed_files": "*.Contracts=*Dto.cs,*Request.cs"}, "ARCH003b") == [("ARCH003", "Helper.cs")]


def test_module_providers(types):
    provider = {"project": "HR.Module", "name": "IEmployeeProvider", "kind": "interface", "path": "Models/Data/Providers/IEmployeeProvider.cs"}
    own = {"project": "HR.Module", "name": "EmployeeProvider", "path": "Services/EmployeeProvider.cs", "interfaces": ["IEmployeeProvider"]}
    assert ids({"type_decl": types({"project": "HR.Module"})}, None, "ARCH003c") == [("ARCH003", "HR.Module")]
    assert not ids({"type_decl": types({"project": "HR.Core"})}, None, "ARCH003c")
    assert not ids({"type_decl": types(provider)}, None, "ARCH003c", "ARCH004")
    assert ids({"type_decl": types(provider, own)}, None, "ARCH003c", "ARCH004") == [("ARCH004", "EmployeeProvider")]


def test_orders(members):
    df = members({"name": "Save", "ordinal": 1}, {"name": "Delete", "ordinal": 2})
    assert ids({"member": df}, None, "ARCH011") == [("ARCH011", "Delete")]
    props = members(*[{"kind": "property", "type_name": "OrderDataModel", "name": n, "ordinal": i} for i, n in enumerate(["Zip", "OrderId", "Age"])])
    assert ids({"member": props}, None, "ARCH005") == [("ARCH005", "Age")]


def test_sizes(types, members):
    assert ids({"type_decl": types({"non_blank_lines": 21}, {"non_blank_lines": 20})}, None, "ARCH006") == [("ARCH006", "X")]
    assert not ids({"member": members({"non_blank_lines": 25})}, {"loc_max_lines_per_method": "30"}, "ARCH007")


def test_budgets(spark):
    facts = {"baseline": spark.createDataFrame([("A", 1000)], "project string, lines long"),
             "numstat": spark.createDataFrame([("A", "a.cs", 25, False)], "project string, path string, added long, is_test boolean")}
    assert ids(facts, {"loc_budget_percent_global": "2", "loc_budget_percent_project": "3"}, "ARCH008", "ARCH009") == [("ARCH008", "solution")]
    assert not ids(facts, {}, "ARCH008", "ARCH009")
    usage = {r.scope: (r.budget, r.usage, r.over) for r in size.gauge(facts, {"loc_budget_percent_global": "2"}).collect()}
    assert usage == {"solution": (20, 125, True), "A": (0, None, False)}


def test_test_share(spark):
    def share(production, tests, **opts):
        rows = [("A", "a.cs", production, False), ("A", "t.cs", tests, True)]
        facts = {"numstat": spark.createDataFrame(rows, "project string, path string, added long, is_test boolean")}
        return len(ids(facts, {k: str(v) for k, v in opts.items()}, "ARCH021"))

    on = {"min_test_lines_percent": 20}
    assert [share(200, 10, **on), share(200, 50, **on), share(20, 0, **on), share(0, 120, **on), share(200, 10)] == [1, 0, 0, 0, 0]
    assert share(20, 0, test_ratio_min_added_lines=10, **on) == 1


def test_required_folders(spark):
    files = spark.createDataFrame([("HR.Infrastructure", "Models/X.cs"), ("HR.Infrastructure", "Models/Entities/Sub/Y.cs"), ("Other", "Z.cs")], "project string, path string")
    opts = {"required_project_folders": "HR.Infrastructure=Models/Entities,Models,Lost"}
    assert len(ids({"source_file": files}, opts, "ARCH010")) == 2


def test_references(spark):
    refs = spark.createDataFrame([("My.Portal", "P.cs", 3, "Order", "My.Domain"), ("My.Web", "W.cs", 3, "Order", "My.Domain")], "project string, path string, line int, to_symbol string, to_assembly string")
    opts = {"module_reference_barrier": "Portal>Domain"}
    assert ids({"reference": refs}, opts, "ARCH012") == [("ARCH012", "Order")]
    assert not ids({"reference": refs}, opts | {"module_reference_barrier_exceptions": "P.cs"}, "ARCH012")


def test_parameters(spark):
    schema = "project string, path string, line int, type_name string, type_kind string, method string, name string, nominal_names array<string>, is_error boolean"
    rows = [("P", "a.cs", 1, "OrderModule", kind, "Run", "x", ["List", "OrderDataModel"], bad) for kind, bad in [("class", False), ("interface", False), ("class", True)]]
    assert len(ids({"parameter": spark.createDataFrame(rows, schema)}, {"method_argument_type_barrier": "*Module>*DataModel"}, "ARCH016")) == 1


def test_known_types(types, spark):
    known = spark.createDataFrame([("MyApp.Infrastructure", "TextJoiner", "public"), ("Other.Lib", "Box", "public"), ("MyApp.X", "Hid", "internal"), ("MyApp.X", "Gen`1", "public")], "assembly string, metadata_name string, accessibility string")
    own = types(*[{"project": "MyApp.Portal", "name": n} for n in ("TextJoiner", "Box", "Hid", "Gen")])
    assert ids({"type_decl": own, "assembly_type": known}, None, "ARCH020") == [("ARCH020", "TextJoiner")]
    assert not ids({"type_decl": own, "assembly_type": known}, {"duplicate_type_name_exceptions": "TextJoiner"}, "ARCH020")


def test_names(types, members):
    facts = {"member": members({"name": "Do"}, {"name": "Go", "imposed_externally": True}, {"kind": "variable", "name": "a"}), "type_decl": types({"name": "Ab"})}
    assert not ids(facts, {}, "ARCH013", "ARCH014", "ARCH015")
    opts = {f"min_{k}_name_length": "3" for k in ("variable", "class", "method")}
    assert ids(facts, opts, "ARCH013", "ARCH014", "ARCH015") == [("ARCH013", "a"), ("ARCH014", "Ab"), ("ARCH015", "Do")]


def test_strings(spark):
    schema = "project string, path string, line int, op_id int, parent_op_id int, kind string, operator string, is_builtin boolean, is_constant boolean, result_type string, n_holes int"
    op = lambda i, up, kind, operator, const=False, builtin=True, holes=0: ("P", "a.cs", 1, i, up, kind, operator, builtin, const, "string", holes)
    rows = [op(1, None, "binary", "+"), op(2, 1, "binary", "+"), op(3, None, "binary", "+", True), op(4, None, "binary", "+", False, False),
            op(5, None, "compound_assignment", "+="), op(6, 5, "binary", "+"), op(7, None, "interpolation", None, holes=2), op(8, None, "interpolation", None)]
    facts = {"operation": spark.createDataFrame(rows, schema)}
    assert [r for r, _ in ids(facts, None, "ARCH017", "ARCH018")] == ["ARCH017", "ARCH017", "ARCH018"]


def test_duplicate_bodies(members):
    body = list(range(40))
    df = members({"name": "A", "path": "a.cs", "tokens": body}, {"name": "B", "path": "b.cs", "tokens": body}, {"name": "C", "path": "c.cs", "tokens": body[:38] + [90, 91]},
                 {"name": "D", "path": "d.cs", "tokens": list(range(100, 140))}, {"name": "E", "path": "e.cs"})
    assert ids({"member": df}, {"duplicate_code_similarity_percent": "100"}, "ARCH019") == [("ARCH019", "C.B")]
    assert ids({"member": df}, {"duplicate_code_similarity_percent": "60"}, "ARCH019") == [("ARCH019", "C.B"), ("ARCH019", "C.C")]
    assert not ids({"member": df}, {"duplicate_code_min_tokens": "500"}, "ARCH019")


def test_duplicate_bodies_with_copies(members):
    """Copies in the same project or in others neither hide a near body nor stand for one; whatever the ids hash to."""
    x, y = list(range(40)), list(range(38)) + [90, 91]
    opts = {"duplicate_code_similarity_percent": "60"}
    for i in range(4):
        copies = [{"project": f"B{j}", "name": "X", "path": f"x{j}.cs", "tokens": x} for j in range(6)]
        df = members(*copies, {"project": "A", "name": f"X{i}", "path": "a.cs", "tokens": x}, {"project": "A", "name": f"Y{i}", "path": "b.cs", "tokens": y})
        assert ids({"member": df}, opts, "ARCH019") == [("ARCH019", f"C.Y{i}")]
        places = [{"name": n, "path": f"{p}.cs", "tokens": t} for n, p, t in [(f"X{i}", "a", x), (f"Y{i}", "b", y)] + [(f"Z{i}{j}", f"c{j}", x) for j in range(6)]]
        found = rules.run({"member": members(*places)}, opts, ["ARCH019"]).collect()
        assert sorted((r.subject, r.args["original"]) for r in found) == [(f"C.Y{i}", f"C.X{i}")] + [(f"C.Z{i}{j}", f"C.X{i}") for j in range(6)]


def test_complexity(members, spark):
    facts = {"member": members({"name": "Compute", "arity": 1, "complexity": 3}),
             "head_member": spark.createDataFrame([("C", "Compute", 1, 1, "h", 9)], "type_name string, name string, arity int, complexity long, body_hash string, body_lines long")}
    assert ids(facts, None, "ARCH022") == [("ARCH022", "C.Compute")]
    assert not ids(facts, {"complexity_ratchet_allowed_increase": "2"}, "ARCH022")
    churn = lambda n: {"churn": spark.createDataFrame([("c.CS", n)], "path string, n long")}
    assert ids(facts | churn(12), None, "ARCH022") == [("ARCH023", "C.Compute")]
    assert ids(facts | churn(1), None, "ARCH022") == [("ARCH022", "C.Compute")]


def test_inferred_conventions(types, spark):
    rows = [{"name": f"{n}Provider", "path": f"Providers/{n}Provider.cs"} for n in ("Aa", "Bb", "Cc", "Dd")] + [{"name": "EeProvider", "path": "Services/EeProvider.cs"}]
    facts = {"type_decl": types(*rows), "changed": spark.createDataFrame([("services/EeProvider.cs",)], "path string")}
    opts = {"convention_min_support": "3", "convention_min_ratio": "75"}
    assert ids(facts, opts, "ARCH024") == [("ARCH024", "EeProvider")]
    assert not ids(facts, opts | {"convention_ignore": "Provider>folder"}, "ARCH024")
    assert not ids(facts | {"changed": spark.createDataFrame([("Providers/AaProvider.cs",)], "path string")}, opts, "ARCH024")
    assert not ids({"type_decl": facts["type_decl"]}, opts, "ARCH024")


def test_tested_changes(members, spark):
    test = "path string, test string, attributes array<struct<name:string,named_args:array<string>>>, has_assertion boolean, body_hash string, head_hash string, type_refs array<string>, invoked array<string>"
    facts = {"member": members({"name": "Add", "arity": 2}, {"name": "Hid", "accessibility": "private"}), "changed": spark.createDataFrame([("C.cs",), ("CTests.cs",)], "path string"),
             "head_member": spark.createDataFrame([], "type_name string, name string, arity int, complexity long, body_hash string, body_lines long")}

    def run(attributes=(("Fact", []),), asserts=True, head=None, calls=("Add",), **opts):
        tests = spark.createDataFrame([("CTests.cs", "T", list(attributes), asserts, "b", head, ["C"], list(calls))], test)
        return ids(facts | {"test_method": tests}, {"test_link_min_added_lines": "5", **opts}, "ARCH025")

    assert run() == []
    for kwargs in ({"calls": ["Other"]}, {"asserts": False}, {"head": "b"}, {"attributes": [("Fact", ["Skip"])]}, {"attributes": [("Fact", []), ("Ignore", [])]}, {"attributes": []}):
        assert run(**kwargs) == [("ARCH025", "C.Add")], kwargs
    assert run(calls=["Other"], test_link_min_added_lines="0") == [] == run(calls=["Other"], test_link_min_added_lines="10")


def test_reappearing(spark):
    block = ["var first = Compute();", "var second = Other(first);", "return second;"]
    removed = spark.createDataFrame([("abc1234567", "Drop it", 4, block), ("fff", "older", 9, block)], "sha string, subject string, ago int, lines array<string>")
    added = spark.createDataFrame([("C.cs", 21, ["  " + x for x in block] + ["more();"]), ("D.cs", 1, block[:2])], "path string, first_line int, lines array<string>")
    found = rules.run({"removed_text": removed, "added_text": added}, {}, ["ARCH027"]).collect()
    assert [(r.path, r.line, r.args["sha"], r.args["ago"], r.severity) for r in found] == [("C.cs", 21, "abc1234", "4", "warning")]


def test_messages_in_both_languages(spark):
    df = spark.createDataFrame([("ARCH011", "error", "P", "a.cs", 1, "Delete", {"previous": "Save"})], SCHEMA)
    assert with_message(df).first().message == "method Delete comes after Save"
    assert "vient après Save" in with_message(df, "fr").first().message
    assert all(sorted(set(a.count(x) for a in pair)) for pair in MESSAGES.values() for x in "{}")


def test_history(spark):
    rows = [("2024-01-01 00:00:00", "p", ["a"], 1, 0), ("2024-01-01 00:01:00", "p", ["A"], 1, 0), ("2024-01-01 00:02:00", "q,r", ["a"], 1, 0)]
    df = spark.createDataFrame(rows, "ts string, prompt string, paths array<string>, production int, tests int").withColumn("ts", F.to_timestamp("ts"))
    full = df.withColumns({"budget": F.lit(20), "usage": F.lit(5), "over": F.lit(False)})
    assert [r.line for r in size.history(full).orderBy("ts").collect()] == ["2024-01-01T00:00:00Z,p,1,1,0,20,5,false", '2024-01-01T00:02:00Z,"q,r",1,1,0,20,5,false']


def test_conventions_stay_in_their_project_and_generated_files_out(types, spark):
    a = [{"project": "A", "name": f"{n}Provider", "path": f"Providers/{n}Provider.cs"} for n in ("Aa", "Bb", "Cc", "Dd", "Ee")]
    b = [{"project": "B", "name": "XxProvider", "path": "Services/XxProvider.cs"}, {"project": "B", "name": "YyProvider", "path": "Other/YyProvider.cs"}]
    changed = spark.createDataFrame([("Services/XxProvider.cs",), ("Services/ZzProvider.cs",)], "path string")
    own = {"project": "A", "name": "ZzProvider", "path": "Services/ZzProvider.cs"}
    opts = {"convention_min_support": "3", "convention_min_ratio": "75"}
    facts = {"type_decl": types(*a, *b, own), "changed": changed}
    assert ids(facts, opts, "ARCH024") == [("ARCH024", "ZzProvider")]
    made = spark.createDataFrame([("A", "Services/ZzProvider.cs", True)], "project string, path string, is_generated boolean")
    assert ids(facts | {"source_file": made}, opts, "ARCH024") == []


def test_every_use_of_a_module_is_reported(spark):
    refs = spark.createDataFrame([("My.Portal", "P.cs", 3, "Order", "My.Domain")] * 2, "project string, path string, line int, to_symbol string, to_assembly string")
    assert len(ids({"reference": refs}, {"module_reference_barrier": "Portal>Domain"}, "ARCH012")) == 2
