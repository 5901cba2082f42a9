from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import patterns as P
from plumbline.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] or [(1,)], list(values) or ["x"])
    return row.select(column.alias("r")).first().r


def test_name_patterns(spark):
    cases = [("*Model", "OrderModel", True), ("*Model", "ModelX", False), ("Get*", "GetAll", True), ("*ab*", "xaby", True),
             ("ab", "ab", True), ("ab", "abc", False), ("**", "x", False), ("a*b", "a*b", True), ("a*b", "axb", False)]
    for raw, name, want in cases:
        assert one(spark, P.name_pattern(F.col("n"), raw), n=name) is want, raw


def test_null_and_empty_names_never_match(spark):
    rows = spark.createDataFrame([(None,), ("",)], "n string")
    assert [r.r for r in rows.select(P.name_pattern(F.col("n"), "*a*").alias("r")).collect()] == [False, False]


def test_globs(spark):
    cases = [("*Dto.cs", "a/OrderDto.cs", True), ("Models/*Dto.cs", "Models/OrderDto.cs", True), ("Models/*Dto.cs", "X/OrderDto.cs", False),
             ("Models/**/*.cs", "Models/a/b/C.cs", True), ("Models/**/*.cs", "Models/C.cs", True), ("**/C.cs", "a/b/C.cs", True),
             ("a/**", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a.b", "axb", False)]
    for glob, path, want in cases:
        got = one(spark, P.glob_match(F.col("p"), X.file_name(F.col("p")), glob), p=path)
        assert got is want, (glob, path)
    assert one(spark, P.glob_match(F.col("p"), X.file_name(F.col("p")), "Models/*.cs", anchored=False), p="root/Models/C.cs")


def test_folder_suffix(spark):
    parts = X.dir_parts(F.col("p"))
    for folder, path, want in [("Models>Business", "src/models/BUSINESS/C.cs", True), ("Models\\Business", "Business/C.cs", False),
                               ("Business", "Business/Sub/C.cs", False), ("a/b/c", "b/c/C.cs", False)]:
        assert one(spark, P.folder_suffix(parts, folder), p=path) is want


def test_modules_and_scopes(spark):
    assert one(spark, P.module_match(F.col("n"), "portal"), n="My.Portal")
    assert one(spark, P.module_match(F.col("n"), "Portal"), n="PORTAL.Web")
    assert not one(spark, P.module_match(F.col("n"), "Portal"), n="MyPortal")
    assert one(spark, P.scope_match(F.col("n"), "My"), n="my.app") and not one(spark, P.scope_match(F.col("n"), "My"), n="Not.My")


def test_lines(spark):
    for line, want in [("", True), ("}", True), ("});", True), ("return x;", False)]:
        assert one(spark, X.is_trivial(X.normalize_line(F.col("l"))), l=line) is want
    assert one(spark, X.normalize_line(F.col("l")), l="\t a \t b\x0b\x0cc ") == "a b c"
    assert one(spark, X.non_blank_lines(F.col("l")), l="a\n \n\nb\n") == 2


def test_camel(spark):
    for name, words in [("HTTPClient", ["HTTP", "Client"]), ("AModel", ["A", "Model"]), ("iPhoneModel", ["Phone", "Model"]), ("GetXY", ["Get", "XY"])]:
        assert one(spark, X.camel_words(F.col("n")), n=name) == words
    assert one(spark, X.camel_suffixes(F.col("n")), n="CustomerOrderProvider") == ["OrderProvider", "Provider"]
    assert one(spark, X.camel_suffixes(F.col("n")), n="Single") == []


def test_budget_and_rounding(spark):
    for base, percent, want in [(1000, 2, 20), (1001, 2, 21), (1, 2, 1), (0, 2, 0), (1000, 0, 0)]:
        assert one(spark, X.percent_budget(F.col("b"), percent), b=base) == want
    assert one(spark, X.usage_percent(F.col("a"), F.col("b")), a=5, b=200) == 2  # 2.5 goes to even
    assert one(spark, X.usage_percent(F.col("a"), F.col("b")), a=5, b=0) is None


def test_csv_and_keys(spark):
    assert one(spark, X.csv_line(F.col("a"), F.col("b")), a='x,"y"', b=1) == '"x,""y""",1'
    key = X.change_key(F.lit("p"), F.col("f"), F.lit(1))
    assert one(spark, key, f=["b", "A"]) == one(spark, key, f=["a", "B"]) != one(spark, key, f=["a"])


def test_cyclomatic(spark):
    assert one(spark, X.cyclomatic(F.col("k")), k=["if", "else", "and", "block", "case_pattern"]) == 4


@given(st.lists(st.sampled_from(["a", "b", "**", "*"]), min_size=1, max_size=5))
def test_glob_regex_always_compiles(parts):
    import re

    re.compile(P.glob_regex("/".join(parts), True))
