import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline import rules
from plumbline.functions import lexer as L
from plumbline.functions import text as X

BLANKS = " \t\f\x0b\r\n"


def walk(s):
    """Lexemes by hand, one character after the other: (text, is trivia)."""
    out, i = [], 0

    def literal(j, verbatim=False, holes=False):
        """The end of a string whose opening quote stands before j."""
        while j < len(s):
            if verbatim and s[j] == '"':
                if s[j + 1 : j + 2] != '"':
                    return j + 1
                j += 2
            elif not verbatim and s[j] == '"':
                return j + 1
            elif not verbatim and s[j] in "\r\n":
                return j
            elif not verbatim and s[j] == "\\":
                if s[j + 1 : j + 2] in ("", "\r", "\n"):
                    return j
                j += 2
            else:
                j += 1
        return j

    while i < len(s):
        start, two = i, s[i : i + 2]
        fresh = i == 0 or s[i] in "\r\n"
        j = i + (0 if s[i] not in "\r\n" else 2 if two == "\r\n" else 1)
        k = j
        while k < len(s) and s[k] in " \t":
            k += 1
        if fresh and s[k : k + 1] == "#" and s[k + 1 : k + 2] not in ("", "\r", "\n"):
            while k < len(s) and s[k] not in "\r\n":
                k += 1
            i, trivia = k, True
        elif s[i] in "\r\n":
            i, trivia = j, True
        elif s[i] in BLANKS:
            while i < len(s) and s[i] in " \t\f\x0b":
                i += 1
            trivia = True
        elif two == "//":
            while i < len(s) and s[i] not in "\r\n":
                i += 1
            trivia = True
        elif two == "/*":
            end = s.find("*/", i + 2)
            i, trivia = (len(s) if end < 0 else end + 2), True
        else:
            trivia = False
            if s[i : i + 3] == '"""':
                n = len(re.match('"+', s[i:])[0])
                end = s.find('"' * n, i + n)
                i = len(s) if end < 0 else end + n
                while s[i : i + 1] == '"':
                    i += 1
            elif two == '@"':
                i = literal(i + 2, True)
            elif s[i] == '"':
                i = literal(i + 1)
            elif m := re.match(r"'(?:[^'\\\r\n]|\\(?:u[0-9a-fA-F]{4}|[^uUx\r\n]))'", s[i:]):
                i += len(m[0])
            elif m := re.match(r"0[xX][0-9a-fA-F_]+[uUlL]*|(?:[0-9][0-9_]*(?:\.[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[fFdDmMuUlL]{0,2}", s[i:]):
                i += len(m[0])
            elif m := re.match(r"@?[^\W\d]\w*", s[i:]):
                i += len(m[0])
            else:
                ops = [o.replace("\\", "") for o in L.OPERATORS]
                i += max([len(o) for o in ops if s.startswith(o, i)], default=1)
        out.append((s[start:i], trivia))
    return out


def lexed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", L.lexemes(F.col("text")).alias("x"))
    df = df.withColumn("t", L.tokens(F.col("x")))
    out = df.select("*", L.body_hash(F.col("t")).alias("hash"), L.token_lines(F.col("t")).alias("n"), L.branches(F.col("t")).alias("b")).withColumn("c", X.cyclomatic(F.col("b")))
    return out.orderBy("id").collect()


def test_tokens_equal_a_walk_over_random_text(spark):
    r = random.Random(5)
    bits = ['"', '"""', '""""', '@"', "'", "\\", "/*", "*/", "//", "/", "*", "#", "#if", "\n", "\r\n", "\r", " ", "\t", "a", "when", "é1", "@if", "if", "0x1F", "1.5e3", "7", ".", "..", "??=", "=>", ">>", "€", "u0041", "'x'", "\x0b", "漢"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", "#", "# x", " #x\n#y", "a #b"]
    for text, row in zip(texts, lexed(spark, texts), strict=True):
        want = walk(text)
        assert list(row.x) == [w for w, _ in want], text
        line, toks = 1, []
        for w, trivia in want:
            if not trivia:
                toks.append((w, line))
            line += len(re.findall(r"\r\n?|\n", w))
        assert [(t.text, t.line) for t in row.t] == toks, text
        assert row.n == len({n for _, n in toks})
        assert row.hash == hashlib.sha256("\x02".join(t.kind + "\x01" + t.text.lstrip("@") for t in row.t).encode()).hexdigest()


def test_kinds_and_trivia(spark):
    code = 'if (@if > 0x1F) s = $"a {d["k"]} b" + @"c""d" + \'\\n\' + "e"; // f\n#region g\n/* h\n */ x >>= 1.5m;'
    (row,) = lexed(spark, [code])
    assert [(t.kind, t.line) for t in row.t] == [(k, 1) for k in ["if", "(", "name", ">", "number", ")", "name", "=", "interpolated", "+", "string", "+", "char", "+", "string", ";"]] + [(k, 4) for k in ["name", ">", ">=", "number", ";"]]
    moved = lexed(spark, [code, code.replace(" // f\n#region g\n/* h\n */", "\n\n"), code.replace("x >", "y >")])
    assert moved[0].hash == moved[1].hash != moved[2].hash and moved[0].n == moved[1].n == 2


def test_common_lexemes_are_tried_first_and_change_nothing(spark):
    """Names, blanks and brackets aren't held against the rules of strings and comments; what the rules alone find is found all the same."""
    r = random.Random(8)
    bits = ["a", "Z9", "_x", "x_1", "é", "aé", "\u00ad", "\u0301", "漢", "𝒜", "\x85", "\u2028", " ", "  ", "\t", "\x0b", "\n", "\r\n", "\r", "#", "#if", "(", ")", "{", "}", "[", "]", ",", ";", '"', '$"', '@"', "@", "@a", "'", "/*", "*/", "//", "1", ".5", "0x", "\\"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(3000)] + ["", None, " #x", " x", "\t\x0b# y", "  ", "a" * 100_000, "a" * 100_000 + "é", " " * 100_000 + "#"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(L.lexemes(F.col("text")).alias("x"), F.regexp_extract_all("text", F.lit("|".join(L.RULES)), F.lit(0)).alias("rules"))
    assert df.filter("NOT x <=> rules").count() == 0 and df.filter("x IS NULL").count() == 1
    tried = L.PATTERN.removesuffix("|" + "|".join(L.RULES))
    assert all(re.fullmatch(tried, x) for x in ["if", "_a1", "Total", "(", ")", "{", "}", "[", "]", ",", ";"]) and re.match(tried, "a b")[0] == "a" and re.match(tried, "aé", re.ASCII) is None is re.match(tried, " #")


def test_kinds_and_trivia_by_the_first_character(spark):
    """Every character begins what it did; the kinds of most tokens are told without cutting the first character off."""
    def trivia(x):
        return x[0] in BLANKS or x[:2] in ("//", "/*") or (x[0] == "#" and len(x) > 1)

    def told(x):
        if re.match(r"@?[^\W\d]", x):
            return x if x in L.KEYWORDS else "name"
        if re.match(r"\.?[0-9]", x):
            return "number"
        if re.match(r'(\$+@?|@\$)"', x):
            return "interpolated"
        return "string" if re.match('@?"', x) else "char" if x[0] == "'" and len(x) > 1 else x

    some = [chr(c) for c in [*range(1, 0x180), 0x6F22, 0x1D49C] if chr(c) not in "ªµº" and (c < 0x80 or chr(c).isalpha())]
    texts = [c + more for c in some for more in ("", "a", "5", '"', "/", "*", "=")] + [*L.KEYWORDS, "@if", "ifs", "@$\"", "$@\"", "$$\"\"\"", "'a'"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", L.kind(F.col("x")).alias("kind"), L.is_trivia(F.col("x")).alias("trivia"))
    for row in df.collect():
        assert row.trivia == trivia(row.x), row
        if not row.trivia:
            assert row.kind == told(row.x), row
    none = spark.createDataFrame([(None,)], "x string").select(L.is_trivia(F.col("x")), L.kind(F.col("x"))).first()
    assert tuple(none) == (None, None)
    assert df.select("kind")._jdf.queryExecution().optimizedPlan().toString().count("substring(") == 1


@pytest.mark.parametrize(
    "code,n",
    [
        ("", 1), ("return a;", 1), ("if (a) b(); else if (c) d();", 3), ("do { } while (a && b || c);", 4), ("while (a) ;", 2),
        ("for (;;) foreach (var x in y) ;", 3), ("switch (a) { case 1 when b > 2: goto case 3; case 3: break; default: break; }", 4),
        ("try { } catch (E e) when (e.A) { } catch { }", 4), ("return a ? b : c ? d : e;", 3), ("int? x = a?.b ?? c; d ??= e?[0];", 3),
        ("return a switch { 1 => x => 2, > 3 when b => f(y => z, w), { A: 1 } => c ? 1 : 2, _ => 0 };", 7),
        ('Say("if (a && b) ? c : d"); // while (x)\n/* case 1: */', 1), ("var when = 1; f(when, a: b); when = 2;", 1), ("Func<int?, string> f = x => g(x);", 1),
    ],
)
def test_complexity_from_text(spark, code, n):
    assert lexed(spark, [code])[0].c == n


def test_null_and_very_long(spark):
    long = '"' + "a\\n" * 200_000 + '" ' + '@"' + '""' * 200_000 + '" ' + "/*" + "*" * 200_000 + "*/ " + '$"' + '{a["b"]}' * 100_000 + '"' + " x" * 200_000
    none, row = lexed(spark, [None, long])
    assert none.x is None and none.t is None and none.c == 0
    assert len(row.t) == 3 + 200_000 and [t.kind for t in row.t[:4]] == ["string", "string", "interpolated", "name"]


def test_rules_read_bodies(spark):
    """Members with source text: one more complex than before, and two that differ in names and blanks only."""
    long = "{ " + "if (a) { b(c, 1); } " * 5 + "}"
    cols = "project string, path string, line int, type_name string, kind string, name string, arity int, body string"
    members = [("P", f"{n}.cs", 1, n, "method", "Go", 0, b) for n, b in [("A", long), ("B", long.replace("a", "other").replace("{ ", "{ /* x */\n")), ("C", None), ("D", "{ return a && b; }")]]
    head = [("A", "Go", 0, long), ("C", "Go", 0, "{ }"), ("D", "Go", 0, "{ return a; /* && */ }")]
    facts = {"member": spark.createDataFrame(members, cols), "head_member": spark.createDataFrame(head, "type_name string, name string, arity int, body string")}
    found = rules.run(facts, {}, ["ARCH019", "ARCH022"]).select("rule_id", "subject").collect()
    assert sorted(map(tuple, found)) == [("ARCH019", "B.Go"), ("ARCH022", "D.Go")]


def test_equal_bodies_are_read_once(spark, monkeypatch):
    """Members have what their own text tells, on either way of joining; texts are read once, members without one never."""
    from plumbline.rules import code

    rows = [(f"M{i}", [None, "", "{ if (a) b(); }", "{ while (a)\n b(); return c ? d : e; }"][i % 4]) for i in range(80)]
    df = spark.createDataFrame(rows, "name string, body string").repartition(4)
    for sent in (code.READINGS_SENT, 0):
        read = []
        monkeypatch.setattr(code, "written", lambda t: read.append(t) or t)
        monkeypatch.setattr(code, "READINGS_SENT", sent)
        found = {r["name"]: (r["complexity"], r["body_lines"], r["tokens"] and len(r["tokens"])) for r in code.from_source(df).collect()}
        want = [(0, None, None), (1, 0, []), (2, 1, 10), (3, 2, 17)]
        assert found == {n: (want[i % 4][0], want[i % 4][1], want[i % 4][2]) for i, (n, _) in enumerate(rows)}
        assert [t.count() for t in read] == [3]
