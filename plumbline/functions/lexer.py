"""Source text as tokens: kinds, texts, lines, a body's hash and its branches, as expressions on the row that holds the text.

One pattern cuts a text into lexemes that cover it whole; blanks, comments and directives are trivia, all others are tokens.
Every step takes time linear in the text: line numbers come from splitting the lexemes' marks at line ends, not from a fold.

Defined cases: a null text has null tokens, an empty one none; a line ends with \\r\\n, \\r or \\n; a string that isn't closed ends
with its line, a verbatim or raw one and a comment with the text; what no rule knows is a token of one character.  An interpolated
string is one token, with strings one level deep in its holes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language's reserved words.
KEYWORDS = (
    "abstract", "as", "base", "bool", "break", "byte", "case", "catch", "char", "checked", "class", "const", "continue", "decimal",
    "default", "delegate", "do", "double", "else", "enum", "event", "explicit", "extern", "false", "finally", "fixed", "float", "for",
    "foreach", "goto", "if", "implicit", "in", "int", "interface", "internal", "is", "lock", "long", "namespace", "new", "null",
    "object", "operator", "out", "override", "params", "private", "protected", "public", "readonly", "ref", "return", "sbyte",
    "sealed", "short", "sizeof", "stackalloc", "static", "string", "struct", "switch", "this", "throw", "true", "try", "typeof",
    "uint", "ulong", "unchecked", "unsafe", "ushort", "using", "virtual", "void", "volatile", "while",
)
#: Operators of more than one character; ``>>`` is two tokens, as it also closes two argument lists.
OPERATORS = (r"<<=", r"\?\?=", "=>", "==", "!=", "<=", ">=", "&&", r"\|\|", r"\+\+", "--", r"\+=", "-=", r"\*=", "/=", "%=", "&=", r"\|=", r"\^=", "<<", "->", "::", r"\.\.", r"\?\?")

_END = r"(?:\r\n?|\n)"
_ESCAPE = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{1,4}|[^uUx\r\n])"
#: Lexemes in order of precedence.  Loops over groups are possessive, so that a long string needs no deep stack.
RULES = (
    rf"(?:\A|{_END})[ \t]*#[^\r\n]+",
    _END,
    r"[ \t\f\x0B]+",
    r"//[^\r\n]*",
    r"/\*[\s\S]*?(?:\*/|\z)",
    r'\$*(?<q>"{3,}+)[\s\S]*?(?:\k<q>"*|\z)',
    r'(?:\$@|@\$|@)"[^"]*+(?:""[^"]*+)*+(?:"|\z)',
    r'\$"(?:[^"\\{\r\n]|\\[^\r\n]|\{\{|\{[^{}"\r\n]*+(?:"[^"\r\n]*"[^{}"\r\n]*+)*+\}|\{)*+"?',
    r'"[^"\\\r\n]*+(?:\\[^\r\n][^"\\\r\n]*+)*+"?',
    rf"'(?:[^'\\\r\n]|{_ESCAPE})'",
    r"0[xX][0-9A-Fa-f_]+[uUlL]*|0[bB][01_]+[uUlL]*",
    r"(?:[0-9][0-9_]*(?:\.[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[fFdDmMuUlL]{0,2}",
    r"@?[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\p{Cf}]*",
    "|".join(OPERATORS),
    r"[\s\S]",
)
#: The commonest lexemes, tried before the rules: no rule that precedes theirs has a lexeme that begins as they do.  A name with a
#: letter beyond ASCII and blanks at the beginning, where a directive may follow, are left to the rules.
COMMON = (r"[A-Za-z_]\w*+(?![^\x00-\x7F])", r"(?!\A)[ \t\f\x0B]+", r"[(){}\[\],;]")
PATTERN = "|".join((*COMMON, *RULES))


def lexemes(text: Column) -> Column:
    """All lexemes of a text; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def is_trivia(x: Column) -> Column:
    directive = F.startswith(x, F.lit("#")) & (F.length(x) > 1)
    blank = F.substring(x, 1, 1).isin(" ", "\t", "\f", "\x0b", "\r", "\n")
    return (x < "A") & (blank | F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("/*")) | directive)  # most are names: no more is asked of them


def kind(x: Column) -> Column:
    """A token's kind: a keyword or an operator is its own kind, names and literals are of one kind each."""
    within = lambda a, z: (x >= a) & (x < chr(ord(z) + 1))  # noqa: E731  by its first character, which needs no cutting
    # Most tokens are told by their first character; patterns are tried on the others.
    rest = (
        F.when(F.rlike(x, F.lit(r"^@?[\p{L}\p{Nl}_]")), F.lit("name"))
        .when(F.rlike(x, F.lit(r"^\.[0-9]")), F.lit("number"))
        .when(F.rlike(x, F.lit(r'^(\$+@?|@\$)"')), F.lit("interpolated"))
        .when(F.rlike(x, F.lit(r'^@?"')), F.lit("string"))
        .when(F.startswith(x, F.lit("'")) & (F.length(x) > 1), F.lit("char"))
        .otherwise(x)
    )
    return (
        F.when(within("a", "z"), F.when(x.isin(*KEYWORDS), x).otherwise(F.lit("name")))
        .when(within("A", "Z"), F.lit("name"))
        .when(within("0", "9"), F.lit("number"))
        .when(F.substring(x, 1, 1).isin(*"(){}[];,=+-*/%<>!&|?:"), x)
        .otherwise(rest)
    )


def tokens(found: Column) -> Column:
    """kind, text and line (from 1) of the tokens among lexemes, in order."""
    # A token leaves a mark on the line where it starts; what is left of the text besides are line ends.
    ends = lambda x: F.when(F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r")), F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[^\n]+", "")).otherwise(F.lit(""))
    # What begins with a letter or comes after it is a token without line ends.
    mark = lambda x: F.when(x >= "A", F.lit("*")).otherwise(F.concat(F.when(is_trivia(x), F.lit("")).otherwise(F.lit("*")), ends(x)))
    marks = F.array_join(F.transform(found, mark), "")
    lines = F.flatten(F.transform(F.split(marks, "\n", -1), lambda m, i: F.array_repeat((i + 1).cast("int"), F.length(m))))
    return F.zip_with(
        F.filter(found, lambda x: ~is_trivia(x)), lines, lambda x, line: F.struct(kind(x).alias("kind"), x.alias("text"), line.alias("line"))
    )


def body_hash(found: Column) -> Column:
    """A hash of the kinds and texts of tokens, the same whatever trivia stand between them."""
    bare = lambda x: F.when(F.startswith(x, F.lit("@")), F.ltrim(x, F.lit("@"))).otherwise(x)
    return F.sha2(F.array_join(F.transform(found, lambda t: F.concat(t["kind"], F.lit("\x01"), bare(t["text"]))), "\x02"), 256)


def token_lines(found: Column) -> Column:
    """The number of lines on which a token starts."""
    return F.size(F.array_distinct(found["line"])).cast("long")


#: Tokens that are a branch wherever they stand, with the node's kind; the ``while`` of a ``do`` stands for it.
_BRANCH = {"if": "if", "while": "while", "for": "for", "foreach": "foreach", "catch": "catch", "&&": "and", "||": "or", "??": "coalesce", "??=": "coalesce_assignment"}
_STATE = "struct<open:string,conditionals:int,arms:int>"


def branches(found: Column) -> Column:
    """The kinds of the branching nodes that tokens show, for ``text.cyclomatic``; in no order.

    ``goto case`` is no label, ``when`` counts after a pattern or a clause and before a condition.  A ``?`` is a conditional if a
    ``:`` closes it between the same brackets, an arrow an arm of a switch if it is the first after ``switch {`` or a comma there.
    """
    def flat(t: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in _BRANCH.items() for x in pair])
        goes_on = t["before"].isin("name", "number", "string", "char", "null", "true", "false", ")", "]", "}", ">")
        ends = t["after"].isin("=", ";", ",", ")", "]", "}", ".", ":", "=>", "?", "in", "")
        return (
            F.when((t["kind"] == "case") & (t["before"] != "goto"), F.lit("case"))
            .when((t["text"] == "when") & goes_on & ~ends, F.lit("when"))
            .otherwise(F.try_element_at(known, t["kind"]))
        )

    def sign(t: Column) -> Column:
        """What the fold sees: brackets, arrows and marks; a ``?`` only if an expression can follow it."""
        of_type = t["after"].isin(".", "[", ",", ")", "]", ";", ">", "=", "?", "??", "}", "=>", ":", "")
        return (
            F.when((t["kind"] == "{") & (t["before"] == "switch"), F.lit("S"))
            .when((t["kind"] == "?") & of_type, F.lit(None))
            .when(t["kind"].isin("(", "[", "{", ")", "]", "}", "?", ":", ";", ",", "=>"), t["kind"])
        )

    # Neighbours come beside each token once; looking them up by index would build the list anew for every token.
    kinds = found["kind"]
    beside = F.zip_with(
        F.concat(F.array(F.lit("")), kinds), F.slice(kinds, 2, F.size(found)), lambda b, a: F.struct(b.alias("before"), F.coalesce(a, F.lit("")).alias("after"))
    )
    each = F.zip_with(found, beside, lambda t, n: F.struct(t["kind"].alias("kind"), t["text"].alias("text"), n["before"].alias("before"), n["after"].alias("after")))
    plain = F.filter(F.transform(each, flat), lambda k: k.isNotNull())
    signs = F.filter(F.transform(each, sign), lambda s: s.isNotNull())

    def step(s: Column, x: Column) -> Column:
        make = lambda o, c=0, a=0: F.struct(o.alias("open"), (s["conditionals"] + c).alias("conditionals"), (s["arms"] + a).alias("arms"))
        o = s["open"]
        bare = F.rtrim(o, F.lit("?"))
        inner = F.substr(bare, F.lit(1), F.greatest(F.length(bare) - 1, F.lit(0)))
        return (
            F.when(x.isin("(", "[", "{", "S", "?"), make(F.concat(o, x)))
            .when(x.isin(")", "]", "}"), make(inner))
            .when((x == ":") & F.endswith(o, F.lit("?")), make(F.substr(o, F.lit(1), F.length(o) - 1), 1))
            .when((x == "=>") & F.endswith(bare, F.lit("S")), make(F.concat(inner, F.lit("s")), 0, 1))
            .when((x == ",") & F.endswith(bare, F.lit("s")), make(F.concat(inner, F.lit("S"))))
            .when(x == ";", make(bare))
            .otherwise(s)
        )

    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("conditionals"), F.lit(0).alias("arms")).cast(_STATE)
    counts = lambda s: F.concat(F.array_repeat(F.lit("conditional"), s["conditionals"]), F.array_repeat(F.lit("switch_arm"), s["arms"]))
    return F.concat(plain, F.aggregate(signs, start, lambda s, x: step(s, x).cast(_STATE), counts))
