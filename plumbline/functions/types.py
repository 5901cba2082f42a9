"""Names inside the text of a type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import any_of, is_named, parse_name_pattern

#: The language's keywords for types, and the names of the types they stand for.
KEYWORDS = {
    "bool": "Boolean", "byte": "Byte", "char": "Char", "decimal": "Decimal", "double": "Double", "float": "Single", "int": "Int32", "long": "Int64",
    "nint": "IntPtr", "nuint": "UIntPtr", "object": "Object", "sbyte": "SByte", "short": "Int16", "string": "String", "uint": "UInt32", "ulong": "UInt64",
    "ushort": "UInt16", "void": "Void",
}
TUPLE = "ValueTuple"
_TOKEN = r"([.:]*[@\w]+(?:[.:]+[@\w]+)*|[<>,()\[\]*])"


def may_name(text: Column, raw: str) -> Column:
    """Whether a type's text holds what a name of the pattern ``raw`` is read from; without that ``nominal_names`` has none.

    A name is a part of the text, what a keyword there stands for, or that of a tuple, which begins with a bracket.
    """
    spelled = [k for k, name in KEYWORDS.items() if is_named(name, raw)] + ["("] * is_named(TUPLE, raw)
    parts = [parsed[1]] if (parsed := parse_name_pattern(raw)) else []
    return any_of([F.contains(text, F.lit(x)) for x in parts + spelled])


def nominal_names(text: Column, type_parameters: Column | None = None) -> Column:
    """The names of a type and of the types in its arguments and elements, at any depth, in their order.

    A fold over the text's tokens with a stack of the places where the type at each depth begins.  Arrays and annotations (``[]``,
    ``?``) add no name; a qualified name counts with its last part, a type inside a generic one without that one's arguments
    (``A<B>.C`` is ``C``); a pointer has no names, nor have ``dynamic`` and type parameters; a tuple is a ``ValueTuple`` and what
    is in it, without the elements' own names.  A null text has null names, text that isn't a type those that can be read.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), 1)
    make = lambda names, begins, fresh: F.struct(names.alias("names"), begins.alias("begins"), fresh.alias("fresh"))
    yes, no = F.lit(True), F.lit(False)

    def step(s: Column, t: Column) -> Column:
        names, begins = s["names"], s["begins"]
        here = F.size(names)
        lower = F.slice(begins, F.lit(1), F.greatest(F.size(begins) - 1, F.lit(0)))
        begun = F.concat(lower, F.array(here))  # the type at this depth begins here
        before = F.slice(names, F.lit(1), F.coalesce(F.try_element_at(begins, F.lit(-1)), F.lit(0)))
        popped = F.when(F.size(begins) > 1, lower).otherwise(begins)
        return (
            F.when(t == "(", make(F.concat(names, F.array(F.lit(TUPLE))), F.concat(begun, F.array(here + 1)), yes))
            .when(t == "<", make(names, F.concat(begins, F.array(here)), yes))
            .when(t == "[", make(names, F.concat(begins, F.array(here)), no))
            .when(t.isin(">", ")", "]"), make(names, popped, no))
            .when(t == ",", make(names, begun, yes))
            .when(t == "*", make(before, begins, no))
            .when(F.startswith(t, F.lit(".")) | F.startswith(t, F.lit(":")), make(F.concat(before, F.array(t)), begins, no))
            .when(s["fresh"], make(F.concat(names, F.array(t)), begun, no))
            .otherwise(s)  # the name of a tuple's element
        )

    start = make(F.array().cast("array<string>"), F.array(F.lit(0)), yes)
    found = F.aggregate(tokens, start, step, lambda s: s["names"])
    known = F.create_map(*[F.lit(x) for pair in KEYWORDS.items() for x in pair])
    last = F.transform(found, lambda n: F.regexp_extract(n, r"@?(\w+)$", 1))
    spelled = F.transform(last, lambda n: F.coalesce(F.try_element_at(known, n), n))
    placeholder = F.array(F.lit("dynamic")) if type_parameters is None else F.concat(F.array(F.lit("dynamic")), F.coalesce(type_parameters, F.array().cast("array<string>")))
    return F.filter(spelled, lambda n: ~F.array_contains(placeholder, n))
