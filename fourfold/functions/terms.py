"""Terms, their canonical keys, and the parts of a key as column expressions.

A key is `<iri>`, `_:label`, `"text"`, `"text"^^<datatype>`, `"text"@language`, `"text"@language--direction`,
`<<subject predicate object>>`, or the empty string for the default graph. Keys are injective, so equal terms are equal
strings, and identity is lexical: no two spellings of a number are one term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class Term:
    """A term of the data, or a variable of a pattern."""

    def key(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Iri(Term):
    value: str

    def key(self) -> str:
        if any(c in '<>"' or c.isspace() for c in self.value):
            raise ValueError(f"not an IRI: {self.value!r}")
        return f"<{self.value}>"


@dataclass(frozen=True)
class Blank(Term):
    label: str

    def key(self) -> str:
        if not self.label or any(c in '<>"' or c.isspace() for c in self.label):
            raise ValueError(f"not a blank node's label: {self.label!r}")
        return f"_:{self.label}"


@dataclass(frozen=True)
class Literal(Term):
    value: str
    datatype: str | None = None
    language: str | None = None
    direction: str | None = None

    def key(self) -> str:
        quoted = f'"{escape(self.value)}"'
        if self.language:
            return f"{quoted}@{self.language}" + (f"--{self.direction}" if self.direction else "")
        return quoted + (f"^^{Iri(self.datatype).key()}" if self.datatype else "")


@dataclass(frozen=True)
class DefaultGraph(Term):
    def key(self) -> str:
        return ""


@dataclass(frozen=True)
class Var(Term):
    """A variable: a wildcard in matches, a name in bindings. Never data."""

    name: str

    def key(self) -> str:
        raise ValueError("a variable is no term of the data")


@dataclass(frozen=True)
class Quoted(Term):
    """A triple as a term. Patterns may hold variables, and None for anything."""

    subject: Term | None
    predicate: Term | None
    object: Term | None
    graph: Term | None = DefaultGraph()

    @property
    def parts(self) -> tuple[Term | None, Term | None, Term | None]:
        return self.subject, self.predicate, self.object

    def has_variables(self) -> bool:
        return any(open_term(t) for t in (*self.parts, self.graph))

    def key(self) -> str:
        if self.graph != DefaultGraph():
            raise ValueError("a quoted triple stands in the default graph")
        return f"<<{' '.join(t.key() for t in self.parts)}>>"


def open_term(term: Term | None) -> bool:
    """Does the term stand for more than itself?"""
    return term is None or isinstance(term, Var) or isinstance(term, Quoted) and term.has_variables()


#: What stands for the characters that a literal escapes.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}
UNESCAPES = {"\\": "\\", '"': '"', "n": "\n", "r": "\r"}


def escape(text: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    out, rest = [], iter(text)
    for c in rest:
        out.append(UNESCAPES[next(rest)] if c == "\\" else c)
    return "".join(out)


def parse(key: str) -> Term:
    """The term of a key."""
    term, end = read(key, 0)
    if end != len(key):
        raise ValueError(f"not a term's key: {key!r}")
    return term


def read(key: str, at: int) -> tuple[Term, int]:
    """The term that starts at `at`, and where it ends."""
    if at == len(key):
        return DefaultGraph(), at
    if key.startswith("<<", at):
        parts, at = [], at + 2
        for k in range(3):
            term, at = read(key, at)
            parts.append(term)
            if not key.startswith(" " if k < 2 else ">>", at):
                raise ValueError(f"not a quoted triple's key: {key!r}")
            at += 1 if k < 2 else 2
        return Quoted(*parts), at
    if key[at] == "<":
        end = key.index(">", at)
        return Iri(key[at + 1 : end]), end + 1
    if key[at] == '"':
        return read_literal(key, at)
    if key.startswith("_:", at):
        end = next((k for k in range(at, len(key)) if key[k] in " >"), len(key))
        return Blank(key[at + 2 : end]), end
    raise ValueError(f"not a term's key: {key!r}")


def read_literal(key: str, at: int) -> tuple[Literal, int]:
    end = at + 1
    while key[end] != '"':
        end += 2 if key[end] == "\\" else 1
    value, end = unescape(key[at + 1 : end]), end + 1
    if key.startswith("^^<", end):
        stop = key.index(">", end)
        return Literal(value, datatype=key[end + 3 : stop]), stop + 1
    if key.startswith("@", end):
        stop = next((k for k in range(end, len(key)) if key[k] in " >"), len(key))
        language, _, direction = key[end + 1 : stop].partition("--")
        return Literal(value, language=language, direction=direction or None), stop
    return Literal(value), end


def kind(key: Column) -> Column:
    """`quoted`, `iri`, `blank`, `literal` or `default`."""
    starts = lambda text: F.startswith(key, F.lit(text))
    return F.when(key == "", "default").when(starts("<<"), "quoted").when(starts("<"), "iri").when(starts("_:"), "blank").otherwise("literal")


def datatype(key: Column) -> Column:
    """A literal's datatype; null for other terms and for literals without one."""
    return found(key, r'(?s)^".*"\^\^<([^<>]*)>$')


def language(key: Column) -> Column:
    return found(key, r'(?s)^".*"@([^"@]*?)(?:--[^"@-]*)?$')


def direction(key: Column) -> Column:
    return found(key, r'(?s)^".*"@[^"@]*?--([^"@-]*)$')


def value(key: Column) -> Column:
    """An IRI, a blank node's label, or a literal's text; null for quoted triples, empty for the default graph."""
    text = F.regexp_extract(key, r'(?s)^"(.*)"(?:\^\^<[^<>]*>|@[^"@]*)?$', 1)
    plain = lambda t: F.replace(F.replace(F.replace(t, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    text = F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")  # between escaped backslashes no other escape can begin with one
    is_a = kind(key)
    return (
        F.when(is_a == "iri", key.substr(F.lit(2), F.length(key) - 2))
        .when(is_a == "blank", key.substr(F.lit(3), F.length(key)))
        .when(is_a == "literal", text)
        .when(is_a == "default", F.lit(""))
    )


def found(key: Column, pattern: str) -> Column:
    """The pattern's first group in a literal's key, null if it doesn't match."""
    return F.when(key.rlike(pattern), F.regexp_extract(key, pattern, 1))


def iri_key(value: Column) -> Column:
    return F.concat(F.lit("<"), value.cast("string"), F.lit(">"))


def literal_key(value: Column) -> Column:
    """The key of a plain literal, escaped."""
    text = value.cast("string")
    for plain, shown in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(shown))
    return F.concat(F.lit('"'), text, F.lit('"'))


#: The tokens of a quoted triple's key, but for what opens one.
TOKENS = r'(?s)>>|<[^<>]*>|_:[^ >]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^<>]*>|@[^ >]+)?'


def levels(key: Column) -> Column:
    """The quoted triples (k, s, p, o) in a quoted triple's key, inner ones first, itself last.

    The key's tokens are read once with a stack: what closes a triple takes three terms off it and puts theirs on.
    """
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<k:string,s:string,p:string,o:string>>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        stack = state["stack"]
        parts = [F.element_at(stack, k) for k in (-3, -2, -1)]
        whole = quoted_key(*parts)
        row = F.struct(whole.alias("k"), *(x.alias(n) for x, n in zip(parts, ("s", "p", "o"))))
        closed = F.struct(F.concat(F.slice(stack, 1, F.size(stack) - 3), F.array(whole)).alias("stack"), F.concat(state["found"], F.array(row)).alias("found"))
        return F.when(token == ">>", closed).otherwise(F.struct(F.concat(stack, F.array(token)).alias("stack"), state["found"].alias("found")))

    return F.aggregate(F.regexp_extract_all(key, F.lit(TOKENS), F.lit(0)), start, step, lambda state: state["found"])


def quoted_key(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<<"), s, F.lit(" "), p, F.lit(" "), o, F.lit(">>"))
