"""The colon language: `class:subclasses:com.example.Base` and the like become DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strataloom.graph import CodeGraph
from strataloom.operators import lookup as L
from strataloom.operators import text as X

#: Words that stand alone, with other spellings of them.
ALONE = {"build": "build", "help": "help", "?": "help", "version": "version", "-v": "version", "--version": "version", "exit": "exit", "quit": "exit", "clear": "clear"}


@dataclass(frozen=True)
class QueryCommand:
    type: str
    args: tuple[str, ...] = ()


class UnknownQuery(ValueError):
    pass


def parse(text: str | None) -> QueryCommand | None:
    """Parts between colons, trimmed, empty ones kept; None for blank texts."""
    if text is None or not text.strip():
        return None
    if (word := ALONE.get(text.strip().lower())) is not None:
        return QueryCommand(word)
    head, *rest = (part.strip() for part in text.strip().split(":"))
    return QueryCommand(head, tuple(rest))


def _nodes_text(g: CodeGraph, words: str) -> DataFrame:
    return X.nodes_for(g.nodes, X.search_query(X.index_nodes(g.nodes), words))


#: (type, action) -> function of the graph and the remaining text.
ACTIONS: dict[tuple[str, str], Callable[[CodeGraph, str], DataFrame]] = {
    ("class", "all"): lambda g, _: g.classes,
    ("class", "name"): L.classes_by_simple_name,
    ("class", "subclasses"): L.subclasses,
    ("class", "implementations"): L.implementations,
    ("class", "superclass"): L.superclass,
    ("class", "interfaces"): L.interfaces_of,
    ("method", "all"): lambda g, _: g.methods,
    ("method", "name"): L.methods_by_name,
    ("method", "class"): L.methods_of,
    ("method", "signature"): L.method_by_signature,
    ("field", "all"): lambda g, _: g.fields,
    ("field", "class"): L.fields_of,
    ("field", "name"): L.field_by_name,
    ("package", "all"): lambda g, _: g.of_type("PACKAGE"),
    ("package", "classes"): L.classes_in_package,
    ("search", "type"): lambda g, kind: g.of_type(kind.upper()),
    ("search", "nodes"): lambda g, kind: g.of_type(kind.upper()),
    ("search", "edges"): lambda g, kind: L.edges_of(g, kind=kind.upper()),
    ("search", "modifier"): lambda g, m: L.with_modifier(g.nodes, m),
    ("search", "text"): _nodes_text,
}
#: What a type's only argument means where it is no action.
DIRECT: dict[str, Callable[[CodeGraph, str], DataFrame]] = {"class": L.class_by_name, "method": L.method_by_signature, "field": L.field_by_name, "package": L.package_by_name, "file": L.in_file}


def run(g: CodeGraph, text: str | None) -> DataFrame:
    """The lazy answer to a query. Values may hold colons; what no rule knows is an UnknownQuery."""
    q = parse(text)
    if q is None:
        raise UnknownQuery("the query is blank")
    if q.type == "stats":
        return L.totals(g)
    kind, first = q.type.lower(), q.args[0] if q.args else ""
    action = ACTIONS.get((kind, first.lower()))
    if action is not None:
        return action(g, ":".join(q.args[1:]))
    if kind in DIRECT and first:
        return DIRECT[kind](g, ":".join(q.args))
    raise UnknownQuery(f"no such query: {text}")


def render(df: DataFrame, most: int = 50) -> str:
    """At most `most` rows as lines; the number of others is said."""
    rows = df.limit(most + 1).collect()
    shown = [" | ".join("" if v is None else str(v) for v in r) for r in rows[:most]]
    return "\n".join(shown + ([f"... and {df.count() - most} more"] if len(rows) > most else [])) or "no results"
