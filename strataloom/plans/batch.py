"""One-line queries of scripts: fixed phrases and call syntax, name(key=value, ...), become DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.graph import CodeGraph
from strataloom.operators import lookup as L
from strataloom.operators import text as X

_N, _W = r"([a-zA-Z0-9._]+)", r"([a-zA-Z0-9_]+)"
# --- fixed values: phrases in their order, the first that fits counts; each names a handler and its arguments ---
PHRASES: list[tuple[str, str, tuple[str, ...]]] = [
    (rf"find\s+class\s+{_N}", "findClassByQualifiedName", ("qn",)),
    (rf"(?:find\s+)?classes?\s+named\s+{_W}", "findClassesByName", ("name",)),
    (r"(?:list\s+)?all\s+classes?", "getAllClasses", ()),
    (rf"subclasses?\s+of\s+{_N}", "getSubclasses", ("className",)),
    (rf"what\s+(?:extends|subclasses)\s+{_N}", "getSubclasses", ("className",)),
    (rf"implementations?\s+of\s+{_N}", "getImplementations", ("interfaceName",)),
    (rf"what\s+implements\s+{_N}", "getImplementations", ("interfaceName",)),
    (rf"methods?\s+in\s+{_N}", "getMethods", ("className",)),
    (rf"what\s+methods?\s+(?:does|has)\s+{_N}", "getMethods", ("className",)),
    (r"find\s+method\s+([a-zA-Z0-9._]+\s*\([^)]*\))", "findMethodBySignature", ("signature",)),
    (rf"methods?\s+named\s+{_W}", "findMethodsByName", ("name",)),
    (rf"(?:who|what)\s+calls\s+{_N}", "getCallers", ("methodName",)),
    (rf"callers?\s+of\s+{_N}", "getCallers", ("methodName",)),
    (rf"what\s+does\s+{_N}\s+call", "getCallees", ("methodName",)),
    (rf"what\s+call\s+{_N}", "getCallees", ("methodName",)),
    (rf"callees?\s+of\s+{_N}", "getCallees", ("methodName",)),
    (rf"fields?\s+in\s+{_N}", "getFields", ("className",)),
    (rf"what\s+fields?\s+(?:does|has)\s+{_N}", "getFields", ("className",)),
    (rf"variables?\s+in\s+{_N}", "getVariables", ("methodName",)),
    (rf"superclass\s+of\s+{_N}", "getSuperclass", ("className",)),
    (rf"what\s+does\s+{_N}\s+extend", "getSuperclass", ("className",)),
    (rf"overridden\s+method\s+of\s+{_N}", "getOverriddenMethod", ("methodName",)),
    (rf"statements?\s+in\s+{_N}", "getStatements", ("methodName",)),
    (r"statement\s+at\s+line\s+(\d+)", "getStatementAt", ("line",)),
    (r"nodes?\s+in\s+file\s+(\S+)", "getNodesInFile", ("file",)),
]
LIMIT = 100


@dataclass(frozen=True)
class Call:
    handler: str
    params: dict[str, str] = field(default_factory=dict)


def parse(query: str) -> Call:
    """A call by its syntax, else by the first phrase that fits from the start; else `interpret`, a search by name."""
    q = query.strip()
    if m := re.fullmatch(r"([a-zA-Z0-9_]+)\(\s*([^)]*)\s*\)", q):
        pairs = (p.split("=", 1) for p in m[2].split(",") if "=" in p)
        return Call(m[1], {k.strip(): v.strip().strip("\"'") for k, v in pairs})
    for pattern, handler, names in PHRASES:
        if m := re.match(pattern, q, re.I):
            return Call(handler, dict(zip(names, m.groups())))
    return Call("interpret", {"query": q})


def _class(g: CodeGraph, name: str) -> str:
    """The qualified name a class is meant by; the name itself where none or several fit."""
    row = L.resolve_one(g, name).select("qualified_name").limit(2).collect()
    return row[0][0] if len(row) == 1 else name


def _methods(g: CodeGraph, name: str) -> DataFrame:
    owner, _, last = name.rpartition(".")
    got = g.methods.where(F.col("name") == last)
    return got.where((F.col("owner") == owner) | F.col("owner").endswith("." + owner)) if owner else got


def _around(g: CodeGraph, name: str, into: bool) -> DataFrame:
    here, there = ("dst", "src") if into else ("src", "dst")
    ids = _methods(g, name).select(F.col("id").alias(here))
    return g.methods.join(g.calls.join(ids, here, "left_semi").select(F.col(there).alias("id")).distinct(), "id", "left_semi")


def _overridden(g: CodeGraph, name: str) -> DataFrame:
    """For methods of that name their nearest overridden ones, by edges."""
    up = g.edges.where("type = 'OVERRIDES'").join(_methods(g, name).select(F.col("id").alias("src")), "src", "left_semi")
    return g.methods.join(up.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def _named(g: CodeGraph, q: str) -> DataFrame:
    return X.names_containing(g.nodes, q)


def _in_methods(g: CodeGraph, name: str, df: DataFrame) -> DataFrame:
    return df.join(_methods(g, name).select(F.col("qualified_name").alias("owner")), "owner", "left_semi")


#: handler -> (its arguments, what it does)
HANDLERS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "findClassByQualifiedName": (("qn",), L.class_by_name),
    "findClassesByName": (("name",), L.classes_by_simple_name),
    "getAllClasses": ((), lambda g: g.classes),
    "getSubclasses": (("className",), lambda g, c: L.subclasses(g, _class(g, c))),
    "getImplementations": (("interfaceName",), lambda g, c: L.implementations(g, _class(g, c))),
    "getMethods": (("className",), lambda g, c: L.methods_of(g, _class(g, c))),
    "findMethodBySignature": (("signature",), lambda g, s: L.method_by_signature(g, re.sub(r"\s+\(", "(", s))),
    "findMethodsByName": (("name",), L.methods_by_name),
    "getCallers": (("methodName",), lambda g, m: _around(g, m, True)),
    "getCallees": (("methodName",), lambda g, m: _around(g, m, False)),
    "getFields": (("className",), lambda g, c: L.fields_of(g, _class(g, c))),
    "getVariables": (("methodName",), lambda g, m: _in_methods(g, m, g.of_type("VARIABLE"))),
    "getSuperclass": (("className",), lambda g, c: L.superclass(g, _class(g, c))),
    "getOverriddenMethod": (("methodName",), _overridden),
    "getStatements": (("methodName",), lambda g, m: _in_methods(g, m, g.of_type(*L.STATEMENTS))),
    "getStatementAt": (("line",), lambda g, n: g.of_type(*L.STATEMENTS).where(F.col("start.line") == int(n))),
    "getNodesInFile": (("file",), L.in_file),
    "interpret": (("query",), _named),
}


class UnknownHandler(ValueError):
    pass


def run(g: CodeGraph, query: str, limit: int | None = LIMIT) -> DataFrame:
    """The answer's first `limit` nodes by id, with `total`, their number before the limit."""
    call = parse(query)
    if call.handler not in HANDLERS:
        raise UnknownHandler(f"no such query: {call.handler}")
    names, do = HANDLERS[call.handler]
    missing = [n for n in names if not call.params.get(n, "").strip()]
    if missing:
        raise ValueError(f"{call.handler} needs {', '.join(missing)}")
    got = do(g, *(call.params[n] for n in names)).select("id", "type", "name", "qualified_name", "file")
    got = got.join(F.broadcast(got.agg(F.count("*").alias("total"))), F.lit(True)).orderBy("id")  # one row
    return got if limit is None else got.limit(limit)
