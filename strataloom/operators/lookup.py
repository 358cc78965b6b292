"""Point lookups, listings and counts over a CodeGraph. Null and blank arguments give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.identifiers import qualifier, simple_name
from strataloom.graph import CodeGraph
from strataloom.operators.closure import ancestors_of_all, closure, descendants, one_start, parents

STATEMENTS = ("BLOCK", "IF", "FOR", "FOREACH", "WHILE", "DO", "SWITCH", "TRY", "RETURN", "THROW", "BREAK", "CONTINUE", "EXPRESSION_STATEMENT")


def _eq(df: DataFrame, column: str, value: str | None) -> DataFrame:
    if value is None or not value.strip():
        return df.where("false")
    return df.where(F.col(column) == value)


# --- classes ------------------------------------------------------------------
def class_by_name(g: CodeGraph, fqn: str | None) -> DataFrame:
    return _eq(g.classes, "qualified_name", fqn)


def classes_by_simple_name(g: CodeGraph, name: str | None) -> DataFrame:
    return _eq(g.classes, "name", name)


def resolve_one(g: CodeGraph, name: str | None) -> DataFrame:
    """The class of that qualified name, else the only one of that simple name."""
    exact = class_by_name(g, name)
    alone = classes_by_simple_name(g, name)
    single = alone.agg(F.count("*").alias("n")).where("n = 1").select(F.lit(True).alias("ok"))
    missing = exact.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(True).alias("none"))
    return exact.unionByName(alone.join(F.broadcast(single), F.lit(True)).join(F.broadcast(missing), F.lit(True)).drop("ok", "none"))  # one-row flags


def subclasses(g: CodeGraph, fqn: str, direct: bool = False) -> DataFrame:
    """Classes below fqn by superclass, at any depth unless direct."""
    below = descendants(g.classes, fqn, interfaces=False, direct=direct)
    return g.classes.join(below.select(F.col("node").alias("qualified_name"), "depth"), "qualified_name")


def implementations(g: CodeGraph, fqn: str, direct: bool = False) -> DataFrame:
    """Classes below fqn by interfaces and superclasses."""
    below = descendants(g.classes, fqn, interfaces=True, direct=direct)
    return g.classes.join(below.select(F.col("node").alias("qualified_name"), "depth"), "qualified_name")


def superclass(g: CodeGraph, fqn: str) -> DataFrame:
    up = parents(class_by_name(g, fqn).unionByName(g.classes.where(F.col("qualified_name") != fqn).withColumn("superclass", F.lit(None).cast("string"))), interfaces=False)
    return g.classes.join(up.where(F.col("src") == fqn).select(F.col("dst").alias("qualified_name")), "qualified_name", "left_semi")


def interfaces_of(g: CodeGraph, fqn: str) -> DataFrame:
    up = parents(g.classes, superclasses=False)
    return g.classes.join(up.where(F.col("src") == fqn).select(F.col("dst").alias("qualified_name")), "qualified_name", "left_semi")


# --- members --------------------------------------------------------------------
def members(g: CodeGraph, fqn: str | None, edge: str) -> DataFrame:
    own = class_by_name(g, fqn).select(F.col("id").alias("src"))
    ids = g.edges_of_type(edge).join(own, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return g.nodes.join(ids, "id", "left_semi")


def methods_of(g: CodeGraph, fqn: str | None) -> DataFrame:
    return members(g, fqn, "HAS_METHOD")


def fields_of(g: CodeGraph, fqn: str | None) -> DataFrame:
    return members(g, fqn, "HAS_FIELD")


def methods_by_name(g: CodeGraph, name: str | None) -> DataFrame:
    return _eq(g.methods, "name", name)


def method_by_signature(g: CodeGraph, signature: str | None) -> DataFrame:
    """Of the methods with this signature the one with the least id."""
    return _eq(g.methods, "signature", signature).orderBy("id").limit(1)


def constructors_of(g: CodeGraph, fqn: str | None) -> DataFrame:
    return methods_of(g, fqn).where("is_constructor")


def static_of(members: DataFrame) -> DataFrame:
    return members.where("is_static")


def final_of(members: DataFrame) -> DataFrame:
    return members.where("is_final")


def with_modifier(df: DataFrame, modifier: str | None) -> DataFrame:
    """Classes, methods and fields that carry a modifier."""
    if not modifier:
        return df.where("false")
    return df.where(F.col("type").isin("CLASS", "INTERFACE", "METHOD", "FIELD") & F.array_contains("modifiers", modifier))


def field_by_name(g: CodeGraph, qn: str | None) -> DataFrame:
    return _eq(g.fields, "qualified_name", qn)


def variables_in(g: CodeGraph, method_key: str | None) -> DataFrame:
    """Local variables of a method, by its key Class.name#name(T)."""
    return _eq(g.of_type("VARIABLE"), "owner", method_key)


def call_neighbours(g: CodeGraph, method_id: str | None, into: bool) -> DataFrame:
    """The methods that call a method (into), or that it calls."""
    here, there = ("dst", "src") if into else ("src", "dst")
    ids = _eq(g.calls, here, method_id).select(F.col(there).alias("id")).distinct()
    return g.methods.join(ids, "id", "left_semi")


def overridden(g: CodeGraph, class_fqn: str, signature: str) -> DataFrame:
    """The method of the nearest superclass with the same signature."""
    up = parents(g.classes, interfaces=False)
    above = closure(up, one_start(g.classes, class_fqn), None)
    found = g.methods.where(F.col("signature") == signature).join(above.select(F.col("node").alias("owner"), "depth"), "owner")
    return found.orderBy("depth", "id").limit(1)


def overriding(g: CodeGraph, class_fqn: str, signature: str) -> DataFrame:
    below = descendants(g.classes, class_fqn, interfaces=False)
    return g.methods.where(F.col("signature") == signature).join(below.select(F.col("node").alias("owner"), "depth"), "owner")


def field_accesses(g: CodeGraph, field_qn: str | None) -> DataFrame:
    return _eq(g.table("field_usages"), "field_qn", field_qn)


# --- files, packages, types, adjacency -----------------------------------------------
def in_file(g: CodeGraph, path: str | None, *types: str) -> DataFrame:
    got = _eq(g.nodes, "file", path)
    return got.where(F.col("type").isin(*types)) if types else got


def statements_in(g: CodeGraph, path: str | None, line: int | None = None) -> DataFrame:
    """Statement nodes of a file; no parser of ours makes any, other sources of graphs may."""
    got = in_file(g, path, *STATEMENTS)
    return got if line is None else got.where(F.col("start.line") == line)


def control_flow(*_: object) -> DataFrame:
    raise NotImplementedError("control flow is not part of the graph")


def package_by_name(g: CodeGraph, name: str | None) -> DataFrame:
    return _eq(g.of_type("PACKAGE"), "name", name)


def classes_in_package(g: CodeGraph, name: str | None) -> DataFrame:
    """Classes of exactly this package."""
    return g.classes.where("false") if not name else g.classes.where(qualifier("qualified_name") == name)


def list_classes(g: CodeGraph, package: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Classes sorted by name with `total` before the limit; a package stands for its subpackages too."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    got = g.classes
    if package:
        got = got.where(F.startswith(F.col("qualified_name"), F.lit(package + ".")))
    if prefix:
        got = got.where(F.startswith(F.col("qualified_name"), F.lit(prefix)))
    got = got.select("qualified_name", "name", "type")
    total = got.agg(F.count("*").alias("total"))
    got = got.join(F.broadcast(total), F.lit(True)).orderBy("qualified_name")  # one row
    return got if limit is None else got.limit(limit)


def of_types(g: CodeGraph, *types: str) -> DataFrame:
    return g.of_type(*types)


def edges_of(g: CodeGraph, src: str | None = None, dst: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Edges that meet all conditions given."""
    got = g.edges if kind is None else g.edges_of_type(kind)
    for column, value in (("src", src), ("dst", dst)):
        if value is not None:
            got = got.where(F.col(column) == value)
    return got if limit is None else got.orderBy("src", "dst", "type").limit(limit)


def nodes_where(g: CodeGraph, kind: str | None = None, node_id: str | None = None, file: str | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes that meet all conditions given, with `total`, their number before the limit."""
    got = g.nodes
    for column, value in (("type", kind), ("id", node_id), ("file", file), ("name", name)):
        if value is not None:
            got = got.where(F.col(column) == value)
    total = got.agg(F.count("*").alias("total"))
    got = got.join(F.broadcast(total), F.lit(True))  # one row
    return got if limit is None else got.orderBy("id").limit(limit)


def search(g: CodeGraph, q: str) -> DataFrame:
    """(kind, qualified_name): classes of this simple name, else methods of this name."""
    classes = classes_by_simple_name(g, q).select(F.lit("class").alias("kind"), "qualified_name", "id")
    none = classes.agg(F.count("*").alias("n")).where("n = 0")
    methods = methods_by_name(g, q).select(F.lit("method").alias("kind"), "qualified_name", "id").join(F.broadcast(none), F.lit(True)).drop("n")  # one row
    return classes.unionByName(methods)


def derived_names(df: DataFrame) -> DataFrame:
    """simple_type of fields, class and package of methods, parent of packages: cut from qualified names."""
    return df.withColumns({"simple_type": simple_name("data_type"), "class_name": qualifier("qualified_name"), "package_name": qualifier(qualifier("qualified_name"))})


def relative(path: str, root: str) -> Column:
    """A path below root, others unchanged."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(F.col(path), F.lit(base)), F.substring(F.col(path), F.lit(len(base) + 1), F.length(path))).otherwise(F.col(path))


# --- counts ---------------------------------------------------------------------------
def totals(g: CodeGraph) -> DataFrame:
    n = g.nodes.agg(F.count("*").alias("total_nodes"))
    return n.join(F.broadcast(g.edges.agg(F.count("*").alias("total_edges"))), F.lit(True))  # one row each


def counts_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"))


def member_counts(g: CodeGraph) -> DataFrame:
    """(qualified_name, method_count, field_count), zero where there are none."""
    each = g.edges_of_type("HAS_METHOD", "HAS_FIELD").where("dst is not null").select("src", "dst", "type").repartition("src").distinct()  # one shuffle for both
    own = each.groupBy("src").agg(F.count_if(F.col("type") == "HAS_METHOD").alias("m"), F.count_if(F.col("type") == "HAS_FIELD").alias("f"))
    got = g.classes.join(own, g.classes.id == own.src, "left")
    return got.select("qualified_name", F.coalesce("m", F.lit(0)).alias("method_count"), F.coalesce("f", F.lit(0)).alias("field_count"))


def class_detail(g: CodeGraph, fqn: str) -> DataFrame:
    return class_by_name(g, fqn).select("qualified_name", "type", "superclass", "file").join(member_counts(g), "qualified_name")


def call_counts(g: CodeGraph) -> DataFrame:
    """Calls, and callers plus callees."""
    return g.calls.agg(F.count("*").alias("call_count"), (F.countDistinct("src") + F.countDistinct("dst")).alias("method_count"))


def override_pairs(g: CodeGraph) -> DataFrame:
    """(src, dst): methods and the methods of any ancestor that they override."""
    above = ancestors_of_all(g.classes)
    m = g.methods.select("id", "owner", "signature")
    low = m.select(F.col("id").alias("src"), F.col("owner").alias("start"), "signature")
    high = m.select(F.col("id").alias("dst"), F.col("owner").alias("node"), "signature")
    return low.join(above, "start").join(high, ["node", "signature"]).select("src", "dst").distinct()
