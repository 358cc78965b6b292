"""Build-time resolution: names as written become nodes, call sites become calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.identifiers import qualifier, simple_name, strip_type
from strataloom.graph import CodeGraph
from strataloom.operators.closure import ancestors_of_all, closure, parents
from strataloom.storage import stored

PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double", "void", "var")
DISPATCH_LIMIT = 50


def as_written(name: Column, package: Column, imports: Column) -> Column:
    """A type name resolved by text alone: primitives, dotted and java.lang names stay; an import that ends in it; else the own package."""
    fit = F.get(F.filter(imports, lambda i: F.endswith(i, F.concat(F.lit("."), name))), F.lit(0))
    own = F.when(F.length(F.coalesce(package, F.lit(""))) > 0, F.concat(package, F.lit("."), name)).otherwise(name)
    return F.when(name.isin(*PRIMITIVES) | name.contains("."), name).otherwise(F.coalesce(fit, own))


def resolve_types(mentions: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, type_name, file, resolved): the class each mention means, null if none.

    In order: qualified name; an import of the file; the file's package;
    java.lang; the only class of that simple name. Primitives mean none.
    """
    m = mentions.withColumn("t", strip_type("type_name")).where(~F.col("t").isin(*PRIMITIVES) & (F.col("t") != ""))
    keys = m.select("t", "file").distinct()
    known = classes.select(F.col("qualified_name").alias("q"), F.col("name").alias("n")).distinct()
    ctx = keys.join(files.select("file", "package", "imports"), "file", "left")
    cand = F.array(
        F.struct(F.lit(1).alias("rank"), F.col("t").alias("q")),
        F.struct(F.lit(2).alias("rank"), F.get(F.filter(F.coalesce("imports", F.array().cast("array<string>")), lambda i: F.endswith(i, F.concat(F.lit("."), F.col("t")))), F.lit(0)).alias("q")),
        F.struct(F.lit(3).alias("rank"), F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "t").alias("q")),
        F.struct(F.lit(4).alias("rank"), F.concat(F.lit("java.lang."), "t").alias("q")),
    )
    named = ctx.select("t", "file", F.explode(cand).alias("c")).select("t", "file", "c.rank", "c.q").where("q is not null").join(known.select("q").distinct(), "q")
    alone = known.groupBy("n").agg(F.min("q").alias("q"), F.count("*").alias("k")).where("k = 1").select(F.col("n").alias("t"), "q", F.lit(5).alias("rank"))
    simple = keys.join(alone, "t").select("t", "file", "rank", "q")
    best = named.select("t", "file", "rank", "q").unionByName(simple).groupBy("t", "file").agg(F.min_by("q", F.struct("rank", "q")).alias("resolved"))
    return m.join(best, ["t", "file"], "left").select("node_id", "type_name", "file", "resolved")


def references(mentions: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """REFERENCES_TYPE edges of all mentions, one for each node and class."""
    ids = classes.select(F.col("qualified_name").alias("resolved"), F.col("id").alias("dst")).distinct()
    return resolve_types(mentions, classes, files).join(ids, "resolved").select(F.col("node_id").alias("src"), "dst", F.lit("REFERENCES_TYPE").alias("type")).distinct()


def hierarchy_edges(classes: DataFrame) -> DataFrame:
    """INHERITS and IMPLEMENTS edges between classes of the graph."""
    ids = classes.select("qualified_name", "id").distinct()
    src, dst = ids.select(F.col("qualified_name").alias("s"), F.col("id").alias("src")), ids.select(F.col("qualified_name").alias("d"), F.col("id").alias("dst"))
    out = []
    for kind, args in (("INHERITS", {"interfaces": False}), ("IMPLEMENTS", {"superclasses": False})):
        up = parents(classes, **args).select(F.col("src").alias("s"), F.col("dst").alias("d"))
        out.append(up.join(src, "s").join(dst, "d").select("src", "dst", F.lit(kind).alias("type")))
    return out[0].unionByName(out[1])


def override_edges(g: CodeGraph) -> DataFrame:
    """OVERRIDES edges: a method to each method of an ancestor with its signature; constructors override none."""
    above = ancestors_of_all(g.classes)
    m = g.methods.where(~F.coalesce("is_constructor", F.lit(False))).select("id", "owner", "signature")
    low = m.select(F.col("id").alias("src"), F.col("owner").alias("start"), "signature")
    high = m.select(F.col("id").alias("dst"), F.col("owner").alias("node"), "signature")
    return low.join(above, "start").join(high, ["node", "signature"]).select("src", "dst", F.lit("OVERRIDES").alias("type")).distinct()


def resolve_calls(sites: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """CALLS (src, dst), distinct, from call sites (caller_id, caller_class, receiver_type, method_name).

    A dotted receiver means that class; a simple one all classes of that name,
    of the caller's package only if there are several and it has one; none
    means the caller's own class. All overloads of the name there are called;
    where there are none, the only method of that name in the graph is.
    """
    callers = stored(sites.where("caller_id is not null and method_name is not null").select("caller_id", "caller_class", "receiver_type", "method_name").distinct(), "sites")
    known = stored(classes.select(F.col("qualified_name").alias("cls"), F.col("name").alias("simple")).distinct(), "known")
    m = stored(methods.select(F.col("id").alias("dst"), F.col("owner").alias("cls"), F.col("name").alias("method_name")), "callable")
    # what is meant depends on these three alone: sites that share them are resolved once
    same = [F.col(c).eqNullSafe(F.col("k_" + c)) for c in ("caller_class", "receiver_type", "method_name")]
    s = callers.select("caller_class", "receiver_type", "method_name").distinct().withColumn("sid", F.xxhash64("caller_class", F.coalesce("receiver_type", F.lit("\x00")), "method_name"))
    s = stored(s, "asked")
    dotted = s.where(F.col("receiver_type").contains(".")).select("sid", "method_name", F.col("receiver_type").alias("cls"))
    own = s.where("receiver_type is null").select("sid", "method_name", F.col("caller_class").alias("cls"))
    exact = dotted.unionByName(own).join(m, ["cls", "method_name"]).select("sid", "dst")
    # a simple receiver: methods of that name in classes of that name; where one of these classes is in the caller's package, those alone
    simple = s.where("receiver_type is not null").where(~F.col("receiver_type").contains(".")).select("sid", "receiver_type", "method_name", qualifier("caller_class").alias("package"))
    local = simple.join(known.select(F.col("simple").alias("receiver_type"), qualifier("cls").alias("package")).distinct(), ["receiver_type", "package"], "left_semi").select("sid", F.lit(True).alias("local"))
    held = m.join(known, "cls").select(F.col("simple").alias("receiver_type"), "method_name", qualifier("cls").alias("held_in"), "dst")
    loose = simple.join(held, ["receiver_type", "method_name"]).join(local, "sid", "left").where("local is null or held_in = package").select("sid", "dst")
    found = stored(exact.unionByName(loose).distinct(), "calls")
    alone = m.groupBy("method_name").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").select("method_name", "dst")
    rest = s.join(found.select("sid").distinct(), "sid", "left_anti").join(alone, "method_name").select("sid", "dst")
    asked = stored(found.unionByName(rest).join(s, "sid").select("dst", *(F.col(c).alias("k_" + c) for c in ("caller_class", "receiver_type", "method_name"))), "answers")
    return callers.join(asked, same[0] & same[1] & same[2]).select(F.col("caller_id").alias("src"), "dst").distinct()


def dispatch_calls(g: CodeGraph, limit: int = DISPATCH_LIMIT) -> DataFrame:
    """New CALLS (src, dst): for a call of an abstract method, or one of an interface or abstract class, the concrete methods of the same signature below it.

    At most `limit` for each call, nearest class first, then by class and id;
    calls that exist already don't count. Only given calls are expanded.
    """
    abstract = F.array_contains(F.coalesce("modifiers", F.array().cast("array<string>")), "abstract")
    cls = g.classes.select(F.col("qualified_name").alias("owner"), ((F.col("type") == "INTERFACE") | abstract).alias("open")).distinct()
    m = g.methods.select("id", "owner", "signature", abstract.alias("abs")).join(cls, "owner")
    loose = m.where("open or abs").select(F.col("id").alias("dst"), F.col("owner").alias("start"), "signature")
    called = stored(g.calls.join(loose, "dst"), "open-calls")
    up = parents(g.classes)
    below = closure(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")), called.select("start").distinct(), None)
    solid = m.join(cls.select("owner", F.col("open").alias("o2")), "owner").where("not abs").select(F.col("id").alias("new"), F.col("owner").alias("node"), "signature")
    solid = solid.join(g.classes.where("type <> 'INTERFACE'").select(F.col("qualified_name").alias("node")).distinct(), "node", "left_semi")
    cand = called.join(below, "start").join(solid, ["node", "signature"]).where("new <> src").select("src", "dst", "new", "depth", "node")
    cand = cand.join(g.calls.select("src", F.col("dst").alias("new")), ["src", "new"], "left_anti")
    w = Window.partitionBy("src", "dst").orderBy("depth", "node", "new")
    return cand.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("src", F.col("new").alias("dst")).distinct()


def resolve_field_usages(refs: DataFrame, fields: DataFrame, classes: DataFrame) -> DataFrame:
    """One (field_qn, method_qn, file, line) for each field and method from references (class_fqn, scope, name, method_qn, file, line).

    scope: null or 'this' for the own class, else a class by simple or qualified name.
    """
    known = classes.select(F.col("qualified_name").alias("cls"), F.col("name").alias("simple")).distinct()
    own = refs.where("scope is null or scope = 'this'").withColumn("cls", F.col("class_fqn"))
    far = refs.where("scope is not null and scope <> 'this'").join(known, (F.col("scope") == F.col("simple"))).select(*refs.columns, "cls")
    full = refs.where(F.col("scope").contains(".")).withColumn("cls", F.col("scope"))
    f = fields.select(F.col("owner").alias("cls"), "name", F.col("qualified_name").alias("field_qn"))
    hit = own.unionByName(far).unionByName(full).join(f, ["cls", "name"])
    return hit.groupBy("field_qn", "method_qn").agg(F.min(F.struct("file", "line")).alias("at")).select("field_qn", "method_qn", "at.file", "at.line")


def unresolved(mentions: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    got = resolve_types(mentions, classes, files)
    return got.agg(F.count("*").alias("mentions"), F.sum(F.when(F.col("resolved").isNull(), 1).otherwise(0)).alias("unresolved"))


def method_by_arity(methods: DataFrame, cls: str, name: str, arity: int) -> DataFrame:
    """The only method of a class with this name and number of parameters."""
    inner = F.regexp_extract("signature", r"\((.*)\)", 1)
    n = F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))
    hit = methods.where((F.col("owner") == cls) & (F.col("name") == name) & (n == arity))
    one = hit.agg(F.count("*").alias("k")).where("k = 1")
    return hit.join(F.broadcast(one), F.lit(True)).drop("k")  # one row
