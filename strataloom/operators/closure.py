"""Recursive operators: reachability, call paths and type hierarchies.

Reachability is a breadth-first frontier loop: a shortest distance within k is
the same as being reached within k steps, and each node is expanded once for
each start. Every frontier is written to the shared folder, which keeps plans
flat and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.storage import stored

DEFAULT_DEPTH = 10


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = DEFAULT_DEPTH) -> DataFrame:
    """(start, node, depth): nodes within max_depth steps of each start; None: any depth.

    edges: (src, dst). starts: (start). A start is in its own closure only if a
    cycle leads back to it, then at that cycle's length.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    edges = stored(edges.select("src", "dst"), "edges")  # repeated edges do no harm: each step is distinct
    front = stored(starts.select("start").distinct().join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct(), "front")
    seen = front
    depth = 1
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        step = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionByName(front)
    return seen


def one_start(df: DataFrame, start: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(start,)], "start string")


def callees(calls: DataFrame, method: str, transitive: bool = False, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(node, depth) called by a method, directly or through others."""
    if not method or not method.strip():
        return calls.where("false").select(F.col("dst").alias("node"), F.lit(1).alias("depth"))
    if not transitive:
        return calls.where(F.col("src") == method).select(F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct()
    return closure(calls, one_start(calls, method), max_depth).select("node", "depth")


def callers(calls: DataFrame, method: str, transitive: bool = False, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(node, depth) that call a method, directly or through others."""
    return callees(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), method, transitive, max_depth)


def has_direct_call(calls: DataFrame, src: str, dst: str) -> bool:
    return not calls.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def call_paths(calls: DataFrame, ends: DataFrame, max_hops: int = 5) -> DataFrame:
    """(src, dst, path, hops): all simple paths of at most max_hops calls between the pairs `ends` (src, dst).

    A pair of equal ends has the path of that one node. Paths are grown only
    through nodes that reach their target in the hops left, so dead branches
    are never enumerated.
    """
    same = ends.where("src = dst").select("src", "dst", F.array("src").alias("path"), F.lit(0).alias("hops"))
    if max_hops < 1:
        return same.where("false")
    pairs = stored(ends.where("src <> dst").distinct(), "ends")
    back = closure(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pairs.select(F.col("dst").alias("start")), max_hops)
    reach = stored(back.select(F.col("start").alias("dst"), "node", F.col("depth").alias("left")).unionByName(pairs.select("dst", F.col("dst").alias("node"), F.lit(0).alias("left")).distinct()), "reach")
    grown = pairs.select("src", "dst", F.array("src").alias("path"), F.col("src").alias("at"))
    done = None
    step = calls.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    for hop in range(1, max_hops + 1):
        more = grown.join(step, "at").where(~F.array_contains("path", F.col("next")))
        more = more.join(reach.where(F.col("left") <= max_hops - hop).select("dst", F.col("node").alias("next")).distinct(), ["dst", "next"], "left_semi")
        grown = stored(more.select("src", "dst", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at")), "paths")
        hit = grown.where("at = dst").select("src", "dst", "path", F.lit(hop).alias("hops"))
        done = hit if done is None else done.unionByName(hit)
        grown = grown.where("at <> dst")
        if grown.isEmpty():
            break
    return same.unionByName(done)


def labelled_paths(paths: DataFrame, methods: DataFrame, limit: int = 10) -> DataFrame:
    """(path, hops) with names for ids, the shortest first, then by path; at most `limit`."""
    few = paths.withColumn("key", F.array_join("path", " > ")).orderBy("hops", "key").limit(limit)
    steps = few.select("key", "hops", F.posexplode("path").alias("pos", "id")).join(methods.select("id", "qualified_name"), "id", "left")
    named = steps.groupBy("key", "hops").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("qualified_name", "id").alias("n")))), lambda x: x["n"]), " -> ").alias("label"))
    return named.select("label", "hops")


def parents(classes: DataFrame, interfaces: bool = True, superclasses: bool = True) -> DataFrame:
    """(src, dst): each class and the classes it names as parents, by qualified or simple name of classes in the graph.

    A simple name counts for every class that bears it.
    """
    named = []
    if superclasses:
        named.append(classes.select(F.col("qualified_name").alias("src"), F.col("superclass").alias("parent")))
    if interfaces:
        named.append(classes.select(F.col("qualified_name").alias("src"), F.explode("interfaces").alias("parent")))
    links = named[0] if len(named) == 1 else named[0].unionByName(named[1])
    links = links.where("parent is not null")
    known = classes.select("qualified_name", "name").distinct()
    exact = links.join(known, F.col("parent") == F.col("qualified_name")).select("src", F.col("qualified_name").alias("dst"))
    loose = links.where(~F.col("parent").contains(".")).join(known, F.col("parent") == F.col("name")).select("src", F.col("qualified_name").alias("dst"))
    return exact.unionByName(loose).where("src <> dst").distinct()


def descendants(classes: DataFrame, root: str, interfaces: bool, direct: bool = False) -> DataFrame:
    """(node, depth): classes below root by superclass, or by superclass and interface."""
    up = parents(classes, interfaces=interfaces)
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(down, one_start(classes, root), 1 if direct else None).where(F.col("node") != root).select("node", "depth")


def ancestors_of_all(classes: DataFrame, interfaces: bool = True) -> DataFrame:
    """(start, node, depth): every class and all its ancestors."""
    up = parents(classes, interfaces=interfaces)
    return closure(up, classes.select(F.col("qualified_name").alias("start")), None)
