"""From declaration rows and side tables to the derived edges of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.graph import CodeGraph
from strataloom.operators.resolve import dispatch_calls, hierarchy_edges, override_edges, resolve_calls
from strataloom.storage import stored

#: Edges that follow from the rest and are worked out anew; the others come with the declarations.
DERIVED = ("INHERITS", "IMPLEMENTS", "OVERRIDES", "CALLS")


def derive(g: CodeGraph, dispatch: bool = True) -> CodeGraph:
    """g with hierarchy, override and call edges worked out from its nodes and call sites, those it had dropped.

    CALLS edges that no call site stands behind are dropped too. Each edge is there once.
    """
    nodes = stored(g.nodes, "nodes")
    g = g.with_tables(nodes=nodes)
    ids = nodes.select(F.col("id").alias("dst"))
    kept = g.edges.where(~F.col("type").isin(*DERIVED)).join(ids, "dst", "left_semi").select("src", "dst", "type", "props")
    calls = stored(resolve_calls(g.table("call_sites"), g.methods, g.classes).withColumn("type", F.lit("CALLS")), "calls")
    made = [hierarchy_edges(g.classes), override_edges(g), calls]
    if dispatch:
        called = g.with_tables(edges=calls.withColumn("props", F.lit(None).cast("map<string,string>")))
        made.append(dispatch_calls(called).withColumn("type", F.lit("CALLS")))
    new = reduce(DataFrame.unionByName, made).distinct().withColumn("props", F.lit(None).cast("map<string,string>"))
    return g.with_tables(edges=stored(kept.unionByName(new), "edges"))


def build_summary(g: CodeGraph) -> DataFrame:
    """One row: files, nodes, edges and edges that end at no node."""
    counts = {"files": g.table("files"), "nodes": g.nodes, "edges": g.edges, "dangling": g.dangling()}
    one = [df.agg(F.count("*").alias(name)) for name, df in counts.items()]
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), one)  # one row each
