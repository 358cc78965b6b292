"""Changing a graph: each function gives a new CodeGraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.graph import CodeGraph
from strataloom.schema import EDGES, NODES


class UnknownEndpoint(ValueError):
    pass


def add_nodes(g: CodeGraph, new: DataFrame) -> CodeGraph:
    """Nodes whose id isn't there yet; of several with one id the first by type and file."""
    w = Window.partitionBy("id").orderBy("type", "file")
    first = new.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return g.with_tables(nodes=g.nodes.unionByName(first.join(g.nodes, "id", "left_anti"), allowMissingColumns=True))


def remove_nodes(g: CodeGraph, ids: DataFrame) -> CodeGraph:
    """Nodes and all edges at them."""
    ids = ids.select("id").distinct()
    edges = g.edges.join(ids, g.edges.src == ids.id, "left_anti")
    return g.with_tables(nodes=g.nodes.join(ids, "id", "left_anti"), edges=edges.join(ids, edges.dst == ids.id, "left_anti"))


def add_edges(g: CodeGraph, new: DataFrame) -> CodeGraph:
    """Edges between nodes of the graph; UnknownEndpoint if one has an end elsewhere. Edges may repeat."""
    new = new if "props" in new.columns else new.withColumn("props", F.lit(None).cast("map<string,string>"))
    out = CodeGraph(g.nodes, new).dangling()
    if not out.isEmpty():
        raise UnknownEndpoint("an edge ends at no node of the graph")
    return g.with_tables(edges=g.edges.unionByName(new))


def remove_edge(g: CodeGraph, src: str, dst: str, kind: str) -> CodeGraph:
    """One of the equal edges."""
    w = Window.partitionBy("src", "dst", "type").orderBy(F.to_json("props"))
    hit = (F.col("src") == src) & (F.col("dst") == dst) & (F.col("type") == kind)
    mine = g.edges.where(hit).withColumn("rn", F.row_number().over(w)).where("rn > 1").drop("rn")
    return g.with_tables(edges=g.edges.where(~hit).unionByName(mine))


def remove_edges(g: CodeGraph, src: str | None = None, dst: str | None = None, kind: str | None = None) -> CodeGraph:
    """All edges that meet every condition given; at least one must be."""
    if src is None and dst is None and kind is None:
        raise ValueError("give src, dst or kind")
    hit = F.lit(True)
    for column, value in (("src", src), ("dst", dst), ("type", kind)):
        if value is not None:
            hit = hit & (F.col(column) == value)
    return g.with_tables(edges=g.edges.where(~hit))


def union(a: CodeGraph, b: CodeGraph) -> CodeGraph:
    """All of both; of equal node ids a's stays."""
    got = add_nodes(a, b.nodes)
    side = {n: (a.table(n).unionByName(b.table(n)) if n in b.side else a.table(n)) for n in {*a.side, *b.side}}
    return got.with_tables(edges=a.edges.unionByName(b.edges), **side)


def clear(g: CodeGraph) -> CodeGraph:
    s = g.spark
    return CodeGraph(s.createDataFrame([], NODES), s.createDataFrame([], EDGES))


def forget_file(g: CodeGraph, path: str) -> CodeGraph:
    """The graph without what a file declared, by exact path, else by the end of it."""
    exact = g.nodes.where(F.col("file") == path)
    mine = exact if not exact.isEmpty() else g.nodes.where(F.col("file").endswith("/" + path.lstrip("/")))
    return forget_files(g, mine.select("file").distinct())


def forget_files(g: CodeGraph, files: DataFrame) -> CodeGraph:
    """The graph without what the files (file) declared. Packages stay: other files may declare them."""
    names = files.select("file").distinct()
    got = remove_nodes(g, g.nodes.where("type <> 'PACKAGE'").join(names, "file", "left_semi").select("id"))
    side = {n: t.join(names, "file", "left_anti") for n, t in g.side.items() if "file" in t.columns}
    return got.with_tables(**side)


def replace_file(g: CodeGraph, path: str, fresh: CodeGraph) -> tuple[CodeGraph, dict[str, int]]:
    """The graph with a file's rows taken from `fresh`, calls and hierarchy worked out anew, and the numbers of nodes removed and added."""
    from strataloom.operators.build import derive

    less = forget_file(g, path)
    more = derive(union(less, fresh))
    n, m, k = g.nodes.count(), less.nodes.count(), more.nodes.count()
    return more, {"removed": n - m, "added": k - m}


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change) from two listings (file, mtime): new, changed and deleted files."""
    b, a = before.select("file", F.col("mtime").alias("m0")), after.select("file", F.col("mtime").alias("m1"))
    both = b.join(a, "file", "full_outer")
    change = F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "deleted").when(F.col("m1") != F.col("m0"), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


def needs_parsing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are new or newer than before."""
    return after.join(before.select("file", F.col("mtime").alias("old")), "file", "left").where("old is null or mtime > old").drop("old")


def change_log(changes: DataFrame, most: int = 200) -> DataFrame:
    """The newest changes first."""
    return changes.orderBy(F.desc("ts"), "path").limit(most)
