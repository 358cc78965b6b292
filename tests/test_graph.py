"""Behaviour on small hand-made graphs."""

import json

import pytest

from strataloom.graph import CodeGraph
from strataloom.operators import lookup as L
from strataloom.operators import mutate as M
from strataloom.operators.build import build_summary, derive
from strataloom.operators.closure import call_paths, callees, callers, closure
from strataloom.plans.dsl import QueryCommand, UnknownQuery, parse, render, run
from strataloom.schema import CALL_SITES, EDGES, FILES, NODES
from strataloom.sources.sinks import read_json, write_json
from strataloom.streaming.updates import apply_changes, ask_windows, log_stream

COLUMNS = [f.split(" ")[0] for f in "id type name qualified_name file modifiers superclass interfaces signature owner is_constructor".split()]


def node(spark, rows):
    made = spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], "id string, type string, name string, qualified_name string, file string, modifiers array<string>, superclass string, interfaces array<string>, signature string, owner string, is_constructor boolean")
    return spark.createDataFrame([], NODES).unionByName(made, allowMissingColumns=True)


def cls(name, kind="CLASS", **more):
    return {"id": f"cls:p/{name}", "type": kind, "name": name, "qualified_name": f"p.{name}", "file": f"p/{name}.java", "modifiers": [], **more}


def mth(owner, name, **more):
    return {"id": f"mth:p/{owner}/{name}", "type": "METHOD", "name": name, "qualified_name": f"p.{owner}.{name}", "file": f"p/{owner}.java", "modifiers": ["public"], "signature": f"{name}()", "owner": f"p.{owner}", **more}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [cls("Shape", "INTERFACE"), cls("Base", modifiers=["abstract"], interfaces=["Shape"]), cls("Circle", superclass="p.Base"), cls("Square", interfaces=["p.Shape"]), cls("Caller")]
    rows += [mth("Shape", "draw", modifiers=["abstract"]), mth("Base", "draw", modifiers=["abstract"]), mth("Circle", "draw"), mth("Square", "draw"), mth("Caller", "go"), mth("Caller", "only")]
    owns = [(f"cls:p/{r['owner'][2:]}", r["id"], "HAS_METHOD", None) for r in rows if r["type"] == "METHOD"]
    sites = spark.createDataFrame([("mth:p/Caller/go", "p.Caller", "Shape", "draw", False, "p/Caller.java", 3), ("mth:p/Circle/draw", "p.Circle", "Unknown", "only", False, "p/Circle.java", 4)], CALL_SITES)
    files = spark.createDataFrame([(f"p/{n}.java", "p", []) for n in ("Shape", "Base", "Circle", "Square", "Caller")], FILES)
    return derive(CodeGraph(node(spark, rows), spark.createDataFrame(owns, EDGES), {"call_sites": sites, "files": files}))


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_derived_edges(graph):
    kinds = {r.type: r.n for r in L.counts_by_type(graph.edges).collect()}
    assert kinds == {"HAS_METHOD": 6, "INHERITS": 1, "IMPLEMENTS": 2, "OVERRIDES": 4, "CALLS": 4}
    assert ids(L.call_neighbours(graph, "mth:p/Caller/go", into=False)) == ["mth:p/Circle/draw", "mth:p/Shape/draw", "mth:p/Square/draw"]  # dispatch leaves out abstract ones
    assert ids(L.call_neighbours(graph, "mth:p/Caller/only", into=True)) == ["mth:p/Circle/draw"]  # the only method of that name
    row = build_summary(graph).first()
    assert (row.files, row.nodes, row.edges, row.dangling) == (5, 11, 17, 0)
    assert derive(graph).same_as(graph)


def test_hierarchy_lookups(graph):
    assert ids(L.implementations(graph, "p.Shape"), "name") == ["Base", "Circle", "Square"]
    assert ids(L.subclasses(graph, "p.Base"), "name") == ["Circle"]
    assert ids(L.superclass(graph, "p.Circle"), "name") == ["Base"]
    assert ids(L.overriding(graph, "p.Base", "draw()")) == ["mth:p/Circle/draw"]
    assert L.class_by_name(graph, None).count() == L.methods_of(graph, " ").count() == 0
    with pytest.raises(NotImplementedError):
        L.control_flow("m")


def letters(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def test_reachability_within_a_depth(spark):
    chain = letters(spark, ["ab", "bc", "cd", "de", "ea"])
    assert ids(callees(chain, "a", True, 2), "node") == ["b", "c"]
    assert ids(callees(chain, "a", True), "node") == list("abcde")
    assert ids(callers(chain, "a"), "node") == ["e"]
    assert callees(chain, "zz", True).count() == callees(chain, "").count() == 0
    with pytest.raises(ValueError):
        closure(chain, chain.selectExpr("src as start"), 0)


def test_call_paths(spark):
    fan = letters(spark, [(x, y) for i in range(12) for x, y in (("s", f"m{i}"), (f"m{i}", "t"))] + [("m0", "m1")])
    end = lambda a, b: spark.createDataFrame([(a, b)], "src string, dst string")
    assert {r.hops: r.n for r in call_paths(fan, end("s", "t")).groupBy("hops").count().selectExpr("hops", "count as n").collect()} == {2: 12, 3: 1}
    assert call_paths(fan, end("t", "s")).count() == 0
    assert call_paths(fan, end("s", "s")).collect()[0].path == ["s"]


def test_language(graph):
    assert parse(None) is None and parse("  ") is None
    assert parse(" QUIT ") == QueryCommand("exit") and parse("?") == QueryCommand("help")
    assert parse("method: class : p.X:") == QueryCommand("method", ("class", "p.X", ""))
    assert ids(run(graph, "class:subclasses:p.Base"), "name") == ["Circle"]
    assert ids(run(graph, "method:class:p.Caller"), "name") == ["go", "only"]
    assert run(graph, "search:nodes:interface").count() == 1 and run(graph, "search:edges:CALLS").count() == 4
    assert ids(run(graph, "class:p.Circle"), "name") == ["Circle"] and run(graph, "file:p/Base.java").count() == 2
    assert "Circle" in ids(run(graph, "search:text:Circle"), "name")
    assert run(graph, "stats").first().total_nodes == 11
    assert render(run(graph, "class:name:none")) == "no results"
    for bad in ("nothing:here", "class:", ""):
        with pytest.raises(UnknownQuery):
            run(graph, bad)


def test_changes(spark, graph):
    less = M.forget_file(graph, "p/Circle.java")
    assert less.nodes.count() == 9 and less.dangling().isEmpty()
    fresh = CodeGraph(node(spark, [cls("Circle", superclass="p.Base"), mth("Circle", "draw"), mth("Circle", "area")]), spark.createDataFrame([("cls:p/Circle", "mth:p/Circle/area", "HAS_METHOD", None)], EDGES))
    more, n = M.replace_file(graph, "p/Circle.java", fresh)
    assert n == {"removed": 2, "added": 3}
    assert ids(L.methods_of(more, "p.Circle"), "name") == ["area"] and L.subclasses(more, "p.Base").count() == 1
    with pytest.raises(M.UnknownEndpoint):
        M.add_edges(graph, spark.createDataFrame([("cls:p/Base", "nowhere", "CALLS")], "src string, dst string, type string"))
    with pytest.raises(ValueError):
        M.remove_edges(graph)


def test_snapshots_and_json(spark, graph, tmp_path):
    graph.save(str(tmp_path / "snap"), "1:2:3")
    assert CodeGraph.load(spark, str(tmp_path / "snap"), "1:2:3").same_as(graph)
    assert CodeGraph.load(spark, str(tmp_path / "snap"), "other") is None and CodeGraph.load(spark, str(tmp_path / "none")) is None
    CodeGraph.invalidate(spark, str(tmp_path / "snap"))
    assert CodeGraph.load(spark, str(tmp_path / "snap")) is None
    write_json(graph, str(tmp_path / "json"))
    assert read_json(spark, str(tmp_path / "json")).same_as(graph)


def test_streams(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    rows = [{"ts": f"2024-01-01T0{h}:10:00Z", "project": "p", "question": "q", "matched": "m", "answer_bytes": 5, "ok": True} for h in (1, 1, 2)]
    (logs / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    query = ask_windows(log_stream(spark, str(logs))).writeStream.format("memory").queryName("asked").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n, r.answer_bytes) for r in spark.table("asked").collect()) == [(1, 5), (2, 10)]
    edits = tmp_path / "edits"
    edits.mkdir()
    (edits / "a.jsonl").write_text('{"path":"x","ts":1,"kind":"new"}\n{"path":"x","ts":2,"kind":"deleted"}\n{"path":"y","ts":1,"kind":"new"}\n')
    seen = []
    apply_changes(log_stream(spark, str(edits), "path string, ts long, kind string"), lambda df, n: seen.extend((r.path, r.kind) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("x", "deleted"), ("y", "new")]


def test_second_hop_counts_only_helpers_of_other_classes(spark):
    from strataloom.operators.coverage import covered
    from strataloom.schema import EDGES, NODES

    cls = lambda q, f: {"id": f"cls:{q}", "type": "CLASS", "name": q, "qualified_name": q, "file": f}
    mth = lambda i, owner: {"id": i, "type": "METHOD", "name": i, "qualified_name": i, "owner": owner, "signature": i}
    nodes = [cls("P", "/src/main/P.java"), cls("H", "/src/main/H.java"), cls("T", "/src/test/T.java"), mth("t", "T")]
    nodes += [mth(f"p{i:02}", "P") for i in range(60)] + [mth(f"h{i:02}", "H") for i in range(60)]
    edges = [("t", f"p{i:02}", "CALLS", None) for i in range(60)] + [("t", f"h{i:02}", "CALLS", None) for i in range(60)] + [(f"h{i:02}", f"p{i:02}", "CALLS", None) for i in range(60)]
    for order in (edges, [(s.replace("h", "z"), d.replace("h", "z"), t, p) for s, d, t, p in edges]):  # helpers before and after the target's own methods
        named = [{**n, "id": n["id"].replace("h", "z")} if n["type"] == "METHOD" else n for n in nodes] if order is not edges else nodes
        g = CodeGraph(spark.createDataFrame(named, NODES), spark.createDataFrame(order, EDGES))
        got = covered(g, spark.createDataFrame([("P",)], "target string")).groupBy("link").count().collect()
        assert {r.link: r["count"] for r in got} == {"call-graph": 60, "call-graph-2hop": 50}
