"""Listings, logs, traces and small operators that no registered query covers."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.functions import identifiers as I
from strataloom.operators import lookup as L
from strataloom.operators import mutate as M
from strataloom.operators import rank as R
from strataloom.operators import resolve as B
from strataloom.operators import trace as E
from strataloom.graph import CodeGraph
from strataloom.operators.text import TextConfig, index_nodes, postings_of, reindex, search_token
from strataloom.schema import EDGES, NODES
from strataloom.sources import files as S
from strataloom.sources import traces as T
from strataloom.sources.sinks import append_log, write_report


@pytest.fixture
def tree(tmp_path):
    for name in ("src/main/java/a/A.java", "src/main/java/a/B.java", "src/test/java/a/ATest.java", "target/X.java", "src/main/java/a/readme.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class A {}")
    return str(tmp_path)


def names(df):
    return {r.file.rpartition("/")[2] for r in df.collect()}


def test_listings(spark, tree):
    assert names(S.listing(spark, tree)) == {"A.java", "B.java", "ATest.java", "X.java"} and S.count(S.listing(spark, tree, ".txt")) == 1
    assert names(S.listing(spark, [f"{tree}/src/main", f"{tree}/target"])) == {"A.java", "B.java", "X.java"}
    assert names(S.listing(spark, tree, exclude=("*/test/**", "/target/"))) == {"A.java", "B.java"} and names(S.texts(spark, tree, exclude=("A",))) == {"B.java", "X.java"}
    assert [r.rpartition("/src/")[2] for r in S.standard_roots(tree)] == ["main/java", "test/java"] and S.source_listing(tree, False)[0][0].endswith("src/main/java")
    assert S.source_listing(f"{tree}/target", False) == ([f"{tree}/target"], ("/test/",)) and S.standard_roots(f"{tree}/target") == [f"{tree}/target"]
    n, size, _ = S.fingerprint(S.listing(spark, tree)).split(":")
    assert (n, size) == ("3", "30")
    for bad in ("", " "):
        with pytest.raises(ValueError):
            S.listing(spark, tree, bad)


def test_listings_are_kept_for_a_while(spark, tree):
    now = [0.0]
    cache = S.ListingCache(2, 10, lambda: now[0])
    for _ in range(2):
        assert names(S.cached_listing(cache, spark, f"{tree}/src")) == {"A.java", "B.java", "ATest.java"}
    assert (cache.hits, cache.misses) == (1, 1)
    now[0] = 11.0
    S.cached_listing(cache, spark, f"{tree}/src")
    assert cache.misses == 2 and cache.hit_rate == 1 / 3


def test_logs_and_traces(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    (tmp_path / "ask.jsonl").write_text('{"ts":"2026-01-01T00:00:00Z","project":"p","question":"q","matched":null,"answer_bytes":3,"ok":true}\n\nnot json\nversion https://x\n')
    assert T.ask_log(spark, at("ask.jsonl")).count() == 1
    (tmp_path / "chunk.json").write_text(json.dumps([{"id": "a", "v": 2}, {"id": "a", "v": 1}, {"id": None, "v": 3}, {"id": None, "v": 3}]))
    assert sorted((r.id or "", r.v) for r in T.chunks(spark, at("chunk.json"), "id string, v int").collect()) == [("", 3), ("", 3), ("a", 1)]
    line = {"child": "c", "seq": 1, "payload": {"result": {"result": {"usage": {"input_tokens": 5, "cached_input_tokens": 2, "output_tokens": 1}}}}}
    (tmp_path / "use.jsonl").write_text(json.dumps(line) + "\n" + json.dumps({"child": "c", "seq": 2}) + "\n")
    assert [tuple(r) for r in T.usage_journal(spark, at("use.jsonl")).collect()] == [("c", 1, 5, 2, 1)]
    spark.createDataFrame([("h", 1, "a"), ("h", 3, "b"), ("i", 1, "c")], "source_trajectory_sha256 string, n_messages int, task string").write.parquet(at("traj"))
    assert {r.task for r in T.trajectories(spark, at("traj")).collect()} == {"b", "c"}
    calls = spark.createDataFrame([("1",), ("2",)], "id string")
    results = spark.createDataFrame([("1", "äb", True)], "tool_call_id string, content string, ok boolean")
    assert {(r.id, r.result_bytes) for r in T.tool_results(calls, results).collect()} == {("1", 3), ("2", None)}
    append_log(calls, at("log"))
    append_log(calls, at("log"))
    assert spark.read.json(at("log")).count() == 4
    text = write_report({"few": calls, "many": spark.range(5).withColumnRenamed("id", "n")}, str(tmp_path / "r.json"), most=3)
    assert "3 of 5 rows" in text and json.loads((tmp_path / "r.json").read_text())["rows_in_all"] == {"many": 5}


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_identifiers(spark):
    lit = F.lit
    got = one(spark, I.declaration_id("CLASS", lit("a.B$C")), I.declaration_id("CLASS", lit(" ")), I.parameter_id(lit("a.B.m#m(int)"), lit(2)), I.variable_id(lit("/x/A b.java"), lit("m"), lit("v")), I.strip_type(lit("Map<K, List<V>>[]...")), I.qualifier(lit("a.b.C")), I.qualifier(lit("C")))
    assert tuple(got) == ("cls:a/B$C", None, "par:a/B/m#m(int):2", "var:_x_A_b.java:m:v", "Map", "a.b", None)
    imports = F.array(lit("x.y.List"), lit("q.Z"))
    got = one(spark, *(B.as_written(lit(n), lit("p"), imports) for n in ("int", "a.B", "List", "Own")))
    assert tuple(got) == ("int", "a.B", "x.y.List", "p.Own")


def test_resolution_and_mutation(spark):
    node = lambda i, t, n, q, **k: {"id": i, "type": t, "name": n, "qualified_name": q, **k}
    nodes = spark.createDataFrame([node("cls:p/A", "CLASS", "A", "p.A"), node("m1", "METHOD", "m", "p.A.m#m(int)", owner="p.A", signature="m(int)"), node("m2", "METHOD", "m", "p.A.m#m()", owner="p.A", signature="m()"), node("v", "VARIABLE", "x", "x", owner="p.A.m#m()"), node("s", "RETURN", "", "", file="f")], NODES)
    edges = spark.createDataFrame([("cls:p/A", "m1", "HAS_METHOD", None), ("m1", "m2", "CALLS", None), ("m1", "m2", "CALLS", None)], EDGES)
    g = CodeGraph(nodes, edges)
    assert B.method_by_arity(g.methods, "p.A", "m", 1).first().id == "m1" and B.method_by_arity(g.methods, "p.A", "m", 2).isEmpty()
    mentions = spark.createDataFrame([("m1", "A", "f"), ("m1", "Zed", "f")], "node_id string, type_name string, file string")
    files = spark.createDataFrame([("f", "p", [])], "file string, package string, imports array<string>")
    assert tuple(B.unresolved(mentions, g.classes, files).first()) == (2, 1)
    assert L.variables_in(g, "p.A.m#m()").first().id == "v" and L.statements_in(g, "f").first().id == "s"
    assert M.remove_edge(g, "m1", "m2", "CALLS").edges.count() == 2 and M.remove_edges(g, src="m1").edges.count() == 1 and M.remove_edges(g, dst="m1").edges.count() == 2
    assert M.clear(g).nodes.isEmpty() and M.add_edges(g, edges.limit(1)).edges.count() == 4
    with pytest.raises(ValueError):
        M.remove_edges(g)
    log = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "ts int, path string")
    assert [r.ts for r in M.change_log(log, 2).collect()] == [4, 3]
    again = reindex(index_nodes(nodes), nodes.where("id = 'm1'").withColumn("name", F.lit("fresh")))
    assert not search_token(again, "fresh").isEmpty() and TextConfig(max_length=3).max_length == 3
    assert postings_of(spark.createDataFrame([("1", "theirs would IndexOf")], "node_id string, text string")).where("token in ('would')").isEmpty()
    with pytest.raises(ValueError):
        TextConfig(min_length=3, max_length=2)


def test_questions_and_classes_of_calls(spark):
    assert R.identifiers("where is com.acme.Widget.run defined?") == ["com.acme.Widget.run"] and R.literals("is \"a b\" or 9200 or 'c' or x1") == ["a b", "9200", "c"]
    calls = [("bash", '{"command": "grep x | wc -l"}'), ("bash", '{"command": "ls && rm a"}'), ("edit", '{"file_path": "A.java"}'), ("read_file", '{"path": "B"}')]
    got = {r.arguments: (r.operation, r.is_mutation) for r in E.classify_calls(spark.createDataFrame(calls, "tool string, arguments string")).collect()}
    assert got[calls[0][1]] == ("search", False) and got[calls[1][1]][1] and got[calls[2][1]] == ("mutate", True) and got[calls[3][1]] == ("read-file", False)
    kinds = spark.createDataFrame([("who calls this method", "x", False), (None, "a/FooTest.java", False)], "r string, t string, a boolean")
    assert all(x.k for x in kinds.select(E.question_kind(F.col("r"), F.col("t"), F.col("a")).alias("k")).collect())
