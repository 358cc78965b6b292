"""Questions, phrases, tools and edits over a small parsed project."""

import json

import pytest

from strataloom.operators import lookup as L
from strataloom.operators.cache import LiveGraph, ResultCache
from strataloom.operators.edit import BadOperation, Operation, apply_edits, edit_summary, edit_text, parse_operation, rendered
from strataloom.plans import batch
from strataloom.plans.router import Router, capped, routed
from strataloom.plans.tools import BadArgument, Tools
from strataloom.sources.java import graph_of, parse

from .test_java import SHOP, rows


@pytest.fixture(scope="module")
def shop(spark):
    return graph_of(parse(spark.createDataFrame(rows(SHOP), "file string, text string")))


ASKED = [
    ("what implements Sink", "implementations", "shop.Store"), ("which classes extends Base", "subclasses", "shop.Store"), ("who calls note", "callers", "Helper"),
    ("who uses PORT", "field-usage", "shop.Store.note"), ("call path from Use.far to Ledger.open", "callers", None), ("flow from Helper.help to Ledger.open", "callpath", "shop.Store.note"),
    ("which tests verify Store", "tests", "shop.StoreTest"), ("where is 9200 defined", "values", "PORT"), ("list methods of Ledger", "methods", "open(int)"), ("fields of Store", "fields", "ledger"),
    ("where is the separator pattern declared", "field-location", "SEP_PAT"), ("where is Ledger", "location", "Ledger.java"), ("where does tidy live", "location", "tidy"), ("Ledger", "class-detail", "shop.Ledger"),
    ("tell me about twice", "method", "twice"), ("zzz qqq", None, None),
]


@pytest.mark.parametrize(("question", "matched", "part"), ASKED)
def test_intents(shop, question, matched, part):
    got = Router(shop).ask(question)
    assert got.matched == matched, got
    assert part is None or part in got.text and got.count > 0


def test_answers_are_cut_at_a_line():
    assert capped("a" * 10) == "a" * 10 and capped("ab\ncd\nef", 5) == "ab\n(cut)" and capped("x" * 20, 5).startswith("xxxxx")


def test_logs_are_routed_by_words(spark):
    asked = spark.createDataFrame([("who calls x",), ("what tests y",), ("Ledger",)], "question string")
    assert [r.intent for r in routed(asked).collect()] == ["callers", "tests", "name"]


def test_phrases_and_calls(shop):
    assert batch.parse(" who calls Store.note ") == batch.Call("getCallers", {"methodName": "Store.note"})
    assert batch.parse("getFields(className='shop.Store', x=1)") == batch.Call("getFields", {"className": "shop.Store", "x": "1"})
    assert batch.parse("something else").handler == "interpret"
    names = lambda q: {r.name for r in batch.run(shop, q).collect()}
    assert names("what does Helper.help call") == {"note", "Store"} and names("callers of note") >= {"help", "put", "tidy"}
    assert names("fields in Store") == {"PORT", "SPARE", "SEP_PAT", "ledger", "count"} and names("variables in Store.note") == {"l"}
    assert names("superclass of Store") == {"Base"} and names("subclasses of Base") == {"Store"} and names("what implements Sink") == {"Store"}
    assert names("overridden method of Store.put") == {"put"} and names("classes named Entry") == {"Entry"} and names("find method note (String)") == {"note"}
    assert names("ledger") == {"Ledger"} and batch.run(shop, "all classes", 3).count() == 3 and batch.run(shop, "all classes", 3).first().total > 3
    for bad in ("nothing(x=1)", "getFields()"):
        with pytest.raises(ValueError):
            batch.run(shop, bad)


def test_tools_check_arguments_and_answer(spark, shop, tmp_path):
    tools = Tools(LiveGraph(lambda: shop), f"file://{tmp_path}/logs", lambda: spark.createDataFrame([("a",)], "file string"), "p")
    assert tools.ask("who calls note").matched == "callers" and tools.search("note")[0].kind == "method"
    assert tools.class_detail("Ledger").method_count == 3 and {r.qualified_name for r in tools.class_members("Store", "fields", True)} >= {"shop.Store.PORT"}
    assert len(tools.classes(package="shop", limit=3)) == 3 and {r.name for r in tools.packages()} == {"shop", "shop.api"}
    assert {r.test_class for r in tools.tests("Store")} == {"shop.StoreTest", "shop.ErrorTest"} and tools.callpath("Use.far", "Ledger.open")
    tools.feedback("who calls note", "good")
    assert tools.edited("/w/src/main/java/shop/Limits.java", "package shop; enum Limits { LOW }")["removed"] == 3
    assert tools.changes()[0].path.endswith("Limits.java") and tools.stats()["stale"] and not tools.stats()["rebuilding"]
    assert spark.read.json(f"file://{tmp_path}/logs/ask").first().matched == "callers" and spark.read.json(f"file://{tmp_path}/logs/feedback").first().rating == "good"
    for bad in (lambda: tools.ask(" "), lambda: tools.classes(), lambda: tools.classes(prefix="s", limit=0), lambda: tools.class_members("Store", "x"), lambda: tools.class_detail("Nope"), lambda: tools.callpath("", "b")):
        with pytest.raises(BadArgument):
            bad()


def test_results_are_kept_and_graphs_swapped(shop):
    cache = ResultCache(shop)
    for _ in range(2):
        assert cache(L.class_by_name, "shop.Store").count() == 1
    assert (cache.hits, cache.misses, cache.hit_rate) == (1, 1, 0.5)
    cache.clear()
    made = iter([shop, shop.with_tables(edges=shop.edges.where("false"))])
    live = LiveGraph(lambda: next(made))
    assert live.refresh() and live.graph is not shop and not live.rebuilding
    assert live.refresh() and live.error is not None and live.graph is not shop  # a failed build leaves the graph


TEXT = """package p;

import a.B;
import java.util.Map;

class C {
    int one = 1, two = f(1, 2);
    private Map<String, Integer> map;

    // kept
    void f() { old(); }
    int f(int a, int b) { return a; }
}
"""


def test_edits_are_spliced():
    ops = [
        Operation("ADD_METHOD", "p.C", "g", "int", "return 1;"), Operation("REPLACE_METHOD_BODY", "p.C.f#f()", body="fresh();"), Operation("REMOVE_METHOD", "p.C.f#f(int,int)"), Operation("REMOVE_FIELD", "p.C.one"),
        Operation("REMOVE_FIELD", "p.C.map"), Operation("ADD_FIELD", "p.C", "three", "long"), Operation("ADD_IMPORT", "p.C", "c.D"), Operation("REMOVE_IMPORT", "p.C", "a.B"),
        Operation("REMOVE_METHOD", "p.C.none"), Operation("ADD_METHOD", "p.C", "bad", "int", "} {"), Operation("ADD_FIELD", "p.C", "two", "int"), Operation("REMOVE_IMPORT", "p.C", "x.Y"),
    ]
    text, results = edit_text("/w/C.java", TEXT, ops)
    assert [ok for ok, _, _ in results] == [True] * 8 + [False] * 4
    assert text == """package p;

import java.util.Map;
import c.D;

class C {
    int two = f(1, 2);

    // kept
    void f() { fresh(); }
    int g() { return 1; }
    private long three;
}
"""
    assert results[0][2] == "mth:p/C/g#g()"
    one, _ = edit_text("/w/C.java", TEXT, [Operation("REMOVE_FIELD", "p.C.two")])
    assert "int one = 1;" in one


def test_edit_syntax():
    assert parse_operation("ADD_METHOD:p.C:g|int|return 1;") == Operation("ADD_METHOD", "p.C", "g", "int", "return 1;")
    assert parse_operation("add_field:p.C:x:List<A>") == Operation("ADD_FIELD", "p.C", "x", "List<A>") and parse_operation("REMOVE_METHOD:p.C.f") == Operation("REMOVE_METHOD", "p.C.f")
    assert parse_operation('{"kind": "REMOVE_FIELD", "target": "p.C.x"}') == Operation("REMOVE_FIELD", "p.C.x")
    for bad in ("", "NOPE:x", "REMOVE_FIELD:", "{", "[1]", '{"kind": "ADD_FIELD"}', "ADD_METHOD:p.C"):
        with pytest.raises(BadOperation):
            parse_operation(bad)


def test_batches_of_edits_over_files(spark, shop):
    sources = spark.createDataFrame(rows(SHOP), "file string, text string")
    ops = [parse_operation(x) for x in ("ADD_FIELD:shop.Ledger:size:int", "REMOVE_METHOD:shop.Store.note", "REMOVE_FIELD:shop.Nope.x")]
    changed, results = apply_edits(shop, sources, ops)
    assert {r.file.rpartition("/")[2] for r in changed.collect()} == {"Ledger.java", "Store.java"}
    assert edit_summary(results).first().asDict() == {"applied": 3, "succeeded": 2, "failed": 1}
    assert "3 applied" in rendered(changed, results, "summary") and "-    void note(String s)" in rendered(changed, results, "diff") and len(json.loads(rendered(changed, results, "json"))) == 3
    again = graph_of(parse(changed.withColumnRenamed("after", "text")))
    assert "shop.Ledger.size" in {r.qualified_name for r in again.fields.collect()}
    untouched = {f: t for f, t in rows(SHOP)}
    assert all(r.before == untouched[r.file] for r in changed.collect())
