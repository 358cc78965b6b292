"""Graphs of small Java projects against expectations made by hand."""

import pytest

from strataloom.operators import coverage as T
from strataloom.operators import lookup as L
from strataloom.operators import text as X
from strataloom.operators.closure import call_paths
from strataloom.sources.java import build_graph, graph_of, parse, refresh_changed, update_file
from strataloom.sources.java_text import ParseFailure, read

SHOP = {
    "src/main/java/shop/Store.java": """package shop;
import shop.api.Sink;
public class Store extends Base implements Sink, Comparable<Store> {
    private static final int PORT = 9200, SPARE = -7;
    static final java.util.regex.Pattern SEP_PAT = java.util.regex.Pattern.compile("a|b");
    private final Ledger ledger = new Ledger("main");
    int count;
    public Store() { this(1); }
    Store(int n) { count = n; ledger.open(n); }
    @Override public void put(String item) throws StoreError {
        if (item == null) { throw new shop.StoreError("none"); }
        for (Entry e : ledger.all()) { e.mark(); }
        this.note(item);
    }
    void note(String s) { var l = new Ledger(s); l.open(PORT); }
    class Shelf { void tidy() { note("x"); count++; } }
    public int after() { return Limits.MOST; }
    public int compareTo(Store o) { return 0; }
}
""",
    "src/main/java/shop/Base.java": "package shop; abstract class Base { abstract void put(String item); }",
    "src/main/java/shop/api/Sink.java": "package shop.api; public interface Sink { void put(String item); default void twice(String s) { put(s); put(s); } }",
    "src/main/java/shop/Ledger.java": "package shop; class Ledger { Ledger(String n) {} void open(int n) {} java.util.List<Entry> all() { return null; } }",
    "src/main/java/shop/Entry.java": "package shop; record Entry(int id) { void mark() {} static Entry of(int i) { return new Entry(i); } }",
    "src/main/java/shop/Limits.java": "package shop; enum Limits { LOW(1), HIGH(20); static final int MOST = 3; Limits(int n) {} }",
    "src/main/java/shop/StoreError.java": "package shop; class StoreError extends Exception { StoreError(String m) { super(m); } }",
    "src/main/java/shop/Use.java": "package shop; class Use { void go(Base b) { b.put(\"q\"); } void far() { new Helper().help(); } }",
    "src/main/java/shop/Helper.java": "package shop; class Helper { void help() { new Store().note(\"h\"); } }",
    "src/main/java/shop/Broken.java": "package shop; class Broken { void (",
    "src/test/java/shop/StoreTest.java": "package shop; class StoreTest { void puts() { new Store().put(\"a\"); } void helped() { Helper h = new Helper(); h.help(); } }",
    "src/test/java/shop/ErrorTest.java": "package shop; class ErrorTest { void fails() { assertThrows(StoreError.class, () -> run()); } void run() {} }",
    "src/test/java/shop/OtherTest.java": "package shop; class OtherTest { void nothing() {} }",
}


def rows(files):
    return [(f"/w/{k}", v) for k, v in files.items()]


@pytest.fixture(scope="module")
def shop(spark):
    return graph_of(parse(spark.createDataFrame(rows(SHOP), "file string, text string")))


@pytest.fixture(scope="module")
def facts(shop):
    nodes = {r.id: r for r in shop.nodes.collect()}
    edges = {(r.type, r.src, r.dst) for r in shop.edges.collect()}
    return nodes, edges


def test_declarations(shop, facts):
    nodes, edges = facts
    store = nodes["cls:shop/Store"]
    assert (store.type, store.superclass, store.interfaces, store.modifiers) == ("CLASS", "shop.Base", ["shop.api.Sink", "shop.Comparable"], ["public"])
    assert nodes["cls:shop/api/Sink"].type == "INTERFACE" and nodes["cls:shop/Store$Shelf"].qualified_name == "shop.Store$Shelf"
    assert nodes["cls:shop/Entry"].superclass == "java.lang.Record" and nodes["cls:shop/Limits"].is_enum
    fields = {r.qualified_name: (r.data_type, r.is_static, r.is_final) for r in nodes.values() if r.type == "FIELD"}
    assert fields["shop.Store.PORT"] == ("int", True, True) and fields["shop.Store.SPARE"] == ("int", True, True)
    assert fields["shop.Limits.LOW"] == ("Limits", True, True) and "shop.Limits.MOST" not in fields
    put = nodes["mth:shop/Store/put#put(String)"]
    assert (put.signature, put.return_type, put.thrown, put.modifiers) == ("put(String)", "void", ["StoreError"], ["public"])
    assert nodes["mth:shop/Store/Store#Store(int)"].is_constructor and nodes["mth:shop/api/Sink/put#put(String)"].modifiers == ["abstract"]
    assert ("HAS_METHOD", "cls:shop/Store", "mth:shop/Store/after#after()") in edges  # after a nested type
    assert ("HAS_PARAMETER", put.id, "par:shop/Store/put#put(String):0") in edges
    assert {r.name for r in nodes.values() if r.type == "VARIABLE" and "Store" in r.owner} == {"e", "l", "h"}
    assert {r.name for r in nodes.values() if r.type == "PACKAGE"} == {"shop", "shop.api"}


def test_derived_edges(facts):
    _, edges = facts
    assert ("INHERITS", "cls:shop/Store", "cls:shop/Base") in edges and ("IMPLEMENTS", "cls:shop/Store", "cls:shop/api/Sink") in edges
    assert ("OVERRIDES", "mth:shop/Store/put#put(String)", "mth:shop/Base/put#put(String)") in edges
    assert ("REFERENCES_TYPE", "fld:shop/Store/ledger", "cls:shop/Ledger") in edges
    calls = {(s, d) for t, s, d in edges if t == "CALLS"}
    m = "mth:shop/"
    assert (m + "Store/Store#Store(int)", m + "Ledger/open#open(int)") in calls  # through a field
    assert (m + "Store/note#note(String)", m + "Ledger/open#open(int)") in calls  # through a local
    assert (m + "Store/put#put(String)", m + "Entry/mark#mark()") in calls and (m + "Store/put#put(String)", m + "Store/note#note(String)") in calls
    assert (m + "Store/put#put(String)", m + "StoreError/StoreError#StoreError(String)") in calls
    assert (m + "Use/go#go(Base)", m + "Store/put#put(String)") in calls  # dispatched below the abstract class
    assert (m + "api/Sink/twice#twice(String)", m + "Store/put#put(String)") in calls
    assert (m + "Use/far#far()", m + "Helper/help#help()") in calls  # new T().m()
    assert (m + "Store$Shelf/tidy#tidy()", m + "Store/note#note(String)") in calls


def test_side_tables(shop):
    values = {(r.value, r.class_fqn, r.field_name) for r in shop.table("values").collect()}
    assert {("9200", "shop.Store", "PORT"), ("7", "shop.Store", "SPARE"), ("a|b", "shop.Store", "SEP_PAT"), ("main", "shop.Store", "ledger"), ("20", "shop.Limits", "HIGH")} <= values
    used = {(r.field_qn, r.method_qn.split("#")[0], r.line) for r in shop.table("field_usages").collect()}
    assert ("shop.Store.PORT", "shop.Store.note", 15) in used and ("shop.Store.count", "shop.Store$Shelf.tidy", 16) in used and ("shop.Store.ledger", "shop.Store.put", 12) in used
    thrown = {(r.exception_name, r.method_qn.split("#")[0], r.is_assertion) for r in shop.table("exceptions").collect()}
    assert thrown == {("StoreError", "shop.Store.put", False), ("StoreError", "shop.ErrorTest.fails", True)}
    assert [r.file for r in shop.table("parse_errors").collect()] == ["/w/src/main/java/shop/Broken.java"]
    assert {r.class_fqn for r in X.literals_containing(shop.table("values"), "92").collect()} == {"shop.Store"}
    assert L.variables_in(shop, "shop.Store.note#note(String)").count() == 1


def test_coverage_of_parsed_tests(shop):
    got = {(r.test_class, r.link) for r in T.tests_for(shop, "shop.Store").collect()}
    assert got == {("shop.StoreTest", "call-graph"), ("shop.ErrorTest", "exception-link")}
    two = T.covered(shop, shop.spark.createDataFrame([("shop.Store",)], "target string")).where("link = 'call-graph-2hop'").collect()
    assert {(r.test_method.split("#")[0], r.covers) for r in two} >= {("shop.StoreTest.helped", "[2hop] note(String)")}


def test_path_over_three_classes(shop):
    ends = shop.spark.createDataFrame([("mth:shop/Use/far#far()", "mth:shop/Ledger/open#open(int)")], "src string, dst string")
    paths = {" ".join(p.rpartition("/")[2].partition("#")[0] for p in r.path) for r in call_paths(shop.calls, ends).collect()}
    assert "far help note open" in paths


def test_one_file_read_anew(shop):
    path = "/w/src/main/java/shop/Ledger.java"
    got, n = update_file(shop, path, "package shop; class Ledger { Ledger(String n) {} void open(long n) {} java.util.List<Entry> all() { return null; } void close() {} }")
    ids = {r.id for r in got.methods.select("id").collect()}
    assert "mth:shop/Ledger/close#close()" in ids and "mth:shop/Ledger/open#open(int)" not in ids
    calls = {(r.src, r.dst) for r in got.calls.collect()}
    assert ("mth:shop/Store/note#note(String)", "mth:shop/Ledger/open#open(long)") in calls
    assert n["added"] == n["removed"] + 1 and got.dangling().isEmpty()
    less, n = update_file(shop, path, None)
    assert n["added"] == 0 and n["removed"] > 0 and less.dangling().isEmpty()


def test_changed_files_only(spark, shop):
    at = "file string, mtime int"
    before = spark.createDataFrame([(f, 1) for f, _ in rows(SHOP)], at)
    new = {**SHOP, "src/main/java/shop/Helper.java": "package shop; class Helper { void help() {} void more() { new Entry(1).mark(); } }"}
    del new["src/main/java/shop/Use.java"]
    after = spark.createDataFrame([(f, 2 if "Helper" in f else 1) for f, _ in rows(new)], at)
    got = refresh_changed(shop, before, after, spark.createDataFrame(rows(new), "file string, text string"))
    whole = graph_of(parse(spark.createDataFrame(rows(new), "file string, text string")))
    edges = lambda g: {(r.type, r.src, r.dst) for r in g.edges.collect()}
    assert edges(got) == edges(whole) and {r.id for r in got.nodes.collect()} == {r.id for r in whole.nodes.collect()}


def test_project_folders(spark, tmp_path):
    for name, text in SHOP.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert build_graph(spark, str(tmp_path)).classes.where("name like '%Test'").count() == 3
    assert build_graph(spark, str(tmp_path), tests=False, exclude=("*Limits*",)).classes.where("name like '%Test' or name = 'Limits'").isEmpty()


MODERN = """package p;
import static java.util.Map.entry;
@Deprecated(since = "1")
public sealed interface Shape permits Shape.Circle, Shape.Box {
    record Circle(@Deprecated double r) implements Shape { Circle { if (r < 0) throw new IllegalArgumentException(); } }
    non-sealed class Box<T extends Comparable<? super T>> implements Shape { T[] parts; int[][] grid = {{1}, {2}}; String text = \"\"\"
        a "quoted" \\\\ block
        \"\"\"; }
    default double area(Object o) {
        return switch (o) {
            case Circle c when c.r() > 1 -> { yield c.r() * 2; }
            case Box<?> b -> b.size();
            default -> 0.0;
        };
    }
    static <A, B extends A> java.util.Map<A, java.util.List<B>> of(A a, B... bs) throws java.io.IOException {
        interface Local { int x(); }
        var record = 1; int yield2 = 2, sealed = 3;
        Runnable r = () -> System.out.println(record), s = Shape::new;
        try (var in = new java.io.StringReader("x"); in) { in.read(); } catch (RuntimeException | Error e) { e.printStackTrace(); }
        int shift = 1 >>> 2 << 3; boolean q = record < sealed && sealed > 2; char c = '\\'', d = '\\u0041';
        return new java.util.HashMap<A, java.util.List<B>>() {{ put(null, null); }};
    }
    enum Kind implements Runnable { A { public void run() {} }, B(2) { public void run() { go(); } }; Kind(int... n) {} public void run() {} }
    @interface Mark { String[] value() default {}; }
}
"""


def test_modern_syntax():
    got = read("/w/p/Shape.java", MODERN)
    names = {r["qualified_name"] for r in got["nodes"]}
    assert {"p.Shape", "p.Shape$Circle", "p.Shape$Box", "p.Kind", "p.Kind.A", "p.Shape$Box.grid", "p.Shape.of#of(A,B)", "p.Shape.area#area(Object)"} <= names
    sites = {(r["receiver_type"], r["method_name"]) for r in got["call_sites"]}
    assert {("Circle", "r"), ("Box", "size"), (None, "put"), (None, "go"), ("java.io.StringReader", "read")} <= sites
    local = {r["name"] for r in got["nodes"] if r["type"] == "VARIABLE"}
    assert {"record", "yield2", "sealed", "shift", "q", "c", "d", "r", "s", "in"} <= local
    for bad in ("class", "class A {", "class A { int x = ; ", "package ;", "nonsense", "class A { void f() { }", "class A { # }"):
        with pytest.raises(ParseFailure):
            read("/w/A.java", bad)
    assert read("/w/E.java", "")["nodes"] == [] and read("/w/E.java", "// only a comment\n")["nodes"] == []
    many = "class A { int x = " + "(" * 20_000 + "1" + ")" * 20_000 + "; }"
    assert read("/w/A.java", many)["values"][0]["value"] == "1"
