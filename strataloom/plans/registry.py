"""The engine's registered queries over the benchmark tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import closure as C
from strataloom.operators import coverage as T
from strataloom.operators import lookup as L
from strataloom.operators import mutate as M
from strataloom.operators import rank as R
from strataloom.operators import resolve as B
from strataloom.operators import text as X
from strataloom.operators import trace as E
from strataloom.functions.identifiers import is_test_class, segments, stem
from strataloom.graph import CodeGraph
from strataloom.operators.build import build_summary
from strataloom.plans import batch
from strataloom.plans.derived import base_views, graph, relation, used
from strataloom.plans.router import Router

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = used(oracle)
        return f

    return keep


def on_graph(name: str, oracle: str | None = None):
    """Registers f(g), g the derived graph."""

    def keep(f):
        query(name, oracle)(lambda spark, sf_dir: f(graph(spark, sf_dir)))
        return f

    return keep


def on_relation(name: str, rel: str, oracle: str | None = None):
    def keep(f):
        query(name, oracle)(lambda spark, sf_dir: f(relation(spark, sf_dir, rel)))
        return f

    return keep


def value(g: CodeGraph, sql: str) -> str:
    """One value that names what to look up; 'none' where there is none."""
    if sql in (BUSY, POPULAR):
        return g.busiest("src" if sql == BUSY else "dst", sql) or "none"
    row = g.sql(sql).first()
    return row[0] if row is not None and row[0] is not None else "none"


ROOT = "SELECT min(qn) FROM d_class WHERE k = 0"
KID = "SELECT min(qn) FROM d_class WHERE k = 5"
IFACE = "SELECT min(c.iface) FROM d_class c"
NAME = "SELECT name FROM d_class GROUP BY name ORDER BY count(*) DESC, name LIMIT 1"
BUSY = "SELECT src FROM d_calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1"
POPULAR = "SELECT dst FROM d_calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1"
CLASS = ["qualified_name", "type", "file"]
METHOD = ["id", "owner", "signature"]
_CLS = "SELECT qn AS qualified_name, type, file FROM d_class"
_MTH = "SELECT id, owner, signature FROM d_meth"

# --- lookups -----------------------------------------------------------------------------
on_graph("class_by_name", f"{_CLS} WHERE qn = ({ROOT})")(lambda g: L.class_by_name(g, value(g, ROOT)).select(*CLASS))
on_graph("classes_by_simple_name", f"{_CLS} WHERE name = ({NAME})")(lambda g: L.classes_by_simple_name(g, value(g, NAME)).select(*CLASS))
on_graph("all_classes", _CLS)(lambda g: g.classes.select(*CLASS))
on_graph("all_methods", _MTH)(lambda g: g.methods.select(*METHOD))
on_graph("all_fields", "SELECT qn AS qualified_name, data_type FROM d_field")(lambda g: g.fields.select("qualified_name", "data_type"))
on_graph("all_packages", "SELECT DISTINCT pkg AS name FROM d_class")(lambda g: g.of_type("PACKAGE").select("name"))
on_graph("superclass_of", f"{_CLS} WHERE qn = (SELECT superclass FROM d_class WHERE qn = ({KID}))")(lambda g: L.superclass(g, value(g, KID)).select(*CLASS))
on_graph("interfaces_of", f"{_CLS} WHERE qn = (SELECT iface FROM d_class WHERE qn = (SELECT min(qn) FROM d_class WHERE iface IS NOT NULL))")(
    lambda g: L.interfaces_of(g, value(g, "SELECT min(qn) FROM d_class WHERE iface IS NOT NULL")).select(*CLASS)
)
SIG = "SELECT min(signature) FROM d_meth"
on_graph("method_by_signature", f"{_MTH} WHERE id = (SELECT min(id) FROM d_meth WHERE signature = ({SIG}))")(lambda g: L.method_by_signature(g, value(g, SIG)).select(*METHOD))
on_graph("methods_by_name", f"{_MTH} WHERE name = (SELECT min(name) FROM d_meth)")(lambda g: L.methods_by_name(g, value(g, "SELECT min(name) FROM d_meth")).select(*METHOD))
on_graph("methods_of_class", f"{_MTH} WHERE owner = ({ROOT})")(lambda g: L.methods_of(g, value(g, ROOT)).select(*METHOD))
on_graph("constructors_of_class", f"{_MTH} WHERE owner = ({ROOT}) AND is_ctor")(lambda g: L.constructors_of(g, value(g, ROOT)).select(*METHOD))
on_graph("static_methods_of_class", f"{_MTH} WHERE owner = ({ROOT}) AND is_static")(lambda g: L.static_of(L.methods_of(g, value(g, ROOT))).select(*METHOD))
on_graph("public_methods_of_class", f"{_MTH} WHERE owner = ({ROOT}) AND mods LIKE '%public%'")(lambda g: L.with_modifier(L.methods_of(g, value(g, ROOT)), "public").select(*METHOD))
on_graph("fields_of_class", f"SELECT qn AS qualified_name, data_type FROM d_field WHERE owner = ({ROOT})")(lambda g: L.fields_of(g, value(g, ROOT)).select("qualified_name", "data_type"))
on_graph("static_fields_of_class", f"SELECT qn AS qualified_name, data_type FROM d_field WHERE owner = ({ROOT}) AND is_static")(lambda g: L.static_of(L.fields_of(g, value(g, ROOT))).select("qualified_name", "data_type"))
on_graph("final_fields_of_class", f"SELECT qn AS qualified_name, data_type FROM d_field WHERE owner = ({ROOT}) AND is_final")(lambda g: L.final_of(L.fields_of(g, value(g, ROOT))).select("qualified_name", "data_type"))
on_graph("field_by_name", "SELECT qn AS qualified_name, data_type FROM d_field WHERE qn = (SELECT min(qn) FROM d_field)")(lambda g: L.field_by_name(g, value(g, "SELECT min(qn) FROM d_field")).select("qualified_name", "data_type"))
on_graph("field_usages", "SELECT field_qn, method_qn, file, line FROM d_usage WHERE field_qn = (SELECT min(field_qn) FROM d_usage)")(lambda g: L.field_accesses(g, value(g, "SELECT min(field_qn) FROM d_usage")))
on_graph("direct_callers", f"{_MTH} WHERE id IN (SELECT src FROM d_calls WHERE dst = ({POPULAR}))")(lambda g: L.call_neighbours(g, value(g, POPULAR), True).select(*METHOD))
on_graph("direct_callees", f"{_MTH} WHERE id IN (SELECT dst FROM d_calls WHERE src = ({BUSY}))")(lambda g: L.call_neighbours(g, value(g, BUSY), False).select(*METHOD))
on_graph("nodes_in_file", f"SELECT id, type FROM d_nodes WHERE file = (SELECT file FROM d_class WHERE qn = ({ROOT}))")(lambda g: L.in_file(g, value(g, f"SELECT file FROM d_class WHERE qn = ({ROOT})")).select("id", "type"))
on_graph("methods_in_file", f"SELECT id, type FROM d_nodes WHERE type = 'METHOD' AND file = (SELECT file FROM d_class WHERE qn = ({ROOT}))")(
    lambda g: L.in_file(g, value(g, f"SELECT file FROM d_class WHERE qn = ({ROOT})"), "METHOD").select("id", "type")
)
PKG = "SELECT min(pkg) FROM d_class"
on_graph("package_by_name", f"SELECT DISTINCT pkg AS name FROM d_class WHERE pkg = ({PKG})")(lambda g: L.package_by_name(g, value(g, PKG)).select("name"))
on_graph("classes_in_package", f"{_CLS} WHERE pkg = ({PKG})")(lambda g: L.classes_in_package(g, value(g, PKG)).select(*CLASS))
on_graph("nodes_by_type", "SELECT id, name FROM d_nodes WHERE type = 'INTERFACE'")(lambda g: L.of_types(g, "INTERFACE").select("id", "name"))
on_graph("edges_by_type", "SELECT src, dst, type FROM d_edges WHERE type = 'INHERITS'")(lambda g: L.edges_of(g, kind="INHERITS").select("src", "dst", "type"))
on_graph("edges_from_node", f"SELECT src, dst, type FROM d_edges WHERE src = ({BUSY})")(lambda g: L.edges_of(g, src=value(g, BUSY)).select("src", "dst", "type"))
on_graph("edges_to_node", f"SELECT src, dst, type FROM d_edges WHERE dst = ({POPULAR})")(lambda g: L.edges_of(g, dst=value(g, POPULAR)).select("src", "dst", "type"))
on_graph("nodes_with_modifier", "SELECT id, type FROM d_nodes WHERE type <> 'PACKAGE' AND mods LIKE '%abstract%'")(lambda g: L.with_modifier(g.nodes, "abstract").select("id", "type"))
on_graph("simple_type_of_fields", "SELECT qn AS qualified_name, split_part(data_type, '.', -1) AS simple_type FROM d_field")(lambda g: L.derived_names(g.fields).select("qualified_name", "simple_type"))
on_graph("package_of_classes", "SELECT qn AS qualified_name, pkg AS class_name, 'com.' || split_part(pkg, '.', 2) AS package_name FROM d_class")(lambda g: L.derived_names(g.classes).select("qualified_name", "class_name", "package_name"))
on_graph("list_classes_of_package", "SELECT qn AS qualified_name, name, type, (SELECT count(*) FROM d_class WHERE qn LIKE 'com.brand2.%') AS total FROM d_class WHERE qn LIKE 'com.brand2.%' ORDER BY qn LIMIT 10")(
    lambda g: L.list_classes(g, package="com.brand2", limit=10)
)
on_graph("search_name", f"SELECT 'class' AS kind, qn AS qualified_name, id FROM d_class WHERE name = ({NAME})")(lambda g: L.search(g, value(g, NAME)))
on_graph("search_method_fallback", "SELECT 'method' AS kind, key AS qualified_name, id FROM d_meth WHERE name = (SELECT min(name) FROM d_meth)")(lambda g: L.search(g, value(g, "SELECT min(name) FROM d_meth")))
on_graph("nodes_where", "SELECT id, (SELECT count(*) FROM d_nodes WHERE type = 'INTERFACE') AS total FROM d_nodes WHERE type = 'INTERFACE' ORDER BY id LIMIT 100")(lambda g: L.nodes_where(g, kind="INTERFACE", limit=100).select("id", "total"))
on_graph("relative_paths", "SELECT id, substr(file, 4) AS rel FROM d_class")(lambda g: g.classes.select("id", L.relative("file", "/w").alias("rel")))

# --- building -------------------------------------------------------------------------------
on_graph("graph_build", "SELECT 0 AS files, (SELECT count(*) FROM d_nodes) AS nodes, (SELECT count(*) FROM d_edges) AS edges, 0 AS dangling")(build_summary)  # the first query of a folder stores its graph


# --- counts ---------------------------------------------------------------------------------
on_graph("totals", "SELECT (SELECT count(*) FROM d_nodes) AS total_nodes, (SELECT count(*) FROM d_edges) AS total_edges")(L.totals)
on_graph("node_counts_by_type", "SELECT type, count(*) AS n FROM d_nodes GROUP BY type")(lambda g: L.counts_by_type(g.nodes))
on_graph("edge_counts_by_type", "SELECT type, count(*) AS n FROM d_edges GROUP BY type")(lambda g: L.counts_by_type(g.edges))
_MEMBERS = """SELECT c.qn AS qualified_name, coalesce(m.n, 0) AS method_count, coalesce(f.n, 0) AS field_count FROM d_class c
    LEFT JOIN (SELECT owner, count(DISTINCT id) AS n FROM d_meth GROUP BY owner) m ON m.owner = c.qn LEFT JOIN (SELECT owner, count(DISTINCT id) AS n FROM d_field GROUP BY owner) f ON f.owner = c.qn"""
on_graph("members_per_class", _MEMBERS)(L.member_counts)
on_graph("class_detail", f"SELECT x.qualified_name, c.type, c.superclass, c.file, x.method_count, x.field_count FROM ({_MEMBERS}) x JOIN d_class c ON c.qn = x.qualified_name WHERE c.qn = ({KID})")(lambda g: L.class_detail(g, value(g, KID)))
on_graph("call_counts", "SELECT count(*) AS call_count, count(DISTINCT src) + count(DISTINCT dst) AS method_count FROM d_calls")(L.call_counts)

# --- recursion ---------------------------------------------------------------------------------
_REACH = """WITH walk(node, depth) AS (SELECT {b}, 1 FROM d_calls WHERE {a} = ({start}) UNION SELECT c.{b}, w.depth + 1 FROM walk w JOIN d_calls c ON c.{a} = w.node WHERE w.depth < {depth})
    SELECT node, min(depth) AS depth FROM walk GROUP BY node"""
on_graph("transitive_callees", _REACH.format(a="src", b="dst", start=BUSY, depth=10))(lambda g: C.callees(g.calls, value(g, BUSY), True))
on_graph("transitive_callers", _REACH.format(a="dst", b="src", start=POPULAR, depth=10))(lambda g: C.callers(g.calls, value(g, POPULAR), True))
on_graph("callees_within_two", _REACH.format(a="src", b="dst", start=BUSY, depth=2))(lambda g: C.callees(g.calls, value(g, BUSY), True, 2))
_TREE = """WITH up(src, dst) AS ({up}), walk(node, depth) AS (SELECT src, 1 FROM up WHERE dst = ({root}) UNION SELECT u.src, w.depth + 1 FROM walk w JOIN up u ON u.dst = w.node WHERE w.depth < 40)
    SELECT node AS qualified_name, min(depth) AS depth FROM walk WHERE node <> ({root}) GROUP BY node"""
_SUPER = "SELECT qn, superclass FROM d_class WHERE superclass IS NOT NULL AND superclass <> qn"
_BOTH = f"{_SUPER} UNION SELECT qn, iface FROM d_class WHERE iface IS NOT NULL AND iface <> qn"
on_graph("subclasses", _TREE.format(up=_SUPER, root=KID))(lambda g: L.subclasses(g, value(g, KID)).select("qualified_name", "depth"))
on_graph("direct_subclasses", f"SELECT qn AS qualified_name, 1 AS depth FROM d_class WHERE superclass = ({KID})")(lambda g: L.subclasses(g, value(g, KID), direct=True).select("qualified_name", "depth"))
on_graph("implementations", _TREE.format(up=_BOTH, root=IFACE))(lambda g: L.implementations(g, value(g, IFACE)).select("qualified_name", "depth"))
_PATHS = f"""WITH ends(a, b) AS (SELECT src, dst FROM (SELECT x.src AS src, y.dst AS dst FROM d_calls x JOIN d_calls y ON y.src = x.dst WHERE x.src <> y.dst) z ORDER BY 1, 2 LIMIT 1),
    walk(node, path, hops) AS (SELECT a, '|' || a || '|', 0 FROM ends UNION ALL SELECT c.dst, w.path || c.dst || '|', w.hops + 1 FROM walk w JOIN d_calls c ON c.src = w.node
    WHERE w.hops < 5 AND w.node <> (SELECT b FROM ends) AND position('|' || c.dst || '|' IN w.path) = 0)
    SELECT path, hops FROM walk WHERE node = (SELECT b FROM ends)"""
_ENDS = "SELECT src, dst FROM (SELECT x.src AS src, y.dst AS dst FROM d_calls x JOIN d_calls y ON y.src = x.dst WHERE x.src <> y.dst) z ORDER BY 1, 2 LIMIT 1"


@on_graph("call_paths", _PATHS)
def _paths(g: CodeGraph) -> DataFrame:
    got = C.call_paths(g.calls, g.sql(_ENDS), 5)
    return got.select(F.concat(F.lit("|"), F.array_join("path", "|"), F.lit("|")).alias("path"), "hops")


_LABELS = _PATHS.replace("SELECT path, hops FROM walk WHERE node = (SELECT b FROM ends)", "") + """, few AS (SELECT path, hops, row_number() OVER (ORDER BY hops, replace(substr(path, 2, length(path) - 2), '|', ' > ')) AS rn FROM walk WHERE node = (SELECT b FROM ends)),
    step AS (SELECT rn, hops, unnest(string_split(substr(path, 2, length(path) - 2), '|')) AS id, generate_subscripts(string_split(substr(path, 2, length(path) - 2), '|'), 1) AS pos FROM few WHERE rn <= 10)
    SELECT string_agg(coalesce(m.key, s.id), ' -> ' ORDER BY s.pos) AS label, max(s.hops) AS hops FROM step s LEFT JOIN d_meth m ON m.id = s.id GROUP BY s.rn"""
on_graph("call_path_labels", _LABELS)(lambda g: C.labelled_paths(C.call_paths(g.calls, g.sql(_ENDS), 5), g.methods))
_ABOVE = "WITH up(lo, hi) AS ({up}), walk(lo, hi, depth) AS (SELECT lo, hi, 1 FROM up UNION SELECT w.lo, u.hi, w.depth + 1 FROM walk w JOIN up u ON u.lo = w.hi WHERE w.depth < 40)"
on_graph("ancestors_of_all", _ABOVE.format(up=_BOTH) + " SELECT lo AS start, hi AS node, min(depth) AS depth FROM walk GROUP BY lo, hi")(lambda g: C.ancestors_of_all(g.classes))
on_graph("override_edges", _ABOVE.format(up=_BOTH) + " SELECT DISTINCT a.id AS src, b.id AS dst, 'OVERRIDES' AS type FROM (SELECT DISTINCT lo, hi FROM walk) w JOIN d_meth a ON a.owner = w.lo AND NOT a.is_ctor JOIN d_meth b ON b.owner = w.hi AND b.signature = a.signature AND NOT b.is_ctor")(B.override_edges)
_OVR = "SELECT a.owner || '!' || a.signature FROM d_meth a JOIN d_class c ON c.qn = a.owner JOIN d_meth b ON b.owner = c.superclass AND b.signature = a.signature ORDER BY 1 LIMIT 1"
on_graph("overridden_method", f"SELECT b.id, b.owner, b.signature FROM d_class c JOIN d_meth b ON b.owner = c.superclass WHERE c.qn || '!' || b.signature = ({_OVR})")(lambda g: L.overridden(g, *(value(g, _OVR) + "!").split("!")[:2]).select(*METHOD))
_OVD = "SELECT b.owner || '!' || b.signature FROM d_meth a JOIN d_class c ON c.qn = a.owner JOIN d_meth b ON b.owner = c.superclass AND b.signature = a.signature ORDER BY 1 LIMIT 1"
on_graph("overriding_methods", _ABOVE.format(up=_SUPER) + f" SELECT a.id, a.owner, a.signature, min(w.depth) AS depth FROM walk w JOIN d_meth a ON a.owner = w.lo WHERE w.hi || '!' || a.signature = ({_OVD}) GROUP BY 1, 2, 3")(
    lambda g: L.overriding(g, *(value(g, _OVD) + "!").split("!")[:2]).select(*METHOD, "depth")
)
on_graph("hierarchy_edges", "SELECT c.id AS src, p.id AS dst, 'INHERITS' AS type FROM d_class c JOIN d_class p ON p.qn = c.superclass WHERE p.qn <> c.qn UNION SELECT c.id, p.id, 'IMPLEMENTS' FROM d_class c JOIN d_class p ON p.qn = c.iface WHERE p.qn <> c.qn")(
    lambda g: B.hierarchy_edges(g.classes)
)
_OPEN = "SELECT m.id, m.owner, m.signature, m.mods LIKE '%abstract%' AS abs, c.type = 'INTERFACE' OR c.mods LIKE '%abstract%' AS op, c.type AS ctype FROM d_meth m JOIN d_class c ON c.qn = m.owner"
on_graph("dispatch_calls", _ABOVE.format(up=_BOTH) + f""", m AS ({_OPEN}), near AS (SELECT lo, hi, min(depth) AS depth FROM walk GROUP BY lo, hi),
    cand AS (SELECT k.src, k.dst, b.id AS new, row_number() OVER (PARTITION BY k.src, k.dst ORDER BY n.depth, b.owner, b.id) AS rn FROM d_calls k JOIN m a ON a.id = k.dst AND (a.abs OR a.op)
    JOIN near n ON n.hi = a.owner JOIN m b ON b.owner = n.lo AND b.signature = a.signature AND NOT b.abs AND b.ctype <> 'INTERFACE' WHERE b.id <> k.src AND NOT EXISTS (SELECT 1 FROM d_calls x WHERE x.src = k.src AND x.dst = b.id))
    SELECT DISTINCT src, new AS dst FROM cand WHERE rn <= 50""")(B.dispatch_calls)

# --- resolution -----------------------------------------------------------------------------------
_SITES = """SELECT a.id AS caller_id, a.owner AS caller_class, CASE a.sk % 3 WHEN 0 THEN b.owner WHEN 1 THEN c.name END AS receiver_type, b.name AS method_name
    FROM d_calls k JOIN d_meth a ON a.id = k.src JOIN d_meth b ON b.id = k.dst JOIN d_class c ON c.qn = b.owner"""


@on_graph("call_resolution", f"""WITH s AS (SELECT DISTINCT * FROM ({_SITES}) q), t AS (
    SELECT s.*, s.receiver_type AS cls FROM s WHERE position('.' IN receiver_type) > 0 UNION ALL SELECT s.*, caller_class FROM s WHERE receiver_type IS NULL
    UNION ALL SELECT s.*, c.qn FROM s JOIN d_class c ON c.name = s.receiver_type JOIN d_class o ON o.qn = s.caller_class WHERE position('.' IN s.receiver_type) = 0
      AND (c.pkg = o.pkg OR NOT EXISTS (SELECT 1 FROM d_class z WHERE z.name = s.receiver_type AND z.pkg = o.pkg))),
    hit AS (SELECT t.caller_id, t.receiver_type, t.method_name, m.id AS dst FROM t JOIN d_meth m ON m.owner = t.cls AND m.name = t.method_name),
    one AS (SELECT name, min(id) AS dst FROM d_meth GROUP BY name HAVING count(*) = 1)
    SELECT caller_id AS src, dst FROM hit UNION SELECT s.caller_id, one.dst FROM s JOIN one ON one.name = s.method_name
    WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.caller_id = s.caller_id AND h.method_name = s.method_name AND h.receiver_type IS NOT DISTINCT FROM s.receiver_type)""")
def _call_resolution(g: CodeGraph) -> DataFrame:
    return B.resolve_calls(g.sites(_SITES), g.methods, g.classes)


_MENTIONS = "SELECT f.id AS node_id, CASE f.n % 3 WHEN 0 THEN c.qn WHEN 1 THEN c.name || '<T>[]' ELSE 'int' END AS type_name, f.file AS file FROM d_field f JOIN d_class c ON c.qn = f.owner"
_FILES = "SELECT DISTINCT file, pkg AS package FROM d_class"


@on_graph("type_references", f"SELECT DISTINCT f.id AS src, f.class_id AS dst, 'REFERENCES_TYPE' AS type FROM d_field f WHERE f.n % 3 <> 2")
def _type_references(g: CodeGraph) -> DataFrame:
    files = g.sql(_FILES).withColumn("imports", F.array().cast("array<string>"))
    return B.references(g.sql(_MENTIONS), g.classes, files)


_DANGLING = "SELECT src, dst, type FROM d_edges WHERE src NOT IN (SELECT id FROM d_nodes) OR dst NOT IN (SELECT id FROM d_nodes)"
on_graph("dangling_edges", _DANGLING)(lambda g: g.dangling().select("src", "dst", "type"))
_SHORT = "SELECT src, dst, type FROM d_edges WHERE (src NOT IN (SELECT id FROM d_nodes WHERE type <> 'FIELD') OR dst NOT IN (SELECT id FROM d_nodes WHERE type <> 'FIELD'))"
on_graph("dangling_without_fields", _SHORT)(lambda g: g.with_tables(nodes=g.nodes.where("type <> 'FIELD'")).dangling().select("src", "dst", "type"))

# --- text -----------------------------------------------------------------------------------------
_TOK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '[._-]', ' ', 'g')"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TRIM = "regexp_replace({x}, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')"
_POST = f"""txt AS (SELECT page_id AS node_id, url AS t FROM pages WHERE url IS NOT NULL), raw AS (SELECT node_id, unnest(string_split_regex({_TOK.format(x='t')}, '\\s+')) AS w FROM txt UNION ALL SELECT node_id, t FROM txt WHERE NOT regexp_matches(t, '\\s')),
    post AS (SELECT DISTINCT lower({_TRIM.format(x='w')}) AS token, node_id FROM raw WHERE length({_TRIM.format(x='w')}) BETWEEN 2 AND 64 AND lower({_TRIM.format(x='w')}) NOT IN ({_STOP}))"""


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.postings_of(relation(spark, sf_dir, "pages").select(F.col("page_id").alias("node_id"), F.col("url").alias("text")))


query("text_postings", f"WITH {_POST} SELECT token, node_id FROM post")(_postings)
query("text_search_token", f"WITH {_POST} SELECT DISTINCT node_id FROM post WHERE token = 'example'")(lambda s, d: X.search_token(_postings(s, d), "Example"))
query("text_search_all", f"WITH {_POST} SELECT node_id FROM post WHERE token IN ('example', 'en') GROUP BY node_id HAVING count(DISTINCT token) = 2")(lambda s, d: X.search_all(_postings(s, d), ["en", "example", " "]))
query("text_search_any", f"WITH {_POST} SELECT DISTINCT node_id FROM post WHERE token IN ('org', 'fr')")(lambda s, d: X.search_any(_postings(s, d), ["org", "fr"]))
query("text_search_phrase", f"WITH {_POST} SELECT node_id FROM post WHERE token IN ('example', 'net') GROUP BY node_id HAVING count(DISTINCT token) = 2")(lambda s, d: X.search_query(_postings(s, d), '"example.net"'))
query("text_search_or_query", f"WITH {_POST} SELECT DISTINCT node_id FROM post WHERE token IN ('org', 'net')")(lambda s, d: X.search_query(_postings(s, d), "org or net"))
query("text_tokens_of_node", f"WITH {_POST} SELECT token FROM post WHERE node_id = 1")(lambda s, d: X.tokens_of(_postings(s, d), 1))
query("text_index_stats", f"WITH {_POST} SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT token) AS tokens, count(*) AS postings FROM post")(lambda s, d: X.index_stats(_postings(s, d)))
query("text_nodes_per_token", f"WITH {_POST} SELECT token, count(DISTINCT node_id) AS n FROM post GROUP BY token")(lambda s, d: X.nodes_per_token(_postings(s, d)))
query("text_unindex", f"WITH {_POST} SELECT token, node_id FROM post WHERE node_id NOT IN (SELECT page_id FROM pages WHERE url LIKE '%.org%')")(lambda s, d: X.unindex(_postings(s, d), s.table("pages").where("url like '%.org%'").select(F.col("page_id").alias("id"))))
_NODE_TXT = " UNION ALL ".join(f"SELECT id AS node_id, {x} AS t FROM d_nodes WHERE {x} IS NOT NULL" for x in ("type", "file", "name", "qualified_name", "CASE WHEN position('.' IN qualified_name) > 0 THEN regexp_extract(qualified_name, '^(.*)\\.', 1) END"))
_NODE_POST = _POST.replace("SELECT page_id AS node_id, url AS t FROM pages WHERE url IS NOT NULL", _NODE_TXT)
on_graph("node_postings", f"WITH {_NODE_POST} SELECT token, node_id FROM post")(lambda g: X.index_nodes(g.nodes, unique=g.unique))
on_graph("node_search_all", f"WITH {_NODE_POST} SELECT node_id FROM post WHERE token IN ('red', 'widget') GROUP BY node_id HAVING count(DISTINCT token) = 2")(lambda g: X.search_nodes(g.nodes, ["red", "widget"]))
_DOC_POST = _POST.replace("SELECT page_id AS node_id, url AS t FROM pages WHERE url IS NOT NULL", "SELECT doc_id AS node_id, text AS t FROM documents WHERE text IS NOT NULL")
query("document_index_stats", f"WITH {_DOC_POST} SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT token) AS tokens, count(*) AS postings FROM post")(
    lambda s, d: X.index_stats(X.postings_of(relation(s, d, "documents").select(F.col("doc_id").alias("node_id"), "text")))
)
query("document_literal_search", "SELECT CAST(doc_id AS STRING) AS class_fqn, source AS file, CAST(length(value) AS BIGINT) AS n FROM (SELECT doc_id, source, text AS value FROM documents) d WHERE value LIKE '%license%' ORDER BY file, class_fqn, value LIMIT 20")(
    lambda s, d: X.literals_containing(
        relation(s, d, "documents").select(F.col("text").alias("value"), F.col("doc_id").cast("string").alias("class_fqn"), F.lit("text").alias("field_name"), F.col("source").alias("file"), F.lit(0).alias("line")), "license"
    ).select("class_fqn", "file", F.length("value").cast("long").alias("n"))
)
on_graph("names_containing", "SELECT id, type FROM d_nodes WHERE type IN ('CLASS', 'METHOD') AND lower(name) LIKE '%widget%'")(lambda g: X.names_containing(g.nodes, "Widget").select("id", "type"))
on_graph("literal_search", "SELECT value, class_fqn, field_name, file, line FROM d_value WHERE value LIKE '%PROMO%' ORDER BY file, line, class_fqn, field_name, value LIMIT 20")(lambda g: X.literals_containing(g.table("values"), "PROMO"))

# --- coverage --------------------------------------------------------------------------------------
_ISTEST = "CASE WHEN file LIKE '%/src/main/%' OR file LIKE 'src/main/%' THEN false WHEN name LIKE '%Test' OR name LIKE '%Tests' OR name LIKE '%IT' OR name LIKE '%TestCase' OR name LIKE 'Test%' THEN true ELSE file LIKE '%/test/%' OR file LIKE '%/internalClusterTest/%' END"
_COVER = f"""cl AS (SELECT qn, name, {_ISTEST} AS t FROM d_class), tm AS (SELECT m.id, m.owner, m.key FROM d_meth m JOIN cl ON cl.qn = m.owner AND cl.t), pm AS (SELECT m.id, m.owner, m.signature, m.key FROM d_meth m JOIN cl ON cl.qn = m.owner AND NOT cl.t),
    c1 AS (SELECT pm.owner AS target, tm.owner AS test_class, tm.key AS test_method, pm.signature AS covers, 'call-graph' AS link FROM d_calls k JOIN tm ON tm.id = k.src JOIN pm ON pm.id = k.dst),
    hp AS (SELECT tm.id, tm.owner AS test_class, tm.key AS test_method, k.dst, h.owner AS hc, row_number() OVER (PARTITION BY tm.id ORDER BY k.dst) AS rn FROM d_calls k JOIN tm ON tm.id = k.src JOIN d_meth h ON h.id = k.dst),
    c2 AS (SELECT pm.owner AS target, hp.test_class, hp.test_method, '[2hop] ' || pm.signature AS covers, 'call-graph-2hop' AS link FROM hp JOIN d_calls k ON k.src = hp.dst JOIN pm ON pm.id = k.dst WHERE hp.hc <> pm.owner AND hp.rn - (SELECT count(*) FROM hp o WHERE o.id = hp.id AND o.hc = pm.owner AND o.rn < hp.rn) <= 50),
    c3 AS (SELECT DISTINCT pm.owner AS target, tm.owner AS test_class, tm.key AS test_method, '[throws ' || a.exception_name || ']' AS covers, 'exception-link' AS link FROM d_exception a JOIN tm ON tm.key = a.method_qn AND a.is_assertion
      JOIN d_exception b ON b.exception_name = a.exception_name AND NOT b.is_assertion JOIN pm ON pm.key = b.method_qn),
    c4 AS (SELECT p.qn AS target, q.qn AS test_class, CAST(NULL AS STRING) AS test_method, CAST(NULL AS STRING) AS covers, 'name-convention' AS link FROM cl p JOIN cl q ON NOT p.t AND q.t AND position(lower(p.name) IN lower(q.name)) > 0),
    cov AS (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3 UNION SELECT * FROM c4)"""
_TARGET = "SELECT min(qn) FROM d_class WHERE size % 5 <> 0"
on_graph("is_test_class", f"SELECT qn AS qualified_name, {_ISTEST} AS is_test FROM d_class")(lambda g: g.classes.select("qualified_name", is_test_class("file", "name").alias("is_test")))
on_graph("coverage_of_class", f"WITH {_COVER} SELECT target, test_class, test_method, covers, link FROM cov WHERE target = ({_TARGET})")(lambda g: T.covered(g, g.sql(_TARGET).toDF("target")))
on_graph("coverage_by_calls", f"WITH {_COVER} SELECT target, test_class, test_method, covers, link FROM cov WHERE link IN ('call-graph', 'call-graph-2hop')")(lambda g: T.covered(g.with_tables(exceptions=g.table("exceptions").where("false"))).where("link like 'call-graph%'"))
on_graph("coverage_classified", f"""WITH {_COVER}, p AS (SELECT target, test_class, min(CASE link WHEN 'call-graph' THEN 1 WHEN 'call-graph-2hop' THEN 2 WHEN 'exception-link' THEN 3 ELSE 4 END) AS p FROM cov GROUP BY 1, 2)
    SELECT target, test_class, CASE p WHEN 1 THEN 'call-graph' WHEN 2 THEN 'call-graph-2hop' WHEN 3 THEN 'exception-link' ELSE 'name-convention' END AS link FROM p""")(lambda g: T.classify(T.covered(g)))
on_graph("tests_for_class", f"""WITH {_COVER}, p AS (SELECT target, test_class, min(CASE link WHEN 'call-graph' THEN 1 WHEN 'call-graph-2hop' THEN 2 WHEN 'exception-link' THEN 3 ELSE 4 END) AS p FROM cov WHERE target = ({_TARGET}) GROUP BY 1, 2)
    SELECT target, test_class, CASE p WHEN 1 THEN 'call-graph' WHEN 2 THEN 'call-graph-2hop' WHEN 3 THEN 'exception-link' ELSE 'name-convention' END AS link, (SELECT count(*) FROM p) AS test_count FROM p ORDER BY test_class LIMIT 20""")(
    lambda g: T.tests_for(g, value(g, _TARGET), limit=20)
)

# --- ranking ------------------------------------------------------------------------------------------
WORDS = ["brand2", "Widget", "steps", "red"]
_SCORE = "CASE WHEN position('$' IN qn) > 0 THEN 0 ELSE 2 END" + "".join(f" + CASE WHEN '.' || lower(qn) || '.' LIKE '%.{w.lower()}.%' THEN 3 WHEN lower(qn) LIKE '%{w.lower()}%' THEN 1 ELSE 0 END" for w in WORDS)
on_graph("class_scores", f"SELECT qn AS qualified_name, {_SCORE} AS score FROM d_class")(lambda g: R.class_scores(g.classes, WORDS).select("qualified_name", "score"))
on_graph("resolve_class", f"WITH s AS (SELECT qn, {_SCORE.replace('brand2', 'brand2').replace('Widget', 'Widget')} AS score FROM d_class WHERE name = 'RedWidget') SELECT qn AS qualified_name, score, (SELECT count(*) FROM s WHERE score = (SELECT max(score) FROM s)) > 1 AS ambiguous FROM s WHERE score = (SELECT max(score) FROM s) ORDER BY qn LIMIT 5".replace(_SCORE, "CASE WHEN position('$' IN qn) > 0 THEN 0 ELSE 2 END + CASE WHEN '.' || lower(qn) || '.' LIKE '%.redwidget.%' THEN 3 WHEN lower(qn) LIKE '%redwidget%' THEN 1 ELSE 0 END + CASE WHEN '.' || lower(qn) || '.' LIKE '%.brand2.%' THEN 3 WHEN lower(qn) LIKE '%brand2%' THEN 1 ELSE 0 END"))(
    lambda g: R.resolve_class(g, ["RedWidget", "brand2"])
)
_FUZZY = """SELECT m.name, m.owner, m.id, 40 * ((CASE WHEN {t} LIKE '%step%' THEN 1 ELSE 0 END) + (CASE WHEN {t} LIKE '%widget%' THEN 1 ELSE 0 END)) + (CASE WHEN {t} LIKE '%step%' THEN 4 ELSE 0 END) + (CASE WHEN {t} LIKE '%widget%' THEN 6 ELSE 0 END)
    - CASE WHEN """ + _ISTEST.replace("file", "c.file").replace("name", "c.name") + """ THEN 15 ELSE 0 END AS score FROM d_meth m JOIN d_class c ON c.qn = m.owner WHERE {t} LIKE '%step%' AND {t} LIKE '%widget%' ORDER BY score DESC, m.id LIMIT 10"""
on_graph("fuzzy_methods", _FUZZY.format(t="lower(m.name || ' ' || c.name)"))(lambda g: R.fuzzy_methods(g, ["steps", "widgets"], 10))
on_graph("fields_by_stem", "SELECT qn AS qualified_name, CASE WHEN 10 > 0 THEN 13 END + CASE WHEN is_static THEN 2 ELSE 0 END + CASE WHEN is_final THEN 1 ELSE 0 END AS score FROM d_field ORDER BY score DESC, qualified_name LIMIT 20")(lambda g: R.fields_by_stem(g, ["retry"]))
on_graph("resolve_method", f"{_MTH} WHERE name = (SELECT min(name) FROM d_meth)")(lambda g: R.resolve_method(g, ["nothing", value(g, "SELECT min(name) FROM d_meth")]).select(*METHOD))
on_graph("method_specs", f"{_MTH} WHERE name = (SELECT min(name) FROM d_meth) ORDER BY id LIMIT 3")(lambda g: R.method_specs(g, value(g, "SELECT min(name) FROM d_meth")).select(*METHOD))
on_graph("callers_by_overload", "WITH h AS (SELECT m.key AS method, k.dst, k.src AS caller FROM d_calls k JOIN d_meth m ON m.id = k.dst WHERE m.name = (SELECT min(name) FROM d_meth)) SELECT method, caller, total FROM (SELECT method, caller, count(*) OVER (PARTITION BY dst) AS total, row_number() OVER (PARTITION BY dst ORDER BY caller) AS rn FROM h) z WHERE rn <= 10")(
    lambda g: R.callers_by_overload(g, value(g, "SELECT min(name) FROM d_meth"))
)
query("name_segments", r"SELECT k, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '\s+'), lambda x: x <> ''), ',') AS segs FROM d_class")(
    lambda s, d: relation(s, d, "d_class").select("k", F.array_join(segments("name"), ",").alias("segs"))
)
query("word_stems", "SELECT DISTINCT event_type AS w, CASE WHEN event_type LIKE '%ation' AND length(event_type) > 7 THEN substr(event_type, 1, length(event_type) - 5) WHEN event_type LIKE '%s' THEN substr(event_type, 1, length(event_type) - 1) ELSE event_type END AS stem FROM events")(
    lambda s, d: relation(s, d, "events").select(F.col("event_type").alias("w"), stem("event_type").alias("stem")).distinct()
)

# --- questions --------------------------------------------------------------------------------------
_METHOD_NAME = "SELECT min(name) FROM d_meth"


@on_graph("ask_answers", f"""WITH {_COVER}, up(src, dst) AS ({_SUPER}), allup(src, dst) AS ({_BOTH}),
    sub(node) AS (SELECT src FROM up WHERE dst = ({KID}) UNION SELECT u.src FROM sub w JOIN up u ON u.dst = w.node), impl(node) AS (SELECT src FROM allup WHERE dst = ({IFACE}) UNION SELECT u.src FROM impl w JOIN allup u ON u.dst = w.node)
    SELECT 'implementations' AS asked, 'implementations' AS matched, (SELECT count(DISTINCT node) FROM impl WHERE node <> ({IFACE})) AS n
    UNION ALL SELECT 'subclasses', 'subclasses', (SELECT count(DISTINCT node) FROM sub WHERE node <> ({KID}))
    UNION ALL SELECT 'callers', 'callers', (SELECT count(*) FROM d_calls k JOIN d_meth m ON m.id = k.dst WHERE m.name = ({_METHOD_NAME}))
    UNION ALL SELECT 'field usage', 'field-usage', (SELECT count(*) FROM d_usage u JOIN d_field f ON f.qn = u.field_qn WHERE f.name = 'maxRetryCount1')
    UNION ALL SELECT 'tests', 'tests', (SELECT count(DISTINCT test_class) FROM cov WHERE target = ({_TARGET}))
    UNION ALL SELECT 'values', 'values', (SELECT count(*) FROM (SELECT DISTINCT * FROM (SELECT value, class_fqn, field_name, file, line FROM d_value WHERE value LIKE '%PROMO%' ORDER BY file, line, class_fqn, field_name, value LIMIT 20) v) w)
    UNION ALL SELECT 'methods', 'methods', (SELECT count(*) FROM d_meth WHERE owner = ({ROOT}))
    UNION ALL SELECT 'fields', 'fields', (SELECT count(*) FROM d_field WHERE owner = ({ROOT}))
    UNION ALL SELECT 'location', 'location', 1 UNION ALL SELECT 'class', 'class-detail', 1 UNION ALL SELECT 'nothing', NULL, 0""")
def _ask_answers(g: CodeGraph) -> DataFrame:
    """(asked, matched, n): which operator answers a question of each kind and how many rows it has."""
    root = value(g, ROOT)
    asked = {
        "implementations": f"what implements {value(g, IFACE)}", "subclasses": f"which classes extends {value(g, KID)}", "callers": f"who calls {value(g, _METHOD_NAME)}", "field usage": "who uses maxRetryCount1",
        "tests": f"which tests verify {value(g, _TARGET)}", "values": 'where is "PROMO" defined', "methods": f"list methods of {root}", "fields": f"fields of {root}", "location": f"where is {root}", "class": root, "nothing": "zzz qqq",
    }
    got = {kind: Router(g).ask(q) for kind, q in asked.items()}
    return g.spark.createDataFrame([(kind, a.matched, a.count) for kind, a in got.items()], "asked string, matched string, n long")


on_graph("phrase_methods", f"SELECT id, qualified_name, (SELECT count(*) FROM d_meth WHERE owner = ({ROOT})) AS total FROM d_nodes WHERE type = 'METHOD' AND owner = ({ROOT}) ORDER BY id LIMIT 100")(
    lambda g: batch.run(g, f"methods in {value(g, ROOT)}").select("id", "qualified_name", "total")
)
on_graph("phrase_callers", f"WITH c AS (SELECT DISTINCT k.src AS id FROM d_calls k JOIN d_meth m ON m.id = k.dst WHERE m.name = ({_METHOD_NAME})) SELECT id, (SELECT count(*) FROM c) AS total FROM c ORDER BY id LIMIT 100")(
    lambda g: batch.run(g, f"getCallers(methodName={value(g, _METHOD_NAME)})").select("id", "total")
)

# --- traces --------------------------------------------------------------------------------------------
on_relation("ask_report", "d_ask", "SELECT count(*) AS total, count(matched) AS answered, round(count(matched) * 1.0 / count(*), 4) AS hit_rate FROM d_ask")(E.ask_report)
on_relation("ask_projects", "d_ask", "SELECT project, count(*) AS n FROM d_ask GROUP BY project")(E.ask_projects)
on_relation("matched_distribution", "d_ask", "SELECT matched, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM d_ask), 4) AS share, round(avg(answer_bytes), 1) AS avg_bytes FROM d_ask WHERE matched IS NOT NULL GROUP BY matched")(E.matched_distribution)
on_relation("unmatched_backlog", "d_ask", "SELECT event_id, project, question FROM d_ask WHERE matched IS NULL")(lambda df: E.unmatched(df).select("event_id", "project", "question"))
_FM = "e AS (SELECT *, min(CASE WHEN is_mutation THEN seq END) OVER (PARTITION BY session_id) AS fm FROM d_events), b AS (SELECT *, fm IS NULL OR seq < fm AS before FROM e)"
_RD = "operation IN ('git-history', 'inspect', 'locate', 'read', 'read-file', 'search')"
on_relation("mutation_split", "d_events", f"""WITH {_FM} SELECT session_id, max(fm) AS first_mut, CAST(sum(CASE WHEN {_RD} AND before THEN 1 ELSE 0 END) AS BIGINT) AS reads_before, CAST(sum(CASE WHEN {_RD} AND NOT before THEN 1 ELSE 0 END) AS BIGINT) AS reads_after,
    CAST(sum(CASE WHEN {_RD} AND before THEN result_bytes ELSE 0 END) AS BIGINT) AS bytes_before, CAST(sum(CASE WHEN {_RD} AND NOT before THEN result_bytes ELSE 0 END) AS BIGINT) AS bytes_after FROM b GROUP BY session_id""")(E.mutation_split)
on_relation("operation_taxonomy", "d_events", f"WITH {_FM} SELECT operation, count(*) AS calls, CAST(sum(result_bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN before THEN 1 ELSE 0 END) AS BIGINT) AS calls_before, round(count(*) * 1.0 / (SELECT count(*) FROM b), 4) AS share FROM b GROUP BY operation")(lambda df: E.taxonomy(df, "operation"))
on_relation("taxonomy_examples", "d_events", "SELECT session_id, seq, operation FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY session_id, seq) AS rn FROM d_events) z WHERE rn <= 12")(lambda df: E.examples(df, "operation").select("session_id", "seq", "operation"))
on_relation("session_summary", "d_events", f"WITH {_FM}, s AS (SELECT session_id, max(fm) AS fm, sum(CASE WHEN {_RD} AND before THEN 1 ELSE 0 END) AS r FROM b GROUP BY session_id) SELECT CAST(sum(CASE WHEN fm IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_mutation, CAST(sum(CASE WHEN fm IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_mutation, round(avg(CASE WHEN fm IS NOT NULL THEN r END), 4) AS avg_reads_before FROM s")(
    lambda df: E.session_summary(E.mutation_split(df))
)
on_relation("extension_histogram", "pages", r"WITH x AS (SELECT list_filter(regexp_extract_all(lower(url), '\.([a-z0-9]+)\b', 1), lambda y: y IN ('c','cpp','css','go','gradle','h','html','java','js','json','kt','md','properties','py','rs','sh','sql','toml','ts','txt','xml','yaml','yml'))[1] AS ext FROM pages) SELECT ext, count(*) AS n FROM x WHERE ext IS NOT NULL GROUP BY ext ORDER BY n DESC, ext LIMIT 15")(
    lambda df: E.extension_histogram(df.withColumn("target", F.col("url")))
)
on_relation("top_captures", "pages", r"SELECT capture, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS capture FROM pages) z GROUP BY capture ORDER BY n DESC, capture LIMIT 25")(lambda df: E.top_captures(df, "html", "<([a-z0-9]+)"))
on_relation("pattern_counts", "pages", "SELECT 'links' AS name, CAST(sum(len(regexp_extract_all(html, '<a href'))) AS BIGINT) AS n FROM pages UNION ALL SELECT 'paragraphs', CAST(sum(len(regexp_extract_all(html, '<p>'))) AS BIGINT) FROM pages")(lambda df: E.pattern_counts(df, "html", {"links": "<a href", "paragraphs": "<p>"}))
on_relation("language_histogram", "documents", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")(lambda df: E.histogram(df, "lang", "source"))
on_relation("token_attribution", "conversations", "SELECT conv_id AS traj, count(*) AS messages, sum(length(text) / 4.0) AS tokens, sum(CASE WHEN role = 'system' THEN length(text) / 4.0 ELSE 0 END) AS system_tokens, sum(CASE WHEN role = 'user' THEN length(text) / 4.0 ELSE 0 END) AS user_tokens, sum(CASE WHEN role = 'assistant' THEN length(text) / 4.0 ELSE 0 END) AS assistant_tokens, sum(CASE WHEN role = 'tool' THEN length(text) / 4.0 ELSE 0.0 END) AS tool_tokens FROM conversations GROUP BY conv_id")(
    lambda df: E.token_attribution(df.withColumn("traj", F.col("conv_id")))
)
on_relation("repeated_reads", "lineitem", "SELECT traj, count(*) AS files, CAST(sum(c - 1) AS BIGINT) AS repeats FROM (SELECT l_suppkey AS traj, l_partkey, count(*) AS c FROM lineitem GROUP BY 1, 2) z GROUP BY traj")(lambda df: E.repeated_reads(df.select(F.col("l_suppkey").alias("traj"), F.col("l_partkey").alias("file"))))
on_relation("upper_median_by_role", "conversations", "SELECT role, n_chars FROM (SELECT role, length(text) AS n_chars, row_number() OVER (PARTITION BY role ORDER BY length(text)) - 1 AS rn, count(*) OVER (PARTITION BY role) AS n FROM conversations) z WHERE rn = CAST(floor(n / 2) AS BIGINT)")(
    lambda df: E.upper_median(df.withColumn("len", F.length("text")), ["role"], "len", "n_chars")
)
on_relation("usage_series", "d_events", "SELECT session_id AS child, seq AS call, result_bytes - seq AS uncached, result_bytes - coalesce(lag(result_bytes) OVER (PARTITION BY session_id ORDER BY seq), 0) AS added FROM d_events")(
    lambda df: E.usage_series(df.select(F.col("session_id").alias("child"), F.col("seq").alias("call"), F.col("result_bytes").alias("input_tokens"), F.col("seq").alias("cached_input_tokens"))).select("child", "call", "uncached", "added")
)
on_relation("usage_sums", "d_events", "SELECT session_id AS child, count(*) AS calls, CAST(sum(result_bytes) AS BIGINT) AS input, CAST(sum(seq) AS BIGINT) AS cached, CAST(sum(seq * 2) AS BIGINT) AS output FROM d_events GROUP BY session_id")(
    lambda df: E.usage_sums(df.select(F.col("session_id").alias("child"), F.col("result_bytes").alias("input_tokens"), F.col("seq").alias("cached_input_tokens"), (F.col("seq") * 2).alias("output_tokens")))
)
on_relation("bytes_by_tool", "d_events", "SELECT session_id, tool, count(*) AS n, CAST(sum(result_bytes) AS BIGINT) AS bytes FROM d_events GROUP BY session_id, tool")(lambda df: E.bytes_by(df, "session_id", "tool"))
on_relation("arm_comparison", "d_events", "SELECT tool, count(*) AS n, round(avg(result_bytes), 4) AS avg_result_bytes FROM d_events GROUP BY tool")(lambda df: E.arm_comparison(df, "tool", "result_bytes"))
_BUCKET = "CASE WHEN n_chars >= 1048576 THEN '1M' WHEN n_chars >= 65536 THEN '64k' WHEN n_chars >= 16384 THEN '16k' WHEN n_chars >= 4096 THEN '4k' WHEN n_chars >= 1024 THEN '1k' ELSE '0' END"
on_relation("size_distribution", "documents", f"SELECT {_BUCKET} AS bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, round(sum(n_chars) * 1.0 / (SELECT sum(n_chars) FROM documents), 4) AS byte_share FROM documents GROUP BY 1")(lambda df: E.size_distribution(df, "n_chars"))
on_relation("size_summary", "documents", "WITH r AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT max(n) AS n, max(CASE WHEN rn = CAST(floor(n / 2) AS BIGINT) THEN v END) AS median, max(CASE WHEN rn = CAST(floor(n * 0.9) AS BIGINT) THEN v END) AS p90, max(v) AS largest, round(sum(CASE WHEN v >= 16384 THEN v ELSE 0 END) * 1.0 / sum(v), 4) AS big_share FROM r")(lambda df: E.size_summary(df, "n_chars"))
on_relation("pair_by_position", "conversations", "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant') SELECT a.conv_id, a.turn AS call_seq, b.turn AS result_seq FROM a LEFT JOIN b ON b.conv_id = a.conv_id AND b.rn = a.rn")(
    lambda df: E.pair_by_position(df.where("role = 'user'"), df.where("role = 'assistant'"), "conv_id", "turn")
)
on_relation("keep_largest", "documents", "SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) z WHERE rn = 1")(lambda df: E.keep_largest(df.select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], "n_chars", "doc_id"))
on_relation("top_documents", "documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")(lambda df: E.top_rows(df.select("doc_id", "n_chars"), "n_chars", "doc_id", 20))

# --- changes -------------------------------------------------------------------------------------------
_OLD = "SELECT CAST(o_orderkey AS STRING) AS file, o_orderdate AS mtime FROM orders WHERE o_orderstatus <> 'P'"
_NEW = "SELECT CAST(o_orderkey AS STRING) AS file, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS mtime FROM orders WHERE o_orderstatus <> 'F'"


@query("snapshot_diff", f"WITH b AS ({_OLD}), a AS ({_NEW}) SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'new' WHEN a.file IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.file = b.file WHERE a.file IS NULL OR b.file IS NULL OR a.mtime <> b.mtime")
def _snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_views(spark, sf_dir)
    return M.snapshot_diff(spark.sql(_OLD), spark.sql(_NEW))


@query("needs_parsing", f"WITH b AS ({_OLD}), a AS ({_NEW}) SELECT a.file FROM a LEFT JOIN b ON a.file = b.file WHERE b.file IS NULL OR a.mtime > b.mtime")
def _needs_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_views(spark, sf_dir)
    return M.needs_parsing(spark.sql(_OLD), spark.sql(_NEW)).select("file")


on_graph("remove_nodes", "SELECT src, dst, type FROM d_edges WHERE src NOT IN (SELECT id FROM d_nodes WHERE type = 'INTERFACE') AND dst NOT IN (SELECT id FROM d_nodes WHERE type = 'INTERFACE')")(
    lambda g: M.remove_nodes(g, g.of_type("INTERFACE").select("id")).edges.select("src", "dst", "type")
)
on_graph("remove_edges_by_type", "SELECT src, dst, type FROM d_edges WHERE type <> 'CALLS'")(lambda g: M.remove_edges(g, kind="CALLS").edges.select("src", "dst", "type"))
on_graph("graph_union", "SELECT id, type FROM d_nodes")(lambda g: M.union(g.with_tables(nodes=g.nodes.where("type <> 'FIELD'")), g).nodes.select("id", "type"))
on_graph("forget_file", f"SELECT id, type FROM d_nodes WHERE file IS NULL OR file <> (SELECT file FROM d_class WHERE qn = ({ROOT}))")(lambda g: M.forget_file(g, value(g, f"SELECT file FROM d_class WHERE qn = ({ROOT})")).nodes.select("id", "type"))
