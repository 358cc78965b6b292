"""The derived graph: only what a query asks for is made, from keys where they can stand for texts, and equal to its SQL on odd tables."""

import os

import duckdb
import pytest

from strataloom.plans import derived
from strataloom.plans.registry import ORACLES, QUERIES

from .test_oracles import TABLES, plain


@pytest.fixture
def copy_of(tiny, tmp_path):
    """A folder with the tiny tables, some replaced by SQL."""

    def make(**changed):
        for t in TABLES:
            if t in changed:
                duckdb.sql(f"COPY ({changed[t].format(t=f"'{tiny}/{t}.parquet'")}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            else:
                os.symlink(f"{tiny}/{t}.parquet", tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def test_queries_make_only_what_they_ask_for(spark, copy_of):
    d = copy_of()
    held = lambda: set(derived._HELD.get(derived._key(spark, d), {}))
    QUERIES["usage_sums"](spark, d).collect()
    assert held() == {"d_events"}
    QUERIES["all_packages"](spark, d).collect()
    assert held() == {"d_events", "d_name", "d_class"}
    QUERIES["resolve_class"](spark, d).collect()
    assert held() == {"d_events", "d_name", "d_class"}
    QUERIES["method_by_signature"](spark, d).collect()
    assert held() == {"d_events", "d_name", "d_class", "k_method", "d_method", "d_meth"}
    assert derived._HELD[derived._key(spark, d)]["k_method"].columns == ["p_partkey", "name", "brand", "p_size", "l_suppkey"]
    assert len(QUERIES["members_per_class"](spark, d).collect()) and "k_call" not in held()


@pytest.mark.parametrize(
    "keyed, part",
    [
        (True, "SELECT * FROM {t}"),
        (False, "SELECT * FROM {t} UNION ALL SELECT * FROM {t} WHERE p_partkey < 9"),
        (False, "SELECT * REPLACE (CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE p_name END AS p_name) FROM {t}"),
    ],
)
def test_odd_tables_against_sql(spark, copy_of, keyed, part):
    rows = "SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_linenumber END AS l_linenumber) FROM {t}"
    d = copy_of(part=part, lineitem=f"{rows} UNION ALL SELECT * FROM {{t}} WHERE l_orderkey < 50")
    assert derived.lean(spark, (derived.base_views(spark, d), d)[1]) == keyed
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    asked = {n: q for n, q in derived.RELATIONS.items() if n in derived.READ or n in ("d_nodes", "d_edges")}
    for name in asked:
        got, want = derived.relation(spark, d, name), con.execute(derived.used(f"SELECT * FROM {name}"))
        heads = sorted(x[0] for x in want.description)
        assert sorted(got.columns) == heads
        theirs = sorted(tuple(plain(dict(zip([x[0] for x in want.description], r))[c]) for c in heads) for r in want.fetchall())
        assert sorted(tuple(plain(r[c]) for c in heads) for r in got.collect()) == theirs, name


def test_postings_of_unique_nodes_take_no_shuffle(spark, tiny):
    from strataloom.operators import text as X
    from strataloom.plans.derived import graph
    from pyspark.sql import functions as F

    n = graph(spark, tiny).nodes
    odd = n.limit(3).withColumns({"id": F.concat(F.lit("odd"), "id"), "name": F.lit("the İstanbul RedWidget ΑΣ widget-Red"), "file": F.lit(None).cast("string")})
    nodes = spark.createDataFrame(n.limit(300).unionByName(odd).collect(), n.schema)
    once, all_ = X.index_nodes(nodes, unique=True), X.index_nodes(nodes)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, all_.collect()))
    for words in (["red", "widget"], ["RED"], ["ας"], ["brand2", "com"], [" "], ["the"]):
        assert sorted(r.node_id for r in X.search_nodes(nodes, words).collect()) == sorted(r.node_id for r in X.search_all(all_, words).collect()), words


@pytest.mark.parametrize("part", ["SELECT * FROM {t}", "SELECT * FROM {t} UNION ALL SELECT * FROM {t} WHERE p_partkey < 9"])
def test_busiest_and_sites_with_and_without_keys(spark, copy_of, part):
    from strataloom.plans import registry

    d = copy_of(part=part)
    g = derived.graph(spark, d)
    assert registry.value(g, registry.BUSY) == g.sql(registry.BUSY).first()[0] and registry.value(g, registry.POPULAR) == g.sql(registry.POPULAR).first()[0]
    a, b = g.sites(registry._SITES), g.sql(registry._SITES)
    assert a.columns == b.columns and a.distinct().exceptAll(b.distinct()).isEmpty() and b.distinct().exceptAll(a.distinct()).isEmpty()
