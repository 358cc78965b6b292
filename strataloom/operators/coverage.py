"""Which tests cover a class: by calls, calls over a helper, exceptions and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.identifiers import is_test_class
from strataloom.graph import CodeGraph
from strataloom.storage import stored

LINKS = ("call-graph", "call-graph-2hop", "exception-link", "name-convention")
HELPERS = 50


def test_classes(g: CodeGraph) -> DataFrame:
    return g.classes.where(is_test_class("file", "name"))


def covered(g: CodeGraph, targets: DataFrame | None = None, helpers: int = HELPERS) -> DataFrame:
    """(target, test_class, test_method, covers, link): every way in which a test method touches a target class.

    targets: (target), qualified names; all classes that are no tests if None.
    Names link whole classes: test_method is null there. For the second hop the
    first `helpers` callees of a test method by id are followed that are not
    methods of the target itself.
    """
    tests = test_classes(g).select(F.col("qualified_name").alias("owner"), F.col("name").alias("test_name")).distinct()
    prod = g.classes.where(~is_test_class("file", "name")).select(F.col("qualified_name").alias("target"), F.col("name").alias("target_name"))
    if targets is not None:
        prod = prod.join(targets.select("target").distinct(), "target", "left_semi")
    tm = g.methods.join(tests, "owner").select(F.col("id").alias("test_id"), F.col("owner").alias("test_class"), F.col("qualified_name").alias("test_method"))
    pm = g.methods.join(prod.select(F.col("target").alias("owner")), "owner").select(F.col("id").alias("prod_id"), F.col("owner").alias("target"), "signature", F.col("qualified_name").alias("prod_method"))
    into = stored(g.calls.join(pm, F.col("dst") == F.col("prod_id")).select("src", "target", "signature").distinct(), "into")
    direct = into.join(tm, F.col("src") == F.col("test_id")).select("target", "test_class", "test_method", F.col("signature").alias("covers"), F.lit(LINKS[0]).alias("link"))
    two = _second_hop(g, tm, into, helpers)
    ex = g.table("exceptions")
    thrown = ex.where("not is_assertion").join(pm, F.col("method_qn") == F.col("prod_method")).select("exception_name", "target").distinct()
    asserted = ex.where("is_assertion").select("method_qn", "exception_name").join(tm, F.col("method_qn") == F.col("test_method")).select("exception_name", "test_class", "test_method")
    by_exception = asserted.join(thrown, "exception_name").select("target", "test_class", "test_method", F.concat(F.lit("[throws "), "exception_name", F.lit("]")).alias("covers"), F.lit(LINKS[2]).alias("link"))
    return direct.unionByName(two).unionByName(by_exception).unionByName(_by_name(tests, prod)).distinct()


def _second_hop(g: CodeGraph, tm: DataFrame, into: DataFrame, helpers: int) -> DataFrame:
    """Links of test methods over a helper. into: (src, target, signature), the calls of target methods.

    Starts from the callers of targets, so only test methods that call one of them are looked at.
    """
    owners = g.methods.where(F.col("owner").isNotNull()).select(F.col("id").alias("mid"), F.col("owner").alias("helper_class"))
    helping = into.withColumnRenamed("src", "mid").join(owners, "mid").where(F.col("helper_class") != F.col("target"))
    cand = g.calls.select(F.col("src").alias("test_id"), F.col("dst").alias("mid")).join(tm, "test_id").join(helping, "mid")
    cand = stored(cand.select("test_id", "test_class", "test_method", "mid", "target", "signature"), "second-hop")
    callees = g.calls.select(F.col("src").alias("test_id"), F.col("dst").alias("mid")).join(cand.select("test_id").distinct(), "test_id", "left_semi").join(owners, "mid")
    ranked = callees.withColumn("rn", F.row_number().over(Window.partitionBy("test_id").orderBy("mid")))
    ranked = stored(ranked.select("test_id", "mid", "helper_class", "rn"), "callees")
    # a callee's place among those that aren't the target's: its place less the target's own before it
    places = cand.select("test_id", "mid", "target").distinct().join(ranked.select("test_id", "mid", "rn"), ["test_id", "mid"])
    own = ranked.select("test_id", F.col("helper_class").alias("target"), F.col("rn").alias("own_rn"))
    place = F.max("rn") - F.count(F.when(F.col("own_rn") < F.col("rn"), 1))
    near = places.join(own, ["test_id", "target"], "left").groupBy("test_id", "mid", "target").agg(place.alias("place")).where(F.col("place") <= helpers)
    return cand.join(near, ["test_id", "mid", "target"]).select("target", "test_class", "test_method", F.concat(F.lit("[2hop] "), "signature").alias("covers"), F.lit(LINKS[1]).alias("link"))


def _by_name(tests: DataFrame, prod: DataFrame) -> DataFrame:
    """Tests whose name contains a target's name: equi-joined on the name's first letters, at each place of the test's name."""
    k = 3
    low = tests.select("owner", F.lower("test_name").alias("t")).where("length(t) > 0")
    at = low.select("owner", "t", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t")))).alias("i")).select("owner", "t", F.substring(F.col("t"), F.col("i"), F.lit(k)).alias("head")).distinct()
    names = prod.select("target", F.lower("target_name").alias("p")).where("length(p) > 0")
    long = names.where(F.length("p") >= k).select("target", "p", F.substring("p", 1, k).alias("head"))
    hit = at.where(F.length("head") == k).join(long, "head").where(F.col("t").contains(F.col("p")))
    short = names.where(F.length("p") < k).select("target", "p", F.col("p").alias("head"))
    heads = at.select("owner", "t", F.explode(F.sequence(F.lit(1), F.length("head"))).alias("n"), "head").select("owner", "t", F.substring(F.col("head"), F.lit(1), F.col("n")).alias("head")).distinct()
    hit = hit.select("target", "owner").unionByName(heads.join(short, "head").select("target", "owner"))
    return hit.distinct().select("target", F.col("owner").alias("test_class"), F.lit(None).cast("string").alias("test_method"), F.lit(None).cast("string").alias("covers"), F.lit(LINKS[3]).alias("link"))


def classify(cover: DataFrame) -> DataFrame:
    """(target, test_class, link): the strongest link of each test class."""
    order = F.array_position(F.lit(list(LINKS)), F.col("link"))
    best = cover.groupBy("target", "test_class").agg(F.min(order).alias("p"))
    return best.select("target", "test_class", F.element_at(F.lit(list(LINKS)), F.col("p").cast("int")).alias("link"))


def tests_for(g: CodeGraph, fqn: str, link: str | None = None, with_methods: bool = False, limit: int | None = None) -> DataFrame:
    """Test classes of one class, sorted, with `test_count`, their number before the limit; optionally a map from test methods to what they cover."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    if link is not None and link not in LINKS:
        raise ValueError(f"link must be one of {LINKS}")
    cover = covered(g, g.spark.createDataFrame([(fqn,)], "target string"))
    got = classify(cover)
    if link:
        got = got.where(F.col("link") == link)
    total = got.agg(F.count("*").alias("test_count"))
    if with_methods:
        per = cover.where("test_method is not null").groupBy("target", "test_class", "test_method").agg(F.sort_array(F.collect_set("covers")).alias("c"))
        per = per.groupBy("target", "test_class").agg(F.map_from_entries(F.collect_list(F.struct("test_method", "c"))).alias("methods"))
        got = got.join(per, ["target", "test_class"], "left")
    got = got.join(F.broadcast(total), F.lit(True)).orderBy("test_class")  # one row
    return got if limit is None else got.limit(limit)
