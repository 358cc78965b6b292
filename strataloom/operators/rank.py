"""Ranked resolution of names in questions: classes, methods and fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.identifiers import SUFFIXES, is_test_class, segments
from strataloom.graph import CodeGraph

#: Words of a question that name nothing.
QUESTION_WORDS = frozenset(
    "who what where which when how why the a an of in on at to for with by is are was were do does did can could call calls caller callers calling called class classes "
    "method methods field fields implement implements implementation implementations subclass subclasses superclass extends override overrides overridden interface interfaces "
    "test tests testing testsuite find list all show get give me tell live lives defined define declared declare located locate location file files this that these those it its and or "
    "any many much please code codebase project java graph server question about used uses usages usage references referenced reference members member variables variable static public "
    "private protected signature signatures type types".split()
)


def identifiers(question: str) -> list[str]:
    """Words of a question that may name something; dotted names stay whole."""
    seen = (w.strip(".") for w in re.split(r"[^A-Za-z0-9._$]+", question or ""))
    return list(dict.fromkeys(w for w in seen if len(w) >= 2 and w.lower() not in QUESTION_WORDS))


def literals(question: str, most: int = 3) -> list[str]:
    """Quoted texts of 1 to 200 characters and free-standing numbers."""
    found = re.findall(r"\"([^\"]{1,200})\"|'([^']{1,200})'|(?<![\w.])(\d+(?:[.,]\d+)*)(?![\w])", question or "")
    return [next(x for x in f if x) for f in found][:most]


def stem_of(word: str, least: int = 3) -> str:
    w = word.lower()
    for s in SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= least:
            return w[: -len(s)]
    return w


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def class_scores(classes: DataFrame, words: list[str]) -> DataFrame:
    """classes with `score`: 2 for a name without $, and for each word 3 if it is a segment of the qualified name, else 1 if it occurs in it; a dotted word gives 1 for each of its segments that occurs."""
    q = F.lower("qualified_name")
    parts = F.split(q, r"[.$]")
    score = F.when(F.col("qualified_name").contains("$"), 0).otherwise(2)
    for w in dict.fromkeys(x.lower() for x in words):
        if "." in w:
            for p in w.split("."):
                score = score + F.when(F.array_contains(parts, p), 1).otherwise(0)
        else:
            score = score + F.when(F.array_contains(parts, w), 3).when(q.contains(w), 1).otherwise(0)
    return classes.withColumn("score", score)


def resolve_class(g: CodeGraph, words: list[str], most: int = 5) -> DataFrame:
    """(qualified_name, score, ambiguous): an exact qualified name; else, by the longest simple name that exists, its best class, or up to `most` that tie."""
    if not words:
        return g.classes.select("qualified_name", F.lit(0).alias("score"), F.lit(False).alias("ambiguous")).where("false")
    rows = [(i, w, w.rsplit(".", 1)[-1]) for i, w in enumerate(words)]
    asked = F.broadcast(_table(g.classes, rows, "ord int, word string, simple string"))  # the question's words
    names = class_scores(g.classes, words).select("qualified_name", "name", "score").distinct()
    exact = names.join(asked, F.col("qualified_name") == F.col("word")).select("qualified_name", "score", F.lit(0).alias("tier"), F.lit(0).alias("len"), "ord")
    simple = names.join(asked, F.col("name") == F.col("simple")).select("qualified_name", "score", F.lit(1).alias("tier"), (-F.length("name")).alias("len"), "ord")
    both = exact.unionByName(simple)
    # each name's own candidates only: the first (tier, longest name, place in the question)
    first = both.agg(F.min(F.struct("tier", "len", "ord")).alias("f")).select("f.*")
    kept = both.join(F.broadcast(first), ["tier", "len", "ord"]).select("qualified_name", "score", "tier").distinct()  # one row
    top = kept.agg(F.max("score").alias("top"))
    best = kept.join(F.broadcast(top), F.col("score") == F.col("top")).select("qualified_name", "score")  # one row
    n = best.agg(F.count("*").alias("n"))
    return best.join(F.broadcast(n), F.lit(True)).select("qualified_name", "score", (F.col("n") > 1).alias("ambiguous")).orderBy("qualified_name").limit(most)  # one row


def resolve_method(g: CodeGraph, words: list[str]) -> DataFrame:
    """Methods named by the last segment of the first dotted word that names any, else by the first bare word that does."""
    dotted = [w.rsplit(".", 1)[-1] for w in words if "." in w and len(w.rsplit(".", 1)[-1]) >= 2]
    tried = dotted + [w for w in words if "." not in w]
    if not tried:
        return g.methods.where("false")
    asked = F.broadcast(_table(g.classes, list(enumerate(tried)), "ord int, name string"))  # the question's words
    hit = g.methods.join(asked, "name")
    first = hit.agg(F.min("ord").alias("ord"))
    return hit.join(F.broadcast(first), "ord").drop("ord").dropDuplicates(["id"])  # one row


def fuzzy_methods(g: CodeGraph, words: list[str], limit: int = 1) -> DataFrame:
    """(name, owner, id, score) of the methods that share the most word stems with a question.

    40 for each stem found in the method's or its class's name plus the stems'
    lengths, 15 less in test classes, 20 more if a word is the whole name and at
    most two methods bear it. One stem alone counts from eight letters on.
    """
    stems = sorted({s for s in (stem_of(w) for w in words) if len(s) >= 3})
    if not stems:
        return g.methods.select("name", "owner", "id", F.lit(0).alias("score")).where("false")
    text = F.lower(F.concat_ws(" ", "name", F.regexp_extract("owner", r"([^.]*)$", 1)))
    hits = [F.when(text.contains(s), 1).otherwise(0) for s in stems]
    matched, letters = sum(hits, F.lit(0)), sum((h * len(s) for h, s in zip(hits, stems)), F.lit(0))
    longest = F.greatest(F.lit(0), *(h * len(s) for h, s in zip(hits, stems))) if len(hits) else F.lit(0)
    cls = g.classes.select(F.col("qualified_name").alias("owner"), is_test_class("file", "name").alias("is_test")).distinct()
    m = g.methods.select("name", "owner", "id").join(cls, "owner", "left")
    m = m.withColumns({"matched": matched, "letters": letters, "longest": longest}).where("matched >= 2 or (matched = 1 and longest >= 8)")
    bearing = g.methods.where(F.lower("name").isin([w.lower() for w in words])).groupBy("name").count().where("count <= 2").select("name", F.lit(20).alias("rare"))
    score = 40 * F.col("matched") + F.col("letters") - F.when(F.col("is_test"), 15).otherwise(0) + F.coalesce("rare", F.lit(0))
    return m.join(bearing, "name", "left").select("name", "owner", "id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def fields_by_stem(g: CodeGraph, words: list[str], limit: int = 20) -> DataFrame:
    """(qualified_name, score): fields one of whose name segments equals, abbreviates or begins like a stem of the question."""
    stems = []
    for w in words:
        s = stem_of(w, 6)
        if len(w) >= 5 and s not in stems:
            stems.append(s if len(s) >= 5 else w.lower())
    stems = stems[:3]
    if not stems:
        return g.fields.select("qualified_name", F.lit(0).alias("score")).where("false")
    asked = F.broadcast(_table(g.classes, [(s, (len(stems) - i) * 10) for i, s in enumerate(stems)], "stem string, weight int"))  # three rows
    seg = g.fields.select("id", "qualified_name", "owner", "is_static", "is_final", F.explode(segments("name")).alias("seg")).where(F.length("seg") >= 3)
    kind = F.when(F.col("seg") == F.col("stem"), 3).when(F.col("stem").startswith(F.col("seg")) & (F.length("stem") >= 2 * F.length("seg")), 2).when(F.col("seg").startswith(F.col("stem")), 1)
    hit = seg.join(asked, F.substring("seg", 1, 3) == F.substring("stem", 1, 3)).withColumn("kind", kind).where("kind is not null")
    best = hit.groupBy("id", "qualified_name", "owner", "is_static", "is_final").agg(F.max(F.col("weight") + F.col("kind")).alias("s"))
    named = F.lower(F.regexp_extract("owner", r"([^.]*)$", 1))
    bonus = F.when(F.exists(F.lit([w.lower() for w in words]), lambda w: named == w), 15).otherwise(0)
    score = F.col("s") + bonus + F.when(F.col("is_static"), 2).otherwise(0) + F.when(F.col("is_final"), 1).otherwise(0)
    return best.select("qualified_name", score.alias("score")).orderBy(F.desc("score"), "qualified_name").limit(limit)


def method_specs(g: CodeGraph, spec: str, most: int = 3) -> DataFrame:
    """Methods meant by `Class.m` (the class by qualified or simple name; any class if none fits) or `m`; at most `most`, by id."""
    owner, _, name = (spec or "").strip().rpartition(".")
    named = g.methods.where(F.col("name") == name)
    if owner:
        fit = named.where((F.col("owner") == owner) | F.col("owner").endswith("." + owner))
        none = fit.agg(F.count("*").alias("n")).where("n = 0")
        named = fit.unionByName(named.join(F.broadcast(none), F.lit(True)).drop("n"))  # one row
    return named.orderBy("id").limit(most)


def callers_by_overload(g: CodeGraph, name: str, most: int = 10) -> DataFrame:
    """(method, caller, total): for each overload its number of callers and the first `most` by id."""
    over = g.methods.where(F.col("name") == name).select(F.col("id").alias("dst"), F.col("qualified_name").alias("method"))
    hit = g.calls.join(over, "dst")
    w = Window.partitionBy("dst").orderBy("src")
    hit = hit.withColumn("rn", F.row_number().over(w)).join(hit.groupBy("dst").agg(F.count("*").alias("total")), "dst")
    return hit.where(F.col("rn") <= most).select("method", F.col("src").alias("caller"), "total")
