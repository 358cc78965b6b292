"""The inverted index over names and the literal search."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.identifiers import STOP_WORDS, qualifier, tokens, whole_token


@dataclass(frozen=True)
class TextConfig:
    stop_words: tuple[str, ...] = STOP_WORDS
    min_length: int = 2
    max_length: int = 64

    def __post_init__(self):
        if self.min_length < 1 or self.max_length < self.min_length:
            raise ValueError("lengths must satisfy 1 <= min_length <= max_length")


def postings_of(texts: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """(token, node_id) from rows (node_id, text): tokens and whole tokens, lower-cased, without stop words."""
    each = texts.where("text is not null").select("node_id", F.explode(F.array_union(tokens("text"), F.array_compact(F.array(whole_token("text"))))).alias("t"))
    t = F.lower("t")
    return each.select(t.alias("token"), "node_id").where(F.length("token").between(config.min_length, config.max_length) & ~F.col("token").isin(*config.stop_words)).distinct()


def _node_texts() -> Column:
    return F.array("type", "file", "name", "qualified_name", qualifier("qualified_name"))


def index_nodes(nodes: DataFrame, config: TextConfig = TextConfig(), unique: bool = False) -> DataFrame:
    """Postings of a node's type, file, name, qualified name and qualifier. unique: no id occurs twice, so that each node's own tokens are distinct postings and nothing is shuffled."""
    if not unique:
        return postings_of(nodes.select(F.col("id").alias("node_id"), F.explode(_node_texts()).alias("text")), config)
    each = F.transform(F.array_compact(_node_texts()), lambda x: F.array_union(tokens(x), F.array_compact(F.array(whole_token(x)))))
    fit = lambda t: F.length(t).between(config.min_length, config.max_length) & ~t.isin(*config.stop_words)
    own = F.array_distinct(F.filter(F.transform(F.flatten(each), F.lower), fit))
    return nodes.select(F.explode(own).alias("token"), F.col("id").alias("node_id"))


def search_nodes(nodes: DataFrame, words, config: TextConfig = TextConfig()) -> DataFrame:
    """Nodes whose texts have every word: search_all of their postings, made only for nodes whose texts contain each word. Texts beyond ASCII are all looked at, as their lower case may depend on what stands beside."""

    def near(t: Column) -> Column:
        return reduce(Column.__and__, (F.contains(F.lower(t), F.lit(k)) for k in _keys(words)), F.lit(True)) | (F.octet_length(t) != F.length(t))

    # in an array, so that the texts are worked out once for all words
    return search_all(index_nodes(nodes.where(F.exists(F.array(F.concat_ws("\n", _node_texts())), near)), config), words)


def unindex(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return postings.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def reindex(postings: DataFrame, nodes: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    return unindex(postings, nodes).unionByName(index_nodes(nodes, config))


def _keys(words) -> list[str]:
    return sorted({w.strip().lower() for w in words if w and w.strip()})


def search_token(postings: DataFrame, token: str | None) -> DataFrame:
    return postings.where(F.col("token") == (token or "").strip().lower()).select("node_id").distinct()


def search_all(postings: DataFrame, words) -> DataFrame:
    """Nodes that have every word; stop words aren't indexed, so a query with one finds none."""
    keys = _keys(words)
    if not keys:
        return postings.where("false").select("node_id")
    hit = postings.where(F.col("token").isin(keys)).groupBy("node_id").agg(F.countDistinct("token").alias("n"))
    return hit.where(F.col("n") == len(keys)).select("node_id")


def search_any(postings: DataFrame, words) -> DataFrame:
    keys = _keys(words)
    return postings.where(F.col("token").isin(keys)).select("node_id").distinct() if keys else postings.where("false").select("node_id")


_CUT = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|[._\-]|\s+")


def query_tokens(text: str) -> list[str]:
    parts = (re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", p) for p in _CUT.split(text or ""))
    return list(dict.fromkeys(p for p in parts if p))


def search_phrase(postings: DataFrame, phrase: str) -> DataFrame:
    """Nodes that have all tokens of the phrase, in any order."""
    return search_all(postings, query_tokens(phrase))


def search_query(postings: DataFrame, query: str | None) -> DataFrame:
    """A quoted phrase; words joined by OR in any case; else all words."""
    q = (query or "").strip()
    if len(q) > 1 and q[0] == q[-1] == '"':
        return search_phrase(postings, q[1:-1])
    if re.search(r"\sor\s", q, re.I):
        return search_any(postings, re.split(r"\s+or\s+", q, flags=re.I))
    return search_all(postings, q.split())


def tokens_of(postings: DataFrame, node_id: str) -> DataFrame:
    return postings.where(F.col("node_id") == node_id).select("token")


def nodes_for(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    return nodes.join(hits.select(F.col("node_id").alias("id")), "id", "left_semi")


def index_stats(postings: DataFrame) -> DataFrame:
    return postings.agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("token").alias("tokens"), F.count("*").alias("postings"))


def nodes_per_token(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.countDistinct("node_id").alias("n"))


def names_containing(nodes: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """Classes, then methods, whose name has q in any case."""
    got = nodes.where(F.col("type").isin("CLASS", "METHOD") & F.lower("name").contains((q or "").lower()))
    return got if limit is None else got.orderBy("type", "qualified_name", "id").limit(limit)


def literals_containing(values: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """The first literals, in order of file, line, class and field, that contain a text as written."""
    return values.where(F.col("value").contains(part)).orderBy("file", "line", "class_fqn", "field_name", "value").limit(limit)
