"""From Java source texts to a graph: each text is parsed once on the executors, names are resolved by joins."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.graph import CodeGraph
from strataloom.operators.build import derive
from strataloom.operators.mutate import forget_file, forget_files, needs_parsing, snapshot_diff
from strataloom.operators.resolve import references, resolve_field_usages
from strataloom.schema import TABLES
from strataloom.sources.files import source_listing, texts
from strataloom.storage import stored

FACTS = {k: v for k, v in TABLES.items() if k != "field_usages"}


def parse(sources: DataFrame, enum_members: bool = False) -> DataFrame:
    """(kind, row as JSON) from rows (file, text), stored. A text that can't be read gives one parse_errors row; null texts are empty."""

    def run(batches):
        from strataloom.sources.java_text import ParseFailure, read

        for b in batches:
            kinds, rows = [], []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    got = read(file, text or "", enum_members)
                except ParseFailure as e:
                    got = {"parse_errors": [{"file": file, "message": str(e)}]}
                for kind, found in got.items():
                    kinds += [kind] * len(found)
                    rows += map(json.dumps, found)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(rows, pa.string())], ["kind", "row"])

    return stored(sources.select("file", "text").mapInArrow(run, "kind string, row string"), "facts")


def facts(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where(F.col("kind") == kind).select(F.from_json("row", FACTS[kind]).alias("r")).select("r.*")


def graph_of(parsed: DataFrame, dispatch: bool = True) -> CodeGraph:
    """The graph of parsed facts: of nodes with one id the first by file and line stays, edges are there once.

    Side tables: call_sites, values, exceptions, field_usages, files, type_mentions, field_refs, parse_errors.
    """
    every = facts(parsed, "nodes")
    whole = F.struct(*every.columns)
    nodes = stored(every.groupBy("id").agg(F.min_by(whole, F.struct("file", "start")).alias("n")).select("n.*"), "nodes")
    edges = facts(parsed, "edges").groupBy("src", "dst", "type").agg(F.first("props").alias("props"))
    side = {k: facts(parsed, k) for k in FACTS if k not in ("nodes", "edges")}
    g = CodeGraph(nodes, edges, side)
    used = references(side["type_mentions"], g.classes, side["files"]).withColumn("props", F.lit(None).cast("map<string,string>"))
    g = g.with_tables(edges=edges.unionByName(used.where("src <> dst")), field_usages=resolve_field_usages(side["field_refs"], g.fields, g.classes))
    return derive(g, dispatch)


def build_graph(spark: SparkSession, project: str, tests: bool = True, exclude: tuple[str, ...] = (), enum_members: bool = False) -> CodeGraph:
    """The graph of a project's Java files: its standard source folders, or all of it; without tests, files below a test folder are left out."""
    roots, more = source_listing(project, tests)
    return graph_of(parse(texts(spark, roots, exclude=(*exclude, *more)), enum_members))


def _resolved(less: CodeGraph, parsed: DataFrame | None) -> CodeGraph:
    """`less` with the parsed facts of further files, all names resolved again."""
    nodes, own, side = less.nodes, less.edges.where("type <> 'REFERENCES_TYPE'"), dict(less.side)
    if parsed is not None:
        nodes = nodes.unionByName(facts(parsed, "nodes").join(nodes.select("id"), "id", "left_anti"))
        own = own.unionByName(facts(parsed, "edges"))
        side |= {k: less.table(k).unionByName(facts(parsed, k)) if k in less.side else facts(parsed, k) for k in FACTS if k not in ("nodes", "edges")}
    made = CodeGraph(stored(nodes, "nodes"), own, side)
    used = references(side["type_mentions"], made.classes, side["files"]).withColumn("props", F.lit(None).cast("map<string,string>"))
    return derive(made.with_tables(edges=own.unionByName(used.where("src <> dst")), field_usages=resolve_field_usages(side["field_refs"], made.fields, made.classes)))


def update_file(g: CodeGraph, path: str, text: str | None) -> tuple[CodeGraph, dict[str, int]]:
    """A graph of graph_of with one file read anew (None: it is gone), and the numbers of nodes removed and added."""
    less = forget_file(g, path)
    out = _resolved(less, None if text is None else parse(g.spark.createDataFrame([(path, text)], "file string, text string")))
    kept = less.nodes.count()
    return out, {"removed": g.nodes.count() - kept, "added": out.nodes.count() - kept}


def refresh_changed(g: CodeGraph, before: DataFrame, after: DataFrame, sources: DataFrame) -> CodeGraph:
    """The graph after a change of the listing (file, mtime): new and newer files are parsed, deleted ones forgotten, the rest kept.

    sources: (file, text) of at least the new and newer files.
    """
    stale = needs_parsing(before, after).select("file")
    gone = snapshot_diff(before, after).where("change = 'deleted'").select("file")
    less = forget_files(g, stored(stale.unionByName(gone).distinct(), "gone"))
    return _resolved(less, parse(sources.join(stale, "file", "left_semi")))
