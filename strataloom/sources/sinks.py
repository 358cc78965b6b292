"""Sinks: the JSON form of a graph, logs and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.graph import CodeGraph
from strataloom.schema import NODES

JSON_VERSION = "1.0"


def write_json(g: CodeGraph, path: str) -> None:
    """nodes and edges as folders of JSON lines beside one line of metadata; every attribute is kept."""
    g.nodes.write.mode("overwrite").json(f"{path}/nodes")
    g.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "type", F.col("props").alias("properties")).write.mode("overwrite").json(f"{path}/edges")
    meta = g.nodes.agg(F.lit(JSON_VERSION).alias("version"), F.count("*").alias("nodes"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_json(spark: SparkSession, path: str) -> CodeGraph:
    """The graph; edges an end of which is missing are dropped."""
    nodes = spark.read.schema(NODES).json(f"{path}/nodes")
    e = spark.read.schema("`from` string, `to` string, type string, properties map<string,string>").json(f"{path}/edges")
    e = e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "type", F.col("properties").alias("props"))
    ids = nodes.select("id")
    e = e.join(ids, e.src == ids.id, "left_semi")
    return CodeGraph(nodes, e.join(ids, e.dst == ids.id, "left_semi"))


def read_json_document(spark: SparkSession, path: str) -> CodeGraph:
    """A graph in one JSON document {version, metadata, nodes[], edges[]}; edges with a missing end are dropped."""
    edge = "struct<`from`:string,`to`:string,type:string,properties:map<string,string>>"
    node = "struct<" + ",".join(f.split(" ", 1)[0] + ":" + f.split(" ", 1)[1] for f in _fields(NODES)) + ">"
    doc = spark.read.schema(f"version string, nodes array<{node}>, edges array<{edge}>").json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    e = doc.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.type").alias("type"), F.col("e.properties").alias("props"))
    ids = nodes.select("id")
    return CodeGraph(nodes, e.join(ids, e.src == ids.id, "left_semi").join(ids, e.dst == ids.id, "left_semi"))


def _fields(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in ddl:
        depth += c == "<"
        depth -= c == ">"
        if c == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(report: dict[str, DataFrame], path: str, most: int = 1000) -> str:
    """Small aggregates as one JSON file; the Markdown form is returned. Of a table of more than `most` rows the first are written, and both forms say how many there are."""
    data, totals = {}, {}
    for k, df in report.items():
        rows = [r.asDict(True) for r in df.limit(most + 1).collect()]
        totals[k] = df.count() if len(rows) > most else len(rows)
        data[k] = rows[:most]
    cut = {k: n for k, n in totals.items() if n > most}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data | ({"rows_in_all": cut} if cut else {}), f, default=str, indent=1)
    parts = []
    for name, rows in data.items():
        parts.append(f"## {name}\n")
        if rows:
            heads = list(rows[0])
            parts += ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *("| " + " | ".join(str(r[h]) for h in heads) + " |" for r in rows), ""]
        if name in cut:
            parts.append(f"{len(rows)} of {cut[name]} rows\n")
    return "\n".join(parts)
