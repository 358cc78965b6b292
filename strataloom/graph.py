"""A code graph as DataFrames: nodes, edges and side tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.schema import TABLES

SNAPSHOT_VERSION = "1"


@dataclass
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame
    side: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types))

    def edges_of_type(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    @cached_property
    def classes(self) -> DataFrame:
        return self.of_type("CLASS", "INTERFACE")

    @cached_property
    def methods(self) -> DataFrame:
        return self.of_type("METHOD")

    @cached_property
    def fields(self) -> DataFrame:
        return self.of_type("FIELD")

    @cached_property
    def calls(self) -> DataFrame:
        """Distinct calls (src, dst)."""
        return self.edges.where("type = 'CALLS' and src is not null and dst is not null").select("src", "dst").distinct()

    def table(self, name: str) -> DataFrame:
        if name in ("nodes", "edges"):
            return getattr(self, name)
        return self.side.get(name, self.spark.createDataFrame([], TABLES[name]))

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(prefix + name)

    # --- checks -------------------------------------------------------------
    def dangling(self) -> DataFrame:
        """Edges an end of which is no node."""
        ids = self.nodes.select("id")
        e = self.edges
        return e.join(ids, e.src == ids.id, "left_anti").unionByName(e.join(ids, e.src == ids.id, "left_semi").join(ids, e.dst == ids.id, "left_anti"))

    def same_as(self, other: "CodeGraph") -> bool:
        """Equal ids, types and edge triples, with their numbers."""
        def differ(a: DataFrame, b: DataFrame) -> bool:
            return not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()

        return not (differ(self.nodes.select("id", "type"), other.nodes.select("id", "type")) or differ(self.edges.select("src", "dst", "type"), other.edges.select("src", "dst", "type")))

    # --- snapshots ----------------------------------------------------------
    def save(self, path: str, fingerprint: str | None = None) -> None:
        """Parquet tables, nodes and edges partitioned by type, and one row of metadata written last.

        Within files nodes are sorted by qualified name and edges by source, so row groups are skipped in lookups.
        """
        for name in TABLES:
            df = self.table(name)
            if name in ("nodes", "edges"):
                df.sortWithinPartitions("type", *(["qualified_name", "id"] if name == "nodes" else ["src", "dst"])).write.mode("overwrite").partitionBy("type").parquet(f"{path}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        self.spark.createDataFrame([(SNAPSHOT_VERSION, fingerprint)], "version string, fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, fingerprint: str | None = None) -> "CodeGraph | None":
        """The snapshot; None if it is of another version or, where one is asked for, another fingerprint."""
        try:
            meta = spark.read.parquet(f"{path}/meta").first()
        except Exception as e:  # no snapshot there
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        if meta is None or meta.version != SNAPSHOT_VERSION or (fingerprint is not None and meta.fingerprint != fingerprint):
            return None
        read = {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in TABLES.items()}
        return cls(read.pop("nodes"), read.pop("edges"), read)

    @staticmethod
    def invalidate(spark: SparkSession, path: str) -> None:
        """Empty the metadata: the snapshot is no longer loaded."""
        spark.createDataFrame([], "version string, fingerprint string").write.mode("overwrite").parquet(f"{path}/meta")

    def with_tables(self, **tables: DataFrame) -> "CodeGraph":
        side = {**self.side, **{k: v for k, v in tables.items() if k not in ("nodes", "edges")}}
        return replace(self, nodes=tables.get("nodes", self.nodes), edges=tables.get("edges", self.edges), side=side)
