"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.storage import dropped, shared_dir, stored

__all__ = ["Memo", "WordHashes", "connected", "dropped", "held_out", "released", "shared_dir", "small_batches", "stored", "table", "trimmed", "unsent"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Arrow batches of few rows and about `size` bytes: texts can be megabytes long. Holds for the session, since plans run later."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def released(batches):
    """batches; at their end the Python worker, which serves later tasks too, gives back what it no longer uses."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(spark: SparkSession) -> bool:
    """Has the driver's JVM give back native memory that it has freed (compiled plans leave a lot of it behind in the C library). False where it can't: JDK before 17.0.9, or another C library."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    types, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    try:
        for i, name in enumerate(names):
            types[i] = kind(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
        # by reflection: the server's own class is not open to callers
        said = kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return "Trim native heap" in str(said)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join in which neither side is broadcast. Spark sizes what an explode makes as if each row gave one, too low by the length of its arrays, and would gather it in the driver."""
    return df.hint("merge")


def held_out(doc_id) -> "F.Column":
    """True where crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Memo(dict):
    """Values of make(key), worked out once each. Beyond `limit` entries the older generation is forgotten; what is in use comes back."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


class WordHashes(Memo):
    """XXH64 of words."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__(lambda word: xxhash.xxh64_intdigest(word, seed=seed), limit)

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Links whose aggregates stay below the size that adaptive execution broadcasts.
MANY = 500_000


def connected(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of undirected links (a, b), a != b: rows (node, root), root the least node.

    Alternates large-star and small-star until the links stand still, however
    many rounds that takes. Each node's neighbours are only aggregated (min),
    never gathered; what they are joined with is stored first where there are more
    than MANY links, so adaptive execution may split the partition of a hub; of
    fewer links the aggregate is small enough for it to be broadcast, of more it never is. Each round's
    tables are deleted once the next is written, and the driver gives back what its
    plans leave behind. No links give no rows.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        kept, sent = (stored, unsent) if seen[0] > MANY else (lambda df, _: df, lambda df: df)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = stored(both.join(sent(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")), name)
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = stored(large.join(sent(low), "a").select(F.explode(pairs).alias("e")).select("e.*").where("a <> b").distinct(), name)
        now = mark(small)
        for old in (edges, least, large, low):
            dropped(old)
        edges = small
        trimmed(edges.sparkSession)
        if now == seen:
            break
        seen = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
