"""Shards along a Hilbert curve over quantised metadata.

Several metadata dimensions are quantised to a few bits each, the point's
index on the Hilbert curve orders the rows, and runs of that order are cut
into shards of near-equal bytes. Neighbours on the curve are near in every
dimension, so each shard covers a small box and files can be pruned by any of
the dimensions through their minimum and maximum. For that, coordinates keep
the order of the values: numbers are cut at quantiles, categories at the names
of the most frequent ones.

The order is (curve index, part, doc_id, ...): the rows of a crowded cell are
dealt into parts of about `part_rows` by a number of the row, so no task holds
a cell however hot its source is and however often an id or a row repeats.
Positions come from prefix sums in three levels: rows within a part, parts
within a cell, and cells (at most 2 ** (dimensions * bits)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import stored, table

BITS = 5


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of an (n, d) array of coordinates below 2**bits, after Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def below(c: Column, cuts: list[tuple]) -> Column:
    """A coordinate: that of the greatest cut (value, coordinate) at or below the value, so it grows with the value; 0 below all cuts and for null."""
    got = F.lit(0)
    for value, at in cuts:
        got = F.when(c >= F.lit(value), at).otherwise(got)
    return F.coalesce(got, F.lit(0)).cast("int")


def name_cuts(rows: DataFrame, c: str, bits: int = BITS) -> list[tuple[str, int]]:
    """Cuts of a category: its 2**bits most frequent values in order of their names (of equally frequent ones the first by name).

    Their coordinates are spread over the range by the rows before them, so the
    curve's first bends part the rows and not the names.
    """
    top = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(1 << bits).collect()  # at most 32 names
    total, before, out = sum(r.n for r in top), 0, []
    for i, r in enumerate(sorted(top, key=lambda r: r[0])):
        at = max((before << bits) // total, out[-1][1] + 1 if out else 0)
        out.append((r[0], min(at, (1 << bits) - len(top) + i)))
        before += r.n
    return out


def number_cuts(rows: DataFrame, c: str, bits: int = BITS) -> list[tuple[float, int]]:
    """Cuts of a number at its quantiles (within a ten-thousandth): each coordinate holds about as many rows, however far single values lie."""
    k = 1 << bits
    got = rows.agg(F.percentile_approx(c, [i / k for i in range(1, k)], 10_000)).first()[0] or []
    return sorted({v: i for i, v in enumerate(got, 1)}.items())


def hilbert_shards(rows: DataFrame, dims: dict[str, Column], size: str, shards: int = 8, bits: int = BITS, order: tuple[str, ...] = ("doc_id",), part_rows: int = 50_000) -> DataFrame:
    """rows with `curve` (the cell's index), `shard` and `slot` (gapless from 0 in each shard).

    rows: small columns only, among them `size` (a positive long) and `order`.
    dims: coordinates below 2**bits. A row belongs to the shard in which the
    middle of its bytes lies, so shards differ from an equal share by less than
    one row at either end. Ties of `order` and `size` fall to a number of the row,
    which is stored, so equal rows have slots of their own that don't change
    when a task runs again. An empty table gives none. Columns named __n, curve,
    salt, shard, slot, row, first must not be among the rows'.
    """
    if len(dims) * bits > 20:
        raise ValueError("at most 20 bits of curve")

    @F.pandas_udf("long")
    def curve(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], axis=1), bits))

    placed = stored(rows.withColumn("curve", curve(*dims.values())).withColumn("__n", F.monotonically_increasing_id()), "curve")
    order = (*order, size, "__n")
    cells = placed.groupBy("curve").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("long"))
    placed = placed.join(F.broadcast(cells.select("curve", "parts")), "curve")  # at most 2**20 cells of 16 bytes
    placed = stored(placed.withColumn("salt", F.pmod(F.xxhash64("__n"), F.col("parts"))).drop("parts"), "salted")
    parts = placed.groupBy("curve", "salt").agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    up = lambda keys, by: W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    cell_sums = parts.groupBy("curve").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    w = up([F.lit(0)], ["curve"])
    cell_at = cell_sums.select("curve", before("b", w).alias("cb"), before("n", w).alias("cn"))
    w = up(["curve"], ["salt"])
    part_at = parts.select("curve", "salt", before("b", w).alias("pb"), before("n", w).alias("pn")).join(cell_at, "curve")
    total = parts.agg(F.sum("b")).first()[0] or 0
    part_at = part_at.select("curve", "salt", (F.col("cb") + F.col("pb")).alias("b0"), (F.col("cn") + F.col("pn")).alias("n0"))
    w = up(["curve", "salt"], order)
    run = placed.withColumn("b1", before(size, w)).withColumn("n1", F.row_number().over(W.partitionBy("curve", "salt").orderBy(*order)) - 1)
    run = run.join(part_at, ["curve", "salt"]).withColumn("at", F.col("b0") + F.col("b1")).withColumn("row", F.col("n0") + F.col("n1"))
    middle = F.expr(f"(2 * at + `{size}`) * {shards} div {max(1, 2 * total)}")  # whole numbers: exact
    run = run.withColumn("shard", F.least(F.lit(shards - 1), middle.cast("int")))
    run = stored(run.drop("salt", "b0", "n0", "b1", "n1", "at", "__n"), "run")
    first = run.groupBy("shard").agg(F.min("row").alias("first"))
    return run.join(F.broadcast(first), "shard").withColumn("slot", F.col("row") - F.col("first")).drop("row", "first")  # one row a shard


def document_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, lang, source, size, text_crc32): UTF-8 bytes plus one (null text: none) and its checksum; columns `keep` too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(*keep, F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs, stored, with __rid, a number of the row: ids may be null or repeat."""
    return stored(docs.withColumn("__rid", F.monotonically_increasing_id()), "numbered")


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """docs (from `numbered`) as one folder of Parquet files for each shard, sorted along the curve. sharded: what shard_documents made of them. Every row is written once."""
    put = docs.join(sharded.select("__rid", "shard", "slot"), "__rid").drop("__rid")
    put.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of near-equal bytes over language, source, size and doc_id, each a dimension of the curve.

    One row for each row of docs, repeated ones too; null languages, sources and
    ids have the least coordinate; null and empty texts weigh one byte, long ones
    all of theirs. A column __rid is kept where docs has one; others aren't read. An
    empty table gives none.
    """
    keep = [c for c in ("__rid",) if c in docs.columns]
    rows = stored(document_rows(docs, *keep), "sizes")
    cuts = {c: name_cuts(rows, c) for c in ("lang", "source")} | {c: number_cuts(rows, c) for c in ("size", "doc_id")}
    return hilbert_shards(rows, {c: below(F.col(c), x) for c, x in cuts.items()}, "size", shards, order=("doc_id", "text_crc32"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see shard_documents for nulls, empty and long texts, ties, repeated rows and empty tables."""
    got = shard_documents(table(spark, sf_dir, "documents"), 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "curve")
