"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a window of words: positions marked 0 are
ignored, so a window whose substituted words fall on ignored positions hashes
alike. Every window of every benchmark item and of every document is hashed
under each mask; a shared hash is a hit that proposes an alignment of document
and item, which is then verified word by word around the hit: some stretch of
`span` aligned words (or the whole item, if shorter) must agree in at least
`agree` of its words.

The test set is sent to the executors in blocks of about `block_words` words,
one after another: each block is one pass over the documents whose findings
are stored before the next is sent, so what is broadcast at a time, and what a
worker holds, has a fixed bound whatever the test set's size. Documents stay
where they are: no window of a document is ever shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import WordHashes, dropped, small_batches, stored, table

#: 1: compared, 0: ignored. Found by enumeration: every 8 to 13 words of which three quarters agree hold a hit.
MASKS = ("11101", "100111", "1101001")
#: Shorter items must occur whole.
SHORT = 8
SPAN = 13
AGREE = 0.75
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ROT = np.uint64(29)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of word hashes h under the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ h[i : i + n]) * _MUL
            out ^= out >> _ROT
    return out


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, span: int) -> float:
    """The largest share of equal words in a stretch of `span` words of the item laid at doc[shift:]; of the whole item if that is shorter."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    need = min(span, len(item))
    if hi - lo < need:
        return 0.0
    same = np.concatenate(([0], np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])))
    return float((same[need:] - same[:-need]).max()) / need


class Probe:
    """A block of the benchmark: seed hashes to (item, position), and the items' word hashes."""

    def __init__(self, items: list[tuple[int, list[np.uint64]]], span: int, agree: float):
        self.ids = [i for i, _ in items]
        self.words = [np.array(w, np.uint64) for _, w in items]
        self.span, self.agree = span, agree
        self.tables = []
        for mask in MASKS:
            parts = [(seed_hashes(w, mask), k) for k, w in enumerate(self.words) if len(w) >= SHORT]
            hashes = np.concatenate([p for p, _ in parts] or [np.empty(0, np.uint64)])
            owner = np.concatenate([np.full(len(p), k, np.int64) for p, k in parts] or [np.empty(0, np.int64)])
            place = np.concatenate([np.arange(len(p), dtype=np.int64) for p, _ in parts] or [np.empty(0, np.int64)])
            order = np.argsort(hashes, kind="stable")
            door = np.zeros(1 << 20, bool)
            door[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, hashes[order], owner[order], place[order], door))
        #: items of fewer than SHORT words are looked up whole
        self.short: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < SHORT:
                self.short.setdefault(w.tobytes(), []).append(k)
        self.short_lengths = sorted({len(w) for w in self.words if 0 < len(w) < SHORT})

    def find(self, h: np.ndarray) -> dict[int, float]:
        """item id -> best share of agreement, for the items that verify."""
        tried: set[tuple[int, int]] = set()
        best = np.zeros(len(self.ids))
        for mask, hashes, owner, place, door in self.tables:
            windows = seed_hashes(h, mask)
            at = np.flatnonzero(door[(windows >> np.uint64(44)).astype(np.int64)])
            if not len(at) or not len(hashes):
                continue
            lo, hi = np.searchsorted(hashes, windows[at], "left"), np.searchsorted(hashes, windows[at], "right")
            hit = np.flatnonzero(hi > lo)
            for i in hit:
                for j in range(lo[i], hi[i]):
                    k = int(owner[j])
                    if best[k] == 1.0:  # nothing can be better: a word repeated throughout ends here
                        continue
                    key = (k, int(at[i] - place[j]))
                    if key not in tried:
                        tried.add(key)
                        best[k] = max(best[k], best_overlap(h, self.words[k], key[1], self.span))
        found: dict[int, float] = {}
        for k in np.flatnonzero(best >= self.agree):
            found[self.ids[k]] = max(found.get(self.ids[k], 0.0), float(best[k]))
        for n in self.short_lengths:
            for i in range(len(h) - n + 1):
                for k in self.short.get(h[i : i + n].tobytes(), ()):
                    found[self.ids[k]] = 1.0
        return found


def find_overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, span: int = SPAN, agree: float = AGREE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' columns `keep` (doc_id alone unless given) with items and overlap: one row for each row of docs.

    items: ids of the benchmark items found in the document, ascending; empty
    for none, and for null and blank texts. overlap: the best verified share,
    0.0 for none. Benchmark rows with null ids or without words match nothing;
    items of fewer than SHORT words must occur whole; items of equal texts are
    all found. Texts are read whole, however long; repeated rows of docs stay.
    Columns of docs named items or overlap must not be kept. An empty table
    gives none, an empty benchmark finds nothing.
    """
    small_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("__text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    sized = stored(tests.distinct().withColumn("weight", F.length("text")), "tests")
    total = sized.agg(F.sum("weight")).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 5)))  # a word takes five characters or so
    out = rows.withColumns({"items": F.array().cast("array<long>"), "overlap": F.lit(0.0)})
    for k in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [(r.item_id, words_of(r.text)) for r in mine.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]  # about block_words words
        hashes = WordHashes()
        before = out
        out, sent = _scan(before, [(i, [hashes[w] for w in ws]) for i, ws in items if ws], span, agree)
        if k + 1 < blocks:
            out = stored(out, "scanned")
            sent.unpersist()
            dropped(before)
    return out.drop("__text")


def _scan(rows: DataFrame, items: list, span: int, agree: float) -> tuple[DataFrame, Broadcast]:
    """rows (..., __text, items, overlap) with what a block of the benchmark adds to the last two, and the block as sent."""
    sent = rows.sparkSession.sparkContext.broadcast(items)
    n = len(rows.columns) - 3

    def run(batches):
        probe, hashes = Probe(sent.value, span, agree), WordHashes()
        for b in batches:
            got = [probe.find(hashes.of(words_of(t))) for t in b.column(n).to_pylist()]
            found = [sorted({*old, *g}) for old, g in zip(b.column(n + 1).to_pylist(), got)]
            best = [max(g.values(), default=0.0) for g in got]
            best = [max(x, y) for x, y in zip(best, b.column(n + 2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], pa.array(found, pa.list_(pa.int64())), pa.array(best, pa.float64())], b.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)), sent


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see find_overlaps for nulls, empty and long texts, ties, repeated rows and empty tables."""
    got = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), F.array_join("items", ",").alias("item_ids"), "overlap")
