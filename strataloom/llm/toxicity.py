"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams, bigrams and one-skip bigrams of a text's
words, hashed to 2**BITS coordinates. FTRL-proximal keeps a learning rate for
each coordinate and its L1 term leaves most weights exactly zero, so the model
that every executor needs is a short list of (coordinate, weight) pairs with a
proven bound: 2**BITS entries of 12 bytes.

Labels are learnt from a bounded sample (a documented parameter): at most
`per_class` toxic rows and one and a half times as many others, chosen by hash.
Each epoch is a job of one task that streams the sample's features from the
shared folder in a fixed order and hands on its state, two numbers for each
coordinate: no task holds more than a batch of rows, however long their texts.
The rate, sparsity and number of
epochs were chosen on an inner split of the rows that may be learnt from (crc32
remainder 1 against 2 to 4), never on held-out ones. Every document is scored over its whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import WordHashes, dropped, held_out, small_batches, stored, table

BITS = 18
PER_CLASS = 3000
_WORD = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct coordinates of a text; none for null and blank texts."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int32)
    h = hashes.of(words)
    parts = [h]
    if len(h) > 1:
        parts.append((h[:-1] * _MUL) ^ (h[1:] * _MUL2 + np.uint64(1)))
    if len(h) > 2:
        parts.append((h[:-2] * _MUL) ^ (h[2:] * _MUL2 + np.uint64(2)))
    mixed = np.concatenate(parts) * _MUL
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.int32))


class Ftrl:
    """The state of FTRL-proximal over 2**bits coordinates and a bias, which is kept in one more and not shrunk."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, state: np.ndarray | None = None):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.state = np.zeros((2, (1 << bits) + 1)) if state is None else state
        self.z, self.n = self.state

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def see(self, at: np.ndarray, y: int) -> None:
        z, n, alpha = self.z, self.n, self.alpha
        za, na = z[at], n[at]
        w, b = self.weights(za, na), self.bias
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        new = na + g * g
        z[at] = za + g - (np.sqrt(new) - np.sqrt(na)) / alpha * w
        n[at] = new
        nb = n[-1] + g * g
        z[-1] += g - (np.sqrt(nb) - np.sqrt(n[-1])) / alpha * b
        n[-1] = nb


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 6, **rates: float) -> tuple[np.ndarray, float]:
    """Weights (dense, mostly zero) and bias. rows are visited in the given order, `epochs` times."""
    model = Ftrl(bits, **rates)
    for _ in range(epochs):
        for at, y in rows:
            model.see(at, y)
    return model.weights(model.z[:-1], model.n[:-1]), model.bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, epochs: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias), learnt from at most `per_class` toxic rows and 1.5 times as many others.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are read. Labels that are null
    or of null ids are left out; of repeated labels of an id the higher counts, of
    its repeated rows the one whose features come first. Empty texts teach the
    bias alone. Without labelled rows the model is empty and every score is that
    of the bias, 0.
    """
    small_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    labels = labels.where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    toxic = min(per_class, labels.where("y = 1").count())
    order = F.xxhash64("doc_id")
    parts = [labels.where(F.col("y") == y).orderBy(order, "doc_id").limit(k) for y, k in ((0, toxic * 3 // 2), (1, toxic))]
    picked = stored(parts[0].unionByName(parts[1]), "toxic-sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def read(batches):
        hashes = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([features(t, hashes, bits).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "y", "at"]
            )

    rows = rows.select("doc_id", "text", "y").mapInArrow(read, "doc_id long, y int, at binary")
    rows = rows.select("doc_id", "y", "at", F.row_number().over(W.partitionBy("doc_id").orderBy("at")).alias("copy")).where("copy = 1")

    sample = stored(rows.select("doc_id", "y", "at"), "toxic-features")
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(7), "doc_id"), "doc_id").select("y", "at")  # another hash than the one that chose the rows
    state = np.zeros((2, (1 << bits) + 1))

    def epoch(sent):
        def learn(batches):
            model = Ftrl(bits, state=sent.value.copy())
            for b in batches:
                for y, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    model.see(np.frombuffer(at, np.int32), y)
            yield pa.RecordBatch.from_arrays([pa.array([model.state.tobytes()], pa.binary())], ["state"])

        return learn

    for _ in range(epochs):
        sent = docs.sparkSession.sparkContext.broadcast(state)  # 16 bytes for each coordinate
        got = ordered.mapInArrow(epoch(sent), "state binary").collect()  # one row
        state = np.frombuffer(bytes(got[0].state)).reshape(state.shape).copy() if got else state
        sent.unpersist()
    dropped(sample)
    dropped(picked)
    model = Ftrl(bits, state=state)
    w = model.weights(model.z[:-1], model.n[:-1])
    at = np.flatnonzero(w)
    return at, w[at], model.bias


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], bits: int = BITS) -> DataFrame:
    """docs' columns `keep` with `tox_score` in 0 to 1: one row for each row, repeated ones too.

    Null and blank texts get the bias's score, long ones are read whole, equal
    texts score alike. A column of docs named tox_score must not be kept. An
    empty table gives none.
    """
    small_batches(docs.sparkSession)
    at, w, bias = model

    def run(batches):
        weights = np.zeros(1 << bits)
        weights[at] = w
        hashes = WordHashes()
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            raw = np.array([weights[features(t, hashes, bits)].sum() + bias for t in texts])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))], [*keep, "tox_score"])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", tox_score double"
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see fit_toxicity and score_toxicity for nulls, empty and long texts, ties, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
