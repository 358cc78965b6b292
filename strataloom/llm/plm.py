"""Language-model scores by masked pseudo-likelihood.

A small network written in numpy predicts every word of a text from the words
around it on both sides; the sum of the conditional log-probabilities is the
text's pseudo-likelihood, its mean the score.

The probability of a word is that of its class, which the network gives, times
the word's share of its class in the whole corpus. The most frequent words have
a class of their own, the others share hashed ones; a class is two digits of
32, predicted one after the other, so the distribution over all words of the
corpus is exactly normalised at the cost of two small softmaxes. The table of
all words and their counts grows with the corpus and is never gathered: counts
of the KNOWN most frequent words go to every worker (a list of bounded size),
those of all others are joined to the words that need them.

Training reads all documents and all positions. Texts are dealt by hash to
shards whose number follows from the corpus alone, so the result doesn't depend on how the
input is partitioned. In each of ROUNDS rounds every shard starts from the same
weights, learns its share of the positions by Adagrad (the first, the second, ...
of every ROUNDS words), and weights and step sizes are averaged by numbers of
tokens, in two levels. The network (about 68,000 numbers whatever the corpus) is all
that a round sends.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import Memo, dropped, small_batches, stored, table

DIGIT, WIDTH = 32, 16
CLASSES = DIGIT * DIGIT
TOP = CLASSES // 2 - 1
SHARED = CLASSES - TOP - 1
EDGE = TOP  # the class beyond either end of a text
KNOWN = 300_000
UNSEEN = 0.5  # the count of a word that the corpus doesn't have
ROUNDS, SHARD_TOKENS, SHARDS = 2, 2_000_000, 4096
OFFSETS = (-2, -1, 1, 2)
REACH = max(map(abs, OFFSETS))
SHAPES = [("E", (len(OFFSETS), CLASSES, WIDTH)), ("b0", (WIDTH,)), ("Wa", (WIDTH, DIGIT)), ("ba", (DIGIT,)), ("G", (DIGIT, WIDTH)), ("Wb", (WIDTH, DIGIT)), ("C", (DIGIT, DIGIT))]
CHUNK = 4096


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def key_of(word: bytes) -> int:
    """A word's key: a negative number of 63 bits of its hash."""
    return -(xxhash.xxh64_intdigest(word) >> 1) - 1


class Net:
    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        sizes = [int(np.prod(s)) for _, s in SHAPES]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = rng.normal(0, 0.1, sum(sizes)).astype(np.float32)
            at = sum(sizes[:4])
            flat[at : at + sizes[4]] += 1.0  # gates start open
        self.flat = np.array(flat, np.float32)
        self.sum2 = np.full_like(self.flat, 1e-4)
        at = 0
        for (name, shape), n in zip(SHAPES, sizes):
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    def _hidden(self, ctx: np.ndarray) -> np.ndarray:
        h = self.E[0].take(ctx[0], axis=0)
        h += self.b0
        for k in range(1, len(OFFSETS)):
            h += self.E[k].take(ctx[k], axis=0)
        return np.tanh(h, out=h)

    @staticmethod
    def _powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(z) of logits z, a column for each position, divided by its greatest; and the columns' sums. z loses that greatest. Columns, since sums along short rows are slow."""
        z -= z.max(axis=0)
        e = np.exp(z)
        return e, e.sum(axis=0)

    def log_probs(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target class given its context classes (one row for each offset)."""
        h = self._hidden(ctx)
        a, b = target >> 5, target & 31
        at = np.arange(len(target))

        def picked(z: np.ndarray, digit: np.ndarray) -> np.ndarray:
            total = self._powers(z)[1]
            return z[digit, at] - np.log(total)

        first = picked(self.Wa.T @ h.T + self.ba[:, None], a)
        h *= self.G.take(a, axis=0)
        return first + picked(self.Wb.T @ h.T + self.C.take(a, axis=0).T, b)

    def learn(self, ctx: np.ndarray, target: np.ndarray, rate: float = 0.1) -> None:
        """One Adagrad step on a batch."""
        n = len(target)
        h = self._hidden(ctx)
        a, b = target >> 5, target & 31
        at = np.arange(n)
        gate = self.G.take(a, axis=0)
        gated = h * gate
        da, total = self._powers(self.Wa.T @ h.T + self.ba[:, None])
        da /= total
        db, total = self._powers(self.Wb.T @ gated.T + self.C.take(a, axis=0).T)
        db /= total
        da[a, at] -= 1
        db[b, at] -= 1
        da /= n
        db /= n
        back = db.T @ self.Wb.T
        dh = (da.T @ self.Wa.T + back * gate) * (1 - h * h)
        cells = (np.arange(len(OFFSETS))[:, None] * CLASSES + ctx).ravel()
        order = np.argsort(cells.astype(np.uint16), kind="stable")
        cells = cells[order]
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        embedded = np.zeros((len(OFFSETS) * CLASSES, WIDTH), np.float32)
        embedded[cells[starts]] = np.add.reduceat(dh.take(order % n, axis=0), starts, axis=0)
        first = (np.arange(DIGIT)[:, None] == a).astype(np.float32)  # sums by first digit are products with it
        parts = [embedded, dh.sum(0), h.T @ da.T, da.sum(1), first @ (back * h), gated.T @ db.T, first @ db.T]
        g = np.concatenate([p.ravel() for p in parts]).astype(np.float32)
        self.sum2 += g * g
        self.flat -= rate * g / np.sqrt(self.sum2)


def contexts(ids: np.ndarray) -> np.ndarray:
    """The classes at each offset of each position of one text."""
    padded = np.concatenate((np.full(REACH, EDGE, np.int64), ids, np.full(REACH, EDGE, np.int64)))
    return np.stack([padded[REACH + o : REACH + o + len(ids)] for o in OFFSETS])


def word_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(k, n): the key and the number of every word of all texts."""

    def row(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(map(key_of, counts)), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["k", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(words_of(t))
                if len(counts) >= flush:
                    yield row(counts)
                    counts.clear()
        yield row(counts)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """counts: (k, n) of all words. keys, logs: the KNOWN most frequent ones and the logarithms of their numbers. totals: the logarithm of each class's number."""

    counts: DataFrame
    tokens: int
    keys: np.ndarray
    logs: np.ndarray
    totals: np.ndarray


def vocabulary(docs: DataFrame, known: int = KNOWN) -> Vocabulary:
    counts = stored(word_counts(docs), "words")
    bins = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()  # some hundred rows
    least, upto = None, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        upto += r.words
        if upto > known:
            break
        least = r.least
    most = counts.where(F.col("n") >= least).collect() if least is not None else []  # at most `known` rows
    most.sort(key=lambda r: (-r.n, r.k))
    keys, n = np.array([r.k for r in most], np.int64), np.array([r.n for r in most], np.float64)
    totals = np.zeros(CLASSES)
    for r in counts.groupBy(F.pmod("k", F.lit(SHARED)).alias("c")).agg(F.sum("n").alias("n")).collect():  # SHARED rows
        totals[TOP + 1 + r.c] = r.n
    tokens = int(totals.sum())
    np.subtract.at(totals, TOP + 1 + keys[:TOP] % SHARED, n[:TOP])
    totals[: len(n[:TOP])] = n[:TOP]
    return Vocabulary(counts, tokens, keys, np.log(n), np.log(np.maximum(totals, UNSEEN)))


def to_classes(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(rid, doc_id, ids, share, rare), stored: the classes of each text's words as 16-bit numbers, the part of the words' shares of their classes that is known already, and the keys of the words whose number has to be joined."""
    sent = docs.sparkSession.sparkContext.broadcast((words.keys, words.logs, words.totals))

    def run(batches):
        keys, logs, totals = sent.value
        at = dict(zip(keys.tolist(), range(len(keys))))
        own = np.where(np.arange(len(keys)) < TOP, np.arange(len(keys)), TOP + 1 + keys % SHARED)
        part = np.where(np.arange(len(keys)) < TOP, 0.0, logs - totals[own])

        def code(word: bytes) -> int:
            k = key_of(word)
            return at.get(k, k)

        of = Memo(code)
        for b in batches:
            ids, share, rare = [], [], []
            for ws in map(words_of, b.column(2).to_pylist()):
                c = np.fromiter(map(of.__getitem__, ws), np.int64, len(ws))
                far = c < 0
                cls = np.where(far, TOP + 1 + c % SHARED, own[np.maximum(c, 0)]) if len(keys) else TOP + 1 + c % SHARED
                ids.append(cls.astype("<u2").tobytes())
                share.append(float(part[c[~far]].sum() - totals[cls[far]].sum()))
                rare.append(c[far])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(share, pa.float64()), pa.array(rare, pa.list_(pa.int64()))], ["rid", "doc_id", "ids", "share", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "rid long, doc_id long, ids binary, share double, rare array<long>"), "classes")


def _batched(texts, size: int, first: int = 0, step: int = 1):
    """Contexts and targets of every step-th position of texts in order, gathered to at least `size` positions, long texts in slices."""
    ctx, tgt, n = [], [], 0
    for ids in texts:
        c, ids = contexts(ids)[:, first::step], ids[first::step]
        for at in range(0, len(ids), size):
            ctx.append(c[:, at : at + size])
            tgt.append(ids[at : at + size])
            n += len(tgt[-1])
            if n >= size:
                yield np.concatenate(ctx, axis=1), np.concatenate(tgt)
                ctx, tgt, n = [], [], 0
    if n:
        yield np.concatenate(ctx, axis=1), np.concatenate(tgt)


def fit(classes: DataFrame, tokens: int, batch: int = 2048, levels: int = 64, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> np.ndarray:
    """The averaged weights after all rounds; the seeded ones where there are no words."""
    shards = max(1, min(SHARDS, -(-tokens // shard_tokens)))
    mixed = F.xxhash64("ids", "doc_id")  # copies of a text part by their ids
    dealt = classes.select("ids", mixed.alias("mixed")).repartition(shards, "mixed").sortWithinPartitions("mixed", "ids").select("ids")
    schema = "chunk long, salt long, n long, w array<double>"

    def train(sent, number):
        def run(batches):
            from pyspark import TaskContext

            flat, sum2 = sent.value
            net, seen = Net(flat), 0
            net.sum2 = np.array(sum2, np.float32)
            texts = (np.frombuffer(x, "<u2").astype(np.int64) for b in batches for x in b.column(0).to_pylist())
            for ctx, tgt in _batched(texts, batch, number, rounds):
                net.learn(ctx, tgt)
                seen += len(tgt)
            if seen:
                salt = TaskContext.get().partitionId() % levels
                whole = np.concatenate((net.flat, net.sum2)).astype(np.float64) * seen
                cuts = [whole[at : at + CHUNK] for at in range(0, len(whole), CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cuts)), pa.int64()), pa.array([salt] * len(cuts), pa.int64()), pa.array([seen] * len(cuts), pa.int64()), pa.array(cuts, pa.list_(pa.float64()))], ["chunk", "salt", "n", "w"]
                )

        return run

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        order = pdf.assign(k=[x.tobytes() for x in pdf.w]).sort_values("k")  # the same sum whatever arrives first
        return pd.DataFrame({"chunk": [head.chunk], "salt": [head.salt], "n": [int(pdf.n.sum())], "w": [np.sum(np.stack(list(order.w)), axis=0)]})

    net = Net()
    state = (net.flat, net.sum2)
    for number in range(rounds):
        sent = classes.sparkSession.sparkContext.broadcast(state)
        parts = dealt.mapInArrow(train(sent, number), schema)
        sums = parts.groupBy("chunk", "salt").applyInPandas(add, schema).withColumn("salt", F.lit(0).cast("long")).groupBy("chunk", "salt").applyInPandas(add, schema)
        rows = sorted(sums.collect(), key=lambda r: r.chunk)  # the network's 34 chunks
        if rows:
            whole = np.concatenate([np.array(r.w) / r.n for r in rows]).astype(np.float32)
            state = (whole[: len(net.flat)], whole[len(net.flat) :])
        sent.unpersist()
    return state[0]


def score(classes: DataFrame, counts: DataFrame, weights: np.ndarray, batch: int = 8192) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob) of the rows of to_classes."""
    sent = classes.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        net = Net(sent.value)
        for b in batches:
            texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in b.column(2).to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            logs = [net.log_probs(c, t).astype(np.float64) for c, t in _batched(texts, batch)]
            sums = np.concatenate(([0.0], np.cumsum(np.concatenate(logs)))) if logs else np.zeros(1)
            ends = np.cumsum(lengths)
            total = sums[ends] - sums[ends - lengths] + b.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths), pa.array(total)], ["rid", "doc_id", "n_tokens", "part"])

    scored = classes.select("rid", "doc_id", "ids", "share").mapInArrow(run, "rid long, doc_id long, n_tokens long, part double")
    rare = classes.where(F.size("rare") > 0).select("rid", F.explode("rare").alias("k")).join(counts, "k", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.log(F.coalesce("n", F.lit(UNSEEN)))).alias("more"))
    whole = scored.join(rare, "rid", "left").withColumn("log_likelihood", F.col("part") + F.coalesce("more", F.lit(0.0)))
    return whole.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob) for every row of docs, or of `others`, by a network trained on all of docs.

    Null, empty and blank texts have 0 tokens, 0.0 and null; long texts are read
    whole; repeated rows are learnt from and scored each, and equal texts score
    alike. Null ids stay null. Words that docs don't have count as half a word. Other columns
    are not read; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    words = vocabulary(docs)
    classes = to_classes(docs, words)
    weights = fit(classes, words.tokens)
    if others is not None:
        dropped(classes)
        classes = to_classes(others, words)
    return score(classes, words.counts, weights)


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see pseudo_likelihood for nulls, empty and long texts, ties, repeated rows and empty tables."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
