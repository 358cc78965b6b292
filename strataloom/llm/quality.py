"""Quality scores by Bradley-Terry pairwise ranking.

Every labelled row that is not held out is compared with every one of the other
class. The probability that the better one wins is
sigmoid(w . (x_better - x_worse)); w minimises the logistic loss on these
feature differences with a ridge term, by Newton steps. The pairs are never
listed: rows are added up by class and by cell of their score, a CELLS-th
wide, and two cells stand for all pairs between their rows, at their mean scores.
So a step is one pass over the rows, on the executors, and what comes back
doesn't grow with them. w . x then scores every document, and the quantile of
all these rows' scores that has as many below as there are worse rows is the
cut: it maps to a score of 0.3, the rest follows the logistic curve.

A text without words has no features to rank it by. Its score is the share of
better ones among the labelled texts without words, one more observation worth
BLANK added: 0.1 where none is labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import held_out, small_batches, stored, table

CELLS = 8
CUT = 0.3
BLANK = 0.1
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>{}[]\\^~=_@/"
_PUNCT = b".,;:?\"'()-"
NAMES = [
    "log_words", "chars_per_word", "upper", "digits", "symbols", "punctuation", "exclamation", "distinct_words", "top_word", "adjacent_repeats",
    "distinct_triples", "dup_lines", "log_line_words", "short_lines", "long_word", "upper_words", "short_words", "pipes", "sentence_ends",
]


def describe(text: str | None) -> list[float] | None:
    """The features of a whole text, in the order of NAMES; None for null and blank texts."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return None
    chars = sum(map(len, words))
    share = lambda drop: (len(data) - len(data.translate(None, drop))) / chars
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    return [
        math.log1p(n), math.log(chars / n), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_PUNCT), data.count(b"!") / n, len(counts) / n ** 0.9, max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, triples if n > 2 else 1.0, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(len(x) < 30 for x in lines) / len(lines),
        math.log1p(max(map(len, words))), sum(map(bytes.isupper, words)) / n, sum(len(w) <= 3 for w in words) / n, data.count(b"|") / n, len(re.findall(rb"[.!?](?:\s|$)", data)) / n,
    ]


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w . x of each row; rows alike get the same number in any batch."""
    return (np.ascontiguousarray(x) * w).sum(1)


def cell_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Rows, features and products of features of the rows z, added up by (class, cell of z . w)."""
    cell = np.floor(np.clip(z @ w, -40, 40) * CELLS).astype(int)
    out = {}
    for key in set(zip(y.tolist(), cell.tolist())):
        own = z[(y == key[0]) & (cell == key[1])]
        out[key] = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    return out


def newton(sums, d: int, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Bradley-Terry weights over all pairs of a better and a worse row; sums(w) gives cell_sums of all rows. Zeros without rows of both classes."""
    w = np.zeros(d)
    for _ in range(steps):
        got = sums(w)
        sides = [np.array([v for k, v in sorted(got.items()) if k[0] == y]).reshape(-1, 1 + d + d * d) for y in (1, 0)]
        if not all(map(len, sides)):
            return np.zeros(d)
        (n, zg, gg), (m, zb, gb) = ((s[:, 0], s[:, 1 : 1 + d], s[:, 1 + d :]) for s in sides)
        p = 1 / (1 + np.exp(-np.clip((zg @ w / n)[:, None] - (zb @ w / m)[None], -30, 30)))
        q, pairs = p * (1 - p), n.sum() * m.sum()
        grad = (n @ (1 - p)) @ zb - ((1 - p) @ m) @ zg
        cross = zg.T @ q @ zb
        hess = (((q @ m) @ gg) + ((n @ q) @ gb)).reshape(d, d) - cross - cross.T
        move = np.linalg.solve(hess / pairs + ridge * np.eye(d), grad / pairs + ridge * w)
        w = w - move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-3:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bradley-Terry weights on raw features; zeros without rows of both classes."""
    sd = x.std(0) + 1e-9
    z = (x - x.mean(0)) / sd
    return newton(lambda w: cell_sums(z, y, w), x.shape[1]) / sd


def _numbers(column: pa.Array) -> np.ndarray:
    """The rows of a column of features that are not null."""
    return column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _added(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """cell_sums of rows(y, x), added up by the executors."""

    def run(batches):
        total: dict = {}
        for b in batches:
            for k, v in cell_sums((_numbers(b.column(1)) - mean) / sd, b.column(0).to_numpy(), w).items():
                total[k] = total.get(k, 0) + v
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))], ["y", "cell", "s"])

    def add(frame):
        one = frame.iloc[:1].copy()
        one["s"] = [np.sum(np.stack(frame["s"].to_list()), axis=0)]
        return one

    form = "y int, cell int, s array<double>"
    return {(r.y, r.cell): np.array(r.s) for r in rows.select("y", "x").mapInArrow(run, form).groupBy("y", "cell").applyInPandas(add, form).collect()}  # at most 2 * 80 * CELLS rows


def cut_between(raws: DataFrame, k: int, cells: int = 4096) -> float:
    """A number with k rows of raws(raw) below it, or as near to k as equal ones allow. 0 < k."""
    lo, hi, n = raws.agg(F.min("raw"), F.max("raw"), F.count("*")).first()
    before = 0
    while lo < hi:  # into the cell of the k-th, until it holds one value
        at = F.least(F.lit(cells - 1), F.floor((F.col("raw") - lo) / F.lit(hi - lo) * cells))
        found = raws.where(F.col("raw").between(lo, hi)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).orderBy("at").collect()  # at most `cells` rows
        for r in found:
            if before + r.n >= k:
                break
            before += r.n
        if len(found) == 1:  # neighbouring numbers
            lo = hi = r.lo
        else:
            lo, hi = r.lo, r.hi
    less, more = F.col("raw") < lo, F.col("raw") > lo
    below, above, under, over = raws.agg(F.count_if(less), F.count_if(more), F.max(F.when(less, F.col("raw"))), F.min(F.when(more, F.col("raw")))).first()
    if above and (not below or n - above - k <= k - below):
        return (lo + over) / 2
    return (under + lo) / 2 if below else lo


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row of docs, x null for texts without words."""
    small_batches(docs.sparkSession)
    return _described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long")


def fit_described(seen: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """(w, cut, score of a blank text) from described texts: see fit_quality."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = stored(seen.join(labels, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")), "quality-rows")
    n = {(r.y, r.blank): r["count"] for r in rows.groupBy("y", F.col("x").isNull().alias("blank")).count().collect()}  # four rows
    blank = [n.get((y, True), 0) for y in (0, 1)]
    empty = (blank[1] + BLANK) / (sum(blank) + 1)
    if not n.get((0, False)) or not n.get((1, False)):
        return np.zeros(len(NAMES)), 0.0, empty
    rows = rows.where("x is not null")
    d = len(NAMES)
    plain = sum(_added(rows, np.zeros(d), np.ones(d), np.zeros(d)).values())
    mean = plain[1 : 1 + d] / plain[0]
    sd = np.sqrt(np.maximum(0, plain[1 + d :].reshape(d, d).diagonal() / plain[0] - mean**2)) + 1e-6
    w = newton(lambda w: _added(rows, mean, sd, w), d) / sd

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_raw(_numbers(b.column(0)), w))], ["raw"])

    return w, cut_between(stored(rows.select("x").mapInArrow(run, "raw double"), "quality-raws"), n[0, False]), empty


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """(w, cut, score of a blank text) from all labelled rows that are not held out.

    Labels that are null or of null ids are left out; repeated labels of an id
    count once, the lower one, and so do its repeated rows, the one whose
    features come first. Without both classes w is zero and all texts that have
    words score alike.
    """
    return fit_described(described(docs), labels)


def _described(df: DataFrame, kept: str) -> DataFrame:
    """df's columns but the last, text, which becomes x, its features."""

    def run(batches):
        for b in batches:
            rows = [describe(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*b.schema.names[:-1], "x"])

    return df.mapInArrow(run, kept + ", x array<double>")


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, score) of every row, repeated ones and null ids too.

    The cut scores 0.3; null, empty and blank texts have the model's score of a
    blank text. Whole texts are read, however long; equal texts score alike.
    Other columns are not read; an empty table gives none.
    """
    return score_described(described(docs), model)


def score_described(seen: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """(doc_id, score) of described texts: see score_quality."""
    w, cut, blank = model

    def run(batches):
        for b in batches:
            score = np.full(b.num_rows, blank)
            score[b.column(1).is_valid().to_numpy(zero_copy_only=False)] = 1 / (1 + np.exp(-np.clip(_raw(_numbers(b.column(1)), w) - cut + math.log(CUT / (1 - CUT)), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return seen.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see fit_quality and score_quality for nulls, empty and long texts, ties, repeated rows and empty tables."""
    seen = stored(described(table(spark, sf_dir, "documents")), "quality-seen")  # read by the fit and by the scores
    scored = score_described(seen, fit_described(seen, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
