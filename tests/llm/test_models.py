"""Held-out accuracy of the fitted models, and their parts against simple versions."""

import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from strataloom.llm.plm import CLASSES, UNSEEN, Net, contexts, op7_pseudo_likelihood, pseudo_likelihood, to_classes, vocabulary, words_of
from strataloom.llm.quality import NAMES, cut_between, fit_described, fit_pairs, fit_quality, op1_quality, score_quality
from strataloom.llm.toxicity import fit_toxicity, ftrl, op8_toxicity, score_toxicity

from .corpora import empty, odd, odd_rows


def area(scores, y):
    """Area under the ROC curve by ranks."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held(spark, sf, query, label):
    """Scores and labels of the rows that no fit has read, all rows' shape checked."""
    rows = query(spark, sf).collect()
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in y]
    return out, np.array([y[r.doc_id] for r in out])


def test_quality_on_held_out_rows(spark):
    rows, y = held(spark, "/root/testdata/sf0.1", op1_quality, "quality")
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert area(np.array([r.score for r in rows]), y) > 0.9
    assert np.mean([r.predicted == v for r, v in zip(rows, y)]) > 0.85


@pytest.mark.parametrize(("sf", "least"), [("/root/testdata/sf0.1", 0.75), ("/root/testdata/check_s", 0.9)])  # some 350 and 1700 toxic rows to learn from
def test_toxicity_on_held_out_rows(spark, sf, least):
    if not os.path.isdir(sf):
        pytest.skip("no such table")
    rows, y = held(spark, sf, op8_toxicity, "toxic")
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert area(np.array([r.score for r in rows]), y) > 0.95
    caught = np.mean([r.predicted for r, v in zip(rows, y) if v])
    wrong = np.mean([r.predicted for r, v in zip(rows, y) if not v])
    assert caught > least and wrong < 0.02


def test_bradley_terry_recovers_a_ranking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(NAMES)))
    y = (x[:, 0] - 2 * x[:, 3] + 0.1 * rng.normal(size=600) > 0).astype(int)
    w = fit_pairs(x, y)
    assert area(x @ w, y) > 0.99 and w[0] > 0 > w[3]
    assert not fit_pairs(x, np.ones(600)).any()


def test_blank_texts_score_below_the_cut_unless_labels_say_otherwise(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "words", "here"]) + str(rng.randrange(50)) for _ in range(60)) if i % 2 else "## || " * 20) for i in range(200)]
    rows += [(200 + i, [None, "", " \n\t"][i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    more = few.unionByName(spark.createDataFrame([(200 + i, 1) for i in range(90)], "doc_id long, quality int"))
    for labels, above in ((few, False), (more, True)):
        got = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
        assert len({got[i] for i in range(200, 290)}) == 1 and (got[200] >= 0.3) == above
        assert np.mean([got[i] >= 0.3 for i in range(1, 200, 2)]) > 0.9 and np.mean([got[i] >= 0.3 for i in range(0, 200, 2)]) < 0.1


def test_all_labelled_rows_and_pairs_count(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, len(NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=9000) > 1).astype(int)
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5][:9000]
    seen = spark.createDataFrame([(i, r) for i, r in zip(ids, x.tolist())], "doc_id long, x array<double>")
    w, cut, _ = fit_described(seen, spark.createDataFrame(list(zip(ids, y.tolist())), "doc_id long, quality int"))
    raw = x @ w
    assert (raw < cut).sum() == (y == 0).sum() > 4000  # the quantile of all rows; there were 4,000 of a class at most
    z = (x - x.mean(0)) / x.std(0)
    v, good, bad = w * x.std(0), z[y == 1], z[y == 0]
    grad = 1e-3 * v  # of all pairs, one by one
    for at in range(0, len(good), 200):
        p = 1 / (1 + np.exp(-((good[at : at + 200] @ v)[:, None] - (bad @ v)[None])))
        grad -= ((1 - p).sum(1) @ good[at : at + 200] - (1 - p).sum(0) @ bad) / len(good) / len(bad)
    assert np.abs(grad).max() < 1e-3


def test_cut_between_ties(spark):
    df = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "raw double")
    assert cut_between(df([1] * 80 + [5] * 20), 80) == 3 and cut_between(df([1] * 80 + [5] * 20), 30) == 3
    assert cut_between(df([1, 2, 2, 2, 9]), 1) == 1.5 and cut_between(df([4] * 9), 3) == 4


def slow_ftrl(rows, size, epochs, alpha, beta, l1, l2):
    z, n, zb, nb = [0.0] * size, [0.0] * size, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for at, y in rows:
            w = {i: weight(i) for i in at}
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in at:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - step * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    return [weight(i) for i in range(size)]


def test_ftrl_against_the_plain_rule():
    rng = random.Random(6)
    rows = [(np.array(sorted(rng.sample(range(64), 6)), np.int32), rng.randint(0, 1)) for _ in range(300)]
    w, _ = ftrl(rows, bits=6, epochs=2, alpha=0.1, beta=1.0, l1=1.0, l2=1.0)
    assert np.allclose(w, slow_ftrl([(a.tolist(), y) for a, y in rows], 64, 2, 0.1, 1.0, 1.0, 1.0))
    assert 0 < (w != 0).sum() < 64


def test_odd_rows(spark):
    docs, none = odd(spark), empty(spark)
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 1, 1), (5, None, None), (None, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for d, lab in ((docs, labels), (docs, labels.limit(0)), (none, labels)):
        n = d.count()
        assert score_quality(d, fit_quality(d, lab)).where("score between 0 and 1").count() == n
        got = score_toxicity(d, fit_toxicity(d, lab), ["doc_id", "score"])
        assert got.where("tox_score between 0 and 1").count() == n
    assert {r.n_tokens == 0 for r in pseudo_likelihood(docs).where("mean_log_prob is null").collect()} == {True}
    assert pseudo_likelihood(docs).count() == len(odd_rows()) and pseudo_likelihood(none).count() == 0


def test_pseudo_likelihood_is_normalised_and_learns():
    net, rng = Net(), np.random.default_rng(1)
    ids = rng.integers(0, 8, 400)
    ctx = contexts(ids)
    one = np.repeat(ctx[:, :1], CLASSES, axis=1)
    assert abs(np.exp(net.log_probs(one, np.arange(CLASSES)).astype(np.float64)).sum() - 1) < 1e-3
    before = net.log_probs(ctx, ids).mean()
    for _ in range(60):
        net.learn(ctx, ids)
    assert net.log_probs(ctx, ids).mean() > before + 1


def test_gradient_by_differences():
    net, rng = Net(), np.random.default_rng(2)
    ids = rng.integers(0, CLASSES, 30)
    ctx = contexts(ids)
    old, loss = net.flat.copy(), lambda n: -n.log_probs(ctx, ids).astype(np.float64).mean()
    net.sum2 = np.ones_like(net.flat) * 1e12  # steps so small that they show the gradient
    net.learn(ctx, ids, rate=1e6)
    g = (old - net.flat).astype(np.float64)
    direction = g / np.linalg.norm(g)
    eps = 1e-2
    up, down = Net(old + eps * direction), Net(old - eps * direction)
    assert abs((loss(up) - loss(down)) / (2 * eps) - g @ direction) < 0.05 * np.linalg.norm(g)


def test_pseudo_likelihood_of_the_whole_table(spark, small):
    rows = op7_pseudo_likelihood(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.log_likelihood <= 1e-9 and (r.mean_log_prob is None) == (r.n_tokens == 0) for r in rows)


def test_prose_scores_above_its_shuffles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rng, both = random.Random(1), []
    for r in docs.where("doc_id % 10 = 3").collect():
        w = (r.text or "").split()
        if len(w) >= 50:
            both += [(2 * r.doc_id, " ".join(w)), (2 * r.doc_id + 1, " ".join(rng.sample(w, len(w))))]
    got = {r.doc_id: r.log_likelihood for r in pseudo_likelihood(docs, spark.createDataFrame(both, "doc_id long, text string")).collect()}
    assert np.mean([got[d] > got[d + 1] for d in got if d % 2 == 0]) >= 0.9


def test_held_out_perplexity_is_below_a_unigram_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    learnt, kept = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    counts = Counter(w for r in learnt.collect() for w in words_of(r.text))
    total = sum(counts.values())
    unigram = sum(math.log(counts.get(w, UNSEEN) / total) for r in kept.collect() for w in words_of(r.text))
    got = pseudo_likelihood(learnt, kept).agg({"log_likelihood": "sum", "n_tokens": "sum"}).first()
    assert got["sum(log_likelihood)"] > unigram + 0.1 * got["sum(n_tokens)"]


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    one, two = ({r.doc_id: r.log_likelihood for r in pseudo_likelihood(docs.repartition(k)).collect()} for k in (2, 7))
    assert set(one) == set(two) and all(abs(one[d] - two[d]) <= 1e-6 * max(1, abs(one[d])) for d in one)


def test_shares_of_words_make_a_distribution(spark):
    texts = [(i, " ".join(f"w{j % (i + 2)}" for j in range(40))) for i in range(30)] + [(99, "w0 w1 rare word w2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for known in (10, 3):  # with words whose counts are joined, and without
        words = vocabulary(docs, known)
        counts = {r.k: r.n for r in words.counts.collect()}
        every = sorted({w for _, t in texts for w in t.split()})
        assert sum(counts.values()) == words.tokens == sum(len(t.split()) for _, t in texts)
        ones = to_classes(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), words).collect()
        share = {}
        for r in ones:
            c = int(np.frombuffer(r.ids, "<u2")[0])
            share[c] = share.get(c, 0) + math.exp(r.share + sum(math.log(counts[k]) for k in r.rare))
        assert all(abs(v - 1) < 1e-9 for v in share.values())


def test_both_passes_against_plain_rules():
    net, rng = Net(), np.random.default_rng(7)
    net.flat += rng.normal(0, 0.3, len(net.flat)).astype(np.float32)
    ids = np.minimum(rng.zipf(1.3, 500), CLASSES) - 1
    ctx, n = contexts(ids), len(ids)
    E, b0, Wa, ba, G, Wb, C = (getattr(net, k).astype(np.float64) for k in ("E", "b0", "Wa", "ba", "G", "Wb", "C"))
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    want, g = np.zeros(n), {k: np.zeros_like(x) for k, x in zip(("E", "b0", "Wa", "ba", "G", "Wb", "C"), (E, b0, Wa, ba, G, Wb, C))}
    for i, t in enumerate(ids):  # one position at a time
        h = np.tanh(sum(E[k][c[i]] for k, c in enumerate(ctx)) + b0)
        a, b = t >> 5, t & 31
        p, q = soft(h @ Wa + ba), soft((h * G[a]) @ Wb + C[a])
        want[i] = np.log(p[a]) + np.log(q[b])
        p[a] -= 1
        q[b] -= 1
        back = Wb @ q
        dh = (Wa @ p + back * G[a]) * (1 - h * h)
        for k, c in enumerate(ctx):
            g["E"][k][c[i]] += dh / n
        for k, x in (("b0", dh), ("Wa", np.outer(h, p)), ("ba", p), ("Wb", np.outer(h * G[a], q))):
            g[k] += x / n
        g["G"][a] += back * h / n
        g["C"][a] += q / n
    assert np.allclose(net.log_probs(ctx, ids), want, atol=1e-4)
    old = net.flat.copy()
    net.sum2 = np.full_like(net.flat, 1e12)  # steps in proportion to the gradient
    net.learn(ctx, ids, rate=1e6)
    assert np.allclose(old - net.flat, np.concatenate([g[k].ravel() for k in g]), atol=1e-5)


def test_scores_cost_less_than_sums_along_short_rows():
    net, rng = Net(), np.random.default_rng(8)
    ids = rng.integers(0, CLASSES, 8192)
    ctx, at, a, b = contexts(ids), np.arange(8192), ids >> 5, ids & 31

    def soft(z):
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def by_rows():
        h = np.tanh(sum(net.E[k][c] for k, c in enumerate(ctx)) + net.b0)
        return soft(h @ net.Wa + net.ba)[at, a] + soft((h * net.G[a]) @ net.Wb + net.C[a])[at, b]

    def least(f):
        took = []
        for _ in range(30):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert np.allclose(net.log_probs(ctx, ids), by_rows(), atol=1e-4)
    assert least(lambda: net.log_probs(ctx, ids)) < 0.75 * least(by_rows)
