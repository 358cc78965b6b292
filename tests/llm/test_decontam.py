import random
from itertools import combinations

import numpy as np

from strataloom.llm.decontam import AGREE, SPAN, Probe, find_overlaps, op9_decontamination, words_of

from .corpora import empty, odd, odd_rows, prose


def brute(doc, items, span=13, agree=0.75):
    """Items with a stretch of aligned words that agrees enough; no mask is asked."""
    w, found = words_of(doc), []
    for i, text in items:
        v = words_of(text)
        need, hit = min(span, len(v)), False
        if 0 < len(v) < 8:
            hit = any(w[s : s + len(v)] == v for s in range(len(w) - len(v) + 1))
        elif v:
            for shift in range(-len(v), len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                same = [w[p + shift] == v[p] for p in range(lo, hi)]
                if any(sum(same[s : s + need]) >= need * agree for s in range(len(same) - need + 1)):
                    hit = True
                    break
        if hit:
            found.append(i)
    return sorted(found)


def test_substituted_passages_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n, 500)) for i, n in enumerate([5, 7, 8, 12, 13, 14, 30, 60, 60, 60])] + [(20, ""), (21, "...")]
    rows = []
    for d in range(120):
        w = prose(rng, 80, 500).split()
        if d % 3:
            v = rng.choice(items)[1].split()[: rng.choice([10, 20, 80])]
            v = [x if rng.random() > 0.12 else "zzz" for x in v]
            at = rng.randrange(len(w))
            w[at:at] = v
        rows.append((d, " ".join(w)))
    bench = spark.createDataFrame([*items, (None, "x y z"), (30, None)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {d: brute(t, items) for d, t in rows}
    assert sum(map(bool, got.values())) > 40
    blocks = {r.doc_id: r["items"] for r in find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=60).collect()}
    assert blocks == got


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "same words here"), (2, None)], "item_id long, text string")
    got = find_overlaps(odd(spark), bench, keep=["doc_id", "score"])
    assert got.count() == len(odd_rows())
    assert {r.doc_id for r in got.where("size(items) > 0").collect()} == {11, 12}
    assert find_overlaps(empty(spark), bench).count() == 0
    assert find_overlaps(odd(spark), bench.limit(0)).where("size(items) > 0").count() == 0


def test_whole_table_finds_whole_items(spark, small):
    bench = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r.doc_id: " " + " ".join(words_of(r.text)) + " " for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    holds = {d: {i for i, w in bench if w and " " + " ".join(w) + " " in t} for d, t in texts.items()}
    got = {r.doc_id: set(filter(None, r.item_ids.split(","))) for r in op9_decontamination(spark, small).collect()}
    assert set(got) == set(texts)
    assert any(holds.values())
    for d, items in holds.items():
        assert {str(i) for i in items} <= got[d]


def test_repeated_words_and_equal_items(spark):
    item = "same " * 60
    bench = spark.createDataFrame([(1, item), (2, item), (3, "tiny item"), (4, "tiny item"), (5, "other words " * 30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "same " * 200_000), (2, "a tiny item here"), (3, "nothing of it")], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in find_overlaps(docs, bench).collect()} == {1: [1, 2], 2: [3, 4], 3: []}


def test_every_pattern_of_substitutions_is_found():
    for n in range(8, 14):
        item = np.arange(1, n + 1, dtype=np.uint64)
        probe = Probe([(1, list(item))], SPAN, AGREE)
        for k in range(n // 4 + 1):
            for gone in combinations(range(n), k):
                doc = item.copy()
                doc[list(gone)] = 99
                assert 1 in probe.find(doc), (n, gone)
