import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm.hilbert import below, document_rows, hilbert_index, hilbert_shards, numbered, op2_hilbert, shard_documents, write_shards

from .corpora import empty, odd, odd_rows


def test_curve_visits_every_cell_by_single_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(product(range(1 << bits), repeat=d)))
        order = np.argsort(hilbert_index(points, bits))
        assert sorted(hilbert_index(points, bits)) == list(range(1 << (bits * d)))
        assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, shards=8):
    size = lambda t: len((t or "").encode("utf-8", "surrogatepass")) + 1
    want = Counter((d, size(t), zlib.crc32((t or "").encode("utf-8", "surrogatepass"))) for d, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, totals = {}, Counter()
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        totals[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < shards for s in slots)
    return totals


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    totals = check(op2_hilbert(spark, small).collect(), [(r.doc_id, r.text) for r in docs])
    largest = max(len(r.text.encode()) for r in docs)
    assert len(totals) == 8 and max(totals.values()) - min(totals.values()) <= 2 * largest


def test_shards_prune_by_every_dimension(spark, small):
    rows = shard_documents(spark.read.parquet(f"{small}/documents.parquet")).collect()
    rng = random.Random(1)
    dealt = [rng.randrange(8) for _ in rows]
    for dim in ("lang", "source", "size", "doc_id"):
        values = sorted({getattr(r, dim) for r in rows})
        values = values[:: max(1, len(values) // 40)]

        def read(shards):
            """Shards whose least and greatest value leave a wanted value possible, on average."""
            reach = {}
            for r, s in zip(rows, shards):
                v = getattr(r, dim)
                lo, hi = reach.get(s, (v, v))
                reach[s] = (min(lo, v), max(hi, v))
            return np.mean([sum(lo <= v <= hi for lo, hi in reach.values()) for v in values])

        assert read([r.shard for r in rows]) < 0.9 * read(dealt), dim


def test_odd_rows_and_files(spark, tmp_path):
    check(shard_documents(odd(spark)).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert shard_documents(empty(spark)).count() == 0
    rows = [(i, "x" * i, "en", "web") for i in range(200)] + [(None, "no id", None, "web")] * 3 + [(7, "again", "de", None)] * 2
    docs = numbered(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    write_shards(docs, shard_documents(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (str(r[0]), r[1], str(r[2]), str(r[3]))
    assert sorted(map(key, back.select("doc_id", "text", "lang", "source").collect())) == sorted(map(key, rows))
    assert back.select("shard").distinct().count() == 8


def test_hot_cells_are_dealt_in_parts(spark):
    rows = [(None, "same", "en", "web")] * 500 + [(i, "x" * (i % 9), "en", "web") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sized = document_rows(docs)
    got = hilbert_shards(sized, {"lang": below(F.col("lang"), [("en", 1)])}, "size", 4, order=("doc_id", "text_crc32"), part_rows=50)
    check(got.collect(), [(r[0], r[1]) for r in rows], 4)
