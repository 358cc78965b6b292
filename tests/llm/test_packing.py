import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataloom.llm.packing import Packer, WordBpe, op10_packing, pack_documents, vocabulary

from .corpora import empty, odd, odd_rows


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(vocabulary())


def check(rows, texts, whole, size=4096):
    """Every id of every document in exactly one piece; no gaps in a sequence."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, t in texts:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), size):
            cut = np.array(ids[at : at + size], "<u4")
            want[d].append((at, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
    assert {d: sorted(v) for d, v in want.items()} == {d: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in v) for d, v in by_doc.items()}
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return sum(r.length for r in rows), len(by_seq)


def test_whole_table(spark, small, whole):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    tokens, sequences = check(op10_packing(spark, small).collect(), texts, whole)
    assert tokens >= 0.97 * 4096 * (sequences - 1)


def test_odd_rows(spark, whole):
    check(pack_documents(odd(spark), vocabulary(), 64).collect(), [(r[0], r[1]) for r in odd_rows()], whole, 64)
    assert pack_documents(empty(spark), vocabulary()).count() == 0


def test_ids_equal_those_of_the_library(whole):
    rng, bpe = random.Random(8), WordBpe(vocabulary(), limit=50)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEÉéßÆæøÿŸĀſʼŉİǰ'’.,;:!?0123456789#@ \t\n\x1c-_$%&()[]{}|<>~^`´¨½²µªº×÷ÐþŐǄ漢Σς"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_strings_of_special_tokens_are_read_as_the_file_reads_them(spark, whole):
    bpe = WordBpe(vocabulary())
    for text in ("hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|> <|endoftext >", "é <|endoftext|> ß", "<|endoftext|><|endoftext|>"):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert 49407 in whole.encode("hello <|endoftext|> world", add_special_tokens=False).ids
    rows = [(1, "hello <|endoftext|> world"), (2, "<|startoftext|>")]
    check(pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), 8).collect(), rows, whole, 8)


def test_each_place_minimises_the_sum_of_squares():
    rng, packer, counts = random.Random(1), Packer(50), [0] * 51
    for _ in range(2000):
        s = rng.randint(1, 50)

        def cost(h):
            n = list(counts)
            if h:
                n[h] -= 1
            if h + s < 50:
                n[h + s] += 1
            return sum(x * x for x in n)

        allowed = [h for h in range(50 - s + 1) if h == 0 or counts[h]]
        _, h = packer.place(s)
        assert h in allowed and cost(h) == min(map(cost, allowed))
        if h:
            counts[h] -= 1
        if h + s < 50:
            counts[h + s] += 1
