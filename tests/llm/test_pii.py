import hashlib
import random
import re

from pyspark.sql import functions as F

from strataloom.llm.pii import KINDS, find_personal_data, listed, op4_pii

from .corpora import empty, odd, odd_rows

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(FORMS[kind], text or "", re.ASCII) if good(kind, m[0])]
    return sorted(found)


def same_base(rows, texts):
    want = {}
    for d, t in texts:
        found = brute(t)
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
        want.setdefault(d, []).append((*(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(line.encode()).hexdigest()))
    have = {}
    for r in rows:
        have.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    assert {d: sorted(v) for d, v in have.items()} == {d: sorted(v) for d, v in want.items()}


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = op4_pii(spark, small).collect()
    same_base(rows, [(r.doc_id, r.text) for r in docs])
    texts = {r.doc_id: r.text for r in docs}
    for r in rows:  # the base spans stay
        mine = set(filter(None, r.spans.split(",")))
        assert {f"{KINDS[k]}:{s}:{e}" for s, k, e in brute(texts[r.doc_id])} <= mine


TRICKY = [
    "a@b.c a@b.c.d-e x..y@z-.q, 1@2.3", "@@a@b.c@d.e", "a@b a@b.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9999999999999999999999.1.1.1", "v1.2.3.4e",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111111", "+1 (415) 555-0100 +44 20 7946 0958. +1 2", "😀 a@b.co 漢字 +49 30 1234567890 1.1.1.1", "a" * 3000 + "@", "9 " * 3000, "+1" + "(" * 3000,
    "+1+2 345 678 9012", "--a@b.c--d", "4222222222222 4222-2222-2222-2", "mail:A.B%c+d-e_f@HOST-1.example.ORG;next", "1.2.3.4\n5.6.7.8",
]


def test_tricky_and_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(100 + i, r[1]) for i, r in enumerate(odd_rows())]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).alias(f"n_{KINDS[k]}")
    same_base(got.select("doc_id", *map(count, range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256")).collect(), rows)
    assert find_personal_data(odd(spark)).count() == len(odd_rows())
    assert find_personal_data(empty(spark)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 415 555 {1000 + i} today") for i in range(12)]
    rows += [(50, "please call me at 0171-998877 today"), (51, "we sold 0171-998877 pieces last year"), (52, "chapter 12 begins")]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", listed(F.col("spans")).alias("spans"), F.size("base").alias("n")).collect()}
    assert got[50].n == 0 and got[50].spans == "phone:18:29"
    assert got[51].spans == "" and got[52].spans == ""


def found(spark, rows):
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.spans for r in got.select("doc_id", listed(F.col("spans")).alias("spans")).collect()}


def test_contexts_hold_whole_words_however_long(spark):
    long = "call" * 700
    rows = [(i, f"{long}A {' ' * 400}{long}B +1 415 555 {1000 + i} {long}C") for i in range(6)]
    rows += [(20 + i, f"{long}X {' ' * 400}{long}B 0171-99887{i} {long}C") for i in range(2)]  # the first word differs beyond any window
    rows += [(30, f"{long}A {' ' * 400}{long}B 0171-998870 {long}C")]
    got = found(spark, rows)
    assert got[20] == got[21] == "" and got[30].startswith("phone:")


def test_found_instances_support_further_patterns(spark):
    rows = [(i, f"please call me at +1 415 555 {1000 + i} today") for i in range(60)]
    rows += [(100 + i, f"please call me at 0171-99{8700 + i} today") for i in range(12)]
    rows += [(200 + i, f"our hotline answers 0171-99{8700 + i} always") for i in range(12)]  # no seed here
    rows += [(300, "our hotline answers 555 010 4477 always"), (301, "our store sells 555 010 4477 always")]
    got = found(spark, rows)
    assert all(got[d].startswith("phone:") for d in (100, 111, 200, 211))
    assert got[300] == "phone:20:32" and got[301] == ""


def test_recall_and_precision_of_unseen_identifiers(spark):
    rng = random.Random(7)
    frames = [("reach {} at desk", "phone"), ("mail goes to {} since", "email"), ("logged in from {} again", "ip"), ("ticket number {} of", None), ("sold about {} units", None)]
    known = {"phone": lambda: f"+49 30 {rng.randrange(10**6, 10**7)}", "email": lambda: f"u{rng.randrange(10**6)}@mail{rng.randrange(99)}.example.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    unseen = {"phone": lambda: f"030-{rng.randrange(10**6)}", "email": lambda: f"u{rng.randrange(10**6)}@localhost", "ip": lambda: f"fe80::{rng.randrange(16**4):x}:{rng.randrange(10)}"}
    rows, want = [], {}
    for d in range(600):
        frame, kind = rng.choice(frames)
        new = rng.random() < 0.15
        v = (unseen if new else known)[kind]() if kind else str(rng.randrange(10**7))
        lead = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 9)))
        text = f"{lead} {frame.format(v)} {lead}"
        rows.append((d, text))
        if new and kind:
            want[d] = f"{kind}:{text.index(v)}:{text.index(v) + len(v)}"
        elif not kind:
            want[d] = ""
    got = found(spark, rows)
    planted = [d for d in want if want[d]]
    assert len(planted) > 30 and sum(got[d] == want[d] for d in planted) >= 0.9 * len(planted)
    assert sum(got[d] == "" for d in want if not want[d]) >= 0.99 * sum(not v for v in want.values())
