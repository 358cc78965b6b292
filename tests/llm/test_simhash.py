import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strataloom.llm import simhash
from strataloom.llm.simhash import anchor_keys, fingerprint, links, near_duplicate_groups, op6_simhash, parities, shingle_hashes, simhash_components, wide_fingerprint

from .corpora import Union, empty, near_copies, odd, odd_rows, prose, words


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """doc_id and fingerprint of each row to its component's least doc_id."""
    fps = sorted({fp for _, fp in rows})
    u = Union()
    for i, a in enumerate(fps):
        u.find(a)
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                u.join(a, b)
    least = {}
    for d, fp in rows:
        if d is not None:
            least[u.find(fp)] = min(d, least.get(u.find(fp), d))
    return sorted((str(d), f"{fp:016x}", str(least.get(u.find(fp)))) for d, fp in rows)


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_whole_table_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert got(op6_simhash(spark, small)) == brute_components(rows)


def test_odd_rows(spark):
    rows = [(r[0], brute_fingerprint(r[1])) for r in odd_rows()]
    assert got(simhash_components(odd(spark))) == brute_components(rows)
    assert simhash_components(empty(spark)).count() == 0
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_links_of_random_cubes_and_the_dense_path(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    u = Union()
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                u.join(a, b)
    want = {frozenset(x for x in fps if u.find(x) == r) for r in {u.find(x) for x in fps}}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for dense in (2_000, 0):
        v = Union()
        for r in links(table, 3, dense).collect():
            v.join(r.a % (1 << 64), r.b % (1 << 64))
        assert {frozenset(x for x in fps if v.find(x) == r) for r in {v.find(x) for x in fps}} == want


def test_near_duplicate_groups(spark):
    rows, family = near_copies()
    found = {r.doc_id: r.group_id for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for a in family:
        for b in family:
            assert (found[a] == found[b]) == (family[a] == family[b])
    odd_found = near_duplicate_groups(odd(spark))
    assert odd_found.count() == len(odd_rows())
    blank = {r.group_id for r in odd_found.where(F.col("doc_id").isin(0, 1, 2)).collect()}
    assert len(blank) == 1
    assert near_duplicate_groups(empty(spark)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicate_groups_find_every_similar_pair(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    found = {r.doc_id: r.group_id for r in near_duplicate_groups(docs).collect()}
    sets, first = {}, {}
    for r in rows:
        w = [x.lower() for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
        for s in sets[r.doc_id]:
            first.setdefault(s, []).append(r.doc_id)
    pairs = {(a, b) for v in first.values() if len(v) > 1 for i, a in enumerate(v) for b in v[i + 1 :]}
    alike = [p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    assert alike and sum(found[a] == found[b] for a, b in alike) >= 0.97 * len(alike)
    joined = {}
    for d, g in found.items():
        joined.setdefault(g, []).append(d)
    for members in joined.values():  # each has a relative in its group
        for d in members:
            assert len(members) == 1 or max(jaccard(sets[d], sets[e]) for e in members if e != d) > 0.55


def sketch(text):
    """Shingle set, wide fingerprint as bits, anchors."""
    h = np.unique(shingle_hashes(text.encode(), 5))
    return set(h.tolist()), int.from_bytes(wide_fingerprint(h).tobytes(), "little"), set(anchor_keys(h))


def test_shingles_decide_and_not_bits(spark):
    rng, rows, want = random.Random(11), [], {}
    far = near = 0
    while far < 6 or near < 6:
        base = prose(rng, 204, 10**6).split()
        changed = 22 if far < 6 else 40  # similarities of 0.80 and 0.67
        other = [*base[: -changed], *prose(rng, changed, 10**6).split()]
        (s, x, k), (t, y, m) = sketch(" ".join(base)), sketch(" ".join(other))
        bits = (x ^ y).bit_count()
        if not k & m or (bits <= 46) == (jaccard(s, t) >= 0.8):
            continue  # no meeting, or 46 bits would have told
        far, near = far + (bits > 46), near + (bits <= 46)
        want[len(rows)] = jaccard(s, t) >= 0.8
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    found = {r.doc_id: r.group_id for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: found[d] == found[d + 1] for d in want} == want


def test_pairs_within_a_shared_passage_meet(spark):
    rng, texts = random.Random(23), []
    passage = prose(rng, 81, 10**6)
    for _ in range(150):  # 0.80 alike; 0.63 and less to all others
        both = prose(rng, 12, 10**6)
        texts += [f"{passage} {both} {prose(rng, 11, 10**6)}" for _ in range(2)]
    sketches = [sketch(t) for t in texts]
    want = Union()
    for i, (s, _, k) in enumerate(sketches):
        want.find(i)
        for j, (t, _, m) in enumerate(sketches[:i]):
            if k & m and jaccard(s, t) >= 0.8:
                want.join(i, j)
    assert sum(want.find(i) != i for i in range(len(texts))) > 120
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small in (64, 10**6):  # by rare shingles, and pair by pair
        found = {r.doc_id: r.group_id for r in near_duplicate_groups(docs, small=small).collect()}
        first = {}
        for d in sorted(found):
            first.setdefault(found[d], d)
        for i in range(len(texts)):  # whoever meets is joined; by rare shingles a pair that shares no anchor may be too
            assert found[i] == found[want.find(i)]
            assert first[found[i]] >= i - 1


def test_fingerprints_three_bits_apart_meet_without_a_shared_minimum(spark):
    rng, refrain = random.Random(5), "x y z " * 600  # most shingles of either text, so that few bits differ
    for _ in range(20_000):  # one in some 900 will do
        base = prose(rng, 204, 10**6)
        texts = [refrain + base, refrain + " ".join([*base.split()[:-22], *prose(rng, 22, 10**6).split()])]
        if not sketch(texts[0])[2] & sketch(texts[1])[2]:
            break
    assert jaccard(sketch(texts[0])[0], sketch(texts[1])[0]) >= 0.8 and not sketch(texts[0])[2] & sketch(texts[1])[2]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() <= 3
    texts.append(refrain + prose(rng, 204, 10**6))  # near in bits, but unlike
    found = {r.doc_id: r.group_id for r in near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[0] == found[1] != found[2]


def test_unlike_copies_of_one_text_are_no_candidates(spark, monkeypatch):
    rng, made = random.Random(8), {}
    base = prose(rng, 150, 10**6).split()
    texts = []
    for _ in range(400):  # 0.6 to 0.75 alike, all with one another
        words = list(base)
        for at in rng.sample(range(150), 4):
            words[at] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [np.unique(shingle_hashes(t.encode(), 5)) for t in texts]
    for a, b in zip(sets, sets[1:]):  # the bound on what two sets differ in
        bits = sum(int(x).bit_count() for x in parities(a) ^ parities(b))
        assert 0 < bits <= len(np.setxor1d(a, b))
    stored = simhash.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert made["near-pairs"] + made["near-rest"] < 10 * len(texts)


def test_exploded_rows_are_never_sent_to_the_driver(spark, tmp_path):
    rng = random.Random(9)
    path = str(tmp_path / "fps")
    spark.createDataFrame([(rng.getrandbits(63), i) for i in range(20_000)], "fp long, node long").write.parquet(path)
    fps = spark.read.parquet(path)  # a third of a MB, which Spark's threshold lets pass; its guests are some 2.5 million rows
    sets = fps.select("node", F.col("node").alias("root"), F.array("fp", "node").alias("shingles"))
    rare = simhash._rare(sets)
    for df in (links(fps.select("fp")), simhash._dense_links(fps.select("fp")), rare, simhash._rare_pairs(rare, F.lit(True))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
