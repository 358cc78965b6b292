"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints at most three bits apart differ by at most one bit in
one of their 32-bit halves. The anchors of a half are the 2**26 words of the
perfect [31, 26] Hamming code, whose covering radius is one: the home anchor of
x lies within one bit of x, hence within covering radius plus threshold (two)
of any y that is one bit away. So every fingerprint is a guest of all anchors
within two bits (at most 16 for each half), a host at its home anchor, and
hosts are compared with guests anchor by anchor. No pair is missed.

Within an anchor the other half tells more: it differs in three bits at most, so
one of its quarters is equal. Hosts and guests therefore meet by anchor and a
quarter of the other half, some 2**34 keys, which keeps the comparisons of
random fingerprints few up to about 10**10 distinct texts (beyond that they
grow with the square of the number).

Equal fingerprints are merged before anchors are dealt. Keys with more than
`dense` hosts are not compared pair by pair: their fingerprints are linked
through the points of the cube around them (see `_dense_links`), which finds
the same components in rows linear in their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import connected, released, small_batches, stored, table, unsent

ONES = (1 << 64) - 1
#: Bits of a position's binary form j: the parity checks of the [31, 26] code.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words; of all words if there are fewer."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, seed=42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[s:e], seed=42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bytes (little-endian bits) of the per-bit majority of the rows of a (n, k) array of 64-bit hashes; ties are 0."""
    n = len(hashes)
    raw = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, -1)
    counts = np.zeros(raw.shape[1] * 8, np.int64)
    for at in range(0, n, 255):  # sums of 255 bits fit a byte, and byte sums vectorise
        counts += np.add.reduce(np.unpackbits(raw[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The contract's 64-bit fingerprint, unsigned. Null, empty and blank texts give zero."""
    h = shingle_hashes((text or "").encode(), width)
    return int(majority(h.reshape(-1, 1)).view(np.uint64)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of docs. Other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _parity(x, mask: int):
    return F.bit_count(x.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))


def _anchors(fps: DataFrame) -> DataFrame:
    """(fp, anchor, home): the anchors within two bits of each half; `home` marks the nearest."""
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned("fp", 33))
    half = fps.select("fp", F.posexplode(halves).alias("half", "x"))
    syndrome = sum((F.shiftleft(_parity(F.col("x"), c).cast("long"), j) for j, c in enumerate(CHECKS)), F.lit(0).cast("long"))
    half = half.withColumn("s", syndrome)
    near = F.expr(
        "concat(array(IF(s = 0, x, x ^ shiftleft(1L, cast(s - 1 as int)))), IF(s = 0, array(), transform("
        "filter(sequence(1L, 31L), p -> p <> s AND p < (p ^ s)), p -> x ^ shiftleft(1L, cast(p - 1 as int)) ^ shiftleft(1L, cast((p ^ s) - 1 as int)))))"
    )
    return half.select("fp", "half", F.posexplode(near).alias("k", "point")).select(
        "fp", (F.shiftleft(F.col("half").cast("long"), 31) + F.col("point")).alias("anchor"), (F.col("k") == 0).alias("home")
    )


def _dense_links(fps: DataFrame) -> DataFrame:
    """Links of all components among fps, for any density.

    Fingerprints are at most three bits apart iff some point lies within one
    bit of the one and two bits of the other. All fingerprints within one bit
    of a point are linked with one another and with all within two bits, so a
    star around the least of the former holds every link through that point.
    """
    one = [0] + [1 << i for i in range(64)]
    two = one + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = lambda xs: [x - (1 << 64) if x >> 63 else x for x in xs]
    ball = lambda xs: fps.select("fp", F.explode(F.lit(signed(xs)).cast("array<long>")).alias("d")).select("fp", F.col("fp").bitwiseXOR(F.col("d")).alias("point"))
    hubs = ball(one).groupBy("point").agg(F.min("fp").alias("a"))
    return ball(two).join(unsent(hubs), "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, threshold: int = 3, dense: int = 2_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within `threshold` bits (3 at most)."""
    if not 0 <= threshold <= 3:
        raise ValueError("the anchors cover thresholds from 0 to 3")
    rows = _anchors(fps)
    # an anchor holds bits 0 to 30 or 33 to 63 of a fingerprint; the other half's quarters are of eight bits
    quarter = "CAST((fp >> (8 * q + IF(anchor >> 31 = 0, 32, 0))) & 255 AS LONG)"
    keyed = rows.select("fp", "home", "anchor", F.explode(F.array(*(F.lit(q) for q in range(4)))).alias("q"))
    keyed = keyed.select("fp", "home", F.expr(f"(anchor << 10) | (q << 8) | {quarter}").alias("key"))
    hosts = keyed.where("home").select("key", F.col("fp").alias("a"))
    guests = keyed.select("key", F.col("fp").alias("b"))
    crowded = stored(hosts.groupBy("key").count().where(F.col("count") > dense).select("key"), "crowded")
    extra = None
    if not crowded.isEmpty():
        within = guests.join(crowded, "key", "left_semi").select(F.col("b").alias("fp")).distinct()
        if threshold != 3:
            raise ValueError("dense anchors need a threshold of 3")
        extra = _dense_links(stored(within, "dense"))
        hosts = hosts.join(crowded, "key", "left_anti")
    found = hosts.join(unsent(guests), "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
    found = found.select("a", "b").distinct()
    return found.unionByName(extra) if extra is not None else found


def simhash_components(docs: DataFrame, width: int = 3, threshold: int = 3, dense: int = 2_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...).

    Null and blank texts have fingerprint zero and link like others; long texts
    are read whole; repeated rows stay; a null doc_id stays but names no component
    unless it is alone. Other columns are not read. An empty table gives none.
    """
    fp = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = stored(connected(links(distinct.select("fp"), threshold, dense), "links"), "roots")
    members = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = members.groupBy("root").agg(F.min("first").alias("component_id"))
    label = members.join(named, "root").select("fp", "component_id")
    return fp.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicates at a similarity, for pipelines ------------------------------------------

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BANDS, ROWS = 16, 5
PARITIES = 16
_MULTIPLIERS = np.random.default_rng(20250).integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Four words (256 bits) of SimHash over distinct shingle hashes; zeros for none."""
    if not len(h):
        return np.zeros(4, np.uint64)
    cols = [h]
    for m in MIX:
        x = h * m
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        cols.append(x ^ (x >> np.uint64(32)))
    return majority(np.stack(cols, axis=1)).view(np.uint64)


def anchor_keys(h: np.ndarray) -> list[int]:
    """BANDS keys of the set of shingles h: the hash of ROWS minima under as many orders of the shingles, each."""
    if not len(h):
        return list(range(BANDS))
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    mixed = h ^ (h >> np.uint64(31))
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        np.minimum(low, (mixed[at : at + 4096, None] * _MULTIPLIERS).min(axis=0), out=low)
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), seed=b) - (1 << 63) for b, r in enumerate(rows)]


def parities(h: np.ndarray) -> np.ndarray:
    """PARITIES words: whether an even or odd number of the distinct shingles h falls to each bit. Two sets differ in as many shingles as bits at least."""
    odd = np.bincount((h >> np.uint64(23) & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _rare(sets: DataFrame) -> DataFrame:
    """(key, node, root, n, at) of sets(node, root, shingles): the shingles of each set, rarest first, up to one more than a fifth; `at` counts the rarer ones before.

    Two sets with a Jaccard similarity of 0.8 share four fifths of either; so
    of either, the first of the shared shingles in any common order is among
    the first fifth and one. Shingles of one set alone are left out.
    """
    each = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often"))
    order = F.sort_array(F.collect_list(F.struct("often", "key")))
    first = each.join(unsent(often), "key").groupBy("node", "root", "n").agg(order.alias("s"))
    first = first.select("node", "root", "n", F.posexplode(F.slice("s", 1, F.expr("n - (4 * n + 4) div 5 + 1").cast("int"))).alias("at", "x"))
    return first.where("x.often > 1").select("x.key", "node", "root", "n", "at")


def _rare_pairs(rare: DataFrame, alike) -> DataFrame:
    """Pairs (a, b) across roots that may have a Jaccard similarity of 0.8, met at a shingle of rare(key, node, root, n, at, ...) and `alike` in their other columns.

    What two sets share lies behind the first shared shingle in both. So at
    positions i and j of sets of n and m, 0.8 needs 9 (n - i) >= 4 (n + m) and
    9 (m - j) >= 4 (n + m): together 9 (i + j) <= n + m. One of the two has the
    shingle in its first ninth, and only those are hosts. Texts that share a
    passage of their larger part and no more meet there, but are no candidates.
    """
    side = lambda df, k: df.select("key", *(F.col(c).alias(k + c if c != "node" else k) for c in df.columns if c != "key"))
    home = lambda k: 9 * F.col(k + "at") <= F.col(k + "n")
    hosts, guests = side(rare.where("9 * at <= n"), "a"), side(rare, "b")
    enough = 9 * F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) >= 4 * (F.col("an") + F.col("bn"))
    once = (F.col("a") < F.col("b")) | ((F.col("a") != F.col("b")) & ~home("b"))
    met = hosts.join(unsent(guests), "key").where(enough & once & (F.col("aroot") != F.col("broot")) & alike)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_groups(docs: DataFrame, width: int = 5, most_bits: int = 80, key: str | None = None, small: int = 0) -> DataFrame:
    """(row_id, doc_id, group_id): near-duplicate classes at a similarity (Jaccard) of word shingles of 0.8 or more.

    Links are decided by the shingle sets themselves; SimHashes and anchors
    propose them. The 64-bit fingerprints of op6 go through its anchor-point
    covering, which misses no two at most three bits apart. Alone that would find
    only copies of similarity 0.98 and more, and a covering code that guarantees
    the 46 bits of 256 that 0.8 asks for has no selectivity. So texts also meet
    at points that similar sets of shingles share: each is dealt to BANDS of
    them, each the minima of the set under ROWS orders. Two texts of similarity s
    share one with probability 1 - (1 - s ** ROWS) ** BANDS: 0.998 at 0.8,
    whatever the number of texts. 256-bit SimHashes only spare comparisons: at a
    similarity of 0.8 they differ in 39 bits on average (48 in the shortest
    texts, spread 6), so few pairs of that similarity differ in more than
    `most_bits`. Parities of the shingle sets rule out pairs without loss: sets
    of n and m shingles and 0.8 differ in (n + m) / 9 of them at most.

    At each anchor all members are first compared with two of them, another two
    at each anchor. That joins most of a large group in comparisons linear in
    its rows, but members of unlike texts (a shared passage can hold all minima)
    may resemble each other and neither of the two. So for the members of anchors
    that are not all joined yet, all pairs across components follow that the
    rarest fifth of their shingles proposes, which no pair of similarity 0.8
    escapes (see `_rare` and `_rare_pairs`); at anchors of up to `small` members,
    pairs are compared whatever their shingles. Every pair of similarity 0.8 or
    more that meets ends in one group.

    Rows with equal texts share a group; rows without words form one. row_id is
    the column `key` of docs (unique), or a number of the row.
    """
    rid = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    small_batches(docs.sparkSession)
    cols, marks = ["f0", "f1", "f2", "f3"], [f"p{i}" for i in range(PARITIES)]

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes((t or "").encode(), width)) for t in b.column(1).to_pylist()]
            bits = np.array([np.concatenate([wide_fingerprint(h), parities(h)]) for h in sets], np.uint64).reshape(-1, 4 + PARITIES).view(np.int64)
            same = pa.array([xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) for h in sets], pa.int64())
            sizes = pa.array([len(h) for h in sets], pa.int64())
            keys = pa.array([anchor_keys(h) for h in sets], pa.list_(pa.int64()))
            short = pa.array(np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), same, *(pa.array(np.ascontiguousarray(x)) for x in bits.T), sizes, short, keys], ["doc_id", "row_id", "same", *cols, *marks, "size", "fp", "keys"])

    def shingles(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes((t or "").encode(), width)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), rid.alias("row_id"))
    if key is None:
        texts = stored(texts, "numbered")  # read twice: the numbers must not change
    form = ", ".join(f"{c} long" for c in ["doc_id", "row_id", "same", *cols, *marks, "size", "fp"])
    fp = stored(texts.mapInArrow(lambda batches: released(run(batches)), form + ", keys array<long>"), "wide")
    whole = ["same", *cols]
    distinct = fp.groupBy(*whole, *marks, "size", "keys").agg(F.min(F.struct("row_id", "fp")).alias("x"))
    distinct = stored(distinct.select(*whole, *marks, "size", "keys", F.col("x.row_id").alias("node"), "x.fp"), "wide-distinct")
    rows = distinct.select("node", F.explode("keys").alias("key"))
    blind = lambda c: F.col(c).bitwiseXOR(F.xxhash64("key"))  # noqa: E731  another order of the nodes at each anchor
    ends = rows.groupBy("key").agg(F.min(blind("node")).alias("lo"), F.max(blind("node")).alias("hi")).where("lo <> hi").select("key", blind("lo").alias("lo"), blind("hi").alias("hi"))
    met = stored(rows.join(unsent(ends), "key"), "near-met")
    codes = stored(distinct.groupBy("fp").agg(F.min("node").alias("first")), "near-codes")
    code = lambda k: codes.select(F.col("fp").alias(k), F.col("first").alias(k + "node"))
    covered = links(codes.select("fp")).join(code("a"), "a").join(code("b"), "b").select(F.col("anode").alias("x"), F.col("bnode").alias("y"))
    equal = distinct.select("fp", "node").join(codes, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    covered = stored(covered.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "near-covered")
    kin = stored(met.select("node").union(covered.select(F.explode(F.array("a", "b")))).distinct(), "near-kin")
    sets = stored(texts.join(kin, F.col("row_id") == F.col("node"), "left_semi").select("row_id", "text").mapInArrow(lambda batches: released(shingles(batches)), "node long, shingles array<long>"), "near-shingles")

    side = lambda k: distinct.select(F.col("node").alias(k), *(F.col(c).alias(k + c) for c in [*cols, *marks, "size"]))
    apart = lambda of: sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in of), F.lit(0))
    alike = (apart(cols) <= most_bits) & (5 * F.least("asize", "bsize") >= 4 * F.greatest("asize", "bsize"))  # sizes further apart cannot reach 0.8
    alike &= 9 * apart(marks) <= F.col("asize") + F.col("bsize")  # nor can sets that more than a ninth of their shingles sets apart

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more."""
        pairs = stored(pairs, name)
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")

    pair = lambda c: F.struct(F.least(c, "node").alias("a"), F.greatest(c, "node").alias("b"))
    cand = met.select(F.explode(F.array(pair("lo"), pair("hi"))).alias("e")).select("e.*").where("a <> b").distinct()
    linked = verified(cand.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"), "near-pairs")
    linked = stored(linked, "near-linked")
    roots = stored(connected(linked, "near"), "near-roots")

    member = met.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    member = stored(member, "near-members")
    open_keys = stored(member.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n")).where("r <> s").select("key", "n"), "near-open")
    rest = member.join(open_keys, "key").select("key", "node", "root", "n")
    crowd = stored(rest.where(F.col("n") > small).select("node", "root").distinct(), "near-crowd")
    bits = distinct.select("node", "size", *cols, *marks)
    more = _rare_pairs(_rare(sets.join(crowd, "node")).join(bits, "node"), alike)
    if small:
        few = rest.where(F.col("n") <= small).select("key", "node", "root").join(bits, "node")
        ab = lambda k: few.select("key", *(F.col(c).alias(k + c) for c in ["root", "size", *cols, *marks]), F.col("node").alias(k))
        more = more.unionByName(ab("a").join(unsent(ab("b")), "key").where((F.col("a") < F.col("b")) & (F.col("aroot") != F.col("broot")) & alike).select("a", "b"))
    root = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(k + "root"))
    covered = covered.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("aroot", "a") != F.coalesce("broot", "b")).select("a", "b")
    more = more.unionByName(covered.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"))
    linked = linked.unionByName(verified(more.select("a", "b").distinct(), "near-rest"))
    roots = stored(connected(linked, "near"), "near-roots")
    label = distinct.join(roots, distinct.node == roots.node, "left").select(*whole, F.coalesce("root", distinct.node).alias("group_id"))
    return fp.select("row_id", "doc_id", *whole).join(label, whole).select("row_id", "doc_id", "group_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see simhash_components for nulls, empty and long texts, ties, repeated rows and empty tables."""
    return simhash_components(table(spark, sf_dir, "documents"))
