"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Entities that the base expressions find (emails, addresses, cards, phones) are
the seeds. The words around each seed induce lexical patterns (the two words
before it and the word after it, and the two words before it alone). Patterns
and the identifier-like tokens in their slots form a bipartite graph, scored in
rounds: a pattern's confidence for a kind is the sum of the scores of its
distinct instances over their number, damped for little support; seeds score 1,
others what is believed of them so far. A pattern counts for a kind if at least
`support` of its instances are seeds or believed and its confidence is at least
`likely` (half of its instances); what is believed of an instance is the noisy-or
of the confidences of the counting patterns that hold it. So instances found in
one round support patterns in the next that no seed occurs in. Scores only
grow, and rounds end when no further pattern counts and none passes
`confident`. Those that do are trusted: they mark the identifiers in their
slots, which the base expressions don't know, as further spans of their kind.

Identifier-like are tokens with a digit, an at-sign or an underscore, and runs of
numbers parted by single spaces, which are one candidate. Names made of letters
alone are not candidates.

Positions are code points, end exclusive, taken from the lengths of what a text
is split into by the expression and of what it matches; no position is searched
for twice. Expressions are possessive and can only start where a run starts, so
their time is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import dropped, stored, table
from strataloom.llm.outliers import _let

KINDS = ("email", "ip", "card", "phone")
SPACE = r"\x20\x09-\x0D"
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Any of these must occur for the expression to match: a cheap test that spares most texts the rest.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Tokens that could be identifiers: runs of numbers parted by single spaces, else tokens with a digit, an at-sign or an underscore.
NUMBERS = rf"[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++(?![^{SPACE},;:!?\"'])"
TOKEN = rf"(?<![^{SPACE}])(?:{NUMBERS}|[^{SPACE}0-9@_]*+[0-9@_][^{SPACE}]*+)"
#: Code points looked at for a context, the next where the words don't fit.
REACHES = (96, 1536, 24576)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>>: start, end and text of each match, left to right, not overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def walk(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    pairs = _let(found, lambda m: F.arrays_zip(F.slice(pieces, 1, F.size(m)).alias("p"), m.alias("m")))
    pairs = F.transform(pairs, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m")))
    return F.aggregate(pairs, zero, walk, lambda a: a["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn: every second digit from the right is doubled and its digits added."""
    parts = F.split(F.reverse(d), "")
    total = F.aggregate(
        F.transform(F.filter(parts, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    d = _digits(v)
    if kind == "card":
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(10, 15)


def base_spans(text: Column) -> Column:
    """array<struct<s, e, k, v>> of the base entities, by start, then kind as listed in KINDS (k is its place)."""

    def of(k: int, kind: str) -> Column:
        none = F.array().cast("array<struct<s:int,e:int,k:int,v:string>>")
        got = F.filter(_spans(text, EXPRESSIONS[kind]), lambda x: _valid(kind, x["v"]))
        got = F.transform(got, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), x["v"].alias("v")))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), got).otherwise(none) if NEEDS[kind] else got

    each = F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))
    by = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"))
    back = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))
    return F.transform(F.sort_array(F.transform(each, by)), back)


def _words(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), rf"[{SPACE}]+"), lambda w: w != "")


def _context(text: Column, s: Column, e: Column) -> Column:
    """Patterns around text[s:e): the two words before with the word after, and the two words before alone; none at a text's start.

    Words are taken whole: a window is widened until it holds them, so the work
    stays in proportion to their length.
    """
    n = F.length(text)

    def before(reach: int | None) -> Column:
        return _words(F.substring(text, F.greatest(F.lit(0), s - reach) + 1, F.least(s, F.lit(reach)))) if reach else _words(F.substring(text, F.lit(1), s))

    def after(reach: int | None) -> Column:
        return _words(F.substring(text, e + 1, F.lit(reach) if reach else n))

    def widened(words, enough) -> Column:
        got = words(None)
        for reach in reversed(REACHES):
            got = _let(words(reach), _chosen(enough(reach), got))
        return got

    def _chosen(enough, wider: Column):
        return lambda w: F.when(enough(w), w).otherwise(wider)

    left = widened(before, lambda reach: lambda w: (F.size(w) > 2) | (s <= reach))  # the first word of a window may be cut
    right = widened(after, lambda reach: lambda w: (F.size(w) > 1) | (e + reach >= n))

    def build(b: Column) -> Column:
        two = F.array_join(F.slice(b, F.greatest(F.lit(1), F.size(b) - 1), F.lit(2)), " ")
        one = F.coalesce(F.get(right, F.lit(0)), F.lit(""))
        return F.when(F.size(b) == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(" <> ", two, one), F.concat(two, F.lit(" <>"))))

    return _let(left, build)


def _trimmed(x: Column) -> Column:
    """A token's span without the punctuation at its ends."""
    lead = F.length(x["v"]) - F.length(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}+@]++", ""))
    core = F.regexp_replace(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}+@]++", ""), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.length(core)).alias("e"), core.alias("v"))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(rid, doc_id or the columns `keep`, base, occ): base spans and the occurrences of seeds and candidates with their patterns. Null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = [F.col(c) for c in keep] if keep else [F.col("doc_id").cast("long").alias("doc_id")]
    keep = keep or ["doc_id"]
    rows = docs.select(*named, text.alias("t"))
    none = F.array().cast("array<struct<s:int,e:int,k:int,v:string>>")
    rows = rows.select(*keep, "t", F.when(F.col("t").rlike("[0-9@]"), base_spans(F.col("t"))).otherwise(none).alias("base"))
    tokens = F.when(F.col("t").rlike("[0-9@_]"), F.transform(_spans(F.col("t"), TOKEN), _trimmed)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))
    free = F.filter(tokens, lambda x: (x["e"] > x["s"]) & ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    occ = F.concat(
        F.transform(F.col("base"), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"), F.lower(b["v"]).alias("v"), _context(F.col("t"), b["s"], b["e"]).alias("p"))),
        F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-1).alias("k"), F.lower(x["v"]).alias("v"), _context(F.col("t"), x["s"], x["e"]).alias("p"))),
    )
    return rows.select(F.monotonically_increasing_id().alias("rid"), *keep, F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"))).alias("base"), occ.alias("occ"))


def score_patterns(occ: DataFrame, confident: float = 0.8, support: int = 3, likely: float = 0.5) -> DataFrame:
    """(p, kind, c): the patterns trusted for a kind and their confidence. occ: rows (p, v, k), k the kind of a seed or -1.

    Repeated occurrences count once. The rounds end when neither more patterns
    count nor more are trusted; no seeds give no patterns.
    """
    pairs = stored(occ.groupBy("p", "v").agg(F.max("k").alias("k")), "pairs")
    sizes = stored(pairs.groupBy("p").agg(F.count("*").alias("n")), "slots")
    seeds = pairs.where("k >= 0").groupBy("p", F.col("k").alias("kind")).agg(F.count("*").cast("double").alias("score"), F.count("*").alias("held"))
    seeds = stored(seeds, "seeds")
    free = pairs.where("k < 0").select("p", "v")
    believed, counting, known = None, None, (0, 0)
    while True:
        held = seeds
        if believed is not None:
            more = free.join(believed, "v").groupBy("p", "kind").agg(F.sum("b").alias("score"), F.sum((F.col("b") >= confident).cast("long")).alias("held"))
            held = seeds.unionByName(more).groupBy("p", "kind").agg(F.sum("score").alias("score"), F.sum("held").alias("held"))
        conf = held.where(F.col("held") >= support).join(sizes, "p").select("p", "kind", (F.col("score") / (F.col("n") + 0.5)).alias("c"))
        now = stored(conf.where(F.col("c") >= likely), "counting")
        dropped(counting)
        counting, before = now, known
        known = tuple(counting.agg(F.count("*"), F.count(F.when(F.col("c") >= confident, 1))).first())
        if known == before or known[0] == 0:
            return counting.where(F.col("c") >= confident)
        dropped(believed)
        noisy_or = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))
        believed = stored(free.join(counting, "p").groupBy("v", "kind").agg(noisy_or.alias("b")), "believed")


def scan_and_find(docs: DataFrame, keep: list[str], confident: float = 0.8, support: int = 3) -> DataFrame:
    """(rid, the columns `keep`, base, spans): one row for each row of docs; spans are base and discovered ones by start, end and kind.

    rid numbers the rows of this call. Texts that are null or empty have no
    spans, long ones are read whole, repeated rows have theirs each. A token that several trusted patterns
    claim takes the most confident one's kind, of equally confident ones the
    first as listed. Columns of docs named rid, t, base, occ or spans must not be
    kept. An empty table gives none.
    """
    seen = stored(scan(docs, keep), "pii")
    occ = seen.where(F.size("occ") > 0).select("rid", F.explode("occ").alias("o")).select("rid", "o.s", "o.e", "o.k", "o.v", F.explode("o.p").alias("p"))
    trusted = score_patterns(occ.select("p", "v", "k"), confident, support)
    new = occ.where("k < 0").join(trusted, "p").groupBy("rid", "s", "e").agg(F.max(F.struct(F.col("c"), (-F.col("kind")).alias("nk"))).alias("best"))
    new = new.groupBy("rid").agg(F.collect_list(F.struct("s", "e", (-F.col("best.nk")).alias("k"))).alias("more"))
    new = stored(new, "found")  # its true size lets Catalyst spare the texts a shuffle where it is small
    got = seen.select("rid", *keep, "base").join(new, "rid", "left")
    return got.select("rid", *keep, "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,e:int,k:int>>")))).alias("spans"))


def find_personal_data(docs: DataFrame, confident: float = 0.8, support: int = 3) -> DataFrame:
    """scan_and_find with doc_id alone."""
    return scan_and_find(docs, ["doc_id"], confident, support)


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see scan_and_find for nulls, empty and long texts, ties, repeated rows and empty tables."""
    got = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return got.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
