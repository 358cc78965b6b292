"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each text becomes a vector of transformed statistics. For each language and
source the minimum covariance determinant estimate is sought as by
deterministic MCD: three robust starts (scatter of the standardised rows after
a hyperbolic tangent, of their spatial signs, and of the rows cut at two
deviations) rank the rows; the nearest `keep` share gives a mean and a
covariance, which rank the rows anew, and so on. Two such concentration steps
are made from each start, the start of the least determinant goes on until its
determinant stands still, and the least one met is the estimate.

The `keep` share is found in a histogram of the distances, whose cells are a
64th of an e-fold wide: the subset is all rows up to the cell that completes
the share. So a step is two aggregations by group that add up before the
shuffle and don't depend on the order of rows, and a group may hold any share of
the rows: where rows meet their group's estimate, a group is dealt in parts of
about `part_rows`. Determinants can rise by what the last cell holds; therefore
the least one is kept.

Every group that has rows is estimated. A group of n rows takes n / (n + k) of
its own estimate and the rest of its language's, which is the pooled estimate
of the language's groups and leans on that of all rows by the same formula. Rows are rejected by their Mahalanobis distance, scaled to the
chi-square median of their group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.llm.common import dropped, stored, table

BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
STATS = ["v_length", "v_symbols", "v_lines", "v_repeats", "v_types", "v_upper"]
#: A deviation is never taken for less than this: natural texts have no symbols at all.
FLOOR = {"v_length": 0.1, "v_symbols": 0.13, "v_lines": 0.2, "v_repeats": 0.2, "v_types": 0.05, "v_upper": 0.1}
#: Of chi-square with six degrees of freedom: its median and its 0.999 quantile.
CHI2_MEDIAN, CUT = 5.348, 22.458
#: Rows that the wider estimate counts for, in a group's centre and in its scatter.
CENTRE_PRIOR, SCATTER_PRIOR = 5.0, 50.0
CELLS = 64.0


def _let(value: Column, body):
    """body(value) with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_statistics(docs: DataFrame, repeat_window: int = 8) -> DataFrame:
    """docs' doc_id, lang, source with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    One row for each row of docs, repeated ones and null ids too; null and empty
    texts have no words and fail. Texts of any length are read whole. Other
    columns are not read. repeat_window is a power of two.
    """
    if repeat_window & (repeat_window - 1) or repeat_window < 2:
        raise ValueError("repeat_window must be a power of two")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    trimmed = lambda x: F.trim(x, F.lit(BLANKS))
    lines = F.filter(F.split("t", "\n"), lambda x: trimmed(x) != "")
    k = repeat_window
    same = lambda s, j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

    def covered(hashes: Column) -> Column:
        """Words under windows that occur twice: starts of such windows in order, each adding what the one before left free."""
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(ranked, lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (same(s, j - 1, x) | same(s, j + 1, x)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))
        return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.when(j == 0, F.lit(k)).otherwise(F.least(F.lit(k), x - F.get(s, j - 1)))), F.lit(0).cast("long"), lambda a, x: a + x))

    def windows(words: Column) -> Column:
        """Hashes of all runs of k words: of words, of pairs of these, of pairs of those."""
        def doubled(hashes: Column, step: int) -> Column:
            def joined(h: Column) -> Column:
                n = F.greatest(F.lit(0), F.size(h) - step)
                return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

            return _let(hashes, joined)

        got, step = F.transform(words, lambda w: F.xxhash64(w)), 1
        while step < k:
            got, step = doubled(got, step), 2 * step
        return got

    def repeats(words: Column) -> Column:
        found = _let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(found)

    words = F.when(trimmed(F.col("t")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(F.col("t")), SPACE))
    got = rows.select(
        "doc_id", "lang", "source",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("k"), repeats(w).alias("r"))).alias("w"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    got = got.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("w.k").alias("n_types"), F.col("l.n").alias("n_lines"), "n_upper")
    return got.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """stats with the transformed vector; texts without words have zeros."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        stats.withColumn("v_length", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
        .withColumn("v_symbols", F.sqrt(F.col("n_symbols") / n))
        .withColumn("v_lines", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))))
        .withColumn("v_repeats", F.sqrt(F.col("n_repeat_words") / n))
        .withColumn("v_types", F.log1p("n_types") / F.log1p(n))
        .withColumn("v_upper", F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))))
    )


def _pairs(d: int):
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _inverted(model: DataFrame, floors: list[float]) -> DataFrame:
    """model with p_i_j, the inverse of its covariance c_i_j, no variance of which is less than its floor's square, and the logarithm of its determinant.

    By sweeping each row in turn, over a matrix of arrays: the group table is small, and no column is written out more than once.
    """
    d = len(floors)
    at = lambda i, j: f"c{max(i, j)}{min(i, j)}" if i != j else f"greatest(c{i}{i}, {floors[i] ** 2}D)"
    matrix = "array(" + ", ".join("array(" + ", ".join(at(i, j) for j in range(d)) + ")" for i in range(d)) + ")"
    pivot = "greatest(s.a[k][k], 1e-9D)"
    entry = f"CASE WHEN i = k AND j = k THEN -1 / {pivot} WHEN i = k OR j = k THEN x / {pivot} ELSE x - s.a[i][k] * s.a[k][j] / {pivot} END"
    sweep = f"named_struct('a', transform(s.a, (r, i) -> transform(r, (x, j) -> {entry})), 'logdet', s.logdet + ln({pivot}))"
    swept = f"aggregate(sequence(0, {d - 1}), named_struct('a', {matrix}, 'logdet', 0D), (s, k) -> {sweep})"
    got = model.selectExpr("*", f"{swept} AS swept")
    return got.selectExpr("*", "swept.logdet AS logdet", *(f"-swept.a[{i}][{j}] AS p{i}{j}" for i, j in _pairs(d))).drop("swept")


def _distance(rows: DataFrame, stats: list[str], centred: bool = True) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under m_i (zero unless centred) and p_i_j."""
    x = [f"({c} - m{i})" if centred else c for i, c in enumerate(stats)]
    terms = " + ".join(f"{1 if i == j else 2} * p{i}{j} * {x[i]} * {x[j]}" for i, j in _pairs(len(stats)))
    return rows.selectExpr("*", f"greatest({terms}, 0D) AS d2")


def _cell() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-9) * CELLS).cast("long")


def _quantile_cell(near: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """(keys, name): the cell of d2 that completes a share of each group's rows. A group has some thousand cells at most."""
    cells = near.groupBy(*keys, _cell().alias("cell")).agg(F.count("*").alias("n"))
    up = W.partitionBy(*keys).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    ranked = cells.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    return ranked.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("cell").alias(name))


def _dealt(model: DataFrame, key: str) -> DataFrame:
    """model once for each part of its group."""
    return model.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def in_parts(rows: DataFrame, key: str, part_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(rows with `part`, one row for each group with its number n and its `parts`), both stored."""
    sizes = stored(rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")), "sizes")
    dealt = rows.withColumn("spread", F.monotonically_increasing_id()).join(sizes.select(key, "parts"), key)
    return stored(dealt.withColumn("part", F.pmod(F.xxhash64("spread"), F.col("parts")).cast("int")).drop("spread", "parts"), "parts"), sizes


def mcd(rows: DataFrame, sizes: DataFrame, key: str, stats: list[str], floors: list[float], keep: float = 0.75, still: float = 1e-3) -> DataFrame:
    """(key, n, parts, m_i, c_i_j, logdet): mean and covariance of the subset of least determinant found in each group.

    rows and sizes come from in_parts. Groups of one row have that row for a
    mean and no scatter; equal rows count each. No rows give no groups.
    """
    d = len(stats)
    by = [key, "part"]
    slim = lambda model: _dealt(model, key).drop("n", "parts")
    xs, zs, each = [f"x{i}" for i in range(d)], [f"z{i}" for i in range(d)], range(d)
    agg = lambda df, keys, exprs: df.groupBy(*keys).agg(*map(F.expr, exprs))
    centre = stored(agg(rows, [key], [f"percentile_approx({c}, 0.5, 1000) AS o{i}" for i, c in enumerate(stats)]).join(sizes, key), "centre")
    rows = stored(rows.join(slim(centre), by).selectExpr(*by, *(f"{c} - o{i} AS x{i}" for i, c in enumerate(stats))), "offsets")
    spread = stored(agg(rows, [key], [f"percentile_approx(abs(x{i}), 0.5, 1000) AS s{i}" for i in each]).join(sizes, key), "spread")
    near = rows.join(slim(spread), by).selectExpr(*by, *xs, *(f"x{i} / (1.4826D * s{i} + {floors[i]}D) AS z{i}" for i in each))
    norm = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in each) + " + 1e-12D)"
    kinds = [[f"tanh({z})" for z in zs], [f"{z} / {norm}" for z in zs], [f"greatest(-2D, least(2D, {z}))" for z in zs]]
    starts = "explode(array(" + ", ".join(f"named_struct('start', {s}, " + ", ".join(f"'g{i}', {e}" for i, e in enumerate(kind)) + ")" for s, kind in enumerate(kinds)) + ")) AS __g"
    made = near.selectExpr(*by, starts).selectExpr(*by, "__g.*")
    first = agg(made, [key, "start"], [f"avg(g{i} * g{j}) AS c{i}{j}" for i, j in _pairs(d)])
    model = stored(_inverted(first.join(sizes, key), [0.05] * d), "start")
    three = F.explode(F.array(*(F.lit(s) for s in range(3)))).alias("start")
    near = _distance(near.select(*by, *xs, *zs, three).join(slim(model), [*by, "start"]), zs, False)
    wide, old = rows.select(*by, *xs, three), [model, spread]
    for step in range(2):
        near = near if step == 0 else _distance(wide.join(slim(model), [*by, "start"]), xs)
        model = stored(_concentrated(near, sizes, [key, "start"], key, xs, floors, keep), "mcd")
        old.append(model)
    lead = model.groupBy(key).agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    active = stored(model.join(lead, [key, "start"]).drop("start"), "mcd")
    met = [active]
    while not active.isEmpty():  # until no group's determinant falls any more
        near = _distance(rows.join(slim(active), by), xs)
        now = _concentrated(near, sizes, [key], key, xs, floors, keep)
        active = stored(now.join(active.select(key, F.col("logdet").alias("was")), key).where(F.col("logdet") < F.col("was") - still).drop("was"), "mcd")
        met.append(active)
    every = reduce(DataFrame.unionByName, met)
    best = every.groupBy(key).agg(F.min_by(F.struct(*(c for c in every.columns if c != key)), "logdet").alias("__b")).select(key, "__b.*")
    kept = [c for c in active.columns if not c.startswith("m")]
    best = stored(best.join(centre.drop("n", "parts"), key).selectExpr(*kept, *(f"m{i} + o{i} AS m{i}" for i in each)), "best")
    for x in [*old, *met, rows, centre]:
        dropped(x)
    return best


def _concentrated(near: DataFrame, sizes: DataFrame, keys: list[str], key: str, xs: list[str], floors: list[float], keep: float) -> DataFrame:
    """The estimate of the rows whose distances are in the least `keep` share of their group. The offsets xs lie around zero, so plain sums of products are exact enough."""
    cut = _quantile_cell(near, keys, keep, "cut").join(sizes, key)
    inner = near.select(*keys, "part", *xs, _cell().alias("cell")).join(_dealt(cut, key), [*keys, "part"]).where("cell <= cut")
    pairs, each = _pairs(len(xs)), range(len(xs))
    sums = inner.groupBy(*keys).agg(*(F.expr(f"avg({x}) AS m{i}") for i, x in enumerate(xs)), *(F.expr(f"avg({xs[i]} * {xs[j]}) AS q{i}{j}") for i, j in pairs))
    got = sums.selectExpr(*keys, *(f"m{i}" for i in each), *(f"q{i}{j} - m{i} * m{j} AS c{i}{j}" for i, j in pairs))
    return _inverted(got.join(sizes, key), floors)


def _leaning(own: DataFrame, wide: DataFrame, columns: dict[str, float], on: str | None) -> DataFrame:
    """own with each column (of prior k) replaced by (n * own + k * wide) / (n + k)."""
    renamed = wide.selectExpr(*([on] if on else []), *(f"{c} AS w_{c}" for c in columns))
    both = own.join(renamed, on) if on else own.join(F.broadcast(renamed), F.lit(True))  # one row
    return both.selectExpr(*(c for c in own.columns if c not in columns), *(f"(n * {c} + {k} * w_{c}) / (n + {k}) AS {c}" for c, k in columns.items()))


def _pooled(model: DataFrame, columns: dict[str, float], on: str | None) -> DataFrame:
    """Means of a model's columns over its groups, weighed by their rows."""
    aggs = [F.expr("sum(n) AS n"), *(F.expr(f"sum({c} * n) / sum(n) AS {c}") for c in columns)]
    return model.groupBy(on).agg(*aggs) if on else model.agg(*aggs)


def _by_levels(model: DataFrame, columns: dict[str, float], wide: str) -> DataFrame:
    """model (n, columns, wide, ...) leaning on its language, which leans on all."""
    lang = _leaning(_pooled(model, columns, wide), _pooled(model, columns, None), columns, None)
    return _leaning(model, lang, columns, wide)


def judge(stats: DataFrame, keep: float = 0.75, cut: float = CUT) -> DataFrame:
    """stats with d2 (scaled) and kept: false where base_failed, else whether d2 is at most `cut`.

    Estimates are made of the rows that pass the base rules. Null languages and
    sources are groups of their own. Repeated rows stay and count each; ties have
    equal distances. A group none of whose rows passes has no estimate, and none
    of its rows is kept. An empty table gives none.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = stored(vectors(stats).withColumn("group", F.concat_ws("\x1f", name("lang"), name("source"))), "vectors")
    sound, sizes = in_parts(rows.where(~F.col("base_failed")).select("group", *STATS), "group")
    floors = [FLOOR[c] for c in STATS]
    model = mcd(sound, sizes, "group", STATS, floors, keep)
    columns = {f"m{i}": CENTRE_PRIOR for i in range(len(STATS))} | {f"c{i}{j}": SCATTER_PRIOR for i, j in _pairs(len(STATS))}
    inverse = [f"p{i}{j}" for i, j in _pairs(len(STATS))]
    model = model.drop(*inverse, "logdet").withColumn("wide", F.substring_index("group", "\x1f", 1))
    model = stored(_inverted(_by_levels(model, columns, "wide"), floors), "model")
    near = _distance(sound.join(_dealt(model, "group").drop("n", "parts"), ["group", "part"]), STATS)
    typical = _quantile_cell(near, ["group"], 0.5, "median").select("group", F.exp((F.col("median") + 0.5) / CELLS).alias("scale"))
    scale = _by_levels(model.select("group", "wide", "n").join(typical, "group"), {"scale": SCATTER_PRIOR}, "wide")
    scale = stored(scale.select("group", F.greatest(F.col("scale") / CHI2_MEDIAN, F.lit(1.0)).alias("scale")), "scale")  # floors only widen, so less than 1 says nothing
    labelled = rows.join(model.drop("wide", "n", "parts", "logdet").join(scale, "group"), "group", "left")
    scored = _distance(labelled, STATS).withColumn("d2", F.col("d2") / F.col("scale"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cut))


def op3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: see base_statistics and judge for nulls, empty and long texts, ties, repeated rows and empty tables."""
    got = judge(base_statistics(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("distance"))
