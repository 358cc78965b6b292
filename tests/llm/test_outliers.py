import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm.outliers import STATS, base_statistics, in_parts, judge, mcd, op3_outliers

from .corpora import SCHEMA, empty, odd, odd_rows, prose, words

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    under = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(under), n < 20 or 100 * len(under) > 30 * n)


def same(rows, texts):
    have, want = Counter((r.doc_id, *(r[c] for c in NAMES)) for r in rows), Counter((d, *brute(t)) for d, t in texts)
    assert have == want, [*(have - want).items()][:3] + [*(want - have).items()][:3]


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = op3_outliers(spark, small).collect()
    same(rows, [(r.doc_id, r.text) for r in docs])
    assert not any(r.kept and r.base_failed for r in rows)
    passed = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in passed) > 0.85 * len(passed)


def test_odd_and_repeating_texts(spark):
    rng = random.Random(3)
    rows = [(i, t, "en", "web") for i, t in enumerate(r[1] for r in odd_rows())]
    for i in range(60):
        w = [f"v{rng.randrange(4)}" for _ in range(rng.randrange(40))]
        rows.append((100 + i, rng.choice([" ", "\n", " \n\n"]).join(w), "en", "web"))
        rows.append((200 + i, "\n".join(prose(rng, 12, 3) for _ in range(rng.randrange(6))), None, None))
    got = base_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    same(got, [(r[0], r[1]) for r in rows])
    assert judge(base_statistics(odd(spark))).count() == len(odd_rows())
    assert judge(base_statistics(empty(spark))).count() == 0


def test_planted_outliers_go_and_others_stay(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        rows.append((i, prose(rng, 150), "en", "web", 0, 0, 0.0, ""))
    for i in range(400, 420):
        rows.append((i, " ".join("#$%|" + str(rng.random()) for _ in range(100)), "en", "web", 0, 0, 0.0, ""))
    got = judge(base_statistics(spark.createDataFrame(rows, SCHEMA)))
    assert got.where((F.col("doc_id") >= 400) & F.col("kept")).count() == 0
    assert got.where((F.col("doc_id") < 400) & F.col("kept")).count() >= 396


def test_determinants_against_all_subsets(spark):
    rng, groups, floors = np.random.default_rng(4), {}, [0.01, 0.01]
    for g in range(24):
        x = rng.normal(size=(12, 2)) @ rng.normal(size=(2, 2))
        x[:3] += rng.normal(size=2) * 8
        groups[g] = x
    rows = spark.createDataFrame([(g, float(a), float(b)) for g, x in groups.items() for a, b in x], "grp int, x double, y double")
    dealt, sizes = in_parts(rows, "grp", part_rows=5)
    got = {r.grp: r.logdet for r in mcd(dealt, sizes, "grp", ["x", "y"], floors, keep=0.75).collect()}

    def logdet(x):
        c = np.cov(x.T, bias=True)
        c[[0, 1], [0, 1]] = np.maximum(c[[0, 1], [0, 1]], 1e-4)
        return np.log(np.linalg.det(c))

    best = {g: min(logdet(x[list(s)]) for s in combinations(range(12), 9)) for g, x in groups.items()}
    assert set(got) == set(best)
    assert all(got[g] > best[g] - 1e-6 for g in best)  # nothing is below the least determinant
    assert np.mean([got[g] < best[g] + 1e-6 for g in best]) >= 0.9  # and nearly all reach it


def test_small_groups_have_estimates_of_their_own(spark):
    rng, rows = random.Random(6), []
    for source, n, length in (("a", 300, 4), ("b", 12, 9), ("c", 1, 4)):  # b's words are twice as long
        for i in range(n):
            words = " ".join("".join(rng.choice("abcdefghij") for _ in range(length)) for _ in range(120))
            rows.append((len(rows), words, "en", source, 0, 0, 0.0, ""))
    rows += [(len(rows) + i, " ".join("".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(120)), "en", "b", 0, 0, 0.0, "") for i in range(2)]
    got = {r.doc_id: r for r in judge(base_statistics(spark.createDataFrame(rows, SCHEMA))).select("doc_id", "source", "kept", "d2").collect()}
    assert all(got[i].kept for i in range(313)) and not any(got[i].kept for i in (313, 314))


def test_verdict_does_not_depend_on_the_order_of_rows(spark, small):
    stats = base_statistics(spark.read.parquet(f"{small}/documents.parquet"))
    one = {(r.doc_id, r.kept, round(r.d2 or 0, 4)) for r in judge(stats).select("doc_id", "kept", "d2").collect()}
    two = {(r.doc_id, r.kept, round(r.d2 or 0, 4)) for r in judge(stats.orderBy(F.desc("doc_id")).repartition(5)).select("doc_id", "kept", "d2").collect()}
    assert one == two and len(STATS) == 6


def test_no_python_in_the_plan(spark, tiny, capsys):
    op3_outliers(spark, tiny).explain("formatted")
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))
