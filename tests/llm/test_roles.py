import random
from functools import cache

from strataloom.llm.roles import BIG, FINAL, MATRICES, ROLES, op5_roles, repair, role_code

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq long"


def best(roles):
    """Least cost by trying every way, on the rules as the module states them."""

    @cache
    def go(i, state):
        if i == len(roles):
            return int(FINAL[state])
        return min(int(MATRICES[roles[i]][state, t]) + go(i + 1, t) for t in range(4) if MATRICES[roles[i]][state, t] < BIG)

    return go(0, 0)


def legal(shown):
    turns = []
    for r in shown:
        if r.inserted:
            turns.append(r.inserted)
        if "merge" not in r.action:
            turns.append(r.new_role)
        turns += [x for x in r.closing.split(",") if x]
    body = turns[1:] if turns[0] == "system" else turns
    return len(body) % 2 == 0 and body and all(x == ROLES[1 + i % 2] for i, x in enumerate(body))


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["system", "user", "User ", "assistant", "tool", None]), rng.choice(["hi", "", None]), "p", 5))
    return rows


def test_costs_and_legality(spark):
    rows = conversations(1, 80)
    for block, parts in ((2048, 8), (2, 5)):
        got = repair(spark.createDataFrame(rows, SCHEMA), block=block, partitions=parts).orderBy("seq").collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.conv_id, []).append(r)
        for c, shown in by.items():
            assert sum(r.cost for r in shown) == best(tuple(role_code(r.role) for r in shown))
            assert legal(shown)
            text = "".join(r.rendered for r in shown)
            assert text.count("<|end|>") == sum(text.count(f"<|{x}|>") for x in ROLES) and text.endswith("<|end|>\n")


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a", "x", 1), (None, None, None, None, None, None), (1, 1, "user", "same", "x", 1), (1, 1, "user", "same", "x", 1), (2, 1, "assistant", "z" * 100_000, "x", 1), (3, 1, "system", "", "x", 1)]
    got = repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, small):
    got = op5_roles(spark, small)
    assert got.count() == spark.read.parquet(f"{small}/conversations.parquet").count()
