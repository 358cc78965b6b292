"""Minimum-cost role repair of conversations.

A legal conversation is: at most one system turn, first; then user and
assistant turns in alternation, user first, ending with the assistant. Dynamic
programming over this automaton picks, for each turn, the cheapest of: keep its
role, relabel it, or merge it into the turn before, each perhaps after one
inserted empty turn. Costs: keep 0, merge with the same role 1, insert 2,
relabel 3 (merging a turn of another role costs both).

A step of the programme is a matrix over the automaton's states under
(min, +), so it is associative: rows are dealt by range of (conversation,
turn, ...), each partition folds its stretch of a conversation into one small
matrix, and only conversations that span partitions are joined up, in one row
for each partition and conversation. A conversation of any length is therefore
repaired in parallel, and no task or the driver ever holds one. The last pass
walks each stretch from its known entry state to its known exit state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import stored, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, after a system, a user, an assistant turn.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
KEEP, MERGE, INSERT, RELABEL = 0, 1, 2, 3
BIG = 1 << 40
#: Turns that may follow a state.
LEGAL = {START: (0, 1), AFTER_SYSTEM: (1,), AFTER_USER: (2,), AFTER_ASSISTANT: (1,)}


def _step(role: int) -> list[tuple[int, int, int, str, int, int]]:
    """Moves for a turn of this role (-1: unknown): (from, to, cost, action, role given, role inserted before or -1)."""
    moves = []
    for s in range(4):
        for r in LEGAL[s]:
            moves.append((s, r + 1, KEEP if r == role else RELABEL, "keep" if r == role else "relabel", r, -1))
            for t in LEGAL[r + 1]:  # an empty turn r first
                moves.append((s, t + 1, INSERT + (KEEP if t == role else RELABEL), "insert+" + ("keep" if t == role else "relabel"), t, r))
        if s:
            moves.append((s, s, MERGE + (0 if s - 1 == role else RELABEL), "merge" if s - 1 == role else "relabel+merge", s - 1, -1))
    return sorted(moves, key=lambda m: (m[2], m[3], m[0], m[1]))


MOVES = {r: _step(r) for r in (-1, 0, 1, 2)}


def matrix(role: int) -> np.ndarray:
    m = np.full((4, 4), BIG, np.int64)
    for s, t, c, *_ in MOVES[role]:
        m[s, t] = min(m[s, t], c)
    return m


MATRICES = {r: matrix(r) for r in MOVES}
#: Cost to end in each state: an assistant turn may be inserted; after nothing or a system turn both are.
FINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), BIG)


def role_code(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES else -1


#: The moves of a role from each state, in order, and its matrix as lists: quicker row by row than arrays.
FROM = {r: [[m[1:] for m in moves if m[0] == s] for s in range(4)] for r, moves in MOVES.items()}
LISTS = {r: m.tolist() for r, m in MATRICES.items()}


def walk(roles: list[int], entry: int, exit_state: int) -> list[tuple[int, str, int, int]]:
    """The cheapest (cost, action, role, inserted role) for each turn from entry to exit; ties go to the first move in order."""
    after = [BIG] * 4  # cost from here to the exit
    after[exit_state] = 0
    back = [after]
    for r in reversed(roles):
        after = [min(BIG, *(c + b for c, b in zip(row, after))) for row in LISTS[r]]
        back.append(after)
    back.reverse()
    out, s = [], entry
    for i, r in enumerate(roles):
        want, then = back[i][s], back[i + 1]
        t, c, what, given, put = next(m for m in FROM[r][s] if m[1] + then[m[0]] == want)
        out.append((c, what, given, put))
        s = t
    return out


def _stretches(roles: np.ndarray, convs: list) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal conversation ids."""
    cuts = [0] + [i for i in range(1, len(convs)) if convs[i] != convs[i - 1]] + [len(convs)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def repair(turns: DataFrame, block: int = 2048, partitions: int | None = None) -> DataFrame:
    """One row for each turn: conv_id, turn, role, text, action, cost, new_role, inserted (role of an empty turn put before, or null), closing, rendered.

    Turns are ordered by turn (nulls first), role and text; repeated rows are
    turns of their own. Unknown and null roles must be relabelled. A null
    conv_id is a conversation of its own; null texts are empty. `closing`
    names the empty turns added behind a conversation's last row. rendered is
    this turn's share of the conversation in chat markup: joined in order, the
    shares are the repaired conversation, so no value grows with it.
    """
    spark = turns.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(n, "conv_id", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    # blocks of rows in order: part is the range, seq the place in it
    rows = stored(rows.withColumn("part", F.spark_partition_id().cast("long")).withColumn("seq", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("block", F.floor(F.col("seq") / block))
    grouped = ["part", "block"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        convs = [None if pd.isna(c) else int(c) for c in pdf.conv_id]
        roles = [role_code(None if pd.isna(r) else r) for r in pdf.role]
        out, runs = [], _stretches(np.array(roles), convs)
        for k, (a, b) in enumerate(runs):
            m = MATRICES[roles[a]]
            for r in roles[a + 1 : b]:
                m = product(m, MATRICES[r])
            edge = k in (0, len(runs) - 1)  # others are whole conversations
            out.append((convs[a], int(pdf.part.iloc[0]), int(pdf.block.iloc[0]), edge, START, int(np.argmin(m[START] + FINAL)), *m.ravel().tolist()))
        return pd.DataFrame(out, columns=["conv_id", "part", "block", "edge", "entry", "exit", *(f"m{i}" for i in range(16))])

    cells = ", ".join(f"m{i} long" for i in range(16))
    turns_only = rows.select("conv_id", "role", "part", "block", "seq").repartition(n, *grouped)  # a number given: small rows are not gathered in one task
    stretch = stored(turns_only.groupBy(*grouped).applyInPandas(fold, f"conv_id long, part long, block long, edge boolean, entry long, exit long, {cells}"), "stretches")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit states of each stretch of one conversation: one row for each `block` of its turns."""
        pdf = pdf.sort_values(["part", "block"]).reset_index(drop=True)
        mats = pdf[[f"m{i}" for i in range(16)]].to_numpy(np.int64).reshape(-1, 4, 4)
        back = [FINAL]
        for m in mats[::-1]:
            back.append(np.minimum((m + back[-1][None, :]).min(axis=1), BIG))
        back.reverse()
        s, states = START, []
        for i, m in enumerate(mats):
            t = int(np.argmin(m[s] + back[i + 1]))
            states.append((s, t, i == len(mats) - 1))
            s = t
        pdf["entry"], pdf["exit"], pdf["last"] = zip(*states)
        return pdf[["conv_id", "part", "block", "entry", "exit", "last"]]

    cut = stretch.where("edge").drop("edge", "entry", "exit").groupBy("conv_id")  # at most two for each block
    ends = cut.applyInPandas(chain, "conv_id long, part long, block long, entry long, exit long, last boolean")
    ends = ends.unionByName(stretch.where("not edge").select("conv_id", "part", "block", "entry", "exit", F.lit(True).alias("last")))
    ends = ends.select("part", "block", F.struct("conv_id", "entry", "exit", "last").alias("e")).groupBy("part", "block").agg(F.collect_list("e").alias("ends"))  # at most one for each row of a block

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("seq")
        known = {e["conv_id"]: (e["entry"], e["exit"], e["last"]) for ends in right.ends for e in ends}
        convs = [None if pd.isna(c) else int(c) for c in left.conv_id]
        roles = [role_code(None if pd.isna(r) else r) for r in left.role]
        made = []
        for a, b in _stretches(np.array(roles), convs):
            entry, out, last = known[convs[a]]
            for i, (cost, what, given, put) in enumerate(walk(roles[a:b], entry, out)):
                end = last and a + i == b - 1
                closing = {AFTER_SYSTEM: "user,assistant", AFTER_USER: "assistant"}.get(out, "") if end else ""
                made.append((what, cost + int(FINAL[out]) * end, ROLES[given], ROLES[put] if put >= 0 else None, closing, entry == START and i == 0, end))
        got = left[["seq"]].copy()
        got["action"], got["cost"], got["new_role"], got["inserted"], got["closing"], got["first"], got["end"] = zip(*made)
        return got

    schema = "seq long, action string, cost long, new_role string, inserted string, closing string, first boolean, end boolean"
    settled = turns_only.groupBy(*grouped).cogroup(ends.groupBy(*grouped)).applyInPandas(settle, schema)
    got = rows.join(settled, "seq")
    opened = F.concat(
        F.when(F.col("first"), F.lit("")).otherwise(F.lit("<|end|>\n")),
        F.coalesce(F.concat(F.lit("<|"), "inserted", F.lit("|>\n<|end|>\n")), F.lit("")),
        F.lit("<|"), "new_role", F.lit("|>\n"),
    )
    closed = F.array_join(F.transform(F.filter(F.split("closing", ","), lambda r: r != ""), lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))), "")
    shown = F.concat(F.when(F.contains(F.col("action"), F.lit("merge")), F.lit("\n")).otherwise(opened), "text", F.when(F.col("end"), F.concat(F.lit("<|end|>\n"), closed)).otherwise(F.lit("")))
    return got.select("conv_id", "turn", "role", "text", "part", "seq", "action", "cost", "new_role", "inserted", "closing", shown.alias("rendered"))


def op5_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repair(table(spark, sf_dir, "conversations"))
    return got.select("conv_id", "turn", "role", "action", "cost", "new_role", "inserted", "closing", F.crc32(F.col("rendered").cast("binary")).alias("rendered_crc32"), "rendered")
