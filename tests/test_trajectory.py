import json
import random
import re

from strataloom.operators import trajectory as J

SCHEMA = (
    "traj string, task string, category string, lang string, assistant_steps int, messages array<struct<role:string,content:string,reasoning_content:string,tool_call_id:string,"
    "tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>"
)
COMMANDS = ["ls -la", "pytest -q", "npm install x", "uname -a", "cat <<E\na\nE", "echo hi > out.py", "make check", "true", "ls -la"]


def made(seed=5, n=30):
    rng, rows = random.Random(seed), []
    for t in range(n):
        messages, calls = [("system", "be brief", None, None, None), ("user", rng.choice(["I want a parser", "fix it", "the header a.h is given"]), None, None, None)], 0
        for _ in range(rng.randrange(8)):
            tool = rng.choice(["bash", "bash", "read", "ls", "write", "edit"])
            args = {
                "bash": {"command": rng.choice(COMMANDS)}, "read": {"path": "a"}, "ls": {}, "write": {"path": rng.choice("ab"), "content": "x\n" * rng.randrange(40)},
                "edit": {"path": rng.choice("ab"), "edits": rng.choice([[{"newText": "a\nb"}, {"newText": ""}], {"newText": "c"}, []])},
            }[tool]
            messages.append(("assistant", rng.choice(["", "now I look", None]), rng.choice(["think", None]), None, [(f"c{calls}", (tool, json.dumps(args)))]))
            messages.append(("tool", rng.choice(["ok", "2 failed", "error: no", ""]), None, f"c{calls}", None))
            calls += 1
        rows.append((f"t{t}", f"task{t}", rng.choice(["dependency-planning", "code", "code", "code"]), "py", t, messages))
    return rows + [("none", "empty", "code", "py", 0, [])]


def plain(row):
    t = lambda x: len(x or "") / 4
    messages, kind_of, out, first, lines, commands, files = row[5], {}, dict.fromkeys(J.TOKENS + ["test_output_tokens", "explore_tokens"], 0.0), None, 0, [], set()
    writes = runs = fails = 0
    for i, (role, content, reasoning, call_id, calls) in enumerate(messages):
        out["prompt_tokens"] += t(content) * (role in ("system", "user"))
        if role == "assistant":
            out["assistant_text_tokens"] += t(content)
            out["reasoning_tokens"] += t(reasoning)
        for cid, (tool, arguments) in calls or []:
            a = json.loads(arguments)
            out["tool_args_tokens"] += t(arguments)
            kind_of[cid] = tool
            if tool == "bash":
                c = a["command"]
                commands.append(c)
                kind_of[cid] = "run" if re.search(J.TEST_RUN, c) else "bash"
                runs += kind_of[cid] == "run"
                if first is None and re.search(J.WRITES, c):
                    first, lines = i, lines + max(1, c.count("\n"))
            elif tool in ("write", "edit"):
                writes += 1
                files.add(a["path"])
                new = [a["content"]] if tool == "write" else [e["newText"] for e in (a["edits"] if isinstance(a["edits"], list) else [a["edits"]])]
                lines += sum(x.count("\n") + 1 for x in new)
                first = i if first is None else first
        if role == "tool":
            out["tool_result_tokens"] += t(content)
            if kind_of.get(call_id) == "run":
                out["test_output_tokens"] += t(content)
                fails += bool(re.search(J.FAILED, content or ""))
    for role, content, reasoning, _, calls in messages[: first or 0]:
        out["explore_tokens"] += t(content) + t(reasoning) + sum(t(a) for _, (_, a) in calls or [])
    return {**out, "deliverable_lines": lines, "files_touched": len(files), "write_edit_calls": writes, "test_runs": runs, "test_fail_outputs": fails, "repeated_commands": len(commands) - len(set(commands))}


def test_attribution_types_and_waste(spark):
    rows = made()
    got = {r.traj: r.asDict() for r in J.attribution(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        want = plain(r)
        assert {k: got[r[0]][k] for k in want} == want, r[0]
        assert got[r[0]]["total_tokens"] == sum(want[k] for k in J.TOKENS)
    assert {g["task_type"] for g in got.values()} >= {"dependency-planning", "env-repair", "one-edit-fix"}
    table = spark.createDataFrame(list(got.values()), J.attribution(spark.createDataFrame(rows, SCHEMA)).schema)
    for r in J.by_task_type(table).collect():
        mine = sorted(g["total_tokens"] for g in got.values() if g["task_type"] == r.task_type)
        assert (r.n, r.median_tokens) == (len(mine), mine[len(mine) // 2])
    signals = {r.signal: r.value for r in J.waste(table).collect()}
    assert signals["before first write"] == sum(g["explore_tokens"] for g in got.values())
    assert J.dearest(table, "env-repair", most=2).count() <= 2 and J.early_exploration(table).count() <= 10
