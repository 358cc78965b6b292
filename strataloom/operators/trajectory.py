"""Where the tokens of agent trajectories go: by role, tool and kind of command; task types and signs of waste."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.trace import upper_median

# --- fixed values: expressions decide the classes, the first that fits counts -----------------------
TEST_RUN = r"(?i)(test_[a-z0-9_]*\.(sh|py)|run_verify|pytest|go test|cargo test|make (test|check)|npm test|node --test|unittest|\.test\.)"
INSTALL = r"(?i)(npm (ci|install)|pip3? install|cargo (build|update)|go (mod|get)|apt|brew)"
EXPLORE = r"^\s*(ls|find|grep|rg|cat|head|tail|wc|file|stat|sed -n|awk|tree|du)\b"
PROBE = r"(?i)(--version|uname|which\s+\w+|^id\b)"
WRITES = r"cat\s*<<|tee\s|>\s*[\w./-]+\.(sh|py|go|rs|c|h|cpp|js|ts|rb|java)"
FAILED = r"\bFAIL\b|failed|panicked|error:|✖"
GIVEN_SPEC = r"(?i)(bitvec\.h|\.hpp|\.h\b|interface|API|signature|skeleton|stub|two new files|single file|package \w+|C17|dependency-free|I want (a|the)|I need (a|the|an))"
TOKENS = ["prompt_tokens", "assistant_text_tokens", "reasoning_tokens", "tool_args_tokens", "tool_result_tokens"]


def tokens(c) -> Column:
    """Four characters a token."""
    return F.length(F.coalesce(c, F.lit(""))) / 4


def lines(c) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def command_class(command: Column) -> Column:
    """test-run, install, explore, env-probe or other."""
    return F.when(command.rlike(TEST_RUN), "test-run").when(command.rlike(INSTALL), "install").when(command.rlike(EXPLORE), "explore").when(command.rlike(PROBE), "env-probe").otherwise("other")


def tool_calls(trajectories: DataFrame) -> DataFrame:
    """(traj, pos, k, id, tool, arguments, command, kind, path, written, first_kind): one row for each tool call, in order."""
    m = trajectories.select("traj", F.posexplode("messages").alias("pos", "m")).select("traj", "pos", F.posexplode("m.tool_calls").alias("k", "c"))
    c = m.select("traj", "pos", "k", F.col("c.id").alias("id"), F.col("c.function.name").alias("tool"), F.coalesce("c.function.arguments", F.lit("")).alias("arguments"))
    arg = lambda n: F.get_json_object("arguments", f"$.{n}")
    command = F.when(F.col("tool") == "bash", F.coalesce(arg("command"), F.lit("")))
    edits = F.coalesce(F.from_json(arg("edits"), "array<struct<newText:string>>"), F.array().cast("array<struct<newText:string>>"))
    one = F.from_json(arg("edits"), "struct<newText:string>")
    edits = F.when(F.trim(arg("edits")).startswith("{"), F.array(one)).otherwise(edits)
    new = F.aggregate(edits, F.lit(0), lambda a, e: a + lines(F.coalesce(e["newText"], F.lit(""))) + 1)
    c = c.withColumns({"command": command, "path": F.when(F.col("tool").isin("write", "edit"), arg("path"))})
    written = F.when(F.col("tool") == "write", lines(F.coalesce(arg("content"), F.lit(""))) + 1).when(F.col("tool") == "edit", new).otherwise(0)
    mutates = F.when(F.col("tool").isin("write", "edit"), "file").when(F.col("command").rlike(WRITES), "shell")
    return c.withColumns({"kind": F.when(F.col("tool") == "bash", F.concat(F.lit("bash:"), command_class(F.col("command")))).otherwise(F.col("tool")), "written": written, "mutates": mutates})


def attribution(trajectories: DataFrame) -> DataFrame:
    """One row for each trajectory (traj, task, category, lang, assistant_steps, messages): its tokens by role and kind, files, commands, tests, exploration before the first write, and its task type.

    Lines written by a shell command count only where it is the first write.
    Trajectories without messages have zeros. Results whose call isn't there are of no kind.
    """
    m = trajectories.select("traj", F.posexplode("messages").alias("pos", "m")).select("traj", "pos", "m.role", "m.content", "m.reasoning_content", "m.tool_call_id", "m.tool_calls")
    calls = tool_calls(trajectories)
    when = lambda cond, value: F.sum(F.when(cond, value).otherwise(0.0))
    role = lambda *r: F.col("role").isin(*r)
    by_role = m.groupBy("traj").agg(
        when(role("system", "user"), tokens(F.col("content"))).alias("prompt_tokens"), when(role("assistant"), tokens(F.col("content"))).alias("assistant_text_tokens"),
        when(role("assistant"), tokens(F.col("reasoning_content"))).alias("reasoning_tokens"), F.min_by(F.when(role("user"), F.coalesce("content", F.lit(""))), F.when(role("user"), F.col("pos"))).alias("user_msg"),
    )
    place = F.struct("pos", "k")
    first = calls.where("mutates is not null").groupBy("traj").agg(F.min_by(F.struct("pos", F.when(F.col("mutates") == "shell", F.greatest(F.lit(1), lines(F.col("command")))).otherwise(0).alias("shell_lines")), place).alias("w")).select("traj", F.col("w.pos").alias("first_write"), "w.shell_lines")
    n = lambda cond: F.count(F.when(cond, 1))
    by_call = calls.groupBy("traj").agg(
        F.sum(tokens(F.col("arguments"))).alias("tool_args_tokens"), F.sum("written").alias("written"), n(F.col("tool").isin("write", "edit")).alias("write_edit_calls"), F.count_distinct("path").alias("files_touched"),
        n(F.col("kind") == "bash:test-run").alias("test_runs"), n(F.col("tool") == "read").alias("reads"), (F.count("command") - F.count_distinct("command")).alias("repeated_commands"),
    )
    kinds = calls.groupBy("traj", F.col("id").alias("tool_call_id")).agg(F.max_by("kind", place).alias("kind"))
    results = m.where(role("tool")).join(kinds, ["traj", "tool_call_id"], "left").withColumn("t", tokens(F.col("content")))
    by_result = results.groupBy("traj").agg(
        F.sum("t").alias("tool_result_tokens"), when(F.col("kind") == "read", F.col("t")).alias("read_result_tokens"), when(F.col("kind") == "ls", F.col("t")).alias("ls_result_tokens"),
        when(F.col("kind").startswith("bash:"), F.col("t")).alias("bash_result_tokens"), when(F.col("kind") == "bash:test-run", F.col("t")).alias("test_output_tokens"),
        when(F.col("kind") == "bash:install", F.col("t")).alias("install_output_tokens"), n((F.col("kind") == "bash:test-run") & F.col("content").rlike(FAILED)).alias("test_fail_outputs"),
    )
    arguments = calls.groupBy("traj", "pos").agg(F.sum(tokens(F.col("arguments"))).alias("a"))
    early = m.join(first, "traj").where("pos < first_write").join(arguments, ["traj", "pos"], "left")
    explored = early.groupBy("traj").agg(F.sum(tokens(F.col("content")) + tokens(F.col("reasoning_content")) + F.coalesce("a", F.lit(0.0))).alias("explore_tokens"))
    head = trajectories.select("traj", "task", "category", "lang", "assistant_steps")
    got = reduce(lambda a, b: a.join(b, "traj", "left"), [by_role, first, by_call, by_result, explored], head)
    zero = [c for c in got.columns if c not in (*head.columns, "user_msg", "first_write")]
    got = got.fillna(0, zero).withColumn("deliverable_lines", F.col("written") + F.col("shell_lines")).drop("written", "shell_lines")
    got = got.withColumn("total_tokens", reduce(Column.__add__, map(F.col, TOKENS)))
    return got.withColumn("task_type", task_type())


def task_type() -> Column:
    """By category, then by how much was written in how many calls, then by what the user gave."""
    few = lambda calls, most: (F.col("write_edit_calls") <= calls) & (F.col("deliverable_lines") <= most)
    got = F.when(F.col("category") == "dependency-planning", "dependency-planning").when(F.col("write_edit_calls") == 0, "env-repair").when(few(2, 10), "one-edit-fix").when(few(3, 60), "small-module")
    return got.when(F.coalesce("user_msg", F.lit("")).rlike(GIVEN_SPEC), "spec-interface-impl").otherwise("other")


def by_task_type(rows: DataFrame) -> DataFrame:
    """(task_type, n, total_tokens, median_tokens, median_loc, median_tokens_per_loc, shares), the dearest lines first. Medians are upper ones."""
    share = lambda c: (F.sum(c) / F.when(F.sum("total_tokens") == 0, 1).otherwise(F.sum("total_tokens"))).alias(c.replace("_tokens", "_share"))
    sums = rows.groupBy("task_type").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("total_tokens"), share("explore_tokens"), share("test_output_tokens"), share("read_result_tokens"))
    for column, name in (("total_tokens", "median_tokens"), ("deliverable_lines", "median_loc")):
        sums = sums.join(upper_median(rows, ["task_type"], column, name), "task_type")
    return sums.withColumn("median_tokens_per_loc", F.col("median_tokens") / F.greatest(F.col("median_loc"), F.lit(1))).orderBy(F.desc("median_tokens_per_loc"), "task_type")


def dearest(rows: DataFrame, *types: str, by: str = "total_tokens", most: int | None = None) -> DataFrame:
    """Trajectories of these task types, the dearest first."""
    got = rows.where(F.col("task_type").isin(*types)).orderBy(F.desc(by), "task")
    return got if most is None else got.limit(most)


def early_exploration(rows: DataFrame, most: int = 10) -> DataFrame:
    """Implementations of a given interface by the share of tokens before the first write."""
    return dearest(rows.withColumn("explore_share", F.col("explore_tokens") / F.col("total_tokens")), "spec-interface-impl", by="explore_share", most=most)


def waste(rows: DataFrame) -> DataFrame:
    """(signal, value, share): over all trajectories, each also as a share of all tokens."""
    names = {"test output": "test_output_tokens", "file reads": "read_result_tokens", "install output": "install_output_tokens", "before first write": "explore_tokens", "repeated commands": "repeated_commands"}
    sums = rows.agg(F.sum("total_tokens").alias("t"), *(F.sum(c).cast("double").alias(c) for c in names.values()))
    each = F.array(*(F.struct(F.lit(n).alias("signal"), F.col(c).alias("value")) for n, c in names.items()))
    return sums.select("t", F.explode(each).alias("x")).select("x.signal", "x.value", (F.col("x.value") / F.when(F.col("t") == 0, 1).otherwise(F.col("t"))).alias("share"))
