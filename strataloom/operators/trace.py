"""Analytics over tool-use traces, question logs, trajectories and usage series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shell commands by what they do; an earlier entry labels a pipeline before a later one.
COMMANDS: list[tuple[str, bool, tuple[str, ...]]] = [
    ("search", False, ("ack", "ag", "grep", "rg")),
    ("read", False, ("awk", "bat", "cat", "head", "less", "more", "nl", "od", "paste", "sed", "tail")),
    ("locate", False, ("fd", "find", "glob", "locate", "ls", "tree")),
    ("git-history", False, ()),
    ("build", False, ("cargo", "cmake", "go", "gradle", "java", "javac", "make", "mvn", "npm", "npx", "pip", "pytest", "python", "python3", "tox")),
    ("inspect", False, ("basename", "cmp", "comm", "diff", "dirname", "du", "file", "md5sum", "readlink", "shasum", "stat", "wc", "which")),
    ("git-mutate", True, ()),
    ("mutate", True, ("chmod", "cp", "install", "ln", "mkdir", "mv", "patch", "rm", "tee", "touch", "truncate")),
    ("run-binary", False, ()),
    ("git-other", False, ()),
    ("network", False, ("curl", "wget")),
    ("echo", False, ("echo", "printf")),
    ("env", False, ("cd", "env", "export", "pwd")),
    ("other", False, ()),
]
LABELS = [c[0] for c in COMMANDS]
GIT_READ = ("blame", "branch", "describe", "diff", "log", "ls-files", "rev-parse", "show", "status")
GIT_WRITE = ("add", "apply", "checkout", "clean", "commit", "merge", "pull", "push", "rebase", "reset", "restore", "rm", "stash")
READ_OPERATIONS = ("git-history", "inspect", "locate", "read", "read-file", "search")
EXTENSIONS = ("c", "cpp", "css", "go", "gradle", "h", "html", "java", "js", "json", "kt", "md", "properties", "py", "rs", "sh", "sql", "toml", "ts", "txt", "xml", "yaml", "yml")

#: Ordered: the first that fits is the kind of question behind a step.
QUESTIONS: list[tuple[str, str]] = [
    ("verify-edit", r"\b(verify|confirm|double[- ]check|did (it|that) work|after (the|my) (edit|change))\b"),
    ("test-coverage", r"\b(tests?|coverage|assert\w*|junit)\b"),
    ("callers", r"\b(callers?|who calls|call sites?|usages?|used by|references?)\b"),
    ("hierarchy", r"\b(subclass\w*|implement\w*|extends|inherit\w*|overrid\w*|interfaces?)\b"),
    ("definition", r"\b(where is|defined|definition|declar\w+|locate|find the)\b"),
    ("behaviour", r"\b(how does|what does|understand|flow|logic|behaviou?r)\b"),
    ("structure", r"\b(structure|layout|overview|list|packages?|director(y|ies)|modules?)\b"),
]


def shell_label(command) -> Column:
    """struct(label, is_mutation) of a shell command, over the stages of its pipelines and lists."""
    c = F.col(command) if isinstance(command, str) else command
    stages = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\||&&|;"), lambda s: F.trim(s)), lambda s: s != "")
    rank = {label: i for i, label in enumerate(LABELS)}

    def of(stage: Column) -> Column:
        words = F.split(stage, r"\s+")
        head, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        out = F.when((head == "git") & second.isin(*GIT_WRITE), rank["git-mutate"]).when((head == "git") & second.isin(*GIT_READ), rank["git-history"])
        out = out.when((head == "git") & second.isNotNull(), rank["git-other"]).when(F.contains(head, F.lit("/")), rank["run-binary"])
        out = out.when((head == "sed") & (F.array_contains(F.slice(words, 1, 3), "-i")), rank["mutate"])
        for i, (_, _, names) in enumerate(COMMANDS):
            if names:
                out = out.when(head.isin(*names), i)
        return out.otherwise(rank["other"])

    ranks = F.transform(stages, of)
    changes = [i for i, (_, m, _) in enumerate(COMMANDS) if m]
    label = F.get(F.lit(LABELS), F.coalesce(F.array_min(ranks), F.lit(rank["other"])))
    return F.struct(label.alias("label"), F.exists(ranks, lambda r: r.isin(*changes)).alias("is_mutation"))


def classify_calls(calls: DataFrame) -> DataFrame:
    """calls (tool, arguments as JSON) with operation, is_mutation and target."""
    arg = lambda *names: F.coalesce(*(F.get_json_object("arguments", f"$.{n}") for n in names), F.lit(""))
    shell = shell_label(arg("command"))
    t = F.col("tool")
    op = F.when(t == "bash", shell["label"]).when(t == "read_file", "read-file").when(t.isin("apply_patch", "create", "edit", "multiedit", "write", "write_file"), "mutate")
    op = op.when(t.isin("grep", "search"), "search").when(t == "search_tool_functions", "tool-discovery").when(t.isin("ask_user_question", "skill", "sleep", "todo"), "meta").otherwise("other")
    target = F.when(t == "bash", arg("command")).when(t.isin("edit", "read_file", "write_file"), arg("file_path", "path")).otherwise(F.coalesce("arguments", F.lit("")))
    return calls.withColumns({"operation": op, "is_mutation": F.when(t == "bash", shell["is_mutation"]).otherwise(op == "mutate"), "target": target})


def first_mutations(events: DataFrame) -> DataFrame:
    """events with first_mut, the seq of the session's first mutation (null: none), and is_before."""
    w = Window.partitionBy("session_id")
    first = F.min(F.when(F.col("is_mutation"), F.col("seq"))).over(w)
    return events.withColumn("first_mut", first).withColumn("is_before", F.col("first_mut").isNull() | (F.col("seq") < F.col("first_mut")))


def question_kind(reasoning: Column, target: Column, after_mutation: Column) -> Column:
    """The kind of question behind a step by its words; by its target where they say nothing."""
    r = F.lower(F.coalesce(reasoning, F.lit("")))
    out = F.when(r.rlike(QUESTIONS[0][1]) & after_mutation, QUESTIONS[0][0])
    for name, pattern in QUESTIONS[1:]:
        out = out.when(r.rlike(pattern), name)
    t = F.lower(F.coalesce(target, F.lit("")))
    return out.when(t.rlike("test"), "test-coverage").when(t.rlike(r"\.(java|py|kt|go|rs|ts|js|c|cpp)\b"), "behaviour").otherwise("structure")


def ask_report(log: DataFrame) -> DataFrame:
    """One row: total, answered, hit_rate (four digits; null for an empty log)."""
    return log.agg(F.count("*").alias("total"), F.count("matched").alias("answered")).withColumn("hit_rate", F.when(F.col("total") > 0, F.round(F.col("answered") / F.col("total"), 4)))


def ask_projects(log: DataFrame) -> DataFrame:
    return log.groupBy("project").agg(F.count("*").alias("n"))


def matched_distribution(log: DataFrame) -> DataFrame:
    """(matched, n, share, avg_bytes)."""
    total = log.agg(F.count("*").alias("total"))
    got = log.where("matched is not null").groupBy("matched").agg(F.count("*").alias("n"), F.round(F.avg("answer_bytes"), 1).alias("avg_bytes"))
    return got.join(F.broadcast(total), F.lit(True)).select("matched", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), "avg_bytes")  # one row


def unmatched(log: DataFrame) -> DataFrame:
    """Questions nothing matched, in the order of the log."""
    return log.where("matched is null").orderBy("ts", "project", "question")


def mutation_split(events: DataFrame) -> DataFrame:
    """One row for each session: read calls and bytes before and after its first mutation."""
    e = first_mutations(events)
    read = F.col("operation").isin(*READ_OPERATIONS)
    s = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    return e.groupBy("session_id").agg(
        F.max(F.col("first_mut")).alias("first_mut"), s(read & F.col("is_before"), F.lit(1)).alias("reads_before"), s(read & ~F.col("is_before"), F.lit(1)).alias("reads_after"),
        s(read & F.col("is_before"), F.col("result_bytes")).alias("bytes_before"), s(read & ~F.col("is_before"), F.col("result_bytes")).alias("bytes_after"),
    )


def taxonomy(events: DataFrame, key: str) -> DataFrame:
    """(key, calls, bytes, calls_before, share of calls)."""
    e = first_mutations(events)
    got = e.groupBy(key).agg(F.count("*").alias("calls"), F.sum("result_bytes").cast("long").alias("bytes"), F.sum(F.col("is_before").cast("int")).cast("long").alias("calls_before"))
    total = events.agg(F.count("*").alias("total"))
    return got.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col("calls") / F.greatest(F.col("total"), F.lit(1)), 4)).drop("total")  # one row


def examples(events: DataFrame, key: str, most: int = 12) -> DataFrame:
    """The first `most` events of each key by session and seq."""
    w = Window.partitionBy(key).orderBy("session_id", "seq")
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def session_summary(split: DataFrame) -> DataFrame:
    """One row over mutation_split: sessions with and without mutation, mean reads before it."""
    has = F.col("first_mut").isNotNull()
    return split.agg(F.sum(has.cast("int")).cast("long").alias("with_mutation"), F.sum((~has).cast("int")).cast("long").alias("without_mutation"), F.round(F.avg(F.when(has, F.col("reads_before"))), 4).alias("avg_reads_before"))


def extension_of(target) -> Column:
    """The first known file extension in a text, lower-cased; null for none."""
    found = F.regexp_extract_all(F.lower(F.col(target) if isinstance(target, str) else target), F.lit(r"\.([a-z0-9]+)\b"), F.lit(1))
    return F.get(F.filter(found, lambda x: x.isin(*EXTENSIONS)), F.lit(0))


def extension_histogram(events: DataFrame, most: int = 15) -> DataFrame:
    got = events.select(extension_of("target").alias("ext")).where("ext is not null").groupBy("ext").agg(F.count("*").alias("n"))
    return got.orderBy(F.desc("n"), "ext").limit(most)


def top_captures(df: DataFrame, column: str, pattern: str, most: int = 25) -> DataFrame:
    """(capture, n): the commonest captures of an expression's first group."""
    got = df.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("capture")).groupBy("capture").agg(F.count("*").alias("n"))
    return got.orderBy(F.desc("n"), "capture").limit(most)


def pattern_counts(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """One row for each name: how often its expression matches over all rows."""
    sums = df.agg(*(F.sum(F.regexp_count(column, F.lit(p))).cast("long").alias(n) for n, p in patterns.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in patterns))).alias("x")).select("x.name", "x.n")


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def approx_tokens(column: str) -> Column:
    """Four characters a token."""
    return F.length(F.coalesce(F.col(column), F.lit(""))) / 4


def token_attribution(messages: DataFrame) -> DataFrame:
    """Tokens by role for each trajectory of rows (traj, role, text), and messages and tokens in all."""
    t = approx_tokens("text")
    by = {r: F.sum(F.when(F.col("role") == r, t).otherwise(0.0)).alias(f"{r}_tokens") for r in ("system", "user", "assistant", "tool")}
    return messages.groupBy("traj").agg(F.count("*").alias("messages"), F.sum(t).alias("tokens"), *by.values())


def repeated_reads(files: DataFrame) -> DataFrame:
    """(traj, files, repeats): distinct files touched, and touches beyond each one's first."""
    return files.groupBy("traj", "file").agg(F.count("*").alias("c")).groupBy("traj").agg(F.count("*").alias("files"), F.sum(F.col("c") - 1).cast("long").alias("repeats"))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The element at position n div 2 of each group's sorted values: never interpolated.

    Nothing is gathered and no task sorts a group: the order is taken over
    counts of distinct values, with prefix sums in two levels, coarse buckets of
    the value and values in a bucket.
    """
    up = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    c = c.withColumn("__g", F.signum("__v") * F.floor(F.log2(F.abs("__v") + 1) * 64))
    coarse = c.groupBy(*keys, "__g").agg(F.sum("__k").alias("__b")).withColumn("__base", F.sum("__b").over(up(keys, "__g")) - F.col("__b")).drop("__b")  # a few thousand buckets a group
    cum = c.join(coarse, [*keys, "__g"]).withColumn("__last", F.col("__base") + F.sum("__k").over(up([*keys, "__g"], "__v")))
    n = c.groupBy(*keys).agg(F.sum("__k").alias("__n"))
    return cum.join(n, keys).where(F.col("__last") > F.floor(F.col("__n") / 2)).groupBy(*keys).agg(F.min("__v").alias(name))


def usage_series(usage: DataFrame) -> DataFrame:
    """usage (child, call, input_tokens, cached_input_tokens, output_tokens) with uncached and added tokens."""
    w = Window.partitionBy("child").orderBy("call")
    return usage.withColumns({"uncached": F.col("input_tokens") - F.col("cached_input_tokens"), "added": F.col("input_tokens") - F.coalesce(F.lag("input_tokens").over(w), F.lit(0))})


def usage_sums(usage: DataFrame) -> DataFrame:
    s = lambda c, n: F.sum(c).alias(n)
    return usage.groupBy("child").agg(F.count("*").alias("calls"), s("input_tokens", "input"), s("cached_input_tokens", "cached"), s("output_tokens", "output"))


def bytes_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("result_bytes").cast("long").alias("bytes"))


SIZE_BUCKETS = ((0, "0"), (1024, "1k"), (4096, "4k"), (16384, "16k"), (65536, "64k"), (1048576, "1M"))


def size_bucket(size: Column) -> Column:
    """The bucket whose lower bound is the largest not above the size."""
    out = F.lit(SIZE_BUCKETS[0][1])
    for low, name in SIZE_BUCKETS[1:]:
        out = F.when(size >= low, name).otherwise(out)
    return out


def size_distribution(df: DataFrame, column: str) -> DataFrame:
    """(bucket, n, bytes, byte_share)."""
    got = df.where(F.col(column).isNotNull()).groupBy(size_bucket(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(column).cast("long").alias("bytes"))
    total = df.agg(F.sum(column).alias("total"))
    return got.join(F.broadcast(total), F.lit(True)).select("bucket", "n", "bytes", F.round(F.col("bytes") / F.greatest(F.col("total"), F.lit(1)), 4).alias("byte_share"))  # one row


def size_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, the values at positions n div 2 and int(0.9 n) in order, the largest, and the share of bytes in sizes of 16 KiB and more.

    The order is taken over counts of distinct sizes, so no task sorts all rows.
    """
    c = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    total = c.agg(F.sum("k").alias("n"), F.max("v").alias("largest"), F.sum(F.col("k") * F.col("v")).alias("b"), F.sum(F.when(F.col("v") >= 16384, F.col("k") * F.col("v")).otherwise(0)).alias("big"))
    # prefix sums in two levels: coarse buckets of the value, then values in a bucket
    c = c.withColumn("g", F.floor(F.log2(F.col("v") + 1) * 64))
    up = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = c.groupBy("g").agg(F.sum("k").alias("k")).withColumn("base", F.sum("k").over(up([F.lit(0)], "g")) - F.col("k")).select("g", "base")  # a few thousand buckets
    cum = c.join(coarse, "g").withColumn("last", F.col("base") + F.sum("k").over(up(["g"], "v")))
    at = cum.join(F.broadcast(total), F.lit(True))  # one row
    pick = lambda pos: F.min(F.when(F.col("last") > pos, F.col("v")))
    return at.agg(
        F.max("n").alias("n"), pick(F.floor(F.col("n") / 2)).alias("median"), pick(F.floor(F.col("n") * 0.9)).alias("p90"), F.max("largest").alias("largest"),
        F.round(F.max(F.col("big")) / F.greatest(F.max("b"), F.lit(1)), 4).alias("big_share"),
    )


def pair_by_position(calls: DataFrame, results: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """(key, call seq, result seq): the n-th result of a session goes to its n-th call; calls without one have null."""
    w = Window.partitionBy(key).orderBy(order)
    a = calls.select(key, F.col(order).alias("call_seq"), F.row_number().over(w).alias("rn"))
    b = results.select(key, F.col(order).alias("result_seq"), F.row_number().over(w).alias("rn"))
    return a.join(b, [key, "rn"], "left").select(key, "call_seq", "result_seq")


def keep_largest(df: DataFrame, keys: list[str], size: str, tie: str) -> DataFrame:
    """Of each key the row of the largest size, on ties the least `tie`. Combined before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(size, -F.col(tie))).alias("b"))
    return best.select("b.*")


def top_rows(df: DataFrame, by: str, tie: str, most: int) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(most)


def arm_comparison(df: DataFrame, arm: str, *values: str) -> DataFrame:
    return df.groupBy(arm).agg(F.count("*").alias("n"), *(F.round(F.avg(v), 4).alias(f"avg_{v}") for v in values))
