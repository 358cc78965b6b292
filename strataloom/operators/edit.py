"""Edits of source texts: operations are spliced into the text, so all else stays as it was written."""

from __future__ import annotations

import difflib
import json
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.graph import CodeGraph
from strataloom.sources.java_text import ParseFailure, Reader, tokens
from strataloom.storage import stored

#: kind -> what its target is
KINDS = {
    "ADD_METHOD": "class", "REMOVE_METHOD": "member", "REPLACE_METHOD_BODY": "member", "ADD_FIELD": "class", "REMOVE_FIELD": "member", "ADD_IMPORT": "class", "REMOVE_IMPORT": "class",
}
RESULT = "n int, kind string, target string, success boolean, message string, node_id string, file string"


class BadOperation(ValueError):
    pass


@dataclass(frozen=True)
class Operation:
    """target: a class, or a member as Class.name, for methods with `#name(T)` where there are several. type: a return or field type. body: statements. name: of a new member, or an import."""

    kind: str
    target: str
    name: str = ""
    type: str = ""
    body: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise BadOperation(f"unknown operation {self.kind}")
        if not self.target.strip():
            raise BadOperation(f"{self.kind} needs a target")
        if KINDS[self.kind] == "class" and not self.name.strip():
            raise BadOperation(f"{self.kind} needs a name")

    @property
    def cls(self) -> str:
        return self.target if KINDS[self.kind] == "class" else self.target.partition("#")[0].rpartition(".")[0]


def parse_operation(text: str) -> Operation:
    """KIND:class:name|type|body for methods, KIND:class:name:type for fields, KIND:target otherwise, or a JSON object with the same parts."""
    text = text.strip()
    if text.startswith("{"):
        try:
            given = json.loads(text)
        except json.JSONDecodeError as e:
            raise BadOperation(f"not JSON: {e}") from None
        if not isinstance(given, dict) or not set(given) <= set(Operation.__dataclass_fields__) or not {"kind", "target"} <= set(given):
            raise BadOperation("an operation has kind and target, and may have name, type and body")
        return Operation(**{k: str(v) for k, v in given.items()})
    kind, _, rest = text.partition(":")
    kind = kind.strip().upper()
    if kind == "ADD_METHOD":
        target, _, method = rest.partition(":")
        name, kind_of, body = (method.split("|", 2) + ["", ""])[:3]
        return Operation(kind, target.strip(), name.strip(), kind_of.strip() or "void", body)
    if kind == "ADD_FIELD":
        target, name, kind_of = (rest.split(":", 2) + ["", ""])[:3]
        return Operation(kind, target.strip(), name.strip(), kind_of.strip() or "Object")
    if kind in ("ADD_IMPORT", "REMOVE_IMPORT"):
        target, _, name = rest.partition(":")
        return Operation(kind, target.strip(), name.strip())
    if kind == "REPLACE_METHOD_BODY":
        target, _, body = rest.partition("|")
        return Operation(kind, target.strip(), body=body)
    return Operation(kind, rest.strip())


class _Text:
    def __init__(self, file: str, text: str):
        self.text = text
        self.r = Reader(file, text, enum_members=True)
        self.r.unit()
        self.starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]

    def at(self, position: dict) -> int:
        return self.starts[position["line"] - 1] + position["column"] - 1

    def node(self, kinds: tuple[str, ...], name: str) -> dict:
        """The only node of that qualified name; of a method its name without the signature is enough."""
        bare = lambda n: n["qualified_name"].partition("#")[0]
        found = [n for n in self.r.rows["nodes"] if n["type"] in kinds and name in (n["qualified_name"], bare(n))]
        if len(found) != 1:
            raise BadOperation(f"{len(found) or 'nothing'} of the name {name}" + (", give its signature" if found else ""))
        return found[0]

    def spot(self, token) -> int:
        return self.starts[token.line - 1] + token.column - 1

    def indent(self, offset: int) -> str:
        line = self.text[self.text.rfind("\n", 0, offset) + 1 : offset]
        return line[: len(line) - len(line.lstrip())]

    def without(self, start: int, end: int) -> str:
        """The text less a part, and less its line where nothing else is on it."""
        a, b = self.text.rfind("\n", 0, start) + 1, self.text.find("\n", end)
        b = len(self.text) if b < 0 else b + 1
        if not self.text[a:start].strip() and not self.text[end:b].strip():
            start, end = a, b
        return self.text[:start] + self.text[end:]


def _edited(file: str, text: str, op: Operation) -> tuple[str, str | None]:
    """(new text, id of the node that came or went)."""
    t = _Text(file, text)
    _closed(op.body)
    if op.kind in ("ADD_METHOD", "ADD_FIELD"):
        cls = t.node(("CLASS", "INTERFACE"), op.target)
        key = f"{op.target}.{op.name}" + (f"#{op.name}()" if op.kind == "ADD_METHOD" else "")
        if any(n["qualified_name"] == key for n in t.r.rows["nodes"] if n["type"] in ("METHOD", "FIELD")):
            raise BadOperation(f"{key} is there already")
        end = t.at(cls["end"])
        pad = t.indent(t.at(cls["start"])) + "    "
        new = f"{op.type} {op.name}() {{ {op.body.strip()} }}" if op.kind == "ADD_METHOD" else f"private {op.type} {op.name};"
        lead = "" if text[:end].rstrip(" \t").endswith("\n") else "\n"
        cut = len(text[:end].rstrip(" \t"))
        out = text[:cut] + lead + pad + new + "\n" + t.indent(t.at(cls["start"])) + text[end:]
        return out, ("mth:" if op.kind == "ADD_METHOD" else "fld:") + key.replace(".", "/")
    if op.kind in ("REMOVE_METHOD", "REPLACE_METHOD_BODY"):
        m = t.node(("METHOD",), op.target)
        start, end = t.at(m["start"]), t.at(m["end"]) + 1
        if op.kind == "REMOVE_METHOD":
            return t.without(start, end), m["id"]
        inner = [x for x in t.r.t if start <= t.spot(x) < end]
        if inner[-1].text != "}":
            raise BadOperation(f"{op.target} has no body")
        depth, k = 0, len(inner)
        while True:
            k -= 1
            depth += (inner[k].text == "}" and inner[k].kind == "op") - (inner[k].text == "{" and inner[k].kind == "op")
            if not depth:
                break
        return text[: t.spot(inner[k]) + 1] + f" {op.body.strip()} " + text[end - 1 :], m["id"]
    if op.kind == "REMOVE_FIELD":
        f = t.node(("FIELD",), op.target)
        toks, name = t.r.t, next(i for i, x in enumerate(t.r.t) if t.spot(x) == t.at(f["start"]))
        first, last = _declarator(toks, name)
        whole = toks[first - 1].text in ("{", "}", ";") and toks[last].text == ";"
        if whole:
            return t.without(t.spot(toks[first]), t.spot(toks[last]) + 1), f["id"]
        if toks[last].text == ",":  # further names follow: this one and its comma go
            return text[: t.spot(toks[name])] + text[t.spot(toks[last + 1]) :], f["id"]
        return text[: t.spot(toks[first - 1])] + text[t.spot(toks[last]) :], f["id"]
    t.node(("CLASS", "INTERFACE"), op.target)
    if op.kind == "ADD_IMPORT":
        if op.name in t.r.imports:
            raise BadOperation(f"{op.name} is imported already")
        place = max((t.spot(x) for i, x in enumerate(t.r.t) if x.text == ";" and _heads(t.r.t, i)), default=-1) + 1
        return text[:place] + ("\n" if place else "") + f"import {op.name};" + ("" if place else "\n") + text[place:], None
    for i, x in enumerate(t.r.t):
        if x.text == "import":
            end = next(j for j in range(i, len(t.r.t)) if t.r.t[j].text == ";")
            if "".join(y.text for y in t.r.t[i + 1 : end] if y.text != "static") == op.name:
                return t.without(t.spot(x), t.spot(t.r.t[end]) + 1), None
    raise BadOperation(f"{op.name} is not imported")


def _closed(body: str) -> None:
    """A body must not end the method it is put into."""
    depth = 0
    for x in tokens(body):
        depth += (x.kind == "op" and x.text == "{") - (x.kind == "op" and x.text == "}")
        if depth < 0:
            break
    if depth:
        raise BadOperation("the braces of the body don't match")


def _heads(toks, i: int) -> bool:
    """Whether the semicolon toks[i] ends a package or import line."""
    k = i - 1
    while k >= 0 and toks[k].text not in (";", "{", "}"):
        if toks[k].text in ("package", "import"):
            return True
        k -= 1
    return False


def _declarator(toks, name: int) -> tuple[int, int]:
    """(the first token of a field's declaration, or of its declarator after a comma; the comma or semicolon after it)."""
    depth, last = 0, name
    while depth or toks[last].text not in (",", ";"):
        depth += (toks[last].text in "([{" and toks[last].kind == "op") - (toks[last].text in ")]}" and toks[last].kind == "op")
        last += 1
    depth, first = 0, name
    while True:
        x = toks[first - 1]
        if x.kind == "op" and not depth and (x.text in ("{", "}", ";") or x.text == "," and not _in_arguments(toks, first - 1)):
            return first, last
        if x.kind == "op":
            depth += (x.text in ")]") - (x.text in "([")
        first -= 1


def _in_arguments(toks, k: int) -> bool:
    """Whether the comma toks[k] stands between type arguments."""
    depth = 0
    while k >= 0 and toks[k].text not in (";", "{", "}", "="):
        depth += (toks[k].text == "<") - (toks[k].text == ">")
        k -= 1
    return depth > 0


def edit_text(file: str, text: str, operations: list[Operation]) -> tuple[str, list[tuple[bool, str, str | None]]]:
    """The text after all operations that succeed, in order, and for each (success, message, node id). A failure doesn't stop the rest."""
    results = []
    for op in operations:
        try:
            new, node_id = _edited(file, text, op)
            Reader(file, new).unit()  # what can't be read again is not kept
            text = new
            results.append((True, "done", node_id))
        except (BadOperation, ParseFailure, RecursionError) as e:
            results.append((False, str(e) or "nested too deeply", None))
    return text, results


def apply_edits(g: CodeGraph, sources: DataFrame, operations: list[Operation]) -> tuple[DataFrame, DataFrame]:
    """((file, before, after) of the files that changed, results) of operations on sources (file, text).

    A target's file is that of its class in the graph. results: one row for each
    operation; operations whose class or file isn't there fail and the others go on.
    """
    s = sources.sparkSession
    asked = s.createDataFrame([(i, *asdict(op).values(), op.cls) for i, op in enumerate(operations)], "n int, kind string, target string, name string, type string, body string, cls string")
    homes = g.classes.groupBy(F.col("qualified_name").alias("cls")).agg(F.min("file").alias("file"))
    placed = asked.join(homes, "cls", "left")
    parts = F.struct("n", "kind", "target", "name", "type", "body")
    per = placed.where("file is not null").groupBy("file").agg(F.sort_array(F.collect_list(parts)).alias("ops"))  # a batch of edits is small
    result = "array<struct<" + RESULT.replace(" int", ":int").replace(" string", ":string").replace(" boolean", ":boolean").replace(", ", ",") + ">>"

    def run(batches):
        for b in batches:
            rows = []
            for file, text, ops in zip(*(b.column(i).to_pylist() for i in range(3))):
                after, got = edit_text(file, text or "", [Operation(o["kind"], o["target"], o["name"], o["type"], o["body"]) for o in ops])
                rows.append((file, text, after, [{"n": o["n"], "kind": o["kind"], "target": o["target"], "success": ok, "message": m, "node_id": i, "file": file} for o, (ok, m, i) in zip(ops, got)]))
            fields = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("target", pa.string()), ("success", pa.bool_()), ("message", pa.string()), ("node_id", pa.string()), ("file", pa.string())]))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], fields)], ["file", "before", "after", "results"])

    done = stored(sources.select("file", "text").join(per, "file").mapInArrow(run, f"file string, before string, after string, results {result}"), "edited")
    results = done.select(F.explode("results").alias("r")).select("r.*")
    lost = placed.join(results.select("n"), "n", "left_anti").select("n", "kind", "target", F.lit(False).alias("success"), F.lit("no such class or file").alias("message"), F.lit(None).cast("string").alias("node_id"), "file")
    return done.where("before <> after").select("file", "before", "after"), results.unionByName(lost)


def edit_summary(results: DataFrame) -> DataFrame:
    """One row: applied, succeeded, failed."""
    return results.agg(F.count("*").alias("applied"), F.count(F.when(F.col("success"), 1)).alias("succeeded"), F.count(F.when(~F.col("success"), 1)).alias("failed"))


def rendered(changed: DataFrame, results: DataFrame, form: str = "text") -> str:
    """A batch's outcome as text, json, diff, source or summary. An edit batch is small and shown whole; nothing is written."""
    rows = results.orderBy("n").collect()
    if form == "json":
        return json.dumps([r.asDict() for r in rows], indent=1)
    if form == "summary":
        return f"{len(rows)} applied, {sum(r.success for r in rows)} succeeded, {sum(not r.success for r in rows)} failed"
    if form == "text":
        return "\n".join(f"{'ok' if r.success else 'failed'} {r.kind} {r.target}: {r.message}" for r in rows)
    files = changed.orderBy("file").collect()
    if form == "source":
        return "\n".join(f"// {f.file}\n{f.after}" for f in files)
    if form == "diff":
        return "".join("".join(difflib.unified_diff(f.before.splitlines(True), f.after.splitlines(True), f.file, f.file)) for f in files)
    raise ValueError("form must be text, json, diff, source or summary")


def write_sources(changed: DataFrame, path: str) -> None:
    """Edited files whole, as (file, text) in Parquet: what was not edited is not written."""
    changed.select("file", F.col("after").alias("text")).write.mode("overwrite").parquet(path)
