"""The twelve tools that agents call: arguments are checked, answers are plain rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strataloom.operators import lookup as L
from strataloom.operators.cache import LiveGraph
from strataloom.operators.coverage import tests_for
from strataloom.operators.mutate import change_log
from strataloom.plans.router import Answer, Router, path_between
from strataloom.sources.java import update_file
from strataloom.sources.sinks import append_log

MEMBERS = ("methods", "fields", "subclasses", "implementations")


class BadArgument(ValueError):
    pass


def _need(name: str, value: str | None) -> str:
    if value is None or not str(value).strip():
        raise BadArgument(f"{name} is required")
    return str(value).strip()


class Tools:
    """logs: a folder for the logs of questions, edits and feedback; none are kept without one. changed: tells the files changed since the build, for the stale flag."""

    def __init__(self, live: LiveGraph, logs: str | None = None, changed: Callable[[], DataFrame] | None = None, project: str = ""):
        self.live, self.logs, self.changed, self.project, self.edits = live, logs, changed, project, []

    @property
    def g(self):
        return self.live.graph

    def _log(self, kind: str, schema: str, *row) -> None:
        if self.logs:
            append_log(self.g.spark.createDataFrame([(datetime.now(timezone.utc), self.project, *row)], f"ts timestamp, project string, {schema}").coalesce(1), f"{self.logs}/{kind}")

    def ask(self, question: str) -> Answer:
        got = Router(self.g).ask(_need("question", question))
        self._log("ask", "question string, matched string, answer_bytes long, ok boolean", question, got.matched, len(got.text.encode()), True)
        return got

    def tests(self, fqn: str, link: str | None = None, methods: bool = False, limit: int | None = None) -> list[Row]:
        return tests_for(self.g, self._class(fqn), link, methods, limit).collect()

    def callpath(self, start: str, end: str, depth: int = 5) -> list[Row]:
        return path_between(self.g, _need("from", start), _need("to", end), depth).collect()

    def search(self, q: str) -> list[Row]:
        return L.search(self.g, _need("q", q)).orderBy("qualified_name").collect()

    def class_detail(self, fqn: str) -> Row:
        return L.class_detail(self.g, self._class(fqn)).first()

    def class_members(self, fqn: str, kind: str = "methods", verbose: bool = False) -> list[Row]:
        """Names in order; verbose adds file and line."""
        if kind not in MEMBERS:
            raise BadArgument(f"kind must be one of {', '.join(MEMBERS)}")
        got = {"methods": L.methods_of, "fields": L.fields_of, "subclasses": L.subclasses, "implementations": L.implementations}[kind](self.g, self._class(fqn))
        more = ["file", F.col("start.line").alias("line")] if verbose else []
        return got.select("qualified_name", *more).orderBy("qualified_name").collect()

    def classes(self, package: str | None = None, prefix: str | None = None, limit: int = 500) -> list[Row]:
        if not (package or prefix):
            raise BadArgument("package or prefix is required")
        if not 1 <= limit <= 1000:
            raise BadArgument("limit must be from 1 to 1000")
        return L.list_classes(self.g, package, prefix, limit).collect()

    def packages(self) -> list[Row]:
        return self.g.of_type("PACKAGE").select("name").distinct().orderBy("name").collect()

    def edited(self, path: str, text: str | None) -> dict[str, int]:
        """One file read anew: the numbers of nodes removed and added."""
        self.live.graph, n = update_file(self.g, _need("path", path), text)
        self.edits.append((datetime.now(timezone.utc), path, n["removed"], n["added"]))
        self._log("edits", "path string, removed_nodes int, added_nodes int, kind string, target string, note string", path, n["removed"], n["added"], None, None, None)
        return n

    def feedback(self, question: str, rating: str, matched: str | None = None, comment: str | None = None) -> None:
        self._log("feedback", "question string, matched string, rating string, comment string", _need("question", question), matched, _need("rating", rating), comment)

    def changes(self, limit: int = 200) -> list[Row]:
        """The newest edits first."""
        return change_log(self.g.spark.createDataFrame(self.edits, "ts timestamp, path string, removed int, added int"), limit).collect()

    def stats(self) -> dict:
        out = L.totals(self.g).first().asDict() | {"rebuilding": self.live.rebuilding, "stale": False, "stale_files": 0}
        if self.changed is not None:
            out["stale_files"] = self.changed().count()
            out["stale"] = out["stale_files"] > 0
        return out

    def _class(self, fqn: str) -> str:
        """A class by its qualified name, or by a simple name that only one bears."""
        row = L.resolve_one(self.g, _need("class", fqn)).select("qualified_name").limit(2).collect()
        if len(row) != 1:
            raise BadArgument(f"no class {fqn}")
        return row[0].qualified_name
