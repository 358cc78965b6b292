"""Questions in words: an ordered list of intents picks the operator that answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.graph import CodeGraph
from strataloom.operators import lookup as L
from strataloom.operators import rank as R
from strataloom.operators import text as X
from strataloom.operators.closure import call_paths, labelled_paths
from strataloom.operators.coverage import tests_for

# --- fixed values: they decide which operator answers and how much is shown -----------------------
LINES, CALLERS, TESTS, LITERALS, PATHS, DEPTH, CHARACTERS = 50, 10, 20, 20, 10, 5, 4096
ABOUT_TESTS = re.compile(r"\btest(s|ed|ing)?\b|\bverif(y|ies|ied)\b|\bassert", re.I)
VALUE_WORDS = ("where", "defined", "declared", "default", "constant", "value")
PLACE_WORDS = ("where", "defined", "declared", "live", "located", "location")


@dataclass
class Answer:
    """matched: the operator that answered, None for none. rows: its lazy result. count: the number of its rows before any cap on what is shown."""

    question: str
    matched: str | None
    rows: DataFrame | None
    count: int
    text: str


def capped(text: str, most: int = CHARACTERS) -> str:
    """A text cut at its last line break within `most` characters."""
    if len(text) <= most:
        return text
    cut = text.rfind("\n", 0, most)
    return text[: cut if cut > 0 else most] + "\n(cut)"


def listing(rows: DataFrame, order: list[str], most: int = LINES) -> tuple[int, str]:
    n = rows.count()
    shown = rows.orderBy(*order).limit(most).collect()
    lines = [" | ".join("" if v is None else str(v) for v in r) for r in shown]
    return n, "\n".join(lines + ([f"... and {n - len(shown)} more"] if n > len(shown) else []))


def _said(question: str, matched: str, rows: DataFrame, order: list[str], head: str, most: int = LINES) -> Answer:
    n, body = listing(rows, order, most)
    return Answer(question, matched, rows, n, capped(f"{head}: {n}\n{body}" if n else f"{head}: none"))


class Router:
    """Answers over one graph. Each question takes a few small lookups; nothing is gathered but what is shown."""

    def __init__(self, g: CodeGraph):
        self.g = g

    def ask(self, question: str) -> Answer:
        low, words = question.lower(), R.identifiers(question)
        has = lambda *parts: any(p in low for p in parts)
        found = R.resolve_class(self.g, words).collect()  # at most five
        literals = R.literals(question)
        if has("implement"):
            got = self.of_class(question, found, "implementations")
            if not (got.matched == "implementations" and got.count == 0 and has("where")):
                return got
        if has("subclass", "extends"):
            return self.of_class(question, found, "subclasses")
        if has("call", "use", "read"):
            if got := self.field_usage(question, words):
                return got
            if has("where") and has("defined", "declared") and not literals and (got := self.field_place(question, words)):
                return got
            return self.callers(question, words) if has("call") else self.none(question, "no field is named; parameters and locals are not modelled")
        if (has("path", "flow") or has("from") and has("to")) and (got := self.path(question, words)):
            return got
        if ABOUT_TESTS.search(low):
            return self.tests(question, found)
        if literals and has(*VALUE_WORDS) and (got := self.values(question, literals)):
            return got
        if has("method"):
            return self.of_class(question, found, "methods")
        if has("field", "variable", "member"):
            if not self.one(found):
                if got := self.field_usage(question, words):
                    return got
                if not literals and (got := self.field_place(question, words)):
                    return got
            return self.of_class(question, found, "fields")
        if has(*PLACE_WORDS):
            return self.place(question, found, words)
        if self.one(found):
            return self.of_class(question, found, "class-detail")
        methods = R.resolve_method(self.g, words)
        if not methods.isEmpty():
            return self.of_methods(question, methods, "method")
        return self.fuzzy(question, words) or self.none(question, "nothing in the question names a class, method or field")

    # --- parts ------------------------------------------------------------------------------------
    @staticmethod
    def one(found: list) -> str | None:
        return found[0].qualified_name if found and not found[0].ambiguous else None

    @staticmethod
    def none(question: str, why: str) -> Answer:
        return Answer(question, None, None, 0, why)

    def of_class(self, question: str, found: list, what: str) -> Answer:
        fqn = self.one(found)
        if fqn is None:
            if found:
                rows = self.g.classes.where(F.col("qualified_name").isin([r.qualified_name for r in found])).select("qualified_name", "file")
                return _said(question, "ambiguous", rows, ["qualified_name"], "several classes fit")
            return self.none(question, "no class is named in the question")
        if what == "methods":
            return _said(question, what, L.methods_of(self.g, fqn).select("signature", "return_type"), ["signature"], f"methods of {fqn}")
        if what == "fields":
            return _said(question, what, L.fields_of(self.g, fqn).select("name", "data_type"), ["name"], f"fields of {fqn}")
        if what == "class-detail":
            return _said(question, what, L.class_detail(self.g, fqn), ["qualified_name"], fqn)
        rows = {"subclasses": L.subclasses, "implementations": L.implementations}[what](self.g, fqn)
        return _said(question, what, rows.select("qualified_name", "file"), ["qualified_name"], f"{what} of {fqn}")

    def named_fields(self, words: list[str]) -> DataFrame:
        names = [w.rpartition(".")[2] for w in words]
        known = self.g.classes.select("name").where(F.col("name").isin(names)).distinct()
        return self.g.fields.where(F.col("name").isin(names)).join(known, "name", "left_anti")

    def field_usage(self, question: str, words: list[str]) -> Answer | None:
        """Uses of the fields a question names; names that classes bear too don't count."""
        if not words:
            return None
        fields = self.named_fields(words).select(F.col("qualified_name").alias("field_qn")).distinct()
        if fields.isEmpty():
            return None
        used = self.g.table("field_usages").join(fields, "field_qn").select("field_qn", "method_qn", "file", "line")
        return _said(question, "field-usage", used, ["field_qn", "file", "line", "method_qn"], "uses of fields")

    def field_place(self, question: str, words: list[str]) -> Answer | None:
        near = R.fields_by_stem(self.g, words)
        rows = near.join(self.g.fields.select("qualified_name", "data_type", "file", F.col("start.line").alias("line")).distinct(), "qualified_name").select("qualified_name", "data_type", "file", "line", "score")
        return None if near.isEmpty() else _said(question, "field-location", rows, [F.desc("score"), "qualified_name"], "fields of like names")

    def callers(self, question: str, words: list[str]) -> Answer:
        methods = R.resolve_method(self.g, words)
        row = methods.select("name").limit(1).collect()
        if not row:
            return self.none(question, "no method is named in the question")
        rows = R.callers_by_overload(self.g, row[0].name, CALLERS)
        totals = rows.groupBy("method").agg(F.max("total").alias("t")).agg(F.sum("t").alias("n")).first().n or 0
        _, body = listing(rows, ["method", "caller"], LINES * CALLERS)
        return Answer(question, "callers", rows, int(totals), capped(f"callers of {row[0].name}: {totals}\n{body}"))

    def path(self, question: str, words: list[str]) -> Answer | None:
        named = re.search(r"\bfrom\s+([\w.$]+).*?\bto\s+([\w.$]+)", question, re.I)
        ends = [named[1].rstrip("."), named[2].rstrip(".")] if named else words[:2]
        if len(ends) < 2:
            return None
        got = path_between(self.g, ends[0], ends[1])
        return None if got.isEmpty() else _said(question, "callpath", got, ["hops", "label"], f"paths from {ends[0]} to {ends[1]}", PATHS)

    def tests(self, question: str, found: list) -> Answer:
        fqn = self.one(found)
        if fqn is None:
            return self.of_class(question, found, "tests")
        return _said(question, "tests", tests_for(self.g, fqn).select("test_class", "link"), ["test_class"], f"tests of {fqn}", TESTS)

    def values(self, question: str, literals: list[str]) -> Answer | None:
        rows = None
        for x in literals:  # three at most
            one = X.literals_containing(self.g.table("values"), x, LITERALS)
            rows = one if rows is None else rows.unionByName(one)
        return None if rows.isEmpty() else _said(question, "values", rows.select("value", "class_fqn", "field_name", "file", "line").distinct(), ["file", "line", "value"], "values", LITERALS * 3)

    def of_methods(self, question: str, methods: DataFrame, what: str) -> Answer:
        return _said(question, what, methods.select("qualified_name", "file", F.col("start.line").alias("line")), ["qualified_name"], "methods")

    def fuzzy(self, question: str, words: list[str]) -> Answer | None:
        best = R.fuzzy_methods(self.g, words, 1).select("id")
        return None if best.isEmpty() else self.of_methods(question, self.g.methods.join(best, "id", "left_semi"), "fuzzy-method")

    def place(self, question: str, found: list, words: list[str]) -> Answer:
        """A class; a name of few methods; the likeliest method; any method; several classes; a field."""
        if fqn := self.one(found):
            rows = L.class_by_name(self.g, fqn).select("qualified_name", "file", F.col("start.line").alias("line"))
            return _said(question, "location", rows, ["qualified_name"], "defined in")
        methods = R.resolve_method(self.g, words)
        n = methods.limit(4).count()
        if 0 < n <= 3:
            return self.of_methods(question, methods, "location")
        if got := self.fuzzy(question, words):
            return got
        if n:
            return self.of_methods(question, methods, "location")
        return self.of_class(question, found, "class-detail") if found else self.field_place(question, words) or self.none(question, "nothing of that name")


def path_between(g: CodeGraph, start: str, end: str, depth: int = DEPTH, most: int = PATHS) -> DataFrame:
    """(label, hops): at most `most` call paths between what two specs mean, at most three methods each."""
    a, b = (R.method_specs(g, x, 3).select(F.col("id").alias(n)) for x, n in ((start, "src"), (end, "dst")))
    ends = a.join(F.broadcast(b), F.lit(True))  # three rows by three
    return labelled_paths(call_paths(g.calls, ends, depth), g.methods, most)


def routed(questions: DataFrame, column: str = "question") -> DataFrame:
    """questions with `intent`, the first rule whose words a question has, for logs of any size. What a graph decides, such as whether a name resolves, is not asked."""
    low = F.lower(column)
    has = lambda *parts: low.rlike("|".join(parts))
    intent = (
        F.when(has("implement"), "implementations").when(has("subclass", "extends"), "subclasses").when(has("call"), "callers").when(has("use", "read"), "field-usage")
        .when(has("path", "flow") | (low.contains("from") & low.contains("to")), "callpath").when(low.rlike(ABOUT_TESTS.pattern), "tests")
        .when(F.col(column).rlike(r"[\"'][^\"']+[\"']|(^|[^\w.])\d+") & has(*VALUE_WORDS), "values").when(has("method"), "methods")
        .when(has("field", "variable", "member"), "fields").when(has(*PLACE_WORDS), "location").otherwise("name")
    )
    return questions.withColumn("intent", intent)
