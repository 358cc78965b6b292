"""Column functions over identifiers: ids, name parts, tokens, segments and stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: ids, postings and answers depend on them exactly ---------------------------
PREFIXES = {"PACKAGE": "pkg", "CLASS": "cls", "INTERFACE": "cls", "METHOD": "mth", "FIELD": "fld", "PARAMETER": "par", "VARIABLE": "var"}
#: Words that are never indexed.
STOP_WORDS = tuple(
    "a an the and or but in on at to for of with by is are was were be been being have has had do does did will would should could may might "
    "as if then else when where how which what who whom this that these those i you he she it we they my your his her its our their".split()
)
#: Where a token ends: before an upper-case letter after a lower-case one, before the last capital of a run, between digits and letters.
_BOUNDARY = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|[._-]|\s+"
SUFFIXES = ("ation", "ion", "ing", "ed", "es", "s")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def declaration_id(kind: str, qualified_name) -> Column:
    """Prefix and qualified name with slashes; null for blank names."""
    q = col(qualified_name)
    return F.when(F.length(F.trim(q)) > 0, F.concat(F.lit(PREFIXES[kind] + ":"), F.translate(q, ".", "/")))


def parameter_id(method_key, position) -> Column:
    return F.concat(F.lit("par:"), F.translate(col(method_key), ".", "/"), F.lit(":"), col(position).cast("string"))


def file_key(file) -> Column:
    return F.translate(col(file), "/\\: ", "____")


def variable_id(file, method, name) -> Column:
    return F.concat(F.lit("var:"), file_key(file), F.lit(":"), col(method), F.lit(":"), col(name))


def simple_name(q) -> Column:
    """Text after the last dot."""
    return F.substring_index(col(q), ".", -1)


def qualifier(q) -> Column:
    """Text before the last dot; null where there is none."""
    return F.when(F.contains(col(q), F.lit(".")), F.regexp_extract(col(q), r"^(.*)\.", 1))


def strip_type(t) -> Column:
    """A type as written without type arguments (two levels), arrays and varargs."""
    once = F.regexp_replace(col(t), "<[^<>]*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(once, "<[^<>]*>", ""), r"\[\]|\.\.\.", ""))


def tokens(text) -> Column:
    """Distinct tokens of a text, case kept, punctuation trimmed off both ends."""
    parts = F.transform(F.split(col(text), _BOUNDARY), lambda x: F.regexp_replace(x, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def whole_token(text) -> Column:
    """A text without white space is a token as it is, its ends trimmed; else null."""
    trimmed = F.regexp_replace(col(text), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    return F.when(~col(text).rlike(r"\s") & (trimmed != ""), trimmed)


def segments(name) -> Column:
    """Lower-case camel humps and parts between underscores and dollars."""
    parts = F.split(F.translate(col(name), "_$", "  "), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|\s+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(x))


def stem(word) -> Column:
    """The word less the first fitting suffix that leaves at least three letters."""
    w = F.lower(col(word))
    out = w
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= 3), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def is_test_class(file, name) -> Column:
    """By path and name; a class under src/main is never a test."""
    f, n = F.coalesce(col(file), F.lit("")), F.coalesce(col(name), F.lit(""))
    return (
        F.when(F.contains(f, F.lit("/src/main/")) | F.startswith(f, F.lit("src/main/")), False)
        .when(n.rlike("(Test|Tests|IT|TestCase)$") | F.startswith(n, F.lit("Test")), True)
        .otherwise(F.contains(f, F.lit("/test/")) | F.contains(f, F.lit("/internalClusterTest/")))
    )
