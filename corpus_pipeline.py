"""A corpus pipeline over `documents`: toxicity, near-duplicates, decontamination, personal data, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of `documents`. Each
works on all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import small_batches, stored, table, trimmed
from strataloom.llm.decontam import find_overlaps
from strataloom.llm.packing import pack_documents, vocabulary
from strataloom.llm.pii import KINDS, scan_and_find
from strataloom.llm.simhash import near_duplicate_groups
from strataloom.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _light(stage: Callable) -> Callable:
    """stage; before it, the driver gives back the native memory that the stages before it left behind."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trimmed(spark)
        return stage(spark, docs, sf_dir)

    return run


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with rid, a number for each row that stays the same when tasks run again."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("rid")), name)


@_light
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. Null texts stay."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(*COLUMNS), model, COLUMNS).where(F.col("tox_score") < 0.5).drop("tox_score")


@_light
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity of about 0.8 or more): the one with the least doc_id.

    Texts without words count as copies of one another.
    """
    rows = _numbered(docs, "dedup")
    groups = near_duplicate_groups(rows, key="rid")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")
    groups = stored(groups, "near-groups")
    several = groups.groupBy("group_id").agg(F.min(order).alias("b"), F.count("*").alias("n")).where("n > 1").select("group_id", F.col("b.row_id").alias("best"))
    several = stored(several, "several")  # apart from the join, which adaptive execution may then split at a large group
    gone = stored(groups.join(several, "group_id").where("row_id <> best").select(F.col("row_id").alias("rid")), "gone")  # only copies are matched with the texts
    return rows.join(gone, "rid", "left_anti").select(*COLUMNS)


@_light
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage was found."""
    return find_overlaps(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where(F.size("items") == 0).select(*COLUMNS)


@_light
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in angle brackets; n_chars follows the text."""
    found = scan_and_find(docs.select(*COLUMNS), keep=COLUMNS)
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    # spans may overlap: each starts no earlier than all before it end
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def step(a, x):
        cut = F.substring(text, a["at"] + 1, F.greatest(F.lit(0), x["s"] - a["at"]))
        fresh = F.when(x["s"] >= a["at"], F.get(names, x["k"])).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], cut, fresh).alias("out"))

    masked = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    masked = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    return found.select("doc_id", masked.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_light
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models, fingerprints and token ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result written as Parquet and read again."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
