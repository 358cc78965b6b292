"""Sources of traces and logs: JSON lines, JSON arrays and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.schema import ASK_LOG


def json_lines(spark: SparkSession, paths, schema: str, limit: int | None = None) -> DataFrame:
    """Rows of JSON lines; blank, malformed and pointer lines are skipped."""
    lines = spark.read.text(paths).where("trim(value) <> '' and not startswith(value, 'version https://')")
    got = lines.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")
    return got if limit is None else got.limit(limit)


def ask_log(spark: SparkSession, paths) -> DataFrame:
    return json_lines(spark, paths, ASK_LOG)


def chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON arrays, of a repeated id the first by content; rows without an id all stay."""
    got = spark.read.schema(schema).json(path, multiLine=True)
    whole = F.struct(*got.columns)
    first = got.where("id is not null").groupBy("id").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    return first.unionByName(got.where("id is null"))


def tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the bytes and success of the result that carries their id."""
    r = results.select(F.col("tool_call_id").alias("id"), F.octet_length("content").alias("result_bytes"), "ok")
    return calls.join(r, "id", "left")


def usage_journal(spark: SparkSession, path: str) -> DataFrame:
    """(child, call, input_tokens, cached_input_tokens, output_tokens) from nested journal lines."""
    usage = "struct<input_tokens:long,cached_input_tokens:long,output_tokens:long>"
    got = json_lines(spark, path, f"child string, seq long, payload struct<result:struct<result:struct<usage:{usage}>>>")
    u = got.select("child", F.col("seq").alias("call"), F.col("payload.result.result.usage").alias("u")).where("u is not null")
    return u.select("child", "call", "u.*")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Parquet trajectories; of those with one hash the one with most messages, on ties the first task by name."""
    got = spark.read.parquet(path)
    best = got.groupBy("source_trajectory_sha256").agg(F.max_by(F.struct(*got.columns), F.struct("n_messages", F.xxhash64("task"))).alias("b"))
    return best.select("b.*")
