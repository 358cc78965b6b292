"""Source listings, fingerprints and exclusions, as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _roots(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def listing(spark: SparkSession, paths, ext: str = ".java", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(file, size, mtime) of the files below one or more folders. A blank extension is an error; contents are not read."""
    if not ext or not ext.strip():
        raise ValueError("ext must not be blank")
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}").load(_roots(paths))
    return without(got.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")), exclude)


def texts(spark: SparkSession, paths, ext: str = ".java", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(file, text): whole files."""
    got = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}").text(_roots(paths), wholetext=True)
    return without(got.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), exclude)


def without(files: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    """Files whose path has none of the parts; asterisks of a pattern are dropped."""
    for pattern in exclude:
        part = pattern.replace("*", "")
        if part:
            files = files.where(~F.col("file").contains(part))
    return files


def standard_roots(project: str, tests: bool = True) -> list[str]:
    """The usual source folders of a project that exist; the project itself if none does."""
    wanted = ["src/main/java"] + (["src/test/java"] if tests else [])
    found = [os.path.join(project, w) for w in wanted if os.path.isdir(os.path.join(project, w))]
    return found or [project]


def source_listing(project: str, tests: bool = True) -> tuple[list[str], tuple[str, ...]]:
    """(folders, parts of paths to leave out) of a project: with tests the standard roots that exist, else the whole tree; without them the main root, else the tree less its test folders."""
    roots = standard_roots(project, tests)
    return roots, () if tests or roots != [project] else ("/test/",)


def cached_listing(cache: "ListingCache", spark: SparkSession, folder: str, ext: str = ".java", exclude: tuple[str, ...] = ()) -> DataFrame:
    """listing() of a folder, its rows kept in the cache."""
    rows = cache.get(f"{folder}/*{ext}", lambda: listing(spark, folder, ext).collect())  # one folder's names
    return without(spark.createDataFrame(list(rows), "file string, size long, mtime timestamp"), exclude)


def count(files: DataFrame) -> int:
    return files.count()


def fingerprint(files: DataFrame) -> str:
    """number:bytes:newest change of a listing, build folders left out."""
    kept = without(files, ("/target/", "/.git/", "/.cache/"))
    row = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.coalesce(F.max(F.unix_millis("mtime")), F.lit(0)).alias("m")).first()
    return f"{row.n}:{row.b}:{row.m}"


class ListingCache:
    """Listings kept for `ttl` seconds, the least recently used of more than `most` dropped."""

    def __init__(self, most: int = 100, ttl: float = 300.0, clock=None):
        import time
        from collections import OrderedDict

        if most < 1 or ttl <= 0:
            raise ValueError("most and ttl must be positive")
        self.most, self.ttl, self.clock, self.rows = most, ttl, clock or time.monotonic, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str, load):
        key = os.path.realpath(key)
        held = self.rows.get(key)
        if held and self.clock() - held[0] < self.ttl:
            self.hits += 1
            self.rows.move_to_end(key)
            return held[1]
        self.misses += 1
        value = tuple(load())
        self.rows[key] = (self.clock(), value)
        self.rows.move_to_end(key)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)
        return value

    def invalidate(self, key: str) -> None:
        self.rows.pop(os.path.realpath(key), None)

    def clear(self) -> None:
        self.rows.clear()

    @property
    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0
