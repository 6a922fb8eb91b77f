"""Queries over files: listing, reading and searching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..sources.scan import file_lines


def list_dir(files: DataFrame, most: int = 80) -> DataFrame:
    """(dir, n, names): the names in each folder, sorted, the first ``most`` of them, joined by commas."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit("."))
    named = files.select(folder.alias("dir"), F.substring_index("path", "/", -1).alias("name")).distinct()
    return named.groupBy("dir").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_list("name")), 1, most), ", ").alias("names"))


def read_lines(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` of a file, from 1, inclusive, clamped; the path is filtered before lines are made."""
    own = files.where(F.col("path") == path)
    return file_lines(own).where(F.col("line").between(max(1, first), last)).select("path", "line", "code")


def grep(files: DataFrame, pattern: str, most: int | None = None, width: int = 120) -> DataFrame:
    """(path, line, code) of lines in which the pattern is found, in any case; lines trimmed and cut to ``width``."""
    rx = f"(?i){pattern}"
    hits = file_lines(files.where(F.col("text").rlike(rx))).where(F.col("code").rlike(rx))
    hits = hits.select("path", "line", F.left(F.trim("code"), F.lit(width)).alias("code"))
    return hits if most is None else hits.orderBy("path", "line").limit(most)


def grep_names(files: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    hits = files.where(F.substring_index("path", "/", -1).rlike(f"(?i){pattern}")).select("path")
    return hits if most is None else hits.orderBy("path").limit(most)


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("n_files"))


def file_info(files: DataFrame) -> DataFrame:
    """(path, lang, n_chars, n_lines, is_empty)."""
    return files.select("path", "lang", F.length("text").cast("long").alias("n_chars"), F.size(sc.lines(F.col("text"))).cast("long").alias("n_lines"), (F.length("text") == 0).alias("is_empty"))
