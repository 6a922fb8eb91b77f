"""Readers: repositories of source files, serialised graphs, trace and report files."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as sc
from ..functions.helpers import safe_path
from .catalog import EXTENSIONS

JS_FAMILY = ("javascript", "typescript", "tsx")


def language_of(path) -> F.Column:
    """Language by the lower-cased extension; null if it has none here."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, extension)


def read_repositories(spark: SparkSession, root: str, enable_js: bool = True, exclude_dirs: tuple[str, ...] = (), git_only: bool = False) -> DataFrame:
    """(repo, path, lang, text) of all source files under the immediate, non-hidden folders of ``root``.

    Bytes that aren't UTF-8 are dropped. Languages and excluded folders are decided on paths, before any content is
    decoded; with ``git_only`` a repository needs a ``.git`` folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in sorted(EXTENSIONS)) + "}").load(root)
    base = root.rstrip("/")
    relative = F.expr(f"substring(path, instr(path, {json.dumps(base + '/')}) + {len(base) + 1})")
    files = files.withColumn("_rel", relative).withColumn("repo", F.substring_index("_rel", "/", 1)).withColumn("_path", F.expr("substring(_rel, length(repo) + 2)"))
    files = files.withColumn("lang", language_of(F.col("_path"))).where("lang IS NOT NULL AND _path <> '' AND NOT startswith(repo, '.')")
    files = without(files, () if enable_js else JS_FAMILY, exclude_dirs, "_path")
    if git_only:
        marked = spark.createDataFrame([(d,) for d in repositories(base, git_only=True)], "repo string")
        files = files.join(F.broadcast(marked), "repo", "left_semi")
    # bytes that aren't UTF-8 are dropped; a replacement character that the file itself holds stays
    raw = F.col("content").cast("string")
    text = F.coalesce(F.try_validate_utf8(raw), F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    return files.select("repo", F.col("_path").alias("path"), "lang", text.alias("text"))


def without(files: DataFrame, languages: tuple[str, ...] = (), folders: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """Files that are of none of the languages and in none of the folders."""
    if languages:
        files = files.where(~F.col("lang").isin(*languages))
    for folder in folders:
        files = files.where(~F.concat(F.lit("/"), F.col(path)).contains(f"/{folder.strip('/')}/"))
    return files


def unpack_zip(archive: str, folder: str) -> str:
    """Unpacks a repository's archive and returns the name of its top folder; members that lead out raise."""
    with zipfile.ZipFile(archive) as file:
        names = [n for n in file.namelist() if n.strip("/")]
        for name in names:
            safe_path(folder, name)
        file.extractall(folder)
    return names[0].split("/")[0] if names else ""


def repositories(root: str, git_only: bool = False) -> list[str]:
    """Names of the immediate, non-hidden folders of a local folder."""
    return sorted(d.name for d in os.scandir(root) if d.is_dir() and not d.name.startswith(".") and (not git_only or os.path.isdir(os.path.join(d.path, ".git"))))


def file_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line, code), lines from 1; only the columns needed are read."""
    return files.select("repo", "path", F.posexplode(sc.lines(F.col("text"))).alias("line", "code")).withColumn("line", F.col("line") + 1)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, raw edges) of serialised graphs in JSON, one object a file; languages follow from file names."""
    ir = spark.read.schema(schema.IR).json(path, multiLine=True)
    nodes = ir.select(F.col("repository").alias("repo"), F.posexplode("nodes").alias("ordinal", "n")).select("repo", "n.*", F.coalesce(language_of(F.col("n.file")), F.lit("unknown")).alias("lang"), F.col("ordinal").cast("long"))
    edges = ir.select(F.col("repository").alias("repo"), F.posexplode("edges").alias("ordinal", "e"))
    edges = edges.select("repo", F.col("e.src").alias("src"), F.col("e.dst").alias("callee"), F.col("e.file").alias("file"), F.col("e.line").alias("line"), F.coalesce(language_of(F.col("e.file")), F.lit("unknown")).alias("lang"), F.col("ordinal").cast("long"))
    return nodes.select(*schema.names(schema.NODES)), edges


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """(trace_id, text) of files named ``<id>_code.txt``."""
    files = spark.read.option("pathGlobFilter", "*_code.txt").text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"(\d+)_code\.txt$", 1).alias("id"), F.col("value").alias("text")).where("id <> ''").select(F.col("id").cast("long").alias("trace_id"), "text")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(trace_id, verdict fields) of files named ``<id>_report.json``."""
    files = spark.read.schema(schema.VERDICT).option("pathGlobFilter", "*_report.json").json(folder, multiLine=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"(\d+)_report\.json$", 1).cast("long").alias("trace_id"), "*")


def config_of(repo_root: str, default: str | None = None) -> dict | None:
    """The source configuration of a repository: its own ``sources.json``, else the default file, else none."""
    for path in (os.path.join(repo_root, "sources.json"), default):
        if path and os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                return json.load(file)
    return None
