"""Traces: code along a path, hashes, three ways of deduplication, hops and their call-sites."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..plans.lineage import small
from .link import numbered

MODES = ("exact", "maximal", "greedy")


def node_code(nodes: DataFrame, files: DataFrame, classes: DataFrame | None = None, most: int = sc.SNIPPET_LINES) -> DataFrame:
    """(uid, code): the lines of each node's span; of its class's span, for methods, if classes are given.

    Files of one path are told apart by their repositories where the nodes name theirs.
    """
    own = ["repo"] if "repo" in nodes.columns and "repo" in files.columns else []
    same = F.col("repo").eqNullSafe(F.col("_repo")) if own else F.lit(True)
    spans = nodes.where("line > 0").select(*own, "uid", "file", "line", "end_line")
    if classes is not None:
        parts = F.split("uid", r"\.")
        spans = spans.withColumn("_class", F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-2))))
        whole = classes.groupBy(*([F.col("repo").alias("_repo")] if own else []), F.col("file").alias("_file"), F.col("name").alias("_name")).agg(F.min(F.struct("line", "end_line")).alias("_span"))
        spans = spans.join(whole, same & (F.col("file") == F.col("_file")) & (F.col("_class") == F.col("_name")), "left")
        spans = spans.select(*own, "uid", "file", F.coalesce("_span.line", "line").alias("line"), F.coalesce("_span.end_line", "end_line").alias("end_line"))
    texts = files.select(*([F.col("repo").alias("_repo")] if own else []), F.col("path").alias("_file"), "text")
    return spans.join(texts, same & (F.col("file") == F.col("_file"))).select("uid", sc.snippet(F.col("text"), F.col("line"), F.col("end_line"), most).alias("code"))


def first_shown(spans: DataFrame) -> DataFrame:
    """Of (trace_id, hop, file, line, end_line): the lines that no earlier hop of the trace shows, (..., shown, gap).

    ``gap`` marks a line whose predecessor in the hop isn't the line before.
    """
    each = spans.select("trace_id", "hop", "file", F.explode(F.sequence("line", "end_line")).alias("shown"))
    once = each.groupBy("trace_id", "file", "shown").agg(F.min("hop").alias("hop"))
    before = F.lag("shown").over(Window.partitionBy("trace_id", "hop", "file").orderBy("shown"))
    return once.select("trace_id", "hop", "file", "shown", F.coalesce(F.col("shown") - before > 1, F.lit(False)).alias("gap"))


def hops(traces: DataFrame) -> DataFrame:
    """(trace_id, hop, uid, next_uid) of every node of a path, from 0; the last has no next."""
    each = traces.select("trace_id", "path", F.posexplode("path").alias("hop", "uid"))
    return each.select("trace_id", "hop", "uid", F.try_element_at("path", F.col("hop") + 2).alias("next_uid"))


def hop_callsites(traces: DataFrame, edge_sites: DataFrame, most: int = 10) -> DataFrame:
    """Distinct call-sites of each hop, the first ``most`` by file and line: (trace_id, hop, src_uid, dst_uid, file, line)."""
    pairs = hops(traces).where("next_uid IS NOT NULL").select("trace_id", "hop", F.col("uid").alias("src_uid"), F.col("next_uid").alias("dst_uid"))
    sites = edge_sites.select("src_uid", "dst_uid", "file", "line").distinct()
    rank = F.row_number().over(Window.partitionBy("src_uid", "dst_uid").orderBy("file", "line"))
    sites = sites.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    return pairs.join(sites, ["src_uid", "dst_uid"]).select("trace_id", "hop", "src_uid", "dst_uid", "file", "line")


def coded_paths(paths: DataFrame, code: DataFrame, compat: bool = False) -> DataFrame:
    """Adds code_hash and functions (set of per-function hashes) over all nodes of the path but the last.

    Paths without any code have a null hash and are never merged; with ``compat`` they share the empty text's.
    """
    keyed = paths.withColumn("_key", F.xxhash64("path"))
    each = keyed.select("_key", "path").dropDuplicates(["path"]).select("_key", "path", F.explode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).alias("uid"))
    filled = each.join(code, "uid", "left").groupBy("path").agg(F.collect_list(F.struct("uid", "code")).alias("_coded"))
    made = filled.select("path", sc.path_code_hash(F.col("_coded")).alias("code_hash"), sc.function_hashes(F.col("_coded")).alias("functions"))
    if compat:
        made = made.withColumn("code_hash", F.coalesce("code_hash", F.md5(F.lit(""))))
    return paths.join(made, "path", "left")


def _exact(coded: DataFrame) -> DataFrame:
    """One row a hash: the longest path, then the first in order; all sinks; how many paths it stands for."""
    own = coded.withColumn("code_hash", F.coalesce("code_hash", F.concat(F.lit("path:"), F.array_join("path", ">"))))
    best = F.min(F.struct((-F.size("path")).alias("n"), F.col("path").alias("path"), F.col("functions").alias("functions")))
    grouped = own.groupBy("code_hash").agg(best.alias("best"), F.array_sort(F.collect_set("sink")).alias("sinks"), F.count("*").alias("n_merged"))
    return grouped.select(F.when(~F.col("code_hash").startswith("path:"), F.col("code_hash")).alias("code_hash"), "best.path", "best.functions", "sinks", "n_merged")


def contained(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(inner, outer) of sets of which one is strictly contained in the other.

    Sets meet in an inverted index; the inner one is contained if all its items are met. Each inner set is looked up
    by its rarest item only, and what it meets there is compared whole, so a common item doesn't pair all its sets.
    """
    each = sets.select(F.col(key).alias("_key"), F.size(items).alias("_n"), F.explode(items).alias("_item"))
    often = each.groupBy("_item").agg(F.count("*").alias("_often"))
    probe = each.join(often, "_item").groupBy("_key").agg(F.min(F.struct("_often", "_item")).alias("_rare")).select(F.col("_key").alias("inner"), F.col("_rare._item").alias("_item"))
    whole = sets.select(F.col(key).alias("_key"), F.col(items).alias("_items"))
    met = probe.join(each.select(F.col("_key").alias("outer"), "_item"), "_item").where("inner <> outer").select("inner", "outer")
    met = met.join(whole.select(F.col("_key").alias("inner"), F.col("_items").alias("_small")), "inner").join(whole.select(F.col("_key").alias("outer"), F.col("_items").alias("_large")), "outer")
    return met.where((F.size("_small") < F.size("_large")) & (F.size(F.array_except("_small", "_large")) == 0)).select("inner", "outer")


def _maximal(exact: DataFrame) -> DataFrame:
    """Without traces whose functions are strictly contained in another's; their sinks go to all that contain them."""
    keyed = exact.withColumn("_id", F.coalesce("code_hash", F.concat(F.lit("path:"), F.array_join("path", ">"))))
    pairs = contained(keyed.where("code_hash IS NOT NULL"), "_id", "functions")
    gone = pairs.select(F.col("inner").alias("_id")).distinct()
    more = pairs.join(keyed.select(F.col("_id").alias("inner"), F.col("sinks").alias("_s")), "inner").groupBy(F.col("outer").alias("_id")).agg(F.array_distinct(F.flatten(F.collect_list("_s"))).alias("_more"))
    kept = keyed.join(gone, "_id", "left_anti").join(more, "_id", "left")
    return kept.withColumn("sinks", F.array_sort(F.array_union("sinks", F.coalesce("_more", F.array().cast("array<string>"))))).drop("_id", "_more")


def _greedy(coded: DataFrame) -> DataFrame:
    """One after another in canonical order, as a sequential run would merge; a repository is one group."""
    repo = F.col("repo") if "repo" in coded.columns else F.lit("")

    def run(group):
        import pandas as pd

        group = group.assign(_path=[">".join(p) for p in group["path"]], _n=[len(p) for p in group["path"]]).sort_values(["sink", "_n", "_path"])
        kept: list[dict] = []
        by_hash: dict[str, dict] = {}
        for row in group.itertuples():
            functions, path = set(row.functions if row.functions is not None else ()), list(row.path)
            hit = by_hash.get(row.code_hash) if row.code_hash else None
            if hit is None and functions:
                hit = next((t for t in kept if len(t["path"]) < len(path) and t["functions"] and t["functions"] <= functions), None)
            if hit is None:
                hit = {"code_hash": row.code_hash, "path": path, "functions": functions, "sinks": set(), "n_merged": 0}
                kept.append(hit)
            elif len(path) > len(hit["path"]):
                hit["path"], hit["functions"] = path, functions
            hit["sinks"].add(row.sink)
            hit["n_merged"] += 1
            if row.code_hash:
                by_hash[row.code_hash] = hit
        return pd.DataFrame([t | {"functions": sorted(t["functions"]), "sinks": sorted(t["sinks"])} for t in kept], columns=["code_hash", "path", "functions", "sinks", "n_merged"])

    grouped = coded.withColumn("_repo", repo).groupBy("_repo")
    return grouped.applyInPandas(run, "code_hash string, path array<string>, functions array<string>, sinks array<string>, n_merged long")


def deduplicate(coded: DataFrame, mode: str = "maximal") -> DataFrame:
    """(code_hash, path, functions, sinks, n_merged) of (sink, path, code_hash, functions).

    ``exact`` merges equal hashes; ``maximal`` also drops traces contained in another, whatever the order;
    ``greedy`` merges one after another in the order of sink, length and path, in one task a repository.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode == "greedy":
        return _greedy(coded)
    exact = _exact(coded)
    return exact if mode == "exact" else _maximal(exact)


def as_traces(deduplicated: DataFrame) -> DataFrame:
    """Numbered traces, in the order of their first sink, length and path."""
    keyed = deduplicated.withColumn("_sink", F.try_element_at("sinks", F.lit(1))).withColumn("_n", F.size("path")).withColumn("_path", F.array_join("path", ">"))
    return numbered(keyed, "_sink", "_n", "_path").select("trace_id", "path", "sinks", "code_hash")


def merge_by_hash(traces: DataFrame) -> DataFrame:
    """Offline: traces (trace_id, code_hash, sinks) of one hash merge under the first id; codeless ones are dropped."""
    each = traces.where("code_hash IS NOT NULL").select("trace_id", "code_hash", F.explode("sinks").alias("sink"))
    return each.groupBy("code_hash").agg(F.min("trace_id").alias("trace_id"), F.array_sort(F.collect_set("sink")).alias("sinks"), F.countDistinct("trace_id").alias("n_merged"))


def merge_counters(merged: DataFrame) -> DataFrame:
    return merged.agg(F.coalesce(F.sum(F.col("n_merged") - 1), F.lit(0)).alias("n_merged"), F.count("*").alias("n_saved"))


def merge_code(one: F.Column, two: F.Column) -> F.Column:
    """Union of two uid-to-code maps; the first wins."""
    return F.map_concat(F.map_filter(two, lambda k, v: ~F.map_contains_key(one, k)), one)


def trace_rows(traces: DataFrame, nodes: DataFrame, edge_sites: DataFrame, code: DataFrame | None = None, most_sites: int = 10) -> DataFrame:
    """What rendering needs, one row a trace: its hops with labels, locations, code and call-sites, in order."""
    each = hops(traces).join(small(nodes.select("uid", "name", "file", "line", "end_line", "is_source", "is_sink", "is_builtin")), "uid", "left")
    if code is not None:
        each = each.join(code, "uid", "left")
    else:
        each = each.withColumn("code", F.lit(None).cast("string"))
    sites = hop_callsites(traces, edge_sites, most_sites).groupBy("trace_id", "hop").agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("_sites"))
    each = each.join(sites, ["trace_id", "hop"], "left")
    row = F.struct("hop", "uid", sc.label(F.col("name"), F.col("is_source"), F.col("is_sink")).alias("label"), sc.location(F.col("file"), F.col("line"), F.col("end_line"), F.col("is_builtin")).alias("location"), "is_source", "is_sink", "file", "line", "end_line", "code", F.transform("_sites", lambda s: F.concat_ws(":", s["file"], s["line"].cast("string"))).alias("sites"))
    return each.groupBy("trace_id").agg(F.array_sort(F.collect_list(row)).alias("hops")).join(traces.select("trace_id", "sinks"), "trace_id")


def lines_of(rows: list) -> Iterator[tuple[int, list[str]]]:
    """(hop, lines that no earlier hop has shown) of a trace's hops; a blank line marks a gap."""
    shown: set = set()
    for h in rows:
        out, last = [], None
        for k, text in enumerate((h["code"] or "").split("\n") if h["code"] else []):
            at = (h["file"], h["line"] + k)
            if at not in shown:
                if last is not None and at[1] != last + 1:
                    out.append("")
                out.append(text)
                shown.add(at)
                last = at[1]
        yield h["hop"], out
