"""Linking raw call edges into a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as sc
from ..plans.lineage import cut, small


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row a repository's uid: flags are OR-ed, the largest end and the smallest positive line win, the rest is the first's."""
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    flags = [F.bool_or(c).alias(c) for c in ("is_sink", "is_entry", "is_source", "is_builtin")]
    line = F.coalesce(F.min(F.when(F.col("line") > 0, F.col("line"))), F.lit(0)).alias("line")
    return nodes.groupBy("repo", "uid").agg(first("name"), first("file"), line, F.max("end_line").alias("end_line"), *flags, first("lang"), F.min("ordinal").alias("ordinal")).select(*schema.names(schema.NODES))


#: Stands between a repository and a uid of it; a uid has no slashes.
MARK = "//"


def qualified(df: DataFrame, column: str) -> DataFrame:
    """Uids that tell repositories apart: the repository, ``MARK``, the uid."""
    return df.withColumn(column, F.concat(F.col("repo"), F.lit(MARK), F.col(column)))


def prefix_of(uid) -> F.Column:
    """Repository and mark of a qualified uid; nothing for a plain one."""
    return F.regexp_extract(uid, f"^[^/]*{MARK}", 0)


def plain(uid) -> F.Column:
    """A uid without its repository."""
    return F.regexp_replace(uid, f"^[^/]*{MARK}", "")


def classify_sinks(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds is_sink: the callee, or a suffix of it after a dot, is in the catalog of the edge's language.

    The catalog is configuration of bounded size; it becomes a literal, so edges are neither shuffled nor joined.
    """
    own: dict[str, list[str]] = {}
    for row in catalog.select("lang", "sink").distinct().collect():
        own.setdefault(row["lang"], []).append(row["sink"])
    return edges.withColumn("is_sink", F.coalesce(is_sink_in(F.col("lang"), F.col("callee"), own), F.lit(False)))


def is_sink_in(lang, callee, catalog: dict[str, list[str]]):
    """The same as a Column, for a catalog given as literals: no join at all."""
    hit = F.lit(False)
    for language, sinks in catalog.items():
        own = F.arrays_overlap(sc.dotted_suffixes(callee), F.split(F.lit("\n".join(sorted(set(sinks)))), "\n"))
        hit = hit | ((lang == language) & own)
    return hit


def resolve(nodes: DataFrame, raw_edges: DataFrame, catalog: DataFrame, compat: bool = False) -> DataFrame:
    """Raw edges with callee normalised, is_sink, dst_uid and how it was found (sink, local, name or ext).

    In order: a sink; a name in the caller's own scope; the first node of that name, in the same language and
    repository; an external name. What is found and made belongs to the caller's repository; with qualified uids (see
    ``qualified``) repositories share no node. With ``compat`` the name lookup ignores languages and also sees the nodes that earlier edges
    create, and a local name counts only once it exists.
    """
    edges = classify_sinks(raw_edges.withColumn("callee", sc.normalize_callee(F.col("callee"))), catalog)
    edges = edges.withColumn("_last", sc.last_segment(F.col("callee"))).withColumn("_local", F.when(~F.col("callee").contains("."), F.concat(sc.parent_scope(F.col("src")), F.lit("."), F.col("callee"))))
    edges = edges.withColumn("_sink_uid", F.concat(prefix_of(F.col("src")), F.lit("builtin."), F.col("lang"), F.lit("."), F.col("callee"))).withColumn("_ext_uid", F.concat(prefix_of(F.col("src")), F.lit("ext."), F.col("lang"), F.lit("."), F.col("callee")))
    known = nodes.groupBy("uid").agg(F.min("ordinal").alias("_born"))
    if not compat:
        named = small(cut(nodes.groupBy("repo", "lang", "name").agg(F.min_by("uid", "ordinal").alias("_named"))))
        local = small(cut(known.select(F.col("uid").alias("_local_uid"))))
        # a callee that begins with "builtin." is the uid of a node already: string building has one for each place
        edges = edges.withColumn("_local", F.when(F.col("callee").startswith("builtin."), F.concat(prefix_of(F.col("src")), F.col("callee"))).otherwise(F.col("_local")))
        out = edges.join(local, F.col("_local") == F.col("_local_uid"), "left")
        out = out.join(named.withColumnsRenamed({"repo": "_nrepo", "lang": "_nlang", "name": "_nname"}), F.col("repo").eqNullSafe(F.col("_nrepo")) & (F.col("lang") == F.col("_nlang")) & (F.col("_last") == F.col("_nname")), "left")
    else:
        # events that bring a node into being: parsed nodes, then for edge k its caller (n + 2k) and its target (n + 2k + 1)
        last = nodes.agg(F.max("ordinal")).first()[0]
        edges = edges.withColumn("_at", F.lit(0 if last is None else last + 1) + 2 * F.col("ordinal"))
        parsed = nodes.select("repo", "uid", "name", F.col("ordinal").alias("born"))
        callers = edges.join(known, F.col("src") == F.col("uid"), "left_anti").select("repo", F.col("src").alias("uid"), sc.last_segment(F.col("src")).alias("name"), F.col("_at").alias("born"))
        sinks = edges.where("is_sink").select("repo", F.col("_sink_uid").alias("uid"), F.col("callee").alias("name"), (F.col("_at") + 1).alias("born"))
        bare = edges.where("NOT is_sink AND NOT contains(callee, '.')").select("repo", F.col("_ext_uid").alias("uid"), F.col("callee").alias("name"), (F.col("_at") + 1).alias("born"))
        lasting = parsed.unionByName(callers).unionByName(sinks)
        local = small(cut(lasting.groupBy("uid").agg(F.min("born").alias("_since")).withColumnRenamed("uid", "_local_uid")))
        named = small(cut(lasting.unionByName(bare).groupBy(F.col("repo").alias("_nrepo"), F.col("name").alias("_nname")).agg(F.min_by("uid", "born").alias("_named"), F.min("born").alias("_named_since"))))
        out = edges.join(local, (F.col("_local") == F.col("_local_uid")) & (F.col("_since") <= F.col("_at")), "left")
        out = out.join(named, F.col("repo").eqNullSafe(F.col("_nrepo")) & (F.col("_last") == F.col("_nname")) & (F.col("_named_since") <= F.col("_at") + 1), "left")
    found = F.when(F.col("is_sink"), F.lit("sink")).when(F.col("_local_uid").isNotNull(), F.lit("local")).when(F.col("_named").isNotNull(), F.lit("name")).otherwise(F.lit("ext"))
    target = F.when(F.col("is_sink"), F.col("_sink_uid")).otherwise(F.coalesce("_local_uid", "_named", "_ext_uid"))
    return out.select(*raw_edges.columns, "is_sink", target.alias("dst_uid"), found.alias("found"))


def link(nodes: DataFrame, raw_edges: DataFrame, catalog: DataFrame, compat: bool = False, skip_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all nodes, edge sites): targets and unknown callers become nodes, or edges of unknown callers are skipped."""
    resolved = resolve(nodes, raw_edges, catalog, compat)
    known = nodes.select("uid").distinct()
    if skip_unknown:
        resolved = resolved.join(known, F.col("src") == F.col("uid"), "left_semi")
    base = nodes.agg(F.max("ordinal")).first()[0] or 0
    made = lambda df, uid, name, file, sink, builtin, step: df.select("repo", uid.alias("uid"), name.alias("name"), F.lit(file).alias("file"), F.lit(0).alias("line"), F.lit(0).alias("end_line"), F.lit(sink).alias("is_sink"), F.lit(False).alias("is_entry"), F.lit(False).alias("is_source"), F.lit(builtin).alias("is_builtin"), "lang", (F.lit(base) + 1 + 2 * F.col("ordinal") + step).cast("long").alias("ordinal"))
    callers = made(resolved.join(known, F.col("src") == F.col("uid"), "left_anti"), F.col("src"), sc.last_segment(F.col("src")), "unknown", False, False, 0)
    sinks = made(resolved.where("found = 'sink'"), F.col("dst_uid"), F.col("callee"), "<builtin>", True, True, 1)
    external = made(resolved.where("found = 'ext'"), F.col("dst_uid"), F.col("callee"), "<external>", False, False, 1)
    every = merge_nodes(nodes.select(*schema.names(schema.NODES)).unionByName(callers).unionByName(sinks).unionByName(external))
    return every, resolved.select(F.col("src").alias("src_uid"), "dst_uid", "file", "line")


def edges_of(edge_sites: DataFrame) -> DataFrame:
    return edge_sites.select("src_uid", "dst_uid").distinct()


def sites_by_edge(edge_sites: DataFrame) -> DataFrame:
    """Call-sites of each edge, as often as they occur."""
    return edge_sites.groupBy("src_uid", "dst_uid").agg(F.count("*").alias("n_sites"), F.countDistinct("file", "line").alias("n_distinct"))


def sink_summary(nodes: DataFrame, edge_sites: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` sinks by call-sites; ties by uid."""
    sinks = nodes.where("is_sink").select(F.col("uid").alias("dst_uid"), "name")
    return edge_sites.join(sinks, "dst_uid").groupBy("dst_uid", "name").agg(F.count("*").alias("n_sites")).orderBy(F.desc("n_sites"), "dst_uid").limit(top)


def totals(nodes: DataFrame) -> DataFrame:
    counted = lambda c, to: F.count_if(F.col(c)).alias(to)
    return nodes.agg(F.count("*").alias("n_nodes"), counted("is_source", "n_sources"), counted("is_sink", "n_sinks"), counted("is_entry", "n_entries"))


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    calls = edges.groupBy(F.col("src_uid").alias("uid")).agg(F.count("*").alias("n"))
    return nodes.select("uid", "name").join(calls, "uid", "left").select("uid", "name", F.coalesce("n", F.lit(0)).alias("n_calls"))


def sinks_by_language(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_sink").groupBy("name", "lang").agg(F.count("*").alias("n"))


def direct_callers(nodes: DataFrame, edges: DataFrame, sink_name: str) -> DataFrame:
    named = nodes.where((F.col("name") == sink_name) & F.col("is_sink")).select(F.col("uid").alias("dst_uid"))
    return edges.join(named, "dst_uid").select("src_uid", "dst_uid").distinct()


def orphan_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sinks that a source calls directly: the first such caller of each."""
    sources = nodes.where("is_source").select(F.col("uid").alias("src_uid"))
    sinks = nodes.where("is_sink").select(F.col("uid").alias("dst_uid"))
    return edges.join(sources, "src_uid").join(sinks, "dst_uid").groupBy("dst_uid").agg(F.min("src_uid").alias("src_uid"))


def uncalled_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.where("is_sink").join(edges, F.col("uid") == F.col("dst_uid"), "left_anti").select("uid", "name")


def numbered(df: DataFrame, *order: str, name: str = "trace_id") -> DataFrame:
    """Sequence numbers from 1 in a total order: ranges are sorted apart, and each continues where the last ended.

    One shuffle. The sizes of the ranges, as many as there are partitions, go to the driver.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_no": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_no").alias("first")).collect()
    before, offset = 1, F.lit(0)
    for row in sorted(counts):
        offset = F.when(F.col("_part") == row["_part"], F.lit(before - row["first"])).otherwise(offset)
        before += row["n"]
    return ranged.withColumn(name, (F.col("_no") + offset).cast("long")).drop("_part", "_no")
