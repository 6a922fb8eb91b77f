"""The whole pipeline over repositories: scan, extract, link, enumerate, validate, deduplicate, render."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import link, paths, render, report, traces, validate
from ..operators.extract import extract
from ..sources.catalog import builtin_catalog, catalog_frame
from .lineage import cut


@dataclass
class Options:
    """``direction`` backward or forward; ``max_nodes`` of a path, none by default; ``validate`` path heads;
    ``dedup`` exact, maximal or greedy; ``compat`` for the historic behaviour where it differs; ``configs`` by
    repository, ``config`` for the rest."""

    direction: str = "backward"
    max_nodes: int | None = None
    max_paths: int | None = None
    validate: bool = True
    dedup: str = "maximal"
    compat: bool = False
    catalog: dict[str, list[str]] | None = None
    config: dict | None = field(default=None)
    configs: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def generation(cls, name: str, **more) -> Options:
        """The four generations of the rules, by their names."""
        own = {
            "core1": {"direction": "forward", "max_nodes": 17, "validate": False, "catalog": builtin_catalog(first_generation=True)}, "core2": {"validate": False},
            "core3-fast": {}, "core4": {},
        }[name]
        return cls(**(own | more))


class Engine:
    """Named, lazily evaluated tables over (repo, path, lang, text) files; ``register`` makes them SQL views.

    Each repository is a graph of its own. Within the engine uids bear their repository; the tables that it gives out
    have plain uids and a column repo.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, options: Options | None = None):
        self.spark, self.files, self.options = spark, files, options or Options()

    @cached_property
    def extracted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(map(cut, extract(self.files, self.options.compat)))

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        nodes, raw, _ = self.extracted
        catalog = catalog_frame(self.spark, self.options.catalog, self.options.compat)
        return tuple(map(cut, link.link(link.qualified(nodes, "uid"), link.qualified(raw, "src"), catalog, self.options.compat)))

    @property
    def nodes(self) -> DataFrame:
        return self._graph[0].withColumn("uid", link.plain("uid"))

    @property
    def edge_sites(self) -> DataFrame:
        sites = self._graph[1]
        return sites.select(_repo("src_uid"), link.plain("src_uid").alias("src_uid"), link.plain("dst_uid").alias("dst_uid"), "file", "line")

    @cached_property
    def _edges(self) -> DataFrame:
        return cut(link.edges_of(self._graph[1]))

    @property
    def edges(self) -> DataFrame:
        return self._edges.select(_repo("src_uid"), link.plain("src_uid").alias("src_uid"), link.plain("dst_uid").alias("dst_uid"))

    @cached_property
    def _heads(self) -> DataFrame:
        """Nodes that may head a path."""
        o, nodes = self.options, self._graph[0]
        if o.direction == "forward":
            return nodes.where("is_entry OR is_source")
        if not o.validate:
            return nodes
        # the text counts only for configurations of indicators and language patterns
        if any(validate.needs_text(c) for c in (o.config, *o.configs.values())):
            whole = traces.node_code(nodes.where(validate.in_project(F.col("file"), F.col("is_builtin"))), self.files, most=1_000_000_000)
            nodes = nodes.join(whole.withColumnRenamed("code", "text"), "uid", "left")
        groups: dict[str, list[str]] = {}
        for repo, config in o.configs.items():
            groups.setdefault(json.dumps(config, sort_keys=True), []).append(repo)
        own = [validate.source_nodes(nodes.where(F.col("repo").isin(repos)), json.loads(config), o.compat) for config, repos in groups.items()]
        rest = nodes.where(~F.col("repo").isin(list(o.configs))) if o.configs else nodes
        return reduce(DataFrame.unionByName, own, validate.source_nodes(rest, o.config, o.compat))

    @property
    def heads(self) -> DataFrame:
        return self._heads.withColumn("uid", link.plain("uid"))

    @cached_property
    def _paths(self) -> DataFrame:
        o, sinks = self.options, self._graph[0].where("is_sink")
        if o.direction == "forward":
            found = paths.forward_paths(self._heads, self._edges, sinks, o.max_nodes, o.max_paths)
        else:
            found = paths.backward_paths(sinks, self._edges, self._heads if o.validate else None, o.max_nodes, o.max_paths)
        return cut(found)

    @property
    def paths(self) -> DataFrame:
        path = F.transform("path", link.plain).alias("path")
        return self._paths.select(_repo("head"), link.plain("sink").alias("sink"), link.plain("head").alias("head"), path)

    @cached_property
    def _code(self) -> DataFrame:
        nodes = self._graph[0]
        return cut(traces.node_code(nodes.where(validate.in_project(F.col("file"), F.col("is_builtin"))), self.files, self.extracted[2]))

    @property
    def code(self) -> DataFrame:
        return self._code.select(_repo("uid"), link.plain("uid").alias("uid"), "code")

    @cached_property
    def _traces(self) -> DataFrame:
        coded = traces.coded_paths(self._paths.withColumn("repo", _repo("head")), self._code, self.options.compat)
        return cut(traces.as_traces(traces.deduplicate(coded, self.options.dedup)))

    @property
    def traces(self) -> DataFrame:
        found = self._traces.withColumn("repo", _repo(F.col("path")[0]))
        return found.withColumns({c: F.transform(c, link.plain) for c in ("path", "sinks")})

    def rendered(self, form: str = "yaml", show_code: bool = True) -> DataFrame:
        rows = traces.trace_rows(self._traces, self._graph[0], self._graph[1], self._code).withColumn("sinks", F.transform("sinks", link.plain))
        return render.render(rows.withColumn("hops", F.transform("hops", lambda h: h.withField("uid", link.plain(h["uid"])))), form, show_code)

    def verdicts(self, ask=report.rule_stub, **options) -> DataFrame:
        return report.triage(self.rendered(), ask, **options)

    def register(self, prefix: str = "") -> None:
        for name in ("files", "nodes", "edges", "edge_sites", "paths", "traces"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _repo(uid) -> F.Column:
    """The repository of a uid that bears one."""
    return F.regexp_replace(link.prefix_of(uid), f"{link.MARK}$", "").alias("repo")
