"""Writers: traces, reports, graphs, messages."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_traces(traces: DataFrame, folder: str) -> None:
    """Traces as Parquet, by repository where they have one."""
    writer = traces.write.mode("overwrite")
    (writer.partitionBy("repo") if "repo" in traces.columns else writer).parquet(folder)


def export_texts(rendered: DataFrame, folder: str, suffix: str = "_code.txt") -> None:
    """One text file a trace, ``<id><suffix>``, in a folder that all executors share; written where the rows are."""

    def write(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            with open(os.path.join(folder, f"{row['trace_id']}{suffix}"), "w", encoding="utf-8") as file:
                file.write(row["text"])

    rendered.select("trace_id", "text").foreachPartition(write)


def write_reports(reports: DataFrame, folder: str) -> None:
    reports.write.mode("overwrite").json(folder)


def write_graph(nodes: DataFrame, edge_sites: DataFrame, folder: str, clear: bool = True) -> None:
    """Node and edge tables: one row a node, one row an edge with its distinct call-sites."""
    mode = "overwrite" if clear else "append"
    nodes.dropDuplicates(["uid"]).write.mode(mode).parquet(f"{folder}/nodes")
    sites = F.array_sort(F.collect_set(F.concat_ws(":", "file", "line")))
    edge_sites.groupBy("src_uid", "dst_uid").agg(sites.alias("callsites")).write.mode(mode).parquet(f"{folder}/calls")


def write_ir(nodes: DataFrame, raw_edges: DataFrame, folder: str) -> None:
    """The seam between extraction and linking."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    raw_edges.write.mode("overwrite").parquet(f"{folder}/raw_edges")


def append_messages(messages: DataFrame, folder: str) -> None:
    """Status messages to an append-only table."""
    messages.write.mode("append").json(folder)
