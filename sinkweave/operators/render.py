"""Rendering traces and graphs as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traces import lines_of

QUOTED = set("[]:\"'&*?|-<>=!%@`#{},")


def quoted(text: str) -> str:
    """A YAML scalar: plain where that is safe, else double-quoted with valid escapes."""
    return json.dumps(text, ensure_ascii=False) if not text or text != text.strip() or QUOTED & set(text) else text


def yaml_trace(hops: list, sinks: list | None = None, show_code: bool = True) -> str:
    """A trace as nested YAML: function, location, tags, code, callsites, calls; several sinks fan out at the last hop."""
    out: list[str] = []
    fresh = dict(lines_of(hops)) if show_code else {}
    for depth, h in enumerate(hops):
        pad = "  " * (2 * depth)
        out += [f"{pad}- function: {quoted(h['label'] or h['uid'])}", f"{pad}  location: {quoted(h['location'] or '<unknown source>')}"]
        tags = [t for t, on in (("SOURCE", h["is_source"]), ("SINK", h["is_sink"])) if on]
        if tags:
            out.append(f"{pad}  tags: [{', '.join(tags)}]")
        if code := fresh.get(h["hop"]):
            out += [f"{pad}  code: |2", *[f"{pad}    {line}" for line in code]]
        if depth + 1 < len(hops):
            if h["sites"]:
                out += [f"{pad}  callsites:", *[f"{pad}    - {quoted(s)}" for s in h["sites"]]]
            out.append(f"{pad}  calls:")
            if depth + 2 == len(hops) and sinks and len(sinks) > 1:
                for s in sorted(sinks):
                    out += [f"{pad}    - function: {quoted(s.rsplit('.', 1)[-1] + ' [SINK]')}", f"{pad}      location: {quoted('<builtin>')}", f"{pad}      tags: [SINK]"]
                break
    return "\n".join(out) + "\n"


def flat_trace(hops: list, show_code: bool = True) -> str:
    """A trace as plain text: its path on one line, then each function with location, code and call-sites."""
    out = ["[PATH] " + " -> ".join(h["label"] or h["uid"] for h in hops)]
    for h in hops:
        out += ["", f"{h['label'] or h['uid']} ({h['location']})"]
        if show_code and h["code"]:
            out += ["```", h["code"], "```"]
        out += [f"  callsite: {s}" for s in h["sites"] or ()]
    return "\n".join(out) + "\n"


def render(rows: DataFrame, form: str = "yaml", show_code: bool = True) -> DataFrame:
    """(trace_id, text) of ``trace_rows``; text is made where the rows are, a batch at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column("trace_id"), []
            for hops, sinks in zip(batch.column("hops").to_pylist(), batch.column("sinks").to_pylist()):
                texts.append(yaml_trace(hops, sinks, show_code) if form == "yaml" else flat_trace(hops, show_code))
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["trace_id", "text"])

    return rows.mapInArrow(run, "trace_id long, text string")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, line) of a DOT graph: nodes coloured by their part, builtins that are no sinks left out, red edges to sinks."""
    shown = nodes.where("NOT is_builtin OR is_sink").select("uid", "name", "is_sink", "is_source")
    colour = F.when(F.col("is_sink"), "red").when(F.col("is_source"), "green").otherwise("lightblue")
    text = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    one = shown.select(F.lit("node").alias("kind"), F.concat(text(F.col("uid")), F.lit(" [label="), text(F.col("name")), F.lit(", color="), colour, F.lit("]")).alias("line"))
    ends = edges.join(shown.select(F.col("uid").alias("src_uid")), "src_uid").join(shown.select(F.col("uid").alias("dst_uid"), F.col("is_sink").alias("_red")), "dst_uid")
    two = ends.select(F.lit("edge").alias("kind"), F.concat(text(F.col("src_uid")), F.lit(" -> "), text(F.col("dst_uid")), F.when(F.col("_red"), F.lit(" [color=red]")).otherwise(F.lit(""))).alias("line"))
    return one.unionByName(two)


def network_attributes(nodes: DataFrame, calls: DataFrame, level: DataFrame) -> DataFrame:
    """(uid, label, level, colour, size, y) for a network view; calls are (uid, n_calls), level (uid, level)."""
    joined = nodes.select("uid", "name", "is_sink", "is_source", "is_entry").join(calls.select("uid", "n_calls"), "uid", "left").join(level, "uid", "left")
    colour = F.when(F.col("is_sink"), "red").when(F.col("is_entry"), "orange").when(F.col("is_source"), "green").otherwise("lightblue")
    return joined.select("uid", F.col("name").alias("label"), F.coalesce("level", F.lit(0)).alias("level"), colour.alias("colour"), F.least(F.lit(50), 20 + 3 * F.coalesce("n_calls", F.lit(0))).cast("long").alias("size"), (150 * F.coalesce("level", F.lit(0))).cast("long").alias("y"))
