"""Written trace documents: read back, merged where they show the same code, written again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how a comment begins that tells the lines shown; it isn't code.
LINES_MARK = "# Lines"


def calls_of(node) -> list[dict]:
    return [c for c in (node.get("calls") or []) if isinstance(c, dict)]


def is_sink(node: dict) -> bool:
    return "SINK" in (node.get("tags") or [])


def functions(node: dict) -> Iterator[dict]:
    """The functions of a document from its root down, sinks and what they call left out."""
    todo = [node]
    while todo:
        x = todo.pop()
        if not is_sink(x):
            yield x
            todo += reversed(calls_of(x))


def sink_and_caller(node: dict) -> tuple[dict | None, dict | None]:
    """The first sink in the document's order, and the function that calls it."""
    todo = [(node, None)]
    while todo:
        x, caller = todo.pop()
        if is_sink(x):
            return x, caller
        todo += [(c, x) for c in reversed(calls_of(x))]
    return None, None


def code_hash(root: dict) -> str | None:
    """md5 over the functions' names and codes, sorted; null if none has code."""
    coded = []
    for x in functions(root):
        code = "\n".join(line for line in str(x.get("code") or "").split("\n") if not line.strip().startswith(LINES_MARK))
        if code.strip():
            coded.append(f"{x.get('function') or ''}:{code}")
    return hashlib.md5("\n---\n".join(sorted(coded)).encode("utf-8", "surrogatepass")).hexdigest() if coded else None


def root_of(text: str | None) -> dict | None:
    """The outermost function of a document; null if it isn't one."""
    import yaml

    try:
        parsed = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return None
    return parsed[0] if isinstance(parsed, list) and parsed and isinstance(parsed[0], dict) else None


def parse_documents(documents: DataFrame) -> DataFrame:
    """(trace_id, path, code_hash, sink, text) of (trace_id, text); ``sink`` is JSON, documents that can't be read are dropped."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                root = root_of(text)
                if root is not None:
                    sink = sink_and_caller(root)[0]
                    rows.append((batch.column(0)[k].as_py(), [str(x.get("function") or "") for x in functions(root)], code_hash(root), None if sink is None else json.dumps(sink, ensure_ascii=False), text))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["trace_id", "path", "code_hash", "sink", "text"])

    return documents.select(F.col("trace_id").cast("long").alias("trace_id"), "text").mapInArrow(run, "trace_id long, path array<string>, code_hash string, sink string, text string")


def with_sinks(text: str, sinks: list[str]) -> str:
    """The document with all the sinks under the function that calls its first."""
    import yaml

    root = root_of(text)
    caller = sink_and_caller(root)[1]
    if caller is not None and len(sinks) > 1:
        caller["calls"] = [c for c in calls_of(caller) if not is_sink(c)] + [json.loads(s) for s in sinks]
    return yaml.dump([root], default_flow_style=False, allow_unicode=True, sort_keys=False)


def merge_documents(documents: DataFrame) -> DataFrame:
    """(trace_id, text, n_merged): documents of one code merge into that of the smallest id, with the sinks of all.

    A sink that several documents share stands once. Documents without code are dropped. What travels to be merged is
    the sinks and the first document of each code.
    """
    parsed = parse_documents(documents).where("code_hash IS NOT NULL")
    sinks = F.transform(F.array_sort(F.collect_list(F.when(F.col("sink").isNotNull(), F.struct("trace_id", "sink")))), lambda s: s["sink"])
    merged = parsed.groupBy("code_hash").agg(F.min("trace_id").alias("trace_id"), F.min_by("text", "trace_id").alias("text"), F.array_distinct(sinks).alias("sinks"), F.count("*").alias("n_merged"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [with_sinks(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("sinks").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("trace_id"), pa.array(texts, pa.string()), batch.column("n_merged")], names=["trace_id", "text", "n_merged"])

    return merged.select("trace_id", "text", "sinks", "n_merged").mapInArrow(run, "trace_id long, text string, n_merged long")
