"""Triage of traces and reports on the verdicts."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..schema import VERDICT, names

DEFAULT_VERDICT = {"vulnerability": False, "confidence": "Low", "reasoning": "", "exploit": ""}


def backoff(tries: int, base: float = 1.0, cap: float = 60.0, jitter: float = 0.0) -> float:
    """Seconds to wait before the next try: doubled each time, capped."""
    return min(cap, base * 2**tries + jitter)


def rule_stub(text: str) -> dict:
    """A deterministic stand-in for a model: traces from a source to a sink are vulnerable."""
    hit = "SOURCE" in text and "SINK" in text
    return DEFAULT_VERDICT | ({"vulnerability": True, "confidence": "Medium", "reasoning": "A source reaches a sink."} if hit else {})


def asked(ask: Callable[[str], dict], text: str, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A verdict, asked again on errors; the default verdict with the last error if none comes."""
    error = ""
    for k in range(retries):
        try:
            return {**DEFAULT_VERDICT, "error": None, **ask(text)}
        except Exception as e:  # whatever a service may raise
            error = f"{type(e).__name__}: {e}"
            if k + 1 < retries:
                sleep(backoff(k, jitter=random.random() if "429" in error else 0.0))
    return DEFAULT_VERDICT | {"error": error}


def json_client(send: Callable[[str, str], str], system: str = "", template: str = "Trace:\nTRACE", tries: int = 3) -> Callable[[str], dict]:
    """What ``triage`` asks, made of ``send(system prompt, prompt) -> answer``: an answer that isn't a JSON object is
    asked for again, with a note, ``tries`` times in all; then the default verdict says so."""

    def ask(text: str) -> dict:
        prompt = template.replace("TRACE", text)
        for _ in range(tries):
            try:
                found = json.loads(send(system, prompt))
            except json.JSONDecodeError:
                found = None
            if isinstance(found, dict):
                return found
            prompt += "\n\nThis was no JSON object. Answer with one JSON object and nothing else."
        return DEFAULT_VERDICT | {"reasoning": "The answer could not be parsed."}

    return ask


def triage(rendered: DataFrame, ask: Callable[[str], dict] = rule_stub, concurrency: int = 8, retries: int = 5) -> DataFrame:
    """(trace_id, verdict fields) of (trace_id, text); each task asks for up to ``concurrency`` traces at a time."""

    def run(frames):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                found = list(pool.map(lambda t: asked(ask, t, retries), frame["text"]))
                yield pd.DataFrame([{"trace_id": k, **{c: v.get(c) for c in names(VERDICT)}} for k, v in zip(frame["trace_id"], found)], columns=["trace_id", *names(VERDICT)])

    return rendered.mapInPandas(run, f"trace_id long, {VERDICT}")


def reports(verdicts: DataFrame, save_all: bool = False) -> DataFrame:
    """The verdicts worth saving."""
    return verdicts if save_all else verdicts.where("vulnerability")


def vulnerabilities(verdicts: DataFrame, traces: DataFrame) -> DataFrame:
    """(trace_id, name, severity, file) of the vulnerable; ``traces`` are (trace_id, file)."""
    hits = verdicts.where("vulnerability").join(traces.select("trace_id", "file"), "trace_id", "left")
    return hits.select("trace_id", sc.vulnerability_name(F.col("reasoning"), F.col("exploit")).alias("name"), sc.severity(F.col("confidence")).alias("severity"), F.coalesce("file", F.lit("")).alias("file"))


def parsed_verdicts(responses: DataFrame, column: str = "response") -> DataFrame:
    """JSON responses as verdicts; what can't be parsed gives the default verdict."""
    v = F.from_json(F.col(column), VERDICT)
    return responses.withColumn("_v", v).select("*", F.coalesce("_v.vulnerability", F.lit(False)).alias("vulnerability"), sc.severity(F.col("_v.confidence")).alias("confidence"), "_v.reasoning", "_v.exploit").drop("_v")
