"""Which nodes may head a path: rules of a repository's source configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.helpers import glob_to_regex


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c, F.lit(False))
    return out


def file_match(file: Column, lang: Column, config: dict, compat: bool = False) -> Column:
    """Whether a file pattern, of its language if it names one, fits."""
    hits = []
    for p in config.get("file_patterns") or []:
        fits = file.rlike(glob_to_regex(p["pattern"], compat))
        hits.append(fits & (lang == p["language"]) if p.get("language") else fits)
    return _any(hits)


def function_match(name: Column, config: dict) -> Column:
    """Whether a function pattern is found in the name, or a function name equals it or its last part."""
    hits = [name.rlike(f"(?i){p}") for p in config.get("function_patterns") or []]
    for n in config.get("function_names") or []:
        hits.append((F.lower(name) == n.lower()) | F.lower(name).endswith("." + n.lower()))
    return _any(hits)


def legacy_match(text: Column, lang: Column, config: dict, permissive: bool = False) -> Column:
    """An indicator in the text, in any case, or a pattern of its language; anything if ``permissive``."""
    if permissive:
        return F.lit(True)
    hits = [F.contains(F.lower(text), F.lit(i.lower())) for i in config.get("source_indicators") or []]
    for language, own in (config.get("language_specific") or {}).items():
        hits += [(lang == language) & text.rlike(p) for p in own["patterns"]]
    return _any(hits)


def valid_source(file: Column, name: Column, lang: Column, is_source: Column, config: dict | None, text: Column | None = None, compat: bool = False) -> Column:
    """The rule for one node. PHP nodes that read a superglobal always pass; without a configuration only they do.

    File patterns alone ask for the file, function rules alone for the function; with both, either will do. A
    configuration of neither falls back to indicators and language patterns in the node's text, and for PHP to
    superglobals in it.
    """
    php = F.coalesce((lang == "php") & is_source, F.lit(False))
    if not config:
        return php
    files, functions = bool(config.get("file_patterns")), bool(config.get("function_patterns") or config.get("function_names"))
    if not files and not functions:
        if text is None:
            return php | F.lit(compat)
        return php | legacy_match(text, lang, config, permissive=compat) | ((lang == "php") & sc.is_php_source(text))
    return php | (file_match(file, lang, config, compat) if files else F.lit(False)) | (function_match(name, config) if functions else F.lit(False))


def needs_text(config: dict | None) -> bool:
    """Whether a configuration is one of indicators and language patterns, which look at a node's text."""
    return bool(config) and not any(config.get(k) for k in ("file_patterns", "function_patterns", "function_names"))


def in_project(file: Column, is_builtin: Column) -> Column:
    """Not a builtin, an external name or an unknown caller."""
    return ~F.coalesce(is_builtin, F.lit(False)) & ~file.isin("unknown", "<external>", "<builtin>")


def source_nodes(nodes: DataFrame, config: dict | None, compat: bool = False) -> DataFrame:
    """The nodes that may head a path."""
    text = F.col("text") if "text" in nodes.columns else None
    return nodes.where(in_project(F.col("file"), F.col("is_builtin")) & valid_source(F.col("file"), F.col("name"), F.col("lang"), F.col("is_source"), config, text, compat))


def invalid_regexes(patterns: list[str]) -> list[str]:
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            out.append(p)
    return out
