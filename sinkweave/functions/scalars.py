"""Scalar functions on Columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a PHP source, and names of its inclusion statements.
PHP_SOURCE = r"(?i)\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER|ENV|SESSION)\b|php://input|\$HTTP_RAW_POST_DATA"
INCLUDE = r"(?i)\b(require_once|require|include_once|include)\b"
LINE_BREAK = r"\r\n|\r|\n"
SNIPPET_LINES = 400


def normalize_callee(callee: Column) -> Column:
    """Without white space, ``?.`` and ``::`` as dots; null gives an empty string."""
    bare = F.regexp_replace(F.coalesce(callee, F.lit("")), r"\s+", "")
    return F.replace(F.replace(bare, F.lit("?."), F.lit(".")), F.lit("::"), F.lit("."))


def module_id(path: Column) -> Column:
    """A relative path without its last extension, separators as dots."""
    return F.translate(F.regexp_replace(path, r"\.[^./\\]*$", ""), "/\\", "..")


def def_uid(module: Column, scopes: Column, name: Column) -> Column:
    """``module[.Class...].name``."""
    return F.concat_ws(".", module, F.array_join(F.filter(F.concat(scopes, F.array(name)), lambda x: x != ""), "."))


def last_segment(uid: Column) -> Column:
    return F.substring_index(uid, ".", -1)


def parent_scope(uid: Column) -> Column:
    """What stands before the last dot; the whole if there is none."""
    return F.regexp_replace(uid, r"\.[^.]*$", "")


def dotted_suffixes(callee: Column) -> Column:
    """The callee and every suffix of it that follows a dot, longest first."""
    parts = F.split(callee, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))


def is_php_source(text: Column) -> Column:
    return F.coalesce(text.rlike(PHP_SOURCE), F.lit(False))


def strip_php_comments(text: Column) -> Column:
    """Without ``/*...*/`` (over lines), then ``//...`` and ``#...`` to the end of the line."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(//[^\n]*|#[^\n]*)$", "")


def include_keywords(text: Column) -> Column:
    """All inclusion keywords of a text, in order, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(INCLUDE), F.lit(1)), F.lower)


def label(name: Column, is_source: Column, is_sink: Column, is_entry: Column | None = None) -> Column:
    """``name [TAG|TAG]``, or the bare name."""
    tags = [F.when(is_entry, F.lit("WEB_ENTRY"))] if is_entry is not None else []
    tags += [F.when(is_source, F.lit("SOURCE")), F.when(is_sink, F.lit("SINK"))]
    joined = F.array_join(F.array(*tags), "|")
    return F.concat(name, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" ["), joined, F.lit("]"))))


def location(file: Column, line: Column, end_line: Column, is_builtin: Column) -> Column:
    spot = F.concat(file, F.lit(":"), line.cast("string"))
    return (
        F.when(is_builtin, F.lit("<builtin>"))
        .when(file == "unknown", F.lit("<unknown source>"))
        .when(file == "<external>", F.lit("<external lib>"))
        .otherwise(F.when((F.coalesce(end_line, F.lit(0)) != 0) & (end_line != line), F.concat(spot, F.lit("-"), end_line.cast("string"))).otherwise(spot))
    )


def lines(text: Column) -> Column:
    """Lines of a text; a line break at the end makes no further line, an empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def snippet(text: Column, line: Column, end_line: Column, most: int = SNIPPET_LINES) -> Column:
    """Lines ``line`` to ``end_line`` (from 1, inclusive), clamped to the text, at most ``most``; null if there are none."""
    every = lines(text)
    first = F.greatest(line, F.lit(1))
    last = F.least(F.greatest(F.coalesce(end_line, line), first), F.size(every), first + most - 1)
    return F.when((line > 0) & (last >= first), F.array_join(F.slice(every, first, last - first + 1), "\n"))


def context(text: Column, line: Column, radius: int) -> Column:
    """The lines around a line."""
    return snippet(text, F.greatest(line - radius, F.lit(1)), line + radius, 2 * radius + 1)


def path_code_hash(coded: Column) -> Column:
    """md5 over the sorted ``uid:code`` of (uid, code) structs; codeless ones don't count, null if all are."""
    known = F.filter(coded, lambda c: c["code"].isNotNull() & (c["code"] != ""))
    joined = F.array_join(F.array_sort(F.transform(known, lambda c: F.concat(c["uid"], F.lit(":"), c["code"]))), "\n---\n")
    return F.when(F.size(known) > 0, F.md5(joined))


def function_hashes(coded: Column) -> Column:
    """Sorted set of md5(``uid:code``)."""
    known = F.filter(coded, lambda c: c["code"].isNotNull() & (c["code"] != ""))
    return F.array_sort(F.array_distinct(F.transform(known, lambda c: F.md5(F.concat(c["uid"], F.lit(":"), c["code"])))))


def severity(confidence: Column) -> Column:
    """Capitalised confidence, ``Medium`` where there is none."""
    return F.coalesce(F.concat(F.upper(F.substring(confidence, 1, 1)), F.lower(confidence.substr(F.lit(2), F.length(confidence)))), F.lit("Medium"))


def vulnerability_name(reasoning: Column, exploit: Column) -> Column:
    """The first of reasoning, exploit and ``Vulnerability`` that isn't empty, 500 characters at most."""
    return F.left(F.coalesce(F.nullif(reasoning, F.lit("")), F.nullif(exploit, F.lit("")), F.lit("Vulnerability")), F.lit(500))


def first_location(trace_text: Column) -> Column:
    """File and line of the first ``location:`` in a rendered trace."""
    return F.regexp_extract(trace_text, r"location:\s*\"?([^\"\n]+?)\"?\s*(?:\n|$)", 1)


def bucket_name(name: Column) -> Column:
    """Lower case, other than a-z, 0-9 and hyphens to hyphens, which are collapsed and trimmed; ``reports`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9-]", "-"), r"-+", "-")
    return F.coalesce(F.nullif(F.btrim(kept, F.lit("-")), F.lit("")), F.lit("reports"))


def entry_file(lang: Column, path: Column, names: dict[str, set[str]]) -> Column:
    """Whether a file name is one in which a language's web applications begin."""
    base, hit = F.lower(F.substring_index(path, "/", -1)), F.lit(False)
    for language, known in names.items():
        hit = hit | ((lang == language) & base.isin(*sorted(known)))
    return hit
