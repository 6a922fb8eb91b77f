"""Driver-side helpers: globs, configuration checks, paths, model names."""

from __future__ import annotations

import fnmatch
import os
import re


def glob_to_regex(pattern: str, compat: bool = False) -> str:
    """A glob as a regular expression for RE2 and Java, to be searched in a relative path.

    The match is anchored on the right; ``**`` spans any number of folders, or exactly one if ``compat``.
    """
    out = []
    for k, part in enumerate(parts := pattern.strip("/").split("/")):
        last = k == len(parts) - 1
        if part == "**" and not compat:
            out.append("(.*)" if last else "(.*/)?")
            continue
        piece = ""
        for c in re.findall(r"\[[!]?[^\]]+\]|.", part):
            piece += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("[^" + c[2:] if c.startswith("[!") else c if c.startswith("[") and len(c) > 1 else re.escape(c))
        piece = re.sub(r"(\[\^/\]\*)+", "[^/]*", piece)
        out.append(piece + ("" if last else "/"))
    return "(^|/)" + "".join(out) + "$"


def glob_matches(path: str, pattern: str, compat: bool = False) -> bool:
    return re.search(glob_to_regex(pattern, compat), path) is not None


def suffix_glob_matches(path: str, pattern: str) -> bool:
    """The rule of the third generation: after ``**/`` a plain ending of the path, else a match of path or file name."""
    if pattern.startswith("**/"):
        return path.endswith(pattern[3:])
    return fnmatch.fnmatch(path, pattern) or fnmatch.fnmatch(path.rsplit("/", 1)[-1], pattern)


def config_errors(config: dict) -> list[str]:
    """What is wrong with a source configuration; an empty list if nothing is."""
    errors: list[str] = []

    def regexes(name: str, patterns) -> None:
        for k, p in enumerate(patterns):
            if not isinstance(p, str) or not p.strip():
                errors.append(f"{name}[{k}] must be non-empty string")
            else:
                try:
                    re.compile(p)
                except re.error as e:
                    errors.append(f"{name}[{k}] invalid regex: {e}")

    def array(name: str) -> list:
        value = config.get(name)
        if value is not None and not isinstance(value, list):
            errors.append(f"{name} must be an array")
        return value if isinstance(value, list) else []

    for k, item in enumerate(array("file_patterns")):
        if not isinstance(item, dict):
            errors.append(f"file_patterns[{k}] must be an object")
        elif not (isinstance(item.get("pattern"), str) and item["pattern"].strip()):
            errors.append(f"file_patterns[{k}] must have non-empty 'pattern' string")
    regexes("function_patterns", array("function_patterns"))
    array("function_names")
    array("source_indicators")
    languages = config.get("language_specific")
    if languages is not None and not isinstance(languages, dict):
        errors.append("language_specific must be an object")
    for lang, value in (languages if isinstance(languages, dict) else {}).items():
        if not isinstance(value, dict):
            errors.append(f"language_specific.{lang} must be an object")
        elif not isinstance(value.get("patterns"), list):
            errors.append(f"language_specific.{lang} must have 'patterns' array")
        else:
            regexes(f"language_specific.{lang}.patterns", value["patterns"])
    return errors


def parse_model(uri: str, default_version: str = "latest") -> tuple[str, str]:
    """(name, version) of ``scheme://folder/name/version``; other names stand for themselves."""
    m = re.fullmatch(r"\w+://[^/]+/([^/]+)(?:/([^/]+))?/?", uri)
    return (m[1], m[2] or default_version) if m else (uri, default_version)


def safe_path(root: str, path: str) -> str:
    """``path`` under ``root``, resolved; PermissionError if it leads out."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    if full != base and not full.startswith(base + os.sep):
        raise PermissionError(f"{path} is outside of {root}")
    return full


def split_prompt(prompt: str, mark: str = "Trace: TRACE") -> tuple[str, str]:
    """(system prompt, user template) of a prompt, cut at the mark."""
    head, found, rest = prompt.partition(mark)
    return head.strip(), (mark + rest) if found else ""
