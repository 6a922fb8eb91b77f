"""A bounded loop in which a model looks through a repository and writes its source configuration.

The model is any callable: it gets the transcript so far and returns ``{"tool": name, "args": {...}}``. All tools
read files under the repository's root only, and cut long answers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from ..functions.helpers import config_errors, safe_path
from ..sources.catalog import EXTENSIONS

MOST_STEPS, MOST_RETRIES = 15, 3
MOST_NAMES, MOST_LINES, MOST_HITS, MOST_BYTES, WIDTH = 80, 200, 50, 1_000_000, 120


class Tools:
    """What a model may call."""

    def __init__(self, root: str):
        self.root = root

    def _files(self):
        for folder, names, files in os.walk(self.root):
            names[:] = sorted(n for n in names if not n.startswith("."))
            for name in sorted(files):
                path = os.path.join(folder, name)
                yield os.path.relpath(path, self.root).replace(os.sep, "/"), path

    def _lines(self, path: str) -> list[str]:
        full = safe_path(self.root, path)
        if os.path.getsize(full) > MOST_BYTES:
            raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
        with open(full, encoding="utf-8", errors="ignore") as file:
            return file.read().splitlines()

    def list_dir(self, path: str = ".") -> str:
        names = sorted(n for n in os.listdir(safe_path(self.root, path)) if not n.startswith("."))
        return ", ".join(names[:MOST_NAMES])

    def ls_depth(self, path: str = ".", depth: int = 2) -> str:
        base, out = safe_path(self.root, path), []
        for folder, names, files in os.walk(base):
            names[:] = sorted(n for n in names if not n.startswith("."))
            level = 0 if folder == base else os.path.relpath(folder, base).count(os.sep) + 1
            if level >= depth:
                names[:] = []
            out.append(f"{os.path.relpath(folder, base)}: {', '.join(sorted([*names, *files])[:MOST_NAMES])}")
        return "\n".join(out)

    def read_file(self, path: str) -> str:
        return "\n".join(self._lines(path)[:MOST_LINES])

    def read_lines(self, path: str, first: int, last: int) -> str:
        return "\n".join(self._lines(path)[max(1, first) - 1 : min(last, first + MOST_LINES - 1)])

    def grep(self, pattern: str, names: bool = False) -> str:
        rx, hits = re.compile(pattern, re.I), []
        for path, full in self._files():
            if names:
                hits += [path] if rx.search(path.rsplit("/", 1)[-1]) else []
            elif os.path.getsize(full) <= MOST_BYTES:
                hits += [f"{path}:{k}: {line.strip()[:WIDTH]}" for k, line in enumerate(self._lines(path), 1) if rx.search(line)]
            if len(hits) >= MOST_HITS:
                break
        return "\n".join(hits[:MOST_HITS])

    def get_languages(self) -> str:
        count: dict[str, int] = {}
        for path, _ in self._files():
            lang = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
            if lang:
                count[lang] = count.get(lang, 0) + 1
        return ", ".join(f"{k}: {n}" for k, n in sorted(count.items()))


def build_config(root: str, model: Callable[[list], dict], steps: int = MOST_STEPS) -> dict | None:
    """The configuration that the model submits with the tool ``submit``, once it is valid; None if it never is.

    The loop ends after ``steps`` calls, or when ``MOST_RETRIES`` submissions were refused.
    """
    tools, transcript, refused = Tools(root), [], 0
    for _ in range(steps):
        call = model(transcript)
        name, args = call.get("tool"), call.get("args") or {}
        if name == "submit":
            errors = config_errors(args)
            if not errors:
                return args
            refused += 1
            answer = "refused: " + "; ".join(errors)
        elif name in ("list_dir", "ls_depth", "read_file", "read_lines", "grep", "get_languages"):
            try:
                answer = getattr(tools, name)(**args)
            except (OSError, ValueError, TypeError, re.error) as e:
                answer = f"error: {e}"
        else:
            answer = f"error: no tool {name}"
        transcript.append({"call": call, "answer": answer})
        if refused >= MOST_RETRIES:
            break
    return None
