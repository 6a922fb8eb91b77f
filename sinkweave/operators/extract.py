"""Function nodes, call edges and classes from source texts.

Python is parsed with its own ``ast``; other languages are scanned: strings and comments are masked, declarations are
found by pattern, their bodies by matching braces (or ``end``), and calls belong to the innermost declaration.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as sc
from ..sources.catalog import ENTRY_FILES

#: Rows that a task holds before it hands them on.
ROWS = 5_000

ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "all", "use")
PHP_ROUTE_METHODS = ("get", "post", "put", "delete", "patch", "options", "any", "match", "view", "redirect", "resource")

#: What marks a function as a web entry, in the lines before and of its declaration.
ENTRY_MARKS = {
    "python": r"@[\w.]*\b(route|get|post|put|delete|patch|websocket|api_view|action)\b",
    "java": r"@(Get|Post|Put|Delete|Patch|Request)Mapping|@Path\b|@(GET|POST|PUT|DELETE)\b",
    "c_sharp": r"\[(Http(Get|Post|Put|Delete|Patch)|Route)\b",
    "php": r"#\[Route\b|@Route\b",
    "typescript": r"@(Get|Post|Put|Delete|Patch|All)\s*\(",
}

IDENT = r"[A-Za-z_$][\w$]*"
CALL = re.compile(rf"((?:new\s+)?{IDENT}(?:\s*(?:\?\.|\.|::|->)\s*{IDENT}[!?]?)*)\s*(?=\()")
NOT_CALLS = set("if for while switch catch return function func fn def elif else match foreach unless until synchronized using lock sizeof typeof await yield not and or in is do try with lambda".split())
FUNCTIONS = {
    "javascript": [rf"\bfunction\s*\*?\s*({IDENT})\s*\(", rf"\b(?:const|let|var)\s+({IDENT})\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=;]+)?=>|{IDENT}\s*=>)", rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*({IDENT})\s*\([^;{{}}]*\)\s*(?::[^{{;=]+)?\{{"],
    "java": [rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?:[\w.<>\[\],?]+\s+)?({IDENT})\s*\([^;{{}}=]*\)\s*(?:throws\s+[\w.,\s]+)?\{{"],
    "c_sharp": [rf"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract|partial|unsafe)\s+)*(?:[\w.<>\[\],?]+\s+)?({IDENT})\s*\([^;{{}}=]*\)\s*(?:where[^{{]+)?(?:\{{|=>)"],
    "go": [rf"\bfunc\s+(?:\([^)]*\)\s*)?({IDENT})\s*(?:\[[^\]]*\])?\("],
    "php": [rf"\bfunction\s+&?({IDENT})\s*\("],
    "ruby": [r"^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[!?=]?)"],
}
CLASSES = {
    "javascript": rf"\bclass\s+({IDENT})", "java": rf"\b(?:class|interface|enum|record)\s+({IDENT})", "c_sharp": rf"\b(?:class|struct|interface|record)\s+({IDENT})",
    "php": rf"\b(?:class|interface|trait)\s+({IDENT})", "ruby": r"^[ \t]*(?:class|module)\s+([A-Z]\w*)", "go": r"\btype\s+(\w+)\s+struct\b(?=\b)$^",
}
MASKS = {
    "ruby": r"(?P<comment>#(?!\{)[^\n]*|^=begin.*?^=end)|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')",
    "php": r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*|#(?!\[)[^\n]*)|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')",
    "": r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)",
}
#: String building: on masked text, where a string is a quote, filler and a quote.
CONCAT = {
    "javascript": r"[\"'`]\s*\+(?![+=])|(?<!\+)\+\s*[\"'`]", "java": r"\"\s*\+(?![+=])|(?<!\+)\+\s*\"", "c_sharp": r"\"\s*\+(?![+=])|(?<!\+)\+\s*\$?\"|\$\"", "go": r"[\"`]\s*\+(?![+=])|(?<!\+)\+\s*[\"`]",
    "php": r"[\"')\w\]]\s*\.\s*[\"'$]|[\"']\s*\.\s*\w", "ruby": r"(?!)",
}


def dialect(lang: str) -> str:
    return "javascript" if lang in ("typescript", "tsx") else lang


def masked(text: str, lang: str) -> str:
    """The text with comments blanked and strings filled, its length and lines kept."""

    def fill(m: re.Match) -> str:
        s = m[0]
        if m.lastgroup == "comment":
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", "\x01", s[1:-1]) + s[-1] if len(s) > 1 else s

    return re.sub(MASKS.get(lang, MASKS[""]), fill, text, flags=re.S | re.M)


class Found:
    """Rows of one file."""

    def __init__(self, repo: str, path: str, lang: str, compat: bool):
        self.repo, self.path, self.lang, self.compat = repo, path, lang, compat
        self.module = re.sub(r"[/\\]", ".", re.sub(r"\.[^./\\]*$", "", path))
        base = path.rsplit("/", 1)[-1].lower()
        self.entry_file = base in ENTRY_FILES.get(lang, ()) or (lang == "php" and "/routes/" in f"/{path}".lower() and base in ("web.php", "api.php", "routes.php"))
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.classes: list[dict] = []
        self.strings: set[str] = set()

    def uid(self, *scopes: str) -> str:
        return ".".join([self.module, *scopes])

    def node(self, uid: str, name: str, line: int, end: int, sink=False, entry=False, source=False, builtin=False) -> None:
        self.nodes.append({"uid": uid, "name": name, "line": line, "end_line": end, "is_sink": sink, "is_entry": entry, "is_source": source, "is_builtin": builtin})

    def edge(self, src: str, callee: str, line: int) -> None:
        callee = re.sub(r"\s+", "", callee).replace("?.", ".").replace("::", ".").replace("->", ".")
        self.edges.append({"src": src, "callee": callee, "line": line})

    def concat(self, src: str, line: int) -> None:
        mark = f"<string_concat@{line}>"
        uid = f"builtin.{self.lang}.{mark}" if self.compat else f"builtin.{self.lang}.{self.module}.{mark}"
        if uid not in self.strings:
            self.strings.add(uid)
            self.node(uid, mark, line, line, sink=True, builtin=True)
        self.edges.append({"src": src, "callee": uid, "line": line})


def python_file(f: Found, text: str) -> None:
    tree = ast.parse(text)
    rows = text.split("\n")
    f.node(f.uid("<global>"), "<global>", 1, len(rows), entry=f.entry_file)

    def string(x) -> bool:
        return isinstance(x, ast.JoinedStr) or (isinstance(x, ast.Constant) and isinstance(x.value, (str, bytes)))

    def walk(x, classes: tuple[str, ...], scope: str) -> None:
        for child in ast.iter_child_nodes(x):
            own_classes, own = classes, scope
            if isinstance(child, ast.ClassDef):
                own_classes, own = (*classes, child.name), f.uid(*classes, child.name)
                f.classes.append({"name": child.name, "line": child.lineno, "end_line": child.end_lineno})
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = f.uid(*classes, child.name)
                top = min([d.lineno for d in child.decorator_list], default=child.lineno)
                marked = any(re.search(ENTRY_MARKS["python"], "@" + ast.unparse(d)) for d in child.decorator_list)
                f.node(own, child.name, top, child.end_lineno, entry=marked)
            elif isinstance(child, ast.Call):
                f.edge(scope, ast.unparse(child.func), child.lineno)
                if isinstance(child.func, ast.Attribute) and child.func.attr == "add_url_rule":
                    handlers = [a.id for a in [*child.args[2:], *[k.value for k in child.keywords if k.arg == "view_func"]] if isinstance(a, ast.Name)]
                    entries.update(handlers)
            elif isinstance(child, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in child.values):
                f.concat(scope, child.lineno)
            elif isinstance(child, ast.BinOp) and (isinstance(child.op, ast.Mod) and string(child.left) or isinstance(child.op, ast.Add) and (string(child.left) or string(child.right))):
                f.concat(scope, child.lineno)
            walk(child, own_classes, own)

    entries: set[str] = set()
    walk(tree, (), f.uid("<global>"))
    for n in f.nodes:
        n["is_entry"] = n["is_entry"] or n["name"] in entries


def body_end(text: str, at: int, lang: str, indent: str = "") -> int:
    """End of the body that begins at or after ``at``: its closing brace, the matching ``end``, or the statement's end."""
    if lang == "ruby":
        m = re.compile(rf"^{indent}end\b", re.M).search(text, at)
        return m.end() if m else len(text)
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
    return len(text)


def scanned_file(f: Found, text: str) -> None:
    lang = dialect(f.lang)
    clean = masked(text, lang)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    f.node(f.uid("<global>"), "<global>", 1, len(breaks) + 1, entry=f.entry_file, source=lang == "php" and bool(re.search(sc.PHP_SOURCE, text)))
    spans: list[tuple[int, int, str, str]] = []
    for m in re.finditer(CLASSES[lang], clean, re.M):
        spans.append((m.start(), body_end(clean, m.end(), lang, re.match(r"[ \t]*", m[0])[0]), "class", m[1]))
        f.classes.append({"name": m[1], "line": line(m.start(1)), "end_line": line(spans[-1][1] - 1)})
    starts = set()
    for pattern in FUNCTIONS[lang]:
        for m in re.finditer(pattern, clean, re.M):
            if m[1] in NOT_CALLS or m[1] in ("new", "throw", "case", "super", "this") or m.start(1) in starts:
                continue
            starts.add(m.start(1))
            parameters = clean.find(")", m.end(1)) if lang != "ruby" else m.end()
            spans.append((m.start(), body_end(clean, max(parameters, m.end(1)), lang, re.match(r"[ \t]*", m[0])[0]), "function", m[1]))
    spans.sort(key=lambda s: (s[0], -s[1]))

    # what stands around each span's beginning, outermost first: spans nest, so a stack follows them in one pass
    begins, stacks, stack = [], [], []
    for s in spans:
        stack = [t for t in stack if t[1] > s[0]] + [s]
        begins.append(s[0])
        stacks.append(stack)

    def scope(at: int) -> tuple[tuple[str, ...], str | None]:
        k = bisect_right(begins, at) - 1
        around = [s for s in stacks[k] if at < s[1]] if k >= 0 else []
        classes = tuple(s[3] for s in around if s[2] == "class")
        inner = around[-1] if around else None
        if inner is None:
            return (), None
        return (classes, inner[3]) if inner[2] == "function" else (classes[:-1], inner[3])

    def caller(at: int) -> str:
        classes, name = scope(at)
        return f.uid("<global>") if name is None else f.uid(*classes, name)

    for a, b, kind, name in spans:
        if kind == "function":
            classes = tuple(s[3] for s in stacks[bisect_right(begins, a) - 1] if s[2] == "class" and b <= s[1])
            before = max(clean.rfind(c, 0, a) for c in "{};") + 1
            head = text[before : clean.find("{", clean.find(name, a))] if f.lang in ENTRY_MARKS else ""
            marked = bool(head and re.search(ENTRY_MARKS[f.lang], head, re.I if lang == "php" else 0))
            f.node(f.uid(*classes, name), name, line(clean.find(name, a)), line(b - 1), entry=marked, source=lang == "php" and bool(re.search(sc.PHP_SOURCE, text[a:b])))
    handlers: set[str] = set()
    chained: dict[int, str] = {}
    for m in CALL.finditer(clean):
        callee, at = m[1], m.start(1)
        if clean[at - 1 : at] == "@" or (lang == "c_sharp" and clean[at - 1 : at] == "["):
            continue
        last = re.split(r"\?\.|\.|::|->", re.sub(r"\s+", "", callee))[-1]
        if last in NOT_CALLS or callee.split()[0] in ("function", "def", "func", "fn") or at in starts:
            continue
        callee = re.sub(r"^new\s+", "", callee).strip()
        end = closing(clean, m.end())
        if clean[at - 1 : at] == "." and at - 2 in chained:  # a call on what another call returns
            callee = f"{chained[at - 2]}.{callee}"
        chained[end] = callee
        f.edge(caller(at), callee, line(at))
        inside = clean[m.end() + 1 : end]
        if lang == "javascript" and last in ROUTE_METHODS and "." in callee or lang == "php" and re.fullmatch(r"Route::(\w+)", re.sub(r"\s+", "", callee)) and last in PHP_ROUTE_METHODS:
            anonymous = re.search(r"(?:async\s*)?(?:function\b|fn\s*\(|\([^()]*\)\s*=>|\w+\s*=>)", inside)
            if anonymous:
                start = m.end() + 1 + anonymous.start()
                f.node(f.uid(f"<anon@{line(start)}>"), f"<anon@{line(start)}>", line(start), line(end - 1), entry=True, source=lang == "php" and bool(re.search(sc.PHP_SOURCE, text[start:end])))
            else:
                handlers.update(re.findall(rf",\s*({IDENT})\s*$", inside))
                handlers.update(re.findall(r"@(\w+)'|,\s*'(\w+)'\s*\]", text[m.end() : end + 1])[0] if re.search(r"@(\w+)'|,\s*'(\w+)'\s*\]", text[m.end() : end + 1]) else ())
        if lang == "go" and last in ("HandleFunc", "Handle"):
            handlers.update(re.findall(rf",\s*(?:[\w.]+\.)?({IDENT})\s*$", inside))
    for n in f.nodes:
        n["is_entry"] = n["is_entry"] or n["name"] in handlers
    if lang == "php":
        for m in re.finditer(sc.INCLUDE, clean):
            f.edge(caller(m.start()), m[1].lower(), line(m.start()))
    done = set()
    builds = [m.start() for m in re.finditer(CONCAT[lang], clean)]
    inner = {"javascript": r"`[^`]*\$\{", "ruby": r"\"[^\"\n]*#\{", "php": r"\"[^\"\n]*\{?\$\w"}.get(lang)
    builds += [m.start() for m in re.finditer(inner, text)] if inner else []
    for at in sorted(builds):
        if line(at) not in done:
            done.add(line(at))
            f.concat(caller(at), line(at))


def closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.start()
    return len(text)


def extract_file(repo: str, path: str, lang: str, text: str, compat: bool = False) -> Found:
    """Nodes, edges and classes of one file; a file that can't be parsed has none."""
    f = Found(repo, path, lang, compat)
    try:
        if lang == "python":
            python_file(f, text)
        elif dialect(lang) in FUNCTIONS:
            scanned_file(f, text)
    except (SyntaxError, ValueError, RecursionError):
        return Found(repo, path, lang, compat)
    return f


def extract(files: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, raw edges, classes) of (repo, path, lang, text). One pass over the files, where they are.

    Ordinals follow (lang, path, place): the hash-free total order on which first-come rules rest is made of the rank
    of the file and the place within it.
    """
    from ..plans.lineage import cut

    def run(batches):
        import pyarrow as pa

        made: list[dict] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("repo", "path", "lang", "text")]
            for k in range(batch.num_rows):  # one text at a time becomes a Python string
                repo, path, lang, text = (c[k].as_py() for c in columns)
                f = extract_file(repo or "", path or "", lang or "", text or "", compat)
                made += [{"kind": kind, "repo": repo, "file": path, "lang": lang, "place": n, **r} for kind, own in (("node", f.nodes), ("edge", f.edges), ("class", f.classes)) for n, r in enumerate(own)]
                if len(made) >= ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema=types)
                    made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=types)

    ddl = "kind string, repo string, file string, lang string, place long, uid string, name string, line int, end_line int, is_sink boolean, is_entry boolean, is_source boolean, is_builtin boolean, src string, callee string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(ddl))
    rows = cut(files.select("repo", "path", "lang", "text").mapInArrow(run, ddl))
    from .link import numbered

    ranked = numbered(rows.where("kind <> 'class'"), "kind", "repo", "lang", "file", "place", name="ordinal")
    first = ranked.groupBy("kind").agg(F.min("ordinal").alias("_first"))
    ranked = ranked.join(F.broadcast(first), "kind").withColumn("ordinal", F.col("ordinal") - F.col("_first"))
    nodes = ranked.where("kind = 'node'").select(*schema.names(schema.NODES))
    edges = ranked.where("kind = 'edge'").select(*schema.names(schema.RAW_EDGES))
    return nodes, edges, rows.where("kind = 'class'").select(*schema.names(schema.CLASSES))


def ast_dump(files: DataFrame) -> DataFrame:
    """(path, depth, type, line, end_line, text) of Python syntax trees, in pre-order; texts cut to 120 characters."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"]):
                try:
                    stack = [(0, ast.parse(text or ""))]
                except (SyntaxError, ValueError):
                    continue
                n = 0
                while stack:
                    depth, x = stack.pop()
                    shown = (ast.get_source_segment(text, x) or "") if hasattr(x, "lineno") else ""
                    rows.append((path, n, depth, type(x).__name__, getattr(x, "lineno", 0), getattr(x, "end_lineno", 0), shown[:120].replace("\n", "\\n")))
                    n += 1
                    stack += [(depth + 1, c) for c in reversed(list(ast.iter_child_nodes(x)))]
            yield pd.DataFrame(rows, columns=["path", "place", "depth", "type", "line", "end_line", "text"])

    return files.where("lang = 'python'").select("path", "text").mapInPandas(run, "path string, place int, depth int, type string, line int, end_line int, text string")
