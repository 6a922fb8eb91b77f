"""URL filter by redirect equivalence [native].

A url takes the verdict of the longest rule that fits it. Urls without a rule take the verdict of their class:
pages that name each other by a canonical link or a refresh redirect form one class (connected components),
a blocked member blocks the class, and an explicitly allowed member clears it. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, rekeyed, small
from .graph import connected_components

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What holds no tags of the page: comments, and elements whose content is text.
NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "title", "textarea", "template", "iframe"))
TAG = r"(?is)<(?:link|meta)\b(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
ATTRIBUTE = r"(?s)[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
VALUE = r"(?s)^[^\s=]+\s*=\s*(?:\"(.*)\"|'(.*)'|(.*))$"
#: What a refresh names: a time, then a url, perhaps in quotes.
REFRESH = r"(?is)^\s*[\d.]*\s*[;,]\s*(?:url\s*=)?\s*(?:\"([^\"]*)|'([^']*)|([^\"'].*)?)"
NUMERIC = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};"
# Character references by name.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved; other paths as they are."""
    segments = F.split(F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path), "/", -1)
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s)))
    resolved = F.aggregate(segments, F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))
    return F.when(path.contains("/."), resolved).otherwise(path)


def node_of(url: Column, host: Column, path: Column) -> Column:
    """Identity of a url among redirects: host, path (``/`` if empty, dots resolved) and query.

    Null where the url has no host.
    """
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(without_dots(path)), query))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits; nulls if none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def resolve(base: Column, host: Column, path: Column, ref: Column) -> Column:
    """Absolute form of a reference found on the page ``base``, whose host and path are given.

    Null for references to the page itself (empty or a fragment) and for schemes without a host (mailto: and the like).
    A relative reference on a page without a host names nothing.
    """
    scheme = F.regexp_extract(base, r"^([^:]*):", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(ref.rlike(SCHEME), F.when(ref.rlike(SCHEME + "//"), ref))
        .when((host == "") | (ref == "") | ref.startswith("#"), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(scheme, F.lit("://"), host, ref))
        .when(ref.startswith("?"), F.concat(scheme, F.lit("://"), host, path, ref))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    )


def decoded(text: Column) -> Column:
    """The text with its character references decoded: those of ``NAMED`` and numbers of ASCII characters."""
    number = lambda r: F.when(F.lower(r).startswith("&#x"), F.conv(F.regexp_extract(r, "([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+);$", 1)).cast("long")
    step = lambda acc, r: F.when(number(r).between(1, 127), F.replace(acc, r, F.char(number(r)))).otherwise(acc)
    out = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0))), text, step)
    for name, value in NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.when(text.contains("&"), out).otherwise(text)


def references(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, ref): what the canonical links and refresh redirects of each page name, as written.

    Tags in comments, scripts and other elements whose content is text don't count. Step by step, one row a tag, so that
    no expression grows with the steps before it.
    """
    page = pages.select(pages[url].alias("url"), pages[html].alias("html")).where(pages[url].isNotNull() & pages[html].rlike("(?i)canonical|refresh"))
    tags = page.select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", NO_TAGS, " "), F.lit(TAG), F.lit(0))).alias("tag"))
    tags = cut(tags.where(F.col("tag").rlike("(?i)canonical|refresh")).select("url", F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(0)).alias("attributes")))
    grouped = lambda text, pattern: F.concat(*[F.coalesce(F.regexp_extract(text, pattern, k), F.lit("")) for k in (1, 2, 3)])
    attribute = lambda name: F.try_element_at(F.filter("attributes", lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name), F.lit(1))
    for name in ("rel", "href", "http-equiv", "content"):
        tags = tags.withColumn(name, attribute(name)).withColumn(name, grouped(F.col(f"`{name}`"), VALUE)).withColumn(name, decoded(F.col(f"`{name}`")))
    kind = F.lower(F.try_element_at("attributes", F.lit(1)))
    canonical = (kind == "<link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    refresh = (kind == "<meta") & (F.trim(F.lower("`http-equiv`")) == "refresh")
    named = cut(tags.select("url", F.when(canonical, F.col("href")).when(refresh, grouped(F.col("content"), REFRESH)).alias("ref")))
    return named.select("url", F.regexp_replace("ref", r"^\s+|\s+$|[\t\r\n]", "").alias("ref")).where("ref <> ''")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): all canonical links and refresh redirects of each page, absolute. ``base`` is not looked at."""
    parts = references(pages, url, html).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parts.select("url", resolve(F.col("url"), F.col("host"), F.col("path"), F.col("ref")).alias("target")).where("target IS NOT NULL").distinct()


def url_filter(pages: DataFrame, url: str = "url", html: str | None = "html", rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule and verdict (``allow`` or ``block``) to every row.

    ``edges`` may hold further (url, target) redirects. Null, empty or hostless urls fit no rule, belong to no
    class and are allowed; rows repeat as they do in the input; columns of the input that have one of the four
    names are replaced. The rules are a short configured list, not data.
    """
    links = alias_edges(pages, url, html) if html else None
    if edges is not None:
        more = edges.select(edges[edges.columns[0]].alias("url"), edges[edges.columns[1]].alias("target"))
        links = more if links is None else links.unionAll(more)
    address, node, stopped = (fresh(pages, c) for c in ("_url", "_node", "_blocked"))
    rest = pages.drop("host", "path", "rule", "verdict")
    judged = pages.select(*[pages[f"`{c}`"] for c in rest.columns], pages[url].alias(address), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    text, own = fitting_rule(F.col("host"), F.col("path"), rules)
    # pages without a host join nothing; keys that no url has keep them from meeting in one task
    alone = F.concat(F.lit(" "), F.xxhash64(address, *([pages[html]] if html else [])).cast("string"))
    judged = judged.withColumns({"rule": text, "verdict": own, node: F.coalesce(node_of(F.col(address), F.col("host"), F.col("path")), alone)}).drop(address)
    if links is None:
        return judged.withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).drop(node)
    links = cut(links)
    for c, n in (("url", "a"), ("target", "b")):  # one end after the other keeps the generated code small
        parts = links.withColumns({"host": host_of(F.col(c)), "path": path_of(F.col(c))})
        links = cut(parts.withColumns({n: node_of(F.col(c), F.col("host"), F.col("path")), f"r{n}": fitting_rule(F.col("host"), F.col("path"), rules)[1]}).where(f"{n} IS NOT NULL").drop("host", "path", c))
    links = cut(links.where("a <> b").select("a", "b", "ra", "rb").distinct())
    classes = connected_components(links)
    verdicts = links.select("a", "ra").unionAll(links.select("b", "rb")).toDF("node", "own").distinct()
    by_class = classes.join(verdicts, "node").groupBy("component").agg(F.bool_or(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"), F.bool_or(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("cleared"))
    blocked = classes.join(rekeyed(by_class.where("blocked AND NOT cleared").select("component"), "component"), "component").select(F.col("node").alias(node), F.lit(True).alias(stopped))
    return judged.join(small(cut(blocked)), node, "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col(stopped), F.lit("block")).otherwise(F.lit("allow")))).drop(node, stopped)
