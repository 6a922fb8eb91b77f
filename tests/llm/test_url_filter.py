import re

from pyspark.sql import functions as F

from sinkweave.llm.graph import connected_components
from sinkweave.llm.url_filter import RULES, url_filter


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fitting(url):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def page(link="", meta=""):
    return f"<html><head>{link}{meta}</head><body>x</body></html>"


CASES = [
    (1, "http://good.io/a", page('<link href="https://bad.example.net/x" rel="canonical">')),  # names a blocked page
    (2, "https://good.io/b", page(meta="<meta http-equiv=refresh content='0; url=/a'>")),  # names it through page 1
    (3, "http://clean.io/", page()),
    (4, "http://other.io/x?q=1#top", page('<link rel=canonical href="//shop.org/fr/x">')),  # names an allowed page ...
    (5, "http://third.io/", page('<LINK REL="Canonical" HREF="http://evil.net/">')),
    (6, "http://other.io/x?q=1", page(meta='<meta content="5;URL=http://evil.net/" HTTP-EQUIV="refresh">')),  # ... and a blocked one
    (7, "HTTP://WWW.EXAMPLE.NET/en/1", None),
    (8, "http://www.example.net", ""),
    (9, None, page()),
    (10, "", page('<link rel="canonical" href="http://evil.net/">')),
    (11, "no scheme", page()),
    (12, "http://example.com/de/1", page()),
    (13, "http://xexample.com/de/1", page()),
    (14, "http://r.io/d/page", page('<link rel="canonical" href="sub">')),
    (15, "http://r.io/d/sub", page('<link rel="canonical" href="http://evil.net/?a=1&amp;b=2">')),
    (15, "http://r.io/d/sub", page('<link rel="canonical" href="http://evil.net/?a=1&amp;b=2">')),
    (16, "http://ÄB.net/x", page()),
]
# page 5 is in the class of page 6, which an allowed page clears; page 14 leads to a blocked one through page 15
METHOD = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 9: "allow", 10: "allow", 11: "allow", 14: "block", 15: "block"}


def test_cases(spark):
    frame = spark.createDataFrame([(*c, "mine") for c in CASES], "page_id long, url string, html string, verdict string").withColumns({"_node": F.lit("mine"), "a.b": F.lit(1)})
    rows = url_filter(frame).collect()
    assert {r["_node"] for r in rows} == {"mine"}
    assert sorted(r["page_id"] for r in rows) == sorted(c[0] for c in CASES)
    urls = {c[0]: c[1] for c in CASES}
    for r in rows:
        rule, verdict = fitting(urls[r["page_id"]])
        assert (r["host"], r["path"]) == split(urls[r["page_id"]]) and r["rule"] == rule
        assert r["verdict"] == (verdict or METHOD.get(r["page_id"], "allow")), r


def test_long_chain_and_hub(spark):
    edges = [(f"http://c{k}.io/", f"http://c{k + 1}.io/") for k in range(70)] + [(f"http://h{k}.io/", "http://hub.io/") for k in range(200)] + [("http://hub.io/", "http://spam.net/")]
    pages = spark.createDataFrame([(f"http://c{k}.io/",) for k in range(71)] + [(f"http://h{k}.io/",) for k in range(200)], "url string")
    rows = url_filter(pages, html=None, edges=spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r["url"]: r["verdict"] for r in rows} == {f"http://c{k}.io/": "allow" for k in range(71)} | {f"http://h{k}.io/": "block" for k in range(200)}


def test_empty(spark):
    assert url_filter(spark.createDataFrame([], "url string, html string")).count() == 0


def test_components_against_search(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(None, 1), (5, 5)]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
