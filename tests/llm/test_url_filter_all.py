"""Every canonical link and refresh redirect of a page counts."""

from sinkweave.llm.url_filter import url_filter


def test_all_references(spark):
    head = lambda *tags: f"<html><head>{' '.join(tags)}</head></html>"
    link, refresh = '<link rel="canonical" href="{}">'.format, '<meta http-equiv="refresh" content="{}">'.format
    pages = [
        ("http://a.io/", head(link("http://b.io/"), link("http://evil.net/"))),
        ("http://b.io/", None),
        ("http://c.io/", head(refresh("30"), refresh("0; url=http://evil.net/x"))),
        ("http://d.io/", head(refresh("30"), '<link rel="canonical">')),
        ("http://e.io/", head(link("http://f.io/"), link("/own"), refresh("1;url=http://evil.net/y"), refresh("2;url=http://shop.org/fr/"))),
        ("http://f.io/", ""),
    ]
    rows = url_filter(spark.createDataFrame(pages, "url string, html string")).collect()
    assert {r["url"]: r["verdict"] for r in rows} == {f"http://{c}.io/": v for c, v in zip("abcdef", ("block", "block", "block", "allow", "allow", "allow"))}


def test_references_as_browsers_read_them(spark):
    evil = "http://evil.net/z"
    link = lambda href: f'<link rel="canonical" href="{href}">'
    long = "x" * 300_000
    cases = {  # page: (html, its verdict)
        "http://a.io/p": (link(f"/login?next={evil}"), "allow"),
        "http://b.io/p": (f"<!-- {link(evil)} --><p>" + link("#top") + link("") + link("mailto:me@evil.net"), "allow"),
        "http://c.io/p": (f"<script>var s='{link(evil)}'</script><title>{link(evil)}</title>", "allow"),
        "http://d.io/p": ("<link rel='x canonical' data-href='/no' href = http://evil.net/z>", "block"),
        "http://e.io/p": (f'<link title="a > b" href="http:&#47;&#x2f;evil.net/z" rel="Canonical">', "block"),
        "http://f.io/a/b/c": (link("../../x/./y"), "block"),
        "http://f.io/x/y": (link(evil), "block"),
        "http://g.io/p?old=1": (link("?new=2"), "block"),
        "http://g.io/p?new=2": (link(evil), "block"),
        "http://h.io/p": (f'<meta content="0;URL=\'{evil}\'" http-equiv=Refresh>', "block"),
        "http://i.io/p": (f'<meta http-equiv="refresh" content="5">{link("javascript:go()")}', "allow"),
        "http://j.io/p": (f'<link rel="canonical" data-x="{long}" href="{evil}">', "block"),
        "http://k.io/p": (f'<link rel="stylesheet" href="{evil}"><a rel=canonical href="{evil}">x</a>', "allow"),
        "nothing": (link(evil), "allow"),
        "x:y": (link("/p") + link(evil), "allow"),
    }
    rows = url_filter(spark.createDataFrame([(u, h) for u, (h, _) in cases.items()], "url string, html string")).collect()
    assert {r["url"]: r["verdict"] for r in rows} == {u: v for u, (_, v) in cases.items()}


def test_against_sql(spark, tmp_path):
    """The registered SQL on pages full of references of all kinds."""
    import random

    import duckdb

    from sinkweave.llm.queries import ORACLE_SQL, QUERIES

    rng = random.Random(1)
    hosts = ["a.io", "b.io", "evil.net", "shop.org", "c.example.com", "d.example.net"]
    refs = ["/fr/x", "x", "../x", "./y/../x", "?q=1", "#f", "", "mailto:a@b.c", "//evil.net/x", "/a?u=http://evil.net/", "HTTPS://Shop.ORG/fr/1", "http://b.io/x&amp;y", "&#47;x", "http://c.example.com/de/1", "x/..", "http://a.io/"]
    tag = lambda r: rng.choice([f'<link rel="canonical" href="{r}">', f"<LINK href='{r}' REL=canonical>", f'<meta http-equiv="refresh" content="0; url={r}">', f"<!-- <link rel=canonical href={r}> -->", f'<link rel="next" href="{r}">', f"<script><link rel=canonical href='{r}'></script>"])
    pages = [(k, rng.choice([None, "", "nohost", "mailto:x"]) if k % 9 == 0 else f"http://{rng.choice(hosts)}/{rng.choice(['', 'x', 'a/x', 'fr/x', 'de/1', 'en/..'])}{rng.choice(['', '?q=1', '#f'])}", None if k % 11 == 0 else "".join(tag(rng.choice(refs)) for _ in range(rng.randint(0, 2)))) for k in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(repr, (tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in QUERIES["op6_url_filter"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE_SQL['op6_url_filter']})").fetchall()))
