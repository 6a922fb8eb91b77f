from sinkweave.llm import html_extract as hx


def test_blocks():
    page = "<!-- <p>no</p> --><script>var t='</p>'</script><nav><a href='/x'>Go</a></nav><p class=\"lead big\">a &amp; b<br>c <b>d</b>e<p>next\n line</div>tail <ul><li>one<li>two</ul>"
    found = hx.blocks(page)
    assert [b[0] for b in found] == ["Go", "a & b c de", "next line", "tail", "one", "two"]
    assert found[0][2] == 1.0 and "tag=nav" in found[0][1] and "name=lead" in found[1][1] and "name=lead" not in found[2][1]


def test_odd_markup_ends():
    for page in ("", "<", "<p", "a < b > c", "<p title='x>y", "<!-- never closed", "<script>never closed", "</p></p>", '<a "' * 3000, "<div>" * 3000 + "x", "&#xD800;&bogus; &lt;", "x" * 100_000):
        hx.blocks(page)
    assert hx.blocks("a < b")[0][0] == "a < b"


def test_held_out_pages():
    """Accuracy on pages that the model hasn't seen."""
    crf = hx.model()
    pages, labels = hx.labelled_pages(300, seed=99)
    wrong = total = whole = 0
    for page, want in zip(pages, labels):
        got = crf.decode(hx.features(page))
        wrong += sum(g != w for g, w in zip(got, want))
        total += len(want)
        whole += got == want
    assert wrong / total < 0.02 and whole / len(pages) > 0.85, (wrong, total, whole)


def test_given_pages(spark, sf):
    """On the given pages the article element holds the main text."""
    rows = hx.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    for r in rows:
        inside = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        assert r["text"] == "\n".join(b[0] for b in hx.blocks(inside))


def test_parts_that_go():
    crf = hx.model()
    page = (
        "<html><head><title>T</title></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        '<div class="cookie-notice">We use cookies on this site.</div><article><h1>Title of it</h1><p>First paragraph, with some words.</p>'
        '<div class="ad">Buy this thing now.</div><p>Second paragraph, it has words too.</p></article>'
        '<section id="comments"><p>Nice text, thanks for it.</p></section><aside><h3>Related</h3><p>Other text.</p></aside>'
        "<form><label>Mail</label><button>Go</button></form><footer>&copy; Site</footer></body></html>"
    )
    assert hx.main_text(page, crf) == "Title of it\nFirst paragraph, with some words.\nSecond paragraph, it has words too."


def test_nulls_repeats_names(spark):
    rows = hx.extract_text(spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6)], "page_id long, html string, text int")).collect()
    assert [(r["page_id"], r["text"]) for r in rows] == [(1, ""), (2, ""), (2, "")]
    assert hx.extract_text(spark.createDataFrame([], "html string")).count() == 0


def test_decoding_is_the_best_of_all_label_sequences():
    import itertools

    import numpy as np

    from sinkweave.llm.html_extract import Crf

    rng = np.random.default_rng(1)
    names = [f"f{k}" for k in range(6)]
    for _ in range(60):
        weights, moves = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        crf = Crf({n: k for k, n in enumerate(names)}, weights, moves)
        page = [[names[k] for k in range(6) if rng.random() < 0.4] + ["unknown"] for _ in range(rng.integers(0, 9))]
        score = [[sum(weights[names.index(f), y] for f in own if f in names) for y in (0, 1)] for own in page]
        total = lambda path: sum(score[t][y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        assert crf.decode(page) == list(max(itertools.product((0, 1), repeat=len(page)), key=total))


def test_training_finds_the_likelihoods_maximum():
    """At the trained weights the likelihood, summed over all label sequences, has no slope but the penalty's."""
    import itertools

    import numpy as np

    from sinkweave.llm.html_extract import train

    rng = np.random.default_rng(2)
    pages = [[["bias", rng.choice(["a", "b", "c"])] for _ in range(rng.integers(1, 5))] for _ in range(12)]
    labels = [[int(own[1] == "a") if rng.random() < 0.7 else int(rng.integers(0, 2)) for own in page] for page in pages]
    crf = train(pages, labels, steps=3000, rate=0.03, decay=1e-2)

    def loss(weights, moves):
        out = 0.5 * 1e-2 * (weights**2).sum()
        for page, own in zip(pages, labels):
            total = lambda path: sum(weights[crf.index[f], y] for fs, y in zip(page, path) for f in fs) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            out -= (total(own) - np.logaddexp.reduce([total(p) for p in itertools.product((0, 1), repeat=len(page))])) / len(pages)
        return out

    for which in ("weights", "moves"):
        for at in np.ndindex(getattr(crf, which).shape):
            values = []
            for step in (1e-4, -1e-4):
                both = {"weights": crf.weights.copy(), "moves": crf.moves.copy()}
                both[which][at] += step
                values.append(loss(**both))
            assert abs(values[0] - values[1]) / 2e-4 < 2e-2


def test_long_attributes_and_pages():
    import time

    from sinkweave.llm.html_extract import blocks

    long = "x > y < z " * 100_000
    page = f'<p title="{long}">kept</p><script data-x=\'{long}\'>var leaked = "</p>";</script><div data-y="{long}">also <b data-z=\'{long}\'>kept</b></div>'
    assert [b[0] for b in blocks(page)] == ["kept", "also kept"]
    for odd in ("<script " * 50_000, "<a " * 100_000, "<a '" * 50_000, "<!--" * 100_000, "<" * 300_000, "<p>" * 50_000, "&amp;" * 100_000):
        start = time.time()
        blocks(odd)
        assert time.time() - start < 20
