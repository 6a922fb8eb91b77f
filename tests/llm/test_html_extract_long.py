"""Quoted attribute values of any length."""

import time

import pytest

from sinkweave.llm import html_extract as hx


@pytest.mark.parametrize("n", [3_000, 5_000, 200_000])
@pytest.mark.parametrize("q", ["'", '"'])
def test_long_values(n, q):
    long = "x>y " * (n // 4)
    page = f"<p>one</p><script data-a={q}{long}{q}>var code;</script><iframe srcdoc={q}<p>inner {long}</p>{q}></iframe><div title={q}{long}{q}>two</div>"
    assert [b[0] for b in hx.blocks(page)] == ["one", "two"]


def test_open_quotes_end():
    start = time.time()
    for page in ('<a "' * 50_000, "<p title='x" * 50_000, '<p a="' + "<p b='c' " * 30_000, '<p>x</p><p title="' + "y" * 1_000_000):
        hx.blocks(page)
    assert time.time() - start < 20
