"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the stretches of text between block-level tags. Each block is described by its
ancestors (tags and the words of their class, id and role) and by its text; a chain CRF with the labels *other* and
*article* is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Pages from which the model is trained, and its training steps: a bound on the labelled sample.
PAGES, STEPS = 500, 150
OTHER, ARTICLE = 0, 1

# HTML element names by their role in parsing.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|audio|video"
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({HIDDEN})\b(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S | re.I)
TOKENS = re.compile(r"[a-z]+")


def blocks(html: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, ancestors' features, share of linked characters) of each leaf block that has text, in page order."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = total = in_link = 0

    def flush():
        nonlocal linked, total
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((text, tuple(sorted({f for _, own in stack for f in own})), linked / max(1, total)))
            pieces.clear()
        linked = total = 0

    def keep(text: str):
        nonlocal linked, total
        if text:
            pieces.append(text)
            total += len(text)
            linked += len(text) if in_link else 0

    at = 0
    for m in MARKUP.finditer(html):
        keep(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, rest = m[2] or m[5], m[4] or m[7] or ""
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                keep(" ")
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        elif name in CLOSED_BY and CLOSED_BY[name] and stack and stack[-1][0] in CLOSED_BY[name]:
            stack.pop()
        own = [f"tag={name}"]
        if name not in ("html", "body"):
            for a in NAMED.finditer(rest):
                own += [f"name={t}" for t in TOKENS.findall((a[2] or a[3] or a[4] or "").lower())]
        stack.append((name, tuple(own)))
    keep(html[at:])
    flush()
    return out


def features(page: list[tuple[str, tuple[str, ...], float]]) -> list[list[str]]:
    out = []
    for k, (text, above, linked) in enumerate(page):
        words = text.count(" ") + 1
        own = ["bias", *above, f"words={min(7, words.bit_length())}", f"linked={int(linked * 4)}"]
        if text[-1] in ".!?:;\"')":
            own.append("ends")
        if "©" in text or "copyright" in text.lower():
            own.append("copyright")
        if "," in text:
            own.append("comma")
        if sum(c.isdigit() for c in text) * 3 > len(text):
            own.append("digits")
        if k == 0:
            own.append("first")
        if k == len(page) - 1:
            own.append("last")
        out.append(own)
    return out


class Crf:
    """Chain CRF of two labels over sparse binary features."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.table = [tuple(w) for w in weights.tolist()]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The best labels of a page's blocks by Viterbi; ties go to *other*."""
        if not page:
            return []
        stay, to_article, to_other, keep = self.moves.ravel().tolist()
        back, a, b = [], 0.0, 0.0
        for k, own in enumerate(page):
            x = y = 0.0
            for f in own:
                at = self.index.get(f)
                if at is not None:
                    w = self.table[at]
                    x += w[0]
                    y += w[1]
            if k == 0:
                a, b = x, y
                continue
            left, right = a + stay >= b + to_other, a + to_article >= b + keep
            back.append((OTHER if left else ARTICLE, OTHER if right else ARTICLE))
            a, b = (a + stay if left else b + to_other) + x, (a + to_article if right else b + keep) + y
        label = OTHER if a >= b else ARTICLE
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(pages: list[list[list[str]]], labels: list[list[int]], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam over all pages at once; forward and backward run over padded pages together."""
    index: dict[str, int] = {}
    for page in pages:
        for own in page:
            for f in own:
                index.setdefault(f, len(index))
    n, longest = len(pages), max(map(len, pages))
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    for k, page in enumerate(pages):
        mask[k, : len(page)] = True
        gold[k, : len(page)] = labels[k]
    rows = [own for page in pages for own in page]
    dense = np.zeros((len(rows), len(index)), np.float32)
    for k, own in enumerate(rows):
        dense[k, [index[f] for f in own]] = 1
    wanted = np.eye(2)[gold]
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.einsum("ntab,nt->ab", wanted[:, :-1, :, None] * wanted[:, 1:, None, :], both)
    weights, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for step in range(1, steps + 1):
        score = np.zeros((n, longest, 2))
        score[mask] = dense @ weights
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, longest):
            new = add(forward[:, t - 1, :, None] + moves, 1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = add(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        whole = add(forward[:, -1], 1)[:, None]
        single = np.exp(forward + backward - whole[:, :, None])
        pair = np.exp(forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, :, None, None])
        slopes = (dense.T @ (single - wanted)[mask] / n + decay * weights, (np.einsum("ntab,nt->ab", pair, both) - seen) / n)
        for x, slope, (m, v) in zip((weights, moves), slopes, state):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(index, weights, moves)


# --- labelled pages -------------------------------------------------------------------------------------------

# Names that pages give to their parts.
MAIN_NAMES = "content article post entry story main text body article-body post-content entry-content main-content page-content".split()
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc pagination pager tabs".split(),
    "head": "header masthead site-header top-bar topbar logo branding".split(),
    "foot": "footer site-footer bottom copyright colophon legal".split(),
    "side": "sidebar side rail aside related recommended popular trending widget more-stories tags author-box".split(),
    "notice": "notice cookie cookie-consent consent gdpr alert banner popup modal message toast".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promoted ad-slot adsense".split(),
    "form": "form login search newsletter subscribe signup contact".split(),
    "comments": "comments comment comment-list replies reply discussion disqus responses".split(),
    "share": "share social sharing follow buttons".split(),
}
GOOD, BAD = "\ue001", "\ue000"  # private-use characters


class Author:
    """Writes labelled pages: each text begins with a mark that tells whether it belongs to the article."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> list[str]:
        r = self.rng
        return ["".join(r.choice("aeiouéstrnlmdcpw") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]

    def sentences(self, low: int, high: int) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(low, high)):
            words = self.words(1, 16)
            if r.random() < 0.4:
                words[r.randrange(len(words))] += ","
            out.append(" ".join(words).capitalize() + r.choice("....!?"))
        return " ".join(out)

    def inline(self, text: str) -> str:
        r = self.rng
        if r.random() < 0.25:
            text = f"<{r.choice(['b', 'em', 'span'])}>{text}" + r.choice(["", "</b>", "</em>", "</span>"])
        if r.random() < 0.15:
            text += f' <a href="/x">{" ".join(self.words(1, 3))}</a>'
        return text

    def links(self, mark: str) -> str:
        items = "".join(f'<li><a href="/{w}">{mark}{w}</a></li>' for w in self.words(2, 7))
        return f"<ul>{items}</ul>"

    def paragraph(self, mark: str) -> str:
        end = self.rng.choice(["</p>", "</p>", "</p>", "<br>"])
        return f"<p>{mark}{self.inline(self.sentences(1, 6))}{end}"

    def named(self, tag: str, names: list[str], inner: str) -> str:
        r = self.rng
        name = r.choice(names)
        attribute = r.choice([f' class="{name}"', f" class='{name} c{r.randint(1, 9)}'", f' id="{name}"', f" id={name}"])
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def aside(self, kind: str) -> str:
        """A part of the page that is not the article."""
        r = self.rng
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        if kind == "menu":
            inner = self.links(BAD)
        elif kind == "comments":
            inner = "".join(f'<div class="comment"><p>{BAD}{self.sentences(1, 4)}</p></div>' for _ in range(r.randint(1, 4)))
            inner = (f"<h3>{BAD}{' '.join(self.words(1, 2))}</h3>" if r.random() < 0.6 else "") + inner
            tag = r.choice([None, "section"])
        elif kind == "foot":
            inner = f"{BAD}&copy; {' '.join(self.words(1, 4))}" + r.choice(["", f" &middot; {self.sentences(1, 3)}", self.links(BAD)])
        elif kind == "form":
            inner = f"<label>{BAD}{' '.join(self.words(1, 3))}</label><input name=q><button>{BAD}{self.words(1, 1)[0]}</button>"
        elif kind == "side":
            inner = f"<h3>{BAD}{' '.join(self.words(1, 3))}</h3>" + r.choice([self.links(BAD), f"<p>{BAD}{self.sentences(1, 2)}</p>"])
        elif kind == "head":
            inner = f"<h2>{BAD}{' '.join(self.words(1, 4))}</h2>" + (f"<p>{BAD}{self.sentences(1, 1)}</p>" if r.random() < 0.4 else "")
        else:
            inner = f"{BAD}{self.sentences(1, 3)}"
            inner = f"<p>{inner}</p>" if r.random() < 0.5 else inner
        if tag and r.random() < 0.6:
            return f"<{tag}>{inner}</{tag}>"
        return self.named(tag if tag and r.random() < 0.3 else "div", PARTS[kind], inner)

    def article(self) -> str:
        r = self.rng
        parts = [f"<h1>{GOOD}{' '.join(self.words(2, 10))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.7:
                parts.append(self.paragraph(GOOD))
            elif kind < 0.76:
                parts.append(f"<h2>{GOOD}{' '.join(self.words(1, 6))}</h2>")
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{GOOD}{self.sentences(1, 1)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{GOOD}{self.sentences(1, 2)}</blockquote>")
            elif kind < 0.89:
                parts.append("<table>" + "".join(f"<tr><td>{GOOD}{w}</td><td>{GOOD}{r.randint(1, 99)}</td></tr>" for w in self.words(1, 3)) + "</table>")
            elif kind < 0.91:
                parts.append(f"<pre>{GOOD}{' '.join(self.words(2, 8))}</pre>")
            elif kind < 0.93:
                parts.append(f"<figure><img src=x><figcaption>{GOOD}{self.sentences(1, 1)}</figcaption></figure>")
            elif kind < 0.95:
                parts.append(f"<div>{GOOD}{self.sentences(1, 3)}</div>")
            else:
                parts.append(self.aside(r.choice(["advert", "side", "share", "notice", "form"])))
        if r.random() < 0.12:
            parts.append(self.aside("comments"))
        return "".join(parts)

    def page(self) -> str:
        r = self.rng
        inner = self.article()
        way = r.random()
        if way < 0.45:
            main = f"<article>{inner}</article>"
        elif way < 0.6:
            main = self.named("article", MAIN_NAMES, inner)
        elif way < 0.7:
            main = f"<main>{inner}</main>"
        elif way < 0.95:
            main = self.named(r.choice(["div", "section", "div", "main"]), MAIN_NAMES, inner)
        else:
            main = inner
        before = "".join(self.aside(k) for k in ("head", "menu", "notice", "advert", "form", "side", "share") if r.random() < 0.3)
        after = "".join(self.aside(k) for k in ("comments", "share", "advert", "side", "form", "menu", "notice") if r.random() < 0.3)
        after += self.aside("foot") if r.random() < 0.85 else ""
        body = before + main + after
        if r.random() < 0.25:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout row"])}">{body}</div>'
        title = f"<title>{BAD}{' '.join(self.words(1, 8))}</title>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head>{title}</head><body>{body}" + r.choice(["", "</body></html>"])


def labelled_pages(n: int, seed: int = 0) -> tuple[list, list[list[int]]]:
    """(blocks, labels) of ``n`` pages; texts without their marks."""
    author, pages, labels = Author(seed), [], []
    while len(pages) < n:
        marked = blocks(author.page())
        if marked:
            pages.append([(text.replace(GOOD, "").replace(BAD, "").strip() or "x", above, linked) for text, above, linked in marked])
            labels.append([ARTICLE if GOOD in text else OTHER for text, _, _ in marked])
    return pages, labels


@lru_cache
def model(pages: int = PAGES, steps: int = STEPS) -> Crf:
    made, labels = labelled_pages(pages)
    return train([features(p) for p in made], labels, steps)


def main_text(html: str | None, crf: Crf) -> str:
    page = blocks(html or "")
    return "\n".join(text for (text, _, _), label in zip(page, crf.decode(features(page))) if label == ARTICLE)


def extract_text(pages: DataFrame, html: str = "html", to: str = "text", crf: Crf | None = None) -> DataFrame:
    """Adds the main text of every page: its article's blocks in page order, joined by one newline.

    Character references are decoded, white space within a block becomes one space, nothing else is dropped or
    capped. Null and empty pages, and pages of nothing but boilerplate, give an empty text. Rows repeat as they do
    in the input; a column of the new name is replaced. The model, of fixed size, is trained once on the driver
    from a bounded number of labelled pages and broadcast; no shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(crf or model())
    return map_texts(pages, html, lambda texts: {to: [main_text(t, shared.value) for t in texts]}, f"`{to}` string")
