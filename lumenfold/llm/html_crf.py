"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Every block is content or not. Its features are the kinds of its ancestors, its tag and the
look of its text; the chain adds what follows what. The field is trained here, on labelled
pages that are laid out from parts in many ways, by gradient ascent on the exact likelihood
(forward-backward over padded batches), and decoded by Viterbi.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import text_of
from lumenfold.llm.html_blocks import Block, blocks

PAGES, STEPS, RATE, PENALTY, SEED = 320, 160, 0.15, 1e-3, 7
#: The features a block can have; the model is a weight for each.
KINDS = "menu header footer side notice advert form comments article main figure table list quote head".split()
TAGS = "p h1 h2 h3 h4 h5 h6 li td th dt dd div section article pre blockquote figcaption body other".split()
LOOKS = (
    "bias words<4 words<10 words<25 words>=25 linked>0.3 linked>0.8 sentence marks copyright question "
    "first last near_start near_end"
).split()
FEATURES = {f: i for i, f in enumerate([f"in {k}" for k in KINDS] + [f"near {k}" for k in KINDS] + [f"tag {t}" for t in TAGS] + LOOKS + ["plain"])}


def features(found: list[Block]) -> list[list[int]]:
    """Feature numbers of every block of a page."""
    out, n = [], len(found)
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        names = ["bias", f"tag {b.tag if b.tag in TAGS else 'other'}", *(f"in {k}" for k in b.kinds), *(f"near {k}" for k in b.near)]
        names.append("words<4" if words < 4 else "words<10" if words < 10 else "words<25" if words < 25 else "words>=25")
        share = b.linked / b.chars
        names += ["linked>0.3"] * (share > 0.3) + ["linked>0.8"] * (share > 0.8)
        names += ["sentence"] * b.text.endswith((".", "!", "?", "…", '"', "”", "»")) + ["marks"] * ("," in b.text)
        names += ["copyright"] * ("©" in b.text) + ["question"] * b.text.endswith("?")
        names += ["first"] * (i == 0) + ["last"] * (i == n - 1) + ["near_start"] * (i < 3) + ["near_end"] * (i >= n - 3)
        names += ["plain"] * (not b.kinds)
        out.append([FEATURES[f] for f in names])
    return out


# ---- labelled pages ---------------------------------------------------------


class _Writer:
    """Lays out labelled pages. Content words carry a mark that tells the label."""

    MARK = "￼"

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, lo: int, hi: int, stop: str = "") -> str:
        r = self.rng
        syllables = ("ka", "lo", "mi", "ren", "tas", "vo", "shi", "dur", "el", "pon", "qua", "zi", "ber", "no")
        out = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        for i in range(len(out) - 1):
            if r.random() < 0.08:
                out[i] += ","
        return " ".join(out).capitalize() + stop

    def main(self, lo: int, hi: int, stop: str = "") -> str:
        return self.MARK + self.words(lo, hi, stop)

    def attr(self, *classes: str) -> str:
        r = self.rng
        name = r.choice(classes)
        return r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} x{r.randint(1, 99)}"'))

    def menu(self) -> str:
        r = self.rng
        links = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(r.randint(2, 9)))
        return r.choice((f"<nav><ul>{links}</ul></nav>", f"<ul{self.attr('menu', 'nav', 'navbar', 'breadcrumb')}>{links}</ul>"))

    def side(self) -> str:
        r = self.rng
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(
            r.choice((f"<p>{self.words(4, 30, '.')}</p>", f'<li><a href="#">{self.words(3, 9)}</a></li>')) for _ in range(r.randint(1, 5))
        )
        return r.choice((f"<aside>{inner}</aside>", f"<div{self.attr('sidebar', 'widget', 'related', 'share', 'recommended')}>{inner}</div>"))

    def advert(self) -> str:
        return f"<div{self.attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'advertisement')}>{self.words(3, 25, '.')}</div>"

    def notice(self) -> str:
        inner = f"<p>{self.words(6, 30, '.')}</p>" + self.rng.choice(("", f"<a href='#'>{self.words(1, 3)}</a>"))
        return f"<div{self.attr('notice', 'cookie', 'consent', 'cookie-banner', 'newsletter', 'alert')}>{inner}</div>"

    def form(self) -> str:
        return f"<form action='/go'><label>{self.words(1, 4)}</label><input name=q><p>{self.words(3, 15, '.')}</p></form>"

    def comments(self) -> str:
        one = lambda: f"<div class='comment'><p>{self.words(1, 2)}</p><p>{self.words(4, 40, '.')}</p></div>"
        inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 6)))
        return self.rng.choice((f"<section{self.attr('comments', 'discussion', 'reader-comments')}>{inner}</section>", f"<div{self.attr('comments', 'comment-list', 'replies')}>{inner}</div>"))

    def header(self) -> str:
        inner = f"<h2><a href='/'>{self.words(1, 3)}</a></h2><p>{self.words(2, 8)}</p>"
        return self.rng.choice((f"<header>{inner}</header>", f"<div{self.attr('header', 'masthead', 'topbar')}>{inner}</div>"))

    def footer(self) -> str:
        inner = f"&copy; {self.words(1, 3)} &middot; {self.words(3, 25, '.')}"
        return self.rng.choice((f"<footer>{inner}</footer>", f"<footer><p>{inner}</p>{self.menu()}</footer>", f"<div{self.attr('footer', 'legal', 'copyright')}><p>{inner}</p></div>"))

    def theme(self) -> str:
        """Classes that speak of other parts of the page, as themes put them on any element."""
        r = self.rng
        words = ("has-sidebar", "no-sidebar", "with-ads", "search-open", "sticky-header", "share-enabled", "comments-open", "header-fixed", "category-news", "page-header-wrapper", "footer-dark", "wide", "is-menu-open")
        return f' class="{" ".join(r.sample(words, r.randint(1, 3)))}"'

    def linked(self, text: str) -> str:
        """A paragraph of the article in which a link has most of the text, or all of it."""
        r = self.rng
        return r.choice((f"<p>{self.main(1, 4)} <a href=/x/>{text}</a></p>", f'<p><a href="#">{text}</a></p>', f"<p>{text} <a href='/y'>{self.words(1, 5)}</a> {self.words(1, 20, '.')}</p>"))

    def story(self) -> str:
        r = self.rng
        parts = [f"<h1>{self.main(1, 12, r.choice(('', '', '.')))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice((0, 1, 2, 4, 8, 14))):
            stop = r.choice((".", ".", ".", "", "!", "?"))
            text = self.main(1, r.choice((3, 8, 30, 80)), stop)
            parts.append(
                r.choice((f"<p>{text}</p>",) * 8 + (f"<p><b>{text}<br>", f"<div>{text}</div>", f"<h2>{self.main(1, 8)}</h2>", f"<ul><li>{text}</li><li>{self.main(2, 20)}</li></ul>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<table><tr><td>{text}<td>{self.main(1, 4)}</table>"))
            )
            if r.random() < 0.12:
                parts.append(self.linked(self.main(6, 30, stop)))
            if r.random() < 0.06:
                parts.append(r.choice((self.advert, self.side, self.form))())
        if r.random() < 0.12:
            parts.append(self.comments())
        inner = "".join(parts)
        if r.random() < 0.3:
            return r.choice((f"<article{self.theme()}>{inner}</article>", f"<div{self.theme()}><article>{inner}</article></div>", f"<div{self.theme()}><div{self.theme()}>{inner}</div></div>"))
        return r.choice(
            (f"<article>{inner}</article>",) * 4
            + (f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{self.attr('content', 'article', 'post', 'entry-content', 'story')}>{inner}</div>", f"<div>{inner}</div>")
        )

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.12:
            return self.story()  # nothing but the article
        before = [f for f in (self.header, self.menu, self.notice, self.advert, self.form) if r.random() < 0.45]
        after = [f for f in (self.side, self.comments, self.advert, self.form, self.notice) if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        body = "".join(f() for f in before) + self.story() + "".join(f() for f in after)
        body += self.footer() if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[list[tuple[Block, int]]]:
    """Pages as lists of blocks with label 1 for content."""
    writer, out = _Writer(random.Random(seed)), []
    while len(out) < n:
        found = blocks(writer.page())
        labels = [int(_Writer.MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(_Writer.MARK, "")
            b.chars = len(b.text)
        if found:
            out.append(list(zip(found, labels, strict=True)))
    return out


# ---- the field --------------------------------------------------------------


def padded(pages: list[list[tuple[Block, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, mask) of pages, padded to the longest."""
    longest, size = max(map(len, pages)), len(FEATURES)
    x = np.zeros((len(pages), longest, size), dtype=np.float32)
    y = np.zeros((len(pages), longest), dtype=np.int64)
    mask = np.zeros((len(pages), longest), dtype=bool)
    for i, page in enumerate(pages):
        for t, f in enumerate(features([b for b, _ in page])):
            x[i, t, f] = 1
        y[i, : len(page)] = [label for _, label in page]
        mask[i, : len(page)] = True
    return x, y, mask


def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of the mean log likelihood less the penalty, by forward and backward sums."""
    n, longest, size = x.shape
    both = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    w, moves = theta[:size], theta[size:].reshape(2, 2)
    emit = np.zeros((n, longest, 2))
    emit[:, :, 1] = x @ w.astype(np.float32)
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, longest):
        go = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + emit[:, t]
        alpha[:, t] = np.where(mask[:, t, None], go, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        nxt = emit[:, t + 1] + beta[:, t + 1]
        go = np.logaddexp(moves[:, 0] + nxt[:, 0, None], moves[:, 1] + nxt[:, 1, None])
        beta[:, t] = np.where(mask[:, t + 1, None], go, 0.0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None])
    grad = np.zeros_like(theta)
    grad[:size] = ((y - p) * mask).ravel() @ x.reshape(-1, size)
    for a in (0, 1):
        for b in (0, 1):
            pair = alpha[:, :-1, a] + moves[a, b] + emit[:, 1:, b] + beta[:, 1:, b] - total[:, None]
            grad[size + 2 * a + b] = seen[a, b] - np.exp(pair[both]).sum()
    return grad / n - PENALTY * theta


def fit(pages: list[list[tuple[Block, int]]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves): the weight of each feature for content, and the score of going
    from one label to the next."""
    given, size = padded(pages), len(FEATURES)
    theta = np.zeros(size + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = gradient(theta, *given)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:size], theta[size:].reshape(2, 2)


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """The field fitted on the labelled pages; the same numbers in every process."""
    return fit(labelled_pages())


def decode(found: list[Block], weights: list[float], moves: list[list[float]]) -> list[int]:
    """The likeliest labels of a page's blocks (Viterbi)."""
    back, no, yes = [], 0.0, 0.0
    for t, f in enumerate(features(found)):
        e = sum(weights[i] for i in f)
        if t == 0:
            no, yes = 0.0, e
            continue
        a0, a1, b0, b1 = no + moves[0][0], yes + moves[1][0], no + moves[0][1], yes + moves[1][1]
        back.append((int(a1 > a0), int(b1 >= b0)))
        no, yes = max(a0, a1), max(b0, b1) + e
    labels = [int(yes > no)] if found else []
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(page: str, weights: list[float], moves: list[list[float]]) -> str:
    """Content blocks joined by line breaks; '' if there are none."""
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, decode(found, weights, moves), strict=True) if label)


def extract(df: DataFrame, field=None, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row.

    NULL and empty pages have an empty text. Ids and urls pass through as they are, NULL
    and repeated ones too; other columns are not read.
    """
    weights, moves = (a.tolist() for a in (field or model()))
    three = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), text_of(html_col).alias("html"))
    kinds = [three.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            texts = [main_text(t.as_py() or "", weights, moves) for t in batch.column(2)]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return three.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
