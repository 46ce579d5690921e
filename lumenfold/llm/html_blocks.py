"""Leaf blocks of a web page: a forgiving one-pass reader of tags.

A block is the text between two borders of block-level elements, with inline markup taken
out and white space made single. It knows which kinds of ancestors it stands in, and which
the nearest one is, told from tag names and from the words of class, id and role. A word tells
a kind as a whole, or by its last part: ``site-header`` is a header, ``header-fixed`` and
``has-header`` are not. Words on the page's own elements, html and body, tell nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SKIP = frozenset("script style noscript template textarea select svg iframe object canvas title button".split())
RAW = frozenset("script style textarea title iframe".split())
#: Kinds of ancestors by tag name, and by word of class, id or role.
TAG_KIND = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form",
    "article": "article", "main": "main", "figure": "figure", "table": "table", "ul": "list", "ol": "list",
    "dialog": "notice", "blockquote": "quote", "fieldset": "form", "head": "head",
}
WORD_KIND = {
    w: kind
    for kind, words in {
        "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
        "header": "header masthead topbar branding logo site-header",
        "footer": "footer copyright colophon legal site-footer contentinfo",
        "side": "sidebar side aside widget related recommended popular trending more-stories complementary tags share social sharing",
        "notice": "notice cookie cookies consent gdpr banner alert popup modal overlay dialog newsletter paywall alertdialog",
        "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp",
        "form": "form search signup login subscribe subscription contact",
        "comments": "comment comments commentlist comment-list disqus discussion reply replies respond reader-comments",
        "article": "article post story entry hentry article-body post-content entry-content story-body articlebody",
        "main": "main content main-content body-content",
    }.items()
    for w in words.split()
}
#: Kinds that the last part of a word tells; the others take the whole word.
BY_PART = frozenset("menu header footer side notice advert comments".split())
#: First parts of words that say something else about the element: what it has, lacks or is filed under.
FILED = frozenset("has have with without no not is hide show hidden sticky toggle category tag type format status page post-type".split())
#: Elements whose open tags may stand without a closing one before the next.
ALONE = frozenset("button select".split())
WHOLE_PAGE = frozenset(("html", "body"))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE, _PART = re.compile(r"\s+"), re.compile(r"[-_]+")


@dataclass
class Block:
    text: str
    tag: str
    kinds: frozenset[str]
    near: frozenset[str] = frozenset()
    chars: int = 0
    linked: int = 0


def word_kind(word: str) -> str | None:
    """The kind that a word of class, id or role tells."""
    if word in WORD_KIND:
        return WORD_KIND[word]
    parts = _PART.split(word)
    if len(parts) < 2 or parts[0] in FILED:
        return None
    if parts[0] == "comment":
        return "comments"
    kind = WORD_KIND.get(parts[-1])
    return kind if kind in BY_PART else None


def _kinds(name: str, attributes: str) -> frozenset[str]:
    if name in WHOLE_PAGE:
        return frozenset()
    found = {TAG_KIND[name]} if name in TAG_KIND else set()
    for m in _ATTR.finditer(attributes):
        for word in _SPACE.split((m[2] or m[3] or m[4] or "").lower()):
            if kind := word_kind(word):
                found.add(kind)
    return frozenset(found)


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the tag that opens before ``at`` closes, quotes respected; -1 if nowhere.

    A quote without a partner counts for nothing; ``missing`` remembers it, so that no
    later tag looks for it again.
    """
    first = end = page.find(">", at)
    while end >= 0:
        open_quote, i = "", at
        while i < end:
            quotes = [x for x in (page.find('"', i, end), page.find("'", i, end)) if x >= 0]
            if not quotes:
                break
            q = page[min(quotes)]
            close = page.find(q, min(quotes) + 1) if q not in missing else -1
            if close < 0:
                missing.add(q)
                return first
            if close > end:
                open_quote, i = q, close + 1
                break
            i = close + 1
        if not open_quote:
            return end
        at, end = i, page.find(">", i)
    return first


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; a page that ends early gives what it has."""
    out: list[Block] = []
    # Of each open element: tag, kinds of it and its ancestors, kinds of the nearest that has
    # some, whether it is inside a link, and the place of the nearest block-level element.
    stack: list[tuple[str, frozenset[str], frozenset[str], bool, int]] = [("", frozenset(), frozenset(), False, 0)]
    opened: dict[str, int] = {}
    text: list[str] = []
    linked, skipped = 0, 0
    missing: set[str] = set()
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            _, kinds, near, _, block = stack[-1]
            out.append(Block(whole, stack[block][0], kinds, near, len(whole), min(linked, len(whole))))
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal skipped
        name = stack.pop()[0]
        opened[name] -= 1
        skipped -= name in SKIP

    def ends(name: str, at: int) -> bool:
        """Whether an element that opens before ``at`` has an end tag of its own."""
        if name in unclosed:
            return False
        stop = re.compile(rf"</{name}\b", re.I).search(page, at)
        if not stop:
            unclosed.add(name)
            return False
        return name not in ALONE or not re.compile(rf"<{name}\b", re.I).search(page, at, stop.start())

    at, size = 0, len(page)
    mute = False  # behind an open tag of SKIP without an end tag: its text goes up to the next tag
    while at < size:
        lt = page.find("<", at)
        piece = page[at : lt if lt >= 0 else size]
        if piece and not skipped and not mute:
            decoded = html.unescape(piece) if "&" in piece else piece
            text.append(decoded)
            if stack[-1][3]:
                linked += len(decoded)
        mute = False
        if lt < 0:
            break
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            continue
        closing = following == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                if not skipped:
                    text.append("<")
                at = lt + 1
            continue
        name = m[0].lower()
        end = _tag_end(page, m.end(), missing)
        if end < 0:
            break  # the page is cut inside a tag
        at = end + 1
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE and name not in SKIP:
            close()
        if closing:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in SKIP and name not in RAW and not ends(name, at):
            mute = True
            continue
        block = stack[-1][4]
        if name not in INLINE and name not in SKIP and stack[block][0] == "p":
            # A paragraph ends where the next block begins.
            while len(stack) > block:
                pop()
        _, above, near, link, block = stack[-1]
        kinds = _kinds(name, page[m.end() : end])
        entry = (name, above | kinds if kinds else above, kinds or near, link or name == "a", block if name in INLINE else len(stack))
        stack.append(entry)
        opened[name] = opened.get(name, 0) + 1
        skipped += name in SKIP
        if name in RAW:
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = stop.start() if stop else size
    close()
    return out
