"""Main text of web pages by two-pass block rules.

First pass: the page is cut into blocks at block-level tags, and each block is
judged by itself: by where it stands (menus, forms, adverts, notices, comments
against an article), by the share of its characters in links, by its length
and by its share of stop words. Second pass: blocks too short to judge, and
those that were nearly good, take the label of the nearest decided neighbours.

Cases: null or empty html, or a page without main text, gives an empty text;
broken mark-up (unclosed tags, a cut-off page) is read as far as it goes;
repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Tags that end a block, tags without content of their own, and tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = "script|style|noscript|template|title|textarea|iframe|svg|math|canvas|object|audio|video|map"
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What marks boilerplate, as a tag, a role, or a name in a class or id.
ASIDE_TAGS = frozenset("nav aside footer form menu button select dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe subscription sidebar side menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended comment comments "
    "commentlist disqus reply replies respond login signup pagination pager widget toolbar copyright disclaimer "
    "hidden".split()
)
#: Words that may stand beside those in a name, as in `cookie-bar` or `site-footer`; other words make it another name.
BESIDE_WORDS = frozenset(
    "area bar block body bottom box btn button buttons container content element form global header icons inner item items "
    "left link links list main message outer overlay page panel policy post posts primary right secondary section site slot "
    "stories top unit wrap wrapper".split()
)
HEAD_WORDS = ASIDE_WORDS | {"header"}
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies".split())
ARTICLE_TAGS = frozenset(("article", "main"))
# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "there they this to was we were which who will with would you "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach "
    "nicht noch oder sich sie sind so und von war werden wie wird zu zum zur "
    "au aux avec ce cette ces dans de du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour "
    "que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos entre esta este fue ha hay la las lo los más no o para pero por que se ser sin sobre "
    "su sus también un una y ya".split()
)

MAX_LINK_SHARE = 0.3
SHORT_CHARS, LONG_CHARS = 70, 200
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.12, 0.22

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SILENT_TAGS})\b[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>"""
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _names_aside(name: str, known: frozenset[str] = ASIDE_WORDS) -> bool:
    """Whether one whole name of a class or id is such a word, or made of them and what stands beside them."""
    words = [word for word in re.split(r"[^a-z0-9]+", name) if word]
    return not known.isdisjoint(words) and all(word in known or word in BESIDE_WORDS or word.isdigit() for word in words)


def _stands_aside(tag: str, attributes: str, in_article: bool) -> str:
    """How a block stands aside: "all" it contains, "named" by a class or id, which an article inside ends; or not."""
    if tag in ASIDE_TAGS or (tag == "header" and not in_article):
        return "all"
    named = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "all"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "all"
        if name == "role" and value in ASIDE_ROLES:
            return "all"
        if tag in ("body", "html") or not (name == "class" or name == "id" and not in_article):
            continue
        names = value.split()
        if tag in ARTICLE_TAGS:
            named = named or ("named" if any(_names_aside(n, COMMENT_WORDS) for n in names) else "")
        elif any(_names_aside(n, ASIDE_WORDS if in_article else HEAD_WORDS) for n in names):
            named = "named"
    return named


class _Blocks:
    """Collects the blocks of a page: (text, characters in links, heading, aside, in an article)."""

    def __init__(self):
        self.found: list[tuple[str, int, bool, bool, bool]] = []
        self._open: list[tuple[str, str, bool]] = []
        self._pieces: list[tuple[str, bool]] = []
        self._linked = False

    def text(self, raw: str) -> None:
        if raw:
            self._pieces.append((raw, self._linked))

    def end_block(self) -> None:
        if not self._pieces:
            return
        text = " ".join(unescape("".join(raw for raw, _ in self._pieces)).split())
        if text:
            linked = sum(len(" ".join(unescape(raw).split())) for raw, link in self._pieces if link)
            tag, aside, article = self._open[-1] if self._open else ("", "", False)
            self.found.append((text, linked, tag in HEADINGS, bool(aside), article))
        self._pieces = []

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self._linked = True
            return
        if tag == "br":
            self.text(" ")
            return
        if tag not in BLOCK_TAGS:
            return
        self.end_block()
        if tag in VOID_TAGS or attributes.endswith("/"):
            return
        if self._open and self._open[-1][0] in ("p", *HEADINGS):
            self._open.pop()
        if tag in ("li", "option", "dt", "dd", "tr", "td", "th") and self._open and self._open[-1][0] == tag:
            self._open.pop()
        _, aside, article = self._open[-1] if self._open else ("", "", False)
        if aside == "named" and tag in ARTICLE_TAGS and not article:
            aside = ""
        if aside != "all":
            aside = _stands_aside(tag, attributes, article) or aside
        self._open.append((tag, aside, article or tag in ARTICLE_TAGS))

    def end(self, tag: str) -> None:
        if tag == "a":
            self._linked = False
        elif tag in BLOCK_TAGS:
            self.end_block()
            for k in range(len(self._open) - 1, -1, -1):
                if self._open[k][0] == tag:
                    del self._open[k:]
                    self._linked = False
                    break


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    out, at = _Blocks(), 0
    for token in _TOKEN.finditer(page):
        out.text(page[at : token.start()])
        at = token.end()
        closing, tag, attributes = token.group(2), token.group(3), token.group(4)
        if tag:
            out.end(tag.lower()) if closing else out.start(tag.lower(), attributes.rstrip())
    out.text(page[at:])
    out.end_block()
    return out.found


def label(text: str, linked: int, aside: bool, article: bool) -> str:
    """First pass: good, near, short or bad."""
    if aside or linked > MAX_LINK_SHARE * len(text):
        return "bad"
    if article:
        return "good"
    if len(text) < SHORT_CHARS:
        return "short"
    words = text.lower().split()
    share = sum(word.strip(".,;:!?()\"'") in STOP_WORDS for word in words) / len(words)
    if "©" in text and len(text) < LONG_CHARS or share < FEW_STOP_WORDS:
        return "bad"
    return "good" if share >= MANY_STOP_WORDS and len(text) >= LONG_CHARS else "near"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = [label(text, linked, aside, article) for text, linked, _, aside, article in found]
    before, last = [], None
    for word in labels:
        last = word if word in ("good", "bad") else last
        before.append(last)
    after, last = [], None
    for word in reversed(labels):
        last = word if word in ("good", "bad") else last
        after.append(last)
    after.reverse()
    if not any(word in ("good", "bad") for word in labels):
        before = after = ["good"] * len(labels)
    kept = []
    for (text, _, heading, _, _), word, left, right in zip(found, labels, before, after):
        near = {left, right} - {None}
        if word == "near" and ("good" in near or near == set()):
            word = "good"
        elif word == "short" and (near == {"good"} or heading and right == "good"):
            word = "good"
        if word == "good":
            kept.append(text)
    return "\n\n".join(kept)


def extract(df: DataFrame, html: str = "html", row_id: str = "page_id", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: the id, the columns of `also`, `text` and its length `n_chars` in code points."""

    def row(key, page, *rest):
        text = main_text(page)
        return (key, *rest, text, len(text))

    names = [f"also{k}" for k in range(len(also))]
    schema = pa.schema([*((n, pa.string()) for n in names), ("text", pa.string()), ("n_chars", pa.int64())])
    out = map_rows(
        df, [F.col(row_id), F.col(html), *(F.col(c).cast("string") for c in also)], row,
        ", ".join(["row_id", *(f"{n} string" for n in names), "text string", "n_chars long"]), schema, text_at=1,
    )
    return out.select(
        F.col("row_id").cast(df.schema[row_id].dataType).alias(row_id),
        *(F.col(n).cast(df.schema[c].dataType).alias(c) for n, c in zip(names, also)), "text", "n_chars",
    )
