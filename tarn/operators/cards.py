"""Listing cards: repeated elements that each hold one posting, and the link that is theirs alone.

Cards need the element tree, so they are found in Arrow batches; titles are then matched to cards in a join.
What a card is: an element with at least one sibling of the same tag and classes under one parent. Its link
is, of the addresses that no other card of the group has, the one whose anchor holds the heading, else the
one that goes deepest. Beyond the cases in the tests this is our own reading of what cards are.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.html import resolve_href
from tarn.functions.text import norm_text
from tarn.functions.url import _canonical
from tarn.operators.links import anchor_score

_SKIP = frozenset("script style noscript template svg iframe head".split())
_MOST_LINKS = 6
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CARD = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("href", "title", "text")]))


class Element:
    """A tag with its classes, link, children and text."""

    __slots__ = ("tag", "classes", "href", "children", "words", "parent")

    def __init__(self, tag: str, classes: tuple[str, ...], href: str | None, parent: Element | None):
        self.tag, self.classes, self.href, self.parent = tag, classes, href, parent
        self.children: list[Element] = []
        self.words: list[str | Element] = []

    def text(self) -> str:
        parts, stack = [], [iter(self.words)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    parts.append(x)
                else:
                    stack.append(iter(x.words))
                    break
            else:
                stack.pop()
        return " ".join(" ".join(parts).split())

    def walk(self):
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += reversed(e.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", (), None, None)
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag in ("li", "p") and self.at.tag == tag:
            self.at = self.at.parent
        got = dict(attrs)
        e = Element(tag, tuple(sorted((got.get("class") or "").split())), got.get("href") if tag == "a" else None, self.at)
        self.at.children.append(e)
        self.at.words.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        if not self.skip:
            self.at.words.append(data)


def tree(body: str) -> Element:
    """The element tree of a page, without what is never shown."""
    builder = _Builder()
    builder.feed(body)
    builder.close()
    return builder.root


def _depth(url: str) -> int:
    return sum(1 for s in url.split("?")[0].split("/")[3:] if s)


def card_links(body: str, base: str) -> list[dict]:
    """href, title and text of the cards of a page. Where groups nest, the outer one decides, unless its
    elements have more links of their own than a card would."""
    if "<" not in body:
        return []
    found: dict[str, dict] = {}
    inside_card: set[int] = set()
    for parent in tree(body).walk():
        if id(parent) in inside_card:
            continue
        groups: dict[tuple, list[Element]] = defaultdict(list)
        for child in parent.children:
            if child.tag != "a":
                groups[(child.tag, child.classes)].append(child)
        for cards in groups.values():
            if len(cards) < 2:
                continue
            links = []
            for card in cards:
                own = {}
                for e in card.walk():
                    url = _canonical(resolve_href(e.href, base), base) if e.href else None
                    if url:
                        own.setdefault(url, e)
                links.append(own)
            met = Counter(url for own in links for url in own)
            alone = sorted(sum(met[url] == 1 for url in own) for own in links)
            if not 0 < alone[len(alone) // 2] <= _MOST_LINKS:
                continue
            inside_card.update(id(e) for card in cards for e in card.walk())
            for card, own in zip(cards, links):
                heading = next((e for e in card.walk() if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), None)
                mine = {url: e for url, e in own.items() if met[url] == 1}
                if not mine:
                    continue
                inside = set() if heading is None else {id(x) for x in heading.walk()}

                def rank(item, heading=heading, inside=inside):
                    url, e = item
                    holds = heading is not None and (id(e) in inside or any(x is heading for x in e.walk()))
                    return (holds, _depth(url), len(e.text()))

                url, e = max(mine.items(), key=rank)
                title = heading.text() if heading is not None and rank((url, e))[0] else e.text()
                if title and url not in found:
                    found[url] = {"href": url, "title": title, "text": card.text()}
    return list(found.values())


@F.pandas_udf(_CARD)
def cards(body: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([card_links(b or "", u or "") for b, u in zip(body, base)])


def _stretches(text: Column, size: Column, space: Column) -> Column:
    """The distinct stretches of a text that have this many characters and their first space at this place (0: none)."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substr(text, at, size))
    return F.array_distinct(F.filter(every, lambda x: F.instr(x, " ") == space))


def match_cards(postings: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, pos, href, score of the postings that one card of their page is for.

    postings: page_id, pos, title, company; found: page_id, href, title, text. Titles are compared normalised;
    several cards of one title are told apart by the company in their text, and if that fails none is taken.

    Cards of one title are counted, not paired with its postings: a lone one is joined to them by title, and of
    several each is cut into the stretches that could be a company's name, which are counted and joined by name.
    """
    of, by_name = ["page_id", "key"], ["page_id", "key", "company"]
    a = postings.select("page_id", "pos", "title", F.coalesce(norm_text(F.col("company")), F.lit("")).alias("company"), norm_text(F.col("title")).alias("key")).filter("key != ''")
    b = found.select("page_id", "href", F.col("title").alias("card_title"), norm_text(F.col("text")).alias("card_text"), norm_text(F.col("title")).alias("key"))
    card = F.min(F.struct("href", "card_title")).alias("card")
    met = b.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), card)
    alone, several = met.filter("n = 1").select(*of, "card"), met.filter("n > 1").select(*of)
    names = a.filter("company != ''").select(*by_name).distinct().join(several, of, "left_semi")
    shapes = names.select(*of, F.length("company").alias("size"), F.instr("company", " ").alias("space")).distinct()
    cut = b.join(shapes, of).filter(F.length("card_text") >= F.col("size"))
    cut = cut.select(*of, "href", "card_title", F.explode(_stretches(F.col("card_text"), F.col("size"), F.col("space"))).alias("company"))
    named = cut.groupBy(*by_name).agg(F.count(F.lit(1)).alias("k"), card).filter("k = 1").select(*by_name, "card")
    taken = a.join(alone, of).select("page_id", "pos", "title", "card").unionByName(a.join(named, by_name).select("page_id", "pos", "title", "card"))
    return taken.select("page_id", "pos", "card.href", anchor_score(F.col("title"), F.col("card.card_title")).alias("score"))
