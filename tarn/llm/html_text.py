"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Each has a score, its log-odds of being content: words score
positive and tags negative by nature, how much depends on what they stand in. One linear scan finds the
contiguous region of the greatest total. Inside it, elements that are no content (menus, forms, notices,
comments) are left out, and the rest is cut into blocks.

An element that its tag or a whole word of its class, id or role calls something else (an aside, an advert, a form) is left out,
however long it is, unless it is around the page; a header that holds the title is not. Of others a sum of log-odds
decides: of the tag, of words that are part of a name, and of what is held (sentences, links). Inside of an article,
which is what is called one or where the title stands together with text, nothing is left out for being short.

All weights are learned when the module is loaded, from labelled pages: layouts put together at random, with names
from lists in several languages, with names that say nothing, and with none.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from random import Random
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.common import small_batches

#: Elements by what they mean for a page's layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea title svg iframe canvas object math head"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
OUT_TAGS = frozenset("nav menu footer aside form button select fieldset dialog search label header".split())
IN_TAGS = frozenset("article main".split())
#: Elements that are asked about whatever their names; others only if their class, id or role says something.
ASKED = OUT_TAGS | IN_TAGS | frozenset("div section table ul ol".split())
#: Words in class, id and role attributes, by the part of the page that they name.
OUT_WORDS = {
    "menu": "nav navbar navigation menu menubar menü menue breadcrumb breadcrumbs pagination pager toc skip tabs tags toolbar",
    "head": "header masthead banner topbar site-header page-header kopfzeile cabecera logo branding",
    "foot": "footer foot fußzeile fusszeile pie-de-pagina copyright impressum site-footer page-footer colophon contentinfo legal",
    "side": "sidebar side aside seitenleiste rail related recommended recommendations widget widgets trending popular complementary also more-stories verwandt articles-lies relacionados",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adslot ad-slot ad-box ad-banner banner-ad sponsor sponsored promo promotion promoted werbung anzeige publicité publicite pub publicidad anuncio",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter paywall dialog toast hinweis avis aviso",
    "form": "form login signup signin subscribe subscription search searchbox contact-form suche anmeldung recherche connexion buscar",
    "comment": "comment comments commentlist comment-list disqus responses replies reply discussion respond kommentar kommentare kommentarbereich leserkommentare commentaire commentaires comentario comentarios opiniones",
    "social": "share sharing social socials follow share-buttons social-links byline-share teilen partager compartir",
}
IN_WORDS = "article content post entry main story body text article-body post-body entry-content post-content main-content story-body article-content artikel inhalt beitrag contenu contenido articulo"
_OUT = {word: part for part, words in OUT_WORDS.items() for word in words.split()}
_IN = frozenset(IN_WORDS.split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(RAW.split()) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
# An element closed by the next one of its kind.
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())


_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li".split())
_LISTS = ({"tag ul"}, {"tag ol"}, {"tag table"})


class Piece(NamedTuple):
    """A run of words in one place, or a tag (words 0); element: the innermost one; block: its number."""

    words: int
    text: str
    link: bool
    tag: str
    block: int
    element: int


class Element:
    """An element with the features of its name, what it holds, and the element around it (-1: the page)."""

    __slots__ = ("above", "named", "words", "linked", "stops", "paragraphs", "titles", "heading", "inner", "label")

    def __init__(self, above: int, named: tuple[str, ...], paragraphs: int, label: str):
        self.above, self.named, self.paragraphs, self.label = above, named, paragraphs, label
        self.words = self.linked = self.stops = self.titles = 0  # titles: the h1 that are held, or the element itself


@cache
def _named(name: str, rest: str) -> tuple[str, ...]:
    """The features of a tag and its attributes; none for an element that is as what it stands in."""
    found = {f"tag {name}" if name in ASKED or name in ("p", "li", "span") else "tag other"}
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            found.add("hidden")
        elif key in ("class", "id", "role") and name not in ("body", "html"):
            for word in value.split():
                # A name that is one word of the lists says more than one that has such a word among others.
                parts = re.split(r"[-_]+", word)
                if word in _IN:
                    found.add("in")
                elif word in _OUT or all(x in _OUT for x in parts):
                    found.add("out " + _OUT.get(word, _OUT.get(parts[0], "")))
                elif parts[-1] in _IN:
                    found.add("part in")
                else:
                    found.update("part out " + ("first" if k == 0 else "last") for k in (0, len(parts) - 1) if parts[k] in _OUT and len(parts) > 1)
    return tuple(sorted(found)) if name in ASKED or len(found) > 1 else ()


def _features(e: Element, most: int) -> tuple[str, ...]:
    """All features of an element; none if it is as what it stands in. most: an element of so many words, in
    paragraphs, holds the better part of the page."""
    if not e.named or (2 * e.linked <= e.words and set(e.named) in _LISTS):
        return ()
    if not e.words:
        return (*e.named, "holds nothing")
    linked = e.linked / e.words
    size = "little" if e.words < 12 else "some" if e.words < 60 else "much"
    said = "linked" if linked > 0.5 else "sentences" if e.stops >= 2 and e.stops * 40 >= e.words else "phrases"
    named = e.named
    if e.words >= most and e.paragraphs > 1 and "tag article" not in named and "tag main" not in named:
        named = tuple(f + " around the page" if f.startswith("tag ") else f for f in named)
    return (*named, f"holds {size}", f"holds {said}", f"holds {size} {said}")


def _most(elements: list[Element]) -> int:
    return max(1, int(0.8 * sum(e.words for e in elements if e.above < 0)))


def parsed(page: str) -> tuple[list[Piece], list[Element]]:
    """The page's words and tags in order, and its elements. Scripts, styles and the like, and comments, are left out.
    Open elements are counted by name, so the time is linear in the page."""
    out: list[Piece] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()
    block, at = 0, 0

    def text(low: int, high: int) -> None:
        if low < high:
            plain = html.unescape(page[low:high])
            words = plain.split()
            if stack:
                e = elements[stack[-1][1]]
                e.words += len(words)
                e.linked += len(words) if open_["a"] else 0
                e.stops += sum(w[-1] in ".!?…" for w in words)
            out.append(Piece(len(words), plain, open_["a"] > 0, "", block, stack[-1][1] if stack else -1))

    def pop() -> str:
        name, i = stack.pop()
        open_[name] -= 1
        e = elements[i]
        if e.above >= 0:  # what is held is held by the element around it too
            a = elements[e.above]
            a.words, a.linked, a.stops, a.paragraphs, a.titles = a.words + e.words, a.linked + e.linked, a.stops + e.stops, a.paragraphs + e.paragraphs, a.titles + e.titles
        return name

    for m in _TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            block += 1
        elif name == "br":
            out.append(Piece(0, " ", open_["a"] > 0, "br", block, stack[-1][1] if stack else -1))
            continue
        out.append(Piece(0, "", open_["a"] > 0, ("/" if m["close"] else "") + name, block, stack[-1][1] if stack else -1))
        if m["close"]:
            if open_[name]:
                while pop() != name:
                    pass
        elif name not in VOID and not m["rest"].endswith("/"):
            if name in _SELF_CLOSING and stack and stack[-1][0] == name:
                pop()
            elif name == "p" and any(x == "p" for x, _ in stack[-4:]):
                while pop() != "p":
                    pass
            label = m["rest"][-1:] if m["rest"][-2:] in ("\x01+", "\x01-") else ""
            elements.append(Element(stack[-1][1] if stack else -1, _named(name, m["rest"].rstrip("\x01+-") if label else m["rest"]), int(name in _PARAGRAPHS), label))
            elements[-1].titles = int(name == "h1")
            elements[-1].heading, elements[-1].inner = name == "h1", name not in ("body", "html")
            stack.append((name, len(elements) - 1))
            open_[name] += 1
    text(at, len(page))
    while stack:
        pop()
    return out, elements


#: Where an element stands: outside of any article, in one, in what is left out inside of one, or in what is left
#: out around it.
OWN, ARTICLE, WITHIN, AROUND = range(4)


def homes(elements: list[Element]) -> set[int]:
    """The elements in which a title stands together with text: of each h1 the innermost one around it that holds
    paragraphs besides titles, unless that is the body."""
    near: list[int] = []  # of each element, itself or the innermost one around it that holds such paragraphs
    for i, e in enumerate(elements):
        near.append(i if e.paragraphs > e.titles else near[e.above] if e.above >= 0 else -1)
    found = {near[e.above] for e in elements if e.heading and e.above >= 0}
    return {i for i in found if i >= 0 and elements[i].inner}


def told(e: Element, place: int, most: int, titles: int) -> bool | None:
    """Whether an element is left out by what it is called; None if that says nothing. most: see _features; titles: of the page."""
    if "hidden" in e.named:
        return True
    parts = {f[4:] for f in e.named if f.startswith("out ")}
    tags = {f[4:] for f in e.named if f.startswith("tag ")} & OUT_TAGS
    if not (parts or tags) or "in" in e.named:
        return None
    linked = 2 * e.linked > e.words
    if e.words >= most and (e.titles or (parts <= {"form", "head"} and e.paragraphs > 1)):
        return False
    if parts <= {"head"} and tags <= {"header"}:
        if place == ARTICLE and (e.titles or not parts) and not linked:
            return False
        if e.titles and e.titles == titles and not linked:  # the page has no title but in it
            return False
    return True


def places(elements: list[Element], weights: dict[str, float]) -> list[int]:
    """Each element's place. An element is left out with all that it holds if it is told to be, or else if its log-odds are
    negative; one without features stands where the one around it does. What is kept and called or marked as an
    article is one, and so is where the title stands together with text."""
    out: list[int] = []
    most, home = _most(elements), homes(elements)
    titles = sum(e.titles for e in elements if e.above < 0)
    for i, e in enumerate(elements):  # an element comes after the one around it
        place = out[e.above] if e.above >= 0 else OWN
        if place in (OWN, ARTICLE):
            left = told(e, place, most, titles)
            found = _features(e, most) if left is None else ()
            if found and not e.titles:
                plain = place == ARTICLE and not any(f.startswith(("out ", "part out")) for f in e.named)
                # Inside of an article what has no telling name is left out for its links alone.
                left = weights["prior"] + sum(weights.get(f, 0.0) for f in found) < 0 and not (plain and 2 * e.linked <= e.words)
            if left:
                place = WITHIN if place == ARTICLE else AROUND
            elif i in home or "tag article" in e.named or "tag main" in e.named or "in" in e.named:
                place = ARTICLE
        out.append(place)
    return out


# --- what is learned -------------------------------------------------------------------------------


def labelled_pages(n: int = 240, seed: int = 5) -> list[str]:
    """Pages put together at random; the label of an element, + or -, ends its attributes after a \x01."""
    rng = Random(seed)
    out_names = {part: words.split() for part, words in OUT_WORDS.items()}
    in_names = IN_WORDS.split()
    dull = "wrap box inner row col-md-8 container c1 css-1a2b grid block module page outer unit left teaser lead".split()

    def words(k: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(k))

    def prose(k: int) -> str:
        return " ".join(words(rng.randint(6, 18)).capitalize() + "." for _ in range(k))

    def tag(name: str, names: list[str], label: str) -> str:
        kind = rng.random()
        chosen = rng.choice(dull) if kind < 0.85 else ""
        if names and kind < 0.7:
            chosen = rng.choice(names)
            chosen = chosen if kind < 0.5 else f"{rng.choice(dull)}-{chosen}" if kind < 0.6 else f"{chosen}-{rng.choice(dull)}"
        rest = f' {rng.choice(["class", "id"])}="{chosen}"' if chosen else ""
        return f"<{name}{rest} \x01{label}>"

    def misleading() -> list[str]:
        """Names of content that have a word of the other lists among others."""
        part = rng.choice(list(out_names))
        return [f"{rng.choice(out_names[part])}-{words(1)}", f"{words(1)}-{rng.choice(out_names[part])}"]

    def linked(k: int) -> str:
        return "".join(f"<li><a href='/'>{words(rng.randint(1, 4))}</a></li>" for _ in range(k))

    def around(part: str) -> str:
        kinds = {
            "menu": lambda: (rng.choice(["nav", "div", "ul"]), linked(rng.randint(3, 9))), "head": lambda: (rng.choice(["header", "div"]), f"<a href='/'>{words(2)}</a>"),
            "foot": lambda: (rng.choice(["footer", "div"]), words(rng.randint(3, 14))), "side": lambda: (rng.choice(["aside", "div"]), f"<h3>{words(2)}</h3>" + linked(rng.randint(2, 6))),
            "ad": lambda: (rng.choice(["div", "section"]), rng.choice([words(rng.randint(2, 12)), prose(1)])), "notice": lambda: (rng.choice(["div", "dialog"]), prose(rng.randint(1, 2)) + "<button>Ok</button>"),
            "form": lambda: (rng.choice(["form", "div"]), f"<label>{words(2)}</label><input>"), "comment": lambda: ("div", "".join(f"<div><b>{words(1)}</b><p>{prose(rng.randint(1, 4))}</p></div>" for _ in range(rng.randint(1, 6)))),
            "social": lambda: ("div", linked(rng.randint(1, 4))),
        }
        name, body = kinds[part]()
        # Reader comments read like content; without a name nothing tells them apart.
        head = f'<{name} class="{rng.choice(out_names[part])}" \x01->' if part == "comment" else tag(name, out_names[part], "-")
        return head + body + f"</{name}>"

    def article() -> str:
        parts = [f"<h1 \x01+>{words(rng.randint(2, 7))}</h1>"]
        for _ in range(rng.randint(2, 9)):
            kind = rng.random()
            if kind < 0.65:
                link = f"<a href='/'>{words(rng.randint(1, 4))}</a> " if rng.random() < 0.4 else ""
                parts.append(f"<p \x01+>{link}{prose(rng.randint(1, 6))}</p>")
            elif kind < 0.75:
                name = rng.choice(["p", "section", "div"])
                parts.append(tag(name, misleading(), "+") + rng.choice([words(rng.randint(3, 9)), prose(rng.randint(1, 6))]) + f"</{name}>")
            elif kind < 0.8:
                parts.append("<ul \x01+>" + "".join(f"<li \x01+>{words(rng.randint(2, 9))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.84:
                parts.append(f"<table \x01+><tr><td \x01+>{words(2)}</td><td \x01+>{words(3)}</td></tr></table>")
            else:
                parts.append(around(rng.choice(["ad", "social", "side", "notice", "form"])))
        name = rng.choice(["article", "div", "div", "section", "main"])
        return tag(name, in_names, "+") + "".join(parts) + f"</{name}>"

    pages = []
    for _ in range(n):
        body = [around(p) for p in ("head", "menu", "notice", "ad", "social") if rng.random() < 0.6] + [article()] + [around(p) for p in ("comment", "side", "form", "foot") if rng.random() < 0.6]
        inner = "".join(body)
        if rng.random() < 0.5:
            name = rng.choice(["div", "div", "form", "table", "section"])
            inner = tag(name, rng.choice([in_names, dull, [words(1) + "-form"]]), "+") + inner + f"</{name}>"
        pages.append(f"<html><body>{inner}</body></html>")
    return pages


def learned(pages: list[str]) -> tuple[dict[str, float], dict[tuple, float]]:
    """(the log-odds of elements' features, those of kinds of pieces). Kinds of words start from a count in favour of
    content, kinds of tags from one against it."""
    inside, outside, good, bad = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        found, elements = parsed(page)
        label, most = [], _most(elements)
        for e in elements:
            above = label[e.above] if e.above >= 0 else "+"
            label.append("-" if above == "-" else e.label or above)
            features = _features(e, most) if e.label else ()  # what is left out with the one around it is not asked about
            if features:
                (good if e.label == "+" else bad).update(("all", *features))
        for x in found:
            (inside if x.element >= 0 and label[x.element] == "+" else outside)[kind(x)] += x.words or 1
    prior = math.log(good["all"] / bad["all"])
    features = {f: math.log((good[f] + 0.5) / (good["all"] + 1)) - math.log((bad[f] + 0.5) / (bad["all"] + 1)) for f in {*good, *bad} - {"all"}}
    every = {*inside, *outside}
    kinds = {k: math.log((inside[k] + (2 if k[0] == "word" else 1)) / (outside[k] + (1 if k[0] == "word" else 2))) for k in every}
    return features | {"prior": prior, "hidden": -20.0}, kinds


def kind(piece: Piece) -> tuple:
    """What a piece's score depends on, beside its place."""
    if piece.words:
        return ("word", piece.link)
    name = piece.tag.lstrip("/")
    return ("tag", name if name in ("p", "a", "br", "li", "div", "h1", "h2") else "other")


WEIGHTS, KINDS = learned(labelled_pages())
#: What an article's title counts more than its words: the tags between it and the text are many.
TITLE = 5.0


def score(piece: Piece, place: int) -> float:
    """The total of a piece's words, or the tag's score. Words are positive and tags negative, except for words
    around the content. What is left out inside of an article counts nothing: what stands before and after it
    belongs together. Words in links are content only inside of an article."""
    if place == WITHIN:
        return 0.0
    value = KINDS.get(kind(piece), 0.5 if piece.words else -0.5)
    if not piece.words:
        return max(-0.5, min(value, -0.05))
    return piece.words * (-1.0 if place == AROUND else max(0.1 if place == ARTICLE else -1.0, min(value, 1.0)))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, after) of the contiguous stretch of the greatest total; the earliest and longest of equals.
    (0, 0) if no score is positive."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0 or i == 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and start == low):
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str) -> str:
    """The main text: blocks joined by two line ends, white space inside a block as one space."""
    found, elements = parsed(page)
    place = [*places(elements, WEIGHTS), OWN]  # -1: the page
    title = [e.heading for e in elements] + [False]
    low, high = best_region([score(x, place[x.element]) + (TITLE if x.words and title[x.element] and place[x.element] == ARTICLE else 0.0) for x in found])
    if low == high:
        return ""
    # Blocks that the region's ends cut are taken whole.
    first, last = found[low].block, found[high - 1].block
    blocks: dict[int, list[str]] = {}
    for x in found:
        if first <= x.block <= last and place[x.element] <= ARTICLE and x.text:
            blocks.setdefault(x.block, []).append(x.text)
    return "\n\n".join(t for t in (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values()) if t)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t or "") for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null or empty html, and pages without any content, give an empty text. Unclosed elements end with the
    page or where the next one implies it. Null ids and urls stay null; repeated rows give repeated rows.
    """
    small_batches(pages.sparkSession)
    fields = [f for n in ("page_id", "url") for f in [pages.schema[n]]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_rows, schema)
