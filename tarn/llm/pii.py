"""Personal data with offsets, plain and disguised.

Plain identifiers are matched in the text as it is. Disguised ones are first undone by a chain of
transducers, each of which rewrites stretches of the text and keeps, for every character it puts out,
the span of source characters that it stands for: look-alike characters become ASCII ones and invisible
ones go, spelled digits become digits, and words or brackets that stand for @ and . become these. The same
detectors then run over what comes out, and their spans are mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The leftmost match of the ip pattern begins where a run of digits does, so other places are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """The leftmost matches, found from each @: the local part is the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# --- transducers -----------------------------------------------------------------------------------

# Characters that look like an ASCII one, by that one.
_ALIKE = {
    "a": "аαɑ", "b": "ЬƄ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽ℮", "g": "ɡ", "h": "һ", "i": "іɩⅰ", "j": "јϳ", "k": "κ", "l": "ⅼӏ",
    "m": "ⅿ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵⅴ", "w": "ԝ", "x": "хⅹ", "y": "уγү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "@": "﹫＠", ".": "․。｡．﹒", "+": "＋﹢", "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d", " ": "\u00a0\u202f\u205f\u3000",
    "(": "（", ")": "）", "": "\u00ad\u200b\u200c\u200d\u2060\ufeff",
}
# Digits by name in English, German, French and Spanish, and the words for the signs.
_NAMES = (
    "zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
_AT_WORDS, _DOT_WORDS, _PLUS_WORDS = "at arobase arroba", "dot punkt point punto", "plus más"


_AT_SET, _DOT_SET = tuple(_AT_WORDS.split()), tuple(_DOT_WORDS.split())


def _folds() -> dict[int, str]:
    table = {ord(c): to for to, alike in _ALIKE.items() for c in alike}
    ranges = [(0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2460, 0x249B), (0x2070, 0x2089), (0x24B6, 0x24EA), (0x0660, 0x0669), (0x06F0, 0x06F9), (0x2000, 0x200A), (0xB9, 0xB9), (0xB2, 0xB3)]
    for low, high in ranges:
        for code in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            digit = unicodedata.digit(chr(code), None)
            plain = str(digit) if digit is not None else plain
            if len(plain) == 1 and plain.isascii():
                table.setdefault(code, plain)
    return table


_FOLD = _folds()
_FOLDED = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_FOLD)))) + "]")
_DIGIT_OF = {name: str(d) for d, names in enumerate(_NAMES) for name in names.split()}
_ANY = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_SPELLED = rf"(?<!\w){_ANY(_DIGIT_OF)}(?!\w)"
_RUN = re.compile(rf"(?:(?<!\w){_ANY(_PLUS_WORDS.split())}[\x20-]{{1,3}})?(?:{_SPELLED}|[0-9])(?:[\x20,-]{{0,3}}(?:{_SPELLED}|[0-9]))+", re.I)
_RUN_PART = re.compile(rf"(?P<plus>{_ANY(_PLUS_WORDS.split())}[\x20-]{{1,3}})|(?P<gap>[\x20,-]{{0,3}})(?P<name>{_SPELLED})|(?P<after>(?<=[^\W\d])[\x20,-]{{1,3}}(?=[0-9]))", re.I)
_OPEN, _CLOSE = r"[\[({<]\x20{0,3}", r"\x20{0,3}[\])}>]"
_AT = re.compile(rf"(?P<sure>\x20{{0,3}}{_OPEN}(?:@|{_ANY(_AT_WORDS.split())}){_CLOSE}\x20{{0,3}})|(?P<word>\x20{{1,3}}{_ANY(_AT_WORDS.split())}\x20{{1,3}})|(?P<sign>\x20{{0,3}}@\x20{{0,3}})", re.I)
_DOT = rf"(?:\x20{{0,3}}{_OPEN}(?:\.|{_ANY(_DOT_WORDS.split())}){_CLOSE}\x20{{0,3}}|\x20{{1,3}}{_ANY(_DOT_WORDS.split())}\x20{{1,3}})"
_DOTS = re.compile(_DOT, re.I)
_BEFORE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{_DOT}[A-Za-z0-9._%+-]+)*\Z", re.I)
_AFTER = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.I)
_IP_DOTS = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)
_GROUP = rf"(?:{_SPELLED}|[0-9])(?:[\x20,-]{{0,3}}(?:{_SPELLED}|[0-9])){{0,2}}"
_QUAD = re.compile(rf"(?<!\w){_GROUP}(?:(?:\.|{_DOT}){_GROUP}){{3}}(?!\w)", re.I)
# Cheap tests, on lower-cased text, of whether a transducer can have anything to do.
_BRACKETED = re.compile(rf"{_OPEN}(?:@|\.|{_ANY((_AT_WORDS + ' ' + _DOT_WORDS).split())}){_CLOSE}")
_AT_DOMAIN = [re.compile(rf" {w} {{1,3}}[a-z0-9-]+\.[a-z0-9]") for w in _AT_WORDS.split()]
_EDGES = ",-.;:!?()[]{}<>\"'"
_APART = str.maketrans({c: " " for c in _EDGES})
_NAME_SET = frozenset(name + end for name in _DIGIT_OF for end in ("", *_EDGES))
_FOLD_SET = frozenset(map(chr, _FOLD))
_FOLD_LATIN = tuple(c for c in sorted(_FOLD_SET) if ord(c) < 256)
#: The longest local part that is looked for before a disguised @; an address has no more than 254 characters.
_REACH = 254

Rewrite = tuple[int, int, str]


class Tape:
    """A text with, for each character, the source span that it stands for and whether it was changed."""

    def __init__(self, text: str):
        self.text = text
        self.start, self.end = list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = bytearray(len(text))

    def rewrite(self, parts: list[Rewrite]) -> None:
        """Puts each (from, to, new text); the parts are in order and apart."""
        if not parts:
            return
        text, start, end, changed, at = [], [], [], bytearray(), 0
        for low, high, new in parts:
            text += [self.text[at:low], new]
            start += self.start[at:low] + [self.start[low]] * len(new)
            end += self.end[at:low] + [self.end[high - 1]] * len(new)
            changed += self.changed[at:low] + b"\1" * len(new)
            at = high
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], changed + self.changed[at:]


def fold(text: str) -> list[Rewrite]:
    """Look-alike characters."""
    return [(m.start(), m.end(), _FOLD[ord(m[0])]) for m in _FOLDED.finditer(text)]


def digits(text: str) -> list[Rewrite]:
    """Spelled digits in a row, or beside figures; the gap before a spelled one goes with it."""
    out: list[Rewrite] = []
    runs = [m.span() for m in _RUN.finditer(text)]
    for quad in _QUAD.finditer(text):  # single digits count between dots
        groups = [m.span() for m in re.finditer(_GROUP, text[quad.start() : quad.end()], re.I)]
        runs += [(quad.start() + x, quad.start() + y) for x, y in groups if not any(u <= quad.start() + x < v for u, v in runs)]
    for low, high in sorted(runs):
        if not re.search(_SPELLED, text[low:high], re.I):
            continue
        for m in _RUN_PART.finditer(text, low, high):
            if m["plus"]:
                out.append((m.start(), m.end(), "+"))
            elif m["name"]:
                first = m.start() == low or text[m.start() - 1 : m.start()] == "+" or (out and out[-1][1:] == (m.start(), "+"))
                out.append((m.start("name") if first else m.start(), m.end(), _DIGIT_OF[m["name"].lower()]))
            else:
                out.append((m.start(), m.end(), ""))
    return out


def signs(text: str) -> list[Rewrite]:
    """Disguised @ and . where what stands around them has the form of an address, and . between digits."""
    out: list[Rewrite] = []
    done = 0
    for m in _AT.finditer(text):
        if m.start() < done:
            continue
        low = max(done, m.start() - _REACH)
        before = _BEFORE.search(text[low : m.start()])
        after = _AFTER.match(text, m.end())
        if not before or not after:
            continue
        inside = [(low + x.start(), low + x.end(), ".") for x in _DOTS.finditer(before[0])]
        inside = [(a + before.start(), b + before.start(), c) for a, b, c in inside]
        behind = [(x.start(), x.end(), ".") for x in _DOTS.finditer(text, after.start(), after.end())]
        # A plain word between two words is an address only if something else says so.
        if m["word"] and (not re.search(r"[A-Za-z]{2,}\Z", after[0]) or not behind and not re.search(r"[0-9._+]", before[0])):
            continue
        if m["sign"] and len(m[0]) > 1 and not behind and not inside:
            continue
        out += [*inside, (m.start(), m.end(), "@"), *behind]
        done = after.end()
    taken = [(a, b) for a, b, _ in out]
    for m in _IP_DOTS.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            out.append((m.start(), m.end(), "."))
    return sorted(out)


def undisguised(text: str) -> Tape | None:
    """The tape of the text with its disguises undone, or None if it has none."""
    tape = None
    if _may_fold(text):
        tape = Tape(text)
        tape.rewrite(fold(text))
    for rewrite, may in ((digits, _may_spell), (signs, _may_sign)):
        now = tape.text if tape else text
        if may(now.lower()):
            parts = rewrite(now)
            if parts:
                tape = tape or Tape(text)
                tape.rewrite(parts)
    return tape


def _may_fold(text: str) -> bool:
    """Whether the text holds a look-alike; few of them are in Latin-1, which most texts fit."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _FOLD_SET.isdisjoint(text)
    return any(c in text for c in _FOLD_LATIN)


def _may_spell(low: str) -> bool:
    """Whether a spelled digit stands beside another one, a figure, or a word for a dot."""
    words = (low.translate(_APART) if "-" in low else low).split()
    for i in [i for i, word in enumerate(words) if word in _NAME_SET]:
        for beside in words[max(0, i - 1) : i] + words[i + 1 : i + 2]:
            beside = beside.strip(_EDGES)
            if beside and (beside in _DIGIT_OF or beside[0].isdigit() or beside[-1].isdigit() or beside in _DOT_SET):
                return True
    return False


def _may_sign(low: str) -> bool:
    if " @" in low or "@ " in low or any(x in low and pattern.search(low) for x, pattern in zip(_AT_SET, _AT_DOMAIN)):
        return True
    if any(f"{w} " in low and f" {w} " in low for w in _DOT_SET):
        return True
    return any(c in low for c in "[({<") and bool(_BRACKETED.search(low))


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain, added) spans as (kind, start, end), by kind as in KINDS, then start."""
    plain = [(kind, *span) for kind in KINDS for span in DETECTORS[kind](text)]
    added: list[tuple[str, int, int]] = []
    tape = undisguised(text)
    if tape:
        for kind in KINDS:
            own = [(a, b) for k, a, b in plain if k == kind]
            for a, b in DETECTORS[kind](tape.text):
                low, high = tape.start[a], tape.end[b - 1]
                if any(tape.changed[a:b]) or high - low != b - a:
                    met = [(x, y) for x, y in own if x < high and low < y]
                    if not met or kind == "email" and all(low <= x and y <= high and (low, high) != (x, y) for x, y in met):
                        added.append((kind, low, high))
    return plain, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            plain, added = find(text or "")
            counts = [sum(k == kind for k, _, _ in plain) for kind in KINDS]
            digest = hashlib.sha256(joined(plain).encode()).hexdigest()
            rows.append((doc_id, *counts, digest, joined(plain + added), len(added)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain ones), base_sha256 (of the plain spans), spans (plain and
    added) and n_added of every document; positions are code points, ends exclusive.

    An added span overlaps a plain one of its kind only where it is an address that holds the plain one whole:
    a look-alike cuts an address short. Null text is empty and has no spans. Null ids
    stay null, repeated rows give repeated rows. Work is linear in the text's length.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rows, schema)
