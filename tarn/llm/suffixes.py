"""Exact substring deduplication over suffix arrays built by two-stage sorting.

A byte goes when it is covered by a string of LENGTH bytes that also starts anywhere else. Where such a
string starts is found in three steps.

1. Every window of LENGTH bytes is given an anchor, the leftmost least hash among the GRAM-byte strings
   inside it. The anchor depends on the window's bytes alone, so equal windows have equal anchors.
   Neighbouring windows with one anchor are a segment: one row for some 130 windows. An anchor that
   occurs once in the corpus ends its windows' search; most do. Segments whose bytes are equal are
   repeated as a whole, and one of them stands for all; those that repeat within the text that is hashed
   at once, as in lines said over and over, are settled there and leave one row.
2. What is left are groups of different segments with one anchor, the edges of repeats. They are dealt
   into blocks of bounded size, and each block's windows are sorted in a suffix array: only suffixes
   smaller than their successors are sorted directly, the others are induced by one scan over the
   buckets of the first byte. Adjacent common prefixes of LENGTH bytes are repeats.
3. The segments of a group too large for a block are cut into chunks of STEP windows, by the distance
   from the anchor. A chunk's windows share a core of bytes; a chunk whose core no other has is done.
   The others are groups of their own. One that is still too large is dealt over several blocks by its
   bytes' hashes; its windows that are alone in their block are then compared across blocks by digest.

Identity of segments and of windows across blocks rests on the anchor's and a second hash, 128 bits.

Beside the bytes, passages of PASSAGE words that also start anywhere else are found, whatever their bytes and
the white space between words. They take the same way, over words for bytes; the windows of unequal segments
with one anchor are compared by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialise, small_batches, text_or_empty

LENGTH, GRAM = 400, 144
PASSAGE, WORD_GRAM = 50, 12
#: Bytes of segments in a block, and of text that is hashed at once.
BLOCK_BYTES, PIECE_BYTES = 1 << 19, 1 << 20
STEP = 8


class Unit(NamedTuple):
    """What windows are made of: bytes a symbol, symbols a window, symbols a gram, and what tells anchors of units apart."""

    size: int
    length: int
    gram: int
    salt: int


BYTES, WORDS = Unit(1, LENGTH, GRAM, 0), Unit(8, PASSAGE, WORD_GRAM, 0x5BD1E995)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.random.default_rng(7).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- anchors ---------------------------------------------------------------------------------------


class _Known(dict):
    """The hash of each word, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def as_words(text: bytes, known: _Known) -> bytes:
    """The hashes of a text's words, eight bytes each."""
    return np.fromiter(map(known.__getitem__, text.split()), dtype=np.uint64).tobytes()


def gram_hashes(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of the gram of symbols from each position on, by doubling. h: each symbol's hash."""
    m, k = 1, 0
    while 2 * m <= gram:
        h = h[:-m] * _ODD[k] + (h[m:] ^ (h[m:] >> np.uint64(31)))
        m, k = 2 * m, k + 1
    rest = gram - m
    if rest:
        h = h[:-rest] * _ODD[k] + (h[rest:] ^ (h[rest:] >> np.uint64(31)))
    return (h ^ (h >> np.uint64(29))) * _ODD[15]


def window_anchors(h: np.ndarray, grams: int = LENGTH - GRAM + 1) -> np.ndarray:
    """For each window, so many grams, the position of its leftmost least gram."""
    best, at, m = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * m <= grams:
        left = best[:-m] <= best[m:]
        best, at = np.where(left, best[:-m], best[m:]), np.where(left, at[:-m], at[m:])
        m *= 2
    rest = grams - m
    if rest:
        at = np.where(best[:-rest] <= best[rest:], at[:-rest], at[rest:])
    return at


def segments(texts: list[bytes], unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash, segment hash, n) of all segments of the texts, in symbols.

    n is how often the segment's bytes occur in what was hashed at once: 1, or for the first of equals
    their number. Windows of such equals come as further rows with n = 0, neighbours joined.
    """
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        lengths = np.array([len(x) // unit.size for _, _, x in held])
        starts = np.cumsum(lengths) - lengths
        whole = b"".join(x for _, _, x in held)
        held_texts, offsets = np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])
        held.clear()
        if len(whole) < unit.length * unit.size:
            return
        h = gram_hashes(_TABLE[np.frombuffer(whole, dtype=np.uint8)] if unit.size == 1 else np.frombuffer(whole, dtype=np.uint64), unit.gram)
        at = window_anchors(h, unit.length - unit.gram + 1)
        owner = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
        valid = np.arange(len(at)) + unit.length <= (starts + lengths)[owner]
        at = np.where(valid, at, -1)
        change = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        low, high = change, np.r_[change[1:], len(at)] - 1
        keep = at[low] >= 0
        low, high = low[keep], high[keep]
        own = owner[low]
        shift = offsets[own] - starts[own]
        cuts = zip((low * unit.size).tolist(), ((high + unit.length) * unit.size).tolist())
        digest = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in cuts), dtype=np.uint64, count=len(low))
        anchor = h[at[low]] ^ np.uint64(unit.salt)
        order = np.lexsort((low, digest, anchor))
        same = np.r_[False, (anchor[order][1:] == anchor[order][:-1]) & (digest[order][1:] == digest[order][:-1])]
        first = np.flatnonzero(~same)
        times = np.diff(np.r_[first, len(order)])
        equal = np.zeros(len(low), dtype=bool)
        equal[order[np.repeat(times > 1, times)]] = True
        one = order[first]
        out.append((held_texts[own][one], (low + shift)[one], (high + shift)[one], anchor[one].view(np.int64), digest[one].view(np.int64), times))
        known = np.flatnonzero(equal)
        if len(known):
            # low and high of neighbouring segments touch, and never across texts.
            begins = np.r_[True, low[known][1:] != high[known][:-1] + 1]
            head = known[begins]
            tail = known[np.r_[np.flatnonzero(begins)[1:], len(known)] - 1]
            zero = np.zeros(len(head), dtype=np.int64)
            out.append((held_texts[own][head], (low + shift)[head], (high + shift)[tail], zero, zero, zero))

    size, most = 0, PIECE_BYTES // unit.size
    for i, text in enumerate(texts):
        # A long text is cut into pieces that overlap, so that each window is in one of them.
        for o in range(0, max(1, len(text) // unit.size - unit.length + 1), most):
            piece = text[o * unit.size : (o + most + unit.length - 1) * unit.size]
            if len(piece) >= unit.length * unit.size:
                if size + len(piece) > PIECE_BYTES + unit.length * unit.size:
                    flush()
                    size = 0
                held.append((i, o, piece))
                size += len(piece)
    flush()
    if not out:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["d", "th", "low", "high", "anchor", "seg", "n", "words"]
    known = _Known()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for unit in (BYTES, WORDS):
            text, low, high, anchor, seg, n = segments(texts if unit is BYTES else [as_words(t, known) for t in texts], unit)
            d, th = (batch.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
            columns = [pa.array(np.asarray(x, dtype=np.int64)) for x in (d, th, low, high, anchor, seg, n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(d), unit is WORDS))], names)


# --- suffix arrays ---------------------------------------------------------------------------------


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part (at least `length` bytes) whether each of its windows occurs twice or more in the
    parts, by a two-stage suffix array of the windows.

    A suffix ends with its part; an ended suffix is smaller than any that goes on. Type B suffixes are
    smaller than their successors, type A larger. The B suffixes are sorted by their first `length` bytes
    (beyond that, order does not matter); scanning the buckets in the order of their first byte puts
    every A suffix behind the one that its successor's place asks for.
    """
    sizes = np.array([len(x) for x in parts])
    ends = np.cumsum(sizes + 1) - 1  # one place after each part, for the empty suffix
    starts = ends - sizes
    n = int(ends[-1]) + 1
    text = np.full(n, -1, dtype=np.int16)
    joined = b"\0".join(parts) + b"\0"
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    text[inside] = np.frombuffer(joined, dtype=np.uint8)[inside]
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[ends] = 1
    # Equal neighbours have the type of the next position.
    nonzero = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(nonzero[::-1])[::-1]
    is_b = step[np.minimum(after, n - 1)] > 0
    window = np.zeros(n + 1, dtype=np.int32)
    np.add.at(window, starts, 1)
    np.add.at(window, ends - length + 1, -1)
    window = np.cumsum(window)[:n] > 0
    # Behind the last window, the run of A suffixes up to a B suffix (or the part's end) is needed too.
    need = window.copy()
    for end, last in zip(ends.tolist(), (ends - length).tolist()):
        i = last
        while i < end and not is_b[i]:
            i += 1
            need[i] = True
    direct = np.flatnonzero(need & is_b & inside)
    stop = ends[np.searchsorted(ends, direct)]
    keys = [joined[i:j] for i, j in zip(direct.tolist(), np.minimum(direct + length, stop).tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    induced = need & ~is_b & inside
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def put(order: np.ndarray, above: int) -> None:
        """The A suffixes just before those of order, whose first byte is above `above`, to their buckets."""
        before = order - 1
        before = before[before >= 0]
        before = before[induced[before] & (text[before] > above)]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            values, cuts = np.unique(first[by], return_index=True)
            for c, part in zip(values.tolist(), np.split(before[by], cuts[1:])):
                waiting[c].append(part)

    put(ends[need[ends]], -1)
    by_byte = np.searchsorted(text[direct], np.arange(257))
    suffixes: list[np.ndarray] = []
    for c in range(256):
        level = np.concatenate([np.empty(0, dtype=np.int64), *waiting[c]])
        bucket = [level]
        while len(level):  # runs of one byte
            level = level[level > 0] - 1
            level = level[induced[level] & (text[level] == c)]
            bucket.append(level)
        bucket.append(direct[by_byte[c] : by_byte[c + 1]])
        order = np.concatenate(bucket)
        if len(order):
            suffixes.append(order)
            put(order, c)
    array = np.concatenate([*suffixes, np.empty(0, dtype=np.int64)])
    array = array[window[array]]
    # Adjacent common prefixes, eight bytes at a time while both agree.
    words = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=joined, strides=(1,))
    a, b = array[:-1], array[1:]
    whole, rest = divmod(length, 8)
    for k in [*range(0, 8 * whole, 8), *([length - 8] if rest else [])]:
        same = words[a + k] == words[b + k]
        a, b = a[same], b[same]
    twice = np.zeros(n, dtype=bool)
    twice[a] = twice[b] = True
    return [twice[s : e - length + 1] for s, e in zip(starts.tolist(), ends.tolist())]


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of each stretch of true marks."""
    edge = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


_FOUND = "d long, th long, low long, high long, anchor long, digest long"


def _solve(block: pa.Table) -> pa.Table:
    """Rows with low and high: windows that are repeated. Rows with a digest: windows of groups spread
    over blocks that are alone in this block (d, th, low), or one for each repeated content (low null)."""
    rows = block.select(["anchor", "alone", "spread", "d", "th", "low", "bytes"]).to_pylist()
    rows.sort(key=lambda r: (r["anchor"], r["d"], r["th"], r["low"]))
    marks = repeated_windows([r["bytes"] for r in rows])
    out: list[tuple] = []
    seen: set[tuple[int, int]] = set()
    for r, twice in zip(rows, marks):
        if r["alone"]:
            out += [(r["d"], r["th"], r["low"] + a, r["low"] + b, r["anchor"], None) for a, b in runs(twice)]
        if r["spread"]:
            for i, known in enumerate(twice.tolist()):
                digest = xxhash.xxh3_64_intdigest(r["bytes"][i : i + LENGTH], 1)
                digest -= (digest >> 63) << 64
                if known or not r["alone"]:
                    if (r["anchor"], digest) not in seen:
                        seen.add((r["anchor"], digest))
                        out.append((None, None, None, None, r["anchor"], digest))
                else:
                    out.append((r["d"], r["th"], r["low"] + i, r["low"] + i, r["anchor"], digest))
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(names, zip(*out) if out else [()] * 6)})


# --- the operator ----------------------------------------------------------------------------------

_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long, kept binary"
_SLICE = "block long, anchor long, alone boolean, spread boolean, d long, th long, low long, bytes binary, digest long"


def chunks(segment: bytes, step: int = STEP) -> list[tuple[int, int, int]]:
    """(first window, last window, key) of the chunks of a segment; windows that are equal are in chunks
    of one key, in whatever segment of the group they are."""
    h = gram_hashes(_TABLE[np.frombuffer(segment, dtype=np.uint8)])
    anchor, last = int(np.argmin(h[: LENGTH - GRAM + 1])), len(segment) - LENGTH
    out = []
    for c in range((anchor - last) // step, anchor // step + 1):
        # The windows that begin step * c to step * c + step - 1 bytes before the anchor. What all of
        # them cover is inside each of them, so it is there even if the segment has only some of them.
        first = anchor - step * c
        low, high = max(0, first - step + 1), min(last, first)
        if low <= high:
            key = xxhash.xxh3_64_intdigest(segment[first : first - step + 1 + LENGTH], c)
            out.append((low, high, key - ((key >> 63) << 64)))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted segments; of those of large groups in chunks, with the chunk's key for anchor. Of
    segments of words a row with the digest of every window; without a place if the segment is known to repeat."""
    names = [x.split()[0] for x in _SLICE.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    known = _Known()
    for batch in batches:
        rows = []
        for d, th, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = as_words(text, known) if any(w["words"] for w in wanted) else b""
            for w in wanted:
                if w["words"]:
                    for i in range(w["low"], w["high"] + 1):
                        digest = xxhash.xxh3_64_intdigest(words[8 * i : 8 * (i + PASSAGE)], 1)
                        place = (d, th, i) if w["alone"] else (None, None, None)
                        rows.append((None, w["anchor"], w["alone"], None, *place, None, digest - ((digest >> 63) << 64)))
                    continue
                part = text[w["low"] : w["high"] + LENGTH]
                if w["spread"]:
                    for low, high, key in chunks(part):
                        rows.append((None, key ^ w["anchor"], w["alone"], True, d, th, w["low"] + low, part[low : high + LENGTH], None))
                else:
                    rows.append((w["block"], w["anchor"], w["alone"], False, d, th, w["low"], part, None))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 9, types)], names)


def _covered(spans: list, length: int, size: int) -> np.ndarray:
    """Whether each of `size` symbols is covered by a window of the spans."""
    marks = np.zeros(size + 1, dtype=np.int32)
    if spans:
        at = np.array([(s["low"], s["high"] + length) for s in spans])
        np.add.at(marks, at[:, 0], 1)
        np.add.at(marks, at[:, 1], -1)
    return np.cumsum(marks)[:size] > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            spans = spans or []
            gone = _covered([s for s in spans if not s["words"]], LENGTH, len(text))
            passages = [s for s in spans if s["words"]]
            said = _covered(passages, PASSAGE, max((s["high"] + PASSAGE for s in passages), default=0))
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if gone.any() else text
            out.append((doc_id, len(text), int(gone.sum()), len(runs(gone)), hashlib.sha256(kept).hexdigest(), int(said.sum()), len(runs(said)), kept))
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * len(types), types)], names)


def repeated_spans(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """d, th, low, high, words: stretches of windows that also start elsewhere, of bytes or of words. docs: d,
    th, bytes; d and th name a document by its id and text, and rows that agree in both are copies of each other."""
    schema = "d long, th long, low long, high long, anchor long, seg long, n long, words boolean"
    place = ["d", "th", "low", "high", "words"]
    every = materialise(docs.mapInArrow(_segment_rows, schema), "segments")
    rows, settled = every.filter("n > 0"), every.filter("n = 0").select(place)
    common = rows.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    met = materialise(rows.join(common.hint("shuffle_merge"), "anchor", "left_semi"), "met")
    one = F.min(F.struct(place)).alias("one")
    distinct = materialise(met.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), one), "distinct")
    again = distinct.filter("n > 1").select("anchor", "seg")
    whole = met.filter("n = 1").join(again.hint("shuffle_merge"), ["anchor", "seg"], "left_semi").select(place)

    width = F.when(F.col("one.words"), 0).otherwise(F.col("one.high") - F.col("one.low") + LENGTH)
    groups = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum(width).alias("size")).filter("k > 1")
    blocks = max(1, -(-(groups.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    large = F.col("size") > 2 * block_bytes
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks))
    wanted = (
        distinct.join(groups.hint("shuffle_merge"), "anchor")
        .select("one.*", "anchor", block.alias("block"), (F.col("n") == 1).alias("alone"), large.alias("spread"))
        .groupBy("d", "th").agg(F.collect_list(F.struct("low", "high", "anchor", "block", "alone", "spread", "words")).alias("wanted"))
    )
    slices = docs.join(wanted.hint("shuffle_merge"), ["d", "th"]).select("d", "th", "bytes", "wanted").mapInArrow(_slices, _SLICE)
    slices = materialise(slices, "slices")
    segment = slices.filter("digest is null").drop("digest")
    cut = segment.filter("spread").drop("block", "spread")
    sizes = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("bytes")).alias("size")).filter("k > 1")
    own = F.xxhash64("anchor", F.when(large, F.pmod(F.xxhash64("bytes"), F.ceil(F.col("size") / block_bytes))))
    cut = cut.join(sizes.hint("shuffle_merge"), "anchor").select(F.pmod(own, F.lit(blocks)).alias("block"), large.alias("spread"), *cut.columns)
    whole_groups = segment.filter("not spread").select(cut.columns)
    found = materialise(whole_groups.unionByName(cut).groupBy("block").applyInArrow(_solve, _FOUND), "found")
    inside = found.filter("digest is null").select("d", "th", "low", "high", F.lit(False).alias("words"))
    windows = found.filter("digest is not null").select("d", "th", "low", "anchor", "digest", F.lit(False).alias("words"))
    windows = windows.unionByName(slices.filter("digest is not null").select("d", "th", "low", "anchor", "digest", F.lit(True).alias("words")))
    met_again = windows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "digest")
    across = windows.filter("low is not null").join(met_again.hint("shuffle_merge"), ["anchor", "digest"], "left_semi")
    across = across.select("d", "th", "low", F.col("low").alias("high"), "words")
    return settled.unionByName(whole).unionByName(inside).unionByName(across)


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document; beside
    them n_passage_words (words covered by PASSAGE words in a row that also start anywhere else) and n_passages
    (runs of them), which remove nothing.

    Null text is empty. Texts under LENGTH bytes keep all. Copies of a document, rows equal in id and text
    included, are elsewhere to each other. Every row gives a row.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.xxhash64(text_or_empty()).alias("th"),
        text_or_empty().cast("binary").alias("bytes"),
    )
    spans = repeated_spans(docs.select("d", "th", "bytes"), block_bytes).groupBy("d", "th").agg(F.collect_set(F.struct("low", "high", "words")).alias("spans"))
    joined = docs.join(spans.hint("shuffle_merge"), ["d", "th"], "left").select("doc_id", "bytes", "spans")
    return joined.mapInArrow(_kept, _OUT)
