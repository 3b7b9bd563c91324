"""Benchmark decontamination with spaced seeds.

A seed mask names the token positions of a window that count; the others may differ. Test items and
training texts are hashed under the same masks, equal hashes are joined, and around every hit the item
is laid over the text and compared token by token.

The two masks for items of SHORT tokens or more have weight 5 and a gap each. Together they hit every copy of a
passage of 15 tokens or more with any fifth of its tokens substituted (the tests try all ways for 15 to 20 tokens),
which is a similarity of 0.8. Shorter items have four masks of weight 4 within five tokens: of five tokens in a row
with at most one substituted, and every such copy of an item has these, one of them hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialise, small_batches, text_or_empty

SHORT = 15
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 5))
SHORT_MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: Items of fewer tokens cannot be told from chance.
LEAST = 5
#: An item counts as leaked when this share of its tokens is found in place,
SIMILARITY = 0.8
_SHARE = Fraction(SIMILARITY).limit_denominator(1000)
#: or when a stretch of at least so many tokens of it is, at that share.
STRETCH = 25
#: Tokens of test items that one pass over the documents holds; a larger benchmark takes several passes.
BLOCK_TOKENS = 200_000
_TOKEN = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class _Hashes(dict):
    """The hash of each token, kept for the next time."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = value = xxhash.xxh64_intdigest(token)
        return value


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _TOKEN.findall(text.lower())


def masked(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of every window's positions under a mask, by the window's first position."""
    n = max(0, len(hashes) - mask[-1])
    out = np.zeros(n, dtype=np.uint64)
    for odd, p in zip(_ODD, mask):
        out += hashes[p : p + n] * odd
        out ^= out >> np.uint64(29)
    return out * _ODD[0]


class Index:
    """The masked hashes of some test items, sorted, with the items' token hashes."""

    def __init__(self, items: list[tuple[int, str]]):
        known = _Hashes()
        self.ids, self.items = [], []
        for item_id, text in items:
            found = np.array([known[t] for t in tokens(text)], dtype=np.uint64)
            if len(found) >= LEAST:
                self.ids.append(item_id)
                self.items.append(found)
        self.tables = []
        for masks, short in ((MASKS, False), (SHORT_MASKS, True)):
            chosen = [i for i, x in enumerate(self.items) if (len(x) < SHORT) == short]
            for mask in masks if chosen else ():
                parts = [masked(self.items[i], mask) for i in chosen]
                keys = np.concatenate(parts)
                item = np.repeat(np.array(chosen), [len(x) for x in parts])
                at = np.concatenate([np.arange(len(x)) for x in parts])
                order = np.argsort(keys, kind="stable")
                bits = np.zeros(1 << 20, dtype=bool)
                bits[(keys >> np.uint64(44)).astype(np.int64)] = True
                self.tables.append((mask, keys[order], item[order].astype(np.int32), at[order].astype(np.int32), np.packbits(bits)))

    def diagonals(self, hashes: np.ndarray) -> np.ndarray:
        """(item, position of the item's first token in hashes) of all hits, distinct."""
        found = [np.empty((0, 2), dtype=np.int64)]
        for mask, keys, item, at, bits in self.tables:
            own = masked(hashes, mask)
            may = np.nonzero(np.unpackbits(bits).view(bool)[(own >> np.uint64(44)).astype(np.int64)])[0]
            low, high = np.searchsorted(keys, own[may], "left"), np.searchsorted(keys, own[may], "right")
            n = high - low
            # Many positions with many entries each are gone through some at a time.
            ends = np.cumsum(n)
            cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + 1, 4_000_000), "right")
            for a, b in zip(cuts, [*cuts[1:], len(n)]):
                some = n[a:b]
                pos = np.repeat(may[a:b], some)
                entry = np.repeat(low[a:b] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                found.append(np.unique(np.stack([item[entry], pos - at[entry]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def leaks(self, hashes: np.ndarray, starts: np.ndarray) -> dict[int, dict[int, tuple[int, int, int]]]:
        """For texts laid end to end (starts: each one's first token, then the end): by text and item,
        the best (matched tokens, aligned tokens, position in the text) that counts as a leak."""
        out: dict[int, dict[int, tuple[int, int, int]]] = {}
        if not self.ids or not len(hashes):
            return out
        for item, first in self.diagonals(hashes):
            own = self.items[item]
            # Every text that the laid item touches is looked at by itself.
            doc = int(np.searchsorted(starts, max(first, 0), "right")) - 1
            while doc < len(starts) - 1 and starts[doc] < first + len(own):
                low, high = max(starts[doc], first), min(starts[doc + 1], first + len(own))
                if high - low >= LEAST:
                    got = verified(hashes[low:high] == own[low - first : high - first], len(own))
                    if got:
                        best = out.setdefault(doc, {})
                        row = (*got, int(low - starts[doc]))
                        if row[0] > best.get(int(item), (0,))[0]:
                            best[int(item)] = row
                doc += 1
        return out


def verified(same: np.ndarray, n: int) -> tuple[int, int] | None:
    """(matched, aligned) if an alignment of an item of n tokens counts as a leak, else None: the whole item,
    or else of all stretches of STRETCH tokens or more at the share asked for the one with the most matched
    tokens, the shortest of equals."""
    matched = int(same.sum())
    if matched * _SHARE.denominator >= _SHARE.numerator * n:
        return matched, n
    if len(same) < STRETCH or matched < SIMILARITY * STRETCH:
        return None
    # A match earns what a mismatch costs at the share, so a stretch has the share when its total is not negative.
    total = np.concatenate([[0], np.cumsum(np.where(same, _SHARE.denominator - _SHARE.numerator, -_SHARE.numerator))])
    ends = np.arange(STRETCH, len(total))
    # For each end the first start whose total is no higher; a longer stretch has no fewer matches.
    starts = np.searchsorted(-np.minimum.accumulate(total), -total[ends])
    ok = ends - starts >= STRETCH
    if not ok.any():
        return None
    ends, starts = ends[ok], starts[ok]
    count = np.concatenate([[0], np.cumsum(same)])
    hits = count[ends] - count[starts]
    best = np.lexsort((ends - starts, -hits))[0]
    return int(hits[best]), int(ends[best] - starts[best])


def _blocks(items: DataFrame, block_tokens: int) -> tuple[int, Iterator[Index]]:
    """(number of blocks, the blocks): the distinct item texts, each under its lowest id, in blocks of about
    block_tokens tokens. Their number comes from a count made on the cluster; a block comes to the driver when it is
    asked for."""
    rows = items.groupBy(text_or_empty().alias("text")).agg(F.min("item_id").alias("item_id"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (block_tokens * 6)))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return n, (Index([(r["item_id"], r["text"]) for r in rows.filter(part == k).collect()]) for k in range(n))


def _laid(texts: list[str | None], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    each = [np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found)) for found in (tokens(t or "") for t in texts)]
    return np.concatenate([*each, np.empty(0, dtype=np.uint64)]), np.cumsum([0, *(len(x) for x in each)])


def _pairs(index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            leaks = index.leaks(*_laid(texts, known))
            rows = [
                (ids[doc], index.ids[item], len(index.items[item]), matched, aligned, at)
                for doc, items in sorted(leaks.items()) for item, (matched, aligned, at) in sorted(items.items())
            ]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "item_id", "item_tokens", "matched", "aligned", "position"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document and test item that it leaks: doc_id, item_id, item_tokens, matched (tokens
    found in place), aligned, position (the document's token where the overlap begins), overlap.

    Documents without a leak have no row. Equal items count once, under the lowest item_id. Items of
    fewer than five tokens cannot be told from chance and match nothing. Null texts are empty and leak
    nothing; null ids stay null; repeated documents give repeated rows; without items there are no rows.

    The driver and the tasks hold one block of items at a time: of several, each one's rows are written before the
    next is read.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, item_tokens long, matched long, aligned long, position long"
    n, blocks = _blocks(items, block_tokens)
    out = None
    for index in blocks:
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pairs(index), schema)
        found = found if n == 1 else materialise(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("overlap", F.col("matched") / F.col("aligned"))


def _picked(index: Index, text_at: int, leaking: bool) -> Callable:
    """The rows that leak an item of the block, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            leaks = index.leaks(*_laid(batch.column(text_at).to_pylist(), known))
            yield batch.filter(pa.array([(i in leaks) == leaking for i in range(batch.num_rows)], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, items: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs, all columns, without the documents that leak an item (see leaked_items)."""
    small_batches(docs.sparkSession)
    n, blocks = _blocks(items, block_tokens)
    if n == 1:
        return docs.mapInArrow(_picked(next(blocks), docs.columns.index("text"), False), docs.schema)
    # Whether a text leaks depends on the text alone, so the leaking texts' hashes say which rows go.
    keys = lambda: [F.xxhash64(text_or_empty()).alias("__a"), F.xxhash64(F.lit("leak"), text_or_empty()).alias("__b")]
    gone = None
    for index in blocks:
        found = docs.select("text").mapInArrow(_picked(index, 0, True), "text string").select(*keys()).distinct()
        found = materialise(found, "leaks")
        gone = found if gone is None else gone.unionByName(found)
    return docs.select(*docs.columns, *keys()).join(gone.distinct().hint("shuffle_merge"), ["__a", "__b"], "left_anti").select(*docs.columns)
