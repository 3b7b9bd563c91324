"""Language-model scores from probabilistic suffix trees.

The model predicts the next token, or the text's end, from the longest of its contexts that it keeps: the one
or two tokens before, or the LONG tokens before. A context is kept when its next-token distribution diverges
from its parent's (the longest shorter context that is kept) by GAIN nats over its occurrences. Next tokens
that are met after a context have their share there; what is left goes to the parent's distribution,
and the root's goes to a tree over bytes, which spells any token: from the longest kept context of up to
DEPTH bytes in the token, its begin included. All are distributions, so a text's score is the log10 of
a probability.

Counts are made over the whole training texts.

* Short contexts and bytes make a tree of bounded size that every task holds: a context, or a context with its
  next token, is a candidate when its probability is at least a fixed one (LEAST, PAIRS), so there are at most
  1 / LEAST or 1 / PAIRS of them at each length.
* Tokens and long contexts are tables that grow with the corpus, and meet the texts in joins. Every long
  context is a candidate that is met twice or more in the whole corpus.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import brief_shuffles, capped_batches, materialise, text_or_empty

DEPTH, LEAST, GAIN = 6, 5e-5, 12.0
#: A token in at least this share of the training tokens is looked up beside the text; there are at most
#: 1 / COMMON of them. The others meet their counts in a join. The same for short contexts with a next token.
COMMON, PAIRS = 2e-7, 2e-6
#: Tokens of a long context, and that one in so many is a candidate: all are.
LONG, THIN = 4, 1
#: Bits of the map of those met twice or more. It only keeps others from being joined; where it is full, all are.
MAP_BITS = 26
#: Training tokens to a part of the hashes, and bits of a part's number at most: a task holds a part at a time.
PART, PART_BITS = 500_000, 14
#: Counts that a task holds before it hands them on.
HELD = 500_000
#: What stands for a token's begin and end, for the end of the text, and for no byte. None is in a token.
EDGE, STOP, PAD = 0x20, 0x0A, 0x09
_PADDED = int.from_bytes(bytes([PAD]) * DEPTH, "big")


def _split(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(_tokens(text))
        seen[b""] += batch.num_rows
        if len(seen) > 300_000:
            yield rows()
            seen.clear()
    if seen:
        yield rows()


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary, the text's end is the empty one) and n over all texts of docs."""
    parts = docs.select(text_or_empty().cast("binary")).mapInArrow(_token_counts, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


# --- the tree --------------------------------------------------------------------------------------


def symbols(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, next, token): for each symbol of each token the DEPTH bytes before it as one number, the
    symbol, and the token's place. Tokens are laid out as EDGE, bytes, EDGE; the empty one as EDGE, STOP."""
    whole = np.frombuffer(b"".join(b" " + t + b" " if t else b" \n" for t in tokens), dtype=np.uint8)
    lengths = np.array([len(t) + 2 if t else 2 for t in tokens])
    starts = np.cumsum(lengths) - lengths
    code = np.full(len(whole), _PADDED, dtype=np.uint64)
    place = np.arange(len(whole)) - np.repeat(starts, lengths)
    for k in range(1, DEPTH + 1):
        shift = np.uint64(8 * (k - 1))
        ok = place >= k
        value = np.zeros(len(whole), dtype=np.uint64)
        value[k:] = whole[:-k]
        byte = np.where(ok, value, np.uint64(PAD))
        code = (code & ~(np.uint64(0xFF) << shift)) | (byte << shift)
    keep = place > 0
    return code[keep], whole[keep], np.repeat(np.arange(len(tokens)), lengths)[keep]


def shortened(code: np.ndarray, depth: int) -> np.ndarray:
    """The contexts cut to their last `depth` bytes."""
    low = np.uint64((1 << (8 * depth)) - 1)
    return (code & low) | (np.uint64(_PADDED) & ~low)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 10_000, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches put together to some rows, or bytes, each: tokens are short, and a batch of few costs as much as one of many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key = context << 8 | next symbol, at the full depth only: shorter contexts are sums of these."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def rows() -> pa.RecordBatch:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    for batch in _larger(batches):
        n = batch.column(1).to_numpy(zero_copy_only=False)
        code, following, token = symbols(batch.column(0).to_pylist())
        held.append(_summed((code << np.uint64(8)) | following, n[token]))
        size += len(held[-1][0])
        if size > HELD:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


class Spelling:
    """The tree over bytes: kept contexts by depth, sorted, with their dense log10 distributions."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], gain: float = GAIN):
        """counts: by depth from 0, (keys, n) of the candidates' symbols, sorted by key."""
        root = np.zeros(256)
        keys, n = counts[0]
        root[(keys & np.uint64(0xFF)).astype(int)] = n
        total, kinds = root.sum(), max(1, int((root > 0).sum()))
        levels: list[tuple[np.ndarray, np.ndarray]] = [
            (np.array([_PADDED], dtype=np.uint64), ((root + kinds / 256) / (total + kinds))[None] if total else np.full((1, 256), 1 / 256))
        ]
        kept: list[np.ndarray] = [np.array([True])]
        parents: list[np.ndarray] = [np.array([0])]
        for depth in range(1, len(counts)):
            keys, n = counts[depth]
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            row = np.repeat(np.arange(len(contexts)), np.diff(np.r_[first, len(keys)]))
            table = np.zeros((len(contexts), 256))
            table[row, (keys & np.uint64(0xFF)).astype(int)] = n
            above, below = levels[-1], shortened(contexts, depth - 1)
            at = np.searchsorted(above[0], below)
            prior = above[1][at]
            totals, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
            share = table / np.maximum(totals, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                divergence = np.where(table > 0, share * np.log(share / prior), 0.0).sum(axis=1) * totals[:, 0]
            levels.append((contexts, (table + kinds * prior) / np.maximum(totals + kinds, 1)))
            kept.append(divergence >= gain)
            parents.append(at)
        for depth in range(len(levels) - 1, 1, -1):  # what is kept keeps its suffixes
            kept[depth - 1][parents[depth][kept[depth]]] = True
        self.levels = [(c[k], np.log10(p[k]).astype(np.float32)) for (c, p), k in zip(levels, kept)]

    def score(self, tokens: list[bytes]) -> np.ndarray:
        """The log10 probability of each token."""
        out = np.zeros(len(tokens))
        for low in range(0, len(tokens), 20_000):
            part = tokens[low : low + 20_000]
            code, following, token = symbols(part)
            value = self.levels[0][1][0][following].astype(np.float64)
            left = np.arange(len(code))
            for depth in range(1, len(self.levels)):
                contexts, logs = self.levels[depth]
                if not len(contexts) or not len(left):
                    break
                own = shortened(code[left], depth)
                at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
                hit = contexts[at] == own  # suffixes of what is kept are kept: a miss ends the search
                left, at = left[hit], at[hit]
                value[left] = logs[at, following[left]]
            out[low : low + len(part)] = np.bincount(token, weights=value, minlength=len(part))
        return out


def grow_spelling(vocabulary: DataFrame, least: float = LEAST, gain: float = GAIN) -> Spelling:
    """The spelling tree of a table of token and n. Only contexts of at least `least` come to the driver, at most
    1 / least for each depth, each with no more next symbols than there are bytes."""
    full = materialise(
        vocabulary.mapInArrow(_context_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "contexts"
    )
    total = full.agg(F.sum("n")).first()[0] or 0
    counts = []
    for depth in range(DEPTH + 1):
        low = (1 << (8 * depth + 8)) - 1
        pad = (_PADDED >> (8 * depth)) << (8 * depth + 8)
        key = F.col("key").bitwiseAND(F.lit(low)).bitwiseOR(F.lit(pad)) if depth < DEPTH else F.col("key")
        at_depth = full.groupBy(key.alias("key")).agg(F.sum("n").alias("n"))
        # A context that does not reach this depth has a pad where the depth's first byte should be.
        if depth:
            at_depth = at_depth.filter(F.shiftrightunsigned("key", 8 * depth).bitwiseAND(F.lit(0xFF)) != PAD)
        context = F.shiftrightunsigned("key", 8)
        often = at_depth.groupBy(context.alias("context")).agg(F.sum("n").alias("all")).filter(F.col("all") >= max(1.0, least * total))
        got = at_depth.withColumn("context", context).join(often.hint("shuffle_merge"), "context").select("key", "n").toPandas()
        keys = got["key"].to_numpy(dtype=np.int64).astype(np.uint64)
        order = np.argsort(keys)
        counts.append((keys[order], got["n"].to_numpy(dtype=np.int64)[order]))
        if not len(keys):
            break
    return Spelling(counts, gain)


# --- the tree over tokens --------------------------------------------------------------------------

_SHIFT = 23  # ids of common tokens are below 1 / COMMON, which is below 2 ** _SHIFT


class _Ids(dict):
    """The number of each common token, by falling count. Other tokens have one below -1 made of a hash: it
    tells contexts apart but is not looked up."""

    def __missing__(self, token: bytes) -> int:
        return -2 - (xxhash.xxh3_64_intdigest(token) & 0x3FFFFFFF)


_NUMBERED = "row long, doc_id long, held_out boolean, n_tokens long, ids binary, token binary, m long"
_NUMBERED_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]


def _numbered(ids: _Ids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with its tokens' numbers, the end's included; and one for each other token of it."""
        names = [x.split()[0] for x in _NUMBERED.split(", ")]
        for batch in batches:
            lengths, numbers, others, times, of = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                tokens = [*_tokens(text), b""]
                x = np.fromiter(map(ids.__getitem__, tokens), dtype=np.int32, count=len(tokens))
                met = Counter(map(tokens.__getitem__, np.flatnonzero(x < 0).tolist()))
                lengths.append(len(x))
                numbers.append(x.tobytes())
                others += met
                times += met.values()
                of.append(len(met))
            n, k = batch.num_rows, len(others)
            null = lambda c, m: pa.nulls(m, _NUMBERED_TYPES[c])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), null(5, n), null(6, n)], names)
            row = np.repeat(batch.column(0).to_numpy(), of)
            yield pa.RecordBatch.from_arrays([pa.array(row), *(null(c, k) for c in range(1, 5)), pa.array(others, pa.binary()), pa.array(times, pa.int64())], names)

    return run


def laid(numbers: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers end to end with two ends before every text, the text of each, and its place in the text
    (below 0 for the two ends before it)."""
    parts = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in numbers]
    every = np.concatenate([np.empty(0, dtype=np.int64), *(y for x in parts for y in (np.array([end, end]), x))])
    lengths = np.array([len(x) + 2 for x in parts], dtype=np.int64)
    place = np.arange(len(every)) - np.repeat(np.cumsum(lengths) - lengths, lengths) - 2
    return every, np.repeat(np.arange(len(parts)), lengths), place


def _find(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in sorted values, or -1."""
    if not len(values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


class Tokens:
    """The tree over tokens. pairs: sorted codes a << _SHIFT | b and counts of two tokens in a row, the
    pair of two ends (a text's begin) included; triples: sorted codes pair << _SHIFT | c and counts."""

    def __init__(self, tokens: list[bytes], n: np.ndarray, all_tokens: int, kinds: int, spelled: np.ndarray):
        self.ids = _Ids({t: i for i, t in enumerate(tokens)})
        self.n, self.all_tokens, self.kinds = n.astype(np.float64), all_tokens, kinds
        self.root = self.root_probability(self.n, spelled)
        self.pairs = self.triples = np.empty(0, dtype=np.int64)
        # The last place of each is what -1, not found, gives.
        self.left1, self.share1 = np.ones(len(tokens) + 1), np.zeros(1)
        self.left2, self.share2 = np.ones(1), np.zeros(1)

    def root_probability(self, n: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """n of the tokens seen, smoothed towards the spelling in the proportion of kinds to tokens."""
        if not self.all_tokens:
            return 10.0**spelled
        return (n + self.kinds * 10.0**spelled) / (self.all_tokens + self.kinds)

    def _kept(self, context: np.ndarray, n: np.ndarray, totals: np.ndarray, parent: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each context is kept, what it leaves to its parent, the share of each next token):
        n by context and next token, totals by context, parent the parent's probability of each n."""
        size = len(totals)
        kinds = np.bincount(context, minlength=size) + 1.0
        seen = np.bincount(context, weights=n, minlength=size)
        whole = np.maximum(totals, seen) + kinds
        left = (whole - seen) / whole
        share = n / whole[context]
        better = np.bincount(context, weights=n * np.log((share + left[context] * parent) / parent), minlength=size)
        better += np.maximum(totals - seen, 0) * np.log(left)
        return better >= gain, left, share

    def learn(self, pairs: np.ndarray, pair_n: np.ndarray, triples: np.ndarray, triple_n: np.ndarray, gain: float = GAIN) -> None:
        mask = (1 << _SHIFT) - 1
        follows = pairs >> _SHIFT
        parent = self.root[pairs & mask]
        kept, left, share = self._kept(follows, pair_n, self.n, parent, gain)
        context = (triples >> _SHIFT).astype(np.int64)
        middle, last = pairs[context] & mask, triples & mask
        at = _find(pairs, (middle << _SHIFT) | last)
        above = np.where(at >= 0, share[at] if len(share) else 0.0, 0.0) + left[middle] * self.root[last]
        kept2, left2, share2 = self._kept(context, triple_n, pair_n.astype(np.float64), above, gain)
        kept[pairs[kept2] & mask] = True  # what is kept keeps its suffixes
        self.left1 = np.r_[np.where(kept, left, 1.0), 1.0]
        self.share1 = np.r_[np.where(kept[follows], share, 0.0), 0.0]
        self.left2 = np.r_[np.where(kept2, left2, 1.0), 1.0]
        keep = kept2[context]
        self.pairs, self.triples, self.share2 = pairs, triples[keep], np.r_[share2[keep], 0.0]

    def nameless(self) -> Tokens:
        """What probabilities needs: tasks that have numbers already hold neither the tokens nor their counts."""
        out = copy.copy(self)
        out.ids, out.n = _Ids(), np.empty(0)
        return out

    def probabilities(self, every: np.ndarray) -> np.ndarray:
        """The probability of each id from the third on, after the two before; for -1, that of any such
        token, without its own part at the root."""
        return self.after(every[:-2], every[1:-1], every[2:])

    def after(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The same of each c after a and b."""
        a, b, c = (np.maximum(x, -1) for x in (a, b, c))
        p = np.where(c >= 0, self.root[c] if len(self.root) else 1.0, 1.0)
        pair = np.where((a >= 0) & (b >= 0), _find(self.pairs, (a << _SHIFT) | b), -1)
        after = np.where((b >= 0) & (c >= 0), _find(self.pairs, (b << _SHIFT) | c), -1)
        p = self.share1[after] + self.left1[b] * p
        triple = np.full(len(p), -1)
        ok = np.flatnonzero((pair >= 0) & (c >= 0))
        triple[ok] = _find(self.triples, (pair[ok] << _SHIFT) | c[ok])
        return self.share2[triple] + self.left2[pair] * p


def _code_counts(end: int, limit: int, pairs: np.ndarray | None):
    """Counts of pairs of numbers below limit; with pairs, of a pair and the id after it, where the last two are a pair too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            codes, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        for batch in batches:
            x, text, _ = laid(batch.column(0).to_pylist(), end)
            x = np.where((x >= 0) & (x < limit), x, -1)
            codes = (x[:-1] << _SHIFT) | x[1:]
            codes[(x[:-1] < 0) | (x[1:] < 0) | (text[:-1] != text[1:])] = -1
            if pairs is not None:
                at = _find(pairs, codes)
                codes = np.where((at[:-1] >= 0) & (at[1:] >= 0), (at[:-1] << _SHIFT) | x[2:], -1)
            codes = codes[codes >= 0]
            held.append(np.unique(codes, return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def _often(docs: DataFrame, counted, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The codes counted at least `least` times, sorted, and their counts: a bounded number of them."""
    rows = docs.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
    rows = rows.sort_values("code")
    return rows["code"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)


# --- long contexts ---------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What makes the keys of what a context leaves to its parent.
_LEFT = 0x632BE59BD9B4E019


def long_contexts(every: np.ndarray, long: int = LONG) -> np.ndarray:
    """The hash of the `long` numbers before each position from `long` on."""
    v = every.view(np.uint64)
    n = max(0, len(every) - long)
    h = np.full(n, long, dtype=np.uint64)
    for k in range(long):
        h = (h ^ v[k : k + n]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def _candidates(every: np.ndarray, place: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose long context may be kept, the context's hash)."""
    h = long_contexts(every, long)
    at = np.flatnonzero(place[long:] >= long)
    return at + long, h[at]


def part_bits(all_tokens: int) -> int:
    """The hashes are dealt by their first bits, so many that a part has few of them whatever the corpus."""
    return min(PART_BITS, max(0, -(-all_tokens // PART) - 1).bit_length())


def _part(hashes: np.ndarray, deal: int) -> np.ndarray:
    return ((hashes >> np.uint64(1)) >> np.uint64(63 - deal)).astype(np.uint16)


def _slices(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The parts that sorted part has, and where each begins and ends."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    return part[first], list(zip(first.tolist(), [*first[1:].tolist(), len(part)]))


def _marks(heads: np.ndarray) -> pa.RecordBatch:
    """part, heads of sorted heads: the hashes' bits up to 32 after those of the part. These are packed."""
    parts, at = _slices((heads >> np.uint64(32)).astype(np.uint16))
    low = (heads & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([low[a:b].tobytes() for a, b in at], pa.binary())], ["part", "heads"])


def _context_marks(end: int, long: int, deal: int):
    """The heads of the candidates of some texts, of each two at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            heads = np.sort(np.concatenate(held))
            return _marks(heads[np.r_[True, True, heads[2:] != heads[:-2]][: len(heads)]])

        for batch in batches:
            every, _, place = laid(batch.column(0).to_pylist(), end)
            held.append(_candidates(every, place, long)[1] >> np.uint64(32 - deal))
            size += len(held[-1])
            if size > 2 * HELD:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def _key_marks(deal: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(32 - deal))
            size += batch.num_rows
            if size > HELD:
                yield _marks(np.sort(np.concatenate(held)))
                held, size = [], 0
        if size:
            yield _marks(np.sort(np.concatenate(held)))

    return run


def recurring_map(ids: DataFrame, end: int, deal: int, long: int = LONG) -> np.ndarray:
    """The bits of the candidates that are met twice or more: a fixed number of bytes."""
    return _bit_map(ids.mapInArrow(_context_marks(end, long, deal), "part int, heads binary"), deal, True)


def value_map(values: DataFrame, deal: int) -> np.ndarray:
    """The bits of the keys that have a value."""
    return _bit_map(values.select("key").mapInArrow(_key_marks(deal), "part int, heads binary"), deal, False)


def _bit_map(marks: DataFrame, deal: int, twice: bool) -> np.ndarray:
    """The bits of all heads, or of those met twice."""
    size = 1 << (MAP_BITS - deal)

    def dense(group: pa.Table) -> pa.Table:
        heads = np.sort(np.frombuffer(b"".join(group.column("heads").to_pylist()), dtype=np.uint32))
        if twice:
            heads = heads[1:][heads[1:] == heads[:-1]]
        out = np.zeros(size, dtype=np.uint8)
        out[heads >> np.uint32(32 - MAP_BITS + deal)] = 1
        bits = np.packbits(out, bitorder="little").tobytes()
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    words = size // 64
    for r in marks.groupBy("part").applyInArrow(dense, "part int, bits binary").collect():
        out[r["part"] * words : (r["part"] + 1) * words] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out


def _recurring(every: np.ndarray, place: np.ndarray, bits: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions whose long context is looked up, the context's hash, the hash of it with the next number)."""
    at, c = _candidates(every, place, long)
    bit = c >> np.uint64(64 - MAP_BITS)
    met = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    at, c = at[met], c[met]
    g = (c ^ every[at].view(np.uint64)) * _ODD
    return at, c, g ^ (g >> np.uint64(31))


def _long_counts(tree: Tokens, bits: np.ndarray, long: int):
    """c, g, n, p: counts of long contexts with each next token (of those that are not common together, g null),
    and the parent's probability of it."""
    end, tree = tree.ids[b""], tree.nameless()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            key, c, g, n, p, common = (np.concatenate(x) for x in zip(*held))
            _, first, of = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(of, weights=n).astype(np.int64)
            c, g, p, rare = c[first], g[first], p[first], ~common[first]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(g.view(np.int64), mask=rare), pa.array(n), pa.array(p, mask=rare)], ["c", "g", "n", "p"])

        for batch in batches:
            every, _, place = laid(batch.column(0).to_pylist(), end)
            at, c, g = _recurring(every, place, bits, long)
            common = every[at] >= 0
            key, first, n = np.unique(np.where(common, g, c ^ np.uint64(_LEFT)), return_index=True, return_counts=True)
            one = at[first]
            p = tree.after(every[one - 2], every[one - 1], every[one])
            held.append((key, c[first], g[first], n, p, common[first]))
            size += len(key)
            if size > HELD:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def long_values(counts: DataFrame, gain: float = GAIN, often: float = float("inf")) -> DataFrame:
    """key, value, rest, often: what a kept long context adds to the log10 probability of its parent. Keys: the context
    with a next token; and what the context leaves, for any other next token. rest is the value of the first kind less
    what the context leaves: held-out texts ask for both. often: met at least so many times."""
    grams = counts.repartition("c").groupBy("c", "g").agg(F.sum("n").alias("n"), F.max("p").alias("p"))
    own = Window.partitionBy("c")
    seen = F.coalesce(F.sum(F.when(F.col("g").isNotNull(), F.col("n"))).over(own), F.lit(0))
    grams = grams.select("*", (F.sum("n").over(own) + F.count("g").over(own) + 1).cast("double").alias("whole"), seen.alias("seen"), F.sum("n").over(own).alias("met"), F.min("g").over(own).alias("least"))
    # A context met once may share a bit of the map with another: it is none, whatever it would gain.
    grams = grams.filter("met > 1").withColumn("left", (F.col("whole") - F.col("seen")) / F.col("whole"))
    times = F.when(F.col("g").isNull(), F.col("left")).otherwise((F.col("n") / F.col("whole") + F.col("left") * F.col("p")) / F.col("p"))
    grams = grams.withColumn("times", times).withColumn("better", F.sum(F.col("n") * F.log("times")).over(own)).filter(F.col("better") >= gain)
    # One row of each context: that of the tokens that are not common, or else the least g.
    one = F.col("g").isNull() | ((F.col("seen") == F.col("met")) & (F.col("g") == F.col("least")))
    row = lambda key, value, rest, n: F.struct(key.alias("key"), value.alias("value"), rest.cast("double").alias("rest"), (n >= often).alias("often"))
    by_token = F.array(row(F.col("g"), F.log10("times"), F.log10("times") - F.log10("left"), F.col("n")))
    none = F.array().cast("array<struct<key: bigint, value: double, rest: double, often: boolean>>")
    any_ = F.array(row(F.col("c").bitwiseXOR(F.lit(_LEFT)), F.log10("left"), F.lit(0.0), F.col("met")))
    rows = grams.select(F.concat(F.when(F.col("g").isNotNull(), by_token).otherwise(none), F.when(one, any_).otherwise(none)).alias("r"))
    return rows.select(F.explode("r").alias("r")).select("r.*")


# --- scores ----------------------------------------------------------------------------------------

#: What a document's own row has; and, null there, what is asked for some documents (a chunk of them): keys of a part, the
#: documents' places in the chunk (of 16 bits), how often (below 0 by held-out texts), packed.
_OWN = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
_OWN_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_ASKED = f"part int, chunk long, place int, keys binary, places binary, times binary, {_OWN}"
_ANSWERED = f"chunk long, place int, places binary, sums binary, {_OWN}"
_VALUED = "part int, keys binary, vals binary, rests binary"
CHUNK = 1 << 16


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _joined(column, dtype) -> np.ndarray:
    """The numbers packed in all rows of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _scored(tree: Tokens, bits: np.ndarray, long: int, valued: np.ndarray, often: tuple[np.ndarray, np.ndarray, np.ndarray], deal: int):
    """valued: the map of the keys with a value; often: those met often, sorted, with value and rest."""
    base = np.r_[np.log10((tree.n + 0.5) / (tree.all_tokens + 0.5 * (tree.kinds + 1))), 0.0]
    met = np.r_[tree.n > 0, False]
    end, tree = tree.ids[b""], tree.nameless()
    names = _names(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's own row, with what its common tokens, short contexts and frequent long ones give; and what
        is asked for its other long contexts."""
        held: list[tuple[np.ndarray, ...]] = []
        chunk = size = filled = 0

        def asked() -> pa.RecordBatch:
            key, place, times = (np.concatenate(x) for x in zip(*held))
            part = _part(key, deal)
            order = np.argsort(part, kind="stable")
            parts, at = _slices(part[order])
            packed = [pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for x in (key[order], place[order], times[order])]
            k = len(parts)
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(k, chunk)), pa.nulls(k, pa.int32()), *packed, *(pa.nulls(k, t) for t in _OWN_TYPES)], names)

        for batch in batches:
            n = batch.num_rows
            row, out = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            if size > HELD or filled + n > CHUNK:
                if size:
                    yield asked()
                held, size, filled = [], 0, 0
            if not filled and n:
                chunk = int(row[0])
            every, text, place = laid(batch.column(4).to_pylist(), end)
            own = place >= 0
            logs = np.r_[0.0, 0.0, np.log10(tree.probabilities(every))] if n else np.empty(0)
            x = np.maximum(every, -1)
            score = np.bincount(text, weights=np.where(own, logs, 0.0), minlength=n)
            bases = np.bincount(text, weights=np.where(own, base[x], 0.0), minlength=n)
            known = np.bincount(text, weights=own & met[x], minlength=n).astype(np.int64)
            at, c, g = _recurring(every, place, bits, long)
            of, common = text[at], every[at] >= 0
            h = out[of].astype(bool)
            any_ = h | ~common
            key, of, minus = np.r_[g[common], (c ^ np.uint64(_LEFT))[any_]], np.r_[of[common], of[any_]], np.r_[h[common], np.zeros(int(any_.sum()), dtype=bool)]
            bit = key >> np.uint64(64 - MAP_BITS)
            some = (valued[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            key, of, minus = key[some], of[some], minus[some]
            found = _find(often[0], key)
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                score += np.bincount(of[hit], weights=np.where(minus[hit], often[2][found[hit]], often[1][found[hit]]), minlength=n)
                key, of, minus = (y[found < 0] for y in (key, of, minus))
            # Each key of a text once; a text asks for a key by one sign.
            order = np.lexsort((key, of))
            key, of, minus = key[order], of[order], minus[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])][: len(key)])
            times = np.diff(np.r_[first, len(key)])
            held.append((key[first], (of[first] + filled).astype(np.uint16), np.where(minus[first], -times, times).astype(np.int32)))
            none = pa.nulls(n, pa.binary())
            places = pa.array(np.arange(filled, filled + n), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(row % (1 << deal), pa.int32()), pa.array(np.full(n, chunk)), places, none, none, none, *batch.columns[:4], pa.array(known), pa.array(bases), pa.array(score)], names)
            size, filled = size + len(first), filled + n
        if size:
            yield asked()

    return run


def _packed_values(deal: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            part = _part(columns[0], deal)
            order = np.argsort(part, kind="stable")
            parts, at = _slices(part[order])
            packed = [pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for x in (y[order] for y in columns)]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *packed], _names(_VALUED))

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            size += batch.num_rows
            if size > HELD:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    return run


def _answers(asked: pa.Table, values: pa.Table) -> pa.Table:
    """Documents' own rows as they are; and for each row of keys what those that have a value give."""
    is_own = pc.is_valid(asked.column("row"))
    own, asked = asked.filter(is_own), asked.filter(pc.invert(is_own))
    known, vals, rests = (_joined(values.column(c), t) for c, t in (("keys", np.uint64), ("vals", np.float64), ("rests", np.float64)))
    order = np.argsort(known)
    known, vals, rests = known[order], vals[order], rests[order]
    keys, places, times = (_joined(asked.column(c), t) for c, t in (("keys", np.uint64), ("places", np.uint16), ("times", np.int32)))
    found = _find(known, keys)
    hit = np.flatnonzero(found >= 0)
    found, places, times = found[hit], places[hit], times[hit]
    sums = np.abs(times) * np.where(times < 0, rests[found], vals[found])
    ends = np.searchsorted(hit, np.cumsum([len(x) // 8 for x in asked.column("keys").to_pylist()]))
    at = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    k, null = len(at), lambda t, m: pa.nulls(m, t)
    packed = [pa.array([x[a:b].tobytes() for a, b in at], pa.binary()) for x in (places, sums)]
    given = [asked.column("chunk"), null(pa.int32(), k), *packed, *(null(t, k) for t in _OWN_TYPES)]
    kept = [own.column("chunk"), own.column("place"), null(pa.binary(), own.num_rows), null(pa.binary(), own.num_rows), *(own.column(c) for c in _names(_OWN))]
    return pa.concat_tables([pa.table(x, names=_names(_ANSWERED)) for x in (kept, given)])


def _added(group: pa.Table) -> pa.Table:
    """The own rows of a chunk with what was given for them."""
    is_own = pc.is_valid(group.column("row"))
    own, given = group.filter(is_own), group.filter(pc.invert(is_own))
    sums = np.bincount(_joined(given.column("places"), np.uint16), weights=_joined(given.column("sums"), np.float64), minlength=CHUNK)
    score = own.column("score").to_numpy() + sums[own.column("place").to_numpy()]
    return pa.table([*(own.column(c) for c in _names(_OWN)[:-1]), pa.array(score)], names=_names(_OWN))


def _rare(spelling: Spelling, all_tokens: int, kinds: int):
    names = ["row", "n_known", "base", "score"]
    root = Tokens([], np.empty(0), all_tokens, kinds, np.empty(0)).root_probability

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches):
            token = batch.column(1).dictionary_encode()
            spelled = spelling.score(token.dictionary.to_pylist())[token.indices.to_numpy(zero_copy_only=False)]
            m, c = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
            base = m * np.log10((c + 0.5) / (all_tokens + 0.5 * (kinds + 1)))
            score = m * np.log10(np.maximum(root(c, spelled), 1e-300))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(c > 0, m, 0).astype(np.int64)), pa.array(base), pa.array(score)], names)

    return run


def common_tokens(vocabulary: DataFrame, common: float = COMMON, gain: float = GAIN) -> tuple[Tokens, Spelling]:
    """The tree with its root only, and the spelling. vocabulary: the token_counts of the training texts."""
    all_tokens, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    spelling = grow_spelling(vocabulary, gain=gain)
    often = vocabulary.filter((F.col("n") >= max(1.0, common * all_tokens)) | (F.col("token") == F.lit(b""))).toPandas()
    often = often.assign(token=[bytes(t) for t in often["token"]]).sort_values(["n", "token"], ascending=[False, True])
    tokens, n = often["token"].tolist(), often["n"].to_numpy(dtype=np.int64)
    if b"" not in tokens:  # no text to learn from
        tokens, n = [*tokens, b""], np.r_[n, 0]
    return Tokens(tokens, n, all_tokens, kinds, spelling.score(tokens)), spelling


def grow(tree: Tokens, ids: DataFrame, pairs: float = PAIRS, gain: float = GAIN) -> None:
    """Adds the short contexts. ids: one column, the numbers of the training texts' tokens."""
    least = max(2.0, pairs * tree.all_tokens)
    limit = int((tree.n >= least).sum())
    end = tree.ids[b""]
    codes, code_n = _often(ids, _code_counts(end, limit, None), least)
    if len(codes):
        triples, triple_n = _often(ids, _code_counts(end, limit, codes), least)
        tree.learn(codes, code_n, triples, triple_n, gain)


def language_scores(docs: DataFrame, common: float = COMMON, pairs: float = PAIRS, gain: float = GAIN, long: int = LONG) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the documents that are not held out. Null text is empty: its end is its only token. Null
    ids belong to the training part. Every row is scored by itself, whatever ids or texts it shares with
    others. Without training texts every token is unknown and only spelled, uniformly.
    """
    capped_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_split() == 1).alias("held_out"), text_or_empty().cast("binary").alias("bytes"))
    with brief_shuffles(docs.sparkSession):
        vocabulary = materialise(token_counts(docs.filter("not held_out").select(F.col("bytes").alias("text"))), "vocabulary")
        tree, spelling = common_tokens(vocabulary, common, gain)
        # A row's number is fixed when it is written here.
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "bytes").mapInArrow(_numbered(tree.ids), _NUMBERED)
        numbered = materialise(numbered, "numbered", "zstd")
        # A row for each document that has tokens which are not common.
        rare = numbered.filter("token is not null").select("row", "token", "m").join(vocabulary.hint("shuffle_merge"), "token", "left")
        rare = rare.select("row", "token", "m", F.coalesce("n", F.lit(0)).alias("c")).mapInArrow(
            _rare(spelling, tree.all_tokens, tree.kinds), "row long, n_known long, base double, score double"
        )
        rare = materialise(rare.groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("n_known", "base", "score")]), "rare")
        texts = numbered.filter("token is null").select("row", "doc_id", "held_out", "n_tokens", "ids")
        training = texts.filter("not held_out").select("ids")
        grow(tree, training, pairs, gain)
        deal = part_bits(tree.all_tokens)
        bits = recurring_map(training, tree.ids[b""], deal, long)
        counts = training.mapInArrow(_long_counts(tree, bits, long), "c long, g long, n long, p double")
        values = materialise(long_values(counts, gain, max(2.0, pairs * tree.all_tokens)), "values")
        valued = value_map(values, deal)
        # Those met often, at most 1 / pairs of each kind, are looked up beside the text: no part has many that ask for one key.
        often = values.filter("often").select("key", "value", "rest").toPandas()
    keys = often["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    often = (keys[order], *(often[c].to_numpy(dtype=np.float64)[order] for c in ("value", "rest")))
    asked = texts.mapInArrow(_scored(tree, bits, long, valued, often, deal), _ASKED)
    packed = values.filter("not often").select("key", "value", "rest").mapInArrow(_packed_values(deal), _VALUED)
    answered = asked.groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(_answers, _ANSWERED)
    rows = answered.groupBy("chunk").applyInArrow(_added, _OWN).join(rare.hint("shuffle_merge"), "row", "left")
    both = {c: F.col(c) + F.coalesce(f"rare_{c}", F.lit(0)) for c in ("n_known", "base", "score")}
    return rows.select(
        "doc_id", "held_out", "n_tokens", both["n_known"].alias("n_known"), F.lit(tree.all_tokens).cast("long").alias("train_tokens"), both["base"].alias("base_score"), both["score"].alias("score")
    )
