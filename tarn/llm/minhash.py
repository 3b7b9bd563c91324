"""MinHash near duplicates by an inverted join on the coordinates of signatures.

A text's set of shingles has a signature of COORDINATES minima, and a text is posted under each (coordinate, value)
pair. Texts whose sets have a Jaccard similarity of 0.8 share at least MATCHES pairs (but for one link in 12 million),
and they share one of the COORDINATES - MATCHES + 1 rarest pairs of either, its prefix. So only prefixes are posted; pairs that
no other text has take up most of them and need no posting. Where lists are merged, what can't link is skipped by its
size, and collisions are counted on four bits of each coordinate (never fewer than the real ones); what reaches MATCHES
is confirmed on the whole sets. Texts of equal sets are one node.

Groups are settled without all their pairs:

1. Every text of a list meets the list's lowest one, and confirmed links join them up.
2. Only lists that are not one component by then are merged, and only pairs across components are counted. These pairs
   give stars of candidates; their connected parts are compared on whole sets, each node's set once or, in a large part,
   once for each block that its block meets. Only links come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialise, small_batches, text_or_empty
from tarn.llm.components import components

#: Percent of the union that the intersection must have.
SIMILAR = 80
#: Coordinates of a signature, how many must collide, and how many of the rarest are posted.
COORDINATES, MATCHES = 64, 33
PREFIX = COORDINATES - MATCHES + 1
#: Rows of a list that one task merges, and rows and bytes of sets; larger ones are cut into blocks that meet in pairs.
LIST_ROWS, SET_ROWS, SET_BYTES = 4096, 1024, 4 << 20
#: Bits of the map of texts whose sets are wanted: a table of 2 ** 18 rows at most, which keeps most others from being
#: shuffled and lets all pass, at that cost, once it is full.
MAP_BITS = 24
#: Words whose hashes a task keeps.
KNOWN = 200_000
_SKETCH = ["s0", "s1", "s2", "s3"]
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _draws(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


_SEEDS, _FACTORS, _NAMES = _draws(COORDINATES, 1), _draws(COORDINATES, 2) | np.uint64(1), _draws(COORDINATES, 3)


class _Hashes(dict):
    """Hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's two-word shingles, sorted; a text of one word is a shingle, one of none has none."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) > 1:
        h = h[:-1] * _ODD + h[1:]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(found: np.ndarray) -> np.ndarray:
    """The minima of a set of hashes, one for each coordinate."""
    least = np.full(COORDINATES, ~np.uint64(0))
    for low in range(0, len(found), 2048):
        np.minimum(least, ((found[low : low + 2048, None] ^ _SEEDS) * _FACTORS).min(axis=0), out=least)
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen to a word."""
    four = (((least ^ (least >> np.uint64(31))) * _ODD) >> np.uint64(60)).reshape(-1, 16)
    return np.bitwise_or.reduce(four << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


_SIGNED = "doc_id long, th long, node long, n long, pairs array<long>, s0 long, s1 long, s2 long, s3 long"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        sets = [shingles(t.as_py() or b"", hashes) for t in batch.column(1).cast(pa.binary())]
        least = np.array([signature(s) for s in sets]).reshape(-1, COORDINATES)
        sketches = np.array([sketch(x) for x in least]).reshape(-1, 4).view(np.int64)
        node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64)
        pairs = pa.ListArray.from_arrays(np.arange(0, least.size + 1, COORDINATES, dtype=np.int32), pa.array((least ^ _NAMES).view(np.int64).ravel()))
        columns = [batch.column(0), batch.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pairs, *[pa.array(sketches[:, k]) for k in range(4)]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "n", "pairs", *_SKETCH])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        sets = [shingles(t.as_py() or b"", hashes).tobytes() for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether intersections of so many are enough for sets of so many."""
    return 100 * both >= SIMILAR * (a + b - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(k)] for k in (2, 3))
        ok = [bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in zip(a, b)]
        yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def collisions(a: list[Column], b: list[Column]) -> Column:
    """Of how many coordinates two sketches have the same four bits."""
    apart = F.lit(0)
    for x, y in zip(a, b):
        d = x.bitwiseXOR(y)
        for k in (2, 1):  # folds each four bits into their lowest
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        apart += F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return COORDINATES - apart


def _collide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a ^ b
    for k in (2, 1):
        d |= d >> np.uint64(k)
    return COORDINATES - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def _root(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (a lower or the same position for each, whose own label is itself) after joining a with b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]


def _stars(rows: pa.Table, label: np.ndarray) -> pa.RecordBatch:
    node = rows.column("node").to_numpy()
    at = np.nonzero(label != np.arange(len(label)))[0]
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["u", "v"])


def _merged(rows: pa.Table) -> pa.RecordBatch:
    """Stars of the pairs of a list's rows that are in different components, of like size and collide often enough.
    Rows are sorted by list and size."""
    cell, n, root, side = (rows.column(c).to_numpy() for c in ("cell", "n", "root", "side"))
    marks = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in _SKETCH], axis=1)
    label, at, shift = np.arange(len(n)), np.arange(len(n)), 1
    while len(at):
        at = at[at + shift < len(n)]
        at = at[(cell[at] == cell[at + shift]) & (100 * n[at] >= SIMILAR * n[at + shift])]  # sorted: what is too large now stays too large
        a = at[(root[at] != root[at + shift]) & (side[at] | side[at + shift] == 3)]
        a = a[_collide(marks[a], marks[a + shift]) >= MATCHES]
        label = _root(label, a, a + shift)
        shift += 1
    return _stars(rows, label)


def _compared(rows: pa.Table) -> pa.RecordBatch:
    """Links across components among the rows of each cell, by their whole sets. Reduced to stars."""
    cell, root, side = (rows.column(c).to_numpy() for c in ("cell", "root", "side"))
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("shingles")]
    n = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    keys = np.concatenate(sets) ^ np.repeat(cell.view(np.uint64) * _ODD, n)  # cells have keys of their own
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    group, starts = np.cumsum(first) - 1, np.nonzero(first)[0]
    sizes, place = np.diff(np.append(starts, len(keys))), np.empty(len(keys), dtype=np.int64)
    place[order] = group
    owners, ends, label = owner[order], np.cumsum(n), np.arange(len(sets))
    for i in range(len(sets)):
        mine = place[ends[i] - n[i] : ends[i]]
        mine = mine[sizes[mine] > 1]
        both = np.zeros(len(sets), dtype=np.int64)
        step = max(1, 4_000_000 // len(sets))
        for low in range(0, len(mine), step):
            some = mine[low : low + step]
            many = sizes[some]
            at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both += np.bincount(owners[at], minlength=len(sets))
        other = np.nonzero(both)[0]
        other = other[(other > i) & (cell[other] == cell[i]) & (root[other] != root[i]) & (side[other] | side[i] == 3)]
        other = other[similar(both[other], n[other], n[i])]
        label = _root(label, np.full(len(other), i), other)
    return _stars(rows, label)


def _by_cells(solve: Callable[[pa.Table], pa.RecordBatch], most: int):
    """Hands whole cells to solve, about `most` bytes at once; partitions hold whole cells, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most or not batch.num_rows:
                continue
            rows = pa.Table.from_batches(held)
            cells = rows.column("cell").to_numpy()
            last = int(np.argmax(cells == cells[-1]))  # the last cell may go on
            if last:
                yield solve(rows.slice(0, last))
                held = rows.slice(last).to_batches()
                size = sum(x.nbytes for x in held)
        if sum(x.num_rows for x in held):
            yield solve(pa.Table.from_batches(held))

    return run


def dealt(rows: DataFrame, blocks: Column, order: list[str]) -> DataFrame:
    """rows (cell, node, ...) dealt by cell and sorted by it and order. A cell is cut into `blocks` (an aggregate over its rows)
    by a hash of the node, and every two blocks meet in a part of their own: side is 3 for a block with itself, else 1
    or 2, and both together are 3."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows_"), F.ceil(blocks).cast("int").alias("g_")).filter("rows_ > 1")
    met = rows.join(sizes.select("cell", "g_"), "cell").withColumn("own_", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("g_")).cast("int"))
    met = met.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("g_") - 1)))
    part = F.when(F.col("g_") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own_", "other_"), F.greatest("own_", "other_")))
    side = F.when(F.col("own_") == F.col("other_"), 3).when(F.col("own_") < F.col("other_"), 1).otherwise(2)
    met = met.withColumn("cell", part).withColumn("side", side.cast("int")).drop("g_", "own_", "other_")
    return met.repartition("cell").sortWithinPartitions("cell", *order)


def posted(nodes: DataFrame) -> DataFrame:
    """cell, node, n and sketch: the nodes under the pairs of their prefixes that other nodes have too."""
    pairs = nodes.select("node", F.explode("pairs").alias("cell"))
    shared = pairs.join(pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "cell")
    ranked = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("many", "cell"))).alias("ranked"))
    left = F.lit(PREFIX - COORDINATES) + F.size("ranked")  # pairs of its own come first
    prefix = ranked.filter(left > 0).select("node", F.transform(F.slice("ranked", F.lit(1), left), lambda x: x["cell"]).alias("cells"))
    return prefix.join(nodes.select("node", "n", *_SKETCH), "node").select(F.explode("cells").alias("cell"), "node", "n", *_SKETCH)


def _sets_of(some: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and shingles of some nodes, made again from the text of the lowest row of each."""
    names = ["none_", "d_", "th_"]
    rows = some.select("node").distinct().join(nodes, "node").select("node", F.col("low.none").alias("none_"), F.coalesce("low.doc_id", F.lit(0)).alias("d_"), F.col("low.th").alias("th_"))
    rows = materialise(rows, "wanted")
    place, bit = F.shiftright(F.col("th_").bitwiseAND((1 << MAP_BITS) - 1), 6).alias("place_"), F.expr("shiftleft(1L, cast(th_ & 63 as int))")
    bits = rows.groupBy(place).agg(F.bit_or(bit).alias("bits_"))
    texts = docs.select(F.col("doc_id").isNull().alias("none_"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d_"), F.xxhash64(text_or_empty()).alias("th_"), "text")
    texts = texts.select("*", place).join(F.broadcast(bits), "place_").filter(F.col("bits_").bitwiseAND(bit) != 0).select(*names, "text")
    found = texts.join(rows.hint("shuffle_merge"), names).select("node", "text").mapInArrow(_sets, "node long, shingles binary")
    return materialise(found.dropDuplicates(["node"]), "sets")


def groups(docs: DataFrame, signed: DataFrame, list_rows: int = LIST_ROWS, set_rows: int = SET_ROWS) -> DataFrame:
    """node and low: for each node of signed, the least (null id last, doc_id, th) of its component."""
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    nodes = materialise(signed.filter("n > 0").groupBy("node").agg(low.alias("low"), *[F.first(c).alias(c) for c in ("n", "pairs", *_SKETCH)]), "nodes")
    cells = posted(nodes)
    lead = F.min(F.struct("node", "n", *_SKETCH)).alias("lead")
    cells = materialise(cells, "prefixes")
    leads = cells.groupBy("cell").agg(lead, F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("cell", "lead")
    met = materialise(cells.join(leads, "cell"), "lists")
    close = (F.col("node") != F.col("lead.node")) & (100 * F.least("n", "lead.n") >= SIMILAR * F.greatest("n", "lead.n"))
    close &= collisions([F.col(c) for c in _SKETCH], [F.col(f"lead.{c}") for c in _SKETCH]) >= MATCHES
    pairs = materialise(met.filter(close).select(F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")), nodes, docs)
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}")).hint("shuffle_merge")
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v")
    links = materialise(both.mapInArrow(_confirmed, "u long, v long"), "links")
    stars = components(links)
    rooted = met.drop("lead").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "rooted")
    open_ = rooted.groupBy("cell").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("cell")
    merged = dealt(rooted.join(open_, "cell", "left_semi"), F.count(F.lit(1)) / list_rows, ["n"]).mapInArrow(_by_cells(_merged, 8 << 20), "u long, v long")
    some = components(merged)
    some = materialise(some.unionByName(some.select(F.col("root").alias("node"), "root").distinct()).select("node", F.col("root").alias("cell")), "open")
    whole = some.join(_sets_of(some, nodes, docs).hint("shuffle_merge"), "node").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = F.greatest(F.count(F.lit(1)) / set_rows, F.sum(F.octet_length("shingles")) / SET_BYTES)
    more = materialise(dealt(whole, blocks, []).mapInArrow(_by_cells(_compared, SET_BYTES), "u long, v long"), "more")
    stars = components(links.unionByName(more))
    roots = nodes.select("node", "low").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("low"))
    return roots.select("node", "root").join(lowest, "root").select("node", "low")


def near_duplicates(docs: DataFrame, list_rows: int = LIST_ROWS, set_rows: int = SET_ROWS) -> DataFrame:
    """doc_id, n_shingles (distinct two-word shingles), component_id (the lowest doc_id reachable), kept (whether it is its own).

    Texts link at a Jaccard similarity of 0.8. A text of one word has that as its shingle; null, empty and blank texts
    have none and link with nothing: component_id is their own. Null ids are higher than all others, so a component of
    null ids only has a null id, and its rows are kept. Repeated rows are kept, as rows of one id. Empty input gives no rows.
    A node is 64 bits of its set's hash: among ten thousand million different texts, some two or three pairs would be taken for equal.
    """
    small_batches(docs.sparkSession)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text_or_empty()).alias("th"))
    signed = materialise(hashed.mapInArrow(_signed, _SIGNED), "signatures")
    found = signed.filter("n > 0").select("doc_id", "node", "n").join(groups(docs, signed, list_rows, set_rows), "node")
    found = found.select("doc_id", "n", F.col("low.doc_id").alias("component_id"))
    found = found.unionByName(signed.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
