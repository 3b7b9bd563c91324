"""SimHash near duplicates, found with pivot distance tables.

Fingerprints: the majority bits of the XXH64 of a text's word shingles. Equal fingerprints are one node. For
every node the Hamming distances to PIVOTS reference fingerprints are tabulated once. By the triangle inequality
two fingerprints within `bits` of each other differ by at most `bits` in every coordinate, so a pair with a
larger difference in any is discarded; survivors are verified.

Coordinates alone do not say which pairs to look at, so pairs meet in cells, whose rows are sorted by the first
coordinate; a row meets only those whose first coordinate is at most `bits` more.

* `near_duplicates` (64 bits, two apart, exact): the fingerprint is cut into blocks; two that differ in `bits`
  bits agree in all blocks but `bits`. There is a cell for every choice of those, and as many blocks as it
  takes for a cell's bits to tell all fingerprints apart, so cells do not fill up as the corpus grows.
* `similar_groups` (texts whose sets of five-word shingles have a Jaccard similarity of 0.8): 128 bits, of which
  such texts differ in about 19; RADIUS is four standard deviations more. A text is in the cells of its KEEP
  shingles of least hash; two such texts share none of them with probability 0.2 ** KEEP at most. Survivors are
  verified on the whole sets, by 32 bits of each shingle's hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import materialise, small_batches, text_or_empty
from tarn.llm.components import components

SEED, WORDS, PIVOTS = 42, 3, 16
#: Rows of a cell that one task compares at once; a larger cell is cut into blocks that meet in pairs.
CELL = 4096
#: The definition of similar texts, and how they are found.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
RADIUS, KEEP = 35, 10
#: Rows with their sets that a task holds, or a whole cell's part.
OPEN_ROWS = 8192
#: Bits of the map of nodes whose sets are wanted; it only keeps most others from being shuffled.
MAP_BITS = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pivot_values(n: int = PIVOTS) -> np.ndarray:
    """n reference fingerprints, the splitmix64 sequence of seed 1."""
    out, x, mask = [], 1, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def counted_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def simhash(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text: a bit is 1 if set in over half the shingles' hashes. A text of
    fewer words is one shingle; one of none is 0. Hashes are counted in slices, so memory stays small."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    n = len(tokens) - words + 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, 8192):
        high = min(n, low + 8192)
        shingles = map(b" ".join, zip(*(tokens[low + i : high + i] for i in range(words))))
        counts += counted_bits(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=high - low))
    return majority(counts, n)


def pivot_rows(words: int) -> np.ndarray:
    """The pivots for fingerprints of so many words of 64 bits."""
    return pivot_values(PIVOTS * words).reshape(PIVOTS, words)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
        values = np.fromiter((simhash(t or b"") for t in texts), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], ["doc_id", "th", "fp"])


def coordinates(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distances of fingerprints (rows of one or more words of 64 bits) to the pivots (likewise)."""
    return np.stack([sum(np.bitwise_count(fps[:, w] ^ p[w]).astype(np.int16) for w in range(fps.shape[1])) for p in pivots], axis=1)


def _pairs(cell: np.ndarray, fps: np.ndarray, side: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions of linked rows among rows sorted by cell and first coordinate, some at a time."""
    table = coordinates(fps, pivot_rows(fps.shape[1]))
    at, shift = np.arange(len(cell)), 1
    while True:
        at = at[at + shift < len(cell)]
        other = at + shift
        near = (cell[at] == cell[other]) & (table[other, 0] - table[at, 0] <= bits)
        at = at[near]  # sorted: what is too far now stays too far
        if not len(at):
            return
        a, b = at, at + shift
        ok = side[a] | side[b] == 3
        a, b = a[ok], b[ok]
        for k in range(1, table.shape[1]):
            ok = np.abs(table[a, k] - table[b, k]) <= bits
            a, b = a[ok], b[ok]
        ok = sum(np.bitwise_count(fps[a, w] ^ fps[b, w]).astype(np.int16) for w in range(fps.shape[1])) <= bits
        if ok.any():
            yield a[ok], b[ok]
        shift += 1


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The lowest position that each of n rows reaches over the links a, b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def _by_cells(solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], most: int = 65536):
    """Hands whole cells to solve, about `most` rows at once; partitions hold whole cells, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < most:
                continue
            rows = pa.Table.from_batches(held)
            cells = rows.column("cell").to_numpy()
            last = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            if last:
                yield from solve(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _words(rows: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy().view(np.uint64) for c in names], axis=1)


def _links(bits: int):
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """A cell's links are reduced to a spanning star, every so many of them."""
        fps, n = _words(rows, ["fp"]), rows.num_rows
        root, a, b, size = np.arange(n), [], [], 0
        for x, y in _pairs(rows.column("cell").to_numpy(), fps, rows.column("side").to_numpy(), bits):
            a.append(x)
            b.append(y)
            size += len(x)
            if size > 1_000_000:
                root = _forest(np.concatenate([np.arange(n), *a]), np.concatenate([root, *b]), n)
                a, b, size = [], [], 0
        root = _forest(np.concatenate([np.arange(n), *a]), np.concatenate([root, *b]), n)
        linked = np.nonzero(root != np.arange(n))[0]
        fp = rows.column("fp").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["u", "v"])

    return _by_cells(solve)


def _literal(p: np.uint64) -> Column:
    return F.lit(int(np.int64(p.view(np.int64))))


def _distance(names: list[str], other: list) -> Column:
    return sum((F.bit_count(F.col(c).bitwiseXOR(o)) for c, o in zip(names[1:], other[1:])), F.bit_count(F.col(names[0]).bitwiseXOR(other[0])))


def _dealt(rows: DataFrame, key: str, names: list[str], cell_rows: int) -> DataFrame:
    """rows (cell, key, the fingerprint's words) that share their cell, dealt by cell and sorted by the first coordinate.

    A cell of more than cell_rows is cut into g blocks by a hash of the key, and every two blocks meet in a part
    of their own, so that a part holds about 2 * cell_rows rows; only pairs across its blocks (or inside,
    for a block with itself) are looked at: both sides together are 3.
    """
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select("cell", F.ceil(F.col("n_") / cell_rows).cast("int").alias("g_"))
    met = rows.join(sizes, "cell").withColumn("own_", F.pmod(F.xxhash64(F.lit("block"), key), F.col("g_")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("g_") - 1)).alias("other_"))
    part = F.when(F.col("g_") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own_", "other_"), F.greatest("own_", "other_")))
    side = F.when(F.col("own_") == F.col("other_"), 3).when(F.col("own_") < F.col("other_"), 1).otherwise(2)
    first = _distance(names, [_literal(x) for x in pivot_rows(len(names))[0]])
    met = met.select(*[c for c in rows.columns if c != "cell"], part.alias("cell"), side.cast("byte").alias("side"), first.cast("short").alias("p0"))
    return met.repartition("cell").sortWithinPartitions("cell", "p0")


def blocks_for(n: int, bits: int) -> int:
    """The least number of blocks, more than bits, of which all but `bits` tell n fingerprints apart."""
    blocks = bits + 1
    while 64 * (blocks - bits) / blocks < math.log2(max(n, 2)) and blocks < 32:
        blocks += 1
    return blocks


def block_cells(bits: int, blocks: int) -> list[Column]:
    """A cell for every choice of blocks - bits of the blocks of fp."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    ones = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(ones, blocks - bits)]
    return [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)]


def fingerprint_links(nodes: DataFrame, bits: int = 2, cell_rows: int = CELL, blocks: int | None = None) -> DataFrame:
    """u, v: links between fingerprints (column fp, distinct) within `bits`, enough to connect every
    pair that is linked; not all pairs of a group. blocks: see blocks_for, which counts the nodes."""
    cells = block_cells(bits, blocks or blocks_for(nodes.count(), bits))
    rows = nodes.select("fp", F.explode(F.array(*cells)).alias("cell"))
    return _dealt(rows, "fp", ["fp"], cell_rows).mapInArrow(_links(bits), "u long, v long")


def _named(docs: DataFrame, bits: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id, th (a hash of the text) and fp of every row; fp and low, the least
    (null id last, doc_id, th) of its component."""
    small_batches(docs.sparkSession)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text_or_empty()).alias("th"))
    marked = materialise(hashed.mapInArrow(_fingerprints, "doc_id long, th long, fp long"), "fingerprints")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    nodes = materialise(marked.groupBy("fp").agg(low.alias("low")), "nodes")
    stars = components(fingerprint_links(nodes, bits, cell_rows))
    roots = nodes.join(stars.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("low"))
    return marked, roots.select("fp", "root").join(lowest, "root").select("fp", "low")


def near_duplicates(docs: DataFrame, bits: int = 2, cell_rows: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the lowest doc_id reachable).

    Documents link when their fingerprints differ in at most `bits` bits. Null text is empty: its
    fingerprint is zero and links like any other. Null ids are higher than all others, so a component
    of null ids only has a null id. Repeated rows are kept.
    """
    marked, groups = _named(docs, bits, cell_rows)
    return marked.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, bits: int = 2, cell_rows: int = CELL) -> DataFrame:
    """docs, all columns, with one row of each component: that of the lowest doc_id (of rows equal in id,
    that of the lowest hash of the text, then of the whole row)."""
    return kept_rows(docs, _named(docs, bits, cell_rows)[1])


def kept_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that are the lowest (column low) of groups, one each."""
    key = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"))
    whole = lambda k: [F.col(f"{k}.none").alias("__none"), F.coalesce(F.col(f"{k}.doc_id"), F.lit(0)).alias("__d"), F.col(f"{k}.th").alias("__th")]
    names = ["__none", "__d", "__th"]
    kept = groups.select(*whole("low")).distinct()
    rows = docs.withColumn("__key", key()).select(*docs.columns, *whole("__key"), F.xxhash64(*docs.columns).alias("__row"))
    order = Window.partitionBy(*names).orderBy("__row")
    return rows.join(kept.hint("shuffle_merge"), names, "left_semi").withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").select(*docs.columns)


# --- similar texts ---------------------------------------------------------------------------------


def shingle_set(text: bytes, words: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, sorted. A text of fewer words is one shingle; one of none has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    runs = zip(*(tokens[i:] for i in range(words))) if len(tokens) > words else [tokens]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in map(b" ".join, runs)), dtype=np.uint64))


def wide_fingerprint(found: np.ndarray) -> tuple[int, int]:
    """The 128 bits of a set of hashes: the majority of their bits, and of the bits of another hash of each."""
    out = []
    for k in range(2):
        counts = np.zeros(64, dtype=np.int64)
        for low in range(0, len(found), 8192):
            h = found[low : low + 8192]
            if k:
                h = (h ^ (h >> np.uint64(31))) * _ODD
                h ^= h >> np.uint64(29)
            counts += counted_bits(h)
        out.append(majority(counts, len(found)))
    return out[0], out[1]


def short(found: np.ndarray) -> np.ndarray:
    """The first 32 bits of a set's hashes: two of different shingles are equal once in four thousand million."""
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_SETS = "doc_id long, th long, node long, n int, fp long, fq long, cells array<long>, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [shingle_set(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
        node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in whole), dtype=np.uint64, count=len(whole))
        wide = np.array([wide_fingerprint(s) for s in whole], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        sets = [short(s) for s in whole]
        columns = [
            batch.column(0), batch.column(2), pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(wide[:, 0]), pa.array(wide[:, 1]),
            pa.array([s[:KEEP].astype(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SETS.split(", ")])


_OPEN = "cell long, node long, n int, fp long, fq long, root long"


def _with_partners(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that have a pair in their cell that may be similar and is in another component."""
    root, n = rows.column("root").to_numpy(), rows.column("n").to_numpy()
    found = np.zeros(rows.num_rows, dtype=bool)
    for a, b in _pairs(rows.column("cell").to_numpy(), _words(rows, ["fp", "fq"]), rows.column("side").to_numpy(), RADIUS):
        ok = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= SIMILARITY * np.maximum(n[a], n[b]))
        found[a[ok]] = found[b[ok]] = True
    some = rows.filter(pa.array(found)).drop_columns(["cell"]).rename_columns({"home": "cell"})
    yield from some.select([x.split()[0] for x in _OPEN.split(", ")]).combine_chunks().to_batches()


def _open_links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The links that join different components in the cells. A pair is looked at in the first cell that it shares,
    and not if it is joined already."""
    node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in rows.column("shingles")]
    home, least = rows.column("home").to_numpy(), np.full((len(sets), KEEP), 1 << 32, dtype=np.int64)
    for x, found in zip(least, sets):
        x[: len(found[:KEEP])] = found[:KEEP]
    _, own = np.unique(rows.column("root").to_numpy(), return_inverse=True)
    label = np.arange(own.max() + 1)  # of each component, the lowest that it is joined with
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return int(i)

    for a, b in _pairs(rows.column("cell").to_numpy(), _words(rows, ["fp", "fq"]), rows.column("side").to_numpy(), RADIUS):
        ok = (label[own[a]] != label[own[b]]) & (np.minimum(n[a], n[b]) >= SIMILARITY * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        first = (least[a][:, :, None] == least[b][:, None, :]).any(axis=2).argmax(axis=1)
        ok = least[a, first] == home[a]
        before = len(links)
        for i, j in zip(a[ok].tolist(), b[ok].tolist()):
            x, y = find(own[i]), find(own[j])
            if x != y and similarity(sets[i], sets[j]) >= SIMILARITY:
                label[max(x, y)] = min(x, y)
                links.append((int(node[i]), int(node[j])))
        while len(links) > before and (label != label[label]).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x, dtype=np.uint32) for x in batch.column(k).to_pylist()] for k in (2, 3))
        ok = pa.array([similarity(x, y) >= SIMILARITY for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])


def _wanted(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
            yield batch.filter(pa.array((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1))

    return run


def _sets_of(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """node and shingles of the given nodes (a table of them, repeats included)."""
    place = F.shiftright(F.col("node").bitwiseAND((1 << MAP_BITS) - 1), 6).alias("place")
    bit = F.expr("bit_or(shiftleft(1L, cast(node & 63 as int)))").alias("bit")
    bits = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    rows = nodes.groupBy(place).agg(bit).toPandas()
    bits[rows["place"].to_numpy(dtype=np.int64)] = rows["bit"].to_numpy(dtype=np.int64)
    sets = marked.select("node", "shingles").mapInArrow(_wanted(bits.view(np.uint64)), "node long, shingles binary")
    return materialise(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _similar(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """u, v: those of the pairs that are similar enough, by their whole sets."""
    some = materialise(pairs.distinct(), "candidates")
    sets = _sets_of(some.select(F.explode(F.array("u", "v")).alias("node")), marked)
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}")).hint("shuffle_merge")
    both = some.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v")
    return materialise(both.mapInArrow(_verified, "u long, v long"), "similar")


def similar_groups(docs: DataFrame, cell_rows: int = CELL) -> DataFrame:
    """node and low, the least (null id last, doc_id, th: a hash of the text) of its component. Texts with equal
    sets are one node.

    Cells are settled in two rounds, and what is in one component by then is not compared again: each node against
    its cell's lowest one, which joins up most groups of copies; then, where a cell is not one component yet, its nodes
    that have a partner by their fingerprints meet with their sets, and only links come out.
    """
    small_batches(docs.sparkSession)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text_or_empty()).alias("th"))
    marked = materialise(hashed.mapInArrow(_sets, _SETS), "shingles")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    nodes = materialise(marked.groupBy("node").agg(low.alias("low"), *[F.first(c).alias(c) for c in ("n", "fp", "fq", "cells")]), "nodes")
    met = nodes.select("node", "n", "fp", "fq", F.explode("cells").alias("cell"))
    leads = met.groupBy("cell").agg(F.min(F.struct("node", "n", "fp", "fq")).alias("lead"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("cell", "lead")
    met = materialise(met.join(leads, "cell"), "cells")
    own, lead = ["fp", "fq"], [F.col("lead.fp"), F.col("lead.fq")]
    close = F.least("n", "lead.n") >= SIMILARITY * F.greatest("n", "lead.n")
    for p in pivot_rows(2):
        at, its = [_literal(x) for x in p], _distance(own, [_literal(x) for x in p])
        close &= F.abs(its - (F.bit_count(lead[0].bitwiseXOR(at[0])) + F.bit_count(lead[1].bitwiseXOR(at[1])))) <= RADIUS
    close &= _distance(own, lead) <= RADIUS
    links = _similar(met.filter(F.col("node") != F.col("lead.node")).filter(close).select(F.col("lead.node").alias("u"), F.col("node").alias("v")), marked)
    stars = components(links)
    rooted = met.join(stars, "node", "left").select("cell", F.col("cell").alias("home"), "node", "n", "fp", "fq", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "rooted")
    open_ = rooted.groupBy("cell").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("cell")
    left = _dealt(rooted.join(open_, "cell", "left_semi"), "node", ["fp", "fq"], cell_rows).mapInArrow(_by_cells(_with_partners), _OPEN)
    left = materialise(left.distinct().withColumn("home", F.col("cell")), "open")
    dealt = _dealt(left.join(_sets_of(left.select("node"), marked).hint("shuffle_merge"), "node"), "node", ["fp", "fq"], cell_rows)
    stars = components(links.unionByName(materialise(dealt.mapInArrow(_by_cells(_open_links, OPEN_ROWS), "u long, v long"), "joined")))
    roots = nodes.select("node", "low").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = roots.groupBy("root").agg(F.min("low").alias("low"))
    return roots.select("node", "root").join(lowest, "root").select("node", "low")


def one_of_similar(docs: DataFrame, cell_rows: int = CELL) -> DataFrame:
    """docs, all columns, with one row of each group of similar texts: that of the lowest doc_id (see one_of_each).

    Null text is empty; texts without words are one group. Null ids are higher than all others. Of repeated rows
    one stays. Empty input gives no rows.
    """
    return kept_rows(docs, similar_groups(docs, cell_rows))
