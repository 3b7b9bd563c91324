"""Homomorphic multiset fingerprints of documents, from DataFrame functions alone.

A fingerprint is a vector of sums: each paragraph is hashed to a wide vector, and the vectors of a
text's paragraphs are added modulo powers of two. The order of paragraphs does not matter, and a
paragraph is put in or taken out by adding or subtracting its vector (`combine`).

A paragraph's vector has two parts. EQUAL lanes hold hashes of the whole paragraph, added modulo
2^32; they decide equality. LIKE lanes hold, modulo 2^24, the sum of a random sign per lane over the
paragraph's pieces of up to PIECE words; the cosine of two texts' lanes estimates the share of pieces
that they have in common, whatever their lengths (its error is about 1/8 with 64 lanes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import materialise, text_or_empty

EQUAL, LIKE, PIECE = 4, 64, 4
_PIECES = r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,%d}" % PIECE
_FIELDS, _SLICE = 0x0001000100010001, 32767
#: Bits of a LIKE lane: a piece may be said eight million times.
_BITS = 24
#: Rows of a range, and cuts of the ids that come to the driver.
_ROWS, _CUTS = 256, 2048


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(hashes: Column, parts: list) -> Column:
    """The sums over an array of hashes of what each of parts makes of a hash."""
    zero = F.array(*[_long(0)] * len(parts))
    return F.aggregate(hashes, zero, lambda acc, h: F.array(*[F.get(acc, F.lit(i)) + part(h) for i, part in enumerate(parts)]))


def _wrapped(x: Column) -> Column:
    """x as a signed number of _BITS bits."""
    return F.pmod(x + (1 << _BITS - 1), F.lit(1 << _BITS)) - (1 << _BITS - 1)


def fingerprint_vector(text: Column) -> Column:
    """array<long>: EQUAL lanes below 2^32, then LIKE signed lanes of _BITS bits.

    A text without paragraphs (null, empty, only line ends) is the zero vector.
    """
    paragraphs = F.filter(F.split(text, "\n"), lambda p: F.length(p) > 0)
    whole = F.transform(paragraphs, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b")))
    low = F.lit(0xFFFFFFFF)
    equal = _sums(
        whole,
        [
            lambda h: h["a"].bitwiseAND(low), lambda h: F.shiftrightunsigned(h["a"], 32),
            lambda h: h["b"].bitwiseAND(low), lambda h: F.shiftrightunsigned(h["b"], 32),
        ],
    )
    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p)))
    # One long counts the ones of four bits of the hashes in fields of 16 bits: 16 additions a piece serve
    # 64 lanes, and a field cannot overflow within _SLICE pieces.
    fields = [lambda h, k=k: F.shiftrightunsigned(h, k).bitwiseAND(_long(_FIELDS)) for k in range(16)]

    def unpacked(sums: Column) -> Column:
        return F.array(*[F.shiftrightunsigned(F.get(sums, F.lit(k)), 16 * j).bitwiseAND(F.lit(0xFFFF)) for k in range(16) for j in range(4)])

    def signed(hashes: Column) -> Column:
        slices = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / _SLICE).cast("int")),
            lambda g: _let(_sums(F.slice(hashes, g * _SLICE + 1, F.lit(_SLICE)), fields), unpacked),
        )
        ones = F.aggregate(slices, F.array_repeat(_long(0), LIKE), lambda acc, x: F.zip_with(acc, x, lambda i, j: i + j))
        return F.transform(ones, lambda x: _wrapped(2 * x - F.size(hashes)))

    like = _let(pieces, lambda h: F.when(F.size(h) == 0, F.array_repeat(_long(0), LIKE)).otherwise(signed(h)))
    return F.concat(F.transform(equal, lambda x: x.bitwiseAND(low)), like)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the texts of a and b together (sign 1), or of a without b's paragraphs (-1)."""
    equal = F.zip_with(F.slice(a, 1, EQUAL), F.slice(b, 1, EQUAL), lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    like = F.zip_with(F.slice(a, EQUAL + 1, LIKE), F.slice(b, EQUAL + 1, LIKE), lambda x, y: _wrapped(x + sign * y))
    return F.concat(equal, like)


def fingerprint_text(vector: Column) -> Column:
    """Lowercase hex: 8 digits for each EQUAL lane, 6 for each LIKE lane."""
    equal = F.transform(F.slice(vector, 1, EQUAL), lambda x: F.lpad(F.hex(x), 8, "0"))
    like = F.transform(F.slice(vector, EQUAL + 1, LIKE), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << _BITS))), _BITS // 4, "0"))
    return F.lower(F.concat_ws("", F.concat(equal, like)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal vectors, else the cosine of the LIKE lanes, from 0 to just below 1."""
    x, y = F.slice(a, EQUAL + 1, LIKE), F.slice(b, EQUAL + 1, LIKE)

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda i, j: i * j), _long(0), lambda acc, v: acc + v).cast("double")

    cosine = F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))), F.lit(0.0))
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(0.999999)))


def _constants(values: list, kind: str) -> Column:
    """An array of constants, folded from one string: thousands of literals would be analysed one by one, for every column."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _cuts(docs: DataFrame, cuts: int) -> list[int]:
    """At most `cuts` ids, ascending, that cut the rows into parts of about equal numbers."""
    shares = [(i + 0.5) / cuts for i in range(cuts)]
    found = docs.agg(F.percentile_approx("doc_id", _constants(shares, "double"), F.lit(10 * cuts))).first()[0]
    return sorted(set(found or []))


def _place(cuts: list[int]) -> tuple[Column, Column]:
    """(where an id stands among the cuts, how many are not above it: column at_, found by halving). It stands at 0
    if it is null, at 2 * at_ if it is a cut itself, but one less, and behind that otherwise."""
    x, bounds = F.col("doc_id"), _constants(cuts, "bigint")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))])
    at = F.aggregate(steps, F.lit(0), lambda acc, k: F.when(F.coalesce(F.get(bounds, acc + k - 1) <= x, F.lit(False)), acc + k).otherwise(acc))
    exact = F.coalesce(F.get(bounds, F.col("at_") - 1) == x, F.lit(False)).cast("int")
    return F.when(x.isNull(), 0).otherwise(F.col("at_") * 2 + 1 - exact), at


def with_ranges(docs: DataFrame, rows: int = _ROWS, cuts: int = _CUTS) -> DataFrame:
    """docs (doc_id, th: a hash of the text) with part and slice: ranges of about `rows` rows in the order of
    (doc_id, th), nulls first.

    The ids are cut where the rows are, at up to `cuts` of their quantiles; only these, and the number and extent of
    the rows between, come to the driver. Rows between two cuts are sliced by id, rows of one id, or of none, by th.
    """
    chosen = _cuts(docs, cuts)
    place, at = _place(chosen)
    placed = lambda df: df.withColumn("at_", at).withColumn("part", place.cast("int")).drop("at_")
    sizes = placed(docs.select("doc_id")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    low, width, slices = [0.0] * (2 * len(chosen) + 2), [1.0] * (2 * len(chosen) + 2), [1] * (2 * len(chosen) + 2)
    for r in sizes:
        slices[r.part] = -(-r.n // rows)
        if r.low is not None:
            low[r.part], width[r.part] = float(r.low), max(1.0, (float(r.high) - float(r.low) + 1) / slices[r.part])
    of = lambda values, kind: F.get(_constants(values, kind), F.col("part"))
    by_text = F.floor((F.col("th").cast("double") / 2.0**64 + 0.5) * of(slices, "int"))
    number = F.when(F.col("part") % 2 == 0, by_text).otherwise(F.floor((F.col("doc_id").cast("double") - of(low, "double")) / of(width, "double")))
    return placed(docs).withColumn("slice", F.least(F.greatest(number, F.lit(0)), of(slices, "int") - 1).cast("long"))


def with_next(docs: DataFrame, extra: dict[str, Column], rows: int = _ROWS, cuts: int = _CUTS) -> DataFrame:
    """docs (doc_id, text) with the columns extra made of the text, and next: the text and extra columns, a struct, of
    the next row by ascending doc_id (after the last: the first).

    A window finds the next row inside a range; one small row for each range carries its first row to the range
    before, in the order of slices inside a part and of parts, of which there are at most twice as many as cuts.
    Texts are shuffled once. Null ids come first; rows of one id are ordered by a hash of their text. A single row
    is its own next.
    """
    ranged = with_ranges(docs.withColumn("th", F.xxhash64("text")), rows, cuts)
    order = Window.partitionBy("part", "slice").orderBy("doc_id", "th")
    row = F.struct("text", *extra)
    inside = ranged.withColumns(extra).select("doc_id", "text", *extra, "part", "slice", F.lead(row).over(order).alias("inside"))
    firsts = ranged.withColumn("rank", F.row_number().over(order)).filter("rank = 1").withColumns(extra)
    firsts = materialise(firsts.select("part", "slice", row.alias("first")), "firsts")
    heads = firsts.groupBy("part").agg(F.min("slice").alias("head"))
    whole = Window.partitionBy(F.lit(1))
    around = heads.select("part", F.lead(F.struct("part", "head")).over(Window.orderBy("part")).alias("later"), F.min(F.struct("part", "head")).over(whole).alias("very_first"))
    around = around.select("part", F.coalesce("later", F.struct(F.col("very_first.part"), F.col("very_first.head"))).alias("later"))
    here = firsts.select("part", "slice", F.lead("slice").over(Window.partitionBy("part").orderBy("slice")).alias("next_slice")).join(around, "part")
    links = here.select(
        F.col("part").alias("p"), F.col("slice").alias("s"), F.when(F.col("next_slice").isNull(), F.col("later.part")).otherwise(F.col("part")).alias("part"),
        F.coalesce("next_slice", "later.head").alias("slice"),
    )
    after = links.join(firsts, ["part", "slice"]).select(F.col("p").alias("part"), F.col("s").alias("slice"), "first")
    return inside.join(after.hint("shuffle_merge"), ["part", "slice"]).select("doc_id", "text", *extra, F.coalesce("inside", "first").alias("next"))


def fingerprint_edits(docs: DataFrame, rows: int = _ROWS, cuts: int = _CUTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all,
    of the next document. Null text is empty. Each row gives a row, repeated ones too. A text's own vector is made
    once, before rows are brought beside each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    out = with_next(docs, {"own": fingerprint_vector(F.col("text"))}, rows, cuts).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("beside"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "beside", fingerprint_vector(F.col("edited")).alias("changed"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("beside")).alias("near_next"),
    )
