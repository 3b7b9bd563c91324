"""Quality classification from positive and unlabelled texts (PU learning).

The model is an additive logistic one over thresholded features of a text's form and over which words and runs of
three bytes it is made of, hashed into buckets. It minimises the non-negative unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),  where R_p is measured on texts
labelled good, R_u on unlabelled ones, and pi, the share of good texts, is estimated from these two
samples alone: pi is at most the share of any region among unlabelled texts over its share among good
ones, and the least ratio over the upper regions of a first classifier is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import materialise, small_batches

#: Rows of each kind that the fit takes at most, chosen by a hash of their ids.
SAMPLE = 20_000
THRESHOLD = 0.3
LEAST = 0.01
FEATURES = (
    "upper", "symbol", "bang", "bar", "digit", "comma", "stop", "space", "same_as_before", "distinct",
    "top_word", "word_chars", "long_words", "same_lines", "lines", "brevity", "marked_words", "capital_words",
)
_BINS = 8
#: Buckets for words, and as many for runs of three bytes.
BUCKETS = 128
#: What weights cost: those of the form's thresholds, and those of buckets, of which there are many. Theirs is over the
#: rows of the lesser sample, so that a few rows teach little about words.
DECAY, LEXICAL_DECAY = 2e-4, 100.0
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#$%&*<>=@\\^_`{}~[]/"]] = True


def lexical(raw: np.ndarray, met: Counter) -> np.ndarray:
    """The roots of the buckets' shares of a text's words, then of its runs of three bytes, in 255ths."""
    buckets = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS for w in met), dtype=np.int64, count=len(met))
    words = np.bincount(buckets, weights=np.fromiter(met.values(), dtype=np.float64, count=len(met)), minlength=BUCKETS)
    runs = np.zeros(BUCKETS)
    for at in range(0, max(0, len(raw) - 2), 1 << 16):
        part = raw[at : at + (1 << 16) + 2].astype(np.uint32)
        mixed = (part[:-2] * np.uint32(0x10001) ^ part[1:-1] * np.uint32(0x101) ^ part[2:]) * np.uint32(0x9E3779B1)
        runs += np.bincount(mixed >> np.uint32(25), minlength=BUCKETS)
    return np.round(255 * np.sqrt(np.concatenate([words / words.sum(), runs / max(1.0, runs.sum())])))


def features(text: str) -> np.ndarray:
    """The features of one text, all finite: those of its form, then its buckets. Those of an empty text are zero."""
    words = text.split()
    if not words:
        return np.zeros(len(FEATURES) + 2 * BUCKETS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    n, k = len(raw), len(words)
    two = int(((raw[:-1] == 0xC3) & (raw[1:] <= 0x9E)).sum())
    upper = int(counts[65:91].sum()) + two
    letters = max(1, upper + int(counts[97:123].sum()) + int(counts[0xC3]) - two)
    lines = [x for x in text.split("\n") if x]
    met = Counter(words)
    # Over stretches of one length, so that a long text is not taken for a repetitive one.
    distinct = sum(len(set(words[i : i + 100])) for i in range(0, k, 100)) / k
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=k)
    form = [
        upper / letters, int(counts[_SYMBOLS].sum()) / n, counts[33] / n, counts[124] / n, int(counts[48:58].sum()) / n,
        counts[44] / n, counts[46] / n, (counts[32] + counts[10]) / n,
        sum(map(str.__eq__, words, words[1:])) / k, distinct, max(met.values()) / k,
        float(lengths.mean()), float((lengths > 14).mean()), 1 - len(set(lines)) / len(lines), min(1.0, 20 * len(lines) / k), min(1.0, k / 20),
        sum(1 for w in met if not w[-1].isalnum() and w[-1] not in ".,") / len(met), sum(1 for w in met if w.isupper() and len(w) > 1) / len(met),
    ]
    return np.concatenate([form, lexical(raw, met)])


class Model:
    """Thresholds of every feature of the form, mean and spread of every bucket, their weights, and the prior."""

    def __init__(self, cuts: np.ndarray, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, prior: float):
        self.cuts, self.mean, self.spread, self.weights, self.prior = cuts, mean, spread, weights, prior

    def design(self, x: np.ndarray) -> np.ndarray:
        """A column of ones, whether each feature passes each of its thresholds, and the buckets, of one spread and
        cut at two of it; an empty text's are zero."""
        n = len(self.cuts)
        steps = (x[:, :n, None] > self.cuts[None]).reshape(len(x), -1)
        out = np.ones((len(x), 1 + steps.shape[1] + x.shape[1] - n), dtype=np.float32)
        out[:, 1 : 1 + steps.shape[1]] = steps
        for low in range(0, len(x), 4096):
            some = x[low : low + 4096, n:]
            out[low : low + 4096, 1 + steps.shape[1] :] = np.clip((some - self.mean) / self.spread, -2, 2) * (some.sum(axis=1, keepdims=True) > 0) / 4
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def estimated_prior(good: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of the upper tails of the two samples' scores, over tails that hold at least a
    fifth of the good ones; a tail's ratio is raised by one standard error, so that noise does not win."""
    cuts = np.quantile(good, np.linspace(0.0, 0.8, 81))
    p = (good[None] >= cuts[:, None]).mean(axis=1)
    u = (unlabelled[None] >= cuts[:, None]).mean(axis=1)
    error = np.sqrt(np.maximum(u * (1 - u), 0) / len(unlabelled)) + np.sqrt(np.maximum(p * (1 - p), 0) / len(good))
    return float(np.clip(((u + error) / p).min(), 0.05, 0.99))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400) -> np.ndarray:
    """Minimises the non-negative risk with the logistic loss, by Adam over whole samples."""
    decay = np.full(p.shape[1], DECAY, dtype=np.float32)
    decay[0], decay[1 + len(FEATURES) * _BINS :] = 0.0, LEXICAL_DECAY / min(len(p), len(u))
    w, m, v = (np.zeros(p.shape[1], dtype=np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        negative = float(-np.log1p(-np.minimum(su, 1 - 1e-6)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-6)).mean())
        g_neg = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = prior * (p.T @ (sp - 1)) / len(p) + g_neg if negative >= 0 else -g_neg
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(float)


def fit(good: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model from feature rows of texts labelled good and of unlabelled ones. Without either it
    finds every text good."""
    return _fitted([np.concatenate([good, unlabelled])], len(good))


def _fitted(held: list[np.ndarray], n_good: int) -> Model:
    """The model from one array of feature rows, the good ones first. It is taken out of the list, so that it goes when
    the designs are made: the driver holds the sample once."""
    both = held.pop()
    if not 0 < n_good < len(both):
        return Model(np.zeros((len(FEATURES), 1)), np.zeros(2 * BUCKETS), np.ones(2 * BUCKETS), np.r_[5.0, np.zeros(len(FEATURES) + 2 * BUCKETS)], 1.0)
    tail = np.array([0.005, 0.02, 0.05, 0.12, 0.88, 0.95, 0.98, 0.995])[:_BINS]
    # Shares below LEAST are not told from none: one odd word must not mark a long text.
    form, buckets = both[:, : len(FEATURES)], both[:, len(FEATURES) :]
    spread = np.concatenate([buckets[:, k : k + 32].std(axis=0) for k in range(0, 2 * BUCKETS, 32)])
    model = Model(np.maximum(np.quantile(form, tail, axis=0).T, LEAST), buckets.mean(axis=0), spread + 1.0, np.zeros(1), 0.5)
    p, u = model.design(both[:n_good]), model.design(both[n_good:])
    del both, form, buckets
    # The first classifier only tells the samples apart, by form; its order of texts is that of their quality.
    n = 1 + model.cuts.size
    first = _descend(p[:, :n], u[:, :n], 0.5)
    model.prior = estimated_prior(p[:, :n] @ first, u[:, :n] @ first)
    model.weights = _descend(p, u, model.prior)
    return model


def _split(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5


def packed(x: np.ndarray) -> bytes:
    """A text's features, those of its form in 32 bits and its buckets in 8."""
    return x[: len(FEATURES)].astype("<f4").tobytes() + x[len(FEATURES) :].astype(np.uint8).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    n, form = len(rows), 4 * len(FEATURES)
    raw, out = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(n, form + 2 * BUCKETS), np.empty((n, len(FEATURES) + 2 * BUCKETS), dtype="<f4")
    out[:, : len(FEATURES)] = np.ascontiguousarray(raw[:, :form]).view("<f4")
    out[:, len(FEATURES) :] = raw[:, form:]
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [packed(features(t or "")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "good", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` rows labelled 1 and as many unlabelled rows (any row without its label), at most, all
    with crc32(doc_id) mod 5 other than 0. Labels of 0 are never read. Which rows is decided by a hash of the id; of
    ids that stand in many rows, by a hash of the features, and rows equal in both count once. Texts beyond the
    sample are not looked at."""
    small_batches(docs.sparkSession)
    rows = docs.filter((_split() != 0) & F.col("doc_id").isNotNull())
    good = labels.filter("quality = 1").select("doc_id").distinct()
    order = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 34)

    def chosen(ids: DataFrame) -> DataFrame:
        n = ids.count()
        return ids.filter(order < int((1 << 30) * min(1.0, sample / max(1, n))))

    positive = chosen(good.filter(_split() != 0)).withColumn("good", F.lit(True))
    unlabelled = chosen(rows.select("doc_id")).select("doc_id").distinct().withColumn("good", F.lit(False))
    ids = positive.unionByName(unlabelled)
    texts = rows.select("doc_id", "text").filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(ids), "doc_id") if ids.count() <= 2 * sample + 1000 else texts.join(ids, "doc_id")
    made = found.select("doc_id", "good", "text").mapInArrow(_feature_rows, "doc_id long, good boolean, x binary")
    made = materialise(made.dropDuplicates(["doc_id", "good", "x"]), "features")
    counts = {r["good"]: r["n"] for r in made.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("good"), min(1.0, sample / counts.get(True, 1))).otherwise(min(1.0, sample / counts.get(False, 1)))
    some = made.filter(F.shiftrightunsigned(F.xxhash64(F.lit("row"), "doc_id", "x"), 34) < share * (1 << 30))
    # Sums must not depend on the order of arrival.
    got = some.toPandas().sort_values(["good", "doc_id", "x"], ascending=[False, True, True])
    held, n_good = [unpacked(got["x"].tolist())], int(got["good"].sum())
    del got
    return _fitted(held, n_good)


def _scores(model: Model, texts: list[str | None]) -> np.ndarray:
    return model.score(np.array([features(t or "") for t in texts], dtype=float).reshape(len(texts), len(FEATURES) + 2 * BUCKETS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Null text is scored as an empty one;
    a null id is held out. Repeated rows are scored alike."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_split() == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, without those that the model rejects."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at).to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
