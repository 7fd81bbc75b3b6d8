"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled documents (``training_rows``; ``SAMPLE`` documents, drawn by class) and has two steps.
(1) N-grams, hashed into ``2 ** bits`` bins, are counted by class in parallel (a document counts once for each bin it has); each task
sends its non-empty bins, summed by Spark. The log-count ratio of a bin is
r = log((a + toxic) / (sum of those)) - log((a + clean) / (sum of those)). Bins whose ratio is at least ``least_z`` standard errors
from 0, or half as many as the best bin's if that is less, are features. (2) A logistic regression on x = r * [the document has the n-gram] is fitted on the same documents. The model is
two arrays of fixed size, so broadcasting it doesn't grow with the data.

Results for odd input: empty or null text scores by the intercept alone; documents without a label don't train; repeated rows score
each; unless both classes are labelled nothing can be told apart, and every score is the smoothed base rate
(toxic + 0.5) / (labelled + 2), which is 0.25 without any label (``both_classes`` of the model is False then); an empty table gives no
rows; other columns pass through, and clashing ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.llm.common import cut, slices, written

MULTIPLIER = np.uint32(0x9E3779B1)
#: The most labelled documents that train; the bound on what one model takes.
SAMPLE = 10_000


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    smoothing: float = 1.0
    least_z: float = 3.0
    ridge: float = 0.1
    steps: int = 240


@dataclass(frozen=True)
class Model:
    """slot: feature number of each bin, or -1; weight: of each feature, the ratio multiplied in."""

    settings: Settings
    slot: np.ndarray
    weight: np.ndarray
    intercept: float
    both_classes: bool = True


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of UTF-8 texts, white space as a blank, and n + 1 offsets; each text gets a blank on either side."""
    raw = data.tobytes()
    texts = [f" {raw[a:b].decode('utf-8', 'replace').lower()} " for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 9) & (points <= 13)] = 32
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def grams(points: np.ndarray, at: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, bin) of the n-grams that lie within one text."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h ^= points[k : k + n]
        h *= MULTIPLIER
        h ^= h >> np.uint32(15)
    whole = np.ones(n, bool)
    for k in range(1, order):
        edge = at[1:-1] - k
        whole[edge[(edge >= 0) & (edge < n)]] = False
    where = np.flatnonzero(whole)
    return where, (h[where] >> np.uint32(32 - bits)).astype(np.int64)


def present(points: np.ndarray, at: np.ndarray, s: Settings, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) pairs, each once; with slot (document, feature) pairs."""
    keys = [np.zeros(0, np.int64)]
    for order in s.orders:
        where, found = grams(points, at, order, s.bits)
        if slot is not None:
            found = slot[found]
            hit = found >= 0
            where, found = where[hit], found[hit]
        keys.append(((np.searchsorted(at, where, "right") - 1) << s.bits) + found)
    pairs = np.unique(np.concatenate(keys))
    return pairs >> s.bits, pairs & ((1 << s.bits) - 1)


def log_count_ratios(clean: np.ndarray, bad: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The ratio of each bin from its documents by class, and how many standard errors it is from 0."""
    clean, bad = clean + s.smoothing, bad + s.smoothing
    ratio = np.log(bad / bad.sum()) - np.log(clean / clean.sum())
    return ratio, np.abs(ratio) / np.sqrt(1 / clean + 1 / bad)


class Design:
    """The sparse matrix x = ratio * [the document has the feature]: only the features of each document are held, four bytes each.

    Products go over a portion of documents after another, so what they take beside it is bounded too.
    """

    def __init__(self, columns: np.ndarray, at: np.ndarray, ratio: np.ndarray, portion: int = 1 << 19):
        self.columns, self.at, self.ratio = columns, at, ratio
        self.parts, first = [], 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(at, at[first] + portion, "right")) - 1)
            self.parts.append((first, last))
            first = last

    def times(self, w: np.ndarray) -> np.ndarray:
        """A sum for each document."""
        scaled, out = self.ratio * w, np.zeros(len(self.at) - 1)
        for first, last in self.parts:
            values = scaled[self.columns[self.at[first] : self.at[last]]]
            filled = np.flatnonzero(self.at[first + 1 : last + 1] > self.at[first:last])
            if len(filled):
                out[first + filled] = np.add.reduceat(values, self.at[first:last][filled] - self.at[first])
        return out

    def transposed(self, g: np.ndarray) -> np.ndarray:
        """A sum for each feature."""
        out = np.zeros(len(self.ratio))
        for first, last in self.parts:
            each = np.repeat(g[first:last], np.diff(self.at[first : last + 1]))
            out += np.bincount(self.columns[self.at[first] : self.at[last]], each, len(out))
        return out * self.ratio


def fit_logistic(x: Design, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the ridge-penalised logistic loss.

    Both classes weigh the same together, so a rare class isn't scored too low.
    """
    n, features = len(y), len(x.ratio)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, b = np.zeros(features), 0.0
    # the largest eigenvalue of the weighted matrix, by power iteration, gives the step
    v, norm = np.ones(features), 0.0
    for _ in range(12):
        u = x.transposed(weight * x.times(v))
        norm = np.linalg.norm(u) / max(np.linalg.norm(v), 1e-300)
        if not norm:
            break
        v = u / np.linalg.norm(u)
    size = 1.0 / (0.25 * (1.1 * norm + weight.sum()) + ridge)
    pw, pb = w, b
    for t in range(steps):
        ew, eb = w + t / (t + 3) * (w - pw), b + t / (t + 3) * (b - pb)
        g = weight * (1 / (1 + np.exp(-np.clip(x.times(ew) + eb, -40, 40))) - y)
        pw, pb = w, b
        w = ew - size * (x.transposed(g) + ridge * ew)
        b = eb - size * g.sum()
    return w, float(b)


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """labelled: doc_id, text, toxic (0 or 1; others are left out); at most as many rows as one driver can take (``training_rows``)."""
    s = settings
    rows = written(labelled.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "training")
    bins = 1 << s.bits
    classes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        rate = (classes.get(1, 0) + 0.5) / (sum(classes.values()) + 2)
        return Model(s, np.full(bins, -1, np.int32), np.zeros(0, np.float32), float(np.log(rate / (1 - rate))), False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, bins), np.int64)
        for batch in batches:
            for part, data, at in slices(batch, "text", 1 << 20):
                doc, found = present(*characters(data, at), s)
                bad = np.asarray(part.column("toxic"), np.int64)[doc] == 1
                sums[1] += np.bincount(found[bad], minlength=bins)
                sums[0] += np.bincount(found[~bad], minlength=bins)
        held = np.flatnonzero(sums.any(0))
        yield pa.record_batch({"bin": pa.array(held, pa.int32()), "clean": pa.array(sums[0][held], pa.int32()), "bad": pa.array(sums[1][held], pa.int32())})

    # at most 2 ** bits rows, whatever the data
    total = rows.mapInArrow(count, "bin int, clean int, bad int").groupBy("bin").agg(F.sum("clean").cast("int").alias("clean"), F.sum("bad").cast("int").alias("bad")).toArrow()
    sums = np.zeros((2, bins))
    held = np.asarray(total.column("bin"))
    sums[0][held], sums[1][held] = np.asarray(total.column("clean")), np.asarray(total.column("bad"))
    del total
    pa.default_memory_pool().release_unused()
    held = np.sort(held)
    ratio, z = log_count_ratios(sums[0][held], sums[1][held], s)
    told = z >= min(s.least_z, z.max(initial=0.0) / 2)
    held, ratio = held[told], ratio[told]
    del sums, z, told
    slot = np.full(bins, -1, np.int32)
    slot[held] = np.arange(len(held))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", 1 << 20):
                doc, feature = present(*characters(data, at), s, slot)
                cuts = np.searchsorted(doc, np.arange(len(at)))
                yield pa.record_batch({"h": part.column("h"), "toxic": part.column("toxic"), "feature": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature, pa.int32()))})

    got = rows.select(F.xxhash64("doc_id", "text").alias("h"), "toxic", "text").mapInArrow(features, "h long, toxic int, feature array<int>").toArrow().sort_by([("h", "ascending"), ("toxic", "ascending")])
    y = np.asarray(got.column("toxic"), np.float64)
    lists = got.column("feature").combine_chunks()
    del got
    at = np.asarray(lists.offsets).astype(np.int64)
    x = Design(np.asarray(lists.flatten()), at - at[0], ratio)
    w, b = fit_logistic(x, y, s.ridge, s.steps)
    del x, lists
    pa.default_memory_pool().release_unused()
    return Model(s, slot, (w * ratio).astype(np.float32), b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted; whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    kept = docs.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, data, at in slices(batch, "text", 1 << 20):
                doc, feature = present(*characters(data, at), m.settings, m.slot)
                p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, m.weight[feature], len(at) - 1) + m.intercept, -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(judge, schema)


def is_held_out() -> Column:
    """Every fifth document by crc32 of its id as text never trains."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out fold: half of them of either class, or more of one if the other has fewer.

    Within a class those of the smallest hashes of doc_id. The sample is bounded by that parameter, so its ids are broadcast and no text
    moves to meet its label. A doc_id labelled more than once trains with its largest label.
    """
    fit = labels.where("toxic in (0, 1) and doc_id is not null").where(~is_held_out())
    marks = cut(fit.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    drawn = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(most // 2, most - sizes.get(1 - c, 0))) for c in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
