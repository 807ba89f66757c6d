"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

After Wang and Manning (2012): a text is the set of its n-grams (bytes, A-Z in lower case, white space as one
blank); r is the log ratio of an n-gram's share among toxic and other texts; a logistic regression with L2 penalty is
fitted to the features r. N-grams whose shares of toxic and other texts lie within ``gate`` standard errors of each
other get no feature: their sum over a text of many thousand characters would be noise.

Training uses a bounded sample of labelled rows (``sample`` of each label, lowest hash of the id first); their texts
are read whole, every feature that passes the gate is kept, and the regression runs over blocks of rows, so beside the
features of each row (4 bytes each) it holds one block. Scoring reads every text whole, in one pass, with tables of 2**bits entries in each worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textcore import buffers, lean, parts

ORDERS, BITS = (3, 4, 5), 20
#: Labelled rows of each label that training uses at most; rows whose n-grams one task counts; rows of a training block.
SAMPLE, TASK_ROWS, BLOCK = 3000, 500, 128

_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91] += 32
_FORM[[9, 10, 11, 12, 13]] = 32


def ngrams(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: the order, the hashed n-gram at each position, and where each row starts. A blank stands before
    each row and after the last; the caller drops what crosses a row's end by more than the next row's blank."""
    text = np.append(np.insert(_FORM[raw], at[:-1], 32), np.uint8(32)).astype(np.uint32)
    starts = at + np.arange(len(at))
    n = len(text)
    with np.errstate(over="ignore"):
        x = text[: max(0, n - 2)] | (text[1 : max(1, n - 1)] << 8)[: max(0, n - 2)] | (text[2:] << 16)
        shift = np.uint32(32 - BITS)
        yield 3, (x * np.uint32(0x9E3779B1)) >> shift, starts
        x = x[: max(0, n - 3)] | (text[3:] << 24)
        yield 4, (x * np.uint32(0x85EBCA6B)) >> shift, starts
        x = (x[: max(0, n - 4)] * np.uint32(0xC2B2AE35)) ^ (text[4:] * np.uint32(0x27D4EB2F))
        yield 5, ((x ^ (x >> 15)) * np.uint32(0x165667B1)) >> shift, starts


def present(raw: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each row that ``wanted`` marks."""
    found = []
    for order, h, starts in ngrams(raw, at):
        hit = np.flatnonzero(wanted[h])
        row = np.searchsorted(starts, hit, side="right") - 1
        inside = (row < len(at) - 1) & (hit + order <= starts[np.minimum(row + 1, len(at) - 1)] + 1)
        found.append((row[inside] << BITS) | h[hit[inside]])
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Classifier:
    """Weights (r times the regression's weight) of hashed n-grams, the features, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.features] = self.weights
        return dense

    def score(self, raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
        row, feature = present(raw, at, table != 0)
        z = self.intercept + np.bincount(row, weights=table[feature], minlength=len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


#: Features whose counts are added up by one group.
_CHUNK_BITS = 14


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many other and toxic texts have each feature, a pair of vectors for each chunk of features."""
    counts, every = np.zeros((2, 1 << BITS), np.int32), np.ones(1 << BITS, bool)
    for batch in batches:
        raw, at = buffers(batch.column("text"))
        label = np.asarray(batch.column("label").to_pylist(), dtype=np.int64)
        for a, b in parts(at, 1 << 20):
            row, feature = present(raw[at[a] : at[b]], at[a : b + 1] - at[a], every)
            for y in (0, 1):
                counts[y] += np.bincount(feature[label[a + row] == y], minlength=1 << BITS).astype(np.int32)
    chunks = counts.reshape(2, -1, 1 << _CHUNK_BITS)
    blobs = [pa.array([x.tobytes() for x in chunks[y]], pa.binary()) for y in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks.shape[1], dtype=np.int32)), *blobs], ["chunk", "other", "toxic"])


_CHOSEN = pa.schema([("feature", pa.int32()), ("other", pa.int64()), ("toxic", pa.int64()), ("sure", pa.float64())])


def _choose(n0: int, n1: int, gate: float):
    """The features of a chunk whose shares differ, and the chunk's sums as feature -1."""

    def run(table: pa.Table) -> pa.Table:
        other, toxic = (sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column(c).to_pylist()) for c in ("other", "toxic"))
        share = (toxic + other) / (n1 + n0)
        sure = np.abs(toxic / n1 - other / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        kept = np.flatnonzero(sure >= gate)
        first = table.column("chunk")[0].as_py() << _CHUNK_BITS
        columns = [np.append(kept + first, -1), np.append(other[kept], other.sum()), np.append(toxic[kept], toxic.sum()), np.append(sure[kept], 0.0)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, _CHOSEN.types, strict=True)], schema=_CHOSEN)

    return run


def _rows(kept: np.ndarray):
    """The features of each text, as places in ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[kept] = True
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            for a, b in parts(at, 1 << 20):
                row, feature = present(raw[at[a] : at[b]], at[a : b + 1] - at[a], wanted)
                place, cut = np.searchsorted(kept, feature).astype(np.int32), np.searchsorted(row, np.arange(b - a + 1))
                blobs = [place[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a).cast(pa.int32()), pa.array(blobs, pa.binary())], ["label", "features"])

    return run


def logistic(rows: list[np.ndarray], value: np.ndarray, y: np.ndarray, penalty: float = 0.5, epochs: int = 20, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over shuffled blocks of rows, the step falling to nothing. A row is given by its
    distinct features; ``value`` is what a feature counts wherever it stands."""
    width, rng = len(value), np.random.default_rng(1)
    w, b, t, m, v = np.zeros(width), 0.0, 0, np.zeros(width + 1), np.zeros(width + 1)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for some in np.split(order, range(BLOCK, len(order), BLOCK)):
            column = np.concatenate([rows[i] for i in some])
            row = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            z = b + np.bincount(row, weights=(w * value)[column], minlength=len(some))
            gap = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[some]
            g = np.bincount(column, weights=gap[row], minlength=width) * value / len(some) + penalty * w / len(rows)
            g, t = np.append(g, gap.mean()), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, gate: float = 4.0) -> Classifier:
    """A classifier from the rows of ``docs`` that ``labels`` marks 0 or 1 and that ``learn`` (over the id) admits.

    Rows without id, label or text teach nothing; of several labels of an id the largest holds. Without toxic rows
    all scores are 0, without others all are 1.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = (known.where(learn) if learn is not None else known).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = None
    for y in (0, 1):  # at most `sample` rows each
        some = known.where(F.col("label") == y).orderBy(F.xxhash64("i"), "i").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).where("text is not null")
    # 2 * sample rows at most are broadcast, and as many texts read again.
    rows = stored(texts.join(F.broadcast(chosen), "i").select("label", "text").repartition(max(1, 2 * sample // TASK_ROWS)), "labelled")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    none = np.zeros(0, np.int32)
    if not n1 or not n0:
        return Classifier(none, none, 60.0 if n1 else -60.0)
    counted = rows.mapInArrow(lean(_totals), "chunk int, other binary, toxic binary")
    chosen = stored(counted.groupBy("chunk").applyInArrow(_choose(n0, n1, gate), "feature int, other long, toxic long, sure double"), "features")
    sums = chosen.where("feature < 0").agg(F.sum("other"), F.sum("toxic")).first()
    best = chosen.where("feature >= 0").orderBy("feature").collect()  # at most 2**BITS
    if not best:
        return Classifier(none, none, float(np.log(n1 / n0)))
    kept = np.array([x.feature for x in best], np.int32)
    p, q = ((np.array([x[c] for x in best]) + 1) / (sums[i] + (1 << BITS)) for c, i in (("toxic", 1), ("other", 0)))
    r = np.log(p) - np.log(q)
    got = rows.mapInArrow(lean(_rows(kept)), "label int, features binary").collect()  # bounded by the sample
    w, b = logistic([np.frombuffer(x.features, np.int32) for x in got], r, np.array([x.label for x in got], dtype=np.float64))
    return Classifier(kept, (w * r).astype(np.float32), float(b))


def _score(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table()
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for a, b in parts(at):
                p = model.score(raw[at[a] : at[b]], at[a : b + 1] - at[a], weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row, repeated rows and rows without id included; a null text scores as empty."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(_score(model)), f"id {dict(source.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns whose text isn't predicted toxic."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table()
        for batch in batches:
            raw, starts = buffers(batch.column(at))
            for a, b in parts(starts):
                clean = model.score(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a], weights) < 0.5
                yield batch.slice(a, b - a).filter(pa.array(clean))

    return docs.mapInArrow(lean(run), docs.schema)
