"""Interpolated modified Kneser-Ney n-gram model of any order from two on: counted in Spark, kept as sorted hash arrays,
memory-mapped.

Tasks count their n-grams in numpy and deal them out by hashes of all words but the last and of all but the first, half
of the bits from each, so neither a very common context nor a very common ending stays in one group. Each of P groups
merges its share, writes its n-grams as one sorted array of 64-bit keys with counts, and passes on what the lower order
needs: for a context its share of the total and how many followers it has once, twice or more often, for an ending how
many words precede it and how often it occurs. The same step then merges the order below, down to single words. Workers
map the tables and look up each distinct n-gram of a chunk once, in sorted order. No task and no process holds the
whole of a table in memory, and the number of groups grows with the input, so a group doesn't.

A text is preceded by order - 1 marks and followed by one. Table size: 12 bytes for each distinct n-gram of the highest
order, 28 for each of an order between and 36 for each distinct word, in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder
from .files import map_array, write_array
from .textcore import buffers, mix64, parts, words

#: Hashes of the marks before the first and after the last word.
BEGIN, END = (mix64(np.array([x], dtype=np.uint64), 99)[0] for x in (1, 2))
#: N-grams that a task gathers before it counts and sends them.
GATHER = 3_000_000
#: Bytes of input files for each group of bigrams, and the fewest groups.
GROUP_BYTES, LEAST_GROUPS = 8 << 20, 16


def pair_keys(context: np.ndarray, word: np.ndarray, shift: int) -> np.ndarray:
    """Keys whose bits from ``shift`` on are the group: leading bits of the context's hash, then of the word's; the others
    hash both."""
    bits = 64 - shift
    of_word = bits // 2
    with np.errstate(over="ignore"):
        both = mix64(context * np.uint64(0x9E3779B97F4A7C15) + word, 5)
    group = (context >> np.uint64(shift + of_word) << np.uint64(of_word)) | (word >> np.uint64(64 - of_word))
    return (group << np.uint64(shift)) | (both >> np.uint64(bits))


def gram_keys(grams, shift: int) -> list[list[np.ndarray]]:
    """From an array of word hashes for each place: at index k - 1 the keys of the k-grams that start at each place. The
    key of a k-gram follows from those of its first and last k - 1 words; longer ones are mixed anew, since the leading
    bits of a bigram's key are those of its words."""
    levels = [list(grams)]
    for size in range(2, len(grams) + 1):
        last = levels[-1] if size == 2 else [mix64(x, size) for x in levels[-1]]
        levels.append([pair_keys(x, y, shift) for x, y in zip(last[:-1], last[1:], strict=True)])
    return levels


def _grams(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-gram that ends at each token, as an array for each place, and where each row's tokens start, then the end."""
    h, w = words(raw, at)
    starts = w + np.arange(len(w))
    last = np.insert(h, w[1:], END)
    place = np.arange(len(last)) - np.repeat(starts[:-1], np.diff(starts))
    before = [np.where(place >= j, np.concatenate([np.full(min(j, len(last)), BEGIN), last[: max(len(last) - j, 0)]]), BEGIN) for j in range(order - 1, 0, -1)]
    return [*before, last], starts


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


#: Rows that go from step to step, a blob of many n-grams each. Kind 0: contexts as keys ``h`` with their totals ``a`` and
#: numbers of followers ``n1`` to ``n3``; 1: n-grams as words ``x`` with counts ``a`` and, below the highest order, how
#: often they occur (``n1``); 2: an order and how many of its n-grams count 1, 2, 3 and 4, in ``h``.
_ROWS = "part int, kind int, h binary, x binary, a binary, n1 binary, n2 binary, n3 binary"
_ROWS_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32())] + [(x, pa.binary()) for x in ("h", "x", "a", "n1", "n2", "n3")])


def _dealt(keys: np.ndarray, shift: int, kind: int, columns: dict[str, np.ndarray]) -> list[dict]:
    """A row for each group of sorted ``keys``; the last axis of each column runs along the keys."""
    group = keys >> np.uint64(shift)
    cut = np.append(_runs(group), len(keys)).tolist()
    return [{"part": int(group[a]), "kind": kind} | {name: x[..., a:b].tobytes() for name, x in columns.items()} for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _count(order: int, shift: int):
    def counted(held: list) -> pa.RecordBatch:
        grams = np.stack([np.concatenate(x) for x in zip(*held, strict=True)])
        k = gram_keys(grams, shift)[-1][0]
        by = np.argsort(k)
        starts = _runs(k[by])
        n, first = np.diff(np.append(starts, len(k))).astype(np.uint32), by[starts]
        return pa.RecordBatch.from_pylist(_dealt(k[first], shift, 1, {"x": grams[:, first], "a": n}), schema=_ROWS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            raw, at = buffers(batch.column(0))
            for a, b in parts(at):
                grams, _ = _grams(raw[at[a] : at[b]], at[a : b + 1] - at[a], order)
                held.append(grams)
                n += len(grams[0])
                if n >= GATHER:
                    yield counted(held)
                    held, n = [], 0
        if n:
            yield counted(held)

    return run


def _joined(table: pa.Table, column: str, dtype, width: int = 1) -> np.ndarray:
    blobs = [np.frombuffer(x, dtype=dtype).reshape(width, -1) for x in table.column(column).to_pylist()]
    out = np.concatenate(blobs, axis=1) if blobs else np.zeros((width, 0), dtype)
    return out if width > 1 else out[0]


def _merged(table: pa.Table, level: int, order: int, shift: int) -> tuple[np.ndarray, ...]:
    """The distinct n-grams of kind 1: sorted keys, words, counts, and how often they occur."""
    grams, count = _joined(table, "x", np.uint64, level).reshape(level, -1), _joined(table, "a", np.uint32)
    k = gram_keys(grams, shift)[-1][0]
    by = np.argsort(k)
    starts = _runs(k[by])
    add = lambda x: np.add.reduceat(x[by].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    total = add(count)
    return k[by[starts]], grams[:, by[starts]], total, total if level == order else add(_joined(table, "n1", np.int64))


def _kinds(table: pa.Table) -> list[pa.Table]:
    kind = table.column("kind").to_numpy()
    return [table.filter(pa.array(kind == i)) for i in range(3)]


def _with_contexts(keys: np.ndarray, count: np.ndarray, contexts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of n-grams and contexts, and for each: followers seen once, twice and more often, its count, its total."""
    h = _joined(contexts, "h", np.uint64)
    both = np.unique(np.concatenate([keys, h]))
    few, at = np.zeros((len(both), 5), np.float32), np.searchsorted(both, h)
    few[np.searchsorted(both, keys), 3] = count
    for i, name, dtype in ((0, "n1", np.uint32), (1, "n2", np.uint32), (2, "n3", np.uint32), (4, "a", np.int64)):
        few[:, i] = np.bincount(at, weights=_joined(contexts, name, dtype), minlength=len(both))
    return both, few


def _merge(folder: str, level: int, order: int, shift: int):
    """Merges the n-grams of a group, writes their table and returns the rows that the order below needs."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        contexts, ngrams, counts = _kinds(table)
        keys, grams, count, occurs = _merged(ngrams, level, order, shift)
        if level == order:
            write_array(f"{folder}/{part:07d}.{level}.keys", keys)
            write_array(f"{folder}/{part:07d}.{level}.counts", count.astype(np.float32))
        else:
            both, few = _with_contexts(keys, count, contexts)
            write_array(f"{folder}/{part:07d}.{level}.keys", both)
            write_array(f"{folder}/{part:07d}.{level}.few", few)
        rows = counts.to_pylist()
        rows.append({"part": part, "kind": 2, "h": np.array([level, *[(count == i).sum() for i in (1, 2, 3, 4)]], dtype=np.int64).tobytes()})
        before, after = gram_keys(grams, shift)[-2]
        own, at = np.unique(before, return_inverse=True)
        add = lambda x, dtype: np.bincount(at, weights=x, minlength=len(own)).astype(dtype)
        rows += _dealt(own, shift, 0, {"h": own, "a": add(count, np.int64), "n1": add(count == 1, np.uint32), "n2": add(count == 2, np.uint32), "n3": add(count > 2, np.uint32)})
        ends, first, at, n = np.unique(after, return_index=True, return_inverse=True, return_counts=True)
        rows += _dealt(ends, shift, 1, {"x": grams[1:, first], "a": n.astype(np.uint32), "n1": np.bincount(at, weights=occurs, minlength=len(ends)).astype(np.int64)})
        return pa.Table.from_pylist(rows, schema=_ROWS_ARROW)

    return run


_STATS = "part int, tokens long, types long, followers long, unigram array<long>, higher array<long>"
_STATS_ARROW = pa.schema([("part", pa.int32())] + [(x, pa.int64()) for x in ("tokens", "types", "followers")] + [(x, pa.list_(pa.int64())) for x in ("unigram", "higher")])


def _finish(folder: str, order: int, shift: int):
    """Writes the word table of a group, sorted by hash, and returns what the whole model has to know of it."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        contexts, own, counts = _kinds(table)
        keys, _, count, occurs = _merged(own, 1, order, shift)
        h, few = _with_contexts(keys, count, contexts)
        known = np.zeros(len(h), np.int64)
        known[np.searchsorted(h, keys)] = occurs
        write_array(f"{folder}/{part:07d}.1.keys", h)
        write_array(f"{folder}/{part:07d}.1.known", known)
        write_array(f"{folder}/{part:07d}.1.few", few)
        higher = np.zeros((order - 1, 4), np.int64)
        for x in counts.column("h").to_pylist():
            level, *n = np.frombuffer(x, np.int64)
            higher[level - 2] += n
        unigram = [int((count == i).sum()) for i in (1, 2, 3, 4)] + [int((count > 2).sum())]
        row = {"part": part, "tokens": int(known.sum()), "types": int((known > 0).sum()), "followers": int(count.sum()), "unigram": unigram, "higher": higher.ravel().tolist()}
        return pa.Table.from_pylist([row], schema=_STATS_ARROW)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of Chen and Goodman from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    if n[0] <= 0 or n[1] <= 0:
        return 0.5, 0.75, 1.0
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2.0)
    return tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    cut = np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2]))
    return np.where(counts > 0, counts - cut, 0.0)


@dataclass
class Model:
    """A trained model: where its tables are and the numbers that hold for all of it. ``tokens`` and ``types`` count the
    end marks, ``unigram`` and ``higher`` how many n-grams of an order count 1, 2, 3 and 4."""

    folder: str
    shift: int
    order: int
    tokens: int
    types: int
    followers: int
    unigram: list[int]
    higher: list[list[int]]
    _maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def _map(self, part: int, what: str, dtype) -> np.ndarray:
        if (part, what) not in self._maps:
            try:
                self._maps[part, what] = map_array(f"{self.folder}/{part:07d}.{what}", dtype)
            except FileNotFoundError:  # nothing of the training texts falls into this group
                self._maps[part, what] = np.zeros(0, dtype)
        return self._maps[part, what]

    def _find(self, queries: np.ndarray, level: int, columns: list[tuple[str, type, int]]) -> list[np.ndarray]:
        """For sorted distinct ``queries`` the rows of the columns of an order's table, zeros where absent."""
        out = [np.zeros((len(queries), width) if width > 1 else len(queries), dtype) for _, dtype, width in columns]
        cut = np.append(_runs(queries >> np.uint64(self.shift)), len(queries))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part, q = int(queries[a] >> np.uint64(self.shift)), queries[a:b]
            table = self._map(part, f"{level}.keys", np.uint64)
            if not len(table):
                continue
            at = np.searchsorted(table, q)
            at[at == len(table)] = 0
            hit = np.flatnonzero(table[at] == q)
            for x, (name, dtype, width) in zip(out, columns, strict=True):
                x[a + hit] = self._map(part, f"{level}.{name}", dtype).reshape((-1, width) if width > 1 else -1)[at[hit]]
        return out

    def score(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, unigram base and model score (log10) of each row."""
        grams, starts = _grams(raw, at, self.order)
        if not len(grams[0]):
            zero = np.zeros(len(at) - 1)
            return zero.astype(np.int64), zero.astype(np.int64), zero, zero
        tokens, keys = len(grams[0]), gram_keys(grams, self.shift)
        names, at_ = np.unique(np.concatenate(keys[0][-2:]), return_inverse=True)
        known, few = self._find(names, 1, [("known", np.int64, 1), ("few", np.float32, 5)])
        context, own = at_[:tokens], at_[tokens:]
        base = np.log10((known + 0.5) / (self.tokens + 0.5 * (self.types + 1)))[own]
        known = (known > 0)[own].astype(np.int64)
        d, followers = discounts(self.unigram[:4]), max(self.followers, 1)
        spare = (d[0] * self.unigram[0] + d[1] * self.unigram[1] + d[2] * self.unigram[4]) / followers if self.followers else 1.0
        p = (_discounted(few[:, 3].astype(np.float64), d) / followers + spare / (self.types + 1))[own]
        for level in range(2, self.order + 1):
            d = discounts(self.higher[level - 2])
            total = few[:, 4].astype(np.float64)
            weight = np.where(total > 0, (few[:, :3].astype(np.float64) @ np.array(d)) / np.maximum(total, 1), 1.0)[context]
            total = np.maximum(total, 1)[context]
            if level < self.order:
                names, at_ = np.unique(np.concatenate(keys[level - 1][-2:]), return_inverse=True)
                (few,) = self._find(names, level, [("few", np.float32, 5)])
                context, own = at_[:tokens], at_[tokens:]
                count = few[:, 3]
            else:
                names, own = np.unique(keys[-1][0], return_inverse=True)
                (count,) = self._find(names, level, [("counts", np.float32, 1)])
            p = _discounted(count.astype(np.float64), d)[own] / total + weight * p
        rows = starts[:-1]
        return np.diff(starts), np.add.reduceat(known, rows), np.add.reduceat(base, rows), np.add.reduceat(np.log10(p), rows)


def train(texts: DataFrame, text_col: str = "text", groups: int | None = None, order: int = 2) -> Model:
    """The model of all rows of ``texts``. Null and empty texts are documents without words; no rows give a model in
    which every token is unknown."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = texts.sparkSession
    if groups is None:
        size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 60:  # what Spark says of a source that knows no size
            size = texts.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        groups = max(LEAST_GROUPS, 1 << (size * order // (2 * GROUP_BYTES)).bit_length())
    shift, folder = 64 - (groups.bit_length() - 1), new_folder(spark, "kneser-ney")
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(_count(order, shift), _ROWS)
    for level in range(order, 1, -1):
        rows = rows.groupBy("part").applyInArrow(_merge(folder, level, order, shift), _ROWS)
    stats = rows.groupBy("part").applyInArrow(_finish(folder, order, shift), _STATS).collect()  # one small row for each group
    add = lambda name, n: [sum(r[name][i] for r in stats) for i in range(n)]
    higher = add("higher", 4 * (order - 1))
    totals = [sum(r[name] for r in stats) for name in ("tokens", "types", "followers")]
    return Model(folder, shift, order, *totals, add("unigram", 5), [higher[i : i + 4] for i in range(0, len(higher), 4)])


def _score(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for a, b in parts(at):
                scored = model.score(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, scored)], names)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every row; null texts count as empty: END alone."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_tokens", "n_known", "base_score", "score"]
    out = source.mapInArrow(_score(model, names), f"id {dict(source.dtypes)['id']}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_col)
