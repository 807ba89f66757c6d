"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash (Li and Li 2022): one permutation shuffles the universe of shingle ids, a second one, shifted
circularly by k, gives signature coordinate k. Both permutations are bijections of the 32-bit integers, so no
table of the universe is held. Texts that agree on all coordinates of a band meet in a bucket.

No bucket is expanded into pairs, and none comes together in one task. (key, text) rows are sorted by range, so a large
bucket runs over many partitions, and are cut into fragments of at most ``FRAGMENT`` texts. The work has two passes:

1. In each fragment every text is verified against the fragment's medoid and against the text that looks most like it
   (by four bits of each coordinate); fragments of one bucket are tied by their medoids. That is at most two pairs a row.
   Connected components of the verified links follow.
2. In buckets that are not one component yet, the texts outside the bucket's largest component are held against all
   texts of other components, block by block of two fragments. A pair is verified unless its size ratio rules it out or
   the estimate lies over ``ERRORS`` standard errors below the threshold, first by the banded coordinates, then by
   ``FINE`` of them. ``errors=None`` verifies every such pair. Components of the components follow.

So a link is lost only if no band holds both texts, or an estimate misses by that many standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .textcore import buffers, lean, mix64, parts, shingles, words

#: With 24 bands of 4 a pair at Jaccard 0.8 is missed once in 300,000 times, one at 0.9 never in practice.
BANDS, ROWS = 24, 4
#: Elements whose signature is worked out at once: they stay in a core's cache.
_CACHE = 1 << 16
#: Texts of a bucket that are looked at together.
FRAGMENT = 256
#: Coordinates of the second estimate, and the standard errors by which an estimate has to miss the threshold before
#: the pair is left unverified.
FINE, ERRORS = 1024, 4.4
#: Candidates up to which their ids (16 bytes each) are broadcast to fetch their texts; beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def _permute(x: np.ndarray, a: int, b: int, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit integers (xor-shifts and odd multipliers)."""
    np.right_shift(x, np.uint32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=out)
    np.multiply(out, np.uint32(a | 1), out=out)
    np.right_shift(out, np.uint32(15), out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    np.multiply(out, np.uint32(b | 1), out=out)
    np.right_shift(out, np.uint32(16), out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    return out


def circulant_signatures(sets: list[np.ndarray], coordinates: int, seed: int = 1) -> np.ndarray:
    """Signature (len(sets), coordinates) of sets of 64-bit ids; rows of empty sets hold the largest value."""
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(lengths)
    ends = np.cumsum(lengths[full])
    i = 0
    with np.errstate(over="ignore"):
        while i < len(full):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + _CACHE, side="right")))
            flat = (mix64(np.concatenate([sets[k] for k in full[i:j]]), 7) >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum(lengths[full[i:j]])[:-1]])
            tmp, moved, buf = np.empty_like(flat), np.empty_like(flat), np.empty_like(flat)
            first = _permute(flat, 0x21F0AAAD + 2 * seed, 0x735A2D97, np.empty_like(flat), tmp)
            for k in range(coordinates):
                np.add(first, np.uint32(k), out=moved)  # the circular shift: 32-bit sums wrap around
                out[full[i:j], k] = np.minimum.reduceat(_permute(moved, 0xD35A2D97, 0x6B43A9B5 + 2 * seed, buf, tmp), starts)
            i = j
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    keys = np.empty((len(signatures), bands), dtype=np.uint64)
    for b in range(bands):
        x = np.full(len(signatures), b, dtype=np.uint64)
        for r in range(rows):
            x = mix64(x ^ signatures[:, b * rows + r].astype(np.uint64), 3 + r)
        keys[:, b] = x
    return keys.view(np.int64)


def nibbles(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates in a 64-bit integer; a last one is filled with zeros."""
    width = -(-signatures.shape[1] // 16)
    bits = np.zeros((len(signatures), width * 16), dtype=np.uint64)
    bits[:, : signatures.shape[1]] = signatures & np.uint32(15)
    return np.bitwise_or.reduce(bits.reshape(len(signatures), width, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _most(coordinates: int, percent: int, errors: float | None) -> float:
    """How many nibbles two texts at the threshold may differ in at most."""
    p = (1 - percent / 100) * 15 / 16
    return coordinates if errors is None else coordinates * p + errors * (coordinates * p * (1 - p)) ** 0.5


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many nibbles each row of x differs from each row of y."""
    out = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        z = x[:, None, k] ^ y[None, :, k]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        out += np.bitwise_count(z & np.uint64(0x1111111111111111))
    return out


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    raw, at = buffers(texts)
    for a, b in parts(at):
        yield a, b, shingles(*words(raw[at[a] : at[b]], at[a : b + 1] - at[a]), size)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _unlisted(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def _describe(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column("text"), size):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                with np.errstate(over="ignore"):
                    sums = [np.array([mix64(s, k).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64) for k in (11, 12)]
                signatures = circulant_signatures(sets, bands * rows)
                own = [batch.column(c).slice(a, b - a) for c in ("id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), *map(pa.array, sums), _lists(band_keys(signatures, bands, rows)), _lists(nibbles(signatures))], ["id", "text_hash", "n", "s1", "s2", "bands", "nibbles"])

    return run


def _refine(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), _lists(nibbles(circulant_signatures(sets, coordinates)))], ["fine_of", "fine"])

    return run


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns starts."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _fragments(most: int):
    """Rows sorted by (key, node) in, (key, frag, cut, node) out: runs of a key cut after ``most`` rows, each piece named
    by its first node. ``cut`` marks pieces of a key that may have others, also in the partitions around. A text that
    stands alone under its key is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, edge = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # edge: the first run may have begun before

        def cut(k: np.ndarray, v: np.ndarray, first_cut: bool, last_cut: bool) -> pa.RecordBatch:
            starts = _starts(k) if len(k) else np.zeros(0, np.int64)
            length = np.diff(np.append(starts, len(k)))
            is_cut = length > most
            if len(length):
                is_cut[0] |= first_cut
                is_cut[-1] |= last_cut
            place = np.arange(len(k)) - np.repeat(starts, length)
            frag = v[np.repeat(starts, length) + place // most * most] if len(k) else v
            kept = np.repeat((length > 1) | is_cut, length)
            return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (k, frag, np.repeat(is_cut, length), v)], ["key", "frag", "cut", "node"])

        for batch in batches:
            key, node = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in ((key, "key"), (node, "node")))
            last = int(_starts(key)[-1]) if len(key) else 0
            if last:  # all but the last run, which may go on
                yield cut(key[:last], node[:last], edge, False)
                key, node, edge = key[last:], node[last:], False
            if len(key) >= 64 * most:  # a large bucket leaves in whole pieces
                whole = len(key) // most * most
                yield cut(key[:whole], node[:whole], True, True)
                key, node, edge = key[whole:], node[whole:], True
        if len(key):
            yield cut(key, node, edge, True)

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[dict[str, np.ndarray], list[tuple[int, int]]]]:
    """The columns of some of the sorted rows, lists as rows of a matrix, and where each group begins and ends; no group
    is torn, however the batches cut them."""
    rest: pa.RecordBatch | None = None

    def some(rows: pa.RecordBatch, starts: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[int, int]]]:
        columns = {f.name: _unlisted(c) if pa.types.is_list(f.type) else c.to_numpy(zero_copy_only=False) for f, c in zip(rows.schema, rows.columns, strict=True)}
        return columns, list(zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        starts = _starts(*[batch.column(c).to_numpy(zero_copy_only=False) for c in by])
        last = int(starts[-1])
        if last:
            yield some(batch.slice(0, last), starts[:-1])
        rest = batch.slice(last)
    if rest is not None:
        yield some(rest, np.zeros(1, np.int64))


_STAR = pa.schema([("key", pa.int64()), ("frag", pa.int64()), ("a", pa.int64()), ("hub", pa.int64()), ("medoid", pa.bool_())])


def _stars(percent: int, coordinates: int, errors: float | None):
    """Fragments in; out the pairs to verify (each text with the medoid and with its nearest), and the medoid of each
    fragment that was cut from a larger bucket."""
    most = _most(coordinates, percent, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, groups in _groups(batches, ["key", "frag"]):
            found: list[tuple[int, int, int, int, bool]] = []
            for a, b in groups:
                node, n, x, key, frag = c["node"][a:b], c["n"][a:b], c["nibbles"][a:b], int(c["key"][a]), int(c["frag"][a])
                apart = differing(x, x)
                hub = int(apart.sum(axis=1).argmin())
                if c["cut"][a]:
                    found.append((key, frag, int(node[hub]), int(node[hub]), True))
                likely = (apart <= most) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
                np.fill_diagonal(likely, False)
                if not likely.any():
                    continue
                np.fill_diagonal(apart, 1 << 20)
                nearest = apart.argmin(axis=1)
                ends = {(min(i, j), max(i, j)) for i in np.flatnonzero(likely.any(axis=1)).tolist() for j in (hub, int(nearest[i])) if likely[i, j]}
                found += [(key, frag, int(node[j if i == hub else i]), int(node[i if i == hub else j]), False) for i, j in ends]
            yield _rows(found, _STAR)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_BLOCK = ["key", "frag", "other"]
_SIDES = pa.schema([(c, pa.int64()) for c in (*_BLOCK, "node")] + [("rest", pa.bool_())])
_PAIRS = pa.schema([("a", pa.int64()), ("hub", pa.int64()), ("salt", pa.int64())])


def _blocks(percent: int, coordinates: int, errors: float | None, column: str, pairs: bool):
    """Blocks in: the texts ``rest`` of one fragment that lie outside the bucket's main component, and all texts of another
    or the same fragment. Out, with ``pairs``, the pairs of different components that may be linked, each only from the
    first band that holds both, else which texts have such a partner."""
    most = _most(coordinates, percent, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, groups in _groups(batches, _BLOCK):
            taken: list[tuple[np.ndarray, ...]] = []
            for a, b in groups:
                u, y = a + np.flatnonzero(c["rest"][a:b]), a + np.flatnonzero(~c["rest"][a:b])
                if not len(u) or not len(y):
                    continue
                n, m = c["n"][u][:, None], c["n"][y]
                maybe = (c["component"][u][:, None] != c["component"][y]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                maybe &= (c["component"][y] == c["main"][y]) | (c["node"][u][:, None] < c["node"][y])  # of two outside the main component, once
                if not maybe.any():
                    continue
                maybe &= differing(c[column][u], c[column][y]) <= most
                if pairs:
                    i, j = np.nonzero(maybe)
                    both = c["bands"][u[i]] == c["bands"][y[j]]
                    first = c["bands"][u[i], both.argmax(axis=1)].view(np.int64) == c["key"][a] if len(i) else np.zeros(0, bool)
                    taken.append((y[j][first], u[i][first]))
                else:
                    taken.append((np.concatenate([u[maybe.any(axis=1)], y[maybe.any(axis=0)]]),))
            if taken and pairs:
                y, u = (np.concatenate(x) for x in zip(*taken, strict=True))
                with np.errstate(over="ignore"):
                    salt = mix64(c["key"][u].view(np.uint64) ^ (c["other"][u].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["node"][y], c["node"][u], salt)], schema=_PAIRS)
            elif taken:
                some = np.concatenate([x for (x,) in taken])
                yield pa.RecordBatch.from_arrays([pa.array(c[f][some]) for f in _SIDES.names], schema=_SIDES)

    return run


_TESTED = pa.schema([("a", pa.int64()), ("hub", pa.int64()), ("common", pa.int64()), ("whole", pa.int64())])


def _compare(size: int):
    """Rows come sorted by hub and salt, the hub's own text first in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, None
        for batch in batches:
            nodes, hubs, salts, member = (batch.column(c).to_pylist() for c in ("node", "hub", "salt", "member"))
            found = []
            for a, b, sets in _sets(batch.column("text"), size):
                for i in range(a, b):
                    s = sets[i - a]
                    if not member[i]:
                        group, hub = (hubs[i], salts[i]), s
                    elif group == (hubs[i], salts[i]):
                        at = np.searchsorted(hub, s)
                        at[at == len(hub)] = 0
                        common = int((hub[at] == s).sum()) if len(hub) else 0
                        found.append((nodes[i], hubs[i], common, len(s) + len(hub) - common))
            yield _rows(found, _TESTED)

    return run


def _verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, hub, common, whole): sizes of intersection and union for each pair (a, hub, salt), from the full sets. The
    texts of one (hub, salt), some hundreds, are held against the hub's set one after the other."""
    of_hub = pairs.select("hub", "salt").distinct().join(texts, F.col("hub") == F.col("node")).select("node", "hub", "salt", F.lit(0).alias("member"), "text")
    of_a = pairs.join(texts, F.col("a") == F.col("node")).select("node", "hub", "salt", F.lit(1).alias("member"), "text")
    rows = of_hub.unionByName(of_a).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return rows.mapInArrow(lean(_compare(size)), "a long, hub long, common long, whole long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, errors: float | None = ERRORS, fragment: int = FRAGMENT) -> DataFrame:
    """(id, n_shingles, component_id, kept, group_id, text_hash) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Two texts are linked if 100 * intersection >=
    ``percent`` * union of their shingle sets, each confirmed on the full sets; a component is what links reach, named
    by its smallest id. A text with fewer than ``shingle`` words has its whole sequence as its one shingle. A null or
    empty text, or one without words, has n_shingles 0, is linked with nothing and is its own component. A row without
    an id has a null component and is kept. Rows that repeat an id are judged each by its text. ``group_id`` numbers the
    components (null for rows without id or words), ``text_hash`` is Spark's xxhash64 of the text. Further columns of
    ``docs``, whatever their names, play no part. An empty table gives an empty result.

    Copies (equal sets) are one text from the start, so a group of copies of any size costs one row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind, width = dict(source.dtypes)["id"], bands * rows
    described = stored(source.mapInArrow(lean(_describe(shingle, bands, rows)), f"id {kind}, text_hash long, n long, s1 long, s2 long, bands array<long>, nibbles array<long>"), "signatures")
    sets = described.where("n > 0 and id is not null").groupBy("n", "s1", "s2")
    reps = sets.agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("bands").alias("bands"), F.first("nibbles").alias("nibbles"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "first", "bands", "nibbles"), "texts")
    keyed = reps.select(F.explode("bands").alias("key"), "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    placed = stored(keyed.mapInArrow(lean(_fragments(fragment)), "key long, frag long, cut boolean, node long"), "fragments")
    members = stored(placed.join(reps.select("node", "n", "nibbles"), "node"), "buckets")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of distinct nodes: one scan of the source, the wanted ids broadcast if they are few."""
        wanted = stored(nodes.join(reps.select("node", "first.id", "first.text_hash"), "node"), "wanted")
        some = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return stored(source.join(some, ["id", "text_hash"]).select("node", "text").dropDuplicates(["node"]), "candidates")

    def both_ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "hub")).alias("node")).distinct()

    linked = f"100 * common >= {percent} * whole"
    # First pass: stars in each fragment, and the medoids of a bucket's fragments tied to one of them.
    stars = stored(members.repartition("key", "frag").sortWithinPartitions("key", "frag").mapInArrow(lean(_stars(percent, width, errors)), "key long, frag long, a long, hub long, medoid boolean"), "stars")
    medoids = stars.where("medoid").select("key", F.col("hub").alias("a"))
    ties = medoids.join(medoids.groupBy("key").agg(F.min("a").alias("hub")), "key").where("a <> hub").select("a", "hub", F.expr("a div 256").alias("salt"))
    pairs = stars.where("not medoid").select("a", "hub", F.xxhash64("key", "frag").alias("salt")).unionByName(ties).groupBy("a", "hub").agg(F.min("salt").alias("salt"))
    pairs = stored(pairs, "pairs")
    tested = stored(_verify(pairs, texts_of(both_ends(pairs)), shingle), "tested")
    label = stored(components(tested.where(linked), "a", "hub"), "labels")

    # Second pass: what lies outside the main component of its bucket against the other components there.
    now = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = stored(now.select("key", "frag", "node", "n", "nibbles", "component"), "labelled")
    of_key = now.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    frags = stored(now.groupBy("key", "frag").agg(F.count("*").alias("c")).join(of_key, "key").select("key", "frag", "main"), "unsettled")
    now = stored(now.join(frags, ["key", "frag"]), "unsettled")
    rest = now.where("component <> main")
    sides = rest.select("key", "frag").distinct().join(frags.select("key", F.col("frag").alias("other")), "key")
    one = rest.join(sides, ["key", "frag"]).withColumn("rest", F.lit(True))
    two = now.withColumnRenamed("frag", "other").join(sides, ["key", "other"]).withColumn("rest", F.lit(False))
    blocks = one.unionByName(two.select(*one.columns)).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    doubtful = stored(blocks.mapInArrow(lean(_blocks(percent, width, errors, "nibbles", False)), "key long, frag long, other long, node long, rest boolean"), "doubtful")
    texts = texts_of(doubtful.select("node").distinct())
    fine = stored(texts.mapInArrow(lean(_refine(shingle, FINE)), "fine_of long, fine array<long>"), "fine")
    of_node = now.select("key", "node", "n", "component", "main")
    blocks = doubtful.join(of_node, ["key", "node"]).join(fine, F.col("node") == F.col("fine_of")).join(reps.select("node", "bands"), "node").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    pairs = blocks.mapInArrow(lean(_blocks(percent, FINE, errors, "fine", True)), "a long, hub long, salt long")
    pairs = stored(pairs.join(tested.select("a", "hub"), ["a", "hub"], "left_anti").join(tested.select(F.col("hub").alias("a"), F.col("a").alias("hub")), ["a", "hub"], "left_anti"), "pairs")
    links = stored(_verify(pairs, texts, shingle).where(linked), "links")
    if not links.isEmpty():
        ends = links.join(label.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left").join(label.select(F.col("node").alias("hub"), F.col("component").alias("y")), "hub", "left")
        ends = ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "hub").alias("y"))
        moved = stored(components(ends, "x", "y").select(F.col("node").alias("old"), F.col("component").alias("new")), "moved")
        whole = label.unionByName(moved.join(label, moved["old"] == label["node"], "left_anti").select(F.col("old").alias("node"), F.col("old").alias("component")))
        label = stored(whole.join(moved, whole["component"] == moved["old"], "left").select("node", F.coalesce("new", "component").alias("component")), "labels")

    named = label.join(reps.select("node", "first.id"), "node")
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    named = named.select("node", "component").join(smallest, "component")
    of_set = reps.select("node", "n", "s1", "s2", F.col("first.id").alias("own")).join(named, "node", "left")
    of_set = of_set.select("n", "s1", "s2", F.coalesce("smallest", "own").alias("component_id"), F.coalesce("component", "node").alias("group_id"))
    out = described.select("id", "text_hash", "n", "s1", "s2").join(of_set, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    group = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("group_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), group.alias("group_id"), "text_hash")
