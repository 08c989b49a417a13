"""Near-duplicate embeddings by spherical-cap filters from structured random product codes (operator 6).

Vectors link if their cosine, in double precision, is at least 0.9.  A filter is a direction made of
one random codeword for each of M blocks of coordinates (after a random rotation), so B^M filters need only M*B
codewords; several independent codes are used, as filters of one code depend on each other.  A vector passes a filter if its score reaches a threshold; list decoding finds all
filters that it passes by extending partial codes whose best completion can still reach the
threshold.  Vectors meet in the filters they share and are then compared exactly.

The number of filters grows with the number of vectors, so that unrelated vectors share few, and the threshold
follows, so that a vector passes ``PASSES`` on average.  A pair is counted only in the smallest
filter that it shares, so no list of pairs is made: a task emits, for its filters, each vector's
number of links and the links that join its own components.  Large filters are dealt into blocks, every two of
which meet in one task.

Nulls and edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; nor do vectors of different lengths, or rows with a null vec_id (their component is null and they are kept);
equal vectors are one vertex, whatever their ids are, and link with each other; repeated rows count as equal vectors; rows of one
vec_id with different vectors have links of their own; an empty table gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import components, cut, table
from helixframe.llm.textbytes import column

COSINE = 0.9
#: Independent codes, filters that a vector passes over all of them, and how full filters may be.
CODES, PASSES, MEET = 8, 72, 0.15
#: Pairs at ``COSINE`` that are planted to find how many codes reach the recall.
RECALL, PLANTED = 0.97, 300
BLOCK = 512
SMALL = 24
SPACE = 64
SEED = 6


def parameters(n: int) -> tuple[int, int]:
    """Blocks M and codewords B of each code for ``n`` vectors.

    ``n * PASSES / MEET`` filters in all let an unrelated vector appear in a given one of a vector's filters
    with probability ``MEET``; there is a least number, so that caps stay far from half spheres.
    """
    filters = max(PASSES / 0.00135, n * PASSES / MEET) / CODES
    # Two blocks lose the fewest pairs; four only where two would need books of over 31,623 codewords (from 16.7 million vectors).
    blocks = 2 if filters <= 1e9 else 4
    return blocks, math.ceil(filters ** (1.0 / blocks))


@lru_cache(4)
def _codes(length: int, blocks: int, words: int) -> tuple[list[tuple[np.ndarray, list[np.ndarray]]], float]:
    """For each code an isometry into max(SPACE, length) dimensions and its codewords; and the threshold.

    The threshold is set on seeded random vectors, so that these pass ``PASSES / CODES`` filters of a code on average.
    There are ``CODES`` codes, or as many more as pairs at ``COSINE`` need to share a filter with probability ``RECALL``.
    """
    space = -(-max(SPACE, length) // blocks) * blocks
    rng = np.random.default_rng((SEED, length, blocks, words))

    def code() -> tuple[np.ndarray, list[np.ndarray]]:
        turn = np.linalg.qr(rng.standard_normal((space, length)))[0].T
        books = []
        for _ in range(blocks):
            book = rng.standard_normal((words, space // blocks))
            books.append((book / np.linalg.norm(book, axis=1, keepdims=True)).astype(np.float32))
        return turn, books

    codes = [code() for _ in range(CODES)]
    some = rng.standard_normal((100, space))
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    parts = _scores(some, codes[0][1])
    while len(parts) > 2:
        parts = [(parts[k][:, :, None] + parts[k + 1][:, None, :]).reshape(len(some), -1) for k in range(0, len(parts), 2)]
    right, low, high = np.sort(parts[1], axis=1), 0.0, 2.0
    for _ in range(30):
        mid = (low + high) / 2
        n = sum(int((right.shape[1] - np.searchsorted(r, mid - l)).sum()) for l, r in zip(parts[0], right))
        low, high = (mid, high) if n > PASSES / CODES * len(some) else (low, mid)
    one, two = rng.standard_normal((2, PLANTED, space))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    two -= (two * one).sum(axis=1, keepdims=True) * one
    two = COSINE * one + math.sqrt(1 - COSINE**2) * two / np.linalg.norm(two, axis=1, keepdims=True)
    (i, a), (j, b) = _passed(one, codes[0][1], low, 0), _passed(two, codes[0][1], low, 0)
    met = len(set(i[np.isin(i + a * PLANTED, j + b * PLANTED)].tolist()))
    miss = 1 - min(max(met, 1), PLANTED - 1) / PLANTED
    codes += [code() for _ in range(math.ceil(math.log(1 - RECALL) / math.log(miss)) - CODES)]
    return codes, low


def _scores(turned: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of each block's codewords, in single precision: they only decide which vectors meet."""
    turned, width = turned.astype(np.float32), turned.shape[1] // len(books)
    return [turned[:, k * width : (k + 1) * width] @ book.T for k, book in enumerate(books)]


def _passed(turned: np.ndarray, books: list[np.ndarray], reach: float, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all turned vectors at once, (vector, filter of code ``number`` that it passes), in order of vector.

    Partial codes are extended block by block as long as their best completion reaches the threshold.
    """
    n, words, scores = len(turned), len(books[0]), _scores(turned, books)
    tops = [s.max(axis=1) for s in scores]
    rest = sum(tops)
    owner, sums, code = np.arange(n), np.zeros(n), np.full(n, number, np.int64)
    for top, mine in zip(tops, scores):
        rest = rest - top
        start = sums >= (reach - rest - top)[owner]
        owner, sums, code = owner[start], sums[start], code[start]
        best = np.full(n, -np.inf)
        np.maximum.at(best, owner, sums)
        row, word = np.divmod(np.flatnonzero(mine >= (reach - rest - best).astype(np.float32)[:, None]), words)
        begin = np.searchsorted(row, np.arange(n + 1))
        size = begin[owner + 1] - begin[owner]
        at = np.repeat(begin[owner] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner, code = np.repeat(owner, size), np.repeat(code, size) * words + word[at]
        sums = np.repeat(sums, size) + mine[owner, word[at]]
        good = sums >= (reach - rest)[owner]
        owner, sums, code = owner[good], sums[good], code[good]
    return owner, code


def decode(unit: np.ndarray, blocks: int, words: int) -> list[np.ndarray]:
    """For each unit vector, the sorted numbers of the filters that it passes."""
    codes, reach = _codes(unit.shape[1], blocks, words)
    found = [_passed(unit @ turn, books, reach, number) for number, (turn, books) in enumerate(codes)]
    owner, code = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((code, owner))
    return np.split(code[order], np.searchsorted(owner[order], np.arange(1, len(unit))))


def vectors(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all lists in double precision (null: not a number), lengths, and where each begins."""
    lists = lists.cast(pa.large_list(pa.float64()))
    at = np.frombuffer(lists.buffers()[1], np.int64, len(lists) + 1, lists.offset * 8)
    flat = lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    return flat, np.diff(at), at[:-1] - at[0]


def usable(lists: pa.Array) -> np.ndarray:
    """Which vectors can link: not null, not empty, finite and not zero."""
    flat, length, begin = vectors(lists)
    owner = np.repeat(np.arange(len(length)), length)
    bad = np.bincount(owner, ~np.isfinite(flat), len(length)) > 0
    some = np.bincount(owner, np.where(np.isfinite(flat), flat != 0, False), len(length)) > 0
    return some & ~bad & ~np.asarray(lists.is_null())


def units(lists: pa.Array, length: int) -> np.ndarray:
    """Unit vectors of lists of one length; scaled first, so that no square over- or underflows."""
    flat, _, _ = vectors(lists)
    rows = flat.reshape(-1, length)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("good", pa.array(usable(column(batch, "embedding"))))


def _filters(blocks: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "embedding")
            length = np.asarray(lists.value_lengths())
            step = max(1, min(500, (4 << 20) // words))  # bounds the scores held at once
            for size in np.unique(length):
                for rows in np.array_split(np.flatnonzero(length == size), max(1, int((length == size).sum()) // step)):
                    part = batch.take(pa.array(rows))
                    found = decode(units(column(part, "embedding"), int(size)), blocks, words)
                    # A filter's number carries the length, so that only equal lengths meet.
                    flat = (np.concatenate(found) << 12) + int(size) % 4096
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([column(part, "rep"), lists], ["rep", "filters"])

    return run


def _first_meeting(filter_id: int, mine: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the pairs (left, right) of members, which share no smaller filter."""
    lower = [f[: np.searchsorted(f, filter_id)] for f in mine]
    if len(left) <= 64:
        return np.array([not len(np.intersect1d(lower[i], lower[j], assume_unique=True)) for i, j in zip(left, right)], bool)
    owner = np.repeat(np.arange(len(lower)), [len(f) for f in lower])
    _, code, times = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
    good = times[code] > 1
    owner, code = owner[good], np.unique(code[good], return_inverse=True)[1]
    common = np.zeros((len(mine), len(mine)), np.float32)
    for low in range(0, int(code.max()) + 1 if len(code) else 0, 4096):
        some = (code >= low) & (code < low + 4096)
        dense = np.zeros((len(mine), 4096), np.float32)
        dense[owner[some], code[some] - low] = 1
        common += dense @ dense.T
    return common[left, right] == 0


class _Links:
    """Counts and joining links of the groups of one task."""

    def __init__(self, cosine: float) -> None:
        self.cosine = cosine
        self.rows: list[tuple[int, int | None, int | None]] = []

    def group(self, filter_id: int, across: bool, block: np.ndarray, rep: np.ndarray, copies: np.ndarray, unit: np.ndarray, mine: list[np.ndarray]) -> None:
        near = np.triu(unit @ unit.T >= self.cosine, 1)
        if across:
            near &= block[:, None] != block[None, :]
        left, right = np.nonzero(near)
        if not len(left):
            return
        good = _first_meeting(filter_id, mine, left, right)
        left, right = left[good], right[good]
        links = np.bincount(left, copies[right], len(rep)) + np.bincount(right, copies[left], len(rep))
        self.rows += [(int(rep[k]), None, int(links[k])) for k in np.flatnonzero(links)]
        parent = list(range(len(rep)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in zip(left.tolist(), right.tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                self.rows.append((int(rep[i]), int(rep[j]), None))

    def flush(self) -> pa.RecordBatch:
        out, self.rows = self.rows, []
        columns = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])


def _compare(cosine: float):
    """Rows come sorted by (filter, b0, b1, rep); a group is held whole, at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held = _Links(cosine), None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([whole.column(c).to_numpy() for c in ("filter", "b0", "b1")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            _groups(links, whole.slice(0, last), np.concatenate([[0], cuts]) if len(cuts) else np.zeros(1, np.int64))
            held = whole.slice(last)
            yield links.flush()
        if held is not None:
            _groups(links, held, np.array([0, held.num_rows]))
            yield links.flush()

    return run


def _groups(links: _Links, rows: pa.Table, cuts: np.ndarray) -> None:
    """Compare the groups that begin at ``cuts``; small ones are screened together."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    lists = rows.column("embedding").chunk(0)
    length = np.asarray(lists.value_lengths())
    at = np.unique(np.append(cuts, rows.num_rows))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hit = np.zeros(len(at) - 1, bool)
    size = np.diff(at)
    flat, _, begin = vectors(lists)
    for width in np.unique(length):
        of = np.flatnonzero(length == width)
        unit = np.zeros((rows.num_rows, int(width))) if len(of) < rows.num_rows else None
        found = units(lists.take(pa.array(of)), int(width))
        if unit is None:
            unit = found
        else:
            unit[of] = found
        thin = unit.astype(np.float32)
        for step in range(1, SMALL):
            same = np.flatnonzero((owner[step:] == owner[:-step]) & (length[step:] == width)) if step < rows.num_rows else []
            if len(same):
                cosine = np.einsum("ij,ij->i", thin[same], thin[same + step])
                hit[owner[same[cosine >= links.cosine - 1e-5]]] = True
        get = lambda c: rows.column(c).to_numpy()
        filters, rep, copies, block, b0, b1 = (get(c) for c in ("filter", "rep", "copies", "block", "b0", "b1"))
        mine = rows.column("filters").chunk(0)
        for g in np.flatnonzero(hit | (size > SMALL)):
            a, b = at[g], at[g + 1]
            if length[a] == width:
                own = [np.array(x, np.int64) for x in mine.slice(a, b - a).to_pylist()]
                links.group(int(filters[a]), b0[a] != b1[a], block[a:b], rep[a:b], copies[a:b], unit[a:b], own)


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    marked = rows.mapInArrow(_check, f"vec_id long, embedding {kind}, good boolean")
    good = F.col("good") & F.col("vec_id").isNotNull()
    key = F.when(good, F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    keyed = cut(marked.select("vec_id", key.alias("key"), F.when(good, F.col("embedding")).alias("embedding")), "caps-keyed")
    # ``rep`` numbers the distinct vectors; the table is written, so numbers stay as they are.
    copies = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    copies = cut(copies.withColumn("rep", F.monotonically_increasing_id()), "caps-copies")
    reps = keyed.join(copies, "key").where("vec_id = low").dropDuplicates(["rep"]).select("rep", "copies", "embedding")
    reps = cut(reps, "caps-reps")
    blocks, words = parameters(reps.count())
    passed = cut(reps.select("rep", "embedding").mapInArrow(_filters(blocks, words), "rep long, filters array<long>"), "caps-filters")
    dealt = passed.select("rep", F.explode("filters").alias("filter"))
    shared = dealt.groupBy("filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1")
    # Only ids and filters travel until here; filters of one vector are gone, from a vector's own list too.
    met = cut(dealt.join(cut(shared.drop("m"), "caps-shared"), "filter"), "caps-met")
    carried = reps.join(met.groupBy("rep").agg(F.sort_array(F.collect_list("filter")).alias("filters")), "rep")
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("filter", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "rep")
    full = met.join(cut(carried, "caps-carried"), "rep")
    full = full.repartition("filter", "b0", "b1").sortWithinPartitions("filter", "b0", "b1", "rep")
    found = cut(full.mapInArrow(_compare(cosine), "a long, b long, n long"), "caps-links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.where("b is not null").select("a", "b"), "caps-cc").withColumnRenamed("v", "rep")
    linked = copies.join(labels, "rep")
    named = linked.join(linked.groupBy("component").agg(F.min("low").alias("component_low")), "component").select("rep", "component_low")
    known = cut(copies.join(counts, "rep", "left").join(named, "rep", "left"), "caps-known")
    out = keyed.select("vec_id", "key").join(known, "key", "left")
    links = F.when(F.col("rep").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
    component = F.coalesce("component_low", "low", "vec_id")
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def op6_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
