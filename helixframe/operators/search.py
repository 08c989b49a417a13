"""Bounded Hamming joins of guides with targets, and the overflow cut-off."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby, product
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from helixframe.functions import dna
from helixframe.functions.enzymes import Enzyme
from helixframe.scratch import cut

MAX_MISMATCHES, MAX_OFF_TARGETS = 4, 2000
#: Up to so many guides are compared with every target, and up to so many neighbours of guides (about 90 bytes each) are broadcast.
SCANNED_GUIDES, BROADCAST_KEYS = 2_000, 2_000_000
#: What a comparison, the look-up of a key, a broadcast key and a shuffled row take, in comparisons.
COMPARE, PROBE, BUILD, SHUFFLE = 1, 6, 10, 60
#: Leading bases of a half by which pairs are dealt to tasks, how many targets a deal may hold before there is one base more, by how many bases targets are counted
#: for this, and how many candidates are compared at once.
DEALT, DEAL_ROWS, COUNTED, AT_ONCE = 3, 1 << 20, 6, 1 << 18
#: How many pairs leave a task at once, and how many of some guides may wait for the cut at a limit.
PAIRS_AT_ONCE, PAIRS_HELD = 1 << 16, 1 << 22
#: A list of targets with one key that is longer is ordered by parts of their other half, and how many guides are searched at once.
LONG, GUIDES_AT_ONCE = 256, 1 << 16
#: Up to so many guides (about 100 bytes each) are broadcast to their pairs; more are dealt with their names.
SENT_GUIDES = 1 << 19
#: Targets that are taken to be there where nobody counted them.
MANY_TARGETS = 1 << 24
#: Bases of a bin of the traversal, and about how many targets its first round holds.
LEAD, FIRST_ROUND = 7, 1 << 16


def named(guides: DataFrame) -> DataFrame:
    return guides.select(F.col("guide_id"), F.col("bases").alias("guide"), F.col("enc").alias("guide_enc"))


def _heavy(targets: DataFrame) -> list[str]:
    return [f.name for f in targets.schema.fields if f.dataType.typeName() == "array"]


def attach(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """The lists (positions) of the hits' targets; they join last, when the pairs are known."""
    heavy = _heavy(targets)
    return hits.join(targets.select(F.col("bases").alias("_of"), *heavy), F.col("bases") == F.col("_of")).drop("_of") if heavy else hits


def join_scan(guides: DataFrame, targets: DataFrame, enzyme: Enzyme, most: int = MAX_MISMATCHES) -> DataFrame:
    """Every target against a broadcast block of guides; for a number of guides that has been checked to be small."""
    distance = dna.mismatches(F.col("enc"), F.col("guide_enc"), enzyme.guide)
    return targets.join(F.broadcast(named(guides)), distance <= most).withColumn("mm", distance).drop("enc", "guide_enc")


def masks(length: int, most: int) -> list[int]:
    """What a packed string of ``length`` bases is XORed with to give each of its neighbours within ``most`` mismatches."""
    out = []
    for n in range(min(most, length) + 1):
        for places in combinations(range(length), n):
            out += [sum(d << 2 * p for p, d in zip(places, digits)) for digits in product((1, 2, 3), repeat=n)]
    return out


def neighbours(length: int, most: int) -> int:
    return sum(comb(length, n) * 3**n for n in range(min(most, length) + 1))


def near_keys(enc: Column, enzyme: Enzyme, k: int, most: int) -> Column:
    """All keys that half ``k`` of a target within ``most`` mismatches may have, if that half holds at most ``most // 2`` of them."""
    # One literal, whatever its length is.
    every = F.split(F.lit(",".join(map(str, masks(enzyme.halves[k][0], most // 2)))), ",").cast("array<bigint>")
    return F.transform(every, lambda m: enzyme.half(enc, k).bitwiseXOR(m))


def _marked(enzyme: Enzyme) -> int:
    """A bit above the keys marks those of the second half."""
    return 1 << 2 * max(size for size, _ in enzyme.halves)


def guide_keys(guides: DataFrame, enzyme: Enzyme, most: int) -> DataFrame:
    """The guides with all their keys: guide_id, guide, guide_enc, guide_half (of both halves)."""
    marked = F.transform(near_keys(F.col("guide_enc"), enzyme, 1, most), lambda x: x + _marked(enzyme))
    # Guides are few rows before their neighbours are listed, so they are dealt out first.
    spark = guides.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return named(guides).repartition(tasks, "guide_enc").withColumn("guide_half", F.explode(F.concat(near_keys(F.col("guide_enc"), enzyme, 0, most), marked)))


def exact(pairs: DataFrame, enzyme: Enzyme, most: int, second: Column) -> DataFrame:
    """Pairs within ``most`` mismatches; those met on the ``second`` half count only if the first one is no way to them."""
    distance = dna.mismatches(F.col("enc"), F.col("guide_enc"), enzyme.guide)
    first = dna.mismatches(enzyme.half(F.col("enc"), 0), enzyme.half(F.col("guide_enc"), 0), enzyme.halves[0][0])
    return pairs.where((distance <= most) & (~second | (first > most // 2))).withColumn("mm", distance).drop("enc", "guide_enc")


def join_halves(guides: DataFrame, targets: DataFrame, enzyme: Enzyme, most: int = MAX_MISMATCHES, broadcast: bool = False) -> DataFrame:
    """Equi-join on a half of the compared bases, then the exact distance.

    Of two strings within ``most`` mismatches, some half has at most ``most // 2`` of them.  The guides' halves are replaced by
    all their neighbours at that distance, so a key is 4^10 wide and candidates are few; a pair counts in its first half
    unless that has more mismatches than allowed.  ``broadcast`` sends the guides' keys to the targets, which then stay
    where they are; else both sides are shuffled.  Lists of positions wait until the pairs are known.
    """
    heavy = _heavy(targets)
    own = F.array(enzyme.half(F.col("enc"), 0), enzyme.half(F.col("enc"), 1) + _marked(enzyme))
    left, right = targets.drop(*heavy).withColumn("half", F.explode(own)), guide_keys(guides, enzyme, most)
    pairs = left.join(F.broadcast(right) if broadcast else right, F.col("half") == F.col("guide_half"))
    return attach(exact(pairs, enzyme, most, F.col("half") >= _marked(enzyme)).drop("half", "guide_half"), targets)


def join_probe(guides: DataFrame, targets: DataFrame, enzyme: Enzyme, most: int = MAX_MISMATCHES) -> DataFrame:
    return join_halves(guides, targets, enzyme, most, True)


def dealt(size: int, n_targets: int) -> int:
    """Leading bases of a half of ``size`` by which ``n_targets`` are dealt."""
    c = min(DEALT, size)
    while c < size and 4**c * DEAL_ROWS < n_targets:
        c += 1
    return c


def reach(most: int) -> tuple[int, int]:
    """Mismatches that either half of a pair may have where the pair counts: with at most the first number in the first half there, else the rest of them in the second."""
    return most // 2, most - most // 2 - 1


def _apart(size: int) -> np.ndarray:
    """Differing bases by the XOR of two packed strings of ``size`` bases."""
    x = np.arange(4**size, dtype=np.int64)
    return np.bitwise_count((x | x >> 1) & int("01" * size, 2)).astype(np.int8)


def _slices(n: np.ndarray, most: int):
    """Ranges [from, to) of lists of ``n`` candidates each, about ``most`` together; a longer list is one range."""
    ends = np.cumsum(n)
    a, done = 0, 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def _listed(first: np.ndarray, n: np.ndarray):
    """The places of ranges that begin at ``first`` and hold ``n``, some ranges at once: (number of the range, place)."""
    full = np.flatnonzero(n)
    for a, b in _slices(n[full], AT_ONCE):
        some = full[a:b]
        of = np.repeat(some, n[some])
        yield of, np.arange(len(of)) + np.repeat(first[some] - np.cumsum(n[some]) + n[some], n[some])


class _Part:
    """The long lists of targets with one key, in the order of one ``part`` (size, shift) of their other half, by which ranges of them are found."""

    def __init__(self, key: np.ndarray, begin: np.ndarray, theirs: np.ndarray, row: np.ndarray, part: tuple[int, int]):
        self.size, self.shift = part
        self.row, bins = row, 4**self.size
        places = np.flatnonzero(row[key] >= 0)  # targets are sorted by key
        fine = row[key[places]].astype(np.int64) * bins + self.of(theirs[places])
        self.places = places[np.argsort(fine, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(fine, minlength=(int(row.max(initial=-1)) + 1) * bins))])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x >> self.shift) & (4**self.size - 1)

    def near(self, key: np.ndarray, across: np.ndarray, most: int):
        """Candidates (number of the guide, place of the target) whose part is within ``most`` mismatches of the guide's."""
        every = np.array(masks(self.size, most), np.int64)
        at_once = max(1, AT_ONCE // len(every))
        for a in range(0, len(key), at_once):
            some = slice(a, a + at_once)
            at = (self.row[key[some]].astype(np.int64)[:, None] * 4**self.size + (self.of(across[some])[:, None] ^ every)).ravel()
            for of, k in _listed(self.begin[at], self.begin[at + 1] - self.begin[at]):
                yield a + of // len(every), self.places[k]


class _Deal:
    """Targets (packed) whose half begins with the ``c`` bases ``prefix``, and the pairs that guides have with them on that half.

    Targets are sorted by the rest of their half; each of a guide's neighbours there is a range of them, of which those stay whose other half is near enough.
    Ranges of over ``LONG`` targets, as common words make them, are not read through: of the other half's two parts one has at most half of the mismatches that
    are left, so only the targets with such a part are compared.
    """

    def __init__(self, targets: np.ndarray, enzyme: Enzyme, most: int, half: int, prefix: int, c: int):
        (size, self.shift), (self.other, self.other_shift) = enzyme.halves[half], enzyme.halves[1 - half]
        self.most, self.half, self.prefix, self.c, self.rest = most, half, prefix, c, size - c
        key = self.cut_out(targets, self.shift, self.rest)
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.counts = np.bincount(key, minlength=4**self.rest)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        key = key[self.order]
        self.theirs = self.cut_out(targets[self.order], self.other_shift, self.other).astype(np.int32)
        self.apart = _apart(self.other)
        self.row = np.full(4**self.rest, -1, np.int32)
        long = np.flatnonzero(self.counts > LONG)
        self.row[long] = np.arange(len(long))
        halves = ((self.other - self.other // 2, 2 * (self.other // 2)), (self.other // 2, 0))
        self.parts = [_Part(key, self.begin, self.theirs, self.row, x) for x in halves] if len(long) else []

    @staticmethod
    def cut_out(x: np.ndarray, at: int, n: int) -> np.ndarray:
        return (x >> at) & (4**n - 1)

    def pairs(self, guides: np.ndarray):
        """Pieces of the pairs (number of a target, guide, mismatches) of different guides; a piece is made of about ``AT_ONCE`` candidates at most."""
        near = reach(self.most)[self.half]
        lead = _apart(self.c)[self.cut_out(guides, self.shift + 2 * self.rest, self.c) ^ self.prefix]
        for ahead in range(min(near, self.c) + 1):
            group = guides[lead == ahead]
            for mine in (group[k : k + GUIDES_AT_ONCE] for k in range(0, len(group), GUIDES_AT_ONCE)):
                yield from self._pairs(mine, ahead, near)

    def _pairs(self, mine: np.ndarray, ahead: int, near: int):
        own, across = self.cut_out(mine, self.shift, self.rest), self.cut_out(mine, self.other_shift, self.other).astype(np.int32)

        def keep(of, at, so_far, again=None):
            d = self.apart[self.theirs[at] ^ across[of]]
            good = d <= self.most - so_far
            if self.half:  # else it is met on the first half
                good &= d > reach(self.most)[0]
            good = np.flatnonzero(good)
            if again is not None:  # else the first part is near enough, too
                good = good[~again(of[good], at[good])]
            if len(good):
                yield self.order[at[good]], mine[of[good]], d[good] + np.int32(so_far)

        for mask in masks(self.rest, near - ahead):
            so_far = ahead + int(np.bitwise_count((mask | mask >> 1) & int("01" * self.rest or "0", 2)))
            theirs_key = own ^ mask
            n, many = self.counts[theirs_key], self.row[theirs_key] >= 0
            for of, at in _listed(self.begin[theirs_key], np.where(many, 0, n)):
                yield from keep(of, at, so_far)
            many, most_of_part = np.flatnonzero(many), (self.most - so_far) // 2
            for k, part in enumerate(self.parts if len(many) else ()):
                seen = None
                if k:
                    a = self.parts[0]
                    seen = lambda of, at, a=a, m=most_of_part: _apart(a.size)[a.of(self.theirs[at]) ^ a.of(across[of])] <= m
                for of, at in part.near(theirs_key[many], across[many], most_of_part):
                    yield from keep(many[of], at, so_far, seen)

    def first_hits(self, guides: np.ndarray, pick):
        """What ``pick`` leaves of the pairs of ``guides``: it gets all that are left of a guide's at once, and of fewer guides if these are too many."""
        held, n = [], 0
        for piece in self.pairs(guides):
            held.append(piece)
            n += len(piece[0])
            if n > PAIRS_HELD:
                held = [pick(*_joined(held))]
                n = len(held[0][0])
                if 2 * n > PAIRS_HELD and len(guides) > 1:
                    for some in (guides[: len(guides) // 2], guides[len(guides) // 2 :]):
                        yield from self.first_hits(some, pick)
                    return
        if held:
            yield pick(*_joined(held))


def _joined(pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*pieces))


def meet(targets: np.ndarray, guides: np.ndarray, enzyme: Enzyme, most: int, half: int, prefix: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a ``_Deal`` of packed strings."""
    none = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))
    return _joined([none, *_Deal(targets, enzyme, most, half, prefix, c).pairs(np.unique(guides))])


def _first_hits(left: pa.Table, enzyme: Enzyme, limit: int):
    """Of the pairs of a guide those with fewer than ``limit`` occurrences before them in traversal order."""
    lead = pc.shift_right(left.column("enc"), 2 * (enzyme.guide - LEAD))
    order = pc.sort_indices(pa.table({"lead": lead, "bases": left.column("bases")}), [("lead", "ascending"), ("bases", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # More than the limit in one target is the limit, so sums stay small.
    cnt = np.minimum(left.column("cnt").to_numpy().astype(np.int64), limit)

    def pick(at: np.ndarray, guide: np.ndarray, mm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((rank[at], guide))
        at, guide, mm = at[by], guide[by], mm[by]
        before = np.cumsum(cnt[at]) - cnt[at]
        begins = np.flatnonzero(np.concatenate([[True], guide[1:] != guide[:-1]]))
        before -= np.repeat(before[begins], np.diff(np.append(begins, len(guide))))
        kept = before < limit
        return at[kept], guide[kept], mm[kept]

    return pick


class _Deals:
    """Deals by leading bases of either half: ``DEALT`` bases, and one more wherever a deal would hold over ``rows`` targets.

    Targets that agree in as many leading bases as were counted are dealt out by a hash, and guides are sent to all of their deals.  ``counts`` are the targets
    of either half by these bases.
    """

    def __init__(self, counts: list[np.ndarray], rows: int):
        self.of: list[tuple[int, int, int]] = []  # half, number of leading bases, these bases
        self.first: list[dict[int, np.ndarray]] = []  # of either half, by number of leading bases: the first deal of these, or -1
        self.parts: list[int] = []  # how many deals hold the same leading bases
        for half, n in enumerate(counts):
            deepest = (len(n).bit_length() - 1) // 2
            open_, first = np.ones(4 ** min(DEALT, deepest), bool), {}
            for c in range(min(DEALT, deepest), deepest + 1):
                held = n.reshape(4**c, -1).sum(axis=1)
                ends = open_ & ((held <= rows) | (c == deepest))
                first[c] = np.full(4**c, -1, np.int32)
                for prefix in np.flatnonzero(ends):
                    parts = max(1, -(-int(held[prefix]) // rows))
                    first[c][prefix] = len(self.of)
                    self.of += [(half, c, int(prefix))] * parts
                    self.parts += [parts] * parts
                open_ = np.repeat(open_ & ~ends, 4)
                if not open_.any():
                    break
            self.first.append({c: x for c, x in first.items() if (x >= 0).any()})

    @classmethod
    def counted(cls, targets: DataFrame, enzyme: Enzyme, n_targets: int) -> _Deals:
        """Few targets need no counting; else at most 2 * 4^``COUNTED`` numbers reach the driver."""
        if n_targets <= DEAL_ROWS:
            return cls([np.zeros(4 ** min(DEALT, size), np.int64) for size, _ in enzyme.halves], DEAL_ROWS)
        deep = [min(COUNTED, size) for size, _ in enzyme.halves]
        lead = [F.shiftright(enzyme.half(F.col("enc"), k), 2 * (enzyme.halves[k][0] - deep[k])) + k * 4 ** deep[0] for k in (0, 1)]
        counts = np.zeros(4 ** deep[0] + 4 ** deep[1], np.int64)
        for r in targets.select(F.explode(F.array(*lead)).alias("lead")).groupBy("lead").count().collect():
            counts[r["lead"]] = r["count"]
        return cls(np.split(counts, [4 ** deep[0]]), DEAL_ROWS)

    def target(self, enc: Column, enzyme: Enzyme, half: int) -> Column:
        """The deal of a target on ``half``."""
        deepest = max(self.first[half])
        spread = np.full(4**deepest, -1, np.int64)
        for c, first in self.first[half].items():
            spread = np.maximum(spread, np.repeat(first, 4 ** (deepest - c)))
        lead = F.shiftright(enzyme.half(enc, half), 2 * (enzyme.halves[half][0] - deepest)).cast("int")
        # One literal, whatever its length is.
        listed = lambda x: F.get(F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>"), lead)
        parts = np.array(self.parts)[spread]
        return listed(spread) if parts.max() == 1 else listed(spread) + F.pmod(F.xxhash64(enc), listed(parts)).cast("int")

    def reached(self, enc: np.ndarray, enzyme: Enzyme, most: int):
        """Pieces (number of a guide, deal) of the deals within ``reach`` of the guides."""
        all_parts = np.array(self.parts)
        for (size, shift), near, by in zip(enzyme.halves, reach(most), self.first):
            for c, first in by.items():
                every = np.array(masks(c, near), np.int64)
                at_once = max(1, AT_ONCE // max(1, len(every)))
                for k in range(0, len(enc), at_once):
                    lead = (enc[k : k + at_once] >> (shift + 2 * (size - c))) & (4**c - 1)
                    deal = first[lead[:, None] ^ every]
                    guide, place = np.nonzero(deal >= 0)
                    deal = deal[guide, place]
                    n = all_parts[deal]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield k + np.repeat(guide, n), np.repeat(deal, n) + nth


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of sorted batches that agree in the first column, with their value there."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        for a, b in zip(begins, [*begins[1:], len(key)]):
            yield int(key[a]), batch.slice(a, b - a)


def join_dealt(
    guides: DataFrame, targets: DataFrame, enzyme: Enzyme, most: int = MAX_MISMATCHES, n_targets: int = MANY_TARGETS, limit: int | None = None
) -> DataFrame:
    """The pairs of ``join_halves``, but neighbours are listed inside tasks.

    Targets are dealt by the first bases of either half, guides to all deals within ``reach`` of their own:
    with three bases and 4 mismatches that is 47 rows a guide, where its neighbours are 467.  Targets bring their columns but for lists; up to ``SENT_GUIDES`` guides are
    dealt as packed bases, and their names join the pairs where these are, by a broadcast; more bring their names, so that pairs, which may grow faster than
    the tables, are not shuffled to be named.  With a ``limit``, each deal leaves out what has so many occurrences of its own before it in traversal order.
    A task holds the targets of one deal at a time, at most about ``DEAL_ROWS``; guides pass by ``GUIDES_AT_ONCE`` and pairs leave by ``PAIRS_AT_ONCE``, however many there are.
    """
    sent = guides.limit(SENT_GUIDES + 1).count() <= SENT_GUIDES
    names = [] if sent else ["guide_id", "guide"]
    enc, light = F.col("enc"), targets.drop(*_heavy(targets)).where("enc is not null")
    deals = _Deals.counted(light, enzyme, n_targets)
    spark = guides.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Guides are few rows before their deals are listed, so they are dealt out first; those that share their bases are one, unless they bring names.
    own = named(guides.where("enc is not null")).select(F.col("guide_enc").alias("enc"), *names).repartition(tasks, "enc")
    own = own.dropDuplicates(["enc"]) if sent else own
    at_once = PAIRS_AT_ONCE

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for guide, deal in deals.reached(batch.column(0).to_numpy(), enzyme, most):
                some = batch.take(pa.array(guide))
                yield pa.RecordBatch.from_arrays([pa.array(2 * deal + 1, pa.int64()), *some.columns], ["_key", *batch.schema.names])

    columns = [x for x in light.columns if x != "enc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, pieces in groupby(_runs(batches), lambda x: x[0] >> 1):
            held, deal, mine, n = [], None, [], 0
            for key, piece in pieces:  # targets come first
                if not key & 1:
                    held.append(piece)
                elif held or deal:
                    if deal is None:
                        left = pa.Table.from_batches(held).combine_chunks()
                        deal = _Deal(left.column("enc").to_numpy(), enzyme, most, *(deals.of[number][k] for k in (0, 2, 1)))
                        pick = _first_hits(left, enzyme, limit) if limit is not None else None
                        held, left = None, left.select(columns)
                    mine.append(piece)
                    n += piece.num_rows
                    if n >= GUIDES_AT_ONCE:
                        yield from found(deal, left, pa.Table.from_batches(mine), pick)
                        mine, n = [], 0
            if n:
                yield from found(deal, left, pa.Table.from_batches(mine), pick)

    def found(deal: _Deal, left: pa.Table, right: pa.Table, pick) -> Iterator[pa.RecordBatch]:
        mine = right.column("enc").to_numpy()
        right, order = right.select(names).combine_chunks(), np.argsort(mine, kind="stable")
        different = np.unique(mine)
        for at, guide, mm in _by_size(deal.first_hits(different, pick) if pick else deal.pairs(different), at_once):
            if names:  # all guides with these bases
                first = np.searchsorted(mine, guide, "left", order)
                n = np.searchsorted(mine, guide, "right", order) - first
                rows = order[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
                at, guide, mm = np.repeat(at, n), mine[rows], np.repeat(mm, n)
            for k in range(0, len(at), at_once):
                cut_ = slice(k, k + at_once)
                out = [*left.take(pa.array(at[cut_])).columns, pa.chunked_array([pa.array(guide[cut_], pa.int64())]), pa.chunked_array([pa.array(mm[cut_], pa.int32())])]
                out += right.take(pa.array(rows[cut_])).columns if names else []
                yield from pa.Table.from_arrays(out, [*columns, "guide_enc", "mm", *names]).to_batches()

    key = StructField("_key", LongType())
    left = light.withColumn("_key", F.explode(F.array(*[2 * deals.target(enc, enzyme, k).cast("long") for k in (0, 1)])))
    right = own.mapInArrow(spread, StructType([key, *own.schema.fields]))
    # Rows of a deal come together, its targets first.
    none = lambda frame, others: [F.lit(None).cast(others.schema[x].dataType).alias(x) for x in others.columns if x not in frame.columns]
    rows = left.select("_key", "enc", *columns, *none(left, right)).unionByName(right.select("_key", "enc", *names, *none(right, left)))
    rows = rows.repartition(tasks, F.shiftright("_key", 1)).sortWithinPartitions("_key")
    extra = [own.schema[name] for name in names]
    schema = StructType([*(light.schema[x] for x in columns), StructField("guide_enc", LongType()), StructField("mm", IntegerType()), *extra])
    pairs = rows.mapInArrow(run, schema)
    pairs = pairs.join(F.broadcast(named(guides)), "guide_enc") if sent else pairs
    return attach(pairs.select("guide_id", "guide", *columns, "mm"), targets)


def _by_size(pieces, least: int):
    """Pieces put together until they hold ``least`` pairs."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= least:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def costs(n_guides: int, n_targets: int, enzyme: Enzyme, most: int = MAX_MISMATCHES) -> dict[str, float]:
    """What each strategy costs, in comparisons; those whose broadcast would be too large are left out."""
    keys = sum(neighbours(size, most // 2) for size, _ in enzyme.halves)
    deals = sum(neighbours(dealt(size, n_targets), near) for (size, _), near in zip(enzyme.halves, reach(most)))
    met = n_guides * n_targets * sum(neighbours(size, most // 2) / 4**size for size, _ in enzyme.halves)
    out = {"halves": SHUFFLE * (2 * n_targets + n_guides * deals) + PROBE * n_guides * keys + COMPARE * met}
    if n_guides * keys <= BROADCAST_KEYS:
        out["probe"] = PROBE * 2 * n_targets + BUILD * n_guides * keys + COMPARE * met
    if n_guides <= SCANNED_GUIDES:
        out["scan"] = COMPARE * n_guides * n_targets
    return out


def pick(n_guides: int, n_targets: int, enzyme: Enzyme, most: int = MAX_MISMATCHES) -> str:
    price = costs(n_guides, n_targets, enzyme, most)
    return min(price, key=price.get)


def discover(guides: DataFrame, targets: DataFrame, enzyme: Enzyme, most: int = MAX_MISMATCHES, strategy: str = "auto", n_targets: int | None = None, limit: int | None = None) -> DataFrame:
    """Hits (guide_id, guide, bases, cnt, mm, ...) by the cheapest join: ``scan``, ``probe`` or ``halves``.

    ``auto`` counts the guides, as far as it needs to, and takes ``n_targets`` as given (an index knows it).  With a ``limit``, hits that have
    so many occurrences of their guide before them in traversal order may be left out.
    """
    if strategy == "auto":
        enough = max(SCANNED_GUIDES, BROADCAST_KEYS // sum(neighbours(size, most // 2) for size, _ in enzyme.halves)) + 1
        strategy = pick(guides.limit(enough).count(), MANY_TARGETS if n_targets is None else n_targets, enzyme, most)
    if strategy == "halves":
        return join_dealt(guides, targets, enzyme, most, MANY_TARGETS if n_targets is None else n_targets, limit)
    return {"scan": join_scan, "probe": join_probe}[strategy](guides, targets, enzyme, most)


def overflow(hits: DataFrame, enzyme: Enzyme, most: int = MAX_OFF_TARGETS) -> DataFrame:
    """Keep hits in traversal order while the occurrences before them are under ``most``.

    The hit that crosses the limit is kept and marks its guide: ``overflowed`` is true for all of
    its rows.  A limit of 0 keeps nothing.  Hits are summed by bin first; bins behind the limit are dropped and the others
    ordered one by one, so no task orders all hits of a guide.
    """
    hits = cut(hits, "hits").withColumn("_bin", enzyme.bin(F.col("bases")))
    in_order = W.partitionBy("guide_id").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = hits.groupBy("guide_id", "_bin").agg(F.sum("cnt").alias("_n"))
    bins = bins.withColumn("_base", F.coalesce(F.sum("_n").over(in_order), F.lit(0))).withColumn("overflowed", F.sum("_n").over(W.partitionBy("guide_id")) >= most)
    near = hits.join(bins.where(F.col("_base") < most).drop("_n"), ["guide_id", "_bin"])
    inside = W.partitionBy("guide_id", "_bin").orderBy(*enzyme.order(F.col("bases"))).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))
    return near.withColumn("_before", before).where(F.col("_before") < most).drop("_before", "_base", "_bin")


def bin_number(enc: Column, enzyme: Enzyme) -> Column:
    """The traversal's bin of a target as a number; bins are met in its order."""
    return F.shiftrightunsigned(enc, 2 * (enzyme.guide - LEAD))


def rounds(bins: list[tuple[int, int]], first: int = FIRST_ROUND) -> list[tuple[int, int]]:
    """Ranges [from, to) of bin numbers in traversal order, each of which holds about as many targets as all before it together; ``bins`` are (number, targets)."""
    out, start, passed, held = [], 0, 0, 0
    for number, n in sorted(bins):
        held += n
        if held >= max(first, passed):
            out.append((start, number + 1))
            start, passed, held = number + 1, passed + held, 0
    return out + [(start, 4**LEAD)] if held or not out else out


def discover_until(
    guides: DataFrame, targets: DataFrame, enzyme: Enzyme, most: int = MAX_MISMATCHES, limit: int = MAX_OFF_TARGETS, strategy: str = "auto",
    bins: list[tuple[int, int]] | None = None, first: int | None = None,
) -> DataFrame:
    """The same rows as ``overflow`` of all hits, but a guide is searched no further than to its limit.

    Targets are met in rounds over their bins in traversal order, each as large as all before it, so few are needed; guides that reached
    the limit leave after each.  Only hits before the limit are written.  ``bins`` are the numbers and sizes of at most
    4^7 bins, as an index lists them.  The first round holds about ``first`` targets, or at least as many as the guides have
    keys, so that listing these again in each round never outweighs the targets.
    """
    if first is None:
        first = max(FIRST_ROUND, guides.count() * sum(neighbours(size, most // 2) for size, _ in enzyme.halves))
    if bins is None:
        counted = targets.groupBy(bin_number(F.col("enc"), enzyme).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        bins = [tuple(r) for r in counted.collect()]
    heavy, shift = _heavy(targets), 2 * (enzyme.guide - LEAD)
    slim, left = targets.drop(*heavy), guides
    in_order = W.partitionBy("guide_id").orderBy(*enzyme.order(F.col("bases")))
    kept, seen = None, None
    for start, stop in rounds(bins, first) if limit > 0 else []:
        part = slim.where((F.col("enc") >= start << shift) & (F.col("enc") < stop << shift))
        hits = discover(left, part, enzyme, most, strategy, sum(n for b, n in bins if start <= b < stop), limit)
        # A hit is one occurrence at least, so later ones than the limit's number are not needed.
        hits = hits.withColumn("_nth", F.row_number().over(in_order)).where(F.col("_nth") <= limit).drop("_nth")
        hits = hits.join(seen, "guide_id", "left") if seen is not None else hits.withColumn("_seen", F.lit(0).cast("long"))
        before = F.coalesce("_seen", F.lit(0)) + F.coalesce(F.sum("cnt").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        new = cut(hits.withColumn("_before", before).where(F.col("_before") < limit).drop("_before", "_seen"), "hits-round")
        kept = new if kept is None else kept.unionByName(new)
        seen = cut(kept.groupBy("guide_id").agg(F.sum("cnt").alias("_seen")), "hits-seen")
        left = cut(guides.join(seen.where(F.col("_seen") >= limit), "guide_id", "left_anti"), "guides-left")
        if not left.limit(1).count():
            break
    if kept is None:
        return attach(discover(guides, slim, enzyme, most, strategy).limit(0), targets).withColumn("overflowed", F.lit(False))
    return attach(kept.join(seen.select("guide_id", (F.col("_seen") >= limit).alias("overflowed")), "guide_id"), targets)


def by_guide(hits: DataFrame) -> DataFrame:
    """Distinct targets and occurrences of each guide with a hit."""
    return hits.groupBy("guide_id", "guide").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("cnt").alias("ot_count"))


def reciprocal(guides: DataFrame, enzyme: Enzyme, most: int = 1) -> DataFrame:
    """Guides of the same set within 1 to ``most`` mismatches: guide_id, partners (bases in guide order)."""
    others = guides.select(F.col("bases"), "enc", F.col("guide_id").alias("partner_id"))
    near = discover(guides, others, enzyme, most).where(F.col("mm") > 0)
    listed = F.sort_array(F.collect_list(F.struct("partner_id", "bases")))
    return near.groupBy("guide_id", "guide").agg(F.array_join(F.transform(listed, lambda x: x["bases"]), ",").alias("partners"))
