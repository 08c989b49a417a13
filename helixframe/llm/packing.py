"""Best-fit packing by a linear grouping scheme (operator 3).

Documents are encoded whole, ended by id 1, and cut into pieces of ``CAPACITY`` tokens; the pieces
are packed into sequences of that capacity without further cuts.

Only the histogram of piece lengths, at most ``CAPACITY`` rows at any input size, reaches the
driver.  There, large lengths are put in order and dealt into groups of equal cardinality, each
length rounded up to its group's largest.  Configurations of these few sizes are optimised: the largest size left
is completed by the subset of sizes that fills the sequence best (an exact bounded knapsack), as often as
supply allows.  Then actual lengths replace rounded ones, which gives gaps, and small lengths go
into the tightest gaps by best fit.  The plan says, for runs of equal-length pieces by rank, which sequences and
offsets they get; it holds a bounded number of runs and is joined to the pieces.

A piece's rank among those of its length is its place within its task plus the counts of tasks
before, so no length is sorted or ranked in one task.

Nulls and edge cases: a null or empty text is the one id 1; a null doc_id is kept; repeated rows are
packed each; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import cut, table
from helixframe.llm.textbytes import chunks, column
from helixframe.llm.wordbpe import WordBpe

CAPACITY = 4096
END_ID = 1
#: Sizes the large lengths are rounded to: the rounding, not the choice of configurations, makes most of the waste.
GROUPS = 1024
#: Lengths above capacity / SMALL are large.
SMALL = 8
VOCABULARY = "word_bpe_49k.json"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_ENCODERS: dict[str, WordBpe] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut_pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or vocabulary_path()
        encoder = _ENCODERS.setdefault(file, None) or WordBpe(file)
        _ENCODERS[file] = encoder
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in chunks(batches):
            ids, at = encoder.encode(column(part, "text"))
            ids = np.insert(ids, at[1:], END_ID).astype("<u4", copy=False)
            at = at + np.arange(len(at))
            size = np.diff(at)
            number = (size + capacity - 1) // capacity
            row = np.repeat(np.arange(len(size)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            order = np.argsort(length, kind="stable")
            same = length[order]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(same, same) + seen[same]
            seen += np.bincount(length, minlength=capacity + 1)
            view, begin = memoryview(ids).cast("B"), (at[row] + start) * 4
            crc = [zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), (begin + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return run


class _Plan:
    """Runs of pieces by length and rank, and where they go."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.used = dict.fromkeys(counts, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        """``n`` pieces, ``each`` a sequence one after another, from ``sequence`` and ``offset`` on."""
        low = self.used[length]
        self.used[length] = low + n
        self.rows.append((length, low, low + n, sequence, each, offset))

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def group_sizes(large: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping of ``large`` (length, count), longest first: (rounded size, [[length, count], ...])."""
    total = sum(n for _, n in large)
    share, out, room = max(1, -(-total // groups)), [], 0
    for length, n in large:
        while n:
            if not room:
                out.append((length, []))
                room = share
            take = min(n, room)
            out[-1][1].append([length, take])
            n, room = n - take, room - take
    merged: dict[int, list[list[int]]] = {}
    for size, members in out:  # groups of one size are one size
        merged.setdefault(size, []).extend(members)
    return list(merged.items())


def best_completion(room: int, sizes: list[int], supply: list[int]) -> list[int]:
    """How many of each size fill ``room`` best: bounded subset sums as bits of one integer."""
    reach, steps, every = 1, [], (1 << (room + 1)) - 1
    for size, n in zip(sizes, supply):
        steps.append(reach)
        add = reach
        for _ in range(min(n, room // size)):
            add = (add << size) & every
            grown = reach | add
            if grown == reach:
                break
            reach = grown
        if reach >> room:
            break
    left, use = reach.bit_length() - 1, [0] * len(sizes)
    for k in range(len(steps) - 1, -1, -1):
        while not steps[k] >> left & 1:
            use[k] += 1
            left -= sizes[k]
    return use


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> _Plan:
    """Pack ``counts`` (pieces by length) into few sequences."""
    out = _Plan(counts)
    full = counts.get(capacity, 0)
    if full:
        out.put(capacity, full, out.open(full), 1, 0)
    large = sorted(((k, n) for k, n in counts.items() if capacity // SMALL < k < capacity), reverse=True)
    small = sorted(((k, n) for k, n in counts.items() if k <= capacity // SMALL), reverse=True)
    grouped = group_sizes(large, groups)
    sizes, queues = [s for s, _ in grouped], [q for _, q in grouped]
    supply = [sum(n for _, n in q) for q in queues]
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> [first sequence, sequences]
    for top in range(len(sizes)):
        while supply[top]:
            supply[top] -= 1
            use = best_completion(capacity - sizes[top], sizes[top:], supply[top:])
            supply[top] += 1
            use[0] += 1
            times = min(supply[top + k] // u for k, u in enumerate(use) if u)
            for k, u in enumerate(use):
                supply[top + k] -= u * times
            _substitute(out, [queues[top + k] for k, u in enumerate(use) for _ in range(u)], times, capacity, gaps)
    _best_fit(out, small, capacity, gaps)
    return out


def _substitute(out: _Plan, slots: list[list[list[int]]], times: int, capacity: int, gaps: dict) -> None:
    """Give ``times`` sequences one actual piece a slot; runs of equal lengths stay together."""
    first, runs = out.open(times), []
    for queue in slots:  # slots of one group share its queue
        left, own = times, []
        while left:
            take = min(left, queue[0][1])
            own.append([queue[0][0], take])
            queue[0][1] -= take
            left -= take
            if not queue[0][1]:
                queue.pop(0)
        runs.append(own)
    at = 0
    while at < times:
        n, offset = min(own[0][1] for own in runs), 0
        for own in runs:
            length = own[0][0]
            out.put(length, n, first + at, 1, offset)
            offset += length
            own[0][1] -= n
            if not own[0][1]:
                own.pop(0)
        if offset < capacity:
            gaps[capacity - offset].append([first + at, n])
        at += n


def _best_fit(out: _Plan, small: list[tuple[int, int]], capacity: int, gaps: dict) -> None:
    order = sorted(gaps)
    for length, left in small:
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                number = -(-left // each)
                gap, block = capacity, [out.open(number), number]
            else:
                gap = order[at]
                block = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                each = gap // length
            whole = min(block[1], left // each)
            if whole:
                out.put(length, whole * each, block[0], each, capacity - gap)
                left -= whole * each
                _free(gaps, order, gap - each * length, block[0], whole)
            if whole < block[1]:
                if left:  # fewer than ``each``: the last sequence of this length
                    out.put(length, left, block[0] + whole, each, capacity - gap)
                    _free(gaps, order, gap - left * length, block[0] + whole, 1)
                    left, whole = 0, whole + 1
                _free(gaps, order, gap, block[0] + whole, block[1] - whole)


def _free(gaps: dict, order: list[int], gap: int, first: int, n: int) -> None:
    if gap and n:
        if gap not in gaps:
            bisect.insort(order, gap)
        gaps[gap].append([first, n])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(texts.mapInArrow(_cut_pieces(tokenizer, capacity), PIECE_SCHEMA), "pieces")
    dealt = cut(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    base = cut(dealt.select("length", "task", before.alias("base")), "piece-base")
    # Tasks times lengths grow with the input: this side is never broadcast.
    ranked = pieces.join(base.hint("merge"), ["length", "task"]).withColumn("nth", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "nth")
    return ranked.mapInArrow(_place(plan(counts, capacity, groups)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _place(plan: _Plan):
    """Sequence and offset of each piece: its run is found by length and rank.  A plan has a bounded number of runs."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    low, sequence, each, place = rows[:, 1], rows[:, 3], rows[:, 4], rows[:, 5]
    key = (rows[:, 0] << 48) + low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "nth").to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            rank = rank - low[at]
            found = [pa.array(sequence[at] + rank // each[at]), pa.array(place[at] + rank % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces."""
    return pack(docs)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
