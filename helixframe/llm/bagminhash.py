"""Near-duplicate documents by BagMinHash over five-word shingles (operator 7).

A text is the multiset of its five-word shingles (fewer than five words: one shingle of
all of them); words are runs of non-space bytes.  Texts link if their weighted Jaccard similarity, the sum of
smaller over the sum of larger multiplicities, is at least 0.8.

BagMinHash: the weight axis is cut into the unit bin [0, 1) and dyadic bins [2^k, 2^(k+1)).  Each
shingle has one Poisson process a bin, whose rate is the bin's width.  A process is known by its first point,
which carries a signature component; it is split into halves, one of which keeps the point while the other starts
later, until its cell lies below the text's multiplicity or beyond it.  The component's value is its first point's
time, so two texts agree in it with probability equal to their similarity.  A process ends as soon as it is later than
the largest component of its text, so few points are drawn for long texts.

Bands of the signature propose pairs.  Exact copies are one vertex.  In a bucket every
member is compared with the smallest id, so tight groups cost linear work.  Where a member
fails that test and the bucket still holds several components, failed members meet all other members, block
by block as matrices of shared elements; only links that join components leave such a task, so that no
class is lost and no list of pairs is made.

Vertices are distinct texts, whatever their ids are, so rows of one doc_id with several texts are judged one by one.

Nulls and edge cases: texts that are null or have no word link with nothing; so do rows with a null
doc_id; repeated rows are copies; the document kept of a class has its smallest doc_id, and of that id's texts in the class the
one with the smallest MD5; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import components, cut, table, unused
from helixframe.llm.textbytes import chunks, column, mix, utf8, word_hashes

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 20, 6
#: Up to this many texts' ids and hashes are broadcast (about 80 bytes each); more are shuffled.
BROADCAST_IDS = 1_000_000
MEMBERS_A_TASK = 64
#: Below so many live processes each gives ``BLOCK_POINTS`` points at once.
FEW, BLOCK_POINTS = 4096, 16
#: A large bucket is dealt into blocks of about so many members and bytes of multisets.
BLOCK_MEMBERS, BLOCK_BYTES = 400, 16 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(data: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ordered by text: text number, 48-bit hash, multiplicity."""
    word, first = word_hashes(data, at)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    acc = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        acc += mix(word[j : j + len(acc)] + _ODD[j % 5]) * _ODD[(j + 1) % 5]
    good = owner[: len(acc)] == owner[k - 1 :][: len(acc)] if len(acc) else np.zeros(0, bool)
    own, value = owner[: len(acc)][good], acc[good]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.full(len(short), len(_ODD), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += mix(word[first[short[has]] + j] + _ODD[j % 5]) * _ODD[(j + 1) % 5]
        own, value = np.concatenate([own, short.astype(np.uint64)]), np.concatenate([value, mix(extra + count[short].astype(np.uint64))])
    keys = np.sort((own << np.uint64(48)) | (mix(value) >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, times = keys[new], np.diff(np.append(new, len(keys)))
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), times


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures of ``n`` multisets; ``owner`` is sorted.  No elements: infinities.

    All texts' processes advance side by side, in rounds, and a process ends when its point is later than the
    largest component of its text so far, as no later point can lower any.
    """
    out = np.full((n, m), np.inf)
    live = _roots(owner, element, weight)
    while len(live.own):
        # Cells beyond the weight are left out by splitting; a process inside it gives its point.
        inside = live.low + live.width <= live.weight
        fresh = inside & ~live.used
        np.minimum.at(out.reshape(-1), live.own[fresh] * m + _component(live.draw[fresh], m), live.time[fresh])
        limit = out.max(axis=1)
        live = _Processes.joined(_next(live.of(inside & (live.width == 1))), *_split(live.of(live.width > 1)))
        live = live.of(live.time <= limit[live.own])
        if 0 < len(live.own) < FEW:
            _run_out(out, live, m)
            live = live.of((live.width > 1) & (live.time <= out.max(axis=1)[live.own]))
    return out


class _Processes(NamedTuple):
    """Poisson processes over cells [low, low + width) of an element's weight axis, each at its first point not yet passed on.

    ``draw`` decides a point's component and the half of the cell it lies in; ``used`` marks points that have counted.
    """

    own: np.ndarray
    element: np.ndarray
    weight: np.ndarray
    low: np.ndarray
    width: np.ndarray
    time: np.ndarray
    draw: np.ndarray
    used: np.ndarray

    def of(self, which: np.ndarray) -> _Processes:
        return _Processes(*(x[which] for x in self))

    @staticmethod
    def joined(*parts: _Processes) -> _Processes:
        return _Processes(*(np.concatenate(x) for x in zip(*parts)))


def _component(draw: np.ndarray, m: int) -> np.ndarray:
    return (((draw & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)).astype(np.int64)


def _wait(draw: np.ndarray) -> np.ndarray:
    """Exponential times of rate 1 from the upper bits, which neither component nor half uses."""
    return -np.log(((draw >> np.uint64(25)).astype(np.float64) + 0.5) * 2.0**-39)


def _seed(element: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return mix(element * _ODD[0] + (low.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _ODD[2] + width.astype(np.uint64) * _ODD[4])


def _roots(owner: np.ndarray, element: np.ndarray, weight: np.ndarray) -> _Processes:
    """The first points of the bins [0, 1), [1, 2), [2, 4), ... that begin below each element's weight."""
    parts, low = [], 0
    while True:
        width = np.full(len(owner), max(1, low))
        draw = _seed(element, np.full(len(owner), low), width)
        parts.append(_Processes(owner, element, weight, np.full(len(owner), low), width, _wait(draw) / width, draw, np.zeros(len(owner), bool)))
        low = max(1, 2 * low)
        more = weight > low
        if not more.any():
            return _Processes.joined(*parts)
        owner, element, weight = owner[more], element[more], weight[more]


def _split(p: _Processes) -> tuple[_Processes, _Processes]:
    """Both halves of each cell: the point's own half keeps it, the other gets a first point of its own, later than it."""
    half = p.width // 2
    right = (p.draw >> np.uint64(24)) & np.uint64(1) == 1
    again = mix(p.draw + _ODD[1])  # the point's next bit; its component stays
    keep = p._replace(low=p.low + np.where(right, half, 0), width=half, draw=(p.draw & np.uint64(0xFFFFFF)) | (again & ~np.uint64(0xFFFFFF)))
    low = p.low + np.where(right, 0, half)
    draw = _seed(p.element, low, half)
    other = p._replace(low=low, width=half, time=p.time + _wait(draw) / half, draw=draw, used=np.zeros(len(half), bool))
    keep = keep._replace(used=p.used | (p.low + p.width <= p.weight))
    return tuple(x.of(x.low < x.weight) for x in (keep, other))


def _next(p: _Processes) -> _Processes:
    """The next point of each unit cell."""
    draw = mix(p.draw * _ODD[3] + _ODD[0])
    return p._replace(time=p.time + _wait(draw), draw=draw, used=np.zeros(len(draw), bool))


def _run_out(out: np.ndarray, live: _Processes, m: int) -> None:
    """The points of a few unit cells, ``BLOCK_POINTS`` at a time, until they are later than all components of their text."""
    p = live.of(live.width == 1)
    p = _Processes.joined(p.of(~p.used), _next(p.of(p.used)))
    while len(p.own):
        time, draw = np.empty((len(p.own), BLOCK_POINTS)), np.empty((len(p.own), BLOCK_POINTS), np.uint64)
        for k in range(BLOCK_POINTS):
            time[:, k], draw[:, k] = p.time, p.draw
            p = _next(p)
        np.minimum.at(out.reshape(-1), (p.own[:, None] * m + _component(draw, m)).ravel(), time.ravel())
        p = p.of(p.time <= out.max(axis=1)[p.own])


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[1]
    for j in range(rows):
        key = mix(key * _ODD[0] + bits[:, :, j])
    return key.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data, at = utf8(column(part, "text"))
            owner, element, weight = shingles(data, at)
            n = part.num_rows
            keys = band_keys(signatures(owner, element, weight, n, bands * rows), bands, rows)
            some = np.bincount(owner, minlength=n) > 0
            view = memoryview(data)
            digest = [hashlib.md5(view[a:b], usedforsecurity=False).digest() if s else None for a, b, s in zip(at[:-1].tolist(), at[1:].tolist(), some.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(digest, pa.binary()), lists], ["doc_id", "key", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        data, at = utf8(column(part, "text"))
        owner, element, weight = shingles(data, at)
        ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
        packed = [element[a:b].astype("<u8").tobytes() + weight[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(packed, pa.binary())], ["doc_id", "bag"])


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, "<u8", n), np.frombuffer(bag, "<u4", n, 8 * n)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two multisets with sorted elements."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.int64)) if len(a[0]) else 0
    return both / max(1, int(a[1].sum(dtype=np.int64)) + int(b[1].sum(dtype=np.int64)) - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt, b), the row of ``a`` itself first with a null ``b``."""
    head, bag = None, None
    for batch in batches:
        left, right, sim = [], [], []
        for a, b, packed in zip(*(column(batch, c).to_pylist() for c in ("a", "b", "bag"))):
            if b is None:
                head, bag = a, unpack(packed)
            else:
                assert head == a
                left.append(a)
                right.append(b)
                sim.append(overlap(bag, unpack(packed)))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "sim"])


def verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Exact similarities of distinct ``pairs(a, b)``.

    Pairs with one ``a`` are dealt by salt to tasks of about ``MEMBERS_A_TASK`` and streamed past a's
    multiset, which is the only one held.
    """
    pairs = cut(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_TASK).cast("int").alias("salts"))
    heads = cut(many, "pair-heads")
    salted = pairs.join(heads, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    members = salted.join(bags.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "bag")
    first = heads.join(bags.withColumnRenamed("doc_id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "bag"
    )
    rows = members.unionByName(first).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return cut(rows.mapInArrow(_compare, "a long, b long, sim double"), "pair-sims")


def _units(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Multisets as sets: a hash of each element and copy number, and the multiset of each."""
    parts = [unpack(x) for x in bags]
    weight = np.concatenate([w for _, w in parts]).astype(np.int64)
    owner = np.repeat(np.repeat(np.arange(len(parts)), [len(e) for e, _ in parts]), weight)
    copy = np.arange(len(owner)) - np.repeat(np.cumsum(weight) - weight, weight)
    element = np.repeat(np.concatenate([e for e, _ in parts]), weight)
    return mix(element + copy.astype(np.uint64) * _ODD[0]), owner


def block_links(reps: list[int], bags: list[bytes], component: list[int], tested: np.ndarray, block: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join components, between members of ``tested`` and all members (of the other block, if there are two)."""
    unit, owner = _units(bags)
    size = np.bincount(owner, minlength=len(bags)).astype(np.float64)
    _, unit, shared = np.unique(unit, return_inverse=True, return_counts=True)
    good = shared[unit] > 1
    unit, owner = unit[good], owner[good]
    order = np.argsort(unit, kind="stable")
    unit, owner = unit[order], owner[order]
    unit = np.cumsum(np.concatenate([[0], unit[1:] != unit[:-1]])) if len(unit) else unit
    rows = np.flatnonzero(tested)
    both = np.zeros((len(rows), len(bags)))
    width = 4096
    for low in range(0, int(unit[-1]) + 1 if len(unit) else 0, width):
        a, b = np.searchsorted(unit, (low, low + width))
        dense = np.zeros((len(bags), width), np.float32)
        dense[owner[a:b], unit[a:b] - low] = 1
        both += dense[rows] @ dense.T
    near = both >= similarity * (size[rows, None] + size[None, :] - both) - 1e-9
    if block.min() != block.max():
        near &= block[rows, None] != block[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(near)):
        i = rows[i]
        a, b = root(component[i]), root(component[j])
        if a != b:
            parent[a] = b
            out.append((reps[i], reps[j]))
    return out


def link_rest(known: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links between components that share a bucket in which some member failed against the hub.

    ``known(bucket, rep, failed, component)``.  A large bucket is dealt into blocks, every two of which meet
    in one task as matrices of shared elements; no pair leaves the task unless it joins components.
    """
    sized = known.join(bags.select(F.col("doc_id").alias("rep"), F.length("bag").alias("bytes")), "rep")
    open_ = sized.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("failed").alias("failed"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    open_ = cut(open_.where("failed and c0 <> c1").select("bucket", blocks.alias("blocks")), "bag-open")
    rows = known.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "rep", "failed", "component")
    rows = cut(rows, "bag-blocks").join(bags.withColumnRenamed("doc_id", "rep"), "rep")

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        get = lambda c: group.column(c).to_pylist()
        out = block_links(get("rep"), get("bag"), get("component"), np.array(get("failed")), np.array(get("block")), similarity)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return cut(rows.groupBy("bucket", "b0", "b1").applyInArrow(link, "a long, b long"), "bag-late")


def near_rows(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, key (MD5 of a text that can link), copy_id, class_id, kept; as ``near_classes`` says."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(texts.mapInArrow(_sign(bands, rows), "doc_id long, key binary, bands array<long>"), "bag-signed")
    usable = signed.where("key is not null and doc_id is not null")
    # ``rep`` numbers the distinct texts; the table is written, so numbers stay as they are.
    copies = cut(usable.groupBy("key").agg(F.min("doc_id").alias("low")).withColumn("rep", F.monotonically_increasing_id()), "bag-copies")
    reps = signed.join(copies, (signed["key"] == copies["key"]) & (signed["doc_id"] == copies["low"])).groupBy("rep").agg(F.first("bands").alias("bands"))
    dealt = cut(reps.select("rep", F.explode("bands").alias("bucket")), "bag-buckets")
    full = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).where("n > 1").select("bucket", "hub")
    member = cut(dealt.join(cut(full, "bag-hubs"), "bucket"), "bag-members")
    star = member.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()

    wanted = cut(copies.join(member.select("rep").distinct(), "rep"), "bag-wanted")
    narrow = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    own = texts.where("text is not null").join(narrow, (F.col("doc_id") == F.col("low")) & (F.unhex(F.md5("text")) == F.col("key")))
    bags = cut(own.groupBy(F.col("rep").alias("doc_id")).agg(F.first("text").alias("text")).mapInArrow(_sets, "doc_id long, bag binary"), "bag-sets")
    sims = verify(star, bags)
    links = sims.where(F.col("sim") >= similarity).select("a", "b")
    labels = components(links)

    # Members that failed against their bucket's hub meet the bucket's other members.
    far = F.lit(1.0) - F.coalesce("sim", F.lit(1.0))
    known = member.join(sims.withColumnRenamed("a", "hub").withColumnRenamed("b", "rep"), ["hub", "rep"], "left")
    known = known.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select(
        "bucket", "rep", (far > 1.0 - similarity + 1e-12).alias("failed"), F.coalesce("component", "rep").alias("component")
    )
    late = link_rest(cut(known, "bag-known"), bags, similarity)
    linked = copies.join(components(links.unionByName(late), "cc-all").withColumnRenamed("v", "rep"), "rep")
    least = linked.groupBy("component").agg(F.min(F.struct("low", "key")).alias("least"))
    named = linked.join(least, "component").select("key", F.col("least.low").alias("class_low"), F.col("least.key").alias("class_key"))
    named = cut(copies.join(named, "key", "left").select("key", "low", F.coalesce("class_low", "low").alias("class_low"), F.coalesce("class_key", "key").alias("class_key")), "bag-named")

    out = signed.select("doc_id", "key").join(named, "key", "left")
    own_id = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    first = (F.col("doc_id") == F.col("class_low")) & (F.col("key") == F.col("class_key"))
    return out.select("doc_id", "key", own_id("low").alias("copy_id"), own_id("class_low").alias("class_id"), F.coalesce(first, F.lit(True)).alias("kept"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, copy_id (smallest id of its exact copies), class_id (smallest id of its class), kept."""
    return near_rows(docs, similarity, bands, rows).drop("key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row stays, as ``near_classes`` marks it; rows that link with nothing stay.

    Rows are judged by id and text.  Of equal ids with equal texts one row stays, that of the smallest hash of all its columns; only
    these rows are shuffled.
    """
    marks = cut(near_rows(docs).where("doc_id is not null and key is not null").groupBy("doc_id", "key").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near-marks")
    of = {n: unused(docs, n) for n in ("near_id", "near_key")}
    named = lambda rows: rows.select(F.col("doc_id").alias(of["near_id"]), F.col("key").alias(of["near_key"]))
    meets = (F.col("doc_id").cast("long") == F.col(of["near_id"])) & (F.unhex(F.md5("text")) == F.col(of["near_key"]))
    lost = cut(named(marks.where("not kept or n > 1")), "near-lost")
    rows = docs.join(F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost, meets, "left_anti")
    twice = cut(named(marks.where("kept and n > 1")), "near-twice")
    if not twice.limit(1).count():
        return rows
    whole = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.join(twice, meets).groupBy(*of.values()).agg(F.min_by(F.struct(*whole), F.xxhash64(*whole)).alias("row"))
    return rows.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
