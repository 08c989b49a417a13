"""Toxicity from the nearest labelled examples by exact TF-IDF cosine (operator 4).

A text's terms are its lower-case words and their first four and five bytes.  The vocabulary is
every term of a bounded sample of labelled examples (``POSITIVES`` and ``NEGATIVES``, evenly drawn by a hash of
doc_id), so cosines are over all terms that a text can share with an example; document frequencies of its terms are counted over all documents.
The examples form a block-max inverted index (see ``Index``), whose bounds leave out blocks that cannot hold one of the k
nearest, so these are exact.  Distance-weighted votes are mapped to
probabilities by isotonic regression on the examples' own leave-one-out votes, weighted to the
labels' true shares.  The nearest examples are the evidence.

Nulls and edge cases: a null text is empty; a text without a known term of weight has no neighbours and gets the share
of toxic ones among such examples; without labels of both kinds every score is that of no evidence, 0;
a null doc_id counts as the empty string in the fold and is never learnt from; an example labelled
twice is toxic if one label says so; repeated rows are scored each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table
from helixframe.llm.langid import fold
from helixframe.llm.textbytes import chunks, column, padded, span_hash, utf8, words

POSITIVES, NEGATIVES = 1000, 2000
NEIGHBOURS = 15
#: Terms whose weights are kept as dense matrices, examples of a block, blocks looked at before the first bound, texts compared at once.
DENSE, BLOCK, WAVE, TEXTS = 1024, 64, 3, 128
THRESHOLD = 0.3
_PREFIXES = (4, 5)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[128:] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts and the number of the text of each."""
    data, at = utf8(texts)
    low = _LOW[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    latin = latin[(low[latin] < 0x9F) & (low[latin] != 0x97)]
    low[latin] += 32
    starts, ends, first = words(low, at, ~_LETTER)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size, windows = ends - starts, padded(low)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    hashes, owners = [span_hash(windows, starts, size)], [owner]
    for n in _PREFIXES:
        longer = size > n
        hashes.append(span_hash(windows, starts[longer], np.full(int(longer.sum()), n), seed=n))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def counted(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term, count), ordered by text; with ``known`` (sorted hashes), places in it instead of hashes."""
    term, owner = terms(texts)
    if known is not None:
        at = np.searchsorted(known, term)
        at[at == len(known)] = 0
        good = known[at] == term if len(known) else np.zeros(len(term), bool)
        key, n = np.unique(owner[good] * max(1, len(known)) + at[good], return_counts=True)
        return key // max(1, len(known)), key % max(1, len(known)), n
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])])) if len(term) else np.zeros(0, np.int64)
    return owner[new], term[new], np.diff(np.append(new, len(term)))


class Index:
    """Block-max inverted index of labelled examples.

    Similar examples are put side by side and cut into blocks of ``BLOCK``.  Rare terms have postings; the ``DENSE`` most
    frequent terms, whose postings hold most examples, are kept as one matrix a block with their largest weight in it.  A
    block's bound is its largest sum over rare terms plus the product with its largest weights; blocks whose bound is under a
    text's k-th best cosine are not looked at, so the k nearest are exact.
    """

    def __init__(self, known: np.ndarray, idf: np.ndarray, owner: np.ndarray, place: np.ndarray, count: np.ndarray, ids: np.ndarray, toxic: np.ndarray, prior: tuple[float, float]) -> None:
        self.known, self.idf, self.ids, self.toxic = known, idf, ids, toxic
        weight = self.weigh(owner, place, count, len(ids))
        many = np.bincount(place, minlength=len(known))
        self.row = np.full(len(known), -1, np.int32)
        often = np.argsort(-many, kind="stable")[:DENSE]
        self.row[often] = np.arange(len(often))
        dense = self.row[place] >= 0
        whole = np.zeros((len(ids), len(often)))
        whole[owner[dense], self.row[place[dense]]] = weight[dense]
        #: Example in each slot, by block; slots beyond the last example have no terms.
        self.slots = _side_by_side(whole)
        self.blocks = -(-len(ids) // BLOCK)
        self.size = self.blocks * BLOCK
        self.dense = np.zeros((self.size, len(often)))
        self.dense[: len(ids)] = whole[self.slots]
        self.dense = self.dense.reshape(self.blocks, BLOCK, -1)
        self.top = self.dense.max(axis=1).T.copy()
        slot = np.empty(len(ids), np.int64)
        slot[self.slots] = np.arange(len(ids))
        many[often] = 0
        self.begin = np.concatenate([[0], np.cumsum(many)])
        order = np.argsort(place[~dense], kind="stable")
        self.example, self.weight = slot[owner[~dense]][order].astype(np.int32), weight[~dense][order]
        self.looked = np.zeros(2, np.int64)  # blocks looked at, and all
        self._calibrate(owner, place, weight, prior)

    def weigh(self, owner: np.ndarray, place: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """TF-IDF weights, each text's vector of length 1."""
        raw = (1.0 + np.log(count)) * self.idf[place]
        return raw / np.sqrt(np.maximum(np.bincount(owner, raw**2, n), 1e-300))[owner]

    def cosines(self, owner: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int, k: int, but: np.ndarray | None) -> np.ndarray:
        """Cosines of ``n`` texts with the examples by slot, -1 where a block's bound shows that none is among the k largest.

        Rounded, so that equal examples tie.
        """
        row, size = self.row[place], self.begin[place + 1] - self.begin[place]
        dense = row >= 0
        text = np.zeros((n, self.dense.shape[2]))
        text[owner[dense], row[dense]] = weight[dense]
        posting = np.repeat(self.begin[place] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(owner * self.size, size) + self.example[posting]
        rare = np.bincount(cell, self.weight[posting] * np.repeat(weight, size), n * self.size).reshape(n, self.blocks, BLOCK)
        bound = text @ self.top + rare.max(axis=2)
        out = np.full((n, self.blocks, BLOCK), -1.0)
        slot = None if but is None else np.argsort(self.slots)[but]

        def look(want: np.ndarray) -> None:
            for block in np.flatnonzero(want.any(axis=0)):
                rows = np.flatnonzero(want[:, block])
                out[rows, block] = np.round(text[rows] @ self.dense[block].T + rare[rows, block], 12)
            if slot is not None:
                out.reshape(n, -1)[np.arange(n), slot] = -1.0

        first = bound >= np.partition(bound, max(0, self.blocks - WAVE), axis=1)[:, max(0, self.blocks - WAVE), None]
        look(first)
        last = max(0, self.size - k)
        least = np.maximum(0.0, np.partition(out.reshape(n, -1), last, axis=1)[:, last])
        rest = ~first & (bound > 0) & (bound >= least[:, None] - 1e-9)
        look(rest)
        self.looked += int(first.sum() + rest.sum()), first.size
        return out.reshape(n, -1)

    def nearest_of(self, owner: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int, k: int = NEIGHBOURS, but: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` texts (``owner`` ascending), the k examples of largest cosine above 0, without ``but``; smaller numbers first among equals."""
        for low in range(0, n, TEXTS):
            rows = min(TEXTS, n - low)
            mine = slice(*np.searchsorted(owner, (low, low + rows)))
            cosine = self.cosines(owner[mine] - low, place[mine], weight[mine], rows, k, None if but is None else but[low : low + rows])
            last = max(0, self.size - k)
            least = np.partition(cosine, last, axis=1)[:, last]
            for one, limit in zip(cosine, least):
                hit = np.flatnonzero((one >= limit) & (one > 0))
                found = self.slots[hit]
                order = np.lexsort((found, -one[hit]))[:k]
                yield found[order], one[hit[order]]

    def nearest(self, place: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text."""
        return next(self.nearest_of(np.zeros(len(place), np.int64), place, weight, 1, k))

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic examples by weights that fall with distance; far ones leave the vote near 0."""
        near = np.minimum(1.0, cosine)
        weight = near**2 / (1.0 - near + 0.05)
        return float((weight * self.toxic[best]).sum() / (weight.sum() + 0.05))

    def _calibrate(self, owner: np.ndarray, place: np.ndarray, weight: np.ndarray, prior: tuple[float, float]) -> None:
        ends = np.searchsorted(owner, np.arange(len(self.ids) + 1))
        votes, has = np.zeros(len(self.ids)), np.diff(ends) > 0
        for k, found in enumerate(self.nearest_of(owner, place, weight, len(self.ids), but=np.arange(len(self.ids)))):
            votes[k] = self.vote(*found)
        mass = np.where(self.toxic == 1, prior[1], prior[0])
        none = mass[~has].sum()
        self.alone = float((mass * self.toxic)[~has].sum() / none) if none else 0.0
        order = np.argsort(votes[has], kind="stable")
        pools: list[list[float]] = []  # value, mass, lowest and highest vote
        for v, y, m in zip(votes[has][order], self.toxic[has][order], mass[has][order]):
            pools.append([float(y), float(m), float(v), float(v)])
            while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
                b, a = pools.pop(), pools.pop()
                pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
        points = [(p[j], p[0]) for p in pools for j in (2, 3)] or [(0.0, 0.0)]
        self.curve = np.array(points).T

    def score(self, best: np.ndarray, cosine: np.ndarray) -> float:
        return float(np.interp(self.vote(best, cosine), *self.curve)) if len(best) else self.alone


def _side_by_side(rows: np.ndarray) -> np.ndarray:
    """An order of the vectors in which similar ones are neighbours: spherical k-means from evenly spaced ones."""
    centre = rows[:: max(1, len(rows) // max(1, len(rows) // BLOCK))]
    for _ in range(6):
        near = (rows @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, rows)
        centre = total / np.maximum(1e-12, np.linalg.norm(total, axis=1, keepdims=True))
    # Clusters that are alike follow each other too.
    rank = np.argsort(centre @ centre.sum(axis=0), kind="stable")
    place = np.empty(len(centre), np.int64)
    place[rank] = np.arange(len(centre))
    return np.argsort(place[near], kind="stable")


def _terms_of_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        owner, term, count = counted(column(part, "text"))
        ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
        packed = [term[a:b].tobytes() + count[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "toxic"), pa.array(packed, pa.binary())], ["doc_id", "toxic", "terms"])


def _frequencies(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(known) + 1, np.int64), 0
        for part in chunks(batches):
            _, place, _ = counted(column(part, "text"), known)
            total[: len(known)] += np.bincount(place, minlength=len(known))
            rows += part.num_rows
        total[-1] = rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Index | None:
    """Index of a bounded sample of examples: about ``positives`` toxic and ``negatives`` other ones."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    marks = marks.where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    cut_off = F.when(F.col("toxic") == 1, positives / shares[1]).otherwise(negatives / shares[0])
    # The sample is bounded by its parameters, so it may be broadcast.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.where(draw < cut_off)), "doc_id")
    rows = sorted((r["doc_id"], r["toxic"], bytes(r["terms"])) for r in sample.mapInArrow(_terms_of_examples, "doc_id long, toxic int, terms binary").collect())
    ids, toxic = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    size = [len(r[2]) // 12 for r in rows]
    owner = np.repeat(np.arange(len(rows)), size)
    term = np.concatenate([np.frombuffer(r[2], "<u8", n) for r, n in zip(rows, size)]) if rows else np.zeros(0, np.uint64)
    count = np.concatenate([np.frombuffer(r[2], "<u4", n, 8 * n) for r, n in zip(rows, size)]) if rows else np.zeros(0, np.uint32)
    if not 0 < toxic.sum() < len(toxic):
        return None
    known = np.unique(term)
    idf, _ = inverse_frequencies(docs, known)
    at = np.searchsorted(known, term)
    at[at == len(known)] = 0
    good = known[at] == term if len(known) else np.zeros(len(term), bool)
    # Counts of the examples' terms are kept in order of example, then place.
    order = np.lexsort((at[good], owner[good]))
    prior = (shares[0] / max(1, (toxic == 0).sum()), shares[1] / max(1, toxic.sum()))
    return Index(known, idf, owner[good][order], at[good][order], count[good][order].astype(np.int64), ids, toxic, prior)


def inverse_frequencies(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """Inverse document frequencies of the known terms over all documents, 0 for a term of every document; and their number."""
    sums = docs.select("text").mapInArrow(_frequencies(known), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    df = np.zeros(len(known) + 1)
    got = sums.toArrow()  # at most one row a known term
    df[got["place"].to_numpy()] = got["n"].to_numpy()
    return np.log((1.0 + df[-1]) / (1.0 + df[:-1])), int(df[-1])


def _score(index: Index | None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            n = part.num_rows
            score, evidence, cosines = [0.0 if index is None else index.alone] * n, [[] for _ in range(n)], [[] for _ in range(n)]
            if index is not None and len(index.known):
                owner, place, count = counted(column(part, "text"), index.known)
                weight = index.weigh(owner, place, count, n)
                for k, (best, cosine) in enumerate(index.nearest_of(owner, place, weight, n)):
                    score[k], evidence[k], cosines[k] = index.score(best, cosine), index.ids[best], cosine
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), column(part, "held_out"), *(pa.array(v, schema.field(j + 2).type) for j, v in enumerate((score, evidence, cosines)))], schema=schema
            )

    return run


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """Per row: doc_id, held_out, score, and its evidence: the ids of the nearest examples and their cosines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return rows.mapInArrow(_score(index), "doc_id long, held_out boolean, score double, evidence array<long>, cosines array<double>")


def op4_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
