"""Ranked lexical search (operator 11): Fagin's threshold algorithm over shards of the corpus.

A forward index holds, for every document, its number of terms and the occurrences of each term of the
vocabulary.  Its rows are dealt to tasks and taken in shards of a bounded number of postings.  A shard
inverts its rows once: a list per term, sorted by impact.  Each query then reads its lists in turn, to the
same depth in all; documents met for the first time are looked up in the forward index, which gives their
whole score; the sum of the impacts at the depth is the threshold, and the query is done when that falls
strictly below its k-th score, or the lists end.  Depths double, so reading in turn is a few array operations.
Shards are exact for their own documents, so the best k of all are among the best k of each; these few rows are merged.

Weights need counts over all documents (N, L and document frequencies), which are read from the whole forward
index first.  Queries come in blocks of at most ``BLOCK`` items, whose terms are the vocabulary that tasks get: this
bounds what is sent, whatever the number of items or documents is.

Nulls and edge cases: a null text has no term; an item without terms that occur has no result; ranks are by score, then
doc_id with null last; rows are documents, so repeated rows and ids rank one by one (equal rows share a score);
each row of the items is a query of its own; no documents or no items give no rows; other columns are ignored; a text's
arrays take tens of bytes a byte of it, and a document's postings are at most the block's vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm import textbytes
from helixframe.llm.common import cut, table

K, BLOCK = 10, 2_000
#: A shard ends with the document that brings it to so many postings or rows.
POSTINGS, ROWS = 1 << 20, 1 << 15
#: Depth of the first reading of a query's lists.
DEPTH = 64
#: Fixed values of the score: tf * 1000 / (tf + 0.008 m) in whole numbers, a quarter of a document's weight is free of its length.
GAIN, SCALE, SLOPE, SHARE = 1_000_000_000, 1_000, 8, 75

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _first, _last in (b"09", b"AZ", b"az"):
    _BREAK[_first : _last + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every term of the texts, and where each text's terms begin."""
    data = _LOWER[data]
    starts, ends, first = textbytes.words(data, at, _BREAK)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), first
    windows = textbytes.padded(data)
    return textbytes.span_hash(windows, starts, ends - starts), textbytes.span_hash(windows, starts, ends - starts, 11), first


def vocabulary(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Both hashes of all terms of the texts, in order, and the places of each text's terms there, with repeats."""
    data, at = textbytes.utf8(pa.array(texts, pa.string()))
    one, two, first = terms(data, at)
    known, where = np.unique(one, return_index=True)
    place = np.searchsorted(known, one)
    return known, two[where], [place[a:b] for a, b in zip(first[:-1], first[1:])]


FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def forward_index(docs: DataFrame, known: np.ndarray, check: np.ndarray) -> DataFrame:
    """doc_id, n and the postings (terms, tfs) of each document with a term; terms are places in the vocabulary.

    A term is known by 128 bits of hash.
    """
    sent = docs.sparkSession.sparkContext.broadcast((known, check))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, check = sent.value
        for batch in textbytes.chunks(batches):
            one, two, first = terms(*textbytes.utf8(textbytes.column(batch, "text")))
            n = np.diff(first)
            place = np.minimum(np.searchsorted(known, one), len(known) - 1)
            held = np.flatnonzero((known[place] == one) & (check[place] == two))
            row = np.searchsorted(first, held, "right") - 1
            key, tf = np.unique(row * len(known) + place[held], return_counts=True)
            ends = np.searchsorted(key // len(known), np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % len(known), tf)]
            whole = pa.RecordBatch.from_arrays([textbytes.column(batch, "doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), *lists], schema=schema)
            yield whole.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(index, FORWARD)


def weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    """Whole-number weights of the terms, in the vocabulary's order."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each posting adds to a score, in 64-bit whole numbers."""
    top = SHARE * int(n.max(initial=0)) * n_docs
    wide = n.astype(object) if top >= 1 << 63 else n
    m = 100 - SHARE + np.asarray((SHARE * wide * n_docs) // n_terms, np.int64)
    return weight * ((GAIN * tf) // (SCALE * tf + SLOPE * m))


class Shard:
    """Postings of some documents: by document, and by term in order of falling impact."""

    def __init__(self, first: np.ndarray, term: np.ndarray, impact: np.ndarray, n_known: int):
        self.first, self.term, self.impact = first, term, impact
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((-impact, term))
        self.list_row, self.list_impact = row[order], impact[order]
        self.list_at = np.searchsorted(term[order], np.arange(n_known + 1))

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Random lookups: whole scores of the rows (each with postings) by the forward index."""
        size = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.first[rows] - (ends - size), size)
        return np.add.reduceat(self.impact[at] * wanted[self.term[at]], ends - size)

    def best(self, query: np.ndarray, repeats: np.ndarray, wanted: np.ndarray, k: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of all documents that may be among the best k, ties with the k-th included, and the depth reached."""
        begin, end = self.list_at[query], self.list_at[query + 1]
        seen = np.zeros(len(self.first) - 1, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        read = 0
        while True:
            stop = np.minimum(begin + depth, end)
            new = np.concatenate([self.list_row[a:b] for a, b in zip(np.minimum(begin + read, end), stop)] or [rows])
            new = np.unique(new[~seen[new]])
            if len(new):
                seen[new] = True
                got = self.scores(new, wanted)
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, got])
                if len(scores) > k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[scores >= kth], scores[scores >= kth]
            open_ = stop < end
            # The next entry of a list is at most its last one read.
            threshold = int((self.list_impact[stop[open_] - 1] * repeats[open_]).sum())
            if not open_.any() or (len(scores) >= k and threshold < scores.min()):
                return rows, scores, depth
            read, depth = depth, depth * 2


def _shards(batches: Iterator[pa.RecordBatch], postings: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in tables of about ``postings`` postings and at most ``most`` rows."""
    kept, held, rows = [], 0, 0
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column(2).value_lengths().to_numpy(zero_copy_only=False), np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(int(np.searchsorted(ends, before + postings - held)) + 1, start + most - rows, batch.num_rows)
            kept.append(batch.slice(start, stop - start))
            held, rows, start = held + int(ends[stop - 1] - before), rows + stop - start, stop
            if held >= postings or rows >= most:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, held, rows = [], 0, 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def search_index(index: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int = K, postings: int = POSTINGS, most: int = ROWS) -> DataFrame:
    """Best ``k`` documents of each query, by its number: query, doc_id, score."""
    plain = [np.unique(q, return_counts=True) for q in queries]
    sent = index.sparkSession.sparkContext.broadcast((plain, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, weight = sent.value
        best: dict[int, list[tuple[int, float, int | None]]] = {}
        for shard in _shards(batches, postings, most):
            first = shard.column(2).chunk(0).offsets.to_numpy().astype(np.int64)
            term, tf = (shard.column(c).chunk(0).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            n = np.repeat(shard.column(1).to_numpy(), np.diff(first))
            ids = shard.column(0)
            here = Shard(first - first[0], term, impacts(tf, n, weight[term], n_docs, n_terms), len(weight))
            wanted = np.zeros(len(weight), np.int64)
            for number, (query, repeats) in enumerate(plain):
                wanted[query] = repeats
                rows, scores, _ = here.best(query, repeats, wanted, k)
                wanted[query] = 0
                found = [(-s, math.inf if d is None else d, d) for s, d in zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist()) if s > 0]
                best[number] = sorted(best.get(number, []) + found, key=lambda x: x[:2])[:k]
            del here, shard, term, tf, n
            textbytes.relieve()
        out = [(number, d, -s) for number, hits in best.items() for s, _, d in hits]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    each = index.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "query int, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return each.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """The ``k`` best documents (rank, doc_id, score) of each row of ``items(item_id, text)``."""
    spark = docs.sparkSession
    n_items = items.count()
    blocks = max(1, -(-n_items // block))
    numbered = cut(items.select("item_id", "text").withColumn("_at", F.monotonically_increasing_id()), "search-items")
    if blocks == 1:
        parts = [numbered]
    else:
        bounds = numbered.approxQuantile("_at", [x / blocks for x in range(1, blocks)], 0.0)
        edges = [-1, *map(int, bounds), 1 << 62]
        parts = [numbered.where((F.col("_at") > a) & (F.col("_at") <= b)) for a, b in zip(edges[:-1], edges[1:])]
    found = None
    for part in parts:
        rows = part.orderBy("_at").collect()  # at most about ``block`` items
        known, check, queries = vocabulary([r["text"] for r in rows])
        if not len(known):
            continue
        index = cut(forward_index(docs, known, check), "forward-index")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        frequencies = np.zeros(len(known), np.int64)
        for term, df in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            frequencies[term] = df
        hits = search_index(index, queries, weights(n_docs, frequencies), n_docs, n_terms, k, postings)
        items_of = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], part.select(F.lit(0).alias("query"), "item_id").schema)
        hits = cut(hits.join(items_of, "query").select("item_id", "rank", "doc_id", "score"), "search-hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = numbered.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return found


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOW.format('text')}, '{_TERM}') as all_terms from documents where text is not null
), s as (
  select r, doc_id, all_terms, len(all_terms) as n from d where len(all_terms) > 0
), c as (
  select count(*)::bigint as big_n, sum(n)::bigint as big_l from s
), i as (
  select row_number() over () as q, item_id, unnest(regexp_extract_all({_LOW.format('text')}, '{_TERM}')) as term from benchmark
), q as (
  select q, item_id, term, count(*) as repeats from i group by all
), p as (
  select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(all_terms) as term from s) where term in (select term from q) group by all
), f as (
  select term, count(*) as df from p group by term
), w as (
  select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint as w from f, c
), x as (
  select q.q, q.item_id, p.r, p.doc_id,
         sum(q.repeats * (w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + ((75 * p.n * c.big_n) // c.big_l))))))::bigint as score
  from q join p using (term) join w using (term), c group by all
), k as (
  select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from x where score > 0
)
select item_id, rank::int as rank, doc_id, score from k where rank <= {K}
"""
