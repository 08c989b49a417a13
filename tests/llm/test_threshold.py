import math
import re
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import threshold

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n string, terms int, score double"


def terms(text):
    return [t.translate(UP) for t in TERM.findall(text or "")]


def brute(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 25 + (75 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scored += [(-s, math.inf if i is None else i, i)] if s > 0 else []
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)] + ["Été", "straße", "x_y", "naïve-word", "ſ", "K"]
    text = lambda n: " ".join(np.array(words)[np.minimum(rng.zipf(1.3, n) - 1, len(words) - 1)])
    rows = [(k, text(int(rng.integers(1, 60)))) for k in range(400)]
    rows += [(1000 + k, "w5 w6 w200 w7") for k in range(60)] + [(7, "w5 w6")] * 4 + [(None, "w5 w6 w250"), (None, None), (2000, ""), (2001, "?! --")]
    rows += [(2002, text(30000)), (2003, "É\x00Tag W9W9 été")]
    items = [(k, text(int(rng.integers(1, 50)))) for k in range(30)] + [(90, None), (91, ""), (92, "never seen"), (93, "W5 w5 w5 ÉTÉ"), (94, "w200 w7"), (94, "w200 w7"), (None, "naïve straße")]
    return rows, items


@pytest.mark.parametrize("block, postings", [(2000, 1 << 20), (5, 300)])
def test_against_plain_python(spark, block, postings):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "n", 0, 0.5) for i, t in rows], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, query string")
    got = threshold.search(docs, asked, 10, block, postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, items, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert threshold.search(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert threshold.search(docs, items.limit(0)).collect() == []
    assert threshold.search(docs, spark.createDataFrame([(1, "!")], "item_id long, text string")).collect() == []


def shard_of(rng, n_docs, n_terms, hot):
    """A random shard; document 0 is far ahead in the terms ``hot``."""
    dense = np.where(rng.random((n_docs, n_terms)) < 0.5, rng.integers(1, 1000, (n_docs, n_terms)), 0)
    dense[0, hot] = 1_000_000
    dense[:, 0] = np.maximum(dense[:, 0], 1)  # no row is empty
    row, term = np.nonzero(dense)
    return dense, threshold.Shard(np.searchsorted(row, np.arange(n_docs + 1)), term, dense[row, term].astype(np.int64), n_terms)


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    dense, shard = shard_of(rng, 5000, 6, [1, 2])
    wanted = np.zeros(6, np.int64)
    wanted[[1, 2]] = 1
    rows, scores, depth = shard.best(np.array([1, 2]), np.array([1, 1]), wanted, 1)
    assert (rows.tolist(), scores.tolist(), depth) == ([0], [2_000_000], threshold.DEPTH)


@pytest.mark.parametrize("k", [1, 3, 10, 10_000])
def test_a_shard_is_exact_with_ties(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        dense, shard = shard_of(rng, 300, 5, [])
        dense_small = dense // 300  # many ties
        row, term = np.nonzero(dense_small + (np.arange(5) == 0))
        shard = threshold.Shard(np.searchsorted(row, np.arange(301)), term, dense_small[row, term].astype(np.int64), 5)
        query, repeats = np.array([1, 2, 4]), np.array([2, 1, 1])
        wanted = np.array([0, 2, 1, 0, 1])
        rows, scores, _ = shard.best(query, repeats, wanted, k, 2)
        whole = dense_small @ wanted
        kth = np.sort(whole)[::-1][min(k, 300) - 1]
        want = {(r, s) for r, s in enumerate(whole.tolist()) if s >= max(kth, 1)}
        assert {(r, s) for r, s in zip(rows.tolist(), scores.tolist()) if s > 0} == want


def test_wide_products_do_not_overflow():
    n = np.array([10**9, 5], np.int64)
    got = threshold.impacts(np.array([3, 3]), n, np.array([7, 7]), 10**11, 10**13)
    assert got.tolist() == [7 * ((10**9 * 3) // (3000 + 8 * (25 + 75 * int(x) * 10**11 // 10**13))) for x in n]
