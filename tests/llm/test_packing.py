import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing
from helixframe.llm.wordbpe import WordBpe

ODD = ["", "a", "It's don't I'LL we've'", "ÀÉÎ ŒÆ ß Σς İi ½ ² ¿¡ «x» 12345 x́ é", "日本語 text", "a\x00b\x1cz", "x" * 200, "%%% !!! ###", "\n\t ", "<|endoftext|> x", "é" * 60, None, "a1b2c3", "''' '' 's"]


@pytest.fixture(scope="module")
def encoder():
    return WordBpe(packing.vocabulary_path())


def test_encoder_equals_library(encoder):
    rng = random.Random(1)
    alphabet = "abcXYZ éÉñ ß'!?. 12\n\t½́日 İΣΩω€"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["".join(rng.choice("abcdefghinorst éü,.") for _ in range(400)) for _ in range(50)]
    ids, at = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.library.encode(text or "", add_special_tokens=False).ids, text


def test_added_tokens_have_their_ids(encoder):
    fresh = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["the end <|endoftext|> next <|startoftext|>", "<|endoftext|><|endoftext|>", "plain", "<|", "endoftext|>", "x<|EndOfText|>y", "a<|startoftext|>b", "", "<|endoftext", "|> plain", None]
    ids, at = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == fresh.encode(text or "", add_special_tokens=False).ids, text
    assert ids[: at[1]].tolist() == [518, 806, 49407, 1131, 49406]


def valid(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    mean = (6.5, 3.0, 8.0, 6.0, 7.5, 5.0)[seed]
    lengths = np.clip(rng.lognormal(mean, 1.0, 3000).astype(int), 1, 4096)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan(counts)
    assert plan.used == counts
    rows = [{"sequence_id": s + j // each, "offset": place + j % each * length, "length": length} for length, low, high, s, each, place in plan.rows for j in range(high - low)]
    assert valid(rows, 4096) == plan.sequences
    halves = sum(n for k, n in counts.items() if k > 2048)
    assert plan.sequences <= 1.02 * max(halves, sum(k * n for k, n in counts.items()) / 4096) + 3
    assert plan.sequences <= packing.plan(counts, groups=160).sequences


def fewest(lengths, capacity):
    """The least number of sequences over all partitions of ``lengths``."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_plans_of_few_pieces_against_all_partitions():
    rng, more = random.Random(8), 0
    for _ in range(400):
        lengths = [rng.choice((rng.randint(1, 64), rng.randint(9, 40), rng.randint(1, 8))) for _ in range(rng.randint(1, 8))]
        counts = {k: lengths.count(k) for k in set(lengths)}
        plan = packing.plan(counts, capacity=64)
        rows = [{"sequence_id": s + j // each, "offset": place + j % each * length, "length": length} for length, low, high, s, each, place in plan.rows for j in range(high - low)]
        assert plan.used == counts and valid(rows, 64) == plan.sequences
        least = fewest(lengths, 64)
        assert least <= plan.sequences <= least + 1, lengths
        more += plan.sequences - least
    assert more <= 20, more


def test_documents(spark, encoder):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "gamma9", "é!"]) for _ in range(rng.randint(1, 900))) for _ in range(120)] + ["long " * 9000, "same", "same"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id", "x"), (5, "again", "x"), (5, "again", "x")], "doc_id long, text string, length string").repartition(5)
    rows = [r.asDict() for r in packing.pack(docs).collect()]
    valid(rows, packing.CAPACITY)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(texts):
        if k == 5:
            continue
        ids = [*encoder.library.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[k], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert len(by[None]) == 1 and len(by[5]) == 3
    assert packing.pack(docs.limit(0)).count() == 0
