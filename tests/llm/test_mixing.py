import re
from collections import defaultdict

import pytest

from helixframe.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], SCHEMA)


def fill(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), list(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 3 * sizes[s]]
        if not full:
            for s in open_:
                target[s] = weight[s] * level
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("fan", [2, 8, 1024])
def test_targets_and_taken(spark, fan):
    rows = []
    for k in range(400):
        source = ("b", "a", None, "é", "z")[0 if k % 3 else k % 5]
        rows.append((k, " ".join(["word"] * (k % 17 + 1)) + " \x0b x", source))
    rows += [(900, None, "a"), (901, "", "b"), (902, "w " * 3000, "z"), (903, "same text", "a"), (903, "same text", "a"), (904, " \t\n", "tiny")]
    got = mixing.mix(docs_of(spark, rows), fan=fan).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(3), fan=fan).collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for r in got)


def test_edges(spark):
    assert mixing.mix(docs_of(spark, []), fan=4).count() == 0
    rows = mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a"), (None, "x", "b")])).collect()
    assert {(r.doc_id, r.size, r.taken) for r in rows} == {(1, 0, 0), (2, 0, 0), (None, 1, 1)}


def test_stage_keeps_columns_and_copies(spark):
    rows = [(k, "w " * 10, "a" if k < 90 else "b") for k in range(100)] + [(200, None, "b")]
    docs = docs_of(spark, rows)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for k in range(100):
        assert counts[k] == int(taken[k].taken / taken[k].size + 0.5)
    assert counts[200] == 1


def test_stage_with_clashing_columns(spark):
    names = "target left taken epochs mix_size source_size c1 c2 mix_source mix_row mix_copies mix_copy s rest upto nth a.b mix_draw mix_b1 mix_b2".split()
    rows = [(k, "w " * 10, "a" if k < 30 else "b", *[k] * len(names)) for k in range(40)] + [(None, None, None, *[None] * len(names)), (1, "w " * 10, "a", *[1] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert all(set(r[3:]) == {r.doc_id} for r in out.collect())


def test_stage_of_an_empty_table(spark):
    docs = docs_of(spark, [])
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 0


def test_rows_without_ids_draw_apart(spark):
    """Of rows whose id is null or the same, a share is taken like of all others."""
    rows = [(None if k % 2 else 7, f"text number {k} of many", "a") for k in range(400)] + [(1000 + k, "w " * 30, "b") for k in range(100)]
    out = mixing.take(*(lambda r: (r, mixing.plan(r, (2, 5)), ["doc_id", "mix_size"]))(mixing.cut(mixing.sized(docs_of(spark, rows), 64, ["doc_id", "source"]), "mix"))).collect()
    for group in ([r for r in out if r.doc_id is None], [r for r in out if r.doc_id == 7]):
        whole = sum(r.taken % r.mix_size == 0 and r.taken > 0 for r in group)
        assert 0.25 * len(group) < whole < 0.75 * len(group)
