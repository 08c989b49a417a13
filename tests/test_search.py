"""Search strategies, the index's seek and the search up to a limit."""

import json
import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.enzymes import enzyme
from helixframe.operators import search, seek
from helixframe.sources import index as target_index

NGG, CPF1 = enzyme("spcas9ngg"), enzyme("cpf1")


def target_frame(spark, texts, e=NGG, counts=None):
    rows = [(b, counts[b] if counts else 1 + k % 3) for k, b in enumerate(texts)]
    return spark.createDataFrame(rows, "bases string, cnt int").withColumn("enc", dna.encode(e.key(F.col("bases"))))


def guide_frame(frame):
    return frame.select(dna.encode(F.col("bases")).alias("guide_id"), "bases", "enc")


def texts_of(n, seed, e=NGG):
    rng = random.Random(seed)
    body = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    return sorted({"TTT" + body(21) if e.five_prime else body(21) + "GG" for _ in range(n)})


def changed(text, places, rng, first=0):
    out = list(text)
    for p in places:
        out[first + p] = rng.choice([c for c in "ACGT" if c != out[first + p]])
    return "".join(out)


def rows_read(frame):
    """Rows that the scan gave, after files, row groups and pages were skipped."""
    frame.collect()
    leaves, out = frame._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        out += leaves.apply(k).metrics().apply("numOutputRows").value()
    return out


@pytest.mark.parametrize("name", ["spcas9ngg", "cpf1", "spcas9ngg19"])
@pytest.mark.parametrize("most", [0, 1, 3, 4, 5])
def test_seek_equals_brute_force(spark, tmp_path, name, most):
    e, rng = enzyme(name), random.Random(most)
    texts = texts_of(300, 1, e)
    texts = sorted({t[: e.length] for t in texts} if e.length < 23 else set(texts))
    first = e.compared[0] - 1
    near = [changed(t, rng.sample(range(e.guide), rng.randint(0, 6)), rng, first) for t in texts[:60] for _ in range(4)]
    every = sorted({*texts, *near})
    found = target_frame(spark, every, e)
    target_index.write_index(found, e, str(tmp_path / "index"))
    index = target_index.read_index(spark, str(tmp_path / "index"))
    guides = guide_frame(found.where(F.col("bases").isin(texts[:60])))
    part = lambda b: b[first : first + e.guide]
    want = {(g, t, n) for g in texts[:60] for t in every for n in [sum(a != b for a, b in zip(part(g), part(t)))] if n <= most}
    for strategy in ("seek", "auto", "scan"):
        got = seek.search_index(guides, index, most, strategy)
        assert got.columns == ["guide_id", "guide", "bases", "cnt", "mm"]
        got = got.collect()
        assert {(r.guide, r.bases, r.mm) for r in got} == want and len(got) == len(want)


def test_ten_guides_read_a_small_part_of_the_index(spark, tmp_path):
    """Two million targets, ten guides, 4 mismatches: pages that no guide reaches are skipped, as the scan's row count shows."""
    digits = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 13), 16, 10).cast("bigint")
    found = spark.range(2_000_000).select(F.concat(dna.decode(digits % 4**21, 21), F.lit("GG")).alias("bases"), F.lit(1).alias("cnt"))
    found = found.withColumn("enc", dna.encode(NGG.key(F.col("bases"))))
    target_index.write_index(found, NGG, str(tmp_path / "index"))
    index = target_index.read_index(spark, str(tmp_path / "index"))
    guides = guide_frame(found.limit(10)).cache()
    reached = seek.reach(index, guides, 4)
    read = [rows_read(p.select("bases")) for p in reached.parts]
    assert sum(reached.rows) < 0.6 * index.n_targets and reached.cost > index.n_targets  # a pass is cheaper for tables of this size
    assert all(n <= r < 0.5 * index.n_targets for r, n in zip(read, reached.rows))
    got = {(r.guide, r.bases) for r in seek.search_index(guides, index, 4, "seek").collect()}
    assert got == {(r.guide, r.bases) for r in search.discover(guides, found, NGG, 4, "scan").collect()}


def test_ranges_cover_what_is_wanted():
    rng = np.random.default_rng(2)
    for most in (1, 3, 50):
        bins = [(int(b), int(rng.integers(1, 9))) for b in rng.choice(400, 150, replace=False)]
        wanted = rng.choice(400, 60, replace=False)
        spans, n = seek.ranges_of(wanted, bins, most)
        inside = lambda b: any(x <= b < y for x, y in spans)
        assert len(spans) <= most and all(inside(b) for b, _ in bins if b in wanted)
        assert n == sum(size for b, size in bins if inside(b))
    assert seek.ranges_of(np.array([3]), [(4, 1)]) == ([], 0) and seek.ranges_of(np.array([3]), []) == ([], 0)


def test_a_damaged_index_is_refused(spark, tmp_path):
    path = tmp_path / "index"
    target_index.write_index(target_frame(spark, texts_of(50, 2)), NGG, str(path))
    assert target_index.read_index(spark, str(path)).n_targets == 50
    spark.read.parquet(str(path / "half=1")).limit(49).write.parquet(str(tmp_path / "less"))
    spark.read.parquet(str(tmp_path / "less")).write.mode("overwrite").parquet(str(path / "half=1"))
    with pytest.raises(ValueError, match="damaged"):
        target_index.read_index(spark, str(path))
    about = json.loads(next((path / "about").glob("part*.json")).read_text())
    spark.createDataFrame([(1, about["enzyme"])], "version int, enzyme string").write.mode("overwrite").json(str(path / "about"))
    with pytest.raises(ValueError, match="version"):
        target_index.read_index(spark, str(path))


def test_the_cheapest_strategy_is_picked():
    assert search.pick(1, 10**8, NGG) == "scan"
    assert search.pick(2_000, 10**8, NGG) == "probe"
    assert search.pick(100_000, 10**8, NGG) == "halves"
    assert search.pick(2_000, 10**8, NGG, 6) in ("scan", "halves")  # over 7,000 keys a guide are not broadcast
    assert "probe" not in search.costs(2_000, 10**8, NGG, 6) and "scan" not in search.costs(2_001, 10**8, NGG)


def test_a_probe_does_not_move_targets(spark, tmp_path):
    target_frame(spark, texts_of(100, 3)).write.parquet(str(tmp_path / "targets"))
    found = spark.read.parquet(str(tmp_path / "targets"))
    plan = search.discover(guide_frame(found), found, NGG, 4, "probe")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    assert plan.count("Exchange hashpartitioning") == 1  # the guides, before their neighbours are listed


def cut_off(hits, e, limit):
    order = (lambda b: (b[4:11], b)) if e.five_prime else (lambda b: b)
    out = set()
    for g in {h[0] for h in hits}:
        mine, total = sorted((h for h in hits if h[0] == g), key=lambda h: order(h[1])), 0
        over = sum(h[2] for h in mine) >= limit
        for _, b, n in mine:
            if total < limit:
                out.add((g, b, n, over))
            total += n
    return out


@pytest.mark.parametrize("name", ["spcas9ngg", "cpf1"])
def test_search_up_to_a_limit_equals_the_cut_off_of_all_hits(spark, name):
    e, rng = enzyme(name), random.Random(6)
    first = e.compared[0] - 1
    texts = texts_of(40, 4, e)
    near = [changed(t, rng.sample(range(e.guide), rng.randint(0, 5)), rng, first) for t in texts[:20] for _ in range(40)]
    found = target_frame(spark, sorted({*texts, *near}), e).withColumn("positions", F.array("cnt")).cache()
    guides = guide_frame(found.where(F.col("bases").isin(texts[:20]))).cache()
    hits = [(r.guide, r.bases, r.cnt) for r in search.discover(guides, found, e, 4, "scan").collect()]
    for limit in (0, 1, 7, 60, 10**6):
        for at_first in (100, 1 << 16):
            got = search.discover_until(guides, found, e, 4, limit, first=at_first).collect()
            assert {(r.guide, r.bases, r.cnt, r.overflowed) for r in got} == (cut_off(hits, e, limit) if limit else set()), (limit, at_first)
            assert len({(r.guide, r.bases) for r in got}) == len(got) and all(r.positions == [r.cnt] for r in got)


def test_a_full_guide_is_searched_no_further(spark, monkeypatch):
    """A guide with 100,000 hits and a limit of 2,000: only hits before the limit are written, and later rounds do without the guide."""
    rng = random.Random(1)
    hot = "ACGT" * 5
    close = set()
    while len(close) < 20_000:
        close.add(changed(hot, rng.sample(range(20), rng.randint(1, 4)), rng) + "AGG")
    other = texts_of(20_000, 8)
    found = target_frame(spark, sorted(close | set(other)), NGG, dict.fromkeys(close | set(other), 5)).cache()
    guides = guide_frame(found.where(F.col("bases").isin([other[0], other[1]]))).unionByName(
        spark.createDataFrame([(1, hot + "TGG")], "guide_id long, bases string").withColumn("enc", dna.encode(NGG.key(F.col("bases"))))
    ).cache()
    asked, written, real, real_cut = [], [], search.discover, search.cut
    monkeypatch.setattr(search, "discover", lambda g, *a: asked.append(g.count()) or real(g, *a))
    monkeypatch.setattr(search, "cut", lambda df, label: [out := real_cut(df, label), label == "hits-round" and written.append(out.count())][0])
    got = search.discover_until(guides, found, NGG, 4, 2_000, "probe", first=1_000)
    assert asked[0] == 3 and asked[-1] == 2 and len(asked) >= 5
    assert sum(written) < 500
    of = [r for r in got.collect() if r.guide_id == 1]
    assert len(of) == 400 and all(r.overflowed for r in of)


def test_rounds_double():
    spans = search.rounds([(k, 10) for k in range(100)], 50)
    assert spans[0] == (0, 5) and spans[1] == (5, 10) and spans[2] == (10, 20) and spans[-1][1] == 4**search.LEAD
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert search.rounds([]) == [(0, 4**search.LEAD)]


def test_guides_have_all_bases_at_every_place(spark):
    from helixframe.plans import catalog

    found = catalog.ngg_targets(spark, "/root/testdata/sf0.001")
    at_end = catalog.some_guides(found).groupBy(F.substring("bases", 20, 1).alias("base")).count().collect()
    assert {r["base"] for r in at_end} == set("ACGT")


def test_places_follow_the_files(spark, tmp_path):
    texts = texts_of(500, 9)
    target_index.write_index(target_frame(spark, texts), NGG, str(tmp_path / "index"))
    index = target_index.read_index(spark, str(tmp_path / "index"))
    for half, key in ((0, lambda b: (b[:10], b)), (1, lambda b: (b[10:20], b))):
        got = sorted((r.place, r.bases) for r in index.places(half).collect())
        assert got == list(enumerate(sorted(texts, key=key), 1))
    target_index.write_index(target_frame(spark, texts).limit(0), NGG, str(tmp_path / "none"))
    assert target_index.read_index(spark, str(tmp_path / "none")).places(0).count() == 0


@pytest.mark.parametrize("name", ["spcas9ngg", "cpf1", "spcas9ngg19"])
@pytest.mark.parametrize("most", [1, 4])
def test_dealt_pairs_equal_brute_force(spark, name, most, monkeypatch):
    """Few pairs at once and four bases a deal; strings that share their compared bases are pairs of their own."""
    monkeypatch.setattr(search, "AT_ONCE", 7)
    e, rng = enzyme(name), random.Random(most)
    first = e.compared[0] - 1
    texts = sorted({t[: e.length] for t in texts_of(60, 5, e)})
    every = sorted({*texts, *(changed(t, rng.sample(range(e.guide), rng.randint(0, 6)), rng, first) for t in texts for _ in range(5)), *("A" + t[1:] if e.five_prime else t[:20] + "A" + t[21:] for t in texts)})
    found = target_frame(spark, every, e).repartition(3)
    guides = guide_frame(found.where(F.col("bases").isin(texts)))
    part = lambda b: b[first : first + e.guide]
    want = {(g, t, n) for g in texts for t in every for n in [sum(a != b for a, b in zip(part(g), part(t)))] if n <= most}
    for n_targets in (len(every), 1 << 28):
        got = search.discover(guides, found, e, most, "halves", n_targets).collect()
        assert {(r.guide, r.bases, r.mm) for r in got} == want and len(got) == len(want)


def test_guides_are_shuffled_without_their_neighbours(spark, tmp_path):
    """A guide has 872 neighbours within 2 mismatches of either half; 74 rows of it are dealt."""
    assert sum(search.neighbours(search.dealt(size, 10**6), 2) for size, _ in NGG.halves) == 74
    target_frame(spark, texts_of(2_000, 7)).write.parquet(str(tmp_path / "targets"))
    found = spark.read.parquet(str(tmp_path / "targets"))
    hits = search.discover(guide_frame(found), found, NGG, 4, "halves")
    hits.collect()
    nodes, most = [hits._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        nodes += children
    assert found.count() < most <= 74 * found.count()


@pytest.mark.parametrize("name,most", [("spcas9ngg", 4), ("cpf1", 3), ("spcas9ngg19", 2)])
def test_long_lists_are_compared_by_parts(name, most, monkeypatch):
    """Many targets with one half: fewer comparisons than pairs of a guide and a target of its list, and the same pairs."""
    e, rng = enzyme(name), np.random.default_rng(4)
    low = 4 ** e.halves[1][0]
    targets = np.unique(np.concatenate([rng.integers(0, low, 3_000), rng.integers(0, low, 3_000) * low, rng.integers(0, low, 500) * low + 5]))
    guides = targets[::7]
    x = targets[:, None] ^ guides
    apart = np.bitwise_count((x | x >> 1) & int("01" * e.guide, 2))
    want = sorted((int(targets[t]), int(guides[g]), int(apart[t, g])) for t, g in zip(*np.nonzero(apart <= most)))
    listed, compared = search._listed, []
    monkeypatch.setattr(search, "_listed", lambda first, n: compared.append(int(n.sum())) or listed(first, n))
    counts = []
    for long in (20, 1 << 40):
        monkeypatch.setattr(search, "LONG", long)
        monkeypatch.setattr(search, "GUIDES_AT_ONCE", 100)
        got = []
        for half, (size, shift) in enumerate(e.halves):
            first = targets >> (shift + 2 * (size - 3)) & 63
            for prefix in range(64):
                some = targets[first == prefix]
                at, guide, mm = search.meet(some, guides, e, most, half, prefix, 3)
                got += zip(some[at].tolist(), guide.tolist(), mm.tolist())
        assert sorted(got) == want
        counts.append(sum(compared))
        compared.clear()
    assert counts[0] < counts[1] / 2


def test_deals_leave_out_what_lies_behind_the_limit(spark):
    """10,000 hits of one guide, of which 10 are needed: no deal gives more than these, and the cut-off is the same."""
    rng = random.Random(3)
    texts = {"TTTA" + "A" * 10 + changed("C" * 10, rng.sample(range(10), 3), rng) for _ in range(20_000)}
    texts |= set(texts_of(2_500, 12, CPF1))
    found = target_frame(spark, sorted(texts), CPF1).cache()
    guides = guide_frame(found.where(F.xxhash64("bases") % 5 == 0)).unionByName(
        spark.createDataFrame([(1, "TTTG" + "A" * 10 + "C" * 10)], "guide_id long, bases string").withColumn("enc", dna.encode(CPF1.key(F.col("bases"))))
    ).cache()
    every = search.discover(guides, found, CPF1, 3, "halves", 10**6).cache()
    few = search.discover(guides, found, CPF1, 3, "halves", 10**6, 10).cache()
    assert every.where("guide_id = 1").count() > 1_000 and few.where("guide_id = 1").count() <= 10 * 20
    of = lambda frame: sorted((r.guide_id, r.bases, r.cnt, r.mm, r.overflowed) for r in frame.select("guide_id", "bases", "cnt", "mm", "overflowed").collect())
    want = of(search.overflow(every, CPF1, 10))
    assert of(search.overflow(few, CPF1, 10)) == want
    assert of(search.discover_until(guides, found, CPF1, 3, 10, "halves")) == want


def test_auto_leaves_no_hits_out(spark, monkeypatch):
    """A repeat's occurrences are no limit where none is given, however the join is picked."""
    monkeypatch.setattr(search, "pick", lambda *a: "halves")
    texts = sorted({"A" * 17 + x + y + z + "AGG" for x in "ACGT" for y in "ACGT" for z in "ACGT"})
    found = target_frame(spark, texts, NGG, dict.fromkeys(texts, 9_000))
    assert search.discover(guide_frame(found), found, NGG, 4, n_targets=100).count() == len(texts) ** 2


def test_many_guides_bring_their_names(spark, monkeypatch):
    """Pairs are not shuffled to be named, and guides that share their compared bases all have them."""
    found = target_frame(spark, sorted({t[:20] + n + "GG" for t in texts_of(200, 21) for n in "AC"})).cache()
    guides = guide_frame(found)
    rows = lambda: sorted(tuple(r) for r in search.discover(guides, found, NGG, 4, "halves").select("guide_id", "guide", "bases", "cnt", "mm").collect())
    want = rows()
    monkeypatch.setattr(search, "SENT_GUIDES", 10)
    assert rows() == want and len(want) >= 4 * 200
    plan = search.discover(guides, found, NGG, 4, "halves")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_pairs_of_a_deal_come_in_pieces():
    """7.8 million pairs of 4,096 guides, which were one table before."""
    some = np.arange(4**6, dtype=np.int64)
    sizes = [len(at) for at, _, _ in search._Deal(some, NGG, 4, 0, 0, 3).pairs(some)]
    assert sum(sizes) == 4**6 * sum(comb(6, n) * 3**n for n in range(5)) and max(sizes) <= search.AT_ONCE


def test_first_hits_of_many_guides_wait_for_few_pairs(monkeypatch):
    """Guides whose hits before the limit are too many to wait together are searched in parts."""
    some = np.arange(4**5, dtype=np.int64)
    deal = search._Deal(some, NGG, 4, 0, 0, 3)
    every = search._joined(list(deal.pairs(some)))
    seen = []

    def pick(at, guide, mm):  # the 20 smallest targets of a guide
        by = np.lexsort((at, guide))
        begins = np.searchsorted(guide[by], guide[by])
        kept = by[np.arange(len(by)) - begins < 20]
        seen.append(len(at))
        return at[kept], guide[kept], mm[kept]

    want = sorted(zip(*(x.tolist() for x in pick(*every))))
    seen.clear()
    monkeypatch.setattr(search, "PAIRS_HELD", 5_000)
    monkeypatch.setattr(search, "AT_ONCE", 1_000)
    got = [x.tolist() for x in search._joined(list(deal.first_hits(some, pick)))]
    assert sorted(zip(*got)) == want and max(seen) <= 6_000 + 4**5


def test_deals_hold_few_targets():
    """Where many targets begin alike a deal has more bases, and those of one half are dealt by a hash; guides reach the deals of all their targets."""
    rng = np.random.default_rng(6)
    low = 4**10
    targets = np.unique(np.concatenate([rng.integers(0, low * low, 3_000), rng.integers(0, low, 3_000) + 77 * low, rng.integers(0, low, 3_000) * low + 5, 4**14 + rng.integers(0, 4**14, 3_000)]))
    lead = [targets >> 20 >> 8, (targets & (low - 1)) >> 8]
    deals = search._Deals([np.bincount(x, minlength=4**6) for x in lead], 200)
    first, held = [np.full(len(targets), -1) for _ in lead], {}
    for half, x in enumerate(lead):
        for c, by in deals.first[half].items():
            first[half] = np.maximum(first[half], by[x >> 2 * (6 - c)])
        assert (first[half] >= 0).all()
        for number, n in zip(*np.unique(first[half], return_counts=True)):
            held[int(number)] = n / deals.parts[number]
            assert deals.of[number] == deals.of[number + deals.parts[number] - 1]
    assert max(held.values()) <= 200 and max(deals.parts) > 1 and {c for _, c, _ in deals.of} >= {3, 6}
    guides = targets[::40]
    reached = {(int(g), int(d)) for guide, deal in deals.reached(guides, NGG, 4) for g, d in zip(guide, deal)}
    x = targets[:, None] ^ guides
    apart = lambda x: np.bitwise_count((x | x >> 1) & int("01" * 20, 2))
    for t, g in zip(*np.nonzero(apart(x) <= 4)):
        half = int(apart(x[t, g] >> 20) > 2)
        number = int(first[half][t])
        assert all((int(g), number + k) in reached for k in range(deals.parts[number]))


@pytest.mark.parametrize("sent", [True, False])
@pytest.mark.parametrize("name,most", [("spcas9ngg", 4), ("cpf1", 3)])
def test_small_deals_equal_brute_force(spark, name, most, sent, monkeypatch):
    """Targets by 50, guides by 20, pairs by 30, where most targets share a half."""
    for key, value in {"DEAL_ROWS": 50, "COUNTED": 5, "GUIDES_AT_ONCE": 20, "PAIRS_AT_ONCE": 30, "SENT_GUIDES": 1 << 19 if sent else 10}.items():
        monkeypatch.setattr(search, key, value)
    e, rng = enzyme(name), random.Random(8)
    first = e.compared[0] - 1
    base = texts_of(1, 8, e)[0][: e.length]
    alike = {changed(base, rng.sample(range(10), rng.randint(1, 4)), rng, first) for _ in range(300)} | {changed(base, rng.sample(range(10, 20), rng.randint(1, 4)), rng, first) for _ in range(300)}
    texts = sorted({*alike, *(t[: e.length] for t in texts_of(300, 8, e)), *("A" + t[1:] if e.five_prime else t[:20] + "A" + t[21:] for t in alike)})
    found = target_frame(spark, texts, e).cache()
    guides = guide_frame(found.where(F.xxhash64("bases") % 3 == 0)).cache()
    of = lambda hits: sorted(tuple(r) for r in hits.select("guide_id", "guide", "bases", "cnt", "mm").collect())
    want = of(search.discover(guides, found, e, most, "scan"))
    assert of(search.discover(guides, found, e, most, "halves", len(texts))) == want and len(want) > 20_000
    cut_off = lambda hits: sorted(tuple(r) for r in search.overflow(hits, e, 7).select("guide_id", "bases", "cnt", "mm", "overflowed").collect())
    few = search.discover(guides, found, e, most, "halves", len(texts), 7)
    assert cut_off(few) == cut_off(search.discover(guides, found, e, most, "scan"))
