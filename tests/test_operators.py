import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.enzymes import ENZYMES, enzyme
from helixframe.operators import intervals, randoms, ranking, scoring, search, sites, targets
from helixframe.plans import catalog
from helixframe.sources import bed, fasta, guide_table, index
from helixframe.streaming.guides import stream_hits

NGG = enzyme("spcas9ngg")


def contigs(spark, *seqs):
    return spark.createDataFrame([(f"c{k}", k, s) for k, s in enumerate(seqs)], "contig string, contig_idx long, seq string")


def revcomp(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def plain_sites(seq, e):
    out = set()
    for p in range(len(seq) - e.length + 1):
        w = seq[p : p + e.length]
        if set(w) - set("ACGT"):
            continue
        for fwd, s in ((True, w), (False, revcomp(w))):
            n = len(e.pams[0])
            if (s[:n] if e.five_prime else s[-n:]) in e.pams:
                out.add((p, s, fwd))
    return out


@pytest.mark.parametrize("name", sorted(ENZYMES))
def test_sites_equal_brute_force(spark, name):
    rng, e = random.Random(5), ENZYMES[name]
    seqs = ["".join(rng.choice("ACGTN" if k == 2 else "ACGT") for _ in range(n)) for k, n in enumerate((10, 700, 600, 23, 24, 1050))]
    got = sites.find_sites(contigs(spark, *seqs), e, 4).collect()
    want = {(k, *s) for k, seq in enumerate(seqs) for s in plain_sites(seq, e)}
    assert {(r.contig_idx, r.start, r.bases, r.fwd) for r in got} == want and len(got) == len(want)
    for r in got:
        seq, low, high = seqs[r.contig_idx], r.start - 4, r.stop + 4
        around = seq[low:high] if low >= 0 and high <= len(seq) else None
        assert r.context == (around if around is None or r.fwd else "".join(c if c == "N" else revcomp(c) for c in reversed(around)))


def test_site_goldens(spark):
    row = sites.find_sites(contigs(spark, "ATAATATA" + "ATTTAAAAAATTTTTAAAAAAGG" + "AATTAAAT"), NGG, 8).collect()
    assert [(r.start, r.context) for r in row] == [(8, "ATAATATAATTTAAAAAATTTTTAAAAAAGGAATTAAAT")]
    row = sites.find_sites(contigs(spark, "CCTTAAAAAACCCCCAAAAAAAA"), NGG).collect()
    assert [(r.bases, r.fwd) for r in row] == [(revcomp("CCTTAAAAAACCCCCAAAAAAAA"), False)]


def some_targets(spark, n=600):
    rng = random.Random(9)
    base = ["".join(rng.choice("ACGT") for _ in range(21)) + "GG" for _ in range(n // 4)]
    near = ["".join(c if rng.random() > 0.1 else rng.choice("ACGT") for c in rng.choice(base)[:21]) + "GG" for _ in range(n)]
    frame = spark.createDataFrame([(b, 1 + k % 3) for k, b in enumerate(sorted(set(base + near)))], "bases string, cnt int")
    return frame.withColumn("enc", dna.encode(NGG.key(F.col("bases"))))


@pytest.mark.parametrize("most", [0, 1, 3, 4, 5])
def test_joins_agree_with_brute_force(spark, most):
    found = some_targets(spark).cache()
    guides = found.where(F.col("enc") % 5 == 0).select(F.col("enc").alias("guide_id"), "bases", "enc")
    rows = [r.bases for r in found.collect()]
    want = {(g, t) for g in (r.bases for r in guides.collect()) for t in rows if sum(a != b for a, b in zip(g[:20], t[:20])) <= most}
    for strategy in ("scan", "probe", "halves", "auto"):
        got = search.discover(guides, found, NGG, most, strategy).collect()
        assert {(r.guide, r.bases) for r in got} == want and len(got) == len(want)


def test_search_brings_positions(spark):
    found = some_targets(spark, 80).withColumn("positions", F.array("cnt"))
    guides = found.where(F.col("enc") % 5 == 0).select(F.col("enc").alias("guide_id"), "bases", "enc")
    for strategy in ("scan", "probe", "halves"):
        rows = search.discover(guides, found, NGG, 4, strategy).collect()
        assert rows and all(r.positions == [r.cnt] for r in rows)


@pytest.mark.parametrize("name", ["spcas9ngg", "cpf1"])
def test_overflow_equals_brute_force(spark, name):
    rng, e = random.Random(4), enzyme(name)
    texts = sorted({"".join(rng.choice("ACGT") for _ in range(e.length)) for _ in range(200)})
    hits = [(g, "g", b, rng.randint(1, 9), 1) for g in range(3) for b in texts[: 70 * (g + 1)]]
    frame = spark.createDataFrame(hits, "guide_id long, guide string, bases string, cnt int, mm int")
    order = (lambda b: (b[4:11], b)) if e.five_prime else (lambda b: b)
    for most in (1, 40, 700, 5000):
        want = set()
        for g in range(3):
            total = 0
            mine = sorted((h for h in hits if h[0] == g), key=lambda h: order(h[2]))
            for h in mine:
                if total < most:
                    want.add((g, h[2], sum(x[3] for x in mine) >= most))
                total += h[3]
        got = search.overflow(frame, e, most).collect()
        assert {(r.guide_id, r.bases, r.overflowed) for r in got} == want and len(got) == len(want)


def test_overflow(spark):
    hits = spark.createDataFrame([(1, "g", b, c, 1) for b, c in (("A", 2), ("C", 3), ("G", 4), ("T", 1))], "guide_id long, guide string, bases string, cnt int, mm int")
    kept = search.overflow(hits, NGG, 5).orderBy("bases").collect()
    assert [(r.bases, r.overflowed) for r in kept] == [("A", True), ("C", True)]
    assert [r.overflowed for r in search.overflow(hits, NGG, 11).collect()] == [False] * 4
    assert search.overflow(hits, NGG, 0).count() == 0


def test_dedupe_and_cap(spark, monkeypatch):
    monkeypatch.setattr(dna, "COUNT_CAP", 3)
    found = sites.find_sites(contigs(spark, *["ATTTAAAAAACCCCCAAAAAGGG"] * 5), NGG)
    row = targets.build_targets(found, NGG).first()
    assert row.cnt == 3 and [p.contig for p in row.positions] == ["c0", "c1", "c2"]


def test_positions_of_a_repeat_family(spark, monkeypatch):
    """The first places in order are kept, whatever contig and stretch they lie in."""
    monkeypatch.setattr(dna, "COUNT_CAP", 7)
    monkeypatch.setattr(targets, "STRETCH", 3)
    rng = random.Random(1)
    places = [(f"c{rng.randint(0, 4)}", rng.randint(0, 4), rng.randint(0, 60), bool(rng.randint(0, 1))) for _ in range(80)]
    places = sorted({(f"c{i}", i, s, f) for _, i, s, f in places})
    sites_of = spark.createDataFrame([(c, i, s, s + 23, "A" * 21 + "GG", f) for c, i, s, f in places], "contig string, contig_idx int, start int, stop int, bases string, fwd boolean")
    row = targets.build_targets(sites_of.repartition(3), NGG).first()
    want = sorted(places, key=lambda p: (p[1], p[2], not p[3]))[:7]
    assert row.cnt == 7 and [(p.contig, p.start, p.fwd) for p in row.positions] == [(c, s, f) for c, _, s, f in want]


def test_no_task_meets_all_places_of_a_repeat_family(spark):
    """A target with a million places over ten contigs: lists hold a stretch each, only its first places are merged."""
    sites_of = spark.range(1_000_000).select(
        F.concat(F.lit("c"), (F.col("id") % 10)).alias("contig"), (F.col("id") % 10).alias("contig_idx"), F.floor(F.col("id") / 10).alias("start"),
        (F.floor(F.col("id") / 10) + 23).alias("stop"), F.lit("A" * 21 + "GG").alias("bases"), F.lit(True).alias("fwd"),
    )
    seen, real = [], targets.cut
    targets.cut = lambda df, label: [out := real(df, label), label == "stretches" and seen.append(out)][0]
    try:
        row = targets.build_targets(sites_of, NGG).first()
    finally:
        targets.cut = real
    assert row.cnt == dna.COUNT_CAP and [p.start for p in row.positions] == list(range(dna.COUNT_CAP)) and {p.contig for p in row.positions} == {"c0"}
    assert seen[0].agg(F.max("n")).first()[0] <= 1 << targets.STRETCH < 1_000_000 / 8


def test_score_ranges_are_even(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_SCORES", 5_000)
    frame = spark.range(200_000).select(F.col("id").alias("guide_id"), ((F.col("id") * 7919) % 200_003).alias("s"))
    kept, real = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, label: [out := real(df, label), label == "score-ranges" and kept.append(out)][0])
    got = ranking.tie_rank(frame, "s", "r", True).orderBy(F.desc("s")).select("r").collect()
    assert [r.r for r in got] == list(range(1, 200_001))
    sizes = sorted(r["count"] for r in kept[0].groupBy("_range").count().collect())
    assert len(sizes) >= 40 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_nested_bins(spark):
    """Intervals of all lengths against plain Python; one as long as a chromosome is two rows at most."""
    rng = random.Random(4)
    beds = [(rng.choice("ab"), s, s + rng.choice([0, 1, 50, 5_000, 4 * 10**6, 2 * 10**8]), f"r{k}", k) for k in range(150) for s in [rng.randint(0, 2 * 10**8)]]
    beds += [("a", 0, 250_000_000, "chr", 150), ("b", 4095, 4097, "edge", 151), ("b", 8191, 2 * 10**9, "far", 152)]
    found = [(rng.choice("abc"), s, s + n, k) for k in range(400) for s, n in [(rng.choice([rng.randint(0, 2 * 10**8), 4090, 8190, 32767]), rng.choice([1, 23, 9_000]))]]
    frame = spark.createDataFrame(beds, "contig string, start long, stop long, name string, idx int")
    got = intervals.overlap_join(spark.createDataFrame(found, "contig string, start long, stop long, n int"), frame, ["n"], "hit").collect()
    want = {n: ",".join(b[3] for b in beds if b[0] == c and s < b[2] and b[1] < e) or "NA" for c, s, e, n in found}
    assert {r.n: r.hit for r in got} == want and len(got) == 400
    rows = frame.withColumn("_level", intervals._level("start", "stop")).select(F.size(intervals._bins("start", "stop")).alias("n"))
    assert rows.agg(F.max("n")).first()[0] <= 2


@pytest.mark.parametrize("split", ["1k", "7k", "128m"])
def test_pieces_give_the_sites_of_whole_contigs(spark, tmp_path, split):
    rng = random.Random(3)
    seqs = {"one x": 9_000, "two": 40, "three": 20_000, "none": 0, "four": 5}
    text = {name: "".join(rng.choice("acgtN" if k % 97 == 0 else "ACGT") for k in range(n)) for name, n in seqs.items()}
    wrap = lambda s, n: "\n".join(s[k : k + n] for k in range(0, len(s), n))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">one x\n" + wrap(text["one x"], 60) + "\n>two\r\n" + text["two"] + "\r\n>three\n" + wrap(text["three"], 71) + "\n")
    (tmp_path / "in" / "b.fa").write_text(">none\n>four\nAC GT\ta\n")
    text["four"] = "ACGTA"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pieces = fasta.read_pieces(spark, str(tmp_path / "in"), *sites.halo([NGG], 6), 512)
        rows = sorted(map(tuple, pieces.collect()), key=lambda r: (r[1], r[3]))
        got = sites.find_sites_in(pieces, 512, [NGG], 6).drop("enzyme").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    names = ["one_x", "two", "three", "none", "four"]
    want = [(n, k + 1, len(s), at, min(6, at), s[max(0, at - 6) : at + 512 + 28]) for k, (n, s) in enumerate(zip(names, (text[x].upper() for x in seqs))) for at in range(0, len(s), 512)]
    assert rows == want
    whole = spark.createDataFrame([(n, k + 1, text[x].upper()) for k, (n, x) in enumerate(zip(names, seqs))], "contig string, contig_idx long, seq string")
    shape = lambda rows: sorted((r.contig, r.start, r.stop, r.bases, r.fwd, r.context or "") for r in rows)
    assert shape(got) == shape(sites.find_sites(whole, NGG, 6).collect()) and got


def test_ends_of_files_that_one_task_reads_stay_apart(spark, tmp_path):
    rng, contigs = random.Random(8), {}
    for k in range(3):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        text = ""
        for part, size in (("a", 3000), ("b", 2000), ("c", 500)):  # a split of 4096 ends within b
            seq = contigs[f"{part}{k}"] = "".join(rng.choice("ACGT") for _ in range(size))
            text += f">{part}{k}\n" + "\n".join(seq[x : x + 50] for x in range(0, size, 50)) + "\n"
        (folder / f"{k}.fa").write_text(text)
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        rows = fasta.read_pieces(spark, str(tmp_path / "in"), 0, 0, 1 << 16).collect()
        assert {r["contig"]: r["piece"] for r in rows} == contigs
        assert [r["contig"] for r in sorted(rows, key=lambda r: r["contig_idx"])] == list(contigs)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)



def test_closest_goldens(spark):
    schema = "guide_id long, guide string, bases string, cnt int, mm int"
    rows = [(1, "g", "a", 1, 1), (2, "g", "a", 40, 1), (3, "g", "a", 70, 1), (3, "g", "b", 20, 2), (3, "g", "c", 10, 4), (4, "g", "a", 5, 0)]
    hits = spark.createDataFrame(rows, schema)
    near = {r.guide_id: (r.closest, r.closest_count) for r in scoring.closest_hit(hits).collect()}
    assert near == {1: ("1", 1), 2: ("1", 40), 3: ("1", 70), 4: ("UNK", 0)}
    histogram = {r.guide_id: r.histogram for r in scoring.mismatch_histogram(hits).collect()}
    assert histogram == {1: "0,1,0,0,0", 2: "0,40,0,0,0", 3: "0,70,20,0,10", 4: "5,0,0,0,0"}


def test_dangerous(spark):
    hits = spark.createDataFrame([(1, "A" * 10 + "TTTT" + "A" * 9, "x", 3, 0), (2, "ACGTACGTACGTACGTACGTAGG", "x", 1, 2)], "guide_id long, guide string, bases string, cnt int, mm int")
    rows = {r.guide_id: r for r in scoring.dangerous(hits).collect()}
    assert rows[1].gc.startswith("GC_0") and rows[1].poly_t == "PolyT" and rows[1].in_genome == "IN_GENOME=3"
    assert (rows[2].gc, rows[2].poly_t, rows[2].in_genome) == ("NONE", "NONE", "NONE")


def test_hsu_guide_golden(spark):
    texts = """GACCTGCATACGAAGCCTTTGGG TTCTTGCATCAGAAGCCGCTGGG GACCTGCATCCAAAGCCAGAGGG GGCTGGCATCCCAAGCCAGTAGG GACTTGCCTCCCAAACCTGTTGG
    GACTTGCATCAGAAGCACATAGG GACTTGGGTCCGAGGCCTGTGGG GAAATGCATCCTAAGCCGTTGGG GAAATGCATCCTAAGCCGTTGGG CACTAGCATCCCAGGCCGGTGGG""".split()
    hits = spark.createDataFrame([(1, "GACTTGCATCCGAAGCCGGTGGG", t, 1, 4) for t in texts], "guide_id long, guide string, bases string, cnt int, mm int")
    assert 96 < scoring.hsu(hits).first().hsu2013 < 100


# The published mismatch weights that the golden pairs below need (position, guide base, target base, weight).
CFD_SOME = (
    (1, "G", "T", 1.0), (2, "A", "G", 0.8), (2, "A", "T", 0.727272727), (4, "T", "C", 0.647058824), (5, "T", "G", 0.64), (8, "A", "C", 0.428571429),
    (10, "C", "A", 0.866666667), (11, "C", "A", 0.75), (12, "G", "A", 0.933333333), (12, "G", "C", 0.529411765), (15, "G", "A", 0.941176471), (18, "G", "A", 0.692307692),
    (18, "G", "T", 0.666666667), (19, "G", "C", 0.448275862), (19, "G", "T", 0.666666667), (20, "T", "A", 0.5625),
)
CRISPRI_SOME = ((1, "A", "T", 0.7952747759038213), (4, "A", "T", 0.6947382165440157), (9, "A", "T", 0.31016952886752025), (14, "A", "G", 0.26865890093507167))


def test_pair_goldens(spark):
    """Pairs scored with published weights."""
    weights = scoring.weights_from_rows(CFD_SOME)
    want = {"GACCTGCATACGAAGCCTTT": 0.249237473, "TTCTTGCATCAGAAGCCGCT": 0.244514106, "GACCTGCATCCAAAGCCAGA": 0.235180995, "GGCTGGCATCCCAAGCCAGT": 0.187656109, "GACTTGCCTCCCAAACCTGT": 0.142362828}
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r.t: r.s for r in rows.select("t", scoring.pair_product(F.lit("GACTTGCATCCGAAGCCGGT"), F.col("t"), weights).alias("s")).collect()}
    assert got == pytest.approx(want, abs=1e-3)
    hits = spark.createDataFrame([(1, "GACTTGCATCCGAAGCCGGTGGG", t + "TGG", 2, 3) for t in want] + [(1, "GACTTGCATCCGAAGCCGGTGGG", "GACTTGCATCCGAAGCCGGTAGG", 5, 0)], "guide_id long, guide string, bases string, cnt int, mm int")
    row = scoring.cfd(hits, weights).first()
    assert row.cfd_max == pytest.approx(0.249237473, abs=1e-3) and row.cfd_specificity == pytest.approx(1 / (1 + 2 * sum(want.values())), abs=1e-3)

    weights, guide = scoring.weights_from_rows(CRISPRI_SOME), "A" * 20 + "GGG"
    want = {"T" + guide[1:]: 1.0, "AT" + guide[2:]: 0.7952747759038213, "AAAATAAAATAAAAGAAAAAGGG": 0.6947382165440157 * 0.31016952886752025 * 0.26865890093507167}
    for target, value in want.items():
        assert one(spark, scoring.crispri_hit(F.lit(guide), F.lit(target), weights)) == pytest.approx(value)
    assert one(spark, scoring.crispri_hit(F.lit("A" * 19 + "GGG"), F.lit("AAATAAAATAAAAGAAAAAGGG"), weights, 22)) == pytest.approx(value)


def one(spark, column):
    return spark.range(1).select(column.alias("out")).first()["out"]


def test_rank_goldens(spark):
    frame = spark.createDataFrame([(k, float(k)) for k in range(5)], "guide_id long, s double")
    rows = {r.guide_id: r for r in ranking.aggregate_ranks(frame, {"s": True}).collect()}
    assert [rows[k].rank_s for k in range(5)] == [5, 4, 3, 2, 1] and [rows[k].tranche for k in range(5)] == [4, 4, 3, 2, 1]
    assert {k: r.top_x for k, r in rows.items() if r.top_x} == {4: 1, 3: 2}
    frame = spark.createDataFrame([(k, float(k), float(k)) for k in range(100)], "guide_id long, a double, b double")
    rows = ranking.aggregate_ranks(frame, {"a": True, "b": False}).collect()
    assert {(r.median_rank, r.tranche) for r in rows} == {(51, 3)}
    assert ranking.aggregate_ranks(frame, {}).where("median_rank is not null").count() == 0
    odd = spark.createDataFrame([(1, "2.5"), (2, "NA"), (3, None)], "guide_id long, s string")
    assert {r.guide_id: r.rank_s for r in ranking.aggregate_ranks(odd, {"s": True}).collect()} == {1: 1, 2: 3, 3: 3}


def test_intervals(spark):
    found = spark.createDataFrame([("chr8", 150, 173, "x"), ("chr8", 1000, 1023, "y"), ("1", 50, 73, "z"), ("chr8", 4090, 4113, "w")], "contig string, start int, stop int, bases string")
    beds = spark.createDataFrame([("chr8", 100, 1000, "region1", 0), ("chr8", 10000, 11000, "region2", 1), ("chr8", 4000, 9000, "wide", 2), ("chr8", 4100, 4101, "tiny", 3)], "contig string, start int, stop int, name string, idx int")
    mapping = spark.createDataFrame([("1", "chr8", 10000)], "old_contig string, contig string, start int")
    moved = intervals.remap(found, mapping)
    rows = {r.bases: r for r in intervals.overlap_join(moved, beds, ["bases"], "hit").collect()}
    assert (rows["x"].hit, rows["y"].hit, rows["z"].hit, rows["w"].hit) == ("region1", "NA", "region2", "wide,tiny")
    assert (rows["z"].contig, rows["z"].start, rows["z"].old_contig, rows["x"].old_contig) == ("chr8", 10050, "1", "NA")


def test_repeated_rows_and_overlaps(spark):
    found = spark.createDataFrame([("c", 0, 23, "x"), ("c", 0, 23, "x"), ("d", 0, 23, "x")], "contig string, start int, stop int, bases string")
    beds = spark.createDataFrame([("c", 0, 9, "r", 0)], "contig string, start int, stop int, name string, idx int")
    rows = intervals.overlap_join(found, beds, ["bases"], "hit").collect()
    assert sorted((r.contig, r.hit) for r in rows) == [("c", "r"), ("c", "r"), ("d", "NA")] and rows[0].__fields__ == ["contig", "start", "stop", "bases", "hit"]


def test_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a b\tc\nacgt\nAC\n>second\nTTTT\n>empty\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("contig_idx").collect()
    assert [(r.contig, r.contig_idx, r.seq) for r in rows] == [("a_b_c", 1, "ACGTAC"), ("second", 2, "TTTT"), ("empty", 3, "")]
    fasta.write_fasta(spark.createDataFrame([("n", "ACGT")], "name string, seq string"), "name", "seq", str(tmp_path / "out.fa"), "gzip")
    assert [(r.contig, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "out.fa")).collect()] == [("n", "ACGT")]
    (tmp_path / "x.bed").write_text("#head\nchr8\t100\t1000\tregion1\tk=v;m=2\nchr8\t5\t6\tr2\n#tail\n")
    rows = bed.read_bed(spark, str(tmp_path / "x.bed")).orderBy("idx").collect()
    assert [(r.contig, r.start, r.stop, r.name, r.rest) for r in rows] == [("chr8", 100, 1000, "region1", {"k": "v", "m": "2"}), ("chr8", 5, 6, "r2", None)]
    (tmp_path / "x.dict").write_text("@HD\tVN:1\n@SQ\tSN:chr1\tLN:99\n")
    assert fasta.read_dictionary(spark, str(tmp_path / "x.dict")).collect()[0][:] == ("chr1", 99)


def test_guide_table_round_trip(spark, tmp_path):
    place = "array<struct<contig:string,start:int,fwd:boolean>>"
    hits = spark.createDataFrame([("ACGT", 2, 1, [("c:1", 5, True), ("d", 9, False)], {"test": "1", "a": "x"}), ("TTTT", 1, 3, [], {})], f"bases string, cnt int, mm int, positions {place}, scores map<string,string>")
    text = guide_table.token(*[F.col(c) for c in ("bases", "cnt", "mm", "positions", "scores")])
    tokens = [r[0] for r in hits.select(text).collect()]
    assert tokens == ["ACGT_2_1<c:1:5^F|d:9^R>{a=x!test=1}", "TTTT_1_3<>"]
    rows = [("ctg", 3, 26, "ACGTACGTACGTACGTACGTAGG", None, False, True, "7.5", 3, tokens), ("ctg", 4, 27, "C" * 23, "N" * 35, True, False, None, 9, tokens)]
    schema = "contig string, start int, stop int, bases string, context string, overflowed boolean, fwd boolean, score string, ot_count long, tokens array<string>"
    guide_table.write_guides(spark.createDataFrame(rows, schema), str(tmp_path / "g.tsv"), ["score"])
    back = guide_table.read_guides(spark, str(tmp_path / "g.tsv"), 2).collect()
    assert len(back) == 1 and back[0].context is None and back[0].score == "7.5" and back[0].ot_count == 3
    assert [(h.bases, h.cnt, h.mm, [tuple(p) for p in h.positions], h.scores) for h in back[0].hits] == [("ACGT", 2, 1, [("c:1", 5, True), ("d", 9, False)], {"test": "1", "a": "x"})]


def test_index_round_trip_and_stream(spark, tmp_path):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(800)) for _ in range(3)]
    found = targets.build_targets(sites.find_sites(contigs(spark, *seqs), NGG), NGG)
    index.write_index(found, NGG, str(tmp_path / "index"))
    whole = index.read_index(spark, str(tmp_path / "index"))
    back = whole.targets
    assert whole.enzyme is NGG and back.count() == found.count() == whole.n_targets
    contigs(spark, seqs[0]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("contig string, contig_idx long, seq string").parquet(str(tmp_path / "in"))
    run = stream_hits(stream, back, NGG, 2).writeStream.format("memory").queryName("hits").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("hits").where("mm = 0").count() >= len(plain_sites(seqs[0], NGG))


@pytest.mark.parametrize("tokens", ["R1,N1", "N1-,N", "N2,N1-", "Z,N", "N-,N", "N,N,N"])
def test_refused_patterns(tokens):
    with pytest.raises(ValueError):
        randoms.pattern(tokens, 1, 2)


def test_randoms(spark):
    rows = randoms.random_guides(spark, NGG, 50, tokens="N1,N1-," + ",".join("N" * 19), one_site=True).collect()
    assert len({r.seq for r in rows}) == 50
    for r in rows:
        assert r.seq[1] == revcomp(r.seq[0]) and r.seq.endswith("GG") and len(plain_sites(r.seq, NGG)) == 1
    assert len(randoms.random_guides(spark, enzyme("cpf1"), 20, left=3).collect()[0].seq) == 27


def test_targets_that_differ_in_the_pam_alone_are_guides_of_their_own(spark):
    rows = [("A" * 20 + "AGG", 1, 0), ("A" * 20 + "TGG", 2, 0)]
    found = spark.createDataFrame(rows, "bases string, cnt int, enc long")
    guides = catalog.as_guides(found)
    assert guides.select("guide_id").distinct().count() == 2
    hits = search.by_guide(search.discover(guides, found, catalog.NGG))
    assert sorted((r["guide"], r["n_hits"], r["ot_count"]) for r in hits.collect()) == [(b, 2, 3) for b, _, _ in rows]


def test_sites_of_pieces_with_letters_of_several_bytes(spark):
    """Places count letters, not bytes, whatever lies in a batch; contexts keep other letters."""
    rng = random.Random(12)
    body = lambda n: "".join(rng.choice("ACGTGGa") for _ in range(n))
    texts = ["", body(30) + "é語" + body(60) + "ß" + body(30), body(5000) + "\U0001f600" + body(4000), "é" * 40, body(9000)]
    contigs = spark.createDataFrame([(str(k), k, t) for k, t in enumerate(texts)], "contig string, contig_idx long, seq string").coalesce(1)
    flip = lambda t: t.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]
    want = set()
    for k, t in enumerate(texts):
        for i in range(len(t) - 22):
            w = t[i : i + 23]
            around = t[i - 6 : i + 29] if i >= 6 and i + 29 <= len(t) else None
            if not set(w) - set("ACGT"):
                want |= {(k, i, w, True, around)} if w.endswith("GG") else set()
                want |= {(k, i, flip(w), False, around and flip(around))} if w.startswith("CC") else set()
    got = sites.find_sites(contigs, NGG, 6)
    assert not [c for c in ("lambdafunction", "regexp") if c in got._jdf.queryExecution().optimizedPlan().toString()]  # letters are scanned a batch at a time
    got = got.collect()
    assert {(r.contig_idx, r.start, r.bases, r.fwd, r.context) for r in got} == want and len(got) == len(want)
