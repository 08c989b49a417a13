import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.enzymes import ENZYMES, enzyme
from helixframe.operators import folding, scoring
from helixframe.operators.ranking import schulze


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("out")).first()["out"]


def test_encode_round_trip_and_mismatches(spark):
    words = ["".join(p) for p in itertools.product("ACGT", repeat=4)]
    frame = spark.createDataFrame([(a, b) for a in words[::7] for b in words[::11]], "a string, b string")
    rows = frame.select(
        "a", "b", dna.decode(dna.encode(F.col("a")), 4).alias("back"), dna.mismatches(dna.encode(F.col("a")), dna.encode(F.col("b")), 4).alias("mm"),
        dna.text_mismatches(F.col("a"), F.col("b")).alias("text_mm"),
    ).collect()
    for r in rows:
        assert r.back == r.a and r.mm == r.text_mm == sum(x != y for x, y in zip(r.a, r.b))


@pytest.mark.parametrize(("bases", "share"), [("AACC", 0.5), ("CaCC", 0.75), ("AaCt", 0.25), ("aaaa", 0.0), ("GGGG", 1.0)])
def test_gc(spark, bases, share):
    assert one(spark, dna.gc(F.col("b")), b=bases) == share


@pytest.mark.parametrize(("bases", "run"), [("AAAAATTCC", 5), ("ACTGACGT", 1), ("AACCTTGG", 2), ("AATTTTTGG", 5), ("A", 0)])
def test_homopolymer(spark, bases, run):
    assert one(spark, dna.homopolymer(F.col("b")), b=bases) == run


def test_entropy_and_complements(spark):
    assert one(spark, dna.entropy(F.col("b")), b="AAAAATTCC") == pytest.approx(1.435521, abs=1e-5)
    assert one(spark, dna.reverse_complement(F.col("b")), b="AACGNt") == "aNCGTT"
    assert one(spark, dna.rna_complement(F.col("b")), b="ACGT") == "UGCA"


def test_median(spark):
    assert one(spark, dna.median(F.array(F.lit(3), F.lit(1), F.lit(2)))) == 2.0
    assert one(spark, dna.median(F.array(F.lit(4), F.lit(1), F.lit(2), F.lit(3)))) == 2.5


def test_positions(spark):
    packed = dna.pack_position(F.lit(7), F.lit(123456), F.lit(23), F.lit(True))
    back = dna.unpack_position(F.col("p"))
    row = spark.range(1).select(packed.alias("p")).select(*[c.alias(n) for n, c in back.items()]).first()
    assert (row.contig_idx, row.start, row.length, row.fwd) == (7, 123456, 23, True)


def test_enzymes():
    assert len(ENZYMES) == 6 and enzyme("cpf1").compared == (5, 20) and enzyme("SpCas919").compared == (1, 19)
    with pytest.raises(ValueError):
        enzyme("")


CFD_ROWS = [
    (1, "G", "T", 1.0), (2, "A", "G", 0.8), (2, "A", "T", 0.727272727), (4, "T", "C", 0.647058824), (5, "T", "G", 0.64), (8, "A", "C", 0.428571429),
    (10, "C", "A", 0.866666667), (11, "C", "A", 0.75), (12, "G", "A", 0.933333333), (12, "G", "C", 0.529411765), (15, "G", "A", 0.941176471),
    (18, "G", "A", 0.692307692), (18, "G", "T", 0.666666667), (19, "G", "C", 0.448275862), (19, "G", "T", 0.666666667), (20, "T", "A", 0.5625),
]


@pytest.mark.parametrize(
    ("target", "score"),
    [("GACCTGCATACGAAGCCTTT", 0.249237473), ("TTCTTGCATCAGAAGCCGCT", 0.244514106), ("GACCTGCATCCAAAGCCAGA", 0.235180995), ("GGCTGGCATCCCAAGCCAGT", 0.187656109), ("GACTTGCCTCCCAAACCTGT", 0.142362828)],
)
def test_cfd_pairs(spark, target, score):
    weights = scoring.weights_from_rows(CFD_ROWS)
    column = scoring.pair_product(F.col("g"), F.col("t"), weights)
    assert one(spark, column, g="GACTTGCATCCGAAGCCGGT", t=target) == pytest.approx(score, abs=1e-3)


def test_crispri_pairs(spark):
    weights = scoring.weights_from_rows([(1, "A", "T", 0.7952747759038213), (4, "A", "T", 0.6947382165440157), (9, "A", "T", 0.31016952886752025), (14, "A", "G", 0.26865890093507167)])
    pair = lambda g, t, n: one(spark, scoring.crispri_hit(F.col("g"), F.col("t"), weights, n), g=g, t=t)
    guide, product = "A" * 20 + "GGG", 0.6947382165440157 * 0.31016952886752025 * 0.26865890093507167
    assert pair(guide, "T" + "A" * 19 + "GGG", 23) == 1.0
    assert pair(guide, "AT" + "A" * 18 + "GGG", 23) == pytest.approx(0.7952747759038213)
    assert pair(guide, "AAAATAAAATAAAAGAAAAAGGG", 23) == pytest.approx(product)
    assert pair("A" * 19 + "GGG", "AAATAAAATAAAAGAAAAAGGG", 22) == pytest.approx(product)


@pytest.mark.parametrize(
    ("context", "score"),
    [("GGTTGTCAGCTGCCCCCACCTCCCTGGGCCCT", 0.011271132), ("TATAGCTGCGATCTGAGGTAGGGAGGGACCT", 0.713089368), ("TCCGCACCTGTCACGGTCGGGGCTTGGCGCT", 0.018983846)],
)
def test_doench2014(spark, context, score):
    assert one(spark, scoring.doench2014(F.col("c")), c=context) == pytest.approx(score, abs=1e-3)


def test_motif_scores_are_summed_a_batch_at_once(spark):
    """Against plain sums; in one generated method, too long to be compiled, a row took some 0.1 ms."""
    draw = random.Random(5)
    texts = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("ACGT", "ACGTacgtN", "ACGTé") for n in (0, 3, 29, 31, 34, 35, 36, 40, 60) for _ in range(8)] + [None]

    def doench(c):
        at = (len(c) - 23) // 2
        if at < 4 or len(c) - at - 23 < 3:
            return None
        t = c[at - 4 : at + 26]
        gc = sum(x in "GC" for x in t[4:24])
        score = scoring.DOENCH_INTERCEPT + ((gc - 10) * scoring.DOENCH_GC_HIGH if gc > 10 else (10 - gc) * scoring.DOENCH_GC_LOW)
        for key, w in scoring.DOENCH_WEIGHTS.items():
            motif = key.rstrip("0123456789")
            score += w if t.startswith(motif, int(key[len(motif) :])) else 0.0
        return 1 / (1 + math.exp(-score))

    def moreno(c):
        at = (len(c) - 23) // 2
        if at < 6 or len(c) - at - 23 < 6:
            return None
        return sum((w for motif, p, w in scoring.MORENO_WEIGHTS if c[p - 1 :].upper().startswith(motif)), scoring.MORENO_INTERCEPT)

    frame = spark.createDataFrame(list(enumerate(texts)), "id int, c string").select("id", scoring.doench2014(F.col("c")).alias("d"), scoring.moreno2015(F.col("c")).alias("m"))
    assert "ArrowEvalPython" in frame._jdf.queryExecution().executedPlan().toString()
    for row in frame.collect():
        c = texts[row["id"]]
        assert row["d"] == (None if c is None or doench(c) is None else pytest.approx(doench(c), rel=1e-14))
        assert row["m"] == (None if c is None or moreno(c) is None else pytest.approx(moreno(c), rel=1e-14))


def test_moreno2015(spark):
    for context, score in (("TCCTCTGGTGGCGCTGCTGGATGGACGGGACTGTA", 0.77), ("TCCTCTGGTGGGGCTGAAAGATGGACGGGTTTGTA", 0.68)):
        assert one(spark, scoring.moreno2015(F.col("c")), c=context) == pytest.approx(score, abs=0.005)
    assert one(spark, scoring.moreno2015(F.col("c")), c="A" * 33) is None


def test_hsu_hits_are_scored_a_batch_at_once(spark):
    """Against plain products; by functions of lists, which the JVM interprets, a search over 0.5 GB took most of its time here."""
    draw, frame = random.Random(6), []
    for n in [0, 1, 2, 3, 4, 20] * 10:
        guide = "".join(draw.choice("ACGT") for _ in range(23))
        places = draw.sample(range(20), n)
        frame.append((len(frame), guide, "".join(draw.choice("ACGT".replace(x, "")) if k in places else x for k, x in enumerate(guide[:21])) + draw.choice(["GG", "AG", "CT"])))

    def score(g, t):
        places = [k for k in range(20) if g[k] != t[k]]
        n, product = len(places), math.prod(1.0 - scoring.HSU_POSITION[k] for k in places)
        spread = 1.0 if n < 2 else 1.0 / (((19 - (places[-1] - places[0]) / (n - 1)) / 19) * 4 + 1)
        return product * spread / max(n * n, 1) * 100 * scoring.HSU_PAM.get(t[21:], scoring.HSU_OTHER_PAM)

    rows = spark.createDataFrame([*frame, (len(frame), None, "A" * 23)], "id int, g string, t string").select("id", scoring.hsu_hit(F.col("g"), F.col("t")).alias("s"))
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["s"] for r in rows.collect()}
    assert got.pop(len(frame)) is None
    assert got == {k: pytest.approx(score(g, t), rel=1e-13) for k, g, t in frame}


def test_hsu(spark):
    hit = scoring.hsu_hit(F.col("g"), F.col("t"))
    assert one(spark, hit, g="TTGTTTCCAGGTCAATGTGACGG", t="TTGTCTTCAAGTCAATATGATGG") == pytest.approx(0.36403873, abs=1e-3)


@pytest.mark.parametrize(("rna", "energy"), [("AGTACTCGAGTACTTCC", -3.5), ("AAGTACTCGAGTACTTCC", -4.4), ("GGAAGTACTCGAGTACTTCC", -10.5), ("GCCAGGAAGTACTCGAGTACTTCC", -10.7)])
def test_folding(rna, energy):
    assert folding.energy(rna) == pytest.approx(energy, abs=1e-3)


def test_folding_of_strings_that_do_not_fold():
    assert folding.energy("") == folding.energy("AAAA") == folding.energy("A" * 20) == 0.0


def widest(votes):
    """Schulze's method by its definition: preferences, then widest paths."""
    n, sums = len(votes), [sum(v) for v in votes]
    wide = [[max(0, a - b) for b in sums] for a in sums]
    for i in range(n):
        for j in range(n):
            for k in range(n):
                wide[j][k] = max(wide[j][k], min(wide[j][i], wide[i][k])) if j != k else 0
    score = [sum(w) for w in wide]
    order = sorted(range(n), key=lambda i: (-score[i], i))
    return [(score[i], order.index(i)) for i in range(n)]


def test_schulze(spark):
    golden = spark.createDataFrame([(k, *[v] * 5) for k, v in enumerate((5, 2, 3, 4, 1))], "id int, a int, b int, c int, d int, e int")
    assert {r.id: (r.score, r.rank) for r in schulze(golden, list("abcde"), "id").collect()}[0] == (50, 0)
    rng = random.Random(7)
    votes = [[rng.randint(1, 9), rng.randint(1, 9)] for _ in range(25)]
    frame = spark.createDataFrame([(k, *v) for k, v in enumerate(votes)], "id int, a int, b int")
    assert [(r.score, r.rank) for r in schulze(frame, ["a", "b"], "id").orderBy("id").collect()] == widest(votes)


def structures(rna, i, j):
    """All sets of nested pairs of rna[i:j] with at least three bases in a hairpin."""
    if j - i < 5:
        return [()]
    out = list(structures(rna, i + 1, j))
    for k in range(i + 4, j):
        if rna[i] + rna[k] in folding.PAIRS:
            out += [((i, k), *a, *b) for a in structures(rna, i + 1, k) for b in structures(rna, k + 1, j)]
    return out


def loop_energy(rna, i, j, inner, loops):
    """Energy of the loop that pair (i, j) closes around the pairs ``inner``."""
    kind = lambda a, b: folding.PAIRS.index(rna[a] + rna[b])
    base = lambda k: "ACGU".index(rna[k])
    weak = lambda *pairs: sum(rna[a] + rna[b] not in ("CG", "GC") for a, b in pairs)
    side = lambda a, b: {"AG": folding.INTERIOR_AG, "GA": folding.INTERIOR_AG, "UU": folding.INTERIOR_UU}.get(rna[a] + rna[b], 0)
    if not inner:
        size = j - i - 1
        if size == 3:
            return folding.HAIRPIN[3] + folding.TERMINAL_AU * weak((i, j))
        return folding._length(folding.HAIRPIN, size) + folding.MISMATCH[kind(i, j)][base(i + 1)][base(j - 1)] + folding.TETRALOOPS.get(rna[i : j + 1], 0)
    if len(inner) > 1:
        total = folding.MULTI_CLOSE + folding.MULTI_BRANCH * (len(inner) + 1) + folding.TERMINAL_AU * weak((i, j), *inner)
        total += folding.DANGLE5[kind(j, i)][base(j - 1)] + folding.DANGLE3[kind(j, i)][base(i + 1)]
        return total + sum(folding.DANGLE5[kind(p, q)][base(p - 1)] + folding.DANGLE3[kind(p, q)][base(q + 1)] for p, q in inner)
    ((p, q),) = inner
    a, b, out, into = p - i - 1, j - q - 1, kind(i, j), kind(q, p)
    if a + b == 0:
        return folding.STACK[out][into]
    if min(a, b) == 0:
        return folding._length(folding.BULGE, a + b) + (folding.STACK[out][into] if a + b == 1 else folding.TERMINAL_AU * weak((i, j), (p, q)))
    left, right = [base(k) for k in range(i + 1, p)], [base(k) for k in range(q + 1, j)]
    if (a, b) == (1, 1):
        return int(loops["1x1"][(out, into, *left, *right)])
    if (a, b) == (1, 2):
        return int(loops["2x1"][(out, into, *left, *right)])
    if (a, b) == (2, 1):
        return int(loops["2x1"][(into, out, *right, *left)])
    if (a, b) == (2, 2):
        return int(loops["2x2"][(out, into, *left, *right)])
    size = folding._length(folding.INTERIOR, a + b) + min(folding.MOST_ASYMMETRY, folding.ASYMMETRY * abs(a - b))
    return size + folding.INTERIOR_AU * weak((i, j), (p, q)) + side(i + 1, j - 1) + side(q + 1, p - 1)


def structure_energy(rna, pairs, loops):
    inside = lambda i, j: [(p, q) for p, q in pairs if i < p and q < j and not any(i < a < p and q < b < j for a, b in pairs)]
    total = sum(loop_energy(rna, i, j, inside(i, j), loops) for i, j in pairs)
    for i, j in inside(-1, len(rna)):
        kind = folding.PAIRS.index(rna[i] + rna[j])
        total += folding.TERMINAL_AU * (kind > 1)
        total += folding.DANGLE5[kind]["ACGU".index(rna[i - 1])] if i else 0
        total += folding.DANGLE3[kind]["ACGU".index(rna[j + 1])] if j + 1 < len(rna) else 0
    return total


@pytest.mark.parametrize("measured", [False, True])
def test_folding_equals_the_best_of_all_structures(measured):
    rng, loops, given = random.Random(11), folding.loops_by_rule(), None
    if measured:  # tables without any symmetry, strong enough to decide
        noise = np.random.default_rng(5)
        given = loops = {k: noise.integers(-90, 10, t.shape).astype(np.int32) for k, t in loops.items()}
    texts = ["".join(rng.choice("GGCCAU") for _ in range(rng.choice((10, 12, 13, 14)))) for _ in range(200)]
    texts += ["GGAGAAACACC", "GCAGAAAACGC", "GGAAGAAACAACC", "GGCGAAAGCC", "GGGAAACGAAACC", "CGGAAACGGAAACG", "GGAGAAACAACC", "GGAAGAAACACC"]
    texts += ["GG" + "A" * a + "GCAAAGC" + "U" * b + "CC" for a, b in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 2))]
    got = folding._energies_of(pd.Series(texts), given)
    for rna, energy in zip(texts, got):
        assert energy == pytest.approx(min(structure_energy(rna, pairs, loops) for pairs in structures(rna, 0, len(rna))) / 10), rna
    assert sum(got < 0) > 30


def test_parts_of_a_sequence_are_folded_with_the_whole():
    texts = pd.Series(["GCCAGGAAGTACTCGAGTAC", "AAAAAAAAAAAAAAAAAAAA", None, "GGCGAAAGCC", "", "GCNAGGAAGNACTCGAGTAC"])
    windows = lambda n: [(0, n), (min(1, n), n), (0, max(0, n - 1)), (min(4, n), max(4, n - 2))]
    for k, found in enumerate(folding._energies_within(texts, windows)):
        for text, energy in zip(texts, found):
            assert np.isnan(energy) if text is None else energy == folding.energy(text[slice(*windows(len(text))[k])])


def test_guides_are_folded_once_for_all_lengths(spark, monkeypatch):
    seen, fold = [], folding.window_energies
    monkeypatch.setattr(folding, "window_energies", lambda letters, windows, loops=None: seen.append(len(letters)) or fold(letters, windows, loops))
    found = folding._energies_within(pd.Series(["GCCAGGAAGTACTCGAGTAC"] * 3), lambda n: [(1, n), (0, n)])
    assert seen == [3] and len(found) == 2
    rows = spark.createDataFrame([("GCCAGGAAGTACTCGAGTACTGG",), (None,)], "bases string")
    for name, size in (("spcas9ngg", 20), ("cpf1", 19)):
        out = folding.folding(rows, enzyme(name), size - 1)
        assert out.columns[0] == "bases"
        first, size = enzyme(name).compared
        for row in out.collect():
            for column in out.columns[1:]:
                n = int(column.rsplit("_", 1)[1])
                at = first - 1 if enzyme(name).five_prime else first - 1 + size - n
                assert row[column] == (None if row["bases"] is None else folding.energy(row["bases"][at : at + n]))


def test_small_loops_have_tables():
    loops = folding.loops_by_rule()
    assert {k: t.shape for k, t in loops.items()} == {"1x1": (6, 6, 5, 5), "2x1": (6, 6, 5, 5, 5), "2x2": (6, 6, 5, 5, 5, 5)}
    stem = lambda a, b: folding.energy(f"GGC{a}GGCGAAAGCC{b}GCC")
    assert stem("G", "G") < stem("A", "A")  # two G lie well beside each other
    assert folding.energy("GGCGAAAGCC") < folding.energy("GGCGAAUGCC")  # a stable tetraloop
    raised = {"1x1": loops["1x1"] + 60}
    assert folding.energy("GGCAGGCGAAAGCCAGCC", raised) > folding.energy("GGCAGGCGAAAGCCAGCC")
