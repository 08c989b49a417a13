"""Minimum free energy of short RNAs by dynamic programming.

Stacks, hairpins with bonuses of stable tetraloops, bulges, interior loops and multiloops with dangling ends on both
sides; energies in tenths of kcal/mol at 37 degrees.  Interior loops of 1x1, 2x1 and 2x2 bases have
tables, which ``loops_by_rule`` fills from closing pairs and mismatches unless others are given.  All sequences of a batch
and all pairs of one span are folded side by side in numpy, so the loops run once a batch, not once a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.enzymes import Enzyme

PAIRS = ("CG", "GC", "GU", "UG", "AU", "UA")
_BASES = "ACGU"

# Nearest-neighbour parameters (Turner 1999). Rows and columns in the order of PAIRS; the
# column's pair is read from the inner pair's second base to its first.
STACK = (
    (-24, -33, -21, -14, -21, -21),
    (-33, -34, -25, -15, -22, -24),
    (-21, -25, 13, -5, -14, -13),
    (-14, -15, -5, 3, -6, -10),
    (-21, -22, -14, -6, -11, -9),
    (-21, -24, -13, -10, -9, -13),
)
# Terminal mismatches in hairpins by pair, base after its first, base before its second (A C G U each).
MISMATCH = (
    ((-15, -15, -14, -18), (-10, -9, -29, -8), (-22, -20, -16, -11), (-17, -14, -18, -20)),
    ((-11, -15, -13, -21), (-11, -7, -24, -5), (-24, -29, -14, -12), (-19, -10, -22, -15)),
    ((2, -5, -3, -3), (-1, -2, -15, -2), (-9, -11, -3, 0), (-3, -3, -4, -11)),
    ((-5, -3, -6, -5), (-2, -1, -17, 0), (-8, -12, -3, -7), (-6, -1, -6, -8)),
    ((-3, -5, -3, -3), (-1, -2, -15, -2), (-11, -12, -2, 2), (-3, -3, -6, -11)),
    ((-5, -3, -6, -5), (-2, -1, -12, 0), (-14, -12, -7, -2), (-3, -1, -5, -8)),
)
DANGLE3 = ((-11, -4, -13, -6), (-17, -8, -17, -12), (-7, -1, -7, -1), (-8, -5, -8, -6), (-7, -1, -7, -1), (-8, -5, -8, -6))
DANGLE5 = ((-5, -3, -2, -1), (-2, -3, 0, 0), (-3, -3, -4, -2), (-3, -1, -2, -2), (-3, -3, -4, -2), (-3, -1, -2, -2))
HAIRPIN = (0, 0, 0, 57, 56, 56, 54, 59, 56, 64)
BULGE = (0, 38, 28, 32, 36, 40, 44, 46, 47, 48)
INTERIOR = (0, 0, 41, 51, 17, 18, 20, 22, 23, 24)
# Bonuses of hairpins of four bases, by the bases with their closing pair.
TETRALOOPS = {
    "GGGGAC": -30, "GGUGAC": -30, "CGAAAG": -30, "GGAGAC": -30, "CGCAAG": -30, "GGAAAC": -30, "CGGAAG": -30, "CUUCGG": -30,
    "CGUGAG": -30, "CGAAGG": -25, "CUACGG": -25, "GGCAAC": -25, "CGCGAG": -25, "UGAGAG": -25, "CGAGAG": -20, "AGAAAU": -20,
    "CGUAAG": -20, "CUAACG": -20, "UGAAAG": -20, "GGAAGC": -15, "GGGAAC": -15, "UGAAAA": -15, "AGCAAU": -15, "AGUAAU": -15,
    "CGGGAG": -15, "AGUGAU": -15, "GGCGAC": -15, "GGGAGC": -15, "GUGAAC": -15, "UGGAAA": -15,
}
# Interior loops: a closing pair other than CG and GC, first mismatches AG and GA, UU.
INTERIOR_AU, INTERIOR_AG, INTERIOR_UU = 7, -11, -7
# Small loops by the number of closing pairs other than CG and GC: 1x1, 1x1 of two G, 2x1, 2x2 without mismatch bonuses.
LOOP_1X1, LOOP_1X1_GG, LOOP_2X1, LOOP_2X2 = (4, 11, 17), (-14, -10, -4), (23, 30, 37), (11, 18, 25)
TERMINAL_AU, ASYMMETRY, MOST_ASYMMETRY = 5, 5, 30
MULTI_CLOSE, MULTI_BRANCH, MULTI_FREE = 34, 4, 0
LONGEST_LOOP = 30
#: Sequences whose tables are kept in memory at once.
AT_ONCE = 2048
_NO = 10**6


def _length(table: tuple, n: int) -> int:
    return table[n] if n < len(table) else table[-1] + round(10.79 * math.log(n / (len(table) - 1)))


def _table(values: tuple) -> np.ndarray:
    """A table by pair and bases, with a last place of zeros for letters that are no base."""
    values = np.array(values, np.int32)
    return np.pad(values, [(0, 0)] + [(0, 1)] * (values.ndim - 1))


_STACK, _MISMATCH, _DANGLE3, _DANGLE5 = np.array(STACK, np.int32), _table(MISMATCH), _table(DANGLE3), _table(DANGLE5)
_KIND = np.array([[PAIRS.index(a + b) if a + b in PAIRS else -1 for b in _BASES + "N"] for a in _BASES + "N"])
_TETRALOOP = np.zeros((5,) * 6, np.int32)
for _letters, _bonus in TETRALOOPS.items():
    _TETRALOOP[tuple(_BASES.index(b) for b in _letters)] = _bonus


def _first_mismatch() -> np.ndarray:
    """Bonuses of the bases beside a pair that closes an interior loop."""
    out = np.zeros((5, 5), np.int32)
    a, g, u = (_BASES.index(b) for b in "AGU")
    out[a, g] = out[g, a] = INTERIOR_AG
    out[u, u] = INTERIOR_UU
    return out


_BESIDE = _first_mismatch()


def loops_by_rule() -> dict[str, np.ndarray]:
    """Tables of small interior loops by outer pair, inner pair read from inside the loop, and bases of the loop (4: no base).

    ``1x1``: base after the outer pair's first, base before its second.  ``2x1``: the single base of the
    short side, then the long side's from 5' to 3', seen from the pair whose first base is followed by the single one.
    ``2x2``: two bases of the 5' side, then two of the 3' side.
    """
    weak = np.array([k > 1 for k in range(len(PAIRS))], np.int64)
    weak = weak[:, None] + weak[None, :]
    one = np.broadcast_to(np.array(LOOP_1X1)[weak][:, :, None, None], (6, 6, 5, 5)).astype(np.int32)
    g = _BASES.index("G")
    one[:, :, g, g] = np.array(LOOP_1X1_GG)[weak]
    two = np.broadcast_to(np.array(LOOP_2X1)[weak][:, :, None, None, None], (6, 6, 5, 5, 5)).astype(np.int32)
    bonus = _BESIDE[:, None, None, :] + np.transpose(_BESIDE)[None, :, :, None]  # outer sees (5' first, 3' last), inner (3' first, 5' last)
    return {"1x1": one, "2x1": two, "2x2": (np.array(LOOP_2X2)[weak][:, :, None, None, None, None] + bonus).astype(np.int32)}


_LOOPS = loops_by_rule()


def energies(letters: np.ndarray, loops: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Energies of sequences of one length, a row of base numbers each (4: no base); all rows are folded side by side."""
    return window_energies(letters, [(0, letters.shape[1])], loops)[0]


def window_energies(letters: np.ndarray, windows: list[tuple[int, int]], loops: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    """Energies of the parts [from, to) of sequences of one length."""
    parts = [_window_energies(letters[k : k + AT_ONCE], windows, loops) for k in range(0, max(1, len(letters)), AT_ONCE)]
    return [np.concatenate(x) for x in zip(*parts)]


def _window_energies(letters: np.ndarray, windows: list[tuple[int, int]], loops: dict[str, np.ndarray] | None) -> list[np.ndarray]:
    """The same for a few rows.

    Tables are kept by span, a row a first base, so all pairs of one span are extended at once.  What lies inside a pair does not
    depend on what is outside, so all windows share the tables of the whole.  A large interior loop is a term of its outer pair, one of
    its inner pair and a constant of its sides; only stacks, bulges of one base and loops with tables are looked up by both pairs.
    """
    small = _LOOPS | (loops or {})
    rows, n = letters.shape
    code = np.full((n + 2, rows), 4, np.int64)  # no base at either end
    code[1:-1] = letters.T
    at = lambda i, w: code[i + 1 : i + 1 + w]
    none = lambda span: np.full((max(0, n - span), rows), _NO, np.int32)
    pair, multi, ends = ({span: none(span) for span in range(n)} for _ in range(3))
    inner_kind, weak_inside, beside_inside, outside = {}, {}, {}, {}
    au = lambda k: np.where(k > 1, np.int32(TERMINAL_AU), np.int32(0))

    for span in range(4, n):
        w = n - span
        first, last, after, before = at(0, w), at(span, w), at(1, w), at(span - 1, w)
        kind, back = _KIND[first, last], _KIND[last, first]
        paired = kind >= 0
        kind, back = np.maximum(kind, 0), np.maximum(back, 0)
        size, end = span - 1, au(kind)
        best = _length(HAIRPIN, size) + (end if size == 3 else _MISMATCH[kind, after, before])
        if size == 4:
            best = best + _TETRALOOP[tuple(at(k, w) for k in range(span + 1))]
        bulges = loops_ = None
        for a in range(min(span - 6, LONGEST_LOOP) + 1):
            for b in range(min(span - 6, LONGEST_LOOP) - a + 1):
                inside, own = span - 2 - a - b, slice(1 + a, 1 + a + w)
                if a + b < 2 and not (a and b):
                    best = np.minimum(best, (_length(BULGE, a + b) if a + b else 0) + _STACK[kind, inner_kind[inside][own]] + pair[inside][own])
                elif not a or not b:
                    x = weak_inside[inside][own] + _length(BULGE, a + b)
                    bulges = x if bulges is None else np.minimum(bulges, x, out=bulges)
                elif a <= 2 and b <= 2:
                    inner, five, three = inner_kind[inside][own], [at(1 + k, w) for k in range(a)], [at(span - b + k, w) for k in range(b)]
                    if a == 1 and b == 1:
                        x = small["1x1"][kind, inner, five[0], three[0]]
                    elif a == 1:
                        x = small["2x1"][kind, inner, five[0], three[0], three[1]]
                    elif b == 1:
                        x = small["2x1"][inner, kind, three[0], five[0], five[1]]
                    else:
                        x = small["2x2"][kind, inner, five[0], five[1], three[0], three[1]]
                    best = np.minimum(best, x + pair[inside][own])
                else:
                    x = beside_inside[inside][own] + (_length(INTERIOR, a + b) + min(MOST_ASYMMETRY, ASYMMETRY * abs(a - b)))
                    loops_ = x if loops_ is None else np.minimum(loops_, x, out=loops_)
        if bulges is not None:
            best = np.minimum(best, bulges + end)
        weak = np.where(kind > 1, np.int32(INTERIOR_AU), np.int32(0))
        if loops_ is not None:
            best = np.minimum(best, loops_ + (weak + _BESIDE[after, before]))
        split = None
        for m in range(4, span - 6):
            x = multi[m][1 : 1 + w] + multi[span - m - 3][m + 2 : m + 2 + w]
            split = x if split is None else np.minimum(split, x, out=split)
        if split is not None:
            best = np.minimum(best, split + (MULTI_CLOSE + MULTI_BRANCH + _DANGLE5[back, before] + _DANGLE3[back, after] + au(back)))
        pair[span] = np.where(paired, best, np.int32(_NO))

        inner_kind[span] = back
        weak_inside[span] = pair[span] + au(back)
        around = _BESIDE[at(span + 1, w), at(-1, w)]
        beside_inside[span] = pair[span] + (np.where(back > 1, np.int32(INTERIOR_AU), np.int32(0)) + around)
        # Dangling ends and terminal penalty of a pair seen from outside.
        outside[span] = (_DANGLE5[kind, at(-1, w)], _DANGLE3[kind, at(span + 1, w)], end)
        best = np.minimum(multi[span - 1][1 : 1 + w], multi[span - 1][:w]) + np.int32(MULTI_FREE)
        best = np.minimum(best, np.where(paired, pair[span] + (MULTI_BRANCH + sum(outside[span])), np.int32(_NO)))
        for m in range(4, span - 4):
            best = np.minimum(best, multi[m][:w] + multi[span - m - 1][m + 1 : m + 1 + w])
        multi[span] = np.minimum(best, np.int32(_NO))

    out = []
    for start, stop in windows:
        open_ = [np.zeros(rows, np.int32)]
        for j in range(start, stop):
            best = open_[-1]
            for i in range(start, j - 3):
                five, three, end = (x[i] for x in outside[j - i])
                best = np.minimum(best, open_[i - start] + pair[j - i][i] + end + (five if i > start else 0) + (three if j + 1 < stop else 0))
            open_.append(best)
        out.append(open_[-1] / 10.0)
    return out


def energy(sequence: str, loops: dict[str, np.ndarray] | None = None) -> float:
    """Minimum free energy in kcal/mol; 0 for sequences that do not fold."""
    return float(_energies_of(pd.Series([sequence]), loops)[0])


def _energies_of(sequences: pd.Series, loops: dict[str, np.ndarray] | None = None) -> pd.Series:
    """Energies in kcal/mol; sequences of one length are folded together, null stays null."""
    return _energies_within(sequences, lambda n: [(0, n)], loops)[0]


def _energies_within(sequences: pd.Series, windows: Callable[[int], list[tuple[int, int]]], loops: dict[str, np.ndarray] | None = None) -> list[pd.Series]:
    """The same of the parts of each sequence that ``windows`` names for its length."""
    texts = sequences.str.upper().str.replace("T", "U")
    out = [pd.Series(np.nan, index=sequences.index) for _ in windows(0)]
    place = np.full(256, 4, np.int64)
    place[[ord(b) for b in _BASES]] = range(4)
    for n, group in texts.groupby(texts.str.len()):
        raw = np.frombuffer("".join(group).encode("ascii", "replace"), np.uint8).reshape(len(group), int(n))
        for column, found in zip(out, window_energies(place[raw], windows(int(n)), loops)):
            column[group.index] = found
    return out


def folding(guides: DataFrame, enzyme: Enzyme, shortest: int, loops: dict[str, np.ndarray] | None = None) -> DataFrame:
    """A column ``free_energy_n`` for each length from ``shortest`` to the guide's, nearest the PAM.

    A guide is folded once for all lengths.  ``loops`` replaces tables of ``loops_by_rule``, such as measured ones.
    """
    first, size = enzyme.compared
    lengths = range(shortest, size + 1)
    names = [f"free_energy_{n}" for n in lengths]

    def windows(length: int) -> list[tuple[int, int]]:
        return [(0, min(n, length)) if enzyme.five_prime else (min(size - n, length), length) for n in lengths]

    @F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in names]))
    def free_energies(sequences: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, _energies_within(sequences, windows, loops))), columns=names)

    if not names:
        return guides
    out = guides.withColumn("_energies", free_energies(F.substring("bases", first, size)))
    return out.withColumns({name: F.col("_energies")[name] for name in names}).drop("_energies")
