"""Random guides: plain, patterned, and made distinct."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.enzymes import Enzyme
from helixframe.operators.sites import unidirectional

IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def _draw(seed: int, slot: str, letters: str) -> Column:
    """A letter chosen by a hash of the row, so that reruns agree."""
    n = (dna.draw(F.lit(f"{seed}:{slot}:"), F.col("id").cast("string")) % len(letters)).cast("int")
    return F.substring(F.lit(letters), n + 1, F.lit(1))


def pattern(tokens: str, seed: int, length: int | None = None) -> Column:
    """Comma-separated tokens: an IUPAC letter; with a number its base is drawn once; with ``-`` the complement of that is used.

    A number belongs to one letter, a complement to a number that has a token of its own, and there are ``length`` tokens.
    """
    parts, slots, parsed = [], {}, [re.fullmatch(r"([A-Za-z])(\d*)(-?)", t.strip()) for t in tokens.split(",")]
    if length is not None and len(parsed) != length:
        raise ValueError(f"{len(parsed)} tokens for {length} bases")
    for token, found in zip(tokens.split(","), parsed):
        if not found or found[1].upper() not in IUPAC or found[3] and not found[2]:
            raise ValueError(f"{token!r} is no token of a pattern")
        if found[2] and not found[3] and slots.setdefault(found[2], found[1].upper()) != found[1].upper():
            raise ValueError(f"slot {found[2]} has the letters {slots[found[2]]} and {found[1]}")
    for k, found in enumerate(parsed):
        if found[3] and found[2] not in slots:
            raise ValueError(f"{found[0]} has no token {found[0][:-1]} to complement")
        letters = slots[found[2]] if found[2] else found[1].upper()
        letter = _draw(seed, found[2] or f"own{k}", IUPAC[letters])
        parts.append(dna.complement(letter) if found[3] else letter)
    return F.concat(*parts)


def random_guides(
    spark: SparkSession, enzyme: Enzyme, count: int, seed: int = 1, left: int = 0, right: int = 0, tokens: str | None = None,
    one_site: bool = False, duplicates: bool = False, effort: int = 50,
) -> DataFrame:
    """``count`` guides (id, seq) with random context, by the smallest ids; at most ``effort`` times as many are drawn.

    Twice as many as wanted are drawn first, and more only where too few of them are good.
    """
    free = enzyme.length - len(enzyme.pams[0])
    body = pattern(tokens or ",".join("N" * free), seed, free)
    pam = F.element_at(F.array(*[F.lit(p) for p in enzyme.pams]), (dna.draw(F.lit(f"{seed}:pam:"), F.col("id").cast("string")) % len(enzyme.pams) + 1).cast("int"))
    site = F.concat(pam, body) if enzyme.five_prime else F.concat(body, pam)
    around = lambda n, name: F.concat(F.lit(""), *[_draw(seed, f"{name}{k}", "ACGT") for k in range(n)])
    checked, times = one_site or not duplicates, 2
    while True:
        times = min(times, effort) if checked else 1
        rows = spark.range(count * times).select("id", F.concat(around(left, "l"), site, around(right, "r")).alias("seq"))
        if one_site:
            rows = unidirectional(rows, enzyme, "id")
        if not duplicates:
            rows = rows.groupBy("seq").agg(F.min("id").alias("id"))
        if not checked or times == effort or rows.count() >= count:
            return rows.select("id", "seq").orderBy("id").limit(count)
        times *= 5
