"""Nucleases: where their PAM lies and which bases of a target are compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLIP = str.maketrans("ACGT", "TGCA")


@dataclass(frozen=True)
class Enzyme:
    name: str
    index: int
    length: int
    five_prime: bool
    #: PAM letters as they end (3' PAM) or begin (5' PAM) a target; N is left out.
    pams: tuple[str, ...]
    guide: int

    @property
    def compared(self) -> tuple[int, int]:
        """First base (from 1) and number of the compared bases."""
        return (self.length - self.guide + 1, self.guide) if self.five_prime else (1, self.guide)

    @property
    def cas9(self) -> bool:
        return not self.five_prime

    def key(self, bases: Column) -> Column:
        return F.substring(bases, *self.compared)

    @property
    def halves(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """Length and shift of both halves of the packed compared bases."""
        low = self.guide // 2
        return (self.guide - low, 2 * low), (low, 0)

    def half(self, enc: Column, k: int) -> Column:
        """Half ``k`` of the packed compared bases, a number whose order is that of the bases."""
        size, shift = self.halves[k]
        return F.shiftrightunsigned(enc, shift).bitwiseAND(F.lit((1 << 2 * size) - 1).cast("bigint"))

    def pam(self, fwd: bool) -> tuple[int, tuple[str, ...]]:
        """Where in a window of either strand the PAM lies (from 0), and the letters that it may have there."""
        pams = self.pams if fwd else tuple(p.translate(_FLIP)[::-1] for p in self.pams)
        return (0 if self.five_prime == fwd else self.length - len(pams[0])), pams

    def bin(self, bases: Column, bin_size: int = 7) -> Column:
        """The first bases in traversal order: behind a 5' PAM, else the first of all."""
        return F.substring(bases, self.length - self.guide + 1 if self.five_prime else 1, bin_size)

    def order(self, bases: Column, bin_size: int = 7) -> list[Column]:
        """The order in which targets are met: by bases, with a 5' PAM by the bin behind it first."""
        return [self.bin(bases, bin_size), bases] if self.five_prime else [bases]


#: Name, number, target length, PAM side, PAMs, compared bases.
ENZYMES = {
    e.name: e
    for e in (
        Enzyme("CPF1", 1, 24, True, ("TTT",), 20),
        Enzyme("SPCAS9", 2, 23, False, ("GG", "AG"), 20),
        Enzyme("SPCAS9NGG", 3, 23, False, ("GG",), 20),
        Enzyme("SPCAS9NAG", 4, 23, False, ("AG",), 20),
        Enzyme("SPCAS919", 5, 22, False, ("GG", "AG"), 19),
        Enzyme("SPCAS9NGG19", 6, 22, False, ("GG",), 19),
    )
}


def enzyme(name: str) -> Enzyme:
    if name.upper() not in ENZYMES:
        raise ValueError(f"unknown enzyme {name!r}; known are {', '.join(ENZYMES)}")
    return ENZYMES[name.upper()]
