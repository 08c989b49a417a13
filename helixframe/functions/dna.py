"""Column builders for nucleotide strings and 2-bit packed integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Counts and position lists of a target stop here.
COUNT_CAP = 32767


def encode(bases: Column) -> Column:
    """2 bits a base, A C G T as 0 to 3, the first base most significant; at most 31 bases."""
    return F.conv(F.translate(bases, BASES, "0123"), 4, 10).cast("bigint")


def decode(packed: Column, length: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), length, "0"), "0123", BASES)


def valid(bases: Column) -> Column:
    """Whether ``encode`` accepts the string: 1 to 24 bases and nothing else."""
    return F.length(bases).between(1, 24) & ~bases.rlike("[^ACGT]")


def flipped(bases: str) -> str:
    """Reverse complement of a Python string."""
    return bases.translate(str.maketrans(BASES, "TGCA"))[::-1]


def complement(bases: Column) -> Column:
    """Upper- and lower-case bases are complemented; other letters stay."""
    return F.translate(bases, "ACGTacgt", "TGCAtgca")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def rna_complement(bases: Column) -> Column:
    return F.translate(bases, "ACGTUacgtu", "UGCAAugcaa")


def gc(bases: Column) -> Column:
    """Share of C and G in the whole string, either case."""
    return F.length(F.regexp_replace(bases, "[^CGcg]", "")) / F.length(bases)


def mismatches(a: Column, b: Column, length: int) -> Column:
    """Differing bases of two packed strings of at most 31 bases."""
    x = a.bitwiseXOR(b)
    low = int("01" * length, 2)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(low).cast("bigint")))


def text_mismatches(a: Column, b: Column) -> Column:
    """Differing places of two strings of one length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def bit_string(packed: Column) -> Column:
    return F.lpad(F.bin(packed), 64, "0")


def entropy(bases: Column) -> Column:
    """Shannon entropy in bits over the four bases."""
    total = F.length(bases).cast("double")
    part = F.lit(0.0)
    for base in BASES:
        share = (F.length(bases) - F.length(F.replace(bases, F.lit(base), F.lit("")))) / total
        part = part - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return part


def homopolymer(bases: Column) -> Column:
    """Longest run of one letter; strings of fewer than two letters give 0."""
    runs = F.transform(F.regexp_extract_all(bases, F.lit(r"((.)\2*)"), F.lit(1)), F.length)
    return F.when(F.length(bases) < 2, 0).otherwise(F.array_max(runs))


def kmers(index: Column, k: int) -> Column:
    """The ``index``-th string of k bases in lexicographic order."""
    return decode(index, k)


def overlaps(start: Column, stop: Column, other_start: Column, other_stop: Column) -> Column:
    """Half-open intervals on one contig that share a base."""
    return (start < other_stop) & (other_start < stop)


def pack_position(contig: Column, start: Column, length: Column, forward: Column) -> Column:
    """Strand 4 bits, length 8, contig 20, position 32; null for contigs of higher numbers."""
    strand = F.when(forward, 1).otherwise(0).cast("bigint")
    wide = lambda c, n: F.shiftleft(c.cast("bigint"), n)
    packed = wide(strand, 60).bitwiseOR(wide(length, 52)).bitwiseOR(wide(contig, 32)).bitwiseOR(start.cast("bigint"))
    return F.when(contig.between(0, (1 << 20) - 1), packed)


def unpack_position(packed: Column) -> dict[str, Column]:
    part = lambda n, bits: F.shiftrightunsigned(packed, n).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return {"contig_idx": part(32, 20), "start": part(0, 32), "length": part(52, 8), "fwd": part(60, 4) == 1}


def centred(context: Column, length: Column) -> Column:
    """Where a guide starts in its context: both flanks are alike."""
    return F.floor((F.length(context) - length) / 2).cast("int")


def median(values: Column) -> Column:
    """Middle of an array, the mean of the two middle ones if their number is even."""
    s = F.sort_array(values)
    n = F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(s, low) + F.try_element_at(s, high)) / 2.0)


def draw(*parts: Column) -> Column:
    """A number from 0 to 2^52 - 1 by the MD5 of the parts, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("bigint")
