"""Column expressions over DNA strings and packed k-mers (two bits a base, first base highest)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
LETTERS = "abcdefghijklmnopqrstuvwxyz "
#: text_as_dna of lower-case text, byte by byte (bytes.translate).
TEXT_CODE = bytes.maketrans(LETTERS.encode(), (BASES * 7)[: len(LETTERS)].encode())


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(seq, BASES, "TGCA"))


def canonical(seq: Column | str) -> Column:
    return F.least(F.col(seq) if isinstance(seq, str) else seq, revcomp(seq))


def is_unambiguous(seq: Column) -> Column:
    """All characters are bases. `$` in a regex would let a trailing line end pass."""
    return ~seq.rlike("[^ACGT]")


def text_as_dna(text: Column | str) -> Column:
    """Letters and space become bases in turn; everything else stays and is ambiguous."""
    return F.translate(F.lower(text), LETTERS, (BASES * 7)[: len(LETTERS)])


def hash60(s: Column) -> Column:
    """The first 60 bits of MD5: the same number in any engine."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 15), 16, 10).cast("long")


def _digits(number: Column, n: int) -> list[Column]:
    return [F.substring(F.lit(BASES), F.shiftright(number, 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for i in reversed(range(n))]


def decode(kmer: Column | str, k: int) -> Column:
    """The bases of a packed k-mer; over 31 bases it is a decimal."""
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    if k <= 31:
        return F.concat(*_digits(kmer, k))
    unit = F.lit(Decimal(4**31))
    low = kmer % unit
    high = ((kmer - low) / unit).cast("long")
    return F.concat(*_digits(high, k - 31), *_digits(low.cast("long"), 31))


def rolling32(smer: Column, s: int, seeds: list[int]) -> Column:
    """The lesser of both strands' rolling hashes: seeds of the bases (A, C, G, T), turned left in 32 bits by their places, xor-ed."""

    def strand(letters: str, by) -> Column:
        out = F.lit(0).cast("long")
        for j in range(s):
            seed = F.element_at(F.array(*map(F.lit, seeds)), F.instr(F.lit(letters), F.substring(smer, j + 1, 1))).cast("long")
            n = by(j) % 32
            turned = F.shiftleft(seed, n).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftright(seed, 32 - n))
            out = out.bitwiseXOR(turned)
        return out

    return F.least(strand(BASES, lambda j: s - 1 - j), strand(BASES[::-1], lambda j: j))


def sketched(kmer_string: Column, fraction: float) -> Column:
    """FracMinHash: keeps a k-mer by its hash alone, the same ones everywhere."""
    if not fraction < 1:  # NaN keeps all
        return F.lit(True)
    return hash60(kmer_string) <= F.lit(int(max(fraction, 0.0) * (1 << 60)))
