"""Small sequences of our own."""

from __future__ import annotations

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def revcomp(s: str) -> str:
    return s.translate(COMPLEMENT)[::-1]


def random_dna(n: int, seed: int) -> str:
    """Letters from a linear congruential generator."""
    x, out = seed | 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("ACGT"[x >> 33 & 3])
    return "".join(out)


def fasta(records) -> str:
    return "".join(f">{name}\n{seq}\n" for name, seq in records)


def fastq(records) -> str:
    return "".join(f"@{name}\n{seq}\n+\n{'@' * len(seq)}\n" for name, seq in records)
