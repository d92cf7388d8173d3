"""Validation and normalisation of parameters; errors are ValueErrors on the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence

MAX_DEPTH = 65535
MAX_GROUPS = 128


def check_k_s(k: int, s: int) -> None:
    if not 3 <= k <= 61 or k % 2 == 0:
        raise ValueError(f"k must be odd and from 3 to 61, not {k}")
    if s % 2 == 0 or not 1 <= s < k or s > 32:
        raise ValueError(f"s must be odd, at least 1, below k and at most 32, not {s}")


def check_fraction(fraction: float) -> float:
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction must be above 0 and at most 1, not {fraction}")
    return fraction


def check_sample_names(names: Sequence[str], n_samples: int | None = None) -> None:
    if n_samples is not None and len(names) != n_samples:
        raise ValueError(f"{len(names)} sample names for {n_samples} samples")
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"Duplicate sample names: {', '.join(twice)}")


def normalise_thresholds(thresholds: Sequence[int]) -> list[int]:
    """Ascending, once each, without those that every found k-mer meets."""
    if any(t > MAX_DEPTH for t in thresholds):
        raise ValueError(f"abundance thresholds go to {MAX_DEPTH}")
    return sorted({t for t in thresholds if t > 1})


def parse_bases(text: str) -> int:
    """An integer with K, M, G or T."""
    m = re.fullmatch(r"(\d+)([KMGT]?)", text.strip().upper())
    if not m:
        raise ValueError(f"not a number of bases: {text!r}")
    return int(m[1]) * 1000 ** " KMGT".index(m[2] or " ")


def check_groups(n: int) -> None:
    if n > MAX_GROUPS:
        raise ValueError(f"Too many groups: {n}; at most {MAX_GROUPS}")
