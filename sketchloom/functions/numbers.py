"""Plain-Python argument helpers shared by the command line and the operators."""

from __future__ import annotations

import argparse
import math
import re


def parse_k_range(text: str) -> list[int]:
    """``"10-21-2"`` to ``[10, 12, ..., 20]``; the step defaults to 1 and one number is a range of one."""
    found = re.fullmatch(r"(\d+)(?:-(\d+)(?:-(\d+))?)?", text.strip())
    if not found:
        raise argparse.ArgumentTypeError(f"'{text}' is not a range; expected '5-10-2'")
    first = int(found[1])
    last = int(found[2] or first)
    step = int(found[3] or 1)
    if step < 1 or last < first:
        raise argparse.ArgumentTypeError(f"'{text}' is an empty range")
    return list(range(first, last + 1, step))


def cap_k_range(ks: list[int], ksize: int) -> list[int]:
    """Keep the lengths a database sketched at ``ksize`` can answer."""
    kept = sorted({k for k in ks if k <= ksize})
    if not kept:
        raise ValueError(f"no shingle length in {ks} is at most {ksize}")
    return kept


def restricted_float(text: str) -> float:
    value = float(text)
    if not 0.0 <= value < 1.0:
        raise argparse.ArgumentTypeError(f"{value} is not in [0.0, 1.0)")
    return value


def clamp_location(location: int, ks: list[int]) -> int:
    """Which of ``ks`` carries the threshold: past the end means the last one, -1 is the default."""
    return len(ks) - 1 if location >= len(ks) else location


def is_prime(number: int) -> bool:
    if number < 2:
        return False
    return all(number % d for d in range(2, math.isqrt(number) + 1))


def prime_at_most(target: int) -> int:
    """Largest prime not above ``target``; 1 for a target of 1."""
    if target == 1:
        return 1
    candidate = target
    while candidate > 1 and not is_prime(candidate):
        candidate -= 1
    if candidate < 2:
        raise ValueError(f"no prime at or below {target}")
    return candidate


def expected_threshold(k: int, coverage: float, fp_rate: float, confidence: float) -> float:
    """Containment that a set of the given coverage exceeds with the given confidence (sketch size ``k``)."""
    if coverage <= 0:
        return 0.0
    spread = math.sqrt(-2 * math.log(1 - confidence) * (coverage + fp_rate) / (coverage * coverage * k))
    return max(coverage * (1 - spread), 0.0)


def chunks(items: list, size: int):
    """Consecutive slices of ``items`` of at most ``size``."""
    return (items[at : at + size] for at in range(0, len(items), size))
