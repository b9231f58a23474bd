"""How many sampled k-mers two fragments of an identity share at least."""

from __future__ import annotations

import math

#: Quantiles of the normal distribution, by the share of true pairs to be kept.
NORMAL_QUANTILES = {0.95: 1.645, 0.975: 1.96, 0.99: 2.33}


def _shares(length: int, k: int, scale: int, identity: float) -> tuple[int, float]:
    """Number of k-mers, and the probability that one is both sampled and unchanged."""
    return length - k + 1, min(1.0, identity**k / max(scale, 1))


def least_shared_normal(length: int, k: int, scale: int, identity: float, kept: float = 0.95) -> int:
    n, p = _shares(length, k, scale, identity)
    return max(1, math.floor(n * p - NORMAL_QUANTILES[kept] * math.sqrt(n * p))) if n > 0 else 1


def least_shared(length: int, k: int, scale: int, identity: float, kept: float = 0.99) -> int:
    """The smallest count whose binomial distribution function exceeds 1 - kept: at least kept of the true pairs reach it."""
    n, p = _shares(length, k, scale, identity)
    if n <= 0 or p <= 0:
        return 1
    if p == 1:
        return n
    total, term = 0.0, n * math.log1p(-p)  # the logarithm of the probability of count
    for count in range(n + 1):
        total += math.exp(term)
        if total > 1 - kept:
            return max(1, count)
        term += math.log((n - count) / (count + 1)) + math.log(p / (1 - p)) if count < n else 0
    return n
