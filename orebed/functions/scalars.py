"""Column functions and driver-side number theory shared by the operators."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 5.0) -> Column:
    """``c`` within [low, high]; null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def pearson(x: str, y: str) -> Column:
    """Pearson correlation aggregate, 0 for a single pair or no variance, to 10 decimals."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.round(F.coalesce(r, F.lit(0.0)), 10)


def in_year(date: Column, year: int) -> Column:
    """Whether a date string (``YYYY-...``) or timestamp lies in ``year``."""
    return F.substring(date.cast("string"), 1, 4) == str(year)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def next_prime(n: int) -> int:
    """The least prime above ``n``."""
    n += 1
    while not is_prime(n):
        n += 1
    return n


def hash_parameters(count: int, bins: int, seed: int = 0) -> list[tuple[int, int, int, int]]:
    """(a, b, p, m) of ``count`` hash functions ((a x + b) mod p) mod m with m the prime above ``bins``
    and p a prime above m, from a seeded generator.  a is small enough for 64-bit products."""
    rng = random.Random(seed)
    m = next_prime(bins)
    top = min((1 << 62) // (bins + 1), 1 << 30)
    return [(rng.randrange(1, top), rng.randrange(0, top), next_prime(m + rng.randrange(1, m)), m) for _ in range(count)]


def token_index(token: Column) -> Column:
    """A 32-bit index of a string, the first 8 digits of its MD5: no global numbering is needed."""
    return F.conv(F.substring(F.md5(token.cast("string")), 1, 8), 16, 10).cast("long")
