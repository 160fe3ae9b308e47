"""Default parameters and the sizing of Bloom filters."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1_048_576
# Upper sizes in MiB (exclusive) and their k; thresholds by k; random-hit probability up to k.
K_BY_MIB = ((10, 15), (20, 16), (50, 17), (100, 18), (500, 19))
K_LARGEST = 20
THRESHOLD_BY_K = {15: 0.4, 16: 0.3, 17: 0.3, 18: 0.3, 19: 0.4, 20: 0.3}
THRESHOLD_OTHER = 0.4
HIT_PROBABILITY = ((12, 0.51038), (15, 0.05569), (18, 0.00636))
HIT_PROBABILITY_OTHER = 0.001057
CLI_ERROR_RATE, API_ERROR_RATE = 0.0005, 0.005
MAX_HASHES = 20


def _case(pairs: list[tuple[Column, object]], other: object) -> Column:
    out = F.when(pairs[0][0], F.lit(pairs[0][1]))
    for cond, value in pairs[1:]:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(other))


def kmer_size(n_bytes: Column) -> Column:
    return _case([(n_bytes < mib * MIB, k) for mib, k in K_BY_MIB], K_LARGEST)


def match_threshold(k: Column) -> Column:
    return _case([(k == n, t) for n, t in THRESHOLD_BY_K.items()], THRESHOLD_OTHER)


def hit_probability(k: Column) -> Column:
    return _case([(k <= n, p) for n, p in HIT_PROBABILITY], HIT_PROBABILITY_OTHER)


def default_k(n_bytes: int) -> int:
    return next((k for mib, k in K_BY_MIB if n_bytes < mib * MIB), K_LARGEST)


def default_threshold(k: int) -> float:
    return THRESHOLD_BY_K.get(k, THRESHOLD_OTHER)


def default_hit_probability(k: int) -> float:
    return next((p for n, p in HIT_PROBABILITY if k <= n), HIT_PROBABILITY_OTHER)


def passes_as_prime(n: int) -> bool:
    """The compatible test, which is not a test of primality.

    Odd divisors come in triples 3 5 7, 11 13 15, 19 21 23, ...: those of the form 8i + 1 are never
    tried, so 289 = 17 * 17 passes. A triple counts while its first number is below the root; the
    number that ends the search decides, on the low 32 bits of n only. 3 is turned away, 1 let in.
    """
    if n % 2 == 0:
        return n == 2
    root = math.isqrt(n)
    ends = next(d for d in itertools.count(3, 8) if d >= root or n % d == 0)
    if any(n % (d + 2) == 0 or n % (d + 4) == 0 for d in range(3, ends, 8)):
        return False
    low = (n + 2**31) % 2**32 - 2**31
    return low % 2**64 % ends != 0


def next_size(n: int) -> int:
    """The least odd number from n that ``passes_as_prime``."""
    return next(m for m in itertools.count(n | 1, 2) if passes_as_prime(m))


@dataclass(frozen=True)
class Sizing:
    bits: int
    n_hashes: int
    capacity: int
    error_rate: float


def sizing(capacity: int, error_rate: float) -> Sizing:
    """Bits and hashes for a capacity. The logarithm of the error rate is cut to a whole number first,
    bits are a whole 13 / 9 of capacity times hashes, and the hashes follow from the bits again."""
    if capacity < 1 or not 0 < error_rate < 1:
        raise ValueError("capacity must be positive and the error rate between 0 and 1")
    hashes = int(int(math.log(error_rate)) / math.log(0.5))
    bits = next_size(13 * capacity * hashes // 9) if hashes else 0
    n = 9 * bits // (13 * capacity)
    if not 1 <= n <= MAX_HASHES or bits < 1:
        raise ValueError(f"an error rate of {error_rate} gives {n} hashes; 1 to {MAX_HASHES} are possible")
    return Sizing(bits, n, capacity, error_rate)
