"""Reproducible integer draws.

Every draw is a function of (seed, sample id, attempt), so a sample does not
depend on partitioning, retries or run order, and plain SQL can repeat it.
All products stay below 2**63, which ANSI mode requires.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixing function.
PRIME = 2147483647
ID_FACTOR = 48271
SEED_FACTOR = 69621
STEP_FACTOR = 16807
SHIFT = 12345
SECOND_FACTOR = 39373
SECOND_SHIFT = 1013904223
HIGH_FACTOR = 40692
SECOND_WORD = 2_000_003


def _long(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("bigint")


def mix(sample_id: Column, seed: Column | int, step: Column | int = 0) -> Column:
    """A pseudo-random integer in ``[0, PRIME)`` from all bits of the sample id."""
    prime = _long(PRIME)
    linear = (
        F.pmod(_long(sample_id), prime) * _long(ID_FACTOR)
        + F.pmod(F.shiftright(_long(sample_id), 30), prime) * _long(HIGH_FACTOR)
        + _long(seed) * _long(SEED_FACTOR)
        + _long(step) * _long(STEP_FACTOR)
        + _long(SHIFT)
    )
    second = F.pmod(F.pmod(linear, prime) * _long(SECOND_FACTOR) + _long(SECOND_SHIFT), prime)
    return F.pmod(second * (F.pmod(second, _long(65536)) + _long(1)), prime)


def draw(sample_id: Column, seed: Column | int, step: Column | int, pool_size: Column | int) -> Column:
    """A uniform draw from ``[0, pool_size)``."""
    return F.pmod(mix(sample_id, seed, step), _long(pool_size))


def point(sample_id: Column, seed: int, step: Column | int, total: Column | int) -> Column:
    """A uniform draw from ``[0, total)`` for any positive bigint ``total``.

    Two words of :func:`mix` make a number of 62 bits, u; the draw is floor(u x total / PRIME^2) in whole numbers, so the
    smallest of very unequal shares can be drawn, and SQL can repeat it.
    """
    return scaled(*words(sample_id, seed, step), total)


def words(sample_id: Column, seed: int, step: Column | int) -> tuple[Column, Column]:
    """The two words of :func:`point`."""
    return mix(sample_id, seed, step), mix(sample_id, seed + SECOND_WORD, step)


def scaled(first: Column, second: Column, total: Column | int) -> Column:
    """The point below ``total`` of two words, in whole numbers below 2**63."""
    size, prime = _long(total), _long(PRIME)
    # With total = whole x PRIME + rest: floor(second x total / PRIME), then floor((first x total + low) / PRIME).
    whole, rest = F.call_function("div", size, prime), F.pmod(size, prime)
    low = second * whole + F.call_function("div", second * rest, prime)
    carry = F.call_function("div", first * rest + F.pmod(low, prime), prime)
    return first * whole + F.call_function("div", low, prime) + carry
