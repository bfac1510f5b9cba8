"""One stream of random numbers that can be entered at any place.

Two multiplicative generators are combined (period about 2.3e18). A generator's n-th state is its
multiplier's n-th power times the seed, and a power is a product over the bits of n, so a row finds
its number from its place alone, inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: moduli and multipliers of the combined generator of L'Ecuyer (1988)
GENERATORS = ((2147483563, 40014), (2147483399, 40692))
BITS = 46  # places up to 7e13


def powers(modulus: int, multiplier: int) -> list[int]:
    """The multiplier's powers to one, two, four and so on."""
    return [pow(multiplier, 1 << i, modulus) for i in range(BITS)]


def seeds(seed: int) -> list[int]:
    return [seed % (m - 1) + 1 for m, _ in GENERATORS]


def uniform(place: Column, seed: int) -> Column:
    """The number in (0, 1) at a place of the stream."""
    states = []
    for (m, a), x in zip(GENERATORS, seeds(seed), strict=True):
        state = F.lit(x).cast("long")
        for i, p in enumerate(powers(m, a)):
            state = state * F.when(place.bitwiseAND(F.lit(1 << i)) != 0, F.lit(p)).otherwise(F.lit(1)).cast("long") % m
        states.append(state)
    top = GENERATORS[0][0]
    return (F.pmod(states[0] - states[1] - 1, F.lit(top - 1)) + 1) / F.lit(float(top))


def normal(place: Column, seed: int) -> Column:
    """The standard normal number at a place, from two of the stream's, by Box and Muller."""
    return F.sqrt(-2.0 * F.log(uniform(place * 2, seed))) * F.cos(uniform(place * 2 + 1, seed) * (2 * math.pi))
