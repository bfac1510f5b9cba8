"""Small literal tables: filter kernels and orthonormal bases. Their size follows parameters, never data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def gaussian(radius: int, sigma: float) -> list[tuple[int, int, float]]:
    """Normalized weights (dy, dx, w); sigma 0 gives equal weights."""
    span = range(-radius, radius + 1)
    raw = [(y, x, math.exp(-(y * y + x * x) / (2 * sigma * sigma)) if sigma else 1.0) for y in span for x in span]
    total = sum(w for *_, w in raw)
    return [(y, x, w / total) for y, x, w in raw]


def binomial() -> list[tuple[int, int, int]]:
    """The integer 5 x 5 kernel 1-4-6-4-1, not normalized, for guides that stay exact."""
    row = [math.comb(4, k) for k in range(5)]
    return [(i - 2, j - 2, row[i] * row[j]) for i in range(5) for j in range(5)]


def box(radius: int, *, half_open: bool = False) -> list[tuple[int, int]]:
    """Offsets of a square window; half open: without the last row and column."""
    span = range(-radius, radius + (0 if half_open else 1))
    return [(y, x) for y in span for x in span]


def bessel_i0(x: float, terms: int = 40) -> float:
    return sum((x * x / 4) ** k / math.factorial(k) ** 2 for k in range(terms))


def kaiser(n: int, beta: float = 2.0) -> list[tuple[int, int, float]]:
    """Outer product of two Kaiser windows."""
    row = [bessel_i0(beta * math.sqrt(max(0.0, 1 - (2 * k / (n - 1) - 1) ** 2))) / bessel_i0(beta) for k in range(n)]
    return [(i, j, row[i] * row[j]) for i in range(n) for j in range(n)]


def dct(n: int) -> list[list[float]]:
    """Orthonormal DCT-II: coefficient k of sample i."""
    scale = [math.sqrt((1.0 if k == 0 else 2.0) / n) for k in range(n)]
    return [[scale[k] * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def haar(n: int) -> tuple[list[list[float]], list[list[float]]]:
    """Analysis and synthesis matrices of the Haar transform to full depth.

    Of n samples there are floor(log2 n) levels; an odd number of samples repeats its last one, so
    such a transform has more coefficients than samples.
    """
    half = math.sqrt(0.5)
    low = [[1.0 if i == j else 0.0 for j in range(n)] for i in range(n)]
    details: list[list[list[float]]] = []
    sizes = []
    for _ in range(n.bit_length() - 1):
        sizes.append(len(low))
        if len(low) % 2:
            low = [*low, low[-1]]
        pairs = list(zip(low[::2], low[1::2], strict=True))
        details.append([[half * (a - b) for a, b in zip(x, y, strict=True)] for x, y in pairs])
        low = [[half * (a + b) for a, b in zip(x, y, strict=True)] for x, y in pairs]
    analysis = [*low, *(row for level in reversed(details) for row in level)]
    count = len(analysis)
    unit = [[1.0 if i == j else 0.0 for j in range(count)] for i in range(count)]
    at = len(low)
    back = unit[:at]
    for size in reversed(sizes):
        own = unit[at : at + len(back)]
        at += len(back)
        back = [[half * (a + s * b) for a, b in zip(x, y, strict=True)] for x, y in zip(back, own, strict=True) for s in (1, -1)][:size]
    return analysis, back


def basis(spark: SparkSession, matrices: dict[int, list[list[float]]], names: tuple[str, str, str, str]) -> DataFrame:
    """Matrices by group size as a table (size, row, column, value)."""
    rows = [(n, r, c, v) for n, m in matrices.items() for r, line in enumerate(m) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, f"{names[0]} int, {names[1]} int, {names[2]} int, {names[3]} double")
