"""Whitening of embeddings from an exact scatter matrix.

The scatter of integer vectors is taken modulo several primes: a matrix product of residues is exact in
double precision for so many rows at a time, and residues of blocks and partitions add up. Chinese
remaindering of the sums gives the scatter as exact integers, whatever the offset of the entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm._common import dropped, ids_only, kind_of, staged, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
ROWS = 4096  # of a block; residues under 2**20 keep its products under 2**52
TOP = 1 << 20
LONGEST = (1 << 63) - 1


def primes(bound: int) -> list[int]:
    """The largest primes under 2**20, as many as their product needs to pass the bound."""
    out, p = [], TOP - 1
    while prod(out) <= bound:
        if all(p % d for d in range(3, isqrt(p) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def quantized(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (id, x) with floor(64 * c) + 1000000 for each entry; rows without a vector, or with null or non-finite entries, go."""
    big = float(1 << 62)  # past it the long is that bound
    rows = ids_only(vectors, id=vec_id, v=embedding).where("v is not null")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    whole = F.transform("v", lambda c: F.greatest(F.lit(-big), F.least(F.lit(big), F.floor(c.cast("double") * SCALE).cast("double"))).cast("long") + OFFSET)
    return rows.select("id", whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def scatter(fit: DataFrame, width: int, bound: int) -> np.ndarray:
    """Exact sums of products of the columns (1, x) over all rows, as a matrix of Python integers.

    `bound` is at least the absolute value of each sum. Each partition sends its residues, (width + 1)²
    numbers a prime; their sums, no more, come to the driver.
    """
    chosen = primes(2 * bound + 1)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(chosen), width + 1, width + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column("x").slice(at, ROWS))
                x = np.hstack([np.ones((len(x), 1), np.int64), x])
                for k, p in enumerate(chosen):
                    r = np.mod(x, p).astype(np.float64)
                    sums[k] = (sums[k] + np.mod(r.T @ r, p).astype(np.int64)) % p
        for k in range(len(chosen)):
            i = pa.array(np.arange(width + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, k, np.int32)), i, pa.array(list(sums[k]))], names=["k", "i", "row"])

    parts = fit.mapInArrow(residues, "k int, i int, row array<bigint>")
    cells = parts.select("k", "i", F.posexplode("row").alias("j", "r")).groupBy("k", "i", "j").agg(F.sum("r").alias("r"))
    total, modulus = np.zeros((width + 1, width + 1), object), prod(chosen)
    for c in cells.collect():  # (width + 1)² numbers a prime
        others = modulus // chosen[c["k"]]
        total[c["i"], c["j"]] += int(c["r"]) % chosen[c["k"]] * pow(others, -1, chosen[c["k"]]) * others
    return np.vectorize(lambda v: v % modulus - (modulus if v % modulus > modulus // 2 else 0), otypes=[object])(total)


class Whitening:
    """Mean, directions and scales that whiten vectors of one width. All of it is small: width² numbers."""

    def __init__(self, sums: np.ndarray, components: int) -> None:
        self.n = n = int(sums[0, 0])
        self.sums = [int(s) for s in sums[0, 1:]]
        self.whole, self.rest = (np.array(a, np.int64) for a in zip(*(divmod(s, n) for s in self.sums), strict=True))
        s = np.array(self.sums, object)
        central = n * sums[1:, 1:] - np.outer(s, s)  # n² times the covariance, exactly
        cov = np.vectorize(lambda v: v / (n * n), otypes=[float])(central)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        trace = int(np.trace(central)) / (n * n)
        real = values > values[0] * len(cov) * np.finfo(float).eps if len(values) else values > 0
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        self.explained = np.where(real, values / trace, 0.0) if trace else np.zeros(len(values))
        self.real = real & (values > 0)
        self.map = vectors * signs / np.sqrt(np.where(self.real, values, np.inf))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x - S/n is taken as (x - floor) - rest/n, so that only its last bit is rounded."""
        return ((x - self.whole) - self.rest / self.n) @ self.map

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over the entries of (n * x - S)², exactly; None where a long can't hold one."""
        near = x - self.whole
        most = max(abs(int(near.min())), abs(int(near.max()))) + 1 if near.size else 0
        if (self.n * most) ** 2 * max(1, x.shape[1]) <= LONGEST:
            return ((self.n * near - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(a) - b) ** 2 for a, b in zip(row, self.sums, strict=True)) for row in x]
        return [v if v <= LONGEST else None for v in exact]


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """A whitening fitted to the distinct vectors x, and the largest entry of the whitened ones' covariance minus the identity.

    The distinct vectors are found by a grouping with partial aggregation, so copies meet before the
    shuffle. None if there are no vectors, or only empty ones.
    """
    fit = staged(vectors.select("x").distinct())
    most = F.greatest(F.max(F.array_max("x")), -F.min(F.array_min("x")))
    n, width, bound = fit.agg(F.count("*"), F.max(F.size("x")), most).first()
    if not width:
        return None
    net = Whitening(scatter(fit, width, n * max(1, bound) ** 2), components)
    count = net.map.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = net.whitened(_matrix(batch.column("x").slice(at, ROWS)))
                w = np.hstack([np.ones((len(w), 1)), w])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count + 1, dtype=np.int32)), pa.array(list(total))], names=["i", "row"])

    cells = fit.mapInArrow(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((count + 1, count + 1))
    for c in cells.collect():  # (components + 1)² numbers
        total[c["i"], c["j"]] = c["v"]
    dropped(fit)
    mean = total[0, 1:] / n
    off = np.abs(total[1:, 1:] / n - np.outer(mean, mean) - np.eye(count))[np.ix_(net.real, net.real)]
    return net, float(off.max()) if off.size else 0.0


def whitened(vectors: DataFrame, *, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Vectors in the directions of the largest variance, each scaled to variance one.

    Returns for each row with a vector of finite entries, and each component: id, component (from 1, by
    falling variance), n (distinct vectors fitted), deviation, whitened, explained and identity_error.
    Each direction's largest entry is positive. Repeated rows and ids come out once each, null ids too;
    other columns are ignored. Vectors must have one length: those of another than most rows have (the
    larger, if two lengths are as frequent) are left out, and so are empty ones. Entries past 2**62
    count as that. A component without variance has whitened null and explained 0; deviation is null
    where a long can't hold it. An empty table gives an empty result.
    """
    rows = quantized(vectors, vec_id=vec_id, embedding=embedding).where(F.size("x") > 0)
    kind = kind_of(rows, "id")
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()  # the most frequent length
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == width["w"])
    net, error = fitted(rows, components)
    count = net.map.shape[1]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("x"))
                m, own = len(x), np.repeat(np.arange(len(x)), count)
                each = [
                    part.column("id").take(pa.array(own)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, net.n)),
                    pa.array(net.deviation(x), pa.int64()).take(pa.array(own)), pa.array(net.whitened(x).ravel(), mask=np.tile(~net.real, m)),
                    pa.array(np.tile(net.explained, m)), pa.array(np.full(m * count, error)),
                ]
                yield pa.RecordBatch.from_arrays(each, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened to sixteen components."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
