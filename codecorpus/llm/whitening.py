"""Embedding whitening by bit-sliced scatter.

Vectors become whole numbers.  Each dimension is shifted to start at zero and cut into bit planes; a
plane of 64 rows is one machine word.  The popcount of the AND of two planes is the number of rows
in which both bits are set, so popcounts weighted by powers of two give every cross-product exactly.
Sums, cross-products and their centring are whole numbers up to the last step, the eigenvectors of a
matrix whose size is the square of the dimensions and does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.frames import only
from codecorpus.session import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows whose bit planes are in memory at a time; a multiple of 64.
BLOCK_ROWS = 4096


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(_id, _x): usable vectors as whole numbers, floor(64 * entry) + 1,000,000.

    Vectors that are null, empty, or hold a null or an entry that is not finite are left out.
    """
    rows = only(vectors, _id=id_column, _c=vector_column)
    entry = F.col("_c").cast("array<double>")
    finite = F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    )
    whole = F.transform(entry, lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long"))
    return rows.where((F.size("_c") > 0) & finite).select("_id", whole.alias("_x"))


def common_length(rows: DataFrame) -> DataFrame:
    """Rows whose vector has the most frequent length; of equally frequent ones the longest."""
    counted = rows.groupBy(F.size("_x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.orderBy(F.desc("n"), F.desc("length")).first()
    return rows.where(F.size("_x") == F.lit(best["length"] if best else 0))


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """Planes (dimension, bit, word) of a block of rows of whole numbers from 0."""
    n, dims = shifted.shape
    padded = np.zeros((-(-n // 64) * 64, dims), np.uint64)
    padded[:n] = shifted
    planes = np.empty((dims, bits, len(padded) // 64), np.uint64)
    for bit in range(bits):
        ones = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        planes[:, bit] = np.packbits(np.ascontiguousarray(ones.T), axis=1).view(np.uint64)
    return planes


def plane_counts(planes: np.ndarray) -> np.ndarray:
    """(power, i, j) → rows with bit a of i and bit b of j set, over all a + b = power; i <= j."""
    dims, bits, _ = planes.shape
    counts = np.zeros((2 * bits - 1, dims, dims), np.int64)
    for i in range(dims):
        for a in range(bits):
            both = np.bitwise_count(planes[i, a] & planes[i:]).sum(axis=2, dtype=np.int64)
            for b in range(bits):
                counts[a + b, i, i:] += both[:, b]
    return counts


@dataclass
class Scatter:
    """Exact sums of the whole-number vectors and what follows from them."""

    n: int
    sums: list[int]
    centred: list[list[int]]  # n * sum(x_i * x_j) - S_i * S_j
    values: np.ndarray  # falling
    axes: np.ndarray  # one row per component

    @property
    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        return np.array([[float(Fraction(c, square)) for c in row] for row in self.centred])


def scatter(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Scatter | None:
    """Sums, covariance and eigenvectors of the vectors of ``quantised``; None without rows.

    Two passes: ranges and sums per dimension, then popcounts of the bit planes.  Every task adds
    its blocks up before it sends (powers x dimensions) rows.  Only matrices of the size of the
    dimensions reach the driver.
    """
    ranges = (
        rows.select(F.posexplode("_x").alias("i", "x"))
        .groupBy("i")
        .agg(
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            F.sum(F.col("x").cast("decimal(20,0)")).alias("total"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("i")
        .collect()
    )
    if not ranges:
        return None
    n, dims = ranges[0]["n"], len(ranges)
    low = np.array([r["low"] for r in ranges], np.int64)
    bits = max(max(r["high"] - r["low"] for r in ranges).bit_length(), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for start in range(0, len(x), block_rows):
                # Differences wrap around and come out right as unsigned numbers.
                shifted = (x[start : start + block_rows] - low).astype(np.uint64)
                block = plane_counts(bit_planes(shifted, bits))
                counts = block if counts is None else counts + block
        if counts is None:
            return
        for power in range(2 * bits - 1):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([power] * dims, pa.int32()),
                    pa.array(range(dims), pa.int32()),
                    pa.array(counts[power].tolist(), pa.list_(pa.int64())),
                ],
                ["power", "i", "counts"],
            )

    counted = (
        rows.select("_x")
        .mapInArrow(count, "power int, i int, counts array<long>")
        .select("power", "i", F.posexplode("counts").alias("j", "count"))
        .groupBy("power", "i", "j")
        .agg(F.sum("count").alias("count"))
        .where("count > 0")
        .collect()
    )
    products = [[0] * dims for _ in range(dims)]
    for r in counted:
        products[r["i"]][r["j"]] += r["count"] << r["power"]
    # The covariance does not depend on the shift, so shifted sums go with shifted products.
    shifted_sums = [int(r["total"]) - n * r["low"] for r in ranges]
    centred = [[0] * dims for _ in range(dims)]
    for i in range(dims):
        for j in range(i, dims):
            value = n * products[i][j] - shifted_sums[i] * shifted_sums[j]
            centred[i][j] = centred[j][i] = value
    found = Scatter(n, [int(r["total"]) for r in ranges], centred, np.empty(0), np.empty((0, 0)))
    values, vectors = np.linalg.eigh(found.covariance)
    found.values, found.axes = values[::-1].copy(), vectors.T[::-1].copy()
    return found


def whiten(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = COMPONENTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(_id, n, deviation, whitened, explained, identity_error), one row per usable vector.

    ``whitened`` and ``explained`` are arrays over the components, largest eigenvalue first;
    ``deviation`` is sum((n * x - S)^2) over the dimensions as decimal(38,0); ``identity_error`` is
    the largest absolute entry of the covariance of the whitened rows minus the identity, measured
    on those rows.

    Rows that repeat stay and count each time; an id may be null.  Vectors that are null, empty or
    not finite are left out, as are those whose length is not the most frequent one.  Components
    whose eigenvalue is zero within rounding (as when a dimension never changes) have no scale:
    their ``whitened`` is null, and they are no part of ``identity_error`` (null if none is left).
    With equal eigenvalues any basis of their space is right.  An empty table gives no rows.
    Entries whose whole number exceeds a long fail the job.
    """
    rows = stored(common_length(quantised(vectors, id_column, vector_column)))
    schema = (
        f"_id {rows.schema['_id'].dataType.simpleString()}, n long, deviation decimal(38,0), "
        "whitened array<double>, explained array<double>, identity_error double"
    )
    fit = scatter(rows, block_rows)
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, dims = fit.n, fit.sums, len(fit.sums)
    k = min(components, dims)
    scaled = fit.values[:k] > max(fit.values[0], 0.0) * dims * np.finfo(float).eps * 8
    trace = Fraction(sum(fit.centred[i][i] for i in range(dims)), n * n)
    explained = [float(value / float(trace)) if trace else 0.0 for value in fit.values[:k]]
    mean = [s // n for s in sums]  # whole part, so that differences keep every digit
    rest = np.array([(s - m * n) / n for s, m in zip(sums, mean)])
    scale = np.where(scaled, 1 / np.sqrt(np.where(scaled, fit.values[:k], 1.0)), 0.0)
    project = (fit.axes[:k] * scale[:, None]).T
    whole_mean, big_sums = np.array(mean, np.int64), np.array(sums, dtype=object)

    def entries(batch: pa.RecordBatch, column: int) -> np.ndarray:
        return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - whole_mean).astype(float) - rest) @ project

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            white = projected(entries(batch, 0))
            total = white.T @ white + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                ["i", "products"],
            )

    measured = (
        rows.select("_x")
        .mapInArrow(square, "i int, products array<double>")
        .select("i", F.posexplode("products").alias("j", "product"))
        .groupBy("i", "j")
        .agg((F.sum("product") / F.lit(float(n))).alias("covariance"))
        .collect()
    )
    errors = [
        abs(r["covariance"] - (r["i"] == r["j"])) for r in measured if scaled[r["i"]] and scaled[r["j"]]
    ]
    error = max(errors) if errors else None

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = entries(batch, 1)
            white = projected(x)
            spread = float(np.abs(x - whole_mean).max(initial=0)) + 1
            if (spread * n) ** 2 * dims < 2.0**62:
                part = n * (x - whole_mean) - (big_sums - whole_mean.astype(object) * n).astype(np.int64)
                deviation = [str(v) for v in (part * part).sum(axis=1).tolist()]
            else:
                part = n * x.astype(object) - big_sums
                deviation = [str(v) for v in (part * part).sum(axis=1).tolist()]
            values = [
                [w if has else None for w, has in zip(row, scaled)] for row in white.tolist()
            ]
            size = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n] * size, pa.int64()),
                    pa.array(deviation, pa.string()),
                    pa.array(values, pa.list_(pa.float64())),
                    pa.array([explained] * size, pa.list_(pa.float64())),
                    pa.array([error] * size, pa.float64()),
                ],
                ["_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    made = rows.mapInArrow(result, schema.replace("decimal(38,0)", "string"))
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
