"""Embedding whitening with exact sums and Chan's merging of centred scatter matrices.

A vector's entry c becomes the whole number floor(64 * c) + 1000000. The fit list is each
distinct vector once, found by a shuffle and written to the shared folder. Each partition
computes its count, sums and scatter centred at its own mean, batch by batch; treeReduce
merges two parts by n = n1 + n2 and M = M1 + M2 + (m2 - m1)(m2 - m1)' n1 n2 / n, which
keeps the large offset out of every product. Sums are exact integers. The driver gets one
d x d matrix and takes its eigenvectors (eigh); a second pass whitens the fit list, merges
its covariance in the same way and reports its largest difference from the identity.

Odd cases: rows whose vector is null, empty or holds null, NaN or infinite entries are left
out; so are vectors of another length than the most frequent one (of two, the longer). Whole
numbers are held within 2**45 of 0. Directions without variance (eigenvalues up to rounding
of the largest) are no components, so equal vectors alone give no rows, as no rows do.
Repeated rows and ids are answered each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import materialise, place_of

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
_FURTHEST = 1 << 45
_DEPTH = 3


def lattice(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors as whole numbers."""
    ids, places = place_of(vectors, "vec_id"), place_of(vectors, "embedding")
    named = vectors.toDF(*(f"c{i}" for i in range(len(vectors.columns)))).select(F.col(f"c{ids}").alias("vec_id"), F.col(f"c{places}").cast("array<double>").alias("v"))
    infinite = float("inf")
    odd = F.exists("v", lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == infinite), F.lit(True)))
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(-_FURTHEST))), F.lit(float(_FURTHEST)))) + OFFSET)
    usable = named.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    lengths = usable.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return usable.where(F.size("v") == (lengths["length"] if lengths else 0)).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Moments:
    """Count, exact sums (integers), and the scatter centred at the mean. scale: the sums are of values times 2**scale."""

    n: int
    sums: tuple
    scatter: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Moments:
        """Of a batch's rows, taken from its first row before any product."""
        near = values - values[0]
        centred = near - near.sum(axis=0) / len(values)
        exact = values.dtype.kind == "i"
        return cls(len(values), tuple(values.sum(axis=0).tolist() if exact else values.sum(axis=0)), centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])  # exact up to the division
        return Moments(n, tuple(a + b for a, b in zip(self.sums, other.sums, strict=True)), self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n)))


def moments(fit: DataFrame, transform=None) -> Moments | None:
    """The moments of the fit list's vectors (or of what transform makes of them); None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(0))
                own = Moments.of(values if transform is None else transform(values))
                total = own if total is None else total.merged(own)
        if total is not None:
            exact = [str(s) for s in total.sums] if transform is None else [float(s).hex() for s in total.sums]
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([exact]), pa.array([total.scatter.tobytes()])], ["n", "sums", "scatter"])

    def read(row) -> Moments:
        sums = tuple(int(s) if transform is None else float.fromhex(s) for s in row["sums"])
        return Moments(row["n"], sums, np.frombuffer(bytes(row["scatter"])).reshape(len(sums), -1))

    parts = fit.select("x").mapInArrow(part, "n long, sums array<string>, scatter binary").rdd.map(read)
    return parts.map(lambda m: (m,)).treeReduce(_joined, _DEPTH)[0] if not parts.isEmpty() else None


def _joined(a: tuple, b: tuple) -> tuple:
    return (a[0].merged(b[0]),)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # a column for each component
    values: np.ndarray  # their eigenvalues, falling
    trace: float
    identity_error: float = float("nan")

    def project(self, values: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((values - whole) - rest) @ self.components / np.sqrt(self.values)

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)**2 of each row, exactly; None where a long cannot hold it."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        near = values - whole
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * len(self.sums) < 1 << 63:
            gaps = self.n * near - np.array([s % self.n for s in self.sums], np.int64)
            return (gaps * gaps).sum(axis=1).tolist()
        rest = [s % self.n for s in self.sums]
        exact = [sum((self.n * x - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in near.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of lattice()'s rows by their distinct vectors, with its identity error; None if they do not differ."""
    distinct = materialise(rows.select("x").distinct(), "fit-list")
    found = moments(distinct)
    if found is None:
        return None
    covariance = found.scatter / found.n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    values, basis = values[::-1], basis[:, ::-1]
    real = int((values[:components] > 4 * len(values) * np.finfo(float).eps * values[0]).sum())
    if not real:
        return None
    model = Whitening(found.n, found.sums, basis[:, :real].copy(), values[:real].copy(), float(np.trace(covariance)))
    again = moments(distinct, model.project)
    error = float(np.abs(again.scatter / again.n - np.eye(real)).max())
    return Whitening(model.n, model.sums, model.components, model.values, model.trace, error)


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of lattice()'s rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(1))
                flat = pa.array(model.project(values).ravel())
                ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(model.values))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(values), pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(whiten, f"vec_id {kind}, deviation long, whitened array<double>")


def component_rows(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    rows = lattice(vectors)
    model = fit(rows, components)
    spark, kind = vectors.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    told = apply(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return told.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
