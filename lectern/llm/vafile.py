"""Centroid clustering over a vector approximation file.

Vectors of integers are stored beside an approximation of four bits a component: the number
of the cell that the component lies in. Cell bounds are quantiles of a bounded sample, the
outermost ones the least and greatest component of all vectors. For a set of centroids,
lookup tables over cells give a lower and an upper bound of every squared distance as sums of
table entries. A vector is assigned from its cells alone where one centroid's upper bound is
below the lower bounds of all others; only where intervals overlap is the full vector
looked at, and only against the centroids that overlap.

Everything is integers, so no order of summation shows. A round is one pass that returns sums
of k x dim numbers a task; Spark adds those up, and the k centroids go back with the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern.llm.common import schema_of
from lectern.session import cut_lineage

#: Vectors whose components place the inner bounds of the cells.
SAMPLE = 4096
CELLS = 16
#: Components stay below this, so that squared distances fit 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class Clustering:
    """``assigned``: ``vec_id, cluster, distance, by_cells`` for every vector; ``centroids``: integers, row by cluster."""

    assigned: DataFrame
    centroids: np.ndarray


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _packed(rows: np.ndarray) -> pa.Array:
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def integer_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` for vectors of exactly ``dim`` finite components: floor(scale * x) as 32-bit integers."""
    chosen = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    schema = schema_of(chosen, "vec_id", vector=T.BinaryType())

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pc.equal(pc.list_value_length(batch.column("vector")), dim).fill_null(False)
            ids, lists = batch.column("vec_id").filter(whole), batch.column("vector").filter(whole)
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
            finite = np.isfinite(values).all(axis=1)
            scaled = np.floor(values[finite] * scale)
            if (np.abs(scaled) >= LARGEST).any():
                raise ValueError(f"components of {LARGEST // scale} and more make distances beyond 64 bits")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(finite)), _packed(scaled.astype("<i4"))], names=schema.names)

    return chosen.mapInArrow(convert, schema)


def component_ranges(integers: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each component over all vectors; a row a component and task is added up."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, LARGEST), np.full(dim, -LARGEST)
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("vector"), dim, "<i4")
                low, high = np.minimum(low, rows.min(axis=0)), np.maximum(high, rows.max(axis=0))
        yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(dim)), "low": pa.array(low), "high": pa.array(high)})

    found = integers.mapInArrow(extremes, "j long, low long, high long").groupBy("j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    found = sorted(found)
    return np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def cell_bounds(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner bounds (dim x 15), and the least and greatest integer of each cell (dim x 16)."""
    inner = np.sort(np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower").T.astype(np.int64), axis=1)
    return inner, np.column_stack([low, inner]), np.column_stack([inner - 1, high])


def with_cells(integers: DataFrame, inner: np.ndarray) -> DataFrame:
    """``cells`` beside ``vec_id`` and ``vector``: two components a byte (one byte more for an odd last one)."""
    dim = len(inner)
    schema = schema_of(integers, "vec_id", "vector", cells=T.BinaryType())

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vector"), dim, "<i4")
            cells = np.zeros((len(rows), dim + dim % 2), dtype=np.uint8)
            for j in range(dim):
                cells[:, j] = np.searchsorted(inner[j], rows[:, j], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, _packed(cells[:, ::2] | cells[:, 1::2] << 4)], names=schema.names)

    return integers.mapInArrow(approximate, schema)


def lookup_tables(centroids: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of squared distances by byte of cells, its value and centroid."""
    below, above = least[:, :, None] - centroids.T[:, None, :], centroids.T[:, None, :] - greatest[:, :, None]
    outside = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(np.abs(below), np.abs(above))
    tables = []
    for one in (outside**2, farthest**2):
        if len(one) % 2:
            one = np.concatenate([one, np.zeros_like(one[:1])])
        tables.append((one[1::2, :, None, :] + one[::2, None, :, :]).reshape(len(one) // 2, CELLS * CELLS, -1))
    return tables[0], tables[1]


def nearest_centroids(cells: np.ndarray, rows: np.ndarray, centroids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, the smaller number of equals, and whether cells alone decided."""
    lower = np.zeros((len(cells), len(centroids)), dtype=np.int64)
    upper = lower.copy()
    for b in range(cells.shape[1]):
        lower += tables[0][b, cells[:, b]]
        upper += tables[1][b, cells[:, b]]
    open_ = lower <= upper.min(axis=1, keepdims=True)
    by_cells = open_.sum(axis=1) == 1
    exact = np.where(open_, 0, np.iinfo(np.int64).max)
    for k, centroid in enumerate(centroids):
        asked = np.flatnonzero(open_[:, k] & ~by_cells)
        exact[asked, k] = ((rows[asked].astype(np.int64) - centroid) ** 2).sum(axis=1)
    return exact.argmin(axis=1), by_cells


def _moved(stored: DataFrame, centroids: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """The next centroids: floor of the mean of each cluster, the old one where it is empty."""
    k, dim = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums, counts = lookup_tables(centroids, least, greatest), np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch.column("vector"), dim, "<i4")
            near, _ = nearest_centroids(_matrix(batch.column("cells"), (dim + 1) // 2, "u1"), rows, centroids, tables)
            np.add.at(sums, near, rows)
            counts += np.bincount(near, minlength=k)
        number = np.repeat(np.arange(k), dim)
        yield pa.RecordBatch.from_pydict({"cluster": number, "j": np.tile(np.arange(dim), k), "total": sums.ravel(), "n": counts[number]})

    parts = stored.select("cells", "vector").mapInArrow(add_up, "cluster long, j long, total long, n long")
    found = parts.groupBy("cluster", "j").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n")).collect()
    moved = centroids.copy()
    for r in found:  # k x dim rows
        if r["n"]:
            moved[r["cluster"], r["j"]] = int(r["total"]) // r["n"]
    return moved


def clustered(
    vectors: DataFrame, order: Column, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Clustering | None:
    """Lloyd's rounds over ``floor(scale * x)``, from the ``k`` vectors first by ``order`` (an expression of ``vec_id``).

    Vectors that are null, of another length, or hold a null, NaN or infinity take no part. Equal
    places in ``order`` go by the vector; with fewer than ``k`` vectors each starts a cluster.
    Equal vectors, equal centroids and null ids are kept as they are; distances that tie go to
    the smaller number. Components whose distances could pass 64 bits raise an error. Without
    any vector there is no clustering (None). Other columns are not looked at.
    """
    integers = integer_vectors(vectors, dim, scale, id_col, vector_col)
    low, high = component_ranges(integers, dim)
    if low[0] > high[0]:
        return None
    first = integers.select(order.alias("__order"), "vector").orderBy("__order", "vector").limit(max(SAMPLE, k)).collect()
    sample = np.stack([np.frombuffer(r["vector"], dtype="<i4") for r in first]).astype(np.int64)
    inner, least, greatest = cell_bounds(sample, low, high)
    stored = cut_lineage(with_cells(integers, inner))
    centroids = sample[:k]
    for _ in range(rounds):
        centroids = _moved(stored, centroids, least, greatest)
    schema = schema_of(stored, "vec_id", cluster=T.IntegerType(), distance=T.LongType(), by_cells=T.BooleanType())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup_tables(centroids, least, greatest)
        for batch in batches:
            rows = _matrix(batch.column("vector"), dim, "<i4")
            near, by_cells = nearest_centroids(_matrix(batch.column("cells"), (dim + 1) // 2, "u1"), rows, centroids, tables)
            distance = ((rows.astype(np.int64) - centroids[near]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(distance), pa.array(by_cells)], names=schema.names)

    return Clustering(cut_lineage(stored.mapInArrow(assign, schema)), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """``assigned`` with the distance summed over each cluster and over all; a row a cluster is broadcast."""
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in sums)
    rows = [(r["cluster"], r["cluster_inertia"], total, found.centroids[r["cluster"]].tolist()) for r in sums]
    per = found.assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.assigned.join(F.broadcast(per), "cluster")
