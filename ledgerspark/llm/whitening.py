"""Embedding whitening with exact cross-products from bit planes.

Every entry becomes a whole number x = floor(scale * entry). The statistics are taken over the fit list, each distinct x vector once. Each
block of its rows is shifted by the block's least x of each dimension; bit b of a dimension over all rows of the block is packed into 64-bit words, a
plane. The sum over rows of the product of two dimensions is the sum over their planes of 2^(b+c) times the set bits of plane AND plane; the shift is
taken out again with the sums. All of it is whole numbers of any size, which travel as limbs of LIMB bits, so the scatter matrix n * P - S S' is exact and
centred before it is divided, whatever the order of rows. Only that division and the eigenvectors are floating-point.

What reaches the driver has the size of the dimension's square, not of the rows.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry have no result; nor have rows whose vector has another length than
most have (of lengths with as many rows, the greater). Entries beyond 2^63 / scale are taken as that. A component whose variance is not above
rounding error cannot be whitened: its rows have a null `whitened` and it does not count in identity_error. A sum of squared deviations beyond 64 bits is null in
`deviation` and whole in `deviation_text`. Null and repeated ids are rows like any other; an empty table gives an empty one; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, COMPONENTS = 256, 4
#: Rows of a block (planes of 64 dimensions of 8 bits stay within a core's cache), and bits of a limb.
BLOCK, LIMB = 8192, 30


class Model(NamedTuple):
    """n rows of the fit list and their sums; unit eigenvectors (rows) by falling eigenvalue; trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    usable: np.ndarray

    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Bit planes of a block as words (plane, word), each plane's dimension and bit, and the shift of each dimension."""
    least = x.min(axis=0)
    shifted = x.astype(np.uint64) - least.astype(np.uint64)  # modulo 2^64, so exact over the whole range of long
    bits = [int(m).bit_length() for m in shifted.max(axis=0)]
    owner = np.repeat(np.arange(x.shape[1]), bits)
    bit = np.array([b for k in bits for b in range(k)], np.int64)
    rows = -(-len(x) // 64) * 64
    packed = np.zeros((len(owner), rows // 8), np.uint8)
    for p in range(len(owner)):
        one = ((shifted[:, owner[p]] >> np.uint64(bit[p])) & np.uint64(1)).astype(bool)
        packed[p, : -(-len(x) // 8)] = np.packbits(one)
    return packed.view(np.uint64), owner, bit, [int(m) for m in least]


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of x and of products of each two of its dimensions, as objects (whole numbers of any size)."""
    d = x.shape[1]
    words, owner, bit, least = planes(x)
    shifted = np.zeros(d, object)
    for p in range(len(owner)):
        shifted[owner[p]] += int(np.bitwise_count(words[p]).sum(dtype=np.int64)) << int(bit[p])
    cross = np.zeros((d, d), object)
    for p in range(len(owner)):
        # plane p against the planes from its own dimension on
        first = int(np.searchsorted(owner, owner[p]))
        shared = np.bitwise_count(words[first:] & words[p]).sum(axis=1, dtype=np.int64)
        for b in range(int(bit.max()) + 1):
            own = bit[first:] == b
            cross[owner[p], owner[first:][own]] += shared[own].astype(object) << (b + int(bit[p]))
    cross = np.triu(cross) + np.triu(cross, 1).T
    shift = np.array(least, object)
    total = shifted + len(x) * shift
    return total, cross + np.outer(shift, shifted) + np.outer(shifted, shift) + len(x) * np.outer(shift, shift)


def _limbs(value: int) -> list[int]:
    """value = sum of limb[k] << (LIMB * k); all but the last are in [0, 2^LIMB)."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, limb, part) of a task: cross-products i <= j, sums at j = -1, the number of rows at i = j = -1."""
    sums, cross, n = 0, 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            x = _matrix(batch.column(0)[at : at + BLOCK])
            total, products = scatter(x)
            sums, cross, n = sums + total, cross + products, n + len(x)
    if n:
        d = len(sums)
        every = [(-1, -1, n), *((i, -1, sums[i]) for i in range(d)), *((i, j, cross[i, j]) for i in range(d) for j in range(i, d))]
        rows = [(i, j, k, part) for i, j, value in every for k, part in enumerate(_limbs(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "limb", "part"])


def whole_numbers(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The key and x of every row that has a result."""

    def known(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    vector = F.col(f"`{column}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{key}`").alias("key"), vector.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", known))
    lengths = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("most"))
    most = lengths.first()["most"]
    return rows.filter(F.size("v") == (most["d"] if most else 0)).select("key", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """The fit list: each x once, as a table in the shared folder."""
    return materialize(rows.select("x").distinct(), "whitening-fit")


def fit(vectors: DataFrame) -> Model | None:
    """Statistics and eigenvectors of the fit list; None if it is empty."""
    parts = vectors.select("x").mapInArrow(_scattered, "i int, j int, limb int, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).toPandas()
    exact: dict[tuple[int, int], int] = {}
    for i, j, limb, part in parts.itertuples(index=False):
        exact[i, j] = exact.get((i, j), 0) + (int(part) << (LIMB * int(limb)))
    n = exact.get((-1, -1), 0)
    if not n:
        return None
    d = max(i for i, _ in exact) + 1
    sums = [exact[i, -1] for i in range(d)]
    centred = {(i, j): n * exact[i, j] - sums[i] * sums[j] for i in range(d) for j in range(i, d)}
    covariance = np.array([[centred[min(i, j), max(i, j)] / (n * n) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1].T
    trace = sum(centred[i, i] for i in range(d)) / (n * n)
    return Model(n, sums, values, np.ascontiguousarray(vectors_), trace, values > max(trace, 0.0) * d * np.finfo(float).eps)


def _whiten(x: np.ndarray, model: Model, count: int) -> np.ndarray:
    """x on the first components, with variance 1 where that can be."""
    scaled = np.where(model.usable[:count], np.sqrt(np.where(model.usable[:count], model.values[:count], 1.0)), np.nan)
    return (x - model.centre()) @ model.vectors[:count].T / scaled


def identity_error(vectors: DataFrame, model: Model, count: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, measured over all its rows."""
    usable = int(model.usable[:count].sum())
    if not usable:
        return None
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = _whiten(_matrix(batch.column(0)).astype(np.float64), shared.value, usable)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, k])) for k in range(usable)], [f"w{k}" for k in range(usable)])

    found = vectors.select("x").mapInArrow(run, ", ".join(f"w{k} double" for k in range(usable)))
    pairs = [(i, j) for i in range(usable) for j in range(i, usable)]
    row = found.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def deviations(x: np.ndarray, model: Model) -> list[int]:
    """Exact sum over the dimensions of (n * x - S)^2 of every row."""
    most = max(abs(model.n * int(m) - s) for m, s in [*zip(x.min(axis=0), model.sums, strict=True), *zip(x.max(axis=0), model.sums, strict=True)])
    kind = np.int64 if most * most * x.shape[1] < 1 << 62 and model.n * int(np.abs(x).max()) < 1 << 62 else object
    gap = x.astype(kind) * model.n - np.array(model.sums, kind)
    return [int(v) for v in (gap * gap).sum(axis=1)]


def whiten(embeddings: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each row with a result and each of the first components: key, component, n, deviation, whitened, explained, identity_error, deviation_text."""
    rows = whole_numbers(embeddings, key, column, scale)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    vectors = distinct_vectors(rows)
    model = fit(vectors)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    count = min(components, len(model.sums))
    error = identity_error(vectors, model, count)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        explained = m.values[:count] / m.trace if m.trace > 0 else np.full(count, np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            far = deviations(x, m)
            each = np.repeat(np.arange(len(x)), count)
            w, share = _whiten(x.astype(np.float64), m, count).ravel(), np.tile(explained, len(x))
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), m.n, np.int64)),
                pa.array([v if v < 1 << 63 else None for v in far], pa.int64()).take(pa.array(each)),
                pa.array(w, mask=np.isnan(w)),
                pa.array(share, mask=np.isnan(share)),
                pa.array(np.full(len(each), np.nan if error is None else error), mask=np.full(len(each), error is None)),
                pa.array([str(v) for v in far], pa.string()).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"])

    return rows.mapInArrow(run, schema)
