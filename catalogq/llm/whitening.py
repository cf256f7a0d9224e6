"""Whitened embeddings: leading components of the covariance by a block Jacobi-Davidson method.

The covariance is never formed. All that is asked of the table is its product with a block of
vectors: tasks centre their rows, multiply twice and pass on one matrix each, which Spark sums by
row of the matrix. Small dense work (Rayleigh-Ritz on the subspace, orthogonalising) is done on
the driver, on matrices of at most dimensions x a few times the components, whatever the rows.

One outer step: Rayleigh-Ritz on the subspace, residuals of the wanted pairs, locking of the
leading ones that have reached double precision, and for all others together the correction
equation (I - QQ')(V - theta I)(I - QQ') t = -r, Q being the locked and the wanted vectors, solved
roughly by a few MINRES steps in lockstep, so one pass over the rows serves all components. The
corrections extend the subspace, which is cut back to the best vectors when it gets wide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.llm.scratch import keep

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
INNER, ROUGH = 8, 0.05  # MINRES steps of a correction equation, and the residual that ends them
WIDTH = 3  # the subspace holds so many times the wanted vectors at most
OUTER = 60
EXACT = 32 * np.finfo(float).eps  # residual that locks a pair, relative to the largest eigenvalue
NEARLY = 1e-11  # below it, a residual that no longer falls is what rounding of the sums leaves
RANK = 1e-11  # eigenvalues below it, relative to the largest, can't be told from rounding
_FAR = float(1 << 61)

Product = Callable[[np.ndarray], np.ndarray]


def _minres(apply: Product, right: np.ndarray, steps: int, rough: float) -> np.ndarray:
    """Solutions of a symmetric system for every column of right, in lockstep."""
    start = np.linalg.norm(right, axis=0)
    active = start > 0
    beta = np.where(active, start, 1.0)
    before, now = np.zeros_like(right), right.copy()  # unscaled Lanczos vectors
    previous = np.ones_like(beta)
    cosine, sine, bar, epsilon, rest = -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta), start.copy()
    solution, way, way_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    for step in range(steps):
        vector = now / beta
        image = apply(vector)
        if step:
            image = image - before * (beta / previous)
        along = np.einsum("ij,ij->j", vector, image)
        image = image - now * (along / beta)
        before, now, previous = now, image, beta
        beta = np.linalg.norm(now, axis=0)
        older, delta, gamma_bar = epsilon, cosine * bar + sine * along, sine * bar - cosine * along
        epsilon, bar = sine * beta, -cosine * beta
        gamma = np.hypot(gamma_bar, beta)
        gamma = np.where(gamma > 0, gamma, 1.0)
        cosine, sine = gamma_bar / gamma, beta / gamma
        length, rest = cosine * rest, sine * rest
        way_before, way = way, (vector - way_before * older - way * delta) / gamma
        solution = solution + np.where(active, length, 0.0) * way
        active = active & (beta > 1e-14 * start)
        beta = np.where(beta > 0, beta, 1.0)
        if not (active & (rest > rough * start)).any():
            break
    return solution


def _fresh(vectors: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what vectors add to the other (orthonormal) columns."""
    for _ in range(2):
        for q in others:
            vectors = vectors - q @ (q.T @ vectors)
        lengths = np.linalg.norm(vectors, axis=0)
        vectors = vectors[:, lengths > 1e-10 * max(lengths.max(initial=0.0), 1e-300)]
        vectors = vectors / np.linalg.norm(vectors, axis=0)
        left, sizes, _ = np.linalg.svd(vectors, full_matrices=False) if vectors.shape[1] else (vectors, np.zeros(0), None)
        vectors = left[:, sizes > 1e-6]
    room = len(vectors) - sum(q.shape[1] for q in others)
    return vectors[:, : max(room, 0)]


def leading(product: Product, size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix that only multiplies."""
    wanted = min(wanted, size)
    locked, done = np.zeros((size, 0)), np.zeros((size, 0))
    basis = np.linalg.qr(np.random.default_rng(13).standard_normal((size, wanted)))[0]
    image = product(basis)
    top, lowest, waits = 0.0, None, 0
    for _ in range(OUTER):
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        basis, image = basis @ turn[:, ::-1], image @ turn[:, ::-1]
        values = values[::-1]
        top = max(top, float(values[0]))
        left = wanted - locked.shape[1]
        residual = image[:, :left] - basis[:, :left] * values[:left]
        residual = residual - locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        full = locked.shape[1] + basis.shape[1] >= size
        waits = waits + 1 if lowest is not None and norms.max() > 0.5 * lowest else 0
        lowest = norms.max()
        bound = NEARLY if waits >= 2 or full else EXACT
        good = norms <= bound * top
        ahead = len(good) if good.all() else int(np.argmin(good))
        if ahead:
            locked, done = np.hstack([locked, basis[:, :ahead]]), np.hstack([done, image[:, :ahead]])
            basis, image, residual, values = basis[:, ahead:], image[:, ahead:], residual[:, ahead:], values[ahead:]
            lowest, waits, left = None, 0, left - ahead
        if not left:
            break
        around = np.hstack([locked, basis[:, :left]])
        away = lambda y: y - around @ (around.T @ y)
        apply = lambda y: away(product(away(y)) - away(y) * values[:left])  # noqa: B023, E731
        steps = _minres(apply, -away(residual), INNER, ROUGH)
        if basis.shape[1] > (WIDTH - 1) * wanted:
            basis, image = basis[:, : 2 * left], image[:, : 2 * left]
        added = _fresh(steps, locked, basis)
        if not added.shape[1]:
            added = _fresh(np.random.default_rng(left).standard_normal((size, left)), locked, basis)
        if added.shape[1]:
            basis, image = np.hstack([basis, added]), np.hstack([image, product(added)])
    else:
        raise ArithmeticError(f"{wanted - locked.shape[1]} of {wanted} components did not converge")
    # Rayleigh-Ritz on all locked vectors: neighbours with close eigenvalues settle.
    locked = np.linalg.qr(locked)[0]
    image = product(locked)
    values, turn = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
    return values[::-1], locked @ turn[:, ::-1]


class Fit(NamedTuple):
    rows: DataFrame  # every column of the table that is asked for, and _x
    size: int
    n: int
    whole: np.ndarray  # floor of the mean of each dimension
    part: np.ndarray  # S - n * whole, from 0 to n - 1


def _integers(column: Column) -> Column:
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-_FAR)), F.lit(_FAR))
    return F.transform(column, lambda c: F.floor(scaled(c)) + F.lit(OFFSET).cast("long"))


def _finite(column: Column) -> Column:
    good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, good)


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The last column of a batch, one row for each of its lists."""
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> dict:
    """{row: sums} of the matrices that tasks make of their rows; at most one matrix leaves each task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(_matrix(batch, size))
                total = more if total is None else total + more
        if total is not None:
            kinds = {"double": pa.float64(), "decimal(38,0)": pa.decimal128(38, 0)}
            flat = pa.array(total.ravel().tolist(), pa.float64()) if kind == "double" else pa.array(
                [int(v) for v in total.ravel()], pa.decimal128(38, 0)
            )
            lists = pa.FixedSizeListArray.from_arrays(flat, total.shape[1]).cast(pa.list_(kinds[kind]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], ["row", "part"])

    parts = rows.select("_x").mapInArrow(apply, f"row int, part array<{kind}>")
    entries = parts.select("row", F.posexplode("part").alias("place", "value"))
    sums = entries.groupBy("row", "place").agg(F.sum("value").alias("value"))
    listed = sums.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "value")))["value"].alias("sums"))
    return {r["row"]: r["sums"] for r in listed.collect()}


def _stacked(sums: dict) -> np.ndarray:
    return np.array([sums[i] for i in range(len(sums))], dtype=float)


def _split_sums(x: np.ndarray) -> np.ndarray:
    """Exact column sums of 64-bit integers as Python integers, one row."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return np.array([[(int(h) << 32) + int(v) for h, v in zip(high, low)]], dtype=object)


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """x - S / n as doubles."""
    return (x - fit.whole).astype(float) - fit.part / fit.n


def _deviation(x: np.ndarray, fit: Fit) -> list:
    """The exact sum over dimensions of (n * x - S)^2 of each row; None where it passes 64 bits."""
    gap = x - fit.whole
    most = int(max(-int(gap.min(initial=0)), int(gap.max(initial=0)))) * fit.n + fit.n
    if fit.size * most * most < 1 << 63:
        return ((gap * fit.n - fit.part) ** 2).sum(axis=1).tolist()
    exact = ((gap.astype(object) * fit.n - fit.part.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def fitted(embeddings: DataFrame, column: str, others: list[str]) -> Fit | None:
    """The rows to fit, written once as integers, with their number and exact sums; None without rows."""
    rows = embeddings.where(_finite(F.col(column))).select(*others, _integers(F.col(column)).alias("_x"))
    rows = keep(rows, "vectors")
    lengths = rows.groupBy(F.size("_x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None
    size, n = lengths["size"], lengths["count"]
    rows = rows.where(F.size("_x") == size)
    sums = [int(v) for v in _summed(rows, _split_sums, size, "decimal(38,0)")[0]]
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return Fit(rows, size, n, whole, np.array([s % n for s in sums], dtype=np.int64))


def _multiplied(x: np.ndarray, fit: Fit, block: np.ndarray) -> np.ndarray:
    z = centred(x, fit)
    return z.T @ (z @ block)


def _squares(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (centred(x, fit) ** 2).sum(axis=0, keepdims=True)


def _gram(x: np.ndarray, fit: Fit, weights: np.ndarray) -> np.ndarray:
    """Products of the whitened columns, and their sums as the last row."""
    white = centred(x, fit) @ weights
    return np.vstack([white.T @ white, white.sum(axis=0)])


def _plain(fit: Fit) -> Fit:
    """The numbers of a fit, without its table, for the tasks."""
    return fit._replace(rows=None)


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    Rows whose vector is null, empty, or holds a null, NaN or infinite entry are left out. Where
    lengths differ, the most frequent length counts (of equally frequent ones the largest) and
    other rows are left out too. Repeated rows and ids, null ids included, count and come out as
    often as they stand. Entries beyond 2^55 count as 2^55; a deviation that passes 64 bits is
    null. Components whose eigenvalue is zero but for rounding (RANK) do not exist, so a table of
    equal vectors, of one vector or of none gives no rows. Equal eigenvalues leave the choice of
    their vectors open; it is one choice for all rows. Other columns are not read.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    fit = fitted(embeddings, column, ["vec_id"])
    empty = embeddings.sparkSession.createDataFrame([], schema)
    if fit is None:
        return empty
    inner = _plain(fit)
    trace = float(np.sum(_summed(fit.rows, partial(_squares, fit=inner), fit.size)[0])) / fit.n
    if trace == 0:
        return empty
    size, n = fit.size, fit.n

    def product(block: np.ndarray) -> np.ndarray:
        return _stacked(_summed(fit.rows, partial(_multiplied, fit=inner, block=block), size)) / n

    values, vectors = leading(product, size, components)
    real = values > RANK * values[0]
    values, vectors = values[real], vectors[:, real]
    weights = vectors / np.sqrt(values)
    gram = _stacked(_summed(fit.rows, partial(_gram, fit=inner, weights=weights), size)) / n
    covariance = gram[:-1] - np.outer(gram[-1], gram[-1])
    error = float(np.abs(covariance - np.eye(len(values))).max())
    explained = values / trace
    count = len(values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, size)
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n, np.int64)),
                    pa.array(_deviation(x, inner), pa.int64()).take(pa.array(each)),
                    pa.array((centred(x, inner) @ weights).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return fit.rows.select("vec_id", "_x").mapInArrow(rows, schema)
