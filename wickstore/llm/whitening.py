"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows form a matrix ``X`` that stays distributed. Each step multiplies it by a right vector and its
transpose by the left vector that results, and orthogonalises both against all earlier ones. A left vector has
an entry for each row; it is never stored, as every left vector is ``X p`` for a short vector ``p`` on the driver.
The singular values of the small bidiagonal matrix are the deviations, its right vectors give the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + OFFSET.
SCALE = 1024
OFFSET = 100_000
#: Entries from here on have no 64-bit integer.
MOST = 2.0**62
#: Entries of a block of rows that a task multiplies at a time.
BLOCK = 1 << 21
#: Relative to the root of the trace: a coupling this small ends a Krylov space, a residual this small is
#: converged, and a deviation this small is none.
BREAK, CONVERGED, LEAST = 1e-14, 2e-15, 1e-9
#: Residual at which the search for a further direction may say that there is none as large.
ROUGH = 1e-6


def entries(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that count, their ``floor(1024 c)`` as a matrix of 64-bit integers).

    A vector that is null, or holds a null, non-finite or over-large entry, does not count. Short vectors are
    filled up with zeros to ``width``, or to the longest one here.
    """
    lists = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    scaled = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
    usable = np.isfinite(scaled) & (np.abs(scaled) < MOST)
    owner = np.repeat(np.arange(len(lists)), lengths)
    keep = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    keep[owner[~usable]] = False
    inside = keep[owner]
    rows = np.flatnonzero(keep)
    width = int(lengths[keep].max(initial=0)) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.searchsorted(rows, owner[inside]), place[inside]] = scaled[inside].astype(np.int64)
    return rows, out


class Centre(NamedTuple):
    """Number of vectors, and per dimension the sum of ``floor(1024 c)`` as whole mean and remainder."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @property
    def width(self) -> int:
        return len(self.whole)

    def gaps(self, y: np.ndarray) -> np.ndarray:
        """``x - S / n`` of each entry."""
        return (y - self.whole) - self.rest / self.n

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sum of ``(n x - S)**2`` of each vector."""
        away = y - self.whole
        most = int(np.abs(away).max(initial=0)) + 1
        if self.n * most < 2**63 and (self.n * most) ** 2 * self.width < 2**63:
            return ((self.n * away - self.rest) ** 2).sum(axis=1).tolist()
        rest = [int(r) for r in self.rest]
        return [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]


def _wide_sum(values: np.ndarray) -> int:
    """Sum of 64-bit integers without overflow."""
    return (int((values >> 31).sum()) << 31) + int((values & 0x7FFFFFFF).sum())


def centre(vectors: DataFrame, column: str) -> Centre:
    """Count and exact sums of all vectors that count: one row per dimension and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            rows, y = entries(batch.column(0))
            n += len(rows)
            sums += [0] * (y.shape[1] - len(sums))
            for i in range(y.shape[1]):
                sums[i] += _wide_sum(y[:, i])
        yield pa.record_batch(
            [
                pa.array(range(-1, len(sums)), pa.int32()),
                pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0)),
            ],
            names=["place", "total"],
        )

    totals = (
        vectors.select(column)
        .mapInArrow(run, "place int, total decimal(38,0)")
        .groupBy("place")
        .agg(F.sum("total").alias("total"))
    )
    found = {row.place: int(row.total) for row in totals.collect()}
    n = found.pop(-1, 0)
    split = [divmod(found[i], n) for i in range(len(found))] if n else []
    return Centre(n, np.array([w for w, _ in split], np.int64), np.array([r for _, r in split], np.int64))


def summed(vectors: DataFrame, column: str, at: Centre, block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``block(centred rows)`` over all blocks of rows; ``block`` gives a vector of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        step = max(1, BLOCK // at.width)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                _, y = entries(batch.column(0).slice(first, step), at.width)
                if len(y):
                    part = block(at.gaps(y))
                    total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "total"])

    totals = (
        vectors.select(column)
        .mapInArrow(run, "place int, total double")
        .groupBy("place")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    out = np.zeros(len(totals))
    for row in totals:
        out[row.place] = row.total
    return out


#: (X'Xq, U'Xq, |Xq|^2) for a right vector q and the left vectors U = X P.
Product = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]]


def _fresh(known: list[np.ndarray], width: int, random: np.random.Generator) -> np.ndarray:
    """A random unit vector orthogonal to ``known``."""
    v = _orthogonal(random.standard_normal(width), known)
    return v / np.linalg.norm(v)


def _orthogonal(v: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    if known:
        basis = np.array(known)
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(
    product: Product, width: int, locked: list, wanted: int, random: np.random.Generator, floor: float = 0.0
) -> tuple[list, bool]:
    """The ``wanted`` largest (deviation, right vector) outside ``locked`` ones, and whether there are no others.

    A step is one pass over the rows: it forms ``X q``, its products with all earlier left vectors and its
    product with the transpose. Where orthogonalising takes most of a left vector away, the step is repeated.
    When a Krylov space ends, a random vector orthogonal to it starts the next. The search ends early when the
    largest value is plainly below ``floor``.
    """
    known = [v for _, v in locked]
    lefts = [v / s for s, v in locked]
    images = [s * v for s, v in locked]
    own, entry, n_left = [], {}, 0
    v, beta, fresh = _fresh(known, width, random), 0.0, True
    while True:
        column = len(own)
        own.append(v)
        known.append(v)
        q = v - beta * lefts[-1] if beta else v
        P = np.array(lefts).reshape(len(lefts), width)
        Z = np.array(images).reshape(len(images), width)
        while True:
            z, h, square = product(q, P)
            q, z, lost = q - P.T @ h, z - Z.T @ h, float(h @ h)
            if square <= BREAK**2 or lost <= 0.01 * square:
                break
        alpha = float(np.sqrt(max(square - lost, 0.0)))
        if beta:
            entry[n_left - 1, column] = beta
        if alpha > BREAK:
            lefts.append(q / alpha)
            images.append(z / alpha)
            entry[n_left, column] = alpha
            n_left += 1
            f = _orthogonal(images[-1] - alpha * v, known)
            beta = float(np.linalg.norm(f))
        else:
            beta = 0.0
        complete = len(known) == width or (fresh and alpha <= BREAK)
        small = np.zeros((max(n_left, 1), len(own)))
        for (i, j), value in entry.items():
            small[i, j] = value
        left, values, right = np.linalg.svd(small, full_matrices=False)
        residuals = np.abs(beta * left[-1]) if n_left else np.zeros(1)
        top = min(wanted, len(values))
        done = len(values) >= wanted and (residuals[:top] <= CONVERGED).all()
        below = floor and residuals[0] <= ROUGH and values[0] + ROUGH < floor
        if complete or done or below:
            basis = np.array(own)
            vectors = [right[i] @ basis for i in range(top)]
            found = [(float(s), w / np.linalg.norm(w)) for s, w in zip(values[:top], vectors)]
            return [pair for pair in found if pair[0] > LEAST], complete
        fresh = beta <= BREAK
        if fresh:
            v, beta = _fresh(known, width, random), 0.0
        else:
            v = f / beta


def components(vectors: DataFrame, column: str, at: Centre, count: int) -> tuple[float, list]:
    """Trace of the covariance, and up to ``count`` (share of the trace, unit component), largest first.

    A single start finds one direction of each set of equal deviations at first, so unless all directions
    were found, further searches beside the known ones go on until none has as large a deviation as the last.
    """
    total = float(summed(vectors, column, at, lambda a: np.array([(a * a).sum()]))[0])
    if not total:
        return 0.0, []
    scale = np.sqrt(total)

    def product(q: np.ndarray, P: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def block(a: np.ndarray) -> np.ndarray:
            a = a / scale
            image = a @ q
            return np.concatenate([a.T @ image, (a @ P.T).T @ image, [image @ image]])

        out = summed(vectors, column, at, block)
        return out[: at.width], out[at.width : -1], float(out[-1])

    random = np.random.default_rng(0)
    found, complete = bidiagonalise(product, at.width, [], count, random)
    while not complete and len(found) < at.width:
        least = min(s for s, _ in found[:count]) if len(found) >= count else 0.0
        more, complete = bidiagonalise(product, at.width, found, 1, random, least)
        if not more or more[0][0] < least:
            break
        found = sorted(found + more, key=lambda pair: -pair[0])
    signed = [(s, v if v[np.abs(v).argmax()] > 0 else -v) for s, v in found[:count]]
    return total / at.n, [(s * s, v) for s, v in signed]


def whitened(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", count: int = 8
) -> DataFrame:
    """One row for each vector that counts and each of up to ``count`` principal components.

    ``whitened`` is the centred vector projected on the component, over the component's deviation;
    ``explained`` the component's share of all variance; ``deviation`` the exact squared distance from the
    centre times ``n`` squared, null where it does not fit 64 bits; ``n`` the number of vectors;
    ``identity_error`` how far the covariance of all ``whitened`` is from the identity at most.

    Entries become ``floor(1024 c) + 100000``. Null vectors and those with a null, non-finite or over-large
    entry (``2**62`` and more after scaling) are dropped; zeros fill a vector that is shorter than the longest.
    Null or repeated ids and repeated vectors are kept row by row. Components without variance are left out, so
    equal vectors, a single one or none give no row. Among equal deviations any orthonormal choice is right.
    Further columns are ignored.
    """
    at = centre(vectors, column)
    trace, found = components(vectors, column, at, count) if at.n and at.width else (0.0, [])
    kind = vectors.schema[id_column].dataType
    schema = f"{id_column} {kind.simpleString()}, component int, n long, deviation long, whitened double, "
    schema += "explained double, identity_error double"
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    axes = np.array([v / np.sqrt(share * trace) for share, v in found]).T
    shares = np.array([share for share, _ in found])
    k = len(found)

    def moments(a: np.ndarray) -> np.ndarray:
        w = a @ axes
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums = summed(vectors, column, at, moments) / at.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(at.width, 8 * k))
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                rows, y = entries(batch.column(1), at.width)
                if not len(rows):
                    continue
                exact = [d if d < 2**63 else None for d in at.deviations(y)]
                again = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(rows)).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * k, at.n, np.int64)),
                        pa.array(exact, pa.int64()).take(again),
                        pa.array((at.gaps(y) @ axes).ravel()),
                        pa.array(np.tile(shares, len(rows))),
                        pa.array(np.full(len(rows) * k, error)),
                    ],
                    names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(id_column, column).mapInArrow(run, schema)
