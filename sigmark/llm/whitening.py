"""Embeddings projected on their leading components and scaled to unit variance.

Entries become integers, so sums are exact.  One pass gives each task's count,
sums and cross products, centred at the task's own mean before multiplying;
Spark adds them up, with what the tasks' means add around the mean of all.  What
reaches the driver is the covariance, whose size is that of the dimension.

The leading eigenvalues come from spectrum slicing: the covariance less a shift
is factored as L D L^T with pivots of one or two rows, and D has as many negative
eigenvalues as there are below the shift (Sylvester's law of inertia).  Counts
halve an interval until it holds one eigenvalue alone, Rayleigh quotient
iteration converges from there to its eigenvector, cubically, and two more counts,
just below and above the value found, certify its number.  Eigenvalues that are
equal to rounding are found as one group, with an orthonormal basis of its space.

A second pass projects the rows and measures the covariance of the result.

Rows whose vector is null or has null, NaN or infinite entries are left out, as
are vectors without entries.  Where lengths differ, the commonest counts (the
greater of two equally common ones), and rows of others are left out.  Entries
beyond 2^30 count as that much.  Repeated rows count, and are returned, each.
Components of no variance (below 1e-12 of the greatest eigenvalue) can't be scaled
and are left out, so equal vectors, or one alone, give no row.  deviation is null
where it exceeds a long.  A null vec_id stays null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut

#: Components returned at most; scale and offset of the integers.
LEADING, SCALE, OFFSET = 8, 1024, 100_000
#: Entries times SCALE are held to so much; after so many rows sums are handed on, so they are exact; so many lengths are summed at a time.
MOST, FLUSH, LENGTHS = 1 << 40, 1 << 21, 4
#: Part of the greatest eigenvalue below which one counts as zero, and within which two count as equal.
TINY, SAME = 1e-12, 1e-11
#: Growth factor that decides between pivots of one row and of two.
ALPHA = (1 + 17**0.5) / 8


def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are negative, from the pivots of L D L^T (Bunch and Kaufman's choice of pivots)."""
    a, below, k, n = a.copy(), 0, 0, len(a)
    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(np.argmax(column)) if len(column) else k
        most = column.max(initial=0.0)
        take, width = k, 1
        if abs(a[k, k]) < ALPHA * most:
            others = np.abs(a[k:, r])
            others[r - k] = 0
            if abs(a[k, k]) * others.max() < ALPHA * most**2:
                take, width = r, 1 if abs(a[r, r]) >= ALPHA * others.max() else 2
        at = k + width - 1
        if take > at:
            a[[at, take]] = a[[take, at]]
            a[:, [at, take]] = a[:, [take, at]]
        pivot, side = a[k : k + width, k : k + width], a[k + width :, k : k + width]
        if width == 2:  # its determinant is negative: one eigenvalue on either side of zero
            below += 1
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(pivot, side.T)
        elif pivot[0, 0]:
            below += int(pivot[0, 0] < 0)
            a[k + 1 :, k + 1 :] -= np.outer(side, side / pivot[0, 0])
        k += width
    return below


class Spectrum:
    """The leading eigenpairs of a symmetric matrix without negative eigenvalues."""

    def __init__(self, a: np.ndarray) -> None:
        self.a, self.n = a, len(a)
        self.scale = float(np.abs(a).sum(1).max())
        self.counts = 0

    def above(self, shift: float) -> int:
        """Eigenvalues above shift."""
        self.counts += 1
        return inertia(shift * np.eye(self.n) - self.a)

    def _solve(self, shift: float, b: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(self.a - shift * np.eye(self.n), b)
        except np.linalg.LinAlgError:  # an eigenvalue to the last bit
            return np.linalg.solve(self.a - (shift + 1e-15 * self.scale) * np.eye(self.n), b)

    def _rayleigh(self, lo: float, hi: float, known: np.ndarray) -> tuple[float, np.ndarray] | None:
        """The eigenpair that Rayleigh quotient iteration reaches from the interval's middle, if it is in the interval."""
        v = np.cos(np.arange(1.0, self.n + 1) ** 1.5)
        shift = (lo + hi) / 2
        for turn in range(40):
            v = self._solve(shift, v)
            v -= known @ (known.T @ v)
            v /= np.linalg.norm(v)
            value = float(v @ self.a @ v)
            if turn < 2:  # two steps of inverse iteration, towards the interval's own eigenvalue
                continue
            if not lo <= value <= hi:
                return None
            if np.linalg.norm(self.a @ v - value * v) <= 1e-14 * self.scale:
                return value, v
            shift = value
        return (value, v) if np.linalg.norm(self.a @ v - value * v) <= 1e-12 * self.scale else None

    def _group(self, lo: float, hi: float, size: int, known: np.ndarray) -> np.ndarray:
        """An orthonormal basis of the space of size eigenvalues that are equal to rounding, by inverse iteration of all at once."""
        v = np.cos(np.outer(np.arange(1.0, self.n + 1) ** 1.5, np.arange(1.0, size + 1)))
        for _ in range(6):
            v = self._solve((lo + hi) / 2, v)
            v -= known @ (known.T @ v)
            v, _ = np.linalg.qr(v)
        return v

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The greatest eigenvalues, falling, and their eigenvectors as columns; those that count as zero are left out."""
        values, vectors, done = [], np.zeros((self.n, 0)), 0
        floor = TINY * self.scale
        most = min(most, self.above(floor))
        while done < most:
            # (lo, top] holds all eigenvalues that are still to be found and are not below lo; the found ones in it don't matter
            lo, top, pair = floor, self.scale * (1 + 1e-9), None
            held = self.above(lo) - done
            while not (held == 1 and (pair := self._rayleigh(lo, top, vectors))) and top - lo > SAME * self.scale:
                middle = (lo + top) / 2
                if (n := self.above(middle) - done) > 0:
                    lo, held = middle, n
                else:
                    top = middle
            if pair:
                found, basis = [pair[0]], pair[1][:, None]
            else:
                basis = self._group(lo, top, held, vectors)
                found, turn = np.linalg.eigh(basis.T @ self.a @ basis)
                found, basis = found[::-1], (basis @ turn)[:, ::-1]
            slack = max(10 * SAME, 1e-14 * self.n) * self.scale
            if self.above(found[0] + slack) > done or self.above(found[-1] - slack) < done + len(found):
                raise ArithmeticError("counts don't certify an eigenvalue's number")
            values += [float(x) for x in found]
            vectors = np.column_stack((vectors, basis))
            done += len(found)
        return np.array(values[:most]), vectors[:, :most]


class Moments:
    """Count, sums and centred cross products of rows, batch by batch."""

    def __init__(self, d: int) -> None:
        self.n, self.sum, self.m = 0, np.zeros(d), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        own = x.sum(0)
        y = x - own / len(x)
        self.m += y.T @ y
        if self.n:
            apart = own / len(x) - self.sum / self.n
            self.m += np.outer(apart, apart) * (self.n * len(x) / (self.n + len(x)))
        self.sum = own + self.sum.astype(own.dtype)
        self.n += len(x)

    def rows(self) -> pa.RecordBatch:
        i, j = np.triu_indices(len(self.sum))
        k = len(i)
        return pa.RecordBatch.from_arrays([*map(pa.array, (np.full(k, len(self.sum), np.int32), i.astype(np.int32), j.astype(np.int32), np.full(k, self.n), self.sum[i], self.sum[j], self.m[i, j]))], names=["d", "i", "j", "n", "si", "sj", "m"])


MOMENTS = "d int, i int, j int, n long, si {0}, sj {0}, m double"


def merged(parts: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance (divisor n) of rows whose mean is known, from parts that are centred each at its own mean."""
    spark = parts.sparkSession
    means = F.broadcast(spark.createDataFrame([(k, float(x)) for k, x in enumerate(mean)], "k int, mean double"))
    both = parts.join(means.withColumnsRenamed({"k": "i", "mean": "mi"}), "i").join(means.withColumnsRenamed({"k": "j", "mean": "mj"}), "j")
    around = F.col("m") + F.col("n") * (F.col("si") / F.col("n") - F.col("mi")) * (F.col("sj") / F.col("n") - F.col("mj"))
    out = np.zeros((len(mean), len(mean)))
    for r in both.groupBy("i", "j").agg(F.sum(around.cast("double")).alias("m")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.m / n
    return out


def integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the usable vectors of each length: which rows they are, and their entries as integers."""
    col = batch.column("embedding")
    at = np.asarray(col.offsets).astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    size = np.diff(at)
    size[(bad[at[1:]] > bad[at[:-1]]) | np.asarray(col.is_null())] = 0
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = np.clip(np.floor(SCALE * values[at[rows][:, None] + np.arange(d)]), -MOST, MOST)
        yield rows, x.astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, Moments] = {}
    for b in batches:
        for _, x in integers(b):
            d = x.shape[1]
            known.setdefault(d, Moments(d)).add(x)
            if known[d].n >= FLUSH or len(known) > LENGTHS:
                for m in known.values():
                    yield m.rows()
                known.clear()
    for m in known.values():
        yield m.rows()


def _deviation(y: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sum of (n y - rest)^2 of each row, null beyond a long; a sum that fits has no square and no product that doesn't."""
    rough = ((float(n) * y - rest.astype(float)) ** 2).sum(1)
    sure, near = rough < 2.0**63 * (1 - 1e-9), rough < 2.0**63 * (1 + 1e-9)
    out = np.zeros(len(y), np.int64)
    out[sure] = ((n * y[sure] - rest) ** 2).sum(1)
    for k in np.flatnonzero(near & ~sure):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[k], rest, strict=True))
        sure[k], out[k] = exact < 1 << 63, min(exact, (1 << 63) - 1)
    return pa.array(out, mask=~sure)


def whiten(vectors: DataFrame, most: int = LEADING) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and leading component."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = cut(own.mapInArrow(_sums, MOMENTS.format("long")), "whitening-sums")
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    first = parts.where("i = 0 and j = 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return own.sparkSession.createDataFrame([], result)
    d, n = first.d, first.n
    total = {r.i: int(r.s) for r in parts.where(F.col("d") == d).where("i = j").groupBy("i").agg(F.sum(F.col("si").cast("decimal(38,0)")).alias("s")).collect()}
    whole, rest = (np.array(x, np.int64) for x in zip(*[divmod(total[k], n) for k in range(d)], strict=True))
    covariance = merged(parts.where(F.col("d") == d), np.array([total[k] / n for k in range(d)]), n)
    values, axes = Spectrum(covariance).leading(min(most, d))
    if not len(values):
        return own.sparkSession.createDataFrame([], result)
    scaled = axes / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Moments(len(values))
        names = ["vec_id", "deviation", "w", *[f.split()[0] for f in MOMENTS.split(", ")]]
        for b in batches:
            for rows, x in integers(b):
                if x.shape[1] == d:
                    y = x - whole
                    w = (y - rest / n) @ scaled
                    seen.add(w)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(values)), pa.array(w.reshape(-1)))
                    none = [pa.nulls(len(w), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), _deviation(y, n, rest), lists, *none], names=names)
        if seen.n:
            m = seen.rows()
            none = [pa.nulls(m.num_rows, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*none, *m.columns], names=names)

    made = cut(own.mapInArrow(project, "vec_id long, deviation long, w array<double>, " + MOMENTS.format("double")), "whitened")
    again = made.where("w is null")
    mean = {r.i: r.s / n for r in again.where("i = j").groupBy("i").agg(F.sum("si").alias("s")).collect()}
    error = float(np.abs(merged(again, np.array([mean[k] for k in range(len(values))]), n) - np.eye(len(values))).max())
    share = F.array(*[F.lit(float(x)) for x in values / np.trace(covariance)])
    each = made.where("w is not null").select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
