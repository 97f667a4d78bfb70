"""Embedding whitening: Golub-Kahan-Lanczos bidiagonalisation of centred integer vectors.

Entries c become x = floor(64 c) + 1000000. The fit list holds every distinct x vector once; it
is a written table, of which every step is one distributed pass. A pass takes the new right
vector v to p = Xv on its own rows and p back to X'p, so the products alternate inside the
tasks; X is centred there, by an integer part and a rest, and never stored centred. Left
vectors are not stored either: each is u = Xa for a short vector a, so a pass remakes all
earlier ones on its rows and measures p against every one of them. That is the full
reorthogonalisation of the left side; X'u follows from X'p by the same coefficients. Right
vectors are short and reorthogonalised twice. The singular values and vectors of the small
bidiagonal matrix give components and deviations.

A step that finds nothing new starts again from a fresh direction, so repeated eigenvalues are
found. The search ends when the wanted components are exact to rounding and the variance outside
the searched directions is smaller than the last of them, or when all directions are searched.

A task sends one row of a few short vectors, and the tasks of a pass are a few for every core.

Rows whose vector is missing, empty or holds a missing or non-finite entry, or one whose x is no
long of 62 bits, are left out. Vectors of different width are whitened apart, each width with its
own fit list. Repeated rows and ids all get their rows back. Components without variance are not
given: one distinct vector alone has none, and an empty table gives an empty result. Equal
eigenvalues share a space, of which any basis is right. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.session import cut

STEP, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of a block of rows that a task holds as doubles.
BLOCK = 1 << 20
#: Widths that one table may mix.
MOST_WIDTHS = 100
_EPS = np.finfo(float).eps


def grid(vector: str) -> Column:
    """x of every entry, or NULL where the row takes no part."""
    held = F.col(vector)

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**55)

    x = F.transform(held, lambda c: F.floor(c.cast("double") * STEP).cast("long") + SHIFT)
    return F.when((F.size(held) > 0) & F.forall(held, usable), x)


@dataclass(frozen=True)
class Centre:
    """n distinct vectors with per-dimension sums; their mean is whole + rest, rest in [0, 1)."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], float) / self.n

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum of (n x - S)^2 of each row, exactly; None beyond 38 digits."""
        off = x - self.whole
        left = np.array([s % self.n for s in self.sums], object)
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            each = self.n * off - left.astype(np.int64)
            return [Decimal(int(v)) for v in np.einsum("ij,ij->i", each, each)]
        each = self.n * off.astype(object) - left
        found = [sum(v * v for v in row) for row in each]
        return [Decimal(v) if v < 10**38 else None for v in found]


def _blocks(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
        rows = values.reshape(-1, width)
        step = max(1, BLOCK // width)
        for low in range(0, len(rows), step):
            yield rows[low : low + step]


def _gathered(fit: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> np.ndarray:
    """The sum of `work` over blocks of x rows: by task first, then over the tasks in order.

    Whole numbers (an object array) travel as text and stay exact.
    """
    exact = start.dtype == object

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start
        for block in _blocks(batches, "x", width):
            total = total + work(block)
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        held = pa.array([[str(v) for v in total]] if exact else [total])
        yield pa.RecordBatch.from_arrays([part, held], ["part", "total"])

    few = fit.coalesce(4 * fit.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(task, f"part int, total array<{'string' if exact else 'double'}>").collect()
    totals = (np.array([int(v) for v in r["total"]], object) if exact else np.array(r["total"]) for r in sorted(found))
    return sum(totals, start)


def centre(fit: DataFrame, width: int) -> Centre:
    def count(x: np.ndarray) -> np.ndarray:
        low = (x & 0xFFFFFFFF).sum(0).astype(object)
        return np.array([len(x), *((x >> 32).sum(0).astype(object) * (1 << 32) + low)], object)

    n, *sums = (int(v) for v in _gathered(fit, width, count, np.array([0] * (width + 1), object)))
    return Centre(n, tuple(sums))


@dataclass(frozen=True)
class Whitening:
    """Unit components (one a column), their variances, and how white the fit list becomes."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    steps: int

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.variances]


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]],
    width: int,
    trace: float,
    wanted: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading right singular vectors and squared singular values, and the steps taken.

    product(v, A) gives X'Xv, (XA)'Xv and |Xv|^2; trace is the sum of all squared singular values.
    """
    draw = np.random.default_rng(11)
    right, lefts, images = (np.zeros((width, 0)) for _ in range(3))
    alpha: list[float] = []
    beta: list[float] = []
    seen, small = 0.0, width * _EPS * np.sqrt(trace)

    def fresh() -> np.ndarray:
        v = draw.standard_normal(width)
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v / np.linalg.norm(v)

    v = fresh()
    while True:
        back, common, size = product(v, lefts)
        seen += size
        a, image = v - lefts @ common, back - images @ common
        norm = np.sqrt(max(size - common @ common, 0.0))
        if norm <= small:
            norm, a, image = 0.0, np.zeros(width), np.zeros(width)
        else:
            a, image = a / norm, image / norm
        right, lefts, images = (np.column_stack(pair) for pair in ((right, v), (lefts, a), (images, image)))
        alpha.append(norm)
        steps = len(alpha)
        w = image - norm * v
        for _ in range(2):
            w = w - right @ (right.T @ w)
        step = float(np.linalg.norm(w))
        step = 0.0 if step <= small else step
        left, values, turned = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        rest = max(trace - seen, 0.0)
        k = min(wanted, steps)
        exact = step * values[:k] * np.abs(left[-1, :k]) <= 4 * _EPS * values[0] ** 2
        done = steps >= wanted and exact.all() and rest < values[k - 1] ** 2
        if done or steps == width or rest <= width * _EPS * trace:
            held = values[:k] > max(small, width * _EPS * values[0])
            return right @ turned[:k][held].T, values[:k][held] ** 2, steps
        beta.append(step)
        v = w / step if step else fresh()


def fit(vectors: DataFrame, width: int, wanted: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct rows `x` (array of longs, all of one width) of a written table.

    None if they have no variance.
    """
    distinct = cut(vectors.select("x").distinct())
    middle = centre(distinct, width)
    whole, rest = middle.whole, middle.rest

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest

    def energy(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return np.array([np.einsum("ij,ij", y, y)])

    trace = float(_gathered(distinct, width, energy, np.zeros(1))[0]) / middle.n
    if not trace > 0:
        return None

    def product(v: np.ndarray, lefts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def work(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            p = y @ v
            return np.concatenate([y.T @ p, (y @ lefts).T @ p, [p @ p]])

        total = _gathered(distinct, width, work, np.zeros(width + lefts.shape[1] + 1)) / middle.n
        return total[:width], total[width:-1], float(total[-1])

    components, variances, steps = bidiagonalise(product, width, trace, wanted)
    k, scaled = len(variances), components / np.sqrt(variances)

    def spread(x: np.ndarray) -> np.ndarray:
        white = centred(x) @ scaled
        return np.concatenate([white.sum(0), (white.T @ white).ravel()])

    found = _gathered(distinct, width, spread, np.zeros(k + k * k)) / middle.n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(middle, components, variances, trace, error, steps)


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row per row of (key, x) and component."""
    middle, width = model.centre, len(model.components)
    whole, rest = middle.whole, middle.rest
    scaled = model.components / np.sqrt(model.variances)
    kind = vectors.schema["key"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(iter([batch]), "x", width):
                white = ((x - whole) - rest) @ scaled
                flat = pa.array(white.ravel())
                edges = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
                columns = [
                    batch.column("key").slice(at, len(x)),
                    pa.array(middle.deviations(x), pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(edges, flat),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "deviation", "white"])
                at += len(x)

    rows = vectors.mapInArrow(task, f"key {kind.simpleString()}, deviation decimal(38,0), white array<double>")
    each = rows.select("key", "deviation", F.posexplode("white").alias("at", "whitened"))
    shares = F.array(*[F.lit(v) for v in model.explained])
    return each.select(
        "key",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(middle.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Whitened rows (key, component, n, deviation, whitened, explained, identity_error)."""
    kept = cut(rows.select(F.col(key).alias("key"), grid(vector).alias("x")).where("x IS NOT NULL"))
    sizes = kept.groupBy(F.size("x").alias("width")).count().orderBy("width").limit(MOST_WIDTHS + 1).collect()
    if len(sizes) > MOST_WIDTHS:
        raise ValueError(f"vectors of more than {MOST_WIDTHS} widths")
    schema = (
        f"key {kept.schema['key'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), "
        "whitened double, explained double, identity_error double"
    )
    result = rows.sparkSession.createDataFrame([], schema)
    for row in sizes:
        width = row["width"]
        vectors = kept.where(F.size("x") == width)
        model = fit(vectors, width, wanted)
        if model is not None:
            result = result.unionByName(transform(vectors, model))
    return result
