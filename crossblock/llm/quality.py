"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text gives a vector of transformed statistics (shares as log odds, sizes as logs). Sums,
products and counts of the labelled vectors are aggregated per class; from them come the class
means and covariances, each shrunk towards the pooled one and that towards its diagonal. The
score is the posterior of class 1, from the difference of the two Gaussian log densities, whose
Mahalanobis terms use Cholesky factors made once. All labelled rows are learnt from.

Missing and empty texts have the statistics of no words and get a score like others. Ties
need no rule. Repeated documents are scored each; a key with several labels counts as its
smallest. Labels of unknown keys are ignored. With one class only, every score is 1 or 0 for
that class, and 0.5 without labels. An empty table gives an empty result. Extra columns are
kept by `keep` and ignored by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.llm.arrays import SPACE, Chunk, chunks, word_hashes, words

STATISTICS = (
    "upper", "symbol", "shout", "digit", "space", "stop", "comma", "high", "word_mean", "word_spread",
    "short", "capital", "types", "top_word", "line_mean", "line_repeat", "line_closed", "entropy",
)
#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL, THRESHOLD = 0.1, 0.1, 0.3
#: Standard units beyond which a statistic counts no further.
BEND = 6.0


def _bytes(*groups: str) -> np.ndarray:
    mask = np.zeros(256)
    mask[[b for g in groups for b in g.encode()]] = 1
    return mask


UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
CLASSES = np.stack([
    UPPER, LOWER, _bytes("#$%&*+/<=>@[]^_`{|}~\\"), _bytes("!?"), _bytes("0123456789"),
    SPACE.astype(float), _bytes("."), _bytes(",;:"), (np.arange(256) >= 128).astype(float),
], axis=1)


def log_odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i + 1]]."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _repeats(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, per text."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(fresh)
    runs = np.diff(np.append(first, len(hashes)))
    distinct = np.bincount(owner[first], minlength=len(edges) - 1)
    top = np.zeros(len(edges) - 1)
    np.maximum.at(top, owner[first], runs)
    return distinct.astype(float), top


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of STATISTICS for each text of a chunk."""
    n, edges, data = chunk.n, chunk.edges, chunk.data
    histogram = np.stack([np.bincount(data[edges[i] : edges[i + 1]], minlength=256) for i in range(n)])
    size = np.diff(edges).astype(float)
    upper, lower, symbol, shout, digit, space, stop, comma, high = (histogram @ CLASSES).T
    found = words(chunk)
    hashes = word_hashes(chunk, found)
    count = np.diff(found.edges).astype(float)
    some = np.maximum(count, 1)
    lengths = (found.ends - found.starts).astype(float)
    mean = _per_text(lengths, found.edges) / some
    square = _per_text(lengths**2, found.edges) / some
    short = _per_text(lengths <= 3, found.edges)
    capital = _per_text(UPPER[data[found.starts]], found.edges)
    types, top = _repeats(hashes, found.edges)
    # Lines are runs between line feeds; a text's last line ends with the text.
    ends = np.union1d(np.flatnonzero(data == 10), edges[1:][size > 0] - 1)
    line_edges = np.searchsorted(ends, edges)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    line_hash = _line_hashes(data, starts, ends + 1)
    lines = np.diff(line_edges).astype(float)
    distinct_lines, _ = _repeats(line_hash, line_edges)
    last = np.where(data[ends] == 10, np.maximum(ends - 1, 0), ends) if len(ends) else ends
    # An empty line has no last character, not even that of the text before.
    ended = np.isin(data[last], list(b".!?:\"'")) & (last >= starts) if len(ends) else last
    closed = _per_text(ended, line_edges) if len(ends) else np.zeros(n)
    share = histogram / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    letters = upper + lower
    return np.column_stack([
        log_odds(upper, letters), log_odds(symbol, size), log_odds(shout, size), log_odds(digit, size),
        log_odds(space, size), log_odds(stop, count), log_odds(comma, count), log_odds(high, size),
        np.log1p(mean), 0.5 * np.log1p(np.maximum(square - mean**2, 0)),
        log_odds(short, count), log_odds(capital, count),
        np.log1p(types) / np.log1p(some), log_odds(top, count),
        np.log1p(size / np.maximum(lines, 1)), log_odds(lines - distinct_lines, lines),
        log_odds(closed, lines), entropy,
    ])


def _line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([hash(raw[s:e].strip()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)


def measured(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the vector of statistics; texts go no further."""
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for chunk in chunks(batch.column(1)):
                values = statistics(chunk)
                flat = pa.array(values.ravel())
                width = len(STATISTICS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, chunk.n * width + 1, width, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([keys.slice(chunk.first, chunk.n), lists], names=["key", "x"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(measure, f"key {kind}, x array<double>")


@dataclass(frozen=True)
class Model:
    """Scale of the statistics, class means, inverse Cholesky factors and constants."""

    classes: tuple[int, ...]
    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), {(): 0.5, (0,): 0.0, (1,): 1.0}[self.classes])
        x, logs = squash(x, self.centre, self.spread), []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = (x - mean) @ factor.T
            logs.append(constant - 0.5 * (z**2).sum(axis=1))
        gap = np.clip(logs[1] - logs[0], -700, 700)
        return 1 / (1 + np.exp(-gap))


def squash(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standard units, bent so that no single statistic lies further out than BEND."""
    return BEND * np.tanh((x - centre) / spread / BEND)


def _moments(rows: DataFrame, centre: np.ndarray, spread: np.ndarray) -> dict[int, np.ndarray]:
    """Per class: count, sum and sum of products of the squashed vectors.

    Partitions send sums; two classes times (1 + d + d^2) numbers reach the driver.
    """
    d = len(STATISTICS)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for batch in batches:
            for value, part in batch.groupby("label"):
                v = squash(np.stack(part["x"].to_numpy()), centre, spread)
                sums = np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
                held[value] = held.get(value, 0) + sums
        for value, sums in held.items():
            yield pd.DataFrame({"label": value, "at": np.arange(len(sums)), "value": sums})

    sums = rows.mapInPandas(partial, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r["label"], np.zeros(1 + d + d * d))[r["at"]] = r["v"]
    return found


def fit(labelled: DataFrame, *, x: str = "x", label: str = "label") -> Model:
    """Learn from all rows with a 0/1 label; only sums reach the driver."""
    d = len(STATISTICS)
    rows = labelled.select(F.col(x).alias("x"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    # First the scale, from one average per class and statistic, so that a class's share of
    # the labels does not move it.
    plain = rows.groupBy("label").agg(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
        *[F.coalesce(F.stddev_pop(F.col("x")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(d)],
    ).collect()
    classes = tuple(sorted(r["label"] for r in plain))
    if len(classes) < 2:
        none = np.zeros((0, d))
        return Model(classes, none, none, none, none, none)
    centre = np.mean([[r[f"m{i}"] for i in range(d)] for r in plain], axis=0)
    spread = np.mean([[r[f"s{i}"] for i in range(d)] for r in plain], axis=0) + 1e-3
    moments = _moments(rows, centre, spread)
    counts = np.array([moments[c][0] for c in classes])
    means = np.stack([moments[c][1 : d + 1] / moments[c][0] for c in classes])
    scatter = np.stack([
        moments[c][d + 1 :].reshape(d, d) - moments[c][0] * np.outer(m, m) for c, m in zip(classes, means, strict=True)
    ])
    pooled = scatter.sum(axis=0) / counts.sum()
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
    factors, constants = [], []
    for n, s in zip(counts, scatter, strict=True):
        pull = max(TO_POOLED, d / (n + d))
        low = np.linalg.cholesky((1 - pull) * s / n + pull * pooled)
        factors.append(np.linalg.inv(low))
        constants.append(np.log(n / counts.sum()) - np.log(np.diag(low)).sum())
    return Model(classes, centre, spread, means, np.stack(factors), np.array(constants))


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """Adds `score`, the posterior of class 1, to a frame (key, x)."""
    kind = vectors.schema["key"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["key", "score"])

    return vectors.select("key", "x").mapInArrow(apply, f"key {kind}, score double")


def kept(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores the threshold or more."""
    schema, at = docs.schema, docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(statistics(chunk)) for chunk in chunks(batch.column(at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(apply, schema)


def with_labels(vectors: DataFrame, labels: DataFrame, *, key: str, label: str, where: Column) -> DataFrame:
    """Vectors of labelled keys; `where` (over the column key) says which keys may be learnt from."""
    known = labels.groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    return vectors.where(where).join(known, "key")
