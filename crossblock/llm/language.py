"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams, hashed to a fixed number of buckets.
Document frequencies are counted over all learnable texts. The weights are trained with
follow-the-regularised-leader and an elastic net on a bounded sample (SAMPLE texts, spread
evenly over the languages); a part of the sample is kept back to calibrate the temperature of
the probabilities. Whole texts are read, in case-folded code points, other characters than
letters standing for a space.

A text that is missing or has no letter is `und` with score 0. Texts without a language are
not learnt from but predicted. Equal texts get equal predictions; ties go to the language
first in order. Without a learnable text all is `und`; with one language that one is certain.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.llm.arrays import Chunk, chunks

BITS, ORDERS = 15, (1, 2, 3)
BUCKETS = 1 << BITS
#: Texts to train on, at most about; share of them kept back for the temperature; seed.
SAMPLE, KEPT_BACK, SEED = 6_000, 0.2, 5
#: Languages whose weights fit into one task.
MOST_LANGUAGES = 1_000
#: Follow-the-regularised-leader: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.002, 2
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Buckets and counts of each text of a chunk of folded texts, and if it has a letter."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    # Code points begin at the bytes that do not continue one.
    begins = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    edges = begins[chunk.edges]
    letter = letters()[points]
    c = np.where(letter, points, 32).astype(np.uint32)
    hashed = []
    for order in ORDERS:
        m = max(len(c) - order + 1, 0)
        h = np.full(m, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(order):
            h ^= c[k : k + m]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        hashed.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = [h[low : max(high - k, low)] for k, h in zip((o - 1 for o in ORDERS), hashed, strict=True)]
        count = np.bincount(np.concatenate(own), minlength=BUCKETS)
        at = np.flatnonzero(count)
        yield at, count[at], bool(letter[low:high].any())


def weighted(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf[at]
    return value / max(np.sqrt((value**2).sum()), 1e-12)


def folded(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each bucket, over all rows; BUCKETS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for chunk in chunks(folded(batch.column(0))):
                for at, _, _ in grams(chunk):
                    total[at] += 1
                rows += chunk.n
        total[BUCKETS] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS + 1, np.int64)
    for r in found.collect():
        total[r["at"]] = r["n"]
    return total[:BUCKETS], int(total[BUCKETS])


def sampled(learnable: DataFrame, size: int) -> pd.DataFrame:
    """About `size` distinct texts as bucket counts, the languages in equal parts as far as they go.

    Every language has at least one. Repeated rows are one.
    """
    draw = F.pmod(F.xxhash64(F.lit(SEED), "key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = learnable.groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("lowest"))
    counts = {r["lang"]: r for r in each.limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "at": [], "n": []})
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    part = size / len(counts)
    rates = [F.lit(v) for k, r in counts.items() for v in (k, max(min(1.0, part / r["n"]), r["lowest"]))]
    rate = F.element_at(F.create_map(*rates), F.col("lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(folded(batch.column(2))):
                found = [(at.astype("<u4").tobytes(), n.astype("<u4").tobytes()) for at, n, _ in grams(chunk)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.n),
                        batch.column(1).slice(chunk.first, chunk.n),
                        pa.array([f[0] for f in found], pa.binary()),
                        pa.array([f[1] for f in found], pa.binary()),
                    ],
                    names=["key", "lang", "at", "n"],
                )

    kind = learnable.schema["key"].dataType.simpleString()
    chosen = learnable.where(draw <= rate).select("key", "lang", "text").distinct()
    frame = chosen.mapInArrow(vectors, f"key {kind}, lang string, at binary, n binary").toPandas()
    # An order of its own, the same in every run.
    return frame.sort_values(["lang", "key", "at", "n"], ignore_index=True)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.bias


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the examples in turn; the last row of the state is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def current(at: np.ndarray) -> np.ndarray:
        held = z[at]
        shrunk = np.sign(held) * np.maximum(np.abs(held) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for at, value, label in examples:
        at, value = np.append(at, BUCKETS), np.append(value, 1.0)
        w = current(at)
        logit = value @ w
        p = np.exp(logit - logit.max())
        p /= p.sum()
        p[label] -= 1
        g = value[:, None] * p
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown
    every = current(np.arange(BUCKETS + 1))
    return every[:-1], every[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the smallest log loss, on a grid of ratios.

    One more text of any language is added to the count, so that a sample without an error
    does not make every score 1.
    """
    if not len(labels):
        return 1.0
    doubt = 1 / (len(labels) + 2)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 20, 120):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        logs = np.log(np.exp(x).sum(axis=1, keepdims=True)) - x
        told = logs[np.arange(len(labels)), labels]
        loss = float(((1 - doubt) * told + doubt * logs.mean(axis=1)).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
        where: Column | None = None, size: int = SAMPLE) -> Model:
    """Learn from the rows that `where` allows and that have a language and a letter."""
    allowed = docs if where is None else docs.where(where)
    learnable = allowed.select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    frame = sampled(learnable, size)
    languages = tuple(sorted(frame["lang"].unique()))
    df, rows = frequencies(learnable)
    idf = np.log((1 + rows) / (1 + df)) + 1
    examples = []
    for name, at, n in zip(frame["lang"], frame["at"], frame["n"], strict=True):
        where_ = np.frombuffer(at, "<u4").astype(np.int64)
        examples.append((where_, weighted(where_, np.frombuffer(n, "<u4"), idf), languages.index(name)))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(examples))
    back = order[: int(len(order) * KEPT_BACK)] if len(languages) > 1 else order[:0]
    rest = order[len(back) :]
    turns = [examples[i] for _ in range(EPOCHS) for i in rng.permutation(rest)]
    weights, bias = train(turns, max(len(languages), 1))
    model = Model(languages, idf, weights.astype(np.float32), bias, 1.0)
    logits = np.array([model.logits(examples[i][0], examples[i][1]) for i in back]).reshape(len(back), weights.shape[1])
    heat = temperature(logits, np.array([examples[i][2] for i in back], dtype=int))
    return Model(languages, idf, model.weights, bias, heat)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for chunk in chunks(folded(batch.column(1))):
                names, scores = [], []
                for at, count, solid in grams(chunk):
                    if not solid or not held.languages:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    x = held.logits(at, weighted(at, count, held.idf)) / held.temperature
                    p = np.exp(x - x.max())
                    names.append(held.languages[int(p.argmax())])
                    scores.append(float(p.max() / p.sum()))
                keys = batch.column(0).slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["key", "lang_pred", "score"],
                )

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(apply, f"key {kind}, lang_pred string, score double")
