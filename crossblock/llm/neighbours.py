"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Centroids are fitted on a bounded sample (SAMPLE vectors); every vector is put in the list of
its nearest centroid. How many lists a query probes is measured on the sample: enough that the
share RECALL of the sample's own neighbours lies in them. A probed list is scanned in column
blocks of randomly rotated unit vectors: after each block the partial distance estimates the
whole one, and candidates that a hypothesis test puts beyond the fifth best so far are given
up. What is left is scored exactly, in double precision, on the original vectors.

Lists are cut into chunks and a list's queries into blocks, both of bounded size, so a hot list
is many tasks. Vectors that are null, zero, or hold null or non-finite components take no part,
neither do rows without an id. Vectors of different width are searched apart, each width with
its own index. Rows that repeat an id count once, with their best score, and take one of the k
places; a query id that repeats asks with the smallest of its vectors, compared component by
component, in every width that it has. A query's own id is not among
its answers. Ties go to the smaller id. A query whose lists give fewer than k ids is asked
again in all lists, so a query with fewer candidates gets them all. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossblock.session import cut

SAMPLE, SAMPLE_QUERIES, RECALL, SEED = 20_000, 400, 0.97, 11
LISTS, ROUNDS = 1024, 8
#: Widths that one table may mix.
MOST_WIDTHS = 100
#: Components of a column block; the test's quantile, in units of 1 / sqrt(components seen).
BLOCK, EPSILON = 16, 2.1
FOUND = "query_id long, id long, score double"
#: Candidates of a chunk, queries of a block, about; candidates scored to have a first bound.
CHUNK_ROWS, QUERY_ROWS, FIRST = 4096, 2048, 64


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each vector, nearest first."""
        near = unit @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares stay in range
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def _centroids(unit: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means."""
    centres = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = np.bincount(own, minlength=lists) == 0
        sums[empty] = unit[rng.choice(len(unit), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """About SAMPLE of the n rows (id, v), or fewer if rows repeat: equal rows are one."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < min(1.0, SAMPLE / max(n, 1))).select("id", "v").distinct()


def fit(rows: DataFrame, n: int, k: int) -> Index:
    """The index of `rows` (id, v), fitted on a sample of distinct rows by their hash."""
    held = sampled(rows, n).orderBy("id", "v").toPandas()
    rng = np.random.default_rng(SEED)
    if held.empty:
        held = rows.orderBy("id", "v").limit(1).toPandas()
    ids, unit = held["id"].to_numpy(), units(np.stack(held["v"].to_numpy()))
    lists = max(1, min(LISTS, len(unit), round(math.sqrt(n) / 4)))
    centroids = _centroids(unit, lists, rng)
    rotation, _ = np.linalg.qr(rng.standard_normal((unit.shape[1], unit.shape[1])))
    index = Index(centroids, rotation, lists)
    asked = rng.choice(len(unit), min(SAMPLE_QUERIES, len(unit)), replace=False)
    near = unit[asked] @ unit.T
    near[ids[asked][:, None] == ids[None, :]] = -np.inf
    # The k nearest other ids of each, by their best rows.
    answers, asking = [], []
    for i, row in enumerate(near):
        order = np.argsort(-row)
        order = order[: np.count_nonzero(row > -np.inf)]
        _, first = np.unique(ids[order], return_index=True)
        best = order[np.sort(first)[:k]]
        answers.extend(best)
        asking.extend([i] * len(best))
    if not answers:
        return index
    own = index.nearest(unit, 1)[:, 0]
    place = np.empty((len(asked), lists), np.int64)
    np.put_along_axis(place, index.nearest(unit[asked], lists), np.arange(lists)[None, :], axis=1)
    ranks = np.sort(place[asking, own[answers]])
    return Index(centroids, rotation, int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1)


def scan(query: np.ndarray, blocks: list[np.ndarray], limit: float, alive: np.ndarray) -> np.ndarray:
    """Candidates (columns of the blocks) that no test has put beyond the squared distance `limit`."""
    whole = sum(len(b) for b in blocks)
    part, seen = np.zeros(len(alive)), 0
    for block in blocks:
        part = part + ((block[:, alive] - query[seen : seen + len(block), None]) ** 2).sum(axis=0)
        seen += len(block)
        slack = (1 + EPSILON / math.sqrt(seen)) ** 2 if seen < whole else 1 + 1e-5
        keep = part * (whole / seen) <= limit * slack
        alive, part = alive[keep], part[keep]
    return alive


def search_chunk(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 rotation: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, id, cosine) of each query's k nearest ids in a chunk, each by its best row."""
    norms = np.sqrt((v**2).sum(axis=1))
    turned = np.ascontiguousarray((units(v) @ rotation).T)
    blocks = [turned[i : i + BLOCK] for i in range(0, len(turned), BLOCK)]
    wanted = units(queries) @ rotation
    for qid, q, turned_q in zip(query_ids.tolist(), queries, wanted, strict=True):
        q_norm = np.sqrt((q**2).sum())
        others = np.flatnonzero(ids != qid)
        found = np.zeros(0, np.int64)
        score = np.zeros(0)
        # The first few give a bound, the rest are scanned against it in growing parts.
        edges = [0, FIRST, *range(1024, len(others) + 1024, 1024)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            part = others[low:high]
            if not len(part):
                continue
            if len(found) >= k:
                part = scan(turned_q, blocks, 2 - 2 * score[-1], part)
            exact = (v[part] * q).sum(axis=1) / (norms[part] * q_norm)
            found, score = np.concatenate([found, part]), np.concatenate([score, exact])
            order = np.lexsort((ids[found], -score))
            # The first row of every id in that order, so that k places are k ids.
            _, first = np.unique(ids[found][order], return_index=True)
            best = order[np.sort(first)[:k]]
            found, score = found[best], score[best]
        yield from ((qid, int(i), float(s)) for i, s in zip(ids[found], score, strict=True))


def search(vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding",
           k: int = 5) -> DataFrame:
    """query_id, rank, id and score of the k nearest found for every row that `queries` selects.

    `queries` is a condition on the column `id`.
    """
    rows = usable(vectors, key, vector)
    counts = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").limit(MOST_WIDTHS + 1).collect()
    if len(counts) > MOST_WIDTHS:
        raise ValueError(f"vectors of more than {MOST_WIDTHS} widths")
    parts = [_search_width(rows.where(F.size("v") == r["d"]), r["n"], queries, k) for r in counts]
    if not parts:
        return _ranked(vectors.sparkSession.createDataFrame([], FOUND), k)
    return parts[0] if len(parts) == 1 else _ranked(reduce(DataFrame.unionByName, parts), k)


def _search_width(rows: DataFrame, n: int, queries: Column, k: int) -> DataFrame:
    """The k nearest of each query among `rows` (id, v) of one width."""
    index = fit(rows, n, k)
    probes = index.probes

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                lists = index.nearest(units(np.stack(batch["v"].to_numpy())), probes)
                yield batch.assign(lists=list(lists.astype(np.int32)))

    # A vector's own list comes first.
    listed = cut(rows.mapInPandas(assign, "id long, v array<double>, lists array<int>"))
    stored = listed.select("id", "v", F.get("lists", F.lit(0)).alias("list"))
    one = listed.where(queries).groupBy("id").agg(F.min(F.struct("v", "lists")).alias("own"))
    one = cut(one.select("id", "own.v", "own.lists"))

    def counted(frame: DataFrame) -> dict[int, int]:
        # One row per list, at most LISTS.
        return {r["list"]: r["n"] for r in frame.groupBy("list").agg(F.count("*").alias("n")).collect()}

    held = counted(stored)

    def parts(counts: dict[int, int], rows_each: int) -> Column:
        pairs = [F.lit(x) for at, n in sorted(counts.items()) for x in (at, -(-n // rows_each))]
        known = F.create_map(*pairs) if pairs else F.create_map().cast("map<int,int>")
        return F.coalesce(F.element_at(known, F.col("list")), F.lit(1)).cast("int")

    def dealt(frame: DataFrame, own: Column, own_name: str, every: Column, every_name: str) -> DataFrame:
        return frame.withColumn(own_name, F.pmod(F.xxhash64("id"), own).cast("int")).withColumn(
            every_name, F.explode(F.sequence(F.lit(0), every - 1))
        )

    def answer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        left = left.sort_values("id")
        found = search_chunk(
            left["id"].to_numpy(), np.stack(left["v"].to_numpy()),
            right["id"].to_numpy(), np.stack(right["v"].to_numpy()), index.rotation, k,
        )
        return pd.DataFrame(list(found), columns=["query_id", "id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        chunks, blocks = parts(held, CHUNK_ROWS), parts(counted(asked), QUERY_ROWS)
        group = ["list", "chunk", "block"]
        return (
            dealt(stored, chunks, "chunk", blocks, "block")
            .groupBy(*group)
            .cogroup(dealt(asked, blocks, "block", chunks, "chunk").groupBy(*group))
            .applyInPandas(answer, FOUND)
        )

    ranked = _ranked(searched(one.select("id", "v", F.explode("lists").alias("list"))), k)
    if probes == len(index.centroids):
        return ranked
    ranked = cut(ranked)
    full = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = cut(one.join(full, "id", "left_anti").select("id", "v"))
    if short.isEmpty():
        return ranked
    every = F.explode(F.array(*[F.lit(x) for x in sorted(held)])).alias("list")
    again = _ranked(searched(short.select("id", "v", every)), k)
    settled = ranked.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return settled.unionByName(again)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
