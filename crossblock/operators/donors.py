"""Replacement vectors: partner, donor of another block, mean, or norm-matched noise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from crossblock.functions import keyed
from crossblock.functions.keyed import digest, index_draw
from crossblock.functions.names import SOURCE_KINDS
from crossblock.functions.values import insist, insist_once
from crossblock.operators.patch import sweep_grid
from crossblock.operators.ranking import hash_bucketed, prefix_sums
from crossblock.operators.score import spread_rows
from crossblock.session import cut


def donor_ranges(cells: DataFrame) -> DataFrame:
    """Lay the pool's blocks end to end in hash order: block_id owns the indices [lo, lo + m)."""
    blocks = cells.groupBy("block_id").agg(F.count("*").alias("m"))
    hashed, bucket = hash_bucketed(cut(blocks.withColumn("_h", digest("pool", "block_id"))), [], "_h", "_b")
    laid = prefix_sums(
        hashed, {"lo": F.col("m")}, group=[], order=["_h", "block_id"], bucket=bucket
    )
    return laid.select("block_id", "m", "lo")


def draw_donors(
    pairs: DataFrame, cells: DataFrame, *, key: Sequence[str], seed: int | str
) -> DataFrame:
    """One donor cell per pair, uniform over the pool outside the pair's own block.

    The draw is an index into the pool with the own range cut out, so no redraw is needed.
    A pair whose block is the whole pool is an error. `seed` should name position and kind;
    the layer stays out of it, so one donor serves all layers. A block has at most four
    cells, which the numbering inside a block relies on. Where cells have a `row`, the donor's
    comes with it.
    """
    ranges = cut(donor_ranges(cells))
    placed = (
        pairs.join(
            ranges.select("block_id", F.col("lo").alias("_lo"), F.col("m").alias("_m")),
            "block_id",
            "left",
        )
        .withColumn("_m", F.coalesce("_m", F.lit(0)))
        .withColumn("_free", F.coalesce(ranges.agg(F.sum("m")).scalar(), F.lit(0)) - F.col("_m"))
    )
    placed = insist(placed, F.col("_free") > 0, "no donor outside the own block")
    u = index_draw(F.col("_free"), seed, *key)
    skip = (F.col("_m") > 0) & (u >= F.col("_lo"))
    inner = Window.partitionBy("block_id").orderBy("cell")
    rows = ["row"] if "row" in cells.columns else []
    pool = (
        cells.select("block_id", "cell", *rows, (F.row_number().over(inner) - 1).alias("_i"))
        .join(ranges, "block_id")
        .select(
            (F.col("lo") + F.col("_i")).alias("_u"),
            F.col("block_id").alias("donor_block"),
            F.col("cell").alias("donor_cell"),
            *[F.col(r).alias("donor_row") for r in rows],
        )
    )
    drawn = placed.withColumn("_u", F.when(skip, u + F.col("_m")).otherwise(u))
    found = insist(
        drawn.join(pool, "_u", "left"), F.col("donor_cell").isNotNull(), "a drawn donor is not in the pool"
    )
    return found.drop("_u", "_lo", "_m", "_free")


def gather_vectors(
    pairs: DataFrame,
    vectors: DataFrame,
    *,
    row: str = "source_row",
    layers: Sequence[int] = (),
    positions: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Source vectors of each pair, one row per (pair, position, layer).

    Every pair must have one vector at each wanted position and layer (without a wish: at each
    that the table has), or the job fails and names the row; with strict=False a pair that
    has none gets a NULL vector instead. Checking reads keys only. The join is on the row alone,
    so vectors stored in buckets of rows stay where they are.
    """
    held = vectors
    if layers:
        held = held.where(F.col("layer").isin([int(x) for x in layers]))
    if positions:
        held = held.where(F.col("position").isin(list(positions)))
    gathered = pairs.join(held.withColumnRenamed("row", row), row, "left")
    if not strict:
        return gathered
    if layers and positions:
        wanted = F.lit(len({int(x) for x in layers}) * len(set(positions)))
    else:
        wanted = held.select("position", "layer").distinct().agg(F.count("*")).scalar()
    places = F.struct("position", "layer")
    counts = held.groupBy(F.col("row").alias(row)).agg(
        F.count("*").alias("_rows"), F.count_distinct(places).alias("_places")
    )
    asked = pairs.select(row).distinct().join(counts, row, "left")
    whole = (F.col("_rows") == wanted) & (F.col("_places") == wanted)
    wrong = asked.where(~F.coalesce(whole, F.lit(False))).agg(
        F.min(F.coalesce(F.col(row).cast("string"), F.lit("NULL"))).alias("row")
    )
    message = F.concat(F.lit("missing or repeated vectors of row "), F.col("row"))
    checked = insist_once(gathered, wrong, F.col("row").isNull(), message)
    return insist(checked, F.col("vec").isNotNull(), F.concat(F.lit("no vector of row "), F.col(row).cast("string")))


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """Mean vector over all rows per (position, layer), combined as vectors before the shuffle."""
    summary = Summarizer.mean(array_to_vector(F.col("vec")))
    means = vectors.groupBy("position", "layer").agg(summary.alias("_mean"))
    return means.select("position", "layer", vector_to_array("_mean", "float32").alias("vec"))


def norm(vec: str | Column) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(total)


def gaussian_vectors(
    sources: DataFrame, *, key: Sequence[str], seed: int, kind: str = "gaussian"
) -> DataFrame:
    """Replace each vector by Gaussian noise of the same norm.

    Box-Muller on counter-based draws: element j of a row is a function of (seed, position,
    kind, key, layer) and j, so the noise does not depend on partitioning. A missing vector
    stays missing; a missing element makes every element of its noise missing (NaN).
    """
    parts = ["position", F.lit(kind), *key, "layer"]
    seeded = sources.withColumn("_h", digest(seed, *parts)).withColumns(
        {"_h0": keyed.word(F.col("_h"), 0), "_h1": keyed.word(F.col("_h"), 1)}
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            widths = pdf["vec"].map(len, na_action="ignore")
            filled: list[np.ndarray | None] = [None] * len(pdf)
            for width, rows in pdf.groupby(widths).groups.items():
                width = int(width)
                words = pdf.loc[rows, ["_h0", "_h1"]].to_numpy().astype(np.uint32)
                x = keyed.np_mix32(keyed.np_first_mix(words[:, 0], 2 * width) ^ words[:, 1, None])
                u = (x.astype(np.float64) + 1.0) / 2.0**32
                noise = np.sqrt(-2.0 * np.log(u[:, 0::2])) * np.cos(2.0 * np.pi * u[:, 1::2])
                real = np.stack(pdf.loc[rows, "vec"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(noise, axis=1, keepdims=True)
                scale = np.linalg.norm(real, axis=1, keepdims=True) / np.where(size > 0, size, 1.0)
                for row, vec in zip(rows, (noise * scale).astype(np.float32), strict=True):
                    filled[row] = vec
            pdf["vec"] = filled
            yield pdf[names]

    names = sources.columns
    return seeded.drop("_h").mapInPandas(fill, sources.schema)


#: Source kinds that take a cell of another block, and the value of `matched` they draw from.
DONOR_POOLS = {"random_cell": None, "matched_donor": True, "crossed_donor": False}


def _along_layers(where: Column | None = None) -> Column:
    """Aggregate the vectors of a group to one array along the layers, on request only some of them."""
    held = F.struct("layer", "vec")
    return F.sort_array(F.collect_list(held if where is None else F.when(where, held)))


def gather_sources(
    requests: DataFrame, vectors: DataFrame, *, positions: Sequence[str], layers: Sequence[int]
) -> DataFrame:
    """Requests (_row, position, ...) with the vectors of their row at their position, as `sources`.

    The store is read once: a row's vectors become an array for each position, where they lie if
    they are stored in buckets of rows, and each request takes one of them. A request whose row
    has not one vector at each wanted layer fails the job, which names the row.
    """
    wanted = vectors.where(F.col("layer").isin(list(layers)) & F.col("position").isin(list(positions)))
    held = {p: f"_at{i}" for i, p in enumerate(positions)}
    rows = wanted.groupBy(F.col("row").alias("_row")).agg(
        *[_along_layers(F.col("position") == p).alias(name) for p, name in held.items()]
    )
    own = F.coalesce(*[F.when(F.col("position") == p, F.col(name)) for p, name in held.items()])
    met = requests.join(rows, "_row", "left").select(*requests.columns, own.alias("sources"))
    name = F.coalesce(F.col("_row").cast("string"), F.lit("NULL"))
    n, found = F.lit(len(layers)), F.col("sources.layer")
    whole = (F.size(found) == n) & (F.size(F.array_distinct(found)) == n)
    met = insist(met, whole, F.concat(F.lit("missing or repeated vectors of row "), name))
    return insist(met, F.size(F.array_compact("sources.vec")) == n, F.concat(F.lit("no vector of row "), name))


def control_sources(
    pairs: DataFrame,
    cells: DataFrame,
    vectors: DataFrame,
    *,
    positions: Sequence[str],
    layers: Sequence[int],
    kinds: Sequence[str] = tuple(SOURCE_KINDS),
    seed: int = 0,
) -> DataFrame:
    """Replacement vectors of every pair, position and source kind, along the layers.

    `pairs` has block_id, target_cell and source_row, `cells` the block_id, cell, row and matched
    of all rows, `vectors` theirs (row, layer, position, vec). Adds position, source_kind and
    `sources`, an array of structs (layer, vec). One donor is drawn per (pair, position, kind)
    and serves all layers. Vectors are read once and joined on the row, where they lie if they
    are stored in buckets of rows; only noise is moved. The means, positions x layers vectors,
    are broadcast.
    """
    unknown = set(kinds) - set(SOURCE_KINDS)
    if unknown:
        raise ValueError(f"unknown source kinds {sorted(unknown)}")
    layers = sorted({int(x) for x in layers})
    columns = [*pairs.columns, "position", "source_kind"]
    placed = sweep_grid(pairs, position=positions)
    asked = []
    for kind in kinds:
        own = placed.withColumn("source_kind", F.lit(kind))
        if kind in DONOR_POOLS:
            wanted = DONOR_POOLS[kind]
            pool = cells if wanted is None else cells.where(F.col("matched") == wanted)
            key = ["position", F.lit(kind), "block_id", "target_cell"]
            drawn = draw_donors(own, pool.select("block_id", "cell", "row"), key=key, seed=seed)
            asked.append(drawn.select(*columns, F.col("donor_row").alias("_row")))
        elif kind != "mean":
            asked.append(own.select(*columns, F.col("source_row").alias("_row")))
    parts = []
    if asked:
        requests = cut(reduce(DataFrame.unionByName, asked))
        met = gather_sources(requests, vectors, positions=positions, layers=layers)
        parts.append(met.where("source_kind <> 'gaussian'"))
        if "gaussian" in kinds:
            long = met.where("source_kind = 'gaussian'").select(*columns, "_row", F.inline("sources"))
            noise = gaussian_vectors(long, key=["block_id", "target_cell"], seed=seed)
            parts.append(noise.groupBy("_row", *columns).agg(_along_layers().alias("sources")))
    if "mean" in kinds:
        held = vectors.where(F.col("layer").isin(layers) & F.col("position").isin(list(positions)))
        means = mean_vectors(held).groupBy("position").agg(_along_layers().alias("sources"))
        # Few bytes that grow to many: by bytes alone few tasks would hold and score all of them.
        own = spread_rows(placed, ["block_id", "target_cell"]).withColumn("source_kind", F.lit("mean"))
        met = insist(
            own.join(F.broadcast(means), "position", "left"),
            F.size("sources") == len(layers),
            "a position or layer has no vectors to take the mean of",
        )
        parts.append(met.select(*columns, "sources"))
    return reduce(DataFrame.unionByName, [p.select(*columns, "sources") for p in parts])
