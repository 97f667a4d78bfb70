"""Block-level resampling: Poisson bootstrap, sign-flip test, ratio of means.

The unit is the block. Its weight in a replicate is a function of (seed, block,
replicate), so groups that hold the same blocks share draws, and the result does not depend
on partitioning. Sums over blocks are arrays along the replicates: a task makes one array per
group it sees, arrays are added as vectors, and percentiles are taken on them. What is shuffled
does not depend on the number of replicates in rows, nor on the number of cores.

Poisson(1) weights stand in for multinomial draws (Hanley and MacGibbon 2006); the two
differ by Monte-Carlo error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossblock.functions import keyed
from crossblock.functions.values import as_column, finite, insist
from crossblock.session import cut

EMPTY = "a group has no block with a finite value"


#: Sums of a row and a replicate that one task makes, about, up to FEW tasks, and beyond them. A
#: task emits an array per group, so many small tasks would shuffle more than they add up.
TASK_SUMS, FULL_SUMS = 50_000_000, 2_000_000_000
FEW = 32
#: Session setting for the numbers that a task holds, and its default.
BUDGET, NUMBERS = "crossblock.bootstrap.numbers", 16_000_000
#: Arrays of one group that one task adds up, about.
FAN = 64


def sum_tasks(rows: int, n_boot: int) -> int:
    """Tasks that the sums of so many rows ask for."""
    sums = rows * n_boot
    return max(1, min(-(-sums // TASK_SUMS), max(FEW, -(-sums // FULL_SUMS))))


def _seeded(df: DataFrame, block: str, seed: int, n_boot: int) -> tuple[DataFrame, int]:
    """Block words for the draws, spread by block, and the number of tasks.

    The rows are few bytes and much work, so tasks follow their number: by bytes alone they
    would be merged into one.
    """
    hashed = keyed.digest(seed, block)
    tasks = sum_tasks(df.count(), n_boot)
    return df.repartition(tasks, block).withColumn("_h", hashed).withColumns(
        {f"_h{i}": keyed.word(F.col("_h"), i) for i in range(3)}
    ), tasks


def _added(partial: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Arrays of equal length added up per group, FAN at a time where many tasks made some."""
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("_sums")))).alias("_sums")
    fan = -(-tasks // FAN)
    while fan > 1:
        at = F.pmod(F.col("_task"), F.lit(fan)).cast("int").alias("_task")
        partial = partial.select(*keys, at, "_sums").groupBy(*keys, "_task").agg(total)
        fan = -(-fan // FAN) if fan > FAN else 1
    # Without keys too, no row at all gives no group.
    whole = partial.groupBy(*keys) if keys else partial.groupBy(F.lit(0).alias("_all"))
    return whole.agg(total).select(*keys, "_sums")


def replicate_sums(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    weighted: dict[str, Column],
    signed: dict[str, Column],
    n_boot: int,
    seed: int,
    chunk: int = 128,
    budget: int | None = None,
) -> DataFrame:
    """One row per group: an array over the replicates for every weighted and signed sum.

    All rows of a block meet in one partition (a block has one row per group), its draws are
    made once for all of its groups, a matrix product adds them, and each task emits one row per
    group it saw. `budget` bounds the numbers held per task (by default the session's setting
    BUDGET): above it the sums are emitted and started again.
    """
    keys = list(keys)
    budget = budget or int(df.sparkSession.conf.get(BUDGET, str(NUMBERS)))
    names = [*weighted, *signed]
    n_weighted, flips = len(weighted), bool(signed)
    spread, tasks = _seeded(df, block, seed, n_boot)
    staged = spread.select(
        *keys,
        F.col(block).alias("_block"),
        *[f"_h{i}" for i in range(3)],
        *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in {**weighted, **signed}.items()],
    )
    if keys:
        staged = staged.sortWithinPartitions("_block")
    out_schema = T.StructType(
        [staged.schema[k] for k in keys]
        + [T.StructField("_task", T.IntegerType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))]
    )

    def emit(held: dict) -> pd.DataFrame:
        frame = pd.DataFrame(list(held), columns=keys) if keys else pd.DataFrame(index=range(len(held)))
        frame["_task"] = TaskContext.get().partitionId()
        frame["_sums"] = [sums.ravel() for sums in held.values()]
        return frame

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            block_code, seen = pd.factorize(pdf["_block"])
            first_row = np.unique(block_code, return_index=True)[1]
            words = pdf[["_h0", "_h1", "_h2"]].to_numpy()[first_row].astype(np.uint32)
            if keys:
                grouped = pdf.groupby(keys, dropna=False, sort=False)
                group_code = grouped.ngroup().to_numpy()
                labels = list(pdf[keys].iloc[np.unique(group_code, return_index=True)[1]]
                              .itertuples(index=False, name=None))
            else:
                group_code, labels = np.zeros(len(pdf), dtype=int), [()]
            values = pdf[names].to_numpy(dtype=np.float64)
            for start in range(0, len(seen), chunk):
                stop = min(start + chunk, len(seen))
                rows = np.flatnonzero((block_code >= start) & (block_code < stop))
                local_groups, local = np.unique(group_code[rows], return_inverse=True)
                shape = (len(names), len(local_groups), stop - start)
                dense = np.zeros(shape)
                for i in range(len(names)):
                    np.add.at(dense[i], (local, block_code[rows] - start), values[rows, i])
                x = keyed.np_first_mix(words[start:stop, 0], n_boot)
                parts = []
                if n_weighted:
                    w = keyed.np_poisson(keyed.np_mix32(x ^ words[start:stop, 1, None]))
                    parts.append(dense[:n_weighted] @ w)
                if flips:
                    coin = keyed.np_mix32(x ^ words[start:stop, 2, None])
                    parts.append(dense[n_weighted:] @ np.where(coin < np.uint32(2**31), -1.0, 1.0))
                sums = np.concatenate(parts)
                for j, g in enumerate(local_groups):
                    label = labels[g]
                    if label in held:
                        held[label] += sums[:, j]
                    else:
                        held[label] = sums[:, j].copy()
            if len(held) * len(names) * n_boot > budget:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    summed = _added(staged.mapInPandas(add, out_schema), keys, tasks)
    slices = [F.slice("_sums", i * n_boot + 1, n_boot).alias(n) for i, n in enumerate(names)]
    return summed.select(*keys, *slices)


def _edges(values: Column, alpha: float, prefix: str = "") -> dict[str, Column]:
    """Both ends of the percentile interval over an array of replicates; missing ones do not count."""
    there = F.array_sort(F.filter(values, lambda x: x.isNotNull()))

    def at(ordered: Column, share: float) -> Column:
        place = F.lit(share) * (F.size(ordered) - 1)
        low = F.floor(place).cast("int")
        below = F.get(ordered, low)
        above = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
        return below + (above - below) * (place - low)

    # One element, so that the replicates are sorted once.
    pair = F.transform(F.array(there), lambda x: F.array(at(x, alpha / 2), at(x, 1 - alpha / 2)))
    return {f"_{prefix}ci": F.element_at(pair, 1)}


def _open_edges(df: DataFrame) -> DataFrame:
    for prefix in ("", "moved_"):
        if f"_{prefix}ci" in df.columns:
            ends = F.col(f"_{prefix}ci")
            df = df.withColumns(
                {f"{prefix}ci_low": F.get(ends, F.lit(0)), f"{prefix}ci_high": F.get(ends, F.lit(1))}
            ).drop(f"_{prefix}ci")
    return df


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two small per-group frames; without keys both have one row."""
    if keys:
        return left.join(right, list(keys), "left")
    held = right.select(F.struct("*").alias("_r"))
    return left.withColumn("_r", held.scalar()).select(
        *left.columns, *[F.col(f"_r.{c}").alias(c) for c in right.columns]
    )


def excludes_zero(low: str | Column = "ci_low", high: str | Column = "ci_high") -> Column:
    return (as_column(low) > 0) | (as_column(high) < 0)


def same_sign_share(value: Column, mean: Column) -> Column:
    """Share of blocks on the side of the mean; zero when the mean is zero."""
    above = F.avg((value > 0).cast("double"))
    below = F.avg((value < 0).cast("double"))
    return F.when(mean > 0, above).when(mean < 0, below).otherwise(F.lit(0.0))


def bootstrap_mean(
    blocks: DataFrame,
    value: str,
    *,
    block: str = "block_id",
    keys: Sequence[str] = (),
    n_boot: int = 10_000,
    alpha: float = 0.05,
    seed: int = 0,
    permutation: bool = True,
) -> DataFrame:
    """Mean over blocks with a percentile interval and, on request, a sign-flip p-value.

    A group without a finite value fails the job.
    """
    keys = list(keys)
    x = F.col("_x0")
    # Written once: the point estimate, the draws and their number of tasks read it.
    every = cut(blocks.select(*keys, block, finite(value).alias("_x0")))
    clean = every.where(x.isNotNull())
    # Over all groups: one without a finite value must not vanish.
    point = every.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        same_sign_share(x, F.avg(x)).alias("sign_consistency"),
        F.count(x).alias("n_blocks"),
    )
    point = insist(point, F.col("n_blocks") > 0, EMPTY)
    signed = {"_flip": x} if permutation else {}
    sums = replicate_sums(clean, keys, block, {"_wx": x, "_w1": F.lit(1.0)}, signed, n_boot, seed)
    drawn = F.zip_with("_wx", "_w1", lambda total, weight: F.when(weight > 0, total / weight))
    found = _attach(point, sums, keys).withColumns(_edges(drawn, alpha))
    if permutation:
        # Sums in another order differ in the last digits; such a tie still counts as a tie.
        far = F.filter("_flip", lambda m: F.abs(m / F.col("n_blocks")) >= F.abs("mean") * (1 - 1e-12))
        found = found.withColumn("p_permutation", (F.size(far) + 1) / F.lit(n_boot + 1))
    shown = [*point.columns, "ci_low", "ci_high", *(["p_permutation"] if permutation else [])]
    return _open_edges(found).select(*shown).withColumn("excludes_zero", excludes_zero())


def bootstrap_ratio(
    blocks: DataFrame,
    numerator: str,
    denominator: str,
    *,
    block: str = "block_id",
    keys: Sequence[str] = (),
    n_boot: int = 10_000,
    alpha: float = 0.05,
    seed: int = 0,
    with_shift: bool = False,
) -> DataFrame:
    """Ratio of means with an interval, and the share of blocks whose own ratio is positive.

    `with_shift` adds the mean of the numerator and its interval from the same draws. A group
    without a block that has both values fails the job.
    """
    keys = list(keys)
    num, den = F.col("_num"), F.col("_den")
    both = num.isNotNull() & den.isNotNull()
    every = cut(
        blocks.select(
            *keys, block, finite(numerator).alias("_num"), finite(denominator).alias("_den")
        )
    )
    base = every.where(both | num.isNotNull() if with_shift else both)
    own = F.when(both & (den != 0), num / den)
    point = every.groupBy(*keys).agg(
        F.try_divide(F.avg(F.when(both, num)), F.avg(F.when(both, den))).alias("mean"),
        F.avg((own > 0).cast("double")).alias("sign_consistency"),
        F.count(F.when(both, F.lit(1))).alias("n_blocks"),
        *([F.avg(num).alias("mean_moved")] if with_shift else []),
    )
    point = insist(point, F.col("n_blocks") > 0, EMPTY)
    weighted = {"_wn": F.when(both, num), "_wd": F.when(both, den)}
    if with_shift:
        weighted |= {"_wm": num, "_w1": F.when(num.isNotNull(), F.lit(1.0))}
    sums = replicate_sums(base, keys, block, weighted, {}, n_boot, seed)
    ends = _edges(F.zip_with("_wn", "_wd", F.try_divide), alpha)
    if with_shift:
        ends |= _edges(F.zip_with("_wm", "_w1", F.try_divide), alpha, "moved_")
    found = _open_edges(_attach(point, sums, keys).withColumns(ends))
    moved = ["moved_ci_low", "moved_ci_high"] if with_shift else []
    return found.select(*point.columns, "ci_low", "ci_high", *moved).withColumn("excludes_zero", excludes_zero())


def paired_effect_size(blocks: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over sample standard deviation; NULL without spread."""
    x = finite(value)
    spread = F.stddev_samp(x)
    return blocks.groupBy(*keys).agg(
        F.when(spread > 0, F.avg(x) / spread).alias("effect_size")
    )
