"""Global order without a single-task window.

Groups of up to WINDOW_ROWS rows are one window partition each. A larger group is cut into as
many buckets as its rows ask for; buckets never decrease along the order, each is a window
partition, and their totals, one number per WINDOW_ROWS rows, are summed along the order and
added back. Results do not depend on the buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossblock.functions.keyed import digest, word
from crossblock.functions.values import finite
from crossblock.operators.lookup import sized_lookup
from crossblock.session import cut

#: Rows that one window task orders, about.
WINDOW_ROWS = 1_000_000
#: Values that cut an order into buckets, at most; they are kept on the driver.
MOST_BUCKETS = 10_000


def large_groups(df: DataFrame, group: Sequence[str]) -> DataFrame | None:
    """Groups above WINDOW_ROWS with their size `_n`, a written table; None if there are none."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > WINDOW_ROWS)
    return cut(sizes) if sizes.select("_n").head(1) else None


def hash_bucketed(
    df: DataFrame, group: Sequence[str], hex_digest: str, name: str
) -> tuple[DataFrame, str | None]:
    """Bucket the rows of large groups by their hash; the name is None if no group is large.

    `df` is read twice.
    """
    large = large_groups(df, group)
    if large is None:
        return df, None
    if group:
        placed = sized_lookup(df, large, group, "_n")
    else:
        placed = df.withColumn("_n", large.select("_n").scalar())
    width = F.ceil(F.col("_n") / F.lit(WINDOW_ROWS))
    bucket = F.floor(word(F.col(hex_digest)) * width / F.lit(2.0**32)).cast("long")
    return placed.withColumn(name, F.coalesce(bucket, F.lit(0).cast("long"))).drop("_n"), name


def prefix_sums(
    df: DataFrame,
    measures: dict[str, Column],
    *,
    group: Sequence[str],
    order: Sequence[str],
    bucket: str | None,
    totals: bool = False,
) -> DataFrame:
    """Exclusive running sum of every measure along `order` inside each group.

    `totals` adds the sum over the whole group as <name>_total, at no further join. Without a
    bucket a group is one window partition, else `df` is read twice.
    """
    before = Window.unboundedPreceding, -1
    whole = Window.partitionBy(*group)
    if bucket is None:
        along = Window.partitionBy(*group).orderBy(*order).rowsBetween(*before)
        sums = {n: F.coalesce(F.sum(v).over(along), F.lit(0)) for n, v in measures.items()}
        if totals:
            sums |= {f"{n}_total": F.sum(v).over(whole) for n, v in measures.items()}
        return df.withColumns(sums)
    staged = df.withColumns({f"_m_{name}": value for name, value in measures.items()})
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(*before)
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(*before)
    per_bucket = staged.groupBy(*group, bucket).agg(
        *[F.sum(f"_m_{name}").alias(f"_t_{name}") for name in measures]
    )
    added = [f"{name}_total" for name in measures] if totals else []
    offsets = per_bucket.select(
        *group,
        bucket,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}")
            for name in measures
        ],
        *[F.sum(f"_t_{t[:-6]}").over(whole).alias(t) for t in added],
    )
    local = staged.withColumns(
        {f"_l_{name}": F.coalesce(F.sum(f"_m_{name}").over(inside), F.lit(0)) for name in measures}
    )
    return local.join(offsets, [*group, bucket]).select(
        *df.columns,
        *[(F.col(f"_l_{name}") + F.col(f"_o_{name}")).alias(name) for name in measures],
        *added,
    )


def global_rank(
    df: DataFrame,
    *,
    group: Sequence[str],
    order: Sequence[str],
    bucket: str | None,
    name: str = "rank",
    totals: bool = False,
) -> DataFrame:
    """0-based rank along `order` inside each group."""
    one = {name: F.lit(1).cast("long")}
    return prefix_sums(df, one, group=group, order=order, bucket=bucket, totals=totals)


def shuffle_rank(
    df: DataFrame,
    *,
    group: Sequence[str],
    key: Sequence[str],
    seed: int | str,
    name: str = "rank",
    narrow: bool = False,
) -> DataFrame:
    """Seeded shuffle: rank of each row in keyed-hash order inside its group.

    Reads df twice, unless the caller knows that no group is large and says `narrow`.
    """
    hashed, bucket = df.withColumn("_h", digest(seed, *key)), None
    if not narrow:
        hashed, bucket = hash_bucketed(hashed, group, "_h", "_b")
    ranked = global_rank(hashed, group=group, order=["_h", *key], bucket=bucket, name=name)
    return ranked.drop("_h", "_b")


def row_index(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """Dense 0-based index in a global sort order.

    The range-partitioned sort is written once, because partition numbers must be the
    same for the counts and for the rows.
    """
    placed = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition.
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_part").select(
        *df.columns, (F.col("_before") + inside).alias(name)
    )


def value_buckets(df: DataFrame, value: str, n_buckets: int) -> DataFrame:
    """Bucket a double column at approximate quantiles, so that buckets follow its order.

    The cut points (at most n_buckets - 1 numbers) are fetched first: every later branch
    then uses the same ones. Results do not depend on where the cuts fall.
    """
    marks = [i / n_buckets for i in range(1, n_buckets)]
    found = df.agg(F.percentile_approx(value, marks, 10 * n_buckets).alias("cuts")).first()["cuts"]
    # + 0.0 turns a negative zero into a zero.
    inner = sorted({float(c) + 0.0 for c in found or []}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(df)


def value_counts(
    df: DataFrame, value: str, measures: dict[str, Column], *, group: Sequence[str] = ()
) -> DataFrame:
    """One row per (group, distinct value) with the measures and their sums over smaller values.

    The collapsed table is written once: cut points, totals and running sums all read it.
    """
    collapsed = cut(
        df.withColumn(value, finite(value) + F.lit(0.0))
        .where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(*[m.alias(name) for name, m in measures.items()])
    )
    buckets = min(MOST_BUCKETS, math.ceil(collapsed.count() / WINDOW_ROWS))
    if buckets > 1:
        collapsed = value_buckets(collapsed, value, buckets)
    sums = {f"{name}_below": F.col(name) for name in measures}
    return prefix_sums(
        collapsed, sums, group=group, order=[value], bucket="_bucket" if buckets > 1 else None, totals=True
    ).drop("_bucket")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """One row per distinct value: how often it occurs and the mean rank its ties share."""
    counted = value_counts(df, value, {"n": F.count(F.lit(1))})
    return counted.select(
        value, "n", ((2 * F.col("n_below") + F.col("n") + 1) / 2).alias("average_rank")
    )


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], *, group: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation quantiles by counting, never by collecting the values."""
    counted = value_counts(df, value, {"n": F.count(F.lit(1))}, group=group)
    size = F.col("n_below_total")

    def at(position: Column) -> Column:
        held = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n"))
        return F.max(F.when(held, F.col(value)))

    columns = []
    for name, q in quantiles.items():
        exact = F.lit(float(q)) * (size - 1)
        low = F.floor(exact)
        high = F.least(low + 1, size - 1)
        share = F.max(exact - low)
        columns.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return counted.groupBy(*group).agg(*columns)


def batch_numbers(
    df: DataFrame, *, length: str, key: Sequence[str], batch_size: int, seed: int | str = 0
) -> DataFrame:
    """Number the full batches of rows that share one token length."""
    if batch_size < 1:
        raise ValueError(f"batch_size must be >= 1, got {batch_size}")
    ranked = shuffle_rank(df, group=[length], key=key, seed=seed, name="_rank")
    return ranked.withColumn("batch", F.floor(F.col("_rank") / F.lit(batch_size))).drop("_rank")
