"""Fact-level splits, stratified by family, with answer clusters kept whole."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.functions.keyed import digest, uniform
from crossblock.functions.names import FITTABLE_SPLITS, HOLDOUT
from crossblock.operators.lookup import sized_lookup
from crossblock.operators.ranking import hash_bucketed, prefix_sums
from crossblock.session import cut


@dataclass(frozen=True)
class Ratios:
    """Shares of the fittable splits."""

    train: float = 0.7
    validation: float = 0.15
    test: float = 0.15

    def __post_init__(self):
        shares = astuple(self)
        if min(shares) <= 0 or not math.isclose(math.fsum(shares), 1.0, abs_tol=1e-9):
            raise ValueError(f"shares of the splits must be positive and add up to one: {shares}")

    def band(self, share: Column) -> Column:
        """The split whose band of [0, 1) holds a share."""
        return (
            F.when(share < F.lit(self.train), "train")
            .when(share < F.lit(self.train + self.validation), "validation")
            .otherwise("test")
        )


def answer_clusters(facts: DataFrame) -> DataFrame:
    """One row per (family, answer) with its facts; a split takes such a cluster whole."""
    return facts.groupBy("relation_family", "answer_id").agg(F.count("*").alias("cluster_size"))


def cluster_splits(
    facts: DataFrame, *, holdout: Sequence[str] = (), ratios: Ratios = Ratios(), seed: int | str = 0
) -> DataFrame:
    """Split of every (family, answer): clusters laid end to end in keyed-hash order.

    A cluster goes to the band that holds its midpoint, so each cut is off by at most half
    a cluster. Hash order rather than size order keeps large clusters out of one band.

    Bands are then taken by number from the end, each with the clusters it holds but no fewer
    than two, so the same rule gives small families test and validation pools.
    """
    clusters = cut(answer_clusters(facts).withColumn("_h", digest(seed, "relation_family", "answer_id")))
    hashed, bucket = hash_bucketed(clusters, ["relation_family"], "_h", "_b")
    laid = prefix_sums(
        hashed,
        {"_before": F.col("cluster_size"), "_rank": F.lit(1).cast("long")},
        group=["relation_family"],
        order=["_h", "answer_id"],
        bucket=bucket,
        totals=True,
    )
    middle = (F.col("_before") + F.col("cluster_size") / 2) / F.col("_before_total")
    banded = cut(laid.withColumn("_band", ratios.band(middle)))
    held = {
        s: F.greatest(F.lit(2), F.count_if(F.col("_band") == s)).alias(f"_{s}")
        for s in ("validation", "test")
    }
    counted = cut(banded.groupBy("relation_family").agg(*held.values(), F.count("*").alias("_n")))
    judged = sized_lookup(banded, counted, ["relation_family"], "_n")
    from_end = F.col("_rank_total") - F.col("_rank")  # 1 for the last cluster
    return judged.select(
        "relation_family",
        "answer_id",
        "cluster_size",
        F.when(F.col("relation_family").isin(list(holdout)), F.lit(HOLDOUT))
        .when(from_end <= F.col("_test"), "test")
        .when(from_end <= F.col("_test") + F.col("_validation"), "validation")
        .otherwise("train")
        .alias("split"),
    )


def assign_facts(
    facts: DataFrame,
    *,
    holdout: Sequence[str] = (),
    ratios: Ratios = Ratios(),
    seed: int | str = 0,
    method: str = "exact",
) -> DataFrame:
    """Add `split` to every fact.

    exact: shares as close to the ratios as whole clusters allow. hash: one draw per
    cluster, no shuffle, shares off by a binomial error.
    """
    if method == "hash":
        drawn = ratios.band(uniform(seed, "relation_family", "answer_id"))
        held = F.col("relation_family").isin(list(holdout))
        return facts.withColumn("split", F.when(held, F.lit(HOLDOUT)).otherwise(drawn))
    if method != "exact":
        raise ValueError(f"unknown split method {method!r}")
    splits = cut(cluster_splits(facts, holdout=holdout, ratios=ratios, seed=seed))
    return sized_lookup(
        facts, splits, ["relation_family", "answer_id"], "cluster_size"
    ).drop("cluster_size")


def pool_sizes(assigned: DataFrame) -> DataFrame:
    """Facts and distinct answers per (family, split)."""
    clusters = assigned.groupBy("relation_family", "split", "answer_id").agg(
        F.count("*").alias("n")
    )
    return clusters.groupBy("relation_family", "split").agg(
        F.sum("n").alias("n_facts"), F.count("*").alias("n_answers")
    )


def weak_pools(assigned: DataFrame) -> DataFrame:
    """(family, split) pools of fittable families that cannot form a block, empty ones included."""
    sizes = pool_sizes(assigned).where(F.col("split") != HOLDOUT)

    def of(split: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("split") == split, F.col(column))), F.lit(0))

    wide = sizes.groupBy("relation_family").agg(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("split"),
                    of(s, "n_facts").alias("n_facts"),
                    of(s, "n_answers").alias("n_answers"),
                )
                for s in FITTABLE_SPLITS
            ]
        ).alias("pools")
    )
    return wide.select("relation_family", F.inline("pools")).where(
        (F.col("n_facts") < 2) | (F.col("n_answers") < 2)
    )


def require_pools(assigned: DataFrame) -> None:
    """Fail when nothing is left to fit on, or when some fittable pool cannot form a block."""
    weak = weak_pools(assigned).orderBy("relation_family", "split").limit(1).collect()
    if weak:
        raise ValueError(f"too little for a block in {weak[0].asDict()}")
    if assigned.where(F.col("split") != HOLDOUT).isEmpty():
        raise ValueError("the holdout leaves no family to fit")


__all__ = [
    "Ratios",
    "answer_clusters",
    "assign_facts",
    "cluster_splits",
    "pool_sizes",
    "require_pools",
    "weak_pools",
]
