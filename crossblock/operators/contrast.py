"""Block contrasts and the behavioural signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossblock.functions.names import CELLS
from crossblock.functions.values import finite, insist_once
from crossblock.operators.ranking import value_counts
from crossblock.operators.resample import bootstrap_mean, paired_effect_size
from crossblock.session import cut


def _block_cells(behavior: DataFrame, margin: str) -> DataFrame:
    """One written row per block: the four margins, and sums and counts by matched. One read.

    A cell column without a single value in the whole table is an error.
    """
    z, matched = finite(margin), F.col("matched")
    wide = cut(
        behavior.groupBy("block_id").agg(
            *[F.max(F.when(F.col("cell") == c, z)).alias(c) for c in CELLS],
            *[
                f(F.when(side, z)).alias(f"{what}_{name}")
                for name, side in (("matched", matched), ("crossed", ~matched))
                for what, f in (("sum", F.sum), ("n", F.count))
            ],
        )
    )
    present = wide.agg(*[F.count(c).alias(c) for c in CELLS])
    complete = F.least(*[F.col(c) for c in CELLS]) > 0
    return insist_once(wide, present, complete, "no block has a value for one of the cells")


def _contrasts(wide: DataFrame) -> DataFrame:
    interaction = F.col("q1a1") - F.col("q1a2") - F.col("q2a1") + F.col("q2a2")
    return wide.select(
        "block_id", interaction.alias("interaction"), (interaction / 2).alias("delta_fit")
    )


def block_contrasts(behavior: DataFrame, margin: str = "confidence_margin") -> DataFrame:
    """Interaction of the 2x2 per block, and half of it. NULL where one cell is missing."""
    return _contrasts(_block_cells(behavior, margin))


def block_gaps(
    behavior: DataFrame, margin: str = "confidence_margin", keys: tuple[str, ...] = ()
) -> DataFrame:
    """Mean matched minus mean crossed margin per block."""
    z = finite(margin)
    return behavior.groupBy(*keys, "block_id").agg(
        (F.avg(F.when(F.col("matched"), z)) - F.avg(F.when(~F.col("matched"), z))).alias("gap")
    )


def length_matched_blocks(behavior: DataFrame, length: str = "n_answer_tokens") -> DataFrame:
    """Blocks whose answers all have one token count."""
    spans = behavior.groupBy("block_id").agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
    return spans.where(F.col("lo") == F.col("hi")).select("block_id")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; NULL when one class is empty."""
    positive = F.col(label).cast("boolean")
    counted = value_counts(
        df,
        score,
        {
            "pos": F.sum(positive.cast("long")),
            "neg": F.sum((~positive).cast("long")),
        },
    )
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return counted.agg(F.try_divide(wins, pairs).alias("auc"))


def matched_by_correct(behavior: DataFrame) -> DataFrame:
    return behavior.groupBy("matched").agg(
        F.count_if("correct").alias("n_correct"), F.count_if(~F.col("correct")).alias("n_incorrect")
    )


def confidence_signal(
    behavior: DataFrame,
    *,
    n_boot: int = 10_000,
    seed: int = 0,
    margin: str = "confidence_margin",
) -> DataFrame:
    """One row: interaction estimate, its half, effect size, AUC and the two mean margins."""
    wide = _block_cells(behavior, margin)
    contrasts = _contrasts(wide)
    estimate = bootstrap_mean(contrasts, "interaction", n_boot=n_boot, seed=seed)
    # Half the contrast has half the estimate under the same draws.
    whole = ["mean", "ci_low", "ci_high", "sign_consistency", "n_blocks", "p_permutation"]
    halved = ["mean", "ci_low", "ci_high"]
    row = estimate.select(
        *[F.col(c).alias(f"interaction_{c}") for c in whole],
        "excludes_zero",
        *[(F.col(c) / 2).alias(f"delta_fit_{c}") for c in halved],
    )
    means = wide.agg(
        *[
            F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}")).alias(name)
            for name in ("matched", "crossed")
        ]
    )
    return row.withColumns(
        {
            "effect_size": paired_effect_size(contrasts, "interaction").scalar(),
            "calibration_auc": auc(behavior, margin, "correct").scalar(),
            "mean_margin_matched": means.select("matched").scalar(),
            "mean_margin_crossed": means.select("crossed").scalar(),
        }
    )


__all__ = [
    "auc",
    "block_contrasts",
    "block_gaps",
    "confidence_signal",
    "length_matched_blocks",
    "matched_by_correct",
]
