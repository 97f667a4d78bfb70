"""Partner pairs, sweep grids, patch summaries and route conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.functions.names import ConditionNames, PositionNames
from crossblock.functions.values import changed_side, finite, insist
from crossblock.operators.resample import bootstrap_mean, bootstrap_ratio
from crossblock.session import cut


def direction(matched: str | Column = "matched") -> Column:
    """A confident target can only be ablated, a doubtful one restored."""
    flag = F.col(matched) if isinstance(matched, str) else matched
    return F.when(flag, F.lit("ablate")).otherwise(F.lit("restore"))


def partner_pairs(
    behavior: DataFrame, margin: str = "confidence_margin", *, strict: bool = True
) -> DataFrame:
    """Each cell with the cell of its block that has the same question and the other answer.

    One aggregate per (block, question) instead of a self-join: the buffers hold one cell
    per answer whatever the group size. A missing or repeated partner fails the job when
    `strict`, else the missing source is NULL.
    """
    carried = ["cell", "matched", *(["row"] if "row" in behavior.columns else [])]
    held = F.struct(*carried, finite(margin).alias("z"))
    sides = [F.col("a_index") == i for i in (1, 2)]
    questions = behavior.groupBy("block_id", "q_index").agg(
        *[F.max(F.when(side, held)).alias(f"s{i}") for i, side in enumerate(sides, 1)],
        *[F.count_if(side).alias(f"n{i}") for i, side in enumerate(sides, 1)],
    )
    where = F.concat(F.lit("no single partner in block "), F.col("block_id"))
    if strict:
        questions = insist(questions, (F.col("n1") == 1) & (F.col("n2") == 1), where)
    else:
        questions = insist(questions, (F.col("n1") <= 1) & (F.col("n2") <= 1), where)
    both = F.array(
        F.struct(F.col("s1").alias("t"), F.col("s2").alias("s")),
        F.struct(F.col("s2").alias("t"), F.col("s1").alias("s")),
    )
    pairs = questions.select("block_id", F.explode(both).alias("p")).where("p.t IS NOT NULL")
    rows = (
        [F.col("p.t.row").alias("target_row"), F.col("p.s.row").alias("source_row")]
        if "row" in behavior.columns
        else []
    )
    return pairs.select(
        "block_id",
        *rows,
        F.col("p.t.cell").alias("target_cell"),
        F.col("p.s.cell").alias("source_cell"),
        direction(F.col("p.t.matched")).alias("direction"),
        F.col("p.t.z").alias("target_clean"),
        F.col("p.s.z").alias("source_clean"),
    )


def chosen_layers(
    n_layers: int, step: int = 1, layers: Sequence[int] = (), start: int = 0
) -> list[int]:
    """Layers of a sweep; an empty list of chosen layers means all."""
    return [x for x in (layers or range(start, n_layers, step))]


def sweep_grid(rows: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row at every combination of the short axes, as one narrow explode per axis."""
    out = rows
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def cumulative_span(rows: DataFrame, start_layers: Sequence[int], layer: str = "layer") -> DataFrame:
    """Repeat each layer row under every start layer whose span [start, end] covers it."""
    starts = F.array(*[F.lit(int(s)) for s in start_layers])
    return rows.withColumn(
        "start_layer", F.explode(F.filter(starts, lambda s: s <= F.col(layer)))
    )


def _per_block(patched: DataFrame, keys: Sequence[str]) -> DataFrame:
    flips = F.col("flipped") if "flipped" in patched.columns else changed_side(
        "patched", "target_clean"
    )
    moved = F.col("moved") if "moved" in patched.columns else F.col("patched") - F.col("target_clean")
    gap = F.col("gap") if "gap" in patched.columns else F.col("source_clean") - F.col("target_clean")
    return patched.groupBy(*keys, "block_id").agg(
        F.avg(finite(moved)).alias("moved"),
        F.avg(finite(gap)).alias("gap"),
        F.sum(flips.cast("long")).alias("flips"),
        F.count(F.lit(1)).alias("pairs"),
    )


def summarize_groups(
    patched: DataFrame,
    keys: Sequence[str],
    *,
    n_boot: int = 10_000,
    seed: int = 0,
) -> DataFrame:
    """Ratio effect and absolute shift over blocks, flip rate over pairs, per group."""
    keys = list(keys)
    # Read three times below, and small beside the sweep it comes from.
    blocks = cut(_per_block(patched, keys))
    effect = bootstrap_ratio(
        blocks, "moved", "gap", keys=keys, n_boot=n_boot, seed=seed, with_shift=True
    )
    rates = blocks.groupBy(*keys).agg(
        (F.sum("flips") / F.sum("pairs")).alias("flip_rate"), F.avg("gap").alias("mean_gap")
    )
    return rates.join(effect, keys, "left").select(
        *keys,
        F.col("mean").alias("effect"),
        "ci_low",
        "ci_high",
        "sign_consistency",
        "mean_moved",
        "moved_ci_low",
        "moved_ci_high",
        "flip_rate",
        "mean_gap",
        "n_blocks",
    )


def summarize_patching(patched: DataFrame, **options) -> DataFrame:
    # The flag is derived anew, so that a saved sweep without it can be summarised.
    fresh = patched.withColumn("flipped", changed_side("patched", "target_clean"))
    return summarize_groups(fresh, ["direction", "position", "layer"], **options)


def summarize_isolated(patched: DataFrame, **options) -> DataFrame:
    cumulative = F.col("cumulative") if "cumulative" in patched.columns else F.lit(False)
    marked = patched.where(F.col("direction") == "restore").withColumn("cumulative", cumulative)
    return summarize_groups(marked, ["position", "layer", "cumulative"], **options).drop(
        "sign_consistency", "moved_ci_low", "moved_ci_high", "mean_gap"
    )


def summarize_controls(patched: DataFrame, **options) -> DataFrame:
    return summarize_groups(patched, ["position", "source_kind", "direction"], **options).drop(
        "sign_consistency", "moved_ci_low", "moved_ci_high", "mean_gap"
    )


def condition_table(
    scored: DataFrame,
    *,
    margin: str = "confidence_margin",
    length: str = "n_answer_tokens",
    names: ConditionNames = ConditionNames(),
    n_boot: int = 10_000,
    seed: int = 0,
) -> DataFrame:
    """Gap, interval and share of the clean gap per (condition, subset).

    Rows are first reduced to one per (condition, block). Only then does a block whose
    answers have one length enter its second subset.
    """
    z, matched = finite(margin), F.col("matched")
    cuts = F.max("edges_cut") if "edges_cut" in scored.columns else F.lit(None).cast("int")
    blocks = scored.groupBy("condition", "block_id").agg(
        *[
            f(F.when(side, z if what == "z" else F.lit(1))).alias(f"{prefix}_{tag}")
            for tag, side in (("m", matched), ("c", ~matched))
            for prefix, f, what in (("sum", F.sum, "z"), ("n", F.count, "z"), ("all", F.count, "1"))
        ],
        cuts.alias("edges_cut"),
        (F.min(length) == F.max(length)).alias("one_length"),
    )
    subsets = F.when(F.col("one_length"), F.array(F.lit("all"), F.lit("length_matched"))).otherwise(
        F.array(F.lit("all"))
    )
    members = blocks.withColumn("subset", F.explode(subsets)).withColumn(
        "gap",
        F.try_divide(F.col("sum_m"), F.col("n_m")) - F.try_divide(F.col("sum_c"), F.col("n_c")),
    )
    keys = ["condition", "subset"]
    members = cut(members)
    estimate = bootstrap_mean(
        members, "gap", keys=keys, n_boot=n_boot, seed=seed, permutation=False
    )
    means = members.groupBy(*keys).agg(
        F.max("edges_cut").alias("edges_cut"),
        *[
            F.when(
                F.sum(f"n_{tag}") == F.sum(f"all_{tag}"),
                F.try_divide(F.sum(f"sum_{tag}"), F.sum(f"n_{tag}")),
            ).alias(name)
            for tag, name in (("m", "mean_matched"), ("c", "mean_crossed"))
        ],
    )
    table = means.join(estimate, keys, "left").withColumnRenamed("mean", "gap")
    clean = table.where(F.col("condition") == names.clean).select(
        "subset", F.col("gap").alias("_clean")
    )
    return table.join(clean, "subset", "left").select(
        *keys,
        "edges_cut",
        "gap",
        "ci_low",
        "ci_high",
        F.try_divide(F.col("gap"), F.col("_clean")).alias("share_of_clean"),
        "mean_matched",
        "mean_crossed",
        "n_blocks",
    )


def shares_side_by_side(conditions: DataFrame) -> DataFrame:
    """The length-matched share of each condition beside its full share."""
    share = F.col("share_of_clean")
    return conditions.groupBy("condition").agg(
        F.max(F.when(F.col("subset") == "all", share)).alias("share_all"),
        F.max(F.when(F.col("subset") == "length_matched", share)).alias("share_length_matched"),
    )


def peak_layers(summary: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """Largest effect per position and the first layer that reaches it."""
    rank = F.struct("effect", -F.col("layer"))
    found = summary.where(F.col("effect").isNotNull())
    return found.groupBy(*keys).agg(
        F.max("effect").alias("peak_effect"),
        F.max_by("layer", rank).alias("best_layer"),
        F.max_by("flip_rate", rank).alias("peak_flip_rate"),
        F.max_by("mean_moved", rank).alias("peak_mean_moved"),
    )


def read_cliff(summary: DataFrame, tolerance: float = 0.9) -> DataFrame:
    """Per position, the last start layer that keeps `tolerance` of the peak effect; -1 if none."""
    peaks = summary.groupBy("position").agg(F.max("effect").alias("_peak"))
    kept = (F.col("_peak") > 0) & (F.col("effect") >= F.lit(tolerance) * F.col("_peak"))
    return (
        summary.join(peaks, "position")
        .groupBy("position")
        .agg(F.coalesce(F.max(F.when(kept, F.col("layer"))), F.lit(-1)).alias("read_cliff"))
    )


def flips_by_difficulty(
    patched: DataFrame, cuts: DataFrame, keys: Sequence[str] = ("source_kind",)
) -> DataFrame:
    """Flip rate per difficulty stratum, strata being cut at two gap values.

    `cuts` is one row with columns lower and upper (exact terciles of the clean gap).
    """
    gap = F.col("clean_gap")
    low, high = (cuts.select(c).scalar() for c in ("lower", "upper"))
    stratum = F.when(gap <= low, "hard").when(gap <= high, "medium").otherwise("easy")
    return (
        patched.where(gap.isNotNull())
        .withColumn("stratum", stratum)
        .groupBy("stratum", *keys)
        .agg(
            F.avg(F.col("flipped").cast("double")).alias("flip_rate"),
            F.avg("clean_gap").alias("mean_clean_gap"),
            F.count(F.lit(1)).alias("n_pairs"),
        )
    )


__all__ = [
    "PositionNames",
    "chosen_layers",
    "condition_table",
    "cumulative_span",
    "direction",
    "flips_by_difficulty",
    "partner_pairs",
    "peak_layers",
    "read_cliff",
    "shares_side_by_side",
    "summarize_controls",
    "summarize_groups",
    "summarize_isolated",
    "summarize_patching",
    "sweep_grid",
]
