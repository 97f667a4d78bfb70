"""Pass/fail gates over the small summary tables. NULL never passes by accident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.functions.names import SOURCE_KINDS, ConditionNames, PositionNames
from crossblock.functions.values import finite, passes
from crossblock.operators.patch import read_cliff

# Thresholds of the gates.
EFFECT_FLOOR = 0.30
LOCAL_MARGIN = 2.0
CONFIDENCE_SHARE = 0.9
SATURATION_GAP = 10.0
FLOOR_SHARE = 0.05
HALF = 0.5
FLAT_FLIPS = 0.1
SOURCE_MARGIN = 3.0
SOURCE_FLOOR = 0.01
TINY = 1e-6


def _at_least(value: Column, factor: float, other: Column, floor: float) -> Column:
    """value >= factor * max(other, floor), where a missing `other` fails."""
    return passes(other.isNotNull() & (value >= F.lit(factor) * F.greatest(other, F.lit(floor))))


def signal_gates(
    signal: DataFrame, summary: DataFrame, names: PositionNames = PositionNames()
) -> DataFrame:
    """Is there a signal, and does the newline position carry it more than its controls?"""
    restore = summary.where(F.col("direction") == "restore").withColumn("effect", finite("effect"))
    best = F.struct("effect", -F.col("layer"))
    at_newline = (F.col("position") == names.newline) & F.col("effect").isNotNull()
    labels = names.ordered()
    one = restore.agg(
        *[
            F.max(F.when(F.col("position") == p, F.col("effect"))).alias(f"_p{i}")
            for i, p in enumerate(labels)
        ],
        F.max_by(F.when(at_newline, F.struct("layer", "mean_moved", "flip_rate")),
                 F.when(at_newline, best)).alias("_best"),
        F.avg(finite("mean_gap")).alias("mean_clean_gap"),
    )
    peak = dict(zip(labels, (F.col(f"_p{i}") for i in range(len(labels))), strict=True))
    newline, after = peak[names.newline], peak[names.after_newline]
    colon, confidence = peak[names.answer_colon], peak[names.confidence]
    held = signal.select(F.struct("interaction_mean", "interaction_ci_low").alias("s")).scalar()
    checks = {
        "confidence_signal": passes(
            (finite(F.col("_s.interaction_mean")) > 0) & (finite(F.col("_s.interaction_ci_low")) > 0)
        ),
        "newline_effect_floor": passes(newline >= EFFECT_FLOOR),
        "newline_beats_next": _at_least(newline, LOCAL_MARGIN, after, TINY),
        "newline_beats_answer_colon": _at_least(newline, LOCAL_MARGIN, colon, TINY),
        # A missing read-out position passes; a missing newline does not.
        "confidence_sanity": confidence.isNull()
        | passes(confidence >= F.lit(CONFIDENCE_SHARE) * newline),
    }
    gated = one.withColumn("_s", held).withColumns(checks)
    overall = F.lit(True)
    for name in checks:
        overall = overall & F.col(name)
    return gated.select(
        *checks,
        overall.alias("overall"),
        F.map_from_arrays(
            F.array(*[F.lit(p) for p in labels]), F.array(*[peak[p] for p in labels])
        ).alias("peak_effect"),
        F.coalesce(F.col("_best.layer"), F.lit(-1)).alias("newline_best_layer"),
        passes(F.col("mean_clean_gap") > SATURATION_GAP).alias("saturated"),
        "mean_clean_gap",
        F.col("_best.mean_moved").alias("newline_moved"),
        F.col("_best.flip_rate").alias("newline_flip_rate"),
    )


def route_gates(
    conditions: DataFrame,
    isolated: DataFrame,
    *,
    names: PositionNames = PositionNames(),
    routes: ConditionNames = ConditionNames(),
) -> DataFrame:
    """Does cutting every route close the gap, and is the newline route enough alone?"""
    if "subset" not in conditions.columns:
        # Older tables have one share per condition, read as either subset.
        conditions = conditions.withColumn(
            "subset", F.explode(F.array(F.lit("all"), F.lit("length_matched")))
        )

    def share(condition: str, subset: str = "all") -> Column:
        picked = (F.col("condition") == condition) & (F.col("subset") == subset)
        return F.max(F.when(picked, finite("share_of_clean")))

    shares = conditions.agg(
        share(routes.everything_cut).alias("gap_floor"),
        share(routes.everything_cut, "length_matched").alias("gap_floor_length_matched"),
        share(routes.only_newline).alias("share_only_newline"),
        share(routes.only_direct).alias("share_only_direct"),
    )
    effect = finite("effect")
    at_newline = (F.col("position") == names.newline) & effect.isNotNull()
    order = F.when(at_newline, F.struct(effect, -F.col("layer")))
    control = F.col("position").isin(names.controls)
    peaks = isolated.agg(
        F.max_by(F.when(at_newline, F.struct("effect", "flip_rate")), order).alias("peak"),
        F.max(F.when(control, finite("flip_rate"))).alias("control"),
        F.count_if(control).alias("n_control"),
    )
    cliff = (
        read_cliff(isolated).where(F.col("position") == names.newline).agg(F.max("read_cliff"))
    )
    floor, matched_floor = F.col("gap_floor"), F.col("gap_floor_length_matched")
    # A missing floor fails; a missing length-matched share passes.
    artefact = matched_floor.isNull() | passes(
        floor.isNotNull() & (matched_floor < HALF * F.greatest(floor, F.lit(TINY)))
    )
    gated = (
        shares.withColumn("_i", peaks.select(F.struct("*")).scalar())
        .withColumn("newline_read_cliff", F.coalesce(cliff.scalar(), F.lit(-1)))
        .withColumns(
            {
                "knockout_collapses_the_gap": passes(floor < FLOOR_SHARE),
                "newline_alone_carries_the_signal": passes(F.col("share_only_newline") > HALF),
                "isolated_patch_flips_decisions": passes(F.col("_i.peak.flip_rate") >= HALF),
                "controls_stay_flat": (F.col("_i.n_control") == 0)
                | passes(F.col("_i.control") < FLAT_FLIPS),
                "floor_is_a_length_artefact": artefact,
                "newline_is_necessary": passes(F.col("share_only_direct") < HALF),
            }
        )
    )
    gates = [
        "knockout_collapses_the_gap",
        "newline_alone_carries_the_signal",
        "isolated_patch_flips_decisions",
        "controls_stay_flat",
    ]
    return gated.select(
        *gates,
        (F.col(gates[0]) & F.col(gates[1]) & F.col(gates[2]) & F.col(gates[3])).alias("overall"),
        "gap_floor",
        "gap_floor_length_matched",
        "floor_is_a_length_artefact",
        "share_only_newline",
        "share_only_direct",
        "newline_is_necessary",
        F.col("_i.peak.effect").alias("newline_peak_effect"),
        F.col("_i.peak.flip_rate").alias("newline_peak_flip_rate"),
        "newline_read_cliff",
    )


def control_gates(summary: DataFrame, names: PositionNames = PositionNames()) -> DataFrame:
    """Is the true partner's effect specific? Judged per direction, never pooled over them."""
    here = summary.where(F.col("position") == names.newline)
    sides = ("restore", "ablate")

    def pick(column: str, kind: str, side: str) -> Column:
        picked = (F.col("source_kind") == kind) & (F.col("direction") == side)
        return F.max(F.when(picked, finite(column)))

    one = here.agg(
        *[pick("flip_rate", k, s).alias(f"{k}_{s}") for k in SOURCE_KINDS for s in sides],
        *[pick("effect", "partner", s).alias(f"effect_{s}") for s in sides],
    )

    def beaten(kind: str) -> Column:
        control = F.col(f"{kind}_ablate")
        floor = F.greatest(control, F.lit(SOURCE_FLOOR))
        return control.isNull() | passes(F.col("partner_ablate") >= F.lit(SOURCE_MARGIN) * floor)

    checks = {
        "bidirectional": passes(F.col("partner_restore") >= HALF)
        & passes(F.col("partner_ablate") >= HALF),
        "beats_destructive_controls": beaten("gaussian") & beaten("mean"),
        "effect_is_pair_specific": beaten("crossed_donor"),
    }
    controls = SOURCE_KINDS[1:]
    flips = [
        F.map_from_arrays(
            F.array(*[F.lit(s) for s in sides]), F.array(*[F.col(f"{k}_{s}") for s in sides])
        )
        for k in controls
    ]
    return one.withColumns(checks).select(
        *checks,
        (
            F.col("bidirectional")
            & F.col("beats_destructive_controls")
            & F.col("effect_is_pair_specific")
        ).alias("overall"),
        F.col("partner_restore").alias("partner_flip_restore"),
        F.col("partner_ablate").alias("partner_flip_ablate"),
        F.col("effect_restore").alias("partner_effect_restore"),
        F.col("effect_ablate").alias("partner_effect_ablate"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in controls]), F.array(*flips)).alias(
            "control_flips"
        ),
        passes(F.col("gaussian_restore") >= HALF).alias("restore_is_confounded"),
    )
