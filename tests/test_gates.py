import pytest

from crossblock.operators import gates, patch


def signal(spark, mean, low):
    return spark.createDataFrame([(mean, low)], "interaction_mean double, interaction_ci_low double")


def summary(spark, nl, nl1, ac, cc, gap=3.0):
    rows = [
        ("restore", p, 5, e, e * gap, e, gap)
        for p, e in (("NL", nl), ("NL1", nl1), ("AC", ac), ("CC", cc))
        if e is not None
    ]
    schema = "direction string, position string, layer int, effect double, mean_moved double, flip_rate double, mean_gap double"
    return spark.createDataFrame(rows, schema)


NAN = float("nan")


@pytest.mark.parametrize(
    "sig, values, failing",
    [
        ((2.0, 1.0), (0.9, 0.02, 0.01, 1.0), None),
        ((0.1, -0.5), (0.9, 0.02, 0.01, 1.0), "confidence_signal"),
        ((2.0, 1.0), (0.29, 0.0, 0.0, 1.0), "newline_effect_floor"),
        ((2.0, 1.0), (0.9, 0.46, 0.01, 1.0), "newline_beats_next"),
        ((2.0, 1.0), (0.9, 0.01, 0.46, 1.0), "newline_beats_answer_colon"),
        ((2.0, 1.0), (0.9, 0.01, 0.01, 0.2), "confidence_sanity"),
        ((2.0, 1.0), (0.9, None, 0.01, 1.0), "newline_beats_next"),
        ((2.0, 1.0), (0.9, NAN, 0.01, 1.0), "newline_beats_next"),
        ((2.0, 1.0), (0.9, 0.01, 0.01, None), None),
        ((NAN, NAN), (0.9, 0.01, 0.01, 1.0), "confidence_signal"),
    ],
)
def test_signal_gates(spark, sig, values, failing):
    row = gates.signal_gates(signal(spark, *sig), summary(spark, *values)).first()
    checks = ["confidence_signal", "newline_effect_floor", "newline_beats_next",
              "newline_beats_answer_colon", "confidence_sanity"]
    assert [c for c in checks if not row[c]] == ([failing] if failing else [])
    assert row["overall"] == (failing is None)
    assert row["newline_best_layer"] == 5 and not row["saturated"]


def test_saturation_is_flagged(spark):
    row = gates.signal_gates(signal(spark, 60.0, 58.0), summary(spark, 0.1, 0.003, 0.001, 1.0, 30.0)).first()
    assert row["saturated"] and row["newline_moved"] == pytest.approx(3.0)


def conditions(spark, floor, via, direct, matched_floor=None):
    rows = [("cut everything", "all", floor), ("only via NL", "all", via), ("only direct", "all", direct)]
    if matched_floor is not None:
        rows.append(("cut everything", "length_matched", matched_floor))
    return spark.createDataFrame(rows, "condition string, subset string, share_of_clean double")


def isolated(spark, newline, control=0.0):
    rows = [("NL", 4, 0.9, newline), ("NL", 8, 0.5, 0.1), ("AC", 4, 0.0, control)]
    return spark.createDataFrame(rows, "position string, layer int, effect double, flip_rate double")


@pytest.mark.parametrize(
    "shares, flips, failing",
    [
        ((0.01, 0.9, 0.7), (0.96, 0.0), None),
        ((0.19, 0.9, 0.7), (0.96, 0.0), "knockout_collapses_the_gap"),
        ((NAN, 0.9, 0.7), (0.96, 0.0), "knockout_collapses_the_gap"),
        ((0.01, 0.3, 0.7), (0.96, 0.0), "newline_alone_carries_the_signal"),
        ((0.01, 0.9, 0.7), (0.4, 0.0), "isolated_patch_flips_decisions"),
        ((0.01, 0.9, 0.7), (0.96, 0.3), "controls_stay_flat"),
    ],
)
def test_route_gates(spark, shares, flips, failing):
    row = gates.route_gates(conditions(spark, *shares), isolated(spark, *flips)).first()
    checks = ["knockout_collapses_the_gap", "newline_alone_carries_the_signal",
              "isolated_patch_flips_decisions", "controls_stay_flat"]
    assert [c for c in checks if not row[c]] == ([failing] if failing else [])
    assert row["overall"] == (failing is None)
    assert row["newline_read_cliff"] == 4 and not row["newline_is_necessary"]


def test_length_artefact(spark):
    high = conditions(spark, 0.2, 0.9, 0.4, 0.19)
    low = conditions(spark, 0.2, 0.9, 0.4, 0.01)
    assert not gates.route_gates(high, isolated(spark, 0.9)).first()["floor_is_a_length_artefact"]
    row = gates.route_gates(low, isolated(spark, 0.9)).first()
    assert row["floor_is_a_length_artefact"] and row["newline_is_necessary"]


def controls(spark, **flips):
    """Flip rates (restore, ablate) by source kind; those of the partner pass by a hair."""
    base = {"partner": (0.5, 0.61), "gaussian": (0.7, 0.2), "mean": (0.3, 0.2), "crossed_donor": (0.6, 0.2),
            "matched_donor": (0.6, 0.6), "random_cell": (0.4, 0.4)}
    rows = [
        ("NL", kind, side, 0.8 if kind == "partner" else 0.4, flip)
        for kind, pair in {**base, **flips}.items()
        if pair is not None
        for side, flip in zip(("restore", "ablate"), pair, strict=True)
    ]
    schema = "position string, source_kind string, direction string, effect double, flip_rate double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "flips, failing",
    [
        ({}, None),
        ({"gaussian": (0.7, 0.21)}, "beats_destructive_controls"),
        ({"mean": (0.3, 0.21)}, "beats_destructive_controls"),
        ({"crossed_donor": (0.6, 0.21)}, "effect_is_pair_specific"),
        ({"partner": (0.49, 0.61)}, "bidirectional"),
        ({"gaussian": None, "mean": None}, None),
        # Controls near zero count as the floor of one in a hundred.
        ({"partner": (0.5, 0.5), "gaussian": (0.1, 0.0), "mean": (0.1, 0.0), "crossed_donor": (0.1, 0.0)}, None),
    ],
)
def test_control_gates(spark, flips, failing):
    row = gates.control_gates(controls(spark, **flips)).first()
    checks = ["bidirectional", "beats_destructive_controls", "effect_is_pair_specific"]
    assert [c for c in checks if not row[c]] == ([failing] if failing else [])
    assert row["overall"] == (failing is None)
    restored = flips.get("gaussian", (0.7, 0.2))
    assert row["restore_is_confounded"] == (restored is not None and restored[0] >= 0.5)


def test_one_way_effect_fails(spark):
    row = gates.control_gates(controls(spark, partner=(0.8, 0.4))).first()
    assert not row["bidirectional"] and not row["overall"]


@pytest.mark.parametrize("tolerance, expected", [(0.9, 8), (0.5, 16)])
def test_read_cliff(spark, tolerance, expected):
    profile = [(0, 0.9), (4, 0.9), (8, 0.9), (16, 0.5), (20, 0.1)]
    rows = [("NL", layer, e) for layer, e in profile] + [("AC", 0, -0.1), ("AC", 4, 0.0)]
    df = spark.createDataFrame(rows, "position string, layer int, effect double")
    found = {r["position"]: r["read_cliff"] for r in patch.read_cliff(df, tolerance).collect()}
    assert found == {"NL": expected, "AC": -1}
