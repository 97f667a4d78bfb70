import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossblock.functions import keyed
from crossblock.operators import contrast, gates, patch, ranking, resample


def frame(spark, values, name="x"):
    rows = [(f"b{i}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"block_id string, {name} double")


def plain_sums(rows, n_boot, seed=0):
    """{group: (weighted sums, weights, flipped sums)} of rows (block, group, x), draw by draw."""
    out = {}
    for block, group, x in rows:
        head = hashlib.md5(f"{seed}:{block}".encode()).hexdigest()
        words = np.array([[int(head[8 * i : 8 * i + 8], 16) for i in range(3)]], np.uint32)
        first = keyed.np_first_mix(words[:, 0], n_boot)
        weight = keyed.np_poisson(keyed.np_mix32(first ^ words[:, 1, None]))[0]
        sign = np.where(keyed.np_mix32(first ^ words[:, 2, None])[0] < 2**31, -1.0, 1.0)
        sums = out.setdefault(group, np.zeros((3, n_boot)))
        sums += np.stack([weight * x, weight, sign * x])
    return out


@pytest.mark.parametrize(("budget", "chunk"), [(None, 128), (1, 7)])
def test_replicates_against_plain_draws(spark, monkeypatch, budget, chunk):
    """In one task, and in many whose arrays are added in several steps."""
    if budget:
        monkeypatch.setattr(resample, "TASK_SUMS", 100)
        monkeypatch.setattr(resample, "FAN", 2)
    rng = np.random.default_rng(0)
    rows = [(f"b{i}", g, float(rng.normal())) for i in range(60) for g in range(3)]
    df = spark.createDataFrame(rows, "block_id string, g int, x double")
    got = resample.replicate_sums(
        df, ["g"], "block_id", {"wx": F.col("x"), "w": F.lit(1.0)}, {"sx": F.col("x")}, 50, 0, budget=budget, chunk=chunk
    ).collect()
    want = plain_sums(rows, 50)
    assert {r["g"] for r in got} == set(want)
    for r in got:
        for name, sums in zip(("wx", "w", "sx"), want[r["g"]], strict=True):
            assert np.allclose(r[name], sums)
    row = resample.bootstrap_mean(df.where("g = 1"), "x", n_boot=50).first()
    wx, w, sx = want[1]
    values = np.array([x for _, g, x in rows if g == 1])
    assert (row["ci_low"], row["ci_high"]) == pytest.approx(tuple(np.quantile(wx / w, [0.025, 0.975])))
    assert row["p_permutation"] == pytest.approx(((np.abs(sx / 60) >= abs(values.mean())).sum() + 1) / 51)


def shuffled_rows(spark, n_boot):
    """Rows that the shuffles of a bootstrap write, from the metrics of its plan."""
    rows = [(f"b{i}", g, float(i * g)) for i in range(200) for g in range(3)]
    df = spark.createDataFrame(rows, "block_id string, g int, x double")
    got = resample.bootstrap_mean(df, "x", keys=["g"], n_boot=n_boot)
    got.collect()
    total, waiting = 0, [got._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        metrics = node.metrics()
        if metrics.contains("shuffleRecordsWritten"):
            total += metrics.apply("shuffleRecordsWritten").value()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            children = node.children()
            waiting.extend(children.apply(i) for i in range(children.length()))
    return total


def test_shuffled_rows_do_not_follow_the_replicates(spark):
    few, many = shuffled_rows(spark, 10), shuffled_rows(spark, 400)
    assert 0 < many == few


def test_weights_are_poisson(spark):
    words = np.arange(2000, dtype=np.uint32) * 7919
    w = keyed.np_poisson(keyed.np_mix32(keyed.np_first_mix(words, 500) ^ words[:, None]))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    # Replicates are not copies of each other.
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1


def test_interval_agrees_with_multinomial_draws(spark):
    values = np.random.default_rng(1).normal(0.3, 1, 140)
    row = resample.bootstrap_mean(frame(spark, values), "x").first()
    rng = np.random.default_rng(2)
    means = values[rng.integers(0, 140, (10_000, 140))].mean(axis=1)
    low, high = np.quantile(means, [0.025, 0.975])
    assert row["mean"] == pytest.approx(values.mean())
    assert row["ci_low"] == pytest.approx(low, abs=0.02)
    assert row["ci_high"] == pytest.approx(high, abs=0.02)
    flips = rng.choice([-1, 1], (10_000, 140))
    p = (np.abs((values * flips).mean(axis=1)) >= abs(values.mean())).mean()
    assert row["p_permutation"] == pytest.approx(p, abs=0.01)
    assert row["sign_consistency"] == pytest.approx((np.sign(values) > 0).mean())


def test_constant_values_and_smallest_p(spark):
    row = resample.bootstrap_mean(frame(spark, [2.0] * 30), "x", n_boot=400).first()
    assert (row["mean"], row["ci_low"], row["ci_high"]) == (2.0, 2.0, 2.0)
    assert row["sign_consistency"] == 1.0 and row["excludes_zero"]
    assert row["p_permutation"] >= 1 / 401


def test_only_finite_blocks_count(spark):
    df = frame(spark, [1.0, 3.0, float("nan"), float("inf"), float("-inf")])
    row = resample.bootstrap_mean(df, "x", n_boot=100).first()
    assert row["n_blocks"] == 2 and row["mean"] == 2.0
    with pytest.raises(Exception, match="no block with a finite value"):
        resample.bootstrap_mean(frame(spark, [float("nan")]), "x", n_boot=10).collect()


def test_same_result_under_any_partitioning(spark):
    df = frame(spark, np.random.default_rng(3).normal(size=90))
    found = {
        tuple(round(v, 9) for v in resample.bootstrap_mean(df.repartition(n), "x", n_boot=200).first()[:5])
        for n in (1, 7, 64)
    }
    assert len(found) == 1


def test_ratio_survives_a_denominator_near_zero(spark):
    rows = [(f"b{i}", 0.5, 1.0) for i in range(40)] + [("b99", 0.5, 1e-9)]
    df = spark.createDataFrame(rows, "block_id string, n double, d double")
    row = resample.bootstrap_ratio(df, "n", "d", n_boot=500).first()
    assert 0.4 < row["mean"] < 0.6 and row["sign_consistency"] == 1.0


def test_effect_size(spark):
    values = [1.0, 2.0, 4.0]
    expected = np.mean(values) / np.std(values, ddof=1)
    assert resample.paired_effect_size(frame(spark, values), "x").first()[0] == pytest.approx(expected)
    assert resample.paired_effect_size(frame(spark, [2.0, 2.0]), "x").first()[0] is None


@pytest.mark.parametrize(
    "scores, labels, expected",
    [
        ([1, 2, 3, 4], [0, 0, 1, 1], 1.0),
        ([1, 2, 3, 4], [1, 1, 0, 0], 0.0),
        ([5, 5, 5, 5], [1, 0, 1, 0], 0.5),
        ([1, 2], [1, 1], None),
    ],
)
def test_auc_values(spark, scores, labels, expected):
    df = spark.createDataFrame(
        [(float(s), bool(l)) for s, l in zip(scores, labels, strict=True)], "s double, l boolean"
    )
    assert contrast.auc(df, "s", "l").first()[0] == expected


def test_auc_and_quantiles_against_brute_force(spark):
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=600), 1)
    scores[:200] = 0.0
    labels = rng.random(600) < 0.4
    df = spark.createDataFrame(
        [(float(s), bool(l), int(i % 2)) for i, (s, l) in enumerate(zip(scores, labels, strict=True))],
        "s double, l boolean, g int",
    )
    pos, neg = scores[labels], scores[~labels]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert contrast.auc(df, "s", "l").first()[0] == pytest.approx(wins / (len(pos) * len(neg)))
    q = {"a": 0.1, "b": 1 / 3, "c": 0.5, "d": 1.0}
    row = ranking.exact_quantiles(df, "s", q).first()
    assert list(row) == pytest.approx(list(np.quantile(scores, list(q.values()))))
    for r in ranking.exact_quantiles(df, "s", q, group=["g"]).collect():
        part = scores[r["g"] :: 2]
        assert list(r)[1:] == pytest.approx(list(np.quantile(part, list(q.values()))))


def test_row_index_and_batches(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), (F.col("id") * 37 % 500)).alias("k"))
    rows = ranking.row_index(df.repartition(9), ["k"]).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["row"])] == sorted(r["k"] for r in rows)
    assert sorted(r["row"] for r in rows) == list(range(500))
    # One length holds nearly all rows: full batches all the same.
    lengths = spark.range(300).select("id", F.when(F.col("id") < 290, 5).otherwise(6).alias("n"))
    numbered = ranking.batch_numbers(lengths, length="n", key=["id"], batch_size=32)
    sizes = sorted(r["count"] for r in numbered.where("n = 5").groupBy("batch").count().collect())
    assert sizes == [290 % 32] + [32] * 9


MISSING = "no block with a finite value"
NAN = float("nan")


def groups(spark, **values):
    rows = [(g, f"b{i}", v, w) for g, pairs in values.items() for i, (v, w) in enumerate(pairs)]
    return spark.createDataFrame(rows, "g string, block_id string, x double, y double")


def test_a_group_without_a_value_is_an_error(spark):
    measured = [(1.0, 2.0), (2.0, 2.0)]
    for empty in ([(None, 1.0), (NAN, 1.0)], [(float("inf"), 1.0)]):
        df = groups(spark, a=measured, b=empty)
        for permutation in (True, False):
            with pytest.raises(Exception, match=MISSING):
                resample.bootstrap_mean(df, "x", keys=["g"], n_boot=20, permutation=permutation).collect()
        for shift in (True, False):
            with pytest.raises(Exception, match=MISSING):
                resample.bootstrap_ratio(df, "x", "y", keys=["g"], n_boot=20, with_shift=shift).collect()
    # A group with one value stays.
    some = resample.bootstrap_mean(groups(spark, a=measured, b=[(None, 1.0), (3.0, 1.0)]), "x", keys=["g"], n_boot=20)
    assert {r["g"]: r["n_blocks"] for r in some.collect()} == {"a": 2, "b": 1}


SWEEP = "block_id string, position string, layer int, direction string, source_kind string, target_clean double, source_clean double, patched double"


def sweep(spark, unmeasured):
    """Two blocks per source kind, position and layer; `unmeasured` rows have no patched margin."""
    rows = [
        (f"b{i}", p, layer, d, kind, -1.0, 2.0, None if unmeasured(p, layer, kind) else 1.0 + i)
        for i in range(2)
        for p in ("NL", "AC")
        for layer in (0, 1)
        for d in ("restore", "ablate")
        for kind in ("partner", "gaussian", "mean", "crossed_donor")
    ]
    return spark.createDataFrame(rows, SWEEP)


@pytest.mark.parametrize(
    ("summarise", "unmeasured"),
    [
        (patch.summarize_patching, lambda p, layer, kind: layer == 1),
        (patch.summarize_isolated, lambda p, layer, kind: p == "AC"),
        (patch.summarize_controls, lambda p, layer, kind: kind == "gaussian"),
    ],
)
def test_an_unmeasured_group_fails_its_summary(spark, summarise, unmeasured):
    whole = summarise(sweep(spark, lambda *_: False), n_boot=20).collect()
    assert whole and all(r["n_blocks"] == 2 for r in whole)
    with pytest.raises(Exception, match=MISSING):
        summarise(sweep(spark, unmeasured), n_boot=20).collect()


def test_unmeasured_controls_cannot_pass_the_gates(spark):
    destroyed = sweep(spark, lambda p, layer, kind: kind != "partner")
    with pytest.raises(Exception, match=MISSING):
        gates.control_gates(patch.summarize_controls(destroyed, n_boot=20)).collect()
    quiet = patch.summarize_isolated(sweep(spark, lambda p, layer, kind: p == "AC"), n_boot=20)
    shares = spark.createDataFrame(
        [("cut everything", 0.01), ("only via NL", 0.9), ("only direct", 0.1)], "condition string, share_of_clean double"
    )
    with pytest.raises(Exception, match=MISSING):
        gates.route_gates(shares, quiet).collect()


def test_an_unmeasured_condition_fails_the_table(spark):
    rows = [
        (c, f"b{i}", cell, cell in ("q1a1", "q2a2"), 1, None if c == "cut" else float(i))
        for c in ("clean", "cut") for i in range(2) for cell in ("q1a1", "q1a2", "q2a1", "q2a2")
    ]
    schema = "condition string, block_id string, cell string, matched boolean, n_answer_tokens int, confidence_margin double"
    scored = spark.createDataFrame(rows, schema)
    assert patch.condition_table(scored.where("condition = 'clean'"), n_boot=20).count() == 2
    with pytest.raises(Exception, match=MISSING):
        patch.condition_table(scored, n_boot=20).collect()


def test_draws_reach_indices_beyond_32_bits(spark):
    size = 1 << 34
    drawn = spark.range(4000).select(keyed.index_draw(F.lit(size), 1, "id").alias("u")).toPandas()["u"]
    assert drawn.between(0, size - 1).all() and (drawn % 4 != 0).sum() > 2500
    assert abs(drawn.mean() / size - 0.5) < 0.02


def test_tasks_stay_few_where_each_emits_an_array_per_group(spark, monkeypatch):
    """Every task writes groups x replicates numbers, so their number must not follow every small lot of rows."""
    monkeypatch.setattr(resample, "TASK_SUMS", 10)
    df = frame(spark, range(180))
    assert resample._seeded(df, "block_id", 0, 50)[1] <= 32
