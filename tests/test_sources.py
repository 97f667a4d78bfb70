"""Replacement vectors, the keyed store, lookups, full batches and fact scoring."""

import json
import os
import sys
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import conftest
import crossblock.operators.lookup as lookup
from crossblock.functions.names import SOURCE_KINDS
from crossblock.operators import blocks, donors, patch, score
from crossblock.plans import inputs, measure, scoring
from crossblock.session import cut
from crossblock.sources import vectors

LAYERS, WIDTH = 3, 4

# Workers cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cells_of(spark, n_blocks=6):
    rows = [
        (f"b{b}", 4 * b + i, i // 2 + 1, i % 2 + 1, f"q{i // 2 + 1}a{i % 2 + 1}", i // 2 == i % 2, float(b + i), 5 + b % 2)
        for b in range(n_blocks)
        for i in range(4)
    ]
    schema = "block_id string, row long, q_index int, a_index int, cell string, matched boolean, confidence_margin double, n_tokens int"
    return cut(spark.createDataFrame(rows, schema))


def vec_of(row, layer, position):
    return [float(np.sin(row * 7 + layer * 3 + d + len(position))) for d in range(WIDTH)]


def vectors_of(spark, rows, positions=("NL", "AC")):
    data = [(r, p, layer, vec_of(r, layer, p)) for r in rows for p in positions for layer in range(LAYERS)]
    return spark.createDataFrame(data, "row long, position string, layer int, vec array<float>")


# The store.


def test_repeated_and_corrected_batches(spark, tmp_path):
    table, path = cut(vectors_of(spark, range(20))), f"{tmp_path}/v"
    for _ in range(2):
        vectors.write_vectors(table, path, half=False, buckets=3)
    assert vectors.read_vectors(spark, path).count() == table.count()
    new = table.where("row = 3 AND layer = 1").withColumn("vec", F.array(*[F.lit(9.0).cast("float")] * WIDTH))
    vectors.write_vectors(new.unionByName(new), path, half=False)
    got = vectors.read_vectors(spark, path).select(*table.columns)
    assert got.exceptAll(table).count() == 2 and table.exceptAll(got).count() == 2
    assert vectors.shape_faults(got, n_rows=20, d_model=WIDTH).count() == 0
    layer = vectors.read_vectors(spark, path, [1])
    assert {tuple(r["vec"]) for r in layer.where("row = 3").collect()} == {(9.0,) * WIDTH}
    vectors.compact(spark, path, f"{tmp_path}/w", buckets=2)
    assert vectors.read_vectors(spark, f"{tmp_path}/w").select(*table.columns).exceptAll(got).count() == 0
    with pytest.raises(ValueError, match="no vector store"):
        vectors.read_vectors(spark, f"{tmp_path}/none")


def test_gathering_moves_no_vectors(spark, tmp_path):
    path = f"{tmp_path}/v"
    vectors.write_vectors(vectors_of(spark, range(40)), path, buckets=4)
    pairs = cut(spark.range(40).select(F.col("id").alias("source_row"), (F.col("id") + 1).alias("target_row")))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = donors.gather_vectors(pairs, vectors.read_vectors(spark, path), layers=[0, 2], positions=["NL"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 80
    finally:
        for k in settings:
            spark.conf.unset(k)
    lines = plan.split("\n")
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert exchanges and "vec" in plan
    for i in exchanges:
        depth = len(lines[i]) - len(lines[i].lstrip(" :|+-"))
        for below in lines[i + 1 :]:
            if len(below) - len(below.lstrip(" :|+-")) <= depth:
                break
            assert "vec#" not in below, plan


def test_missing_repeated_and_null_vectors_fail(spark):
    pairs = cut(spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "name string, source_row long"))
    table = cut(vectors_of(spark, [1, 2, 3]))
    assert donors.gather_vectors(pairs, table).count() == 3 * 2 * LAYERS
    holed = table.where("NOT (row = 2 AND layer = 1 AND position = 'NL')")
    for wish in ({}, {"layers": [1], "positions": ["NL"]}):
        with pytest.raises(Exception, match="missing or repeated vectors of row 2"):
            donors.gather_vectors(pairs, holed, **wish).collect()
    assert donors.gather_vectors(pairs, holed, layers=[0], positions=["NL", "AC"]).count() == 6
    with pytest.raises(Exception, match="missing or repeated vectors of row 3"):
        donors.gather_vectors(pairs, table.where("row < 3")).collect()
    with pytest.raises(Exception, match="missing or repeated vectors of row 1"):
        donors.gather_vectors(pairs, table.unionByName(table.where("row = 1"))).collect()
    with pytest.raises(Exception, match="missing or repeated vectors of row NULL"):
        donors.gather_vectors(pairs.withColumn("source_row", F.expr("nullif(source_row, 2)")), table).collect()
    blank = table.withColumn("vec", F.when(F.col("row") != 2, F.col("vec")))
    with pytest.raises(Exception, match="no vector of row 2"):
        donors.gather_vectors(pairs, blank).collect()
    loose = donors.gather_vectors(pairs, table.where("row < 3"), layers=[0], positions=["NL"], strict=False)
    assert {(r["name"], r["vec"] is None) for r in loose.collect()} == {("x", False), ("y", False), ("z", True)}
    assert donors.gather_vectors(pairs.limit(0), table.limit(0)).count() == 0


def test_noise_of_missing_vectors_is_missing(spark):
    table = vectors_of(spark, [1, 2]).withColumn("vec", F.when(F.col("row") == 1, F.col("vec")))
    got = donors.gaussian_vectors(table, key=["row"], seed=1).collect()
    assert all((r["vec"] is None) == (r["row"] == 2) for r in got) and len(got) == 4 * LAYERS
    none = donors.gaussian_vectors(table.where("row = 2"), key=["row"], seed=1)
    assert all(r["vec"] is None for r in none.collect())


# Control sources.


def sum_scorer():
    def run(batch):
        assert batch["n_tokens"].nunique() == 1
        return pd.DataFrame({"patched": [sum(sum(s["vec"]) for s in held) for held in batch["sources"]]})

    return run


def swept(spark, **options):
    cells = cells_of(spark)
    held = cut(vectors_of(spark, range(24)))
    return cells, measure.control_sweep(
        cells, held, sum_scorer, positions=["NL", "AC"], layers=[1, 2], length="n_tokens", seed=5, **options
    )


def test_control_sources_end_to_end(spark):
    cells, got = swept(spark)
    rows = got.toPandas()
    by_cell = {(r["block_id"], r["cell"]): r for r in cells.collect()}
    assert len(rows) == 24 * 2 * 6 and set(rows["source_kind"]) == set(SOURCE_KINDS)
    assert set(rows["start_layer"]) == {1}

    def total(row, position):
        return sum(np.float32(x) for layer in (1, 2) for x in vec_of(row, layer, position))

    middle = {p: np.mean([total(r, p) for r in range(24)]) for p in ("NL", "AC")}
    for r in rows.itertuples():
        block, source = r.block_id, by_cell[r.block_id, r.source_cell]
        reached = {
            kind: [
                total(c["row"], r.position)
                for c in by_cell.values()
                if c["block_id"] != block and donors.DONOR_POOLS[kind] in (None, c["matched"])
            ]
            for kind in donors.DONOR_POOLS
        }
        if r.source_kind == "partner":
            assert r.patched == pytest.approx(total(source["row"], r.position), abs=1e-4)
        elif r.source_kind == "mean":
            assert r.patched == pytest.approx(middle[r.position], abs=1e-4)
        elif r.source_kind in reached:
            assert min(abs(r.patched - x) for x in reached[r.source_kind]) < 1e-4
        else:
            assert abs(r.patched) < 2 * WIDTH * 2
    noise = rows[rows["source_kind"] == "gaussian"].set_index(["block_id", "target_cell", "position"])["patched"]
    partner = rows[rows["source_kind"] == "partner"].set_index(["block_id", "target_cell", "position"])["patched"]
    assert (noise - partner).abs().min() > 1e-6
    again = swept(spark, batch_size=3)[1].toPandas()
    order = ["block_id", "target_cell", "position", "source_kind"]
    pd.testing.assert_frame_equal(
        rows.sort_values(order, ignore_index=True), again.sort_values(order, ignore_index=True)
    )


def test_control_sources_refuse_gaps(spark):
    cells = cells_of(spark)
    pairs = cut(patch.partner_pairs(cells))
    held = cut(vectors_of(spark, range(23)))
    options = {"positions": ["NL"], "layers": [0, 1]}
    with pytest.raises(Exception, match="missing or repeated vectors of row 23"):
        donors.control_sources(pairs, cells, held, kinds=["partner"], **options).collect()
    with pytest.raises(Exception, match="no vectors to take the mean of"):
        donors.control_sources(pairs, cells, held, kinds=["mean"], positions=["NL"], layers=[0, 7]).collect()
    with pytest.raises(ValueError, match="unknown source kinds"):
        donors.control_sources(pairs, cells, held, kinds=["other"], **options)


def _names(leaf):
    schema = leaf.schema()
    return [schema.fieldNames()[i] for i in range(schema.size())]


def test_control_sources_read_the_store_once(spark):
    cells = cells_of(spark)
    pairs = cut(patch.partner_pairs(cells))
    held = cut(vectors_of(spark, range(24)))
    options = {"positions": ["NL", "AC"], "layers": [0, 1]}
    donors_only = donors.control_sources(pairs, cells, held, kinds=["partner", "random_cell"], **options)
    leaves = donors_only._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("layer" in _names(leaves.apply(i)) for i in range(leaves.size())) == 1
    assert donors_only.count() == 24 * 2 * 2
    # The means' rows are few bytes, and are scored by all cores all the same.
    means = donors.control_sources(pairs, cells, held, kinds=["mean"], **options)
    assert means.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_control_sources_refuse_missing_and_repeated(spark):
    cells = cells_of(spark)
    pairs = cut(patch.partner_pairs(cells))
    table = vectors_of(spark, range(24))
    options = {"positions": ["NL", "AC"], "layers": [0, 1], "kinds": ["partner"]}
    twice = table.unionByName(table.where("row = 4 AND layer = 1 AND position = 'AC'"))
    gap = table.where("NOT (row = 5 AND layer = 1 AND position = 'AC')")
    # Two rows where two are wanted, but of one layer.
    wrong = gap.unionByName(table.where("row = 5 AND layer = 0 AND position = 'AC'"))
    for held, row in ((twice, 4), (gap, 5), (wrong, 5)):
        with pytest.raises(Exception, match=f"missing or repeated vectors of row {row}"):
            donors.control_sources(pairs, cells, cut(held), **options).collect()
    none = table.withColumn("vec", F.when(F.col("row") != 6, F.col("vec")))
    with pytest.raises(Exception, match="no vector of row 6"):
        donors.control_sources(pairs, cells, cut(none), **options).collect()
    assert donors.control_sources(pairs, cells, cut(twice), **{**options, "positions": ["NL"]}).count() == 24


def test_buckets_follow_the_rows(spark):
    assert vectors.buckets_for(0) == vectors.BUCKETS == vectors.buckets_for(100_000)
    assert vectors.buckets_for(3_000_000) == 300 and vectors.buckets_for(10**9) == vectors.MOST_BUCKETS


def test_probe_reads_vectors_of_any_width():
    rows = [[[1.0, 2.0], [3.0, 4.0]], [[5.0], [0.25, 0.5]], []]
    held = [[{"layer": i, "vec": np.array(v, np.float32)} for i, v in enumerate(r)] for r in rows]
    for part in (held, held[:1]):
        batch = pd.DataFrame({"sources": part, "position": ["NL"] * len(part), "target_clean": [8.0] * len(part)})
        got = inputs.probe_scorer()(batch)["patched"].tolist()
        assert got == [1.0 + 0.875 * sum(float(x.sum()) for x in [s["vec"] for s in h]) for h in part]


# Lookups.


@pytest.mark.parametrize("form", ["whole", "heavy", "copies"])
def test_lookup_forms_agree(spark, monkeypatch, form):
    """A key with a third of the rows, keys without a partner and NULL keys, under all three plans."""
    if form != "whole":
        monkeypatch.setattr(lookup, "SMALL", 5 if form == "heavy" else 0)
        monkeypatch.setattr(lookup, "HEAVY", 10)
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        "id",
    )
    right = cut(
        left.where("key <> 'k7'").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    )
    got = lookup.sized_lookup(cut(left), right, ["key"], "n")
    tops = {r["key"]: r["top"] for r in right.collect()}
    rows = got.collect()
    assert got.columns == ["key", "id", "n", "top"] or set(got.columns) == {"key", "id", "n", "top"}
    assert len(rows) == 3000 and all(r["top"] == tops.get(r["key"]) for r in rows)


def test_wide_right_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BYTES", 100)
    right = cut(spark.range(10).select("id", F.lit(1).alias("n"), F.repeat(F.lit("x"), 50).alias("wide")))
    got = lookup.sized_lookup(cut(spark.range(30).select((F.col("id") % 10).alias("id"))), right, ["id"], "n")
    assert got.where("length(wide) = 50").count() == 30


def test_many_templates_per_family(spark):
    rows = spark.range(100).select(F.lit("f").alias("relation_family"), "id")
    texts = [("f", i, f"f/t{i}", f"text {i} {{s}}") for i in range(40)]
    templates = spark.createDataFrame(texts, "relation_family string, ordinal int, template_id string, text string")
    got = blocks.pick_templates(cut(rows), templates, F.col("id"))
    assert all(r["template"]["ordinal"] == r["id"] % 40 for r in got.collect())
    with pytest.raises(Exception, match="too few question templates for family f"):
        blocks.pick_templates(cut(rows), templates, F.col("id"), least=41).collect()


# Full batches.


def logging_scorer(folder):
    """Writes each batch's length and size to a folder of this test."""

    def factory():
        def run(batch):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                json.dump([int(batch["n_tokens"].iloc[0]), len(batch), batch["n_tokens"].nunique()], out)
            return pd.DataFrame({"z": batch["id"] * 2.0})

        return run

    return factory


def batches_in(folder):
    found = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as held:
            found.append(json.load(held))
    return found


@pytest.mark.parametrize("parts", [1, 13])
def test_a_length_has_at_most_one_partial_batch(spark, tmp_path, parts):
    df = spark.range(500).select("id", (F.col("id") % 7 % 5).cast("int").alias("n_tokens")).repartition(parts)
    got = score.score(df, logging_scorer(str(tmp_path)), "z double", key=["id"], batch_size=16)
    assert {r["id"]: r["z"] for r in got.collect()} == {i: 2.0 * i for i in range(500)}
    found = batches_in(tmp_path)
    assert all(kinds == 1 for _, _, kinds in found)
    for length in range(5):
        sizes = [n for held, n, _ in found if held == length]
        total = sum(1 for i in range(500) if i % 7 % 5 == length)
        assert sum(sizes) == total and len(sizes) == -(-total // 16) and sum(n < 16 for n in sizes) <= 1


def test_keys_to_score_must_be_unique_and_present(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (None, 3)], "id long, n_tokens int")
    factory = logging_scorer("/nowhere")
    with pytest.raises(Exception, match="a key to score repeats"):
        score.score(df.where("id = 1"), factory, "z double", key=["id"])
    with pytest.raises(Exception, match="a row to score has no id"):
        score.score(df.where("id IS NULL"), factory, "z double", key=["id"])


# Facts to scores.


def counting(folder, column, value):
    def factory():
        def run(batch):
            for text in batch[column]:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                    out.write(text)
            return value(batch)

        return run

    return factory


def texts_in(folder):
    return sorted(open(os.path.join(folder, name)).read() for name in os.listdir(folder))


def test_repeated_facts_are_scored_once(spark, tmp_path):
    asked, sure = tmp_path / "a", tmp_path / "b"
    asked.mkdir(), sure.mkdir()
    facts = conftest.toy_facts(spark, n=5, families=("capital",))
    # The same subject under two families asks one question; a third of the facts repeat it.
    again = facts.withColumn("relation_family", F.lit("river"))
    answerer = counting(asked, "prompt", lambda b: pd.DataFrame({"generated": ["Capital ANSWER 1\nso"] * len(b)}))
    scorer = counting(
        sure, "prompt", lambda b: pd.DataFrame({"confidence_margin": [2.5] * len(b), "logprobs": [[-1.0, -3.0]] * len(b)})
    )
    got = scoring.score_facts(
        facts.unionByName(again), conftest.toy_templates(spark), answerer, scorer, ordinal=1
    ).collect()
    assert len(got) == 10
    assert len(texts_in(asked)) == 5 and len(set(texts_in(asked))) == 5
    assert len(texts_in(sure)) == 5
    assert all(t.endswith("Answer:") for t in texts_in(asked))
    for r in got:
        own = r["gold"] == "capital answer 1"
        assert r["greedy_answer"] == "Capital ANSWER 1" and not r["greedy_exact"]
        assert (r["greedy_entity"], r["is_alias"], r["is_model_error"]) == (own, own, not own)
        assert (r["gold_margin"], r["gold_nll_per_token"], r["gold_n_tokens"]) == (2.5, 2.0, 2)


def test_stand_in_models_agree_with_the_query(spark):
    names = ["ALGERIA", "CHINA"]
    out = inputs.guess_answerer(names)()(pd.DataFrame({"prompt": ["a", "b"]}))
    assert all(g.split("\n")[0].strip().upper() in names for g in out["generated"])
