"""One query per operator, each over whole driver tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossblock.functions import likelihood, positions, prompts, text
from crossblock.functions.keyed import stable_seed
from crossblock.functions.names import SOURCE_KINDS, SPLITS, PositionNames
from crossblock.functions.values import finite
from crossblock.operators import contrast, donors, gates, patch, ranking, resample, score, splits
from crossblock.operators import blocks as block_ops
from crossblock.operators import validate as rules
from crossblock.plans import build, inputs, measure, scoring
from crossblock.session import cut, scratch_path
from crossblock.sources import contract, manifest, vectors
from crossblock.sources import facts as fact_source

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DIGITS = 6


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles for display; adding zero removes a negative zero."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            (F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0)).alias(c)
            if c in doubles
            else F.col(c)
            for c in df.columns
        ]
    )


def _signal_columns(gated: DataFrame) -> DataFrame:
    peaks = [F.col("peak_effect")[p].alias(f"peak_{p}") for p in PositionNames().ordered()]
    return tidy(gated.select(*[c for c in gated.columns if c != "peak_effect"], *peaks))


def _control_columns(gated: DataFrame) -> DataFrame:
    flips = [
        F.col("control_flips")[k][s].alias(f"{k}_{s}")
        for k in ("random_cell", "gaussian", "mean", "matched_donor", "crossed_donor")
        for s in ("restore", "ablate")
    ]
    return tidy(gated.select(*[c for c in gated.columns if c != "control_flips"], *flips))


def built_cells(spark: SparkSession, sf: str) -> DataFrame:
    return build.build_cells(inputs.facts(spark, sf), inputs.templates(spark, sf), inputs.CONFIG)


def facts_with_ids(spark: SparkSession, sf: str) -> DataFrame:
    return fact_source.with_ids(inputs.facts(spark, sf))


def assigned_facts(spark: SparkSession, sf: str) -> DataFrame:
    return cut(build.split_facts(inputs.facts(spark, sf), inputs.CONFIG))


# A. Sources and sinks


@query
def a1_contract_scan(spark, sf):
    path = scratch_path(spark, "cells")
    contract.write_cells(inputs.unchecked_cells(spark, sf), path)
    return contract.read_cells(spark, path).groupBy("split", "relation_family").agg(
        F.count("*").alias("n_rows"), F.countDistinct("block_id").alias("n_blocks")
    )


@query
def a2_contract_sink(spark, sf):
    path = scratch_path(spark, "cells")
    contract.write_cells(inputs.unchecked_cells(spark, sf), path)
    return contract.read_cells(spark, path)


@query
def a3_result_sink(spark, sf):
    path = scratch_path(spark, "behavior")
    contract.write_result(inputs.behavior(spark, sf), path)
    return tidy(spark.read.parquet(path))


@query
def a4_saved_sweep_summary(spark, sf):
    """A saved sweep without its derived columns, summarised without measuring again."""
    path = scratch_path(spark, "sweep")
    contract.write_result(inputs.sweep(spark, sf).drop("moved", "gap", "flipped"), path)
    return tidy(patch.summarize_isolated(spark.read.parquet(path)))


@query
def a4_signal_report(spark, sf):
    """Gates of a saved run: behaviour and sweep are read back, nothing is measured again."""
    path = scratch_path(spark, "run")
    contract.write_result(inputs.behavior(spark, sf), f"{path}/behavior")
    sweep = inputs.sweep(spark, sf).drop("moved", "gap", "flipped")
    contract.write_result(sweep, f"{path}/patching")
    return _signal_columns(measure.signal_report(spark, path))


@query
def a4_routes_report(spark, sf):
    path = scratch_path(spark, "run")
    contract.write_result(inputs.scored_conditions(spark, sf), f"{path}/conditions")
    contract.write_result(inputs.sweep(spark, sf).drop("moved", "gap", "flipped"), f"{path}/isolated")
    return tidy(measure.routes_report(spark, path))


@query
def a4_controls_report(spark, sf):
    path = scratch_path(spark, "run")
    contract.write_result(inputs.controls(spark, sf), f"{path}/controls")
    return _control_columns(measure.controls_report(spark, path))


@query
def a5_vector_store(spark, sf):
    """A store whose first batch is written twice and whose second corrects a part of it."""
    path, held = scratch_path(spark, "vectors"), inputs.vectors(spark, sf)
    wrong = F.transform("vec", lambda x: x + F.lit(1).cast("float"))
    vectors.write_vectors(held.withColumn("vec", F.when(F.col("row") % 3 == 0, wrong).otherwise(F.col("vec"))), path, half=False)
    for _ in range(2):
        vectors.write_vectors(held.where("row % 3 = 0"), path, half=False)
    held = vectors.read_vectors(spark, path, [1, 3]).withColumn("norm", donors.norm("vec"))
    return tidy(held.select("row", F.col("layer").cast("int"), "position", "norm"))


@query
def a6_fingerprint(spark, sf):
    return manifest.fingerprint(inputs.table(spark, sf, "documents"),
                                ["doc_id", "text", "lang", "source", "n_chars"])


@query
def a7_manifest(spark, sf):
    row = manifest.manifest(
        spark,
        command="report",
        config={"seed": 7, "splits": SPLITS},
        artifacts={
            "conversations": inputs.table(spark, sf, "conversations"),
            "labels": inputs.table(spark, sf, "labels"),
        },
        payload={"source": "driver tables"},
        caller={"revision": "unknown"},
    )
    return row.select(
        "command", "config", "config_sha256", "payload", "revision",
        *[F.col(f"artifacts.{a}.{c}").alias(f"{a}_{c}") for a in ("conversations", "labels")
          for c in ("hash_xor", "hash_sum", "n_rows")],
    )


def _move(spark, folder: str, to: str) -> None:
    """Put the one Parquet file of a folder in the place of another file."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    written = [s.getPath() for s in store.listStatus(path(folder)) if s.getPath().getName().endswith(".parquet")]
    store.delete(path(to), False)
    if len(written) != 1 or not store.rename(written[0], path(to)):
        raise ValueError(f"{folder} does not hold one file that can be moved")


@query
def a7_altered_file(spark, sf):
    """The one file of a table that was changed after its checksums were taken; only it is read again."""
    path, columns = scratch_path(spark, "files"), ["c_custkey", "c_name", "c_mktsegment"]
    rows = inputs.table(spark, sf, "customer").select(*columns)
    rows.repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    saved = cut(manifest.file_digests(spark, path, columns))
    name = F.when(F.col("c_custkey") % 100 == 7, F.upper("c_name")).otherwise(F.col("c_name"))
    part = rows.where("c_mktsegment = 'MACHINERY'").withColumn("c_name", name).drop("c_mktsegment")
    fresh = scratch_path(spark, "fresh")
    part.coalesce(1).write.parquet(fresh)
    _move(spark, fresh, saved.where("file LIKE '%MACHINERY%'").first()["file"])
    found = manifest.changed_files(saved, path, columns)
    segment = F.regexp_extract("file", "c_mktsegment=([A-Z]+)", 1).alias("segment")
    whole = manifest.merged(manifest.file_digests(spark, path, columns)).select("hash_xor").scalar()
    return found.select(
        "change", segment, "hash_xor", F.col("hash_sum").cast("string").alias("hash_sum"), "n_rows", whole.alias("table_xor")
    )


@query
def a8_fact_source(spark, sf):
    return inputs.facts(spark, sf).withColumn("also_correct", F.array_join("also_correct", ","))


@query
def a9_templates(spark, sf):
    return fact_source.templates_for(
        inputs.templates(spark, sf), inputs.facts(spark, sf), 2
    ).select("relation_family", "ordinal", "template_id", "text")


@query
def a10_run_size(spark, sf):
    return manifest.run_size(inputs.vector_cells(spark, sf), inputs.vectors(spark, sf))


# B. Projections, filters, predicates


@query
def b1_facts_of_families(spark, sf):
    held = fact_source.facts_of_families(inputs.facts(spark, sf), ["BUILDING", "MACHINERY"])
    return held.select("relation_family", "subject", "answer")


@query
def b2_fact_ids(spark, sf):
    return facts_with_ids(spark, sf).select(
        "subject", "fact_id", "question_id", "answer_id",
        F.array_join("correct_ids", ",").alias("correct_ids"),
    )


@query
def b3_select_rows(spark, sf):
    held = score.select_rows(
        inputs.unchecked_cells(spark, sf),
        splits=["train", "test"],
        families=["BUILDING", "HOUSEHOLD", "FURNITURE"],
        n_blocks=25,
    )
    return held.select("block_id", "cell", "split", "relation_family", "question_id")


@query
def b4_can_pair(spark, sf):
    """The pairing predicate on neighbours of each family in shuffled order."""
    facts = facts_with_ids(spark, sf).withColumn("split", F.lit("all"))
    ranked = ranking.shuffle_rank(
        facts, group=block_ops.POOL, key=["fact_id"], seed="b4", name="_rank"
    )
    couples = block_ops._couple(ranked, F.floor(F.col("_rank") / 2), F.col("_rank") % 2, block_ops.POOL)
    return couples.where("y IS NOT NULL").select(
        "relation_family",
        F.col("x.fact_id").alias("first"),
        F.col("y.fact_id").alias("second"),
        fact_source.can_pair("x", "y").alias("can_pair"),
    )


@query
def b5_expand_blocks(spark, sf):
    """Cells, ids and labels of the valid couples of b4, before any split."""
    facts = facts_with_ids(spark, sf).withColumn("split", F.lit("train"))
    ranked = ranking.shuffle_rank(
        facts, group=block_ops.POOL, key=["fact_id"], seed="b4", name="_rank"
    )
    couples = block_ops._couple(ranked, F.floor(F.col("_rank") / 2), F.col("_rank") % 2, block_ops.POOL)
    pairs = block_ops._judge(couples).where("ok")
    blocks = block_ops.assign_templates(
        pairs.select(*block_ops.POOL, "fact_q1", "fact_q2"), inputs.templates(spark, sf),
        templates_per_family=1, seed="b5",
    )
    return block_ops.expand_blocks(blocks, dataset_tier=2)


@query
def b9_readouts(spark, sf):
    return tidy(
        inputs.sweep(spark, sf).select(
            "block_id", "target_cell", "position", "layer", "moved", "gap", "flipped"
        )
    )


@query
def b11_finite_only(spark, sf):
    """log of the balance is NaN or NULL below zero and -inf at zero; one rule covers them."""
    raw = inputs.table(spark, sf, "customer").select(
        "c_mktsegment",
        F.when(F.col("c_acctbal") < 0, F.lit(float("nan")))
        .when(F.col("c_acctbal") < 100, F.lit(float("-inf")))
        .otherwise(F.col("c_acctbal") / 370)
        .alias("x"),
    )
    return tidy(
        raw.groupBy("c_mktsegment").agg(
            F.count("*").alias("n"), F.count(finite("x")).alias("n_finite"),
            F.avg(finite("x")).alias("mean_finite"),
        )
    )


@query
def b12_score_flags(spark, sf):
    return score.score_flags(inputs.fact_scores(spark, sf)).select(
        "subject", "greedy_exact", "greedy_entity", "is_model_error", "is_alias"
    )


@query
def b13_layer_stride(spark, sf):
    layers = patch.chosen_layers(7, step=3)
    held = inputs.sweep(spark, sf).where(F.col("layer").isin(layers))
    return tidy(held.groupBy("layer", "position").agg(
        F.count("*").alias("n_rows"), F.avg("moved").alias("mean_moved")
    ))


@query
def b14_cell_factors(spark, sf):
    cells = inputs.behavior(spark, sf).select("block_id", "cell")
    return cells.select("block_id", "cell", *[
        c.alias(n) for n, c in block_ops.cell_factors().items()
    ])


# C. Joins


@query
def c1_partner_pairs(spark, sf):
    return tidy(patch.partner_pairs(inputs.behavior(spark, sf)))


@query
def c2_pair_facts(spark, sf):
    pairs = block_ops.pair_facts(
        assigned_facts(spark, sf), pairings_per_fact=2, seed=inputs.CONFIG.seed
    )
    return pairs.select(
        "relation_family", "split", "round",
        F.col("fact_q1.fact_id").alias("fact_1"), F.col("fact_q2.fact_id").alias("fact_2"),
    )


def _donors(spark, sf, kind: str, pool):
    cells = inputs.behavior(spark, sf)
    pairs = patch.partner_pairs(cells).select("block_id", "target_cell", "source_cell")
    return donors.draw_donors(
        pairs, pool(cells), key=["block_id", "target_cell"], seed=f"7:NL:{kind}"
    )


@query
def c3_random_donors(spark, sf):
    return _donors(spark, sf, "random_cell", lambda c: c)


@query
def c3_matched_donors(spark, sf):
    return _donors(spark, sf, "matched_donor", lambda c: c.where("matched"))


@query
def c3_crossed_donors(spark, sf):
    return _donors(spark, sf, "crossed_donor", lambda c: c.where(~F.col("matched")))


@query
def c4_gather_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    vectors.write_vectors(inputs.vectors(spark, sf), path, half=False)
    pairs = patch.partner_pairs(inputs.vector_cells(spark, sf), strict=False).where("source_row IS NOT NULL")
    held = donors.gather_vectors(
        pairs.select("block_id", "target_row", "source_row"),
        vectors.read_vectors(spark, path), layers=[2, 5], positions=["NL"],
    )
    return tidy(held.select("block_id", "target_row", "source_row", "layer",
                            donors.norm("vec").alias("norm")))


@query
def c5_cumulative_span(spark, sf):
    span = patch.cumulative_span(inputs.vectors(spark, sf), [0, 2, 4, 6])
    return tidy(
        span.groupBy("row", "start_layer").agg(
            F.count("*").alias("n_layers"), F.sum(donors.norm("vec")).alias("norms")
        )
    )


@query
def c6_sweep_grid(spark, sf):
    pairs = patch.partner_pairs(inputs.behavior(spark, sf))
    grid = patch.sweep_grid(
        pairs.select("block_id", "target_cell", "direction"),
        position=PositionNames().ordered(),
        layer=patch.chosen_layers(7),
    )
    return grid


@query
def c7_keep_block_set(spark, sf):
    cells = inputs.behavior(spark, sf)
    held = cells.join(contrast.length_matched_blocks(cells), "block_id", "left_semi")
    return tidy(held.select("block_id", "cell", "confidence_margin"))


@query
def c10_behavior_with_vectors(spark, sf):
    cells = inputs.vector_cells(spark, sf).select("block_id", "cell", "row", "matched")
    return tidy(
        cells.join(inputs.vectors(spark, sf), "row").select(
            "block_id", "cell", "matched", "position", "layer", donors.norm("vec").alias("norm")
        )
    )


@query
def c11_template_assignment(spark, sf):
    blocks = _blocks(spark, sf)
    return blocks.groupBy("relation_family", "split", F.col("template.template_id").alias("template_id")).agg(
        F.count("*").alias("n_blocks")
    )


def _blocks(spark, sf):
    return build.build_blocks(inputs.facts(spark, sf), inputs.templates(spark, sf), inputs.CONFIG)


@query
def c12_share_side_by_side(spark, sf):
    return tidy(patch.shares_side_by_side(_conditions(spark, sf)))


# D. Aggregations


@query
def d1_table_counts(spark, sf):
    return rules.table_counts(inputs.unchecked_cells(spark, sf))


@query
def d2_block_contrasts(spark, sf):
    return tidy(contrast.block_contrasts(inputs.behavior(spark, sf)))


@query
def d3_block_gaps(spark, sf):
    return tidy(contrast.block_gaps(inputs.behavior(spark, sf)))


@query
def d4_confidence_signal(spark, sf):
    return tidy(contrast.confidence_signal(inputs.behavior(spark, sf)))


@query
def d5_block_bootstrap(spark, sf):
    """Interval, sign-flip p, sign consistency and the zero check of the interaction."""
    contrasts = contrast.block_contrasts(inputs.behavior(spark, sf))
    return tidy(resample.bootstrap_mean(contrasts, "interaction"))


@query
def d6_sign_flip_by_layer(spark, sf):
    moved = inputs.sweep(spark, sf).groupBy("layer", "block_id").agg(F.avg("moved").alias("moved"))
    return tidy(resample.bootstrap_mean(moved, "moved", keys=["layer"]))


@query
def d7_bootstrap_ratio(spark, sf):
    blocks = inputs.lines(spark, sf).groupBy("block_id").agg(
        F.avg("v").alias("num"), F.avg(F.col("l_quantity") / 37).alias("den")
    )
    return tidy(resample.bootstrap_ratio(blocks, "num", "den"))


@query
def d8_paired_effect_size(spark, sf):
    contrasts = contrast.block_contrasts(inputs.behavior(spark, sf))
    return tidy(resample.paired_effect_size(contrasts, "interaction"))


@query
def d9_auc(spark, sf):
    return tidy(contrast.auc(inputs.labelled_scores(spark, sf), "score", "quality"))


@query
def d9_auc_line_items(spark, sf):
    """Does the price rank returned line items above the rest? Heavily tied, largest table."""
    items = inputs.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("label")
    )
    return tidy(contrast.auc(items, "score", "label"))


@query
def d12_answer_clusters(spark, sf):
    return splits.answer_clusters(facts_with_ids(spark, sf))


@query
def d12_pool_sizes(spark, sf):
    return splits.pool_sizes(assigned_facts(spark, sf))


@query
def d13_likelihood_array(spark, sf):
    sequence = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    stats = likelihood.with_array_stats(inputs.table(spark, sf, "embeddings"), sequence)
    return tidy(stats.drop("embedding", "label"))


@query
def d13_likelihood_rows(spark, sf):
    """The same statistics from one row per token: the vectors of a label are one sequence."""
    long = inputs.table(spark, sf, "embeddings").select(
        "label", "vec_id", F.posexplode("embedding").alias("at", "value")
    )
    rows = long.select(
        "label",
        (F.col("vec_id") * 64 + F.col("at")).alias("index"),
        (-F.abs(F.col("value").cast("double"))).alias("logprob"),
    )
    return tidy(likelihood.likelihood_stats(rows, ["label"]))


@query
def d14_mean_vectors(spark, sf):
    means = donors.mean_vectors(inputs.vectors(spark, sf))
    long = means.select("position", "layer", F.posexplode("vec").alias("dim", "value"))
    # Single precision: five digits.
    return long.withColumn("value", F.round(F.col("value").cast("double"), 5) + F.lit(0.0))


@query
def d15_patch_summary(spark, sf):
    return tidy(patch.summarize_patching(inputs.sweep(spark, sf)))


@query
def d16_isolated_summary(spark, sf):
    marked = inputs.sweep(spark, sf).withColumn("cumulative", F.lit(True))
    return tidy(patch.summarize_isolated(marked))


@query
def d17_control_summary(spark, sf):
    return tidy(patch.summarize_controls(inputs.controls(spark, sf)))


def _conditions(spark, sf):
    return patch.condition_table(inputs.scored_conditions(spark, sf))


@query
def d18_condition_table(spark, sf):
    return tidy(_conditions(spark, sf))


@query
def d19_length_matched(spark, sf):
    return contrast.length_matched_blocks(inputs.behavior(spark, sf))


@query
def d20_score_summary(spark, sf):
    return tidy(score.score_summary(score.score_flags(inputs.fact_scores(spark, sf))))


@query
def d21_score_summary_by_family(spark, sf):
    scores = score.score_flags(inputs.fact_scores(spark, sf))
    return tidy(score.score_summary(scores, ["relation_family"]))


def _point_summary(spark, sf):
    """Effects per (position, layer) without resampling."""
    blocks = patch._per_block(
        inputs.sweep(spark, sf).where(F.col("direction") == "restore"), ["position", "layer"]
    )
    return blocks.groupBy("position", "layer").agg(
        F.try_divide(F.avg("moved"), F.avg("gap")).alias("effect"),
        F.avg("moved").alias("mean_moved"),
        (F.sum("flips") / F.sum("pairs")).alias("flip_rate"),
    )


@query
def d22_peak_layers(spark, sf):
    return tidy(patch.peak_layers(_point_summary(spark, sf)))


@query
def d23_read_cliff(spark, sf):
    return patch.read_cliff(_point_summary(spark, sf), tolerance=0.5)


@query
def d24_matched_by_correct(spark, sf):
    return contrast.matched_by_correct(inputs.behavior(spark, sf))


# E. Ranks


@query
def e2_shuffle_rank(spark, sf):
    held = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ranking.shuffle_rank(held, group=["o_orderpriority"], key=["o_orderkey"], seed=5)


@query
def e3_row_index(spark, sf):
    cells = inputs.behavior(spark, sf).select("block_id", "cell")
    return ranking.row_index(cells, ["block_id", "cell"])


@query
def e4_average_ranks(spark, sf):
    held = inputs.table(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("score"))
    return ranking.average_ranks(held, "score")


@query
def e5_flips_by_difficulty(spark, sf):
    gaps = contrast.block_gaps(inputs.behavior(spark, sf))
    cuts = cut(ranking.exact_quantiles(gaps, "gap", {"lower": 1 / 3, "upper": 2 / 3}))
    patched = inputs.controls(spark, sf).join(
        gaps.select("block_id", F.col("gap").alias("clean_gap")), "block_id"
    )
    return tidy(patch.flips_by_difficulty(patched, cuts, ["source_kind", "direction"]))


@query
def e5_exact_terciles(spark, sf):
    prices = inputs.table(spark, sf, "orders").select(
        "o_orderpriority", (F.col("o_totalprice") / 37).alias("price")
    )
    return tidy(
        ranking.exact_quantiles(
            prices, "price", {"lower": 1 / 3, "upper": 2 / 3}, group=["o_orderpriority"]
        )
    )


@query
def e6_batch_numbers(spark, sf):
    rows = inputs.table(spark, sf, "part").select("p_partkey", F.length("p_name").alias("n_tokens"))
    return ranking.batch_numbers(rows, length="n_tokens", key=["p_partkey"], batch_size=32)


# F, G. Limits and set operations


@query
def f3_capped_report(spark, sf):
    """Twenty broken rows and ten leaks of a kind are shown, the rest is counted."""
    leaks = {f"leak {kind}": 10 for kind in ("block", "question identity", "answer identity")}
    violations = rules.validate(cut(inputs.unchecked_cells(spark, sf)))
    return rules.capped_report(violations, {"row": 20, **leaks})


@query
def f4_ordered_report(spark, sf):
    """Every violation with its place in the report."""
    return rules.report(rules.validate(cut(inputs.unchecked_cells(spark, sf))))


@query
def g1_concat_facts(spark, sf):
    customers = inputs.facts(spark, sf)
    nation = inputs.table(spark, sf, "nation")
    suppliers = inputs.table(spark, sf, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).select(F.lit("SUPPLIER").alias("relation_family"), F.col("s_name").alias("subject"),
             F.col("n_name").alias("answer"))
    both = fact_source.concat_facts(customers, suppliers)
    return both.withColumn("also_correct", F.array_join("also_correct", ","))


@query
def g3_duplicate_blocks(spark, sf):
    """Customers of one segment and nation would collide under an id made of just those."""
    ids = inputs.raw_facts(spark, sf).select(
        F.concat_ws("/", "c_mktsegment", "n_name").alias("block_id")
    )
    return block_ops.duplicate_blocks(ids)


@query
def g4_snapshot_drift(spark, sf):
    """Order priorities by customer, against those of customers in credit: rows of one side only."""
    current = inputs.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("label")
    )
    frozen = inputs.table(spark, sf, "customer").join(
        inputs.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")
    ).where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("key"), F.col("o_orderpriority").alias("label")
    )
    return positions.snapshot_drift(current, frozen)


@query
def g4_position_drift(spark, sf):
    """Positions by one tokenizer against a frozen table by another, for turns of either table."""
    rendered = prompts.render_prompts(inputs.turns(spark, sf))

    def snapshot(held, tokenizer=None):
        tokens = held.withColumn("tokens", positions.encode("prompt", tokenizer))
        return positions.position_snapshot(positions.resolve_positions(tokens), ["conv_id", "turn"])

    now = snapshot(rendered.where("turn >= 2"))
    frozen = snapshot(rendered.where("turn <= 4"), inputs.short_tokenizer)
    drift = positions.field_drift(now, frozen, ["conv_id", "turn"])
    return drift.select(
        "conv_id", "turn", "change", F.array_join("fields.field", ",").alias("fields"),
        F.array_join(F.transform("fields", lambda f: F.concat_ws(">", F.coalesce(f["was"], F.lit("-")),
                                                                  F.coalesce(f["now"], F.lit("-")))), ",").alias("values"),
    )


# H. Text, prompts, positions, likelihood, noise


@query
def h1_slugify(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.slugify("text")).alias("slug_md5"),
        F.length(text.slugify("text")).alias("slug_length"),
    )


@query
def h1_slugify_names(spark, sf):
    return inputs.table(spark, sf, "part").select(
        "p_partkey",
        text.slugify(F.concat_ws(" & ", "p_name", "p_brand", "p_type")).alias("slug"),
    )


@query
def h2_normalize_entity(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", F.md5(text.normalize_entity("text")).alias("entity_md5"),
        F.length(text.normalize_entity("text")).alias("entity_length"),
    )


@query
def h3_fill_template(spark, sf):
    facts = cut(patch.sweep_grid(inputs.facts(spark, sf), place=range(len(inputs.TEMPLATE_TEXTS))))
    asked = block_ops.pick_templates(facts, inputs.templates(spark, sf), F.col("place"))
    return asked.select("subject", "template.ordinal",
                        text.fill_template("template.text", "subject_phrase").alias("question"))


@query
def h4_prompts(spark, sf):
    rendered = prompts.render_prompts(inputs.turns(spark, sf))
    return rendered.select("conv_id", "turn", "prompt_sha256", "template_hash",
                           F.length("prompt").alias("n_chars"), "anchors.*")


def _resolved(spark, sf):
    rendered = prompts.render_prompts(inputs.turns(spark, sf))
    return positions.resolve_positions(rendered.withColumn("tokens", positions.encode("prompt")))


@query
def h7_tokens(spark, sf):
    held = inputs.table(spark, sf, "conversations").withColumn("tokens", positions.encode("text"))
    return held.select("conv_id", "turn", F.posexplode("tokens").alias("index", "t")).select(
        "conv_id", "turn", "index", "t.*"
    )


def blank_tokenizer():
    """Runs between blanks; the id is the length."""
    pattern = re.compile("[^ ]+")
    return lambda text: [(len(m[0]), m.start(), m.end()) for m in pattern.finditer(text)]


@query
def j2_custom_tokenizer(spark, sf):
    held = inputs.table(spark, sf, "conversations")
    tokens = held.withColumn("tokens", positions.encode("text", blank_tokenizer))
    return tokens.select("conv_id", "turn", F.posexplode("tokens").alias("index", "t")).select(
        "conv_id", "turn", "index", "t.*"
    )


@query
def h8_covering_token(spark, sf):
    """The token over the middle character of each text."""
    held = inputs.table(spark, sf, "conversations").withColumn("tokens", positions.encode("text"))
    middle = F.floor(F.length("text") / 2)
    return held.select("conv_id", "turn", positions.covering_token("tokens", middle).alias("index"))


@query
def h9_positions(spark, sf):
    names = PositionNames().ordered()
    return _resolved(spark, sf).select(
        "conv_id", "turn", "position_error", "n_tokens", "n_answer_tokens", "answer_start",
        "answer_end", *[f"pos_{n}" for n in names], *[f"tok_{n}" for n in names],
    )


@query
def h10_token_window(spark, sf):
    held = _resolved(spark, sf)
    return held.select(
        "conv_id", "turn", positions.token_window("prompt", "tokens", F.col("pos_NL")).alias("window")
    )


@query
def h12_position_sets(spark, sf):
    long = positions.token_table(_resolved(spark, sf), ["conv_id", "turn"])
    sets = [c for c in long.columns if c.startswith("in_")]
    return long.groupBy("conv_id", "turn").agg(
        *[F.count_if(s).alias(f"n_{s[3:]}") for s in sets]
    )


@query
def h13_class_margin(spark, sf):
    held = inputs.table(spark, sf, "embeddings")
    return tidy(held.select("vec_id", likelihood.class_margin("embedding", 7, 3).alias("margin")))


@query
def h14_answer_logprobs(spark, sf):
    """Logits of each label's vectors in order; the token to predict is hashed from the key."""
    held = inputs.table(spark, sf, "embeddings")
    predicted = held.select("label", F.col("vec_id").alias("index"), F.col("embedding").alias("logits"))
    tokens = held.select(
        "label", (F.col("vec_id") + 1).alias("index"),
        F.pmod(F.col("vec_id") * 7, F.size("embedding")).cast("int").alias("token_id"),
        F.lit(True).alias("in_answer"),
    )
    return tidy(likelihood.answer_logprobs(predicted, tokens, ["label"]))


@query
def h15_half_precision(spark, sf):
    held = inputs.table(spark, sf, "embeddings").withColumn("half", vectors.half_precision("embedding"))
    error = F.zip_with("embedding", "half", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return tidy(held.select("vec_id", (F.array_max(error) * 1000).alias("largest_error")))


@query
def h16_gaussian(spark, sf):
    """The noise itself, element by element, in thousandths."""
    noise = donors.gaussian_vectors(inputs.vectors(spark, sf), key=["row"], seed=7)
    long = noise.select("row", "layer", "position", F.posexplode("vec").alias("dim", "value"))
    return long.withColumn("value", F.round(F.col("value").cast("double") * 1000, 2) + F.lit(0.0))


@query
def h17_stable_seed(spark, sf):
    held = inputs.table(spark, sf, "customer")
    return held.select("c_custkey", stable_seed(2**31 - 5, "c_name", "c_mktsegment").alias("seed"))


@query
def h18_first_line(spark, sf):
    held = inputs.table(spark, sf, "documents")
    return held.select("doc_id", text.first_line("text").alias("first_line"))


# J. Scoring by a supplied model


@query
def j1_score_batches(spark, sf):
    resolved = _resolved(spark, sf)
    scored = score.score(
        resolved.select("conv_id", "turn", "n_tokens", "input_ids"),
        inputs.id_mean_scorer, "confidence_margin double", key=["conv_id", "turn"], batch_size=8,
    )
    return tidy(scored)


# K. Gates


@query
def k1_signal_gates(spark, sf):
    signal = contrast.confidence_signal(inputs.behavior(spark, sf))
    summary = patch.summarize_patching(inputs.sweep(spark, sf))
    return _signal_columns(gates.signal_gates(signal, summary))


@query
def k2_route_gates(spark, sf):
    isolated = patch.summarize_isolated(inputs.sweep(spark, sf))
    return tidy(gates.route_gates(_conditions(spark, sf), isolated))


@query
def k3_control_gates(spark, sf):
    return _control_columns(
        gates.control_gates(patch.summarize_controls(inputs.controls(spark, sf)))
    )


# L. Splits and the build


@query
def l1_split_exact(spark, sf):
    assigned = splits.assign_facts(facts_with_ids(spark, sf), holdout=["FURNITURE"], seed=7)
    return assigned.select("fact_id", "split")


@query
def l1_split_hash(spark, sf):
    assigned = splits.assign_facts(
        facts_with_ids(spark, sf), holdout=["FURNITURE"], seed=7, method="hash"
    )
    return assigned.select("fact_id", "split")


@query
def l2_build_cells(spark, sf):
    return built_cells(spark, sf)


@query
def l2_build_dataset(spark, sf):
    """The whole pipeline with its files: validated counts as written to the manifest."""
    result = build.build_dataset(
        inputs.facts(spark, sf), inputs.templates(spark, sf), inputs.CONFIG,
        scratch_path(spark, "build"),
    )
    counts = rules.table_counts(result.cells)
    return counts.withColumn("valid", F.lit(result.ok))


@query
def l3_measured_behavior(spark, sf):
    """Built cells, rendered, resolved, scored and reduced to block gaps."""
    cells = cut(built_cells(spark, sf))
    behavior = measure.measure(cells, inputs.id_mean_scorer)
    return tidy(contrast.block_gaps(behavior))


@query
def l4_sweep_to_gates(spark, sf):
    """Pairs, grid, scorer, read-outs, summary and gates in one go."""
    behavior = cut(inputs.behavior(spark, sf))
    patched = cut(
        measure.sweep(
            behavior, inputs.blend_scorer, positions=PositionNames().ordered(),
            layers=patch.chosen_layers(7),
        )
    )
    signal = contrast.confidence_signal(behavior)
    return _signal_columns(gates.signal_gates(signal, patch.summarize_patching(patched)))


@query
def l5_behavior_likelihood(spark, sf):
    """Behaviour rows with the ten likelihood statistics in place of the scorer's arrays."""
    behavior = measure.measure(
        cut(built_cells(spark, sf)), inputs.id_logprob_scorer, schema="logprobs array<double>",
        likelihood="logprobs",
    )
    stats = ["lp_mean", "lp_min", "lp_max", "lp_var", "lp_first", "lp_last", "lp_sum", "nll", "nll_per_token"]
    return tidy(behavior.select("block_id", "cell", *stats, "n_answer_tokens"))


def _scored_facts(spark, sf):
    names = [r["n_name"] for r in inputs.table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]
    return scoring.score_facts(
        inputs.facts(spark, sf), inputs.templates(spark, sf), inputs.guess_answerer(names), inputs.id_gold_scorer,
        ordinal=1,
    )


@query
def l8_scored_facts(spark, sf):
    """Facts, questions, two passes of a model over distinct prompts, and flags."""
    return tidy(_scored_facts(spark, sf))


@query
def l9_fact_score_summary(spark, sf):
    scored = cut(_scored_facts(spark, sf))
    return tidy(score.score_summary(scored, ["relation_family"]))


def _control_sweep(spark, sf, kinds=SOURCE_KINDS):
    """Pairs with replacement vectors from a store, scored by a model that reads them."""
    path = scratch_path(spark, "vectors")
    rows = inputs.table(spark, sf, "embeddings").count()
    held = inputs.position_vectors(spark, sf)
    vectors.write_vectors(held, path, half=False, buckets=vectors.buckets_for(rows))
    cells = cut(inputs.probed_cells(spark, sf))
    return measure.control_sweep(
        cells, vectors.read_vectors(spark, path), inputs.probe_scorer, positions=list(inputs.PLACES),
        layers=range(inputs.START, 8), kinds=kinds, seed=7,
    )


@query
def l6_control_sweep(spark, sf):
    """Patched margins of the five kinds of sources that are not noise."""
    swept = _control_sweep(spark, sf, [k for k in SOURCE_KINDS if k != "gaussian"])
    return tidy(
        swept.select(
            "block_id", "target_cell", "position", "source_kind", "start_layer", "direction",
            *[F.round(c, 5).alias(c) for c in ("patched", "moved", "gap")],
        )
    )


@query
def l7_controls_to_gates(spark, sf):
    """All six kinds of sources, from vectors to the control gates."""
    summary = patch.summarize_controls(cut(_control_sweep(spark, sf)))
    return _control_columns(gates.control_gates(summary))


# V. Validation


def _violations(rule):
    def run(spark, sf):
        return rule(inputs.unchecked_cells(spark, sf)).select(*rules.COLUMNS)

    return run


for _name, _rule in {
    "v1_row_rules": rules.row_rules,
    "v2_block_rules": rules.block_rules,
    "v3_split_leaks": rules.split_leaks,
    "v4_label_rules": rules.label_rules,
    "v4_family_rules": rules.family_rules,
    "v5_text_rules": rules.text_rules,
}.items():
    REGISTRY[_name] = _violations(_rule)


@query
def v7_appended_cells(spark, sf):
    """Violations after three appends, cells dealt out so that blocks and identities meet in several."""
    cells, path = cut(inputs.unchecked_cells(spark, sf)), scratch_path(spark, "appended")
    for part in range(3):
        held = cells.where(F.pmod(F.xxhash64("block_id", F.col("cell") < "q2"), F.lit(3)) == part)
        found = rules.append_checked(held, path)
    return found


@query
def v5_empty_table(spark, sf):
    """Blocks of each segment that pass a filter nothing passes: the empty-table rule."""
    none = inputs.unchecked_cells(spark, sf).where(F.col("dataset_tier") > 100)
    return rules.empty_table(none)


@query
def v6_fact_rules(spark, sf):
    """Customers and their nation, where some phrases and accepted answers are wrong."""
    base = inputs.raw_facts(spark, sf)
    balance = F.col("c_acctbal")
    raw = base.select(
        F.col("c_mktsegment").alias("relation_family"),
        F.concat(F.lit("Firm "), F.floor(F.col("c_custkey") * 2 / 3)).alias("subject"),
        F.when(balance > 9000, F.col("c_name"))
        .otherwise(F.concat(F.lit("Firm "), F.floor(F.col("c_custkey") * 2 / 3)))
        .alias("subject_phrase"),
        F.when(balance < -950, F.lit("?")).otherwise(F.col("n_name")).alias("answer"),
        F.when(balance < 0, F.array(text.slugify("n_name"), F.lower(F.col("c_mktsegment"))))
        .otherwise(F.array())
        .cast("array<string>")
        .alias("also_correct"),
    )
    facts = fact_source.with_ids(fact_source.read_facts(raw))
    return rules.fact_rules(facts, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"])
