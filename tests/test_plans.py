"""What must reach the scan, and results under other partition counts."""

import pandas as pd
import pytest
from check_oracle import rows_of

import __spark_entry__ as entry
from crossblock.operators import score
from crossblock.plans import inputs, scoring
from crossblock.session import cut

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(entry.queries()["d24_matched_by_correct"](spark, SMALL))
    wanted = "l_suppkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string"
    assert f"ReadSchema: struct<{wanted}>" in text
    text = plan(entry.queries()["b1_facts_of_families"](spark, SMALL))
    assert "PushedFilters: [In(c_mktsegment, [BUILDING,MACHINERY])" in text.replace("IsNotNull(c_nationkey), ", "")


@pytest.mark.parametrize("name", ["e2_shuffle_rank", "l1_split_hash", "c1_partner_pairs", "d2_block_contrasts"])
def test_partitioning_does_not_change_the_result(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = set()
    try:
        for n in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = entry.queries()[name](spark, SMALL)
            found.add(repr(rows_of(df.columns, [tuple(r) for r in df.collect()])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 1


RANKED = [
    "c2_pair_facts", "c3_random_donors", "c3_crossed_donors", "d5_block_bootstrap", "d7_bootstrap_ratio",
    "d9_auc_line_items", "e2_shuffle_rank", "e4_average_ranks", "e5_exact_terciles", "l1_split_exact",
]


@pytest.mark.parametrize("name", RANKED)
def test_window_width_does_not_change_the_result(spark, name, monkeypatch):
    """The same rows when every group of more than forty rows is cut into buckets."""
    from crossblock.operators import ranking

    run = entry.queries()[name]
    whole = run(spark, MID)
    want = rows_of(whole.columns, [tuple(r) for r in whole.collect()])
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 40)
    cut = run(spark, MID)
    assert rows_of(cut.columns, [tuple(r) for r in cut.collect()]) == want


def test_lookups_agree_however_the_right_side_travels(spark, monkeypatch):
    from crossblock.operators import lookup

    left = spark.range(9000).selectExpr("id", "IF(id % 3 = 0, 0, id) AS k", "IF(id = 5, NULL, 'x') AS t")
    right = cut(left.groupBy("k").count().selectExpr("IF(k = 7, NULL, k) AS k", "count AS n", "k * 2 AS v").where("k <> 8"))
    found = []
    for small in (5, 100_000):
        monkeypatch.setattr(lookup, "SMALL", small)
        joined = lookup.sized_lookup(left, right, ["k"], "n")
        found.append(rows_of(joined.columns, [tuple(r) for r in joined.collect()]))
    assert found[0] == found[1] and len(found[0]) == 9000
    assert all(r[-1] == (None if r[1] in (7, 8) else 2 * r[1]) for r in found[0])


def jobs_of(spark, name):
    """Jobs that a query starts, with its result written away."""
    group = f"count-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        entry.queries()[name](spark, MID).write.format("noop").mode("overwrite").save()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(("name", "most"), [("c2_pair_facts", 50), ("l2_build_cells", 70)])
def test_pairing_takes_few_jobs(spark, name, most):
    assert jobs_of(spark, name) <= most


def test_the_signal_reads_its_blocks_once(spark, monkeypatch):
    """Behaviour is read for the blocks and for the AUC; everything else reads the blocks."""
    from crossblock.operators import contrast, ranking, resample

    seen = []
    for module in (contrast, ranking, resample):
        plain = module.cut
        monkeypatch.setattr(module, "cut", lambda df, plain=plain: seen.append(plan(df)) or plain(df))
    seen.append(plan(entry.queries()["d4_confidence_signal"](spark, SMALL)))
    single = plan(inputs.behavior(spark, SMALL)).count("lineitem.parquet")
    assert sum(text.count("lineitem.parquet") for text in seen) <= 2 * single


def test_rows_to_score_are_never_broadcast(spark):
    """Rows of a grid repeat their columns: small as files, large in memory."""
    rows = cut(spark.range(40).selectExpr("cast(id % 10 as string) AS block_id", "cast(floor(id / 10) as int) AS layer", "'x' AS text"))
    key = ["block_id", "layer"]
    placed = score.in_batches(rows, rows.select(*key), key=key, length="layer", batch_size=4)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert placed.count() == 40


def test_scores_come_in_whole_frames(spark):
    """Batches keep their size and length across frames, and a worker returns few frames, not one per batch."""
    def factory():
        def run(batch):
            assert batch["n_tokens"].nunique(dropna=False) == 1 and len(batch) <= 4
            return pd.DataFrame({"size": [len(batch)] * len(batch), "twice": batch["id"] * 2})

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(60).selectExpr("id", "cast(if(id % 3 = 0, null, id % 3) as int) AS n_tokens").coalesce(1)
        scored = score.score(rows, factory, "size int, twice long", key=["id"], keep=["id", "n_tokens"], batch_size=4, spread=False)
        seen = scored.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["id"], r["twice"]) for r in seen) == [(i, 2 * i) for i in range(60)]
    assert all(r["size"] == 4 for r in seen)


def test_facts_are_spread_before_their_tokens(spark, monkeypatch):
    """Facts of one small file are much work: they must not all be resolved by one task."""
    from conftest import toy_facts, toy_templates

    seen, whole = [], scoring.resolved_cells
    monkeypatch.setattr(scoring, "resolved_cells", lambda cells, **o: seen.append(plan(cells)) or whole(cells, **o))
    got = scoring.score_facts(toy_facts(spark).coalesce(1), toy_templates(spark), inputs.guess_answerer(["A", "B"]), inputs.id_gold_scorer)
    assert got.count() == 120
    assert "REPARTITION_BY_NUM" in seen[0]
