from collections import Counter

import pytest
from conftest import TOY, toy_facts, toy_templates
from pyspark.sql import functions as F

from crossblock.operators import blocks, splits
from crossblock.operators.contrast import block_contrasts
from crossblock.operators.patch import partner_pairs
from crossblock.plans import build
from crossblock.session import cut
from crossblock.sources import facts as fact_source


def pool(spark, answers, partitions=4):
    """One pool with the given answer per fact."""
    rows = [("f", f"s{i}", a) for i, a in enumerate(answers)]
    raw = spark.createDataFrame(rows, "relation_family string, subject string, answer string")
    facts = fact_source.with_ids(fact_source.read_facts(raw)).withColumn("split", F.lit("train"))
    return cut(facts.repartition(partitions))


def pairs_of(facts, k=1, seed=0):
    found = blocks.pair_facts(facts, pairings_per_fact=k, seed=seed)
    return found.select("round", "fact_q1.fact_id", "fact_q2.fact_id", "fact_q1.answer_id",
                        "fact_q2.answer_id").collect()


@pytest.mark.parametrize("hot", [0, 34, 70])
def test_pairing_is_as_large_as_it_can_be(spark, hot):
    """One answer holds `hot` of 100 facts: every possible partner is used."""
    answers = ["hot"] * hot + [f"a{i % 11}" for i in range(100 - hot)]
    rows = pairs_of(pool(spark, answers))
    assert len(rows) == min(50, 100 - hot)
    seen = Counter(x for r in rows for x in (r[1], r[2]))
    assert max(seen.values()) == 1
    assert all(r[3] != r[4] and r[1] < r[2] for r in rows)


@pytest.mark.parametrize("hot", [12_000, 8_000])
def test_large_pools_pair_as_small_ones_do(spark, monkeypatch, hot):
    """One answer holds a half or a third among thousands: cut into buckets, no pair is lost."""
    from crossblock.operators import ranking

    facts = pool(spark, ["hot"] * hot + [f"a{i}" for i in range(24_000 - hot)])
    want = sorted(pairs_of(facts))
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 500)
    assert sorted(pairs_of(facts)) == want and len(want) == 12_000


def test_no_pair_returns_and_the_result_is_deterministic(spark):
    answers = [f"a{i % 5}" for i in range(41)]
    first = pairs_of(pool(spark, answers, 1), k=2)
    assert sorted(first) == sorted(pairs_of(pool(spark, answers, 7), k=2))
    couples = [(r[1], r[2]) for r in first]
    assert len(set(couples)) == len(couples) >= 38
    for r in range(2):
        used = Counter(x for row in first if row[0] == r for x in (row[1], row[2]))
        assert max(used.values()) == 1
    assert sorted(first)[:20] != sorted(pairs_of(pool(spark, answers), seed=1))
    with pytest.raises(ValueError, match="pairings_per_fact"):
        pairs_of(pool(spark, answers), k=0)


@pytest.mark.parametrize(("n", "k"), [(40, 10), (41, 10), (6, 10), (7, 10), (2, 3)])
def test_many_rounds_from_one_layout(spark, n, k):
    """All answers differ: rounds are full until every pair has been used."""
    rows = pairs_of(pool(spark, [f"a{i}" for i in range(n)]), k=k)
    couples = [(r[1], r[2]) for r in rows]
    assert len(set(couples)) == len(couples)
    for r in range(k):
        used = Counter(x for row in rows if row[0] == r for x in (row[1], row[2]))
        assert max(used.values(), default=0) <= 1
    full = sum(min(n // 2, max(0, n * (n - 1) // 2 - r * (n // 2))) for r in range(k))
    # An even pool has n - 1 full rounds, taken as n / 2 of them and n / 2 with two facts alone.
    assert len(rows) >= min(full, n * (n - 1) // 2) - (0 if n % 2 or k <= n // 2 else k)
    if k >= n:
        assert len(rows) == n * (n - 1) // 2


@pytest.mark.parametrize("hot", [0, 20])
def test_many_rounds_with_clashes(spark, hot):
    answers = ["hot"] * hot + [f"a{i % 6}" for i in range(60 - hot)]
    rows = pairs_of(pool(spark, answers), k=10)
    couples = [(r[1], r[2]) for r in rows]
    assert len(set(couples)) == len(couples) and all(r[3] != r[4] for r in rows)
    for r in range(10):
        used = Counter(x for row in rows if row[0] == r for x in (row[1], row[2]))
        assert max(used.values()) == 1
    assert len(rows) >= 270


def test_other_correct_answers_are_respected(spark):
    raw = spark.createDataFrame(
        [("f", "x", "one", ["two"]), ("f", "y", "two", []), ("f", "z", "three", [])],
        "relation_family string, subject string, answer string, also_correct array<string>",
    )
    facts = fact_source.with_ids(fact_source.read_facts(raw))
    a, b = facts.select(F.struct("*").alias("a")), facts.select(F.struct("*").alias("b"))
    allowed = {
        (r[0], r[1])
        for r in a.crossJoin(b)
        .where(fact_source.can_pair("a", "b"))
        .select("a.subject", "b.subject")
        .collect()
    }
    assert allowed == {("x", "z"), ("z", "x"), ("y", "z"), ("z", "y")}


def test_cells_of_the_build(spark, cells):
    rows = cells.collect()
    by_block = Counter(r["block_id"] for r in rows)
    assert set(by_block.values()) == {4}
    for r in rows:
        assert r["matched"] == (r["q_index"] == r["a_index"]) == r["correct"]
        assert r["cell"] == f"q{r['q_index']}a{r['a_index']}"
        assert "{" not in r["question"]
    splits_of = {}
    for r in rows:
        for identity in (r["question_id"], r["answer_id"]):
            splits_of.setdefault(identity, set()).add(r["split"])
    assert all(len(s) == 1 for s in splits_of.values())
    assert {r["split"] for r in rows if r["relation_family"] == "author"} == {"family_holdout"}
    used = Counter((r["relation_family"], r["split"], r["template_id"]) for r in rows)
    per_pool = {}
    for (f, s, _), n in used.items():
        per_pool.setdefault((f, s), []).append(n)
    assert all(max(n) - min(n) <= 4 for n in per_pool.values() if len(n) == 3)


def test_split_shares_and_clusters(spark):
    facts = fact_source.with_ids(fact_source.read_facts(toy_facts(spark, 120)))
    for method in ("exact", "hash"):
        rows = splits.assign_facts(facts, holdout=["author"], seed=1, method=method).collect()
        held = {r["answer_id"]: set() for r in rows}
        for r in rows:
            held[r["answer_id"]].add(r["split"])
        assert all(len(s) == 1 for s in held.values())
        assert {r["split"] for r in rows if r["relation_family"] == "author"} == {"family_holdout"}
    exact = splits.assign_facts(facts, seed=1)
    shares = exact.groupBy("relation_family").agg(F.avg((F.col("split") == "train").cast("int")))
    assert all(0.6 <= r[1] <= 0.8 for r in shares.collect())


def test_a_heavy_cluster_stays_whole(spark):
    """One answer holds a third of the facts and passes through the broadcast side."""
    rows = [("f", f"s{i}", "hot" if i % 3 == 0 else f"a{i}") for i in range(3000)]
    raw = spark.createDataFrame(rows, "relation_family string, subject string, answer string")
    facts = fact_source.with_ids(fact_source.read_facts(raw))
    out = splits.assign_facts(facts, seed=2)
    assert out.count() == 3000 and out.where("split IS NULL").count() == 0
    assert out.where(F.col("answer_id") == "a:f:hot").select("split").distinct().count() == 1


def test_few_clusters_still_reach_every_split(spark):
    for n in (6, 9, 12):
        raw = fact_source.read_facts(toy_facts(spark, n, ("capital",)))
        assigned = cut(splits.assign_facts(fact_source.with_ids(raw), seed=n))
        splits.require_pools(assigned)
        assert splits.pool_sizes(assigned).agg(F.min("n_answers")).first()[0] >= 2


def test_bad_splits_are_refused(spark):
    with pytest.raises(ValueError, match="add up to one"):
        splits.Ratios(0.7, 0.2, 0.2)
    with pytest.raises(ValueError, match="must be positive"):
        splits.Ratios(1.0, 0.0, 0.0)
    thin = fact_source.with_ids(fact_source.read_facts(toy_facts(spark, 3)))
    with pytest.raises(ValueError, match="too little for a block"):
        splits.require_pools(splits.assign_facts(thin))
    with pytest.raises(ValueError, match="no family to fit"):
        held = splits.assign_facts(thin, holdout=["capital", "river", "author"])
        splits.require_pools(held)


def test_build_dataset_writes_a_valid_table(spark, tmp_path):
    result = build.build_dataset(toy_facts(spark), toy_templates(spark), TOY, str(tmp_path))
    assert result.ok and result.violations.count() == 0
    row = spark.read.json(f"{tmp_path}/manifest").first()
    assert row["command"] == "data build" and row["artifacts"]["cells"]["n_rows"] > 0


def test_missing_optional_fields_and_duplicate_ids(spark):
    raw = spark.createDataFrame(
        [("f", "x", None, "one", None)],
        "relation_family string, subject string, subject_phrase string, answer string, also_correct array<string>",
    )
    row = fact_source.with_ids(fact_source.read_facts(raw)).first()
    assert row["subject_phrase"] == "x" and row["correct_ids"] == ["a:f:one"]
    twice = spark.createDataFrame([("b",), ("b",), ("c",)], "block_id string")
    with pytest.raises(ValueError, match="block ids repeat, first b"):
        blocks.require_unique_blocks(twice)


def test_unknown_family_and_template_errors(spark):
    facts = fact_source.read_facts(toy_facts(spark))
    with pytest.raises(Exception, match="no facts for the families nowhere"):
        fact_source.facts_of_families(facts, ["capital", "nowhere"]).collect()
    with pytest.raises(Exception, match="too few question templates"):
        fact_source.templates_for(toy_templates(spark), facts, 4).collect()


def test_pairs_and_contrast_by_hand(spark):
    rows = [("b", c, int(c[1]), int(c[3]), c[1] == c[3], z)
            for c, z in zip(["q1a1", "q1a2", "q2a1", "q2a2"], [3.0, -1.0, -2.0, 4.0], strict=True)]
    schema = ("block_id string, cell string, q_index int, a_index int, matched boolean, "
              "confidence_margin double")  # fmt: skip
    behavior = spark.createDataFrame(rows, schema)
    assert block_contrasts(behavior).first()[1:] == (10.0, 5.0)
    pairs = {(r["target_cell"], r["source_cell"], r["direction"]) for r in partner_pairs(behavior).collect()}
    assert pairs == {("q1a1", "q1a2", "ablate"), ("q1a2", "q1a1", "restore"),
                     ("q2a2", "q2a1", "ablate"), ("q2a1", "q2a2", "restore")}
    short = behavior.where("cell <> 'q2a1'")
    with pytest.raises(Exception, match="no single partner"):
        partner_pairs(short).collect()
    assert partner_pairs(short, strict=False).where("source_cell IS NULL").count() == 1
    with pytest.raises(Exception, match="no block has a value"):
        block_contrasts(short).collect()
    with pytest.raises(Exception, match="no single partner"):
        partner_pairs(behavior.union(behavior), strict=False).collect()
