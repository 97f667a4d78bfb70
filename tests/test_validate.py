"""Corrupt a good table in one way and expect that violation."""

import functools

import pytest
from pyspark.sql import functions as F

from crossblock.operators import validate as rules
from crossblock.session import cut
from crossblock.sources import contract
from crossblock.sources import facts as fact_source


def first_block(cells):
    held = cells.where("relation_family = 'capital' AND split = 'train'")
    return held.agg(F.min("block_id")).first()[0]


def kinds(cells):
    return {(r["rule"], r["kind"]) for r in rules.validate(cells).collect()}


def test_good_table(cells):
    assert rules.validate(cells).count() == 0


def change(cells, column, value, cell="q1a1"):
    here = (F.col("block_id") == first_block(cells)) & (F.col("cell") == cell)
    return cells.withColumn(column, F.when(here, F.lit(value).cast(cells.schema[column].dataType)).otherwise(F.col(column)))


def test_dropped_and_duplicated_cells(cells):
    block = first_block(cells)
    here = (F.col("block_id") == block) & (F.col("cell") == "q1a2")
    assert kinds(cells.where(~here)) == {("block", "row count")}
    doubled = cells.unionByName(cells.where(here))
    found = rules.block_rules(doubled).collect()
    assert [(r["kind"], r["id"], r["detail"]) for r in found] == [("row count", block, "5")]


@pytest.mark.parametrize(
    "column, value, expected",
    [
        ("matched", False, {("row", "cell disagrees with matched"), ("block", "matched cells"),
                                   ("block", "question not balanced"), ("block", "answer not balanced"),
                                   ("row", "crossed cell is correct without being an alias"),
                                   ("label", "crossed cell is correct without being an alias")}),
        ("correct", False, {("label", "matched cell is incorrect")}),
        ("split", "test", {("block", "split not constant"), ("leak", "block"),
                                  ("leak", "question identity"), ("leak", "answer identity")}),
        ("template_id", "other/t9", {("block", "template_id not constant")}),
        ("question", "Who is {s}?", {("text", "unfilled placeholder"),
                                            ("text", "question text varies in a template")}),
        ("answer", "something else", {("text", "answer text varies")}),
        ("answer", "  ", {("text", "answer text varies"), ("text", "blank question or answer")}),
        ("answer_source", "oracle", {("row", "answer_source outside its domain")}),
        ("cell", "q1a2", {("row", "cell disagrees with its indices"), ("block", "cells"),
                                 ("row", "cell disagrees with matched")}),
        ("dataset_tier", 7, {("row", "dataset_tier out of range"),
                                                    ("block", "dataset_tier not constant")}),
        ("subject", None, {("row", "subject is null")}),
        ("subject", "", {("row", "subject is empty")}),
    ],
)
def test_one_corruption(cells, column, value, expected):
    assert kinds(change(cells, column, value)) == expected


def test_crossed_cell_marked_correct(cells):
    found = kinds(change(cells, "correct", True, "q1a2"))
    assert found == {("row", "crossed cell is correct without being an alias"),
                     ("label", "crossed cell is correct without being an alias")}
    alias = change(change(cells, "correct", True, "q1a2"), "answer_source", "alias", "q1a2")
    assert kinds(alias) == set()


def test_repeated_pairs_with_balanced_identities(cells):
    """Both crossed cells carry the matched pairs: every identity is still balanced."""
    block = cells.where(F.col("block_id") == first_block(cells))
    swapped = {r["cell"]: r for r in block.collect()}
    spark = cells.sparkSession
    rows = []
    for cell, twin in (("q1a1", "q1a1"), ("q2a2", "q2a2"), ("q1a2", "q1a1"), ("q2a1", "q2a2")):
        rows.append({**swapped[cell].asDict(), "answer_id": swapped[twin]["answer_id"]})
    broken = spark.createDataFrame([tuple(r[c] for c in cells.columns) for r in rows], cells.schema)
    assert ("block", "pairs not unique") in {(r["rule"], r["kind"]) for r in rules.block_rules(broken).collect()}


def test_family_rules(cells):
    moved = cells.withColumn(
        "split",
        F.when((F.col("relation_family") == "river") & (F.col("split") == "train"), "test").otherwise(F.col("split")),
    )
    assert {r["kind"] for r in rules.family_rules(moved).collect()} == {"absent from a fittable split"}
    both = cells.withColumn(
        "split",
        F.when((F.col("relation_family") == "river") & (F.col("split") == "test"), "family_holdout").otherwise(F.col("split")),
    )
    assert {r["kind"] for r in rules.family_rules(both).collect()} == {
        "held out and fittable", "absent from a fittable split"}


def test_empty_table(cells):
    assert kinds(cells.limit(0)) == {("table", "empty")}


def test_a_block_that_holds_most_rows(spark, cells):
    """A broken block with thousands of rows costs one counter, not a collected list."""
    block = first_block(cells)
    many = cells.where(F.col("block_id") == block).crossJoin(spark.range(2000)).drop("id")
    found = rules.block_rules(cells.unionByName(many)).collect()
    assert [(r["kind"], r["detail"]) for r in found] == [("row count", "8004")]


def test_report_is_capped_but_the_table_is_not(cells):
    bad = cells.withColumn("answer_source", F.lit("oracle"))
    violations = cut(rules.validate(bad))
    assert violations.where("rule = 'row'").count() == cells.count()
    assert rules.capped_report(violations).count() == violations.count()
    report = rules.capped_report(violations, {"row": 20})
    assert report.where("check = 'row' AND kind <> 'further violations'").count() == 20
    rest = report.where("kind = 'further violations'").first()["detail"]
    assert int(rest) == cells.count() - 20


def test_contract(spark, cells, tmp_path):
    contract.write_cells(cells, f"{tmp_path}/cells")
    assert contract.read_cells(spark, f"{tmp_path}/cells").count() == cells.count()
    cells.select("block_id").write.parquet(f"{tmp_path}/one")
    with pytest.raises(contract.ContractError, match="not those of the contract"):
        contract.read_cells(spark, f"{tmp_path}/one")
    cells.withColumn("q_index", F.col("q_index").cast("int")).write.parquet(f"{tmp_path}/wide")
    with pytest.raises(contract.ContractError, match="another type"):
        contract.read_cells(spark, f"{tmp_path}/wide")


def test_fact_rules(spark):
    schema = "relation_family string, subject string, subject_phrase string, answer string, also_correct array<string>"
    rows = [
        ("f", "A", "the A", "one", []),
        ("f", "a", "the a", "two", ["one"]),
        ("f", "B", "the C", "three", ["three", "nine"]),
        ("g", "?", "?", "one", []),
        ("f", "D", "D", "!", []),
    ]
    facts = fact_source.with_ids(fact_source.read_facts(spark.createDataFrame(rows, schema)))
    found = {(r["kind"], r["id"]) for r in rules.fact_rules(facts, ["f"]).collect()}
    assert found == {
        ("subject repeated", "f:a"), ("phrase lacks the subject", "f:b"),
        ("also_correct repeats the answer", "f:b"), ("also_correct is no answer of the family", "f:b"),
        ("unknown family", "g:"), ("empty subject slug", "g:"), ("empty answer slug", "f:d"),
    }


@pytest.mark.parametrize("dealt", ["block_id", "block_id, cell", "question_id"])
def test_appended_cells_get_the_full_check(spark, tmp_path, dealt):
    """Cells come in three parts that cut blocks and identities apart; faults also vanish again."""
    from collections import Counter

    from crossblock.plans import inputs

    cells = cut(inputs.unchecked_cells(spark, "/root/testdata/sf0.001"))
    # Two rows without a block.
    blank = cells.limit(2).withColumn("block_id", F.lit(None).cast("string"))
    cells = cut(cells.unionByName(blank))
    path, kept = str(tmp_path / "grown"), []
    for part in range(3):
        held = cells.where(f"pmod(xxhash64({dealt}), 3) = {part}")
        kept.append(held)
        got = Counter(map(tuple, rules.append_checked(held, path).collect()))
        so_far = cut(functools.reduce(lambda a, b: a.unionByName(b), kept))
        assert got == Counter(map(tuple, rules.validate(so_far).collect()))
    assert sum(got.values()) > 0


def test_appending_nothing(spark, cells, tmp_path):
    path = str(tmp_path / "none")
    assert [r["kind"] for r in rules.append_checked(cells.limit(0), path).collect()] == ["empty"]
    assert rules.append_checked(cells, path).count() == 0
    assert rules.append_checked(cells.limit(0), path).count() == 0
