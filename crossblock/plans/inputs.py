"""Operator inputs derived from the driver tables, whole tables at every scale."""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossblock.functions.keyed import uniform
from crossblock.functions.names import SOURCE_KINDS, PositionNames
from crossblock.functions.text import fill_template, slugify
from crossblock.functions.values import with_readouts
from crossblock.operators.patch import partner_pairs
from crossblock.operators.splits import Ratios
from crossblock.plans.build import BuildConfig
from crossblock.sources.contract import CELL_COLUMNS
from crossblock.sources.facts import read_facts, with_ids

POSITIONS = PositionNames().ordered()
CONFIG = BuildConfig(holdout=("FURNITURE",), pairings_per_fact=2, templates_per_family=3, seed=7)
#: Conditions of the scored table and how many routes each cuts.
CONDITIONS = {
    "clean": 0, "cut one": 1, "cut two": 2, "only via NL": 1,
    "cut three": 3, "cut four": 4, "only direct": 2, "cut everything": 1,
}
TEMPLATE_TEXTS = ["Where is {s} based?", "Which nation is home to {s}?", "Name the nation of {s}."]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Natural 2x2 of the line items of a supplier: returned or not, by open or filled.


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey")).alias("block_id"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("q_index"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("a_index"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 370).alias("v"),
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
        F.floor(F.round(F.col("l_tax") * 100) * 5 / 9).cast("int").alias("tier"),
    )


def _cell() -> Column:
    return F.concat(F.lit("q"), F.col("q_index"), F.lit("a"), F.col("a_index"))


def behavior(spark: SparkSession, sf: str) -> DataFrame:
    return (
        lines(spark, sf)
        .groupBy("block_id", "q_index", "a_index")
        .agg(
            F.avg("v").alias("confidence_margin"),
            (F.sum("l_quantity") > 25.5 * F.count("*")).alias("correct"),
            F.length(F.min("l_orderkey").cast("string")).alias("n_answer_tokens"),
        )
        .withColumns({"cell": _cell(), "matched": F.col("q_index") == F.col("a_index")})
    )


def _measured(spark: SparkSession, sf: str, **axes: Column) -> DataFrame:
    """Margin of a cell within the line items of one setting."""
    staged = lines(spark, sf).withColumns(axes)
    return staged.groupBy("block_id", _cell().alias("target_cell"), *axes).agg(
        F.avg("v").alias("patched")
    )


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Patch rows: partner pairs at every (position, layer) that was measured."""
    position = F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.col("tier") + 1)
    measured = _measured(spark, sf, position=position, layer=F.col("l_linenumber") - 1)
    pairs = partner_pairs(behavior(spark, sf))
    return with_readouts(pairs.join(measured, ["block_id", "target_cell"]))


def controls(spark: SparkSession, sf: str) -> DataFrame:
    position = F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.col("tier") + 1)
    kind = F.element_at(
        F.array(*[F.lit(k) for k in SOURCE_KINDS]),
        F.least(F.col("l_linenumber"), F.lit(len(SOURCE_KINDS))),
    )
    measured = _measured(spark, sf, position=position, source_kind=kind)
    pairs = partner_pairs(behavior(spark, sf))
    return with_readouts(pairs.join(measured, ["block_id", "target_cell"]))


def scored_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Margins per (condition, cell): all line items for clean, one line number for the others."""
    routes = F.array(
        *[
            F.struct(F.lit(n).alias("condition"), F.lit(cut).alias("edges_cut"))
            for n, cut in CONDITIONS.items()
        ]
    )
    at = F.least(F.col("l_linenumber"), F.lit(len(CONDITIONS) - 1)) + 1
    both = F.array(F.element_at(routes, 1), F.element_at(routes, at))
    staged = lines(spark, sf).withColumn("_r", F.explode(both))
    cells = behavior(spark, sf).select("block_id", "cell", "matched", "n_answer_tokens")
    margins = staged.groupBy(
        "block_id", _cell().alias("cell"), F.col("_r.condition").alias("condition"),
        F.col("_r.edges_cut").alias("edges_cut"),
    ).agg(F.avg("v").alias("confidence_margin"))
    return margins.join(cells, ["block_id", "cell"])


# Facts: customers of a market segment and their nation.


def raw_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the name of their nation and of the nation after it."""
    nation = table(spark, sf, "nation")
    after = nation.select(
        F.col("n_nationkey").alias("_after"), F.col("n_name").alias("next_nation")
    )
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("_after", (F.col("c_nationkey") + 1) % 25)
        .join(after, "_after")
        .drop("_after")
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """An indebted customer also accepts the next nation as an answer."""
    other = F.when(F.col("c_acctbal") < 0, F.array(slugify("next_nation"))).otherwise(F.array())
    return read_facts(
        raw_facts(spark, sf).select(
            F.col("c_mktsegment").alias("relation_family"),
            F.col("c_name").alias("subject"),
            F.concat(F.lit("the firm "), F.col("c_name")).alias("subject_phrase"),
            F.col("n_name").alias("answer"),
            other.alias("also_correct"),
        )
    )


def templates(spark: SparkSession, sf: str) -> DataFrame:
    """Three question texts for every market segment in the data."""
    family = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("f")).distinct()
    texts = F.array(*[F.lit(t) for t in TEMPLATE_TEXTS])
    return family.select(
        F.col("f").alias("relation_family"), F.posexplode(texts).alias("ordinal", "text")
    ).withColumn(
        "template_id", F.concat("relation_family", F.lit("/t"), (F.col("ordinal") + 1).cast("string"))
    )


def unchecked_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A cell table put together without any care, as input of the validation rules.

    Neighbouring customer keys form blocks of one or two facts, whatever their families.
    """
    base = raw_facts(spark, sf)
    named = with_ids(facts(spark, sf)).select("subject", "fact_id", "question_id", "answer_id",
                                              "correct_ids")
    keyed = base.join(named.withColumnRenamed("subject", "c_name"), "c_name").withColumns(
        {
            "_j": F.floor(F.col("c_custkey") * 2 / 3),
            "_seat": F.when(F.col("c_custkey") % 3 == 1, 2).otherwise(1),
        }
    )
    held = F.struct("c_name", "n_name", "c_acctbal", "n_regionkey", "c_mktsegment", "question_id",
                    "answer_id", "correct_ids")
    blocks = keyed.groupBy("_j").agg(
        F.max(F.when(F.col("_seat") == 1, held)).alias("x"),
        F.max(F.when(F.col("_seat") == 2, held)).alias("y"),
    )
    sides = F.array(
        *[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q in (1, 2) for a in (1, 2)]
    )
    rows = blocks.withColumn("_f", F.explode(sides)).withColumns(
        {
            "_q": F.when(F.col("_f.q") == 1, F.col("x")).otherwise(F.col("y")),
            "_a": F.when(F.col("_f.a") == 1, F.col("x")).otherwise(F.col("y")),
        }
    )
    rows = rows.where(F.col("_q").isNotNull() & F.col("_a").isNotNull())
    matched = F.col("_f.q") == F.col("_f.a")
    text = F.when(F.col("_q.c_acctbal") < -900, F.lit(TEMPLATE_TEXTS[0])).otherwise(
        fill_template(F.lit(TEMPLATE_TEXTS[0]), "_q.c_name")
    )
    answer = F.when(F.col("_a.c_acctbal") > 9500, F.lower("_a.n_name")).otherwise(
        F.col("_a.n_name")
    )
    draw = uniform(11, "_q.question_id")
    split = F.when(draw < 0.02, "family_holdout").otherwise(Ratios().band(draw))
    out = rows.select(
        F.concat(F.lit("pair-"), F.col("_j")).alias("block_id"),
        F.col("_q.c_mktsegment").alias("relation_family"),
        (F.col("_q.n_regionkey") + 1).cast("tinyint").alias("dataset_tier"),
        F.concat(F.lit("q"), F.col("_f.q"), F.lit("a"), F.col("_f.a")).alias("cell"),
        F.col("_f.q").cast("tinyint").alias("q_index"),
        F.col("_f.a").cast("tinyint").alias("a_index"),
        F.col("_q.question_id").alias("question_id"),
        F.col("_a.answer_id").alias("answer_id"),
        F.col("_q.c_name").alias("subject"),
        text.alias("question"),
        answer.alias("answer"),
        F.when(F.col("_a.c_acctbal") < -950, ~matched).otherwise(matched).alias("matched"),
        F.array_contains("_q.correct_ids", F.col("_a.answer_id")).alias("correct"),
        F.when(matched, "gold")
        .when(F.col("_q.c_acctbal") < 0, "swap")
        .otherwise("distractor")
        .alias("answer_source"),
        F.when(matched, "natural").otherwise("off_policy").alias("policy_status"),
        F.concat("_q.c_mktsegment", F.lit("/t1")).alias("template_id"),
        split.alias("split"),
    )
    return out.select(*CELL_COLUMNS)


# Question and answer turns, scores, logits and vectors.


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    said = table(spark, sf, "conversations")
    asked = said.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answered = said.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"])


def labelled_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("score"), "quality"
    )


def fact_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy answers per fact: the nation in one of three spellings, or the next nation."""
    balance = F.col("c_acctbal")
    greedy = (
        F.when(balance < 0, F.col("next_nation"))
        .when(balance > 8000, F.lower("n_name"))
        .otherwise(F.col("n_name"))
    )
    return raw_facts(spark, sf).select(
        F.col("c_mktsegment").alias("relation_family"),
        F.col("c_name").alias("subject"),
        F.col("n_name").alias("gold"),
        greedy.alias("greedy_answer"),
        (balance / 370).alias("gold_margin"),
    )


def guess_answerer(nations: list[str]):
    """A stand-in model that answers with some nation, small or in capitals, and goes on talking."""

    def factory():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            drawn = [int(hashlib.sha256(p.encode()).hexdigest()[:7], 16) for p in batch["prompt"]]
            said = [nations[d % len(nations)] for d in drawn]
            said = [s.lower() if d % 3 == 0 else s for s, d in zip(said, drawn, strict=True)]
            return pd.DataFrame({"generated": [f" {s} \nas everybody knows" for s in said]})

        return run

    return factory


def id_gold_scorer():
    """A stand-in model: the margin is the mean token id, log-probabilities the answer's scaled ids."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        ids = np.stack(batch["input_ids"].to_numpy()).astype(np.float64)
        spans = zip(ids, batch["answer_start"], batch["answer_end"], strict=True)
        return pd.DataFrame(
            {
                "confidence_margin": (ids.sum(axis=1) / ids.shape[1] / 2**27 - 1.0) * 50,
                "logprobs": [-row[start:end] / 2**28 for row, start, end in spans],
            }
        )

    return run


WIDTH = 8


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors (row, layer, position, vec): every embedding cut into slices.

    Four rows make a block; a slice is a layer.
    """
    slices = F.transform(
        F.sequence(F.lit(0), (F.size("embedding") / WIDTH).cast("int") - 1),
        lambda i: F.slice("embedding", i * WIDTH + 1, WIDTH),
    )
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row"), F.lit("NL").alias("position"),
        F.posexplode(slices).alias("layer", "vec"),
    )


def vector_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells that the vector rows belong to, with their partner rows."""
    seat = F.col("vec_id") % 4
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("block-"), F.floor(F.col("vec_id") / 4)).alias("block_id"),
        F.col("vec_id").alias("row"),
        (F.floor(seat / 2) + 1).cast("int").alias("q_index"),
        (seat % 2 + 1).cast("int").alias("a_index"),
    ).withColumns(
        {
            "cell": _cell(),
            "matched": F.col("q_index") == F.col("a_index"),
            "confidence_margin": F.col("row").cast("double"),
        }
    )


#: Positions of the control sweep, and by how much each shifts the slices of an embedding.
PLACES = {"NL": 0, "NL1": 1, "AC": 2}
SHARES = {"NL": 0.875, "NL1": 0.25, "AC": 0.125}
START = 3


def position_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors at three positions: position k has slice l + k at layer l."""
    slices = vectors(spark, sf)
    n = slices.agg(F.max("layer") + 1).scalar()
    shifts = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for p, k in PLACES.items()])
    return slices.select("row", F.explode(shifts).alias("s"), "layer", "vec").select(
        "row", F.col("s.p").alias("position"), F.pmod(F.col("layer") - F.col("s.k"), n).cast("int").alias("layer"), "vec"
    )


def probed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of whole blocks of vector rows, whose margin is the sum of an embedding."""
    held = vector_cells(spark, sf).drop("confidence_margin")
    probe = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    sums = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), probe.alias("confidence_margin"))
    whole = held.groupBy("block_id").agg(F.count("*").alias("n")).where("n = 4")
    return held.join(sums, "row").join(whole, "block_id", "left_semi")


def probe_scorer():
    """A stand-in model that reads vectors: the margin moves towards the sum of the replaced ones."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        vecs = [s["vec"] for held in batch["sources"] for s in held]
        if len(set(map(len, vecs))) == 1:
            sums = np.concatenate(vecs).reshape(len(vecs), -1).sum(axis=1, dtype=np.float64).tolist()
        else:
            sums = [float(np.sum(v, dtype=np.float64)) for v in vecs]
        each = iter(sums)
        read = [sum(islice(each, len(held))) for held in batch["sources"]]
        share = batch["position"].map(SHARES)
        return pd.DataFrame({"patched": batch["target_clean"] * (1.0 - share) + np.array(read) * share})

    return run


#: Pieces of at most four characters, as another tokenizer might cut them.
SHORT_PIECES = r" ?[A-Za-z0-9]{1,4}|[^A-Za-z0-9]"


def short_tokenizer():
    """A stand-in for another tokenizer: short pieces, the id from their hash."""
    pattern = re.compile(SHORT_PIECES)

    def run(text: str) -> list[tuple[int, int, int]]:
        found = [(m[0], m.start(), m.end()) for m in pattern.finditer(text)]
        return [(int(hashlib.md5(p.encode()).hexdigest()[:7], 16), i, j) for p, i, j in found]

    return run


#: How much of the partner's margin a position carries over, for the stand-in sweep.
CARRIED = {"AC": 0.02, "LAT": 0.3, "NL": 0.9, "NL1": 0.05, "CC": 1.0}


def blend_scorer():
    """A stand-in model: the partner's margin shows through at some positions, less in late layers."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        share = batch["position"].map(CARRIED) * (1.0 - batch["layer"] / 10.0)
        return pd.DataFrame(
            {"patched": batch["target_clean"] + (batch["source_clean"] - batch["target_clean"]) * share}
        )

    return run


def id_logprob_scorer():
    """A stand-in model: every token's log-probability is its scaled id, negated."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        ids = batch["input_ids"].map(lambda x: -np.asarray(x, dtype=np.float64) / 2**28)
        return pd.DataFrame({"logprobs": ids})

    return run


def id_mean_scorer():
    """A stand-in model: the margin is the mean token id, centred and scaled."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        ids = np.stack(batch["input_ids"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"confidence_margin": ids.sum(axis=1) / ids.shape[1] / 2**27 - 1.0})

    return run
