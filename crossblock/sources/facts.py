"""Fact and template tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossblock.functions.text import slugify
from crossblock.functions.values import as_column, insist, insist_once

FACT = T.StructType(
    [
        T.StructField("relation_family", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("subject_phrase", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("also_correct", T.ArrayType(T.StringType())),
    ]
)
IDS = ["subject_slug", "answer_slug", "fact_id", "question_id", "answer_id", "correct_ids"]


def read_facts(df: DataFrame) -> DataFrame:
    """Bring a user table to the fact columns.

    Without subject_phrase the subject is its own phrase; without also_correct there is
    one correct answer.
    """
    defaults = {"subject_phrase": F.col("subject"), "also_correct": F.array().cast("array<string>")}
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    missing = [f.name for f in FACT if f.name not in df.columns]
    if missing:
        raise ValueError(f"the fact table lacks {missing}")
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT])
    # A missing value means the same as a missing column.
    return typed.withColumns({n: F.coalesce(F.col(n), v.cast(FACT[n].dataType)) for n, v in defaults.items()})


def concat_facts(*frames: DataFrame) -> DataFrame:
    out = read_facts(frames[0])
    for frame in frames[1:]:
        out = out.unionByName(read_facts(frame))
    return out


def with_ids(facts: DataFrame) -> DataFrame:
    """Add slugs, fact, question and answer identities, and every correct answer identity."""
    family = F.col("relation_family")
    slugged = facts.withColumns(
        {"subject_slug": slugify("subject"), "answer_slug": slugify("answer")}
    )
    prefix = F.concat(F.lit("a:"), family, F.lit(":"))
    answer = F.concat(prefix, F.col("answer_slug"))
    others = F.transform("also_correct", lambda s: F.concat(prefix, s))
    return slugged.withColumns(
        {
            "fact_id": F.concat(family, F.lit(":"), F.col("subject_slug")),
            "question_id": F.concat(F.lit("q:"), family, F.lit(":"), F.col("subject_slug")),
            "answer_id": answer,
            "correct_ids": F.array_union(F.array(answer), others),
        }
    )


def facts_of_families(facts: DataFrame, families: Sequence[str]) -> DataFrame:
    """Facts of the requested families; a family without a single fact is an error."""
    wanted = sorted(set(families))
    held = facts.where(F.col("relation_family").isin(wanted))
    present = facts.agg(
        *[F.max((F.col("relation_family") == f).cast("int")).alias(f"f{i}")
          for i, f in enumerate(wanted)]
    )
    absent = F.concat_ws(
        ", ",
        *[
            F.when(F.coalesce(F.col(f"f{i}"), F.lit(0)) == 0, F.lit(f))
            for i, f in enumerate(wanted)
        ],
    )
    message = F.concat(F.lit("no facts for the families "), absent)
    return insist_once(held, present, absent == "", message)


def templates_for(templates: DataFrame, families: DataFrame, limit: int | None = None) -> DataFrame:
    """The first `limit` templates (relation_family, ordinal, template_id, text) per family.

    Fails when a requested family has none, or fewer than `limit`.
    """
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be >= 1, got {limit}")
    counts = templates.groupBy("relation_family").agg(F.count("*").alias("n_available"))
    joined = families.select("relation_family").distinct().join(counts, "relation_family", "left")
    enough = insist(
        joined,
        F.coalesce(F.col("n_available"), F.lit(0)) >= F.lit(limit or 1),
        F.concat(F.lit("too few question templates for family "), F.col("relation_family")),
    )
    taken = templates if limit is None else templates.where(F.col("ordinal") < F.lit(limit))
    return taken.join(enough.select("relation_family"), "relation_family")


def can_pair(a: str | Column, b: str | Column) -> Column:
    """Two facts of one family whose answers are wrong for each other's subject."""
    x, y = as_column(a), as_column(b)
    return (
        (x["relation_family"] == y["relation_family"])
        & (x["fact_id"] != y["fact_id"])
        & ~F.array_contains(y["correct_ids"], x["answer_id"])
        & ~F.array_contains(x["correct_ids"], y["answer_id"])
    )
