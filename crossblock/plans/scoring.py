"""Facts to scores: what a model answers itself, and how sure it is of the known answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossblock.functions.names import PositionNames
from crossblock.functions.positions import count_tokens
from crossblock.functions.prompts import PromptText, render_prompts
from crossblock.functions.text import fill_template, first_line
from crossblock.operators.blocks import pick_templates
from crossblock.operators.score import Scorer, score_flags, score_once, spread_rows
from crossblock.plans.measure import resolved_cells
from crossblock.session import cut
from crossblock.sources.facts import read_facts, with_ids


def ask_facts(facts: DataFrame, templates: DataFrame, *, ordinal: int = 0) -> DataFrame:
    """Every fact with the question that its family's template of this rank asks."""
    named = with_ids(read_facts(facts))
    asked = pick_templates(named, templates.where(F.col("ordinal") == ordinal), F.lit(0))
    return asked.withColumn("question", fill_template("template.text", "subject_phrase")).drop("template")


def score_facts(
    facts: DataFrame,
    templates: DataFrame,
    answerer: Callable[[], Scorer],
    scorer: Callable[[], Scorer],
    *,
    ordinal: int = 0,
    margin: str = "confidence_margin",
    likelihood: str = "logprobs",
    tokenizer: Callable | None = None,
    text: PromptText = PromptText(),
    names: PositionNames = PositionNames(),
    batch_size: int = 32,
) -> DataFrame:
    """One row per fact with its own answer, the margin and likelihood of the known one, and flags.

    `answerer` reads `prompt`, the text up to where an answer begins, and returns `generated`, of
    which the first line counts. `scorer` reads the prompt with the known answer, its tokens and
    positions, and returns the margin and the log-probabilities of the answer's tokens. Each
    distinct prompt is scored once, whatever the number of its facts.
    """
    asked = ask_facts(facts, templates, ordinal=ordinal)
    rendered = render_prompts(asked, text=text).withColumnRenamed("prompt", "_whole")
    head = F.substring(F.col("_whole"), F.lit(1), F.col("anchors.answer_boundary"))
    opened = rendered.withColumn("prompt", head).withColumns(
        {"_address": F.sha2("prompt", 256), "n_tokens": count_tokens("prompt", tokenizer)}
    )
    answered = score_once(
        cut(opened), answerer, "generated string", address="_address", carry=["prompt"], batch_size=batch_size
    )
    columns = ["fact_id", "relation_family", "subject", "question", "answer"]
    kept = answered.select(*columns, "prompt_sha256", first_line("generated").alias("greedy_answer"))
    # Few bytes and much work: by bytes alone one task would make the tokens of many facts.
    spread = spread_rows(kept, ["fact_id", "prompt_sha256"])
    resolved = resolved_cells(spread, tokenizer=tokenizer, text=text, names=names)
    read = ["prompt", "input_ids", "answer_start", "answer_end", *[f"pos_{n}" for n in names.ordered()]]
    measured = score_once(
        cut(resolved.select(*kept.columns, *read, "n_tokens")), scorer,
        f"{margin} double, {likelihood} array<double>", address="prompt_sha256", carry=read, batch_size=batch_size,
    )
    total = F.aggregate(likelihood, F.lit(0.0), lambda s, x: s + x)
    return score_flags(
        measured.select(
            *columns[:4],
            F.col("answer").alias("gold"),
            "greedy_answer",
            F.col(margin).alias("gold_margin"),
            F.try_divide(-total, F.size(likelihood)).alias("gold_nll_per_token"),
            F.size(likelihood).alias("gold_n_tokens"),
        )
    )
