"""Margins and likelihood statistics from logits and log-probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.functions.values import as_column, insist


def class_tokens(labels: DataFrame) -> DataFrame:
    """Check the two confidence classes (label, tokens) and return one row (high, low).

    Each label must be exactly one token and the two must differ.
    """
    single = F.size("tokens") == 1
    one = insist(labels, single, F.concat(F.col("label"), F.lit(" is not a single token")))
    wide = one.agg(
        *[F.max(F.when(F.col("label") == c, F.get("tokens", F.lit(0)))).alias(c)
          for c in ("high", "low")]
    )
    return insist(wide, F.col("high") != F.col("low"), "both classes map to the same token")


def class_margin(logits: str | Column, high: int, low: int) -> Column:
    """Logit of the high class minus logit of the low class (0-based token ids)."""
    x = as_column(logits)
    return F.get(x, F.lit(high)).cast("double") - F.get(x, F.lit(low)).cast("double")


def log_sum_exp(logits: str | Column) -> Column:
    """Shifted by the maximum, which travels in the accumulator so that it is found once."""
    x = as_column(logits)
    start = F.struct(F.array_max(x).cast("double").alias("top"), F.lit(0.0).alias("total"))
    return F.aggregate(
        x,
        start,
        lambda a, v: F.struct(
            a["top"].alias("top"), (a["total"] + F.exp(v.cast("double") - a["top"])).alias("total")
        ),
        lambda a: a["top"] + F.log(a["total"]),
    )


def target_logprob(logits: str | Column, target: str | Column) -> Column:
    """Log-softmax of a logit vector at a 0-based target."""
    x = as_column(logits)
    return F.get(x, as_column(target)).cast("double") - log_sum_exp(x)


def answer_logprobs(predicted: DataFrame, tokens: DataFrame, key: Sequence[str]) -> DataFrame:
    """Log-probability of each answer token.

    `predicted` holds (key, index, logits): what the model predicts after token `index`.
    `tokens` holds (key, index, token_id, in_answer). The prediction at i - 1 scores token i.
    """
    shifted = predicted.withColumn("index", F.col("index") + 1)
    answers = tokens.where("in_answer").select(*key, "index", "token_id")
    return answers.join(shifted, [*key, "index"], "left").select(
        *key, "index", target_logprob("logits", "token_id").alias("logprob")
    )


def likelihood_stats(logprobs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ten statistics per answer from (key, index, logprob), with fixed-size buffers."""
    lp = F.col("logprob")
    return logprobs.groupBy(*key).agg(
        F.avg(lp).alias("lp_mean"),
        F.min(lp).alias("lp_min"),
        F.max(lp).alias("lp_max"),
        F.var_pop(lp).alias("lp_var"),
        F.min_by(lp, "index").alias("lp_first"),
        F.max_by(lp, "index").alias("lp_last"),
        F.sum(lp).alias("lp_sum"),
        (-F.sum(lp)).alias("nll"),
        (-F.avg(lp)).alias("nll_per_token"),
        F.count(F.lit(1)).alias("n_answer_tokens"),
    )


def with_array_stats(df: DataFrame, sequence: str | Column) -> DataFrame:
    """Add the same ten statistics of an array column, without a shuffle.

    One pass over the array: sums of the deviations from its first element.
    """
    x = as_column(sequence)
    first = F.get(x, F.lit(0)).cast("double")
    moments = F.aggregate(
        x,
        F.struct(first.alias("first"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, v: F.struct(
            a["first"].alias("first"),
            (a["s"] + (v.cast("double") - a["first"])).alias("s"),
            (
                a["q"]
                + (v.cast("double") - a["first"]) * (v.cast("double") - a["first"])
            ).alias("q"),
        ),
    )
    staged = df.withColumns({"_x": x}).withColumns({"_a": moments, "_n": F.size("_x")})
    n, shift = F.col("_n"), F.try_divide(F.col("_a.s"), F.col("_n"))
    total = F.col("_a.s") + n * F.col("_a.first")
    mean = F.col("_a.first") + shift
    spread = F.greatest(F.try_divide(F.col("_a.q"), n) - shift * shift, F.lit(0.0))
    return staged.withColumns(
        {
            "lp_mean": mean,
            "lp_min": F.array_min("_x").cast("double"),
            "lp_max": F.array_max("_x").cast("double"),
            "lp_var": F.when(n > 1, spread).otherwise(F.lit(0.0)),
            "lp_first": F.col("_a.first"),
            "lp_last": F.get("_x", n - 1).cast("double"),
            "lp_sum": total,
            "nll": -total,
            "nll_per_token": -mean,
            "n_answer_tokens": n,
        }
    ).drop("_x", "_a", "_n")
