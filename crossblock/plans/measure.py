"""Cells to measured behaviour and patched margins, and saved measurements to summaries and gates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossblock.functions.likelihood import with_array_stats
from crossblock.functions.names import SOURCE_KINDS, PositionNames
from crossblock.functions.positions import count_tokens, encode, resolve_positions
from crossblock.functions.prompts import PromptText, render_prompts
from crossblock.functions.values import with_readouts
from crossblock.operators.contrast import confidence_signal
from crossblock.operators.donors import control_sources
from crossblock.operators.gates import control_gates, route_gates, signal_gates
from crossblock.operators.patch import (
    condition_table,
    partner_pairs,
    summarize_controls,
    summarize_isolated,
    summarize_patching,
    sweep_grid,
)
from crossblock.operators.score import BATCH, Scorer, in_batches, score, spread_rows
from crossblock.session import cut
from crossblock.sources.contract import write_result

KEY = ["block_id", "cell"]


def resolved_cells(
    cells: DataFrame,
    *,
    tokenizer: Callable | None = None,
    text: PromptText = PromptText(),
    prefix: str | None = None,
    names: PositionNames = PositionNames(),
    strict: bool = True,
) -> DataFrame:
    """Prompt, tokens and positions of every cell; an unresolved one fails when `strict`."""
    rendered = render_prompts(cells, prefix=prefix, text=text)
    tokens = rendered.withColumn("tokens", encode("prompt", tokenizer))
    resolved = resolve_positions(tokens, names=names)
    if not strict:
        return resolved
    # Checked in the column that every consumer needs, not by a filter: a filter would be
    # pushed below the token scan and repeat it.
    error = F.raise_error(F.concat(F.lit("unresolved position: "), F.col("position_error")))
    return resolved.withColumn(
        "n_tokens",
        F.when(F.col("position_error").isNull(), F.col("n_tokens")).otherwise(error.cast("int")),
    )


def counted_cells(
    cells: DataFrame,
    *,
    tokenizer: Callable | None = None,
    text: PromptText = PromptText(),
    prefix: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Key and number of tokens of every cell. Positions are left to `resolved_cells`, `strict` too."""
    rendered = render_prompts(cells, prefix=prefix, text=text)
    return rendered.select(*KEY, count_tokens("prompt", tokenizer).alias("n_tokens"))


def measure(
    cells: DataFrame,
    factory: Callable[[], Scorer],
    *,
    schema: str = "confidence_margin double",
    batch_size: int = 32,
    names: PositionNames = PositionNames(),
    likelihood: str | None = None,
    **options,
) -> DataFrame:
    """Behaviour rows: cells, positions, prompt checksum and what the scorer returned.

    Cells are shuffled while they are still small. Their token counts come first, from a pass
    that keeps nothing else; prompts and tokens are made again where the batches are scored, and
    are dropped before anything leaves the worker. `likelihood` names a column of the scorer,
    log-probabilities as an array, that is replaced by its ten statistics.
    """
    cells = cut(cells)
    lengths = counted_cells(spread_rows(cells, KEY), **options)
    placed = in_batches(cells, lengths, key=KEY, length="n_tokens", batch_size=batch_size)
    resolved = resolved_cells(placed.drop("n_tokens"), names=names, **options)
    positions = [f"{p}_{n}" for n in names.ordered() for p in ("pos", "tok")]
    keep = [*cells.columns, "n_tokens", "n_answer_tokens", "prompt_sha256", *positions]
    inputs = resolved.select(*keep, "input_ids", "answer_start", "answer_end", BATCH)
    scored = score(
        inputs, factory, schema, key=KEY, keep=keep, batch_size=batch_size, spread=False
    )
    return with_array_stats(scored, likelihood).drop(likelihood) if likelihood else scored


def sweep(
    behavior: DataFrame,
    factory: Callable[[], Scorer],
    *,
    positions: Sequence[str],
    layers: Sequence[int],
    margin: str = "confidence_margin",
    batch_size: int = 32,
) -> DataFrame:
    """Every partner pair scored at every position and layer, with moved, gap and flipped.

    The scorer gets rows of pairs with position and layer and returns `patched`.
    """
    pairs = partner_pairs(behavior, margin)
    grid = sweep_grid(pairs, position=positions, layer=layers)
    # All rows of a layer have one length, so a batch holds one layer.
    scored = score(
        grid, factory, "patched double", key=["block_id", "target_cell", "position", "layer"],
        keep=grid.columns, length="layer", batch_size=batch_size,
    )
    return with_readouts(scored)


def control_sweep(
    behavior: DataFrame,
    vectors: DataFrame,
    factory: Callable[[], Scorer],
    *,
    positions: Sequence[str],
    layers: Sequence[int],
    kinds: Sequence[str] = SOURCE_KINDS,
    margin: str = "confidence_margin",
    length: str | None = None,
    seed: int = 0,
    batch_size: int = 32,
) -> DataFrame:
    """Every pair scored with each kind of replacement vectors at each position.

    `behavior` has a `row` that the vectors share, and `vectors` those of all its rows at the
    wanted positions and layers; a missing one fails the job. One row of the scorer holds the
    pair, position, source_kind, and `sources`: structs (layer, vec) from the first to the last
    layer; it returns `patched`. Where `length` names a column of the behaviour, batches have one
    value of it among the targets. Rows carry vectors and are scored where they lie.
    """
    pairs = partner_pairs(behavior, margin)
    size = F.lit(1) if length is None else F.col(length)
    targets = behavior.select("block_id", F.col("cell").alias("target_cell"), size.alias("n_tokens"))
    pairs = cut(pairs.join(targets, ["block_id", "target_cell"]))
    sources = control_sources(
        pairs, behavior, vectors, positions=positions, layers=layers, kinds=kinds, seed=seed
    )
    key = ["block_id", "target_cell", "position", "source_kind"]
    scored = score(
        sources, factory, "patched double", key=key, keep=[c for c in sources.columns if c != "sources"],
        batch_size=batch_size, spread=False,
    )
    return with_readouts(scored.withColumn("start_layer", F.lit(min(layers))))


def signal_report(
    spark: SparkSession,
    path: str,
    *,
    n_boot: int = 10_000,
    seed: int = 0,
    names: PositionNames = PositionNames(),
) -> DataFrame:
    """Re-summarise path/behavior and path/patching, rewrite path/summary, return the gates."""
    behavior = spark.read.parquet(f"{path}/behavior")
    summary = summarize_patching(spark.read.parquet(f"{path}/patching"), n_boot=n_boot, seed=seed)
    write_result(summary, f"{path}/summary")
    signal = confidence_signal(behavior, n_boot=n_boot, seed=seed)
    return signal_gates(signal, spark.read.parquet(f"{path}/summary"), names)


def routes_report(
    spark: SparkSession,
    path: str,
    *,
    n_boot: int = 10_000,
    seed: int = 0,
    names: PositionNames = PositionNames(),
) -> DataFrame:
    """Re-summarise path/conditions and path/isolated, return the route gates."""
    conditions = spark.read.parquet(f"{path}/conditions")
    if "share_of_clean" not in conditions.columns:
        conditions = condition_table(conditions, n_boot=n_boot, seed=seed)
    isolated = summarize_isolated(
        spark.read.parquet(f"{path}/isolated"), n_boot=n_boot, seed=seed
    )
    write_result(isolated, f"{path}/isolated_summary")
    saved = spark.read.parquet(f"{path}/isolated_summary")
    return route_gates(conditions, saved, names=names)


def controls_report(
    spark: SparkSession,
    path: str,
    *,
    n_boot: int = 10_000,
    seed: int = 0,
    names: PositionNames = PositionNames(),
) -> DataFrame:
    """Re-summarise path/controls, return the control gates."""
    summary = summarize_controls(spark.read.parquet(f"{path}/controls"), n_boot=n_boot, seed=seed)
    write_result(summary, f"{path}/controls_summary")
    return control_gates(spark.read.parquet(f"{path}/controls_summary"), names)
