"""Batch scoring by a model the caller supplies, and the score tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossblock.functions.text import first_line, normalize_entity
from crossblock.functions.values import finite, insist
from crossblock.operators.lookup import sized_lookup
from crossblock.operators.ranking import batch_numbers, exact_quantiles, row_index
from crossblock.session import cut

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

# Fixed value: a gold margin below this in size counts as unsaturated.
UNSATURATED = 10


def select_rows(
    cells: DataFrame,
    *,
    splits: Sequence[str] = (),
    families: Sequence[str] = (),
    n_blocks: int | None = None,
) -> DataFrame:
    """Rows of the wanted splits and families; on request only the first n blocks, whole.

    Fewer matching blocks than asked for is an error.
    """
    held = cells
    if splits:
        held = held.where(F.col("split").isin(list(splits)))
    if families:
        held = held.where(F.col("relation_family").isin(list(families)))
    if n_blocks is None:
        return held
    # Ranked over all tasks: n is the caller's and may be large.
    first = row_index(held.select("block_id").distinct(), ["block_id"], "_at").where(F.col("_at") < n_blocks)
    found = first.count()
    if found < n_blocks:
        raise ValueError(f"{n_blocks} blocks are wanted, {found} match")
    return held.join(first.select("block_id"), "block_id", "left_semi")


#: Rows that one task scores, about.
TASK_ROWS = 20_000
#: Columns that in_batches adds: the batch number.
BATCH = "_batch"


def _tasks(df: DataFrame, rows: int) -> int:
    """As many tasks as the rows ask for, every core at least: few bytes may be much model time."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def spread_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hash rows over as many tasks as their number asks for.

    Rows that are few bytes and much model time would otherwise be merged into few tasks.
    """
    rows = cut(df)
    return rows.repartition(_tasks(df, rows.count()), *key)


def in_batches(
    df: DataFrame, lengths: DataFrame, *, key: Sequence[str], length: str, batch_size: int
) -> DataFrame:
    """Rows laid out by (length, batch number): a batch lies in one task, a task holds many.

    Rows of one length are numbered over all tasks in the order of a hash of the key, so that
    a length has at most one batch that is not full, and batches do not depend on
    partitioning. `lengths` holds the key, which must be present and unique, and the length of
    every row of `df`; only those are ranked.
    """
    if batch_size < 1:
        raise ValueError(f"batch_size must be >= 1, got {batch_size}")
    size = [] if length in key else [F.max(length).alias(length)]
    unique = lengths.groupBy(*key).agg(*size, F.count("*").alias("_n"))
    unique = insist(unique, F.col("_n") == 1, "a key to score repeats")
    for k in key:
        unique = insist(unique, F.col(k).isNotNull(), f"a row to score has no {k}")
    numbered = batch_numbers(cut(unique.drop("_n")), length=length, key=key, batch_size=batch_size)
    numbered = cut(numbered.withColumnRenamed("batch", BATCH))
    other = [c for c in df.columns if c != length or c in key]
    # Rows that repeat their columns are small as files and large in memory: never broadcast them.
    placed = df.select(*other).join(numbered.hint("merge"), list(key))
    return placed.repartition(_tasks(df, numbered.count()), length, BATCH)


def score(
    df: DataFrame,
    factory: Callable[[], Scorer],
    schema: str,
    *,
    key: Sequence[str],
    keep: Sequence[str] | None = None,
    length: str = "n_tokens",
    batch_size: int = 32,
    spread: bool = True,
) -> DataFrame:
    """Score rows in batches of one token length and add the scorer's columns to them.

    `factory` builds the scorer once per worker partition. The scorer gets a pandas frame
    of at most batch_size rows of equal length and returns the columns of `schema` for them
    in order. `keep` lists the columns of the result besides those (default: the key).

    Rows are first written and laid out by `in_batches`. Pass spread=False for a frame that
    already is, or for one whose rows are too heavy to move: without batch numbers each task
    makes its own batches, and one of each length in a task may not be full.
    """
    if batch_size < 1:
        raise ValueError(f"batch_size must be >= 1, got {batch_size}")
    kept = list(keep if keep is not None else key)
    scored = T.StructType.fromDDL(schema)
    out = T.StructType([df.schema[k] for k in kept] + list(scored.fields))
    names = [f.name for f in scored.fields]
    rows = df
    if spread:
        held = cut(df)
        rows = in_batches(held, held.select(*{*key, length}), key=key, length=length, batch_size=batch_size)
    groups = [length, BATCH] if BATCH in rows.columns else [length]
    ordered = rows.sortWithinPartitions(*groups, *key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer: Scorer | None = None
        waiting: pd.DataFrame | None = None

        def scored_part(part: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
            """The rows up to the last end, scored in batches that stop at the ends."""
            nonlocal scorer
            if scorer is None:
                scorer = factory()
            read = part.drop(columns=BATCH, errors="ignore")
            found: dict[str, list[np.ndarray]] = {name: [] for name in names}
            for start, end in zip([0, *ends], ends):  # noqa: B905
                result = scorer(read.iloc[start:end].reset_index(drop=True))
                if len(result) != end - start:
                    raise ValueError(f"scorer returned {len(result)} rows for {end - start}")
                for name in names:
                    found[name].append(result[name].to_numpy())
            done = part[kept].iloc[: ends[-1]].reset_index(drop=True)
            for name, pieces in found.items():
                same = len({p.dtype for p in pieces}) == 1
                done[name] = np.concatenate(pieces if same else [p.astype(object) for p in pieces])
            return done

        # Rows arrive sorted by group, so of a frame only the last batch can continue in the next.
        # All others are scored together: one frame in, one frame out.
        for pdf in batches:
            if pdf.empty:
                continue
            rows = pdf if waiting is None else pd.concat([waiting, pdf], ignore_index=True)
            changed = np.zeros(len(rows), dtype=bool)
            for g in groups:
                code = pd.factorize(rows[g], use_na_sentinel=False)[0]
                changed[1:] |= code[1:] != code[:-1]
            edges = [*np.flatnonzero(changed).tolist(), len(rows)]
            ends = [e for lo, hi in zip([0, *edges], edges) for e in (*range(lo + batch_size, hi, batch_size), hi)]  # noqa: B905
            last = ends[-2] if len(ends) > 1 else 0
            if len(rows) - last < batch_size:
                ends.pop()
            waiting = rows.iloc[ends[-1] if ends else 0 :]
            if ends:
                yield scored_part(rows, ends)
        if waiting is not None and len(waiting):
            yield scored_part(waiting, [len(waiting)])

    return ordered.mapInPandas(run, out)


def score_once(
    df: DataFrame,
    factory: Callable[[], Scorer],
    schema: str,
    *,
    address: str,
    carry: Sequence[str],
    length: str = "n_tokens",
    batch_size: int = 32,
) -> DataFrame:
    """Score every distinct content once and give all its rows the result.

    `address` names the content address (a hash of what the scorer reads), `carry` the columns
    that the scorer needs, equal in all rows of an address. Rows without an address get
    missing scores.
    """
    content = df.where(F.col(address).isNotNull()).groupBy(address).agg(
        *[F.any_value(c).alias(c) for c in {*carry, length}], F.count("*").alias("_copies")
    )
    scored = cut(
        score(content, factory, schema, key=[address], keep=[address, "_copies"], length=length, batch_size=batch_size)
    )
    return sized_lookup(df, scored, [address], "_copies").drop("_copies")


def score_flags(df: DataFrame, greedy: str = "greedy_answer", gold: str = "gold") -> DataFrame:
    """Exact match, match as an entity, error (another entity), alias (other surface form)."""
    return df.withColumns(
        {
            "greedy_exact": F.col(greedy) == F.col(gold),
            "greedy_entity": normalize_entity(greedy) == normalize_entity(gold),
        }
    ).withColumns(
        {
            "is_model_error": ~F.col("greedy_entity"),
            "is_alias": F.col("greedy_entity") & ~F.col("greedy_exact"),
        }
    )


def score_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, on-policy rates, median gold margin and unsaturated share, whole or by group."""
    keys = list(by)
    margin = finite("gold_margin")
    # A missing margin is not below the bound.
    small = F.coalesce(F.abs(margin) < UNSATURATED, F.lit(False))
    plain = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_facts"),
        F.avg(F.col("greedy_exact").cast("double")).alias("on_policy_exact"),
        F.avg(F.col("greedy_entity").cast("double")).alias("on_policy_entity"),
        F.count_if(~F.col("greedy_entity")).alias("model_errors"),
        F.avg(small.cast("double")).alias("unsaturated_fraction"),
    )
    median = exact_quantiles(scores, "gold_margin", {"median_gold_margin": 0.5}, group=keys)
    if keys:
        return plain.join(median, keys, "left")
    return plain.withColumn("median_gold_margin", median.scalar())


__all__ = [
    "Scorer",
    "first_line",
    "in_batches",
    "score",
    "score_flags",
    "score_once",
    "score_summary",
    "select_rows",
    "spread_rows",
]
