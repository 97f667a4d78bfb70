"""Facts to a validated, written cell table with its manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossblock.operators.blocks import (
    assign_templates,
    expand_blocks,
    pair_facts,
    require_unique_blocks,
)
from crossblock.operators.splits import Ratios, assign_facts, require_pools
from crossblock.operators.validate import fact_rules, table_counts, validate
from crossblock.session import cut
from crossblock.sources.contract import read_cells, write_cells
from crossblock.sources.facts import facts_of_families, read_facts, templates_for, with_ids
from crossblock.sources.manifest import manifest, write_manifest


@dataclass(frozen=True)
class BuildConfig:
    families: tuple[str, ...] = ()
    holdout: tuple[str, ...] = ()
    ratios: Ratios = field(default_factory=Ratios)
    pairings_per_fact: int = 2
    templates_per_family: int | None = None
    dataset_tier: int = 1
    seed: int = 0
    split_method: str = "exact"


def split_facts(facts: DataFrame, config: BuildConfig) -> DataFrame:
    """Checked facts with ids and their split."""
    known = read_facts(facts)
    if config.families:
        known = facts_of_families(known, config.families)
    ready = cut(with_ids(known))
    broken = fact_rules(ready, list(config.families) or None).orderBy("id", "kind").limit(1)
    first = broken.collect()
    if first:
        raise ValueError(f"the fact table is inconsistent: {first[0]['id']}: {first[0]['kind']}")
    return assign_facts(
        ready,
        holdout=config.holdout,
        ratios=config.ratios,
        seed=config.seed,
        method=config.split_method,
    )


def build_blocks(facts: DataFrame, templates: DataFrame, config: BuildConfig) -> DataFrame:
    assigned = cut(split_facts(facts, config))
    require_pools(assigned)
    pairs = pair_facts(assigned, pairings_per_fact=config.pairings_per_fact, seed=config.seed)
    wanted = templates_for(templates, assigned, config.templates_per_family)
    blocks = cut(
        assign_templates(
            pairs, wanted, templates_per_family=config.templates_per_family, seed=config.seed
        )
    )
    require_unique_blocks(blocks)
    return blocks


def build_cells(facts: DataFrame, templates: DataFrame, config: BuildConfig) -> DataFrame:
    return expand_blocks(build_blocks(facts, templates, config), dataset_tier=config.dataset_tier)


@dataclass(frozen=True)
class BuildResult:
    cells: DataFrame
    violations: DataFrame
    manifest: DataFrame
    ok: bool


def build_dataset(
    facts: DataFrame,
    templates: DataFrame,
    config: BuildConfig,
    path: str,
    *,
    caller: Mapping[str, str] | None = None,
) -> BuildResult:
    """Write path/cells and path/manifest. A failing validation is reported after writing."""
    spark = facts.sparkSession
    write_cells(build_cells(facts, templates, config), f"{path}/cells")
    # Everything below reads the written table, so the facts are processed once.
    cells = read_cells(spark, f"{path}/cells")
    violations = cut(validate(cells))
    counts = _counts(table_counts(cells).where(F.col("scope").isin("table", "split")))
    counts["n_violations"] = violations.count()
    row = manifest(
        spark,
        command="data build",
        config=asdict(config),
        artifacts={"cells": cells},
        payload=counts,
        caller=caller,
    )
    write_manifest(row, f"{path}/manifest")
    return BuildResult(cells, violations, row, counts["n_violations"] == 0)


def _counts(rows: DataFrame) -> dict[str, Any]:
    """At most five rows: one for the table and one per split that we assigned."""
    out: dict[str, Any] = {}
    for r in rows.collect():
        label = "table" if r["scope"] == "table" else f"{r['scope']} {r['value']}"
        out[label] = {"n_rows": r["n_rows"], "n_blocks": r["n_blocks"]}
    return out


__all__: Sequence[str] = ["BuildConfig", "BuildResult", "build_blocks", "build_cells",
                          "build_dataset", "split_facts"]
