"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies. Along an order of the
source's documents the expected copies are added up, one random offset is added for the
source, and a document is emitted once for every integer that its stretch crosses. The order
goes by size, so that neighbours stand in for each other and the words taken come within
about one document of the target. Sums run over counts of (source, size, bucket) cells; no
task holds a source.

Missing text has size 0. A missing source is a source of its own, last in the order. Sources
without a word have target 0 and give no copy. Repeated rows count one by one. An empty table
gives an empty result. Extra columns are ignored by `taken` and kept by `emit`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossblock.functions.keyed import digest, word
from crossblock.llm.common import word_count
from crossblock.operators.lookup import sized_lookup
from crossblock.operators.ranking import prefix_sums, row_index
from crossblock.session import cut

WEIGHTS, SHARE, CEILING, SEED = (5, 2, 1), 1.5, 2, 20
#: Rows of one (source, size) cell, or sources, that one window task ranks at most, about.
CELL_ROWS = 20_000
#: Copies of one row that one task makes.
RUN = 1000


def targets(
    sizes: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
) -> DataFrame:
    """Words to take from each source, from one row per source (_none, _source, source_size).

    Weights repeat along the sources' order. A target above `ceiling` times its source's size
    stops there and the excess goes to the others by weight. That ends where all targets are
    level * weight or their ceiling, and with sources ordered by ceiling / weight the level
    follows from running sums, which go over buckets of CELL_ROWS sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = row_index(sizes, ["_none", "_source"], "_at").select(
        *sizes.columns,
        F.element_at(cycle, (F.pmod(F.col("_at"), len(weights)) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * F.lit(float(ceiling))).alias("_top"),
    ).withColumn("_ratio", F.col("_top") / F.col("_w"))
    placed = row_index(ranked, ["_ratio", "_none", "_source"], "_at").withColumn(
        "_bucket", F.floor(F.col("_at") / F.lit(CELL_ROWS))
    )
    measures = {"_tops": F.col("_top"), "_ws": F.col("_w"), "_words": F.col("source_size")}
    summed = prefix_sums(placed, measures, group=[], order=["_at"], bucket="_bucket", totals=True)
    levels = cut(summed.select(
        *ranked.columns,
        "_at",
        # Level if exactly the sources before this one stop at their ceilings.
        (
            (F.col("_words_total") * F.lit(float(share)) - F.col("_tops")) / (F.col("_ws_total") - F.col("_ws"))
        ).alias("_level"),
    ))
    # The first such source, also among equal ratios.
    free = levels.where(F.col("_level") < F.col("_ratio")).agg(F.min(F.struct("_at", "_level")).alias("_f"))
    return levels.withColumn("_free", free.select("_f._level").scalar()).select(
        "_none",
        "_source",
        "source_size",
        F.when(F.col("_free").isNull() | (F.col("_free") * F.col("_w") >= F.col("_top")), F.col("_top"))
        .otherwise(F.col("_free") * F.col("_w"))
        .alias("target"),
    )


def taken(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: str | Column | None = None,
    text: str = "text",
    seed: int = SEED,
    keep: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
) -> DataFrame:
    """One row per document: key, size, source_size, target, copies, and the `keep` columns."""
    measured = word_count(text) if size is None else (F.col(size) if isinstance(size, str) else size)
    rows = cut(
        docs.select(
            F.col(key).alias("_key"),
            F.col(source).isNull().alias("_none"),
            F.coalesce(F.col(source), F.lit("")).alias("_source"),
            measured.cast("long").alias("_size"),
            digest(seed, key).alias("_h"),
            *[F.col(c).alias(f"_k_{c}") for c in keep],
        )
    )
    cell = ["_none", "_source", "_size"]
    cells = cut(rows.groupBy(*cell).agg(F.count("*").alias("_n")))
    sizes = cells.groupBy("_none", "_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    plan = targets(sizes, weights=weights, share=share, ceiling=ceiling)
    # Buckets follow the order by hash inside a cell, as many as its rows ask for.
    width = F.ceil(F.col("_n") / F.lit(CELL_ROWS))
    large = cells.where(F.col("_n") > CELL_ROWS)
    wide = sized_lookup(rows, large, cell, "_n").withColumn(
        "_bucket", F.coalesce(F.floor(word(F.col("_h")) * width / F.lit(2**32)), F.lit(0)).cast("long")
    ).drop("_n")
    wide = cut(wide)
    along = Window.partitionBy("_none", "_source").orderBy("_size", "_bucket")
    offsets = (
        wide.groupBy(*cell, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(along) - F.col("_n"))
        .join(plan.withColumnsRenamed({"_none": "_pn", "_source": "_ps"}),
              (F.col("_none") == F.col("_pn")) & (F.col("_source") == F.col("_ps")))
        .select(*cell, "_bucket", "_before", "source_size", "target")
    )
    inside = Window.partitionBy(*cell, "_bucket").orderBy("_h", "_key")
    offset = (word(digest(seed, F.lit("offset"), F.col("_none"), F.col("_source"))) + F.lit(0.5)) / F.lit(2.0**32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = (
        wide.join(offsets, [*cell, "_bucket"])
        .withColumn("_at", (F.col("_before") + F.row_number().over(inside) - 1).cast("double"))
        .withColumn("_u", offset)
        .withColumn("_rate", rate)
    )
    crossed = F.floor(F.col("_u") + (F.col("_at") + 1) * F.col("_rate")) - F.floor(F.col("_u") + F.col("_at") * F.col("_rate"))
    return placed.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        # A stretch of at most `ceiling` crosses no more integers; this holds against rounding.
        F.least(crossed, F.lit(int(ceiling))).cast("long").alias("copies"),
        *[F.col(f"_k_{c}").alias(c) for c in keep],
    )


def emit(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixed corpus: rows of `docs` with all their columns, each as often as it is taken.

    Ranks are made without texts. Equal rows share the copies they got together; a row of any
    number of copies is made in runs of RUN.
    """
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(key).alias("_id"),
        F.xxhash64(F.col(key)).alias("_named"),
        F.xxhash64(F.col(source), F.col(text)).alias("_same"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"),
        F.col(source).alias("_from"),
        word_count(text).alias("_words"),
    )
    cell = ["_named", "_same", "_all"]
    counted = taken(marked, key="_id", source="_from", size="_words", keep=cell, **how)
    cells = cut(counted.groupBy(*cell).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")))
    # Rows with equal id, source and text share their copies evenly, in the order of the whole row.
    alike = Window.partitionBy("_named", "_same")
    whole, rows = F.sum("_copies").over(alike), F.sum("_rows").over(alike)
    before = F.sum("_rows").over(alike.orderBy("_all")) - F.col("_rows")
    each = F.floor(whole / rows)
    extra = F.greatest(F.least(whole - each * rows - before, F.col("_rows")), F.lit(0))
    times = cut(cells.select(*cell, (each * F.col("_rows") + extra).alias("_times")).where("_times > 0"))
    # Copies of a row are merged before the shuffle; its copies in the mix are made after it.
    mixed = marked.groupBy(*cell).agg(F.any_value("_row").alias("_row")).join(times, cell).select("_row", "_times")
    few = _copied(mixed.where(F.col("_times") <= RUN), F.col("_times"))
    if times.where(F.col("_times") > RUN).isEmpty():
        return few
    # Many copies of one row are made in runs, each of its own task.
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / RUN)))
    many = mixed.where(F.col("_times") > RUN).withColumn("_run", runs)
    many = many.repartition(F.xxhash64("_row"), "_run")
    return few.unionByName(_copied(many, F.least(F.lit(RUN), F.col("_times") - F.col("_run") * RUN)))


def _copied(rows: DataFrame, times: Column) -> DataFrame:
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("_row.*")
