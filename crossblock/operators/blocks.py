"""Pairing facts into blocks and expanding a block to its four cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossblock.functions.keyed import digest
from crossblock.functions.text import fill_template
from crossblock.functions.values import insist
from crossblock.operators.lookup import narrow, sized_lookup
from crossblock.operators.ranking import global_rank, hash_bucketed, large_groups, prefix_sums, shuffle_rank
from crossblock.session import cut
from crossblock.sources.contract import CELL_COLUMNS
from crossblock.sources.facts import can_pair

POOL = ["relation_family", "split"]
#: What one matching covers.
MATCHING = [*POOL, "round"]


def _round_sum(r: Column, n: Column) -> Column:
    """Sum, modulo n, of the ranks that round r pairs; NULL when all pairs of n facts are used up.

    Odd sums come first where n is even: they leave no fact alone.
    """
    even = F.when(r < n / 2, 2 * r + 1).otherwise(2 * r - n)
    return F.when(r < n, F.when(n % 2 == 0, even).otherwise((2 * r + 1) % n))


def _sum_round(total: Column, n: Column) -> Column:
    """The round that pairs ranks with this sum modulo n."""
    even = F.when(total % 2 == 1, F.floor((total - 1) / 2)).otherwise(F.floor(n / 2) + F.floor(total / 2))
    odd = ((total - 1 + n) % n) * F.floor((n + 1) / 2) % n
    return F.when(n % 2 == 0, even).otherwise(odd)


def _couple(facts: DataFrame, slot: Column, seat: Column, group: Sequence[str] = tuple(MATCHING)) -> DataFrame:
    """Seat the facts of a (matching, slot) as x and y. The second is NULL for an odd one out."""
    held = F.struct(*[c for c in facts.columns if not c.startswith("_") and c != "round"])
    return facts.withColumn("_slot", slot).withColumn("_seat", seat).groupBy(*group, "_slot").agg(
        F.max(F.when(F.col("_seat") == 0, held)).alias("x"),
        F.max(F.when(F.col("_seat") == 1, held)).alias("y"),
    )


def _judge(couples: DataFrame) -> DataFrame:
    """The couple in the order of its ids, and whether it has both partners and valid answers."""
    swap = F.col("y.fact_id") < F.col("x.fact_id")
    return couples.withColumns(
        {
            "fact_q1": F.when(swap, F.col("y")).otherwise(F.col("x")),
            "fact_q2": F.when(swap, F.col("x")).otherwise(F.col("y")),
        }
    ).withColumn("ok", F.col("y").isNotNull() & F.coalesce(can_pair("fact_q1", "fact_q2"), F.lit(False)))


def _facts_of(couples: DataFrame) -> DataFrame:
    members = F.filter(F.array("x", "y"), lambda f: f.isNotNull())
    return couples.select(*MATCHING, F.explode(members).alias("f")).select(
        *MATCHING, *[F.col(f"f.{c}").alias(c) for c in couples.schema["x"].dataType.names if c not in MATCHING]
    )


def _ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"_k1": F.col("fact_q1.fact_id"), "_k2": F.col("fact_q2.fact_id")})


def _broken_up(judged: DataFrame, seed: str, narrow: bool) -> DataFrame | None:
    """Valid couples that are broken up so that the leftovers can be matched; None if none are.

    Where one answer holds the majority of a matching's leftovers, just enough valid couples
    without that answer give their members as partners.
    """
    leftovers = _facts_of(judged.where(~F.col("ok")))
    by_answer = leftovers.groupBy(*MATCHING, "answer_id").agg(F.count("*").alias("n"))
    rank = F.struct("n", "answer_id")
    short = (
        by_answer.groupBy(*MATCHING)
        .agg(
            F.sum("n").alias("m"),
            F.max("n").alias("h"),
            F.max_by("answer_id", rank).alias("majority"),
        )
        .withColumn("need", F.col("h") - F.ceil(F.col("m") / 2))
    )
    good = judged.where("ok")
    sizes = good.groupBy(*MATCHING).agg(F.count("*").alias("_n"))
    # One row per matching that lacks partners.
    wanted = cut(sizes.join(short.where("need > 0"), MATCHING).select(*MATCHING, "_n", "need", "majority"))
    if wanted.isEmpty():
        return None
    found = sized_lookup(good, wanted, MATCHING, "_n").where(
        (F.col("need") > 0)
        & ~F.array_contains("fact_q1.correct_ids", F.col("majority"))
        & ~F.array_contains("fact_q2.correct_ids", F.col("majority"))
    )
    ids = _ids(found)
    ids = ids if narrow else cut(ids)
    ranked = shuffle_rank(ids, group=MATCHING, key=["round", "_k1", "_k2"], seed=f"{seed}:d", name="_r", narrow=narrow)
    return cut(ranked.where(F.col("_r") < F.col("need")).select(*judged.columns))


def _laid_out(rest: DataFrame, narrow: bool) -> DataFrame:
    """Rank `_rank` along (_a, _f, fact_id) inside each matching, and its rows `_rank_total`.

    Where a pool may be large, an answer's rows are ranked by themselves, cut by `_f` if they
    are many, and the rows of all answers before are added: every answer is one run.
    """
    if narrow:
        order = ["_a", "_f", "fact_id"]
        return global_rank(rest, group=MATCHING, order=order, bucket=None, name="_rank", totals=True)
    rest, answer = cut(rest), [*MATCHING, "_a"]
    sizes = cut(rest.groupBy(*answer).agg(F.count("*").alias("_held")))
    sizes, bucket = hash_bucketed(sizes, MATCHING, "_a", "_b")
    before = {"_start": F.col("_held")}
    runs = prefix_sums(sizes, before, group=MATCHING, order=["_a"], bucket=bucket, totals=True)
    placed, bucket = hash_bucketed(rest, answer, "_f", "_b")
    ranked = global_rank(placed, group=answer, order=["_f", "fact_id"], bucket=bucket, name="_at")
    found = sized_lookup(ranked, cut(runs.drop("_b")), answer, "_held")
    return found.select(
        *rest.columns,
        (F.col("_start") + F.col("_at")).alias("_rank"),
        F.col("_start_total").alias("_rank_total"),
    )


def _repaired(rest: DataFrame, seed: str, rounds: int, narrow: bool) -> DataFrame:
    """Pairs among the leftovers of all rounds, none of which any round has otherwise.

    They are laid out by answer and rank i meets i + n/2, rounded up, which can only clash on an
    answer that holds more than half of them; `_broken_up` prevents that.
    """
    hashed = rest.withColumns({"_a": digest(seed, "round", "answer_id"), "_f": digest(seed, "round", "fact_id")})
    laid = _laid_out(hashed, narrow)
    half = F.ceil(F.col("_rank_total") / 2)
    second = F.col("_rank") >= half
    slot = F.when(second, F.col("_rank") - half).otherwise(F.col("_rank"))
    judged = _judge(_couple(laid, slot, second.cast("int"))).where("ok")
    n = F.col("x.pool_size")
    own = _sum_round((F.col("x.place") + F.col("y.place")) % n, n)
    fresh = _ids(judged.where((own >= rounds) | (own == F.col("round"))))
    first = Window.partitionBy(*POOL, "_k1", "_k2").orderBy("round")
    return fresh.withColumn("_again", F.row_number().over(first)).where("_again = 1")


def pair_facts(facts: DataFrame, *, pairings_per_fact: int, seed: int | str) -> DataFrame:
    """Pairs (relation_family, split, round, fact_q1, fact_q2) inside each (family, split) pool.

    A pool is ranked once, in a shuffled order, and round r pairs the ranks whose sum is s(r)
    modulo the pool's size: every fact once, and no pair in two rounds. Couples that may not
    pair are matched again, those of all rounds in one pass. Per round each fact is used at most
    once, and no pair returns; a fact without a valid partner stays out of that round. `facts` is
    read twice, so pass a written table.
    """
    if pairings_per_fact < 1:
        raise ValueError(f"pairings_per_fact must be >= 1, got {pairings_per_fact}")
    seed = str(seed)
    # What is ranked inside a matching is never more than the pool's facts.
    narrow = large_groups(facts, POOL) is None
    hashed, bucket = facts.withColumn("_h", digest(seed, "fact_id")), None
    if not narrow:
        hashed, bucket = hash_bucketed(hashed, POOL, "_h", "_b")
    ranked = global_rank(hashed, group=POOL, order=["_h", "fact_id"], bucket=bucket, name="place", totals=True)
    ranked = ranked.withColumnRenamed("place_total", "pool_size")
    every = ranked.withColumn("round", F.explode(F.array(*[F.lit(r) for r in range(pairings_per_fact)])))
    own, n = F.col("place"), F.col("pool_size")
    other = F.coalesce((_round_sum(F.col("round"), n) - own + n) % n, own)
    couples = _couple(every, F.least(own, other), (own > other).cast("int"))
    judged = cut(_judge(couples).select(*MATCHING, "x", "y", "fact_q1", "fact_q2", "ok"))
    broken = _broken_up(judged, seed, narrow)
    kept = judged.where("ok")
    rest = _facts_of(judged.where(~F.col("ok")))
    if broken is not None:
        kept = _ids(kept).join(_ids(broken).select("round", "_k1", "_k2"), ["round", "_k1", "_k2"], "left_anti")
        rest = rest.unionByName(_facts_of(broken))
    repaired = _repaired(rest, seed, pairings_per_fact, narrow)
    sides = [F.col(f).dropFields("place", "pool_size").alias(f) for f in ("fact_q1", "fact_q2")]
    return cut(kept.select(*MATCHING, *sides).unionByName(repaired.select(*MATCHING, *sides)))


def pick_templates(rows: DataFrame, templates: DataFrame, rank: Column, *, least: int = 1) -> DataFrame:
    """Add `template`, the one of the row's family at place rank modulo their number.

    Templates are looked up by (family, place), however many a family has; a family with
    fewer than `least` fails the job. Where templates are too many to broadcast, `rows` is read
    twice.
    """
    family = "relation_family"
    order = Window.partitionBy(family).orderBy("ordinal", "template_id")
    numbered = cut(
        templates.select(
            family,
            (F.row_number().over(order) - 1).alias("_place"),
            F.count("*").over(Window.partitionBy(family)).alias("_count"),
            F.struct("ordinal", "template_id", "text").alias("template"),
        )
    )
    counts, places = numbered.where("_place = 0").select(family, "_count"), numbered.drop("_count")
    ranked = rows.withColumn("_rank_at", rank)
    if narrow(numbered):
        counted = ranked.join(F.broadcast(counts), family, "left")
        placed = _at_place(counted, least).join(F.broadcast(places), [family, "_place"], "left")
        return placed.select(*rows.columns, "template")
    sizes = cut(rows.groupBy(family).agg(F.count("*").alias("_n")).join(counts, family, "left"))
    # Ranks go round, so each place has its share of the family's rows.
    shares = places.join(sizes.select(family, F.ceil(F.col("_n") / F.col("_count")).alias("_share")), family)
    placed = _at_place(sized_lookup(ranked, sizes, [family], "_n"), least)
    return sized_lookup(placed, cut(shares), [family, "_place"], "_share").select(*rows.columns, "template")


def _at_place(counted: DataFrame, least: int) -> DataFrame:
    enough = insist(
        counted,
        F.coalesce(F.col("_count"), F.lit(0)) >= F.lit(least),
        F.concat(F.lit("too few question templates for family "), F.col("relation_family")),
    )
    return enough.withColumn("_place", (F.col("_rank_at") % F.col("_count")).cast("int"))


def assign_templates(
    pairs: DataFrame, templates: DataFrame, *, templates_per_family: int | None, seed: int | str
) -> DataFrame:
    """Round-robin templates inside each (family, split) pool, and the block id."""
    if templates_per_family is not None:
        templates = templates.where(F.col("ordinal") < F.lit(templates_per_family))
    ids = pairs.withColumns(
        {"_k1": F.col("fact_q1.fact_id"), "_k2": F.col("fact_q2.fact_id")}
    )
    ranked = shuffle_rank(ids, group=POOL, key=["_k1", "_k2"], seed=f"{seed}:t", name="_rank")
    picked = pick_templates(ranked, templates, F.col("_rank"), least=templates_per_family or 1)
    return picked.select(
        block_id(F.col("relation_family"), F.col("template.template_id")).alias("block_id"),
        *[c for c in pairs.columns],
        "template",
    )


def block_id(family: Column, template_id: Column) -> Column:
    return F.concat(
        family,
        F.lit("/"),
        F.col("fact_q1.subject_slug"),
        F.lit("__"),
        F.col("fact_q2.subject_slug"),
        F.lit("/"),
        F.substring_index(template_id, "/", -1),
    )


def duplicate_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_id").agg(F.count("*").alias("n")).where("n > 1")


def require_unique_blocks(blocks: DataFrame) -> None:
    first = duplicate_blocks(blocks).orderBy("block_id").limit(1).collect()
    if first:
        raise ValueError(f"block ids repeat, first {first[0]['block_id']}")


def cell_factors(cell: str | Column = "cell") -> dict[str, Column]:
    """q_index, a_index and matched read off a cell name."""
    name = F.col(cell) if isinstance(cell, str) else cell
    q, a = (F.substring(name, i, 1).try_cast("tinyint") for i in (2, 4))
    return {"q_index": q, "a_index": a, "matched": q == a}


def expand_blocks(blocks: DataFrame, *, dataset_tier: int = 1) -> DataFrame:
    """Four cell rows per block. `correct` comes from the facts, not from the cell name."""
    factors = F.array(
        *[
            F.struct(F.lit(q).cast("tinyint").alias("q"), F.lit(a).cast("tinyint").alias("a"))
            for q in (1, 2)
            for a in (1, 2)
        ]
    )
    rows = blocks.withColumn("_f", F.explode(factors)).withColumns(
        {
            "q_index": F.col("_f.q"),
            "a_index": F.col("_f.a"),
            "_q": F.when(F.col("_f.q") == 1, F.col("fact_q1")).otherwise(F.col("fact_q2")),
            "_a": F.when(F.col("_f.a") == 1, F.col("fact_q1")).otherwise(F.col("fact_q2")),
        }
    )
    matched = F.col("q_index") == F.col("a_index")
    return rows.select(
        "block_id",
        "relation_family",
        F.lit(dataset_tier).cast("tinyint").alias("dataset_tier"),
        F.concat(F.lit("q"), F.col("q_index"), F.lit("a"), F.col("a_index")).alias("cell"),
        "q_index",
        "a_index",
        F.col("_q.question_id").alias("question_id"),
        F.col("_a.answer_id").alias("answer_id"),
        F.col("_q.subject").alias("subject"),
        fill_template("template.text", "_q.subject_phrase").alias("question"),
        F.col("_a.answer").alias("answer"),
        matched.alias("matched"),
        F.array_contains("_q.correct_ids", F.col("_a.answer_id")).alias("correct"),
        F.when(matched, "gold").otherwise("distractor").alias("answer_source"),
        F.when(matched, "natural").otherwise("off_policy").alias("policy_status"),
        F.col("template.template_id").alias("template_id"),
        "split",
    ).select(*CELL_COLUMNS)
