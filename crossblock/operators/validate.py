"""Validation: every rule yields rows of one violations table (rule, kind, id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.functions.names import (
    ANSWER_SOURCES,
    CELLS,
    FITTABLE_SPLITS,
    HOLDOUT,
    POLICY_STATUSES,
    SPLITS,
)
from crossblock.functions.text import is_blank
from crossblock.operators.blocks import cell_factors
from crossblock.operators.ranking import row_index
from crossblock.session import cut
from crossblock.sources.contract import CELL_COLUMNS

COLUMNS = ["rule", "kind", "id", "detail"]
TEXT = ["block_id", "relation_family", "question_id", "answer_id", "subject", "question",
        "answer", "template_id"]


def _cell_id() -> Column:
    return F.concat_ws("/", "block_id", "cell")


def _from_rules(df: DataFrame, rules: dict[tuple[str, str], tuple[Column, Column]], ident: Column):
    """One narrow pass: an array with an entry per broken rule, exploded."""
    entries = [
        F.when(
            F.coalesce(broken, F.lit(True)),
            F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"),
                     detail.cast("string").alias("detail")),
        )
        for (rule, kind), (broken, detail) in rules.items()
    ]
    found = df.select(ident.alias("id"), F.explode(F.array_compact(F.array(*entries))).alias("v"))
    return found.select("v.rule", "v.kind", "id", "v.detail")


def row_rules(cells: DataFrame) -> DataFrame:
    """Domains, ranges, non-empty text, and agreement of the cell name with its indices."""
    factor = cell_factors()
    rules: dict[tuple[str, str], tuple[Column, Column]] = {}
    for name in CELL_COLUMNS:
        rules["row", f"{name} is null"] = F.col(name).isNull(), F.lit(name)
    for name in TEXT:
        rules["row", f"{name} is empty"] = F.coalesce(F.length(name) < 1, F.lit(False)), F.lit(name)
    domains = {"cell": CELLS, "answer_source": ANSWER_SOURCES, "policy_status": POLICY_STATUSES,
               "split": SPLITS}
    for name, domain in domains.items():
        unknown = F.coalesce(~F.col(name).isin(domain), F.lit(False))
        rules["row", f"{name} outside its domain"] = unknown, F.col(name)
    for name, (low, high) in {"dataset_tier": (1, 3), "q_index": (1, 2), "a_index": (1, 2)}.items():
        outside = F.coalesce(~F.col(name).between(low, high), F.lit(False))
        rules["row", f"{name} out of range"] = outside, F.col(name)
    known = F.col("cell").isin(CELLS)
    differs = (F.col("q_index") != factor["q_index"]) | (F.col("a_index") != factor["a_index"])
    rules["row", "cell disagrees with its indices"] = F.coalesce(known & differs, F.lit(False)), F.col("cell")
    mismatch = F.coalesce(known & (F.col("matched") != factor["matched"]), F.lit(False))
    rules["row", "cell disagrees with matched"] = mismatch, F.col("cell")
    rules["row", "crossed cell is correct without being an alias"] = (
        F.coalesce(_crossed_correct(), F.lit(False)),
        F.col("answer_source"),
    )
    return _from_rules(cells, rules, _cell_id())


def _crossed_correct() -> Column:
    return ~F.col("matched") & F.col("correct") & (F.col("answer_source") != "alias")


def block_rules(cells: DataFrame) -> DataFrame:
    """The 2x2 structure of each block.

    One aggregate with fixed-size buffers settles every block that is complete or has the
    wrong number of rows. Only blocks of exactly four rows that look wrong are read again,
    so no buffer ever holds more than four rows, however large a broken block is.
    """
    constant = ["relation_family", "template_id", "split", "dataset_tier"]
    on, off = F.col("matched"), ~F.col("matched")
    q, a, c = F.col("question_id"), F.col("answer_id"), F.col("cell")

    def span(value: Column, side: Column, tag: str) -> list[Column]:
        held = F.when(side, value)
        return [F.min(held).alias(f"{tag}_lo"), F.max(held).alias(f"{tag}_hi")]

    profile = cells.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n"),
        *span(q, on, "qm"), *span(q, off, "qc"), *span(a, on, "am"), *span(a, off, "ac"),
        F.min(F.when(on, F.struct(q, a))).alias("pair_m"),
        F.min(F.when(off, F.struct(q, a))).alias("pair_c"),
        *[F.count_if(c == name).alias(name) for name in CELLS],
        *[(F.min(k) != F.max(k)).alias(f"varies_{k}") for k in constant],
        F.count_if(on).alias("n_matched"),
        F.count_if(F.greatest(*[F.col(k).isNull() for k in [*constant, "question_id", "answer_id",
                                                             "cell", "matched"]])).alias("n_null"),
    )
    balanced = (
        (F.col("n_matched") == 2)
        & (F.col("qm_lo") == F.col("qc_lo")) & (F.col("qm_hi") == F.col("qc_hi"))
        & (F.col("am_lo") == F.col("ac_lo")) & (F.col("am_hi") == F.col("ac_hi"))
        & (F.col("qm_lo") != F.col("qm_hi")) & (F.col("am_lo") != F.col("am_hi"))
        # The lower question meets another answer when crossed: no pair repeats.
        & (F.col("pair_m") != F.col("pair_c"))
        & (F.col("n_null") == 0)
    )
    for name in CELLS:
        balanced = balanced & (F.col(name) == 1)
    for k in constant:
        balanced = balanced & ~F.col(f"varies_{k}")
    # Written once: the wrong counts and the second look both read these few blocks.
    odd = cut(
        profile.where((F.col("n") != 4) | ~F.coalesce(balanced, F.lit(False))).select("block_id", "n")
    )
    wrong_count = odd.where("n <> 4").select(
        F.lit("block").alias("rule"),
        F.lit("row count").alias("kind"),
        F.col("block_id").alias("id"),
        F.col("n").cast("string").alias("detail"),
    )
    looked = cells.join(odd.where("n = 4").select("block_id"), "block_id", "left_semi")
    four = cut(
        looked.groupBy("block_id").agg(
            F.collect_list(F.struct("cell", "question_id", "answer_id", "matched", *constant)).alias("r")
        )
    )
    return wrong_count.unionByName(_four_row_faults(four, constant))


def _four_row_faults(four: DataFrame, constant: list[str]) -> DataFrame:
    def distinct(field: str) -> Column:
        return F.sort_array(F.array_distinct(F.col(f"r.{field}")))

    def joined(values: Column) -> Column:
        return F.array_join(values, ",", "null")

    pairs = F.array_distinct(
        F.transform("r", lambda x: F.struct(x["question_id"].alias("q"), x["answer_id"].alias("a")))
    )
    n_matched = F.size(F.filter("r", lambda x: x["matched"]))
    rules: dict[tuple[str, str], tuple[Column, Column]] = {
        ("block", "cells"): (
            distinct("cell") != F.array(*[F.lit(c) for c in CELLS]),
            joined(distinct("cell")),
        ),
        ("block", "pairs not unique"): (F.size(pairs) != 4, F.size(pairs)),
        ("block", "question identities"): (
            F.size(distinct("question_id")) != 2,
            F.size(distinct("question_id")),
        ),
        ("block", "answer identities"): (
            F.size(distinct("answer_id")) != 2,
            F.size(distinct("answer_id")),
        ),
        ("block", "matched cells"): (n_matched != 2, n_matched),
    }
    for k in constant:
        rules["block", f"{k} not constant"] = F.size(distinct(k)) != 1, joined(distinct(k))
    plain = _from_rules(four, rules, F.col("block_id"))
    # Each identity must be matched once and crossed once.
    def tagged(kind: str, field: str) -> Column:
        return F.transform(
            "r",
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x[field].alias("identity"), x["matched"].alias("matched")
            ),
        )

    either = [tagged("question", "question_id"), tagged("answer", "answer_id")]
    flags = four.select("block_id", F.explode(F.concat(*either)).alias("e"))
    unbalanced = (
        flags.groupBy("block_id", "e.kind", "e.identity")
        .agg(F.count_if("e.matched").alias("on"), F.count_if(~F.col("e.matched")).alias("off"))
        .where((F.col("on") != 1) | (F.col("off") != 1))
    )
    return plain.unionByName(
        unbalanced.select(
            F.lit("block").alias("rule"),
            F.concat("kind", F.lit(" not balanced")).alias("kind"),
            F.col("block_id").alias("id"),
            F.concat_ws(":", "identity", F.col("on").cast("string"), F.col("off").cast("string")).alias(
                "detail"
            ),
        )
    )


def label_rules(cells: DataFrame) -> DataFrame:
    wrong = F.col("matched") & ~F.col("correct")
    rules = {
        ("label", "crossed cell is correct without being an alias"): (
            F.coalesce(_crossed_correct(), F.lit(False)),
            F.col("answer_source"),
        ),
        ("label", "matched cell is incorrect"): (
            F.coalesce(wrong, F.lit(False)),
            F.col("answer_source"),
        ),
    }
    return _from_rules(cells, rules, _cell_id())


def _splits_seen(column: str = "split") -> list[Column]:
    """Fixed-size evidence of which splits a group touches, unknown ones included."""
    other = F.when(~F.col(column).isin(SPLITS), F.col(column))
    return [
        *[F.max(F.col(column) == s).alias(f"in_{s}") for s in SPLITS],
        F.min(other).alias("other_lo"),
        F.max(other).alias("other_hi"),
    ]


def _splits_listed() -> Column:
    known = [F.when(F.col(f"in_{s}"), F.lit(s)) for s in SPLITS]
    listed = F.array_compact(F.array(*known, F.col("other_lo"), F.col("other_hi")))
    return F.sort_array(F.array_distinct(listed))


def split_leaks(cells: DataFrame) -> DataFrame:
    """Block, question or answer identities that occur in more than one split."""
    identities = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(column).alias("id"))
            for kind, column in (
                ("block", "block_id"),
                ("question identity", "question_id"),
                ("answer identity", "answer_id"),
            )
        ]
    )
    long = cells.select("split", F.explode(identities).alias("i")).select("i.kind", "i.id", "split")
    spread = long.groupBy("kind", "id").agg(*_splits_seen()).withColumn("_s", _splits_listed())
    return spread.where(F.size("_s") > 1).select(
        F.lit("leak").alias("rule"), "kind", "id", F.array_join("_s", ",").alias("detail")
    )


def family_rules(cells: DataFrame) -> DataFrame:
    """Families both held out and fittable, and fittable families absent from a split."""
    families = cells.groupBy("relation_family").agg(
        *_splits_seen(), F.max(F.col("split") != HOLDOUT).alias("fittable")
    )
    absent = F.array_compact(
        F.array(*[F.when(~F.col(f"in_{s}"), F.lit(s)) for s in sorted(FITTABLE_SPLITS)])
    )
    rules = {
        ("family", "held out and fittable"): (
            F.col(f"in_{HOLDOUT}") & F.col("fittable"),
            F.lit(HOLDOUT),
        ),
        ("family", "absent from a fittable split"): (
            F.col("fittable") & (F.size(absent) > 0),
            F.array_join(absent, ","),
        ),
    }
    return _from_rules(families, rules, F.col("relation_family"))


def text_rules(cells: DataFrame) -> DataFrame:
    brace = F.col("question").contains("{") | F.col("question").contains("}")
    rows = _from_rules(
        cells,
        {
            ("text", "unfilled placeholder"): (F.coalesce(brace, F.lit(False)), F.col("question")),
            ("text", "blank question or answer"): (
                F.coalesce(is_blank("question") | is_blank("answer"), F.lit(False)),
                F.lit(""),
            ),
        },
        _cell_id(),
    )

    def one_text(keys: list[str], text: str, kind: str) -> DataFrame:
        return (
            cells.groupBy(*keys)
            .agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
            .where(F.col("lo") != F.col("hi"))
            .select(
                F.lit("text").alias("rule"),
                F.lit(kind).alias("kind"),
                F.col(keys[0]).alias("id"),
                (F.col(keys[1]) if len(keys) > 1 else F.lit("")).alias("detail"),
            )
        )

    return rows.unionByName(
        one_text(["question_id", "template_id"], "question", "question text varies in a template")
    ).unionByName(one_text(["answer_id"], "answer", "answer text varies"))


def empty_table(cells: DataFrame) -> DataFrame:
    found = cells.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return found.select(
        F.lit("table").alias("rule"), F.lit("empty").alias("kind"), F.lit("").alias("id"),
        F.lit("table is empty").alias("detail"),
    )


def validate(cells: DataFrame) -> DataFrame:
    """Every violation of every rule."""
    out = empty_table(cells)
    for rule in (row_rules, block_rules, label_rules, split_leaks, family_rules, text_rules):
        out = out.unionByName(rule(cells).select(*COLUMNS))
    return out


# Validation of a table that grows.

#: Keys of the evidence: what kind of identity, and its one or two parts.
IDENTITY = ["kind", "key", "second"]


def evidence(cells: DataFrame) -> DataFrame:
    """One row per identity of a table with all that the rules across blocks ask about it.

    Fixed-size: splits seen, whether fittable, the least and the greatest text. Evidence of
    parts of a table is merged by `merge_evidence`.
    """
    none = F.lit(None).cast("string")

    def one(kind: str, key: str, second: Column = none, text: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col(key).alias("key"), second.alias("second"), text.alias("text")
        )

    every = F.array(
        one("block", "block_id"),
        one("question identity", "question_id"),
        one("answer identity", "answer_id", text=F.col("answer")),
        one("family", "relation_family"),
        one("question text", "question_id", F.col("template_id"), F.col("question")),
    )
    long = cells.select("split", F.explode(every).alias("i")).select("i.*", "split")
    return long.groupBy(*IDENTITY).agg(
        *_splits_seen(),
        F.max(F.col("split") != HOLDOUT).alias("fittable"),
        F.min("text").alias("text_lo"),
        F.max("text").alias("text_hi"),
    )


def merge_evidence(parts: DataFrame) -> DataFrame:
    lowest = {"other_lo", "text_lo"}
    return parts.groupBy(*IDENTITY).agg(
        *[(F.min if c in lowest else F.max)(c).alias(c) for c in parts.columns if c not in IDENTITY]
    )


def evidence_rules(held: DataFrame) -> DataFrame:
    """Violations of the leak, family and text rules, with the identity that each is about."""
    seen = held.withColumn("_s", _splits_listed())
    absent = F.array_compact(F.array(*[F.when(~F.col(f"in_{s}"), F.lit(s)) for s in sorted(FITTABLE_SPLITS)]))
    family, varies = F.col("kind") == "family", F.col("text_lo") != F.col("text_hi")
    leaks = F.col("kind").isin("block", "question identity", "answer identity") & (F.size("_s") > 1)

    def fault(broken: Column, rule: str, kind: Column, detail: Column) -> Column:
        return F.when(broken, F.struct(F.lit(rule).alias("rule"), kind.alias("fault"), detail.alias("detail")))

    faults = F.array_compact(
        F.array(
            fault(leaks, "leak", F.col("kind"), F.array_join("_s", ",")),
            fault(family & F.col(f"in_{HOLDOUT}") & F.col("fittable"), "family", F.lit("held out and fittable"), F.lit(HOLDOUT)),
            fault(family & F.col("fittable") & (F.size(absent) > 0), "family",
                  F.lit("absent from a fittable split"), F.array_join(absent, ",")),
            fault((F.col("kind") == "question text") & varies, "text",
                  F.lit("question text varies in a template"), F.col("second")),
            fault((F.col("kind") == "answer identity") & varies, "text", F.lit("answer text varies"), F.lit("")),
        )
    )
    return seen.select(*IDENTITY, F.explode(faults).alias("f")).select(
        *IDENTITY, "f.rule", F.col("f.fault").alias("fault"), F.col("key").alias("id"), "f.detail"
    )


def _row_faults(cells: DataFrame) -> DataFrame:
    """Violations that one row shows by itself, under its block."""
    text = text_rules(cells).where(F.col("kind").isin("unfilled placeholder", "blank question or answer"))
    return row_rules(cells).select(*COLUMNS).unionByName(label_rules(cells).select(*COLUMNS)).unionByName(text.select(*COLUMNS))


def append_checked(new: DataFrame, path: str) -> DataFrame:
    """Append cells to the table kept at `path` and return every violation of the whole table.

    Equal to `validate` on all cells. Rows are checked once, when they come; blocks and
    identities again only when new cells touch them, from the old cells of those blocks and
    the old evidence of those identities. Each call adds a commit to every folder.
    """
    spark, new = new.sparkSession, cut(new)

    def kept(name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def both(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
        return fresh if old is None else old.unionByName(fresh)

    cells, faults, known = kept("cells"), kept("faults"), kept("evidence")
    touched = new.select(F.col("block_id").alias("_b")).distinct()
    in_touched = F.col("block_id").eqNullSafe(F.col("_b"))
    again = both(None if cells is None else cells.join(touched, in_touched, "left_semi").select(*new.columns), new)

    def subject(kind: str, *parts: Column) -> Column:
        return F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.concat(F.lit("="), p), F.lit("~")) for p in parts])

    rows = _row_faults(new).withColumn("about", F.lit("row"))
    shape = block_rules(again).select(*COLUMNS).withColumn("about", subject("block", F.col("id")))
    fresh = cut(evidence(new))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]
    named = fresh.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY])
    merged = merge_evidence(both(None if known is None else known.join(named, same, "left_semi"), fresh))
    spread = evidence_rules(merged)
    identity = subject("identity", *map(F.col, IDENTITY))
    crossing = spread.select("rule", F.col("fault").alias("kind"), "id", "detail", identity.alias("about"))
    latest = found = cut(rows.unionByName(shape).unionByName(crossing))
    if faults is not None:
        # What was said about a block or identity that is checked again no longer counts.
        settled = touched.select(subject("block", F.col("_b")).alias("about")).unionByName(fresh.select(identity.alias("about")))
        latest = cut(faults.select(*found.columns).join(settled, "about", "left_anti").select(*found.columns).unionByName(found))
    new.write.mode("append").parquet(f"{path}/cells")
    fresh.write.mode("append").parquet(f"{path}/evidence")
    latest.write.mode("overwrite").parquet(f"{path}/faults")
    return latest.select(*COLUMNS).unionByName(empty_table(spark.read.schema(new.schema).parquet(f"{path}/cells")))


def report(violations: DataFrame) -> DataFrame:
    """Violations under the name of their check, in order of check, id, kind and detail.

    Leaks are checked by kind. `place` is the position in that order.
    """
    check = F.when(F.col("rule") == "leak", F.concat_ws(" ", "rule", "kind")).otherwise(F.col("rule"))
    named = violations.select(check.alias("check"), *COLUMNS[1:])
    return row_index(named, ["check", "id", "kind", "detail"], "place")


def capped_report(violations: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The report with at most limits[check] lines of a check, and how many further ones there are.

    A check without a limit is shown whole. Lines keep the report's order; a line about
    further violations comes after those of its check. The table itself stays complete.
    """
    ordered = cut(report(violations))
    if not limits:
        return ordered.orderBy("place").drop("place")
    most = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("check"))
    first = ordered.groupBy("check").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    # One row per check, fewer than ten.
    placed = ordered.join(F.broadcast(first), "check")
    shown = placed.where(most.isNull() | (F.col("place") - F.col("_first") < most))
    further = first.where(F.col("_n") > most).select(
        "check",
        F.lit("further violations").alias("kind"),
        F.lit("").alias("id"),
        (F.col("_n") - most).cast("string").alias("detail"),
        (F.col("_first") + F.col("_n")).alias("place"),
    )
    return shown.select(*further.columns).unionByName(further).orderBy("check", "place").drop("place")


def table_counts(cells: DataFrame) -> DataFrame:
    """Rows and blocks of the table, by split and by family (scope, value, n_rows, n_blocks).

    Cells are reduced to (block, split, family) first, so no block is expanded per scope.
    """
    blocks = cells.groupBy("block_id", "split", "relation_family").agg(F.count("*").alias("n"))
    scopes = F.array(
        F.struct(F.lit("table").alias("scope"), F.lit("").alias("value")),
        F.struct(F.lit("split").alias("scope"), F.col("split").alias("value")),
        F.struct(F.lit("family").alias("scope"), F.col("relation_family").alias("value")),
    )
    long = blocks.select("block_id", "n", F.explode(scopes).alias("s"))
    per_block = long.groupBy("s.scope", "s.value", "block_id").agg(F.sum("n").alias("n"))
    return per_block.groupBy("scope", "value").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_blocks")
    )


def fact_rules(facts: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Integrity of the fact table itself (facts with ids)."""
    family = F.col("relation_family")
    repeated = facts.groupBy("relation_family", "subject_slug").agg(F.count("*").alias("n"))
    not_functional = repeated.where("n > 1").select(
        F.lit("fact").alias("rule"),
        F.lit("subject repeated").alias("kind"),
        F.concat(family, F.lit(":"), F.col("subject_slug")).alias("id"),
        F.col("n").cast("string").alias("detail"),
    )
    unknown = ~family.isin(families) if families is not None else F.lit(False)
    rules = {
        ("fact", "unknown family"): (unknown, family),
        ("fact", "empty subject slug"): (F.col("subject_slug") == "", F.col("subject")),
        ("fact", "empty answer slug"): (F.col("answer_slug") == "", F.col("answer")),
        ("fact", "phrase lacks the subject"): (
            ~F.col("subject_phrase").contains(F.col("subject")),
            F.col("subject_phrase"),
        ),
        ("fact", "also_correct repeats the answer"): (
            F.array_contains("also_correct", F.col("answer_slug")),
            F.col("answer_slug"),
        ),
    }
    rows = _from_rules(facts, rules, F.col("fact_id"))
    extra = facts.select("relation_family", "fact_id", F.explode("also_correct").alias("slug"))
    answers = facts.select("relation_family", F.col("answer_slug").alias("slug")).distinct()
    # Slugs are made distinct before the anti join, so a popular one costs one row.
    absent = extra.select("relation_family", "slug").distinct().join(
        answers, ["relation_family", "slug"], "left_anti"
    )
    dangling = extra.join(absent, ["relation_family", "slug"], "left_semi").select(
        F.lit("fact").alias("rule"),
        F.lit("also_correct is no answer of the family").alias("kind"),
        F.col("fact_id").alias("id"),
        F.col("slug").alias("detail"),
    )
    return not_functional.unionByName(rows).unionByName(dangling)
