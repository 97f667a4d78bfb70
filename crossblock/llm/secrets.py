"""Secret scans over an incremental ledger of text blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a Parquet
folder with one row per scanned (blob, rule, rule version) and the spans found there, so a
later scan reads the text of those blobs only that some current rule has not seen, and adds
its rows. Findings are joined back to all paths and versions that hold the blob.

A missing text is the empty blob. Copies of a text are scanned once, however many paths have
them. Missing paths and versions are kept like others. Repeated rows get the same findings
each. An empty table gives empty results. Extra columns are ignored. Spans count code points,
end exclusive; a text may hold any number of them. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossblock.operators.lookup import sized_lookup
from crossblock.session import cut


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches whose group is long enough.

    Change `version` with any other field: pairs of a blob and a version are scanned once.
    `needle` is a string that every match contains; texts without it skip the pattern.
    """

    kind: str
    pattern: str
    min_length: int = 1
    group: int = 0
    needle: str = ""
    version: int = 1
    base: bool = False


_NAMES = "|".join(map(either_case, ["password", "passwd", "secret", "token", "api_?key"]))
# The three base kinds, then kinds that this scan adds.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 16, needle="AKIA", base=True),
    # A run is whole in either form; shorter runs need not be listed to be dropped.
    Rule("hex", "[0-9a-f]{32,}", 32, base=True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", needle="PRIVATE KEY-----"),
    # A part that starts right and goes on wrong is matched and dropped: nothing in it can match.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]++(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?", 1, 1, needle="eyJ"),
)
SPANS = "array<struct<start:long,end:long>>"
LEDGER = f"blob string, kind string, version int, spans {SPANS}"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches, from the lengths of the matches and of the text between them.

    The lists are built in slices of about the root of their number, since a list that grows
    by one is copied whole.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # The group ends its match where it is not the match itself.
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zipped = F.zip_with(
        F.zip_with(found, F.split(text, rule.pattern, -1), lambda m, gap: F.struct(F.length(m).alias("n"), F.length(gap).alias("gap"))),
        kept,
        lambda x, g: F.struct(x["n"].alias("n"), x["gap"].alias("gap"), F.length(g).alias("g")),
    )
    none = F.array().cast(SPANS)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["n"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(x["g"] >= rule.min_length, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def part(state: Column, matches: Column) -> Column:
        run = F.aggregate(matches, F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return bound(run, lambda r: F.struct(r["at"].alias("at"), F.concat(state["parts"], F.array(r["spans"])).alias("parts")))

    def whole(matches: Column) -> Column:
        size = F.size(matches)
        width = F.ceil(F.sqrt(size)).cast("int")
        slices = F.transform(F.sequence(F.lit(0), size - 1, width), lambda i: F.slice(matches, i + 1, width))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts"))
        return F.when(size > 0, F.flatten(F.aggregate(slices, start, part, lambda s: s["parts"]))).otherwise(none)

    # The piece after the last match has no match of its own.
    spans = bound(F.filter(zipped, lambda x: x["n"].isNotNull()), whole)
    present = text.contains(rule.needle) if rule.needle else F.lit(True)
    return F.when(present & text.rlike(rule.pattern), spans).otherwise(none)


def blobs(versions: DataFrame, *, path: Sequence[str], text: str = "text") -> DataFrame:
    """The paths and versions with the address of their text."""
    return versions.select(*path, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger so far; rows that a repeated run wrote twice count once."""
    try:
        rows = spark.read.schema(LEDGER).parquet(ledger)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows


def scan(
    versions: DataFrame,
    ledger: str,
    *,
    path: Sequence[str],
    text: str = "text",
    rules: Sequence[Rule] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger up to date; returns (paths with blob, blobs with how many paths they have).

    Both are written tables without texts. Each unseen blob is scanned once.
    """
    spark = versions.sparkSession
    paths = cut(blobs(versions, path=path, text=text))
    holders = cut(paths.groupBy("blob").agg(F.count("*").alias("holders")))
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    known = read_ledger(spark, ledger).groupBy("blob").agg(
        F.collect_set(F.concat_ws(":", "kind", "version")).alias("_known")
    )
    todo = (
        holders.join(known, "blob", "left")
        .withColumn("_todo", F.array_except(current, F.coalesce("_known", F.array().cast("array<string>"))))
        .where(F.size("_todo") > 0)
        .select("blob", "_todo")
    )
    # Copies are merged before the shuffle, so a text that many rows hold is one row a task.
    held = F.coalesce(F.col(text), F.lit("")).alias("_text")
    texts = versions.select(held).select(F.sha2("_text", 256).alias("blob"), "_text")
    texts = texts.groupBy("blob").agg(F.any_value("_text").alias("_text"))
    scanned = F.array(
        *[
            F.when(
                F.array_contains("_todo", f"{r.kind}:{r.version}"),
                F.struct(
                    F.lit(r.kind).alias("kind"),
                    F.lit(r.version).alias("version"),
                    spans_of(F.col("_text"), r).alias("spans"),
                ),
            )
            for r in rules
        ]
    )
    (
        texts.join(todo, "blob")
        .select("blob", F.explode(F.filter(scanned, lambda x: x.isNotNull())).alias("_f"))
        .select("blob", "_f.kind", "_f.version", "_f.spans")
        .write.mode("append")
        .parquet(ledger)
    )
    return paths, holders


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    one = F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def findings(
    paths: DataFrame, holders: DataFrame, ledger: str, *, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Every path with the findings in its blob: n_<kind>, base_sha256 and spans."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    of = read_ledger(paths.sparkSession, ledger).where(
        F.array_contains(wanted, F.concat_ws(":", "kind", "version"))
    )
    # A blob has one row per rule; collect_set drops rows that a repeated run wrote again.
    whole = of.groupBy("blob").agg(F.collect_set(F.struct("kind", "spans")).alias("_rules"))

    def flat(kinds: Sequence[str]) -> Column:
        chosen = F.filter("_rules", lambda r: r["kind"].isin(*kinds))
        return F.flatten(
            F.transform(
                chosen,
                lambda r: F.transform(
                    r["spans"],
                    lambda s: F.struct(
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        r["kind"].alias("kind"),
                        F.array_position(names, r["kind"]).alias("rank"),
                    ),
                ),
            )
        )

    base = [r.kind for r in rules if r.base]
    per_blob = whole.select(
        "blob",
        *[F.size(flat([k])).cast("long").alias(f"n_{k}") for k in [r.kind for r in rules]],
        F.sha2(joined(flat(base)), 256).alias("base_sha256"),
        joined(flat([r.kind for r in rules])).alias("spans"),
    )
    sized = cut(holders.select("blob", "holders").join(per_blob, "blob"))
    return sized_lookup(paths, sized, ["blob"], "holders")
