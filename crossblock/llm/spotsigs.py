"""Document fingerprints from spot signatures.

A spot signature is a common word (the anchor) with the chain of the next content words
after it, common words in between skipped. A document's fingerprint is the set of its
signatures, so edits of headers or of single words touch few of them. Documents are
partitioned by the size of their sets: two sets with Jaccard similarity t differ in size by
the factor t at most, so a partition meets itself and the next one only, and pairs whose sizes
or prefixes rule t out are never intersected.

A text without a complete chain has one signature that stands for all its words, so equal
texts always have equal fingerprints and empty (or missing) texts are alike. Ties and repeated
rows keep their own rows. Empty tables give empty results. Extra columns are ignored by
`neighbours` and `near_pairs`. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossblock.session import cut

# Frequent function words of English, German, French and Spanish.
ANCHORS = tuple(
    """a an the of to in is was are were be been by for from on at it and or that this with as
    der die das den dem des ein eine einer und oder ist war sind mit von zu im auf nicht
    le la les un une des du de et ou est sont dans pour par sur que qui avec
    el los las una y o es son en para por con del al se no""".split()
)
CHAIN = 2
#: Rows that one range of doc ids holds, about, when documents are set beside their successors.
RANGE_ROWS, MOST_RANGES = 1_000, 10_000
#: Sizes of sets within this factor share a partition or are in adjacent ones.
LIKENESS = 0.8


def signatures(text: Column, *, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text as 32-bit hashes, never empty.

    The j-th anchor at word a has a - j content words before it, so its chain starts there
    in the list of content words.
    """
    words = F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""
    )

    def common(w: Column) -> Column:
        return w.isin(*sorted(set(anchors)))

    state = F.struct(
        words.alias("w"),
        F.filter(words, lambda w: ~common(w)).alias("c"),
        F.filter(F.transform(words, lambda w, i: F.when(common(w), i)), lambda i: i.isNotNull()).alias("a"),
    )

    def build(s: Column) -> Column:
        def one(a: Column, j: Column) -> Column:
            links = [F.get(s["c"], a - j + k) for k in range(chain)]
            return F.when(a - j + chain <= F.size(s["c"]), F.hash(F.get(s["w"], a), *links))

        found = F.array_sort(F.array_distinct(F.filter(F.transform(s["a"], one), lambda h: h.isNotNull())))
        whole = F.array(F.hash(F.array_join(s["w"], " ")))
        return F.when(F.size(found) > 0, found).otherwise(whole)

    # One element, so that the words are made once.
    return F.element_at(F.transform(F.array(state), build), 1)


def fingerprint(sigs: Column) -> Column:
    """The set as text: eight hex digits per signature, in order."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a look inside where sizes rule `floor` out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))
    return F.when(small < large * F.lit(float(floor)), F.lit(0.0)).otherwise(exact)


def length_partition(sigs: Column, threshold: float) -> Column:
    """Sets whose sizes differ by the factor `threshold` at most are in equal or adjacent partitions."""
    return F.floor(F.log(F.size(sigs).cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def neighbours(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document beside the next one in ascending key order; after the last, the first.

    Returns key, text, sigs, next_text, next_sigs. Rows are dealt to ranges of keys, whose
    first key is sent to the range before as well; a range is one window partition, so texts
    are shuffled once. Equal keys follow each other by text.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    ).withColumn("_h", F.xxhash64("_text"))
    ids = cut(rows.select("_key", "_h"))
    parts = max(1, min(MOST_RANGES, math.ceil(ids.count() / RANGE_ROWS)))
    marks = [i / parts for i in range(1, parts)]
    found = ids.agg(
        F.min(F.struct("_key", "_h")).alias("first"),
        F.percentile_approx("_key", marks or [0.5], 100 * parts).alias("cuts"),
    ).first()
    # Fewer than MOST_RANGES keys, whatever the data. They occur in it, so a range begins
    # with the rows that hold its cut.
    splits = sorted(set(found["cuts"] or [])) if marks else []
    top = len(splits)
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    edges = F.from_json(F.lit(str(splits)), f"array<{kind}>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(top.bit_length() or 1))])
    # Number of cuts up to the key, by halving.
    rank = F.aggregate(
        steps,
        F.lit(0),
        lambda at, s: F.when(F.get(edges, at + s - 1) <= F.col("_key"), at + s).otherwise(at),
    )
    opens = F.get(edges, F.col("_rank") - 1) == F.col("_key")
    head = found["first"]
    leads = F.lit(False)
    if head is not None:
        leads = F.col("_key").eqNullSafe(F.lit(head["_key"])) & (F.col("_h") == F.lit(head["_h"]))

    def place(at: Column, ghost: int) -> Column:
        return F.struct(at.alias("range"), F.lit(ghost).alias("ghost"))

    places = F.array(
        place(F.col("_rank"), 0),
        F.when(opens, place(F.col("_rank") - 1, 1)),
        F.when(leads, place(F.lit(top), 1)),
    )
    dealt = rows.withColumn("_rank", rank).select(
        "_key", "_text", "_h", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("_at")
    )
    signed = dealt.withColumn("_sigs", signatures(F.col("_text")))
    along = Window.partitionBy("_at.range").orderBy("_at.ghost", F.col("_key").asc_nulls_first(), "_h")
    return (
        signed.select(
            F.col("_key").alias("key"),
            F.col("_text").alias("text"),
            F.col("_sigs").alias("sigs"),
            F.lead("_text").over(along).alias("next_text"),
            F.lead("_sigs").over(along).alias("next_sigs"),
            F.col("_at.ghost").alias("_ghost"),
        )
        .where("_ghost = 0")
        .drop("_ghost")
    )


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def near_pairs(marked: DataFrame, *, key: str, sigs: str, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity) of different signature sets with Jaccard >= threshold.

    One document stands for all with an equal set: the one with the smallest key. Sets are
    dealt to partitions by size; each is posted under its rarest signatures, as many as any
    set that similar must share one of, in its own partition and, to meet larger sets, in the
    next. Sizes and positions prune pairs before a set is read.
    """
    sets = cut(
        marked.select(F.col(key).alias("key"), F.col(sigs).alias("sigs"))
        .groupBy("sigs")
        .agg(F.min("key").alias("key"))
        .select("key", "sigs", F.size("sigs").alias("n"), length_partition(F.col("sigs"), threshold).alias("part"))
    )
    single = sets.select("key", "n", "part", F.explode("sigs").alias("sig"))
    counted = single.groupBy("sig").agg(F.count("*").alias("df"))
    rare_first = Window.partitionBy("key").orderBy("df", "sig")
    posted = cut(
        single.join(counted, "sig")
        .withColumn("pos", F.row_number().over(rare_first))
        .where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
        .where("df > 1")
        .select("sig", "key", "n", "part", "pos")
    )
    left = posted.select(
        "sig", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("part").alias("own"),
        F.explode(F.array("part", F.col("part") + 1)).alias("part"),
    )
    right = posted.select("sig", "part", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    least = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    pairs = left.join(right, ["sig", "part"]).where(smaller & (most >= least)).select("a", "b").distinct()
    return (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("sigs").alias("sa")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("sigs").alias("sb")), "b")
        .select("a", "b", jaccard(F.col("sa"), F.col("sb"), threshold).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
