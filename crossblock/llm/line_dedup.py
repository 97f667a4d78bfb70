"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed (blank lines do not count, white space at a
line's ends is ignored). A text with fewer lines is one window of all it has. Windows that
occur more than once anywhere are found with one aggregate; every occurrence but the first, in
order of (key, text, position), marks its lines, overlapping marks merge, and marked lines go.
A line that goes has an equal line earlier, so every line keeps its first copy. Repeated runs
of one or two lines inside a longer text stay, however long.

Missing text stays missing and empty text empty. A text of which no line is left becomes
empty. Missing keys sort first. Repeated rows (equal key and text) are one document and are
treated alike. An empty table gives an empty result. Extra columns are kept whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossblock.operators.lookup import sized_lookup
from crossblock.session import cut

WINDOW = 3
#: What is ignored at a line's ends.
BLANK = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(text: Column, width: int = WINDOW) -> Column:
    """Array of (hash, positions of the lines covered)."""
    numbered = F.filter(
        F.transform(
            lines_of(text), lambda line, i: F.struct(F.btrim(line, F.lit(BLANK)).alias("line"), i.alias("at"))
        ),
        lambda x: x["line"] != "",
    )

    def build(lines: Column) -> Column:
        whole = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
        short = F.array(
            F.struct(
                F.unhex(F.md5(F.concat_ws("\n", F.size(lines).cast("string"), whole))).alias("hash"),
                F.transform(lines, lambda x: x["at"]).alias("lines"),
            )
        )

        def one(j: Column) -> Column:
            run = [F.get(lines, j + k) for k in range(width)]
            return F.struct(
                F.unhex(F.md5(F.concat_ws("\n", *[x["line"] for x in run]))).alias("hash"),
                F.array(*[x["at"] for x in run]).alias("lines"),
            )

        every = F.transform(F.sequence(F.lit(0), F.size(lines) - width), one)
        return F.when(F.size(lines) >= width, every).when(F.size(lines) > 0, short)

    # One element, so that the lines are made once.
    return F.element_at(F.transform(F.array(numbered), build), 1)


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Columns `row` (the row as it was), `text` (what is left), `lines`, `removed`, `left`.

    `lines`, `removed` and `left` count lines that are not blank.
    """
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("_key"),
        F.col(text).alias("_text"),
    ).withColumn("_h", F.xxhash64("_text"))
    place = F.struct("_key", "_h", "_at").alias("_place")
    occurring = (
        marked.select("_key", "_h", F.posexplode(windows(F.col("_text"), width)).alias("_at", "_w"))
        .select(F.col("_w.hash").alias("_hash"), place, F.col("_w.lines").alias("_lines"))
    )
    repeated = cut(
        occurring.groupBy("_hash")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    later = sized_lookup(occurring, repeated, ["_hash"], "_n").where(
        F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_place"))
    )
    covered = later.groupBy(F.col("_place._key").alias("_k"), F.col("_place._h").alias("_kh")).agg(
        F.array_distinct(F.flatten(F.collect_set("_lines"))).alias("_gone")
    )
    joined = marked.join(
        covered, (F.col("_h") == F.col("_kh")) & F.col("_key").eqNullSafe(F.col("_k")), "left"
    )
    lines = lines_of(F.col("_text"))
    solid = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    count = F.coalesce(solid, F.lit(0)).cast("long")
    gone = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    return joined.select(
        "row",
        F.when(gone == 0, F.col("_text")).when(gone == count, F.lit("")).otherwise(rest).alias("text"),
        count.alias("lines"),
        gone.alias("removed"),
        (count - gone).alias("left"),
    )
