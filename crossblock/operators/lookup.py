"""Left lookup that survives keys holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy above 1/HEAVY of all rows, so there are fewer than HEAVY heavy keys.
HEAVY = 1000
#: Rows and bytes of the right side up to which it, or its heavy part, is broadcast.
SMALL, BYTES = 5_000, 8 << 20
#: Copies of a heavy row that is too wide to broadcast.
COPIES = 32


def narrow(rows: DataFrame) -> bool:
    """Whether at most SMALL rows of at most BYTES are there."""
    size = F.octet_length(F.to_json(F.struct("*")))
    found = rows.select(size.alias("size")).limit(SMALL + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)))
    n, total = found.first()
    return n <= SMALL and total <= BYTES


def sized_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Left join to one row per key, where right[size] counts the left rows of the key.

    `right` is read more than once, so pass a written table. A right side of few rows and
    bytes is broadcast whole. Beyond that, heavy keys number fewer than HEAVY whatever the
    data. Their rows are broadcast and their left rows then pass the shuffled join under a salt
    that spreads them and matches nothing; if their rows are too wide for that, a few
    copies of each meet the left rows under salts that match.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys and c not in left.columns]
    right = right.select(*keys, *values, *([] if size in [*keys, *values] else [size]))
    if narrow(right):
        return left.join(F.broadcast(right.select(*keys, *values)), keys, "left").select(*left.columns, *values)
    # Rounded up so that the bound on their number holds exactly.
    heavy = right.where(F.col(size) * F.lit(HEAVY) > right.agg(F.sum(size)).scalar())
    known = right.select(*keys, *values).withColumn("_salt", F.lit(0).cast("long"))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(4096))
    if not narrow(heavy):
        marks = heavy.select(*keys, F.lit(True).alias("_hot"))
        salt = F.when(F.col("_hot"), spread % COPIES + 1).otherwise(F.lit(0))
        salts = F.sequence(*[F.lit(n).cast("long") for n in (1, COPIES)])
        copies = heavy.select(*keys, *values, F.explode(salts).alias("_salt"))
        salted = left.join(F.broadcast(marks), keys, "left").withColumn("_salt", salt)
        return salted.join(known.unionByName(copies), [*keys, "_salt"], "left").select(*left.columns, *values)
    hot = heavy.select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    flagged = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread + 1).otherwise(F.lit(0))
    )
    joined = flagged.join(known, [*keys, "_salt"], "left")
    return joined.select(
        *left.columns,
        *[F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(v)).alias(v) for v in values],
    )
