"""Missing-value rules shared by all measures.

NULL is the only missing value after ingest: Spark orders NaN above every number, so a
NaN that reached a gate would pass it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is made once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements that are added up one after the other; longer arrays are cut into runs of so many.
RUN = 64


def running_totals(values: Column) -> Column:
    """Inclusive running sums of an array of ints.

    By runs: an array that grows by one is copied for every element, so only short ones grow. The
    sums before each run are added to its own.
    """

    def along(xs: Column) -> Column:
        last = lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0))
        return F.aggregate(xs, F.array().cast("array<int>"), lambda sums, x: F.concat(sums, F.array(last(sums) + x)))

    def added(runs: Column) -> Column:
        before = along(F.transform(runs, lambda r: F.coalesce(F.element_at(r, -1), F.lit(0))))
        return bound(before, lambda t: F.flatten(F.transform(runs, lambda r, i: F.when(i == 0, r).otherwise(
            F.transform(r, lambda x: x + F.get(t, i - 1))
        ))))

    n = F.size(values)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int"))
    runs = F.transform(starts, lambda k: along(F.slice(values, k * RUN + 1, F.lit(RUN))))
    return F.when(n <= RUN, along(values)).otherwise(bound(runs, added))


def finite(value: str | Column) -> Column:
    """NaN and both infinities become NULL (NaN < inf is false in Spark)."""
    x = as_column(value).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def changed_side(after: str | Column, before: str | Column) -> Column:
    """Whether the sign changed; a missing side counts as a change."""
    a, b = finite(after), finite(before)
    return F.coalesce(F.signum(a) != F.signum(b), F.lit(True))


def strict_mean(value: str | Column) -> Column:
    """Mean that is NULL as soon as one member is missing."""
    x = finite(value)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def passes(condition: Column, missing: bool = False) -> Column:
    return F.coalesce(condition, F.lit(missing))


def insist(df: DataFrame, holds: Column, message: str | Column) -> DataFrame:
    """Fail the job on the first row for which `holds` is not true."""
    text = F.lit(message) if isinstance(message, str) else message
    broken = F.raise_error(text).cast("boolean")
    return df.where(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(broken))


def insist_once(df: DataFrame, check: DataFrame, holds: Column, message: str | Column) -> DataFrame:
    """Fail the job when the one-row frame `check` does not satisfy `holds`, even on empty input."""
    text = F.lit(message) if isinstance(message, str) else message
    verdict = check.select(
        F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(text).cast("boolean")
        )
    )
    return df.where(verdict.scalar())


def with_readouts(df: DataFrame) -> DataFrame:
    """moved, gap and flipped of a patched margin."""
    return df.withColumns(
        {
            "moved": finite("patched") - finite("target_clean"),
            "gap": finite("source_clean") - finite("target_clean"),
            "flipped": changed_side("patched", "target_clean"),
        }
    )
