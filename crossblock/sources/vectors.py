"""Hidden vectors as a long table (row, layer, position, vec), kept as a store by key.

A store is a folder of Parquet files, one subfolder per layer, every file one bucket of rows.
Writing a batch adds a commit; a reader sees of each (row, layer, position) its last commit, so
that repeating a batch changes nothing and a corrected one replaces its rows. Files are never
changed. Buckets follow the row: picking the last commit, and joining on the row, leave the
vectors where they are.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def half_precision(vec: str | Column) -> Column:
    """Round every element to 16-bit float precision; the column stays array<float>."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def rounded(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        # Beyond the half range a value becomes infinite, as a half-precision store would have it.
        with np.errstate(over="ignore"):
            halves = flat.astype(np.float16).astype(np.float32)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(halves), mask=pc.is_null(vectors)
        )

    return rounded(F.col(vec) if isinstance(vec, str) else vec)


KEY = ["row", "layer", "position"]
#: Buckets of a new store. Few for small ones: a commit writes a file per layer and bucket.
BUCKETS = 16
#: Rows of a bucket, about, where a store is known to be large; a bucket is a task of every join.
BUCKET_ROWS, MOST_BUCKETS = 10_000, 1024
_COMMIT = "_commit"


def buckets_for(rows: int) -> int:
    """Buckets of a new store of so many rows."""
    return min(max(BUCKETS, -(-rows // BUCKET_ROWS)), MOST_BUCKETS)


def _layout(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Buckets and columns of the store at `path`; None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_layout")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return tuple(spark.read.parquet(f"{path}/_layout").first())


def _registered(spark: SparkSession, path: str, buckets: int, columns: str) -> str:
    """Name of the session's table over the store, with all commits that are there now.

    Spark knows the buckets of tables only, not of paths.
    """
    name = f"vectors_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        quoted = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (layer) "
            f"CLUSTERED BY (row) SORTED BY (row) INTO {buckets} BUCKETS LOCATION '{quoted}'"
        )
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.catalog.refreshTable(name)
    return name


def write_vectors(df: DataFrame, path: str, *, half: bool = True, buckets: int = BUCKETS) -> None:
    """Commit a batch of vectors (row, layer, position, vec) to the store at `path`.

    Rows whose key the store has replace it; other rows stay. A batch may come in any
    number of tasks and again after a failure. Of a key that repeats inside a batch one row
    is kept, the same in every run. `buckets` counts for the first batch. Commits are ordered
    by the clock of the driver that writes them.
    """
    spark = df.sparkSession
    out = df.withColumn("vec", half_precision("vec")) if half else df
    stamped = out.withColumn(_COMMIT, F.lit(time.time_ns()))
    held = _layout(spark, path)
    if held is None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stamped.schema)
        spark.createDataFrame([(buckets, columns)], "buckets int, columns string").coalesce(1).write.parquet(f"{path}/_layout")
        held = buckets, columns
    buckets, columns = held
    name = _registered(spark, path, buckets, columns)
    names = spark.table(name).columns
    first = Window.partitionBy(*KEY).orderBy(F.xxhash64("vec"))
    placed = stamped.select(*names).repartition(buckets, "row").withColumn("_k", F.row_number().over(first))
    batch = placed.where("_k = 1").drop("_k").write.mode("append").format("parquet").partitionBy("layer")
    batch.bucketBy(buckets, "row").sortBy("row").saveAsTable(name)


def read_vectors(spark: SparkSession, path: str, layers: Sequence[int] = ()) -> DataFrame:
    """The last commit of every key. Reading one layer touches only that layer's folder."""
    held = _layout(spark, path)
    if held is None:
        raise ValueError(f"no vector store at {path}")
    table = spark.table(_registered(spark, path, *held))
    if layers:
        table = table.where(F.col("layer").isin([int(x) for x in layers]))
    last = Window.partitionBy(*KEY).orderBy(F.desc(_COMMIT))
    return table.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", _COMMIT)


def compact(spark: SparkSession, path: str, to: str, *, buckets: int = BUCKETS) -> None:
    """Write a store's current rows as one commit of a new store."""
    write_vectors(read_vectors(spark, path), to, half=False, buckets=buckets)


def shape_faults(vectors: DataFrame, *, n_rows: int, d_model: int) -> DataFrame:
    """(layer, position) slices whose row count or vector width is off."""
    slices = vectors.groupBy("layer", "position").agg(
        F.count("*").alias("n_rows"),
        F.min(F.size("vec")).alias("min_width"),
        F.max(F.size("vec")).alias("max_width"),
    )
    return slices.where(
        (F.col("n_rows") != n_rows) | (F.col("min_width") != d_model) | (F.col("max_width") != d_model)
    )
