"""Content checksums, run manifest and run-size metadata."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossblock.session import cut


def row_hash(columns: list[str]) -> Column:
    """60 bits of md5 over the row as text; any engine can recompute it."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *marked)), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-insensitive checksum of a table in one aggregate: xor, sum and count."""
    hashed = df.select(row_hash(columns or df.columns).alias("h"))
    return hashed.agg(
        F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.count("*").alias("n_rows"),
    )


def file_digests(spark: SparkSession, path: str, columns: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Checksum of every file of a Parquet table: file, bytes, modified, hash_xor, hash_sum, n_rows.

    `columns` fixes what is hashed, partition columns included; without it these are the table's
    at the time. `only` names files to read instead of all. A table's own checksum is `merged`.
    """
    table = spark.read.parquet(path) if only is None else spark.read.option("basePath", path).parquet(*only)
    at = F.col("_metadata")
    hashed = table.select(
        at["file_path"].alias("file"),
        at["file_size"].alias("bytes"),
        at["file_modification_time"].alias("modified"),
        row_hash(columns or table.columns).alias("h"),
    )
    return hashed.groupBy("file").agg(
        F.max("bytes").alias("bytes"),
        F.max("modified").alias("modified"),
        F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"),
        F.count("*").alias("n_rows"),
    )


def merged(digests: DataFrame) -> DataFrame:
    """The checksum of the whole table, as `fingerprint` makes it, from its files' checksums."""
    return digests.agg(
        F.bit_xor("hash_xor").alias("hash_xor"),
        F.sum("hash_sum").cast("decimal(38,0)").cast("string").alias("hash_sum"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
    )


def changed_files(saved: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Files of the table at `path` that are not as `saved` (file_digests) has them.

    Only files of another size or time than saved, and new ones, are read. `change` is altered,
    added or removed; the checksum is the one that the file has now (of a removed file, had). A
    file without rows has no checksum and is not listed.
    """
    spark = saved.sparkSession
    # The listing reads no contents.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    now = listed.select(F.col("path").alias("file"), F.col("length").alias("_bytes"), F.col("modificationTime").alias("_modified"))
    now = now.withColumn("_there", F.lit(True))
    both = cut(saved.withColumn("_known", F.lit(True)).join(now, "file", "full"))
    same = F.col("_known") & F.col("_there") & (F.col("bytes") == F.col("_bytes")) & (F.col("modified") == F.col("_modified"))
    suspects = [r["file"] for r in both.where(F.col("_there") & ~F.coalesce(same, F.lit(False))).select("file").toLocalIterator()]
    gone = both.where(F.col("_there").isNull()).select(F.lit("removed").alias("change"), "file", "hash_xor", "hash_sum", "n_rows")
    if not suspects:
        return gone
    fresh = file_digests(spark, path, columns, suspects).select(
        "file", *[F.col(c).alias(f"_{c}") for c in ("hash_xor", "hash_sum", "n_rows")]
    )
    held = both.where("_there").select("file", "_known", "hash_xor", "hash_sum", "n_rows").join(fresh, "file")
    equal = F.col("_known") & (F.col("hash_xor") == F.col("_hash_xor")) & (F.col("hash_sum") == F.col("_hash_sum")) & (
        F.col("n_rows") == F.col("_n_rows")
    )
    differing = held.where(~F.coalesce(equal, F.lit(False))).select(
        F.when(F.col("_known"), "altered").otherwise("added").alias("change"), "file",
        F.col("_hash_xor").alias("hash_xor"), F.col("_hash_sum").alias("hash_sum"), F.col("_n_rows").alias("n_rows"),
    )
    return differing.unionByName(gone)


def config_hash(config: Mapping[str, Any]) -> str:
    text = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(
    spark: SparkSession,
    *,
    command: str,
    config: Mapping[str, Any],
    artifacts: Mapping[str, DataFrame],
    payload: Mapping[str, Any],
    caller: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row: command, config and its hash, a checksum per artifact, counts.

    `caller` carries strings we cannot know, such as a source revision.
    """
    head = spark.range(1).select(
        F.lit(command).alias("command"),
        F.lit(json.dumps(config, sort_keys=True, default=str)).alias("config"),
        F.lit(config_hash(config)).alias("config_sha256"),
        F.lit(json.dumps(payload, sort_keys=True, default=str)).alias("payload"),
        *[F.lit(v).alias(k) for k, v in (caller or {}).items()],
    )
    return head.withColumn(
        "artifacts",
        F.struct(
            *[
                fingerprint(df).select(F.struct("*")).scalar().alias(name)
                for name, df in artifacts.items()
            ]
        ),
    )


def write_manifest(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def run_size(behavior: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows, blocks, layers and vector width of a run."""
    blocks = behavior.groupBy("block_id").agg(F.count("*").alias("n"))
    sized = blocks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_blocks")
    )
    layers = vectors.groupBy("layer").agg(F.max(F.size("vec")).alias("d"))
    shape = layers.agg(F.count("*").alias("n_layers"), F.max("d").alias("d_model"))
    return sized.withColumn("_s", shape.select(F.struct("*")).scalar()).select(
        "n_rows", "n_blocks", F.col("_s.n_layers").alias("n_layers"), F.col("_s.d_model").alias("d_model")
    )
