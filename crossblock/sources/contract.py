"""The cell table on disk: 17 columns with fixed names, order and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "block_id": T.StringType(),
    "relation_family": T.StringType(),
    "dataset_tier": T.ByteType(),
    "cell": T.StringType(),
    "q_index": T.ByteType(),
    "a_index": T.ByteType(),
    "question_id": T.StringType(),
    "answer_id": T.StringType(),
    "subject": T.StringType(),
    "question": T.StringType(),
    "answer": T.StringType(),
    "matched": T.BooleanType(),
    "correct": T.BooleanType(),
    "answer_source": T.StringType(),
    "policy_status": T.StringType(),
    "template_id": T.StringType(),
    "split": T.StringType(),
}
CELL_COLUMNS = list(_TYPES)
CELL_SCHEMA = T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])


class ContractError(ValueError):
    """A file does not follow the cell contract."""


def check_contract(df: DataFrame) -> DataFrame:
    if df.columns != CELL_COLUMNS:
        raise ContractError(f"columns {df.columns} are not those of the contract")
    drifted = [
        f"{f.name}: {f.dataType.simpleString()}"
        for f in df.schema
        if f.dataType != _TYPES[f.name]
    ]
    if drifted:
        raise ContractError(f"columns of another type than in the contract: {drifted}")
    return df


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Names, order and types are refused here; missing values are a validation rule."""
    return check_contract(spark.read.parquet(path))


def to_cells(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in _TYPES.items()])


def write_cells(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    to_cells(df).write.mode(mode).option("compression", "zstd").parquet(path)


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result tables: behaviour, sweeps, summaries, conditions, scores."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
