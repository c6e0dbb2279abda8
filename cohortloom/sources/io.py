"""Tables in and out. Parquet and CSV only reach Spark's own readers, so pruning and filters go to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True) -> DataFrame:
    """CSV with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", header).csv(path)


def write(df: DataFrame, path: str, kind: str = "parquet", header: bool = False) -> None:
    df.write.csv(path, header=header) if kind == "csv" else df.write.parquet(path)


def realizations(df: DataFrame, versions: Sequence[DataFrame], key: str, column: str) -> tuple[DataFrame, list[str]]:
    """Versions of an uncertain column as columns `column_0`, `column_1`, ... : one shuffle of all versions by key, one join."""
    names = [f"{column}_{i}" for i in range(len(versions))]
    long = None
    for i, v in enumerate(versions):
        one = v.select(F.col(key), F.lit(i).alias("_i"), F.col(column).alias("_v"))
        long = one if long is None else long.unionByName(one)
    wide = long.groupBy(key).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)])
    return df.join(wide, key, "left"), names


def system_version(spark: SparkSession) -> dict[str, str]:
    import platform

    return {"spark": spark.version, "python": platform.python_version(), "system": platform.platform(), "parallelism": str(spark.sparkContext.defaultParallelism)}
