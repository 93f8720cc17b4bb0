"""Tables: reading, durable intermediate results, keyed upserts, appends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session has none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpuscle-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps don't repeat the earlier ones."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the last in order."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """``old`` after the rows of ``new``: new keys are added, of known keys only the columns of ``replaced`` change."""
    n = new.select(*[F.col(c).alias(f"__{c}") for c in new.columns], F.lit(True).alias("__new"))
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = old.withColumn("__old", F.lit(True)).join(n, match, "full_outer")

    def column(c: str):
        if c in replaced:
            return F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
        return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}"))

    return met.select(*[column(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it doesn't have; the first of repeated new keys counts."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)
    return old.unionByName(fresh)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def swap_in(df: DataFrame, base: str, version: int) -> str:
    """Writes a table version beside the one that is read, and returns its path."""
    path = f"{base.rstrip('/')}/v{version}"
    df.write.mode("errorifexists").parquet(path)
    return path
