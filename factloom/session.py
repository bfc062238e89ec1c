"""The Spark session that the command line and the benchmark use, and tables between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    A folder of our own is used only where the session names none and runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/factloom-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its plan cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session(master: str | None = None, **conf: str) -> SparkSession:
    """ANSI mode and UTC, adaptive plans with skew handling; a cluster's own settings are left alone otherwise."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName("factloom").config(map=base | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
