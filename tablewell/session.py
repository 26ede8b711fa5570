"""Spark sessions for stores, and for queries of tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What results depend on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "tablewell") -> SparkSession:
    """The running session, or a new one, with the settings above."""
    spark = SparkSession.builder.appName(app).getOrCreate()
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def tenant_session(spark: SparkSession) -> SparkSession:
    """A session of its own: own views, double-quoted identifiers, no files by path."""
    own = spark.newSession()
    for key, value in {**SETTINGS, "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false"}.items():
        own.conf.set(key, value)
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, as the cluster names it; ValueError where it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def fixed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder, with their lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
