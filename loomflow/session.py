"""Session helpers shared by the tests, the benchmark and the driver entry."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, partitions: int = 8, app: str = "loomflow") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOOMFLOW_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the repository folder.

    On a cluster the package is shipped with ``--py-files``; there this adds a
    path that does not exist, which Python ignores.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder; any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
