"""Table reads by name, and the shared folder that cuts lineage."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quizloom_shipped", False):
        return
    home = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quizloom-")
    ignore = shutil.ignore_patterns("__pycache__")
    shutil.copytree(home, Path(folder, "tree", home.name), ignore=ignore)
    context.addPyFile(shutil.make_archive(f"{folder}/{home.name}", "zip", f"{folder}/tree"))
    context._quizloom_shipped = True


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; column pruning and filters reach the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if the input has fewer splits than there are cores; else as they are.

    For work that takes far longer a row than moving it. A large input has splits enough and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores)


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the cluster's own (spark.checkpoint.dir) if it names one.

    Only a local session that names none (a test on one machine) gets a temporary folder; on a cluster a folder of the
    driver alone would be of no use to the executors, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="quizloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
