"""Cutting lineage reliably: in the shared folder the cluster names, or one the caller set."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Point the context at the configured folder; one that is already set stays.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, survives lost executors.

    It also stops the optimiser from pushing later filters down into long chains of derived
    columns, where substituting every alias makes the expressions explode.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder below which results may be kept that all executors read: the configured one, or the context's."""
    prepare(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.removeprefix("file:").rstrip("/") if folder.startswith("file:/") else folder.rstrip("/")
