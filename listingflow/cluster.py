"""Sending the library to the Python workers of a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import listingflow


def ship(spark: SparkSession) -> None:
    """Send the library to the Python workers once, as ``--py-files`` would."""
    context = spark.sparkContext
    if not getattr(context, "_library_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(listingflow.__file__)))
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.addPyFile(shutil.make_archive(f"{folder}/listingflow", "zip", root, "listingflow"))
        context._library_shipped = True


PAGES_PER_BATCH = 250
BYTES_PER_BATCH = 8 << 20
BYTES_PER_METHOD = 8_000


def for_pages(spark: SparkSession) -> None:
    """Pages may be large, so the Python workers get few at a time; smaller limits that are set stay.

    Records are made by many expressions: of more than 8,000 bytes of code the JVM compiles none, so Spark is
    to make smaller methods of them.
    """
    most = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": PAGES_PER_BATCH,
        "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_PER_BATCH,
        "spark.sql.codegen.hugeMethodLimit": BYTES_PER_METHOD,
    }
    for key, limit in most.items():
        now = int(str(spark.conf.get(key)).lower().rstrip("b"))
        if now <= 0 or now > limit:
            spark.conf.set(key, str(limit))
