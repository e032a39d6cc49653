"""What the corpus operators share: the session's set-up, staged tables, clash-free columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.cluster import ship

ROWS_PER_BATCH = 1_000
BYTES_PER_BATCH = 8 << 20
STRETCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Send the library to the workers and keep Arrow batches small, whatever a text's length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder all executors share, below spark.checkpoint.dir; only a local session may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """The frame written once as a table in the shared folder and read again: it survives lost executors."""
    folder = shared_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def with_row(frame: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's names, and all others in one struct ``row``, so that no names clash."""
    rest = [F.col(f"`{c}`") for c in frame.columns if c not in columns.values()]
    picked = [F.col(f"`{source}`").alias(name) for name, source in columns.items()]
    return frame.select(*picked, F.struct(*(rest or [F.lit(0).alias("_none")])).alias("row"))


def without_row(frame: DataFrame, names: list[str], **columns: str) -> DataFrame:
    """Undo :func:`with_row`: the columns ``names`` in their order."""
    own = {source: name for name, source in columns.items()}
    return frame.select(*[F.col(own[c]).alias(c) if c in own else F.col(f"row.`{c}`").alias(c) for c in names])


def one_each(rows: DataFrame, *by: str) -> DataFrame:
    """Of the rows (text, row) alike in ``by`` one: the first by text, then by its other columns written as JSON."""
    first = F.min_by(F.struct("text", "row"), F.struct("text", F.to_json("row")))
    return rows.groupBy(*by).agg(first.alias("_one")).select(*by, "_one.*")


def appended(frame: DataFrame, make: Callable, added: str) -> DataFrame:
    """Columns added batch by batch: ``make()`` runs once a task and returns a function from a batch to arrays."""
    extra = T.StructType.fromDDL(added)
    schema = T.StructType(frame.schema.fields + extra.fields)
    names = schema.names

    def work(batches):
        columns = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns(batch)], names)

    return frame.mapInArrow(work, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def stretches(text: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in stretches of about ``size`` bytes, cut at white space: the words of a very long text a few at a time."""
    at, size = 0, size or STRETCH_BYTES
    while len(text) - at > size:
        found = _BLANK.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def crc_bucket(column: str, divisor: int):
    """The remainder of crc32 of an id written as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
