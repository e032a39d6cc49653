"""Changes of keyed observations, as they arrive or over a finished table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedupe import first_wins
from ..operators.history import with_previous
from ..sources.store import StateStore
from .watch import stream_id

OBSERVED = ("key", "ts", "seq", "cost", "flag", "active")
CHANGE_DDL = (
    "key string, ts timestamp, seq long, cost double, previous_cost double, "
    "is_new boolean, dropped boolean, gained boolean, relisted boolean"
)
# ``name`` stands for the key and is never null.
_LAST_DDL = "name string, key string, ts timestamp, seq long, cost double, flag boolean, active boolean"


def last_rows(spark: SparkSession, location: str, compact_after: int = 50) -> StateStore:
    """The table of each key's last observation, as versions in a folder."""
    return StateStore(spark, location, compact_after, schema=T.StructType.fromDDL(_LAST_DDL), key=("name",))


def diff_stream(
    observations: DataFrame, store: StateStore, out: str, checkpoint: str, available_now: bool = True, ranges: int | None = None
):
    """``key, ts, seq, cost, flag, active`` to one change row per observation, written below ``out``.

    Each micro-batch is joined to ``store`` (see :func:`last_rows`) by its keys; a key's rows follow its last known
    one in the order of ts and seq (nulls first). Micro-batches follow each other as they arrive, so a late row is
    compared with what was known when it came. No task holds a key: windows run inside ranges.

    A batch's changes are in a folder of its own; then its last rows are published. A batch that is replayed
    writes the same folder again if they were not, and does nothing if they were.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch, checkpoint)
        named = {"stream": stream, "batch": batch_id, "step": "rows"}
        if store.find(**named):
            return
        base = store.version()
        fresh = batch.select(F.to_json(F.struct("key")).alias("name"), *OBSERVED, F.lit(True).alias("fresh"))
        known = store.read(base).join(fresh.select("name").distinct(), "name", "left_semi")
        rows = known.select("name", *OBSERVED, F.lit(False).alias("fresh")).unionByName(fresh)
        order = ["fresh", "ts", "seq"]
        linked = with_previous(rows, ["name"], order, ["cost", "flag", "active"], ranges=ranges)
        linked.filter("fresh").select(*_changes()).write.mode("overwrite").parquet(f"{out}/stream={stream}/batch={batch_id}")
        last = first_wins(linked.filter("fresh"), ["name"], [F.desc("ts"), F.desc("seq")])
        store.write(last, **named, based_on=base)

    writer = observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """All changes written so far, with the ``stream`` and ``batch`` that brought them."""
    schema = f"{CHANGE_DDL}, stream string, batch long"
    return spark.read.schema(schema).parquet(out)


def batch_changes(observations: DataFrame, ranges: int | None = None) -> DataFrame:
    """The same over a finished table."""
    rows = with_previous(observations, ["key"], ["ts", "seq"], ["cost", "flag", "active"], ranges=ranges)
    return rows.select(*_changes())


def _changes() -> list[Column]:
    """The change that a row with ``prev_`` columns and ``is_first`` is."""
    known = ~F.col("is_first")
    drop = known & (F.col("prev_cost") != 0) & (F.col("cost") != 0) & (F.col("cost") < F.col("prev_cost"))
    return [
        F.col("key"),
        F.col("ts"),
        F.col("seq"),
        F.col("cost"),
        F.col("prev_cost").alias("previous_cost"),
        F.col("is_first").alias("is_new"),
        F.coalesce(drop, F.lit(False)).alias("dropped"),
        (known & F.coalesce("flag", F.lit(False)) & ~F.col("prev_flag").eqNullSafe(True)).alias("gained"),
        (known & F.coalesce("active", F.lit(False)) & ~F.coalesce("prev_active", F.lit(False))).alias("relisted"),
    ]
