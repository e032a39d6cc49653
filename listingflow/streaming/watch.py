"""The watch loop as micro-batches over newly arriving pages or records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..operators.dedupe import first_wins
from ..operators.gazetteer import Gazetteer, PlaceTable
from ..operators.state import mark_notified, pending, upsert
from ..plans.runs import ORDER, Rules, assess, watch
from ..schema import KEY, conform
from ..sources.registry import extract_all
from ..sources.store import StateStore, StateView, write_outbox

Deliver = Callable[[DataFrame, int], DataFrame]
Records = DataFrame | tuple[DataFrame, DataFrame]
OUTBOX_DDL = "source string, listing_id string, priority int, position int, reasons array<string>, message string"


def page_batches(gazetteer: Gazetteer | PlaceTable, rules: Rules) -> Callable[[DataFrame], Records]:
    """Micro-batch of pages to assessed records and refused pages."""

    def step(pages: DataFrame) -> Records:
        records, refused = extract_all(pages, gazetteer)
        return assess(records, rules), refused

    return step


def stream_id(batch: DataFrame, checkpoint: str) -> str:
    """The query's id, which its checkpoint keeps: another checkpoint is another stream."""
    return batch.sparkSession.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def watch_stream(
    source: DataFrame,
    store: StateStore,
    outbox: str,
    checkpoint: str,
    rules: Rules,
    to_records: Callable[[DataFrame], Records],
    deliver: Deliver | None = None,
    available_now: bool = True,
    quarantine: str | None = None,
):
    """Ingest each micro-batch, write what it made announceable, mark what was delivered.

    ``to_records`` turns a micro-batch into assessed records, or these and the refused pages, which go
    to ``quarantine``. ``deliver`` gets the outbox and the batch id and returns the keys that went out;
    without it nothing is marked, and everything stays pending.

    Each step is published once under the query's id and the batch's number. A batch that is replayed
    does only the steps not yet published: its rows are not applied twice, its outbox is the one already
    written, so ``deliver`` gets the same records again, and its marks are made once.

    What is pending is a view kept beside the state: announcing and marking read it and the batch's rows,
    not the state.
    """
    spark = source.sparkSession
    view = StateView(store, "pending", pending)

    def run(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch, checkpoint)
        named = {"stream": stream, "batch": batch_id}
        place = f"stream={stream}/batch={batch_id}"
        if not store.find(**named, step="rows"):
            found = to_records(batch)
            rows, refused = found if isinstance(found, tuple) else (found, None)
            if refused is not None and quarantine is not None:
                refused.write.mode("overwrite").json(f"{quarantine}/{place}")
            order = [F.col(c) for c in ORDER if c in rows.columns]
            # Without a column that says which came first, the row's own text decides.
            unique = first_wins(rows, KEY, order or [F.to_json(F.struct(*rows.columns))])
            # Read twice by the incremental upsert, so it is computed once.
            unique = cut(conform(unique))
            base = store.version()
            merged = upsert(store.read(base), unique, F.current_timestamp(), full=False)
            store.write(merged, **named, step="rows", based_on=base)
        folder = f"{outbox}/{place}"
        if not store.find(**named, step="outbox"):
            result = watch(store, rules, view.refresh())
            columns = [f.split()[0] for f in OUTBOX_DDL.split(", ")]
            # Overwrites only what a failed attempt left: nothing was delivered from it.
            write_outbox(result.outbox.select(*columns), folder)
            store.publish("step", **named, step="outbox")
        if deliver is not None and not store.find(**named, step="marks"):
            sent = deliver(spark.read.schema(OUTBOX_DDL).json(folder), batch_id)
            # What was announced is pending, so the view holds the whole rows to be marked.
            base = store.version()
            marked = mark_notified(view.refresh(), sent, F.current_timestamp(), full=False)
            store.write(marked, **named, step="marks", based_on=base)

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def first_seen_stream(source: DataFrame, key: Sequence[str], ts: str, horizon: str) -> DataFrame:
    """Each key once; keys are remembered for ``horizon`` of event time."""
    return source.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(key))


def unseen(batch: DataFrame, state: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The exact form: keys the state has never held."""
    return batch.join(state.select(*key), list(key), "left_anti")


def session_stream(source: DataFrame, key: Sequence[str], ts: str, gap: str, late: str) -> DataFrame:
    """Activity sessions per key, emitted once the watermark has passed their gap."""
    return (
        source.withWatermark(ts, late)
        .groupBy(*key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("observations"))
        .select(*key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "observations")
    )


