"""Record state on disk: immutable versions, published one number at a time.

Data goes to a folder of the attempt's own (``data/<attempt>``). A version exists once its manifest does (``log``):
a finished manifest takes its number, which fails if the number is taken. So a crashed write leaves nothing that is
read, two writers cannot take one number, and a version never changes.

A version is a whole snapshot or the rows one run changed. A whole one says up to which number it
covers; reading folds the newest one with all changes after that number, so a batch that commits while
a snapshot is made is kept. Steps of a stream carry its query's id, the batch and the step's name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedupe import first_wins
from ..schema import KEY, RUN_LOG_DDL, record_schema
from .log import Files, Version, VersionExpired, VersionLog, VersionTaken


class StateStore:
    """``compact_after`` changes since the last snapshot make a write fold them into a new one.

    ``only`` picks the rows that a snapshot keeps, if not all (see :class:`StateView`). ``schema`` and ``key``
    are those of listing records if not said otherwise; keys must not be null.
    """

    def __init__(
        self, spark: SparkSession, location: str, compact_after: int = 50, only: Callable[[DataFrame], DataFrame] | None = None,
        put_if_absent: Callable[[str, bytes], bool] | None = None, schema: T.StructType | None = None, key: Sequence[str] = KEY,
    ) -> None:
        self.spark = spark
        self.schema = schema or record_schema()
        self.key = list(key)
        self.location = location.rstrip("/")
        self.compact_after = compact_after
        self.only = only
        self.put_if_absent = put_if_absent
        self.log = VersionLog(Files(self.location, put_if_absent))

    def versions(self) -> list[Version]:
        """Every version whose manifest is kept, oldest first."""
        return self.log.all()

    def version(self) -> int:
        return self.log.latest().number

    def _data(self, attempt: str) -> str:
        return f"{self.location}/data/{attempt}"

    def read(self, upto: int | None = None) -> DataFrame:
        """Newest whole snapshot, its changed keys replaced by their newest change.

        Only the changes are folded, in one scan. The snapshot is merely anti-joined to their keys, so
        it is not shuffled while those fit a broadcast, and filters and column lists reach its scan.
        """
        state = self.log.latest() if upto is None else self.log.at(upto)
        whole, changes = state.whole, state.changes
        reader = self.spark.read.schema(self.schema)
        snapshot = reader.parquet(self._data(whole.attempt)) if whole else None
        if not changes:
            return snapshot if whole else self.spark.createDataFrame([], self.schema)
        newest = reader.parquet(*[self._data(v.attempt) for v in changes])
        if len(changes) > 1:
            numbers = F.create_map(*[F.lit(x) for v in changes for x in (v.attempt, v.number)])
            attempt = F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]+)/", 1)
            newest = first_wins(newest.withColumn("_version", numbers[attempt]), self.key, [F.desc("_version")]).drop("_version")
        if not whole:
            return newest
        untouched = snapshot.join(newest.select(*self.key), self.key, "left_anti")
        return untouched.select(*newest.columns).unionByName(newest)

    def rows_of(self, version: Version) -> DataFrame:
        """The rows that one version wrote."""
        return self.spark.read.schema(self.schema).parquet(self._data(version.attempt))

    def find(self, stream: str, batch: int, step: str) -> Version | None:
        """The published step of a stream's micro-batch, if it was published.

        Batches come in order, so of a batch before the stream's newest every step was.
        """
        steps = self.log.latest().streams.get(stream, {})
        newest = max((v.batch for v in steps.values()), default=-1)
        return next(iter(steps.values())) if batch < newest else steps.get(step) if batch == newest else None

    def write(
        self, rows: DataFrame, kind: str = "changes", stream: str | None = None, batch: int | None = None,
        step: str | None = None, based_on: int | None = None,
    ) -> int:
        """Write rows to a folder of their own and publish them as the next version.

        ``based_on`` is the version the rows were derived from: a newer one makes the write fail, since
        it could undo what that one changed.
        """
        attempt = self._write_data(rows)
        number = self.publish(kind, attempt, stream=stream, batch=batch, step=step, based_on=based_on)
        if len(self.log.latest().changes) >= self.compact_after:
            self.compact()
        return number

    def _write_data(self, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        writer = rows.select(*self.schema.names).write.mode("errorifexists").option("parquet.block.size", 128 * 1024 * 1024)
        writer.parquet(self._data(attempt))
        return attempt

    def publish(
        self, kind: str, attempt: str | None = None, covers: int | None = None, stream: str | None = None,
        batch: int | None = None, step: str | None = None, based_on: int | None = None,
    ) -> int:
        latest = self.version()
        if based_on is not None and latest != based_on:
            raise VersionTaken(f"derived from version {based_on}, but {latest} is published")
        number = latest + 1
        if covers is None:
            covers = number if kind == "whole" else 0
        self.log.publish(Version(number, kind, attempt, covers, stream, batch, step))
        return number

    def compact(self) -> int:
        """Fold all up to now into one snapshot, laid out for pruning by key, and status if it has one; trim the log.

        What other writers publish meanwhile is not covered, and stays in force.
        """
        upto = self.version()
        rows = self.read(upto)
        rows = self.only(rows) if self.only else rows
        attempt = self._write_data(rows.repartition(*self.key).sortWithinPartitions(*[c for c in ["status"] if c in rows.columns], *self.key))
        while True:
            try:
                number = self.publish("whole", attempt, covers=upto)
                break
            except VersionTaken:  # it depends on no number of its own
                continue
        self.log.trim(lambda old: self.log.files.delete(f"data/{old}"))
        return number


class StateView:
    """The rows of a state that ``only`` picks, kept beside it and brought up to date from its log.

    Only keys that a version wrote can enter or leave, so a refresh reads the rows of the versions since the last
    one, never the state; the view's own snapshots hold only picked rows. It starts with one reading of the state,
    and again where the versions it needs are no longer kept.
    """

    def __init__(self, store: StateStore, name: str, only: Callable[[DataFrame], DataFrame]) -> None:
        columns = [f.name for f in record_schema().fields]
        self.store = store
        self.only = lambda rows: only(rows).select(*columns)
        self.own = StateStore(
            store.spark, f"{store.location}/{name}", store.compact_after, self.only, store.put_if_absent
        )

    def _applied(self) -> int:
        steps = self.own.log.latest().streams.get("state", {})
        return max((v.batch for v in steps.values()), default=0)

    def refresh(self) -> DataFrame:
        """The view after the state's newest version; rows that left it since its last snapshot are among them."""
        now, done = self.store.version(), self._applied()
        try:
            new = self.store.log.between(done, now) if done else []
        except VersionExpired:
            done = 0
        # A snapshot that covers itself was written as one; others only fold what was applied already.
        if now and (not done or any(v.kind == "whole" and v.covers == v.number for v in new)):
            self.own.write(self.only(self.store.read(now)), "whole", stream="state", batch=now, step="rows")
        else:
            for v in new:
                if v.kind == "changes":
                    self.own.write(self.store.rows_of(v), stream="state", batch=v.number, step="rows")
        return self.own.read()


class RunLog:
    """Completed runs; appended to, the high-water mark is an aggregate."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark = spark
        self.location = location

    def record(self, pipeline: str, at) -> None:
        self.spark.createDataFrame([(pipeline, at)], RUN_LOG_DDL).coalesce(1).write.mode("append").parquet(
            self.location
        )

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(RUN_LOG_DDL).parquet(self.location)
        except Exception as error:  # nothing recorded yet
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], RUN_LOG_DDL)
            raise


def high_water(run_log: DataFrame) -> DataFrame:
    return run_log.groupBy("pipeline").agg(F.max("completed_at").alias("completed_at"))


def write_outbox(messages: DataFrame, folder: str) -> None:
    """Messages to deliver, as JSON lines in a folder of their own; the sender reports delivered keys back."""
    messages.write.mode("overwrite").json(folder)
