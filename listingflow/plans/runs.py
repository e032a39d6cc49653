"""Whole runs: assess a batch, then announce incrementally (watch) or from scratch (backfill)."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..operators import classify as C
from ..operators.dedupe import content_fingerprint, first_wins, mark_duplicates
from ..operators.outbox import announce, backfill_top_n, message
from ..operators.score import add_proximity
from ..operators.state import mark_notified, pending, upsert
from ..functions.text import blank_to_null, normalize_spelling
from ..schema import KEY, conform_columns, record_schema
from ..sources.store import RunLog, StateStore

ORDER = ("source_ord", "page_id", "strategy", "pos")


@dataclass(frozen=True)
class Rules:
    # The places and limits a run uses unless told otherwise.
    allowlist: dict[str, set[str]] = field(
        default_factory=lambda: {
            "新北市": {"永和區", "新店區"},
            "台北市": {"信義區", "大安區", "文山區", "中山區", "大同區", "松山區", "萬華區"},
        }
    )
    max_rent: int = 18_600
    min_area: float = 6.0
    suite_only: bool = True
    exclude_female_only: bool = True
    proximity: bool = True
    watch_limit: int = 50
    max_results: int = 20


def assess(
    records: DataFrame,
    rules: Rules,
    order: tuple[str, ...] = ORDER,
    labels: DataFrame | None = None,
    commute: DataFrame | None = None,
) -> DataFrame:
    """Extracted records to state rows: flags, reasons, status, score, duplicates marked.

    Rejected records keep their reasons and do not claim a fingerprint.
    """
    carried = [c for c in order if c in records.columns]
    shaped = [f.name for f in record_schema().fields]
    base = records.select(*carried, *conform_columns(records))
    flagged = C.apply_classification(C.classify(base, labels))
    scored = add_proximity(flagged, commute, rules.proximity)
    place_ok = C.allowed_place(
        blank_to_null(normalize_spelling(F.col("city"))),
        blank_to_null(normalize_spelling(F.col("district"))),
        rules.allowlist,
    )
    reasons = C.reject_reasons(
        place_ok, rules.max_rent, rules.min_area, rules.suite_only, rules.exclude_female_only
    )
    routed = C.route(scored, reasons).withColumn(
        "dedupe_fingerprint", F.when(F.col("status") == "active", content_fingerprint())
    )
    # Read twice by the marking; everything up to here is computed once.
    marked = mark_duplicates(cut(routed), "dedupe_fingerprint", carried or list(KEY))
    return marked.select(*carried, *shaped)


@dataclass
class WatchResult:
    outbox: DataFrame
    summary: DataFrame


def ingest(store: StateStore, assessed: DataFrame, now: datetime) -> int:
    """Upsert a batch; reads the matching state rows and writes only the batch's rows."""
    # Used twice below and costly to derive from pages, so it is materialised once.
    order = [F.col(c) for c in ORDER if c in assessed.columns]
    unique = first_wins(assessed, KEY, order or [F.to_json(F.struct(*assessed.columns))])
    batch = cut(unique.drop(*[c for c in ORDER if c in assessed.columns]))
    base = store.version()
    merged = upsert(store.read(base), batch, F.lit(now), full=False)
    return store.write(merged, "changes" if base else "whole", based_on=base)


def watch(store: StateStore, rules: Rules, state: DataFrame | None = None) -> WatchResult:
    """What the current state has to announce, ordered and cut, with the run's summary.

    ``state``: the state's rows, or at least all pending ones, where they are at hand.
    """
    top, summary = announce(pending(store.read() if state is None else state), min(rules.watch_limit, rules.max_results), rules.max_rent)
    return WatchResult(top.withColumn("message", message(show_proximity=rules.proximity)), summary)


def deliver(store: StateStore, delivered: DataFrame, at: datetime, log: RunLog | None = None) -> int:
    """Mark what was really delivered; the rest stays pending for the next run."""
    base = store.version()
    n = store.write(mark_notified(store.read(base), delivered, F.lit(at), full=False), based_on=base)
    if log is not None:
        log.record("watch", at)
    return n


def backfill(assessed: DataFrame, rules: Rules) -> DataFrame:
    """The best accepted records of this batch, whether or not announced before."""
    accepted = assessed.filter(
        (F.col("status") == "active") & ~F.coalesce("possible_duplicate", F.lit(False))
    )
    return backfill_top_n(accepted, rules.max_results, rules.max_rent)
