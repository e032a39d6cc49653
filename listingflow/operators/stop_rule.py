"""How deep a search was worth paging, replayed over all fetched pages at once."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoint import cut

BLOCK_ROWS = 1_000_000


def kept_pages(
    records: DataFrame,
    pages: DataFrame,
    key: Sequence[str],
    misses: int | Column = 1,
    with_end: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``search, page, n_parsed, n_new, kept`` for every fetched page (``with_end``: and ``ended``, its search's last).

    ``pages``: search, page (0, 1, 2, … per search; searches run in order of their value)
    and n_parsed, the number of records read from the page; a page with none ends its
    search, and so do ``misses`` pages in a row without a new record (a number, or one of each row of ``pages``). ``records``: search,
    page and the key columns of the records that count. New is what no kept page before it,
    in any search, has shown.

    Which pages are kept depends on what earlier pages showed. Searches are dealt in their
    order into blocks of about ``block_rows`` rows. A task walks its block page by page, so
    that searches of one block that depend on each other, however many, are settled in one
    reading. Between blocks only first showings travel: after a reading, a record is marked
    where an earlier block has shown it on a kept page, and only blocks whose marks changed
    are walked again. Each round settles at least one more block, so there are at most as
    many rounds as blocks, and one where everything fits one block.
    """
    name = F.unhex(F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256))
    listed = pages.select("search", "page").distinct()
    # A search shows a record from the first of its pages on that has it: one row each, whatever the pages.
    shown = records.join(listed.hint("merge"), ["search", "page"], "left_semi").groupBy("search", name.alias("id")).agg(F.min("page").alias("page"))
    allowed = F.lit(misses) if isinstance(misses, int) else misses
    asked = pages.groupBy("search", "page").agg(F.min("n_parsed").cast("long").alias("n_parsed"), F.min(allowed).cast("int").alias("misses"))
    rows = shown.select("search", "page", "id").unionByName(asked.withColumn("id", F.lit(None).cast("binary")), allowMissingColumns=True)
    rows = cut(rows)
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.repartitionByRange(blocks, "search").withColumn("block", F.spark_partition_id())
    marked = cut(dealt.withColumn("before", F.lit(False)))
    walked = cut(_walk(marked, blocks))
    while blocks > 1:  # at most one round a block
        first = walked.filter("id IS NOT NULL").groupBy("id").agg(F.min("block").alias("_first"))
        now = F.coalesce(F.col("_first") < F.col("block"), F.lit(False))
        again = cut(marked.join(first, "id", "left").withColumn("_now", now).drop("_first"))
        moved = [r["block"] for r in again.filter("_now <> before").select("block").distinct().collect()]
        if not moved:
            break
        marked = again.drop("before").withColumnRenamed("_now", "before").select(*marked.columns)
        redone = _walk(marked.filter(F.col("block").isin(moved)), blocks)
        walked = cut(walked.filter(~F.col("block").isin(moved)).unionByName(redone))
    done = walked.filter("id IS NULL").select("search", "page", "n_new", "kept", "ended")
    out = pages.select("search", "page", "n_parsed").join(done.hint("merge"), ["search", "page"])
    return out.select("search", "page", "n_parsed", "n_new", "kept", *(["ended"] if with_end else []))


def _walk(marked: DataFrame, blocks: int) -> DataFrame:
    """Each block's pages in order: a row per page, and one per record (``id``) that is new on a kept page."""
    search = marked.schema["search"]
    schema = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("search", search.dataType), T.StructField("page", marked.schema["page"].dataType)]
        + [T.StructField("n_new", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("ended", T.BooleanType())]
        + [T.StructField("id", T.BinaryType())]
    )
    columns = ["block", "search", "page", "n_parsed", "misses", "id", "before"]
    ordered = marked.select(*columns).repartition(blocks, "block").sortWithinPartitions("block", "search", "page")
    return ordered.mapInArrow(_pages_of(), schema)


def _pages_of():
    names = ["block", "search", "page", "n_new", "kept", "ended", "id"]

    def work(batches):
        out: list[tuple] = []
        place, held, seen, over, run, kinds = None, [], set(), False, (0, None), None

        def close():
            """The page that was read last."""
            nonlocal over, run
            block, search, page = place
            parsed, misses = [(n, m) for n, m, i, _ in held if i is None][0]
            kept, ends, n_new = not over, False, 0
            if kept:
                new = [i for _, _, i, before in held if i is not None and not before and i not in seen]
                seen.update(new)
                out.extend((block, search, page, None, None, None, i) for i in new)
                n_new = len(new)
                miss = parsed is not None and parsed > 0 and not n_new
                run = (run[0] + 1 if miss and run[1] == page - 1 else int(miss), page if miss else None)
                ends = over = parsed == 0 or run[0] >= misses
            out.append((block, search, page, n_new, kept, ends, None))

        def batch_of():
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            of = {c: batch.schema.field(c).type for c in ("block", "search", "page", "id")}
            kinds = [of["block"], of["search"], of["page"], pa.int64(), pa.bool_(), pa.bool_(), of["id"]]
            values = (batch.column(c).to_pylist() for c in ("block", "search", "page", "n_parsed", "misses", "id", "before"))
            for block, search, page, parsed, misses, i, before in zip(*values, strict=True):
                if place != (block, search, page):
                    if place is not None:
                        close()
                        if place[0] != block:
                            seen = set()
                        if place[:2] != (block, search):
                            over, run = False, (0, None)
                    place, held = (block, search, page), []
                held.append((parsed, misses, i, before))
            if len(out) > 10_000:
                yield batch_of()
                out.clear()
        if place is not None:
            close()
            yield batch_of()

    return work
