"""URL rules by a sort-merge range join.

A host's canonical key is its labels reversed, each closed by a character below all that hosts use: every host at or
below ``example.com`` has a key that starts with that of ``example.com``, so a rule is an interval of keys. Urls, the
starts of intervals and their ends are dealt into ranges of keys and sorted; a sweep over each range keeps the stack
of rules whose intervals are open, nested by host. An interval that is open across several ranges is handed to each of
them, found by joining its start to its end. The sweep verifies host and path of each candidate.

A salt splits one host, or one url, over several ranges, whatever share of the rows it has. Rules of any number take
part by the same join; none is broadcast.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; what no rule fits gets
the ``default`` verdict. Of several rules that fit, the longest (host and path together) wins, then the longer host, then
the verdict that comes first by name. Rules with a null or empty host fit nothing; a null path counts as empty. Repeated urls are
judged one by one; repeated rules count once. Empty tables give empty results. Other columns never clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import partitions, staged, with_row, without_row

CLOSE = "\x01"
AFTER = "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END, URL = 0, 1, 2


# Everything to the first "://", the host to the first of / ? # or the end, the path to the first of ? # or the end.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def key_of(host: Column) -> Column:
    """The labels reversed, each closed; an empty host has an empty key."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(labels, CLOSE), F.lit(CLOSE)))


def _events(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls, starts and ends in one frame: key, kind, salt, rule's host, path and verdict, url's host and path, row."""
    nothing = F.lit(None).cast("string")
    rows = urls.select(
        key_of(F.col("host")).alias("key"), F.lit(URL).alias("kind"), F.xxhash64("path", "salt").alias("salt"),
        "host", "path", nothing.alias("verdict"), "row",
    )
    key = key_of(F.col("host"))
    bounds = rules.select(
        F.explode(
            F.array(
                F.struct(key.alias("key"), F.lit(START).alias("kind")),
                F.struct(F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit(AFTER)).alias("key"), F.lit(END).alias("kind")),
            )
        ).alias("at"), "host", "path", "verdict",
    )
    bounds = bounds.select("at.key", "at.kind", F.lit(0).cast("long").alias("salt"), "host", "path", "verdict")
    return rows.unionByName(bounds.withColumn("row", F.lit(None).cast(urls.schema["row"].dataType)))


def _sweep(batches):
    """A sorted stream of starts (with those open from before) and urls of one range after the other."""
    part, stack = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "verdict")]
        chosen, keep = [], []
        for i, (own, key, kind, host, path, verdict) in enumerate(zip(*columns, strict=True)):
            if own != part:
                part, stack = own, []
            if kind == START:
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not stack or stack[-1].key != key:
                    stack.append(_Level(key, host))
                stack[-1].add(path, verdict)
                continue
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            best = max((f for level in stack for f in level.fitting(host, path)), default=None, key=_rank)
            chosen.append(best or (None, None, None))
            keep.append(i)
        if keep:
            found = batch.select(["row", "host", "path"]).take(pa.array(keep))
            hosts, paths, verdicts = zip(*chosen, strict=True)
            extra = [pa.array(x, pa.string()) for x in (hosts, paths, verdicts)]
            yield pa.RecordBatch.from_arrays([*found.columns, *extra], ["row", "host", "path", "rule_host", "rule_path", "verdict"])


def _rank(fit):
    host, path, verdict = fit
    return (len(host) + len(path), len(host), [-ord(c) for c in verdict])


class _Level:
    """The open rules of one host: by path, with the lengths of paths there are."""

    def __init__(self, key, host):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path, verdict):
        self.paths[path] = min(verdict, self.paths.get(path, verdict))
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def fitting(self, host, path):
        if host == self.host or host.endswith("." + self.host):
            for n in self.lengths:
                if n <= len(path) and path[:n] in self.paths:
                    yield (self.host, path[:n], self.paths[path[:n]])
                    return  # shorter paths of the same host lose


def judged(frame: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``frame`` (url, row) as row, host, path, rule, verdict."""
    spark = frame.sparkSession
    n = partitions(spark)
    urls = frame.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "row")
    urls = urls.withColumn("salt", F.rand(0))  # deals only: results don't depend on it
    known = rules.select(
        F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit(default)).alias("verdict")
    ).filter("host <> ''").distinct()
    known = known.withColumn("k", key_of(F.col("host")))
    order = ["key", "kind", "salt"]
    dealt = _events(urls, known).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt)
    names = ["host", "path", "verdict"]
    starts = dealt.filter(F.col("kind") == START)
    ends = dealt.filter(F.col("kind") == END).select(*names, F.col("part").alias("last"))
    # What opens in one range and closes in a later one is open at the start of each range after the first.
    crossing = (
        starts.join(ends, names)
        .filter("last > part")
        .withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.col("last"))))
        .select(*starts.columns)
    )
    swept = dealt.filter(F.col("kind") != END).unionByName(crossing)
    # Rules open from before have keys at or below the range's first, and sort before its urls.
    swept = swept.repartition(n, "part").sortWithinPartitions("part", "key", "kind")
    kind = frame.schema["row"].dataType.simpleString()
    schema = f"row {kind}, host string, path string, rule_host string, rule_path string, verdict string"
    found = swept.select("part", "key", "kind", "host", "path", "verdict", "row").mapInArrow(_sweep, schema)
    return found.select("row", "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict. ``rules``: host, path, verdict."""
    frame = pages.select(F.col(f"`{url_col}`").alias("url"), F.struct(F.col(f"`{id_col}`").alias("page_id")).alias("row"))
    return judged(frame, rules, default).select("row.page_id", "host", "path", "rule", "verdict")


def keep_allowed(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """The pages, with all their columns, whose verdict isn't ``block``."""
    frame = with_row(pages, url=url_col)
    whole = frame.select("url", F.struct("url", "row").alias("row"))
    kept = judged(whole, rules, default).filter("verdict <> 'block'").select("row.url", "row.row")
    return without_row(kept, pages.columns, url=url_col)
