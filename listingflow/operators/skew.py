"""Joining per-group facts back to rows when one group may hold a third of them.

The join is an ordinary left join of rows to one fact row per key. A sort-merge join's rows side may be cut
anywhere, since each piece meets the same fact row: adaptive execution splits the partitions that
a hot group fills, from what it measured in the shuffle, whatever the number of such groups.
Small facts may be broadcast, which Spark decides from their measured size.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SPREAD = 1 << 20


def attach_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join ``facts`` (one row per key) to ``rows``. Null keys match nothing, and are dealt out by the whole row."""
    values = [c for c in facts.columns if c not in keys]
    # Always 0, but no literal: of a constant Spark makes a test beside the join instead of a key.
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).alias("_f_spread")
    named = facts.select(*[F.col(k).alias(f"_f_{k}") for k in keys], zero, F.struct(*values).alias("_facts"))
    told = [f"`{f.name}`" for f in rows.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    alone = reduce(or_, [F.col(k).isNull() for k in keys])
    spread = F.when(alone, F.pmod(F.xxhash64(*told), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long"))
    on = [*[F.col(k) == F.col(f"_f_{k}") for k in keys], F.col("_spread") == F.col("_f_spread")]
    joined = rows.withColumn("_spread", spread).join(named, on, "left")
    return joined.select(*rows.columns, *[F.col(f"_facts.{v}").alias(v) for v in values])
