"""Centroid clustering of integer vectors by scalar lookup tables.

Every component becomes the integer floor(scale * x). The kept vectors are written once as blocks: for each dimension
the integers that occur in the block, and for each vector their places. A round tabulates, block by block, the squared
difference of each dimension, occurring integer and centroid; a vector's distances are gathers from these tables,
added up. Sums of a cluster's vectors leave each task as one row a cluster, are added in two steps (by cluster and
task, then by cluster) and reach the driver as at most ``k`` rows; so do the starting vectors.

All arithmetic is exact: 64-bit integers where no sum can pass them, Python's integers otherwise.

Defined results: vectors that are null, have another number of components, or a null or non-finite one are left out.
Of fewer than ``k`` kept vectors each is a centroid; none kept gives an empty result. A null id counts as empty text
where starting vectors are drawn, and equal ids are told apart by their components. Repeated rows are clustered row by
row. A distance or inertia that no long holds is null (the assignment is exact all the same). Other columns never
clash: only id and vector are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.llm.common import staged

BLOCK_ROWS = 4_096
SMALL = 1 << 24  # below it, 64 bits hold every distance and every sum of a block
WIDE = 1 << 12  # dimensions up to which that is so
MERGE = 64
LONG = (1 << 63) - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly."""
    if not len(values) or np.abs(values).max() < (1 << 52) / scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array([math.floor(x) * scale if abs(x) >= 1 << 53 else _floor(x, scale) for x in values.tolist()], object)


def _floor(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def _whole(texts) -> np.ndarray:
    """Integers from their decimal texts: 64-bit ones if all are small."""
    found = [int(x) for x in texts]
    return np.array(found, np.int64 if all(-SMALL < x < SMALL for x in found) else object)


class Block:
    """Vectors as places in the lists of integers that occur in each dimension."""

    def __init__(self, sizes: list[int], values: list[str], codes: bytes):
        ends = np.cumsum(sizes)
        self.values = np.split(_whole(values), ends[:-1])
        self.codes = np.frombuffer(codes, "<u2").reshape(len(sizes), -1)

    @staticmethod
    def of(rows: np.ndarray) -> dict:
        """The stored form of vectors (one a row)."""
        sizes, values, codes = [], [], []
        for column in rows.T:
            occurring, places = np.unique(column, return_inverse=True)
            sizes.append(len(occurring))
            values.extend(map(str, occurring.tolist()))
            codes.append(places.astype("<u2"))
        return {"sizes": sizes, "values": values, "codes": np.array(codes, "<u2").tobytes()}

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (ties: the first) and its squared distance."""
        total = 0
        for values, places, means in zip(self.values, self.codes, centroids.T, strict=True):
            table = np.square(values[:, None] - means[None, :])
            total = total + table[places]
        found = total.argmin(axis=1)
        return found, total[np.arange(len(found)), found]

    def vectors(self) -> np.ndarray:
        return np.stack([v[c] for v, c in zip(self.values, self.codes, strict=True)], axis=1)


def _blocks(kept: DataFrame, scale: int) -> DataFrame:
    """``kept`` (id, vector) as rows of up to BLOCK_ROWS vectors."""
    kind = kept.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType()))]
        + [T.StructField("values", T.ArrayType(T.StringType())), T.StructField("codes", T.BinaryType())]
    )

    def work(batches):
        ids, rows, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            rows.append(integers(flat, scale).reshape(batch.num_rows, -1))
            ids.append(batch.column("id"))
            held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield row(ids, rows)
                ids, rows, held = [], [], 0
        if held:
            yield row(ids, rows)

    def row(ids, rows):
        stored = Block.of(np.concatenate(rows))
        own = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                pa.array([stored["sizes"]], pa.list_(pa.int32())),
                pa.array([stored["values"]], pa.list_(pa.string())),
                pa.array([stored["codes"]], pa.binary()),
            ],
            ["ids", "sizes", "values", "codes"],
        )

    return kept.mapInArrow(work, schema)


_SUMS = "cluster int, salt int, n long, sums array<string>"


def _sums_of(centroids: list[list[int]]):
    """Per task one row a cluster: how many vectors it has, and their sum."""

    def work(batches):
        from pyspark import TaskContext

        means = _matrix(centroids)
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(means.shape, object)
        for block, _ in _read(batches):
            found, _ = block.nearest(means)
            vectors = block.vectors()
            part = np.zeros(means.shape, vectors.dtype)
            np.add.at(part, found, vectors)
            counts += np.bincount(found, minlength=len(centroids))
            sums += part
        salt = TaskContext.get().partitionId() % MERGE
        rows = [
            {"cluster": i, "salt": salt, "n": n, "sums": list(map(str, sums[i].tolist()))} for i, n in enumerate(counts.tolist()) if n
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW_SUMS)

    return work


_ARROW_SUMS = pa.schema([("cluster", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _add(rows: pa.Table) -> pa.Table:
    """The rows of one group as one."""
    first = rows.slice(0, 1).to_pylist()[0]
    sums = [sum(map(int, column)) for column in zip(*rows.column("sums").to_pylist(), strict=True)]
    first |= {"n": sum(rows.column("n").to_pylist()), "sums": list(map(str, sums))}
    return pa.Table.from_pylist([first], _ARROW_SUMS)


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    flat = _whole([x for c in centroids for x in c])
    return flat.reshape(len(centroids), -1)


def _read(batches):
    for batch in batches:
        for sizes, values, codes, ids in zip(
            batch.column("sizes").to_pylist(),
            batch.column("values").to_pylist(),
            batch.column("codes").to_pylist(),
            batch.column("ids"),
            strict=True,
        ):
            yield Block(sizes, values, codes), ids.values


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of each one's vectors; one without vectors stays."""
    parts = blocks.mapInArrow(_sums_of(centroids), _SUMS)
    parts = parts.groupBy("cluster", "salt").applyInArrow(_add, _SUMS).groupBy("cluster").applyInArrow(_add, _SUMS)
    out = list(centroids)
    for row in parts.collect():  # at most one row a centroid
        out[row["cluster"]] = [int(x) // row["n"] for x in row["sums"]]
    return out


def assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """id, cluster, distance of every vector."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def work(batches):
        means = _matrix(centroids)
        for block, ids in _read(batches):
            found, distance = block.nearest(means)
            held = [x if x <= LONG else None for x in distance.tolist()]
            arrays = [ids, pa.array(found, pa.int32()), pa.array(held, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "cluster", "distance"])

    return blocks.mapInArrow(work, schema)


def kept_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    frame = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return frame.filter((F.size("vector") == dims) & ~bad)


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """Every kept vector's id, cluster and squared distance, and the final centroids.

    Starts from the ``k`` vectors with the smallest SHA-256 of ``seed:id``.
    """
    if dims > WIDE:
        raise ValueError(f"at most {WIDE} dimensions")
    kept = kept_vectors(vectors, dims, id_col, vector_col)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = kept.orderBy(F.sha2(named.cast("binary"), 256), "vector").limit(k).collect()
    centroids = [integers(np.array(r["vector"], float), scale).tolist() for r in first]
    blocks = staged(_blocks(kept, scale))
    for _ in range(rounds if centroids else 0):
        centroids = moved(blocks, centroids)
    return assigned(blocks, centroids or [[0] * dims]), centroids


def describe(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(vectors, id_col=id_col, **options)
    found = staged(found)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.count("*") == F.count("distance")
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.when(whole, exact).alias("total")).collect()}

    def fits(total):
        return None if total is None or total > LONG else int(total)

    everything = None if None in sums.values() else fits(sum(map(int, sums.values())))
    rows = [
        (i, fits(sums.get(i, 0)), everything, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    facts = vectors.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    out = found.join(F.broadcast(facts), "cluster")  # one row a centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
