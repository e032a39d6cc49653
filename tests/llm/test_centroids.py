import hashlib
import math
import random

from fractions import Fraction

import numpy as np
import pytest

from listingflow.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, label int"


def brute(rows, k, rounds, dims, scale=256):
    """The same by loops over Python's integers."""
    kept = [
        (i, [math.floor(Fraction(x) * scale) for x in v], v)
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    means = [v for _, v, _ in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(means))

    for _ in range(rounds if means else 0):
        of = [near(v)[1] for _, v, _ in kept]
        for j in range(len(means)):
            own = [v for (_, v, _), c in zip(kept, of, strict=True) if c == j]
            if own:
                means[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v, _ in kept]
    total = sum(d for *_, d in out)
    by = {j: sum(d for _, c, d in out if c == j) for j in range(len(means))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]

    def fits(x):
        return x if x <= centroids.LONG else None

    def all_fit(ds):
        return all(d <= centroids.LONG for d in ds)

    return sorted(
        (
            (
                i,
                c,
                fits(d),
                fits(by[c]) if all_fit(e for _, g, e in out if g == c) else None,
                fits(total) if all_fit(e for *_, e in out) else None,
                sha[c],
            )
            for i, c, d in out
        ),
        key=str,
    )


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "d", 1) for i, v in rows], SCHEMA)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in centroids.describe(frame(spark, rows), **options).collect()), key=str)


def test_like_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(i % 5, 0.5) for _ in range(6)]) for i in range(700)]
    rows += [(1_000 + i, [1.5, -0.25, 0.0, 2.0, -0.0, 1.0]) for i in range(300)]  # a hot vector
    assert found(spark, rows, k=7, rounds=4, dims=6) == brute(rows, 7, 4, 6)


def test_blocks_and_tasks_make_no_difference(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(200)]
    wanted = brute(rows, 9, 5, 3)
    assert found(spark, rows, k=9, dims=3) == wanted
    monkeypatch.setattr(centroids, "MERGE", 2)
    assert sorted((tuple(r) for r in centroids.describe(frame(spark, rows).repartition(5), k=9, dims=3).collect()), key=str) == wanted


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [0.0, -inf]), (8, [1.0, 2.0, 3.0])]
    assert found(spark, rows, k=3, dims=2) == []
    assert found(spark, [], k=3, dims=2) == []
    rows += [(None, [1.0, 2.0]), (None, [3.0, 2.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (9, [-1.0, 0.001])]
    assert found(spark, rows, k=3, dims=2) == brute(rows, 3, 5, 2)
    assert len(found(spark, rows, k=30, dims=2)) == 5


@pytest.mark.parametrize("large", [2.0**30, 1e13, 1e30, 1.7e308])
def test_large_numbers_stay_exact(spark, large):
    rows = [(i, [large * (i % 3 - 1), 0.1 * i, -large / (i + 1)]) for i in range(40)]
    assert found(spark, rows, k=4, dims=3) == brute(rows, 4, 5, 3)


def test_ids_may_be_texts_and_components_floats(spark):
    rows = [(f"v{i}", [i / 7.0, 1.0]) for i in range(20)]
    data = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = {r["vec_id"]: r["cluster"] for r in centroids.describe(data, k=2, dims=2).collect()}
    narrow = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == {i: c for i, c, *_ in brute(narrow, 2, 5, 2)}
