import random

import numpy as np
import xxhash

from listingflow.llm import simhash
from tests.llm import cases


def plain_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = low.split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    names = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                old, new = names[a], names[b]
                names = [new if x == old else x for x in names]
    least = {}
    for name, (i, _) in zip(names, prints, strict=True):
        if i is not None:
            least[name] = min(i, least.get(name, i))
    out = [(i, f"{p:016x}", least.get(n)) for n, (i, p) in zip(names, prints, strict=True)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_awkward_documents(spark):
    docs = cases.docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert cases.rows_of(simhash.find_near_copies(docs)) == brute(rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    components = {(c is None, c) for _, _, c in brute(rows)}
    assert len(kept.collect()) == len(components)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in components}
    assert simhash.find_near_copies(cases.no_docs(spark)).count() == simhash.drop_near_copies(cases.no_docs(spark)).count() == 0


def test_near_copies_and_chains(spark):
    draw = random.Random(4)
    rows = []
    for n in range(12):
        text = [f"w{draw.randint(0, 9999)}" for _ in range(120)]
        for _ in range(draw.randint(1, 12)):
            rows.append((len(rows) * 7 % 101 + len(rows) * 101, " ".join(text)))
            text[draw.randint(0, 119)] = f"v{draw.randint(0, 9999)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cases.rows_of(simhash.find_near_copies(docs)) == brute(rows)


def test_every_linked_pair_shares_a_cell_and_large_cells_are_cut(monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_CELL", 300)
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for row in range(300):
        for bit in draw.choice(64, row % 4, replace=False):
            near[row] ^= np.uint64(1) << np.uint64(bit)
    a, b = simhash.cell_keys(base), simhash.cell_keys(near)
    assert (a == b).any(1).all()
    # The embedding's Manhattan distance is a lower bound.
    gap = np.abs(simhash.bit_counts(base).astype(int) - simhash.bit_counts(near).astype(int)).sum(1)
    assert (gap <= np.bitwise_count(base ^ near)).all()
    # A ball of fingerprints above the size of a small cell gives one tree, as brute force does.
    centre = base[0]
    ball = np.array([centre ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(64) for j in range(i)], np.uint64)
    found = np.unique(np.concatenate([ball, base[1:]]))
    assert len(found) > simhash.SMALL_CELL
    tree = simhash.forest(found)
    sets = simhash.Sets(len(found))
    assert all(sets.join(x, y) for x, y in tree)
    linked = simhash.Sets(len(found))
    for i in range(len(found)):
        for j in np.flatnonzero(np.bitwise_count(found[i:] ^ found[i]) <= 3) + i:
            linked.join(i, int(j))
    assert len({sets.find(i) for i in range(len(found))}) == len({linked.find(i) for i in range(len(found))})


def test_components_of_a_long_path(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1003), (1001, 1003)]
    random.Random(2).shuffle(pairs)
    found = dict(simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1003: 1000}
