import hashlib
import re
from collections import defaultdict

import corpus_pipeline
from listingflow.llm import bpe, common
from tests.llm import cases
from tests.llm.test_bpe import ids
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_simhash import brute as brute_prints


def folder(spark, docs, items):
    path = common.shared_folder(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(spark, docs, items):
    """All stages in one process; with some language learned, the first one rejects texts without a letter."""
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text)].append((i, text))
    rows = [min(g, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0)) for g in groups.values()]
    named = {i: c for i, _, c in brute_prints(rows)}
    rows = [r for r in rows if named[r[0]] == r[0]]
    bad = {r[0] for r in brute_hits(rows, items, 10) if r[5]}
    return sorted(
        (str(i), len(ids(t)) // 4, hashlib.sha256(ids(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows if i not in bad
    )


def corpus(spark):
    words = "the of and that with from this here there over under after before again always never often quite rather still".split()
    text = lambda n: " ".join(words[(n * 7 + k * (n + 3)) % 20] + ("" if k % 9 else str(n)) for k in range(60))
    rows = [(i, text(i), "en") for i in range(40)]
    rows += [(100, text(3) + " ", "en"), (101, text(3).replace(" ", "\n"), "en"), (102, text(5) + " more", "en"), (103, text(6) + " less", "en")]
    rows += [(104, text(8) + " " + text(60), "en"), (105, "123 456", "en"), (None, None, None), (None, "no id", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), [(1, text(60)), (2, None)]


def test_the_pipeline_is_its_stages(spark):
    docs, items = corpus(spark)
    found = corpus_pipeline.run(spark, folder(spark, docs, items))
    assert sorted((str(r.doc_id), *r[1:]) for r in found.collect()) == plain(spark, docs, items)


def test_each_stage_takes_awkward_documents(spark):
    docs, items = corpus(spark)
    for start in (cases.docs(spark), cases.no_docs(spark)):
        path = folder(spark, start, items)
        now = spark.read.parquet(f"{path}/documents.parquet")
        names = now.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = common.staged(stage(spark, now, path))
            assert now.columns == names
        last = corpus_pipeline.STAGES[-1][1](spark, now, path)
        assert last.count() == now.count()
        assert {r.doc_id for r in last.collect()} == ({None, 1, 2, 7, 9, 11, 12} - {1} if start.count() else set()) or not start.count()


def test_sql_is_declared_absent():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5 and bpe.LEAF
