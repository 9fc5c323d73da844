import re

import corpus_pipeline
import pytest

from tablewise.llm.common import shared_folder, written
from tests.llm.test_simhash import brute_print, brute_roots


@pytest.fixture(scope="module")
def passed(spark, sf_dir):
    """What each stage gets and gives."""
    docs, steps = corpus_pipeline.table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), name)
        steps[name] = (docs, out)
        docs = out
    return steps


def test_stages(passed):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(passed)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, (docs, out) in passed.items():
        assert out.columns == columns + (["ids", "n_tokens", "exact"] if name == "byte_bpe" else [])
        assert set(map(tuple, out.select(columns).collect())) <= set(map(tuple, docs.collect()))


def test_exact_copies(passed):
    docs, out = (df.collect() for df in passed["exact_dedup"])
    def normal(r):
        return re.sub(r"[\x20\x09-\x0D]+", "", r["text"])
    best = {}
    for r in docs:
        key = (-len(r["text"]), r["doc_id"])
        best[normal(r)] = min(best.get(normal(r), key), key)
    assert sorted(r["doc_id"] for r in out) == sorted(i for _, i in best.values())


def test_near_copies(passed):
    docs, out = (df.collect() for df in passed["simhash_dedup"])
    roots = brute_roots([brute_print(r["text"]) for r in docs])
    least = {}
    for r in docs:
        root = roots[brute_print(r["text"])]
        least[root] = min(r["doc_id"], least.get(root, r["doc_id"]))
    assert sorted(r["doc_id"] for r in out) == sorted(least.values())


def test_mixing(passed):
    from tablewise.llm import mixing

    docs, out = passed["mixing"]
    want = {r["id"]: r["copies"] for r in mixing.mix_report(docs).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want


def test_encoding(passed):
    _, out = passed["byte_bpe"]
    assert all(r["exact"] and len(r["ids"]) == 4 * r["n_tokens"] for r in out.collect())


@pytest.mark.parametrize("kind", ["clashing", "no_docs"])
def test_awkward(spark, sf_dir, kind, request):
    docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), name)
        assert out.columns[: len(docs.columns)] == docs.columns
        if name == "byte_bpe":
            assert len(out.columns) == len(docs.columns) + 3
        docs = out
    assert (docs.count() == 0) == (kind == "no_docs")


def test_run_is_registered(spark, sf_dir, passed):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, sf_dir)
    want = sorted(map(repr, passed["byte_bpe"][1].collect()))
    assert sorted(map(repr, rows.collect())) == want


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert spark.sparkContext.getCheckpointDir()
