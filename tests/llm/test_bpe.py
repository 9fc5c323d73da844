import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewise.llm import bpe, queries
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ranks():
    pairs = (line.split() for line in bpe.read_ranks(PATH).splitlines())
    return {base64.b64decode(a): int(b) for a, b in pairs}


RANKS = ranks()
MERGES = bpe.Merges(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_same_ids_as_the_library(texts):
    got = MERGES.encode(texts)
    assert [ids_of(x) for x in got] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [MERGES.decode(x) for x in got] == [t.encode() for t in texts]


@pytest.mark.parametrize(
    "text", ["a" * 4097, "aaa" * 333 + "b", " " * 999, "日本" * 500, "<|endoftext|>", "\x00�", "ab" * 7 + "é"]
)
def test_runs(text):
    assert ids_of(MERGES.encode([text])[0]) == LIBRARY.encode_ordinary(text)


def test_merge_of_smaller_rank():
    """A vocabulary whose merges make pairs of smaller rank, and equal tokens two ways."""
    small = {bytes([i]): i + 10 for i in range(256)}
    small |= {b"bc": 600, b"abc": 3, b"aa": 700, b"aaa": 701, b"cc": 5, b"ca": 650, b"cab": 2}
    words = [b"abcabc", b"aaaaaaa", b"bccabcca", b"", b"cabcabab", b"a"]
    ids, ends = bpe.replay(words, small, bpe.PairTable(small))
    parts = [p.tolist() for p in np.split(ids, ends[:-1])]
    assert parts == [bpe.merge_one(w, small) for w in words]


def test_query(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode_ordinary(r["text"])
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids)
        assert own["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_awkward(awkward, no_docs, clashing):
    got = bpe.encode_documents(clashing, PATH, public_tokenizers.PATTERN).collect()
    want = sorted((r[1] or "").encode() for r in awkward_rows())
    assert sorted(bytes(r["decoded"]) for r in got) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    assert bpe.encode_documents(no_docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_rare_words(monkeypatch, awkward, documents):
    """With few or no words merged beforehand the ids are the same."""
    some = documents.where("doc_id < 40").select("doc_id", "text").unionAll(awkward.select("doc_id", "text"))
    want = sorted(
        (repr(r[0]), LIBRARY.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in some.collect()
    )
    for most in (0, 50):
        monkeypatch.setattr(bpe, "FREQUENT", most)
        got = bpe.encode_documents(some, PATH, public_tokenizers.PATTERN).collect()
        assert sorted((repr(r["id"]), ids_of(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_words_are_counted_once(documents, monkeypatch):
    """The word table has each distinct word of the corpus once; merging it gives its ids."""
    monkeypatch.setattr(bpe, "HELD", 500)
    some = documents.where("doc_id < 40").select("text").repartition(5)
    words = bpe.word_counts(some.selectExpr("cast(text AS binary) AS text"), lambda: MERGES)
    counts = {}
    for r in some.collect():
        for w in MERGES.split(r["text"]):
            counts[w.encode()] = counts.get(w.encode(), 0) + 1
    table = words.collect()
    assert {bytes(r["word"]): r["n"] for r in table} == counts and len(table) == len(counts)
    top = bpe.frequent(words, 100).collect()
    assert 0 < len(top) <= 100 and min(r["n"] for r in top) >= sorted(counts.values())[-100]
    merged = words.mapInArrow(bpe._merger(lambda: MERGES), "word binary, n long, ids binary").collect()
    assert len(merged) == len(counts)
    for r in merged:
        assert np.frombuffer(r["ids"], MERGES.type).tolist() == bpe.merge_one(bytes(r["word"]), RANKS)


def test_wide_vocabulary():
    """Ids over 65535 take four bytes on the way, too."""
    wide = bpe.Merges({bytes([i]): i for i in range(256)} | {b"ab": 70_000}, public_tokenizers.PATTERN)
    assert ids_of(wide.encode(["abc ab"])[0]) == [70_000, 99, 32, 70_000]
    assert wide.decode(wide.encode(["abc ab"])[0]) == b"abc ab"


def test_texts_are_coded_as_a_batch(monkeypatch):
    """Words that are known are not merged again, and rare ones once for a batch of texts."""
    asked = []
    merge = bpe.Merges.merge
    monkeypatch.setattr(bpe.Merges, "merge", lambda self, words: asked.append(words) or merge(self, words))
    texts = ["the cat", "", "zyxwvq zyxwvq zyxwvq the", "cat"]
    known = pa.array([b"the", b" the", b"unused"], pa.binary())
    known_ids = pa.array(merge(MERGES, known.to_pylist()), pa.binary())
    ids, decoded = MERGES.coded(pa.array([t.encode() for t in texts], pa.binary()), known, known_ids)
    assert [ids_of(x) for x in ids.to_pylist()] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert decoded.to_pylist() == [t.encode() for t in texts]
    assert asked == [[b" cat", b"zyxwvq", b" zyxwvq", b"cat"]]
    none = known[:0]
    assert MERGES.coded(none, known, known_ids)[0].to_pylist() == []
    assert MERGES.coded(pa.array([b"", b""], pa.binary()), none, none)[1].to_pylist() == [b"", b""]
