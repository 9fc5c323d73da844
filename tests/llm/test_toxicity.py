import random
import zlib

import pytest

from tablewise.llm import toxicity
from tests.llm.conftest import awkward_rows


@pytest.mark.parametrize(
    "text, folded",
    [
        ("You 1D10T!", " you idiot "),
        ("Ѕtuрid, $cum; tra$h", " stupid scum trash "),
        ("café  STRASSE ÀÉ", " cafe strasse ae "),
        ("a@b.com $$$ | 日本", " aab com 日本 "),
        ("ｗｏｒｔｈ", " worth "),
        (" \n!?", ""),
        ("", ""),
    ],
)
def test_fold(text, folded):
    assert toxicity.fold(text) == folded


def test_hits_and_exceptions():
    model = toxicity.Model(
        {" trash ": 5.0, " iose": 3.0}, frozenset({toxicity.fold("trash can")}), -4.0, 1.0, 1.0
    )
    fold = toxicity.fold
    assert [w for *_, w in model.hits(fold("Tra$h and l0ser"))] == [5.0, 3.0]
    assert model.hits(fold("put it in the trash can")) == []
    assert len(model.hits(fold("trash, trash can, trash"))) == 2
    assert model.hits(fold("closer trashy")) == []
    assert model.score("") == model.score(fold("a clean text")) < 0.5 < model.score(fold("trash"))
    # The same weight counts less in a longer text.
    assert model.score(fold("trash " + "word " * 500)) < model.score(fold("trash word"))


def corpus(n=900, seed=1):
    own = random.Random(seed)
    bad = ["blorg", "snarfle", "grumpish"]
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = []
    for i in range(n):
        text = [own.choice(words) for _ in range(own.randrange(5, 80))]
        toxic = own.random() < 0.2
        if toxic:
            for _ in range(own.randrange(1, 4)):
                word = own.choice(bad)
                text.insert(own.randrange(len(text)), own.choice([word, word.upper(), word.replace("o", "0").replace("a", "@")]))
        elif own.random() < 0.1:
            text.append("blorg fish")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t, _ in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), rows


def test_held_out_accuracy(planted):
    docs, labels, rows = planted
    got = {r["id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    out = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in out) and len(out) > 100
    assert sum(r["predicted"] == y for r, y in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_not_used(planted):
    docs, labels, rows = planted
    from pyspark.sql import functions as F

    turned = labels.withColumn(
        "toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    same = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert same[0] == same[1]


def test_copies_count_once(planted, spark):
    """A toxic text that is copied hundreds of times does not make its words entries."""
    docs, labels, rows = planted
    victim = next(t for _, t, y in rows if y)
    more = spark.createDataFrame([(5000 + i, victim) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(5000 + i, 1) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text").unionAll(more), labels.unionAll(marks))
    assert len(model.weights) <= 8


def test_sample_keeps_the_mix(spark):
    """A weak entry scores as in the whole table when clean rows are drawn and toxic ones all kept."""
    own = random.Random(4)
    rows = []
    for i in range(6000):
        text = " ".join("w" + "".join(own.choices("abcdefgh", k=3)) for _ in range(12))
        kind = own.random()
        weak, fish = kind < 0.08, 0.08 <= kind < 0.10
        toxic = own.random() < (0.4 if weak else 0.04 if fish else 0.005)
        rows.append((i, text + " blorg" * weak + " blorg fish" * fish, int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole, drawn = (toxicity.fit(docs, labels, sample_rows=n) for n in (20_000, 1000))
    text = toxicity.fold(rows[0][1].split(" blorg")[0] + " blorg")
    assert whole.score(text) < 0.5
    assert abs(drawn.score(text) - whole.score(text)) < 0.1
    phrase = toxicity.fold("blorg fish")
    assert phrase in whole.exceptions and phrase in drawn.exceptions


def test_stage(planted, clashing, no_docs, spark):
    docs, labels, rows = planted
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert sum((i not in kept) == bool(y) for i, _, y in rows) / len(rows) > 0.95
    assert toxicity.drop_toxic(clashing, labels).columns == clashing.columns
    assert toxicity.drop_toxic(no_docs, labels).collect() == []


def test_awkward(clashing, no_docs, spark):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 1), (8, 0), (9, 0)], "doc_id long, toxic int"
    )
    got = toxicity.toxicity(clashing, labels).collect()
    assert len(got) == len(awkward_rows())
    assert all(r["score"] is not None and r["predicted"] in (0, 1) for r in got)
    for few in (labels.where("toxic = 0"), labels.limit(0)):
        assert {r["predicted"] for r in toxicity.toxicity(clashing, few).collect()} == {0}
    assert toxicity.toxicity(no_docs, labels).collect() == []


def test_automaton_against_naive_matching(documents):
    """Every occurrence of every entry outside the exceptions, over all documents.

    The entries are short pieces of the documents' own words, so that they overlap and meet.
    """
    texts = [r[0] for r in documents.select("text").collect()]
    words = sorted({w for t in texts for w in toxicity.fold(t).split() if len(w) > 4})[::25]
    entries = {f" {w[:n]}": 1.0 + n for w in words for n in (4, 5)} | {f" {w} ": 9.0 for w in words}
    pairs = [toxicity.fold(t).split() for t in texts]
    harmless = frozenset(f" {a} {b} " for p in pairs for a, b in zip(p, p[1:]) if b in words[::3])
    model = toxicity.Model(entries, frozenset(sorted(harmless)[:200]))

    def places(text, entry):
        at = text.find(entry)
        while at >= 0:
            yield at, at + len(entry)
            at = text.find(entry, at + 1)

    seen = 0
    for text in texts:
        folded = toxicity.fold(text)
        harmless = [s for e in model.exceptions for s in places(folded, e)]
        want = [
            (a, b, w)
            for e, w in model.weights.items()
            for a, b in places(folded, e)
            if not any(x <= a and b <= y for x, y in harmless)
        ]
        assert sorted(model.hits(folded)) == sorted(want)
        seen += len(want)
    assert seen > 20
