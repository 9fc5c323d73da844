import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tablewise.llm import lattice
from tablewise.llm.pieces import Pieces, read_pieces
from tablewise.llm.subwords import Lattice
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(own, word, scores):
    """All segmentations one by one."""
    marked, total = "▁" + word, 0.0
    first = {p: n for n, p in enumerate(own.first)}
    inside = {p: n + len(own.first) for n, p in enumerate(own.inside)}
    go = math.log1p(-math.exp(scores[own.stop]))

    def walk(at, score):
        nonlocal total
        if at == len(marked):
            total += math.exp(score + scores[own.stop])
            return
        for end in range(at + 1, len(marked) + 1):
            n = (inside if at else first).get(marked[at:end])
            if n is not None:
                walk(end, score + scores[n] + (go if at else 0))
        if at:
            walk(at + 1, score + len(marked[at].encode()) * (go + scores[own.byte]))

    walk(0, 0.0)
    return math.log10(total)


@pytest.fixture(scope="module")
def vocabulary():
    return Lattice(read_pieces(PATH, lower=True))


WORDS = ["the", "nation", "x", "beieen,", "日a", "▁th", "anat▁th", "zz9", "ciónmit", "é", "the"]


def test_forward_recursion(vocabulary):
    got = vocabulary.word_scores(WORDS, [vocabulary.prior])[:, 0]
    assert np.allclose(got, [brute(vocabulary, w, vocabulary.prior) for w in WORDS], rtol=1e-9)


def test_fitting_raises_the_likelihood(vocabulary):
    scores = vocabulary.prior
    before = -np.inf
    for _ in range(3):
        now = vocabulary.word_scores(WORDS, [scores]).sum()
        assert now > before - 1e-9
        before = now
        uses = vocabulary.expected(WORDS, scores)
        assert uses[vocabulary.stop] == pytest.approx(len(WORDS))
        scores = vocabulary.fitted(uses)
        first = np.exp(scores[: len(vocabulary.first)]).sum()
        inner = np.exp(scores[len(vocabulary.first) : vocabulary.byte]).sum()
        assert first == pytest.approx(1) and inner + 256 * np.exp(scores[vocabulary.byte]) == pytest.approx(1)


def test_words_of_a_small_vocabulary_add_up():
    """Over an alphabet of pieces a and ab, words up to a length take nearly all probability."""
    own = Lattice(Pieces({"▁": math.log(0.5), "▁a": math.log(0.5)},
                         {"a": math.log(0.6), "b": math.log(0.2), "ab": math.log(0.2)}, -200.0, 2))
    words, layer = [""], [""]
    for _ in range(11):
        layer = [w + c for w in layer for c in "ab"]
        words += layer
    total = (10.0 ** own.word_scores(words, [own.prior])[:, 0]).sum()
    assert 0.93 < total <= 1 + 1e-9


def check(docs, frequent):
    rows = docs.select("doc_id", "text", "lang").collect()
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]
    def out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(t for r in rows if not out(r["doc_id"]) for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (
            repr(r["doc_id"]), out(r["doc_id"]), len(tokens(r["text"])),
            sum(counts[t] > 0 for t in tokens(r["text"])), n,
            round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r["text"])), 4),
        )
        for r in rows
    )
    got = lattice.score_documents(docs, PATH, frequent_words=frequent).collect()
    assert sorted(
        (repr(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
         round(r["base_score"], 4))
        for r in got
    ) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    return sorted((repr(r["id"]), round(r["score"], 3)) for r in got)


def test_documents(documents):
    """Broadcast and joined words give the same scores."""
    assert check(documents, 50) == check(documents, 1 << 18)


def test_scores_by_hand(spark):
    rows = [(i, "the cat the dog" if i % 2 else "le chat", "en" if i % 2 else "fr") for i in range(9)]
    rows += [(100, "the unseenword", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["id"]: r for r in lattice.score_documents(df, PATH).collect()}
    # Learn from the same rows: counts, fitted pieces, and the mixture over classes.
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    names = [x for x, _ in Counter(sorted(r[2] for r in train)).most_common()]
    names.sort(key=lambda x: (-sum(r[2] == x for r in train), x))
    kinds = [*names, None]
    count = {k: Counter(t for r in train if r[2] == k for t in [*r[1].split(), None]) for k in kinds}
    overall = sum(count.values(), Counter())
    n, v = sum(overall.values()), len(overall)
    novel = v / (n + v)
    own = Lattice(read_pieces(PATH, lower=True))
    scores = {}
    for k in kinds:
        s = own.prior
        seen = sorted(w for w in count[k] if w)
        for _ in range(lattice.ROUNDS):
            s = own.fitted(own.expected(seen, s))
        scores[k] = s
    for doc_id, text, _ in rows:
        total = 0.0
        for k in kinds:
            n_k = sum(count[k].values())
            p = (sum(r[2] == k for r in train) + 1) / (len(train) + len(kinds))
            for t in [*text.split(), None]:
                c = count[k][t] / n_k if n_k else overall[t] / n
                known = (1 - novel) * (0.9 * c + 0.1 * overall[t] / n)
                rest = 0.01 if t is None else 0.99 * 10 ** brute(own, t, scores[k])
                p *= known + novel * rest
            total += p
        assert got[doc_id]["score"] == pytest.approx(math.log10(total), rel=1e-6)


def test_awkward(clashing, no_docs):
    check(clashing, 3)
    assert lattice.score_documents(no_docs, PATH).collect() == []
    assert len(awkward_rows()) == clashing.count()


def test_nothing_to_learn_from(spark):
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(out, "a b", "en")], "doc_id long, text string, lang string")
    (r,) = lattice.score_documents(df, PATH).collect()
    assert (r["n_known"], r["train_tokens"]) == (0, 0) and math.isfinite(r["score"])
