import public_tokenizers
from tokenizers import Tokenizer, models

from tablewise.llm.pieces import Pieces, read_pieces, token_counts
from tablewise.llm.token_counts import count_tokens
from tests.llm.conftest import awkward_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def alone(word, pieces):
    """Best segmentation of one word without sharing anything."""
    marked = "▁" + word
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(marked)
    for end in range(1, len(marked) + 1):
        options = []
        for start in range(end):
            score = (pieces.inside if start else pieces.first).get(marked[start:end])
            if score is not None:
                options.append((best[start][0] + score, -best[start][1] - 1))
        if end > 1 and marked[end - 1] not in pieces.inside:
            n = len(marked[end - 1].encode())
            options.append((best[end - 1][0] + n * pieces.byte, -best[end - 1][1] - n))
        score, tokens = max(options)
        best[end] = (score, -tokens)
    return best[-1][1]


def test_same_as_the_library(documents):
    pieces = read_pieces(PATH)
    words = sorted({w for r in documents.collect() for w in r["text"].split()})
    words = [w for w in words if all(c in pieces.inside for c in w)]
    library = Tokenizer(
        models.Unigram([("<unk>", -1e9), *pieces.first.items(), *pieces.inside.items()], 0, False)
    )
    got = token_counts(words, pieces)
    assert len(words) > 1000
    assert [got[w] for w in words] == [len(library.encode("▁" + w).tokens) for w in words]


def test_shared_prefixes():
    pieces = Pieces(
        {"▁": -3.0, "▁a": -1.0, "▁ab": -1.5}, {"a": -2.0, "b": -2.0, "ab": -2.5, "bab": -3.0}, -9.0, 3
    )
    words = ["", "a", "ab", "aba", "abab", "ababab", "b", "ba", "日", "a日b", "ab日", "▁", "abc"]
    got = token_counts(words, pieces)
    assert got == {w: alone(w, pieces) for w in words}
    assert got["日"] == 4


def test_documents(documents):
    pieces = read_pieces(PATH)
    got = {r["id"]: r for r in count_tokens(documents, PATH).collect()}
    for r in documents.collect()[:60]:
        words = [w.decode() for w in r["text"].encode().split()]
        assert got[r["doc_id"]]["n_words"] == len(words)
        assert got[r["doc_id"]]["n_tokens"] == sum(alone(w, pieces) for w in words[:10**6])


def test_awkward(clashing, no_docs):
    got = count_tokens(clashing, PATH).collect()
    assert sorted(r["n_words"] for r in got) == sorted(
        len((r[1] or "").encode().split()) for r in awkward_rows()
    )
    assert {(r["n_words"], r["n_tokens"]) for r in got if r["id"] in (5, 6, 7)} == {(0, 0)}
    assert count_tokens(no_docs, PATH).collect() == []
