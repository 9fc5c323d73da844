import hashlib
import json
import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewise.llm import alignment, queries
from tests.llm.conftest import awkward_rows

os.environ["TOKENIZERS_PARALLELISM"] = "false"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(A)
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
FILES = tuple(open(p, "rb").read() for p in (A, B))
VOCAB = alignment.vocabularies(FILES, public_tokenizers.PATTERN, (A, B, public_tokenizers.PATTERN))


def letters():
    """The published table of byte-level vocabularies."""
    bs = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    cs, n = list(bs), 0
    for b in range(256):
        if b not in bs:
            bs.append(b)
            cs.append(256 + n)
            n += 1
    return dict(zip(map(chr, cs), bs))


LETTERS = letters()


def plain(text):
    """(A ids, B ids, groups, links) of one text, token by token."""
    if not text:
        return [], [], [], []
    raw = (" " + text).encode()
    sides = []
    a = LIBRARY.encode(" " + text, add_special_tokens=False).ids
    sides.append([(i, bytes(LETTERS[c] for c in LIBRARY.id_to_token(i))) for i in a])
    b = []
    for i in PIECES.encode(text):
        p = PIECES.id_to_piece(i)
        b.append((i, bytes([int(p[3:-1], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()))
    sides.append(b)
    if any(b"".join(t for _, t in side) != raw for side in sides):
        return [], [], [], []
    spans = []
    for side in sides:
        at, own = 0, []
        for i, t in side:
            own.append((i, at, at + len(t)))
            at += len(t)
        spans.append(own)
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, at = [], [0, 0]
    for cut in cuts:
        group = []
        for side, own in enumerate(spans):
            start = at[side]
            while at[side] < len(own) and own[at[side]][2] <= cut:
                at[side] += 1
            group.append([i for i, _, _ in own[start : at[side]]])
        groups.append(group)
    b_end = {e: i for i, _, e in spans[1]}
    links = [(i, b_end[e]) for i, _, e in spans[0] if e in b_end]
    return a, [i for i, _ in sides[1]], groups, links


def tokens(vocab, texts):
    return [(a.tolist(), b.tolist()) for a, b in zip(*vocab.encode(texts))]


def brute_force(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of rows (id, text)."""
    done = [(i, plain(t)) for i, t in rows]
    counts = Counter(link for _, d in done for link in d[3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, (a, b, groups, links) in done:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else "",
        ))
    return sorted(out, key=repr)


def test_query(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = queries.op11_alignment(spark, sf_dir)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_awkward(clashing, no_docs):
    got = alignment.alignment_report(clashing, A, B, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force([(r[0], r[1]) for r in awkward_rows()])
    assert alignment.alignment_report(no_docs, A, B, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), min_size=1, max_size=4))
def test_same_tokens_as_the_libraries(texts):
    assert tokens(VOCAB, texts) == [plain(t)[:2] for t in texts]


@pytest.mark.parametrize(
    "text", ["<|endoftext|> <s></s>", "a▁b", "\x00", "  two  spaces \n\n", "é" * 9001, "don't DON'T’s", "🙂👍🏽", "﻿x"]
)
def test_odd_texts(text):
    assert tokens(VOCAB, [text]) == [plain(text)[:2]]
    assert tokens(VOCAB, ["before", text, "", "after"]) == [plain(t)[:2] for t in ("before", text, "", "after")]


def test_vocabulary_out_of_order():
    """Merges that do not follow the ids are left to the library."""
    spec = json.loads(FILES[0])
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    low, high = merges[0], merges[5000]
    token = ["".join(m.split(" ") if isinstance(m, str) else m) for m in (low, high)]
    vocab[token[0]], vocab[token[1]] = vocab[token[1]], vocab[token[0]]
    own = alignment.Vocabularies((json.dumps(spec).encode(), FILES[1]), public_tokenizers.PATTERN)
    texts = ["The river met the tower in the evening, three times over."]
    a = Tokenizer.from_str(json.dumps(spec)).encode(" " + texts[0], add_special_tokens=False).ids
    assert tokens(own, texts)[0][0] == a


def test_pairs_cover_all_links():
    pairs = set(VOCAB.pairs().tolist())
    assert len(pairs) < 12 * (len(VOCAB.a) + len(VOCAB.b))
    for text in ("Straße und Fluß 日本 x<|y|>", "naïve 12,345.67\tend\n", "ab" * 40):
        assert all(a * len(VOCAB.b) + b in pairs for a, b in plain(text)[3])


def test_groups():
    a, b, la, lb = alignment.group_tokens(np.array([2, 3, 1, 4]), np.array([5, 3, 2]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 1, 1]
    assert list(zip(la.tolist(), lb.tolist())) == [(1, 0), (3, 2)]
    assert [x.tolist() for x in alignment.group_tokens(np.zeros(0, int), np.zeros(0, int))] == [[]] * 4
