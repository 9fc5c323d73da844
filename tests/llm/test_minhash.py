import hashlib

import numpy as np

from tablewise.llm import minhash
from tests.llm.conftest import awkward_rows


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} - {()})


def resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_documents(documents):
    rows = sorted(map(tuple, documents.select("doc_id", "text").collect()), reverse=True)
    got = {r["id"]: r for r in minhash.fingerprints(documents.repartition(7)).collect()}
    assert len(got) == len(rows)
    errors, by_text = [], {}
    for n, (doc_id, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        errors.append(r["near_edited"] - resemblance(text, changed))
        assert abs(r["near_next"] - resemblance(text, after)) < 0.3
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).mean() < 0.04


def test_likeness_is_unbiased():
    words = [f"w{i}" for i in range(4000)]
    for share in (0.0, 0.3, 0.8, 1.0):
        own = " ".join(words[:2000])
        other = " ".join(words[: int(2000 * share)] + words[2000 : 4000 - int(2000 * share)])
        a, b = minhash.sketch(own.encode()), minhash.sketch(other.encode())
        assert abs(minhash.likeness(a, b) - resemblance(own, other)) < 0.08


def test_few_shingles_fill_all_bins():
    a, b = (minhash.sketch(t) for t in (b"one", b"one two three"))
    assert len(a) == len(b) == minhash.BINS
    assert minhash.likeness(a, minhash.sketch(b"ONE")) == 1.0
    assert minhash.likeness(a, b) < 0.2
    assert minhash.sketch(b" \n") is None
    assert minhash.likeness(None, None) == 1.0 and minhash.likeness(None, a) == 0.0
    assert (minhash.unpacked(minhash.packed(b)) == b).all()


def test_awkward(clashing, no_docs, spark):
    got = minhash.fingerprints(clashing).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(r[1] or "") for r in awkward_rows())
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["id"], set()).add(r["fingerprint"])
    assert prints[6] == {""} and len(prints[9]) == 2 and prints[1] == prints[2] == prints[3]
    assert minhash.fingerprints(no_docs).collect() == []
    alone = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    (r,) = minhash.fingerprints(alone).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()


def plain_bins(text):
    """The bins of one text, one number after the other: minima, then densification."""
    import xxhash

    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & mask
        x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & mask
        return x ^ (x >> 33)

    words = text.encode().lower().split()
    if not words:
        return None
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    n = min(5, len(words))
    least = {}
    for i in range(len(words) - n + 1):
        h = mixed(sum(hashes[i + k] * int(minhash._PLACES[k]) for k in range(n)) & mask)
        least[h >> 55] = min(h, least.get(h >> 55, h))
    out = []
    for b in range(512):
        if b not in least:
            order = sorted(range(512), key=lambda j: (mixed(b * 512 + j + 1), j))
            b = next(j for j in order if j in least)
        out.append(least[b] & 15)
    return out


def test_fingerprints_are_those_of_a_plain_build(documents):
    texts = [r[0] for r in documents.where("n_chars < 6000").select("text").limit(12).collect()]
    for text in [*texts, "one", "One two three four", "", " a  b\nc d e f"]:
        bits, want = minhash.sketch(text.encode()), plain_bins(text)
        assert (bits is None) == (want is None)
        assert bits is None or bits.tolist() == want
        assert minhash.packed(bits) == ("" if want is None else "".join(f"{x:x}" for x in want))
