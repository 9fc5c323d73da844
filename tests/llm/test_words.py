import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewise.llm import words

FIND = regex.compile(public_tokenizers.PATTERN).findall
PIECES = [
    *" \n\t　\xa0\x85\x1c​",  # white space of one to three bytes, and what is none
    *"''strevmldS",
    *["'s", "'ll", "'re", "'ve"],
    *"é日ſ1²½!-́😀𝟘𐐀",
]


def words_of(texts, pattern=public_tokenizers.PATTERN):
    found, bounds = words.splitter(pattern)(pa.array(texts, pa.binary()))
    found = [w.decode() for w in found.to_pylist()]
    return [found[a:b] for a, b in zip(bounds, bounds[1:])]


def test_pattern_is_known():
    """The queries' pattern is the one that is split by classes."""
    assert words.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=8))
def test_same_words_as_the_pattern(texts):
    """Texts side by side, some of them empty, do not share words."""
    assert words_of([t.encode() for t in texts]) == [FIND(t) for t in texts]


def test_every_character(monkeypatch):
    """Characters that a piece's end cuts in two are whole, too."""
    monkeypatch.setattr(words, "_PIECE", 1001)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}'s {c}{c}1" for c in points]
    assert words_of([t.encode() for t in texts]) == list(map(FIND, texts))


@pytest.mark.parametrize(
    "texts", [[b"a\xff 's", b"b"], [b"x\xc3", b"\xa9y"], [b"\xed\xa0\x80 a", "é".encode()], [b"", b"\x80"]]
)
def test_malformed(texts):
    """Bytes that are valid only beside the next text's are malformed, too."""
    assert words_of(texts) == [FIND(t.decode("utf-8", "replace")) for t in texts]


def test_slices_and_wide_offsets():
    texts = pa.array([b"a b", b"c's", b"", b"d  e"], pa.large_binary())
    for column in (texts, texts.cast(pa.binary())):
        found, bounds = words.splitter(words.PATTERN)(column[1:])
        assert found.to_pylist() == [b"c", b"'s", b"d", b" ", b" e"]
        assert bounds.tolist() == [0, 2, 2, 5]


def test_other_patterns():
    """Any other pattern is matched as it is; what it does not match is left out."""
    assert words_of([b"ab 12c", b"", b"3"], r"\p{L}+|1") == [["ab", "1", "c"], [], []]
