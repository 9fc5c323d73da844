"""Words of texts: the matches of a split pattern, for many texts at once, as Arrow arrays.

The words of ``PATTERN`` tile a text, and where one begins follows from the characters beside
that place: letter, number, white space or other.  So they come from a few passes of NumPy
over the bytes of all texts.  Any other pattern is matched text by text by the ``regex`` module,
whose classes of characters the first way has, too.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

#: The split pattern whose words are found from classes of characters.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CLASSES = (r"\p{L}+", r"\p{N}+", r"\s+")
_WHITE = 3
_BLANK, _QUOTE = ord(" "), ord("'")
#: Bytes whose wide characters are looked up together.
_PIECE = 1 << 20


@functools.cache
def _classes() -> np.ndarray:
    """0 to 3 for each code point: other, letter, number, white space."""
    points = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    kinds = np.zeros(len(points), np.uint8)
    for kind, pattern in enumerate(_CLASSES, 1):
        for run in regex.finditer(pattern, points):
            kinds[run.start() : run.end()] = kind
    return kinds


def _byte_classes(raw: bytes, data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    classes = _classes()
    kinds = np.frombuffer(bytearray(raw.translate(classes[:256].tobytes())), np.uint8)
    for at in range(0, 0 if raw.isascii() else len(data), _PIECE):
        lead = at + np.flatnonzero(data[at : at + _PIECE] >= 0xC0)
        first = data[lead]
        length = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first.astype(np.int32) & (0x7F >> length)
        more = [(np.flatnonzero(length > k), k) for k in (1, 2, 3)]
        for has, k in more:
            point[has] = point[has] << 6 | (data[lead[has] + k] & 0x3F)
        kinds[lead] = kind = classes[point]
        for has, k in more:
            kinds[lead[has] + k] = kind[has]
    return kinds


def _word_starts(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """Where the words of ``PATTERN`` begin, in texts that begin at ``offsets``; valid UTF-8."""
    n, data = len(raw), np.frombuffer(raw, np.uint8)
    kinds = _byte_classes(raw, data)
    edge = np.zeros(n + 3, bool)  # of texts
    edge[offsets], edge[n:] = True, True
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    start[1:] &= data[:-1] != _BLANK  # a blank goes with the word behind it
    # Before a word the last white character of several stands alone, or goes with the word.
    white = kinds == _WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])
    wide = np.flatnonzero(data[last] >= 0x80)  # back to its first byte, one or two before
    last[wide] -= 1 + (data[last[wide] - 1] < 0xC0)
    start[last] = True
    start |= edge[:n]
    # Endings such as 's, where a word begins with the quote.
    quote = np.flatnonzero(data == _QUOTE)
    quote = quote[start[quote] & ~edge[quote + 1]]
    padded = np.append(data, np.zeros(2, np.uint8)) if len(quote) else data
    for ending in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        at = quote[padded[quote + 1] == ending[0]]
        if len(ending) > 1:
            at = at[(padded[at + 2] == ending[1]) & ~edge[at + 2]]
        start[at + 1] = False
        end = at + 1 + len(ending)
        start[end[end < n]] = True
    return np.flatnonzero(start)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where the values of a binary array begin and end in its buffer, and that buffer."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int32), pa.py_buffer(b"")
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return ends, data if data is not None else pa.py_buffer(b"")


def binary_array(offsets: np.ndarray, data) -> pa.Array:
    """A binary array of the values between ``offsets`` in ``data``."""
    ends = pa.py_buffer(offsets.astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(data)])


def _valid(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts and where each begins and ends; malformed UTF-8 is replaced."""
    ends, data = binary_parts(texts.cast(pa.binary()))
    raw, offsets = data[int(ends[0]) : int(ends[-1])].to_pybytes(), ends - ends[0]
    if raw.isascii():
        return raw, offsets
    try:
        raw.decode()
        begins = np.frombuffer(raw, np.uint8)[offsets[:-1][offsets[:-1] < len(raw)]]
        whole = not ((begins >= 0x80) & (begins < 0xC0)).any()
    except UnicodeDecodeError:
        whole = False
    if not whole:
        mended = [t.as_py().decode("utf-8", "replace").encode() for t in texts]
        raw, offsets = b"".join(mended), np.cumsum([0, *map(len, mended)])
    return raw, offsets


def splitter(pattern: str) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray]]:
    """A function from texts (binary, UTF-8) to their words, all in turn, and bounds.

    The words of text i are those from ``bounds[i]`` to ``bounds[i + 1]``.  Malformed UTF-8 is
    replaced first.
    """
    find = regex.compile(pattern).findall

    def by_classes(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        raw, offsets = _valid(texts)
        if not raw:
            return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
        starts = _word_starts(raw, offsets)
        words = binary_array(np.append(starts, len(raw)), raw)
        return words, np.searchsorted(starts, offsets)

    def by_matches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        split = [find(t.as_py().decode("utf-8", "replace")) for t in texts]
        words = pa.array((w.encode() for found in split for w in found), pa.binary())
        return words, np.cumsum([0, *map(len, split)])

    return by_classes if pattern == PATTERN else by_matches
