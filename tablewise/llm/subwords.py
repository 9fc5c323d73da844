"""Probabilities of words by their subword lattice, for many words at once.

A word is a first piece, then after each piece a stop or another piece, so that the
probabilities of all words add up to one.  Any character may also be spelled as bytes.
The forward recursion adds up all segmentations in log space; with the backward recursion
it gives the expected uses of each piece, from which the scores can be fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tablewise.llm.pieces import BLANK, Pieces

#: Chance that a word ends after a piece, before anything is learned.
STOP = 0.35
#: Weight of the vocabulary's own scores when they are fitted, in words.
PRIOR = 50.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 19
#: Cells of a block of the lattice.
_CELLS = 1 << 21


def _code_points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; codes and result have one column per word."""
    hashes = np.zeros((len(codes) + 1, codes.shape[1]), np.uint64)
    for i, row in enumerate(codes):
        hashes[i + 1] = hashes[i] * _BASE + row
    return hashes


def _of_length(n: int) -> np.uint64:
    return np.uint64(n * int(_SPREAD) % (1 << 64))


class Lattice:
    """Where the pieces of a vocabulary stand in words.

    Numbers of pieces: those that begin a word, then those inside; one more for a byte,
    and one for the stop.
    """

    def __init__(self, pieces: Pieces):
        self.first, self.inside = list(pieces.first), list(pieces.inside)
        self.byte = len(self.first) + len(self.inside)
        self.stop = self.byte + 1
        self.longest = pieces.longest
        self.prior = np.array(
            [*pieces.first.values(), *pieces.inside.values(), pieces.byte, np.log(STOP)]
        )
        names = self.first + self.inside
        self._powers = [
            np.uint64(pow(int(_BASE), n, 1 << 64)) for n in range(self.longest + 1)
        ]
        keys = np.array(
            [
                _prefix_hashes(_code_points(n)[:, None].astype(np.uint64))[-1, 0]
                ^ _of_length(len(n))
                for n in names
            ],
            np.uint64,
        )
        size = 1 << _SLOT_BITS
        self._keys, self._ids = np.zeros(size + 64, np.uint64), np.full(size + 64, -1, np.int32)
        self._probes = 1
        for n, (key, slot) in enumerate(zip(keys, self._slots(keys))):
            probe = 0
            while self._ids[slot + probe] >= 0:
                probe += 1
            self._keys[slot + probe], self._ids[slot + probe] = key, n
            self._probes = max(self._probes, probe + 1)

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        found = np.where(self._keys[slots] == keys, self._ids[slots], -1)
        for probe in range(1, self._probes):
            slots = slots + 1
            found = np.where((found < 0) & (self._keys[slots] == keys), self._ids[slots], found)
        return found

    def blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, pieces, bytes) of words of one length, in blocks of bounded size.

        ``pieces[end, length - 1, word]`` is the piece that ends there (or one past the
        last number), ``bytes[end, word]`` the bytes of the character that does.
        """
        by_length: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(n)
        for length, members in by_length.items():
            step = max(1, _CELLS // (length * (self.longest + 1)))
            for start in range(0, len(members), step):
                own = members[start : start + step]
                text = "".join(BLANK + words[n] for n in own)
                codes = _code_points(text).reshape(len(own), length).T.astype(np.uint64)
                hashes = _prefix_hashes(codes)
                wide = min(self.longest, length)
                pieces = np.full((length + 1, wide, len(own)), self.stop + 1, np.int32)
                for n in range(1, wide + 1):
                    keys = hashes[n:] - hashes[: length + 1 - n] * self._powers[n]
                    found = self._find(keys ^ _of_length(n))
                    # A piece that begins a word stands at the beginning only.
                    found[1:][found[1:] < len(self.first)] = -1
                    pieces[n:, n - 1][found >= 0] = found[found >= 0]
                size = np.zeros((length + 1, len(own)))
                size[1:] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
                yield np.array(own), pieces, size

    def _arcs(self, pieces: np.ndarray, size: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Log weight of each arc, with the chance to go on after the piece before it.

        The last arc of each end is the character spelled as bytes.
        """
        go = np.log1p(-np.exp(scores[self.stop]))
        table = np.append(scores, -np.inf)
        table[len(self.first) : self.byte] += go
        ends, wide, words = pieces.shape
        arcs = np.empty((ends, wide + 1, words))
        arcs[:, :wide] = table[pieces]
        arcs[:, wide] = size * (scores[self.byte] + go)
        arcs[:2, wide] = -np.inf  # the mark itself is not spelled
        return arcs

    @staticmethod
    def _total(terms: np.ndarray) -> np.ndarray:
        top = terms.max(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            summed = top + np.log(np.exp(terms - top).sum(axis=0))
        return np.where(np.isneginf(top), -np.inf, summed)

    def _forward(self, arcs: np.ndarray) -> np.ndarray:
        ends, width, words = arcs.shape
        forward = np.full((ends, words), -np.inf)
        forward[0] = 0.0
        for end in range(1, ends):
            near = min(width - 1, end)
            terms = np.empty((near + 1, words))
            terms[:near] = arcs[end, :near] + forward[end - near : end][::-1]
            terms[near] = arcs[end, -1] + forward[end - 1]
            forward[end] = self._total(terms)
        return forward

    def word_scores(self, words: list[str], scores: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each word (rows) under each set of scores (columns)."""
        found = np.empty((len(words), len(scores)))
        for own, pieces, size in self.blocks(words):
            for k, own_scores in enumerate(scores):
                forward = self._forward(self._arcs(pieces, size, own_scores))
                found[own, k] = (forward[-1] + own_scores[self.stop]) / np.log(10)
        return found

    def expected(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, of bytes and of the stop, each word counting once."""
        uses = np.zeros(self.stop + 2)
        for _, pieces, size in self.blocks(words):
            arcs = self._arcs(pieces, size, scores)
            forward = self._forward(arcs)
            ends, width, n = arcs.shape
            backward = np.full((ends, n), -np.inf)
            backward[-1] = 0.0
            for start in range(ends - 2, -1, -1):
                near = min(width - 1, ends - 1 - start)
                lengths = np.arange(near)
                terms = np.empty((near + 1, n))
                terms[:near] = arcs[start + 1 + lengths, lengths] + backward[start + 1 : start + 1 + near]
                terms[near] = arcs[start + 1, -1] + backward[start + 1]
                backward[start] = self._total(terms)
            for end in range(1, ends):
                near = min(width - 1, end)
                rest = backward[end] - forward[-1]
                share = np.exp(arcs[end, :near] + forward[end - near : end][::-1] + rest)
                uses += np.bincount(pieces[end, :near].ravel(), share.ravel(), len(uses))
                uses[self.byte] += (size[end] * np.exp(arcs[end, -1] + forward[end - 1] + rest)).sum()
            uses[self.stop] += n
        return uses[:-1]

    def fitted(self, uses: np.ndarray) -> np.ndarray:
        """Scores from expected uses; the vocabulary's own ones count as ``PRIOR`` words."""
        begin, inner = slice(0, len(self.first)), slice(len(self.first), self.byte + 1)
        counts = uses.copy()
        counts[begin] += PRIOR * np.exp(self.prior[begin])
        counts[inner] += PRIOR * np.exp(self.prior[inner])
        scores = np.empty(len(uses))
        scores[begin] = np.log(counts[begin] / counts[begin].sum())
        # A byte is one of 256, all alike.
        inside = counts[inner].sum() + 255 * PRIOR * np.exp(self.prior[self.byte])
        scores[inner] = np.log(counts[inner] / inside)
        scores[self.byte] -= np.log(256)
        going = uses[len(self.first) : self.byte + 1].sum() + PRIOR
        scores[self.stop] = np.log((uses[self.stop] + PRIOR) / (uses[self.stop] + PRIOR + going))
        return scores
