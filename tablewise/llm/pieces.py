"""An existing subword vocabulary as unigram scores, and best segmentations under it."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

#: Fixed value: the mark that stands for the blank before a word.
BLANK = "▁"


@dataclass(frozen=True)
class Pieces:
    """Natural log scores: of pieces that begin a word, of those inside, and of a byte.

    Those that can begin a word add up to one, and so do the others with 256 bytes.
    """

    first: dict[str, float]
    inside: dict[str, float]
    byte: float
    longest: int


def read_pieces(path: str, lower: bool = False) -> Pieces:
    """The vocabulary of a sentencepiece file, read on the driver; bounded by its size.

    ``lower`` leaves out pieces with the letters A-Z, for texts that have none.

    A BPE file scores its pieces by rank, which is turned into a probability by Zipf's
    law; the scores of a unigram file are taken as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [
        i
        for i in range(size)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        and BLANK not in model.id_to_piece(i)[1:]
        and not (lower and any("A" <= c <= "Z" for c in model.id_to_piece(i)))
    ]
    scores = [model.get_score(i) for i in plain]
    ranked = min(scores, default=0.0) < -50
    weights = {
        model.id_to_piece(i): 1 / (2 - s) if ranked else math.exp(s) for i, s in zip(plain, scores)
    }
    least = min(weights.values(), default=1.0)
    first = {p: w for p, w in weights.items() if p.startswith(BLANK)}
    first.setdefault(BLANK, least)
    inside = {p: w for p, w in weights.items() if not p.startswith(BLANK)}
    total = sum(first.values())
    inner = sum(inside.values()) + 256 * least
    return Pieces(
        {p: math.log(w / total) for p, w in first.items()},
        {p: math.log(w / inner) for p, w in inside.items()},
        math.log(least / inner),
        max(map(len, weights), default=1),
    )


def shared_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    return len(os.path.commonprefix((a, b)))


def token_counts(words: list[str], pieces: Pieces) -> dict[str, int]:
    """Tokens of each distinct word in its best segmentation (fewest tokens among equals).

    Words are inserted in a trie by being sorted: the best score and its count at each
    node are computed once for all words below it, and the terminal's count is the word's.
    A character outside the vocabulary is so many byte tokens.
    """
    first, inside, longest = pieces.first.get, pieces.inside.get, pieces.longest
    found = {}
    before, best, count = "", [0.0], [0]
    for word in sorted(words):
        marked = BLANK + word
        same = shared_prefix(before, marked)
        del best[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(marked) + 1):
            top, tokens = -math.inf, 0
            for start in range(max(0, end - longest), end):
                score = inside(marked[start:end]) if start else first(marked[:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and count[start] + 1 < tokens):
                        top, tokens = score, count[start] + 1
            if end > 1 and inside(marked[end - 1]) is None:
                n = len(marked[end - 1].encode("utf-8", "replace"))
                score = best[end - 1] + n * pieces.byte
                if score > top:
                    top, tokens = score, count[end - 1] + n
            best.append(top)
            count.append(tokens)
        before = marked
        found[word] = count[-1]
    return found
