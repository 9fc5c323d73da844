"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level BPE vocabulary (A) and a piece vocabulary (B) both tile a text's bytes.  All
tokens of both sides are sorted by their starts and a running maximum of their ends is
kept: where a start reaches the maximum, no token crosses, and a new group begins.  Within
a group every A token is expanded into the B tokens that it overlaps; overlaps whose
tokens end together are links.  How often each pair of ids is linked is counted over the
whole corpus.

Two tokens that end together are one a suffix of the other, so the pairs that can be
linked at all follow from the two vocabularies (about as many as these have tokens, times
the tokens among a token's suffixes), whatever the corpus.  Their table is what is broadcast.

The tokens come from the vocabularies' own libraries.  A byte-level vocabulary whose merges
make their tokens in the order of the ids is run by ranks, which gives the same ids in less time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import quoted, release_memory, small_batches, text_of, written

#: Bytes of texts whose tokens are sorted together.
SLICE = 1 << 19
_KNOWN: dict[tuple, "Vocabularies"] = {}


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable bytes stand for
    themselves, the others for the code points from 256 on, in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers with the bytes of their tokens; ``files`` are the files' contents."""

    def __init__(self, files: tuple[bytes, bytes], pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec, letters = json.loads(files[0]), _byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        plain = {i: t for t, i in spec["model"]["vocab"].items() if i not in special}
        ranks = {bytes(letters[c] for c in t): i for i, t in plain.items()}
        self.a = [b""] * (1 + max(plain, default=-1))
        for raw, i in ranks.items():
            self.a[i] = raw
        if self._in_order(spec["model"]) and spec.get("normalizer") is None:
            own = tiktoken.Encoding(
                "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )
            self._encode_a = lambda texts: [own.encode_to_numpy(t, disallowed_special=()) for t in texts]
        else:
            library = Tokenizer.from_str(files[0].decode())
            library.encode_special_tokens = True
            self._encode_a = lambda texts: [
                e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)
            ]
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        self.b = [
            bytes([int(piece[3:-1], 16)])
            if self._pieces.is_byte(i)
            else piece.replace("▁", " ").encode()
            for i in range(self._pieces.get_piece_size())
            for piece in [self._pieces.id_to_piece(i)]
        ]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in v], np.int64) for v in (self.a, self.b))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(v), np.uint8) for v in (self.a, self.b))

    @staticmethod
    def _in_order(model: dict) -> bool:
        """Whether merges make tokens in the order of their ids, single bytes being first."""
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        return (
            all(x < y for x, y in zip(made, made[1:]))
            and len(made) + 256 <= len(vocab)
            and min(made, default=0) >= 0
        )

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A ids of space and text, B ids of text; none where the tokens' bytes are not the text's."""
        raw = [(" " + t).encode() if t else b"" for t in texts]
        filled = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in filled]
        nothing = np.zeros(0, np.int64)
        coded = [[nothing] * len(texts) for _ in range(2)]
        found = (self._encode_a([" " + t for t in some]), self._pieces.encode(some, num_threads=1))
        for ids, own in zip(coded, found):
            for i, x in zip(filled, own):
                ids[i] = np.asarray(x, np.int64)
        wrong = self._unlike(coded[0], self.a_flat, self.a_sizes, raw)
        wrong |= self._unlike(coded[1], self.b_flat, self.b_sizes, raw)
        for i in np.flatnonzero(wrong):
            coded[0][i] = coded[1][i] = nothing
        return coded[0], coded[1]

    @staticmethod
    def _unlike(ids: list[np.ndarray], flat: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which texts are not what their tokens' bytes make up."""
        lengths = np.array([len(r) for r in raw], np.int64)
        made = np.array([int(sizes[x].sum()) for x in ids], np.int64)
        wrong = lengths != made
        like = np.flatnonzero(~wrong)
        if not len(like):
            return wrong
        tokens = np.concatenate([ids[i] for i in like])
        if len(tokens):
            size = sizes[tokens]
            ends = np.cumsum(size)
            # The place of every byte: its token's bytes begin where the vocabulary has them.
            begins = np.cumsum(sizes) - sizes
            at = np.arange(ends[-1]) + np.repeat(begins[tokens] - (ends - size), size)
            off = flat[at] != np.frombuffer(b"".join(raw[i] for i in like), np.uint8)
            if off.any():
                wrong[like[np.unique(np.cumsum(lengths[like]).searchsorted(np.flatnonzero(off), "right"))]] = True
        return wrong

    def pairs(self) -> np.ndarray:
        """All pairs of ids (A id * size of B + B id) that can end together, sorted."""
        by_bytes: list[dict[bytes, list[int]]] = []
        for tokens in (self.a, self.b):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(tokens):
                if t:
                    ids.setdefault(t, []).append(i)
            by_bytes.append(ids)
        ids_a, ids_b = by_bytes
        found = set()
        for one, other, turned in ((ids_a, ids_b, False), (ids_b, ids_a, True)):
            for token, ids in one.items():
                for cut in range(len(token)):
                    for j in other.get(token[cut:], ()):
                        for i in ids:
                            found.add((j, i) if turned else (i, j))
        keys = np.array([a * len(self.b) + b for a, b in found], np.int64)
        return np.sort(keys)


def vocabularies(files: tuple[bytes, bytes], pattern: str, name: tuple) -> Vocabularies:
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = Vocabularies(files, pattern)
    return _KNOWN[name]


def group_tokens(
    a_sizes: np.ndarray, b_sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(groups of the A tokens, of the B tokens, linked A tokens, linked B tokens).

    The sizes are the tokens' bytes; both sides tile the same stretch.
    """
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    if len(a_end) and a_end[-1] < 1 << 31:
        a_end, b_end = a_end.astype(np.int32), b_end.astype(np.int32)
        a_sizes, b_sizes = a_sizes.astype(np.int32), b_sizes.astype(np.int32)
    a_start, b_start = a_end - a_sizes, b_end - b_sizes
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((start,))
    reach = np.maximum.accumulate(end[order])
    breaks = np.append(True, start[order][1:] >= reach[:-1])[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = b_end.searchsorted(a_start, "right")
    count = b_start.searchsorted(a_end, "left") - first
    a_of = np.repeat(np.arange(len(a_end)), count)
    b_of = np.arange(len(a_of)) - np.repeat(np.cumsum(count) - count, count) + first[a_of]
    together = a_end[a_of] == b_end[b_of]
    return group[: len(a_end)], group[len(a_end) :], a_of[together], b_of[together]


def _packed(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = values.astype("<u4").tobytes()
    cuts = [0, *(4 * ends).tolist()]
    return [raw[x:y] for x, y in zip(cuts, cuts[1:])]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SPANS = ("a_ids", "b_ids", "a_groups", "b_groups", "links")


def _aligned(vocab: Vocabularies, pairs: np.ndarray, texts: list[str]) -> list[pa.Array]:
    coded = vocab.encode(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in coded)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    a, b = (np.concatenate(side) for side in coded)
    group_a, group_b, link_a, link_b = group_tokens(vocab.a_sizes[a], vocab.b_sizes[b])
    n_groups = 1 + (group_a[-1] if len(group_a) else -1)
    per_a, per_b = (np.bincount(g, minlength=n_groups) for g in (group_a, group_b))
    # Every text ends a group, so the groups up to a text's last token are those of the texts so far.
    last = np.append(-1, group_a)[ends_a] if len(group_a) else np.full(len(ends_a), -1)
    ends_groups = np.maximum.accumulate(last) + 1
    ends_links = link_a.searchsorted(ends_a, "left")
    links = pairs.searchsorted(a[link_a] * len(vocab.b) + b[link_b])
    numbers = [n_a, n_b, np.diff(ends_groups, prepend=0), np.diff(ends_links, prepend=0)]
    spans = [
        _packed(a, ends_a),
        _packed(b, ends_b),
        _packed(per_a, ends_groups),
        _packed(per_b, ends_groups),
        _packed(links, ends_links),
    ]
    return [pa.array(x, pa.int64()) for x in numbers] + [pa.array(x, pa.binary()) for x in spans]


def align(
    docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, np.ndarray]:
    """(one row per row of ``docs``, the pairs of ids that can be linked).

    Columns: id; n_a, n_b, n_groups, n_links; and, packed as little-endian unsigned 32-bit
    integers, a_ids and b_ids (the tokens), a_groups and b_groups (how many tokens of each
    side make up each group), links (each link as its place in the pairs, which are sorted
    numbers ``A id * size of B + B id``).  The text is encoded as space and text by A and as
    text by B, without special tokens.  A null or empty text, and one whose tokens' bytes
    differ from space and text on either side, has none of all these.  Repeated rows stay
    repeated, malformed UTF-8 is replaced, an empty table gives an empty table.

    The files are read once, on the driver, and broadcast.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            contents.append(f.read())
    files, name = (contents[0], contents[1]), (a_path, b_path, pattern)
    pairs = vocabularies(files, pattern, name).pairs()
    shared = context.broadcast((files, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, pairs = shared.value
        vocab = vocabularies(files, pattern, name)
        for batch in batches:
            texts, at = [t.as_py().decode("utf-8", "replace") for t in batch.column(1)], 0
            for part in _slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *_aligned(vocab, pairs, part)],
                    ["id", *_COUNTS, *_SPANS],
                )
                at += len(part)
        release_memory()

    own = docs.select(F.col(quoted(id_col)).alias("id"), text_of(text_col).cast("binary").alias("text"))
    schema = (
        f"id {own.schema['id'].dataType.simpleString()}, "
        + ", ".join(f"{c} long" for c in _COUNTS)
        + ", "
        + ", ".join(f"{c} binary" for c in _SPANS)
    )
    return own.mapInArrow(run, schema), pairs


def pair_counts(aligned: DataFrame, pairs: np.ndarray) -> np.ndarray:
    """How many links of all texts hold each of the pairs; a task sends one row per pair it met."""
    size = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(totals, np.frombuffer(x.as_py(), "<u4"), 1)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["pair", "n"])

    rows = (
        aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = np.zeros(size, np.int64)
    counts[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return counts


def best_of_b(counts: np.ndarray, pairs: np.ndarray, size_b: int) -> np.ndarray:
    """Whether a pair's count is the highest of its B id (ties included)."""
    highest = np.zeros(size_b, np.int64)
    np.maximum.at(highest, pairs % size_b, counts)
    return (counts > 0) & (counts == highest[pairs % size_b])


class GroupText:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``, decimal ids in order."""

    def __init__(self, size: int):
        numbers = [str(i) for i in range(size)]
        self.size = size
        # A token's number and what follows it: more tokens, the other side, the next group, nothing.
        self.parts = [n + after for after in (",", "|", ";", "") for n in numbers]

    def __call__(self, a, b, per_a, per_b) -> str:
        if not len(per_a):
            return ""
        n = len(per_a)
        per = np.column_stack([per_a, per_b]).ravel()
        ends = np.cumsum(per)
        after = np.zeros(ends[-1], np.int64)
        after[ends[0::2] - 1], after[ends[1::2] - 1] = 1, 2
        after[-1] = 3
        side_b = np.repeat(np.tile([False, True], n), per)
        ids = np.empty(ends[-1], np.int64)
        ids[~side_b], ids[side_b] = a, b
        return "".join(map(self.parts.__getitem__, (after * self.size + ids).tolist()))


def alignment_report(
    docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose pair is counted as often as any pair of its B id; ``count_sum``:
    the counts of the links' pairs.  ``groups_sha256`` is the hash of the groups as text
    (see ``GroupText``), '' without tokens.  Otherwise as ``align``.
    """
    frame, pairs = align(docs, a_path, b_path, pattern, id_col, text_col)
    aligned = written(frame, "aligned", compression="zstd")
    counts = pair_counts(aligned, pairs)
    vocab = _KNOWN[(a_path, b_path, pattern)]
    best = best_of_b(counts, pairs, len(vocab.b))
    most = max(len(vocab.a), len(vocab.b))
    shared = docs.sparkSession.sparkContext.broadcast((counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, best), text = shared.value, GroupText(most)
        for batch in batches:
            n_best, count_sum, digests = [], [], []
            for row in zip(*(batch.column(c) for c in _SPANS)):
                a, b, per_a, per_b, links = (np.frombuffer(x.as_py(), "<u4") for x in row)
                n_best.append(int(best[links].sum()))
                count_sum.append(int(counts[links].sum()))
                groups = text(a, b, per_a, per_b)
                digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", *_COUNTS)),
                    pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(digests, pa.string()),
                ],
                ["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"],
            )
        release_memory()

    id_type = aligned.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum"))
    return aligned.mapInArrow(run, f"id {id_type}, {numbers}, groups_sha256 string")
