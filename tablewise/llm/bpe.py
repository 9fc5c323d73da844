"""Byte-level BPE: texts to token ids and back, by replaying the merges over the corpus's words.

The words of all texts (matches of the split pattern) are counted, and the frequent ones, a
bounded number, are dealt out to partitions, each of which applies the merges to its words
together.  An inverted index leads from the rank of a token pair to the positions where that
pair stands; ranks are taken in order, each at all of its positions at once, and a merge only
touches the two neighbours of its position.  Words are independent of each other, so this
gives each word the tokens that merging it alone would give, at a cost in proportion to its
length rather than to its square, and once for all its occurrences.

Texts take the tokens of frequent words from a table beside them.  The rare words, a few in a
hundred, are merged in the same way by the task that meets them, all of a batch together:
joining them would have every text's ids written and shuffled once more.

Words, tokens and pieces stay in Arrow arrays: a batch of texts is split, looked up, joined
and decoded as a whole, without an object for each word.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import fresh, quoted, release_memory, small_batches, text_of, written
from tablewise.llm.words import binary_array, binary_parts, splitter

#: Words that are merged once for the whole corpus and broadcast.
FREQUENT = 1 << 18
#: Distinct words that a counting task holds before it passes them on, and bytes of words
#: that are merged together.
HELD = 300_000
MERGED_BYTES = 1 << 22
#: Pairs that are looked up one by one rather than by hashing.
_FEW = 1000
_KNOWN: dict[str, "Merges"] = {}


class PairTable:
    """Rank of the token that two tokens make, for whole arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(10, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size + 256, -1, np.int64)
        self.ranks = np.full(size + 256, -1, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.probes = 1
        for key, slot in zip(keys.tolist(), self._slots(keys).tolist()):
            probe = 0
            while self.keys[slot + probe] >= 0:
                probe += 1
            self.keys[slot + probe], self.ranks[slot + probe] = key, pairs[key]
            self.probes = max(self.probes, probe + 1)
        order = np.argsort(keys)
        self.sorted = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.sorted_ranks = np.append(values[order], -1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        if len(keys) < _FEW:
            at = self.sorted.searchsorted(keys)
            return np.where(self.sorted[at] == keys, self.sorted_ranks[at], -1)
        slots = self._slots(keys)
        found = np.where(self.keys[slots] == keys, self.ranks[slots], -1)
        for probe in range(1, self.probes):
            open_ = np.flatnonzero((found < 0) & (self.keys[slots + probe - 1] >= 0))
            if not len(open_):
                break
            near = slots[open_] + probe
            found[open_] = np.where(self.keys[near] == keys[open_], self.ranks[near], -1)
        return found


def merge_one(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one word: always the pair of least rank, the leftmost of equals."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        known = [r for r in found if r >= 0]
        if not known:
            break
        at = found.index(min(known))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def replay(
    words: list[bytes], ranks: dict[bytes, int], table: PairTable
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the tokens of all words in turn, and where each word's end.

    A vocabulary's merges never make a pair of smaller rank than their own.  Where one
    does all the same, the word is merged by itself.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    one_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)])
    symbol = one_byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
    n, ends = len(symbol), np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    # Positions of a batch of words fit into 32 bits.
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    some = lengths > 0
    after[ends[some] - 1] = -1
    before[(ends - lengths)[some]] = -1
    odd = np.zeros(len(words), bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def note(found: np.ndarray, places: np.ndarray) -> None:
        known = found >= 0
        if not known.any():
            return
        found, places = found[known], places[known]
        order = np.argsort(found, kind="stable")
        found, places = found[order], places[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        starts = [0, *cuts.tolist(), len(found)]
        for rank, start, end in zip(found[starts[:-1]].tolist(), starts, starts[1:]):
            if rank in index:
                index[rank].append(places[start:end])
            else:
                index[rank] = [places[start:end]]
                heapq.heappush(queue, rank)

    at = np.flatnonzero(after >= 0)
    note(table.find(symbol[at], symbol[at + 1]), at)
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank)
        at = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
        to = after[at]
        whole = to >= 0
        at, to = at[whole], to[whole]
        same = table.find(symbol[at], symbol[to]) == rank  # the pair may be another by now
        at, to = at[same], to[same]
        if not len(at):
            continue
        chained = np.append(False, to[:-1] == at[1:])
        if chained.any():  # of overlapping pairs every other one, from the left
            first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            every_other = (np.arange(len(at)) - first) % 2 == 0
            at, to = at[every_other], to[every_other]
        beyond = after[to]
        symbol[at], symbol[to] = rank, -1
        after[at], after[to] = beyond, -1
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        behind = before[at]
        outer = behind >= 0
        places = np.concatenate([at[inner], behind[outer]])
        found = table.find(symbol[places], symbol[np.concatenate([beyond[inner], at[outer]])])
        smaller = (found >= 0) & (found < rank)
        if smaller.any():
            odd[owner[places[smaller]]] = True
        note(found, places)
    kept = symbol >= 0
    ids = symbol[kept]
    ends = np.cumsum(np.bincount(owner[kept], minlength=len(words)))
    if odd.any():
        parts = np.split(ids, ends[:-1])
        for word in np.flatnonzero(odd):
            parts[word] = np.array(merge_one(words[word], ranks), np.int64)
        ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    return ids, ends


class Merges:
    """A vocabulary of ranks: words to packed little-endian ids, and ids to bytes.

    Ids are packed in two bytes where the vocabulary allows it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.table = ranks, PairTable(ranks)
        self.split, self.words = regex.compile(pattern).findall, splitter(pattern)
        self.type = np.dtype("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4")
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = pa.array(pieces, pa.binary())

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each of many words."""
        merged = [b""] * len(words)
        hard = []
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is None:
                hard.append(i)
            else:
                merged[i] = rank.to_bytes(self.type.itemsize, "little")
        if hard:
            ids, ends = replay([words[i] for i in hard], self.ranks, self.table)
            packed = ids.astype(self.type).tobytes()
            start = 0
            for i, end in zip(hard, (self.type.itemsize * ends).tolist()):
                merged[i] = packed[start:end]
                start = end
        return merged

    def coded(self, texts: pa.Array, known: pa.Array, known_ids: pa.Array) -> list[pa.Array]:
        """Ids of texts, four bytes each, and the bytes they stand for.

        ``known`` are distinct words whose packed ids are ``known_ids``; the others are merged.
        """
        words, bounds = self.words(texts)
        # Known words come first, so that what follows them in the dictionary is not known.
        each = pa.concat_arrays([known, words]).dictionary_encode()
        rare = each.dictionary[len(known) :].to_pylist()
        ids = pa.concat_arrays([known_ids, pa.array(self.merge(rare), pa.binary())])
        ends, packed = binary_parts(ids.take(each.indices[len(known) :]))
        flat = np.frombuffer(packed, self.type, ends[-1] // self.type.itemsize)
        cuts = ends[bounds] // self.type.itemsize
        starts, pieces = binary_parts(self.pieces.take(pa.array(flat)))
        return [binary_array(4 * cuts, flat.astype("<u4")), binary_array(starts[cuts], pieces)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """A few texts at once, without Spark; four bytes an id."""
        none = pa.array([], pa.binary())
        split = pa.array([t.encode() for t in texts], pa.binary())
        return self.coded(split, none, none)[0].to_pylist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.pieces.take(pa.array(np.frombuffer(ids, "<u4"))).to_pylist())


def read_ranks(path: str) -> bytes:
    """The rank file as it is; under a megabyte for a vocabulary of 50 000."""
    with open(path, "rb") as f:
        return f.read()


def _merges(content: bytes, pattern: str, name: str) -> Merges:
    if name not in _KNOWN:
        pairs = (line.split() for line in content.splitlines() if line)
        _KNOWN[name] = Merges({base64.b64decode(a): int(b) for a, b in pairs}, pattern)
    return _KNOWN[name]


def _summed(held: list[pa.Table]) -> pa.Table:
    """(word, n) of several such tables, each word once."""
    grouped = pa.concat_tables(held).group_by("word", use_threads=False)
    return grouped.aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def _word_counter(merges):
    """(word, n) of the words of a task; a word may come several times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, held, size = merges().words, [], 0
        for batch in batches:
            word, n = words_of(batch.column(0))[0].value_counts().flatten()
            held.append(pa.table({"word": word, "n": n}))
            size += len(word)
            if size > HELD:
                held = [_summed(held)]
                size = len(held[0])
            if size > HELD:
                yield from held[0].to_batches()
                held, size = [], 0
        if held:
            yield from _summed(held).to_batches()
        del held
        release_memory()

    return count


def _merger(merges):
    """(word, n, ids): all words of a task, some megabytes at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            part = pa.Table.from_batches(held)
            words = part.column("word").to_pylist()
            columns = [c.combine_chunks() for c in (part.column("word"), part.column("n"))]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(merges().merge(words), pa.binary())], ["word", "n", "ids"]
            )

        for batch in batches:
            held.append(batch)
            size += batch.column("word").nbytes
            if size > MERGED_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        release_memory()

    return merge


def word_counts(texts: DataFrame, merges) -> DataFrame:
    """(word, n): every distinct word of the one column of ``texts``.

    Only words are shuffled, summed up by task first.
    """
    counted = texts.mapInArrow(_word_counter(merges), "word binary, n long")
    return written(
        counted.groupBy("word").agg(F.sum("n").alias("n")), "words", compression="zstd"
    )


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words over the least count that at most ``most`` words reach; no task sorts them."""
    step = F.floor(F.log2("n") * 16).cast("int")
    least, taken = None, 0
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        taken += r["count"]
        if taken > most:
            break
        least = r["step"]
    return words.limit(0) if least is None else words.where(step >= least)


def _encoder(top, merges):
    """Ids of texts, four bytes each, and the bytes they stand for."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def encode(texts: pa.Array) -> pa.Array:
        out = pa.StructArray.from_arrays(merges().coded(texts, *top.value), ["ids", "decoded"])
        release_memory()
        return out

    return encode


def with_tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    names: tuple[str, str] = ("ids", "decoded"),
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with two more columns, named by ``names``; of its own those in ``keep``.

    The first has the text's token ids by the rank file at ``path``, packed as little-endian
    unsigned 32-bit integers (binary); the second the bytes that these ids stand for.  Null
    is empty, an empty text has no ids, malformed UTF-8 is replaced; there are no special
    tokens.  Repeated rows stay repeated.  The file is read once, on the driver, and broadcast:
    its size is that of the vocabulary, whatever the corpus.  ``docs`` is read twice.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(read_ranks(path))
    name = f"{path} {pattern}"

    def merges() -> Merges:
        return _merges(shared.value, pattern, name)

    text = text_of(text_col).cast("binary")
    words = frequent(word_counts(docs.select(text.alias("text")), merges), FREQUENT)
    best = words.mapInArrow(_merger(merges), "word binary, n long, ids binary").toArrow()
    top = context.broadcast(
        [best.column(c).cast(pa.binary()).combine_chunks() for c in ("word", "ids")]
    )
    coded = fresh(docs, "coded")
    own = [quoted(c) for c in (docs.columns if keep is None else keep)]
    return docs.withColumn(coded, _encoder(top, merges)(text)).select(
        *own, *[F.col(f"{coded}.{a}").alias(b) for a, b in zip(("ids", "decoded"), names)]
    )


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ids (packed), decoded (bytes), n_tokens.

    Repeated rows stay repeated and an empty table gives an empty table.
    """
    own = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return with_tokens(own, path, pattern, keep=["id"]).withColumn(
        "n_tokens", F.floor(F.length("ids") / 4).cast("long")
    )
