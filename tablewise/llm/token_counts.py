"""Token counts under an existing unigram vocabulary, without writing tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import quoted, small_batches, text_of
from tablewise.llm.pieces import Pieces, read_pieces, token_counts

#: Words whose counts a Python worker remembers; beyond it starts anew.
REMEMBERED = 200_000
_KNOWN: dict[str, dict[bytes, int]] = {}


def _count(texts: list[list[bytes]], pieces: Pieces, known: dict[bytes, int]) -> list[int]:
    if len(known) > REMEMBERED:
        known.clear()
    new = set().union(*texts) - known.keys()
    decoded = {raw: raw.decode("utf-8", "replace") for raw in new}
    counts = token_counts(list(set(decoded.values())), pieces)
    known.update({raw: counts[word] for raw, word in decoded.items()})
    get = known.__getitem__
    return [sum(map(get, words)) for words in texts]


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens.

    Words are split at ASCII white space and marked at their beginning; a word has the
    tokens of its best segmentation.  Null and empty texts have none; repeated rows stay
    repeated; an empty table gives an empty table.  Each task inserts the distinct words
    of its batch in a trie; the vocabulary is broadcast, its size being that of its file.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path))

    @F.arrow_udf("struct<n_words: long, n_tokens: long>")
    def counts(texts: pa.Array) -> pa.Array:
        words = [t.as_py().split() for t in texts]
        tokens = _count(words, shared.value, _KNOWN.setdefault(path, {}))
        return pa.StructArray.from_arrays(
            [pa.array(list(map(len, words)), pa.int64()), pa.array(tokens, pa.int64())],
            ["n_words", "n_tokens"],
        )

    return docs.select(
        F.col(quoted(id_col)).alias("id"), counts(text_of(text_col).cast("binary")).alias("c")
    ).select("id", "c.n_words", "c.n_tokens")
