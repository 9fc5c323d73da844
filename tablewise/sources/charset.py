"""Which character set a file is written in, guessed from all its lines.

Files that are valid UTF-8 never come here.  For the others every line is read in each
candidate set, and the characters beyond ASCII are judged by their surroundings: accented
letters stand among Latin ones, Cyrillic letters among their like and with capitals in front,
Japanese is full of kana, Chinese of the frequent half of its characters.  What lines add up to
are a few numbers per file and set, so a file may be of any size and lie in any number of
tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least confidence of a guess; below it the file is read as latin-1.
LEAST_CONFIDENCE = 0.5
#: Least share of zero bytes in a file of two-byte units: line ends, digits and delimiters have one each.
ZERO_SHARE = 0.1

# --- fixed values: characters by which texts are judged ---------------------------
WESTERN_LETTERS = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœšžÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒŠŽ")
WESTERN_MARKS = frozenset("‘’“”„‚–—…€•™«»‹›°§£©®·¿¡ºª½¼¾²³±×")
CYRILLIC_WORDS = frozenset("авикосуя")
CYRILLIC_MARKS = frozenset("«»–—…№“”„’•€")

SETS = ("cp1252", "cp1251", "shift_jis", "gb18030")
#: What Spark's reader takes as it is; cells of other sets are recoded after reading.
SPARK_NAMES = {
    "utf-8": "UTF-8", "latin-1": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE",
}
PYTHON_NAMES = {"shift_jis": "cp932"}


def _ascii_letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z"


def _cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "џ"


def _western(before: str, c: str, after: str) -> float:
    if c in WESTERN_MARKS:
        return 0.7
    if c not in WESTERN_LETTERS:
        return 0.0
    if c.isupper() and before.islower():
        return 0.0
    near = _ascii_letter(before) or _ascii_letter(after)
    crowded = before in WESTERN_LETTERS and after in WESTERN_LETTERS
    return 0.0 if crowded else 1.0 if near else 0.3


def _russian(before: str, c: str, after: str) -> float:
    if c in CYRILLIC_MARKS:
        return 0.7
    if not _cyrillic(c) or _ascii_letter(before) or _ascii_letter(after):
        return 0.0
    if _cyrillic(before):
        return 0.0 if c.isupper() and before.islower() else 1.0
    return 1.0 if _cyrillic(after) else 0.7 if c in CYRILLIC_WORDS else 0.2


def _japanese(before: str, c: str, after: str) -> float:
    if "　" <= c <= "ヿ":
        return 1.0
    if "一" <= c <= "鿿":
        return 0.9 if c.encode("cp932")[0] <= 0x97 else 0.3
    return 0.2 if "｡" <= c <= "ﾟ" else 0.5 if "！" <= c <= "～" else 0.1


def _chinese(before: str, c: str, after: str) -> float:
    raw = c.encode("gb18030")
    if len(raw) != 2 or raw[1] < 0xA1:
        return 0.1
    return 0.9 if raw[0] <= 0xA3 else 1.0 if 0xB0 <= raw[0] <= 0xD7 else 0.3


_JUDGES = dict(zip(SETS, (_western, _russian, _japanese, _chinese)))


def judged(line: bytes, name: str) -> tuple[int, float]:
    """(characters beyond ASCII, how many of them are plausible) of a line in a set.

    A sequence that the set does not have counts as a character, against the set.
    """
    text = line.decode(PYTHON_NAMES.get(name, name), "replace")
    judge, n, good = _JUDGES[name], 0, 0.0
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        n += 1
        good += (
            -1.0
            if c == "�"
            else judge(text[i - 1] if i else " ", c, text[i + 1] if i + 1 < len(text) else " ")
        )
    return n, good


def two_byte_order(line: bytes) -> int:
    """1 for little-endian, -1 for big-endian, 0 where the zero bytes of a line do not tell.

    A line that starts with a zero byte may have it from the line end before (little-endian)
    or from its own first character.
    """
    if line[:2] == b"\xff\xfe" or line[:2] == b"\xfe\xff":
        return 1 if line[0] == 0xFF else -1
    if not line or line[0] == 0:
        return 0
    low, high = line[1::2].count(0), line[0::2].count(0)
    return (low > high) - (low < high)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, charset, n, good) summed up by batch."""
    for batch in batches:
        sums: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
        for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            order = two_byte_order(line)
            sums[path, "order"][0] += 1
            sums[path, "order"][1] += order
            if not line.isascii():
                for name in SETS:
                    n, good = judged(line, name)
                    sums[path, name][0] += n
                    sums[path, name][1] += good
                if any(0x80 <= b <= 0x9F for b in line):
                    sums[path, "c1"][0] += 1
        keys, values = list(sums), list(sums.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([v[0] for v in values], pa.float64()),
                pa.array([v[1] for v in values], pa.float64()),
            ],
            ["path", "charset", "n", "good"],
        )


def _zero_bytes(value: Column) -> Column:
    raw = value.cast("binary")
    return F.octet_length(raw) - F.octet_length(F.replace(value, F.lit("\x00"), F.lit("")))


def byte_facts() -> list[Column]:
    """Aggregates over the lines (value) of a file that settle whether it is UTF-8."""
    raw = F.col("value").cast("binary")
    zeros = F.sum(_zero_bytes(F.col("value"))) > F.sum(F.octet_length("value")) * ZERO_SHARE
    return [
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.coalesce(zeros, F.lit(False)).alias("zeros"),
        F.bool_or(F.substring(raw, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))).alias("mark"),
    ]


def is_utf8(facts) -> bool:
    return facts["valid"] and not facts["zeros"]


def guesses(lines: DataFrame, open_files: dict[str, bool]) -> dict[str, tuple[str, float]]:
    """(encoding, confidence) of files that are not UTF-8; ``lines`` has (path, value).

    ``open_files`` says which files may be in two-byte units: these are utf-16-le or -be, by
    the places of their zero bytes.  Others are the most plausible set, at a confidence of 0.5
    or more, and latin-1 as the last resort.  Where a Western file has none of the bytes in
    which latin-1 and cp1252 differ it is latin-1.  One row per file and set reaches the driver.
    """
    if not open_files:
        return {}
    wanted = lines.sparkSession.createDataFrame([(p,) for p in open_files], "path string")
    votes = (
        lines.join(F.broadcast(wanted), "path", "left_semi")
        .select("path", F.col("value").cast("binary").alias("value"))
        .mapInArrow(_votes, "path string, charset string, n double, good double")
        .groupBy("path", "charset")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        .collect()
    )
    found: dict[str, dict[str, tuple[float, float]]] = {p: {} for p in open_files}
    for r in votes:
        found[r["path"]][r["charset"]] = (r["n"], r["good"])
    return {p: _decided(open_files[p], own) for p, own in found.items()}


def _decided(wide: bool, votes: dict[str, tuple[float, float]]) -> tuple[str, float]:
    if wide:
        return ("utf-16-le" if votes.get("order", (0, 0))[1] > 0 else "utf-16-be"), 1.0
    # How much of what is beyond ASCII is plausible, of all characters that the set would have.
    shares = {name: max(0.0, votes[name][1] / votes[name][0]) for name in SETS if votes.get(name, (0,))[0]}
    best = max(shares, key=shares.get, default="cp1252")
    share = round(shares.get(best, 0.0), 3)
    plain = best == "cp1252" and "c1" not in votes
    return (best if share >= LEAST_CONFIDENCE and not plain else "latin-1"), share


def recoded(df: DataFrame, encoding: str) -> DataFrame:
    """Text cells and names that were read as latin-1, byte by byte, in their own set."""
    own = PYTHON_NAMES.get(encoding, encoding)
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]

    @F.arrow_udf("string")
    def decode(cells: pa.Array) -> pa.Array:
        return pa.array(
            [
                None if t is None else t if t.isascii() else t.encode("latin-1").decode(own, "replace")
                for t in cells.to_pylist()
            ],
            pa.string(),
        )

    out = df.withColumns({c: decode(F.col("`" + c.replace("`", "``") + "`")) for c in texts})
    return out.toDF(*[c.encode("latin-1", "replace").decode(own, "replace") for c in df.columns])
