"""Zip and xz files: their text is unpacked once into the shared folder.

Neither can be read from the middle, so a member is unpacked by one task, which streams it:
a block of compressed bytes in, a batch of lines out.  What is written are plain files, one
per member, which Spark then splits like any other; later passes do not unpack again.
"""

from __future__ import annotations

import io
import lzma
import posixpath
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tablewise.sources.manifest import listed_files
from tablewise.sources.scratch import scratch_path

SUFFIXES = ("zip", "xz")
#: Bytes that are read at once, and of lines that a batch has.
BLOCK = 1 << 20


class ArchiveError(ValueError):
    """An archive that cannot be unpacked: no members, encrypted, or out of reach."""


def suffix_of(path: str) -> str:
    return posixpath.basename(path.rstrip("/")).lower().rpartition(".")[2]


class _Source(io.BufferedReader):
    """A stream that refuses places before its start as Python's files do: with an OSError.

    By it zipfile tells that a file is too short for a long header, as one without members is.
    """

    def seek(self, place: int, whence: int = io.SEEK_SET) -> int:
        try:
            return super().seek(place, whence)
        except pa.ArrowInvalid as exc:
            raise OSError(str(exc)) from exc


@contextmanager
def _opened(path: str):
    """A file of any store that pyarrow knows, as a stream that can be positioned."""
    scheme, mark, rest = path.partition(":")
    uri = f"{scheme}://{rest}" if mark and rest.startswith("/") and not rest.startswith("//") else path
    store, name = fs.FileSystem.from_uri(uri) if mark else (fs.LocalFileSystem(), path)
    with store.open_input_file(name) as source:
        yield _Source(source, BLOCK)


def _is_data(member: zipfile.ZipInfo) -> bool:
    """No folders, and no files that archivers and systems add for themselves."""
    parts = member.filename.split("/")
    return not member.is_dir() and not any(p.startswith((".", "_")) for p in parts)


def _members_of(path: str) -> list[str]:
    """Names of an archive's members; an xz file has one, without a name."""
    if suffix_of(path) == "xz":
        return [""]
    with _opened(path) as source, zipfile.ZipFile(source) as archive:
        found = [m for m in archive.infolist() if _is_data(m)]
        if any(m.flag_bits & 1 for m in found):
            raise ArchiveError(f"encrypted: {path}")
        return [m.filename for m in found]


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, m) for p in batch.column(0).to_pylist() for m in _members_of(p)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["path", "member"]
        )


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member) of every archive under ``path``; only tables of contents are read."""
    files = listed_files(spark, path).select("path")
    wanted = files.where(" OR ".join(f"lower(path) LIKE '%.{s}'" for s in SUFFIXES))
    return wanted.mapInArrow(_listing, "path string, member string")


@contextmanager
def _stream(path: str, member: str):
    with _opened(path) as source:
        if suffix_of(path) == "xz":
            with lzma.open(source) as text:
                yield text
        else:
            with zipfile.ZipFile(source) as archive, archive.open(member) as text:
                yield text


def lines_of(text) -> Iterator[list[bytes]]:
    """The lines of a stream without their line feeds, some of them at a time."""
    rest = b""
    while block := text.read(BLOCK):
        *whole, rest = (rest + block).split(b"\n")
        if whole:
            yield whole
    if rest:
        yield [rest]


def unpacked(spark: SparkSession, path: str) -> str:
    """A folder in the session's shared folder with one plain file for each member.

    Bytes stay what they are, in any character set.  A line has to fit into memory, a member
    or an archive has not.
    """
    found = [(r["path"], r["member"]) for r in members(spark, path).sort("path", "member").collect()]
    if not found:
        raise ArchiveError(f"nothing to unpack at {path}")
    listed = spark.sparkContext.broadcast(found)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                with _stream(*listed.value[n]) as text:
                    for lines in lines_of(text):
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])

    out = scratch_path(spark, "unpacked")
    # A range deals out its numbers evenly: one member to each task, and so one file.
    rows = spark.range(0, len(found), 1, len(found)).mapInArrow(unpack, "value binary")
    rows.selectExpr("CAST(value AS STRING) AS value").write.text(out)
    return out
