"""Readers, writers and the file manifest."""

import gzip
import io
import json
import lzma
import zipfile

import pytest
from pyspark.sql import functions as F

from catalogue import storage
from conftest import rows_of
from tablewise.sources import archives, manifest, readers, writers
from tablewise.sources.manifest import file_manifest
from tablewise.sources.scratch import NoSharedFolderError, scratch_path


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


@pytest.mark.parametrize(
    "path, want",
    [("data.CSV", "csv"), ("/x/y.parquet/", "parquet"), ("a.b.tsv.gz", "tsv"), ("z.ndjson", "json")],
)
def test_formats(path, want):
    assert readers.format_of(path) == want


@pytest.mark.parametrize("path", ["malware.exe", "README", "book.xlsx", "a.parquet.zip", "a.exe.xz", "a.gz"])
def test_unsupported(path):
    with pytest.raises(readers.UnsupportedFileError):
        readers.format_of(path)


def test_csv_types_marks_and_headers(spark, tmp_path):
    path = put(
        tmp_path, "t.csv",
        "﻿ id , when,ok,x,code,note\n1,2024-01-05,True,1.5,007,\"a, b\"\n"
        "2,2024-1-6 10:30,false,NA,8,\"say \"\"hi\"\"\"\n3,,TRUE,3,9,null\n",
    )
    df = readers.load(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint", "when": "timestamp_ntz", "ok": "boolean", "x": "double", "code": "bigint",
        "note": "string",
    }
    rows = df.orderBy("id").collect()
    assert [r["x"] for r in rows] == [1.5, None, 3.0]
    assert [r["note"] for r in rows] == ["a, b", 'say "hi"', None]
    assert str(rows[1]["when"]) == "2024-01-06 10:30:00" and rows[2]["when"] is None


def test_csv_dialects_and_compression(spark, tmp_path):
    put(tmp_path, "a.csv", "id;name\n1;caf\xe9\n".encode("latin-1"))
    put(tmp_path, "b.csv", "id,name\n2,naïve\n")
    put(tmp_path, "c.csv", "id|name|extra\n3|x|9\n")
    df = readers.read_csv(spark, str(tmp_path))
    assert rows_of(df, "id", "name", "extra") == [(1, "café", None), (2, "naïve", None), (3, "x", 9)]
    zipped = tmp_path / "z"
    zipped.mkdir()
    put(zipped, "d.csv.gz", gzip.compress("id;name\n4,5;café\n".encode("latin-1")))
    assert rows_of(readers.load(spark, str(zipped / "d.csv.gz")), "*") == [("4,5", "café")]
    put(zipped, "e.json.gz", gzip.compress(json.dumps([{"a": 1}, {"a": 2}], indent=1).encode()))
    assert rows_of(readers.load(spark, str(zipped / "e.json.gz")), "*") == [(1,), (2,)]


def test_bytes_far_down_a_file_count(spark, tmp_path):
    late = put(tmp_path, "late.csv", ("id;name\n" + "1;plain\n" * 30_000 + "2;caf\xe9\n").encode("latin-1"))
    df = readers.load(spark, late)
    assert df.count() == 30_001
    assert df.where("id = 2").first()["name"] == "café"
    assert df.where(F.col("name").contains("\ufffd")).count() == 0


def test_header_clash(spark, tmp_path):
    path = put(tmp_path, "t.csv", "a, a\n1,2\n")
    with pytest.raises(ValueError):
        readers.load(spark, path)


def test_dates_are_all_or_nothing(spark):
    df = spark.createDataFrame([("2024-01-05", "2024-01-05"), ("2024-02-30", None)], "a string, b string")
    assert dict(readers.promote_dates(df).dtypes) == {"a": "string", "b": "timestamp_ntz"}


def test_json_layouts(spark, tmp_path):
    array = put(tmp_path, "array.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], indent=1))
    lines = put(tmp_path, "lines.jsonl", '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    single = put(tmp_path, "single.json", json.dumps({"a": 1, "b": "x"}, indent=2))
    lists = put(tmp_path, "lists.json", json.dumps({"a": [1, 2], "b": ["x", "y"]}))
    ragged = put(tmp_path, "ragged.json", json.dumps({"a": [1, 2], "b": ["x"]}))
    both = [(1, "x"), (2, "y")]
    for path in (array, lines, lists):
        assert rows_of(readers.load(spark, path), "a", "b") == both
    assert rows_of(readers.load(spark, single), "a", "b") == [(1, "x")]
    with pytest.raises(Exception, match="differ in length"):
        readers.load(spark, ragged).collect()


def test_manifest(spark, tmp_path):
    put(tmp_path, "bom.csv", b"\xef\xbb\xbfa\tb\n1\t2\n")
    put(tmp_path, "latin.csv", b"a;b\n\xe9;2\n")
    put(tmp_path, "_hidden.csv", "a,b\n")
    got = {r["path"].rsplit("/", 1)[1]: r for r in file_manifest(spark, str(tmp_path)).collect()}
    assert set(got) == {"bom.csv", "latin.csv"}
    assert (got["bom.csv"]["encoding"], got["bom.csv"]["delimiter"]) == ("utf-8", "\t")
    assert (got["latin.csv"]["encoding"], got["latin.csv"]["delimiter"]) == ("latin-1", ";")


@pytest.mark.parametrize(
    "content, encoding, delimiter, layout",
    [
        (("é" * 40_000).encode(), "utf-8", ",", "document"),
        (b"\xe9t\xe9", "latin-1", ",", "document"),
        (b"one\ntwo\n", "utf-8", ",", "document"),
        (b'"a,b";c\n"d,e";f\n', "utf-8", ";", "document"),
        (b"a|b|c\nd|e|f\ng,h\n", "utf-8", "|", "document"),
        (b' {"a": 1}\n', "utf-8", ",", "lines"),
        (b'{\n "a": 1}', "utf-8", ",", "document"),
        (b'[\n{"a": 1},\n{"a": 2},\n{"a": 3}\n]', "utf-8", ",", "document"),
        (b'\xef\xbb\xbf{"a": 1}\n{"a": 2}\n', "utf-8", ",", "lines"),
    ],
)
def test_manifest_rules(spark, tmp_path, content, encoding, delimiter, layout):
    put(tmp_path, "file.txt", content)
    (r,) = file_manifest(spark, str(tmp_path)).collect()
    assert (r["bytes"], r["encoding"], r["delimiter"], r["json_layout"]) == (
        len(content), encoding, delimiter, layout
    )


def test_scratch_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(NoSharedFolderError):
        scratch_path(Session, "x")

def test_write_csv_and_read_back(spark, tmp_path, clean_table):
    out = str(tmp_path / "clean.csv")
    writers.write_csv(clean_table, out)
    assert rows_of(readers.load(spark, out), "*") == rows_of(clean_table, "*")


def test_empty_csv_has_a_header(spark, tmp_path, empty_table):
    out = str(tmp_path / "empty.csv")
    writers.write_csv(empty_table, out)
    assert [r[0] for r in spark.read.text(out).collect()] == ["a,b"]


def test_nested_and_odd_types(spark, tmp_path):
    df = spark.sql(
        "SELECT 1 AS a, array(1, 2) AS n, parse_json('{\"k\": 1}') AS v, null AS z, "
        "interval '1' day AS d, timestamp_ntz'2024-01-01 10:00:00.000123' AS t"
    )
    writers.write_csv(df, str(tmp_path / "odd.csv"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "odd.csv")).collect()]
    assert "2024-01-01 10:00:00.000123" in text[1] and '""k"":1' in text[1]
    writers.write_parquet(df, str(tmp_path / "odd.parquet"))
    back = readers.load(spark, str(tmp_path / "odd.parquet"))
    assert dict(back.dtypes)["v"] == "string" and back.first()["n"] == [1, 2]


def test_capped(spark):
    assert readers.capped(spark.range(100), 7).count() == 7
    got = readers.capped(spark.range(100).selectExpr("100 - id AS x"), 3, ["x"])
    assert sorted(r["x"] for r in got.collect()) == [1, 2, 3]


def people(spark, n):
    return spark.range(0, n, 1, 3).select(
        F.col("id").alias("c_custkey"), F.format_string("p%d", "id").alias("note"),
        F.format_string("n%d", "id").alias("pan_no"),
    )


def test_json_documents_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(storage, "DOCUMENT_ROWS", 16, raising=False)
    df = storage._json_gz(people(spark, 100))
    sizes = [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 9 and max(sizes) <= 16  # 33, 33 and 34 rows in three partitions
    assert rows_of(df, "c_custkey", "note", "pan_no") == sorted(
        [(i, f"ref p{i}", f"n{i}") for i in range(100)], key=repr
    )


def test_late_byte_among_several_files(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = storage._late_latin(people(spark, 100))
        files = {r["path"]: [] for r in df.select(F.input_file_name().alias("path")).collect()}
        assert len(files) > 1
        for path, lines in files.items():
            raw = spark.read.format("binaryFile").load(path).first()["content"]
            lines += bytes(raw).splitlines()
        late = [lines for lines in files.values() if not b"".join(lines).isascii()]
        assert len(late) == 1 and b"".join(late[0][:-1]).isascii()
        assert rows_of(df, "c_custkey", "note", "pan_no") == sorted(
            [(i, f"p{i}", f"n{i}") for i in range(99)] + [(99, "Café", "n99")], key=repr
        )
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


CHARSETS = {
    "utf-8": ("naïve 日本", "id,name\n1,naïve 日本\n"),
    "latin-1": ("Café für Ölçü", None),
    "cp1252": ("l’été – 5 €", None),
    "cp1251": ("Привет, Иван Щукин", None),
    "shift_jis": ("東京都渋谷区のデータ", None),
    "gb18030": ("北京市海淀区数据分析", None),
    "utf-16-le": ("Ивановo 日本", None),
    "utf-16-be": ("Émile Žižek", None),
}


def in_charset(encoding, ids, text):
    rows = "".join(f'{i};"{text} {i}";plain\r\n' for i in ids)
    content = f"id;{text[:4]};note\r\n{rows}".encode("cp932" if encoding == "shift_jis" else encoding)
    return {"utf-16-le": b"\xff\xfe"}.get(encoding, b"") + content


@pytest.mark.parametrize("encoding", [e for e in CHARSETS if e != "utf-8"])
def test_charsets_are_guessed_and_read_back(spark, tmp_path, encoding):
    text = CHARSETS[encoding][0]
    path = put(tmp_path, "t.csv", in_charset(encoding, range(1, 40), text))
    (r,) = file_manifest(spark, path).collect()
    assert r["encoding"] == encoding and r["confidence"] >= 0.5
    assert r["delimiter"] == ";"
    df = readers.load(spark, path)
    assert df.columns == ["id", text[:4].strip(), "note"]
    assert rows_of(df, "*") == sorted([(i, f"{text} {i}", "plain") for i in range(1, 40)], key=repr)


def test_files_of_many_charsets_load_together(spark, tmp_path):
    want = []
    for n, (encoding, (text, _)) in enumerate(CHARSETS.items()):
        body = f"id,name\n{n},{text.replace(',', '')}\n"
        put(tmp_path, f"{n}.csv", body.encode("cp932" if encoding == "shift_jis" else encoding))
        want.append((n, text.replace(",", "")))
    got = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in file_manifest(spark, str(tmp_path)).collect()}
    assert got == {f"{n}.csv": encoding for n, encoding in enumerate(CHARSETS)}
    assert rows_of(readers.read_csv(spark, str(tmp_path)), "id", "name") == sorted(want, key=repr)
    schema = "id bigint, name string"
    russian = readers.read_csv(spark, str(tmp_path / "3.csv"), encoding="cp1251", sep=",", schema=schema)
    assert russian.collect() == [want[3]] and russian.dtypes[0] == ("id", "bigint")


def test_bytes_of_no_charset_are_latin1(spark, tmp_path):
    put(tmp_path, "noise.csv", b"a,b\n" + bytes([0xA4, 0x20, 0xAC, 0x2C, 0xA6, 0x20, 0xB8, 0x0A]) * 30)
    put(tmp_path, "empty.csv", b"")
    (r,) = file_manifest(spark, str(tmp_path / "noise.csv")).collect()
    assert r["encoding"] == "latin-1" and r["confidence"] < 0.5
    assert readers.load(spark, str(tmp_path / "noise.csv")).first()["a"] == "¤ ¬"


def test_zip_members_load_like_plain_files(spark, tmp_path):
    path = tmp_path / "both.csv.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", "id,name\n1,naïve\n2,\"a, b\"\n")
        z.writestr("deep/two.csv", in_charset("cp1251", range(3, 9), "Привет Иван"))
        z.writestr("__MACOSX/._one.csv", b"\x00\x01")
        z.writestr("deep/", b"")
    got = readers.load(spark, str(path)).select("id", "name", "Прив")
    assert rows_of(got, "*") == sorted(
        [(1, "naïve", None), (2, "a, b", None), *((i, None, f"Привет Иван {i}") for i in range(3, 9))],
        key=repr,
    )
    assert readers.format_of(str(path)) == "csv"


def test_xz_and_packed_json(spark, tmp_path):
    csv = put(tmp_path, "t.csv.xz", lzma.compress("id;x\n1;1.5\n2;\n".encode()))
    assert rows_of(readers.load(spark, csv), "*") == [(1, 1.5), (2, None)]
    lines = put(tmp_path, "t.jsonl.xz", lzma.compress(b'{"a": 1}\n{"a": 2}\n'))
    assert rows_of(readers.load(spark, lines), "a") == [(1,), (2,)]
    with zipfile.ZipFile(tmp_path / "t.json.zip", "w") as z:
        z.writestr("t.json", json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert rows_of(readers.load(spark, str(tmp_path / "t.json.zip")), "a") == [(1,), (2,)]


def test_members_are_streamed(spark, tmp_path, monkeypatch):
    """A member far larger than a block comes in batches; lines may cross blocks."""
    text = "".join(f"{i},{'x' * (i % 97)}\n" for i in range(200_000))
    blocks = list(archives.lines_of(io.BytesIO(text.encode())))
    assert len(blocks) > 5 and max(sum(map(len, b)) for b in blocks) < 2 * archives.BLOCK
    assert b"\n".join(line for b in blocks for line in b) + b"\n" == text.encode()
    with zipfile.ZipFile(tmp_path / "big.csv.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "id,x\n" + text)
        z.writestr("b.csv", "id,x\n" + text)
    df = readers.load(spark, str(tmp_path / "big.csv.zip"))
    assert df.count() == 400_000
    assert df.select("id").distinct().count() == 200_000


def test_zip_without_members_among_others(spark, tmp_path):
    """A task without rows writes such a file; it holds nothing and stops nothing."""
    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w"):
        pass
    with zipfile.ZipFile(tmp_path / "b.csv.zip", "w") as z:
        z.writestr("b.csv", "n\n1\n2\n")
    put(tmp_path, "c.csv.zip", b"no archive")
    assert archives._members_of(str(tmp_path / "a.csv.zip")) == []
    with pytest.raises(zipfile.BadZipFile):
        archives._members_of(str(tmp_path / "c.csv.zip"))
    (tmp_path / "c.csv.zip").unlink()
    assert rows_of(readers.load(spark, f"{tmp_path}/*.csv.zip"), "n") == [(1,), (2,)]


def test_archives_that_cannot_be_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "none.csv.zip", "w") as z:
        z.writestr(".hidden", "x")
    with pytest.raises(archives.ArchiveError):
        readers.load(spark, str(tmp_path / "none.csv.zip"))
    broken = put(tmp_path, "broken.csv.xz", b"no archive")
    with pytest.raises(Exception, match="(?i)format"):
        readers.load(spark, broken)
    with pytest.raises(readers.UnsupportedFileError):
        readers.format_of("t.parquet.zip")


def test_folder_of_lines_and_documents(spark, tmp_path):
    put(tmp_path, "array.json", json.dumps([{"a": 1, "b": "x", "n": {"k": 1}}, {"a": 2, "b": "y"}], indent=1))
    put(tmp_path, "single.json", json.dumps({"a": 3, "b": "z"}, indent=2))
    put(tmp_path, "lines.json", '{"a": 4.5, "c": true, "n": "plain"}\n{"a": 5, "d": "2024-01-05"}\n')
    df = readers.read_json(spark, str(tmp_path))
    assert dict(df.dtypes) == {
        "a": "double", "b": "string", "c": "boolean", "d": "timestamp_ntz", "n": "string",
    }
    assert rows_of(df, "a", "b", "c", "n") == sorted(
        [(1.0, "x", None, '{"k":1}'), (2.0, "y", None, None), (3.0, "z", None, None),
         (4.5, None, True, "plain"), (5.0, None, None, None)], key=repr,
    )
    given = readers.read_json(spark, str(tmp_path), schema="a double, b string")
    assert rows_of(given, "a") == [(1.0,), (2.0,), (3.0,), (4.5,), (5.0,)]


def test_one_scan_judges_utf8_files(spark, tmp_path, monkeypatch):
    """Encoding, delimiter and layout come from one pass over the lines of a folder."""
    for n in range(5):
        put(tmp_path, f"{n}.csv", "a|b|c\n" + "1|2|3\n" * 50 + "x,y\n" * n)
    scans = []
    plain = manifest._lines
    monkeypatch.setattr(manifest, "_lines", lambda *a: scans.append(a) or plain(*a))
    monkeypatch.setattr(manifest, "guesses", lambda lines, files: {} if not files else 1 / 0)
    got = {r["path"].rsplit("/", 1)[1]: r for r in file_manifest(spark, str(tmp_path)).collect()}
    assert len(scans) == 1
    assert len(got) == 5
    assert {(r["encoding"], r["delimiter"], r["json_layout"]) for r in got.values()} == {("utf-8", "|", "document")}


def test_ties_between_delimiters(spark, tmp_path):
    """Most lines of one width; of equals more fields, then the order of the delimiters."""
    for name, text, want in (
        ("fields", "a;b,c,d\n" * 4, ","),
        ("order", "a;b,c\n" * 4, ","),
        ("lines", "a;b,c,d\na;b\n", ";"),
        ("none", "abc\ndef\n", ","),
        ("many", "".join("x|" * n + "y;z\n" for n in range(1, 60)), ";"),
    ):
        path = put(tmp_path, f"{name}.csv", text)
        assert file_manifest(spark, path).first()["delimiter"] == want, name


def test_mixed_dialects_have_no_files_without_rows(spark, tmp_path):
    """Where the first partition of a table is empty, no file with a header alone is written."""
    people = spark.range(40).selectExpr("id AS c_custkey", "'x' AS note", "'y' AS pan_no")
    late = people.where("c_custkey < 0").union(people.coalesce(1))
    assert late.rdd.glom().map(len).first() == 0
    found = file_manifest(spark, storage._mixed_dialects(late))
    assert rows_of(found.select("encoding", "delimiter").distinct(), "*") == [("latin-1", ";"), ("utf-8", ",")]
