import io
import os
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import engines, relational as R
from quarry.plans import files, registry, rules  # noqa: F401
from quarry.sources import archives

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_page_ranges(spark):
    rows = [("1-3, 5, 8-", 9), (" 2 - 3 ; 1 ", 3), ("0", 3), ("4", 3), ("3-1", 3), ("a", 3), ("", 3)]
    got = values(spark, S.page_ranges(F.col("t"), F.col("n")), rows, "t string, n int")
    assert got == [[[0, 1, 2], [4], [7, 8]], [[1, 2], [0]], None, None, None, None, None]


def test_names(spark):
    rows = [("facture‮gpj.exe",), ("..\\..\\Windows\\evil.dll",), ("a/b:c?.pdf",), ("",)]
    assert values(spark, S.safe_name(F.col("t")), rows, "t string") == ["facturegpj.exe", "_.._Windows_evil.dll", "a_b_c_.pdf", "file"]
    bad, good = ["/a", "\\a", "a\0b", "c:x", "a/../b", "nul", "COM1.txt", "a./b", "x "], ["a", "a/b", "a/", "./a", "console"]
    assert values(spark, S.unsafe_name(F.col("t")), [(x,) for x in bad + good], "t string") == [True] * len(bad) + [False] * len(good)


def test_versions_and_sizes(spark):
    rows = [("0.3.1", "0.3.0"), ("0.10.0", "0.9.9"), ("1.0.0", "0.99.99"), ("0.3.0", "0.3.0"), ("0", "0.3.0"), ("x.2", "0.1")]
    assert values(spark, S.newer(F.col("a"), F.col("b")), rows, "a string, b string") == [True, True, True, False, False, True]
    assert values(spark, S.human_bytes(F.col("n")), [(0,), (999,), (1000,), (1049,), (99950,), (123456,), (2_500_000,)], "n long") == ["0 B", "999 B", "1.0 KB", "1.0 KB", "100.0 KB", "123 KB", "2.5 MB"]


def test_sniff(spark):
    heads = {b"RIFF....WAVEfmt ": "wav", b"ID3..": "mp3", b"\xff\xfb\x90\x64": "mp3", b"OggS": "ogg", b"fLaC": "flac", b"....ftypM4A ": "m4a", b"\xff\xd8\xff\xe0": "jpeg", b"....ftypisom": "mp4", b"BM" + bytes(12) + b"\x28" + bytes(15): "bmp", b"%PDF-1.7": "pdf", b"": "", b"x": ""}
    got = spark.createDataFrame([(x,) for x in heads], "content binary").select(S.sniff("content")[1]).collect()
    assert [r[0] for r in got] == list(heads.values())


def archive(method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("a.txt", "hello " * 5000)
        z.writestr("d/b.txt", "x" * 1000)
        z.writestr("r.bin", os.urandom(5000))
        z.writestr("empty/", "")
    return out.getvalue()


def test_zip_rewrite_reads_elsewhere():
    before = archive()
    made, changed = archives.rewrite(b"prefix" + before)
    assert not changed and len(made) < len(before)
    with zipfile.ZipFile(io.BytesIO(made)) as a, zipfile.ZipFile(io.BytesIO(before)) as b:
        assert a.testzip() is None and a.namelist() == b.namelist()
        assert all(a.read(n) == b.read(n) for n in b.namelist())
    _, changed = archives.rewrite(before, lambda name, data: b"new" if name.startswith("d/") else None)
    assert changed == {1}


def test_zip_bomb_and_names():
    raw = bytearray(archive(zipfile.ZIP_DEFLATED))
    e = archives.directory(bytes(raw))[0]
    with pytest.raises(archives.Corrupt):
        archives.content(bytes(raw), e | {"usize": 10}, 1 << 30)
    raw[30] ^= 1
    with pytest.raises(archives.Corrupt, match="unsafe-paths"):
        archives.body(bytes(raw), e)


def png(noise):
    import struct

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + (os.urandom(64) if noise else bytes(64)) for _ in range(64))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 64, 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 0)) + chunk(b"IEND", b"")


def test_engines(spark):
    rows = [("z", archive()), ("p", png(False)), ("n", png(True)), ("o", b"text"), ("c", b"PK\3\4broken"), ("e", None)]
    got = {r["file_id"]: r for r in engines.compress(spark.createDataFrame(rows, "file_id string, content binary")).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"z": None, "p": None, "n": "already-optimal", "o": "unsupported", "c": "corrupt", "e": "unsupported"}
    assert got["z"]["output_size"] < got["z"]["input_size"] and all(c["ok"] for c in got["z"]["checks"])
    listed = archives.entries(spark.createDataFrame(rows, "file_id string, content binary")).where("file_id = 'z'").collect()
    assert [r["name"] for r in listed] == ["a.txt", "d/b.txt", "r.bin", "empty/"]


def test_box_mean_and_reachability(spark):
    ramp = spark.createDataFrame([(1, [float(x) for x in range(7)])], "k int, v array<double>")
    assert [round(r["v"], 6) for r in R.box_mean(R.pixels(ramp, "k", "v", 7), "k", 1).orderBy("x").collect()] == [0.5, 1, 2, 3, 4, 5, 5.5]
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 5)], "src int, dst int")
    assert sorted(r[0] for r in R.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]


def test_reachable_never_stops_short(spark):
    edges, roots = spark.createDataFrame([(k, k + 1) for k in range(4)], "src int, dst int"), spark.createDataFrame([(0,)], "node int")
    assert R.reachable(edges, roots, 5).count() == 5
    with pytest.raises(RuntimeError):
        R.reachable(edges, roots, 2)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_composed_names(spark):
    import unicodedata

    pool = [*map(chr, [*range(0x41, 0x5B), *range(0xC0, 0x180), *range(0x300, 0x330), *range(0x1100, 0x1113), *range(0x1161, 0x1176), 0x958, 0x2126, 0x212B, 0x1F600])]
    names = [None, "", "plain.txt", "e\u0301", *("".join(pool[(k * 7919 + j * (k + 31)) % len(pool)] for j in range(k % 7 + 1)) for k in range(300))]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").repartition(2)
    found = {r["i"]: r for r in rows.select("i", S.nfc(F.col("n")).alias("c"), S.safe_name(F.col("n")).alias("safe")).collect()}
    for i, n in enumerate(names):
        assert found[i]["c"] == (None if n is None else unicodedata.normalize("NFC", n))
    assert [found[i]["safe"] for i in range(4)] == ["file", "file", "plain.txt", "\u00e9"]
