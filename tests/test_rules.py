import io
import struct
import unicodedata
import zipfile
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import rules as D, scalars as S
from quarry.operators import engines, packages, pictures, relational as R
from quarry.plans import files, registry
from quarry.sources import archives


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_settings_by_type_and_place(spark):
    texts = [None, "null", "{", '{"mode":"__proto__","allowMacros":"yes"}', '{"task":"upload","imageTarget":"exe","mediaTarget":"constructor"}', '{"task":"convert","imageTarget":"webp"}', '{"note":{"allowMacros":true,"stripMetadata":true},"allowMacros":false}', '{"allowMacros":true,"stripMetadata":true}', '{"allowMacros":"true"}', '[{"allowMacros":true}]']
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*S.sanitise(F.col("t"))).collect()]
    default = ("compress", "lossless", "jpg", "mp4", False, False)
    assert got == [default, default, default, default, default, ("convert", "lossless", "webp", "mp4", False, False), default, ("compress", "lossless", "jpg", "mp4", True, True), default, default]


def test_dangerous_names(spark):
    bad = ["/etc/passwd", "\\server\\x", "C:/Windows/x.dll", "../up.txt", "a/../../up.txt", "NUL", "nul.txt", "d/CON.docx", "com1", "LPT9.log", "file.", "dir /x.txt", "a.txt:hidden", "x\1y", "com¹", "LPT².x", "conin$", "CONOUT$.txt"]
    good = ["a.txt", "dossier/", "dossier/sous dossier/b.pdf", "./a.txt", "console.log", "nullable.txt", "com10.txt", ".gitignore", "Été 2026/photo.jpg", "a\x7fb"]
    assert values(spark, S.unsafe_name(F.col("t")), [(n,) for n in bad + good], "t string") == [True] * len(bad) + [False] * len(good)
    assert all(engines.unsafe([n]) for n in bad) and not any(engines.unsafe([n]) for n in good)
    twins = ["Rapport.txt", "rapport.TXT", "Été.txt", unicodedata.normalize("NFD", "Été.txt"), "ok.txt"]
    rows = spark.createDataFrame([(1, n) for n in twins], "g int, n string")
    assert {r["n"]: r["twin"] for r in R.twins(rows, "g", "n").collect()} == {n: n != "ok.txt" for n in twins}
    assert engines.unsafe(twins) and not engines.unsafe(twins[1:3])


def test_safe_names_by_units(spark):
    given = ["e\u0301" * 3, "\U0001f600" * 150, "x" + "\U0001f600" * 150, "\u00a0 . name \ufeff", None]
    assert values(spark, S.safe_name(F.col("t")), [(g,) for g in given], "t string") == ["é" * 3, "\U0001f600" * 100, "x" + "\U0001f600" * 99, "name", "file"]


def test_versions_with_words(spark):
    rows = [("1.2.3-rc1", "1.2.0"), ("1.2", "1.2.0"), ("2", "10"), (" 3", "2.9"), ("a.b.c", "0.0.0"), ("0.2.9", "0.3.0")]
    assert values(spark, S.newer(F.col("a"), F.col("b")), rows, "a string, b string") == [True, False, False, True, False, False]


def test_sizes_beyond_terabytes(spark):
    assert values(spark, S.human_bytes(F.col("n")), [(1_234_567_000_000_000,), (999_949,), (1_000_000_000_000,)], "n long") == ["1,235 TB", "1,000 KB", "1.0 TB"]


def test_sizes_beyond_a_long(spark, tmp_path):
    """Keys from 922337 on make sizes that no long holds; the others are held against the SQL, which stops at such a key."""
    assert values(spark, S.human_bytes(F.col("n")), [(Decimal(n),) for n in (10**19, 92_233_700 * 10**12, 10**36, 2**63)] + [(None,)], "n decimal(38,0)") == ["10,000,000 TB", "92,233,700 TB", "1,000,000,000,000,000,000,000,000 TB", "9,223,372 TB", None]
    keys = [0, 1, 13, 27, 922_319, 922_333, 1_064_349, 8_999_983, 8_999_997, 8_999_999, 2**53 + 9, 2**63 - 1, 2**63 - 8, -1, -13, -14, -1_400_000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.shown for r in registry.size_format(spark, str(tmp_path)).collect()}
    assert got.keys() == set(keys)
    duckdb = pytest.importorskip("duckdb")
    large = [k for k in keys if k and k > 0 and k * 10 ** (k % 14) >= 2**63]
    orders = duckdb.read_parquet(f"{tmp_path}/orders.parquet/*.parquet").filter(f"o_orderkey IS NULL OR o_orderkey NOT IN ({', '.join(map(str, large))})")  # noqa: F841  (the SQL reads it)
    said = dict(duckdb.sql(registry.ORACLE_SQL["size_format"]).fetchall())
    assert len(said) == len(keys) - len(large) and {k: got[k] for k in said} == said
    digits = lambda k: k * 10 ** (k % 14) / 10**12
    assert len(large) >= 4 and all(float(got[k].removesuffix(" TB").replace(",", "")) == pytest.approx(digits(k), rel=1e-15, abs=0.5) for k in large)


def test_memory_cost_by_format(spark):
    rows = [("compress", "image", "png", 10, None, None), ("compress", "image", "webp", 10, 100, 100), ("compress", "other", "", 10, None, None), ("compress", "image", "png", 10, 1600, 1200)]
    got = values(spark, S.memory_cost(*(F.col(c) for c in "abcdef")), rows, "a string, b string, c string, d long, e int, f int")
    assert got == [float("inf"), 20.0, 20.0, 1600 * 1200 * 16 + 20.0]


def test_office_macros(spark):
    rows = [(1, "[Content_Types].xml"), (1, "xl/a"), (1, "XL/VBAPROJECT.BIN"), (2, "[Content_Types].xml"), (2, "word/x"), (2, "xvbaProject.bin"), (3, "a.txt")]
    got = {r["g"]: (r["extension"], r["macro"]) for r in packages.office_kind(spark.createDataFrame(rows, "g int, n string"), "g", "n").collect()}
    assert got == {1: ("xlsm", True), 2: ("docx", False), 3: (None, False)}


def test_relationships_in_any_quotes_and_order(spark):
    xml = "<Relationships><Relationship Target='../media/a>b.png' Id=\"r1\" Type='t/image'/><Relationship TargetMode = 'External' Type=\"x/hyperlink\" Target=\"https://x.example/?a=1&amp;b\"/><Relationship MyTarget=\"no\" Type=\"t\"/><RelationshipX Target=\"no\"/></Relationships>"
    rows = [("ppt/slides/_rels/s.xml.rels", xml), ("ppt/a.xml", xml), ("b.rels", None)]
    got = [(r["target"], r["external"], r["hyperlink"]) for r in packages.relationships(spark.createDataFrame([(1, *r) for r in rows], "g int, n string, x string"), "g", "n", "x").collect()]
    assert got == [("ppt/media/a>b.png", False, False), (None, True, True), (None, False, False)]


def test_running_offset_over_runs(spark):
    rows = [(k % 3, k, (k * 7) % 50) for k in range(500)]
    got = R.running_offset(spark.createDataFrame(rows, "g int, o long, n int"), "g", "o", "n", 16).collect()
    for r in got:
        assert r["offset"] == sum(n for g, o, n in rows if g == r["g"] and o < r["o"])


def test_moved_and_swapped(spark):
    rows = spark.createDataFrame([(g, k, k) for g in range(3) for k in range(5)], "g int, id int, p int")

    def order(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r["g"], r["p"])):
            out.setdefault(r["g"], []).append(r["id"])
        return out

    assert order(R.moved(rows, "g", "p", F.lit(1), F.lit(3)))[0] == [0, 2, 3, 1, 4]
    assert order(R.moved(rows, "g", "p", F.lit(4), F.lit(0)))[1] == [4, 0, 1, 2, 3]
    assert order(R.moved(rows, "g", "p", F.lit(1), F.lit(5)))[2] == [0, 1, 2, 3, 4]
    assert order(R.swapped(rows, "g", "p", F.lit(4), F.lit(1)))[0] == [0, 1, 2, 3, 4]
    assert order(R.swapped(rows, "g", "p", F.lit(2), F.lit(-1)))[0] == [0, 2, 1, 3, 4]


def test_same_arrays_with_nulls(spark):
    schema = "k int, v array<int>"
    a = spark.createDataFrame([(1, [1, None]), (2, None), (3, []), (4, [1]), (5, [1])], schema)
    b = spark.createDataFrame([(1, [1, None]), (2, None), (3, []), (4, [2]), (6, [1])], schema)
    assert {r["k"]: r["same"] for r in R.same_arrays(a, b, "k", "v").collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_choices(spark):
    assert values(spark, D.best_candidate(F.col("o"), F.col("a"), F.col("b")), [(100, 90, 80), (100, 90, 81), (100, None, 99), (100, None, 100), (100, 100, None), (100, 120, 110), (100, None, None)], "o int, a int, b int") == ["lossy", "lossless", "lossy", None, None, None, None]
    names = ["Report. ", "x.pdf", " . "]
    assert values(spark, D.with_extension(F.col("n"), F.lit("out.PDF"), F.lit("a")), [(n,) for n in names], "n string") == ["Report.pdf", "x.pdf", "file.pdf"]
    assert values(spark, D.percent_saved(F.lit(1000), F.col("n")), [(80,), (904,), (950,), (999,), (1000,)], "n int") == ["-92%", "-9.6%", "-5%", "-0.1%", "-0%"]
    assert values(spark, D.magnitude(F.col("n")), [(0,), (1,), (-1,), (255,), (-256,)], "n int") == [0, 1, 1, 8, 9]


def test_entry_actions(spark):
    big = (128 << 20) + 1
    rows = [("a.txt", True, 5, 0, "pack"), ("a.txt", False, 5, 0, "pack"), ("a.txt", True, 5, 0, "copy"), ("a.txt", True, big, 0, "pack"), ("a.MP4", True, big, 0, "pack"), ("a.txt", True, big, 8, "transform"), ("m/a", True, 5, 8, "transform")]
    got = values(spark, D.entry_action(*map(F.col, "nrumP")), rows, "n string, r boolean, u long, m int, P string")
    assert got == ["pack", "copy", "copy", "stream", "copy", "copy", "transform"]


def test_network_input(spark):
    pixels = [10, 20, 30, 255, 40, 0, 5, 255]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(pixels)] + [(2, i, 0) for i in range(4)], "k int, i int, v int")
    got = {(r["k"], r["place"]): r["x"] for r in pictures.network_input(rows, "k", "i", "v").collect()}
    assert got == {(1, p): v / 40 - 0.5 for p, v in enumerate((10, 40, 20, 0, 30, 5))} | {(2, p): -0.5 for p in range(3)}


def test_symbol_counts(spark):
    rows = [("a", "é"), ("a", "aa"), (None, "a"), ("b", None), ("b", "")]
    got = {(r["g"], r["symbol"]): r["n"] for r in pictures.symbol_counts(spark.createDataFrame(rows, "g string, t string"), "g", "t").collect()}
    assert got == {("a", 0xC3): 1, ("a", 0xA9): 1, ("a", 97): 2, (None, 97): 1}


def package(extra=(), signed=False):
    names = ["[Content_Types].xml", "word/document.xml", "docProps/core.xml", *extra, *(["_xmlsignatures/a.xml"] if signed else [])]
    picture = files.png(8, 8, bytes(64), b"taken by")
    return archives.assemble([files.entry(n, (f"<x><dc:creator>me</dc:creator>{n}</x>" * 30).encode()) for n in names] + [files.entry("word/media/p.png", picture), files.entry("word/embeddings/o.bin", b"\0" * 500)])


@pytest.mark.parametrize("signed", [False, True])
def test_office_engine(signed):
    data = package(signed=signed)
    found = archives.directory(data)
    made, checks = engines.office_engine(data, found, False, strip=True)
    assert len(made) < len(data) and all(ok for _, ok in checks)
    with zipfile.ZipFile(io.BytesIO(made)) as after, zipfile.ZipFile(io.BytesIO(data)) as before:
        assert after.namelist() == before.namelist() and after.testzip() is None
        assert (b"<dc:creator></dc:creator>" in after.read("docProps/core.xml")) is not signed
        assert after.read("word/document.xml") == before.read("word/document.xml")
        assert (b"tEXt" in after.read("word/media/p.png")) is signed
        assert after.getinfo("word/embeddings/o.bin").compress_type == zipfile.ZIP_STORED
    with pytest.raises(archives.Corrupt, match="macro"):
        engines.zip_engine(package(["word/vbaProject.bin"]))
    with pytest.raises(archives.Corrupt, match="unsafe-paths"):
        engines.zip_engine(package(["../x"]))


def test_mimetype_stays_first_and_stored():
    data = archives.assemble([files.entry("mimetype", b"application/vnd.oasis.opendocument.text" * 20), files.entry("content.xml", b"<a/>" * 500)])
    made, _ = engines.zip_engine(data)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert [i.compress_type for i in z.infolist()] == [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]


def test_bombs_false_names_and_zip64(spark):
    zeros = files.entry("bomb.txt", bytes(1_000_000), 8)
    lying = archives.assemble([(zeros[0] | {"usize": 1000}, zeros[1])])
    false = bytearray(archives.assemble([files.entry("a.txt", b"hello " * 50)]))
    false[30] = ord("b")
    many = archives.assemble([files.entry("x.txt", b"LocalText")] * 70_000)
    assert len(archives.directory(many)) == 70_000
    rows = [("bomb", lying), ("false", bytes(false)), ("cut", lying[:-30]), ("png", b"\x89PNG\r\n\x1a\n" + bytes(4)), ("text", b"hello"), ("none", None)]
    got = {r["file_id"]: r["reason"] for r in engines.compress(spark.createDataFrame(rows, "file_id string, content binary")).collect()}
    assert got["bomb"] in ("corrupt", "validation") and got["false"] == "unsafe-paths" and got["cut"] == "corrupt" and got["text"] == got["none"] == "unsupported" and got["png"] in ("corrupt", "unreadable", "already-optimal")
    found = {r["file_id"]: r for r in archives.entries(spark.createDataFrame([("a", lying), ("b", b"x")], "file_id string, content binary")).collect()}
    assert found["a"]["usize"] == 1000 and found["b"]["reason"]


def test_png_info(spark):
    animated = b"\x89PNG\r\n\x1a\n" + files.chunk(b"IHDR", struct.pack(">2I5B", 1600, 1200, 8, 2, 0, 0, 0)) + files.chunk(b"acTL", bytes(8))
    rows = [(1, files.png(3, 2, bytes(6))), (2, animated), (3, animated[:20]), (4, None), (5, zlib.compress(b"x"))]
    got = {r["k"]: (r["width"], r["height"], r["animated"]) for r in archives.png_info(spark.createDataFrame(rows, "k int, c binary"), "k", "c").collect()}
    assert got == {1: (3, 2, False), 2: (1600, 1200, True), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}


def photo(rng, width, height, sampling, header=()):
    """A picture of invented coefficients, most of the later ones zero."""
    from quarry.sources import jpeg

    parts = [jpeg.Component(k + 1, a, d, min(k, 1)) for k, (a, d) in enumerate(sampling)]
    body = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([c.name, c.across << 4 | c.down, c.quantiser]) for c in parts)
    made = jpeg.frame(0xC0, body)
    for c in made.components:
        shape = c.blocks.shape
        scale = 60 / (1 + np.arange(64)) ** 1.1
        c.blocks[:] = np.round(rng.laplace(size=shape) * scale).astype(int) * (rng.random(shape) < 0.35)
        c.blocks[:, :, 0] = np.clip(np.cumsum(rng.integers(-9, 10, shape[:2]), axis=1), -900, 900)
        c.blocks[:, :, 40] += (rng.random(shape[:2]) < 0.02) * rng.integers(-3, 4, shape[:2])
    made.header, made.quantisers = list(header), {0: bytes([0, *range(1, 65)]), 1: bytes([1, *range(2, 66)])}
    return made


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(1, 1)] * 4, [(4, 2), (1, 1), (2, 1)]])
@pytest.mark.parametrize("size", [(8, 8), (67, 45)])
def test_jpeg_round_trips(sampling, size):
    from quarry.sources import jpeg

    made = photo(np.random.default_rng(9), *size, sampling)
    if len(sampling) == 1 or sum(a * d for a, d in sampling) > 10:  # single scans say nothing of padding beyond what is visible
        for c in made.components:
            c.blocks[c.visible[0] :], c.blocks[:, c.visible[1] :] = 0, 0
    baseline, progressive = jpeg.encode(made, False), jpeg.encode(made, True)
    want = [c.blocks[: c.visible[0], : c.visible[1]] for c in made.components]
    for data in (baseline, progressive):
        got = jpeg.coefficients(data)
        assert len(got) == len(want) and all((a == b).all() for a, b in zip(got, want, strict=True))
    assert jpeg.same_coefficients(baseline, progressive) and jpeg.same_coefficients(jpeg.encode(jpeg.decode(progressive), False), baseline)
    other = photo(np.random.default_rng(10), *size, sampling)
    assert not jpeg.same_coefficients(baseline, jpeg.encode(other, False))


def restarted(made, every):
    """A sequential file with fixed codes and restart markers, written without the library's coder."""
    from quarry.sources import jpeg

    codes = {s: (k, 12) for k, s in enumerate(sorted({z << 4 | n for z in range(16) for n in range(1, 11)} | {0, 0xF0}))}
    tables = b"".join(jpeg.segment(jpeg.DHT, bytes([t, *[0] * 11, len(codes), 0, 0, 0, 0]) + bytes(codes)) for t in (0, 16))
    stretches, bits, last = [], "", 0
    number = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    code = lambda s: format(codes[s][0], "012b")
    for count, unit in enumerate(jpeg.places(made, [0])):
        if count and count % every == 0:
            stretches.append(bits)
            bits, last = "", 0
        v = made.components[0].blocks[unit[0][1], unit[0][2]].tolist()
        bits += code(abs(v[0] - last).bit_length()) + number(v[0] - last)
        last, zeros = v[0], 0
        for k in range(1, 64):
            if not v[k]:
                zeros += 1
                continue
            bits += code(0xF0) * (zeros // 16) + code(zeros % 16 << 4 | abs(v[k]).bit_length()) + number(v[k])
            zeros = 0
        bits += code(0) if zeros else ""
    out = b""
    for k, part in enumerate([*stretches, bits]):
        part += "1" * (-len(part) % 8)
        out += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + int(part, 2).to_bytes(len(part) // 8, "big").replace(b"\xff", b"\xff\0")
    body = struct.pack(">BHHB", 8, made.height, made.width, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + jpeg.segment(0xFE, b"a comment") + jpeg.segment(jpeg.DQT, made.quantisers[0]) + jpeg.segment(0xC0, body) + tables + jpeg.segment(jpeg.DRI, struct.pack(">H", every)) + jpeg.segment(jpeg.SOS, bytes([1, 1, 0, 0, 63, 0])) + out + b"\xff\xd9"


def test_jpeg_restarts_and_engine(spark):
    from quarry.sources import jpeg

    made = photo(np.random.default_rng(4), 90, 70, [(1, 1)])
    data = restarted(made, 7)
    assert (jpeg.coefficients(data)[0] == made.components[0].blocks).all()
    better = jpeg.smaller(data)
    assert len(better) < len(data) and jpeg.same_coefficients(data, better) and b"a comment" in better
    turned = b"\xff\xd8" + jpeg.segment(0xE1, jpeg.exif(6)) + jpeg.segment(0xE1, b"http://xmp") + data[2:]
    bare = jpeg.smaller(turned, strip=True)
    assert b"a comment" not in bare and b"xmp" not in bare and b"JFIF" in bare and pictures.segments(bare)["orientation"] == 6
    rows = [("good", data), ("cut", data[: len(data) // 2]), ("bad", data[:700] + bytes(300) + data[1000:]), ("best", better), ("lossless", data.replace(b"\xff\xc0", b"\xff\xc3", 1)), ("head", b"\xff\xd8\xff\xe0")]
    got = {r["file_id"]: r["reason"] for r in engines.compress(spark.createDataFrame(rows, "file_id string, content binary")).collect()}
    assert got["good"] is None and got["cut"] == "corrupt" and got["best"] == "already-optimal" and got["lossless"] == "unsupported" and got["head"] == "corrupt"


def test_jpeg_faults_are_told():
    from quarry.sources import jpeg

    data = jpeg.encode(photo(np.random.default_rng(5), 40, 40, [(2, 1), (1, 1), (1, 1)]), True)
    rng = np.random.default_rng(6)
    for _ in range(150):
        broken = bytearray(data)
        for at in rng.integers(2, len(data), 3):
            broken[at] = int(rng.integers(0, 256))
        jpeg.coefficients(bytes(broken))  # None or blocks, never another error
    for cut in range(2, len(data) - 2, 37):
        assert jpeg.coefficients(data[:cut]) is None


def test_pdf_compress_keeps_pages_and_drops_the_rest(spark):
    from quarry.sources import jpeg, pdf

    photo_ = restarted(photo(np.random.default_rng(4), 64, 64, [(1, 1)]), 5)
    texts = [f"page {k} " * 50 for k in range(4)]
    made = pdf.load(files.paged(texts))
    made.objects[3].value = {b"/Author": pdf.Plain(b"(me \\) (nested) \\\\)"), b"/Title": pdf.Plain(b"<feff 0041>"), b"/MSIP_Label_x": pdf.Plain(b"(y)")}
    made.objects[4] = pdf.Item({b"/Subtype": pdf.Name(b"/Image"), b"/Filter": [pdf.Name(b"/DCTDecode")]}, photo_)
    made.objects[5] = pdf.Item({b"/Type": pdf.Name(b"/Metadata")}, b"<xmp/>" * 20)
    made.objects[6] = pdf.Item({}, b"never used " * 100)
    made.objects[1].value |= {b"/Metadata": pdf.Ref(5), b"/Thumb": pdf.Ref(4)}
    made.trailer[b"/Info"] = pdf.Ref(3)
    data = made.save()
    better, checks = pdf.compress(data, strip=True)
    assert len(better) < len(data) and all(ok for _, ok in checks) and files.facts(better) == files.facts(data)
    after = pdf.load(better)
    assert len({n for _, p in after.pages() for n in [p[b"/Contents"][1].number]}) == 1 and 6 not in after.objects and 5 not in after.objects
    assert jpeg.same_coefficients(after.objects[4].stream, photo_) and len(after.objects[4].stream) < len(photo_)
    assert after.objects[3].value == {b"/Title": b"<feff 0041>", b"/MSIP_Label_x": b"(y)"}
    assert pdf.compress(better)[0] is None
    rows = [("good", data), ("best", better), ("cut", data[:300]), ("secret", data.replace(b"trailer\n<<", b"trailer\n<</Encrypt 9 0 R")), ("signed", data.replace(b"/Unused", b"/Unused") .replace(b"/Author", b"/ByteRange[0 1]/Contents(x)/Author"))]
    got = {r["file_id"]: r["reason"] for r in engines.compress(spark.createDataFrame(rows, "file_id string, content binary")).collect()}
    assert got == {"good": None, "best": "already-optimal", "cut": "corrupt", "secret": "encrypted", "signed": "signed"}


def test_pdf_forms_of_files():
    from quarry.sources import pdf

    page = b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]/Contents 5 0 R>>"
    body = b"%PDF-1.5\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj 5 0 obj <</Length 6 0 R>>stream\r\n1 0 obj <<>>\nendstream\nendobj 6 0 obj 12 endobj\n"
    plain = body + b"3 0 obj" + page + b"endobj trailer <</Root 1 0 R>>"
    document = pdf.load(plain)
    assert len(document.pages()) == 1 and document.objects[5].stream == b"1 0 obj <<>>"
    # the last of a number counts
    turned = plain + b"\n3 0 obj" + page.replace(b"9 9]", b"9 9]/Rotate 90") + b"endobj trailer <</Root 1 0 R/Prev 1>>"
    assert pdf.load(turned).pages()[0][1][b"/Rotate"] == b"90"
    # objects in a stream, the trailer in another
    packed = zlib.compress(b"3 0 " + page)
    modern = body + b"7 0 obj<</Type/ObjStm/N 1/First 4/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj 8 0 obj<</Type/XRef/Root 1 0 R/Length 0>>stream\n\nendstream endobj" % (len(packed), packed)
    assert pdf.load(pdf.load(modern).save()).pages()[0][1][b"/MediaBox"] == [b"0", b"0", b"9", b"9"]
    for wrong in (b"", b"%PDF-1.4", body, plain.replace(b"/Kids[3 0 R]", b"/Kids[2 0 R]"), plain.replace(b"/Pages 2 0 R", b"/Pages 9 0 R")):
        with pytest.raises(pdf.Unfit, match="corrupt"):
            pdf.load(wrong)
    for asked in ([], [(1, 0)], [(-1, 0)]):
        with pytest.raises(pdf.Unfit, match="invalid"):
            pdf.picked([(document, asked)])
    rng = np.random.default_rng(7)
    data = files.paged(["a", "b" * 600, "c"])
    for _ in range(200):
        broken = bytearray(data)
        for at in rng.integers(0, len(data), 4):
            broken[at] = int(rng.integers(0, 256))
        for work in (pdf.compress, lambda x: pdf.merged([x, x]), lambda x: pdf.split(x, [[0]])):
            try:
                work(bytes(broken))
            except pdf.Unfit:
                pass


def test_pdf_page_work():
    from quarry.sources import documents, pdf

    data = files.paged([str(k) for k in range(5)])
    assert [f[2] for f in files.facts(pdf.merged([data, data]))] == [str(k).encode() for k in range(5)] * 2
    assert [[f[2] for f in files.facts(part)] for part in pdf.split(data, [[4, 0], [2]])] == [[b"4", b"0"], [b"2"]]
    turned = pdf.picked([(pdf.load(data), [(1, 90), (1, 270), (0, -90)])]).save()
    assert [(f[0], f[1]) for f in files.facts(turned)] == [(201, 90), (201, 270), (200, 270)]
    assert [f[1] for f in files.facts(pdf.picked([(pdf.load(turned), [(2, 180)])]).save())] == [90]
    picture = restarted(photo(np.random.default_rng(4), 64, 48, [(1, 1)]), 5)
    made = documents.jpeg_page(picture)
    assert len(pdf.load(made).pages()) == 1 and documents.facts(made)[1:] == ((48.0, 36.0), [picture])
    with pytest.raises(documents.Unfit):
        documents.jpeg_page(picture[:40])
