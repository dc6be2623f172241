import heapq
import struct

import pytest
from pyspark.sql import functions as F

from quarry.functions import planning as P
from quarry.operators import packages, pictures
from quarry.plans import registry


def column(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_watermark_label(spark):
    rows = [(None,), ("",), (" a\t b ",), ("x" * 200,), ("日é",)]
    assert column(spark, P.watermark_label(F.col("t")), rows, "t string") == [None, None, "a b", "x" * 120, "?é"]


def test_numbered_names(spark):
    rows = [(1, 1), (2, 3), (7, 1000)]
    assert column(spark, P.numbered_name(F.lit("b"), F.col("k"), F.col("n"), "pdf", 2), rows, "k int, n int") == ["b.pdf", "b-02.pdf", "b-0007.pdf"]


def folded(names):
    used, out = set(), []
    for name in names:
        at = name.rfind(".")
        head, tail = (name, "") if at < 0 else (name[:at], name[at:])
        k, taken = 2, name
        while taken in used:
            taken, k = f"{head} ({k}){tail}", k + 1
        used.add(taken)
        out.append(taken)
    return out


def test_unique_names_meet_numbered_ones(spark):
    names = ["a.x", "a (2).x", "a.x", "a (2).x", "a", "a", "a (3).x", "a.x", "", "", ".x", ".x", "a (2) (2).x", "b.x"]
    rows = [("g", i, n) for i, n in enumerate(names)] + [("h", 0, "a.x"), ("h", 1, None), ("h", 2, "file")]
    found = packages.unique_names(spark.createDataFrame(rows, "g string, i int, n string"), "g", "i", "n").collect()
    by = {(r.g, r.i): r.unique_name for r in found}
    assert [by["g", i] for i in range(len(names))] == folded(names)
    assert [by["h", i] for i in range(3)] == ["a.x", "file", "file (2)"]


def test_resolved_paths(spark):
    rows = [("ppt/slides/_rels/s.xml.rels", "../media/a.png", "ppt/media/a.png"), ("_rels/.rels", "/xl/a+b%20c", "xl/a+b c"), ("_rels/.rels", "../../x/./y//z", "x/y/z"), ("a/_rels/b.rels", "bad%zz", "a/bad%zz")]
    assert column(spark, packages.resolved(F.col("r"), F.col("t")), [r[:2] for r in rows], "r string, t string") == [r[2] for r in rows]


def test_package_checks_of_empty_and_null(spark):
    schema = "g string, name string, xml string"
    assert packages.package_checks(spark.createDataFrame([], schema), "g", "name", "xml").collect() == []
    rows = [("a", "[Content_Types].xml", None), ("a", "_rels/.rels", None), ("b", None, "x")]
    found = {r.g: (r.resolves, r.active_links) for r in packages.package_checks(spark.createDataFrame(rows, schema), "g", "name", "xml").collect()}
    assert found == {"a": (True, False), "b": (False, False)}


def test_upsample_vector(spark):
    image = spark.createDataFrame([("i", y, x, float(x)) for y in range(2) for x in range(2)], "k string, y int, x int, v double")
    found = {(r.y, r.x): r.v for r in pictures.upsample(image, "k", 4, 1).collect()}
    line = [found[0, x] for x in range(4)]
    assert line == pytest.approx([0, 0.25, 0.75, 1]) and len(found) == 4


def resampled(pixels, w, h, width, height):
    """The plain way: {(y, x): v}; pixels that are null or absent add nothing."""
    out = {}
    for y in range(height):
        for x in range(width):
            fy, fx = (min(max((k + 0.5) * size / count - 0.5, 0.0), size - 1) for k, size, count in ((y, h, height), (x, w, width)))
            taps = [(int(fy) + j, int(fx) + i, (fx - int(fx) if i else 1 - fx + int(fx)) * (fy - int(fy) if j else 1 - fy + int(fy))) for j in (0, 1) for i in (0, 1)]
            found = [(pixels[j, i], share) for j, i, share in taps if (j, i) in pixels]
            if found:
                known = [v * share for v, share in found if v is not None]
                out[y, x] = sum(known) if known else None
    return out


@pytest.mark.parametrize(("width", "height"), [(1, 1), (4, 3), (7, 21), (30, 2)])
def test_upsample_of_any_size(spark, width, height):
    sizes = {"one": (1, 1), "wide": (9, 1), "odd": (7, 5), "large": (23, 17), None: (2, 3)}
    pictures_ = {k: {(y, x): None if (x * 5 + y) % 7 == 3 or k == "odd" and y < 3 else (x * 31 + y * 17) % 11 - 5.0 for y in range(h) for x in range(w) if (k, y, x) != ("wide", 0, 4)} for k, (w, h) in sizes.items()}
    rows = [(k, y, x, v) for k, image in pictures_.items() for (y, x), v in image.items()]
    got = pictures.upsample(spark.createDataFrame(rows, "k string, y int, x int, v double"), "k", width, height).collect()
    want = {(k, y, x): v for k, image in pictures_.items() for (y, x), v in resampled(image, *sizes[k], width, height).items()}
    assert {(r.k, r.y, r.x): r.v for r in got} == {k: v if v is None else pytest.approx(v) for k, v in want.items()} and len(got) == len(want)


def test_upsample_broadcasts_nothing(spark, tmp_path):
    """Pixels of many pictures go through one exchange, by picture; the plan that runs has no join, whatever is estimated."""
    spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 64), k -> cast(k + id AS float)) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = registry.upsample(spark, str(tmp_path))
    assert found.agg(F.count("*"), F.count("v")).first() == (3000 * 143, 3000 * 143)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "Join" not in plan and "Broadcast" not in plan and final.count("Exchange hashpartitioning") == 1


def test_upsample_of_odd_vectors(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    inf, nan = float("inf"), float("nan")
    rows = [(1, [float(k) for k in range(64)]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [float(k) for k in range(80)]), (6, [None] * 63 + [1.0]), (7, [1.0] * 63 + [inf]), (8, [nan] + [0.5] * 63), (None, [2.0] * 64), (9, [1.0] * 64), (9, [0.25] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    embeddings = duckdb.read_parquet(f"{tmp_path}/embeddings.parquet/*.parquet")  # noqa: F841  (the SQL reads it)
    got = [tuple(r) for r in registry.upsample(spark, str(tmp_path)).select("vec_id", "y", "x", "v").collect()]
    assert sorted(map(str, got)) == sorted(map(str, duckdb.sql(registry.ORACLE_SQL["upsample"]).fetchall()))


def jpeg(*parts):
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b for m, b in parts) + b"\xff\xd9"


def test_jpeg_segments():
    frame = b"\x08" + struct.pack(">HHB", 7, 9, 1) + b"\1\x11\0"
    little = b"Exif\0\0II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x112, 3, 1, 6, 0)
    found = pictures.segments(jpeg((0xE1, little), (0xFE, b"note"), (0xC2, frame)))
    assert (found["width"], found["height"], found["components"], found["progressive"], found["orientation"], found["reason"]) == (9, 7, 1, True, 6, None)
    assert [s["marker"] for s in found["segments"]] == [0xE1, 0xFE, 0xC2]
    for data, reason in ((b"", "unreadable"), (b"\xff\xd8", "corrupt"), (jpeg((0xC9, frame)), "unsupported"), (jpeg((0xC0, frame))[:12], "corrupt"), (jpeg((0xC0, b"\x08" + struct.pack(">HHB", 60000, 60000, 3))), "too-large"), (jpeg((0xE1, b"Exif\0\0II*\0\xff\xff\xff\xff"), (0xC0, b"\x08\0\0\0\0\1")), "corrupt")):
        assert pictures.segments(data)["reason"] == reason


@pytest.mark.parametrize("counts", [{5: 1}, {0: 3, 1: 3, 2: 3}, {k: k + 1 for k in range(256)}, {k: 2**k for k in range(30)}])
def test_prefix_codes(counts):
    lengths = pictures.code_lengths(counts)
    codes = pictures.canonical(lengths)
    assert set(lengths) == set(counts) and max(lengths.values()) <= 16
    shown = [format(codes[s], f"0{lengths[s]}b") for s in counts]
    assert all("0" in c for c in shown) and not any(a != b and b.startswith(a) for a in shown for b in shown)
    heap, cost = [*counts.values(), 1], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    if len(counts) < 20 or counts[0] == 1 and len(counts) == 256:  # nothing had to be shortened: optimal with the reserved symbol
        assert sum(counts[s] * n for s, n in lengths.items()) <= cost


def test_prefix_codes_count_every_byte(spark, tmp_path):
    rows = [("en", "plain text"), ("en", ""), ("fr", "é€ 😀 漢"), (None, "x"), ("fr", None)]
    spark.createDataFrame(rows, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for lang, text in rows:
        for b in (text or "").encode() if lang else b"":
            want[lang, b] = want.get((lang, b), 0) + 1
    assert {(r["lang"], r["symbol"]): r["count"] for r in registry.QUERIES["prefix_codes"](spark, str(tmp_path)).collect()} == want
