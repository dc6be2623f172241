"""Queries of archives, pictures and office packages. Files are made from the tables' rows by the library's own writers, so that their entries are known."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.operators import engines
from quarry.plans.registry import query
from quarry.session import table
from quarry.sources import archives, documents, jpeg, pdf


def entry(name: str, raw: bytes, method: int = 0, time: int = 0) -> tuple[dict, bytes]:
    """An entry and its stored bytes, as assemble() takes them."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = deflate.compress(raw) + deflate.flush() if method == 8 else raw
    encoded = name.encode()
    return {"name": name, "name_bytes": encoded, "made_by": 20, "flags": 0x800, "method": method, "time": time, "date": 33, "crc": zlib.crc32(raw), "csize": len(packed), "usize": len(raw), "internal": 0, "external": 0, "comment": b""}, packed


def archive_of(names: list[str], texts: list[str], methods: list[int]) -> bytes:
    return archives.assemble([entry(n, t.encode(), m) for n, t, m in zip(names, texts, methods, strict=True)])


def conversations(spark, d) -> DataFrame:
    """file_id and content: an archive for each conversation, with an entry for each turn, every third one deflated already. The entries of one archive meet in a task, as its bytes must."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))

    def build(batches):
        for batch in batches:
            made = [archive_of([f"turn/{t['turn']}.txt" for t in all_], [t["text"] * 3 for t in all_], [8 if t["turn"] % 3 == 2 else 0 for t in all_]) for all_ in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["file_id", "content"])

    return gathered.mapInArrow(build, "file_id string, content binary")


@query("SELECT conv_id::VARCHAR AS file_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS index, 'turn/' || turn || '.txt' AS name, CASE WHEN turn % 3 = 2 THEN 8 ELSE 0 END AS method, 3 * strlen(coalesce(text, ''))::BIGINT AS usize, true AS readable, NULL::VARCHAR AS reason FROM conversations")
def zip_entries(spark, d):
    return archives.entries(conversations(spark, d)).select("file_id", "index", "name", "method", "usize", "readable", "reason")


@query("SELECT conv_id::VARCHAR AS file_id, 'turn/' || turn || '.txt' AS name, sha256(repeat(coalesce(text, ''), 3)) AS sha FROM conversations")
def zip_rewrite(spark, d):
    """What the rewritten archives hold, read again with the verified reader."""
    done = engines.compress(conversations(spark, d)).select("file_id", "output")

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left = archives.budget(len(data))
                rows = [(key, e["name"], archives.content(data, e, left)) for e in archives.directory(data)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["file_id", "name", "raw"])

    return done.mapInArrow(run, "file_id string, name string, raw binary").select("file_id", "name", F.sha2("raw", 256).alias("sha"))


@query()
def compress_gain(spark, d):
    """Reasons, sizes and digests of whole files; sizes depend on the deflate library, so no SQL."""
    return engines.compress(conversations(spark, d)).drop("output")


def chunk(kind: bytes, raw: bytes) -> bytes:
    return struct.pack(">I", len(raw)) + kind + raw + struct.pack(">I", zlib.crc32(kind + raw))


def png(width: int, height: int, rows: bytes, text: bytes = b"") -> bytes:
    """An 8-bit gray picture, badly packed, with a text chunk."""
    lines = b"".join(b"\0" + rows[k * width : (k + 1) * width] for k in range(height))
    packed = zlib.compress(lines, 0)
    half = len(packed) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"Comment\0" + text) + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


def gray_pictures(spark, d) -> DataFrame:
    """file_id and content: an 8 by 24 picture of each embedding's signs and sizes."""

    def build(batches):
        for batch in batches:
            made = [png(8, 24, bytes(int(abs(v) * 200) & 255 for v in x) * 3, str(k).encode()) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["vec_id", "content"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(build, "vec_id long, content binary")


@query("SELECT vec_id, 8 AS width, 24 AS height, false AS animated, 'IHDR,tEXt,IDAT,IDAT,IEND' AS chunks FROM embeddings")
def png_info(spark, d):
    return archives.png_info(gray_pictures(spark, d), "vec_id", "content").select("vec_id", "width", "height", "animated", F.array_join("chunks", ",").alias("chunks"))


@query("SELECT vec_id::VARCHAR AS file_id, 'png' AS format, true AS optimized, true AS same FROM embeddings")
def png_optimise(spark, d):
    done = engines.compress(gray_pictures(spark, d).select(F.col("vec_id").alias("file_id"), "content"))
    return done.select("file_id", "format", "optimized", F.forall("checks", lambda c: c["ok"]).alias("same"))


def packages(spark, d) -> DataFrame:
    """file_id and content: a small package for each supplier; every fourth has macros, every fifth is signed, every seventh has an unsafe name."""

    def build(batches):
        for batch in batches:
            made = []
            for k in batch.column(0).to_pylist():
                names = ["[Content_Types].xml", "ppt/presentation.xml", "docProps/core.xml", *(["ppt/vbaProject.bin"] if k % 4 == 0 else []), *(["_xmlsignatures/s.xml"] if k % 5 == 0 else []), *(["../x"] if k % 7 == 0 else [])]
                made.append(archives.assemble([entry(n, (f"<{n}><dc:creator>me {k}</dc:creator></{n}>" * 20).encode()) for n in names] + [entry("ppt/media/p.PNG", png(8, 8, bytes(64), b"x" * 50))]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["file_id", "content"])

    return table(spark, d, "supplier").select("s_suppkey").mapInArrow(build, "file_id string, content binary")


@query("SELECT s_suppkey::VARCHAR AS file_id, CASE WHEN s_suppkey % 7 = 0 THEN 'unsafe-paths' WHEN s_suppkey % 4 = 0 THEN 'macro' END AS reason, s_suppkey % 7 > 0 AND s_suppkey % 4 > 0 AS optimized FROM supplier")
def office_rewrite(spark, d):
    return engines.compress(packages(spark, d)).select("file_id", "reason", "optimized")


def coefficient_pictures(spark, d) -> DataFrame:
    """vec_id, way and content: an 8 by 8 gray JPEG whose coefficients are an embedding's numbers, sequential and progressive."""

    def build(batches):
        for batch in batches:
            rows = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = jpeg.frame(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + bytes([1, 0x11, 0]))
                made.components[0].blocks[0, 0, : len(x)] = np.floor(np.array(x) * 60 + 0.5).astype(int)[:64]
                made.quantisers = {0: bytes([0, *[1] * 64])}
                rows += [(key, way, jpeg.encode(made, way)) for way in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["vec_id", "progressive", "content"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(build, "vec_id long, progressive boolean, content binary")


@query("SELECT vec_id, p AS progressive, (i - 1)::INT AS place, floor(embedding[i]::DOUBLE * 60 + 0.5)::INT AS value FROM embeddings, generate_series(1, 64) AS g(i), (VALUES (false), (true)) AS w(p) WHERE floor(embedding[i]::DOUBLE * 60 + 0.5) <> 0")
def jpeg_coefficients(spark, d):
    files = coefficient_pictures(spark, d)

    def run(batches):
        for batch in batches:
            found = [jpeg.coefficients(data)[0][0, 0].tolist() for data in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["vec_id", "progressive", "all"])

    rows = files.mapInArrow(run, "vec_id long, progressive boolean, all array<int>")
    return rows.select("vec_id", "progressive", F.posexplode("all").alias("place", "value")).where("value <> 0")


@query("SELECT vec_id, p AS progressive, 1 AS pages, round(8 * 0.75, 2) AS width, round(8 * 0.75, 2) AS height, true AS same FROM embeddings, (VALUES (false), (true)) AS w(p)")
def picture_document(spark, d):
    files = coefficient_pictures(spark, d)

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                made = documents.jpeg_page(data)
                count, (width, height), streams = documents.facts(made)
                rows.append((count, width, height, streams[0] == data))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.bool_())))], ["vec_id", "progressive", "pages", "width", "height", "same"])

    return files.mapInArrow(run, "vec_id long, progressive boolean, pages int, width double, height double, same boolean")


#: A stream that still is long when it is packed.
SHOWN = b"%" + b"".join(hashlib.sha256(bytes([k])).hexdigest().encode() for k in range(40))


def paged(texts: list[str]) -> bytes:
    """A document with a page for each text, 100 by 200 plus the page's index, its size inherited by every other page; every page shows the same long stream as well."""
    made = pdf.Document({1: pdf.Item({b"/Type": pdf.Name(b"/Catalog"), b"/Pages": pdf.Ref(2)}), 2: pdf.Item({}), 3: pdf.Item({b"/Unused": pdf.Plain(b"(x)")})}, {b"/Root": pdf.Ref(1)})
    kids = []
    for k, text in enumerate(texts):
        number = 10 + 3 * k
        made.objects[number] = pdf.Item({b"/Type": pdf.Name(b"/Page"), b"/Parent": pdf.Ref(2), b"/Contents": [pdf.Ref(number + 1), pdf.Ref(number + 2)]} | ({b"/MediaBox": [pdf.Plain(str(n).encode()) for n in (0, 0, 100, 200 + k)]} if k % 2 else {}))
        made.objects[number + 1] = pdf.Item({}, b"%" + text.encode())
        made.objects[number + 2] = pdf.Item({}, SHOWN)
        kids.append(pdf.Ref(number))
    made.objects[2].value = {b"/Type": pdf.Name(b"/Pages"), b"/Kids": kids, b"/Count": pdf.Plain(str(len(kids)).encode()), b"/MediaBox": [pdf.Plain(b"0"), pdf.Plain(b"0"), pdf.Plain(b"100"), pdf.Plain(b"200")]}
    return made.save()


def facts(data: bytes) -> list[tuple[int, int, bytes]]:
    """Height, rotation and first content of each page."""
    document = pdf.load(data)
    out = []
    for _, page in document.pages():
        item = document.objects[page[b"/Contents"][0].number]
        raw = pdf.inflated(item.stream) if document.filters(item) else item.stream
        out.append((int(page[b"/MediaBox"][3]), int(page.get(b"/Rotate", b"0")), raw[1:]))
    return out


def paged_conversations(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))


def on_documents(frame: DataFrame, work) -> DataFrame:
    """conv_id, page, height, rotate and sha of the pages that work(texts) leaves of each conversation's document."""

    def run(batches):
        for batch in batches:
            for key, all_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(key, k, *x) for k, x in enumerate(facts(work([t["text"] for t in all_])))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["conv_id", "page", "height", "rotate", "raw"])

    rows = frame.mapInArrow(run, "conv_id long, page int, height int, rotate int, raw binary")
    return rows.select("conv_id", "page", "height", "rotate", F.sha2("raw", 256).alias("sha"))


PAGES = "p AS (SELECT conv_id::BIGINT AS conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS k, count(*) OVER (PARTITION BY conv_id)::INT AS n, coalesce(text, '') AS text FROM conversations)"


@query(f"WITH {PAGES} SELECT conv_id, k AS page, 200 + CASE WHEN k % 2 = 1 THEN k ELSE 0 END AS height, 0 AS rotate, sha256(text) AS sha FROM p")
def pdf_compress(spark, d):
    return on_documents(paged_conversations(spark, d), lambda texts: pdf.compress(paged(texts))[0] or paged(texts))


@query(f"WITH {PAGES} SELECT conv_id, n - 1 - k AS page, 200 + CASE WHEN k % 2 = 1 THEN k ELSE 0 END AS height, (k * 90) % 360 AS rotate, sha256(text) AS sha FROM p UNION ALL SELECT conv_id, n, 200, 0, sha256(text) FROM p WHERE k = 0")
def pdf_organise(spark, d):
    def work(texts):
        spec = [(k, k * 90) for k in reversed(range(len(texts)))] + [(0, 0)]
        return pdf.picked([(pdf.load(paged(texts)), spec)]).save()

    return on_documents(paged_conversations(spark, d), work)


@query(f"WITH {PAGES} SELECT conv_id, (CASE WHEN k = 0 THEN n - 1 ELSE k - 1 END + f * n)::INT AS page, 200 + CASE WHEN k % 2 = 1 THEN k ELSE 0 END AS height, 0 AS rotate, sha256(text) AS sha FROM p, (VALUES (0), (1)) AS v(f) WHERE n > 1")
def pdf_merge(spark, d):
    """Split into the first page and the others, put together the other way round, and that twice."""

    def work(texts):
        first, others = pdf.split(paged(texts), [[0], list(range(1, len(texts)))])
        return pdf.merged([others, first, others, first])

    return on_documents(paged_conversations(spark, d).where(F.size("all") > 1), work)
