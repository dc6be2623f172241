"""Queries of the decisions, of page, reference and picture relations, with their DuckDB SQL. Inputs vary with keys in several independent ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions import rules as D, scalars as S
from quarry.operators import pictures as Pic, relational as R
from quarry.plans.registry import PIXELS, chosen, pick, query
from quarry.session import table


def parts(spark, d, **columns) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", *(c.alias(n) for n, c in columns.items()))


STEMS, ENDS = ("a", "word/media/x", "xl/vbaProject", "ppt/embeddings/o", "docProps/core", "mimetype", "_xmlsignatures/s", "b/c.d"), (".PNG", ".xml", ".bin", "", ".tar.gz", ".jpeg", ".txt")
ENTRY = f"{chosen('p_partkey', STEMS)} || {chosen('p_partkey', ENDS, 8)}"


def entry_names():
    return F.concat(pick("p_partkey", STEMS), pick("p_partkey", ENDS, 8))


@query(f"""WITH s AS (SELECT p_partkey, p_size, {ENTRY} AS name, p_partkey % 3 > 0 AS readable, p_size * 6000000 AS usize, {chosen('p_partkey', (0, 8), 3)} AS method, {chosen('p_partkey', ('pack', 'copy', 'transform'), 5)} AS policy FROM part)
SELECT p_partkey, CASE WHEN NOT readable OR policy = 'copy' THEN 'copy' WHEN usize > 134217728 THEN CASE WHEN method = 8 OR regexp_matches(lower(name), '\\.(png|jpeg|gz)$') THEN 'copy' ELSE 'stream' END ELSE policy END AS action,
CASE WHEN p_partkey % 7 > 0 AND least(p_size * 90, p_partkey % 5000) >= p_partkey % 4000 THEN 'copy' WHEN p_size * 90 < p_partkey % 5000 THEN 'deflate' ELSE 'store' END AS form,
CASE WHEN p_size = 1 AND name = 'mimetype' THEN 'copy' ELSE 'pack' END AS first FROM s""")
def entry_policy(spark, d):
    rows = parts(spark, d, name=entry_names(), readable=F.col("p_partkey") % 3 > 0, usize=F.col("p_size").cast("long") * 6000000, method=pick("p_partkey", (0, 8), 3), policy=pick("p_partkey", ("pack", "copy", "transform"), 5))
    k = F.col("p_partkey")
    return rows.select(k, D.entry_action(*map(F.col, ("name", "readable", "usize", "method", "policy"))).alias("action"), D.stored_as(k % 7 == 0, k % 4000, k % 5000, F.col("p_size") * 90).alias("form"), D.first_entry_policy(F.col("p_size") - 1, F.col("name")).alias("first"))


@query(f"""SELECT p_partkey, CASE WHEN starts_with(name, '_xmlsignatures/') OR contains(name, '/embeddings/') OR name IN ('xl/vbaProject.bin') THEN 'copy'
WHEN p_size % 2 = 0 AND (regexp_matches(name, '^word/media/x\\.(PNG|jpeg)$') OR p_size % 3 = 0 AND name = 'docProps/core.xml') THEN 'transform' ELSE 'pack' END AS policy, contains(name, '/embeddings/') OR name = 'xl/vbaProject.bin' AS active FROM (SELECT p_partkey, p_size, {ENTRY} AS name FROM part)""")
def office_policy(spark, d):
    rows = parts(spark, d, name=entry_names())
    return rows.select("p_partkey", D.office_policy(F.col("name"), F.col("p_size") % 2 == 1, F.col("p_size") % 3 == 0).alias("policy"), F.col("name").rlike(D.ACTIVE).alias("active"))


@query("""WITH s AS (SELECT p_partkey, p_retailprice AS o, CASE WHEN p_partkey % 4 > 0 THEN p_size * 40.0 END AS a, CASE WHEN p_partkey % 3 > 0 THEN p_size * 37.0 - p_partkey % 200 END AS b FROM part),
t AS (SELECT *, CASE WHEN b IS NOT NULL AND (a IS NULL OR b < a * 0.9) THEN 'lossy' WHEN a IS NOT NULL THEN 'lossless' END AS c FROM s)
SELECT p_partkey, CASE WHEN CASE c WHEN 'lossy' THEN b WHEN 'lossless' THEN a END < o THEN c END AS choice FROM t""")
def lossy_choice(spark, d):
    k = F.col("p_partkey")
    rows = parts(spark, d, a=F.when(k % 4 > 0, F.col("p_size") * 40.0), b=F.when(k % 3 > 0, F.col("p_size") * 37.0 - k % 200))
    return rows.select("p_partkey", D.best_candidate(F.col("p_retailprice"), F.col("a"), F.col("b")).alias("choice"))


@query("""SELECT p_partkey, CASE WHEN w IS NULL THEN 'unreadable' WHEN p_partkey % 5 = 0 THEN 'animated' WHEN w * h > CASE WHEN p_partkey % 2 = 0 THEN 64e6 ELSE 120e6 END THEN 'too-large' END AS reason,
CASE t WHEN 'jpg' THEN 'jpeg' ELSE t END = f AND NOT ends_with(lower(n), '.svg') AS same FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_size * 400.0 END AS w, p_partkey % 9000 + 500 AS h,
""" + f"{chosen('p_partkey', ('jpg', 'png', 'webp', 'pdf'), 2)} AS t, {chosen('p_partkey', ('jpeg', 'png', 'webp', 'gif'), 3)} AS f, 'x' || {chosen('p_partkey', ('.svg', '.SVG', '.png', ''), 5)} AS n FROM part)")
def image_limits(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("x"), pick("p_partkey", (".svg", ".SVG", ".png", ""), 5))
    same = D.same_format(pick("p_partkey", ("jpg", "png", "webp", "pdf"), 2), pick("p_partkey", ("jpeg", "png", "webp", "gif"), 3), name)
    return parts(spark, d).select(k, D.image_limits(F.when(k % 7 > 0, F.col("p_size") * 400), (k % 9000 + 500).cast("int"), k % 5 == 0, k % 2 == 0).alias("reason"), same.alias("same"))


@query(f"""WITH s AS (SELECT p_partkey, {chosen('p_partkey', ('', 'FlateDecode', 'DCTDecode', 'LZWDecode', 'FlateDecode,DCTDecode'))} AS f, {chosen('p_partkey', (None, 'XObject', 'Metadata', 'XRef', 'ObjStm'), 5)} AS t, CASE WHEN p_partkey % 11 > 0 THEN p_size * 20 END AS n, p_size * 15 AS packed, p_retailprice AS old FROM part)
SELECT p_partkey, CASE WHEN f = 'DCTDecode' THEN 'jpeg' WHEN f IN ('', 'FlateDecode') AND n BETWEEN 256 AND 134217728 AND coalesce(t NOT IN ('Metadata', 'XRef', 'ObjStm'), true) AND packed < old * 0.99 THEN 'deflate' END AS way FROM s""")
def stream_way(spark, d):
    k = F.col("p_partkey")
    filters = F.filter(F.split(pick("p_partkey", ("", "FlateDecode", "DCTDecode", "LZWDecode", "FlateDecode,DCTDecode")), ","), lambda x: x != "")
    return parts(spark, d).select(k, D.stream_eligible(filters, pick("p_partkey", (None, "XObject", "Metadata", "XRef", "ObjStm"), 5), F.when(k % 11 > 0, F.col("p_size") * 20), F.col("p_size") * 15, F.col("p_retailprice")).alias("way"))


@query(f"""WITH s AS (SELECT p_partkey, {chosen('p_partkey', ('DeviceGray', 'DeviceRGB', 'ICCBased', 'DeviceCMYK', None))} AS c, {chosen('p_partkey', (1, 3, 4, None), 5)} AS n, p_size AS w, p_size - (p_partkey % 9 = 0)::INT AS own, p_partkey % 6 = 0 AS dec, p_partkey % 7 = 0 AS mask FROM part),
g AS (SELECT *, CASE WHEN c = 'DeviceGray' OR c = 'ICCBased' AND n = 1 THEN true WHEN c = 'DeviceRGB' OR c = 'ICCBased' AND n = 3 THEN false END AS gray FROM s)
SELECT p_partkey, gray, gray IS NOT NULL AND w = own AND NOT dec AND NOT mask AND w * 3000000 <= 120000000 AS lossy FROM g""")
def lossy_gate(spark, d):
    k, w = F.col("p_partkey"), F.col("p_size")
    rows = parts(spark, d, gray=D.gray(pick("p_partkey", ("DeviceGray", "DeviceRGB", "ICCBased", "DeviceCMYK", None)), pick("p_partkey", (1, 3, 4, None), 5)))
    return rows.select(k, "gray", D.lossy_image(F.col("gray"), w, F.lit(3000000), w - (k % 9 == 0).cast("int"), F.lit(3000000), k % 6 == 0, F.lit(False), k % 7 == 0).alias("lossy"))


@query("SELECT page_id, page_id % 5 = 0 OR regexp_matches(lower(replace(t, chr(1), '')), 'msip_label|classification|sensitivity|confidentiality') AS keeps FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || 'Con' || 'fidentiality' WHEN 1 THEN html || 'SENSITIVITY' WHEN 2 THEN html || 'Sensitiv' ELSE html END AS t FROM pages)")
def label_keep(spark, d):
    k = F.col("page_id") % 4
    text = F.concat("html", F.when(k == 0, "C\0o\0nfidentiality").when(k == 1, "SENSITIVITY").when(k == 2, "Sensitiv").otherwise(""))
    return table(spark, d, "pages").select("page_id", D.may_hold_label(text, F.col("page_id") % 5 == 0).alias("keeps"))


@query("SELECT vec_id, CASE WHEN c < 0.005 OR c > 0.995 THEN 'no-subject' END AS reason, round(CASE WHEN c < 0.04 THEN 0 WHEN c > 0.96 THEN 1 ELSE (c - 0.04::DOUBLE) / (0.96::DOUBLE - 0.04::DOUBLE) END, 6) AS stretched, greatest(2, floor(greatest(vec_id % 4000, 100) / 320 + 0.5))::INT AS radius FROM (SELECT vec_id, embedding[1]::DOUBLE * 3 + 0.5 AS c FROM embeddings)")
def mask_rules(spark, d):
    c = F.col("embedding")[0].cast("double") * 3 + 0.5
    rows = table(spark, d, "embeddings").select("vec_id", c.alias("c"))
    return rows.select("vec_id", D.no_subject(F.col("c")).alias("reason"), F.round(D.clipped(F.col("c")), 6).alias("stretched"), D.refine_radius((F.col("vec_id") % 4000).cast("int"), F.lit(100)).alias("radius"))


BYTES = "SELECT vec_id, i - 1 AS i, CAST(floor((embedding[i]::DOUBLE + 1) * 127.5) AS INT) AS v FROM embeddings, generate_series(1, 64) AS g(i)"


def rgba(spark, d):
    """vec_id, i, v: the numbers of an embedding as bytes of pixels, four channels each."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select("vec_id", "i", F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("v"))


@query(f"WITH b AS ({BYTES}), m AS (SELECT vec_id AS k, greatest(1, max(v) FILTER (WHERE i % 4 < 3)) AS most FROM b GROUP BY vec_id) SELECT vec_id, ((i % 4) * 16 + i // 4)::INT AS place, round(v / most - 0.5, 6) AS x FROM b JOIN m ON k = vec_id WHERE i % 4 < 3")
def network_input(spark, d):
    return Pic.network_input(rgba(spark, d), "vec_id", "i", "v").select("vec_id", "place", F.round("x", 6).alias("x"))


@query(f"SELECT vec_id, bool_and(v = 255) FILTER (WHERE i % 4 = 3) AS opaque, bool_or(v < 255) FILTER (WHERE i % 4 = 3) AS transparent, max(v) FILTER (WHERE i % 4 = 0) AS most FROM (SELECT vec_id, i, CASE WHEN i % 4 = 3 AND (vec_id % 3 = 0 OR v > 60) THEN 255 ELSE v END AS v FROM ({BYTES})) GROUP BY vec_id")
def opacity(spark, d):
    v = F.when((F.col("i") % 4 == 3) & ((F.col("vec_id") % 3 == 0) | (F.col("v") > 60)), 255).otherwise(F.col("v"))
    found = Pic.opacity(rgba(spark, d).withColumn("v", v), "vec_id", "i", "v")
    most = rgba(spark, d).withColumn("v", v).where("i % 4 = 0").groupBy("vec_id").agg(F.max("v").alias("most"))
    return found.join(most, "vec_id")


@query("SELECT l_orderkey, l_linenumber, '-' || CASE WHEN x >= 10 THEN floor(x + 0.5)::BIGINT::VARCHAR WHEN t = floor(t) THEN t::BIGINT::VARCHAR ELSE printf('%.1f', t) END || '%' AS saved FROM (SELECT *, floor(x * 10 + 0.5) / 10 AS t FROM (SELECT l_orderkey, l_linenumber, 100 * (1 - (l_extendedprice * (1 - l_discount / 1.3))::DOUBLE / l_extendedprice::DOUBLE) AS x FROM lineitem))")
def saving_percent(spark, d):
    rows = table(spark, d, "lineitem")
    after = (F.col("l_extendedprice") * (1 - F.col("l_discount") / 1.3)).cast("double")
    return rows.select("l_orderkey", "l_linenumber", D.percent_saved(F.col("l_extendedprice").cast("double"), after).alias("saved"))


NAMES, PATHS = (" report. ", "report.pdf ", "...", "a.b ", "x", "no.ext here"), ("out.PDF", "out", None, "dir.x/out", "o.toolongext")


@query(f"""WITH s AS (SELECT p_partkey, {chosen('p_partkey', NAMES)} AS n, {chosen('p_partkey', PATHS, 6)} AS p, {chosen('p_partkey', ('in.JPG', 'in', 'a.tar.gz'), 30)} AS f FROM part),
t AS (SELECT *, regexp_replace(ltrim(n), '[.\\s]+$', '') AS c, coalesce(nullif(lower(regexp_extract(p, '\\.([A-Za-z0-9]{{1,8}})$', 1)), ''), nullif(lower(regexp_extract(n, '\\.([A-Za-z0-9]{{1,8}})$', 1)), ''), nullif(lower(regexp_extract(f, '\\.([A-Za-z0-9]{{1,8}})$', 1)), '')) AS e FROM s)
SELECT p_partkey, CASE WHEN regexp_matches(c, '\\.[^.]+$') OR e IS NULL THEN CASE c WHEN '' THEN 'file' ELSE c END ELSE CASE c WHEN '' THEN 'file' ELSE c END || '.' || e END AS name, ends_with(lower(f), '.jpg') OR p_partkey % 5 = 0 AS svg FROM t""")
def ensured_name(spark, d):
    source = pick("p_partkey", ("in.JPG", "in", "a.tar.gz"), 30)
    svg = D.is_svg(F.when(F.col("p_partkey") % 5 == 0, "image/svg+xml"), F.regexp_replace(source, "JPG", "SVG"))
    return parts(spark, d).select("p_partkey", D.with_extension(pick("p_partkey", NAMES), pick("p_partkey", PATHS, 6), source).alias("name"), svg.alias("svg"))


@query("SELECT p_partkey, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v)))::INT + 1 END AS bits, least(p_size % 4, 1) AS tab FROM (SELECT p_partkey, p_size, (p_partkey * 37) % 5000 - 2500 AS v FROM part)")
def magnitude_bits(spark, d):
    return parts(spark, d).select("p_partkey", D.magnitude((F.col("p_partkey") * 37) % 5000 - 2500).alias("bits"), D.table_index(F.col("p_size") % 4).alias("tab"))


@query("SELECT p_partkey, i::INT AS index, 0 AS rotation, false AS deleted FROM part, LATERAL (SELECT unnest(range(p_size)) AS i)")
def fresh_pages(spark, d):
    return parts(spark, d).select("p_partkey", F.explode(D.fresh_pages(F.col("p_size"))).alias("page")).select("p_partkey", "page.*")


@query("SELECT doc_id, hex(encode(text)[1:4]) AS head, coalesce(substr(hex(encode(text)), (2 * (doc_id % 50) + 1)::BIGINT, (2 * greatest(0, n_chars % 90 - doc_id % 50))::BIGINT), '') AS middle, length(hex(encode(text))) // 2 + 2 AS joined FROM documents WHERE text IS NOT NULL".replace("hex(encode(text)[1:4])", "substr(hex(encode(text)), 1, 8)"))
def byte_ranges(spark, d):
    content = F.encode("text", "UTF-8")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "n_chars", content.alias("c"))
    return rows.select("doc_id", F.hex(D.head(F.col("c"), 4)).alias("head"), F.hex(D.byte_range(F.col("c"), F.col("doc_id") % 50, F.col("n_chars") % 90)).alias("middle"), F.octet_length(F.concat("c", F.lit(b"\0\1"))).cast("long").alias("joined"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'e' || text WHEN doc_id % 2 = 0 THEN left(text, 5) ELSE text END) AS sha FROM documents WHERE text IS NOT NULL")
def file_pick(spark, d):
    k = F.col("doc_id")
    best = D.picked(F.when(k % 3 == 0, F.concat(F.lit("e"), "text")), F.when(k % 2 == 0, F.substring("text", 1, 5)), F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(best, 256).alias("sha"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey % 5 > 0")
def orphan_folders(spark, d):
    folders = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    held = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("node"))
    own = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("node"))
    return R.unused(R.unused(folders, "s_nationkey", held), "s_suppkey", own)


@query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS used FROM documents GROUP BY source")
def folder_usage(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("used"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 6 > 1 AND p_size - 3 + p_partkey % 6 > 20 OR p_size < 4 THEN 'invalid' END AS reason FROM part WHERE p_partkey % 6 <> 1")
def page_check(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    asked = F.when(k % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array((s - 4).cast("bigint"), (s - 4 + k % 6).cast("bigint")))
    return parts(spark, d).where("p_partkey % 6 <> 1").select(k, D.bad_pages(asked, F.lit(20)).alias("reason"))


@query("SELECT p_partkey, abs(b - a) <= greatest(0.5, a * 0.01) AS same FROM (SELECT p_partkey, p_size * 7.0::DOUBLE AS a, p_size * 7.0::DOUBLE + (p_partkey % 100 - 50) / 12.0::DOUBLE AS b FROM part)")
def duration_check(spark, d):
    a = F.col("p_size") * 7.0
    return parts(spark, d).select("p_partkey", D.same_duration(a, a + (F.col("p_partkey") % 100 - 50) / F.lit(12.0)).alias("same"))


@query(f"""WITH s AS (SELECT p_partkey, p_size, {chosen('p_partkey', ('waiting', 'working', 'done', 'failed'))} AS st, p_partkey // 4 % 2 = 0 AS held, p_partkey // 8 % 2 = 0 AS res, {chosen('p_partkey', ('on', 'off', 'failed'), 3)} AS g, p_size % 2 = 0 AS hd, p_size % 3 = 0 AS stale FROM part)
SELECT p_partkey, CASE WHEN st = 'working' OR st = 'waiting' AND NOT held THEN 'pending' WHEN st = 'done' AND res THEN 'savable' ELSE 'idle' END AS state, hd AND g <> 'failed' AND NOT stale AS ready,
CASE WHEN p_size % 2 = 0 THEN CASE WHEN hd AND p_size % 3 = 0 THEN CASE WHEN p_partkey % 3 = 2 THEN 'password-wrong' ELSE 'password' END ELSE 'corrupt' END END AS reason FROM s""")
def queue_states(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    flag = lambda n: F.floor(k / n) % 2 == 0
    return parts(spark, d).select(k, D.queue_state(pick("p_partkey", ("waiting", "working", "done", "failed")), flag(4), flag(8)).alias("state"), D.ready(pick("p_partkey", ("on", "off", "failed"), 3), s % 2 == 0, s % 3 == 0).alias("ready"), D.password_reason(s % 2 == 1, s % 3 == 0, k % 3).alias("reason"))


@query("SELECT conv_id, count(*) FILTER (WHERE turn % 3 > 0) AS usable, count(*) = max(turn) + 1 AS complete, bool_or(turn > 2) AS headers FROM conversations GROUP BY conv_id")
def page_counts(spark, d):
    files = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("pages"), F.when(F.col("turn") > 2, F.create_map(F.lit("x-a"), F.lit("1"))).alias("headers"))
    return files.groupBy("conv_id").agg(F.count("pages").alias("usable"), (F.count("*") == F.max("turn") + 1).alias("complete"), F.coalesce(F.bool_or(F.size("headers") > 0), F.lit(False)).alias("headers"))


URLS, METHODS = ("https://app.example/a.js", "https://app.example/", "https://app.example/b?x=1", "https://other.example/a.js", "https://app.example/none.js", "https://app.example/b#?x"), ("GET", "HEAD", "POST")


@query(f"""SELECT page_id, CASE WHEN starts_with(u, 'https://other') THEN 'cross-origin' WHEN m = 'POST' THEN 'POST not permitted' WHEN n THEN NULL WHEN contains(u, '?x') AND NOT contains(u, '#') THEN 'query strings not permitted' WHEN u NOT IN ('https://app.example/a.js', 'https://app.example/b#?x') THEN 'not an application file' END AS why
FROM (SELECT page_id, {chosen('page_id', URLS)} AS u, {chosen('page_id', METHODS, 6)} AS m, page_id // 18 % 3 = 0 AS n FROM pages)""")
def worker_policy(spark, d):
    rows = table(spark, d, "pages").select("page_id", pick("page_id", URLS).alias("u"), pick("page_id", METHODS, 6).alias("m"), (F.floor(F.col("page_id") / 18) % 3 == 0).alias("n"))
    manifest = spark.createDataFrame([("/a.js",), ("/b",)], "path string")
    path = F.regexp_extract("u", r"^https://[^/?#]*([^?#]*)", 1)
    seen = R.flagged(rows.withColumn("path", path), "path", manifest, "path", "listed")
    return seen.select("page_id", D.worker_policy(F.col("u"), F.col("m"), F.col("n"), F.lit("https://app.example"), F.col("listed")).alias("why"))


@query("SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 40) AS is_mask FROM lineitem")
def mask_streams(spark, d):
    rows = table(spark, d, "lineitem")
    return R.flagged(rows.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", rows.where("l_quantity > 40").select("l_suppkey"), "l_suppkey", "is_mask").drop("l_partkey")


@query("SELECT l_orderkey, l_linenumber, coalesce(keep, l_partkey) AS target FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size, p_brand) AS keep FROM part) ON p_partkey = l_partkey")
def alias_rewrite(spark, d):
    from pyspark.sql import Window

    aliases = table(spark, d, "part").select("p_partkey", F.min("p_partkey").over(Window.partitionBy("p_size", "p_brand")).alias("keep")).where("p_partkey <> keep")
    return R.rewritten(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target")), "target", aliases, "p_partkey", "keep")


@query("SELECT vec_id, vec_id % 7 > 0 AND vec_id % 5 > 0 AND vec_id % 11 > 0 AS same FROM embeddings")
def same_pixels(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = rows.where("vec_id % 11 > 0").select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x, i: F.when(i == 63, x + F.lit(1).cast("float")).otherwise(x))).otherwise(F.col("embedding")).alias("embedding"))
    return R.same_arrays(rows, other, "vec_id", "embedding")


ORDER = ("png", "jpg", "webp", "pdf")


@query("""WITH s AS (SELECT p_size, unnest(CASE p_partkey % 3 WHEN 0 THEN ['jpg', 'png'] WHEN 1 THEN ['pdf', 'webp', 'jpg'] ELSE ['png'] END) AS t FROM part),
c AS (SELECT p_size FROM part GROUP BY p_size HAVING count(*) > 1) SELECT p_size, array_to_string(list_sort(list(DISTINCT list_position(['png', 'jpg', 'webp', 'pdf'], t)::VARCHAR)), ',') AS places FROM s WHERE p_size IN (SELECT p_size FROM c) GROUP BY p_size""")
def common_targets(spark, d):
    k = F.col("p_partkey") % 3
    listed = F.when(k == 0, F.array(F.lit("jpg"), F.lit("png"))).when(k == 1, F.array(F.lit("pdf"), F.lit("webp"), F.lit("jpg"))).otherwise(F.array(F.lit("png")))
    found = R.offered(table(spark, d, "part").select("p_size", listed.alias("t")), "p_size", "t", ORDER)
    return found.select("p_size", F.array_join(F.transform("targets", lambda t: R.ranked(t, ORDER).cast("string")), ",").alias("places"))


@query("""WITH s AS (SELECT conv_id, turn, (conv_id % 4)::INT AS a, (conv_id // 4 % 5)::INT AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
o AS (SELECT *, CASE WHEN a = b OR a >= n OR b >= n THEN turn * 10 WHEN turn = a THEN b * 10 + CASE WHEN b > a THEN 5 ELSE -5 END ELSE turn * 10 END AS w FROM s)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY w) - 1)::BIGINT AS place FROM o""")
def page_move(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("long").alias("place"))
    return R.moved(rows, "conv_id", "place", F.col("conv_id") % 4, F.floor(F.col("conv_id") / 4) % 5)


@query("""WITH s AS (SELECT conv_id, turn, conv_id % 5 AS a, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE -1 END AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN a < n AND a + b >= 0 AND a + b < n AND turn IN (a, a + b) THEN 2 * a + b - turn ELSE turn END::BIGINT AS place FROM s""")
def file_swap(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("long").alias("place"))
    return R.swapped(rows, "conv_id", "place", F.col("conv_id") % 5, F.when(F.col("conv_id") % 2 == 0, 1).otherwise(-1))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def last_blocked(spark, d):
    return R.first_rows(table(spark, d, "events").select("user_id", "event_id"), "user_id", [F.col("event_id").desc()], 20)


@query("SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id % 17, conv_id, turn) - 1)::BIGINT AS index FROM conversations")
def merged_pages(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    files = rows.select("conv_id", (F.col("conv_id") % 17).alias("place")).distinct()
    return R.merged(rows, files, "conv_id", "turn", "place").select("conv_id", "turn", "index")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation WHERE n_nationkey % 4 > 0), r AS (SELECT 7 AS node UNION SELECT CAST(dst AS INT) FROM e JOIN r ON src = node) SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT node FROM r)")
def swept_nodes(spark, d):
    n = table(spark, d, "nation")
    edges = n.where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst"))
    return R.unused(n.select("n_nationkey"), "n_nationkey", R.reachable(edges, n.where("n_nationkey = 7").select(F.col("n_nationkey").alias("node"))))


@query("SELECT url, sha256(html) AS sha FROM pages")
def manifest_sorted(spark, d):
    return table(spark, d, "pages").select("url", F.sha2("html", 256).alias("sha")).orderBy("url")


@query("SELECT source, doc_id, n_chars - coalesce(lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id), 0) AS difference FROM documents")
def dc_differences(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return R.differences(rows, ["source"], "doc_id", "n_chars").drop("n_chars")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, unnest([n_nationkey * 3 % 25, n_nationkey + 5]) AS b FROM nation WHERE n_nationkey % 6 > 0), r AS (SELECT 4 AS node UNION SELECT b::INT FROM e JOIN r ON a = node WHERE b < 25) SELECT 'c' || node || '.js' AS chunk FROM r")
def import_reach(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    text = F.when(k % 6 > 0, F.concat(F.lit("import{a}from\"./c"), (k * 3 % 25).cast("string"), F.lit(".js\";import './c"), (k + 5).cast("string"), F.lit(".js';let x=1"))).otherwise("let from=1")
    chunks = n.select(F.concat(F.lit("c"), k.cast("string"), F.lit(".js")).alias("name"), text.alias("text"))
    edges = R.imports(chunks, "name", "text").join(chunks.select(F.col("name").alias("dst")), "dst", "left_semi")
    return R.reachable(edges, chunks.where("name = 'c4.js'").select(F.col("name").alias("node"))).select(F.col("node").alias("chunk"))


@query("SELECT lang, ('0x' || h[i:i+1])::INT AS symbol, count(*) AS n FROM (SELECT lang, hex(encode(text)) AS h, unnest(range(1, length(hex(encode(text))), 2)) AS i FROM documents WHERE text IS NOT NULL) GROUP BY lang, symbol")
def symbol_counts(spark, d):
    return Pic.symbol_counts(table(spark, d, "documents"), "lang", "text")


@query(f"""WITH {PIXELS}, m0 AS (SELECT vec_id, y, x, v / 2 + 0.5 AS g, v, v * (v / 2 + 0.5) AS gv, (v / 2 + 0.5) * (v / 2 + 0.5) AS gg FROM p),
m1 AS (SELECT vec_id, y, x, g, avg(g) OVER h AS mg, avg(v) OVER h AS mv, avg(gv) OVER h AS mgv, avg(gg) OVER h AS mgg FROM m0 WINDOW h AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m2 AS (SELECT vec_id, y, x, g, avg(mg) OVER w AS mg, avg(mv) OVER w AS mv, avg(mgv) OVER w AS mgv, avg(mgg) OVER w AS mgg FROM m1 WINDOW w AS (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
a0 AS (SELECT vec_id, y, x, g, (mgv - mg * mv) / (mgg - mg * mg + 5e-4) AS a, mg, mv FROM m2), a1 AS (SELECT vec_id, y, x, g, a, mv - a * mg AS b FROM a0),
b1 AS (SELECT vec_id, y, x, g, avg(a) OVER h AS a, avg(b) OVER h AS b FROM a1 WINDOW h AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b2 AS (SELECT vec_id, y, x, g, avg(a) OVER w AS a, avg(b) OVER w AS b FROM b1 WINDOW w AS (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT vec_id, y, x, round(a * g + b, 5) + 0 AS q FROM b2""")
def guided_filter(spark, d):
    image = R.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8).withColumn("guide", F.col("v") / 2 + 0.5)
    return R.guided_filter(image, "vec_id", 2, 5e-4).withColumn("q", F.round("q", 5) + 0.0)
