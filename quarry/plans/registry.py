"""Queries and their SQL, by name. Where the tables hold no files, names, sizes and pages are made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import planning as P, scalars as S
from quarry.operators import packages as Pack, pictures as Pic, relational as R
from quarry.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def pick(key: str, values: tuple, step: int = 1):
    """One of the values by a key's digit."""
    return F.get(F.array(*map(F.lit, values)), (F.floor(F.col(key) / step) % len(values)).cast("int"))


def chosen(key: str, values: tuple, step: int = 1) -> str:
    """The same in SQL."""
    said = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
    return f"([{said}])[({key} // {step}) % {len(values)} + 1]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY strlen(text), sha256(text)) AS keep_id, CAST(strlen(text) AS BIGINT) AS bytes, doc_id <> min(doc_id) OVER (PARTITION BY strlen(text), sha256(text)) AS is_alias FROM documents WHERE strlen(text) >= 512")
def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_duplicates(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""WITH steps AS (SELECT list(step ORDER BY n) AS steps FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS step FROM (SELECT unnest(range(256)) AS n))),
raw AS (SELECT doc_id, text IS NULL AS none, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents)
SELECT doc_id, CASE WHEN NOT none THEN xor(list_reduce(list_concat([4294967295], bytes), lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1])), 4294967295) END AS crc32 FROM raw, steps""")
def crc32_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.crc32("text").alias("crc32"))


HEADS = ("FFD8FFE0", "89504E470D0A1A0A", "52494646000000005745425020", "47494638", "5249464600000000574156452020", "4F676753", "664C6143", "494433", "000000206674797061766966", "000000206674797069736F6D", "1A45DFA3", "255044462D", "504B0304", "")


@query("""SELECT doc_id, CASE doc_id % 14 WHEN 4 THEN 'audio' WHEN 5 THEN 'audio' WHEN 6 THEN 'audio' WHEN 7 THEN 'audio' WHEN 9 THEN 'video' WHEN 10 THEN 'video' WHEN 11 THEN 'pdf' WHEN 12 THEN 'zip' WHEN 13 THEN 'other' ELSE 'image' END AS kind,
CASE doc_id % 14 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'gif' WHEN 4 THEN 'wav' WHEN 5 THEN 'ogg' WHEN 6 THEN 'flac' WHEN 7 THEN 'mp3' WHEN 8 THEN 'avif' WHEN 9 THEN 'mp4' WHEN 10 THEN 'mkv' WHEN 11 THEN 'pdf' WHEN 12 THEN 'zip' ELSE '' END AS format FROM documents""")
def sniff_kind(spark, d):
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 14 + 1).cast("int")))
    kind, fmt = S.sniff("content")
    return table(spark, d, "documents").select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content")).select("doc_id", kind.alias("kind"), fmt.alias("format"))


EXTENSIONS = ("jpg", "PDF", "pptx", "ods", "docm", "mkv", "opus", "zip", "txt", "tar.gz")
NAME_SQL = "'f' || p_partkey || CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '.{e}'" for k, e in enumerate(EXTENSIONS)) + " END"


def part_names(spark, d):
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, d, "part").withColumn("name", F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("."), ext))


@query("SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'presentation' WHEN 3 THEN 'spreadsheet' WHEN 4 THEN 'document' WHEN 5 THEN 'video' WHEN 6 THEN 'audio' WHEN 7 THEN 'archive' ELSE 'other' END AS category FROM part")
def category_of(spark, d):
    return part_names(spark, d).select("p_partkey", S.category(F.col("name")).alias("category"))


@query(r"SELECT page_id, left(CASE WHEN s = '' THEN 'file' ELSE s END, 200) AS safe FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(CASE page_id % 4 WHEN 0 THEN repeat(url, 6) WHEN 1 THEN '. . ' WHEN 2 THEN '..e' || chr(769) || url || chr(8238) ELSE chr(160) || url || 'e' || chr(769) END || chr(9) || ' '), '[\x00-\x1F\x7F\x{200E}\x{200F}\x{202A}-\x{202E}]', '', 'g'), '[\\/:*?\"<>|]', '_', 'g'), '^[.\s\x{00A0}]+', ''), '[\s\x{00A0}]+$', '') AS s FROM pages)")
def safe_name(spark, d):
    k = F.col("page_id") % 4
    given = F.when(k == 0, F.repeat("url", F.lit(6))).when(k == 1, ". . ").when(k == 2, F.concat(F.lit("..e\u0301"), "url", F.lit("\u202e"))).otherwise(F.concat(F.lit("\u00a0"), "url", F.lit("e\u0301")))
    return table(spark, d, "pages").select("page_id", S.safe_name(F.concat(given, F.lit("\t "))).alias("safe"))


HEADS_OF_NAMES = ("", "/", "a/", "a\\", "../", "x/../", "b:", "\x01")
BODIES_OF_NAMES = ("con", "NUL", "com1", "com\u00b2", "LPT0", "conin$", "console", "plain", ".", "..", "lpt")
TAILS_OF_NAMES = ("", ".txt", ".", " ", "/", "\x7f", "\\y")


@query(f"""WITH s AS (SELECT p_partkey, {chosen('p_partkey', HEADS_OF_NAMES)} || {chosen('p_partkey', BODIES_OF_NAMES, 8)} || {chosen('p_partkey', TAILS_OF_NAMES, 88)} AS n FROM part)
SELECT p_partkey, regexp_matches(n, '^[\\\\/]') OR regexp_matches(n, '[\\x00-\\x1F:]') OR len(list_filter(string_split_regex(regexp_replace(n, '[\\\\/]$', ''), '[\\\\/]'), lambda p: p = '..' OR regexp_matches(string_split(lower(p), '.')[1], '^(con|prn|aux|nul|conin\\$|conout\\$|com[0-9\u00b9\u00b2\u00b3]|lpt[0-9\u00b9\u00b2\u00b3])$') OR p <> '.' AND (ends_with(p, '.') OR ends_with(p, ' ')))) > 0 AS unsafe FROM s""")
def unsafe_name(spark, d):
    made = F.concat(pick("p_partkey", HEADS_OF_NAMES), pick("p_partkey", BODIES_OF_NAMES, 8), pick("p_partkey", TAILS_OF_NAMES, 88))
    return table(spark, d, "part").select("p_partkey", S.unsafe_name(made).alias("unsafe"))


@query("WITH s AS (SELECT p_partkey, p_size, lower(nfc_normalize(replace(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'e' || chr(769) || '/' || p_name ELSE chr(233) || chr(92) || p_name END, chr(92), '/'))) AS k FROM part) SELECT p_partkey, count(*) OVER (PARTITION BY p_size, k) > 1 AS twin FROM s")
def name_twins(spark, d):
    k = F.col("p_partkey") % 3
    odd = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("e\u0301/"), "p_name")).otherwise(F.concat(F.lit("\u00e9\\"), "p_name"))
    return R.twins(table(spark, d, "part").select("p_partkey", "p_size", odd.alias("name")), "p_size", "name").select("p_partkey", "twin")


VERSIONS = ("1", "2-rc1", "x", "10", "", "02", "-3")


def numbers_sql(text: str) -> str:
    return f"list_resize(list_transform(string_split({text}, '.')[1:3], lambda p: coalesce(try_cast(regexp_extract(p, '^\\s*([+-]?[0-9]+)', 1) AS DOUBLE), 0)), 3, 0)"


@query(f"""WITH s AS (SELECT o_orderkey, {chosen('o_orderkey', VERSIONS)} || '.' || {chosen('o_orderkey', VERSIONS, 7)} AS a, {chosen('o_orderkey', VERSIONS, 3)} || '.' || {chosen('o_orderkey', VERSIONS, 11)} || '.' || {chosen('o_orderkey', VERSIONS, 2)} || '.9' AS b FROM orders)
SELECT o_orderkey, {numbers_sql('a')} > {numbers_sql('b')} AS is_newer FROM s""")
def version_newer(spark, d):
    dots = lambda *steps: F.concat_ws(".", *(pick("o_orderkey", VERSIONS, k) for k in steps))
    return table(spark, d, "orders").select("o_orderkey", S.newer(dots(1, 7), F.concat(dots(3, 11, 2), F.lit(".9"))).alias("is_newer"))


KINDS_OF_FILES = ("image", "image", "image", "pdf", "zip", "video", "audio", "other")
FORMATS_OF_FILES = ("jpeg", "png", "webp", "pdf", "zip", "mp4", "wav", "")


@query(f"""WITH s AS (SELECT p_partkey, {chosen('p_partkey', ('compress', 'convert', 'removebg'), 8)} AS task, {chosen('p_partkey', KINDS_OF_FILES)} AS kind, {chosen('p_partkey', FORMATS_OF_FILES)} AS f, p_partkey * 100000.0::DOUBLE AS n, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 8 < 2 THEN p_size * 100.0 * 200 END AS a FROM part)
SELECT p_partkey, task, CAST(CASE task WHEN 'removebg' THEN 1073741824 + coalesce(a * 12, n * 8) WHEN 'convert' THEN CASE WHEN kind IN ('video', 'audio') THEN 536870912 WHEN kind = 'pdf' THEN n * 3 + 268435456 ELSE coalesce(a * 12 + n * 2, greatest(268435456, n * 20)) END
ELSE CASE WHEN f IN ('jpeg', 'png') THEN coalesce(a * 16 + n * 2, 1e300) WHEN kind = 'pdf' THEN n * 4 WHEN kind = 'zip' THEN least(n, 134217728) * 3 WHEN kind = 'video' THEN 536870912 ELSE n * 2 END END AS DOUBLE) AS cost FROM s""")
def memory_cost(spark, d):
    task = pick("p_partkey", ("compress", "convert", "removebg"), 8)
    width = F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 100)
    cost = S.memory_cost(task, pick("p_partkey", KINDS_OF_FILES), pick("p_partkey", FORMATS_OF_FILES), F.col("p_partkey") * 100000.0, width, F.lit(200))
    return table(spark, d, "part").select("p_partkey", task.alias("task"), F.least(cost, F.lit(1e300)).alias("cost"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey * pow(10, o_orderkey % 14)::BIGINT AS n FROM orders), t AS (SELECT *, CASE WHEN n >= 1e12 THEN 4 WHEN n >= 1e9 THEN 3 WHEN n >= 1e6 THEN 2 WHEN n >= 1000 THEN 1 ELSE 0 END AS i FROM s), u AS (SELECT *, n / pow(1000.0, i) AS v FROM t)
SELECT o_orderkey, CASE WHEN i = 0 OR v >= 100 THEN format('{:,}', floor(v + 0.5)::BIGINT) ELSE printf('%.1f', floor(v * 10 + 0.5) / 10) END || (['' , 'K', 'M', 'G', 'T'])[i + 1] || 'B' AS shown FROM u""".replace("|| (['' ,", "|| ' ' || (['',"))
def size_format(spark, d):
    n = F.col("o_orderkey").cast("decimal(20,0)") * F.pow(F.lit(10), F.col("o_orderkey") % 14).cast("decimal(18,0)")  # exact; a long would overflow from key 922337 on
    return table(spark, d, "orders").select("o_orderkey", S.human_bytes(n).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 1000 * (1 - l_discount) <= l_quantity * 1000 * 0.99 THEN 'optimized' ELSE 'already-optimal' END AS outcome FROM lineitem")
def keep_if_smaller(spark, d):
    size = F.col("l_quantity") * 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(size * (1 - F.col("l_discount")) <= size * 0.99, "optimized").otherwise("already-optimal").alias("outcome"))


@query("SELECT doc_id, source, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def running_offset(spark, d):
    return R.running_offset(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars")


@query("""WITH f AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS cost, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS total FROM documents),
s AS (SELECT lang, min(place) AS stop FROM f WHERE place > 1 AND total > 5000 GROUP BY lang) SELECT doc_id, f.lang, CAST(place AS INT) AS place FROM f LEFT JOIN s ON f.lang = s.lang WHERE place <= 4 AND (stop IS NULL OR place < stop)""")
def admission_step(spark, d):
    return R.admission(table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("cost")), "lang", "doc_id", "cost", 4, 5000.0).select("doc_id", "lang", "place")


@query("SELECT conv_id, turn, CAST(turn // 2 + 1 AS INT) AS part, lpad(CAST(turn // 2 + 1 AS VARCHAR), CAST(greatest(2, length(CAST(max(turn) OVER (PARTITION BY conv_id) // 2 + 1 AS VARCHAR))) AS INT), '0') AS suffix FROM conversations")
def split_pages(spark, d):
    return R.split_pages(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2)


@query("SELECT conv_id, CAST(m.n - turn AS BIGINT) AS pos, turn AS index, CAST((((turn * 90 + 360) % 360)) AS INT) AS rotate, role FROM conversations JOIN (SELECT conv_id AS c, max(turn) AS n FROM conversations GROUP BY conv_id) m ON conv_id = c")
def organise_pages(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", "turn", "role")
    last = pages.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("n"))
    spec = pages.join(last, F.col("conv_id") == F.col("c")).select("conv_id", (F.col("n") - F.col("turn")).alias("pos"), F.col("turn").alias("index"), S.quarter_turn(F.col("turn") * 90 + 360).alias("rotate"))
    return R.organise(pages, spec, "conv_id", "turn")


@query("SELECT p_partkey, round(w * least(0.75, 14400 / greatest(w, h)), 6) AS width, round(h * least(0.75, 14400 / greatest(w, h)), 6) AS height, CAST(greatest(1, floor(w * least(1, 1000 / greatest(w, h)) + 0.5)) AS BIGINT) AS small FROM (SELECT p_partkey, p_size * 500.0 AS w, p_retailprice AS h FROM part)")
def page_size(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 500.0).alias("w"), F.col("p_retailprice").alias("h"))
    most = F.greatest("w", "h")
    scale = F.least(F.lit(0.75), 14400 / most)
    return rows.select("p_partkey", F.round(F.col("w") * scale, 6).alias("width"), F.round(F.col("h") * scale, 6).alias("height"), F.greatest(F.lit(1), S.half_up(F.col("w") * F.least(F.lit(1.0), 1000 / most))).cast("long").alias("small"))


@query("SELECT vec_id, round(min(v), 5) AS lowest, round(max(v), 5) AS highest, round((avg(v) - min(v)) / (max(v) - min(v)), 5) AS coverage FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY vec_id")
def mask_normalise(spark, d):
    found = R.normalise(R.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8), "vec_id")
    return found.select("vec_id", *(F.round(c, 5).alias(c) for c in ("lowest", "highest", "coverage")))


PIXELS = "p AS (SELECT vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) AS g(i))"


@query(f"WITH {PIXELS}, r AS (SELECT vec_id, y, x, avg(v) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM p) SELECT vec_id, y, x, round(avg(v) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 5) + 0 AS v FROM r")
def box_mean(spark, d):
    return R.box_mean(R.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8), "vec_id", 1).withColumn("v", F.round("v", 5) + 0.0)


@query("SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'POST not permitted' WHEN page_id % 5 = 3 THEN 'query strings not permitted' WHEN page_id % 5 = 2 THEN 'not an application file' WHEN page_id % 5 = 1 THEN 'cross-origin' END AS refused FROM pages")
def egress_policy(spark, d):
    k = F.col("page_id") % 5
    url = F.concat(F.when(k == 1, "https://other.example").otherwise("https://app.example"), F.lit("/a/"), F.col("page_id").cast("string"), F.when(k == 2, ".pdf").otherwise(".js"), F.when(k == 3, "?d=1").otherwise(""))
    return table(spark, d, "pages").select("page_id", S.egress(url, F.when(k == 4, "POST").otherwise("GET"), F.lit("https://app.example")).alias("refused"))


@query("SELECT event_type AS scope, user_id % 7 = 0 AS blocked, count(*) AS requests FROM events GROUP BY 1, 2")
def net_log_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("scope"), (F.col("user_id") % 7 == 0).alias("blocked")).agg(F.count("*").alias("requests"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'mismatch' END AS problem FROM documents WHERE doc_id % 10 < 2")
def manifest_check(spark, d):
    served = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    manifest = served.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 10 == 1, "0").otherwise(F.col("sha")).alias("want"))
    return served.join(manifest, served["doc_id"] == manifest["path"], "left").select("doc_id", F.when(F.col("want").isNull(), "missing").when(F.col("want") != F.col("sha"), "mismatch").alias("problem")).where("problem is not null")


@query("SELECT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def dangling_refs(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return R.dangling(refs, table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("name")))


@query("SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN 'name' ELSE 'content' END AS problem FROM documents WHERE doc_id % 50 = 0 AND doc_id % 150 <> 50")
def verify_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("name"), F.crc32("text").alias("crc"), F.col("n_chars").alias("size"))
    after = docs.select("idx", F.when(F.col("idx") % 100 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"), (F.col("crc") + (F.col("idx") % 50 == 0).cast("long")).alias("crc"), "size")
    found = R.verify(docs, after, docs.where("idx % 150 = 50").select("idx"))
    return found.where("NOT (idx % 150 = 50)").select(F.col("idx").alias("doc_id"), "problem")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation), r AS (SELECT 7 AS node UNION SELECT CAST(dst AS INT) FROM e JOIN r ON src = node) SELECT DISTINCT CAST(node AS INT) AS node FROM r")
def reachable(spark, d):
    n = table(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("dst")).union(n.select("n_nationkey", "n_regionkey"))
    return R.reachable(edges, n.where("n_nationkey = 7").select(F.col("n_nationkey").alias("node")))


@query("SELECT l_orderkey, min(CAST(l_quantity AS BIGINT)) AS size, CAST(min(l_linenumber) FILTER (WHERE l_quantity = m) AS INT) AS rank FROM lineitem JOIN (SELECT l_orderkey AS k, min(l_quantity) AS m FROM lineitem GROUP BY 1) ON l_orderkey = k GROUP BY l_orderkey")
def argmin_candidate(spark, d):
    return R.smallest(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), "l_orderkey", "q", "l_linenumber")


JSON_TASKS, JSON_FLAGS = ('"convert"', '"upload"', "1", "null", '"pdf"', "[]"), ("true", "false", '"true"', "1", "null")
JSON_SHELLS = ("{%s}", '{"note":{"allowMacros":true,"stripMetadata":true},%s}', "[%s]", "{%s", '{"mode":"compact","imageTarget":"webp","mediaTarget":"constructor",%s}')


@query(f"""WITH s AS (SELECT event_id, replace({chosen('event_id', JSON_SHELLS)}, '%s', '"task":' || {chosen('event_id', JSON_TASKS, 5)} || ',"allowMacros":' || {chosen('event_id', JSON_FLAGS, 30)} || ', "stripMetadata" : ' || {chosen('event_id', JSON_FLAGS, 150)}) AS t FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(t) AND json_type(t::JSON) = 'OBJECT' THEN t::JSON END AS j FROM s)
SELECT event_id, CASE WHEN json_type(j, '$.task') = 'VARCHAR' AND json_extract_string(j, '$.task') IN ('compress', 'convert', 'removebg', 'pdf') THEN json_extract_string(j, '$.task') ELSE 'compress' END AS task, CASE WHEN json_extract_string(j, '$.mode') IN ('balanced', 'compact') THEN json_extract_string(j, '$.mode') ELSE 'lossless' END AS mode,
CASE WHEN json_extract_string(j, '$.imageTarget') IN ('png', 'webp', 'pdf') THEN json_extract_string(j, '$.imageTarget') ELSE 'jpg' END AS "imageTarget", 'mp4' AS "mediaTarget", coalesce(json_type(j, '$.stripMetadata') = 'BOOLEAN' AND json_extract_string(j, '$.stripMetadata') = 'true', false) AS "stripMetadata", coalesce(json_type(j, '$.allowMacros') = 'BOOLEAN' AND json_extract_string(j, '$.allowMacros') = 'true', false) AS "allowMacros" FROM j""")
def settings_sanitise(spark, d):
    inner = F.concat(F.lit('"task":'), pick("event_id", JSON_TASKS, 5), F.lit(',"allowMacros":'), pick("event_id", JSON_FLAGS, 30), F.lit(', "stripMetadata" : '), pick("event_id", JSON_FLAGS, 150))
    made = F.replace(pick("event_id", JSON_SHELLS), F.lit("%s"), inner)
    return table(spark, d, "events").select("event_id", made.alias("t")).select("event_id", *S.sanitise(F.col("t")))


@query("SELECT conv_id, CAST(turn AS INT) AS page, CASE WHEN turn <= least(1, n - 1) THEN 1 ELSE 2 END AS grp FROM conversations JOIN (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = c WHERE turn < 2 OR (turn = n - 1 AND n > 2)")
def page_ranges(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    text = F.when(F.col("n") > 2, F.concat(F.lit("1-2; "), F.col("n").cast("string"), F.lit("-"))).when(F.col("n") == 2, "1-2").otherwise("1")
    groups = n.select("conv_id", F.posexplode(S.page_ranges(text, F.col("n"))).alias("g", "pages"))
    return groups.select("conv_id", F.explode("pages").alias("page"), (F.col("g") + 1).alias("grp"))


@query("SELECT doc_id, quality = 1 AND toxic = 0 AS passed FROM labels")
def checks_pass(spark, d):
    checks = F.array(F.struct(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("ok")), F.struct(F.lit("clean").alias("label"), (F.col("toxic") == 0).alias("ok")))
    return table(spark, d, "labels").select("doc_id", F.forall(checks, lambda c: c["ok"]).alias("passed"))


@query("SELECT p_partkey, round((0.299 * (p_size % 256) + 0.587 * (p_partkey % 256) + 0.114 * ((p_size * 7) % 256)) / 255, 6) AS luma FROM part")
def luma(spark, d):
    r, g, b = F.col("p_size") % 256, F.col("p_partkey") % 256, (F.col("p_size") * 7) % 256
    return table(spark, d, "part").select("p_partkey", F.round((0.299 * r + 0.587 * g + 0.114 * b) / 255, 6).alias("luma"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'png,webp,pdf' WHEN 1 THEN 'jpg,png,webp,pdf' WHEN 2 THEN 'jpg,png,webp' WHEN 3 THEN 'webm,m4a,wav' WHEN 4 THEN 'm4a,wav,webm' ELSE '' END AS targets FROM part")
def conversion_targets(spark, d):
    name = F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ("JFIF", "heic", "pdf", "mp4", "flac", "txt"))), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", F.array_join(P.targets(name), ",").alias("targets"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'file' ELSE 'a.' || p_partkey END || CASE p_partkey % 3 WHEN 0 THEN '.compressed' WHEN 1 THEN '.nobg' ELSE '' END || '.png' AS name FROM part")
def output_name(spark, d):
    given = F.when(F.col("p_partkey") % 4 == 3, "...").otherwise(F.concat(F.lit("..a."), F.col("p_partkey").cast("string"), F.lit(".jpg ")))
    task = F.when(F.col("p_partkey") % 3 == 0, "compress").when(F.col("p_partkey") % 3 == 1, "removebg").otherwise("convert")
    return table(spark, d, "part").select("p_partkey", P.output_name(given, task, F.lit("png")).alias("name"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'compact' ELSE 'lossless' END AS mode, p_size * 170 AS w, CAST(p_partkey % 4300 + 50 AS INT) AS h, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 90 / 1.5 END AS rate, p_retailprice * 10000 AS bits FROM part),
t AS (SELECT *, CASE WHEN mode = 'lossless' THEN 'video-lossless' WHEN CAST(w AS DOUBLE) * h > 33177600 THEN 'too-large' END AS reason, least(60, greatest(1, floor(coalesce(nullif(rate, 0), 30) + 0.5))) AS f, least(1.0::DOUBLE, CASE mode WHEN 'balanced' THEN 1080::DOUBLE ELSE 720::DOUBLE END / least(w, h)) AS k, CASE mode WHEN 'balanced' THEN 0.06::DOUBLE ELSE 0.035::DOUBLE END AS bpp FROM s),
u AS (SELECT *, greatest(2, floor(w * k / 2 + 0.5) * 2) AS ew, greatest(2, floor(h * k / 2 + 0.5) * 2) AS eh FROM t)
SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN CAST(ew AS BIGINT) ELSE 0 END AS width, CASE WHEN reason IS NULL THEN CAST(eh AS BIGINT) ELSE 0 END AS height, CASE WHEN reason IS NULL THEN CAST(f AS BIGINT) ELSE 0 END AS fps, CASE WHEN reason IS NULL THEN CAST(greatest(250000, least(floor(ew * eh * f * bpp + 0.5), floor(bits * 0.85::DOUBLE + 0.5))) AS BIGINT) ELSE 0 END AS bitrate, p_partkey % 2 = 0 AND p_partkey % 200 * 1000 <= CASE mode WHEN 'balanced' THEN 160000 ELSE 120000 END AS keeps_audio FROM u""")
def video_plan(spark, d):
    k = F.col("p_partkey")
    mode = F.when(k % 3 == 0, "balanced").when(k % 3 == 1, "compact").otherwise("lossless")
    rows = table(spark, d, "part").select(k, mode.alias("mode"), (F.col("p_size") * 170).alias("w"), (k % 4300 + 50).cast("int").alias("h"), F.when(k % 5 > 0, k % 90 / 1.5).alias("rate"), (F.col("p_retailprice") * 10000).alias("bits"))
    audio = P.keeps_audio(F.col("mode"), F.when(k % 2 == 0, "aac").otherwise("mp3"), k % 200 * 1000)
    return rows.select("p_partkey", *P.video_plan(*map(F.col, ("mode", "w", "h", "rate", "bits"))), audio.alias("keeps_audio")).fillna(0)


@query("""WITH s AS (SELECT p_partkey, p_size * 30.0::DOUBLE AS w, p_retailprice AS h, CAST(p_partkey % 40 AS DOUBLE) / 2 AS u FROM part),
t AS (SELECT *, least(48::DOUBLE, sqrt(w * w + h * h) * 0.8::DOUBLE / greatest(1, u)) AS s, atan2(h, w) AS a FROM s)
SELECT p_partkey, round(s, 4) AS size, round(w / 2 - u * s / 2 * cos(a) + s / 3 * sin(a), 4) AS x, round(h / 2 - u * s / 2 * sin(a) - s / 3 * cos(a), 4) AS y, round(degrees(a), 4) AS angle, 0.9::DOUBLE AS alpha, round(least(150::DOUBLE / 72, 6000 / greatest(w, h), sqrt(36e6 / (w * h))), 6) AS scale FROM t""")
def watermark_place(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 30.0).alias("w"), F.col("p_retailprice").alias("h"), ((F.col("p_partkey") % 40) / 2).alias("u"))
    w, h = F.col("w"), F.col("h")
    found = rows.select("p_partkey", *P.watermark(w, h, F.col("u"), F.lit(48.0), F.lit(2.0)), P.render_scale(w, h).alias("scale"))
    return found.select("p_partkey", *(F.round(c, 4).alias(c) for c in ("size", "x", "y", "angle")), "alpha", F.round("scale", 6).alias("scale"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'it''s a \"page\"' WHEN 1 THEN 'x ? y' END AS label FROM pages")
def watermark_text(spark, d):
    text = F.when(F.col("page_id") % 3 == 0, " it’s \t a “page” ").when(F.col("page_id") % 3 == 1, "x\n字 y").otherwise("  ")
    return table(spark, d, "pages").select("page_id", P.watermark_label(text).alias("label"))


@query("SELECT p_partkey, k AS point, round(p_size * CAST(k AS DOUBLE) / n, 5) AS x, round(30.0::DOUBLE * k / n, 5) AS y FROM (SELECT p_partkey, p_size, CAST(greatest(1, ceil(sqrt(CAST(p_size AS DOUBLE) * p_size + 900) / 4)) AS INT) AS n FROM part), LATERAL (SELECT CAST(unnest(range(1, n + 1)) AS INT) AS k)")
def brush_dabs(spark, d):
    points = P.dabs(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(30.0), F.lit(16.0))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(points).alias("k", "p"))
    return rows.select("p_partkey", (F.col("k") + 1).alias("point"), F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


PARTS = ("[Content_Types].xml", "ppt/presentation.xml", "xl/workbook.xml", "word/document.xml", "xl/vbaProject.bin", "XL/VBAPROJECT.BIN", "xvbaProject.bin", "a.txt")


@query(f"""WITH n AS (SELECT unnest([{', '.join(f"'{p}'" for p in PARTS)}]) AS name, unnest(range(8)) AS bit), s AS (SELECT s_suppkey, name FROM supplier, n WHERE bit = 7 OR (s_suppkey * 37 // pow(2, bit)::BIGINT) % 2 = 1),
g AS (SELECT s_suppkey, bool_or(name = '[Content_Types].xml') AS typed, bool_or(lower(name) IN ('xl/vbaproject.bin')) AS macro, CASE WHEN bool_or(name LIKE 'ppt/%') THEN 'ppt' WHEN bool_or(name LIKE 'xl/%') THEN 'xls' WHEN bool_or(name LIKE 'word/%') THEN 'doc' END AS base FROM s GROUP BY s_suppkey)
SELECT s_suppkey::BIGINT AS s_suppkey, CASE WHEN typed THEN base || CASE WHEN macro THEN 'm' ELSE 'x' END END AS extension, typed AND base IS NOT NULL AND macro AS macro FROM g""")
def office_kind(spark, d):
    bit = lambda k: F.floor(F.col("s_suppkey") * 37 / 2**k) % 2 == 1
    listed = F.array_compact(F.array(*(F.when(F.lit(k == 7) | bit(k), name) for k, name in enumerate(PARTS))))
    return Pack.office_kind(table(spark, d, "supplier").select("s_suppkey", F.explode(listed).alias("name")), "s_suppkey", "name")


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_suppkey % 5 NOT IN (1, 4) AS resolves, s_suppkey % 5 = 3 AS active_links FROM supplier")
def package_checks(spark, d):
    target = F.element_at(F.array(*map(F.lit, ("../media/a&amp;b%20c.png", "../media/none.png", "/ppt/media/a&amp;b%20c.png", "https://x.example/t", "./../media/a&amp;b%20c.png"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    xml = F.concat(F.lit('<Relationships><Relationship Id="h" Type="t/hyperlink" Target="https://y.example" TargetMode="External"/><Relationship Id="r" Type="t/image" Target="'), target, F.lit('"'), F.when(F.col("s_suppkey") % 5 == 3, ' TargetMode="External"').otherwise(""), F.lit("/></Relationships>"))
    listed = F.array(*(F.struct(F.lit(n).alias("name"), x.alias("xml")) for n, x in (("ppt/slides/_rels/s.xml.rels", xml), ("ppt/media/a&b c.png", F.lit("")))), F.struct(F.when(F.col("s_suppkey") % 5 == 4, "other").otherwise("[Content_Types].xml").alias("name"), F.lit("").alias("xml")))
    parts = table(spark, d, "supplier").select("s_suppkey", F.explode(listed).alias("p")).select("s_suppkey", "p.*")
    return Pack.package_checks(parts, "s_suppkey", "name", "xml")


@query("SELECT page_id, regexp_replace(html, '<title>.*?</title>', '<title></title>', 'gs') AS cleaned FROM pages")
def metadata_clear(spark, d):
    return table(spark, d, "pages").select("page_id", Pack.cleared(F.col("html"), ("title",)).alias("cleaned"))


@query("SELECT p_size, p_partkey, 'n' || p_partkey % 3 || '.txt' AS name, 'n' || p_partkey % 3 || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.txt' AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_partkey % 3 ORDER BY p_partkey) AS k FROM part)")
def unique_names(spark, d):
    files = table(spark, d, "part").select("p_size", "p_partkey", F.concat(F.lit("n"), (F.col("p_partkey") % 3).cast("string"), F.lit(".txt")).alias("name"))
    return Pack.unique_names(files, "p_size", "p_partkey", "name")


@query("SELECT host, count(*) AS texts FROM (SELECT page_id, lower(regexp_extract(url, '://([A-Za-z0-9.-]+)', 1)) AS host FROM pages) WHERE regexp_matches(host, '[^.]') AND NOT starts_with(host, 'a') GROUP BY host")
def unreviewed_hosts(spark, d):
    pages = table(spark, d, "pages")
    reviewed = Pack.hosts(pages, "page_id", "url").where(F.col("host").startswith("a"))
    return Pack.unreviewed(pages, reviewed, "page_id", "url")


def taps_sql(name: str, size: int, count: int) -> str:
    return f"{name} AS (SELECT k, CAST(floor(s) AS INT) + o AS src, CASE o WHEN 0 THEN 1 - (s - floor(s)) ELSE s - floor(s) END AS share FROM (SELECT k, least(greatest((k + 0.5::DOUBLE) * {size} / {count} - 0.5::DOUBLE, 0), {size - 1}) AS s FROM (SELECT unnest(range({count})) AS k)), (VALUES (0), (1)) AS v(o))"


@query(f"WITH {PIXELS}, {taps_sql('tx', 8, 11)}, {taps_sql('ty', 8, 13)} SELECT vec_id, CAST(ty.k AS INT) AS y, CAST(tx.k AS INT) AS x, round(sum(v * tx.share * ty.share), 5) + 0 AS v FROM p JOIN tx ON tx.src = p.x JOIN ty ON ty.src = p.y GROUP BY ALL")
def upsample(spark, d):
    square = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get("embedding", k))  # 8 by 8 whatever the vector, as in SQL
    found = Pic.upsample(R.pixels(table(spark, d, "embeddings").select("vec_id", square.alias("embedding")), "vec_id", "embedding", 8), "vec_id", 11, 13)
    return found.withColumn("v", F.round("v", 5) + 0.0)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_size ELSE 0 END AS width, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_partkey % 60000 + 1 AS INT) ELSE 0 END AS height, CASE WHEN p_partkey % 4 < 2 THEN 3 ELSE 0 END AS components, p_partkey % 4 = 1 AS progressive, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE CAST(p_partkey % 8 + 1 AS INT) END AS orientation, CASE p_partkey % 4 WHEN 2 THEN 'unsupported' WHEN 3 THEN 'unreadable' END AS reason FROM part")
def jpeg_info(spark, d):
    k, short = F.col("p_partkey"), lambda n: F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0"))
    raw = lambda x: F.unhex(F.lit(x))
    exif = F.concat(raw("FFE10022"), raw("457869660000" + "4D4D002A00000008" + "0001" + "0112000300000001"), short(k % 8 + 1), raw("0000" + "00000000"))
    frame = F.concat(F.element_at(F.array(raw("FFC0"), raw("FFC2"), raw("FFC9")), F.least(k % 4 + 1, F.lit(3)).cast("int")), raw("000B08"), short(k % 60000 + 1), short(F.col("p_size")), raw("03010000"))
    content = F.concat(F.when(k % 4 == 3, raw("8950")).otherwise(raw("FFD8")), exif, frame, raw("FFD9"))
    return Pic.jpeg_info(table(spark, d, "part").select("p_partkey", content.alias("content")), "p_partkey", "content").drop("segments").fillna(0).fillna(False)


@query()
def prefix_codes(spark, d):
    counts = Pic.symbol_counts(table(spark, d, "documents"), "lang", "text")
    return Pic.prefix_codes(counts.where("lang is not null"), "lang", "symbol", "n")
