"""Operator 10: line dedup by distinct-site spread. HyperLogLog sketches of the sites of each line hash are merged by aggregation; lines whose estimate is near the threshold get an exact distinct count; lines that stand on enough sites are boilerplate and are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import cut

#: A line on at least so many distinct sites is boilerplate; shorter lines (in characters, trimmed) are left alone.
SITES, SHORTEST = 6, 10
#: log2 of a sketch's registers, and how far an estimate may lie from the threshold before it is trusted without an exact count: several standard errors of the sketch.
LG_K, NEAR = 11, 0.25
#: Up to so many lines that may be boilerplate are told to all tasks; with more, rows of lines are exchanged.
TOLD = 50_000
HASHES = ["h1", "h2"]


def trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  "))


def lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, shortest: int) -> DataFrame:
    """One row per line that is long enough: id, of (the text's hash), site, at, h1, h2. A line is trimmed of spaces and tabs for its hash; a null site is a site of its own."""
    text = F.col(f"`{text_col}`")
    site = F.coalesce(F.concat(F.lit("="), F.col(f"`{site_col}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("of"), site.alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    long = rows.withColumn("line", trimmed(F.col("line"))).where(F.char_length("line") >= shortest)
    return long.select("id", "of", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, shortest: int = SHORTEST) -> DataFrame:
    """id, of, at of every boilerplate line: a line, trimmed, of `shortest` characters or more on `sites` distinct sites or more.

    Null sites are one site; null texts have no lines; lines shorter than `shortest` are never boilerplate. The first aggregation keeps a small sketch for each line hash and task, so a line that a third of all rows hold costs one row a task. Only rows of lines whose estimate may reach the threshold go on; they are found by a broadcast of a checked size, or else by a join that adaptive execution can split, and written once to the checkpoint folder. The exact count deduplicates (line, site) before it counts.
    """
    every = lines(docs, id_col, text_col, site_col, shortest)
    spread = every.groupBy(*HASHES).agg(F.count("*").alias("rows"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).where(F.col("rows") >= sites).select(*HASHES, F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - NEAR))
    spread = cut(spread)  # written, so that both sides of the join are exchanges of their own, which adaptive execution can split
    rows = cut(every.join(F.broadcast(spread) if spread.count() <= TOLD else spread, HASHES))
    few = rows.where(F.col("estimate") <= sites * (1 + NEAR)).select(*HASHES, "site").distinct().groupBy(*HASHES).agg(F.count("*").alias("sites")).where(F.col("sites") < sites).select(*HASHES)
    return rows.select("id", "of", "at", *HASHES).join(few, HASHES, "left_anti").select("id", "of", "at")


def strip_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, shortest: int = SHORTEST, spare: float = 0.0) -> DataFrame:
    """docs with the boilerplate lines taken out of their texts, and n_lines and n_removed (0 for null texts, which stay null). A text whose every line goes becomes empty; its row stays.

    spare: a text of which less than this share of its characters would be left stays whole. By default none does; a pipeline that removes near copies afterwards may ask for it, as the lines of a text with copies on many sites all stand on many sites.

    All columns of docs are kept, but columns named n_lines or n_removed are replaced; other names may be anything. Rows are told apart by id and text: repeated rows are stripped alike, and rows with a null id too. The hits are grouped by document and joined back on the id; a document's hits are as many as its lines at most. An empty table gives none.
    """
    hits = boilerplate_lines(docs, id_col, text_col, site_col, sites, shortest).groupBy("id", "of").agg(F.collect_set("at").alias("hits"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))  # in a struct, no name can clash
    text = F.col("row").getField(text_col)
    # hashing the hits, small beside the texts, saves sorting whole texts
    joined = rows.join(hits.hint("shuffle_hash"), F.col("row").getField(id_col).eqNullSafe(hits["id"]) & (F.xxhash64(text) == hits["of"]), "left")
    parts = F.split(text, "\n", -1)
    kept = F.when(F.col("hits").isNotNull(), F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("hits", i)), "\n"))
    made = joined.select("row", F.coalesce(F.array_size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_size("hits"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
    if spare:
        whole = F.col("kept").isNull() | (F.char_length("kept") < spare * F.char_length(text))
        made = made.select("row", "n_lines", F.when(whole, 0).otherwise(F.col("n_removed")).cast("long").alias("n_removed"), F.when(~whole, F.col("kept")).alias("kept"))
    return made.select(*(F.coalesce("kept", text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names), "n_lines", "n_removed")


SQL = f"""
WITH l AS (SELECT doc_id, text, '=' || source AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(translate(line, chr(9) || chr(13), '  ')) AS k FROM l),
b AS (SELECT k FROM t WHERE length(k) >= {SHORTEST} GROUP BY k HAVING count(DISTINCT coalesce(site, '')) >= {SITES}),
m AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM b)) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM b)), '') AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256 FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
"""
