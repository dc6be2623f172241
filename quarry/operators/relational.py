"""Relational operators: duplicate merging, twins, offsets, page algebra, masks, reachability, admission."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.scalars import nfc


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's folder; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def merge_duplicates(payloads: DataFrame, key: str, content: str, least: int = 512) -> DataFrame:
    """key, keep_id, bytes, is_alias for payloads of at least so many bytes: the smallest key of equal payloads is kept. Only digests are shuffled; a partial minimum makes hot groups one row a task."""
    rows = payloads.select(F.col(key), F.octet_length(content).cast("long").alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha")).where(F.col("bytes") >= least)
    first = rows.groupBy("bytes", "sha").agg(F.min(key).alias("keep_id"))
    return rows.join(first, ["bytes", "sha"]).select(key, "keep_id", "bytes", (F.col(key) != F.col("keep_id")).alias("is_alias"))


def twins(entries: DataFrame, group: str, name: str) -> DataFrame:
    """entries with `twin`: whether another entry of the group has the same name but for case, the kind of slash and the way accents are composed."""
    folded = F.lower(F.regexp_replace(nfc(F.col(name)), r"\\", "/"))
    entries = entries.withColumn("_folded", folded)
    folded = F.col("_folded")
    counts = entries.groupBy(F.col(group).alias("_g"), folded.alias("_n")).agg(F.count("*").alias("_c"))
    return entries.join(counts, entries[group].eqNullSafe(counts["_g"]) & folded.eqNullSafe(counts["_n"])).select(*(entries[c] for c in entries.columns if c != "_folded"), (F.col("_c") > 1).alias("twin"))


def running_offset(entries: DataFrame, group: str, order: str, size: str, slice_of: int = 1 << 16) -> DataFrame:
    """entries with `offset`: the bytes of the group's entries before, in the order of a whole number.

    A group may hold a third of all entries, so sums are made at two levels: entries are dealt by group and run of slice_of order numbers; a window over the runs, one row each, says what lies before a run, another inside a run what lies before an entry.
    """
    runs = entries.withColumn("_run", F.floor(F.col(order) / slice_of))
    totals = runs.groupBy(F.col(group).alias("_g"), F.col("_run").alias("_r")).agg(F.sum(size).alias("_s"))
    ahead = totals.withColumn("_before", F.sum("_s").over(Window.partitionBy("_g").orderBy("_r")) - F.col("_s")).drop("_s")
    inside = Window.partitionBy(group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("_within", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = rows.join(ahead, F.col(group).eqNullSafe(F.col("_g")) & F.col("_run").eqNullSafe(F.col("_r")))
    return joined.select(*(entries[c] for c in entries.columns), (F.col("_before") + F.col("_within")).cast("long").alias("offset"))


def admission(queue: DataFrame, group: str, order: str, cost: str, slots: int, budget: float) -> DataFrame:
    """The entries of each queue that may start together when nothing runs: from the front, at most `slots`, while the costs stay in the budget; the first may exceed it alone. The first entry that doesn't fit, or has no known cost, stops the queue."""
    front = Window.partitionBy(group).orderBy(order)
    rows = queue.withColumn("place", F.row_number().over(front)).where(F.col("place") <= slots)
    total = F.sum(F.coalesce(cost, F.lit(float("inf")))).over(front.rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col(cost).isNotNull() & (F.col(cost) < float("inf")) & ((F.col("place") == 1) | (total <= budget))
    return rows.withColumn("fits", fits).withColumn("admitted", F.min("fits").over(front.rowsBetween(Window.unboundedPreceding, 0))).where("admitted").drop("fits", "admitted")


def split_pages(pages: DataFrame, doc: str, page: str, per: int) -> DataFrame:
    """Pages dealt into files of `per` pages: part (from 1) and the file's name suffix, of at least two digits."""
    part = (F.floor(F.col(page) / per) + 1).cast("int")
    digits = F.greatest(F.lit(2), F.length((F.floor(F.max(page).over(Window.partitionBy(doc)) / per) + 1).cast("string")))
    return pages.withColumn("part", part).withColumn("suffix", F.lpad(F.col("part").cast("string"), digits, "0"))


def organise(pages: DataFrame, spec: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages picked by spec (doc, pos, index, rotate): in the order of pos, repeats allowed."""
    picks = spec.select(F.col(doc).alias("_doc"), "pos", "index", "rotate")
    return picks.join(pages, (F.col("_doc") == F.col(doc)) & (F.col("index") == F.col(page))).drop("_doc", page)


def pixels(images: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """key, y, x, v of row-major images."""
    return images.select(key, F.posexplode(values).alias("i", "v")).select(key, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def box_mean(image: DataFrame, key: str, radius: int, value: str = "v") -> DataFrame:
    """The mean over a square window, clipped at the edges: along rows, then along columns; O(1) a pixel from differences of running sums."""
    out = image
    for along, across in (("x", "y"), ("y", "x")):
        line = Window.partitionBy(key, across).orderBy(along).rowsBetween(-radius, radius)
        out = out.withColumn(value, F.avg(value).over(line))
    return out


def guided_filter(image: DataFrame, key: str, radius: int, eps: float) -> DataFrame:
    """q of columns guide and v: the guided image filter of He, Sun and Tang from six box means."""
    rows = image.withColumns({"m_g": F.col("guide"), "m_v": F.col("v"), "m_gg": F.col("guide") * F.col("guide"), "m_gv": F.col("guide") * F.col("v")})
    for name in ("m_g", "m_v", "m_gg", "m_gv"):
        rows = box_mean(rows, key, radius, name)
    a = (F.col("m_gv") - F.col("m_g") * F.col("m_v")) / (F.col("m_gg") - F.col("m_g") * F.col("m_g") + eps)
    rows = rows.withColumn("a", a).withColumn("b", F.col("m_v") - F.col("a") * F.col("m_g"))
    for name in ("a", "b"):
        rows = box_mean(rows, key, radius, name)
    return rows.select(key, "y", "x", (F.col("a") * F.col("guide") + F.col("b")).alias("q"))


def normalise(image: DataFrame, key: str) -> DataFrame:
    """Per image: lowest, highest, and coverage, the mean after stretching to 0 to 1 (a flat image has span 1)."""
    span = F.when(F.max("v") > F.min("v"), F.max("v") - F.min("v")).otherwise(1.0)
    return image.groupBy(key).agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), ((F.avg("v") - F.min("v")) / span).alias("coverage"))


def reachable(edges: DataFrame, roots: DataFrame, rounds: int = 1000) -> DataFrame:
    """Nodes reachable from roots (node) along edges (src, dst), roots included. Cycles are fine: each round keeps only new nodes; visited rows are checkpointed, nothing is collected. Raises if the last of so many rounds still found new nodes."""
    visited = frontier = checkpointed(roots.select("node").distinct())
    for _ in range(rounds):
        frontier = checkpointed(edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = checkpointed(visited.union(frontier))
    else:
        raise RuntimeError("reachable did not settle")
    return visited


def dangling(references: DataFrame, names: DataFrame) -> DataFrame:
    """References (source, target) whose target is not among names (name)."""
    return references.join(names, references["target"] == names["name"], "left_anti")


def verify(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries (idx, name, crc, size) that a rewrite must not have altered and did: index and problem. Content may differ only at the indices in changed (idx)."""
    mark = changed.select("idx").distinct().withColumn("may", F.lit(True))
    both = before.alias("b").join(after.alias("a"), "idx", "full_outer").join(mark, "idx", "left")
    problem = F.when(F.col("b.name").isNull() | F.col("a.name").isNull(), "missing").when(F.col("a.name") != F.col("b.name"), "name").when(F.col("may").isNull() & ((F.col("a.crc") != F.col("b.crc")) | (F.col("a.size") != F.col("b.size"))), "content")
    return both.select("idx", problem.alias("problem")).where("problem is not null")


def smallest(candidates: DataFrame, key: str, size: str, rank: str) -> DataFrame:
    """The smallest candidate of each key; of equals the one of lowest rank."""
    return candidates.groupBy(key).agg(F.min(F.struct(F.col(size).alias("size"), F.col(rank).alias("rank"))).alias("best")).select(key, "best.size", "best.rank")


def flagged(rows: DataFrame, key: str, marks: DataFrame, mark: str, name: str) -> DataFrame:
    """rows with a flag: whether the key is among the marks, such as streams that others use as masks. Null keys are not."""
    known = marks.select(F.col(mark).alias("_mark")).where("_mark is not null").distinct()
    return rows.join(known, F.col(key) == F.col("_mark"), "left").withColumn(name, F.col("_mark").isNotNull()).drop("_mark")


def rewritten(references: DataFrame, column: str, aliases: DataFrame, alias: str, keep: str) -> DataFrame:
    """references with each alias replaced by what is kept for it; other references stay."""
    table = aliases.select(F.col(alias).alias("_alias"), F.col(keep).alias("_keep"))
    return references.join(table, F.col(column) == F.col("_alias"), "left").withColumn(column, F.coalesce("_keep", column)).drop("_alias", "_keep")


def same_arrays(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """key and same: whether both sides hold equal arrays, element by element; a key of one side alone is not the same. Nulls are equal to nulls."""
    left, right = a.select(key, F.struct(values).alias("_a")), b.select(key, F.struct(values).alias("_b"))
    return left.join(right, key, "full_outer").select(key, F.coalesce(F.col("_a") == F.col("_b"), F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))


def ranked(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order, from 1; 0 outside it."""
    return F.array_position(F.array(*map(F.lit, order)), value)


def offered(items: DataFrame, group: str, targets: str, order: tuple[str, ...], least: int = 2) -> DataFrame:
    """group and the union of its items' targets, each once, in a fixed order; groups of fewer than `least` items have no common choice."""
    counts = items.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    found = items.select(group, F.explode(targets).alias("_t")).distinct().join(counts, group)
    placed = found.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(ranked(F.col("_t"), order).alias("place"), F.col("_t").alias("target")))).alias("_all"))
    return placed.select(group, F.col("_all.target").alias("targets"))


def moved(rows: DataFrame, group: str, place: str, source: Column, to: Column) -> DataFrame:
    """rows with places renumbered as if the row at `source` had been taken out and put in at `to` (both from 0); places outside the group, or equal ones, move nothing."""
    count = F.count("*").over(Window.partitionBy(group))
    at = F.col(place)
    valid = (source != to) & (to >= 0) & (to < count) & (source >= 0) & (source < count)
    shifted = F.when(at == source, to).when((at > source) & (at <= to), at - 1).when((at < source) & (at >= to), at + 1).otherwise(at)
    return rows.withColumn(place, F.when(valid, shifted).otherwise(at))


def swapped(rows: DataFrame, group: str, place: str, at: Column, by: Column) -> DataFrame:
    """rows with the neighbours at `at` and `at + by` changed over; outside the group nothing moves."""
    other, count = at + by, F.count("*").over(Window.partitionBy(group))
    here = F.col(place)
    valid = (other >= 0) & (other < count) & (at >= 0) & (at < count)
    return rows.withColumn(place, F.when(valid & (here == at), other).when(valid & (here == other), at).otherwise(here))


def first_rows(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """At most so many rows of each group, the first in the given order. Spark keeps no more than that of a group in a task before it exchanges them."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def merged(pages: DataFrame, files: DataFrame, doc: str, page: str, place: str) -> DataFrame:
    """The pages of several files as one: files in the order of their place, pages in theirs; index counts from 0. Lengths of files are summed over the files, so that no task numbers all pages."""
    counts = pages.groupBy(doc).agg(F.count("*").alias("_n"))
    starts = files.select(doc, place).join(counts, doc).withColumn("_start", F.sum("_n").over(Window.orderBy(place, doc)) - F.col("_n"))
    inside = F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1
    return pages.withColumn("_inside", inside).join(starts.drop("_n"), doc).withColumn("index", (F.col("_start") + F.col("_inside")).cast("long")).drop("_start", "_inside")


def differences(blocks: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """blocks with `difference`: the value less that of the block before in its component; the first is taken from 0."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(*group).orderBy(order))
    return blocks.withColumn("difference", F.col(value) - before)


def unused(rows: DataFrame, key: str, live: DataFrame) -> DataFrame:
    """Rows whose key is not among the live nodes (node): what a sweep deletes."""
    return rows.join(live.select(F.col("node").alias("_node")).distinct(), F.col(key) == F.col("_node"), "left_anti")


def imports(chunks: DataFrame, name: str, text: str) -> DataFrame:
    """src and dst of every static import between text chunks: names in quotes after `from` or `import` that begin with a dot step, without it."""
    found = F.regexp_extract_all(text, F.lit(r"""(?:\bfrom|\bimport)\s*["']\.?/?([^"']+)["']"""), F.lit(1))
    return chunks.select(F.col(name).alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
