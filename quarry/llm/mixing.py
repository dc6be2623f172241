"""Operator 6: mixing sources to target weights over time. Each source's weight schedule is integrated to its cumulative token demand; the demand is inverted to give every taken copy of a document its training position, and the copies are range-sorted by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import cut

# Fixed values of the contract: weights by rank of source, repeating, and the largest repetition.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
WORD = r"[^\x20\x09-\x0D]+"
#: First digits of a row's hash that name its slice, so that running sums need no task with a whole source: 16 to this power slices a source.
SLICE = 3
#: How the weights move over the run: by rank, the factor on a source's mean rate at the start and at the end; factors are linear in schedule time between.
DRIFT = ((1.5, 0.5), (0.75, 1.25), (0.5, 1.5))


def word_count(text: Column) -> Column:
    """Words are runs of anything but the space and the controls from tab to carriage return: one pass makes those spaces, another cuts at single spaces."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """The hash of a row's id and text, which sets the order inside a source."""
    return F.md5(F.concat(F.coalesce(key.cast("long").cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit(""))).cast("binary"))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, order and slice of every row, without texts, written once: all that follows reads this table."""
    key, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    rows = docs.select(key.cast("long").alias("doc_id"), source.cast("string").alias("source"), word_count(text).alias("size"), row_hash(key, text).alias("order"))
    return cut(rows.withColumn("slice", F.substring("order", 1, SLICE)))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, rank, weight, target from source and source_size.

    Sources rank by code point, null last; the weights repeat by rank and share the sum of all sizes; a target stops at `most` times its source's size and the excess is shared again by weight, until none is above. Exact: as the level of words a unit of weight rises, sources reach their caps in the order of cap to weight, so a source is capped if its cap lies under the level that holds when all before it are capped. The windows run over the sources, never over documents. A source without words gets target 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything, before = Window.partitionBy(), rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", left / open_).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # beyond the first source under its cap they fall
    return leveled.withColumn("final", level).select("source", "source_size", "rank", "weight", F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def drifting(rank: Column, ends: tuple[tuple[float, float], ...]) -> tuple[Column, Column]:
    """The rate's factor of a source at the start and at the end, scaled to a mean of 1, so that its demand over the whole run is its target."""
    of = lambda k: F.element_at(F.array(*(F.lit(2 * e[k] / (e[0] + e[1])) for e in ends)), (F.pmod(rank, F.lit(len(ends))) + 1).cast("int"))
    return of(0), of(1)


def integral(time: Column, a: Column, b: Column) -> Column:
    """The demand by this time of a rate that goes from a to b."""
    return time * (a + (b - a) * time / 2)


def inverse(share: Column, a: Column, b: Column) -> Column:
    """The time by which the integral of a rate from a to b, of mean 1, reaches this share; written so that it holds for a rate that doesn't move."""
    return F.least(F.lit(1.0), 2 * share / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) * share, F.lit(0.0)))))


def place(copy: Column) -> tuple[Column, Column]:
    """Schedule time and training position of a document's copy (from 1): its source's stream runs through all its documents once a pass, so the copy starts (copy - 1) * source_size + start words into the stream; the source's demand is inverted at that share of the target; the position is the share of the words of all sources that is demanded by then."""
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), ((copy - 1) * F.col("source_size") + F.col("start")) / F.col("target"))).otherwise(0.0)
    time = inverse(share, F.col("rate_from"), F.col("rate_to"))
    return time, integral(time, F.col("all_from"), F.col("all_to"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, ends: tuple[tuple[float, float], ...] = DRIFT) -> DataFrame:
    """One row per document: doc_id, source, order, size, source_size, target, taken, copies, start, time, position, and the rates of its source and of all.

    Of a source with target t and size s every document is taken floor(t / s) times; the rest of the target goes to the documents in the order of a hash of id and text, each taken once more whose running size starts below the rest, so that the words taken differ from the target by less than one document. No document is taken more than `most` times, since t <= most * s; where t / s is whole nothing is left over. start is the document's running size in its source. A source's demand by schedule time T is its target times the integral of its rate to T; time and position are those of the first copy, see place(); the others come from schedule(). A document that isn't taken has no time and position. Documents without words, and null texts, have size 0 and take 0; null sources are one source; a null id stays; repeated rows are dealt with one by one, in any order among equals, as their sizes are equal; an empty table gives none. Other columns are not read.

    Texts are read once. Running sums come from hash slices of each source: a sum by slice, a window over a source's slices (a few thousand rows at most) and a window inside a slice. No task holds a source.
    """
    rows = sizes(docs, id_col, text_col, source_col)
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = by_slice.withColumn("before", F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size"))
    goal = targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most)
    a, b = drifting(F.col("rank"), ends)
    goal = goal.withColumn("rate_from", a).withColumn("rate_to", b)
    mean = lambda c: F.coalesce(F.sum(F.col("target") * F.col(c)).over(Window.partitionBy()) / F.sum("target").over(Window.partitionBy()), F.lit(1.0))
    goal = goal.withColumn("all_from", mean("rate_from")).withColumn("all_to", mean("rate_to"))
    named = goal.select(F.col("source").alias("of"), "source_size", "target", "rate_from", "rate_to", "all_from", "all_to")
    known = before.join(named, before["source"].eqNullSafe(named["of"])).select("of", F.col("slice").alias("part"), "before", "source_size", "target", "rate_from", "rate_to", "all_from", "all_to")
    inside = Window.partitionBy("source", "slice").orderBy("order", "doc_id")
    summed = rows.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    joined = summed.join(known, summed["source"].eqNullSafe(known["of"]) & (summed["slice"] == known["part"])).withColumn("start", F.col("before") + F.col("within"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    copies = F.when(F.col("size") == 0, 0).otherwise(passes + (F.col("start") + 0.5 < rest).cast("long"))
    time, position = place(F.lit(1))
    taken = F.col("copies") > 0
    return joined.withColumn("copies", copies.cast("long")).select("doc_id", "source", "order", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "start", F.when(taken, time).alias("time"), F.when(taken, position).alias("position"), "rate_from", "rate_to", "all_from", "all_to")


def schedule(planned: DataFrame) -> DataFrame:
    """The training order of a plan's rows, which may carry more columns: one row per taken copy, numbered from 1, with its own time and position, range-sorted by position."""
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    rows = planned.where("copies > 0").drop("time", "position").select("*", copy)
    time, position = place(F.col("copy"))
    return rows.withColumn("time", time).withColumn("position", position).orderBy("position", "source", "doc_id", "copy")


def ordered(planned: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the position of its first copy; documents that are not taken come last."""
    return planned.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id"))
