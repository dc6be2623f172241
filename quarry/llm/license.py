"""Operator 7: license scans by diagonal voting, with DataFrame functions alone.

All rolling word 3-gram hashes of the documents are joined to the positions that they have in the templates, a small fixed table; hashes that no template has are left out before rows are made of them. A hit votes for its diagonal, document position less template position; votes are summed by diagonal, neighbouring diagonals of a template are merged, and the spans that result are verified: each vote is for equal words, a template position counts once a span and only where it stands behind those before it, and a template counts when enough of its own 3-grams are found so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import UPPER, shuffle_partitions

# The phrases of the contract, and short notices in their usual public wording. Words are lower case, without punctuation.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "all-rights-reserved",
}
K = 3
#: Share of a template's 3-grams that must vote, and how far apart merged diagonals may lie.
COVER, GAP = 0.6, 2
#: What parts words: everything in ASCII but letters and digits.
PARTING = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: one pass makes spaces of all that parts words, another cuts at single spaces; patterns would take several times longer."""
    spaced = F.translate(F.coalesce(text, F.lit("")), PARTING + UPPER, " " * len(PARTING) + UPPER.lower())
    return F.array_remove(F.split(spaced, " ", -1), "")


def gram(array: Column, word: Column, at: Column) -> Column:
    """The hash of the K-gram that begins with the word at this place."""
    return F.xxhash64(word, *(F.get(array, at + k) for k in range(1, K)))


def templates(spark, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per template position: template, label, exact, grams, parts (the K-gram's words), at, hash. Its size is the code's, never the data's."""
    rows = []
    for n, (exact, phrase, label) in enumerate([(True, *x) for x in base.items()] + [(False, *x) for x in notices.items()]):
        parts = phrase.split()
        rows += [(n, label, exact, len(parts) - K + 1, parts[i : i + K], i) for i in range(len(parts) - K + 1)]
    made = spark.createDataFrame(rows, "template int, label string, exact boolean, grams int, parts array<string>, at int")
    return made.withColumn("hash", F.xxhash64(*(F.get("parts", F.lit(k)) for k in range(K))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, over the whole text.

    base: phrases of at least three words that must stand word for word; every place counts. notices: templates of which COVER of the 3-grams must be found along neighbouring diagonals, in the template's order: of a span's positions the first place of each counts if it stands behind the first places of all positions before it. score is the largest share of a template's 3-grams that is found. Null and empty texts have no words, no labels and score 0. Repeated rows stay and give equal rows; a null id stays; an empty table gives none. Other columns are not read. Texts are scanned once; what is shuffled is each row's id and word count, and its hits.
    """
    known = templates(docs.sparkSession, base, notices)
    hashes = [r["hash"] for r in known.select("hash").distinct().collect()]  # the code's templates, some hundred
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), words(F.col(f"`{text_col}`")).alias("words"))
    starts = F.slice("words", 1, F.greatest(F.size("words") - (K - 1), F.lit(0)))
    found = F.array_compact(F.transform(starts, lambda w, i: F.when(gram(F.col("words"), w, i).isin(hashes), i)))
    kept = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), F.transform(found, lambda i: F.struct(i.alias("pos"), F.slice("words", i + 1, K).alias("found"))).alias("hits"))
    each = kept.select("row", "id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "id", "n_words", "hit.pos", "hit.found")
    rolled = each.withColumn("hash", F.xxhash64(*(F.get("found", F.lit(k)) for k in range(K))))
    # equal words, not hashes alone; a document's rows meet once, all that follows stays there
    voted = rolled.join(F.broadcast(known), (rolled["hash"] == known["hash"]) & (F.col("found") == F.col("parts")), "left").select("row", "id", "n_words", "template", "label", "exact", "grams", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    hits = voted.repartition(shuffle_partitions(docs), "row")
    of, of_template = ["row", "id", "n_words"], ["template", "label", "exact", "grams"]
    votes = hits.withColumn("votes", F.count("at").over(Window.partitionBy("row", "template", "diagonal")))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal", "at")
    bands = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > GAP).cast("int")).withColumn("band", F.sum(F.coalesce("new", F.lit(0))).over(by_diagonal))
    # verified spans: the first place of each template position counts where it stands behind those of all positions before it
    span = Window.partitionBy("row", "template", "band")
    firsts = bands.withColumn("first", F.when(F.col("pos") == F.min("pos").over(Window.partitionBy("row", "template", "band", "at")), F.col("pos")))
    chained = firsts.withColumn("ahead", F.max("first").over(span.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)))
    place = F.when(F.col("exact") & (F.col("at") == 0) & (F.col("votes") == F.col("grams")), F.col("pos"))  # a base phrase stands there word for word
    counts = F.col("first").isNotNull() & (F.col("ahead").isNull() | (F.col("first") > F.col("ahead")))
    spans = chained.groupBy(*of, *of_template, "band").agg(F.max("votes").alias("best"), F.count(F.when(counts, 1)).alias("chain"), F.count(place).alias("places"), F.min(place).alias("first"), F.max(place).alias("last"))
    share = F.when(F.col("exact"), F.col("best")).otherwise(F.col("chain")) / F.col("grams")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    labels = F.when(F.col("share") >= F.when(F.col("exact"), 1.0).otherwise(COVER), F.col("label"))
    summary = spans.withColumn("share", share).groupBy(*of).agg(F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"), joined(labels).alias("labels"), F.max("share").alias("score"))
    return summary.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), "base_labels", "labels", F.coalesce("score", F.lit(0.0)).alias("score"))
