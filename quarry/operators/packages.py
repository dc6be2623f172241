"""Packages as rows: kind of an office package, its relationships, metadata, names of its outputs; reviewed hosts of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The folder that tells an office package's kind, tried in this order, and the start of its extension.
FOLDERS = (("ppt/", "ppt"), ("xl/", "xls"), ("word/", "doc"))
TYPES_PART = "[Content_Types].xml"
MOST_XML, MOST_METADATA = 16 << 20, 1 << 20


def office_kind(entries: DataFrame, group: str, name: str) -> DataFrame:
    """group, extension and macro of every package: null without the content types part or without a known folder. One aggregation with partial results; null names count as other names."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = entries.groupBy(group).agg(has(F.col(name) == TYPES_PART).alias("typed"), has(F.col(name).rlike(r"(?i)(^|/)vbaProject\.bin$")).alias("macro"), *(has(F.col(name).startswith(folder)).alias(short) for folder, short in FOLDERS))
    base = F.coalesce(*(F.when(F.col(short), short) for _, short in FOLDERS))
    return found.select(group, F.when(F.col("typed"), F.concat(base, F.when(F.col("macro"), "m").otherwise("x"))).alias("extension"), (F.col("typed") & base.isNotNull() & F.col("macro")).alias("macro"))


def resolved(rels: Column, target: Column) -> Column:
    """The part that a relationship of the part list `rels` points to: from the root after a slash, else from the owner's folder, with dot steps folded and percent signs decoded."""
    owner = F.regexp_replace(rels, r"_rels/[^/]*\.rels$", "")
    folded = F.aggregate(
        F.split(F.concat(owner, target), "/"),
        F.expr("CAST(array() AS array<string>)"),
        lambda out, step: F.when(step == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(step.isin("", "."), out).otherwise(F.concat(out, F.array(step))),
    )
    path = F.when(target.startswith("/"), F.substring(target, F.lit(2), F.length(target))).otherwise(F.array_join(folded, "/"))
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in either kind of quotes, wherever it stands; empty without it."""
    quoted = F.regexp_extract(tag, rf"""(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 2, F.lit(0)))


def relationships(parts: DataFrame, group: str, name: str, xml: str) -> DataFrame:
    """One row per relationship: group, name, target (resolved; null for what points outside), external and hyperlink. Only parts named *.rels of at most MOST_XML bytes are read; null texts have none."""
    fit = parts.where(F.col(name).endswith(".rels") & (F.octet_length(xml) <= MOST_XML))
    # after the tag's name: values in quotes, which may hold the closing bracket, and all else up to it
    rows = fit.select(group, name, F.explode(F.regexp_extract_all(xml, F.lit(r"""<Relationship(?=[\s/>])((?:"[^"]*"|'[^']*'|[^>"'])*)>"""), F.lit(1))).alias("tag"))
    rows = rows.select(group, name, *(attribute(F.col("tag"), a).alias(a) for a in ("Target", "TargetMode", "Type")))
    external = F.col("TargetMode") == "External"
    raw = F.replace("Target", F.lit("&amp;"), F.lit("&"))
    return rows.select(group, name, F.when(~external & (raw != ""), resolved(F.col(name), raw)).alias("target"), external.alias("external"), F.col("Type").endswith("/hyperlink").alias("hyperlink"))


def package_checks(parts: DataFrame, group: str, name: str, xml: str) -> DataFrame:
    """group, resolves (the content types are declared and every inner target is a part) and active_links (something other than a hyperlink points outside). Targets meet names in an anti-join on package and name."""
    found = relationships(parts, group, name, xml)
    names = parts.select(F.col(group).alias("_g"), F.col(name).alias("_n")).distinct()
    broken = found.where("target is not null").join(names, (F.col(group) == F.col("_g")) & (F.col("target") == F.col("_n")), "left_anti").select(group).distinct().withColumn("broken", F.lit(True))
    outside = found.groupBy(group).agg(F.bool_or(F.col("external") & ~F.col("hyperlink")).alias("active_links"))
    typed = parts.groupBy(group).agg(F.coalesce(F.bool_or(F.col(name) == TYPES_PART), F.lit(False)).alias("typed"))
    return typed.join(broken, group, "left").join(outside, group, "left").select(group, (F.col("typed") & F.col("broken").isNull()).alias("resolves"), (F.col("typed") & F.coalesce("active_links", F.lit(False))).alias("active_links"))


def cleared(xml: Column, tags: tuple[str, ...]) -> Column:
    """XML text with the named elements emptied, their tags kept; texts above MOST_METADATA bytes stay as they are."""
    # of equal tags the nearest closing one ends an element
    out = F.regexp_replace(xml, rf"(?s)<({'|'.join(tags)})>.*?</\1>", "<$1></$1>")
    return F.when(F.octet_length(xml) <= MOST_METADATA, out).otherwise(xml)


def unique_names(files: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """group, order, name and the output name: the first of `a.x`, `a (2).x`, `a (3).x` that no earlier file of the group took.

    What a file takes depends on all names taken before it, given ones and numbered ones alike, so a group is folded in its order. Only groups with a repeated name take that path, and of those only the names that can meet: names are dealt by group and by what is left of them without numbers in brackets, so that a fold holds one such family. Null names count as `file`; ties of order are taken by name.
    """
    rows = files.select(group, order, F.coalesce(F.col(name), F.lit("file")).alias("name"))
    stem = F.regexp_replace("name", r"( \(\d+\))+(?=(\.[^.]*)?$)", "")
    schema = rows.withColumn("unique_name", F.lit("")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, used, following = None, set(), {}
        for batch in batches:
            out = []
            groups, names, families = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for g, given, stem_ in zip(groups, names, families, strict=True):
                if (g, stem_) != family:
                    family, used, following = (g, stem_), set(), {}
                taken = given
                if taken in used:
                    dot = given.rfind(".")
                    head, tail = (given, "") if dot < 0 else (given[:dot], given[dot:])
                    k = following.get(given, 2)
                    while (taken := f"{head} ({k}){tail}") in used:
                        k += 1
                    following[given] = k + 1
                used.add(taken)
                out.append(taken)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], [group, order, "name", "unique_name"])

    dealt = rows.withColumn("_stem", stem).repartition(F.col(group), F.col("_stem")).sortWithinPartitions(group, "_stem", order, "name")
    return dealt.mapInArrow(fold, schema)


def hosts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and host of every distinct host that a text names after a web or socket scheme, lower-cased."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:https?|wss?)://([a-z0-9.-]+)"), F.lit(1)), F.lower))
    return texts.select(key, F.explode(found).alias("host"))


def unreviewed(texts: DataFrame, reviewed: DataFrame, key: str, text: str) -> DataFrame:
    """host and in how many texts it stands, for hosts that the reviewed list (host) lacks."""
    return hosts(texts, key, text).groupBy("host").agg(F.count("*").alias("texts")).join(reviewed.select("host").distinct(), "host", "left_anti")
