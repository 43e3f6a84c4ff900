"""Collections of look files: modes, votes, similarity groups and orderings."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import text


def described(files: DataFrame) -> DataFrame:
    """files (folder, pos, filename) with designer, season, year, kind and look_number."""
    f = F.col("filename")
    return files.withColumns({"designer": text.designer(f), "season": text.season(f), "year": text.year(f), "kind": text.collection_type(f), "look_number": text.look_number(f)})


def mode_per(rows: DataFrame, group: str, value: str, pos: str = "pos") -> DataFrame:
    """The most frequent value of each group, of equals the one seen first, with its count."""
    by = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return by.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(group, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def consistency(files: DataFrame, least: int = 5) -> DataFrame:
    """Per folder of at least `least` described files: the usual designer, season and year, and a confidence of 0.6, 0.3 and 0.1 for their shares."""
    size = files.groupBy("folder").agg(F.count("*").alias("files")).where(F.col("files") >= least)
    out, confidence = size, F.lit(0.0)
    for value, weight in (("designer", 0.6), ("season", 0.3), ("year", 0.1)):
        out = out.join(mode_per(files, "folder", value).withColumnRenamed("n", f"{value}_n"), "folder", "left")
        confidence = confidence + weight * F.coalesce(F.col(f"{value}_n") / F.col("files"), F.lit(0.0))
    return out.withColumn("confidence", F.round(confidence, 6)).drop("designer_n", "season_n", "year_n")


def largest_pattern(files: DataFrame) -> DataFrame:
    """Per folder, the files of the commonest name before "-NN.ext", by look number."""
    stem = F.regexp_extract("filename", r"^(.*)-\d+\.[a-zA-Z]+$", 1)
    named = files.withColumn("stem", stem).where("stem != ''")
    best = mode_per(named, "folder", "stem").drop("n")
    return named.join(best, ["folder", "stem"]).withColumn("position", F.row_number().over(Window.partitionBy("folder").orderBy(text.look_number(F.col("filename")), "filename")))


def similarity_groups(files: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Groups of a folder's described files: the first file without a group begins one, and later ones join that score enough against it.

    The score is 1 each for an equal designer, season and year, so a file's partners depend on its values alone: files of equal values, of which
    enough are known, share a group, and the pass in order runs over the distinct values of a folder, which are few, not over its files. A
    file of which fewer are known joins none and is joined by none; such groups of one are numbered after the others, by pos.
    """
    known = sum(F.col(c).isNotNull().cast("int") for c in ("designer", "season", "year")) >= threshold
    by = files.where(known).groupBy("folder", "designer", "season", "year").agg(F.min("pos").alias("pos"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        values = rows[["designer", "season", "year"]].astype(object).where(rows[["designer", "season", "year"]].notna(), None).values.tolist()
        group, seeds = [], []
        for v in values:
            hit = next((k for k, s in enumerate(seeds) if sum(a is not None and a == b for a, b in zip(v, s, strict=True)) >= threshold), None)
            if hit is None:
                hit = len(seeds)
                seeds.append(v)
            group.append(hit)
        return rows.assign(group_no=pd.Series(group, dtype="int64"))[["folder", "designer", "season", "year", "group_no"]]

    grouped = by.groupBy("folder").applyInPandas(run, "folder string, designer string, season string, year int, group_no long")
    keys = [F.col(f"f.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("folder", "designer", "season", "year")]
    together = files.where(known).alias("f").join(grouped.alias("g"), keys).select("f.*", "g.group_no")
    groups = grouped.groupBy("folder").agg((F.max("group_no") + 1).alias("_groups"))
    alone = files.where(~known).withColumn("_nth", F.row_number().over(Window.partitionBy("folder").orderBy("pos"))).join(groups, "folder", "left")
    return together.unionByName(alone.withColumn("group_no", F.coalesce("_groups", F.lit(0)) + F.col("_nth") - 1).drop("_groups", "_nth"))


def primary_cluster(images: DataFrame, page: str = "page_id") -> DataFrame:
    """The gallery of each page of images (page, dom_index, ancestry, url): those of the ancestry that most images have, of equals the one
    that comes first in the page; each file name once, with position from 1. An image without an ancestry counts as of the empty one."""
    named = images.withColumn("ancestry", F.coalesce("ancestry", F.lit("")))
    sizes = named.groupBy(page, "ancestry").agg(F.count("*").alias("n"), F.min("dom_index").alias("first"))
    best = sizes.groupBy(page).agg(F.max_by(F.struct("ancestry", "n"), F.struct("n", -F.col("first"))).alias("b")).select(page, "b.ancestry", F.col("b.n").alias("images"))
    stem = F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1)
    once = named.join(best, [page, "ancestry"]).where("url IS NOT NULL").groupBy(page, "ancestry", "images", stem.alias("stem")).agg(F.min_by("url", "dom_index").alias("url"), F.min("dom_index").alias("dom_index"))
    return once.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy("dom_index"))).drop("stem")


def class_groups(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """The groups of elements (page, name, css_class) that share a class: page, css_class, members, and filterable, whether groups may be left
    out by a judge. An element alone in its class is in no group, and a page with a single group can't be told apart, so nothing is left out."""
    groups = elements.where("css_class != ''").groupBy(page, "css_class").agg(F.count("*").alias("members")).where("members > 1")
    return groups.withColumn("filterable", F.count("*").over(Window.partitionBy(page)) > 1)


def matching_collection(files: DataFrame, name: str, least: int = 5, confidence: float = 0.6) -> DataFrame:
    """Per folder, how many files carry a collection's name, and whether these are enough to keep the folder."""
    hit = F.contains(F.lower("filename"), F.lit(name.lower())).cast("int")
    by = files.groupBy("folder").agg(F.count("*").alias("files"), F.sum(hit).alias("matches"))
    return by.withColumn("keep", (F.col("matches") >= least) & (F.col("matches") / F.col("files") >= confidence))


