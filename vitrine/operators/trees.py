"""Category trees as edge tables (node_id, parent_id, ordinal, name, url): paths, counts, pruning, roll-ups and rewrites.

What follows the tree comes from its closure, which is found by doubling: each round joins the pairs known so far to the jumps of twice the
length, so the rounds are the logarithm of the depth and there is no bound on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.predicates import is_all_category, is_homepage
from vitrine.shared import spread, staged


def closure(nodes: DataFrame) -> DataFrame:
    """Every pair of a node and one of its ancestors, itself included: node_id, ancestor_id, distance. Parents that form a cycle are an error."""
    child, above = nodes.select("node_id", F.col("parent_id").alias("ancestor_id")), nodes.select(F.col("node_id").alias("ancestor_id"))
    parents = staged(child.join(above, "ancestor_id").select("node_id", "ancestor_id", F.lit(1).alias("distance")), "tree-parents")
    pairs, jumps, length = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance")).unionByName(parents), parents, 1
    known = parents
    while True:
        further = known.select(F.col("node_id").alias("by"), F.col("ancestor_id").alias("top"), F.col("distance").alias("more"))
        found = jumps.join(further, F.col("ancestor_id") == F.col("by")).select("node_id", F.col("top").alias("ancestor_id"), (F.lit(length) + F.col("more")).alias("distance"))
        found = staged(found, "tree-pairs")
        size = found.agg(F.count("*").alias("n"), F.count_if(F.col("node_id") == F.col("ancestor_id")).alias("cycles")).first()
        if size["cycles"]:
            raise ValueError("the parents of some nodes form a cycle")
        if not size["n"]:
            return pairs
        pairs, known, length = pairs.unionByName(found), known.unionByName(found), 2 * length
        jumps = found.where(F.col("distance") == length)


def with_paths(nodes: DataFrame) -> DataFrame:
    """Every node below a root with depth (0 at a root), path of names joined by " > ", and sort_path, which orders a listing depth first."""
    own = F.struct("node_id", "parent_id", "ordinal", "name", "url")
    above = closure(nodes).join(nodes.select(F.col("node_id").alias("ancestor_id"), own.alias("at")), "ancestor_id")
    by = above.groupBy("node_id").agg(F.max("distance").alias("depth"), F.max(F.when(F.col("distance") == 0, F.col("at"))).alias("own"), F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("up"), F.col("at.name").alias("name"), F.col("at.ordinal").alias("ordinal"), F.col("at.parent_id").alias("parent_id")))).alias("way"))
    names = F.transform("way", lambda x: x["name"])
    path = F.when(~F.exists(names, lambda x: x.isNull()), F.array_join(names, " > "))
    sort_path = F.array_join(F.transform("way", lambda x: F.lpad(x["ordinal"].cast("string"), 12, "0")), "/")
    return by.where(F.col("way")[0]["parent_id"].isNull()).select("own.*", "depth", path.alias("path"), sort_path.alias("sort_path"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")


def kept_leaves(nodes: DataFrame) -> DataFrame:
    """Leaves with a URL, with the number at their level; an "all" leaf is skipped if its level has three or more."""
    own = leaves(nodes).where("url IS NOT NULL").withColumn("at_level", F.count("*").over(Window.partitionBy("parent_id")))
    return own.where(~(is_all_category(F.col("name")) & (F.col("at_level") >= 3)))


def counts(nodes: DataFrame) -> DataFrame:
    """nodes, with_url, distinct_urls, leaves (with a URL) of the whole tree."""
    return nodes.agg(F.count("*").alias("nodes"), F.count("url").alias("with_url"), F.count_distinct("url").alias("distinct_urls")).crossJoin(leaves(nodes).agg(F.count("url").alias("leaves")))


def subtree_products(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """Per node, the distinct products of its subtree; listed has (node_id, product_id). Nodes without any are left out."""
    #: Both dealings are of a given number, as tasks that hold whole sets of pairs would be put together by how small these are when packed.
    pairs = spread(listed.select("node_id", "product_id"), "node_id").distinct()
    above = closure(nodes).join(pairs, "node_id").where("product_id IS NOT NULL").select(F.col("ancestor_id").alias("node_id"), "product_id")
    return spread(above, "node_id", "product_id").distinct().groupBy("node_id").agg(F.count("*").alias("products"))


def pruned(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """The nodes that have a product, or a descendant that has."""
    full = closure(nodes.select("node_id", "parent_id")).join(listed.select("node_id").distinct(), "node_id", "left_semi").select(F.col("ancestor_id").alias("node_id")).distinct()
    return nodes.join(full, "node_id", "left_semi")


def rolled_into_all(nodes: DataFrame, listed: DataFrame, least_siblings: int = 3) -> DataFrame:
    """listed, with the products of their siblings for every empty "all" node that has siblings enough; each product once, at its first place."""
    named = nodes.withColumn("siblings", F.count("*").over(Window.partitionBy("parent_id")))
    empty = named.where(is_all_category(F.col("name")) & (F.col("siblings") >= least_siblings)).join(listed, "node_id", "left_anti").select(F.col("node_id").alias("all_id"), "parent_id")
    others = nodes.where(~is_all_category(F.col("name"))).select("node_id", "parent_id").join(listed, "node_id")
    added = empty.join(others, "parent_id").groupBy(F.col("all_id").alias("node_id"), "product_id").agg(F.min("pos").alias("pos"))
    return listed.select("node_id", "product_id", "pos").unionByName(added)


def redundant_urls(nodes: DataFrame) -> DataFrame:
    """nodes, a URL that a direct child shares set to null."""
    child = nodes.where("url IS NOT NULL").select(F.col("parent_id").alias("node_id"), F.col("url").alias("url")).distinct().withColumn("shared", F.lit(True))
    return nodes.join(child, ["node_id", "url"], "left").withColumn("url", F.when(F.col("shared").isNull(), F.col("url"))).select("node_id", "parent_id", "ordinal", "name", "url")


def without_homepages(nodes: DataFrame, base: str) -> DataFrame:
    """Without nodes that lead to the homepage and all below them; one that is the only root stays."""
    alone = nodes.where("parent_id IS NULL").agg(F.count("*").alias("roots"))
    bad = nodes.crossJoin(F.broadcast(alone)).where(F.coalesce(is_homepage(F.col("url"), F.lit(base)), F.lit(False)) & ~(F.col("parent_id").isNull() & (F.col("roots") == 1)))
    below = closure(nodes.select("node_id", "parent_id")).join(bad.select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("node_id").distinct()
    return nodes.join(below, "node_id", "left_anti")


def collapsed(nodes: DataFrame) -> DataFrame:
    """While the top level is one node with children, its children take its place: the roots are then the nodes of the first level that has
    several, or none below it."""
    placed = staged(with_paths(nodes), "tree-levels")
    levels = placed.groupBy("depth").agg(F.count("*").alias("n"))
    below = levels.select((F.col("depth") - 1).alias("depth"), F.lit(True).alias("goes_on"))
    top = levels.join(below, "depth", "left").where("n > 1 OR goes_on IS NULL").agg(F.min("depth").alias("top"))
    kept = placed.crossJoin(F.broadcast(top)).where("depth >= top")
    return kept.withColumn("parent_id", F.when(F.col("depth") > F.col("top"), F.col("parent_id"))).select("node_id", "parent_id", "ordinal", "name", "url")


def lifted_links(links: DataFrame) -> DataFrame:
    """Links (parent_id, child_id or null, url) of one level: in the parent and two children or more, the parent's alone; in the parent and one
    child, the child's alone; in two children or more and not the parent, moved up to the parent."""
    by = links.groupBy("parent_id", "url").agg(F.max(F.col("child_id").isNull()).alias("above"), F.count_distinct("child_id").alias("children"), F.min("child_id").alias("child"))
    return by.select("parent_id", "url", F.when(F.col("children") >= 2, F.lit(None)).when(F.col("children") == 1, F.col("child")).alias("child_id"))


def from_paths(rows: DataFrame) -> DataFrame:
    """Rows (path of names joined by " > ", url, pos) as an edge table: every prefix is a node, equal neighbours are one level; the first URL given to a path is its own."""
    parts = F.split("path", " > ")
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    clean = rows.withColumn("parts", parts).withColumn("parts", F.filter("parts", lambda p, i: (i == 0) | (p != F.get(F.col("parts"), i - 1))))
    prefixes = clean.select("url", "pos", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    at = lambda n: F.array_join(F.slice("parts", F.lit(1), n), " > ")
    each = prefixes.select(at(F.col("n")).alias("node_id"), F.when(F.col("n") > 1, at(F.col("n") - 1)).alias("parent_id"), F.get("parts", F.col("n") - 1).alias("name"), F.when(F.col("n") == F.size("parts"), F.col("url")).alias("url"), "pos")
    return each.groupBy("node_id").agg(F.first("parent_id").alias("parent_id"), F.min("pos").alias("ordinal"), F.first("name").alias("name"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("pos"))).alias("url"))


def url_hierarchy(links: DataFrame) -> DataFrame:
    """Per link (url, path), the nearest other link above it by path. Prefixes of each path are joined by equality, so nothing is compared in pairs."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    up = links.select("url", "path", parts.alias("parts")).select("url", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/")))).alias("above"))
    #: One link of each path, so that many at a path and many below it make no more rows than there are prefixes.
    known = links.where("path != '/'").groupBy(F.col("path").alias("above")).agg(F.max("url").alias("parent_url"))
    best = up.where("above != path").join(known, "above").groupBy("url").agg(F.max_by("parent_url", F.struct(F.length("above"), "parent_url")).alias("parent_url"))
    return links.join(best, "url", "left").select("url", "path", "parent_url")


def first_category(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """Per product, the path of the first category, depth first, that lists it."""
    return listed.join(with_paths(nodes).select("node_id", "path", "sort_path"), "node_id").groupBy("product_id").agg(F.min_by("path", "sort_path").alias("path"))


def listing(nodes: DataFrame) -> DataFrame:
    """Lines of a readable listing, in order: line_no, line."""
    rows = with_paths(nodes)
    return rows.select(F.col("sort_path"), F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name")).alias("line"))


def standard_tree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """A tree of categories that hold links (nodes: node_id, parent_id, name; links: node_id, pos, name, url) as one whose leaves are the links:
    parent_id, name, url, is_link.

    The root isn't part of it, so what is directly below it has no parent. A category with one link below it in all is that link; one with
    none goes; others have the URL of their own link of the same name. One closure gives the links below each node.
    """
    above = closure(nodes)
    below = above.join(links.select("node_id"), "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("links"))
    kept = nodes.where("parent_id IS NOT NULL").join(below.where("links > 1"), "node_id").select("node_id", "parent_id", "name")
    own = links.join(kept.select("node_id", F.col("name").alias("category")), "node_id").where(F.lower("name") == F.lower("category")).groupBy("node_id").agg(F.min_by("url", "pos").alias("url"))
    top = F.min_by("ancestor_id", "distance")
    holders = above.join(kept.select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi").groupBy("node_id").agg(top.alias("holder"))
    leaves_ = links.join(holders, "node_id", "left").select(F.col("holder").alias("parent_id"), "name", "url", F.lit(True).alias("is_link"))
    inner = kept.join(own, "node_id", "left").join(kept.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("_kept")), "parent_id", "left")
    return leaves_.unionByName(inner.select(F.when(F.col("_kept"), F.col("parent_id")).alias("parent_id"), "name", "url", F.lit(False).alias("is_link")))


def ordered_for_display(nodes: DataFrame) -> DataFrame:
    """Per parent, categories with children before leaves, each by ordinal; as position."""
    inner = nodes.select(F.col("parent_id").alias("node_id")).where("node_id IS NOT NULL").distinct().withColumn("inner", F.lit(0))
    return nodes.join(inner, "node_id", "left").withColumn("position", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.coalesce("inner", F.lit(1)), "ordinal", "node_id"))).drop("inner")


def url_map(nodes: DataFrame) -> DataFrame:
    """name to url; of equal names the later in the listing."""
    return with_paths(nodes).where("url IS NOT NULL").groupBy("name").agg(F.max_by("url", "sort_path").alias("url"))


def with_url_counts(nodes: DataFrame, urls: DataFrame) -> DataFrame:
    """nodes with the number of URLs that a category URL's page lists (url, product_url); none is 0."""
    return nodes.join(urls.groupBy("url").agg(F.count("*").alias("listed")), "url", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
