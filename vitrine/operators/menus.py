"""Accessibility snapshots of menus (one line an element, indented) and the trees that explored menus make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.predicates import is_homepage, is_product_link
from vitrine.functions.text import undoubled
from vitrine.functions.urls import absolute, extract, title_words

#: Lines below a link that may hold its URL, the longest name of a link, and of an element that opens something.
URL_LINES, LONGEST_LINK, LONGEST_OPENER = 3, 100, 50


def snapshot_lines(pages: DataFrame, key: str = "doc_id", text: str = "snapshot") -> DataFrame:
    """key, line_no (from 0), line and indent of every line that isn't blank."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "").withColumn("indent", F.length("line") - F.length(F.ltrim("line")))


def snapshot_links(pages: DataFrame, key: str = "doc_id", text: str = "snapshot") -> DataFrame:
    """Links of snapshots: key, name, url, line_no. The URL is on the link's line or on one of the next three, before another element; a link
    without a name has one from its URL; of equal names in a page the later counts."""
    array = F.split(text, "\n")
    #: A line goes with the few below it alone: with all lines of its page, rows would grow with the square of a page's length.
    below = [f"_below{k}" for k in range(1, URL_LINES + 1)]
    lines = pages.select(key, F.posexplode(F.arrays_zip(array.alias("line"), *[F.slice(array, k + 1, F.size(array)).alias(b) for k, b in enumerate(below, 1)])).alias("line_no", "at")).select(key, "line_no", "at.*")
    lines = lines.where(F.col("line").rlike('- link "[^"]+"') | F.col("line").rlike(r"- link:\s*$"))
    after = F.array(*below)
    url = lambda line: extract(line, r"/url:\s*(\S+)")
    stops = lambda line: line.rlike(r"^\s*-\s+(link|button|tab|img|text|listitem|menu)")
    #: The first line below that has a URL or is another element decides.
    first = F.get(F.filter(after, lambda line: url(line).isNotNull() | stops(line)), F.lit(0))
    found = lines.select(key, "line_no", F.trim(extract(F.col("line"), '- link "([^"]+)"')).alias("given"), F.coalesce(url(F.col("line")), url(first)).alias("url")).where("url IS NOT NULL")
    from_url = title_words(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1))
    named = found.withColumn("name", F.when(F.coalesce("given", F.lit("")).isin("", "null"), from_url).otherwise(F.col("given")))
    return named.where((F.length("name") > 0) & (F.length("name") < LONGEST_LINK)).groupBy(key, "name").agg(F.max_by("url", "line_no").alias("url"), F.max("line_no").alias("line_no"))


def snapshot_openers(pages: DataFrame, key: str = "doc_id", text: str = "snapshot") -> DataFrame:
    """Buttons, menu items and tabs that may open something: key, line_no, indent, role, name (a doubled one once); not back and close."""
    role, name = r"(?i)\b(button|menuitem|tab)\s+\"", r"(?i)\b(?:button|menuitem|tab)\s+\"([^\"]+)\""
    rows = snapshot_lines(pages, key, text).select(key, "line_no", "indent", F.lower(extract(F.col("line"), role)).alias("role"), undoubled(F.trim(extract(F.col("line"), name))).alias("name"))
    return rows.where("name IS NOT NULL").where((F.length("name") <= LONGEST_OPENER) & ~F.lower("name").startswith("back") & (F.lower("name") != "close"))


def tree_of_states(states: DataFrame, base: str, filtered: DataFrame | None = None) -> DataFrame:
    """Nodes of a menu's states (pos, path array<string>, links map<string,string>): path (lower case, joined by " > "), name, name and url of its links.

    A path's case doesn't count; the first state gives a node's name. A node has a URL once, under the first name it came with, and
    again under its own name. Links to the homepage are left out; so are products and URLs that `filtered` (url) lists, unless the link has the node's own name.
    """
    low = lambda parts: F.array_join(F.transform(parts, F.lower), " > ")
    prefixes = states.where(F.size("path") > 0).select("pos", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("part"))
    nodes = prefixes.groupBy(low(F.col("part")).alias("node")).agg(F.min_by(F.element_at("part", -1), "pos").alias("node_name"), F.min("pos").alias("first"))
    links = states.select("pos", low(F.col("path")).alias("node"), F.lower(F.try_element_at("path", F.lit(-1))).alias("folder"), F.posexplode("links").alias("at", "name", "href"))
    links = links.withColumn("url", absolute(F.col("href"), F.lit(base))).withColumn("own", F.coalesce(F.lower("name") == F.col("folder"), F.lit(False)))
    if filtered is not None:
        known = filtered.select(F.col("url"), F.lit(True).alias("known")).distinct()
        links = links.join(known, "url", "left").where("own OR known IS NULL").drop("known")
    kept = links.where(~F.coalesce(is_homepage(F.col("url"), F.lit(base)), F.lit(False)) & (F.col("own") | ~F.coalesce(is_product_link(F.col("url")), F.lit(False))))
    again = F.row_number().over(Window.partitionBy("node", "url").orderBy("pos", "at")) > 1
    kept = kept.withColumn("again", again).where("own OR NOT again").withColumn("link_no", F.row_number().over(Window.partitionBy("node").orderBy("pos", "at")))
    return nodes.join(kept.select("node", "name", "url", "link_no"), "node", "full").select("node", "node_name", "name", "url", "link_no")


def every_kth(rows: DataFrame, order: Column, size: int) -> DataFrame:
    """A systematic sample: each k-th row in order, k = rows div size, the first `size` of them; all rows if there are no more."""
    from vitrine.operators.ranking import positioned

    placed = positioned(rows, order)
    k = F.greatest(F.floor(F.col("_rows") / size), F.lit(1))
    counted = placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("_rows"))))
    return counted.where((F.col("_rows") <= size) | (((F.col("position") - 1) % k == 0) & ((F.col("position") - 1) / k < size))).drop("_rows")


def seasons(links: DataFrame) -> DataFrame:
    """Links (url, text) to collections with more than five characters of text, each pair once, in order of text: position."""
    from vitrine.operators.ranking import positioned

    found = links.where(F.contains("url", F.lit("/fashion/collections/")) & (F.length(F.trim("text")) > 5)).select(F.trim("text").alias("text"), "url").distinct()
    return positioned(found, F.col("text"), F.col("url"))


#: Endings of image files, and hosts of videos.
IMAGE_ENDINGS = ["jpg", "jpeg", "png", "gif", "webp", "bmp"]
VIDEO_HOSTS = ["youtube.com", "youtu.be", "vimeo.com"]


def image_files(files: DataFrame) -> DataFrame:
    """Files (folder, filename) that are images by their ending, whatever its case, numbered by name in their folder."""
    own = files.where(F.lower("filename").rlike(rf"\.({'|'.join(IMAGE_ENDINGS)})$"))
    return own.withColumn("position", F.row_number().over(Window.partitionBy("folder").orderBy("filename")))


def video_candidates(links: DataFrame, key: str) -> DataFrame:
    """Links (key, pos, href) to videos, those wrapped in a redirect (/url?q=) unwrapped and decoded; each once at its first place."""
    url = F.coalesce(F.url_decode(extract(F.col("href"), r"/url\?q=([^&]+)")), F.col("href"))
    found = links.select(key, "pos", url.alias("url")).where(F.col("url").rlike("|".join(h.replace(".", r"\.") for h in VIDEO_HOSTS)))
    return found.groupBy(key, "url").agg(F.min("pos").alias("pos"))
