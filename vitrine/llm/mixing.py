"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key scaled by its quality weight. Within its source, documents in order of key are prefix-summed
against the source's budget of words: as many whole epochs as fit come first, then the head of the key order fills the rest.

Keys are cut into slots, so a source with a third of all rows is summed by many tasks. Sums of slots show the slot in which a source's
budget ends; only that slot's documents are sorted. What comes out is one small row per source, and a document's share follows from its
own key. Labels are joined by id: a broadcast of ids and labels while these are few, so that texts stay where they are; where they are
many, the rows that they are joined with are shuffled once by id, rows without an id spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, join_checked, read, staged

#: A document is repeated so many times at most.
MAX_EPOCHS = 3
#: Sampling weights by the quality label of a document; one without a label weighs 1.
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_name(source: Column) -> Column:
    """A key that is never null and keeps a null source apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight, where u in (0, 1) comes from the id, so that reruns agree."""
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds target to one row per source (source, size): weights 1, 2, 3, repeating in code-point order (null last), shares of all sizes,
    none above MAX_EPOCHS times its source's size, the excess reshared by weight.

    The level at which resharing ends follows from one order by the ratio of cap to weight. A source is one narrow row, so putting all
    of them in order is a small task whatever the number of documents.
    """
    everything, before = Window.partitionBy(), Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("ratio", MAX_EPOCHS * F.col("size") / F.col("weight"))
    ranked = ranked.withColumn("level", (F.sum("size").over(everything) - MAX_EPOCHS * so_far("size")) / (F.sum("weight").over(everything) - so_far("weight")))
    #: The first source, in order of ratio, whose cap lies above its level sets the level for itself and all that follow.
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)
    return ranked.select("source", "size", F.least((MAX_EPOCHS * F.col("size")).cast("double"), first["level"] * F.col("weight")).alias("target"))


def source_decisions(keyed: DataFrame) -> DataFrame:
    """One row per source of keyed (name, source, size, key): name, source_size, target, epochs, end_slot, end_key, slots."""
    slots = 8 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.withColumn("slot", _slot(F.col("key"), slots))
    in_slots = staged(keyed.groupBy("name", "source", "slot").agg(F.sum("size").alias("size")), "mix-slots")
    targets = source_targets(in_slots.groupBy("source").agg(F.sum("size").alias("size")))
    targets = targets.select(source_name(F.col("source")).alias("name"), F.col("size").alias("source_size"), "target", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("size"), F.lit(0))), F.lit(0)).alias("epochs"))
    targets = staged(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    upto = F.sum("size").over(Window.partitionBy("name").orderBy("slot"))
    ends = join_checked(in_slots.withColumn("upto", upto).drop("source"), targets.select("name", "rest"), ["name"])
    ends = staged(ends.where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest"))).select("name", F.col("slot").alias("end_slot"), (F.col("upto") - F.col("size")).alias("start"), "rest"), "mix-ends")
    last = join_checked(keyed.select("name", "slot", "key", "size"), ends, ["name"], "inner").where(F.col("slot") == F.col("end_slot"))
    last = last.groupBy("name", "key", "start", "rest").agg(F.sum("size").alias("size")).withColumn("upto", F.col("start") + F.sum("size").over(Window.partitionBy("name").orderBy("key")))
    #: The document across the budget's end is taken if that comes nearer to the budget than leaving it.
    cut = last.where((F.col("upto") - F.col("size") < F.col("rest")) & (F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")))).groupBy("name").agg(F.max("key").alias("end_key"))
    decided = targets.join(ends.select("name", "end_slot"), "name", "left").join(cut, "name", "left")
    return staged(decided.select("name", "source_size", "target", "epochs", "end_slot", "end_key", F.lit(slots).alias("slots")), "mix-decisions")


def _slot(key: Column, slots: int | Column) -> Column:
    return F.floor((1 - F.exp(-key)) * slots)


def apply_decisions(docs: DataFrame, decisions: DataFrame, name: Column, key: Column) -> DataFrame:
    """Adds source_size, target and times, how often the mix takes the document."""
    joined = join_checked(docs.withColumn("name", name).withColumn("key", key), decisions, ["name"])
    slot = _slot(F.col("key"), F.col("slots"))
    head = F.coalesce((slot < F.col("end_slot")) | ((slot == F.col("end_slot")) & (F.col("key") <= F.col("end_key"))), F.lit(False))
    return joined.withColumn("times", (F.col("epochs") + head.cast("long")).cast("long")).drop("name", "key", "epochs", "end_slot", "end_key", "slots")


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id and more) with weight: by the highest quality label of their id, else 1."""
    best = staged(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")), "best-labels")
    weight = F.lit(1.0)
    for k, v in QUALITY_WEIGHT.items():
        weight = F.when(F.col("quality") == k, F.lit(v)).otherwise(weight)
    #: Rows without an id match nothing; a number spreads them.
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1009))).otherwise(F.lit(0).cast("long"))
    rows = join_checked(docs.withColumn("spread", spread), best.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], max_rows=500_000)
    return rows.withColumn("weight", weight).drop("quality", "spread")


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, times, taken; other columns are ignored.

    labels (doc_id, quality), if given, set the sampling weights. A null text has size 0; a null source is a source of its own; a null id
    has one key for all such rows. Rows of one id have one key and are taken together. Empty table: no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = quality_weights(rows, labels) if labels is not None else rows.withColumn("weight", F.lit(1.0))
    keyed = staged(rows.select("doc_id", "source", "size", source_name(F.col("source")).alias("name"), exponential_key(F.col("doc_id"), F.col("weight")).alias("key")), "mix-keys")
    mixed = apply_decisions(keyed, source_decisions(keyed), F.col("name"), F.col("key"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs as the mix has them: each row as often as it is taken, its columns unchanged. labels as in mix()."""
    weighted = lambda rows: quality_weights(rows, labels) if labels is not None else rows.withColumn("weight", F.lit(1.0))
    key, name = exponential_key(F.col("doc_id"), F.col("weight")), source_name(F.col("source"))
    keyed = weighted(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    keyed = staged(keyed.select("source", "size", name.alias("name"), key.alias("key")), "mix-keys")
    times = apply_decisions(weighted(docs.select(F.struct("*").alias("row"), "doc_id", "source")), source_decisions(keyed), name, key)
    return times.where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
      / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents LEFT JOIN best USING (doc_id)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source
), r AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size::DOUBLE / ((rank - 1) % 3 + 1) AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS own
  FROM r WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, (SELECT own FROM l WHERE ratio >= own ORDER BY ratio, rank LIMIT 1) * weight) AS target FROM l
), e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs FROM t),
p AS (
  SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY d.source, key) AS own
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN upto - own < rest AND upto - rest <= rest - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
