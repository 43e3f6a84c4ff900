"""Conversation prefix trie: chained digests of prefixes, nodes by (depth, digest), sums over subtrees.

Each turn has a digest; the digest of a prefix is chained from those of its turns, so equal prefixes have equal digests and others don't.
Every prefix of every conversation is one narrow row, and prefixes of one depth and digest are a node. A node belongs to its smallest
member, and gives its value to all of its ancestors, which are that member's own shorter prefixes. Along a conversation, the values
that reach one prefix are summed first (a suffix sum), so this explosion to ancestors costs one row for each prefix however deep a
conversation is; then the rows of a node are summed.

A conversation or a node may hold a large share of all rows. Turns are put in order over the whole table by range, not by conversation;
chains and suffix sums run in blocks of BLOCK turns with one row for each block carried over; counts and sums of a node are combined
before the shuffle; joins are on unique keys, or deal hot keys apart. Texts are read once, where they lie, and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, read, staged
from vitrine.llm.neardup import join_hot
from vitrine.operators.ranking import positioned

#: Turns of a conversation that are chained, or summed, in one group.
BLOCK = 1024
#: Ids of a list that are joined in one group: those of one range of so many numbers.
ID_RANGE = 512
#: Most turns that a conversation shares with the first of its twenty.
MOST_SHARED = 3


def turn_facts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, digest (SHA-256 of role and text, told apart by the role's length) and words of each turn. Null text or role: empty."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    return turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"))


def in_order(facts: DataFrame) -> DataFrame:
    """facts (conv_id, turn, digest, words) with pos, the turn's place in its conversation from 1: by turn, null first, ties by digest.
    Rows without conv_id are in no conversation and are left out. Equal rows are told apart by where they are read, so that they can be dealt."""
    #: Written first, as dealing by range reads its input twice.
    rows = staged(facts.where("conv_id IS NOT NULL").withColumn("read", F.monotonically_increasing_id()), "turn-facts")
    rows = positioned(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("read"), name="place")
    first = staged(rows.groupBy("conv_id").agg((F.min("place") - 1).alias("before"), F.count("*").alias("n")), "conv-starts")
    return join_hot(rows, first, ["conv_id"], "n").select("conv_id", (F.col("place") - F.col("before")).alias("pos"), "digest", "words", "n")


def rebuilt(ordered: DataFrame, base: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first `shared` (MOST_SHARED at most) turns of conversation `base`, both expressions over conv_id,
    and go on with their own turns after the first `shared`. ordered: a written table of in_order().

    Returns turns (conv_id, depth, digest, words, size) and conversations (conv_id, size), of which some may have no turn.
    """
    heads = ordered.where(F.col("pos") <= MOST_SHARED).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    convs = ordered.where("pos = 1").select("conv_id", "n", base.alias("base"), shared.cast("int").alias("shared")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("shared")))
    convs = staged(convs.select("conv_id", "n", "shared", "head", (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("shared"))).cast("long").alias("size")), "rebuilt")
    given = convs.select("conv_id", F.explode("head").alias("h"), "size").select("conv_id", F.col("h.pos").alias("depth"), "h.digest", "h.words", "size")
    own = join_hot(ordered.drop("n"), convs.select("conv_id", "n", "shared", F.size("head").alias("taken"), "size"), ["conv_id"], "n")
    own = own.where("pos > shared").select("conv_id", (F.col("pos") - F.col("shared") + F.col("taken")).alias("depth"), "digest", "words", "size")
    return given.unionByName(own), convs.select("conv_id", "size")


def _chain(rows: DataFrame, by: list[str], order: str, digest: str) -> DataFrame:
    """rows with chained, the digest over the chained digest of the row before, in order within `by`, and this row's; and its `previous`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, b""
        for batch in batches:
            chained, previous = [], []
            for *key, own in zip(*(batch.column(c).to_pylist() for c in by), batch.column(digest).to_pylist(), strict=True):
                if key != now:
                    now, last = key, b""
                previous.append(last)
                last = hashlib.sha256(last + own).digest()
                chained.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chained, pa.binary()), pa.array(previous, pa.binary())], [*batch.schema.names, "chained", "previous"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, f"{fields}, chained binary, previous binary")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one (of an empty digest) included: conv_id, depth, digest, parent (the digest of one
    turn less; null at the root), words of its last turn, size of its conversation.

    turns: conv_id, depth from 1 without gaps, digest, words, size. convs: conv_id, size. Chains are cut after each BLOCK turns: what follows
    is chained from nothing, and digested once more behind the digest of all blocks before, so blocks of one conversation are independent.
    """
    blocks = staged(_chain(turns.withColumn("block", F.expr(f"(depth - 1) DIV {BLOCK}")), ["conv_id", "block"], "depth", "digest").drop("digest"), "chained")
    ends = blocks.where(f"depth % {BLOCK} = 0").select("conv_id", "block", F.col("chained").alias("digest"))
    #: Behind `behind`, the digest of a conversation's turns before a block.
    before = staged(_chain(ends, ["conv_id"], "block", "digest").select("conv_id", (F.col("block") + 1).alias("block"), F.col("chained").alias("behind")), "blocks")
    rows = blocks.join(before, ["conv_id", "block"], "left") if not before.isEmpty() else blocks.withColumn("behind", F.lit(None).cast("binary"))
    behind = lambda own: F.when(F.col("block") == 0, F.unhex(F.sha2(own, 256))).otherwise(F.unhex(F.sha2(F.concat("behind", own), 256)))
    none = F.lit(b"")
    parent = F.when(F.col("depth") == 1, none).when(F.col("previous") == none, F.col("behind")).otherwise(behind(F.col("previous")))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), none.alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "size")
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), behind(F.col("chained")).alias("digest"), parent.alias("parent"), "words", "size").unionByName(root)


def _suffix_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows (conv_id, depth, ...) with each of values summed from its row to the end of its conversation, in blocks."""
    rows = rows.withColumn("block", F.expr(f"depth DIV {BLOCK}"))
    own, later = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()), Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select(*(c for c in rows.columns if c not in values), *(F.sum(c).over(own).alias(c) for c in values))
    long_ = rows.where(f"size >= {BLOCK}").groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in values))
    after = staged(long_.select("conv_id", "block", *(F.sum(c).over(later).alias(f"_{c}") for c in values)), "after-blocks")
    if after.isEmpty():
        return within.drop("block")
    joined = within.join(after, ["conv_id", "block"], "left")
    return joined.select(*(c for c in rows.columns if c not in (*values, "block")), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in values))


def _ends_digests(ends: DataFrame) -> DataFrame:
    """ends (depth, digest, conv_id): depth, digest and ends_sha256, the hash of the ids in numeric order with commas between. Ids of a
    range are joined first; a node's pieces then stream through its hash in order, so no list of ids is ever held."""
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("depth", "digest", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(piece.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary()), pa.array([d[2].hexdigest() for d in done], pa.string())], ["depth", "digest", "ends_sha256"])

        now, done = None, []
        for batch in batches:
            for depth, digest, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "ids")), strict=True):
                if now is None or now[:2] != (depth, digest):
                    done += [now] if now else []
                    now = (depth, digest, hashlib.sha256(ids.encode()))
                else:
                    now[2].update(b"," + ids.encode())
            yield flushed(done)
            done = []
        if now:
            yield flushed([now])

    return pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "range").select("depth", "digest", "ids").mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: depth, digest, parent_digest, conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, ... without gaps), digest, words, size (the conversation's number of turns). convs: one row (conv_id, size)
    for each conversation, also for those without turns. No conversations: no nodes, not even the root. Equal conversations are members
    of the same nodes. Other columns are ignored.
    """
    rows = staged(prefixes(turns, convs), "prefixes")
    #: Members of a node agree on its parent and words.
    nodes = rows.groupBy("depth", "digest", "parent", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("deepest"))
    nodes = staged(nodes.select("*", (F.col("deepest") == F.col("depth")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "nodes")
    sums = ["n_leaves", "saved_tokens"]
    #: A node's value stands at its owner's prefix of that depth; suffix sums carry it to the owner's shorter prefixes.
    valued = rows.select("conv_id", "depth", "digest", "size").join(nodes.select("conv_id", "depth", *sums), ["conv_id", "depth"], "left").fillna(0, sums)
    reach = _suffix_sums(valued, sums).groupBy("depth", "digest").agg(*(F.sum(c).alias(c) for c in sums))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    out = nodes.drop(*sums).join(reach, ["depth", "digest"]).join(children, ["depth", "digest"], "left").join(_ends_digests(rows.where("depth = size")), ["depth", "digest"], "left")
    out = staged(out.fillna(0, ["n_children"]).fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"]), "trie")
    parents = out.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = join_hot(out.where("depth > 0"), parents.withColumnRenamed("n_children", "siblings"), ["depth", "parent"], "siblings").drop("siblings")
    top = out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).select("depth", "digest", F.col("parent").alias("parent_digest"), "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first of its twenty (see the contract: c - c % 20, crc32 of the id % 4 turns)."""
    ordered = staged(in_order(turn_facts(read(spark, sf_dir, "conversations"))), "ordered-turns")
    turns, convs = rebuilt(ordered, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    return trie(turns, convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 by its definition: for each byte, eight shifts with the reversed polynomial.
ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT c, list(digest ORDER BY turn NULLS FIRST, digest) AS turns, list(words ORDER BY turn NULLS FIRST, digest) AS words FROM t GROUP BY c),
h AS (
  SELECT *, c - c % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
      lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT) % 4 AS h
  FROM o
), r AS (SELECT h.c, list_concat(coalesce(b.turns, [])[:h.h], h.turns[h.h + 1:]) AS turns, list_concat(coalesce(b.words, [])[:h.h], h.words[h.h + 1:]) AS words FROM h LEFT JOIN o b ON b.c = h.base),
p AS (SELECT *, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth FROM r),
q AS (SELECT c, size, depth, array_to_string(turns[:depth], ',') AS node, CASE WHEN depth > 0 THEN array_to_string(turns[:depth - 1], ',') END AS up, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words FROM p),
n AS (
  SELECT depth, node, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own, CAST(max(size) = depth AS BIGINT) AS leaf,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = depth), '')) AS ends_sha256
  FROM q GROUP BY depth, node
), above AS (SELECT a.depth, a.node, n.own, n.leaf FROM n JOIN q m ON m.c = n.conv_id AND m.depth = n.depth JOIN q a ON a.c = m.c AND a.depth <= m.depth),
s AS (SELECT depth, node, sum(own) AS saved, sum(leaf) AS leaves FROM above GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, up AS node, count(*) AS children FROM n WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, node) LEFT JOIN k USING (depth, node) LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = n.up AND n.depth > 0
"""
