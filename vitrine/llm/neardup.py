"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: a set's elements are thrown into T bins in rounds, each round with hashes of its own; a bin keeps its least (round, hash).
After T rounds of random bins, T more rounds throw every element into one given bin each, so all bins fill; with many elements the
first round or two do. Two sets agree in a bin with the probability of their similarity. Bands of ROWS bins give buckets: a pair at
the threshold of 0.8 misses every one of the 32 bands with probability (1 - 0.8^5)^32, 3 in a million.

Texts with equal sets are one class. In each bucket, classes are first held against one leader, so a bucket costs as many pairs as it has
members however large it is; only members that stay in different components go on to further leaders, and what remains after that is
searched for partners in other components by prefix filtering, which misses none. Every link is confirmed on the full sets. Components
come from alternating large-star and small-star steps over written tables.

A bucket, a leader or a class may hold a large share of all rows. Aggregates are combined before the shuffle; in joins, keys of more than
HOT rows are joined apart (`join_hot`), and the set of a document in more than HOT pairs is dealt in copies (`_linked`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import join_checked, read, slices, staged
from vitrine.llm.wordhash import mix, shingle_hashes, word_hashes

ROWS, BANDS = 5, 32
BINS = ROWS * BANDS
#: Rounds after the first in which each bucket has one leader, before what is left of different components is compared.
LEADER_ROUNDS = 1
#: Rows of one key beyond which a join treats it apart, with the same result.
HOT = 400
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SEED_1, _SEED_2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_LOW = np.uint64((1 << 40) - 1)
_NONE = np.uint64((1 << 64) - 1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """BINS values of a set of 64-bit hashes that isn't empty."""
    out, first = np.full(BINS, _NONE), 0
    while first < 2 * BINS:
        #: Small sets take many rounds, so several go at once; later rounds never replace what earlier ones placed.
        last = min(2 * BINS, BINS if first < BINS else 2 * BINS, first + max(1, 2 * BINS // len(elements)))
        hashes = mix(elements[None, :] ^ _SEEDS[first:last, None])
        rounds = np.arange(first, last, dtype=np.uint64)[:, None]
        bins = ((hashes >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24) if first < BINS else np.broadcast_to(rounds - np.uint64(BINS), hashes.shape)
        np.minimum.at(out, bins.ravel().astype(np.intp), ((rounds << np.uint64(40)) | (hashes & _LOW)).ravel())
        if out.max() != _NONE:
            break
        first = last
    return out


def bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return out.view(np.int64)


_SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per document: the size of its set of k-word shingles, a 128-bit digest of it, and its buckets (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, d1, d2, keys, ends = [], [], [], [], [0]
                for words in word_hashes(part.column("text"), lower=True):
                    elements = np.unique(shingle_hashes(words, k))
                    sizes.append(len(elements))
                    d1.append(mix(elements ^ _SEED_1).sum(dtype=np.uint64))
                    d2.append(mix(elements ^ _SEED_2).sum(dtype=np.uint64))
                    if len(elements):
                        keys.append(bands(sketch(elements)))
                    ends.append(len(keys) * BANDS)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIGNATURE)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the sorted hashes of its distinct k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(shingle_hashes(words, k)).view(np.int64) for words in word_hashes(part.column("text"), lower=True)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["doc_id", "elements"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, elements array<long>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, its smallest reachable node, for every node of the undirected edges."""
    pairs = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(pairs)
    while before[0]:
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = staged(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        if (now := state(pairs)) == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct().toDF("node", "component"))


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows joined with keyed, a written table of one row per key, `size` being the key's number of rows. Keys of more than HOT rows are
    broadcast if a count shows that they are few, so their rows stay where they are; beyond that Spark splits skewed partitions."""
    large = keyed.where(F.col(size) > HOT)
    if large.isEmpty():
        return rows.join(keyed.hint("merge"), on)
    here = rows.join(keyed.where(F.col(size) <= HOT).hint("merge"), on)
    return here.unionByName(join_checked(rows, large, on, "inner"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets have a similarity of 0.8 or more. Pairs of a document that has more than HOT are
    checked apart, where its set is dealt in as many copies as it takes for each to serve HOT pairs, about."""
    often = {side: pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(side, F.ceil(F.col("n") / HOT).cast("int").alias(f"copies_{side}")) for side in "ab"}
    often = {side: staged(rows, "often") for side, rows in often.items()}
    if all(rows.isEmpty() for rows in often.values()):
        return _similar(pairs.join(_of(sets, "a"), "a").join(_of(sets, "b"), "b"))
    dealt = staged(join_checked(join_checked(pairs, often["a"], ["a"]), often["b"], ["b"]).fillna(1, ["copies_a", "copies_b"]), "dealt-pairs")
    cold, hot = dealt.where("copies_a = 1 AND copies_b = 1").select("a", "b"), dealt.where("copies_a > 1 OR copies_b > 1")
    needed = staged(hot.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "hot-ids")
    own = join_checked(sets, needed, ["doc_id"], "left_semi", max_rows=500_000)
    for side in "ab":
        copies = F.sequence(F.lit(0), F.coalesce(f"copies_{side}", F.lit(1)) - 1)
        copied = join_checked(_of(own, side), often[side], [side]).select(side, f"of_{side}", F.explode(copies).alias("copy"))
        hot = hot.withColumn("copy", F.pmod(F.xxhash64("a", "b"), f"copies_{side}").cast("int")).join(copied, [side, "copy"]).drop("copy")
    return _similar(cold.join(_of(sets, "a"), "a").join(_of(sets, "b"), "b")).unionByName(_similar(hot))


def _of(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(F.col("doc_id").alias(side), F.col("elements").alias(f"of_{side}"))


def _similar(pairs: DataFrame) -> DataFrame:
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.where(100 * both >= 80 * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _near_in_size(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= 80 * F.greatest(n, m)


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept. Documents whose sets of k-word shingles have a Jaccard
    similarity of 0.8 or more are linked; a component's id is its smallest doc_id, and that document is kept.

    Fewer words than k are one shingle; a null text or one without words has an empty set and is linked with nothing. Rows of one doc_id
    are one node. A row without doc_id is linked with nothing and kept, its component null. Empty table: no rows. Other columns are ignored.
    """
    signed = staged(signatures(docs, k), "signatures")
    with_set = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(with_set.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("members")), "classes")
    members = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("leader"), F.min_by("n", "rep").alias("leader_n"), F.count("*").alias("rows")).where("rows > 1")
    buckets = staged(join_hot(members, staged(shared, "leaders"), ["key"], "rows").drop("rows"), "buckets")
    ids = staged(buckets.select(F.col("rep").alias("doc_id")).distinct(), "bucket-ids")
    sets = staged(shingle_sets(join_checked(docs.select("doc_id", "text"), ids, ["doc_id"], "left_semi", max_rows=500_000), k), "sets")

    def pair(df: DataFrame) -> DataFrame:
        return df.where(_near_in_size(F.col("n"), F.col("leader_n"))).select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct()

    tested = staged(pair(buckets.where("rep != leader")), "pairs")
    label = staged(components(staged(_linked(tested, sets), "verified")), "labels")
    for salt in range(1, LEADER_ROUNDS + 2):
        open_ = _open_buckets(buckets, label)
        if open_.isEmpty():
            break
        if salt <= LEADER_ROUNDS:
            order = F.xxhash64("rep", "key", F.lit(salt))
            lead = open_.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("leader"), F.col("n").alias("leader_n"), F.col("component").alias("leader_component"))).alias("l"), F.count("*").alias("rows")).select("key", "l.leader", "l.leader_n", "l.leader_component", "rows")
            found = pair(join_hot(open_, staged(lead, "leaders"), ["key"], "rows").where("component != leader_component"))
        else:
            found = _prefix_pairs(open_.select("rep", "component").distinct(), sets)
        more = staged(found.join(tested, ["a", "b"], "left_anti"), "more-pairs")
        tested = tested.union(more)
        found = staged(_linked(more, sets), "verified")
        if not found.isEmpty():
            label = staged(components(found.union(label.select("node", "component"))), "labels")
    of_class = classes.select("d1", "d2", "n_shingles", "rep", "members").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = staged(of_class.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"), "members"), "of-class")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    rows = signed.select("doc_id", "n_shingles", "d1", "d2")
    linked = join_hot(rows.where(~alone), of_class, ["d1", "d2", "n_shingles"], "members").select("doc_id", "n_shingles", "component")
    out = linked.unionByName(rows.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes (rep, component) of different components that can have a similarity of 0.8, by prefix filtering, which is exact.

    With elements in order of rarity, such a pair shares one of the first n - ceil(0.8 n) + 1, and from the first that it shares enough
    elements are left in both. An element that one set alone has can't be shared, but takes a place, so a text with its own edits throughout
    has no partners to be tried. Such a pair also shares a second element among the first n - ceil(0.8 n) + 2, so where more than HOT
    prefixes hold an element, it is only a partner's together with each that may be the second one.
    """
    tokens = nodes.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "component", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = tokens.groupBy("e").agg(F.count("*").alias("often")).where("often > 1")
    shared, own = tokens.join(often.hint("merge"), "e"), Window.partitionBy("rep")
    shared = shared.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "e")) - 1)
    spare = F.expr("n - (4 * n + 4) DIV 5")
    prefix = staged(shared.where(F.col("place") <= spare + 1).select("rep", "component", "n", "e", "place"), "prefixes")
    first = prefix.where(F.col("place") <= spare)
    common = staged(first.groupBy("e").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT).select("e"), "common-elements")
    keyed = join_checked(first, common, ["e"], "left_anti")
    if not common.isEmpty():
        hot = join_checked(first, common, ["e"], "left_semi").select("rep", F.col("e").alias("e1"), F.col("place").alias("first_place"))
        second = prefix.join(hot, "rep").where("place > first_place")
        keyed = keyed.unionByName(second.select("rep", "component", "n", F.xxhash64("e1", "e").alias("e"), F.col("first_place").alias("place")))
    keyed = staged(keyed, "prefix-keys")
    other = keyed.select("e", *(F.col(c).alias(f"other_{c}") for c in ("rep", "component", "n", "place")))
    left = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place")) - 1
    both = keyed.join(other.hint("merge"), "e").where((F.col("component") < F.col("other_component")) & _near_in_size(F.col("n"), F.col("other_n")) & (9 * left >= 4 * (F.col("n") + F.col("other_n"))))
    return both.select(F.greatest("rep", "other_rep").alias("a"), F.least("rep", "other_rep").alias("b")).distinct()


def _open_buckets(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one component, with component; written, as several steps read it."""
    named = buckets.select("key", "rep", "n").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = staged(named, "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows")).where("x != y").select("key", "rows")
    return staged(join_hot(named, staged(mixed, "mixed"), ["key"], "rows").drop("rows"), "open")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)
