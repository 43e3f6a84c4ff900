"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits, in Spark expressions only.

Every shingle is hashed once. The hash's top bits name its bin, and sorting the hashes puts each bin's least hash first in its run; one
sentinel per bin, sorted in with them, makes the bins' order their index. An empty bin borrows from the first filled bin along a
permutation of its own. The least hashes' low bits make up the fingerprint.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import WORD, read

BIN_BITS, LOW_BITS, SHINGLE = 8, 8, 5
BINS = 1 << BIN_BITS
#: Steps that an empty bin takes along its permutation before all filled bins are compared for it at once; with the same outcome.
STEPS = 8
#: Rows of documents that one bucket of the id order holds. There are at most four times as many buckets as the root of the rows, which
#: the driver sends as bounds; so of very many rows a bucket holds more, of 50 billion about 56,000.
BUCKET_ROWS = 1500
_SENTINEL = (1 << (64 - BIN_BITS)) - 1


def _permutations() -> tuple[list[int], list[int], list[int]]:
    """For each bin, an odd step, its inverse and a start: the bin's permutation of all bins is start + step * t modulo BINS."""
    steps = [(2 * ((j * 2654435761 >> 7) % (BINS // 2)) + 1) for j in range(BINS)]
    return steps, [pow(a, -1, BINS) for a in steps], [((j * 40503 + 12345) * 2246822519 >> 11) % BINS for j in range(BINS)]




def _shingles_of(words: Column, k: int) -> Column:
    many = F.transform(F.arrays_zip(*[F.slice(words, j + 1, F.greatest(F.size(words) - (k - 1), F.lit(0))).alias(f"w{j}") for j in range(k)]), lambda z: F.xxhash64(*[z[f"w{j}"] for j in range(k)]))
    return F.when(F.size(words) >= k, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))




def _first_of_bins(ordered: Column) -> Column:
    return F.filter(ordered, lambda h, i: (i == 0) | (F.shiftright(h, 64 - BIN_BITS) != F.shiftright(F.get(ordered, i - 1), 64 - BIN_BITS)))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = SHINGLE) -> DataFrame:
    """Adds out, an array of BINS values of LOW_BITS bits, for the column text (not null). A text without words has an empty array."""
    steps, inverses, starts = (F.lit(x) for x in _permutations())
    empty = lambda h: h.bitwiseAND(F.lit(_SENTINEL)) == _SENTINEL
    w, o, m, f = (f"_{out}_{x}" for x in ("words", "order", "minima", "filled"))
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)))
    sentinels = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda j: F.shiftleft(j.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_SENTINEL)))
    df = df.withColumn(o, F.sort_array(F.concat(_shingles_of(F.col(w), k), sentinels)))
    df = df.withColumn(m, _first_of_bins(F.col(o)))
    df = df.withColumn(f, F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: ~empty(F.get(F.col(m), j))))
    at = lambda j: F.get(F.col(m), j)

    def borrowed(j: Column) -> Column:
        probe = lambda t: at((F.get(starts, j) + F.get(steps, j) * t).bitwiseAND(F.lit(BINS - 1)))
        near = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), F.lit(_SENTINEL), lambda acc, t: F.when(~empty(acc), acc).otherwise(probe(t)))
        rank = lambda b: ((b - F.get(starts, j)) * F.get(inverses, j)).bitwiseAND(F.lit(BINS - 1))
        far = at(F.array_min(F.transform(F.col(f), lambda b: F.struct(rank(b).alias("rank"), b.alias("bin"))))["bin"])
        return F.transform(F.array(near), lambda x: F.when(empty(x), far).otherwise(x))[0]

    low = F.transform(F.col(m), lambda h, j: F.when(empty(h), borrowed(j)).otherwise(h).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int"))
    return df.withColumn(out, F.when(F.size(f) > 0, low).otherwise(F.array().cast("array<int>"))).drop(w, o, m, f)


def packed(values: Column) -> Column:
    """A fingerprint's values as lowercase hex digits, LOW_BITS bits each; a text without words has an empty string."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), LOW_BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated similarity of two sets of shingles. Values of different sets agree by chance once in 2^LOW_BITS; that bias is taken out.
    Two texts without words are alike, one with and one without words are not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(BINS)
    chance = 1.0 / (1 << LOW_BITS)
    both = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(both)


def in_id_order(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) dealt once into buckets of consecutive ids, and the window in which lead() is the next document by id.

    The first document of each bucket also stands, as a halo row, at the end of the bucket before; the very first one, a lap later, at the
    end of the last. The bounds of the buckets are real ids from one approximate percentile.
    """
    n = docs.count()
    buckets = max(1, min(n // BUCKET_ROWS, 4 * math.isqrt(n)))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = docs.select(key.alias("k")).agg(F.min("k").alias("least"), F.percentile_approx("k", [i / buckets for i in range(1, buckets)] or [1.0], 10 * buckets).alias("cuts")).first()
    bounds = sorted({cuts["least"], *(cuts["cuts"] if buckets > 1 else ())}) if n else [0]
    last = len(bounds) - 1
    group = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + group] for i in range(0, len(bounds), group)]
    #: One literal each, whatever the number of bounds.
    table = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    coarse = F.size(F.filter(heads, lambda b: b <= F.col("_key"))) - 1
    fine = F.size(F.filter(F.get(table, F.col("_coarse")), lambda b: b <= F.col("_key"))) - 1
    rows = docs.withColumn("_key", key).withColumn("_coarse", coarse).withColumn("_bucket", F.col("_coarse") * group + fine)
    head = F.get(F.get(table, F.col("_coarse")), F.col("_bucket") - F.col("_coarse") * group) == F.col("_key")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("lap"), F.lit(False).alias("halo"))
    halo = F.struct(F.when(F.col("_bucket") == 0, F.lit(last)).otherwise(F.col("_bucket") - 1).alias("bucket"), (F.col("_bucket") == 0).cast("int").alias("lap"), F.lit(True).alias("halo"))
    rows = rows.select("doc_id", "text", "_key", F.explode(F.when(head, F.array(own, halo)).otherwise(F.array(own))).alias("_at"))
    return rows.select("doc_id", "text", "_key", "_at.*"), Window.partitionBy("bucket").orderBy("lap", "_key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the head of the next document by id (after the last: the first; alone: itself). A null
    text is empty. Rows of one doc_id follow each other in order of text; null ids come first. Empty table: no rows. Other columns are ignored.
    """
    rows, order = in_id_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))).drop("next_text")
    rows = with_fingerprint(rows, "text", "own")
    rows = rows.withColumn("next", F.lead("own").over(order)).where(~F.col("halo"))
    rows = with_fingerprint(rows, "edited", "other")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("own")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
