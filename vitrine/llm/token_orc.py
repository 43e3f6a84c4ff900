"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by range of id, so files and stripes lie in ascending order of id: readers take stripes in parallel, and a lookup of
ids skips the stripes and row groups whose statistics or Bloom filters rule them out. A document's start is its place within its file,
known when it is written, plus the sum of the files before, one number per file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import read, shared_dir, slices
from vitrine.llm.remember import WordIds, remembers, work_for

END_ID = 1
#: Characters of a long text that are encoded at once.
PIECE = 1 << 20
#: Words in the younger of the two generations that a Python worker remembers.
REMEMBERED = 500_000
#: Rows of one file, about, so that files follow the data.
FILE_ROWS = 200_000
#: A word of lower-case letters that no normalization changes, and the punctuation that ends it.
_PLAIN = re.compile("^([a-zß-öø-ÿ]+)([.,!?;:]*)$", re.M)
#: Words of such letters, digits and ASCII marks, and the pieces that the splitter makes of them.
_LATIN = re.compile("[!-@[-~ß-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")
#: What a tokenizer file must say for its words to be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLITTER}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one of the next free ones."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_BYTE_CHARACTERS = _byte_characters()
_workers: dict[str, "WordEncoder"] = {}
remembers("tokens", _workers.clear)


def encodes_by_word(tokenizer: Any) -> bool:
    """Whether a tokenizer is one whose normalizer and splitter never look across a space, as the fast path takes it to be."""
    said = json.loads(tokenizer.to_str())
    model = said["model"]
    marks = [x["content"] for x in said["added_tokens"]]
    plain = not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in said["added_tokens"]) and all(m.startswith("<|") and " " not in m for m in marks)
    bare = model["type"] == "BPE" and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
    return plain and bare and said["normalizer"] == _NORMALIZER and said["pre_tokenizer"] == _PRE_TOKENIZER and not (said["post_processor"] or said["truncation"] or said["padding"])


class WordEncoder(WordIds):
    """Encodes whole texts with the tokenizers library. Where that allows it, texts are encoded word by word and a worker remembers the
    words' ids."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        super().__init__(remembered)
        #: Spark runs a task on every core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer: Any = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = encodes_by_word(self.tokenizer)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, np.int32).tobytes()

    def _pieces(self, pieces: Iterable[str]) -> None:
        """Learns runs of one kind of character, each a piece to the splitter; pieces are read as mapped bytes."""
        known, older, tokenize = self.known, self.older, self.model.tokenize
        for x in pieces:
            if x in older:
                known[x] = older[x]
            else:
                mapped = x if x.isascii() else "".join(map(_BYTE_CHARACTERS.__getitem__, x.encode()))
                known[x] = array("i", [t.id for t in tokenize(mapped)]).tobytes()

    def learn(self, words: set[str]) -> None:
        known = self.known
        plain = _PLAIN.findall("\n".join(words))
        rest = words.difference([a + b for a, b in plain])
        mixed = [(w, _PIECES.findall(w)) for w in rest if _LATIN.fullmatch(w) and "<|" not in w]
        self._pieces({x for pair in plain for x in pair}.union(*(parts for _, parts in mixed)).difference(known))
        known.update([(a + b, known[a] + known[b]) for a, b in plain if b])
        known.update([(w, b"".join(map(known.__getitem__, parts))) for w, parts in mixed])
        odd = list(rest.difference([w for w, _ in mixed]))
        known.update(zip(odd, self._encode(odd), strict=True))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. Only the distinct words of the texts are looked up one by one."""
        if not self.by_word:
            coded = list(self._encode(texts))
            return np.frombuffer(b"".join(coded), np.int32), np.array([len(x) // 4 for x in coded], np.int64)
        lists = pc.split_pattern(pa.array([_lowered(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        ids, ends = self.of(lists.values)
        return ids, np.diff(np.concatenate([[0], ends])[lists.offsets.to_numpy()])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length. Long ones go in pieces cut at a space, so memory doesn't follow them."""
        if len(text) <= PIECE or not self.by_word:
            return self.encode_all([text])[0]
        parts, start = [], 0
        while start < len(text):
            cut = text.find(" ", start + PIECE)
            end = cut + 1 if cut >= 0 else len(text)
            parts.append(self.encode_all([text[start:end]])[0])
            start = end
        return np.concatenate(parts)


def _lowered(text: str) -> str:
    """The text in lower case if that changes single characters of Latin-1 alone, and no special token can arise by it; else the text."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def splits_at_space(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, kept for later batches and tasks."""
    work_for("tokens")
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


_STORED = "doc_id long, part int, place long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes the ids of docs (doc_id, text), each with END_ID after it, to ORC in ascending order of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = splits_at_space(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                ids, counts = encoder.encode_all(texts) if len(texts) > 1 else ((one := encoder.encode(texts[0])), np.array([len(one)]))
                ids, counts = np.insert(ids, np.cumsum(counts), END_ID), counts + 1
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(rows), part, np.int32)), pa.array(place + ends[:-1]), pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))],
                    ["doc_id", "part", "place", "n_tokens", "ids"],
                )
                place += int(ends[-1])

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // FILE_ROWS)
    #: The heads of texts spread the rows of one id, or of none, over files; they sort as the texts do.
    dealt = docs.repartitionByRange(files, "doc_id", F.substring("text", 1, 8)).sortWithinPartitions("doc_id", "text")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD"}
    dealt.mapInArrow(run, _STORED).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Stored documents: doc_id, part, place, n_tokens, ids; with doc ids given, only those, by stripe statistics and Bloom filters."""
    stored = spark.read.schema(_STORED).orc(path)
    return stored if ids is None else stored.where(F.col("doc_id").isin(ids))


def with_start(stored: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before. Sums are read from one narrow column, and there is one per file, so they are broadcast."""
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("place")).drop("base", "part", "place")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of docs (doc_id, text), read back from ORC: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids).

    A null text is empty and has the end id alone. Rows of one id follow each other in order of text, a null id comes first. Empty table:
    no rows. Other columns are ignored.
    """
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].data) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens").cast(pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    stored = with_start(read_tokens(docs.sparkSession, path))
    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
