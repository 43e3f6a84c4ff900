"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's pieces are the segmentation of greatest total score; of equals, the one that a single pass from left to right settles for. A
document of CHUNK characters or more is cut into chunks that any executor can work on. Between chunks, the state is how far the last piece
of one chunk reaches into the next. Each chunk yields the matrix of best scores from every entering to every leaving state; the max-plus
product of such matrices is associative, so a tree of products gives the scores of all states at every boundary. With these, a chunk
goes on as the single pass would, and yields the entering state for each leaving one; these maps, composed by a tree from the right, give
the state at every boundary, and each chunk is then traced back by itself. So the ids don't depend on where a text is cut.

No piece reaches from a word into the space before the next, so what lies between the first and the last word's end inside a chunk adds the
same to all entries of its matrix and is left out of it, and its pieces are those of whole words, which workers remember.

The vocabulary is a public one with byte fallback; a piece's score is the logarithm of a Zipf probability of its rank, in millionths, so
sums are exact. Decoding gives back every text exactly: a character that the vocabulary uses for spaces is itself encoded by bytes.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import join_checked, read, slices, staged
from vitrine.llm.langid import default_tokenizer
from vitrine.llm.pieces import SPACE, vocabulary
from vitrine.llm.remember import WordIds, remembers, work_for

CHUNK = 1 << 15
#: Chunks or products of chunks that one group of the scan holds.
BLOCK = 64
#: Words in the younger of the two generations that a Python worker remembers.
REMEMBERED = 200_000
#: Words of more characters are segmented one by one.
TABLED = 64
#: Stands for a space mark that is in the text itself; no valid text has a lone surrogate.
LITERAL = "\udc81"
NEVER = -(1 << 60)
_UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Segmenter(WordIds):
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        super().__init__(remembered)
        self.vocab = vocabulary(path)
        self.states = self.vocab.longest
        first = min(self.vocab.ids.values())
        self.score = np.zeros(self.vocab.size, np.int64)
        for i in range(self.vocab.size):
            rank = i - first + 1 if i >= first else self.vocab.size
            self.score[i] = -round(1e6 * (math.log(rank) + math.log(math.log(self.vocab.size))))
        self.scores = self.score.tolist()
        self.text_of = [p.replace(SPACE, " ").encode() for p in self.vocab.pieces]
        for b, i in self.vocab.bytes.items():
            self.text_of[i] = bytes([b])

    def bytes_of(self, c: str) -> list[int]:
        return [self.vocab.bytes[b] for b in (SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass")]

    def _pieces_at(self, text: str, i: int) -> list[tuple[int, int, list[int]]]:
        """(end, score, ids) of what can start at i."""
        get, out = self.vocab.ids.get, []
        for j in range(i + 1, min(len(text), i + self.states) + 1):
            if (p := get(text[i:j])) is not None:
                out.append((j, self.scores[p], [p]))
        if get(text[i]) is None:
            ids = self.bytes_of(text[i])
            out.append((i + 1, sum(self.scores[p] for p in ids), ids))
        return out

    def _forward(self, text: str, seeds: list[int], end: int, owned: int) -> tuple[list[int], list[tuple[int, list[int]] | None]]:
        """Best score and last step of each place up to end, by pieces that start before owned, from the scores of the first places; a
        place that no piece improves on has no step. Of equals, the longest last piece."""
        best = [*seeds[: end + 1], *[NEVER] * (end + 1 - len(seeds))]
        back: list[tuple[int, list[int]] | None] = [None] * (end + 1)
        for i in range(min(end, owned)):
            if best[i] == NEVER:
                continue
            for j, s, ids in self._pieces_at(text, i):
                if j <= end and best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, ids)
        return best, back

    def best(self, text: str, start: int, end: int, owned: int) -> tuple[int, list[int]]:
        """Score and ids of the best pieces from start to end, all of which start before owned."""
        best, back = self._forward(text[start : end + self.states], [0], end - start, owned - start)
        out, at = [], end - start
        while (step := back[at]) is not None:
            at, ids = step
            out.append(ids)
        return (best[end - start], [p for ids in reversed(out) for p in ids]) if at == 0 else (NEVER, [])

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) <= TABLED and self.vocab.covers(w):
                by_length.setdefault(len(w), []).append(w)
            else:
                self.known[w] = np.array(self.best(w, 0, len(w), len(w))[1], np.int32).tobytes()
        for some in by_length.values():
            self.known.update(zip(some, self.vocab.trie.best(some, self.score), strict=True))

    def words(self, units: list[str]) -> bytes:
        return self.of(units)[0].tobytes()

    def cut(self, core: int, text: str) -> tuple[list[str], int, int]:
        """The whole words of a chunk of `core` characters, whose text goes on a little; where the first starts and the last ends.
        (-1, -1) if the chunk has no word's end inside."""
        units = _UNITS.findall(text)
        ends = np.cumsum([len(u) for u in units])
        inside = int(np.searchsorted(ends, core, side="right"))
        #: The last end is only known to be one if text goes on after it.
        if inside == len(units) and inside and len(text) > core:
            inside -= 1
        if not inside:
            return [], -1, -1
        return units[1:inside], int(ends[0]), int(ends[inside - 1])

    def matrix(self, core: int, text: str) -> np.ndarray:
        """Best scores from each entering state (characters already covered) to each leaving one (characters covered beyond core), up to a
        number that is the same for all of them."""
        words, first, last = self.cut(core, text)
        if first < 0:
            return self._span(text, 0, core, core)
        head = self._span(text, 0, first, first)[:, 0]
        tail = self._span(text, last, core, core)[0]
        out = head[:, None] + tail[None, :]
        out[(head == NEVER)[:, None] | (tail == NEVER)[None, :]] = NEVER
        return out

    def _span(self, text: str, start: int, end: int, owned: int) -> np.ndarray:
        """[entering, leaving] from start + i to end + j by pieces that start before owned."""
        n = self.states
        scores = np.full((end - start + n, n), NEVER, np.int64)
        for i in range(min(n, len(scores))):
            scores[i, i] = 0
        for i in range(start, end):
            row = scores[i - start]
            if row.max() == NEVER:
                continue
            for j, s, _ in self._pieces_at(text, i):
                if j - start < len(scores):
                    np.maximum(scores[j - start], np.where(row == NEVER, NEVER, row + s), out=scores[j - start])
        out = np.full((n, n), NEVER, np.int64)
        tail = scores[end - start : end - start + n]
        out[:, : len(tail)] = tail.T
        #: Entering beyond the end isn't a path of this span unless the end is where it leaves.
        return out

    def entering(self, core: int, text: str, scores: np.ndarray) -> np.ndarray:
        """For each leaving state, the entering one that the single pass came from, given the scores of the entering states."""
        words, first, last = self.cut(core, text)
        end = core + self.states - 1 if first < 0 else first
        _, back = self._forward(text, scores.tolist(), end, core if first < 0 else first)

        def origin(at: int) -> int:
            while (step := back[at]) is not None:
                at = step[0]
            return at

        out = np.array([origin(core + j) for j in range(self.states)] if first < 0 else [origin(first)] * self.states, np.int64)
        return np.where(out < self.states, out, 0)  # a state that no path leaves by isn't used

    def trace(self, core: int, text: str, entering: int, leaving: int) -> bytes:
        words, first, last = self.cut(core, text)
        if first < 0:
            return np.array(self.best(text, entering, core + leaving, core)[1], np.int32).tobytes()
        head = np.array(self.best(text, entering, first, first)[1], np.int32).tobytes()
        tail = np.array(self.best(text, last, core + leaving, core)[1], np.int32).tobytes()
        return head + self.words(words) + tail

    def decode(self, ids: np.ndarray) -> str:
        parts = [b"".join(map(self.text_of.__getitem__, ids[i : i + (1 << 20)].tolist())) for i in range(0, len(ids), 1 << 20)]
        return b"".join(parts)[1:].decode("utf-8", "surrogatepass")


def prepared(text: str) -> str:
    """The text as the vocabulary has it: a space before it, and marks for spaces; empty if it is empty."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(out > NEVER // 2, out, NEVER)


def advanced(scores: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The scores of the states after a chunk from those before it; the greatest is 0, as only differences count."""
    out = product(scores[None, :], matrix)[0]
    return np.where(out > NEVER // 2, out - out.max(), NEVER)


_segmenters: dict[str, Segmenter] = {}
remembers("pieces", _segmenters.clear)


def segmenter(path: str) -> Segmenter:
    """The worker's segmenter for a vocabulary file, kept for later batches and tasks."""
    work_for("pieces")
    if path not in _segmenters:
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


def _lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _encode_short(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(tokenizer)
        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                units = [_UNITS.findall(prepared(t or "")) for t in rows.column("text").to_pylist()]
                ids, ends = own.of([u for some in units for u in some])
                offsets = np.concatenate([[0], ends])[np.cumsum([0, *map(len, units)])]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def _chunks(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """row, doc_id, seq, core, text of each chunk; text goes on by as many characters as a piece can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = segmenter(tokenizer).states
        for batch in batches:
            for k in range(len(batch)):
                row, doc, text = (batch.column(c)[k].as_py() for c in ("row", "doc_id", "text"))
                text = prepared(text)
                for first in range(0, len(text), 64 * size):
                    at = range(first, min(len(text), first + 64 * size), size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(at), pa.int64()), pa.array([doc] * len(at), pa.int64()), pa.array([i // size for i in at], pa.int64()),
                            pa.array([min(size, len(text) - i) for i in at], pa.int32()), pa.array([text[i : i + size + ahead].encode("utf-8", "surrogatepass") for i in at], pa.binary()),
                        ],
                        ["row", "doc_id", "seq", "core", "text"],
                    )

    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, seq long, core int, text binary")


def scanned(items: DataFrame, combine: Callable, step: Callable, start: np.ndarray, from_right: bool = False) -> DataFrame:
    """row, seq, state: the state before each item (row, seq, item) of a row, the first one's being start. Items and states are int64 bytes.

    A tree of products: BLOCK items at a time give one item of the next level, until a level has no row of more; then the states go back
    down. No task holds more than BLOCK items at once, however long a row is.
    """

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values("seq", ascending=not from_right)

    def combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = functools.reduce(combine, [np.frombuffer(x, np.int64) for x in ordered(rows)["item"]])
        return pd.DataFrame({"row": [key[0]], "seq": [key[1]], "item": [found.tobytes()]})

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(rows)
        states = [np.frombuffer(rows["before"].iloc[0], np.int64)]
        for x in rows["item"].iloc[:-1]:
            states.append(step(states[-1], np.frombuffer(x, np.int64)))
        return pd.DataFrame({"row": rows["row"], "seq": rows["seq"], "state": [x.tobytes() for x in states]})

    block = F.expr(f"seq DIV {BLOCK}").alias("block")
    levels = [items]
    while not levels[-1].where(F.col("seq") >= BLOCK).isEmpty():
        levels.append(staged(levels[-1].groupBy("row", block).applyInPandas(combined, "row long, seq long, item binary"), "sp-level"))
    before = None
    for level in reversed(levels):
        rows = level.withColumn("block", block)
        rows = rows.withColumn("before", F.lit(start.tobytes())) if before is None else rows.join(before.select("row", F.col("seq").alias("block"), F.col("state").alias("before")), ["row", "block"])
        before = rows.groupBy("row", "block").applyInPandas(spread, "row long, seq long, state binary")
        before = staged(before, "sp-states")
    return before


def _encode_long(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    chunks = staged(_chunks(docs, tokenizer, size).repartition("row", "seq"), "sp-chunks")
    n = segmenter(tokenizer).states

    def per_chunk(f: Callable[..., bytes]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = segmenter(tokenizer)
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("core", "text", *batch.schema.names[4:])]
                out = [f(own, core, text.decode("utf-8", "surrogatepass"), *more) for core, text, *more in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seq"), pa.array(out, pa.binary())], ["row", "seq", "item"])

        return run

    def with_state(name: str, states: DataFrame) -> DataFrame:
        return join_checked(chunks, states.withColumnRenamed("state", name), ["row", "seq"], "inner").select("row", "seq", "core", "text", name)

    items = "row long, seq long, item binary"
    square = lambda x: x.reshape(n, n)
    matrices = staged(chunks.select("row", "seq", "core", "text").mapInArrow(per_chunk(lambda own, core, text: own.matrix(core, text).tobytes()), items), "sp-matrices")
    first = np.where(np.arange(n) == 0, 0, NEVER)
    scores = scanned(matrices, lambda a, b: product(square(a), square(b)).ravel(), lambda v, m: advanced(v, square(m)), first)
    maps = with_state("scores", scores).mapInArrow(per_chunk(lambda own, core, text, v: own.entering(core, text, np.frombuffer(v, np.int64)).tobytes()), items)
    #: A map composed with the one of the chunk to its left; the state after the last chunk is 0.
    leaving = scanned(staged(maps, "sp-maps"), lambda a, b: b[a], lambda state, m: m[state], np.zeros(1, np.int64), from_right=True)
    number = lambda c: F.conv(F.hex(F.reverse(c)), 16, 10).cast("int")
    left = leaving.select("row", "seq", number(F.col("state")).alias("leaving"))
    states = left.join(left.select("row", (F.col("seq") + 1).alias("seq"), F.col("leaving").alias("entering")), ["row", "seq"], "left").fillna(0, ["entering"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(tokenizer)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("core", "text", "entering", "leaving")]
            coded = [own.trace(c, t.decode("utf-8", "surrogatepass"), i, j) for c, t, i, j in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "seq")), _lists(coded)], ["row", "doc_id", "seq", "ids"])

    parts = join_checked(chunks, staged(states, "sp-boundaries"), ["row", "seq"], "inner").mapInArrow(traced, "row long, doc_id long, seq long, ids array<int>")
    whole = parts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, tokenizer: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids. A null text is empty and has no ids; repeated rows stay; no rows give none; other
    columns are ignored. Texts of `chunk` characters or more go in chunks, with the same ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") >= chunk, F.lit(False))
    return _encode_short(docs.where(~long), tokenizer).unionByName(_encode_long(docs.where(long), tokenizer, chunk))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(tokenizer)
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for first in range(0, len(batch), 200):
                spans = [values[a:b] for a, b in zip(ends[first : first + 200], ends[first + 1 : first + 201], strict=False)]
                rows = batch.slice(first, 200)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(map(len, spans), pa.int64()), pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in spans], pa.int64()), pa.array([own.decode(s) for s in spans], pa.string())],
                    ["doc_id", "n_pieces", "ids_crc32", "text"],
                )

    return encoded.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_pieces, ids_crc32, and the code points and digest of the text decoded."""
    tokenizer = default_tokenizer()
    back = decode(encode(read(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))
