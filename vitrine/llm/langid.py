"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A text's likelihood is the sum over all its segmentations
into pieces, found by the forward algorithm. Only letters tell a language, so a text is its runs of letters, of any length, each after a
space; its likelihood is their product, and a worker remembers the words it has seen. The probabilities come from two rounds of
expectation-maximisation over the word counts of the labelled texts, each round one Spark job whose result is one number per language and
piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import join_checked, read, slices, staged
from vitrine.llm.pieces import SPACE, Lattice, by_cells, total_of_long, vocabulary
from vitrine.llm.remember import distinct_words, remembers, work_for

#: Labelled documents of each language that the fit reads, about; chosen by a hash of their ids among all.
FIT_DOCUMENTS = 1000
ROUNDS = 2
SMOOTHING = 0.1
#: Evidence beyond so many words doesn't raise the score further.
SCORE_WORDS = 30
UNDETERMINED = "und"
#: Languages that a task holds the model of (256 KB each) at once; more are learned and scored in blocks, with the same result.
LANGUAGES_AT_ONCE = 200
#: Words in the younger of the two generations that a Python worker remembers, which bounds memory and changes no result.
REMEMBERED = 200_000
#: Cells of a table of words by positions that are summed at once; longer words than LONG are scored a block at a time.
CELLS, LONG = 40_000, 8192
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    tokenizer: str
    languages: list[str]
    log_p: np.ndarray  # [piece, language]
    more: Model | None = None  # of the next languages in order


def split_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def fit(docs: DataFrame, tokenizer: str, label: str = "lang", fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Learns from the rows of docs (doc_id, text, label) that have all three. A word takes memory in proportion to its length."""
    known = docs.select("doc_id", "text", F.col(label).alias("label")).where("doc_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages, vocab, model = sorted(counts), vocabulary(tokenizer), None
    blocks = [languages[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(languages), LANGUAGES_AT_ONCE)]
    if not blocks:
        return Model(tokenizer, [], np.zeros((vocab.size, 0)))
    shares = known.sparkSession.createDataFrame([(k, min(1.0, fit_documents / n)) for k, n in counts.items()], known.select("label").schema.add("share", "double"))
    chosen = join_checked(known, shares, ["label"], "inner").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < 1_000_000 * F.col("share")).select("label", "text")
    words = staged(_word_counts(chosen).groupBy("label", "word").agg(F.sum("n").alias("n")), "langid-words")
    for block in reversed(blocks):
        #: A language is learned from its own words alone, so blocks don't depend on one another.
        own, log_p = words.where(F.col("label").isin([str(k) for k in block])), np.full((vocab.size, len(block)), -np.log(vocab.size))
        for _ in range(ROUNDS):
            expected = np.full(log_p.shape, SMOOTHING)
            for r in _expected(own, Model(tokenizer, block, log_p)).groupBy("language", "piece").agg(F.sum("n").alias("n")).collect():
                expected[r["piece"], r["language"]] += r["n"]
            log_p = np.log(expected / expected.sum(axis=0))
        model = Model(tokenizer, block, log_p, model)
    return model


def _word_counts(texts: DataFrame) -> DataFrame:
    """label, word, n: counts of words within batches of texts (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                found = Counter()
                for label, text in zip(rows.column("label").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    found.update((label, w) for w in split_words(text))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(found.values(), pa.int64())], ["label", "word", "n"])

    return texts.select(F.col("label").cast("string").alias("label"), "text").mapInArrow(run, "label string, word string, n long")


def _expected(words: DataFrame, model: Model) -> DataFrame:
    """Expected uses of each piece over all segmentations of the words (label, word, n)."""
    place = {str(k): i for i, k in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, out = vocabulary(model.tokenizer), np.zeros(model.log_p.shape)
        for batch in batches:
            all_words = [SPACE + w for w in batch.column("word").to_pylist()]
            languages, counts = np.array([place[x] for x in batch.column("label").to_pylist()], np.int64), batch.column("n").to_numpy()
            for some in by_cells(np.fromiter(map(len, all_words), np.int64, len(all_words)), CELLS):
                lattice = Lattice(vocab, [all_words[i] for i in some])
                own = languages[some][lattice.word]
                weights = model.log_p[lattice.pieces, own][:, None]
                alpha, beta = lattice.forward(weights), lattice.backward(weights)
                through = alpha[lattice.word, lattice.starts, 0] + weights[:, 0] + beta[lattice.word, lattice.ends, 0] - beta[lattice.word, 0, 0]
                np.add.at(out, (lattice.pieces, own), np.exp(through) * counts[some][lattice.word])
        piece, language = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(out[piece, language])], ["language", "piece", "n"])

    return words.mapInArrow(run, "language int, piece int, n double")


class _Scorer:
    """Log likelihoods of words by language, remembered in two generations."""

    def __init__(self, model: Model, remembered: int = REMEMBERED) -> None:
        self.vocab, self.model, self.remembered = vocabulary(model.tokenizer), model, remembered
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.scores = self.old_scores = np.zeros((0, len(model.languages)))

    def _add(self, words: list[str], scores: np.ndarray) -> None:
        need = len(self.known) + len(words)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(need, 2 * len(self.scores), 1024) - len(self.scores), scores.shape[1]))])
        self.scores[len(self.known) : need] = scores
        self.known.update(zip(words, range(len(self.known), need), strict=True))

    def _scored(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for some in by_cells(lengths, CELLS):
            if lengths[some[0]] > LONG:
                out[some] = total_of_long(self.vocab, SPACE + words[some[0]], self.model.log_p)
                continue
            lattice = Lattice(self.vocab, [SPACE + words[i] for i in some])
            out[some] = lattice.total(self.model.log_p[lattice.pieces])
        return out

    def of(self, words: list[str]) -> np.ndarray:
        """The scores of distinct words: [word, language]."""
        places = list(map(self.known.get, words))
        if None in places:
            if len(self.known) > self.remembered:
                self.older, self.old_scores = self.known, self.scores
                self.known, self.scores = {}, self.scores[:0]
                places = [None] * len(words)
            new = [w for w, p in zip(words, places, strict=True) if p is None]
            met = [w for w in new if w in self.older]
            self._add(met, self.old_scores[[self.older[w] for w in met]])
            rest = [w for w in new if w not in self.known]
            self._add(rest, self._scored(rest))
            places = [self.known[w] if p is None else p for w, p in zip(words, places, strict=True)]
        return self.scores[places]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each whole text by language, and its words; a text without letters has none."""
        words, counts, letters = [], [], []
        for t in texts:
            own = split_words(t)
            #: A run of what isn't a letter though the pattern takes it (such as a raised two) tells nothing.
            letters.append(any(w[0].isalpha() or any(map(str.isalpha, w)) for w in own))
            words += own
            counts.append(len(own))
        distinct, at = distinct_words(words)
        scores, text = self.of(distinct)[at], np.repeat(np.arange(len(texts)), counts)
        total = np.stack([np.bincount(text, scores[:, k], len(texts)) for k in range(scores.shape[1])], axis=1)
        return total, np.array(counts) * np.array(letters)


_scorers: dict[int, tuple[bytes, _Scorer]] = {}
remembers("language", _scorers.clear)


def _scorer(model: Model) -> _Scorer:
    """The worker's scorer for this model, kept between tasks."""
    work_for("language")
    key = model.log_p.tobytes()
    if 0 not in _scorers or _scorers[0][0] != key:
        _scorers[0] = (key, _Scorer(model))
    return _scorers[0][1]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) of every whole text; input columns of these names are replaced.

    A null text, one without letters, or a model that learned no language gives `und` and 0. Ties go to the first language in order.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows, blocks = docs.select(*kept), [model]
    while blocks[-1].more is not None:
        blocks.append(blocks[-1].more)
    for k, block in enumerate(blocks):
        rows = _scored_by(rows, kept, replace(block, more=None), text, k == 0, k == len(blocks) - 1)
    return rows


def _scored_by(docs: DataFrame, kept: list[str], block: Model, text: str, first: bool, last: bool) -> DataFrame:
    """docs (columns kept, and if this isn't the first block what the blocks before found) with what they and this block find: the best
    language, its likelihood and the sum of all posteriors against it; after the last block, lang_pred and score."""
    spark = docs.sparkSession
    schema = docs.select(*kept).schema
    schema = schema.add("lang_pred", "string").add("score", "double") if last else schema.add("_best", "string").add("_top", "double").add("_sum", "double")
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _scorer(model)
        for batch in batches:
            for rows in slices(batch, text):
                n = len(rows)
                best = [UNDETERMINED] * n if first else rows.column("_best").to_pylist()
                top, total = (np.full(n, -np.inf), np.zeros(n)) if first else (rows.column(c).to_numpy().copy() for c in ("_top", "_sum"))
                if model.languages:
                    totals, counts = scorer.texts([t or "" for t in rows.column(text).to_pylist()])
                    found = np.flatnonzero(counts)
                    own = totals[found]
                    highest = np.maximum(own.max(axis=1), top[found])
                    temper = np.minimum(1.0, SCORE_WORDS / counts[found])
                    with np.errstate(invalid="ignore"):
                        before = np.where(total[found] > 0, total[found] * np.exp((top[found] - highest) * temper), 0.0)
                    total[found] = before + np.exp((own - highest[:, None]) * temper[:, None]).sum(axis=1)
                    for i, k, better in zip(found.tolist(), own.argmax(axis=1).tolist(), (own.max(axis=1) > top[found]).tolist(), strict=True):
                        best[i] = model.languages[k] if better else best[i]
                    top[found] = highest
                own = [pa.array(best, pa.string())]
                own += [pa.array(np.divide(1.0, total, out=np.zeros(n), where=total > 0))] if last else [pa.array(top), pa.array(total)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *own], [*kept, *schema.names[len(kept) :]])

    return docs.mapInArrow(run, schema)


def held_out(docs: DataFrame) -> DataFrame:
    """Adds held_out: whether crc32 of the id as text leaves 2 modulo 4; a null id isn't held out, nor learned from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = fit(docs.where("NOT held_out"), default_tokenizer())
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
