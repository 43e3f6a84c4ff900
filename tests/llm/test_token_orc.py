"""Token storage: ids against the library on hostile words, and what the ORC files hold."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vitrine.llm import token_orc
from vitrine.llm.common import shared_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
HARD = ["don't", "THE'S", "École", "naïve...", "ß", "ÀÉÎ,x", "..", ",.", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "x\x1cy", "IİΣ", "ÿ÷×", "12.5", "ª", "º", "µ", "'s", "'t.", "ll.'d", "é", "日本", " ", "\x85", "\t", "\n", "\r\n", " ", "\x00", "ﬁ", "Ǆ", "ΑΣ", "ſ", "Å", "###", "a_b-c", "'re's", "'''s", "\U0001f600", ""]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name: str) -> None:
    from tokenizers import Tokenizer

    rng, alphabet = random.Random(3), "abzABZßäÖé'.,!?;:#-0129<|> \n\t́Σ日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(6000)]
    texts += [rng.choice(["", " ", "\n"]).join(rng.choices(HARD, k=rng.randrange(1, 7))) for _ in range(4000)]
    own, library = token_orc.WordEncoder(public_tokenizers.path(name), remembered=500), Tokenizer.from_file(public_tokenizers.path(name))
    assert own.by_word == (name == "word_bpe_49k.json")
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # afresh, and from what is remembered
        for i in range(0, len(texts), 100):
            ids, counts = own.encode_all(texts[i : i + 100])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[i : i + 100]
    assert [own.encode(t).tolist() for t in texts[-300:]] == want[-300:]


def test_long_text_in_pieces(monkeypatch) -> None:
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_orc, "PIECE", 50)
    text = " ".join(HARD * 20)
    assert token_orc.WordEncoder(WORDS).encode(text).tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_files_hold_bloom_filters_and_row_indexes(spark) -> None:
    path = f"{shared_dir(spark)}/orc-footers"
    docs = spark.range(40_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    token_orc.write_tokens(docs, path, WORDS)
    jvm, conf, rows = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for status in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        if not status.getPath().getName().endswith(".orc"):
            continue
        reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        ids = reader.getSchema().getFieldNames().indexOf("doc_id") + 1
        recorded = reader.rows()
        for stripe in reader.getStripes():
            rows += stripe.getNumberOfRows()
            streams = [(s.getColumn(), s.getKind().toString()) for s in recorded.readStripeFooter(stripe).getStreamsList()]
            assert (ids, "BLOOM_FILTER_UTF8") in streams and all((ids, kind) in streams for kind in ("ROW_INDEX", "DATA"))
            assert {c for c, kind in streams if kind.startswith("BLOOM")} == {ids}
        recorded.close()
    assert rows == 40_000

    def scanned(ids: list[int]) -> tuple[int, int]:
        found = token_orc.read_tokens(spark, path, ids)
        n = len(found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        return n, next(int(x.metrics().apply("numOutputRows").value()) for x in _nodes(plan) if x.nodeName().startswith("Scan"))

    #: One group of 1,000 rows of 40,000 for an id that is there; an id that statistics allow but Bloom filters rule out costs next to none.
    assert scanned([3 * 777]) == (1, 1000)
    absent = [scanned([3 * i + 1]) for i in range(100, 39_000, 3000)]
    assert all(n == 0 for n, _ in absent) and sum(read for _, read in absent) <= 3000


def _nodes(plan) -> list:
    children = plan.children()
    return [plan, *(x for i in range(children.size()) for x in _nodes(children.apply(i)))]
