"""Near-duplicates, language ID, SentencePiece, token storage and HTML extraction."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import reference
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from vitrine.llm import common, html_tpr, langid, neardup, pieces, sp_maxplus, token_orc, wordhash
from vitrine.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = langid.default_tokenizer()


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def check_near(spark, docs, k: int) -> None:
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == reference.near_duplicates(docs, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(docs)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k: int) -> None:
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    near = []
    for i in range(60):  # a group whose members lie on either side of the threshold
        w = list(base)
        for j in rng.sample(range(60), rng.randrange(0, 6)):
            w[j] = f"x{i}_{j}"
        near.append((1000 + i, " ".join(w)))
    short = [(2000, "a"), (2001, "A"), (2002, "a b"), (2003, "a  b\n"), (2004, "b a"), (2005, ""), (2006, None), (2007, " \t")]
    check_near(spark, documents(spark)[:120] + near + short, k)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_of_hot_groups(spark, monkeypatch, k: int) -> None:
    """Every way that joins of large groups take, and texts of few words that share common shingles, with a small bound."""
    monkeypatch.setattr(neardup, "HOT", 3)
    rng, docs = random.Random(k), []
    for i in range(40):  # one class of copies, and near copies of it
        docs += [(i, "one two three four five six seven eight nine ten"), (100 + i, " ".join(f"w{j}" if j != i else f"x{j}" for j in range(80)))]
    docs += [(200 + i, " ".join(rng.choices("abc", k=rng.randrange(4, 30)))) for i in range(150)]
    docs += [(400 + i, " ".join(rng.choices([f"v{j}" for j in range(12)], k=60))) for i in range(60)]
    docs += [(600 + i, None) for i in range(10)]
    check_near(spark, docs, k)
    #: Prefix filtering alone finds every linked pair of different texts.
    sets = {i: reference.shingle_set(t, k) for i, t in docs}
    table = common.staged(neardup.shingle_sets(spark.createDataFrame([d for d in docs if sets[d[0]]], "doc_id long, text string"), k), "sets-test")
    found = neardup._prefix_pairs(common.staged(table.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("component")), "nodes"), table)
    found = {(r["a"], r["b"]) for r in found.collect()}
    ids = sorted(i for i in sets if sets[i])
    assert all((a, b) in found for b in ids for a in ids if a > b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))


def test_near_duplicates_odd(spark, odd) -> None:
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(8, 1, True)] * 2 and by[2] == [(8, 1, False)] and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)]
    assert all(c is None and kept for _, c, kept in by[None])
    assert neardup.near_duplicates(odd.where("false")).count() == 0


def test_sketch_estimates_similarity() -> None:
    rng = np.random.default_rng(1)
    for n, shared in ((3, 2), (40, 30), (2000, 1200)):
        hits = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = neardup.sketch(x[:n]), neardup.sketch(x[n - shared :])
            assert a.max() != neardup._NONE
            hits.append((a == b).mean())
        assert abs(np.mean(hits) - shared / (2 * n - shared)) < 0.06


def test_word_hashes() -> None:
    import pyarrow as pa

    texts = ["Ab ab\tAB", None, "", "x" * 10, " é\x0bé ", "a" * (wordhash.PIECE + 5) + " b " + "c " * wordhash.PIECE]
    got = list(wordhash.word_hashes(pa.array(texts).slice(0), lower=True))
    assert [len(g) for g in got] == [len(reference.words(t)) for t in texts]
    assert got[0][0] == got[0][1] == got[0][2] and got[4][0] == got[4][1] and got[5][1] != got[5][2]
    sliced = list(wordhash.word_hashes(pa.array(texts).slice(3, 2), lower=True))
    assert all((a == b).all() for a, b in zip(got[3:5], sliced, strict=True))


def test_language_forward_sums_all_segmentations() -> None:
    vocab = pieces.vocabulary(PIECES)
    log_p = np.log(np.random.default_rng(0).dirichlet(np.ones(vocab.size), 2).T + 1e-12)

    def brute(symbols: list) -> np.ndarray:
        if not symbols:
            return np.zeros(2)
        out = np.full(2, -np.inf)
        for j in range(1, min(vocab.longest, len(symbols)) + 1):
            head = symbols[:j]
            p = head[0] if isinstance(head[0], int) and j == 1 else vocab.ids.get("".join(head)) if all(isinstance(c, str) for c in head) else None
            if p is not None:
                out = np.logaddexp(out, log_p[p] + brute(symbols[j:]))
        return out

    words = ["▁hello", "▁élan", "▁日本", "▁x😀y"]
    lattice = pieces.Lattice(vocab, words)
    assert np.allclose(lattice.total(log_p[lattice.pieces]), [brute(vocab.symbols(w)) for w in words])
    long = pieces.Lattice(vocab, ["▁" + "😀" * 150, "▁a"])
    assert np.isfinite(long.total(log_p[long.pieces])).all()


def test_language_held_out(spark) -> None:
    docs = langid.held_out(spark.read.parquet(f"{SF}/documents.parquet"))
    model = langid.fit(docs.where("NOT held_out"), PIECES)
    rows = langid.identify(docs, model).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    crc = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r["held_out"] == crc(r["doc_id"]) for r in docs.collect())


def test_language_odd(spark, odd) -> None:
    model = langid.fit(odd, PIECES)
    assert model.languages == ["de", "en"]
    out = langid.identify(odd, model)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns == ["doc_id", "text", "lang", "source", "key", "lang_pred", "score"]
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    none = langid.fit(odd.where("false"), PIECES)
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(odd.where("false"), model).count() == 0


def unigram_library(own: sp_maxplus.Segmenter) -> SentencePieceProcessor:
    m = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, x in enumerate(m.pieces):
        if x.type in (1, 4):
            x.score, x.type = own.scores[i] / 1e6, 1
        elif x.type == 6:
            x.score = 0
    return SentencePieceProcessor(model_proto=m.SerializeToString())


def chunked(own: sp_maxplus.Segmenter, text: str, size: int) -> np.ndarray:
    x = sp_maxplus.prepared(text)
    parts = [(min(size, len(x) - i), x[i : i + size + own.states]) for i in range(0, len(x), size)]
    scores, maps, states = [np.where(np.arange(own.states) == 0, 0, sp_maxplus.NEVER)], [], [0]
    for p in parts:
        maps.append(own.entering(*p, scores[-1]))
        scores.append(sp_maxplus.advanced(scores[-1], own.matrix(*p)))
    for m in reversed(maps):
        states.append(int(m[states[-1]]))
    states.reverse()
    return np.frombuffer(b"".join(own.trace(c, t, a, b) for (c, t), a, b in zip(parts, states[:-1], states[1:], strict=True)), np.int32)


def test_pieces_are_the_best_segmentation(spark) -> None:
    own = sp_maxplus.Segmenter(PIECES)
    library, score = unigram_library(own), lambda ids: sum(own.scores[i] for i in ids)
    for _, text in documents(spark)[:60]:
        ids = np.frombuffer(own.words(sp_maxplus._UNITS.findall(sp_maxplus.prepared(text))), np.int32)
        #: The library adds up 32-bit floats, so over a long text it may settle for a little less than the best.
        other = score(library.encode(text))
        assert own.decode(ids) == text and 0 <= score(ids) - other <= 1e-7 * abs(other)
        for size in (5, 17, 60):
            part = text[:300]
            whole = np.frombuffer(own.words(sp_maxplus._UNITS.findall(sp_maxplus.prepared(part))), np.int32)
            cut = chunked(own, part, size)
            assert own.decode(cut) == part and (cut == whole).all()
    for text in ("  a▁b\n\n  \tc ", "日本語😀" * 30, "x" * 300, " " * 40 + "b", "▁▁", "\x00\n", "banana" * 40, "ababab " * 20 + "e" * 150):
        for size in (5, 16, 40):
            whole = np.frombuffer(own.words(sp_maxplus._UNITS.findall(sp_maxplus.prepared(text))), np.int32)
            assert own.decode(chunked(own, text, size)) == text and (chunked(own, text, size) == whole).all()


def test_max_plus_product_is_associative() -> None:
    a, b, c = np.random.default_rng(0).integers(-50, 0, (3, 4, 4))
    assert (sp_maxplus.product(sp_maxplus.product(a, b), c) == sp_maxplus.product(a, sp_maxplus.product(b, c))).all()


def test_ids_do_not_depend_on_chunks(spark, odd) -> None:
    """Chunks far smaller than words, and documents of more chunks than one group of the scan holds."""
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id % 16 = 0 AND length(text) < 4000")
    more = spark.createDataFrame([(-1, "xy" * 3000 + " end"), (-2, "日本語" * 500)], "doc_id long, text string")
    docs = common.staged(odd.select("doc_id", "text").union(sf).union(more), "chunk-test")
    want = sorted(map(tuple, sp_maxplus.encode(docs, PIECES).collect()), key=str)
    for chunk in (17, 64, 1000):
        assert sorted(map(tuple, sp_maxplus.encode(docs, PIECES, chunk).collect()), key=str) == want


def test_pieces_in_spark(spark, odd) -> None:
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    for chunk in (sp_maxplus.CHUNK, 1000):
        back = sp_maxplus.decode(sp_maxplus.encode(odd, PIECES, chunk), PIECES).collect()
        assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == texts
    assert sp_maxplus.encode(odd.where("false"), PIECES).count() == 0


def test_token_table(spark, odd) -> None:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    for docs in (odd.select("doc_id", "text", "key"), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, (r[1] or "").encode())))
        want, start = [], 0
        for doc, text in rows:
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, token_table(docs)), key=str) == sorted(want, key=str)
    assert not token_table(odd.where("false"))


def token_table(docs) -> list:
    return token_orc.token_table(docs, TOKENIZER).collect()


def test_token_lookup_and_splitting(spark, odd) -> None:
    path = f"{shared_dir(spark)}/lookup"
    token_orc.write_tokens(odd.where("doc_id IS NOT NULL"), path, TOKENIZER)
    found = token_orc.read_tokens(spark, path, [6, 7])
    assert {r["doc_id"] for r in found.collect()} == {6, 7}
    assert "PushedFilters: [In(doc_id, [6,7])]" in found._jdf.queryExecution().toString()
    from tokenizers import Tokenizer

    own, library = token_orc.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in ("Don't it's THE'S École!!! naïve... ß ÀÉÎ,x .. ,.", "<|endoftext|> a<|endoftext|>b o'clock x\x1cy IİΣ ÿ÷× 12.5, a,b", "ª º µ ñandú, 's 't. ll.'d é 日本", "a b c"):
        assert list(np.frombuffer(own.encode(text), np.int32)) == library.encode(text, add_special_tokens=False).ids


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>no</article>";</script><style>p{}</style></head><body class="page header-on"><header><h2>Site</h2></header>
<div class="cookie-notice">We use cookies, yes.</div><nav><ul><li>Menu</ul></nav><div id="sidebar"><p>Links, more, text.</p></div>
%s<section id="comments"><h3>Comments</h3><p>Great text, really, a long comment. It goes on, and on.</p></section><footer>&copy; me</footer></body></html>"""
BODY = """<h1>Title &amp; more</h1><!-- x --><p>First  paragraph,
 with <a href=x>a link</a> and <b>bold</b>, long enough.<p>Short.<aside>Related</aside><form>Name <input></form><div class="advert">Buy</div><ul><li>One<li>Two</ul>"""
TEXT = "Title & more\nFirst paragraph, with a link and bold, long enough.\nShort.\nOne\nTwo"


def test_main_text() -> None:
    for wrap in ("<article>%s</article>", '<div class="content">%s</div>', '<main role="main">%s</main>', '<div itemprop="articleBody">%s</div>'):
        assert html_tpr.main_text(PAGE % (wrap % BODY)) == TEXT
    for page, text in (("", ""), (None, ""), ("plain, text", "plain, text"), ("<p>a &am b &lt;c&gt;</p", "a &am b <c>"), ("<nav>x</nav>", ""), ("<article><p>cut <b>off", "cut off"), ("<p>a<br>b</p>", "a b")):
        assert html_tpr.main_text(page) == text


def test_main_text_in_several_parts() -> None:
    long = [f"<p>Sentence {k}, which is long enough to count, has commas; it ends here.</p>" for k in range(6)]
    plain = [x[3:-4] for x in long]
    for page, text in (
        (f"<h1>Title</h1><p>lead</p><div class=body>{''.join(long)}</div>", ["Title", "lead", *plain]),
        (f"<div><a>Home</a></div><h1><a>Title</a></h1><div>by me</div><div><div>{''.join(long)}</div></div>", ["Title", "by me", *plain]),
        (f"<div>{''.join(long[:4])}</div><div>{''.join(long[4:])}</div>", plain),
        (f"<div>{''.join(long[:4])}</div><h2>Part</h2><div>{''.join(long[4:])}</div>", [*plain[:4], "Part", *plain[4:]]),
        (f"<article>{''.join(long[:5])}</article><article>Short</article>", [*plain[:5], "Short"]),
        (f"<article>{long[0]}</article><div><article>{long[1]}</article></div>", plain[:2]),
        (f"<article><p>Teaser, short.</p></article><div>{''.join(long)}</div>", ["Teaser, short.", *plain]),
        (f"<main><h1>Title</h1><article>{''.join(long)}</article></main>", ["Title", *plain]),
    ):
        assert html_tpr.main_text(PAGE % page) == "\n".join(text)


def test_extract(spark) -> None:
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "x"), (1, "u", PAGE % f"<article>{BODY}</article>", "x"), (None, None, None, None), (2, "v", "<article>" + "<p>long, text.</p>" * 20_000 + "</article>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_tpr.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(TEXT)), (1, len(TEXT)), (2, 20_000 * 12 - 1)] and html_tpr.extract(pages.where("false")).count() == 0


def long_words() -> list[str]:
    rng = random.Random(8)
    return ["a" * 1500, "".join(rng.choices("abcdefghij", k=1300)), "日本語" * 400, "".join(rng.choices("thehndsöก", k=2100))]


def test_language_of_long_words() -> None:
    """Words of more than 1,000 letters against a sum in logarithms, whole and in blocks; their place in a batch doesn't count."""
    vocab = pieces.vocabulary(PIECES)
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(vocab.size), 3).T + 1e-12)
    want = []
    for w in long_words():
        symbols = vocab.symbols("▁" + w)
        alpha = np.full((len(symbols) + 1, 3), -np.inf)
        alpha[0] = 0
        for i, s in enumerate(symbols):
            if isinstance(s, int):
                alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i] + log_p[s])
                continue
            for j in range(i + 1, min(len(symbols), i + vocab.longest) + 1):
                if all(isinstance(c, str) for c in symbols[i:j]) and (p := vocab.ids.get("".join(symbols[i:j]))) is not None:
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + log_p[p])
        want.append(alpha[-1])
    scorer = langid._Scorer(langid.Model(PIECES, ["a", "b", "c"], log_p), remembered=3)
    assert np.allclose(scorer.of(long_words()), want)
    for block in (5, 100, 1299, 5000):
        assert np.allclose([pieces.total_of_long(vocab, "▁" + w, log_p, block) for w in long_words()], want)
    short = [f"w{i}" for i in range(50)]
    alone = np.concatenate([scorer.of([w]) for w in short])
    assert np.allclose(scorer.of([*short, *long_words()])[:50], alone) and np.allclose(scorer.of(long_words()), want)


def test_language_learns_from_whole_words(spark) -> None:
    """What tells two languages apart comes after 300 letters that they share."""
    rows = [(i, "x" * 300 + tail * 50, lang) for i, (tail, lang) in enumerate([("ab", "p"), ("cd", "q")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in langid.identify(docs, langid.fit(docs, PIECES)).collect())
    #: More languages than a task holds at once are learned in blocks.
    many = langid.fit(spark.range(300).selectExpr("id AS doc_id", "'a' AS text", "string(id) AS lang"), PIECES)
    assert [len(many.languages), len(many.more.languages), many.more.more] == [200, 100, None]


def test_languages_in_blocks(spark, odd, monkeypatch) -> None:
    """However many languages a task holds at once, the predictions are the same, and scores but for rounding."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    docs = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 2).cast("string")))

    def found() -> list[tuple]:
        rows = langid.identify(docs, langid.fit(docs, langid.default_tokenizer())).collect()
        return sorted((str(r["doc_id"]), str(r["text"]), r["lang_pred"], round(r["score"], 9)) for r in rows)

    whole = found()
    assert len({x[2] for x in whole}) > 4
    for at_once in (1, 3):
        monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", at_once)
        assert found() == whole
