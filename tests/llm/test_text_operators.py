"""Piece encoding, HTML extraction and language identification."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import public_tokenizers
import sentencepiece as library

from quire.llm import html_extraction as H, language_id as L, sentencepiece as S
from quire.llm.catalog import PIECES

ODD = [None, "", " ", "\n", "a", "▁ x", "a\x00b", "  two  spaces ", "é😀\n\nñ", "x" * 5000, "word " * 3000, "<s></s><0x41>", "\t tab"]


@pytest.fixture(scope="module")
def pieces():
    return library.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def own():
    return S.MergeCodec(PIECES)


def test_codec_equals_library(pieces, own):
    rnd = random.Random(5)
    texts = [t or "" for t in ODD] + [" " * k + "x" + " " * k for k in range(1, 35)]
    parts = [p.replace("▁", " ") for p in own.pieces]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(rnd.choice("abeént \n▁<|0") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    joined, decoded = own.encode_batch(pa.array(texts))
    for text, ids, back in zip(texts, joined.to_pylist(), decoded.to_pylist()):
        want = pieces.encode(text)
        assert own.encode(text) == want and ids == ",".join(map(str, want))
        assert own.decode(want) == pieces.decode(want) == back


def test_incompatible_neighbours_are_refused(pieces, own):
    rnd = random.Random(6)
    ids = [i for i in own.parts if own.pieces[i].isalpha() and len(own.pieces[i]) > 1]
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        text = own.pieces[a] + own.pieces[b]
        assert own.compatible(a, b) == (own._run(text) == [a, b])


def test_remembered_pairs_are_bounded(pieces, monkeypatch):
    """A worker forgets remembered pairs at the bound and encodes on with equal ids."""
    monkeypatch.setattr(S, "FIT_PAIRS", 50)
    fresh, rnd = S.MergeCodec(PIECES), random.Random(8)
    for _ in range(300):
        text = "".join(rnd.choice("abcdefgh") for _ in range(30))
        assert fresh.encode(text) == pieces.encode(text) and len(fresh.fits) <= 50


def test_encode_decode_rows(spark, pieces):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, "same", 1), (None, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(S.encode_decode(docs, PIECES).select("doc_id", "text", "n_tokens", "ids", "decoded").collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        want = pieces.encode(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == pieces.decode(want)
    digest = {r.doc_id: r for r in S.encode_decode(docs, PIECES, keep=["doc_id"], digests=True).collect()}
    want = pieces.encode(ODD[8])
    assert digest[8].ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert S.encode_decode(docs.limit(0), PIECES).count() == 0


LONG = "The cat and the dog is in the house that was on the hill of the town and it is a good thing for all of us to see it with our own eyes today. "


def test_main_text_rules():
    page = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav>"
            "<!-- <p>gone</p> --><article><h1>Head &amp; line</h1><p>First <b>bold<br>\n part<p>Second &lt;x&gt;&nbsp;y</p><aside>advert</aside>"
            "<ul><li>one<li>two</ul><form><p>Name</p></form><div class='comments'><p>Nice article!</p></div></article><div class='cookie-notice'>ok</div><footer>&copy; z</footer></body></html>")
    assert H.main_text(page) == "Head & line\nFirst bold part\nSecond <x> y\none\ntwo"
    plain = f"<div><a href=a>menu</a> <a href=b>more</a></div><p>{LONG * 2}</p><p>Short one.</p><p>{LONG * 2}</p><div><a href=c>imprint</a></div><p>x</p>"
    lines = H.main_text(plain).split("\n")
    assert len(lines) == 3 and lines[1] == "Short one."  # the short block between two good ones stays, the last one goes with the links
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav><p>only menu</p></nav>") == ""
    assert H.main_text("<article><p>" + "w " * 20000 + "</p></article>").count("w") == 20000
    assert H.main_text("<" * 2000 + '<a href="' * 500) == ""


def test_parts_without_text():
    for name in ("svg", "math", "button", "object", "select", "canvas", "video", "audio", "template"):
        assert H.main_text(f'<article><p>One</p><{name} class="i"/><p>Two</p><p>Three</p></article>') == "One\nTwo\nThree", name
        assert H.main_text(f'<article><div><p>One</p><{name} class="i"><b>x</b></div><p>Two</p><p>Three</p></article>') == "One\nTwo\nThree", name
        assert H.main_text(f"<article><p>One <{name}>a<i>b</i></{name}> two</p><p>Three</p></article>") == "One two\nThree", name
    assert H.main_text('<article><p>One</p><svg class="i"><path d=x><p>Two</p><p>Three</p></article>') == "One\nTwo\nThree"
    assert H.main_text("<article><p>One <button><div>x<p>y</div></button> two<svg><svg></svg>z</svg></p><script/><p>Three</p><script>x<p>y</article>") == "One two\nThree"
    assert H.main_text('<article><p>One <button class="share">x</p><p>Two</p></article>') == "One\nTwo"
    assert H.main_text("<template><article><p>gone</p></article></template><article><p>One</p></article>") == "One"


def test_open_elements_without_bound():
    items = "".join(f"<li><a href=x{k}>x" for k in range(600))
    assert H.main_text(f"<body><nav>{items}</nav><article><p>One</p><p>Two</p></article></body>") == "One\nTwo"
    assert H.main_text(f"<body><nav>{'<span><i>x' * 600}</nav><article><p>One</p><p>Two</p></article></body>") == "One\nTwo"
    found, _ = H.blocks(f"<article><ul>{items}</ul><p>{LONG}</p><div><a href=y>y</div><p>Two <a href=z>z</a> three</p></article>")
    assert [(b.text, b.link_chars) for b in found if b.text != "x"] == [(LONG.strip(), 0), ("y", 1), ("Two z three", 1)]
    found, _ = H.blocks("<ul><li>one<ul><li><b>two<li>three</ul><li>four</ul><a name=t><div><p>x</p><a href=y>y</a> z</div>")
    assert [(b.text, b.link_chars) for b in found] == [("one", 0), ("two", 0), ("three", 0), ("four", 0), ("x", 1), ("y z", 1)]


def test_extract_pages_rows(spark):
    rows = [(1, "u", "<article><p>a  b</p></article>", "old"), (1, "u", "<article><p>a  b</p></article>", "old"), (None, None, None, None), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract_pages(pages).collect())
    assert got == [("1", "a b", 3), ("1", "a b", 3), ("2", "", 0), ("None", "", 0)]
    assert H.extract_pages(pages.limit(0)).count() == 0


def _brute(model, word, label):
    """Sum over all segmentations, by recursion."""
    index = {p: i for i, p in enumerate(model.pieces)}
    text, memo = L.SPACE + word, {}

    def tail(at):
        if at == len(text):
            return 1.0
        if at not in memo:
            total = 0.0
            for end in range(at + 1, len(text) + 1):
                i = index.get(text[at:end])
                if i is None and end == at + 1:
                    i = len(model.pieces)
                if i is not None:
                    total += model.table[i, label] * tail(end)
            memo[at] = total
        return memo[at]
    return tail(0)


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train(docs, PIECES, docs_per_label=40, rounds=2)
    assert model.labels == sorted(r.lang for r in docs.where("lang IS NOT NULL").select("lang").distinct().collect())
    for word in ("the", "ción", "ünder", "zzq", "日本", "e" * 30, "e" * 90):
        got = model.log_likelihood([word])[0]
        for j in range(len(model.labels)):
            brute = _brute(model, word, j)
            assert brute == 0 or abs(got[j] - __import__("math").log(brute)) < 1e-6
    out = L.identify(docs, model).withColumn("held", L.held_out())
    held = out.where("held AND lang_pred <> 'und'").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert held.n > 20 and held.a > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the and of the", "x"), (4, "the and of the", "x")], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in L.identify(odd, model).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", True), (4, "en", True)]


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (None, "x", "en")], "doc_id long, text string, lang string")
    assert L.train(docs, PIECES) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}


def test_held_out_rule(spark):
    import zlib
    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    for r in ids.select("doc_id", L.held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECES
