"""Encoding with forced boundaries, importance resampling and the source divergence audit."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from quire.llm import batches, bpe, catalog, divergence as D, importance as I

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "a", "a\x00b\x1cc", "It'S  the 'LL don't", "<|endoftext|>x<|STARTOFTEXT|><|startoftext|>", "≯<|endoftext|≯", "İstanbul ΣΑΣ ẞ ǅ Å ﬁ Ⅷ ½",
       "中文 字 한글 กข", "x" * 4000, "the" * 700 + "ab" * 900, "1234567 8.9", "é" * 300, "\u0085a　b c", "🇩🇪👍🏽"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(catalog.WORDS)


@pytest.fixture(scope="module")
def own():
    return bpe.BoundaryCodec(catalog.WORDS)


def test_codec_equals_library(library, own):
    rnd = random.Random(3)
    letters = [chr(c) for c in range(0x250)] + [t or "" for t in ODD] + ["'s", "'ve", " ", "the", "ing", "<|", "|>", "́", "Σ", "ς"]
    tokens = [t.replace("</w>", " ") for t in own.names.values() if t.isascii()]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(2500)]
    texts += ["".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 12))) for _ in range(2500)]
    joined, decoded = own.encode_batch(pa.array(texts))
    for text, ids, back in zip(texts, joined.to_pylist(), decoded.to_pylist()):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want == np.frombuffer(ids, "<u4").tolist()
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == back


def test_cut_pairs_stand_in_no_token(own):
    """Every token that merging builds is free of cut pairs, so no merge is lost at a cut; and pairs that are no cut are needed by a token."""
    for name, i in ((n, i) for i, n in own.names.items() if n not in own.special):
        ended = name.endswith("</w>") and len(name) > 4
        word = [own.byte_of[c] for c in (name[:-4] if ended else name)]
        if ended:
            word[-1] += 256
        if own._long_fragment(word) == [i]:
            assert all(own.inside[a, b] for a, b in zip(word, word[1:]))
    assert 0 < own.inside.sum() < own.inside.size / 10
    assert not own.inside[256:].any()  # nothing follows the end of a word


def test_fragments_side_by_side_equal_single_ones(own):
    rnd = random.Random(8)
    for width in (2, 5, 32):
        words = [[rnd.choice(b"theingoar") for _ in range(rnd.randint(1, width))] for _ in range(400)]
        rows = np.full((len(words), width), bpe._NONE)
        for row, word in zip(rows, words):
            row[:len(word)] = [own.base[s] for s in word]
        for row, word in zip(own._table(rows), words):
            assert [i for i in row.tolist() if i != bpe._NONE] == own._long_fragment(list(word))


def test_merge_table_holds_all_merges(own):
    keys = np.array(list(own.merges))
    assert (own.merge(keys >> 32, keys & 0xFFFFFFFF) == np.array(list(own.merges.values()))).all()
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 49408, (2, 20000))
    assert own.merge(a, b).tolist() == [own.merges.get(int(x) << 32 | int(y), int(bpe._NEVER)) for x, y in zip(a, b)]


def test_encode_decode_rows(spark, library):
    texts = ODD + ODD[:4]
    docs = spark.createDataFrame([(i % 17, t, "kept", i) for i, t in enumerate(texts)], "doc_id long, text string, `a b` string, n_tokens long")
    got = bpe.encode_decode(docs, catalog.WORDS).collect()
    assert got[0].asDict().keys() == {"doc_id", "a b", "n_tokens", "ids", "decoded"} and len(got) == len(texts)
    for r, t in zip(got, texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (want, len(want), library.decode(want, skip_special_tokens=False))
    assert bpe.encode_decode(docs.limit(0), catalog.WORDS, digests=True).collect() == []


def test_bpe_query_equals_library(spark, sf, library):
    got = {r["doc_id"]: r for r in catalog.op11(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_split_words_against_regex():
    rnd = random.Random(4)
    texts = [None, "", "  ", "A\x00b"] + ["".join(rnd.choice("aZé9-_ \n\x1c中\x7f") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    flat, ends = batches.split_words(pa.array(["skipped", *texts], pa.string()).slice(1), I.WORD_BYTES)
    words = flat.to_pylist()
    assert [words[a:b] for a, b in zip(ends, ends[1:])] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in texts]


def _resampled(docs, target, max_n, buckets=100, percent=10, least=20):
    """Brute force: (n_features, weight, score, rank) of each row, in order."""
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[0]) for texts in ([x for _, x in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (ns + buckets)) / float((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        f, n = features(x)
        w = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("max_n,most", [(1, 20_000), (1, 3), (2, 5), (3, 4)])
def test_resampling_against_brute_force(spark, monkeypatch, max_n, most):
    """Any head, down to a few words, gives the same result; ids repeat and are null, texts are null, empty and long."""
    whole = I.head_vocabulary
    monkeypatch.setattr(I, "head_vocabulary", lambda docs, text, max_n: whole(docs, text, max_n, most))
    rnd = random.Random(max_n)
    words = ["The", "of", "ring", "Ünder", "x9", "long" * 30] + [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rnd.choice(words[:6] if rnd.random() < 0.5 else words) for _ in range(rnd.choice([0, 3, 19, 20, 40, 200])))
    docs = [(k % 70, text()) for k in range(90)] + [(None, text()), (500, None), (501, ""), (502, "The of " * 3000), (502, "The of " * 3000)]
    target = [text() for _ in range(12)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank_", F.lit(1)).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = I.importance_resample(frame, goal, max_n=max_n, buckets=100, percent=30)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == _resampled(docs, target, max_n, percent=30)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert I.importance_resample(none, some).collect() == []
    assert sorted((r["rank"] or 0) for r in I.importance_resample(some, none, percent=50).collect()) == [0, 1]


def test_head_pairs_are_used():
    head = I.Head(["a", "b", "c"], ["a b", "c a", "c zz"])
    hit, state = head.known_pairs(np.array([0, 2, 1, -1]), np.array([1, 0, 1, 0]))
    assert hit.tolist() == [True, True, False, False]
    assert state[:2].tolist() == [zlib.crc32(b"a b"), zlib.crc32(b"c a")]


def _audited(rows, least=10, top=10):
    """Brute force of the audit over (lang, source, text)."""
    inside, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        inside[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out, f = [], lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in inside[lang].items() if n >= least]
        sources = [s for a, s in counts if a == lang]
        share = lambda c, n, t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * len(kept))
        total = sum((counts[lang, s] for s in sources), Counter())
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s], size[s], t) for t in kept} for s in sources}
        q = {t: share(total, sum(size.values()), t) for t in kept}
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"shard_terms": 7, "wave_bytes": 3000}, {"shard_terms": 1, "wave_bytes": 20_000}])
def test_divergence_against_brute_force(spark, limits, monkeypatch):
    """One or many shards, one or many passes, counters handed on early: the same rows. Null and empty columns, ties, repeated rows."""
    if limits:
        monkeypatch.setattr(D, "TASK_COUNTERS", 20)
    rnd = random.Random(9)
    words = ["The", "über", "中文", "a", "b"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["s1", "s1", "s2", "s3", None, "ä"]),
             rnd.choice([None, "", "9 9"] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(9)])) for _ in range(250 if not limits else 120)]
    rows += [("en", "hot", "the ring " * 400)] * 12 + [("fr", "only", "un deux"), ("xx", "a", "y"), ("xx", "b", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("shard", F.lit("x")).repartition(4)
    got = sorted(tuple(r) for r in D.source_divergence(docs, **limits).collect())
    assert got == _audited(rows)


def test_divergence_of_an_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_perfect_hash_is_minimal_and_verified():
    rnd = random.Random(2)
    for size in (1, 2, 50, 3000):
        terms = [f"t{k}" for k in rnd.sample(range(10 ** 6), size)]
        levels, slots = D.build_hash(D.term_hashes(terms))
        assert sorted(slots.tolist()) == list(range(size))
        keys = [t for _, t in sorted(zip(slots.tolist(), terms))]
        table = D.TermTable([("en", 0, 1, [len(b) for b in levels], np.packbits(np.concatenate(levels)).tobytes(), pa.array(keys))])
        asked = terms + [f"other{k}" for k in range(2000)]
        found = table.slots(0, pa.array(asked), D.term_hashes(asked))
        assert [keys[k] for k in found[:size]] == terms and (found[size:] == -1).all()


def test_shares_are_exact():
    rnd = random.Random(1)
    for _ in range(200):
        total = rnd.choice([0, 5, 10 ** 9, 8 * 10 ** 15 - 1])
        terms, count = rnd.randint(1, 10 ** 6), rnd.randint(0, total)
        got = D.shares(np.array([[count]]), np.array([total]), terms)[0, 0]
        assert got == 1 + 10 ** 9 * (count + 2) // (total + 2 * terms)
