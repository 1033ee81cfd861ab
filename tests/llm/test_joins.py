"""Decontamination, n-gram join and line deduplication against brute force."""

from collections import Counter
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import decontamination as D, graph, line_dedup as E, ngram_join as J


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def brute_contamination(docs, items, width=10):
    windows = [(i, tuple(w[s:s + width])) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - width + 1))]
    out = []
    for d, t in docs:
        own, hit, found = words(t), set(), set()
        for i, win in windows:
            for s in range(len(own) - len(win) + 1):
                if tuple(own[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(i))
        out.append((str(d), len(own), len(hit), sorted(found)))
    return sorted(out)


def test_contamination(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("the of Éa bb cc dd e1".split()) for _ in range(n))
    items = [(k, text(r.randint(1, 14))) for k in range(12)] + [(20, None), (21, ""), (22, "the the the the the the the the the the the"), (22, "one two"), (0, "same as")] * 2
    docs = [(k, text(r.randint(0, 60)) + ", " + (items[r.randrange(12)][1] if k % 3 else "")) for k in range(40)]
    docs += [(50, None), (51, ""), (52, "The-THE; the the the the the the the the the the"), (52, "The-THE; the the the the the the the the the the"), (None, "one two three"), (53, "!one two ")]
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, h string, n_hit int")
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, pos int")
    for width in (10, 3):
        got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.item_ids) for x in D.contamination(left, right, width).collect())
        assert got == brute_contamination(docs, items, width)
    clean = {str(x.doc_id) for x in D.decontaminate(left, right).collect()}
    assert clean == {d for d, _, n, _ in brute_contamination(docs, items) if not n}
    assert D.decontaminate(left, right).columns == left.columns
    assert D.contamination(left.limit(0), right).count() == 0
    assert {x.n_hit for x in D.contamination(left, right.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c x b y a"), (2, "a b " + "z " * 50 + "c"), (3, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index = D.build_index(docs, items)
    assert [x.doc_id for x in D.proximity_matches(index, D.item_windows(index, items), 10).collect()] == [1]


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert graph.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute_groups(docs, percent=75):
    sets = []
    for d, t in docs:
        w = ascii_lower(t).encode().split()
        sets.append((d, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and docs[a][0] is not None and docs[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted((str(d), len(s), str(least[find(k)] if d is not None else None)) for k, (d, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed, monkeypatch):
    if seed % 2:  # the open sets are joined where they are too many for an index
        monkeypatch.setattr(J, "INDEX_ENTRIES", 0)
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 6, 20, 80, 200]))] for _ in range(12)]
    docs = []
    for k in range(160):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((k * 3 + 1, r.choice([" ", "  ", "\n"]).join(w).replace("w1", "W1") + (f" {passage}" if k % 4 == 0 else "")))
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "a b c d"), (906, "a b c d"), (907, "a b c d e")]
    docs += [(None, docs[0][1]), (None, None), docs[3], docs[3]]
    df = spark.createDataFrame([(*d, 0, "z") for d in docs], "doc_id long, text string, n int, cls string")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in J.near_duplicates(df).collect())
    assert got == brute_groups(docs)
    kept = J.deduplicate(df)
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({int(c) for d, _, c in brute_groups(docs) if d == c != "None"})
    assert ids.count(None) == 2


def test_deduplicate_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(1, text(1)), (5, text(1) + " more"), (5, text(2)), (5, text(3)), (5, text(3)), (6, text(4)), (6, text(4) + " more"), (7, text(5)), (8, text(5)), (8, text(5)), (8, text(6)),
            (9, ""), (9, ""), (9, None), (9, text(7)), (None, text(1)), (None, text(1))]
    kept = J.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    sixth = [k for k in got if k[0] == 6]
    assert len(sixth) == 1 and got.pop(sixth[0]) == 1
    assert got == Counter([(1, text(1)), (5, text(2)), (5, text(3)), (7, text(5)), (8, text(6)), (9, ""), (9, ""), (9, None), (9, text(7)), (None, text(1)), (None, text(1))])


def test_open_sets_in_blocks(spark, monkeypatch):
    """Links of sets in many small blocks against brute force, with runs of one set, and nothing through the driver."""
    r = random.Random(5)
    sets = []
    for cls in range(90):
        base = range(1000 * (cls % 4), 1000 * (cls % 4) + 24)
        sets.append((cls - 40, cls % 7, sorted(t for t in {*r.sample(base, r.randint(16, 24)), *range(cls * 10_000, cls * 10_000 + r.randint(0, 3))})))
    share = Counter(t for _, _, own in sets for t in own)
    lists = []
    for cls, part, own in sets:
        ranked = sorted(own, key=lambda t: (share[t], t))
        lead = len(own) - J.need(len(own))
        rows = [(t, max(1, k - lead + 1), share[t]) for k, t in enumerate(ranked) if share[t] > 1]
        if len(rows) >= J.need(len(own)):
            lists.append((cls, part, len(own), rows, r.choice([1, 2, 4])))
    held = {c: set(own) for c, _, own in sets}
    want = sorted((a, b, s, t) for a, p, n, _, _ in lists for b, q, m, _, _ in lists if p != q and (m, b) < (n, a)
                  for s, t in [(len(held[a] & held[b]), len(held[a] | held[b]))] if 100 * s >= 75 * t)
    assert len(want) > 100
    df = spark.createDataFrame(lists, "cls long, part long, n int, rows array<struct<token: long, level: int, df: long>>, l int")
    monkeypatch.setattr(type(df), "toArrow", None)  # the sets stay with the workers
    for block, run in ((100, 1), (700, 2000), (10 ** 6, 10 ** 6)):
        monkeypatch.setattr(J, "BLOCK_ENTRIES", block)
        monkeypatch.setattr(J, "RUN_POSTINGS", run)
        got = J._in_blocks(df, sum(len(x[3]) for x in lists), 75)
        assert sorted(map(tuple, got.collect())) == want
    assert J._in_blocks(df.limit(0), 0, 75).count() == 0


def test_near_duplicates_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def noisy_lines(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(9, 16))) for _ in range(30)]

    def noisy(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            kind, at = r.randint(0, 2), r.randrange(len(s))
            if kind == 0:
                s.insert(at, r.choice("abcdé "))
            elif kind == 1:
                del s[at]
            else:
                s[at] = r.choice("abxé ")
        return "".join(s)
    return [(k, "\n".join(noisy(r.choice(base)) for _ in range(r.randint(1, 5)))) for k in range(50)]


@pytest.mark.parametrize("edits", [0, 2, 3])
def test_near_lines(spark, edits):
    docs = noisy_lines(edits)
    lines = sorted({x for _, t in docs for x in t.split("\n") if len(x) >= 8})
    named = {x.id: x.line for x in spark.createDataFrame([(x,) for x in lines], "line string").select("line", E.line_key(F.col("line")).alias("id")).collect()}
    got = {tuple(sorted((named[x.a], named[x.b]))): x.distance for x in E.near_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits, 8).collect()}
    assert got == {(a, b): n for i, a in enumerate(lines) for b in lines[i + 1:] if (n := levenshtein(a, b)) <= edits}


def brute_lines(docs, edits, min_chars, exact_chars=None):
    def taken(x):
        return len(x) >= min_chars or (exact_chars is not None and len(x) >= exact_chars and re.search(r"[^ \t-\r]", x) is not None)
    places = [(d, k, x) for d, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)) if t is not None for k, x in enumerate(t.split("\n")) if taken(x)]
    short = {x: x for _, _, x in places if len(x) < min_chars}
    lines = sorted({x for _, _, x in places if len(x) >= min_chars})
    bag = {x: Counter(x) for x in lines}
    root = {x: x for x in lines} | short

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if abs(len(a) - len(b)) <= edits and sum(((bag[a] - bag[b]) + (bag[b] - bag[a])).values()) <= 2 * edits and levenshtein(a, b) <= edits:
                root[find(a)] = find(b)
    first = {}
    for d, k, x in places:
        first.setdefault(find(x), (d, k))
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not taken(x) or first[find(x)] == (d, k)) for d, t in docs}


def test_dedup_lines(spark):
    docs = noisy_lines(9) + [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (104, "a line that stands twice\na line that stands twice"), (None, "a line that stands twice"), (105, "y" * 30000)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_lines int")
    out = E.dedup_lines(df, 2, 9)
    want = brute_lines(docs, 2, 9)
    rows = out.collect()
    assert {x.doc_id: x.text for x in rows} == want and len(rows) == len(docs)
    assert sum(x.n_removed for x in rows) == sum(t.count("\n") + 1 for _, t in docs if t is not None) - sum(x.n_lines - x.n_removed for x in rows)
    assert E.dedup_lines(df.limit(0)).count() == 0


def test_dedup_short_lines(spark):
    docs = [(1, "Licensed under MIT.\none line that is quite long\n \nx"), (2, "a\nLicensed under MIT.\nLicensed under BSD.\none line that is quite lung\n \nx"), (3, "Licensed under MIT.\n\na\n\n"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_removed) for x in E.dedup_lines(df, 2, 20, 1).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("a\nLicensed under BSD.\n ", 3), 3: ("\n\n", 2), 4: (None, 0)}
    got = {x.doc_id: x.text for x in E.dedup_lines(df, 2, 20, 5).collect()}
    assert got[2] == "a\nLicensed under BSD.\n \nx" and got[3] == "\na\n\n"


def test_near_lines_beyond_a_broadcast(spark, monkeypatch):
    """When every entry is shuffled, no entry carries the text of its line."""
    written = {}
    keep = E.stored
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(E, "stored", lambda df, name: (written.setdefault(name, df.columns), keep(df, name))[1])
    docs = noisy_lines(4)
    lines = sorted({x for _, t in docs for x in t.split("\n") if len(x) >= 8})
    named = {x.id: x.line for x in spark.createDataFrame([(x,) for x in lines], "line string").select("line", E.line_key(F.col("line")).alias("id")).collect()}
    got = {tuple(sorted((named[x.a], named[x.b]))): x.distance for x in E.near_lines(spark.createDataFrame(docs, "doc_id long, text string"), 2, 8).collect()}
    assert got == {(a, b): n for i, a in enumerate(lines) for b in lines[i + 1:] if (n := levenshtein(a, b)) <= 2}
    assert sorted(written["met"]) == ["id", "key", "probe", "size"] and "line" in written["texts"]
