"""Operators on small tables: behaviour, properties and order independence."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.operators import aliases as AL, audit as AU, authors as AUT, evidence as E, ledger as L, merge as MG, mining as M, references as R, sets as O


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


PUBS = "id string, doi string, ord long, title string"


def test_merge_by_id_and_doi(spark):
    old = spark.createDataFrame([("a", "10.1/a", 0, "A"), ("b", "10.1/b", 1, "B"), ("c", None, 2, "C")], PUBS)
    new = spark.createDataFrame([("x", "10.1/a", 0, "A2"), ("b", "10.1/b", 1, "B"), ("n", "10.1/n", 2, "N"), ("n2", "10.1/n", 3, "N2"), ("c", None, 4, "C2")], PUBS)
    merged, log = MG.merge(old, new)
    assert rows(merged, "id", "doi", "title", "side") == [("a", "10.1/a", "A2", 0), ("b", "10.1/b", "B", 0), ("c", None, "C2", 0), ("n", "10.1/n", "N2", 1)]
    assert rows(log) == [("a", "updated"), ("b", "unchanged"), ("c", "updated"), ("n", "added")]


def test_merge_is_idempotent_and_order_free(spark):
    rng = random.Random(1)
    data = [(f"i{k}", f"10.1/{k}", k, f"t{rng.random()}") for k in range(50)]
    old = spark.createDataFrame(data[:30], PUBS)
    new = spark.createDataFrame(data[20:], PUBS)
    once, _ = MG.merge(old, new.repartition(7))
    twice, log = MG.merge(once.drop("side"), new.repartition(3))
    assert rows(once, "id", "title") == rows(twice, "id", "title")
    assert {a for _, a in rows(log)} == {"unchanged"}


def test_merge_conflict_is_quarantined(spark):
    old = spark.createDataFrame([("a", "10.1/a", 0, "A"), ("b", "10.1/b", 1, "B")], PUBS)
    new = spark.createDataFrame([("a", "10.1/b", 0, "X")], PUBS)
    assert rows(MG.merge_conflicts(old, new), "id", "id_match", "doi_match") == [("a", "a", "b")]
    assert rows(MG.merge(old, new)[0], "title") == [("A",), ("B",)]


def test_aliases_long_chain_and_cycle(spark):
    chain = [(f"n{i}", f"n{i + 1}", "r") for i in range(40)]
    ring = [("r0", "r1", "r"), ("r1", "r0", "r"), ("q", "r0", "r")]
    resolved, cycles = AL.resolve_aliases(spark.createDataFrame(chain + ring, "src string, dst string, reason string"))
    assert {t for _, t in rows(resolved)} == {"n40"} and resolved.count() == 40
    assert rows(cycles) == [("q",), ("r0",), ("r1",)]


def test_add_aliases(spark):
    edges = spark.createDataFrame([("a", "b", "r")], "src string, dst string, reason string")
    new = spark.createDataFrame([("c", "a"), ("a", "b"), ("a", "z"), ("b", "a")], "src string, dst string")
    kept, refused = AL.add_aliases(edges, new)
    assert rows(kept, "src", "dst") == [("a", "b"), ("c", "b")]
    assert rows(refused, "src", "problem") == [("a", "conflict"), ("b", "self")]


def test_dedupe_first_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(30)], "k int, ord int")
    out = O.dedupe_first(df, "k")
    assert rows(out) == [(0, 0), (1, 1), (2, 2)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_mining_counts_match_brute_force(spark):
    texts = [("red blue green", "keep"), ("red blue", "keep"), ("blue green red", "reject"), ("red", "reject")]
    ev = spark.createDataFrame([(f"d{i}", i, "", t, [], f"b{i % 2}") for i, (t, _) in enumerate(texts)],
                               "doi string, ord int, title string, abstract string, keywords array<string>, batch_id string")
    lab = spark.createDataFrame([(f"d{i}", v, "human") for i, (_, v) in enumerate(texts)], "doi string, label string, source string")
    got = {r["phrase"]: (r["keep"], r["reject"], r["batch_count"]) for r in M.phrase_counts(M.labeled_features(ev, lab, [], [])).collect()}
    want = {}
    for i, (t, v) in enumerate(texts):
        w = t.split()
        for g in {" ".join(w[a:a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)}:
            k, r, b = want.get(g, (0, 0, set()))
            want[g] = (k + (v == "keep"), r + (v == "reject"), b | {i % 2})
    assert got == {g: (k, r, len(b)) for g, (k, r, b) in want.items()}


def _ref(text, doi=None):
    return {"doi": doi, "citation": text}


def _align(spark, cur, prov):
    s = "id int, refs array<struct<doi:string,citation:string>>, prov array<struct<doi:string,citation:string>>"
    df = spark.createDataFrame([(1, [(r["doi"], r["citation"]) for r in cur], [(r["doi"], r["citation"]) for r in prov])], s)
    return [(r["kind"], r["current_index"], r["provider_index"], r["evidence"]) for r in R.align_references(df).first()["rows"]]


def test_alignment(spark):
    a, b, c = _ref("A", "10.1/a"), _ref("B", "10.1/b"), _ref("C", "10.1/c")
    assert _align(spark, [a, b], [a, c, b]) == [("unchanged", 1, 1, "same-doi"), ("inserted", None, 2, None), ("unchanged", 2, 3, "same-doi")]
    assert _align(spark, [a, b, c], [c, a, b]) == [("inserted", None, 1, None), ("unchanged", 1, 2, "same-doi"), ("unchanged", 2, 3, "same-doi"), ("removed", 3, None, None)]
    assert _align(spark, [_ref("Smith, On rings")], [_ref("New one entirely"), _ref("smith on rings!")]) == [
        ("inserted", None, 1, None), ("changed", 1, 2, "formatting")]


def test_alignment_run_is_longest():
    rng = random.Random(3)
    for _ in range(200):
        values = rng.sample(range(30), rng.randint(0, 12))
        best = [1] * len(values)
        for i in range(len(values)):
            best[i] = max([best[j] + 1 for j in range(i) if values[j] < values[i]] or [1])
        run = R._longest_increasing(values)
        picked = [values[i] for i in run]
        assert picked == sorted(picked) and len(run) == max(best, default=0)


def test_gap_matches_equal_all_pairs():
    rng = random.Random(5)
    words = ["ring", "group", "field", "1999", "smith"]

    def entry():
        t = [rng.choice(words) for _ in range(rng.randint(0, 4))]
        return None, " ".join(t), t

    from collections import Counter
    for _ in range(200):
        cur, prov = [entry() for _ in range(5)], [entry() for _ in range(5)]
        pairs = {}
        for i, c in enumerate(cur):
            for j, p in enumerate(prov):
                if c[2] == p[2]:
                    pairs[i, j] = "formatting"
                elif R._wrapped(c[1], p[1]):
                    pairs[i, j] = "wrapper-artifact"
                elif c[2] and Counter(c[2]) != Counter(p[2]) and Counter(c[2]) <= Counter(p[2]):
                    pairs[i, j] = "metadata-enrichment"
        left, right = Counter(i for i, _ in pairs), Counter(j for _, j in pairs)
        want = sorted((j, i, w) for (i, j), w in pairs.items() if left[i] == 1 and right[j] == 1)
        if any(a[1] >= b[1] for a, b in zip(want, want[1:])):
            want = []
        assert R._gap_matches(range(5), range(5), cur, prov) == want


def test_near_equal_matches_difflib(spark):
    base = "the quick brown fox jumps over the lazy dog " * 6
    others = [base.replace("lazy", "lazi"), base.replace("quick", "slow"), base + "x", base.upper().lower(), "short", base.replace(" ", "-")]
    df = spark.createDataFrame([(i, base.strip(), o.strip()) for i, o in enumerate(others)], "i int, a string, b string")
    got = {r["i"]: r["n"] for r in AU.with_near(df, F.col("a"), F.col("b"), "n").collect()}
    for i, o in enumerate(others):
        a, b = base.strip(), o.strip()
        compact = lambda s: "".join(ch for ch in s if ch.isalnum())
        want = compact(a) == compact(b) or (min(len(a), len(b)) / max(len(a), len(b)) >= 0.95 and SequenceMatcher(None, a, b).ratio() >= 0.98)
        assert got[i] == want


@pytest.mark.parametrize("names", [["J. Smith", "John Smith", "Jane Smith", "J. A. Smith", "John Adam Smith", "J. Adam Smith", "John A. Smith", "K. Smith"]])
def test_initial_candidates_match_pairwise(spark, names):
    m = spark.createDataFrame([(f"s{i}", 1, n) for i, n in enumerate(names)], "slug string, pos int, name string")
    got = {(r["left_slug"], r["right_slug"]) for r in AUT.initial_candidates(m).collect()}
    parts = [n.lower().replace(".", "").split() for n in names]
    want = set()
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            a, b = parts[i], parts[j]
            if a[-1] != b[-1] or len(a) != len(b):
                continue
            fit = all(x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y)) for x, y in zip(a[:-1], b[:-1]))
            if fit and any((len(x) == 1) != (len(y) == 1) for x, y in zip(a[:-1], b[:-1])):
                want.add((f"s{i}", f"s{j}"))
    assert got == want


def test_allocate_slugs_match_sequential(spark):
    titles = ["a", "a", "a0", "b", "a", "a00", "b", "c"]
    used = ["a", "b0"]
    t = spark.createDataFrame([(str(i), i, x) for i, x in enumerate(titles)], "id string, ord int, title string")
    got = dict(rows(AUT.allocate_slugs(t, spark.createDataFrame([(u,) for u in used], "slug string"))))
    taken, want = set(used), {}
    for i, x in enumerate(titles):
        while x in taken:
            x += "0"
        taken.add(x)
        want[str(i)] = x
    assert got == want


def test_labels_have_one_source(spark):
    ev = spark.createDataFrame([("a", "", "keep"), ("b", "reject", "keep"), ("c", "", ""), ("d", "", "")], "doi string, correction_decision string, human_decision string")
    canon, gone = (spark.createDataFrame([(k,)], "doi string") for k in ("b", "d"))
    alias = spark.createDataFrame([("c", "d")], "src string, terminal string")
    good, clash = E.labels(ev, canon, gone, alias)
    assert rows(good) == [("a", "keep", "human"), ("c", "reject", "alias"), ("d", "reject", "terminal")]
    assert rows(clash) == [("b", "reject", "correction")]


def test_next_batch_prefers_pending(spark):
    items = spark.createDataFrame([("a", 0, "retryable", 1, ""), ("b", 1, "pending", 0, ""), ("c", 2, "pending", 0, "")], "key string, ord int, state string, attempts int, detail string")
    assert rows(L.next_batch(items, 1), "key") == [("b",)]
    assert rows(L.next_batch(items.filter("state <> 'pending'"), 5), "key", "attempts") == [("a", 2)]


def test_merge_links_rows_of_one_batch(spark):
    """Ids and DOIs stated together are one record, also through other rows; no id or DOI comes out twice."""
    old = spark.createDataFrame([("a", "10.1/b", 0, "A"), ("k", "10.1/k", 1, "K"), ("m", "10.1/m", 2, "M")], PUBS)
    new = spark.createDataFrame([
        ("x", "10.1/n", 0, "X1"), ("x", None, 1, "X2"),          # one id with and without a DOI
        ("a", "10.1/b", 2, "A2"), ("q", "10.1/b", 3, "Q"),       # a second id for a canonical DOI
        ("y", "10.1/y1", 4, "Y1"), ("y", "10.1/y2", 5, "Y2"), ("z", "10.1/y2", 6, "Z"),
        ("k", "10.1/l", 7, "L"), ("l", "10.1/l", 8, "L2"), ("l", "10.1/m", 9, "L3")], PUBS)  # ties k and m together
    merged, log = MG.merge(old, new)
    got = rows(merged, "id", "doi", "title", "side")
    assert got == [("a", "10.1/b", "Q", 0), ("k", "10.1/k", "K", 0), ("m", "10.1/m", "M", 0), ("x", "10.1/n", "X2", 1), ("y", "10.1/y2", "Z", 1)]
    assert rows(MG.quarantined(old, new), "title") == [("L",), ("L2",), ("L3",)]
    assert rows(log) == [("a", "updated"), ("x", "added"), ("y", "added")]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_against_union_find(spark, seed):
    rng = random.Random(seed)
    old = [(f"c{k}", f"10.1/{k}", k, f"o{k}") for k in range(8)]
    new = [(rng.choice([f"c{k}" for k in range(8)] + [f"n{k}" for k in range(10)]), rng.choice([None] * 3 + [f"10.1/{k}" for k in range(16)]), k, f"t{k}") for k in range(14)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for i, d, _, _ in old + new:
        if d:
            root[find("i" + i)] = find("d" + d)
    owners = {}
    for i, _, _, _ in old:
        owners.setdefault(find("i" + i), []).append(i)
    batch = {}
    for r in new:
        batch.setdefault(find("i" + r[0]), []).append(r)
    merged = {r["id"]: r["title"] for r in MG.merge(spark.createDataFrame(old, PUBS), spark.createDataFrame(new, PUBS))[0].collect()}
    want = {i: t for i, _, _, t in old}
    for g, own in batch.items():
        if len(owners.get(g, [])) <= 1:
            want[owners[g][0] if g in owners else own[0][0]] = own[-1][3]
    assert merged == want


def test_common_title_gives_one_warning(spark):
    kind = "id long, permalink string, title string, publication_year string, identifiers map<string,string>"
    known = spark.createDataFrame([(k, f"p{k}", "Editorial", "2020", {"isbn": "1"}) for k in range(40)], kind)
    new = spark.createDataFrame([(100 + k, f"n{k}", "Editorial!", "2020", {"isbn": "1"}) for k in range(30)], kind)
    warnings, _ = MG.possible_duplicates(new, known)
    assert warnings.count() == 60 and {(r["canonical_id"], r["alike"]) for r in warnings.collect()} == {(0, 40)}


def test_apply_contributors(spark):
    from quire.operators import decisions as D
    people = "array<struct<given:string,family:string,literal:string,role:string>>"
    pubs = spark.createDataFrame([("1", "T", [("Ann", "Lee", None, "x"), (None, None, "Bo", "y")], ["a"]), ("2", "U", [], ["b"])], f"id string, title string, authors {people}, keywords array<string>")
    current = spark.createDataFrame([("1", "authors", ["Ann Lee", "Bo"]), ("1", "keywords", ["a"]), ("2", "authors", [])], "publication_id string, field string, value array<string>")
    cands = spark.createDataFrame([("k1", "1", "authors", ["Ann Lee", "Bo"]), ("k2", "1", "keywords", ["a"]), ("k3", "2", "authors", [])], "key string, publication_id string, field string, current_value array<string>")
    decisions = spark.createDataFrame([("k1", "accepted", ["Bo", "Cy Dee", "Ann Lee"]), ("k2", "custom", ["p", "q"]), ("k3", "accepted", ["Eva"])], "key string, decision string, resolved_value array<string>")
    staged = {r["id"]: r for r in D.apply_decisions(pubs, current, cands, decisions, ["authors", "keywords"])[0].collect()}
    assert [tuple(a) for a in staged["1"]["authors"]] == [(None, None, "Bo", "y"), (None, None, "Cy Dee", None), ("Ann", "Lee", None, "x")]
    assert staged["1"]["keywords"] == ["p", "q"] and [a["literal"] for a in staged["2"]["authors"]] == ["Eva"]
