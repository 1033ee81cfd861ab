"""Sequence match, compatible names and findings against plain definitions."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions.sequences import similar
from quire.operators import audit as AU


def _edited(rng, seq, count, letters):
    seq = list(seq)
    for _ in range(count):
        k, kind = rng.randrange(len(seq) + 1), rng.random()
        if kind < 0.4 and k < len(seq):
            seq[k] = rng.choice(letters)
        elif kind < 0.7 and k < len(seq):
            del seq[k]
        else:
            seq.insert(k, rng.choice(letters))
    return seq


@pytest.mark.parametrize("letters", ["ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyz .,;-0123456789"])
def test_similarity_equals_the_standard_matcher(letters):
    rng = random.Random(len(letters))
    for _ in range(600):
        n = rng.choice([0, 1, 5, 40, 199, 200, 230, 600])
        a = [rng.choice(letters) for _ in range(n)]
        b = _edited(rng, a, rng.choice([0, 1, 4, 30]), letters) if rng.random() < 0.8 else [rng.choice(letters) for _ in range(n)]
        ratio = SequenceMatcher(None, a, b).ratio()
        assert all(similar(a, b, least) == (ratio >= least) for least in (0.98, 0.9, 0.5, ratio, ratio + 1e-9))


def test_similarity_of_long_texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    for changes in (0, 3, 40, 400):
        text = " ".join(rng.choice(words) for _ in range(3400))
        other = " ".join(_edited(rng, text.split(" "), changes, words))
        assert len(text) > 20_000
        for a, b in ((text, other), (text.split(" "), other.split(" "))):
            ratio = SequenceMatcher(None, a, b).ratio()
            assert similar(a, b, 0.98) == (ratio >= 0.98) and similar(a, b, ratio) and not similar(a, b, ratio + 1e-9)


def test_similarity_grows_with_the_length():
    """Token lists of rare words, where matching every pair of places would grow with the square."""
    rng, took = random.Random(3), []
    for n in (4000, 32000):
        a = [rng.randrange(n) for _ in range(n)]
        b = _edited(rng, a, 20, range(n))
        start = time.perf_counter()
        assert similar(a, b, 0.98)
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * took[0]


def _compatible(a, b):
    """Compatible given names by the written rule."""
    fit = lambda x, y: x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y))
    initials = lambda t: all(len(x) == 1 for x in t)
    if "".join(a) == "".join(b):
        return True
    if not a or not b:
        return False
    if len(a) == len(b) and all(map(fit, a, b)):
        return True
    if initials(a) and initials(b):
        return False
    if initials(a) or initials(b):
        return fit(a[0], b[0])
    short, long = sorted((a, b), key=len)
    return short[0] == long[0] and len(short) == 1 and initials(long[1:])


def test_given_names_against_the_rule(spark):
    rng = random.Random(1)
    tokens = ["j", "a", "b", "jo", "john", "adam", "ab", "ja"]
    pairs = [(i, [rng.choice(tokens) for _ in range(rng.randint(0, 3))], [rng.choice(tokens) for _ in range(rng.randint(0, 3))]) for i in range(3000)]
    df = spark.createDataFrame(pairs, "i int, a array<string>, b array<string>").select("i", N.compatible_given(F.col("a"), F.col("b")).alias("ok"), N.compatible_given(F.col("b"), F.col("a")).alias("turned"))
    got = {r["i"]: r for r in df.collect()}
    for i, a, b in pairs:
        assert got[i]["ok"] == got[i]["turned"] == _compatible(a, b), (a, b)


CANON = "publication_id string, field string, value array<string>, is_list boolean"
PROV = "publication_id string, provider string, p_ord int, status string, detail string, field string, value array<string>, is_list boolean"


def _findings(spark, canon, prov):
    order = {p: i for i, p in enumerate("abcdefgh")}
    c = spark.createDataFrame([(i, f, v, f in AU.LIST_FIELDS) for i, f, v in canon], CANON)
    p = spark.createDataFrame([(i, who, order[who], "available", "", f, v, f in AU.LIST_FIELDS) for i, who, f, v in prov], PROV)
    found = AU.review_findings(AU.compare(c, p)[0]).collect()
    return sorted((r["publication_id"], r["field"], r["classification"], ",".join(r["providers"]), r["actionable"]) for r in found), found


def test_equal_alternatives_are_united_though_not_equal_to_the_first(spark):
    text = "a long and steady account of rings and fields that many people have read with care " * 4
    got, found = _findings(spark, [("1", "title", ["Old title"]), ("1", "abstract", [text])], [
        ("1", "a", "title", ["New"]), ("1", "b", "title", ["Other - title"]), ("1", "c", "title", ["other-title ."]), ("1", "d", "title", ["new"]), ("1", "e", "title", ["Third"]),
        ("1", "a", "abstract", ["something else"]), ("1", "b", "abstract", ["x" + text[40:]]), ("1", "c", "abstract", ["y" + text[40:]])])
    assert got == [("1", "abstract", "substantive-difference", "a", False), ("1", "abstract", "substantive-difference", "b,c", True),
                   ("1", "title", "substantive-difference", "a,d", True), ("1", "title", "substantive-difference", "b,c", True), ("1", "title", "substantive-difference", "e", False)]
    values = {tuple(r["providers"]): [tuple(v) for v in r["provider_values"]] for r in found if r["field"] == "title"}
    assert values["b", "c"] == [("b", ["Other - title"]), ("c", ["other-title ."])]


def test_roles_confirmations_and_disagreements(spark):
    got, _ = _findings(spark, [("1", "authors", [""]), ("1", "editors", ["Ann Lee"]), ("1", "volume", ["4"]), ("1", "container_title", ["J"]), ("2", "identifiers.isbn", ["1"]), ("2", "issue", [""])], [
        ("1", "a", "authors", ["A. Lee"]), ("1", "b", "authors", ["Bo Ray"]), ("1", "c", "authors", ["a. lee"]), ("1", "a", "editors", ["Ann Lee"]),
        ("1", "a", "volume", ["5"]), ("1", "b", "volume", ["5"]), ("1", "c", "volume", ["4"]),
        ("1", "a", "container_title", ["K"]), ("1", "b", "container_title", ["j"]),
        ("2", "a", "identifiers.isbn", ["2"]), ("2", "b", "identifiers.isbn", ["1"]), ("2", "a", "issue", [""]), ("2", "b", "issue", ["7"]), ("2", "c", "issue", ["7"])])
    assert got == [
        ("1", "authors", "provider-disagreement", "a,b,c", False), ("1", "contributors", "role-disagreement", "a,c", False), ("1", "contributors", "role-disagreement", "b", False),
        ("1", "volume", "substantive-difference", "a,b", False),
        ("2", "identifiers.isbn", "identity-problem", "a", False), ("2", "identifiers.isbn", "provider-disagreement", "a,b", False),
        ("2", "issue", "canonical-missing", "b,c", True)]


def test_findings_read_the_comparisons_once(spark):
    from quire.plans.catalog import auditing as Q

    plan = AU.review_findings(Q.comparisons(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 5  # one scan of the parts for the canonical side and one for each of four providers


def test_neither_side_of_the_comparison_is_broadcast(spark):
    c = spark.createDataFrame([("1", "title", ["A"], False)], CANON)
    p = spark.createDataFrame([("1", "a", 1, "available", "", "title", ["a"], False)], PROV)
    plan = AU.compare(c, p)[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_short_way_equals_the_steps(spark):
    """Comparison forms of the audit, where plain values skip steps, against the form that takes them all."""
    from quire.functions import text as X

    values = ["Plain Title.", "  two  blanks ", "a--b", "x – y", "<i>A</i> b", "AT&amp;T", "$x$ {y} \\alpha", "well- d one", "A 1-2", "Summary: all", "ﬁne Straße", "3 - 3", "12-12", "tab\there", ""]
    rows = [(f, [v]) for v in values for f in ("title", "abstract", "pages", "publisher")] + [
        ("keywords", ["B", "a.", "b"]), ("keywords", []), ("authors", ["Ann Lee", "Bö  Ray"]), ("authors", None), ("keywords", [None, "x"])]
    df = AU.with_canonical_forms(spark.createDataFrame(rows, "field string, value array<string>"), "value")
    whole = F.coalesce(*[F.when(F.col("field") == f, F.col(f"w_{f}")) for f in ("title", "abstract", "pages", "publisher", "keywords", "authors")])
    df = df.withColumns({f"w_{f}": X.norm_value(f, F.col("value")) for f in ("title", "abstract", "pages", "publisher", "keywords", "authors")})
    for r in df.select("field", "value", "canon_norm", whole.alias("whole")).collect():
        assert r["canon_norm"] == r["whole"], (r["field"], r["value"])
