"""Scalar functions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions import identity as I, markup as K, names as N, text as T
from quire.operators import mining as M, references as R


def one(spark, make, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [
    (" https://doi.org/10.1/AbC ", "10.1/abc"), ("doi: 10.1/x", "10.1/x"), ("DOI:10.1/X ", "10.1/x"),
    ("11.1/x", None), ("10.1x", None), ("10.1/a b", None), ("", None)])
def test_norm_doi(spark, raw, want):
    assert one(spark, I.norm_doi, raw) == want


@pytest.mark.parametrize("raw, kinds, legacy, want", [
    ("doi:10.1/A", None, False, ("doi", "10.1/a")), ("10.1/A", None, True, ("doi", "10.1/a")), ("10.1/A", None, False, None),
    ("pmid: 12 ", None, False, ("pmid", "12")), ("pmid:12", ["doi"], False, None), ("9x:1", None, False, None)])
def test_parse_token(spark, raw, kinds, legacy, want):
    got = one(spark, lambda c: I.parse_token(c, kinds, legacy), raw)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("raw, want", [
    ("<p>Hi</p>", "Hi"), ("Abstract: Summary - Text", "Text"), ("Résumé\nle texte", "le texte"), ("Not  available", "")])
def test_clean_abstract(spark, raw, want):
    assert one(spark, lambda c: T.clean_abstract(T.plain_text(c)), raw) == want


@pytest.mark.parametrize("field, raw, want", [
    ("title", "On $\\alpha$-Sets &amp; <i>Rings</i>.", "on α-sets & rings"), ("pages", "12 – 12", "12"), ("pages", "12--15", "12-15"),
    ("abstract", "Abstract. Straße ﬁne", "strasse fine"), ("title", "The E - x pander H 2-norm", "the e -xpander h2-norm"),
    ("publisher", "Ａ＆Ｂ", "a&b")])
def test_norm_text(spark, field, raw, want):
    assert one(spark, lambda c: T.norm_text(field, c), raw) == want


@pytest.mark.parametrize("a, b, want", [
    ("Jan van Dam", "van Dam, J.", True), ("J. A. Smith", "John Smith", True), ("John A. Smith", "John Smith", True),
    ("J. Smith", "K. Smith", False), ("Jean-Paul Li", "Jeanpaul Li", True), ("A. B. Li", "A. C. Li", False), ("José Ruiz", "Jose Ruiz", True)])
def test_names_compatible(spark, a, b, want):
    assert one(spark, N.names_compatible, a, b) is want


def test_contributor_set(spark):
    df = spark.createDataFrame([(["A. Li", "Bo Wu"], ["Bo Wu", "Anna Li"])], "a array<string>, b array<string>")
    df = df.select(N.name_forms("a").alias("a"), N.name_forms("b").alias("b"))
    assert df.select(N.contribs_compatible("a", "b"), N.contribs_same_set("a", "b")).first()[:] == (False, True)


@pytest.mark.parametrize("raw, want", [("<p>a<br>b</p>", False), ("<p>a", True), ("</p>", True), ("<a><b></a></b>", True), ("<x/>", False)])
def test_unbalanced(spark, raw, want):
    assert one(spark, K.tags_unbalanced, raw) is want


CLEAN = [
    ("plain", ("plain", True, "already-clean")), ("<p>a  b</p>", ("a b", True, "normalized")), ("x<sub>2</sub>", ("x<sub>2</sub>", False, "script-markup")),
    ("a <inline-formula><tex-math notation='LaTeX'>$x^2$</tex-math></inline-formula> b", ("a \\(x^2\\) b", True, "normalized")),
    ("<inline-formula><math>q</math></inline-formula>", (None, False, "formula-without-trusted-text")),
    ("&lt;p&gt;a", (None, False, "escaped-markup")), ("<p>a<!-- c --></p>", (None, False, "xml-comment-review")), ("<div>a</div>", (None, False, "unsupported-markup"))]


def test_clean_structured_abstract(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLEAN)], "i int, t string")
    got = {r["i"]: r["r"] for r in K.clean_structured_abstract(df, "t", "r").select("i", "r").collect()}
    for i, (raw, (text, ok, why)) in enumerate(CLEAN):
        assert (got[i]["deterministic"], got[i]["reason"]) == (ok, why), raw
        assert got[i]["normalized"] == (raw if text is None else text)


TITLES = [
    ("A &amp;amp; B", ("A & B", True, "entity-decoding")), ("A <i>b</i> c", ("A b c", True, "structural-unwrapping")),
    ("A<i>b</i> c", (None, False, "ambiguous-inline-boundary")), ("bad �", (None, False, "unicode-replacement")),
    ("x <tex-math>$a$</tex-math>", ("x \\(a\\)", True, "embedded-tex")), ("<math><mi>x</mi></math>", (None, False, "unsupported-mathml"))]


def test_clean_titles(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(TITLES)], "i int, t string")
    got = {r["i"]: r["r"] for r in K.clean_titles(df, "t", "r").select("i", "r").collect()}
    for i, (raw, (text, ok, why)) in enumerate(TITLES):
        assert (got[i]["normalized"], got[i]["deterministic"], got[i]["reason"]) == (raw if text is None else text, ok, why)


def test_cite_tokens(spark):
    assert one(spark, lambda c: F.array_join(R.cite_tokens(c), " "), "Li, L2-norm (1994b).") == "li l 2 norm 1994"


def test_phrase_rules(spark):
    assert one(spark, M.phrase_regex, "deep-learning model") == r"deep[-\s]+learning[-\s]+model"
    assert one(spark, M.redundant_pair, "deep learning", "learning") is True
    assert one(spark, M.redundant_pair, "deep learning", "earning") is False


def test_identifier_map_last_key_wins(spark):
    df = spark.sql("SELECT map('DOI', '10.1/A', ' doi ', '10.1/B') AS m, map('id', 'x') AS bad")
    assert df.select(I.norm_identifiers("m"), I.norm_identifiers("bad")).first()[:] == ({"doi": "10.1/b"}, None)


def test_slugs_of_any_script(spark):
    from quire.functions import text as T
    from quire.operators.authors import name_signature, plan_authors
    cases = {"Nguyễn Văn": "nguyen-van", "Иванов Петр": "ivanov-petr", "Joséphine Müller": "josephine-muller", "Παπαδόπουλος Νίκος": "papadopoulos-nikos",
             "王 小": "u738b-u5c0f", "さくら": "sakura", "한 글": "han-geul", "Łukasz Øster": "lukasz-oster", "***": "", "Щука Юрій": "shchuka-iurii"}
    rows = spark.createDataFrame([(k,) for k in cases], "name string").select("name", T.slugify("name").alias("slug"), name_signature("name").alias("sig")).collect()
    got = {r["name"]: r["slug"] for r in rows}
    assert {k: v for k, v in got.items() if k != "한 글"} == {k: v for k, v in cases.items() if k != "한 글"} and got["한 글"].startswith("h")
    assert {r["name"]: r["sig"] for r in rows}["***"] is None
    pubs = spark.createDataFrame([("1", ["***", "+++", "Иванов Петр"])], "id string, authors array<string>")
    safe, review = plan_authors(pubs, spark.createDataFrame([], "slug string, name string"))
    assert [r["slug"] for r in safe.collect()] == ["ivanov-petr"] and sorted(r["name"] for r in review.collect()) == ["***", "+++"]


def test_name_tokens_of_any_script(spark):
    from quire.functions.names import name_tokens, names_compatible
    row = spark.createDataFrame([("Joséphine Dü", "Иванов Петр", "Nguyễn Văn", "Nguyen Van")], "a string, b string, c string, d string").select(
        name_tokens("a").alias("a"), name_tokens("b").alias("b"), names_compatible("c", "d").alias("same"), names_compatible("b", "d").alias("other")).first()
    assert row["a"] == ["josephine", "du"] and row["b"] == ["иванов", "петр"] and row["same"] and not row["other"]


def test_tight_equals_the_spacing_patterns(spark):
    from pyspark.sql import functions as F
    from quire.functions import text as X

    rows = spark.createDataFrame([(x,) for x in ["a - b", "a -b , c ; d", "x  -  y\t.", "é – è !", "", None]], "t string")
    form = X.norm_text("title", "t")
    old = F.regexp_replace(F.regexp_replace(form, r"(?U)\s*-\s*", "-"), r"(?U)\s+([,.;:!?])", "$1")
    assert all(r["new"] == r["old"] for r in rows.select(X.tight(form).alias("new"), old.alias("old")).collect())
