"""Field-by-field comparison of provider evidence with the canonical table.

Both sides are long tables: publication_id, field, value array<string>, is_list; provider
rows add provider, p_ord, status, detail. A publication has one row per provider and field,
so every window and group over (publication, field) is bounded by the number of providers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quire.functions.markup import clean_given_abstract
from quire.functions.names import contribs_compatible, contribs_same_set, name_parts
from quire.functions.sequences import similar, similar_udf
from quire.functions.staging import let, stage
from quire.functions.text import (
    _JOIN, _after_unicode, _before_unicode, _plain_form, display_name, is_ascii, nfkc, one_day_apart, strip, tight, unescape_entities,
)

# The compared fields; the list fields among them.
AUDIT_FIELDS = ["type", "title", "authors", "editors", "abstract", "container_title", "publication_year", "volume", "issue",
                "pages", "publisher", "event", "keywords", "created_date"]
LIST_FIELDS = ["authors", "editors", "keywords"]


def audit_record(pubs: DataFrame) -> DataFrame:
    """Publications to one row per compared field."""
    people = lambda c: F.transform(F.col(c), display_name)
    value = {
        "authors": people("authors"), "editors": people("editors"), "keywords": F.col("keywords"),
        "created_date": F.array(F.coalesce(F.col("created_date").cast("string"), F.lit(""))),
    }
    rows = [
        F.struct(F.lit(f).alias("field"), value.get(f, F.array(F.col(f))).alias("value"), F.lit(f in LIST_FIELDS).alias("is_list"))
        for f in AUDIT_FIELDS if f in pubs.columns
    ]
    return pubs.select(F.col("id").alias("publication_id"), F.explode(F.array(*rows)).alias("r")).select("publication_id", "r.*")


def is_empty(value: Column) -> Column:
    return ~F.exists(F.coalesce(value, F.array().cast("array<string>")), lambda x: strip(x) != "")


def _joined(field: Column, arr: Column) -> Column:
    """``struct(all, odd)``: the joined values, and again as ``odd`` if an Unicode, markup, TeX, dash or space step of the comparison form might change one."""
    odd = lambda j: (
        ~is_ascii(j) | j.contains("&") | j.contains("<") | j.contains("  ") | j.contains("--") | F.replace(j, F.lit(_JOIN), F.lit("")).rlike(r"\p{Cntrl}")
        | ((field == "title") & j.contains("-")) | (field.isin("title", "abstract") & j.rlike(r"[$\\{}]")))
    return let(F.array_join(arr, _JOIN), lambda j: F.struct(j.alias("all"), F.when(odd(j), j).alias("odd")))


def _norm(field: Column, arr: Column, joined: Column, odd: Column) -> Column:
    """Comparison form of a value array; ``odd`` holds the values that passed the Unicode steps, the others take a short way."""
    pieces = lambda c: F.split(c, _JOIN)
    out = F.when(odd.isNotNull(), F.transform(pieces(odd), lambda x: _after_unicode(x, field))).otherwise(
        F.transform(pieces(joined), lambda x: _plain_form(x, field)))
    out = let(out, lambda x: F.when(field == "keywords", F.sort_array(F.array_distinct(x))).otherwise(x))
    return F.when(F.size(arr) == 0, F.array().cast("array<string>")).otherwise(out)


def _through_unicode(df: DataFrame, *keys: str) -> DataFrame:
    """Add ``_n_<key>`` for each column ``_j_<key>`` of ``_joined`` values: the odd ones after both Unicode steps, which all keys pass together."""
    field = F.col("field")
    df = df.withColumns({f"_u_{k}": unescape_entities(F.col(f"_j_{k}.odd")) for k in keys})
    df = stage(df, **{f"_b_{k}": F.array_join(F.transform(F.split(f"_u_{k}", _JOIN), lambda x: _before_unicode(x, field)), _JOIN) for k in keys})
    return df.withColumns({f"_n_{k}": nfkc(f"_b_{k}") for k in keys}).drop(*[f"_{x}_{k}" for x in "ub" for k in keys])


def _forms(field: Column, arr: Column, norm: Column) -> Column:
    forms = F.zip_with(norm, F.transform(arr, name_parts), lambda n, p: F.struct(n.alias("norm"), p["given"].alias("given"), p["family"].alias("family")))
    return F.when(field.isin("authors", "editors"), forms)


# Least similarity of near-equal texts, and of their lengths.
NEAR, NEAR_LENGTH = 0.98, 0.95
_near_udf = similar_udf(NEAR)
_near_tokens_udf = similar_udf(NEAR, tokens=True)


def _compact(c: Column) -> Column:
    return let(c, lambda x: F.when(is_ascii(x), F.regexp_replace(x, r"\W+", "")).otherwise(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", "")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _near_pairs(texts: pd.Series) -> pd.Series:
    """Pairs ``i < j`` of near texts in each list, as ``i * n + j``; null texts are near to nothing."""
    def pairs(own):
        near = lambda a, b: min(len(a), len(b)) >= NEAR_LENGTH * max(len(a), len(b)) and similar(a, b, NEAR)
        return [i * len(own) + j for j, b in enumerate(own) for i, a in enumerate(own[:j]) if a and b and a != b and near(a, b)]

    return pd.Series([None if t is None else pairs(list(t)) for t in texts], dtype="object")


def _near_asked(a: Column, b: Column) -> Column:
    """``struct(equal, a, b)`` of two texts, else null: equal but for marks, and the texts if that takes sequence matching."""
    def guarded(x: Column, y: Column) -> Column:
        close = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y)) >= NEAR_LENGTH
        return let(_compact(x) == _compact(y), lambda equal: F.struct(
            equal.alias("equal"), F.when(~equal & close, x).alias("a"), F.when(~equal & close, y).alias("b")))

    pair = F.struct(F.nullif(a, F.lit("")).alias("a"), F.nullif(b, F.lit("")).alias("b"))
    return let(pair, lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), guarded(p["a"], p["b"])))


def _near(asked: str) -> Column:
    return F.coalesce(F.col(f"{asked}.equal"), F.lit(False)) | F.coalesce(_near_udf(f"{asked}.a", f"{asked}.b"), F.lit(False))


def with_near(df: DataFrame, a: Column, b: Column, out: str) -> DataFrame:
    """Add ``out``: normalised abstracts differ only marginally. Guards keep other pairs inside the JVM."""
    return stage(df, _q=_near_asked(a, b)).withColumn(out, _near("_q")).drop("_q")


def with_truncation(df: DataFrame, canon: Column, prov: Column, out: str) -> DataFrame:
    """Add ``out``: the normalised provider abstract is a prefix, clearly shorter than the canonical one."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def fitting(pair: Column) -> Column:
        c, p = pair["c"], pair["p"]
        n, m = F.size(p), F.size(c)
        head = F.slice(c, F.lit(1), n)
        return F.when((n >= 8) & (n < m) & (n / m <= 0.9), let(head == p, lambda exact: F.struct(
            exact.alias("exact"), F.when(~exact, head).alias("head"), F.when(~exact, p).alias("p"))))

    df = stage(df, _q=let(F.struct(canon.alias("c"), prov.alias("p")), lambda pair: F.when(
        F.length(pair["p"]) < F.length(pair["c"]), let(F.struct(words(pair["c"]).alias("c"), words(pair["p"]).alias("p")), fitting))))
    df = df.withColumn("_n", _near_tokens_udf("_q.head", "_q.p"))
    return df.withColumn(out, F.coalesce("_q.exact", F.lit(False)) | F.coalesce("_n", F.lit(False))).drop("_q", "_n")


def with_canonical_forms(df: DataFrame, value: str) -> DataFrame:
    """Add ``canon_norm`` and ``canon_forms`` of the canonical values in column ``value``."""
    field, arr = F.col("field"), F.col(value)
    df = _through_unicode(stage(df, _j_canon=_joined(field, arr)), "canon")
    made = let(_norm(field, arr, F.col("_j_canon.all"), F.col("_n_canon")), lambda norm: F.struct(
        norm.alias("norm"), _forms(field, arr, norm).alias("forms")))
    return stage(df, _c=made).withColumns({"canon_norm": F.col("_c.norm"), "canon_forms": F.col("_c.forms")}).drop("_c", "_j_canon", "_n_canon")


def classify(df: DataFrame) -> DataFrame:
    """Add ``classification`` to rows with field, canonical_value, provider_value and is_identity.

    Also leaves the comparison forms (``canon_norm``, ``prov_norm``, ``canon_forms``,
    ``prov_forms``) for the operators that follow; canonical forms that are there already (see
    ``with_canonical_forms``) are used. Sequence matching comes last. What lies between two steps in Python
    is one stage, and a row evaluates in it what its field needs.
    """
    field, canonical, provider = F.col("field"), F.col("canonical_value"), F.col("provider_value")
    own = "canon_norm" not in df.columns
    abstract = let(F.get(provider, F.lit(0)), lambda x: F.when((field == "abstract") & (strip(x) != ""), x))

    def read(cleaned: Column) -> Column:
        clean = F.coalesce(cleaned["deterministic"], F.lit(True))
        value = F.when(F.col("_pa").isNull() | ~clean, provider).otherwise(F.array(cleaned["normalized"]))
        return let(value, lambda v: F.struct((F.col("_pa").isNotNull() & ~clean).alias("refused"), v.alias("value"), _joined(field, v).alias("joined")))

    df = clean_given_abstract(stage(df, _pa=abstract), "_pa", "_p", read)
    df = df.withColumn("_j_prov", F.col("_p.joined"))
    df = _through_unicode(stage(df, _j_canon=_joined(field, canonical)) if own else df, *["canon"] * own, "prov")
    value = F.col("_p.value")

    def compared(a: Column, b: Column, a_forms: Column, b_forms: Column, no_canon: Column, no_prov: Column) -> Column:
        same = (a == b) | F.coalesce(F.when(field.isin("authors", "editors"), contribs_compatible(a_forms, b_forms)), F.lit(False))
        first = lambda x: F.get(x, F.lit(0))
        return let(same, lambda same: F.struct(
            a.alias("canon_norm"), b.alias("prov_norm"), a_forms.alias("canon_forms"), b_forms.alias("prov_forms"), no_canon.alias("no_canon"), no_prov.alias("no_prov"),
            same.alias("same"), F.when((field == "abstract") & ~no_canon & ~no_prov & ~same, _near_asked(first(a), first(b))).alias("near")))

    a = _norm(field, canonical, F.col("_j_canon.all"), F.col("_n_canon")) if own else F.col("canon_norm")
    forms = lambda a: _forms(field, canonical, a) if own else F.col("canon_forms")
    df = stage(df, _r=let(a, lambda a: let(_norm(field, value, F.col("_j_prov.all"), F.col("_n_prov")), lambda b: let(forms(a), lambda a_forms: let(
        _forms(field, value, b), lambda b_forms: let(is_empty(canonical), lambda no_canon: let(is_empty(value), lambda no_prov: compared(
            a, b, a_forms, b_forms, no_canon, no_prov))))))))
    r = lambda name: F.col(f"_r.{name}")
    verdict = (
        F.when(F.col("_p.refused"), "provider-review-required")
        .when(r("no_canon") & r("no_prov"), "equal").when(r("no_canon"), "canonical-missing").when(r("no_prov"), "provider-missing")
        .when(canonical == value, "equal")
        .when(r("same") | F.col("_near"), "formatting-only")
        .when(F.col("is_identity"), "identity-problem").otherwise("substantive-difference"))
    df = stage(df.withColumn("_near", _near("_r.near")), classification=verdict)
    made = [x for x in ("canon_norm", "prov_norm", "canon_forms", "prov_forms") if own or x.startswith("prov")]
    return df.withColumns({x: r(x) for x in made}).drop("_pa", "_p", "_j_prov", "_n_prov", "_j_canon", "_n_canon", "_r", "_near")


def compare(canon_long: DataFrame, prov_long: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(comparisons, provider issues, violations)``. Identifier fields are named ``identifiers.<name>``.

    Both sides are dealt by publication and field before any form is made, so the work spreads however the
    tables are stored; neither side is broadcast, for a table of publications is small on disk alone.
    """
    keys = ["publication_id", "field"]
    known = F.col("field").isin(AUDIT_FIELDS) | F.col("field").startswith("identifiers.")
    available = prov_long.filter("status = 'available'")
    # canonical values are brought into their forms once, before they meet their providers
    canon = with_canonical_forms(canon_long.select(*keys, F.col("value").alias("canonical_value")).repartition(*keys), "canonical_value")
    rows = available.filter(known).withColumnRenamed("value", "provider_value").join(canon.hint("merge"), keys, "left")
    none = F.array(F.lit(""))
    nobody = F.array(F.struct(F.lit("").alias("norm"), F.array().cast("array<string>").alias("given"), F.array().cast("array<string>").alias("family")))
    rows = rows.withColumns({
        "canonical_value": F.coalesce("canonical_value", none), "canon_norm": F.coalesce("canon_norm", none),
        "canon_forms": F.coalesce("canon_forms", F.when(F.col("field").isin("authors", "editors"), nobody))})
    rows = rows.withColumn("is_identity", F.col("field").startswith("identifiers.") & ~is_empty(F.col("canonical_value")))
    issues = prov_long.filter("status <> 'available'").select(
        "publication_id", "provider", F.col("status").alias("classification"), "detail").distinct()
    return classify(rows), issues, available.filter(~known).select("publication_id", "provider", "field")


def reclassify(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored comparisons under the current rules, and counts of before and after per class."""
    before = stored.withColumnRenamed("classification", "before")
    before = before.withColumn("is_identity", F.col("field").startswith("identifiers.") & ~is_empty(F.col("canonical_value")))
    after = classify(before)
    summary = after.groupBy("before", "classification").agg(F.count("*").alias("n"))
    return after, summary


_AGREES = ("equal", "formatting-only")


def _entries(comparisons: DataFrame, *extra: Column) -> DataFrame:
    """One row per (publication, field) with its comparisons in provider order as ``e``: as many as there are providers."""
    c = F.col
    entry = F.struct("p_ord", "provider", c("provider_value").alias("value"), c("classification").alias("cls"), c("prov_norm").alias("norm"), c("prov_forms").alias("forms"),
                     ((c("classification") != "provider-review-required") & ~is_empty(c("provider_value"))).alias("given"), *extra)
    return comparisons.groupBy("publication_id", "field").agg(
        F.sort_array(F.collect_list(entry)).alias("e"), F.first("canonical_value").alias("canonical_value"), F.first("is_list").alias("is_list"),
        *([F.first("_ed").alias("_ed")] if "_ed" in comparisons.columns else []))


def _with_equivalences(groups: DataFrame) -> DataFrame:
    """Add ``_eq``: the pairs ``i < j`` of entries with equivalent values, as ``i * n + j``.

    Values are equivalent if they or their comparison forms are equal, if they are lists of
    compatible people, or if they are near-equal abstracts. Only abstracts with several forms leave the JVM.
    """
    e, n = F.col("e"), F.size("e")
    people, text = F.col("field").isin("authors", "editors"), F.col("field") == "abstract"
    form = lambda x: F.when(x["given"], F.get(x["norm"], F.lit(0)))
    several = text & (F.size(F.array_distinct(F.transform(e, form))) > 1)
    groups = stage(groups, _texts=F.when(several, F.transform(e, form)))
    groups = groups.withColumn("_found", _near_pairs("_texts"))
    compact = F.transform("_texts", lambda x: F.nullif(_compact(x), F.lit("")))
    groups = stage(groups, _compact=compact, _near=F.coalesce("_found", F.array().cast("array<int>")))

    def same(i: Column, j: Column) -> Column:
        a, b = F.get(e, i), F.get(e, j)
        return (a["value"] == b["value"]) | (a["norm"] == b["norm"]) | F.coalesce(
            F.when(people, contribs_compatible(a["forms"], b["forms"])).when(
                several, F.array_contains("_near", i * n + j) | F.coalesce(F.get(F.col("_compact"), i) == F.get(F.col("_compact"), j), F.lit(False))), F.lit(False))

    up_to = lambda k: F.filter(F.sequence(F.lit(0), F.greatest(k, F.lit(0))), lambda x: x < k)
    pairs = F.flatten(F.transform(up_to(n), lambda j: F.transform(F.filter(up_to(j), lambda i: same(i, j)), lambda i: i * n + j)))
    return stage(groups, _eq=pairs).drop("_texts", "_found", "_near", "_compact")


def _split(e: Column, pairs: Column) -> Column:
    """Several entries give values, and not all are equivalent to the first of them."""
    given = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: F.get(e, i)["given"])
    first = F.get(given, F.lit(0))
    return (F.size(given) > 1) & F.exists(given, lambda j: (j > first) & ~F.array_contains(pairs, first * F.size(e) + j))


def disagreements(comparisons: DataFrame) -> DataFrame:
    """Fields on which at least two providers give values that are not all equivalent.

    More than one class of equivalent values exists exactly when some value differs from the
    first one, so each value is compared with the first only.
    """
    groups = _with_equivalences(_entries(comparisons))
    values = F.transform(F.filter("e", lambda x: x["given"]), lambda x: F.struct(x["p_ord"].alias("p_ord"), x["provider"].alias("provider"), x["value"].alias("provider_value")))
    return groups.filter(_split(F.col("e"), F.col("_eq"))).select("publication_id", "field", values.alias("values"), "is_list")


def stored_disagreements(comparisons: DataFrame) -> DataFrame:
    """The same on stored values: more than one distinct comparison form."""
    rows = comparisons.filter((F.col("classification") != "provider-review-required") & ~is_empty(F.col("provider_value")))
    return rows.groupBy("publication_id", "field").agg(
        F.count("*").alias("n"), F.size(F.collect_set("prov_norm")).alias("forms")).filter("n >= 2 AND forms > 1")


def _united(e: Column, able: Column, joined) -> Column:
    """For each entry the first of its finding: the earliest one that starts a finding and is ``joined(i, j)`` with it; -1 where ``able`` is false."""
    start = F.array().cast("array<int>")

    def step(labels: Column, j: Column) -> Column:
        heads = F.filter(F.transform(labels, lambda label, i: F.when(label == i, i)), lambda i: i.isNotNull() & joined(i, j))
        return F.concat(labels, F.array(F.when(F.get(able, j), F.coalesce(F.get(heads, F.lit(0)), j)).otherwise(F.lit(-1)).cast("int")))

    return F.aggregate(F.sequence(F.lit(0), F.size(e) - 1), start, step)


def review_findings(comparisons: DataFrame) -> DataFrame:
    """Findings for human review with their actionability.

    Equal and provider-missing pairs are dropped, an author list of an editor-only record
    becomes a role finding, year and venue differences vanish if another provider confirms
    the canonical value, equivalent alternatives of several providers are united under the first of
    them, and what two providers agree on without a confirming third is actionable.
    ``comparisons`` is read once and dealt by publication; the comparisons of a field meet in one
    array, as many as there are providers, and all its findings come from that array.
    """
    c = F.col
    first = lambda x: F.get(c(x), F.lit(0))
    is_text = (c("field") == "abstract") & (c("classification") == "substantive-difference")
    rows = with_truncation(comparisons, F.when(is_text, first("canon_norm")), F.when(is_text, first("prov_norm")), "_cut")
    editors = F.when((c("field") == "editors") & ~is_empty(c("canonical_value")), F.struct("canonical_value", "canon_forms"))
    rows = rows.withColumn("_ed", F.first(editors, ignorenulls=True).over(Window.partitionBy("publication_id")))
    day = (c("field") == "created_date") & one_day_apart(first("canonical_value"), first("provider_value"))
    groups = _with_equivalences(_entries(rows, day.alias("day"), c("_cut").alias("cut")))

    e, n, field = c("e"), F.size("e"), c("field")
    agrees = lambda x: x["cls"].isin(*_AGREES)
    titled = field.isin("title", "abstract")
    loose = lambda x: F.when(titled & x["given"], F.transform(x["norm"], tight))
    groups = stage(groups, _supported=F.exists(e, agrees), _loose=F.transform(e, loose),
                   _confirm=F.array_distinct(F.transform(F.filter(e, lambda x: agrees(x) & ~is_empty(x["value"])), lambda x: x["provider"])))
    role = lambda x: (field == "authors") & (x["cls"] == "canonical-missing") & c("_ed").isNotNull()
    muted = lambda x: (x["cls"] == "substantive-difference") & field.isin("publication_year", "container_title") & c("_supported")
    plain = F.transform(e, lambda x: ~agrees(x) & (x["cls"] != "provider-missing") & ~role(x) & ~muted(x))
    editorial = F.transform(e, lambda x: F.when(role(x), F.when(
        contribs_same_set(c("_ed.canon_forms"), x["forms"]), "provider authors match canonical editors").otherwise("provider reports authors for canonical editor-only record")))
    groups = stage(groups, _plain=plain, _role=editorial)
    at = lambda i: F.get(e, i)
    equivalent = lambda i, j: F.array_contains("_eq", i * n + j) | F.coalesce(F.get(c("_loose"), i) == F.get(c("_loose"), j), F.lit(False))
    # only findings of one class, or roles with one remark and one form, are united
    groups = stage(
        groups,
        _of=_united(e, c("_plain"), lambda i, j: (at(i)["cls"] == at(j)["cls"]) & (at(i)["cls"] != "provider-review-required") & equivalent(i, j)),
        _role_of=_united(e, F.transform("_role", lambda r: r.isNotNull()), lambda i, j: (F.get(c("_role"), i) == F.get(c("_role"), j)) & (at(i)["norm"] == at(j)["norm"])))

    shape = lambda members: F.transform(members, lambda x: F.struct(x["provider"].alias("provider"), x["value"].alias("value")))
    names = lambda members: F.array_distinct(F.transform(members, lambda x: x["provider"]))
    judge = lambda ok, why: F.struct(F.lit(ok).alias("actionable"), (why if isinstance(why, Column) else F.lit(why)).alias("detail"))

    def verdict(members: Column) -> Column:
        cls, count = F.get(members, F.lit(0))["cls"], F.size(names(members))
        others = F.size(F.array_except(c("_confirm"), names(members))) > 0
        return (
            F.when(cls == "provider-review-required", judge(False, "provider abstract holds unsupported markup"))
            .when((field == "publication_id") & (cls == "identity-problem"), judge(True, "canonical publication is missing"))
            .when(F.exists(members, lambda x: x["day"]), judge(False, "created_date differs by one day"))
            .when(F.forall(members, lambda x: x["cut"]), judge(False, "provider abstract is a truncation"))
            .when(count < 2, judge(False, "single-provider difference"))
            .when(cls.isin("substantive-difference", "identity-problem") & others, judge(False, "another provider confirms the canonical value"))
            .otherwise(judge(True, F.concat(F.lit("corroborated by "), count.cast("string"), F.lit(" providers")))))

    def finding(name, cls, members: Column, canonical, judged: Column) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(text(name).alias("field"), text(cls).alias("classification"), names(members).alias("providers"), canonical.alias("canonical_value"),
                        shape(members).alias("provider_values"), judged["actionable"].alias("actionable"), judged["detail"].alias("detail"))

    heads = lambda labels: F.filter(F.transform(labels, lambda label, i: F.when(label == i, i)), lambda i: i.isNotNull())
    members = lambda labels, i: F.filter(e, lambda _, k: F.get(labels, k) == i)
    found = F.transform(heads(c("_of")), lambda i: finding(field, at(i)["cls"], members(c("_of"), i), c("canonical_value"), verdict(members(c("_of"), i))))
    roles = F.transform(heads(c("_role_of")), lambda i: finding(
        "contributors", "role-disagreement", members(c("_role_of"), i), c("_ed.canonical_value"), judge(False, F.get(c("_role"), i))))
    quiet = (field.isin("publication_year", "container_title") & c("_supported")) | F.exists(e, lambda x: x["cls"] == "substantive-difference")
    split = F.when(~quiet & _split(e, c("_eq")), F.array(finding(
        field, "provider-disagreement", F.filter(e, lambda x: x["given"]), c("canonical_value"), judge(False, ""))))
    every = F.concat(found, roles, F.coalesce(split, F.slice(found, 1, 0)))
    return groups.select("publication_id", F.explode(every).alias("f")).select("publication_id", "f.*")


def missing_canonical(items: DataFrame, pubs: DataFrame) -> DataFrame:
    """Audited publications that the canonical table does not hold."""
    gone = items.select("publication_id").distinct().join(pubs.select(F.col("id").alias("publication_id")), "publication_id", "left_anti")
    return gone.select(
        "publication_id", F.lit("publication_id").alias("field"), F.lit("identity-problem").alias("classification"),
        F.array(F.lit("")).alias("canonical_value"), F.array("publication_id").alias("provider_value"))


def failure_status(code) -> Column:
    """Class of a failed lookup by its response code."""
    return F.when(F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit(0)).isin(400, 401, 403), "error").otherwise("unavailable")


def classification_counts(comparisons: DataFrame, issues: DataFrame) -> DataFrame:
    """How often each class occurs among comparisons and provider issues, and how many fields have a provider disagreement; ``comparisons`` is read once."""
    groups = _with_equivalences(_entries(comparisons))
    split = F.when(_split(F.col("e"), F.col("_eq")), F.array(F.lit("provider-disagreement"))).otherwise(F.array().cast("array<string>"))
    found = groups.select(F.explode(F.concat(F.transform("e", lambda x: x["cls"]), split)).alias("classification"))
    return found.unionByName(issues.select("classification")).groupBy("classification").agg(F.count("*").alias("n"))


def audit_summary(results: DataFrame, findings: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: audited and flagged publications, actionable and informational findings, provider issues.

    ``results`` needs nothing but the ids of the audited publications, repeated or not.
    """
    tagged = (results.select("publication_id", F.lit("r").alias("t")).distinct()
              .unionByName(findings.select("publication_id", F.when(F.col("actionable"), "a").otherwise("i").alias("t")))
              .unionByName(issues.select("publication_id", F.lit("p").alias("t"))))
    per = tagged.groupBy("publication_id").agg(*[F.count_if(F.col("t") == k).alias(k) for k in "raip"])
    return per.agg(
        F.count_if(F.col("r") > 0).alias("audited"),
        F.count_if(F.col("a") + F.col("i") > 0).alias("flagged"), F.sum("a").alias("actionable"),
        F.sum("i").alias("informational"), F.sum("p").alias("provider_issues"))


def latest_results(results: DataFrame, key: str = "publication_id", order: str = "attempt") -> DataFrame:
    """Last attempt of every item."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
