"""Queries of reference lists: the sentences of a document serve as its references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.staging import stage
from quire.operators import references as R
from quire.plans import views as V
from quire.plans.catalog import query
from quire.session import cut_lineage


def lists(spark, sf) -> DataFrame:
    """Documents with their sentences as canonical list, and a provider list that adds, drops and alters some.

    A sentence of more than 60 characters carries a DOI. By document language the provider
    returns the same list (en), other case (fr), one more reference (de) or a shorter list (es).
    """
    d = V.table(spark, sf, "documents").select("doc_id", "lang", "text")
    sentences = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda s: F.btrim(s)), lambda s: s != "")
    d = stage(d, s=sentences)
    ref = lambda c: F.struct(F.when(F.length(c) > 60, F.concat(F.lit("10.2/"), F.substring(F.md5(c), 1, 12))).alias("doi"), c.alias("citation"))
    d = stage(d, refs=F.transform("s", ref))
    more = lambda r: r.withField("deterministic", F.lit(True)).withField("reason", F.lit("clean"))
    loud = F.transform("refs", lambda r: r.withField("citation", F.concat(r["citation"], F.lit(";"))))
    longer = F.concat("refs", F.array(F.struct(F.lit("10.9/added").alias("doi"), F.lit("Added by the provider").alias("citation"))))
    shorter = F.slice("refs", F.lit(2), F.greatest(F.size("refs"), F.lit(1)))
    prov = (F.when(F.col("lang") == "fr", loud).when(F.col("lang") == "de", longer).when(F.col("lang") == "es", shorter).otherwise(F.col("refs")))
    return d.select(F.col("doc_id").alias("id"), "lang", "refs", F.transform(prov, more).alias("prov"),
                    F.lit(True).alias("available"), F.lit("").alias("unavailable_reason"))


def _explained(spark, sf) -> DataFrame:
    return R.explain_drift(R.align_references(cut_lineage(R.compare_references(lists(spark, sf)))))


_S = r"""WITH s AS (SELECT doc_id AS id, lang, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
  n AS (SELECT *, len(s) AS n FROM s)"""


@query("f14_cite_tokens", r"""SELECT doc_id AS id, md5(array_to_string(flatten(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'),
    lambda w: CASE WHEN regexp_matches(w, '^\d{4}[a-z]$') THEN [substr(w, 1, 4)] ELSE regexp_extract_all(w, '[\p{L}]+|\p{Nd}+|_|[^\p{L}\p{Nd}_]+') END)), ' ')) AS h FROM documents""")
def f14(spark, sf):
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(F.array_join(R.cite_tokens("text"), " ")).alias("h"))


@query("f15_doi_cmp", "SELECT p_partkey, lower('10.1/' || p_brand || '-' || p_type) AS d FROM part")
def f15(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", R.doi_cmp(F.concat(F.lit("10.1/"), "p_brand", F.lit("–"), "p_type")).alias("d"))


@query("f20_reference_keys", _S + r""", e AS (SELECT id, unnest(s) AS c, unnest(range(1, n + 1)) AS pos FROM n),
    b AS (SELECT *, CASE WHEN length(c) > 60 THEN 'doi:10.2/' || substr(md5(c), 1, 12) ELSE 'sha256:' || substr(sha256(c), 1, 16) END AS base FROM e)
    SELECT id, pos, CASE WHEN count(*) OVER (PARTITION BY id, base) > 1 THEN base || '#' || row_number() OVER (PARTITION BY id, base ORDER BY pos) ELSE base END AS key FROM b""")
def f20(spark, sf):
    d = stage(lists(spark, sf).select("id", "refs"), k=R.reference_keys("refs"))
    return d.select("id", F.posexplode_outer("k").alias("p", "key")).filter("key IS NOT NULL").select("id", (F.col("p") + 1).alias("pos"), "key")


@query("t10_changed_indices", _S + """ SELECT id, CASE lang WHEN 'fr' THEN n WHEN 'de' THEN 1 WHEN 'es' THEN
    (SELECT count(*) FROM (SELECT unnest(range(1, n + 1)) AS i) WHERE s[i] IS DISTINCT FROM s[i + 1]) ELSE 0 END AS changed FROM n""")
def t10(spark, sf):
    return lists(spark, sf).select("id", F.size(R.changed_indices("refs", "prov")).cast("long").alias("changed"))


_R1 = _S + """, r AS (SELECT id, lang, n, CASE WHEN n = 0 AND lang <> 'de' THEN 'unchanged' WHEN lang = 'en' THEN 'unchanged' ELSE 'review-required' END AS classification,
    CASE WHEN (n = 0 AND lang <> 'de') OR lang = 'en' THEN 'provider-reference-list-unchanged' WHEN lang = 'fr' THEN 'reference-citation-drift:1' ELSE 'reference-count-changed' END AS reason FROM n)"""


@query("r1_compare_references", _R1 + " SELECT id, classification, reason, n AS current_count FROM r")
def r1(spark, sf):
    return R.compare_references(lists(spark, sf)).select("id", "classification", "reason", F.col("current_count").cast("long").alias("current_count"))


@query("r2_align_references", _S + """, a AS (SELECT id, lang, n, len(list_distinct(s)) AS u FROM n)
    SELECT id, CASE WHEN lang = 'en' OR lang = 'de' THEN n ELSE NULL END AS unchanged, CASE WHEN lang = 'de' THEN 1 WHEN lang = 'es' THEN 0 ELSE 0 END AS inserted,
    CASE WHEN lang = 'es' AND n > 0 THEN 1 ELSE 0 END AS removed FROM a""")
def r2(spark, sf):
    d = R.align_references(lists(spark, sf))
    count = lambda k: F.size(F.filter("rows", lambda r: r["kind"] == k)).cast("long")
    same = F.when(F.col("lang").isin("en", "de"), count("unchanged"))
    return stage(d.select("id", "lang", "rows"), unchanged=same, inserted=count("inserted"), removed=count("removed")).select(
        "id", "unchanged", "inserted", "removed")


@query("r2_alignment_covers_lists", _S + " SELECT id, n AS current_rows, CASE lang WHEN 'de' THEN n + 1 WHEN 'es' THEN greatest(n - 1, 0) ELSE n END AS provider_rows FROM n")
def r2_cover(spark, sf):
    d = R.align_references(lists(spark, sf))
    seen = lambda f: F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r[f]), lambda i: i.isNotNull()))).cast("long")
    return d.select("id", seen("current_index").alias("current_rows"), seen("provider_index").alias("provider_rows"))


@query("r3_drift_evidence", _S + r""", e AS (SELECT id, unnest(s) AS c, unnest(range(1, n + 1)) AS pos FROM n)
    SELECT id, pos, CASE WHEN length(c) > 60 THEN 'same-doi' WHEN pos > 1 THEN 'formatting' WHEN regexp_matches(c, '[\p{L}\p{N}_]') THEN 'metadata-enrichment' END AS evidence FROM e""")
def r3(spark, sf):
    d = stage(lists(spark, sf).select("id", "refs"), c=R.with_tokens(F.col("refs")))
    alter = lambda r, i: r.withField("citation", F.when((i == 0) & r["doi"].isNull(), F.concat(r["citation"], F.lit(" (extended edition)"))).otherwise(F.upper(r["citation"])))
    d = stage(d, p=R.with_tokens(F.transform("refs", alter)))
    pairs = d.select("id", F.posexplode_outer(F.zip_with("c", "p", lambda a, b: R.drift_evidence(a, b))).alias("i", "evidence"))
    return pairs.filter("i IS NOT NULL").select("id", (F.col("i") + 1).alias("pos"), "evidence")


@query("r4_explain_drift", _R1 + """ SELECT id, CASE WHEN lang = 'fr' THEN CASE WHEN list_bool_and(list_transform((SELECT s FROM s WHERE s.id = r.id), lambda x: length(x) > 60))
      THEN 'same-doi-citation-drift' ELSE 'citation-formatting-drift' END WHEN lang = 'de' THEN 'explained-provider-expansion' ELSE 'ambiguous-structural-drift' END AS explanation
    FROM r WHERE classification = 'review-required'""")
def r4(spark, sf):
    return _explained(spark, sf).filter("explanation IS NOT NULL").select("id", "explanation")


@query("a15_explanation_counts", _R1 + """ SELECT explanation, count(*) AS n FROM (SELECT CASE WHEN lang = 'fr' THEN CASE WHEN list_bool_and(list_transform(
    (SELECT s FROM s WHERE s.id = r.id), lambda x: length(x) > 60)) THEN 'same-doi-citation-drift' ELSE 'citation-formatting-drift' END
    WHEN lang = 'de' THEN 'explained-provider-expansion' ELSE 'ambiguous-structural-drift' END AS explanation FROM r WHERE classification = 'review-required') GROUP BY 1""")
def a15(spark, sf):
    return R.explanation_counts(_explained(spark, sf))


@query("r5_safe_projection", _R1 + """ SELECT id, CASE WHEN lang = 'de' THEN n + 1 ELSE n END AS size, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS inserted_references,
    CASE WHEN lang = 'fr' THEN n ELSE 0 END AS citation_updates, 0 AS identifier_updates FROM r""")
def r5(spark, sf):
    return R.safe_projection(_explained(spark, sf)).select(
        "id", F.size("projected").alias("size"), "inserted_references", "citation_updates", "identifier_updates")


@query("r6_needs_review", _R1 + " SELECT id, lang = 'es' AND n > 0 AS needs_review FROM r")
def r6(spark, sf):
    return R.safe_projection(_explained(spark, sf)).select("id", "needs_review")


def _items(spark, sf) -> DataFrame:
    p = R.safe_projection(_explained(spark, sf))
    return p.withColumn("now_fingerprint", F.when(F.col("current_count") > 40, F.lit("moved")).otherwise(F.col("current_fingerprint")))


@query("r7_apply_safe", _R1 + """ SELECT id, CASE WHEN n > 40 THEN 'stale' WHEN lang IN ('fr', 'de') AND (n > 0 OR lang = 'de') THEN 'change' ELSE 'policy' END AS status
    FROM r WHERE n > 40 OR NOT (lang = 'es' AND n > 0)""")
def r7(spark, sf):
    items = cut_lineage(_items(spark, sf).select("id", "projected", "inserted_references", "citation_updates", "identifier_updates", "needs_review",
                                                 "current_fingerprint", "proposed_fingerprint", "now_fingerprint"))  # read three times
    changes, policy, stale = R.apply_safe_references(items, spark.createDataFrame([], "id long, fingerprint string"))
    tag = lambda d, s: d.select("id", F.lit(s).alias("status"))
    return tag(changes, "change").unionByName(tag(policy, "policy")).unionByName(tag(stale, "stale"))


@query("r8_apply_decisions", _S + """ SELECT id, CASE WHEN lang = 'en' THEN 'completed' WHEN lang = 'fr' THEN 'apply' ELSE 'stale' END AS status,
    n AS size FROM n WHERE lang <> 'es'""")
def r8(spark, sf):
    d = lists(spark, sf)
    fp = R.references_fingerprint
    items = d.select("id", "refs", fp("refs").alias("now_fingerprint"),
        F.when(F.col("lang") == "fr", fp("refs")).otherwise(F.lit("old")).alias("source_fingerprint"),
        F.when(F.col("lang") == "en", fp("refs")).otherwise(F.lit("new")).alias("resolved_fingerprint"),
        F.transform("prov", lambda r: F.struct(r["doi"].alias("doi"), r["citation"].alias("citation"))).alias("resolved"),
        F.when(F.col("lang") == "es", "deferred").otherwise("provider").alias("decision"))
    return R.apply_reference_decisions(items)[0].select("id", "status", F.size("refs").cast("long").alias("size"))


@query("r9_reconcile", _S + """ SELECT id, CASE WHEN lang = 'es' THEN 'missing' WHEN lang = 'de' THEN 'ledgered' WHEN lang = 'fr' THEN 'adopted' ELSE 'current' END AS action FROM n""")
def r9(spark, sf):
    d = lists(spark, sf).select("id", "lang", R.references_fingerprint("refs").alias("fingerprint"))
    items = d.select("id", F.when(F.col("lang") == "fr", "old").otherwise(F.col("fingerprint")).alias("current_fingerprint"))
    return R.reconcile(items, d.filter("lang <> 'es'"), d.filter("lang = 'de'")).select("id", "action")


@query("j11_inject_citations", _S + """, e AS (SELECT id, unnest(s) AS c, unnest(range(1, n + 1)) AS pos FROM n)
    SELECT id, pos, CASE WHEN length(c) > 60 THEN 'from table' ELSE md5(c) END AS citation FROM e""")
def j11(spark, sf):
    d = lists(spark, sf).select("id", "refs")
    blanked = d.withColumn("refs", F.transform("refs", lambda r: r.withField("citation", F.when(r["doi"].isNotNull(), "").otherwise(F.md5(r["citation"])))))
    cites = d.select(F.explode_outer("refs").alias("r")).filter("r.doi IS NOT NULL").select("r.doi", F.lit("from table").alias("citation")).distinct()
    out = R.inject_citations(blanked, cites)
    return out.select("id", F.posexplode_outer("refs").alias("p", "r")).filter("r IS NOT NULL").select("id", (F.col("p") + 1).alias("pos"), "r.citation")


@query("j12_canonical_fallback", _S + """, e AS (SELECT id, lang, unnest(s) AS c, unnest(range(1, n + 1)) AS pos FROM n)
    SELECT id, pos, CASE WHEN length(c) > 60 THEN md5(c) ELSE md5('') END AS h FROM e WHERE lang <> 'es' UNION ALL SELECT id, n + 1, md5('') FROM n WHERE lang = 'de'
    UNION ALL SELECT id, i, CASE WHEN length(s[i]) > 60 AND s[i] = s[i + 1] THEN md5(s[i]) ELSE md5('') END FROM (SELECT id, s, unnest(range(1, n)) AS i FROM n WHERE lang = 'es' AND n > 1)""")
def j12(spark, sf):
    d = lists(spark, sf)
    d = d.withColumn("prov", F.transform("prov", lambda r: r.withField("citation", F.lit(" "))))
    out = R.canonical_fallback(d).select("id", F.posexplode_outer("prov").alias("p", "r")).filter("r IS NOT NULL")
    return out.select("id", (F.col("p") + 1).alias("pos"), F.md5(F.btrim("r.citation")).alias("h"))


@query("j13_link_references", """SELECT l_orderkey, l_linenumber, l_partkey, '10.1/p' || l_partkey AS doi, CASE WHEN p_size > 25 THEN lower(replace(p_name, ' ', '-')) || '-' || p_partkey END AS target
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def j13(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.doi("10.1/p", "l_partkey").alias("doi"))
    pubs = V.table(spark, sf, "part").filter("p_size > 25").select(
        V.doi("10.1/p", "p_partkey").alias("doi"), F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), "p_partkey").alias("permalink"))
    return R.link_references(li, pubs)
