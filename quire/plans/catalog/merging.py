"""Queries of identity, sets, merging, evidence and state transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quire.functions import identity as I, text as T
from quire.operators import aliases as AL, evidence as E, merge as MG, sets as O, state as ST
from quire.plans import views as V
from quire.plans.catalog import query
from quire.session import cut_lineage

_W = V.with_


# -- identity ------------------------------------------------------------------------

@query("i1_norm_doi", """SELECT p_partkey, lower(raw) AS doi FROM (SELECT p_partkey,
    CASE WHEN contains(p_name, 'red') THEN NULL WHEN contains(p_name, 'small') THEN NULL ELSE '10.7/' || p_brand || '.' || p_partkey END AS raw FROM part)""")
def i1(spark, sf):
    p = V.table(spark, sf, "part")
    key = F.concat(F.lit("10.7/"), "p_brand", F.lit("."), F.col("p_partkey").cast("string"))
    raw = (F.when(p.p_name.contains("red"), F.concat(F.lit("11.7/"), "p_brand"))
           .when(p.p_name.contains("small"), F.concat(key, F.lit(" x")))
           .when(p.p_name.contains("blue"), F.concat(F.lit(" DOI: "), key))
           .otherwise(F.concat(F.lit("HTTPS://dx.doi.org/"), key, F.lit("\t"))))
    return p.select("p_partkey", I.norm_doi(raw).alias("doi"))


@query("i2_norm_uuid", f"""SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN {V._UUID.format('c_custkey::VARCHAR')} END AS id FROM customer""")
def i2(spark, sf):
    c = V.table(spark, sf, "customer")
    u = V.uuid_of(F.col("c_custkey").cast("string"))
    return c.select("c_custkey", I.norm_uuid(F.when(c.c_nationkey < 12, F.upper(u)).otherwise(F.replace(u, F.lit("-"), F.lit("")))).alias("id"))


@query("i3_norm_identifiers", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
    ELSE 'doi=10.1/o' || o_orderkey || ';isbn=' || o_custkey END AS ids FROM orders""")
def i3(spark, sf):
    o = V.table(spark, sf, "orders")
    third = F.when(o.o_orderstatus == "P", "id").otherwise("doi")
    m = F.create_map(F.lit(" ISBN "), F.concat(F.lit(" "), F.col("o_custkey").cast("string")),
                     F.lit("Doi"), F.lit("10.1/old"), third, F.concat(F.lit("doi:10.1/O"), F.col("o_orderkey").cast("string")))
    ids = I.sorted_map(I.norm_identifiers(m))
    pairs = F.transform(F.map_entries(ids), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return o.select("o_orderkey", F.array_join(pairs, ";").alias("ids"))


@query("i4_shared_strong", _W("canonical", "incoming") + """ SELECT c.id AS left_id, i.id AS right_id, c.doi AS value
    FROM canonical c JOIN incoming i ON c.doi = i.doi""")
def i4(spark, sf):
    def strong(df, name):
        ids = F.map_filter(F.create_map(F.lit("doi"), "doi", F.lit("isbn"), "type"), lambda k, v: v.isNotNull())
        return df.select(F.col("id").alias(name), F.explode(I.strong_ids(ids)).alias("s")).select(name, "s.key", "s.value")
    return strong(V.canonical(spark, sf), "left_id").join(strong(V.incoming(spark, sf), "right_id"), ["key", "value"]).drop("key")


@query("i5_parse_token", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'doi' WHEN 'O' THEN 'doi' ELSE NULL END AS kind,
    CASE o_orderstatus WHEN 'P' THEN NULL ELSE '10.1/o' || o_orderkey END AS value FROM orders""")
def i5(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    raw = (F.when(o.o_orderstatus == "F", F.concat(F.lit("https://doi.org/10.1/O"), k))
           .when(o.o_orderstatus == "O", F.concat(F.lit(" DOI : 10.1/o"), k)).otherwise(F.concat(F.lit("pmid:"), k)))
    t = I.parse_token(raw, ["doi", "id"], legacy=True)
    return o.select("o_orderkey", t["kind"].alias("kind"), t["value"].alias("value"))


@query("i6_registry_token", _W("canonical") + """ SELECT id, coalesce('doi:' || doi, 'id:' || id) AS token,
    coalesce(doi, 'id:' || id) AS label FROM canonical""")
def i6(spark, sf):
    d, i = F.col("doi"), F.col("id")
    return V.canonical(spark, sf).select("id", I.registry_token(d, i).alias("token"), I.identity_label(d, i).alias("label"))


@query("i7_resolve_aliases", _W("edges", "chain", "resolved", recursive=True) + " SELECT src, terminal FROM resolved")
def i7(spark, sf):
    return AL.resolve_aliases(V.alias_edges(spark, sf))[0]


@query("i7_alias_cycles", "SELECT 'r' || n_nationkey AS src FROM nation")
def i7_cycles(spark, sf):
    # Nations form one ring ordered by key; every source lies on the cycle.
    n = V.table(spark, sf, "nation").select("n_nationkey")
    top = n.agg(F.max("n_nationkey")).scalar()
    key = lambda c: F.concat(F.lit("r"), c.cast("string"))
    edges = n.select(key(F.col("n_nationkey")).alias("src"), key(F.when(F.col("n_nationkey") == top, F.lit(0)).otherwise(
        F.col("n_nationkey") + 1)).alias("dst"), F.lit("superseded").alias("reason"))
    return AL.alias_cycles(edges)


_NEW_ALIASES = """new_edges AS (SELECT '10.1/p' || p_partkey AS src, '10.1/p' || (p_partkey + 1) AS dst FROM part WHERE p_brand = 'Brand#7'),
    wanted AS (SELECT n.src, coalesce(r.terminal, n.dst) AS dst, k.terminal AS known FROM new_edges n
      LEFT JOIN resolved r ON n.dst = r.src LEFT JOIN resolved k ON n.src = k.src)"""


@query("i8_add_aliases", _W("edges", "chain", "resolved", recursive=True) + ", " + _NEW_ALIASES + """
    SELECT src, dst FROM edges UNION SELECT src, dst FROM wanted WHERE known IS NULL""")
def i8(spark, sf):
    new = V.table(spark, sf, "part").filter("p_brand = 'Brand#7'").select(
        V.doi("10.1/p", "p_partkey").alias("src"), F.concat(F.lit("10.1/p"), (F.col("p_partkey") + 1).cast("string")).alias("dst"))
    return AL.add_aliases(V.alias_edges(spark, sf), new)[0].select("src", "dst")


@query("i9_slugify", r"""SELECT doc_id, trim(regexp_replace(replace(replace(lower(strip_accents(replace(replace(replace(replace(
    substr(text, 1, 240), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'Æ', 'AE'))), 'ø', 'o'), 'ł', 'l'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents""")
def i9(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.slugify("text").alias("slug"))


@query("i11_safe_component", r"""SELECT conv_id, turn, text <> '' AND text NOT IN ('.', '..', 'index') AND
    NOT regexp_matches(text, '[/\\\x00-\x1f<>:"|?*]') AS safe FROM conversations""")
def i11(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", T.is_safe_component("text").alias("safe"))


@query("i12_prepare_keys", """SELECT DISTINCT '10.1/u' || user_id AS doi FROM events
    WHERE '10.1/u' || user_id NOT IN (SELECT '10.1/u' || user_id FROM events WHERE value > 300)""")
def i12(spark, sf):
    e = V.table(spark, sf, "events")
    keys = e.select(F.concat(F.lit("doi:10.1/U"), F.col("user_id").cast("string")).alias("doi"), F.col("event_id").alias("ord"))
    known = e.filter("value > 300").select(V.doi("10.1/u", "user_id").alias("doi"))
    return O.prepare_keys(keys, known).select("doi")


@query("i13_exclude_substrings", """SELECT '10.1/o' || o_orderkey AS doi FROM orders
    WHERE NOT contains('10.1/o' || o_orderkey, 'o77') AND NOT contains('10.1/o' || o_orderkey, '00')""")
def i13(spark, sf):
    return O.exclude_substrings(V.table(spark, sf, "orders").select(V.doi("10.1/o", "o_orderkey").alias("doi")), [" O77", "00", " "])


@query("i14_fingerprint", _W("canonical") + """ SELECT id, sha256('{"doi":' || coalesce('"' || doi || '"', 'null') || ',"title":"' || title
    || '","type":"' || type || '"}') AS fp FROM canonical""")
def i14(spark, sf):
    return V.canonical(spark, sf).select("id", I.fingerprint(type="type", title="title", doi="doi").alias("fp"))


# -- sets ----------------------------------------------------------------------------

@query("o1_append_unique", """WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click')
    SELECT k AS user_id, 'a' AS side FROM a UNION ALL SELECT DISTINCT user_id, 'b' FROM events
    WHERE event_type = 'view' AND user_id NOT IN (SELECT k FROM a)""")
def o1(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.col("event_id").alias("ord"), "event_type")
    a = e.filter("event_type = 'click'").withColumn("side", F.lit("a"))
    b = e.filter("event_type = 'view'").withColumn("side", F.lit("b"))
    return O.append_unique(a, b, "user_id").select("user_id", "side")


@query("o2_dedupe_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY text")
def o2(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return O.dedupe_first(d, "h", order="doc_id")


@query("a4_duplicates", "SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def a4(spark, sf):
    return O.duplicates(V.table(spark, sf, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("o3_state_sets", _W("members") + """ SELECT count(*) FILTER (canonical AND NOT rejected) AS only_canonical,
    count(*) FILTER (queued AND staged) AS queued_and_staged, count(*) FILTER (canonical OR queued OR review OR rejected OR staged)
    AS any_state FROM members""")
def o3(spark, sf):
    s = {k: v.select("doi") for k, v in V.order_states(spark, sf).items()}
    rows = (s["canonical"].exceptAll(s["rejected"]).select(F.lit("c").alias("t"))
            .unionByName(s["queued"].intersect(s["staged"]).select(F.lit("q").alias("t")))
            .unionByName(O.state_membership(s).select(F.lit("a").alias("t"))))
    return rows.agg(F.count_if(F.col("t") == "c").alias("only_canonical"), F.count_if(F.col("t") == "q").alias("queued_and_staged"),
                    F.count_if(F.col("t") == "a").alias("any_state"))


def _members(spark, sf) -> DataFrame:
    return O.state_membership(V.order_states(spark, sf))


@query("j20_key_surfaces", _W("members", "present") + """ SELECT doi, canonical, queued, review, rejected, staged,
    CASE WHEN canonical AND NOT rejected THEN 'keep' WHEN rejected AND NOT canonical THEN 'reject' END AS current_decision FROM present""")
def j20(spark, sf):
    return ST.with_current_decision(_members(spark, sf))


@query("j21_state_overlaps", _W("members") + """ SELECT doi, 'queued' AS left_state, 'rejected' AS right_state FROM members WHERE queued AND rejected
    UNION ALL SELECT doi, 'review', 'rejected' FROM members WHERE review AND rejected
    UNION ALL SELECT doi, 'rejected', 'canonical' FROM members WHERE rejected AND canonical""")
def j21(spark, sf):
    return O.state_overlaps(_members(spark, sf))


# -- merge ---------------------------------------------------------------------------

_MERGED = _W("canonical", "incoming") + """,
    m AS (SELECT i.*, coalesce(a.id, b.id) AS target FROM incoming i LEFT JOIN canonical a ON a.id = i.id LEFT JOIN canonical b ON b.doi = i.doi
      WHERE a.id IS NULL OR b.id IS NULL OR a.id = b.id)"""


@query("j1_merge", _MERGED + """ SELECT c.id, coalesce(m.doi, c.doi) AS doi, coalesce(m.title, c.title) AS title, coalesce(m.type, c.type) AS type,
      coalesce(m.volume, c.volume) AS volume, c.ord, 0 AS side FROM canonical c LEFT JOIN m ON m.target = c.id
    UNION ALL SELECT id, doi, title, type, volume, ord, 1 FROM m WHERE target IS NULL""")
def j1(spark, sf):
    return MG.merge(V.canonical(spark, sf), V.incoming(spark, sf))[0]


@query("j1_merge_log", _MERGED + """ SELECT c.id, CASE WHEN c.title = m.title AND c.type = m.type AND c.volume = m.volume THEN 'unchanged'
      ELSE 'updated' END AS action FROM canonical c JOIN m ON m.target = c.id UNION ALL SELECT id, 'added' FROM m WHERE target IS NULL""")
def j1_log(spark, sf):
    return MG.merge(V.canonical(spark, sf), V.incoming(spark, sf))[1]


@query("j2_merge_conflicts", _W("canonical", "incoming") + """, bad AS (SELECT id, CASE WHEN doi IS NOT NULL AND type = 'FURNITURE' THEN
      '10.1/c' || (ord + 1) ELSE doi END AS doi, ord FROM incoming)
    SELECT i.id, i.doi, i.ord, a.id AS id_match, b.id AS doi_match FROM bad i JOIN canonical a ON a.id = i.id JOIN canonical b ON b.doi = i.doi
    WHERE a.id <> b.id""")
def j2(spark, sf):
    shifted = F.concat(F.lit("10.1/c"), (F.col("ord") + 1).cast("string"))
    inc = V.incoming(spark, sf).withColumn("doi", F.when(F.col("doi").isNotNull() & (F.col("type") == "FURNITURE"), shifted).otherwise(F.col("doi")))
    return MG.merge_conflicts(V.canonical(spark, sf), inc)


@query("j3_project_merge", _W("canonical", "incoming") + """, rej AS (SELECT '10.1/c' || c_custkey AS doi FROM customer WHERE c_acctbal > 9000),
    acc AS (SELECT * FROM incoming WHERE coalesce(doi NOT IN (SELECT doi FROM rej), true)),
    m AS (SELECT i.*, coalesce(a.id, b.id) AS target FROM acc i LEFT JOIN canonical a ON a.id = i.id LEFT JOIN canonical b ON b.doi = i.doi),
    final AS (SELECT id, doi FROM canonical UNION ALL SELECT id, doi FROM m WHERE target IS NULL)
    SELECT 'registry' AS state, coalesce('doi:' || doi, 'id:' || id) AS token FROM final
    UNION ALL SELECT 'pending', '10.1/c' || c_custkey FROM customer WHERE c_acctbal < 4000
      AND '10.1/c' || c_custkey NOT IN (SELECT doi FROM acc WHERE doi IS NOT NULL) AND '10.1/c' || c_custkey NOT IN (SELECT doi FROM rej)
    UNION ALL SELECT 'review', '10.1/c' || c_custkey FROM customer WHERE c_acctbal > 8500
      AND '10.1/c' || c_custkey NOT IN (SELECT doi FROM acc WHERE doi IS NOT NULL) AND '10.1/c' || c_custkey NOT IN (SELECT doi FROM rej)""")
def j3(spark, sf):
    c = V.table(spark, sf, "customer").select(V.doi("10.1/c", "c_custkey").alias("doi"), F.col("c_custkey").alias("ord"), "c_acctbal")
    out = MG.project_merge({
        "canonical": V.canonical(spark, sf), "staged": V.incoming(spark, sf), "rejected": c.filter("c_acctbal > 9000").drop("c_acctbal"),
        "pending": c.filter("c_acctbal < 4000"), "review": c.filter("c_acctbal > 8500")})
    return (out["registry"].select(F.lit("registry").alias("state"), "token")
            .unionByName(out["pending"].select(F.lit("pending").alias("state"), F.col("doi").alias("token")))
            .unionByName(out["review"].select(F.lit("review").alias("state"), F.col("doi").alias("token"))))


@query("j4_prune_variants", """WITH gone AS (SELECT DISTINCT p_name FROM part WHERE p_size > 45),
    active AS (SELECT p_name FROM part WHERE p_retailprice < 950)
    SELECT p_partkey, p_name AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM gone WHERE p_name NOT IN (SELECT p_name FROM active))""")
def j4(spark, sf):
    p = V.table(spark, sf, "part").withColumnRenamed("p_name", "name")
    return MG.prune_variants(p.select("p_partkey", "name"), p.filter("p_size > 45"), p.filter("p_retailprice < 950"))


@query("j22_possible_duplicates", """WITH n AS (SELECT * FROM part WHERE p_size > 40), c AS (SELECT * FROM part WHERE p_size <= 10)
    SELECT n.p_partkey AS new_id, min(c.p_partkey) AS canonical_id, 'title and year' AS reason, count(*) AS alike FROM n JOIN c
      ON lower(n.p_name || n.p_brand) = lower(c.p_name || c.p_brand) AND n.p_type = c.p_type GROUP BY n.p_partkey
    UNION ALL SELECT n.p_partkey, min(c.p_partkey), 'identifier:price:' || n.p_brand || n.p_type || n.p_name, count(*) FROM n JOIN c
      ON n.p_brand || n.p_type || n.p_name = c.p_brand || c.p_type || c.p_name GROUP BY n.p_partkey, n.p_brand, n.p_type, n.p_name""")
def j22(spark, sf):
    p = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" #"), "p_brand").alias("title"), F.col("p_type").alias("publication_year"),
        F.col("p_partkey").cast("string").alias("permalink"), "p_size",
        F.create_map(F.lit("price"), F.concat("p_brand", "p_type", "p_name")).alias("identifiers"))
    return MG.possible_duplicates(p.filter("p_size > 40"), p.filter("p_size <= 10"))[0]


# -- evidence ------------------------------------------------------------------------

@query("j5_merge_evidence", _W("decided") + """, o AS (SELECT * FROM decided WHERE work_type <> 'es'),
    n AS (SELECT doi, ord, 'v2 ' || abstract AS abstract, CASE WHEN work_type = 'de' THEN '' ELSE 'b2' END AS batch_id,
      CASE WHEN work_type = 'fr' THEN 'keep' ELSE '' END AS human_decision FROM decided WHERE length(abstract) > 2000)
    SELECT coalesce(o.doi, n.doi) AS doi, md5(coalesce(n.abstract, o.abstract)) AS h,
      CASE WHEN n.doi IS NULL THEN o.batch_id WHEN o.doi IS NOT NULL AND n.batch_id = '' THEN o.batch_id ELSE n.batch_id END AS batch_id,
      CASE WHEN n.doi IS NULL THEN o.human_decision WHEN o.doi IS NOT NULL AND n.human_decision = '' THEN o.human_decision ELSE n.human_decision END AS human_decision,
      CASE WHEN o.doi IS NULL THEN 1 ELSE 0 END AS side FROM o FULL JOIN n ON o.doi = n.doi""")
def j5(spark, sf):
    e = V.evidence_decided(spark, sf)
    new = e.filter("length(abstract) > 2000").withColumns({
        "abstract": F.concat(F.lit("v2 "), "abstract"), "batch_id": F.when(F.col("work_type") == "de", "").otherwise("b2"),
        "human_decision": F.when(F.col("work_type") == "fr", "keep").otherwise(""), "correction_decision": F.lit("")})
    return E.merge_evidence(e.filter("work_type <> 'es'"), new).select("doi", F.md5("abstract").alias("h"), "batch_id", "human_decision", "side")


@query("j6_record_decisions", _W("decided") + """ SELECT doi, CASE WHEN quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END
    ELSE human_decision END AS human_decision FROM decided""")
def j6(spark, sf):
    d = V.labels(spark, sf).select("doi", F.concat(F.lit(" "), F.upper("label")).alias("decision"))
    return E.record_decisions(V.evidence_decided(spark, sf), d).select("doi", "human_decision")


@query("j6_unknown_corrections", """SELECT '10.1/d' || doc_id AS doi FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def j6_unknown(spark, sf):
    ev = V.evidence_decided(spark, sf).filter("work_type <> 'en'")
    return E.record_corrections(ev, V.labels(spark, sf).withColumnRenamed("label", "decision"))[1].select("doi")


_LABELS = _W("decided", "copies") + """, canon AS (SELECT doi FROM decided WHERE quality = 1), gone AS (SELECT doi FROM decided WHERE quality = 0),
    j AS (SELECT d.doi, d.correction_decision AS c, d.human_decision AS h, a.terminal AS t, d.doi IN (SELECT doi FROM canon) AS ic,
      d.doi IN (SELECT doi FROM gone) AS ir, a.terminal IN (SELECT doi FROM canon) AS tc, a.terminal IN (SELECT doi FROM gone) AS tr
      FROM decided d LEFT JOIN copies a ON a.src = d.doi),
    v AS (SELECT doi, ic, ir, CASE WHEN c <> '' THEN c WHEN h <> '' THEN h WHEN t IS NOT NULL THEN CASE WHEN tc THEN 'keep' WHEN tr THEN 'reject' END
        WHEN ic THEN 'keep' WHEN ir THEN 'reject' END AS label,
      CASE WHEN c <> '' THEN 'correction' WHEN h <> '' THEN 'human' WHEN t IS NOT NULL THEN 'alias' WHEN ic THEN 'canonical' WHEN ir THEN 'terminal' END AS source FROM j)"""


def _labels(spark, sf):
    lab = V.labels(spark, sf)
    return E.labels(V.evidence_decided(spark, sf), lab.filter("label = 'keep'"), lab.filter("label = 'reject'"), V.copies(spark, sf))


@query("j7_labels", _LABELS + """ SELECT doi, label, source FROM v WHERE label IS NOT NULL
    AND NOT (source IN ('correction', 'human') AND ((label = 'keep' AND ir) OR (label = 'reject' AND ic)))""")
def j7(spark, sf):
    return _labels(spark, sf)[0]


@query("j7_label_conflicts", _LABELS + """ SELECT doi, label, source FROM v WHERE source IN ('correction', 'human')
    AND ((label = 'keep' AND ir) OR (label = 'reject' AND ic))""")
def j7_conflicts(spark, sf):
    return _labels(spark, sf)[1]


@query("j8_backfill_evidence", _W("decided") + """, known AS (SELECT doi FROM decided WHERE work_type = 'en'),
    canon AS (SELECT * FROM decided WHERE quality = 1), gone AS (SELECT * FROM decided WHERE quality = 0)
    SELECT doi, 'canonical-backfill' AS source, CASE WHEN work_type = 'fr' THEN batch_id ELSE '' END AS batch_id, md5(abstract) AS h FROM canon WHERE work_type <> 'en'
    UNION ALL SELECT doi, 'backfill', CASE WHEN work_type = 'fr' THEN batch_id ELSE '' END, md5(abstract) FROM gone WHERE work_type <> 'en' AND length(abstract) > 500""")
def j8(spark, sf):
    e, lab = V.evidence_decided(spark, sf), V.labels(spark, sf)
    pubs = e.join(lab.filter("label = 'keep'").select("doi"), "doi", "left_semi")
    ctx = e.filter("work_type = 'fr'").select("doi", "batch_id", "attempt")
    works = e.filter("length(abstract) > 500")
    out = E.backfill_evidence(e.filter("work_type = 'en'"), pubs, lab.filter("label = 'reject'"), works, ctx)[0]
    return out.select("doi", "source", "batch_id", F.md5("abstract").alias("h"))


# -- state transitions ---------------------------------------------------------------

@query("j23_review_cases", _W("evidence", "labels_view", "matched") + """ SELECT doi, array_to_string(am, ' & ') AS accept_matches,
    array_to_string(rm, ' & ') AS reject_matches, true AS metadata_available, CASE WHEN work_type = 'fr' THEN batch_id END AS batch_id FROM matched WHERE work_type <> 'es'
    UNION ALL SELECT '10.1/c' || c_custkey, '', '', false, NULL FROM customer""")
def j23(spark, sf):
    e = V.evidence(spark, sf)
    review = e.filter("work_type <> 'es'").select("doi", "ord").unionByName(
        V.table(spark, sf, "customer").select(V.doi("10.1/c", "c_custkey").alias("doi"), F.col("c_custkey").alias("ord")))
    ctx = e.filter("work_type = 'fr'").select("doi", "batch_id", F.lit(1).alias("attempt"))
    out = ST.review_cases(review, V.works(spark, sf), ctx, V.ACCEPT_RULES, V.REJECT_RULES)
    return out.select("doi", F.array_join("accept_matches", " & ").alias("accept_matches"),
                      F.array_join("reject_matches", " & ").alias("reject_matches"), "metadata_available", "batch_id")


_REVIEWED = _W("members", "present", "odec") + """, r AS (SELECT o.doi, o.decision, p.* EXCLUDE (doi), CASE WHEN NOT coalesce(p.review, false) THEN 'not in review'
    WHEN p.queued OR p.rejected THEN 'incompatible state' END AS problem FROM odec o LEFT JOIN present p ON o.doi = p.doi)"""


@query("j24_apply_review", _REVIEWED + """ SELECT doi, decision, CASE WHEN decision = 'keep' THEN 'queued' ELSE 'rejected' END AS add_to, NULL::VARCHAR AS problem
    FROM r WHERE problem IS NULL UNION ALL SELECT doi, decision, NULL, problem FROM r WHERE problem IS NOT NULL""")
def j24(spark, sf):
    ok, bad = ST.apply_review(_members(spark, sf), V.order_decisions(spark, sf))
    return ok.select("doi", "decision", "add_to").unionByName(bad, allowMissingColumns=True)


@query("j24_state_after_review", _REVIEWED + """ SELECT p.doi, p.review AND r.doi IS NULL AS review,
    p.queued OR coalesce(r.decision = 'keep', false) AS queued, p.rejected OR coalesce(r.decision = 'reject', false) AS rejected
    FROM present p LEFT JOIN (SELECT * FROM r WHERE problem IS NULL) r ON p.doi = r.doi""")
def j24_after(spark, sf):
    m = _members(spark, sf)
    return ST.apply_moves(m, ST.apply_review(m, V.order_decisions(spark, sf))[0]).select("doi", "review", "queued", "rejected")


@query("h6_replace_keys", _W("members", "present") + """, ch AS (SELECT '10.1/o' || o_orderkey AS src, '10.1/o' || (o_orderkey + 1) AS dst FROM orders),
    r AS (SELECT c.src, c.dst, CASE WHEN s.canonical THEN 'source canonical' WHEN s.rejected THEN 'source rejected' WHEN s.doi IS NULL THEN 'unknown source'
      WHEN d.rejected THEN 'replacement rejected' WHEN d.review THEN 'replacement in review' END AS problem,
      coalesce(d.canonical OR d.queued OR d.staged, false) AS placed, s.* EXCLUDE (doi) FROM ch c LEFT JOIN present s ON s.doi = c.src LEFT JOIN present d ON d.doi = c.dst)
    SELECT src AS doi, concat_ws(',', CASE WHEN queued THEN 'queued' END, CASE WHEN review THEN 'review' END, CASE WHEN staged THEN 'staged' END) AS leaves,
      NULL::VARCHAR AS add_to FROM r WHERE problem IS NULL UNION ALL SELECT dst, '', 'queued' FROM r WHERE problem IS NULL AND NOT placed""")
def h6(spark, sf):
    o = V.table(spark, sf, "orders")
    ch = o.select(V.doi("10.1/o", "o_orderkey").alias("src"), F.concat(F.lit("10.1/o"), (F.col("o_orderkey") + 1).cast("string")).alias("dst"))
    moves, _ = ST.replace_keys(_members(spark, sf), spark.createDataFrame([], "src string, terminal string"), ch)
    return moves.select("doi", F.array_join("remove_from", ",").alias("leaves"), "add_to")


@query("h7_correct_relevance", _W("members", "present", "odec") + """,
    r AS (SELECT o.doi, o.decision, p.* EXCLUDE (doi), p.doi IS NOT NULL AS known, coalesce(p.status = 'F' OR p.price > 100000, false) AS ev FROM odec o LEFT JOIN
      (SELECT doi, canonical, queued, review, rejected, staged, price, status FROM present) p ON o.doi = p.doi),
    s AS (SELECT *, CASE WHEN NOT known THEN 'unknown key' WHEN canonical AND rejected THEN 'canonical and rejected'
      WHEN review AND (canonical OR queued OR rejected OR staged) THEN 'incompatible state' WHEN review THEN 'first decision'
      WHEN (decision = 'keep' AND ((canonical AND NOT rejected) OR queued OR staged)) OR (decision = 'reject' AND rejected AND NOT canonical AND NOT staged) THEN 'no-op'
      WHEN NOT ev THEN 'evidence required' ELSE 'correct' END AS step FROM r)
    SELECT doi, decision, CASE WHEN step IN ('first decision', 'correct') THEN CASE WHEN decision = 'keep' THEN 'queued' ELSE 'rejected' END END AS add_to,
      CASE WHEN step IN ('first decision', 'correct') THEN CASE WHEN review THEN 'review' WHEN decision = 'keep' THEN 'rejected' ELSE
        concat_ws(',', CASE WHEN canonical THEN 'canonical' END, CASE WHEN queued THEN 'queued' END, CASE WHEN staged THEN 'staged' END) END END AS leaves,
      CASE WHEN step NOT IN ('first decision', 'correct') THEN step END AS problem FROM s""")
def h7(spark, sf):
    o = V.table(spark, sf, "orders")
    ev = o.filter("o_orderstatus = 'F' OR o_totalprice > 100000").select(V.doi("10.1/o", "o_orderkey").alias("doi"), F.lit(True).alias("evidence"))
    m = _members(spark, sf).join(ev, "doi", "left").withColumn("evidence", F.coalesce("evidence", F.lit(False))).withColumn("alias", F.lit(False))
    moves, noops, bad = ST.correct_relevance(m, V.order_decisions(spark, sf))
    return (moves.select("doi", "decision", "add_to", F.array_join("remove_from", ",").alias("leaves"))
            .unionByName(noops.withColumn("problem", F.lit("no-op")), allowMissingColumns=True)
            .unionByName(bad, allowMissingColumns=True))


# One change of the ordered log in SQL: the step by the state before, and the state after it.
_REVIEW_STEP = "CASE WHEN NOT review THEN 'not in review' WHEN queued OR rejected THEN 'incompatible state' ELSE 'first decision' END"
_CORRECTION_STEP = """CASE WHEN sup IS NOT NULL THEN 'superseded' WHEN NOT (ev OR outcome IS NOT NULL OR canonical OR queued OR review OR rejected OR staged) THEN 'unknown key'
      WHEN canonical AND rejected THEN 'canonical and rejected'
      WHEN review THEN CASE WHEN canonical OR queued OR staged OR rejected THEN 'incompatible state' ELSE 'first decision' END
      WHEN (d = 'keep' AND ((canonical AND NOT rejected) OR queued OR staged)) OR (d = 'reject' AND rejected AND NOT canonical AND NOT staged) THEN 'no-op'
      WHEN NOT ev THEN 'evidence required' ELSE 'correct' END"""


def _fold_step(before: str, after: str, decision: str, step: str) -> str:
    return f"""{after}d AS (SELECT *, {decision} AS d FROM {before}),
    {after}s AS (SELECT *, CASE WHEN d IS NOT NULL THEN CASE WHEN d NOT IN ('keep', 'reject') THEN 'unknown decision' ELSE {step} END END AS step FROM {after}d),
    {after}t AS (SELECT *, coalesce(step IN ('first decision', 'correct'), false) AS done FROM {after}s),
    {after} AS (SELECT doi, canonical AND NOT (done AND d = 'reject') AS canonical, CASE WHEN done THEN d = 'keep' ELSE queued END AS queued, review AND NOT done AS review,
      CASE WHEN done THEN d = 'reject' ELSE rejected END AS rejected, staged AND NOT (done AND d = 'reject') AS staged, ev, sup,
      CASE WHEN step = 'first decision' AND ev THEN d ELSE human END AS human, CASE WHEN step = 'correct' THEN d ELSE corr END AS corr,
      CASE WHEN done AND outcome IS NOT NULL THEN CASE d WHEN 'keep' THEN 'queued' ELSE 'rejected' END ELSE outcome END AS outcome,
      CASE WHEN done AND d = 'reject' AND outcome IS NOT NULL AND item_state = 'active' THEN 'completed' ELSE item_state END AS item_state,
      price, k, batch_no, concat_ws(' > ', nullif(steps, ''), step) AS steps FROM {after}t)"""


_CHANGED = _W("members") + """, c0 AS (SELECT m.doi, m.canonical, m.queued, m.review, m.rejected, m.staged, m.price, m.ord AS k, o.o_custkey % 40 AS batch_no,
      m.price > 60000 AS ev, CASE WHEN m.ord % 50 = 0 THEN 'x' END AS sup, NULL::VARCHAR AS human, NULL::VARCHAR AS corr,
      CASE WHEN m.status <> 'F' THEN 'review' END AS outcome, CASE WHEN m.status = 'O' THEN 'active' WHEN m.status = 'P' THEN 'completed' END AS item_state, NULL::VARCHAR AS steps
      FROM members m JOIN orders o ON o.o_orderkey = m.ord),
    """ + ",\n    ".join([
    _fold_step("c0", "c1", "CASE WHEN price > 30000 THEN CASE WHEN k % 97 = 0 THEN 'maybe' WHEN price > 150000 THEN 'keep' ELSE 'reject' END END", _REVIEW_STEP),
    _fold_step("c1", "c2", "CASE WHEN k % 3 = 0 THEN CASE WHEN price > 150000 THEN 'reject' ELSE 'keep' END END", _CORRECTION_STEP),
    _fold_step("c2", "c3", "CASE WHEN k % 6 = 0 THEN 'keep' END", _CORRECTION_STEP)])


def _changed(spark, sf):
    """State of the orders before and after three ordered changes, and what each change did."""
    o = V.table(spark, sf, "orders")
    key, price, k = V.doi("10.1/o", "o_orderkey").alias("doi"), F.col("o_totalprice"), F.col("o_orderkey")
    evidence = o.filter("o_totalprice > 60000").select(key, F.lit(None).cast("string").alias("human_decision"), F.lit(None).cast("string").alias("correction_decision"))
    report = o.filter("o_orderstatus <> 'F'").select(key, F.lit("review").alias("outcome"))
    items = o.filter("o_orderstatus <> 'F'").select(V.doi("10.1/o", "o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("completed").alias("state"),
                                                    F.lit("").alias("detail"))
    aliases = o.filter("o_orderkey % 50 = 0").select(V.doi("10.1/o", "o_orderkey").alias("src"), F.lit("x").alias("terminal"))
    before = cut_lineage(ST.change_state(_members(spark, sf), evidence, report, items, aliases))
    opinion = F.when(price > 150000, " Keep").otherwise("reject")
    log = [
        o.filter(price > 30000).select(key, F.lit(1).alias("seq"), F.lit("review").alias("kind"), F.when(k % 97 == 0, "maybe").otherwise(opinion).alias("decision")),
        o.filter(k % 3 == 0).select(key, F.lit(2).alias("seq"), F.lit("correction").alias("kind"), F.when(price > 150000, "reject").otherwise("keep").alias("decision")),
        o.filter(k % 6 == 0).select(key, F.lit(3).alias("seq"), F.lit("correction").alias("kind"), F.lit("keep").alias("decision"))]
    return before, *ST.fold_changes(before, log[2].unionByName(log[0]).unionByName(log[1]))


@query("j24_change_log", _CHANGED + """ SELECT doi, canonical, queued, review, rejected, staged, human AS human_decision, corr AS correction_decision, outcome, item_state, steps
    FROM c3 WHERE canonical OR queued OR review OR rejected OR staged OR ev OR outcome IS NOT NULL OR steps <> ''""")
def j24_log(spark, sf):
    _, after, results = _changed(spark, sf)
    steps = results.groupBy("doi").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "step"))), lambda r: r["step"]), " > ").alias("steps"))
    out = after.join(steps, "doi", "full").withColumn("steps", F.coalesce("steps", F.lit("")))
    flags = ("canonical", "queued", "review", "rejected", "staged")
    return out.select("doi", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags], "human_decision", "correction_decision", "outcome", "item_state", "steps")


@query("h7_after_effects", _CHANGED + """, p AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN '10.1/o' || o_orderkey END AS doi, """ + V._UUID.format("o_orderkey::VARCHAR") + """ AS id FROM orders WHERE o_orderstatus = 'F'),
    gone AS (SELECT a.doi FROM c0 a JOIN c3 b ON a.doi = b.doi WHERE a.canonical AND NOT b.canonical),
    ch AS (SELECT b.*, a.outcome AS old_outcome, a.item_state AS old_state FROM c0 a JOIN c3 b ON a.doi = b.doi)
    SELECT 'registry' AS what, coalesce('doi:' || doi, 'id:' || id) AS key, '' AS value FROM p WHERE coalesce(doi NOT IN (SELECT doi FROM gone), true)
    UNION ALL SELECT 'report', doi, outcome FROM ch WHERE outcome IS DISTINCT FROM old_outcome
    UNION ALL SELECT 'item', doi, item_state FROM ch WHERE item_state IS DISTINCT FROM old_state
    UNION ALL SELECT 'batch', batch_no::VARCHAR, 'closed' FROM ch WHERE item_state IS NOT NULL GROUP BY batch_no
      HAVING count(*) FILTER (item_state = 'active') = 0 AND bool_or(item_state IS DISTINCT FROM old_state)""")
def h7_after(spark, sf):
    before, after, _ = _changed(spark, sf)
    o, key = V.table(spark, sf, "orders"), V.doi("10.1/o", "o_orderkey")
    pubs = o.filter("o_orderstatus = 'F'").select(F.when(F.col("o_orderkey") % 10 != 0, key).alias("doi"), V.uuid_of(F.col("o_orderkey").cast("string")).alias("id"), F.lit(0).alias("side"), F.col("o_orderkey").alias("ord"))
    batches = o.filter("o_orderstatus <> 'F'").select((F.col("o_custkey") % 40).alias("batch_no"), key.alias("key"), F.lit(False).alias("closed"))
    out = ST.follow_up(before, after, pubs, batches)
    row = lambda df, what, k, v: df.select(F.lit(what).alias("what"), F.col(k).cast("string").alias("key"), v.alias("value"))
    return reduce(DataFrame.unionByName, [
        row(out["registry"], "registry", "token", F.lit("")), row(out["report"], "report", "doi", F.col("outcome")),
        row(out["items"], "item", "key", F.col("state")), row(out["closed_batches"], "batch", "batch_no", F.lit("closed"))])


@query("h6_after_effects", _W("members", "present") + """, ch AS (SELECT '10.1/o' || o_orderkey AS src, '10.1/o' || (o_orderkey + 1) AS dst FROM orders),
    r AS (SELECT c.src, c.dst, coalesce(d.canonical OR d.queued OR d.staged, false) AS placed FROM ch c JOIN present s ON s.doi = c.src LEFT JOIN present d ON d.doi = c.dst
      WHERE NOT s.canonical AND NOT s.rejected AND NOT coalesce(d.rejected OR d.review, false)),
    st AS (SELECT m.doi, m.queued, m.review, m.staged, CASE WHEN m.status <> 'F' THEN 'review' END AS outcome,
      CASE WHEN m.status = 'O' THEN 'active' WHEN m.status = 'P' THEN 'completed' END AS item_state FROM members m),
    a AS (SELECT st.doi, r.dst AS superseded_by, (queued AND r.dst IS NULL) OR st.doi IN (SELECT dst FROM r WHERE NOT placed) AS queued, review AND r.dst IS NULL AS review, staged AND r.dst IS NULL AS staged,
      CASE WHEN r.dst IS NOT NULL AND outcome IS NOT NULL THEN 'skipped' ELSE outcome END AS outcome,
      CASE WHEN r.dst IS NOT NULL AND item_state = 'active' THEN 'completed' ELSE item_state END AS item_state,
      CASE WHEN r.dst IS NOT NULL AND item_state = 'active' THEN 'superseded by ' || r.dst ELSE CASE WHEN item_state IS NOT NULL THEN '' END END AS detail
      FROM st LEFT JOIN r ON r.src = st.doi)
    SELECT * FROM a WHERE doi IN (SELECT doi FROM present) OR outcome IS NOT NULL OR doi IN (SELECT dst FROM r WHERE NOT placed)
    UNION ALL SELECT DISTINCT dst, NULL, true, false, false, NULL, NULL, NULL FROM r WHERE NOT placed AND dst NOT IN (SELECT doi FROM st)""")
def h6_after(spark, sf):
    o = V.table(spark, sf, "orders")
    key = V.doi("10.1/o", "o_orderkey").alias("doi")
    open_ = o.filter("o_orderstatus <> 'F'")
    none = spark.createDataFrame([], "doi string, human_decision string, correction_decision string")
    items = open_.select(key.alias("key"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("completed").alias("state"), F.lit("").alias("detail"))
    state = ST.change_state(_members(spark, sf), none, open_.select(key, F.lit("review").alias("outcome")), items, spark.createDataFrame([], "src string, terminal string"))
    ch = o.select(V.doi("10.1/o", "o_orderkey").alias("src"), F.concat(F.lit("10.1/o"), (F.col("o_orderkey") + 1).cast("string")).alias("dst"))
    moves, _ = ST.replace_keys(_members(spark, sf), spark.createDataFrame([], "src string, terminal string"), ch)
    return ST.supersede(state, moves).select("doi", "superseded_by", "queued", "review", "staged", "outcome", "item_state", "detail")


@query("a17_init_status", _W("members") + """ SELECT count(*) AS total, count(*) FILTER (status = 'P') AS unscreened,
    count(*) FILTER (queued AND NOT staged AND NOT canonical) AS queued, count(*) FILTER (review) AS review,
    count(*) FILTER (staged AND NOT canonical) AS staged, count(*) FILTER (canonical) AS merged, count(*) FILTER (rejected) AS rejected,
    count(*) FILTER (price > 450000) AS skipped FROM members""")
def a17(spark, sf):
    o = V.table(spark, sf, "orders")
    items = o.select(V.doi("10.1/o", "o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("active").alias("state"))
    report = o.select(V.doi("10.1/o", "o_orderkey").alias("doi"), F.when(F.col("o_totalprice") > 450000, "skipped").otherwise("queued").alias("outcome"))
    return ST.init_status(items, _members(spark, sf), report)
