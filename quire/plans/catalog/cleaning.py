"""Queries of markup signals, lossless cleaning and hygiene jobs over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import markup as K, text as T
from quire.operators import hygiene as H, pagetext as P
from quire.plans import views as V
from quire.plans.catalog import query

_PIECES = r"(?s)<p>.*?</p>|<nav>.*?</nav>|<h1>.*?</h1>|<title>.*?</title>|<div.*?</div>|<!--.*?-->|<b>[^<]*"


def pieces(spark, sf) -> DataFrame:
    """Every page and every marked-up piece of it."""
    p = V.table(spark, sf, "pages")
    cut = F.regexp_extract_all("html", F.lit(_PIECES), F.lit(0))
    whole = F.concat(F.array("html"), cut, F.transform(cut, lambda x: F.regexp_replace(x, r"</?(?:title|h1)>", "")))
    return p.select("page_id", F.posexplode_outer(whole).alias("pos", "text"))


_TAG = r"<\s*/?\s*[A-Za-z][A-Za-z0-9_.:-]*\b[^<>]*?/?\s*>"
_TEX = r"\\\(|\\\[|(?:^|[^\\])\$(?:[^\s$\\]|[^\s$][^$\n]*[^\s$\\])\$|\\[A-Za-z]+(?:\s*\{[^{}]*\})?"
def _decoded(c: str) -> str:
    """Character references of the page table, the ampersand last so that one level is decoded."""
    for name, ch in (("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{ch}')"
    return c


_VIEW = rf"""WITH cut AS (SELECT page_id, html, regexp_extract_all(html, '{_PIECES}') AS c FROM pages),
  al AS (SELECT page_id, list_concat([html], c, list_transform(c, lambda x: regexp_replace(x, '</?(?:title|h1)>', '', 'g'))) AS l FROM cut),
  piece AS (SELECT page_id, unnest(l) AS text, unnest(range(0, len(l))) AS pos FROM al),
  marks AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '(?i){_TAG}'), lambda t:
      CASE WHEN regexp_matches(t, '/\s*>$') OR lower(regexp_extract(t, '<\s*/?\s*([A-Za-z][A-Za-z0-9_.:-]*)', 1)) IN
        ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr') THEN ''
      WHEN regexp_matches(t, '^<\s*/') THEN '-' || lower(regexp_extract(t, '<\s*/?\s*([A-Za-z][A-Za-z0-9_.:-]*)', 1))
      ELSE '+' || lower(regexp_extract(t, '<\s*/?\s*([A-Za-z][A-Za-z0-9_.:-]*)', 1)) END), lambda m: m <> '') AS ms,
      list_distinct(list_transform(regexp_extract_all(text, '(?i){_TAG}'), lambda t: lower(regexp_extract(t, '<\s*/?\s*([A-Za-z][A-Za-z0-9_.:-]*)', 1)))) AS names FROM piece),
  st AS (SELECT *, list_reduce(list_concat(['/'], ms), lambda acc, m: CASE WHEN acc = '!' THEN '!' WHEN m[1] = '+' THEN acc || m[2:] || '/'
      WHEN ends_with(acc, '/' || m[2:] || '/') THEN acc[1:len(acc) - len(m)] ELSE '!' END) <> '/' AS unb FROM marks),
  fam AS (SELECT *, list_filter([
      CASE WHEN contains(text, '[[:space:]]') THEN 'legacy-renderer-marker' END,
      CASE WHEN contains(text, '<!--') THEN 'xml-comment' END,
      CASE WHEN regexp_matches(text, '(?i)&lt;\s*/?\s*(?:p|div|span|inline-formula|math|mml:|jats:)') THEN 'escaped-markup' END,
      CASE WHEN regexp_matches(text, '(?i)<\s*/?\s*[A-Za-z][A-Za-z0-9_.:-]*(?:\s[^<>]*?)?/?>') THEN 'html-xml-markup' END,
      CASE WHEN unb THEN 'unbalanced-structured-tags' END], lambda x: x IS NOT NULL) AS f,
      list_filter([CASE WHEN regexp_matches(text, '&(?:[A-Za-z][A-Za-z0-9]+|#\d+|#x[0-9A-Fa-f]+);') THEN 'html-entity' END,
      CASE WHEN regexp_matches(text, '{_TEX}') THEN 'tex-fragment' END], lambda x: x IS NOT NULL) AS f2 FROM st),
  sig AS (SELECT *, list_concat(list_concat(list_filter(f, lambda x: x <> 'unbalanced-structured-tags'), f2),
      list_filter(f, lambda x: x = 'unbalanced-structured-tags')) AS s,
      CASE WHEN unb THEN 'review-required' WHEN list_contains(f, 'escaped-markup') THEN 'review-required'
        WHEN f = ['legacy-renderer-marker'] THEN 'legacy-marker-removal' ELSE 'structural-unwrapping' END AS hint FROM fam),
  abs AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)&lt;\s*/?\s*[A-Za-z][A-Za-z0-9_.:-]*\b') THEN 'escaped-markup' WHEN unb THEN 'unbalanced-markup'
      WHEN NOT list_contains(f, 'html-xml-markup') AND NOT contains(text, '<!--') THEN NULL WHEN contains(text, '<!--') THEN 'xml-comment-review'
      WHEN len(list_filter(names, lambda n: n NOT IN ('p', 'italic', 'bold', 'styled-content'))) > 0 THEN 'unsupported-markup' END AS refuse,
      CASE WHEN list_contains(f, 'html-xml-markup') THEN trim(regexp_replace({_decoded("regexp_replace(regexp_replace(text, '</?p>', ' ', 'g'), '</?(?:italic|bold|styled-content)>', '', 'g')")}, '\s+', ' ', 'g')) ELSE text END AS clean FROM sig),
  dec AS (SELECT *, {_decoded('text')} AS d FROM sig),
  ttl AS (SELECT *, CASE WHEN unb THEN 'unbalanced-markup' WHEN len(names) = 0 AND NOT contains(d, '<!--') THEN NULL
      WHEN regexp_matches(d, '(?i)[\p{{L}}\p{{N}}]<(?:b|bold|em|i|italic|strong|styled-content)(?:\s[^<>]*)?>(?:<[^<>]*>)*[\p{{L}}\p{{N}}]')
        OR regexp_matches(d, '(?i)[\p{{L}}\p{{N}}](?:<[^<>]*>)*</(?:b|bold|em|i|italic|strong|styled-content)>[\p{{L}}\p{{N}}]') THEN 'ambiguous-inline-boundary'
      WHEN contains(d, '<!--') THEN 'xml-comment-review'
      WHEN len(list_filter(names, lambda n: n NOT IN ('b','bold','em','i','italic','scp','small-caps','strong','styled-content'))) > 0 THEN 'unsupported-markup' END AS refuse,
      CASE WHEN len(names) = 0 THEN d ELSE trim(regexp_replace(regexp_replace(d, '</?(?:b|bold|em|i|italic|scp|small-caps|strong|styled-content)>', '', 'g'), '\s+', ' ', 'g')) END AS clean FROM dec)"""


@query("c7_markup_families", _VIEW + " SELECT page_id, pos, array_to_string(f, ',') AS families FROM fam")
def c7(spark, sf):
    return pieces(spark, sf).select("page_id", "pos", F.array_join(K.markup_families("text"), ",").alias("families"))


@query("c8_text_signals", _VIEW + " SELECT page_id, pos, array_to_string(s, ',') AS signals FROM sig")
def c8(spark, sf):
    return pieces(spark, sf).select("page_id", "pos", F.array_join(K.text_signals("text"), ",").alias("signals"))


@query("c9_tags_unbalanced", _VIEW + " SELECT page_id, pos, unb AS unbalanced FROM st")
def c9(spark, sf):
    return pieces(spark, sf).select("page_id", "pos", K.tags_unbalanced("text").alias("unbalanced"))


@query("c10_assess_markup", _VIEW + """ SELECT page_id, pos, hint <> 'review-required' AS deterministic, hint FROM sig WHERE len(f) > 0""")
def c10(spark, sf):
    p = pieces(spark, sf).withColumn("f", K.markup_families("text")).filter(F.size("f") > 0)
    return p.withColumn("a", K.assess_markup("f", "text")).select("page_id", "pos", "a.deterministic", "a.hint")


@query("c11_signal_context", _VIEW + r""", k AS (SELECT page_id, pos, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM sig WHERE len(f) > 0),
    a AS (SELECT *, greatest(coalesce(least(nullif(strpos(t, '<!--'), 0),
      nullif(strpos(t, nullif(regexp_extract(t, '(?i)<\s*/?\s*[A-Za-z][A-Za-z0-9_.:-]*(?:\s[^<>]*?)?/?>'), '')), 0)), 1), 1) AS p FROM k)
    SELECT page_id, pos, CASE WHEN p > 71 THEN '…' ELSE '' END || substr(t, greatest(p - 70, 1), least(p + 170, length(t) + 1) - greatest(p - 70, 1))
      || CASE WHEN p + 170 <= length(t) THEN '…' ELSE '' END AS context FROM a""")
def c11(spark, sf):
    return H.abstract_findings(pieces(spark, sf), "text").select("page_id", "pos", "context")


@query("c12_clean_abstracts", _VIEW + """ SELECT page_id, pos, md5(CASE WHEN refuse IS NULL THEN clean ELSE text END) AS h, refuse IS NULL AS deterministic,
    coalesce(refuse, CASE WHEN clean <> text THEN 'normalized' ELSE 'already-clean' END) AS reason FROM abs""")
def c12(spark, sf):
    return K.clean_structured_abstract(pieces(spark, sf), "text", "r").select(
        "page_id", "pos", F.md5("r.normalized").alias("h"), "r.deterministic", "r.reason")


@query("c13_clean_titles", _VIEW + """ SELECT page_id, pos, md5(CASE WHEN refuse IS NULL THEN clean ELSE text END) AS h, refuse IS NULL AS deterministic,
    coalesce(refuse, CASE WHEN clean = text THEN 'already-clean' WHEN d <> text AND len(names) > 0 THEN 'entity-decoding+structural-unwrapping'
      WHEN d <> text THEN 'entity-decoding' ELSE 'structural-unwrapping' END) AS reason FROM ttl""")
def c13(spark, sf):
    return K.clean_titles(pieces(spark, sf), "text", "r").select(
        "page_id", "pos", F.md5("r.normalized").alias("h"), "r.deterministic", "r.reason")


_CITES = _VIEW + r""", cit AS (SELECT *, CASE WHEN unb THEN 'unbalanced-markup' WHEN len(names) = 0 AND NOT contains(d, '<!--') THEN NULL
      WHEN regexp_matches(d, '(?i)[\p{L}\p{N}]<(?:b|bold|em|i|italic|strong|styled-content|suffix|title|tt)(?:\s[^<>]*)?>(?:<[^<>]*>)*[\p{L}\p{N}]')
        OR regexp_matches(d, '(?i)[\p{L}\p{N}](?:<[^<>]*>)*</(?:b|bold|em|i|italic|strong|styled-content|suffix|title|tt)>[\p{L}\p{N}]') THEN 'ambiguous-inline-boundary'
      WHEN contains(d, '<!--') THEN 'xml-comment-review'
      WHEN len(list_filter(names, lambda n: n NOT IN ('b','bold','em','i','italic','scp','small-caps','strong','styled-content','suffix','title','tt','p'))) > 0 THEN 'unsupported-markup' END AS crefuse,
      CASE WHEN len(names) = 0 THEN d ELSE trim(regexp_replace(regexp_replace(regexp_replace(d, '</?p>', ' ', 'g'), '</?(?:b|bold|em|i|italic|scp|small-caps|strong|styled-content|suffix|title|tt)>', '', 'g'), '\s+', ' ', 'g')) END AS cclean FROM ttl)"""


@query("c13_clean_citations", _CITES + " SELECT page_id, pos, md5(CASE WHEN crefuse IS NULL THEN cclean ELSE text END) AS h, crefuse IS NULL AS deterministic FROM cit")
def c13_citations(spark, sf):
    return K.clean_citations(pieces(spark, sf), "text", "r").select("page_id", "pos", F.md5("r.normalized").alias("h"), "r.deterministic")


def _piece_lists(spark, sf) -> DataFrame:
    """Pages with their pieces as one reference list each."""
    p = V.table(spark, sf, "pages")
    cut = F.regexp_extract_all("html", F.lit(_PIECES), F.lit(0))
    whole = F.concat(F.array("html"), cut, F.transform(cut, lambda x: F.regexp_replace(x, r"</?(?:title|h1)>", "")))
    return p.select(F.col("page_id").alias("id"), F.transform(whole, lambda c: F.struct(F.lit(None).cast("string").alias("doi"), c.alias("citation"))).alias("refs"))


def _piece_proposals(spark, sf) -> DataFrame:
    rows = H.migration_proposals(pieces(spark, sf), "text", "citation")
    return rows.select(F.col("page_id").alias("id"), "pos", F.col("text").alias("current_value"), "proposed_value", "review_required")


@query("h2_apply_deterministic", _CITES + """ SELECT page_id AS id, pos, md5(cclean) AS h FROM cit WHERE len(s) > 0 AND crefuse IS NULL AND cclean <> text""")
def h2(spark, sf):
    staged, changes, _ = H.apply_hygiene(_piece_lists(spark, sf), _piece_proposals(spark, sf))
    long = staged.select("id", F.posexplode("refs").alias("pos", "r")).select("id", "pos", F.md5("r.citation").alias("h"))
    return long.join(changes.select("id", "pos"), ["id", "pos"])


@query("h2_violations", _CITES + """ SELECT page_id AS id, pos, CASE WHEN crefuse IS NOT NULL THEN 'review required' ELSE 'no change' END AS problem FROM cit
    WHERE len(s) > 0 AND (crefuse IS NOT NULL OR (cclean <> text AND pos > 5))""")
def h2_bad(spark, sf):
    p = _piece_proposals(spark, sf)
    dec = p.select("id", "pos", F.when(F.col("review_required") | (F.col("pos") <= 5), "accepted").otherwise("custom").alias("decision"),
                   F.col("current_value").alias("resolved_value"))
    return H.apply_hygiene(_piece_lists(spark, sf), p, dec)[2]


@query("j10_apply_repairs", """SELECT '10.1/o' || o_orderkey AS doi, CASE WHEN o_orderstatus = 'F' THEN 'stale' ELSE 'ok' END AS status FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT '10.1/gone' || c_custkey, 'gone' FROM customer""")
def j10(spark, sf):
    o = V.table(spark, sf, "orders").select(V.doi("10.1/o", "o_orderkey").alias("doi"), F.to_json(F.struct("o_custkey", "o_orderpriority")).alias("payload"), "o_orderstatus", "o_orderpriority")
    fp = H.evidence_fingerprint(F.col("doi"), F.when(F.col("o_orderstatus") == "F", "{}").otherwise(F.col("payload")))
    none = F.array().cast("array<string>")
    rep = o.filter("o_orderpriority = '1-URGENT'").select("doi", fp.alias("fingerprint"), F.array(F.lit("A B")).alias("authors"), none.alias("editors"))
    gone = V.table(spark, sf, "customer").select(V.doi("10.1/gone", "c_custkey").alias("doi"), F.lit("x").alias("fingerprint"), none.alias("authors"), none.alias("editors"))
    ok, other = H.apply_repairs(o, rep.unionByName(gone))
    return ok.select("doi", F.lit("ok").alias("status")).unionByName(other)


@query("a12_hygiene_report", _VIEW + """ SELECT count(*) AS scanned, count(*) FILTER (trim(text) <> '') AS present, count(*) FILTER (len(f) > 0) AS suspicious,
    count(*) FILTER (len(f) > 0 AND hint <> 'review-required') AS deterministic, count(*) FILTER (len(f) > 0 AND hint = 'review-required') AS review_required FROM sig""")
def a12(spark, sf):
    p = pieces(spark, sf).withColumn("f", K.markup_families("text"))
    return H.hygiene_report(p, "text", F.col("f"), K.assess_markup("f", "text")["deterministic"])


@query("a12_family_counts", _VIEW + " SELECT family, count(*) AS n FROM (SELECT unnest(f) AS family FROM fam) GROUP BY family")
def a12_counts(spark, sf):
    return H.family_counts(pieces(spark, sf).withColumn("families", K.markup_families("text")))


@query("h1_migration_proposals", _VIEW + """ SELECT page_id, pos, refuse IS NOT NULL OR clean = text AS review_required,
    md5(CASE WHEN refuse IS NULL AND clean <> text THEN clean ELSE '' END) AS h,
    coalesce(refuse, CASE WHEN clean <> text THEN 'normalized' ELSE 'no-deterministic-change' END) AS reason FROM abs WHERE len(f) > 0""")
def h1(spark, sf):
    return H.migration_proposals(pieces(spark, sf), "text", "abstract").select(
        "page_id", "pos", "review_required", F.md5("proposed_value").alias("h"), "reason")


@query("f1_clean_metadata", r"""SELECT conv_id, turn, trim(regexp_replace(text, '[\t\n\r\f\v]+', ' ', 'g')) AS plain,
    trim(regexp_replace(trim(regexp_replace('Abstract: Summary - ' || text, '\s+', ' ', 'g')), '(?i)^(?:(?:abstract|summary)(?:\s*[:.\-–—]\s*|\s+|$))+', '')) AS abstract FROM conversations""")
def f1(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.clean_metadata("text").alias("plain"),
                    T.clean_metadata(F.concat(F.lit("Abstract: <jats:p>Summary - "), "text"), abstract=True).alias("abstract"))


@query("f2_is_missing", """SELECT p_partkey, contains(p_name, 'red') OR contains(p_name, 'blue') AS missing_abstract, contains(p_name, 'red') AS missing_title FROM part""")
def f2(spark, sf):
    p = V.table(spark, sf, "part")
    v = F.when(p.p_name.contains("red"), " \n").when(p.p_name.contains("blue"), " Not \t AVAILABLE").otherwise(p.p_name)
    return p.select("p_partkey", T.is_missing("abstract", v).alias("missing_abstract"), T.is_missing("title", v).alias("missing_title"))


@query("f3_norm_dash", r"SELECT doc_id, md5(regexp_replace(replace(text, ' ', '–'), '\p{Pd}', '-', 'g')) AS h FROM documents")
def f3(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(T.norm_dash(F.replace("text", F.lit(" "), F.lit("–")))).alias("h"))


@query("f13_plain_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")
def f13(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.md5(T.plain_text("html")).alias("h"))


@query("f13_norm_keywords", """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(lower(text), ' '), lambda x: trim(x)),
    lambda x: x <> ''))), '|') AS k FROM documents""")
def f13_keywords(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(T.norm_keywords(F.split("text", " ")), "|").alias("k"))


# -- contributors ----------------------------------------------------------------------

_TEAM = r"""team AS (SELECT o_orderkey AS id, list_filter([c_name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'University ' || c_mktsegment END,
    CASE WHEN o_orderstatus = 'P' THEN '12 ' || c_mktsegment END], lambda x: x IS NOT NULL) AS a FROM orders JOIN customer ON o_custkey = c_custkey)"""


def team(spark, sf) -> DataFrame:
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    names = F.array_compact(F.array(
        F.col("c_name"), F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("University "), "c_mktsegment")),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("12 "), "c_mktsegment"))))
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), names.alias("authors"), F.array("c_mktsegment").alias("editors"))


@query("c14_institution_like", f"WITH {_TEAM} SELECT id, array_to_string(list_transform(a, lambda n: CASE WHEN regexp_matches(n, '(?i)^\\s*\\d+\\s+|\\buniversity\\b') THEN '1' ELSE '0' END), '') AS flags FROM team")
def c14(spark, sf):
    return team(spark, sf).select("id", F.array_join(F.transform("authors", lambda n: F.when(K.is_institution_like(n), "1").otherwise("0")), "").alias("flags"))


@query("c15_mixed_contributors", f"WITH {_TEAM}, e AS (SELECT id, unnest(a) AS name, unnest(range(0, len(a)))::INT AS index FROM team) SELECT id, 'author' AS role, index, name FROM e WHERE index > 0")
def c15(spark, sf):
    return H.mixed_contributors(team(spark, sf))


@query("h3_contributor_removals", f"""WITH {_TEAM} SELECT id, array_to_string(list_filter(a, lambda x: x NOT LIKE 'University%'), ';') AS authors FROM team WHERE array_to_string(a, ';') LIKE '%University%'""")
def h3(spark, sf):
    t = team(spark, sf)
    dec = H.mixed_contributors(t).filter("name LIKE 'University%'").select("id", "index", F.lit("remove").alias("decision"))
    return H.apply_contributor_removals(t, dec)[0].select("id", F.array_join("authors", ";").alias("authors"))


@query("h5_rename_contributor", f"""WITH {_TEAM} SELECT t.id, array_to_string(list_transform(a, lambda x: CASE WHEN x LIKE '12 %' THEN 'Team ' || x ELSE x END), ';') AS authors
    FROM team t JOIN orders o ON o.o_orderkey = t.id WHERE o_orderstatus = 'P'""")
def h5(spark, sf):
    t = team(spark, sf)
    ch = t.select("id", F.element_at("authors", -1).alias("old_name")).filter("old_name LIKE '12 %'")
    return H.rename_contributor(t, ch.withColumn("new_name", F.concat(F.lit("Team "), "old_name")))[0].select(
        "id", F.array_join("authors", ";").alias("authors"))


@query("c20_page_abstract")
def c20(spark, sf):
    return P.extract_page_abstract(V.table(spark, sf, "pages"))
