"""Queries of provider dumps, enrichment and publication building over orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.text import display_name
from quire.operators import enrichment as E
from quire.plans import views as V
from quire.plans.catalog import query
from quire.sources import works as W


def crossref_dump(spark, sf) -> DataFrame:
    """Orders with their customer as one JSON work record each."""
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    d = F.to_date("o_orderdate")
    parts = lambda x: F.struct(F.array(F.array(F.year(x), F.month(x), F.day(x))).alias("date-parts"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rec = F.struct(
        F.concat(F.lit("https://doi.org/10.1/O"), "o_orderkey").alias("DOI"),
        F.when(F.col("o_orderstatus") == "F", "journal-article").when(F.col("o_orderstatus") == "O", "book-chapter").otherwise("dataset").alias("type"),
        F.when(urgent, F.array(F.concat(F.lit("Order <i>"), F.col("o_orderkey").cast("string"), F.lit("</i> of x<sub>1</sub>")))).otherwise(
            F.array(F.concat(F.lit("Order <i>"), F.col("o_orderkey").cast("string"), F.lit("</i> &amp; more")))).alias("title"),
        F.array(F.concat(F.lit("Journal "), "c_mktsegment")).alias("container-title"),
        F.array(F.create_map(F.lit("given"), F.lit(" Ann "), F.lit("family"), F.col("c_name"), F.lit("ORCID"), F.col("c_custkey").cast("string")),
                F.create_map(F.lit("name"), F.when(F.col("o_orderstatus") == "P", "Trade Institute").otherwise("Bo Li"))).alias("author"),
        F.concat(F.lit("<jats:p>Abstract: order "), F.col("o_orderkey").cast("string"), F.lit(" was placed</jats:p>")).alias("abstract"),
        F.array(F.lit(" Trade "), F.lit(""), F.col("o_orderpriority")).alias("subject"),
        parts(d).alias("created"), F.when(F.col("o_totalprice") > 200000, parts(F.add_months(d, 12))).alias("published-print"),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("1-"), F.col("c_nationkey").cast("string"))).alias("page"),
        F.concat(F.lit("e"), F.col("c_nationkey").cast("string")).alias("article-number"), F.col("c_nationkey").cast("string").alias("volume"),
        F.col("c_mktsegment").alias("publisher"), F.struct(F.lit(" Fair ").alias("name")).alias("event"),
        F.array(F.struct(F.lit("print").alias("type"), F.lit(" ").alias("value")), F.struct(F.lit("print").alias("type"), F.col("o_custkey").cast("string").alias("value"))).alias("isbn-type"),
        F.array(F.struct(F.concat(F.lit("10.1/P"), F.col("o_custkey").cast("string")).alias("DOI"), F.lit("See <b>that</b>").alias("unstructured"), F.lit("").alias("author"), F.lit(None).cast("string").alias("year")),
                F.struct(F.lit("bad").alias("DOI"), F.lit("").alias("unstructured"), F.col("c_name").alias("author"), F.lit("1999").alias("year")),
                F.struct(F.lit("bad").alias("DOI"), F.lit("x<sub>2</sub>").alias("unstructured"), F.lit("").alias("author"), F.lit(None).cast("string").alias("year"))).alias("reference"))
    return o.join(c, o.o_custkey == c.c_custkey).select(F.to_json(rec).alias("json"))


def crossref(spark, sf) -> DataFrame:
    return W.parse(crossref_dump(spark, sf), "json", W.CROSSREF_SCHEMA)


_O = """WITH o AS (SELECT *, '10.1/o' || o_orderkey AS doi, o_orderdate::DATE AS d, CASE WHEN o_totalprice > 200000 THEN (year(o_orderdate) + 1)::VARCHAR END AS print_year,
    CASE WHEN o_totalprice > 100000 THEN '1-' || c_nationkey ELSE 'e' || c_nationkey END AS page FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("s8_crossref_evidence", _O + """ SELECT doi, f.field, CASE f.field WHEN 'identifiers.doi' THEN doi WHEN 'identifiers.isbn' THEN o_custkey::VARCHAR
    WHEN 'type' THEN CASE o_orderstatus WHEN 'F' THEN 'journal-article' WHEN 'O' THEN 'book-chapter' ELSE 'dataset' END
    WHEN 'title' THEN 'Order <i>' || o_orderkey || CASE WHEN o_orderpriority = '1-URGENT' THEN '</i> of x<sub>1</sub>' ELSE '</i> &amp; more' END
    WHEN 'abstract' THEN '<jats:p>Abstract: order ' || o_orderkey || ' was placed</jats:p>' WHEN 'container_title' THEN 'Journal ' || c_mktsegment
    WHEN 'publication_year' THEN coalesce(print_year, '') WHEN 'volume' THEN c_nationkey::VARCHAR WHEN 'issue' THEN '' WHEN 'pages' THEN page
    WHEN 'publisher' THEN c_mktsegment WHEN 'event' THEN 'Fair' WHEN 'created_date' THEN d::VARCHAR
    WHEN 'authors' THEN 'Ann ' || c_name || '|' || CASE WHEN o_orderstatus = 'P' THEN 'Trade Institute' ELSE 'Bo Li' END WHEN 'editors' THEN '' WHEN 'keywords' THEN 'Trade|' || o_orderpriority END AS value
    FROM o, (SELECT unnest(['identifiers.doi','identifiers.isbn','type','title','abstract','container_title','publication_year','volume','issue','pages','publisher','event','created_date','authors','editors','keywords']) AS field) f""")
def s8(spark, sf):
    return W.crossref_evidence(crossref(spark, sf)).select("doi", "field", F.array_join("value", "|").alias("value"))


def inverted(spark, sf) -> DataFrame:
    """Documents as word to positions maps of their whole text, in JSON."""
    d = V.table(spark, sf, "documents").select("doc_id", "lang", "source", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    pairs = d.select("doc_id", F.posexplode("w").alias("p", "word")).groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    maps = pairs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "ps"))).alias("m"))
    rec = F.struct(F.concat(F.lit("10.1/D"), F.col("doc_id").cast("string")).alias("doi"), F.concat(F.lit(" "), "source").alias("title"), F.lit(2020).alias("publication_year"),
                   F.array(F.struct(F.lit(None).cast("string").alias("raw_author_name"), F.struct(F.col("source").alias("display_name")).alias("author"))).alias("authorships"),
                   F.struct(F.lit("3").alias("volume"), F.lit("7").alias("first_page"), F.col("lang").alias("last_page")).alias("biblio"), F.col("m").alias("abstract_inverted_index"))
    return d.select("doc_id", "lang", "source").join(maps, "doc_id", "left").select("doc_id", F.to_json(rec).alias("json"))


@query("e4_text_from_index", r"""SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS h FROM documents""")
def e4(spark, sf):
    return W.parse(inverted(spark, sf), "json", W.OPENALEX_SCHEMA).select("doc_id", F.md5(W.inverted_text("abstract_inverted_index")).alias("h"))


@query("s9_openalex_evidence", r"""SELECT '10.1/d' || doc_id AS doi, f.field, CASE f.field WHEN 'identifiers.doi' THEN '10.1/d' || doc_id WHEN 'title' THEN source
    WHEN 'abstract' THEN md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) WHEN 'publication_year' THEN '2020' WHEN 'volume' THEN '3' WHEN 'pages' THEN '7-' || lang WHEN 'authors' THEN source ELSE '' END AS value
    FROM documents, (SELECT unnest(['identifiers.doi','title','abstract','container_title','publication_year','volume','issue','pages','authors']) AS field) f""")
def s9(spark, sf):
    ev = W.openalex_evidence(W.parse(inverted(spark, sf), "json", W.OPENALEX_SCHEMA))
    v = F.array_join("value", "|")
    return ev.select("doi", "field", F.when(F.col("field") == "abstract", F.md5(v)).otherwise(v).alias("value"))


@query("s10_s2_evidence", """SELECT '10.1/d' || doc_id AS doi, f.field, CASE f.field WHEN 'identifiers.doi' THEN '10.1/d' || doc_id WHEN 'title' THEN source WHEN 'container_title' THEN lang
    WHEN 'publication_year' THEN '2021' WHEN 'authors' THEN source || '|B' ELSE md5(trim(text, E' \\t\\n\\r')) END AS value
    FROM documents, (SELECT unnest(['identifiers.doi','title','abstract','container_title','publication_year','authors']) AS field) f""")
def s10(spark, sf):
    rec = F.struct(F.struct(F.concat(F.lit("10.1/D"), F.col("doc_id").cast("string")).alias("DOI")).alias("externalIds"), F.col("source").alias("title"),
                   F.array(F.struct(F.col("source").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.lit("B").alias("name"))).alias("authors"),
                   F.col("text").alias("abstract"), F.col("lang").alias("venue"), F.lit(2021).alias("year"))
    d = V.table(spark, sf, "documents").select(F.to_json(rec).alias("json"))
    ev = W.s2_evidence(W.parse(d, "json", W.S2_SCHEMA))
    v = F.array_join("value", "|")
    return ev.select("doi", "field", F.when(F.col("field") == "abstract", F.md5(v)).otherwise(v).alias("value"))


@query("s11_with_unavailable", """SELECT o_orderkey::VARCHAR AS publication_id, p.provider, CASE WHEN o_orderstatus = 'P' THEN 'no supported identifier' ELSE 'record not found' END AS detail
    FROM orders, (SELECT unnest(['crossref', 'openalex']) AS provider) p WHERE o_orderstatus = 'P' OR p.provider = 'openalex' OR o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def s11(spark, sf):
    keys = V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("publication_id"),
        F.when(F.col("o_orderstatus") != "P", V.doi("10.1/o", "o_orderkey")).alias("doi"))
    return W.with_unavailable(keys, W.crossref_evidence(crossref(spark, sf)), ["crossref", "openalex"]).filter(
        "status = 'unavailable'").select("publication_id", "provider", "detail")


@query("s16_publisher_enrichment", """SELECT '10.1/p' || p_partkey AS doi, 'elsevier' AS kind, p_name AS abstract, array_to_string(list_sort(list_distinct([lower(p_type), lower(p_brand)])), ';') AS keywords, '' AS event FROM part
    UNION ALL SELECT '10.1/p' || p_partkey, 'springer', p_name, lower(p_brand), p_type FROM part
    UNION ALL SELECT '10.1/p' || p_partkey, 'ieee', p_name, lower(p_brand), CASE WHEN p_size > 25 THEN p_type ELSE '' END FROM part""")
def s16(spark, sf):
    p = V.table(spark, sf, "part")
    doi, bold = F.concat(F.lit("10.1/P"), F.col("p_partkey").cast("string")).alias("doi"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>"))
    recs = {
        "elsevier": F.struct(doi, bold.alias("description"), F.concat("p_brand", F.lit(" | "), "p_type", F.lit(";"), "p_brand").alias("authkeywords")),
        "springer": F.struct(doi, bold.alias("abstract"), F.array("p_brand", F.lit(" ")).alias("keyword"), F.col("p_type").alias("conference")),
        "ieee": F.struct(doi, bold.alias("abstract"), F.create_map(F.lit("author_terms"), F.struct(F.array("p_brand").alias("terms"))).alias("index_terms"),
                         F.when(F.col("p_size") > 25, "Conferences").otherwise("Journals").alias("content_type"), F.col("p_type").alias("publication_title")),
    }
    out = [W.publisher_enrichment(W.parse(p.select(F.to_json(r).alias("json")), "json", W.PUBLISHER_SCHEMAS[k]), k).withColumn("kind", F.lit(k)) for k, r in recs.items()]
    return W.union_evidence(*out).select("doi", "kind", "abstract", F.array_join("keywords", ";").alias("keywords"), "event")


@query("f18_dates", _O + " SELECT doi, coalesce(print_year, year(d)::VARCHAR) AS year, d::VARCHAR AS created FROM o")
def f18(spark, sf):
    return crossref(spark, sf).select(W.norm_doi("DOI").alias("doi"), E.pub_year().alias("year"), W.strict_date("created").cast("string").alias("created"))


@query("e1_base_enrichment", _O + " SELECT doi, '' AS abstract, 'Trade|' || o_orderpriority AS keywords, 'unsupported-markup' AS refused FROM o WHERE false UNION ALL SELECT doi, 'order ' || o_orderkey || ' was placed', 'Trade|' || o_orderpriority, '' FROM o")
def e1(spark, sf):
    b = E.base_enrichment(crossref(spark, sf))
    return b.select("doi", "abstract", F.array_join("keywords", "|").alias("keywords"),
                    F.array_join(F.transform("evidence", lambda e: e["reason"]), "|").alias("refused"))


def _extra(spark, sf) -> DataFrame:
    """Publisher values of closed orders; some abstracts hold markup that is refused."""
    o = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    bad = F.concat(F.lit("<mml:math><mml:mi>x</mml:mi></mml:math> "), F.col("o_orderkey").cast("string"))
    return o.select(V.doi("10.1/o", "o_orderkey").alias("doi"), F.when(F.col("o_totalprice") > 150000, "long text").when(F.col("o_totalprice") > 100000, bad).otherwise("").alias("abstract"),
                    F.array("o_orderpriority").alias("keywords"), F.lit("Conf").alias("event"))


@query("e2_enrich_collect", _O + """ SELECT doi, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 'long text' WHEN o_totalprice > 50000 THEN 'order ' || o_orderkey || ' was placed' ELSE 'fallback' END AS abstract,
    CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 'publisher' WHEN o_totalprice > 50000 THEN 'crossref' ELSE 'fb' END AS abstract_source,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'Trade|' || o_orderpriority END AS keywords, CASE WHEN o_orderstatus = 'F' THEN 'Conf' ELSE '' END AS event,
    concat_ws('|', CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 AND o_totalprice <= 150000 THEN 'publisher' END,
      CASE WHEN o_totalprice <= 50000 AND o_orderkey % 2 = 0 THEN 'other' END) AS refused FROM o""")
def e2(spark, sf):
    w = crossref(spark, sf)
    key = V.doi("10.1/o", "o_orderkey").alias("doi")
    # three fallback sources: the longest safe text wins, a refused one stays as evidence where the fallback is asked
    o = V.table(spark, sf, "orders")
    offered = o.filter("o_totalprice <= 50000").select(key, F.lit("short").alias("source"), F.lit(0).alias("rank"), F.lit("fall").alias("abstract")).unionByName(
        o.filter("o_totalprice <= 50000").select(key, F.lit("fb").alias("source"), F.lit(1).alias("rank"), F.lit("fallback").alias("abstract"))).unionByName(
        o.filter("o_orderkey % 2 = 0").select(key, F.lit("other").alias("source"), F.lit(2).alias("rank"), F.lit("<mml:math><mml:mi>y</mml:mi></mml:math>").alias("abstract")))
    cheap, refused = E.best_abstract(offered)
    base = E.base_enrichment(w).join(cheap.select("doi", F.lit(True).alias("c")), "doi", "left").withColumn(
        "abstract", F.when(F.col("c"), "").otherwise(F.col("abstract"))).drop("c")
    out = E.enrich_collect(base, _extra(spark, sf), cheap, refused)
    return out.select("doi", "abstract", "abstract_source", F.array_join("keywords", "|").alias("keywords"), "event",
                      F.array_join(F.transform("evidence", lambda e: e["source"]), "|").alias("refused"))


@query("e3_enrich_discover", _O + """ SELECT doi, 'order ' || o_orderkey || ' was placed' || CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN ' long text' ELSE '' END AS abstract,
    'Trade|' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '|' || o_orderpriority ELSE '' END AS keywords FROM o""")
def e3(spark, sf):
    out = E.enrich_discover(E.base_enrichment(crossref(spark, sf), keep_refused=True), _extra(spark, sf))
    return out.select("doi", "abstract", F.array_join("keywords", "|").alias("keywords"))


@query("t9_best_abstract", r"""SELECT doi, abstract, source FROM (SELECT conv_id::VARCHAR AS doi, t AS abstract, role AS source, row_number() OVER (PARTITION BY conv_id ORDER BY length(t) DESC, turn) AS rn
    FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations) WHERE t <> '') WHERE rn = 1""")
def t9(spark, sf):
    c = V.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doi"), F.col("role").alias("source"), F.col("turn").alias("rank"), F.col("text").alias("abstract"))
    return E.best_abstract(c)[0]


@query("c16_contributors", _O + """ SELECT doi, 0 AS pos, 'Ann' AS given, c_name AS family, NULL::VARCHAR AS literal, c_custkey::VARCHAR AS orcid FROM o
    UNION ALL SELECT doi, 1, NULL, NULL, CASE WHEN o_orderstatus = 'P' THEN 'Trade Institute' ELSE 'Bo Li' END, NULL FROM o""")
def c16(spark, sf):
    p = crossref(spark, sf).select(W.norm_doi("DOI").alias("doi"), F.posexplode(W.parse_contributors("author")).alias("pos", "a"))
    return p.select("doi", "pos", "a.given", "a.family", "a.literal", F.try_element_at("a.source_fields", F.lit("ORCID")).alias("orcid"))


@query("c17_display_name", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) END AS name FROM part""")
def c17(spark, sf):
    p = V.table(spark, sf, "part")
    person = F.struct(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" ")).alias("given"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("family"),
                      F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ").alias("literal"))
    return p.select("p_partkey", display_name(person).alias("name"))


@query("e5_extract_references", _O + """ SELECT doi, 0 AS pos, '10.1/p' || o_custkey AS ref_doi, 'See that' AS citation FROM o UNION ALL SELECT doi, 1, NULL, c_name || ', (1999)' FROM o""")
def e5(spark, sf):
    return E.extract_references(crossref(spark, sf))


def _slugs(spark, sf) -> DataFrame:
    return V.table(spark, sf, "orders").select(V.doi("10.1/o", "o_orderkey").alias("doi"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("slug"))


_BUILT = _O + """, r AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unsafe title' WHEN o_orderstatus = 'P' THEN 'mixed contributors' END AS reason FROM o)"""


@query("c18_build_publications", _BUILT + """ SELECT doi, o_custkey::VARCHAR AS isbn, 'Order ' || o_orderkey || ' & more' AS title, 'order ' || o_orderkey || ' was placed' AS abstract,
    'Journal ' || c_mktsegment AS container_title, coalesce(print_year, year(d)::VARCHAR) AS publication_year, replace(page, '-', '--') AS pages, 'order-' || o_orderkey AS permalink, 2 AS n_authors FROM r WHERE reason IS NULL""")
def c18(spark, sf):
    w = crossref(spark, sf)
    enr = E.base_enrichment(w).withColumn("event", F.lit(""))
    good, _ = E.build_publications(w, enr, _slugs(spark, sf))
    return good.select("doi", "isbn", "title", "abstract", "container_title", "publication_year", "pages", "permalink", F.size("authors").alias("n_authors"))


@query("c19_collect", _BUILT + """ SELECT doi, coalesce(reason, 'ok') AS status FROM r WHERE o_totalprice > 20000 UNION ALL SELECT '10.1/u' || user_id, 'unavailable' FROM (SELECT DISTINCT user_id FROM events)""")
def c19(spark, sf):
    w = crossref(spark, sf)
    keys = V.table(spark, sf, "orders").filter("o_totalprice > 20000").select(V.doi("10.1/o", "o_orderkey").alias("doi")).unionByName(
        V.table(spark, sf, "events").select(V.doi("10.1/u", "user_id").alias("doi")))
    items, gone, bad = E.collect(keys, w, E.base_enrichment(w).withColumn("event", F.lit("")), _slugs(spark, sf))
    return (items.select("doi", F.lit("ok").alias("status")).unionByName(gone.select("doi", F.lit("unavailable").alias("status")))
            .unionByName(bad.select("doi", F.col("reason").alias("status"))))


def _pubs(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 48, V.doi("10.1/p", "p_partkey")).alias("doi"), F.col("p_type").alias("type"), F.col("p_name").alias("title"),
                    F.when(F.col("p_size") > 30, " Not Available").otherwise("text").alias("abstract"), F.when(F.col("p_size") > 40, "").otherwise("7").alias("volume"))


def _values(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part").filter("p_brand <> 'Brand#3'")
    items = F.explode(F.array(F.struct(F.lit("abstract").alias("field"), F.when(F.col("p_size") > 45, "").otherwise("found").alias("value"), (F.col("p_size") > 44).alias("refused")),
                              F.struct(F.lit("volume").alias("field"), F.lit("9").alias("value"), F.lit(False).alias("refused")),
                              F.struct(F.lit("title").alias("field"), F.upper("p_brand").alias("value"), F.lit(False).alias("refused"))))
    return p.select(V.doi("10.1/p", "p_partkey").alias("doi"), items.alias("r")).select("doi", "r.*")


_P = "WITH p AS (SELECT *, '10.1/p' || p_partkey AS doi FROM part WHERE p_type IN ('ECONOMY', 'SMALL'))"


@query("e6_manual_backfill", _P + """ SELECT p_partkey AS id, 'abstract' AS field FROM p WHERE p_size > 30 UNION ALL SELECT p_partkey, 'volume' FROM p WHERE p_size > 40""")
def e6(spark, sf):
    return E.manual_backfill(_pubs(spark, sf), ["abstract", "volume"], ["ECONOMY", "SMALL"]).select("id", "field")


@query("c6_eligible", _P + " SELECT p_partkey AS id FROM p WHERE p_size > 30 AND p_size < 48")
def c6(spark, sf):
    return E.eligible(_pubs(spark, sf), ["ECONOMY", "SMALL"], ["abstract", "volume"]).select("id")


@query("e7_backfill", _P + """ SELECT p_partkey AS id, 'abstract' AS field, CASE WHEN p_size > 45 THEN 'no value' WHEN p_size > 44 THEN 'review' ELSE 'found' END AS status FROM p WHERE p_size > 30 AND p_size < 48 AND p_brand <> 'Brand#3'
    UNION ALL SELECT p_partkey, 'volume', '9' FROM p WHERE p_size > 40 AND p_size < 48 AND p_brand <> 'Brand#3'
    UNION ALL SELECT p_partkey, '', 'unavailable' FROM p WHERE p_size > 30 AND p_size < 48 AND p_brand = 'Brand#3'""")
def e7(spark, sf):
    props, none, gone = E.backfill(_pubs(spark, sf), _values(spark, sf), ["abstract", "volume"], ["ECONOMY", "SMALL"])
    return (props.select("id", "field", F.when(F.col("review_required"), "review").otherwise(F.col("proposed_value")).alias("status"))
            .unionByName(none.select("id", "field", F.lit("no value").alias("status")))
            .unionByName(gone.select("id", F.lit("").alias("field"), F.lit("unavailable").alias("status"))))


@query("e8_refresh", _P + """, s AS (SELECT * FROM p WHERE p_size > 30 AND p_size < 48 AND p_retailprice > 905), n AS (SELECT * FROM s WHERE p_brand <> 'Brand#3')
    SELECT p_partkey AS id, 'stale' AS kind, CASE WHEN p_retailprice >= 950 THEN 'missing text' ELSE 'changed text' END AS field, '' AS value FROM s
    UNION ALL SELECT p_partkey, 'unavailable', '', '' FROM s WHERE p_brand = 'Brand#3'
    UNION ALL SELECT p_partkey, 'proposal', 'abstract', 'found' FROM n WHERE p_size <= 40
    UNION ALL SELECT p_partkey, 'person', 'abstract', 'refused' FROM n WHERE p_size > 40 AND p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'other', 'abstract', 'provider-missing' FROM n WHERE p_size > 40 AND p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, 'proposal', 'volume', '9' FROM n WHERE p_size > 40 AND p_size % 5 > 0
    UNION ALL SELECT p_partkey, 'other', 'volume', CASE WHEN p_size % 5 = 0 THEN 'provider-missing' ELSE 'substantive-difference' END FROM n WHERE p_size <= 40
    UNION ALL SELECT p_partkey, 'other', 'title', 'substantive-difference' FROM n WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, 'other', 'keywords', 'substantive-difference' FROM n WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, 'other', 'authors', 'substantive-difference' FROM n WHERE p_size % 7 = 0
    UNION ALL SELECT p_partkey, 'other', 'created_date', 'substantive-difference' FROM n WHERE p_size % 4 = 0""")
def e8(spark, sf):
    """Parts whose citation text changed, made anew with values that are equal, written otherwise, different, missing or refused."""
    p = V.table(spark, sf, "part").withColumn("doi", V.doi("10.1/p", "p_partkey"))
    size, lit = F.col("p_size"), F.lit
    person = lambda given: F.array(F.struct(given.alias("given"), F.initcap(F.split_part("p_name", lit(" "), lit(2))).alias("family"), lit(None).cast("string").alias("literal")))
    day = lambda d: F.date_add(lit("1992-01-01"), size + d)
    pubs = _pubs(spark, sf).join(p.select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("keywords"), person(lit("Maria")).alias("authors"), day(lit(0)).alias("created_date")), "id")
    fresh = p.filter("p_brand <> 'Brand#3'").select(
        "doi", "p_type", F.col("p_type").alias("type"), F.when(size % 2 == 0, F.concat("p_name", lit(" two"))).otherwise(F.upper("p_name")).alias("title"),
        F.when(size <= 40, "found").otherwise("").alias("abstract"), F.when(size % 5 > 0, "9").otherwise("").alias("volume"),
        F.when(size % 3 == 0, F.array("p_brand", "p_type")).otherwise(F.array(F.upper("p_brand"))).alias("keywords"),
        F.when(size % 7 == 0, person(lit("Zed"))).otherwise(person(lit("M."))).alias("authors"), day(F.when(size % 4 == 0, 1).otherwise(0)).alias("created_date"))
    refused = p.filter("p_partkey % 2 = 0").select("doi", lit("crossref").alias("source"), lit("<x>").alias("value"), lit("refused").alias("reason"))
    text = p.select("doi", "p_retailprice", F.col("p_name").alias("text"))
    stored = text.withColumn("text", F.when(F.col("p_retailprice") > 905, F.upper("text")).otherwise(F.col("text"))).filter("p_retailprice < 950")
    stale, props, other, gone = E.refresh(pubs, stored.select("doi", "text"), text.select("doi", "text"), fresh, refused, ["abstract", "volume"], ["ECONOMY", "SMALL"])
    tag = lambda d, k, f, v: d.select("id", (F.lit(k) if isinstance(k, str) else k).alias("kind"), f.alias("field"), v.alias("value"))
    why = F.when(F.col("review_required"), F.get(F.col("evidence.reason"), lit(0))).otherwise(F.col("proposed_value"))
    return (tag(stale, "stale", F.col("reason"), lit("")).unionByName(tag(gone, "unavailable", lit(""), lit("")))
            .unionByName(tag(props, F.when(F.col("review_required"), "person").otherwise("proposal"), F.col("field"), why))
            .unionByName(tag(other, "other", F.col("field"), F.col("classification"))))


@query("e9_publisher_of", """SELECT page_id, CASE WHEN contains(html, 'lang="fr"') THEN 'springer' WHEN contains(html, 'lang="de"') THEN 'elsevier' WHEN contains(html, 'lang="es"') THEN 'ieee' END AS publisher FROM pages""")
def e9(spark, sf):
    host = (F.when(F.contains("html", F.lit('lang="fr"')), "link.Springer.com").when(F.contains("html", F.lit('lang="de"')), "www.sciencedirect.com")
            .when(F.contains("html", F.lit('lang="es"')), "ieeexplore.ieee.org").otherwise("example.org"))
    return V.table(spark, sf, "pages").select("page_id", E.publisher_of(F.concat(F.lit("https://"), host, F.lit("/a?b=elsevier"))).alias("publisher"))


@query("e10_categorise", """SELECT p_partkey, CASE WHEN p_name ILIKE '%red%' THEN 'warm' WHEN p_name ILIKE '%blue%' THEN 'cold' WHEN p_type = 'PROMO' THEN 'promo' WHEN p_type = 'SMALL' THEN 'small' END AS category FROM part""")
def e10(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", E.categorise(F.upper("p_name"), "p_type", [("red", "warm"), ("blue", "cold")], {"PROMO": "promo", "SMALL": "small"}).alias("category"))


@query("e11_to_csl", _O + """ SELECT doi, CASE o_orderstatus WHEN 'F' THEN 'article-journal' WHEN 'O' THEN 'chapter' ELSE 'article' END AS type, page,
    coalesce(print_year, year(d)::VARCHAR) AS issued_year, c_name AS family FROM o""")
def e11(spark, sf):
    c = E.to_csl(crossref(spark, sf))
    j = lambda p: F.get_json_object("csl", p)
    return c.select("doi", j("$.type").alias("type"), j("$.page").alias("page"), j("$.issued.date-parts[0][0]").alias("issued_year"), j("$.author[0].family").alias("family"))


@query("e12_tidy_citation", r"""SELECT conv_id, turn, md5(CASE WHEN t = '' THEN '' WHEN ends_with(l, '.') THEN rtrim(l[:-2]) ELSE l END) AS h FROM
    (SELECT conv_id, turn, t, regexp_replace(trim(regexp_split_to_array(t, '\r\n|[\n\r]')[-1]), '^1\.\s*', '') AS l FROM (SELECT *, trim(text, E' \t\n\r') AS t FROM conversations))""")
def e12(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(E.tidy_citation("text")).alias("h"))
