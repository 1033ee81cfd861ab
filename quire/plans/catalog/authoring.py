"""Queries of author identities and site indexes; part names serve as person names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import text as T
from quire.operators import authors as A, site as S
from quire.plans import views as V
from quire.plans.catalog import query


def mapping(spark, sf) -> DataFrame:
    """Every part name as identity, its initial form as another one, and an accented copy of the red ones."""
    n = V.table(spark, sf, "part").select("p_name").distinct()
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    full = n.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.lit(1).alias("pos"), F.col("p_name").alias("name"))
    short = n.select(F.concat(F.substring(first, 1, 1), F.lit("-"), last).alias("slug"), F.lit(1).alias("pos"), F.concat(F.substring(first, 1, 1), F.lit(". "), last).alias("name")).distinct()
    accent = n.filter("p_name LIKE 'red %'").select(F.concat(F.lit("x-red-"), last).alias("slug"), F.lit(1).alias("pos"), F.concat(F.lit("Réd "), last).alias("name"))
    return full.unionByName(short).unionByName(accent)


_M = """m AS (SELECT DISTINCT replace(p_name, ' ', '-') AS slug, p_name AS name FROM part UNION ALL
    SELECT DISTINCT p_name[1] || '-' || split_part(p_name, ' ', 2), p_name[1] || '. ' || split_part(p_name, ' ', 2) FROM part UNION ALL
    SELECT DISTINCT 'x-red-' || split_part(p_name, ' ', 2), 'Réd ' || split_part(p_name, ' ', 2) FROM part WHERE p_name LIKE 'red %')"""


def known(spark, sf) -> DataFrame:
    """Identities of the names of small parts."""
    n = V.table(spark, sf, "part").filter("p_size <= 3").select("p_name").distinct()
    return n.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.lit(1).alias("pos"), F.col("p_name").alias("name"))


def pubs(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"),
                    F.array("p_name", F.when(F.col("p_size") > 40, F.upper("p_name")).otherwise(F.concat(F.lit("zed "), F.split_part("p_name", F.lit(" "), F.lit(1))))).alias("authors"))


_K = """k AS (SELECT DISTINCT replace(p_name, ' ', '-') AS slug, p_name AS name FROM part WHERE p_size <= 3),
  a AS (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_name) ELSE 'zed ' || split_part(p_name, ' ', 1) END FROM part),
  u AS (SELECT name, count(*) AS n FROM a WHERE name NOT IN (SELECT name FROM k) GROUP BY name),
  g AS (SELECT lower(replace(name, ' ', '-')) AS slug, count(*) AS names, sum(n)::BIGINT AS occurrences FROM u GROUP BY 1),
  sig AS (SELECT DISTINCT split_part(slug, '-', 2) || '|' || slug[1] AS s FROM k),
  plan AS (SELECT *, slug IN (SELECT slug FROM k) AS taken, split_part(slug, '-', 2) || '|' || slug[1] IN (SELECT s FROM sig) AS alike FROM g)"""


@query("a13_occurrences", f"WITH {_K} SELECT name, count(*) AS n FROM a GROUP BY name")
def a13(spark, sf):
    return A.occurrences(pubs(spark, sf))


@query("a13_author_status", f"""WITH {_K} SELECT (SELECT count(*) FROM k) AS known_variants, (SELECT count(*) FROM u) AS unknown_names,
    count(*) FILTER (NOT taken AND names = 1 AND NOT alike) AS safe, coalesce(sum(names) FILTER (taken OR names > 1 OR alike), 0)::BIGINT AS manual_review FROM plan""")
def a13_status(spark, sf):
    return A.author_status(pubs(spark, sf), known(spark, sf))


@query("t8_unknown_names", f"WITH {_K} SELECT name, n FROM u")
def t8(spark, sf):
    return A.ordered_unknown_names(pubs(spark, sf), known(spark, sf)).select("name", "n")


@query("j17_possible_matches", f"WITH {_K} SELECT u.name, k.slug FROM u JOIN k ON split_part(k.slug, '-', 2) = lower(split_part(u.name, ' ', 2)) AND k.slug[1] = lower(u.name[1])")
def j17(spark, sf):
    k = known(spark, sf)
    return A.possible_matches(A.unknown_names(pubs(spark, sf), k), k)


@query("n1_plan_authors", f"""WITH {_K} SELECT slug, names, occurrences, concat_ws(';', CASE WHEN taken THEN 'slug exists' END, CASE WHEN names > 1 THEN 'several names' END,
    CASE WHEN alike THEN 'same surname and initial' END) AS reasons FROM plan""")
def n1(spark, sf):
    safe, review = A.plan_authors(pubs(spark, sf), known(spark, sf))
    return safe.select("slug", F.lit(1).cast("long").alias("names"), "occurrences", F.lit("").alias("reasons")).unionByName(
        review.select("slug", "names", "occurrences", F.array_join("reasons", ";").alias("reasons")))


@query("n2_author_cases", f"""WITH {_K}, r AS (SELECT u.name FROM u JOIN plan p ON p.slug = lower(replace(u.name, ' ', '-')) WHERE taken OR names > 1 OR alike),
    w AS (SELECT name, name AS seen_name, 'self' AS candidate FROM r UNION ALL SELECT r.name, k.name, k.slug FROM r JOIN k ON split_part(k.slug, '-', 2) = lower(split_part(r.name, ' ', 2)) AND k.slug[1] = lower(r.name[1]))
    SELECT w.name, w.candidate, count(*) AS n FROM w JOIN a ON a.name = w.seen_name GROUP BY 1, 2""")
def n2(spark, sf):
    k, p = known(spark, sf), pubs(spark, sf)
    _, review = A.plan_authors(p, k)
    names = A.unknown_names(p, k).select("name", T.slugify("name").alias("slug")).join(review.select("slug"), "slug", "left_semi")
    people = p.select("id", "title", F.transform("authors", lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("orcid"), F.array().cast("array<string>").alias("affiliations"))).alias("people"))
    return A.author_cases(people, names, k).groupBy("name", "candidate").agg(F.count("*").alias("n"))


@query("j16_encoding_groups", f"WITH {_M} SELECT DISTINCT replace(slug[3:], '-', '') AS compact, slug[3:] AS anchor, slug FROM m WHERE slug LIKE 'x-%'")
def j16(spark, sf):
    return A.encoding_groups(mapping(spark, sf))


@query("j16_initial_candidates", """SELECT DISTINCT split_part(p_name, ' ', 2) AS family, split_part(p_name, ' ', 1) AS full_given, p_name[1] AS initial FROM part""")
def j16_initial(spark, sf):
    c = A.initial_candidates(mapping(spark, sf))
    full = F.when(F.length("left_given") > 1, F.col("left_given")).otherwise(F.col("right_given"))
    return c.select("family", full.alias("full_given"), F.substring("left_given", 1, 1).alias("initial"))


@query("n4_slug_findings", """SELECT DISTINCT p_name[1] || '-' || split_part(p_name, ' ', 2) AS slug,
    max(replace(p_name, ' ', '-')) OVER (PARTITION BY p_name[1], split_part(p_name, ' ', 2)) AS proposed_slug FROM part WHERE false
    UNION ALL SELECT slug, replace(name, ' ', '-') FROM (SELECT p_name[1] || '-' || split_part(p_name, ' ', 2) AS slug, p_name AS name,
      row_number() OVER (PARTITION BY p_name[1], split_part(p_name, ' ', 2) ORDER BY length(p_name) DESC, p_name) AS rn FROM (SELECT DISTINCT p_name FROM part)) WHERE rn = 1""")
def n4(spark, sf):
    n = V.table(spark, sf, "part").select("p_name").distinct()
    short = F.concat(F.substring("p_name", 1, 1), F.lit("-"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return A.slug_findings(n.select(short.alias("slug"), F.lit(1).alias("pos"), F.col("p_name").alias("name")))[0]


def _pairs(spark, sf) -> DataFrame:
    return A.initial_candidates(mapping(spark, sf)).select("left_slug", "right_slug")


@query("n5_suppress_distinct", """WITH p AS (SELECT DISTINCT least(replace(p_name, ' ', '-'), p_name[1] || '-' || split_part(p_name, ' ', 2)) AS left_slug,
    greatest(replace(p_name, ' ', '-'), p_name[1] || '-' || split_part(p_name, ' ', 2)) AS right_slug FROM part)
    SELECT left_slug, right_slug FROM p WHERE NOT (right_slug LIKE '%-bolt')""")
def n5(spark, sf):
    m = mapping(spark, sf)
    p = _pairs(spark, sf)
    fp = A.pair_fingerprint(p.distinct(), m)
    dec = fp.filter("right_slug LIKE '%-bolt' OR right_slug LIKE '%-ring'").withColumn(
        "fingerprint", F.when(F.col("right_slug").like("%-ring"), "old").otherwise(F.col("fingerprint")))
    return A.suppress_distinct(p, m, dec)[0]


@query("n3_edit_authors", f"""WITH {_M} SELECT CASE WHEN slug LIKE 'x-red-%' THEN slug[3:] WHEN slug LIKE '%-bolt' AND slug[2] = '-' THEN 'short-' || slug ELSE slug END AS slug, name FROM m
    UNION ALL SELECT DISTINCT replace(p_name, ' ', '-'), p_name || ' jr' FROM part""")
def n3(spark, sf):
    m = mapping(spark, sf)
    none = F.lit(None).cast("string")
    merge = m.filter("slug LIKE 'x-red-%'").select(F.lit("merge").alias("op"), "slug", F.substr("slug", F.lit(3)).alias("target"), none.alias("name"))
    rename = m.filter("slug LIKE '%-bolt' AND substring(slug, 2, 1) = '-' AND slug NOT LIKE 'x-red-%'").select(F.lit("rename").alias("op"), "slug", F.concat(F.lit("short-"), "slug").alias("target"), none.alias("name"))
    full = V.table(spark, sf, "part").select("p_name").distinct()
    assign = full.select(F.lit("assign").alias("op"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), none.alias("target"), F.concat("p_name", F.lit(" jr ")).alias("name"))
    bad = full.select(F.lit("create").alias("op"), F.lit("a/b").alias("slug"), none.alias("target"), F.concat("p_name", F.lit(" new")).alias("name"))
    return A.edit_authors(m, merge.unionByName(rename).unionByName(assign).unionByName(bad))[0].select("slug", "name")


@query("s6_mapping_errors", """SELECT DISTINCT 'n/a' AS slug, '' AS name, 'unsafe slug' AS problem FROM part UNION ALL
    SELECT min(slug), name, 'ambiguous name' FROM (SELECT DISTINCT CASE WHEN p_brand = 'Brand#5' THEN 'n/a' ELSE lower(p_type) END AS slug, p_name AS name FROM part) GROUP BY name HAVING min(slug) <> max(slug)""")
def s6(spark, sf):
    p = V.table(spark, sf, "part")
    return A.mapping_errors(p.select(F.when(F.col("p_brand") == "Brand#5", "n/a").otherwise(F.lower("p_type")).alias("slug"), F.lit(1).alias("pos"), F.concat(F.lit(" "), "p_name").alias("name")))


@query("i10_allocate_slugs", """WITH b AS (SELECT p_partkey, replace(p_name, ' ', '-') AS base FROM part), used AS (SELECT DISTINCT base || '0' AS slug FROM b WHERE base LIKE 'red%'),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b)
    SELECT p_partkey::VARCHAR AS id, base || repeat('0', (CASE WHEN base LIKE 'red%' AND k > 1 THEN k ELSE k - 1 END)::INT) AS slug FROM r""")
def i10(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))
    used = p.filter("title LIKE 'red%'").select(F.concat(T.slugify("title"), F.lit("0")).alias("slug"))
    return A.allocate_slugs(p, used)


@query("f19_author_sort_key", """SELECT p_partkey, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS key FROM part""")
def f19(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", T.author_sort_key(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" d'"), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("key"))


# -- site ------------------------------------------------------------------------------

def site_pubs(spark, sf) -> DataFrame:
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("permalink"), V.doi("10.1/o", "o_orderkey").alias("doi"),
        F.when(F.col("o_totalprice") < 480000, F.to_date("o_orderdate")).alias("created_date"),
        F.when(F.col("o_totalprice") < 470000, F.year("o_orderdate").cast("string")).otherwise("n.d.").alias("publication_year"),
        F.col("o_orderpriority").alias("title"), F.array("c_name").alias("authors"))


def site_mapping(spark, sf) -> DataFrame:
    return V.table(spark, sf, "customer").filter("c_nationkey <> 3").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("slug"), F.lit(1).alias("pos"), F.col("c_name").alias("name"))


_SITE = """WITH p AS (SELECT o_orderkey AS id, 'o' || o_orderkey AS permalink, CASE WHEN o_totalprice < 480000 THEN o_orderdate::DATE END AS d,
    CASE WHEN o_totalprice < 470000 THEN year(o_orderdate)::VARCHAR ELSE 'n.d.' END AS y, o_orderpriority AS title, c_name, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("a14_site_errors", _SITE + " SELECT id, 'missing created_date' AS problem FROM p WHERE d IS NULL UNION ALL SELECT id, 'invalid year' FROM p WHERE y = 'n.d.' UNION ALL SELECT id, 'unmapped author' FROM p WHERE c_nationkey = 3")
def a14_errors(spark, sf):
    return S.site_errors(site_pubs(spark, sf), site_mapping(spark, sf))


@query("a14_author_pages", _SITE + """ SELECT 'c' || c_custkey AS slug, c_name AS name, count(*) AS publications, arg_max(id, (coalesce(d, DATE '0001-01-01'), y, title, permalink)) AS newest, 1::BIGINT AS variants
    FROM p WHERE c_nationkey <> 3 GROUP BY c_custkey, c_name""")
def a14(spark, sf):
    m = site_mapping(spark, sf)
    return S.author_pages(S.memberships(site_pubs(spark, sf), m)[0], m)


@query("a14_year_pages", _SITE + " SELECT y AS year, count(*) AS publications, arg_max(id, (coalesce(d, DATE '0001-01-01'), c_name, title, permalink)) AS newest FROM p GROUP BY y")
def a14_years(spark, sf):
    return S.year_pages(S.memberships(site_pubs(spark, sf), site_mapping(spark, sf))[1])


@query("a14_newest_members", _SITE + """ SELECT y AS year, rank, id FROM (SELECT y, id, row_number() OVER (PARTITION BY y ORDER BY d DESC NULLS LAST, c_name DESC, title DESC, permalink DESC) AS rank FROM p)""")
def a14_newest(spark, sf):
    return S.ranked_members(S.memberships(site_pubs(spark, sf), site_mapping(spark, sf))[1], "year")


@query("t6_order_publications", _SITE + " SELECT id, permalink FROM p")
def t6(spark, sf):
    return S.order_publications(site_pubs(spark, sf)).select("id", "permalink")


@query("t7_author_index", """WITH m AS (SELECT DISTINCT replace(p_name, ' ', '-') AS slug, p_name AS name, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS key FROM part)
    SELECT slug, name, key, key[1] AS letter, row_number() OVER (PARTITION BY key[1] ORDER BY key, name) = 1 AS starts_letter FROM m""")
def t7(spark, sf):
    n = V.table(spark, sf, "part").select("p_name").distinct()
    return S.author_index(n.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.col("p_name").alias("name")))


@query("j15_file_coverage", "SELECT 'missing' AS kind, 'o' || o_orderkey AS name FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT DISTINCT 'orphan', 'u' || user_id FROM events")
def j15(spark, sf):
    files = V.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name")).unionByName(
        V.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")))
    missing, orphan = S.file_coverage(site_pubs(spark, sf), files)
    return missing.select(F.lit("missing").alias("kind"), F.col("permalink").alias("name")).unionByName(orphan.select(F.lit("orphan").alias("kind"), F.col("permalink").alias("name")))
