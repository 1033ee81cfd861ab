"""Queries that write derived documents to the shared folder, read them back, or run as streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.operators import site as S
from quire.plans import views as V
from quire.plans.catalog import query
from quire.plans.catalog.authoring import site_mapping, site_pubs
from quire.session import ensure_checkpoint_dir
from quire.sources import bib as B, documents as D
from quire.streaming import jobs as J


def scratch(spark) -> str:
    """A new folder under the checkpoint folder, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark)}/quire-{uuid.uuid4()}"


def _people(*names):
    return F.array(*[F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), n.alias("literal"),
                              F.create_map(F.lit("role"), F.lit("x")).alias("source_fields")) for n in names])


def stored(spark, sf) -> DataFrame:
    """Parts as stored publications."""
    p = V.table(spark, sf, "part")
    s = lambda v: F.lit(v)
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.create_map(s("doi"), V.doi("10.1/p", "p_partkey")).alias("identifiers"), F.col("p_type").alias("type"),
        F.col("p_name").alias("title"), _people(F.col("p_brand")).alias("authors"), F.slice(_people(F.col("p_brand")), 1, 0).alias("editors"), s("").alias("abstract"),
        s("J").alias("container_title"), s("2001").alias("publication_year"), F.col("p_size").cast("string").alias("volume"), s("").alias("issue"), s("").alias("pages"),
        s("").alias("publisher"), s("").alias("event"), F.array("p_type").alias("keywords"),
        F.when(F.col("p_size") > 25, F.date_add(F.lit("2001-01-01"), F.col("p_size"))).alias("created_date"), F.col("p_partkey").cast("string").alias("permalink"),
        F.array(F.struct(F.create_map(s("doi"), s("10.1/x")).alias("identifiers"), s("c").alias("citation"))).alias("references"))


@query("s1_read_publications", """SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS author, CASE WHEN p_size > 25 THEN (DATE '2001-01-01' + p_size)::VARCHAR END AS created FROM part""")
def s1(spark, sf):
    path = scratch(spark)
    D.write_publications(stored(spark, sf), path, "2024-01-01")
    good, _ = D.read_publications(spark, f"{D.current_folder(spark, path)}/publications")
    return good.select("id", "title", F.get("authors", F.lit(0))["literal"].alias("author"), F.col("created_date").cast("string").alias("created"))


@query("s1_read_documents", """SELECT p_partkey::VARCHAR AS id, p_name AS title, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS editors, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 2 END AS version,
    row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place FROM part""")
def s1_documents(spark, sf):
    """Exchange files, one for each size of part: bare lists of version 1 without editors, or metadata and publications."""
    path, old = scratch(spark), F.col("volume").cast("int") % 4 == 0
    p = stored(spark, sf).withColumn("created_date", F.col("created_date").cast("string")).withColumn("editors", F.when(~old, F.col("authors")))
    shape = {"ignoreNullFields": "false"}
    version1 = F.to_json(F.struct(*[c for c in p.columns if c != "editors"]), shape)
    listed = p.select("volume", F.struct(F.col("id").cast("long").alias("key"), F.when(old, version1).otherwise(F.to_json(F.struct(*p.columns), shape)).alias("record")).alias("r"), old.alias("old"))
    files = listed.groupBy("volume", "old").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["record"]), ",").alias("records"))
    text = F.when(F.col("old"), F.concat(F.lit("["), "records", F.lit("]"))).otherwise(
        F.concat(F.lit('{"metadata":{"schema_version":2},"publications":['), "records", F.lit("]}")))
    files.select(text.alias("value"), "volume").repartition("volume").write.partitionBy("volume").text(path)
    records = D.read_records(spark, f"{path}/*", "document").withColumn("ord", F.struct("ord.*", "schema_version"))  # the version travels with the place
    good = D.validate_publications(records)[0]
    return good.select("id", "title", F.size("editors").alias("editors"), F.col("ord.schema_version").alias("version"), (F.col("ord.line") + 1).alias("place"))


@query("s2_write_publications", "SELECT 2 AS schema_version, '2024-01-01' AS last_update, count(*) AS publications FROM part")
def s2(spark, sf):
    path = scratch(spark)
    D.write_publications(stored(spark, sf), path, "2024-01-01")
    now = D.current_folder(spark, path)
    meta = spark.read.schema("schema_version int, last_update string").json(f"{now}/metadata")
    n = spark.read.text(f"{now}/publications").agg(F.count("*").alias("publications")).scalar()
    return meta.withColumn("publications", n)


@query("s3_validate_publications", """SELECT p_partkey AS ord, concat_ws(';', CASE WHEN p_size > 45 THEN 'missing fields: title' END, CASE WHEN p_size > 40 THEN 'unknown fields: extra' END,
    CASE WHEN p_size <= 5 THEN 'volume must be a string' END, CASE WHEN p_size = 10 THEN 'no contributor' END) AS reasons FROM part WHERE p_size > 40 OR p_size <= 5 OR p_size = 10""")
def s3(spark, sf):
    rec = F.to_json(F.struct(*[c for c in stored(spark, sf).columns]), {"ignoreNullFields": "false"})
    p = stored(spark, sf).withColumn("created_date", F.col("created_date").cast("string")).withColumn("record", rec).withColumn("size", F.col("volume").cast("int"))
    r = F.col("record")
    r = F.when(F.col("size") > 45, F.regexp_replace(r, r'"title":"[^"]*",', "")).otherwise(r)
    r = F.when(F.col("size") > 40, F.concat(F.lit('{"extra":1,'), F.substr(r, F.lit(2)))).otherwise(r)
    r = F.when(F.col("size") <= 5, F.regexp_replace(r, r'"volume":"(\d+)"', r'"volume":$1')).otherwise(r)
    r = F.when(F.col("size") == 10, F.regexp_replace(r, r'"authors":\[[^\]]*\]', '"authors":[]')).otherwise(r)
    rows = p.select(F.col("id").cast("long").alias("ord"), F.lit(2).alias("schema_version"), r.alias("record"))
    return D.validate_publications(rows)[1].select("ord", F.array_join("reasons", ";").alias("reasons"))


@query("s4_read_tokens", "SELECT DISTINCT 'doi' AS kind, '10.1/u' || user_id AS value FROM events")
def s4(spark, sf):
    path = scratch(spark)
    e = V.table(spark, sf, "events")
    lines = F.when(F.col("event_type") == "view", F.concat(F.lit(" https://doi.org/10.1/U"), F.col("user_id").cast("string"))).when(
        F.col("event_type") == "click", F.concat(F.lit("# "), "props")).when(F.col("event_type") == "error", "").otherwise(
        F.concat(F.lit("DOI:10.1/u"), F.col("user_id").cast("string")))
    e.select(lines.alias("value")).write.text(path)
    return D.read_tokens(spark, path, ["doi"], legacy=True)[0].select("kind", "value")


@query("s5_write_tokens", "SELECT 'doi:10.1/o' || o_orderkey AS value FROM orders")
def s5(spark, sf):
    path = scratch(spark)
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.lit("doi").alias("kind"), V.doi("10.1/o", "o_orderkey").alias("value"))
    D.write_tokens(o, path)
    return spark.read.text(path)


@query("s6_read_author_mapping", """SELECT p_brand || '-' || p_size AS slug, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS pos, p_name AS name FROM part""")
def s6(spark, sf):
    """Mapping documents, one for each size of part, of brand to the names of its parts."""
    path = scratch(spark)
    p = V.table(spark, sf, "part")
    names = p.groupBy("p_size", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("slug")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat(F.lit(" "), x["p_name"])).alias("names"))
    docs = names.groupBy("p_size").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("slug", "names")))).alias("value"))
    docs.repartition("p_size").write.partitionBy("p_size").text(path)
    return D.read_author_mapping(spark, f"{path}/*")


@query("s7_read_evidence", """SELECT '10.1/d' || doc_id AS doi, CASE WHEN lang = 'en' THEN source ELSE '' END AS container_title, CASE WHEN lang = 'fr' THEN 'keep' ELSE '' END AS correction_decision FROM documents""")
def s7(spark, sf):
    d = V.table(spark, sf, "documents")
    base = [V.doi("10.1/d", "doc_id").alias("doi"), F.lit("").alias("title"), F.col("text").alias("abstract"), F.col("source").alias("batch_id")]
    rec = F.when(F.col("lang") == "en", F.to_json(F.struct(*base, F.col("source").alias("container_title")))).when(
        F.col("lang") == "fr", F.to_json(F.struct(*base, F.lit("keep").alias("correction_decision")))).otherwise(F.to_json(F.struct(*base)))
    return D.read_evidence(d.select(F.col("doc_id").alias("ord"), rec.alias("record")))[0].select("doi", "container_title", "correction_decision")


@query("s12_read_feed", """SELECT c_name AS title, 'Balance of ' || c_mktsegment AS summary, 'A|B' AS authors, '2024-01-05' AS updated FROM customer WHERE c_nationkey <> 7""")
def s12(spark, sf):
    path = scratch(spark)
    c = V.table(spark, sf, "customer")
    day = F.when(F.col("c_nationkey") == 7, "bad").otherwise("2024-01-05T10:00:00Z")
    entry = F.concat(F.lit("<entry><title> "), "c_name", F.lit("</title><summary>Balance   of\t"), "c_mktsegment", F.lit("</summary><id>x</id><author><name>A</name></author><author><name> B</name></author><updated>"), day, F.lit("</updated></entry>"))

    def wrapped(frames):
        yield pd.DataFrame({"value": ["<feed>"]})
        yield from frames
        yield pd.DataFrame({"value": ["</feed>"]})

    c.select(entry.alias("value")).mapInPandas(wrapped, "value string").write.text(path)
    return D.read_feed(spark, path)[0].select("title", "summary", F.array_join("authors", "|").alias("authors"), F.col("updated").cast("string").alias("updated"))


def bib_texts(spark, sf) -> DataFrame:
    """Parts as bibliographic entries; some are broken, some lists hold an empty segment."""
    p = V.table(spark, sf, "part")
    size = F.col("p_size")
    author = F.when(size == 4, F.concat(F.lit("A and "), "p_brand", F.lit(" and "))).when(size == 5, F.lit("Other Name")).otherwise(F.concat(F.lit("{"), "p_brand", F.lit(" and Sons} and "), "p_name"))
    field = F.when(size == 3, "").otherwise(F.concat(F.lit(",\n  author = {"), author, F.lit("}")))
    body = F.concat(F.lit("@Article{k"), F.col("p_partkey").cast("string"), F.lit(",\n  title = \"T {\\\"o} "), "p_name", F.lit("\""), field, F.lit(",\n % note\n year = 2001\n}\n"))
    text = F.when(size == 1, "").when(size == 2, F.concat(body, F.lit("@Book{x, y = 1}"))).otherwise(body)
    return p.select(F.col("p_partkey").cast("string").alias("permalink"), text.alias("text"), "p_size")


@query("s13_parse_bib", r"""SELECT p_partkey::VARCHAR AS permalink, f.field, CASE f.field WHEN 'title' THEN 'T {\"o} ' || p_name WHEN 'year' THEN '2001'
      ELSE CASE WHEN p_size = 4 THEN 'A and ' || p_brand || ' and ' WHEN p_size = 5 THEN 'Other Name' ELSE '{' || p_brand || ' and Sons} and ' || p_name END END AS value, NULL::VARCHAR AS error
    FROM part, (SELECT unnest(['title', 'author', 'year']) AS field) f WHERE p_size > 2 AND NOT (p_size = 3 AND f.field = 'author')
    UNION ALL SELECT p_partkey::VARCHAR, NULL, NULL, CASE WHEN p_size = 1 THEN 'empty' ELSE 'more than one entry' END FROM part WHERE p_size <= 2""")
def s13(spark, sf):
    return B.parse_bib(bib_texts(spark, sf)).select("permalink", "field", "value", "error")


def _bib_pubs(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("string").alias("permalink"),
                    F.array(F.concat(F.lit("Sons and "), "p_brand"), "p_name").alias("authors"), F.array().cast("array<string>").alias("editors"), "p_size")


@query("j14_audit_bib", """SELECT p_partkey::VARCHAR AS id, 'bib' AS field, 'missing file' AS kind FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey::VARCHAR, 'bib', 'invalid file' FROM part WHERE p_size <= 2
    UNION ALL SELECT p_partkey::VARCHAR, 'author', 'missing field' FROM part WHERE p_size = 3 UNION ALL SELECT p_partkey::VARCHAR, 'author', 'malformed list' FROM part WHERE p_size = 4
    UNION ALL SELECT p_partkey::VARCHAR, 'author', 'mismatch' FROM part WHERE p_size IN (4, 5)""")
def j14(spark, sf):
    return B.audit_bib(_bib_pubs(spark, sf), B.parse_bib(bib_texts(spark, sf).filter("p_size <= 45")))


@query("h4_bib_repairs", """SELECT p_partkey::VARCHAR AS id, 'author' AS field, 'Sons and ' || p_brand || ' and ' || p_name AS proposed_value, true AS deterministic FROM part WHERE p_size = 3
    UNION ALL SELECT p_partkey::VARCHAR, 'author', 'A and ' || p_brand, true FROM part WHERE p_size = 4 UNION ALL SELECT p_partkey::VARCHAR, 'bib', NULL, false FROM part WHERE p_size <= 2""")
def h4(spark, sf):
    pubs, bib = _bib_pubs(spark, sf), B.parse_bib(bib_texts(spark, sf))
    return B.bib_repairs(B.audit_bib(pubs, bib), pubs, bib).select("id", "field", "proposed_value", "deterministic")


@query("s14_site_tables", """SELECT year(o_orderdate)::VARCHAR AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < 470000 GROUP BY 1""")
def s14(spark, sf):
    path, m = scratch(spark), site_mapping(spark, sf)
    p = site_pubs(spark, sf).filter("publication_year <> 'n.d.'")
    D.write_site_tables(p, *S.memberships(p, m), path, "2024-01-01")
    return D.read_version(spark, path, "years").groupBy(F.col("year").cast("string").alias("year")).agg(F.count("*").alias("n"))


@query("s15_write_if_changed", "SELECT count(*) AS n, true AS first, false AS again, true AS changed FROM part")
def s15(spark, sf):
    path, p = scratch(spark), V.table(spark, sf, "part")
    wrote = [D.write_if_changed(p, path), D.write_if_changed(p.repartition(3), path), D.write_if_changed(p.withColumn("p_size", F.col("p_size") + 1), path)]
    return D.read_version(spark, path).agg(F.count("*").alias("n")).select("n", *[F.lit(w).alias(k) for w, k in zip(wrote, ("first", "again", "changed"))])


# -- streams ---------------------------------------------------------------------------

def _stream(spark, sf, table: str) -> DataFrame:
    return spark.readStream.schema(V.table(spark, sf, table).schema).parquet(f"{sf}/{table}*.parquet")


@query("x1_screen_stream", """SELECT DISTINCT '10.1/u' || user_id || event_type AS doi, CASE WHEN event_type = 'click' THEN 'queued' WHEN event_type = 'error' THEN 'rejected' ELSE 'review' END AS outcome
    FROM events WHERE event_type <> 'signup'""")
def x1(spark, sf):
    key = F.concat(F.lit("10.1/u"), F.col("user_id").cast("string"), "event_type").alias("doi")
    events = _stream(spark, sf, "events").select(key, F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    known = V.table(spark, sf, "events").filter("event_type = 'signup'").select(key).distinct()
    path = scratch(spark)
    out = J.screen_stream(events, known, ["click"], ["err.r"]).select("doi", "outcome")
    q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("doi string, outcome string").parquet(f"{path}/out")


@query("x1_late_rows", """WITH e AS (SELECT event_id, ts, event_type, user_id % 3 AS part FROM events), m AS (SELECT part, max(ts) AS newest FROM e GROUP BY part)
    SELECT '10.1/e' || event_id AS doi, CASE WHEN event_type = 'click' THEN 'queued' WHEN event_type = 'error' THEN 'rejected' ELSE 'review' END AS outcome,
      coalesce(ts < (SELECT max(newest) FROM m WHERE m.part < e.part) - INTERVAL 10 DAY, false) AS late FROM e""")
def x1_late(spark, sf):
    """Three batches whose times overlap; the later ones repeat some rows of the first."""
    path, part = scratch(spark), F.col("user_id") % 3
    rows = V.table(spark, sf, "events").select(V.doi("10.1/e", "event_id").alias("doi"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"), "user_id", "event_id")
    for k in range(3):  # files are taken in the order of their time, one for each batch
        rows.filter((part == k) | ((part == 0) & (F.col("event_id") % 5 == k))).select("doi", "ts", "text").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("doi string, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    J.screen_into(stream, rows.select("doi").limit(0), ["click"], ["err.r"], f"{path}/out", f"{path}/ckpt", "10 days").awaitTermination()
    both = [J.arrivals(spark, f"{path}/out", late).select("doi", "outcome", F.lit(late).alias("late")) for late in (False, True)]
    return both[0].unionByName(both[1])


@query("x2_merge_stream", """WITH c AS (SELECT * FROM customer) SELECT '10.1/c' || c_custkey AS doi, CASE WHEN c_acctbal > 5000 THEN upper(c_name) ELSE c_name END AS title FROM c WHERE c_acctbal > 1000 AND c_nationkey < 20
    UNION ALL SELECT '10.1/c' || c_custkey, c_name FROM c WHERE c_acctbal <= 1000 AND c_nationkey < 20 AND c_mktsegment <> 'BUILDING'""")
def x2(spark, sf):
    path = scratch(spark)
    incoming = _stream(spark, sf, "customer").filter("c_acctbal > 1000 AND c_nationkey < 20").select(
        V.uuid_of(F.concat(F.lit("new"), F.col("c_custkey").cast("string"))).alias("id"), V.doi("10.1/c", "c_custkey").alias("doi"), F.col("c_custkey").alias("ord"),
        F.when(F.col("c_acctbal") > 5000, F.upper("c_name")).otherwise(F.col("c_name")).alias("title"))
    base = V.canonical(spark, sf).filter("doi IS NOT NULL").select("id", "doi", "ord", "title").withColumn("side", F.lit(0))
    J.merge_stream(incoming, base, f"{path}/canon", f"{path}/ckpt").awaitTermination()
    return J.latest_version(spark, f"{path}/canon").select("doi", "title")


@query("x4_limited_stream", "SELECT 'u' || user_id AS source, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS limited_at FROM events WHERE event_type = 'error' AND value > 50 GROUP BY user_id")
def x4_stream(spark, sf):
    path = scratch(spark)
    e = _stream(spark, sf, "events").select(V.doi("u", "user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 50), 429).otherwise(200).alias("status"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    J.limited_sources_stream(e).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("source", F.date_format("limited_at", "yyyy-MM-dd HH:mm:ss").alias("limited_at"))
