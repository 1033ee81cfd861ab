"""Views that shape the benchmark tables into the entities of the engine.

``TABLES`` names the parquet tables; every view is a whole-table projection. ``SQL``
holds the same views as common table expressions for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

ACCEPT_RULES = [
    r"(?:^|[^\p{L}\p{N}])with(?:[^\p{L}\p{N}]|$)",
    r"(?:^|[^\p{L}\p{N}])from(?:[^\p{L}\p{N}]|$)",
    r"learn|model",
    r"(?:^|[^\p{L}\p{N}])zzyzx",
]
REJECT_RULES = [
    r"[%$#*&]{3}",
    r"(?:^|[^\p{L}\p{N}])und(?:[^\p{L}\p{N}]|$)",
    r"copyright|licen[cs]e",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doi(prefix: str, key):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as screening evidence."""
    return table(spark, sf_dir, "documents").select(
        doi("10.1/d", "doc_id").alias("doi"),
        F.col("doc_id").alias("ord"),
        F.lit("").alias("title"),
        F.col("text").alias("abstract"),
        F.array().cast("array<string>").alias("keywords"),
        F.col("source").alias("batch_id"),
        F.col("lang").alias("work_type"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        doi("10.1/d", "doc_id").alias("doi"),
        F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("label"),
        F.when(F.col("toxic") == 1, "human").otherwise("canonical").alias("source"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as provider records for screening."""
    return evidence(spark, sf_dir).select(
        "doi", "title", "abstract", "keywords", "work_type",
        F.array(F.col("batch_id")).alias("authors"), F.lit("").alias("container_title"))


def uuid_of(c):
    """Name-based id in UUID form, equal in both engines."""
    h = F.md5(c)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers outside one segment as canonical publications; some nations carry no DOI."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        uuid_of(F.col("c_custkey").cast("string")).alias("id"),
        F.when(F.col("c_nationkey") < 20, doi("10.1/c", "c_custkey")).alias("doi"),
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("type"),
        F.col("c_acctbal").cast("string").alias("volume"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a good balance as staged rows: new ids for some nations, new titles for high balances."""
    return table(spark, sf_dir, "customer").filter("c_acctbal > 1000").select(
        F.when(F.col("c_nationkey") < 10, uuid_of(F.concat(F.lit("new"), F.col("c_custkey").cast("string"))))
        .otherwise(uuid_of(F.col("c_custkey").cast("string"))).alias("id"),
        F.when(F.col("c_nationkey") < 20, doi("10.1/c", "c_custkey")).alias("doi"),
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_acctbal") > 5000, F.upper("c_name")).otherwise(F.col("c_name")).alias("title"),
        F.col("c_mktsegment").alias("type"), F.col("c_acctbal").cast("string").alias("volume"))


def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is superseded by the next key when that part is larger: chains of rising sizes."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_size").alias("next_size"))
    return p.join(n, "p_partkey").filter("next_size > p_size").select(
        doi("10.1/p", "p_partkey").alias("src"),
        F.concat(F.lit("10.1/p"), (F.col("p_partkey") + 1).cast("string")).alias("dst"),
        F.lit("superseded").alias("reason"))


def order_states(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """State tables keyed by order: each state is a property of the order."""
    o = table(spark, sf_dir, "orders")
    key = doi("10.1/o", "o_orderkey").alias("doi")
    rules = {
        "canonical": "o_orderstatus = 'F'",
        "queued": "o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
        "review": "o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM'",
        "rejected": "o_totalprice < 60000",
        "staged": "o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000",
    }
    return {name: o.filter(rule).select(key, F.col("o_orderkey").alias("ord")) for name, rule in rules.items()}


def order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on orders: keep the more expensive ones."""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 30000").select(
        doi("10.1/o", "o_orderkey").alias("doi"),
        F.when(F.col("o_totalprice") > 150000, " Keep").otherwise("reject").alias("decision"))


def evidence_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document evidence with human decisions (toxic labels) and corrections (short French texts)."""
    t = table(spark, sf_dir, "labels").filter("toxic = 1").select(
        doi("10.1/d", "doc_id").alias("doi"), F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("human_decision"))
    e = evidence(spark, sf_dir).join(t, "doi", "left")
    return e.withColumn("human_decision", F.coalesce("human_decision", F.lit(""))).withColumn(
        "correction_decision",
        F.when((F.col("work_type") == "fr") & (F.length("abstract") < 1500), "reject").otherwise("")).withColumn(
        "attempt", F.lit(1))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias table of documents: a copy points to the first document with the same text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return d.join(first, "h").filter("doc_id > first_id").select(
        doi("10.1/d", "doc_id").alias("src"), doi("10.1/d", "first_id").alias("terminal"))


_SQL_RULES = {
    "accept": [r.replace("'", "''") for r in ACCEPT_RULES],
    "reject": [r.replace("'", "''") for r in REJECT_RULES],
}


def sql_matches(side: str, text: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, '{r}', 'is') THEN '{r}' END" for r in _SQL_RULES[side])
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


SQL = {
    "evidence": """evidence AS (SELECT '10.1/d' || doc_id AS doi, doc_id AS ord, text AS abstract,
        source AS batch_id, lang AS work_type FROM documents)""",
    "labels_view": """labels_view AS (SELECT '10.1/d' || doc_id AS doi,
        CASE WHEN quality = 1 THEN 'keep' ELSE 'reject' END AS label,
        CASE WHEN toxic = 1 THEN 'human' ELSE 'canonical' END AS source FROM labels)""",
    "matched": f"""matched AS (SELECT e.doi, e.ord, e.batch_id, e.abstract, e.work_type, l.label, l.source,
        {sql_matches('accept', 'abstract')} AS am, {sql_matches('reject', 'abstract')} AS rm
        FROM evidence e LEFT JOIN labels_view l ON e.doi = l.doi)""",
    "triaged": """triaged AS (SELECT *, CASE WHEN len(am) > 0 AND len(rm) > 0 THEN 'review'
        WHEN len(am) > 0 THEN 'queued' WHEN len(rm) > 0 THEN 'rejected' ELSE 'review' END AS outcome FROM matched)""",
}

_UUID = ("substr(md5({0}),1,8)||'-'||substr(md5({0}),9,4)||'-'||substr(md5({0}),13,4)||'-'||substr(md5({0}),17,4)"
         "||'-'||substr(md5({0}),21,12)")
SQL.update({
    "canonical": f"""canonical AS (SELECT {_UUID.format('c_custkey::VARCHAR')} AS id,
        CASE WHEN c_nationkey < 20 THEN '10.1/c' || c_custkey END AS doi, c_custkey AS ord, c_name AS title,
        c_mktsegment AS type, c_acctbal::VARCHAR AS volume FROM customer WHERE c_mktsegment <> 'BUILDING')""",
    "incoming": f"""incoming AS (SELECT CASE WHEN c_nationkey < 10 THEN {_UUID.format("('new' || c_custkey)")}
        ELSE {_UUID.format('c_custkey::VARCHAR')} END AS id, CASE WHEN c_nationkey < 20 THEN '10.1/c' || c_custkey END AS doi,
        c_custkey AS ord, CASE WHEN c_acctbal > 5000 THEN upper(c_name) ELSE c_name END AS title, c_mktsegment AS type,
        c_acctbal::VARCHAR AS volume FROM customer WHERE c_acctbal > 1000)""",
    "edges": """edges AS (SELECT '10.1/p' || a.p_partkey AS src, '10.1/p' || b.p_partkey AS dst FROM part a JOIN part b
        ON b.p_partkey = a.p_partkey + 1 WHERE b.p_size > a.p_size)""",
    "chain": """chain AS (SELECT src, dst FROM edges UNION ALL SELECT c.src, e.dst FROM chain c JOIN edges e ON c.dst = e.src)""",
    "resolved": """resolved AS (SELECT src, dst AS terminal FROM chain WHERE dst NOT IN (SELECT src FROM edges))""",
    "members": """members AS (SELECT '10.1/o' || o_orderkey AS doi, o_orderstatus = 'F' AS canonical,
        o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS queued,
        o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' AS review, o_totalprice < 60000 AS rejected,
        o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000 AS staged, o_orderkey AS ord,
        o_totalprice AS price, o_orderstatus AS status FROM orders)""",
    "present": """present AS (SELECT * FROM members WHERE canonical OR queued OR review OR rejected OR staged)""",
    "odec": """odec AS (SELECT '10.1/o' || o_orderkey AS doi, CASE WHEN o_totalprice > 150000 THEN 'keep' ELSE 'reject' END AS decision
        FROM orders WHERE o_totalprice > 30000)""",
    "decided": """decided AS (SELECT '10.1/d' || d.doc_id AS doi, d.doc_id AS ord, d.text AS abstract, d.source AS batch_id,
        d.lang AS work_type, coalesce(CASE WHEN l.toxic = 1 THEN CASE WHEN l.quality = 1 THEN 'keep' ELSE 'reject' END END, '')
        AS human_decision, CASE WHEN d.lang = 'fr' AND length(d.text) < 1500 THEN 'reject' ELSE '' END AS correction_decision,
        l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))""",
    "copies": """copies AS (SELECT '10.1/d' || doc_id AS src, '10.1/d' || f AS terminal FROM
        (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id > f)""",
})


def with_(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named views, in the given order."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
