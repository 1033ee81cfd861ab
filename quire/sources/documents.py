"""Readers and writers of the engine's own documents. Bad records become rows with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.identity import parse_token, token_text
from quire.functions.text import collapse, strip
from quire.operators.sets import dedupe_first
from quire.sources.versions import Part, current_folder, publish

_PERSON = "struct<given:string,family:string,literal:string,source_fields:map<string,string>>"
PUBLICATION_SCHEMA = f"""id string, identifiers map<string,string>, type string, title string, authors array<{_PERSON}>, editors array<{_PERSON}>,
  abstract string, container_title string, publication_year string, volume string, issue string, pages string, publisher string, event string,
  keywords array<string>, created_date string, permalink string, references array<struct<identifiers:map<string,string>,citation:string>>"""
_STRINGS = ["id", "type", "title", "abstract", "container_title", "publication_year", "volume", "issue", "pages", "publisher", "event", "permalink"]
_REQUIRED = _STRINGS + ["identifiers", "authors", "keywords", "created_date", "references"]


def line_order() -> Column:
    """Place of a line among all files read: file, begin of the split in it, line of the split.

    Splits of one file ascend with their begin and a task numbers the lines of a split in order, so
    the comparison of two places does not depend on how files are cut and packed into tasks.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


def read_records(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """``(ord, schema_version, record)`` with one JSON text per publication; ``ord`` sorts in the order of files and records.

    ``lines`` is the layout for large data: splittable, one record per line, version 2.
    ``document`` reads whole exchange files: a bare list (version 1) or metadata plus publications.
    Each file is one task's work there; a file that is neither has no records.
    """
    if layout == "lines":
        rows = spark.read.text(path).select(line_order().alias("ord"), "value").filter(F.trim("value") != "")
        return rows.select("ord", F.lit(2).alias("schema_version"), F.col("value").alias("record"))
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
    docs = docs.select("file", "doc", F.try_variant_get("doc", "$.publications", "array<variant>").alias("pubs"),
                       F.try_variant_get("doc", "$", "array<variant>").alias("bare"),
                       F.try_variant_get("doc", "$.metadata.schema_version", "int").alias("version"))
    return docs.select("file", F.coalesce("version", F.lit(1)).alias("schema_version"), F.posexplode(F.coalesce("pubs", "bare")).alias("pos", "v")).select(
        F.struct("file", F.lit(0).cast("long").alias("start"), F.col("pos").cast("long").alias("line")).alias("ord"), "schema_version", F.to_json("v").alias("record"))


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit("ABSENT"))


def validate_publications(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed publications and rejected records ``(ord, reasons)``; version 1 records have no editors."""
    rows = records.withColumn("_v", F.try_parse_json("record"))
    keys = F.coalesce(F.json_object_keys("record"), F.array().cast("array<string>"))
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    allowed = F.when(F.col("schema_version") >= 2, lit(_REQUIRED + ["editors"])).otherwise(lit(_REQUIRED))
    rows = rows.withColumn("_missing", F.array_except(lit(_REQUIRED), keys)).withColumn("_unknown", F.array_except(keys, allowed))
    rows = rows.withColumn("_p", F.from_json("record", PUBLICATION_SCHEMA))
    people = F.concat(F.coalesce("_p.authors", F.array()), F.coalesce("_p.editors", F.array()))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    not_text = [F.when(~_kind(f"$.{f}").isin("STRING", "ABSENT"), F.lit(f"{f} must be a string")) for f in _STRINGS]
    not_list = [F.when(~(_kind(f"$.{f}").startswith("ARRAY") | (_kind(f"$.{f}") == "ABSENT")), F.lit(f"{f} must be a list"))
                for f in ("authors", "editors", "keywords", "references")]
    checks = F.array_compact(F.array(
        F.when(F.col("_v").isNull(), F.lit("not a JSON object")),
        F.when(F.size("_missing") > 0, F.concat(F.lit("missing fields: "), F.array_join(F.sort_array("_missing"), ", "))),
        F.when(F.size("_unknown") > 0, F.concat(F.lit("unknown fields: "), F.array_join(F.sort_array("_unknown"), ", "))),
        *not_text, *not_list,
        F.when((_kind("$.created_date") == "STRING") & F.try_to_date("_p.created_date").isNull(), F.lit("invalid created_date")),
        F.when(F.size(people) == 0, F.lit("no contributor")),
        F.when(F.exists(people, lambda p: blank(p["given"]) & blank(p["family"]) & blank(p["literal"])), F.lit("contributor without name")),
        F.when(F.exists(people, lambda p: F.exists(F.map_keys(p["source_fields"]), lambda k: k.isin("given", "family", "literal"))),
               F.lit("source_fields shadow a name"))))
    rows = rows.withColumn("reasons", checks)
    good = rows.filter(F.size("reasons") == 0).select("ord", "_p.*")
    good = good.withColumn("created_date", F.try_to_date("created_date")).withColumn(
        "editors", F.coalesce("editors", F.array().cast(f"array<{_PERSON}>")))
    return good, rows.filter(F.size("reasons") > 0).select("ord", "reasons")


def read_publications(spark: SparkSession, path: str, layout: str = "lines") -> tuple[DataFrame, DataFrame]:
    return validate_publications(read_records(spark, path, layout))


def write_publications(pubs: DataFrame, path: str, last_update: str) -> bool:
    """Publications as JSON lines plus a one-row metadata table, as a new version; returns whether the content is new.

    Without a change the former version stays with its date.
    """
    shape = sorted(_REQUIRED + ["editors"])
    cols = [F.col(c).cast("string").alias(c) if c == "created_date" else F.col(c) for c in shape]
    record = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    meta = pubs.sparkSession.range(1).select(F.lit(2).alias("schema_version"), F.lit(last_update).alias("last_update"))
    return publish(pubs.sparkSession, path, {
        "publications": Part(pubs.select(record.alias("value")), lambda df, to: df.write.text(to)),
        "metadata": Part(meta.coalesce(1), lambda df, to: df.write.json(to), about=True)})


def read_tokens(spark: SparkSession, path: str, kinds: list[str] | None = None, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed tokens ``(ord, kind, value)``, first occurrence in the order of files and lines kept, and bad lines. Blank and # lines are skipped."""
    lines = spark.read.text(path).select(line_order().alias("ord"), strip("value").alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("t", parse_token("line", kinds, legacy))
    good = dedupe_first(lines.filter("t IS NOT NULL").select("ord", "t.kind", "t.value"), "kind", "value")
    return good, lines.filter("t IS NULL").select("ord", "line")


def write_tokens(tokens: DataFrame, path: str) -> None:
    """One token per line in order: a range-partitioned sort, files in name order."""
    tokens.orderBy("ord").select(token_text(F.struct("kind", "value")).alias("value")).write.mode("overwrite").text(path)


def read_author_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping documents (slug to name list) as the long table ``(slug, pos, name)``."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return docs.select(F.explode("m").alias("slug", "names")).select("slug", F.posexplode("names").alias("p", "name")).select(
        "slug", (F.col("p") + 1).alias("pos"), F.trim("name").alias("name"))


EVIDENCE_SCHEMA = """doi string, title string, abstract string, keywords array<string>, work_type string, authors array<string>, container_title string,
  screening_outcome string, accept_matches array<string>, reject_matches array<string>, source string, batch_id string, attempt int,
  human_decision string, correction_decision string"""


def read_evidence(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of versions 1 to 3 from ``(ord, record)`` JSON rows; later fields get defaults, repeated keys are returned."""
    rows = records.select("ord", F.from_json("record", EVIDENCE_SCHEMA).alias("r")).select("ord", "r.*")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({
        "authors": F.coalesce("authors", none), "container_title": F.coalesce("container_title", F.lit("")),
        "correction_decision": F.coalesce("correction_decision", F.lit("")), "human_decision": F.coalesce("human_decision", F.lit(""))})
    twice = rows.groupBy("doi").agg(F.count("*").alias("n")).filter("n > 1")
    return rows, twice


def read_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Atom entries ``(title, summary, url, authors, updated)`` and entries with a bad date."""
    schema = "title string, summary string, id string, author array<struct<name:string>>, updated string"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    text = lambda c: F.coalesce(collapse(c), F.lit(""))
    rows = raw.select(text("title").alias("title"), text("summary").alias("summary"), text("id").alias("url"),
                      F.coalesce(F.transform("author", lambda a: text(a["name"])), F.array().cast("array<string>")).alias("authors"),
                      F.try_to_date(F.split_part(strip("updated"), F.lit("T"), F.lit(1))).alias("updated"))
    return rows.filter("updated IS NOT NULL"), rows.filter("updated IS NULL")


def write_if_changed(df: DataFrame, path: str, allow_empty: bool = True) -> bool:
    """Write a new version of a Parquet table only when its content differs; returns whether it wrote.

    The content is digested while it is written, so ``df`` is computed once, and a write that fails
    leaves the former version readable; ``read_version`` reads the current one. With ``allow_empty`` off
    an empty table, such as a feed that failed, does not replace a stored one.
    """
    if not allow_empty and df.isEmpty():
        return False
    return publish(df.sparkSession, path, {"data": Part(df, lambda rows, to: rows.write.parquet(to))})


def read_version(spark: SparkSession, path: str, part: str = "data") -> DataFrame:
    """A Parquet part of the current version under ``path``."""
    return spark.read.parquet(f"{current_folder(spark, path)}/{part}")


def write_site_tables(pubs: DataFrame, by_author: DataFrame, by_year: DataFrame, path: str, generated: str) -> bool:
    """Index tables as one new version: publications by year, memberships sorted within their partitions, one metadata row.

    Returns whether the content is new; without a change the former version stays with its date.
    """
    newest = [F.desc(c) for c in ("created_date", "publication_year", "title", "permalink")]
    by = lambda *keys: lambda df, to: df.write.partitionBy(*keys).parquet(to)
    meta = pubs.agg(F.count("*").alias("publications")).withColumn("generated", F.lit(generated))
    return publish(pubs.sparkSession, path, {
        "publications": Part(pubs, by("publication_year")),
        "authors": Part(by_author.repartitionByRange("slug", F.desc("created_date")).sortWithinPartitions("slug", *newest), lambda df, to: df.write.parquet(to)),
        "years": Part(by_year.repartitionByRange("year", F.desc("created_date")).sortWithinPartitions("year", *newest), by("year")),
        "metadata": Part(meta.coalesce(1), lambda df, to: df.write.json(to), about=True)})
