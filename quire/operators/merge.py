"""Merging incoming publications into the canonical table.

Rows carry ``id``, ``doi`` (nullable), ``ord`` and any content columns. Identity is the id
or the DOI, nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.identity import registry_token
from quire.functions.text import slugify
from quire.operators.components import connected_components


def _content(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("id", "ord")]


def match_targets(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with the canonical ids they match by id and by DOI.

    Rows without a DOI skip that join, so they are no hot key of it.
    """
    by_id = existing.select("id", F.col("id").alias("id_match"))
    by_doi = existing.filter("doi IS NOT NULL").select("doi", F.col("id").alias("doi_match"))
    rows = incoming.join(by_id, "id", "left")
    keyed = rows.filter("doi IS NOT NULL").join(by_doi, "doi", "left")
    return keyed.unionByName(rows.filter("doi IS NULL").withColumn("doi_match", F.lit(None).cast("string")))


def merge_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that would tie two canonical rows together."""
    return match_targets(existing, incoming).filter("id_match <> doi_match").select(
        "id", "doi", "ord", "id_match", "doi_match")


def _token(kind: str, value: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(value))


def identities(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, targets)``: incoming rows with their ``group``, and the canonical ids of each group.

    Ids and DOIs that one row states together denote one record, whether the row is incoming or
    canonical; a group is what such statements connect. ``targets(group, target, owners)`` has the
    smallest canonical id of the group and their number.
    """
    stated = incoming.filter("doi IS NOT NULL AND id IS NOT NULL").select("id", "doi")
    known = existing.filter("doi IS NOT NULL").select("id", "doi")
    touched = known.join(incoming.select("id").distinct(), "id", "left_semi").unionByName(
        known.join(incoming.select("doi").distinct(), "doi", "left_semi").select("id", "doi"))
    edges = stated.unionByName(touched).select(_token("i", "id").alias("a"), _token("d", "doi").alias("b"))
    parts = connected_components(edges).withColumnRenamed("component", "part")
    own = incoming.withColumn("node", F.coalesce(_token("i", "id"), _token("d", "doi")))
    rows = own.join(parts, "node", "left").withColumn("group", F.coalesce("part", "node")).drop("node", "part")
    old = existing.select("id", _token("i", "id").alias("node")).join(parts, "node", "left").select("id", F.coalesce("part", "node").alias("group"))
    wanted = old.join(rows.select("group").distinct(), "group", "left_semi")
    return rows, wanted.groupBy("group").agg(F.min("id").alias("target"), F.count("*").alias("owners"))


def quarantined(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows of groups that hold several canonical records; ``merge`` leaves them out."""
    rows, targets = identities(existing, incoming)
    return rows.join(targets.filter("owners > 1").select("group"), "group", "left_semi").drop("group")


def merge(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged table and its log ``(id, action)``; rows of conflicting groups are left out (see ``quarantined``).

    A matched row keeps the canonical id and position and takes the incoming content; new
    rows follow (``side`` = 1). When several incoming rows belong to one record, also by way of
    others, the last one gives the content, the first one the id, and a DOI that the last one lacks
    comes from the last that has one. All come from one aggregation with a map-side combine, so many
    copies of one record are no hot group.
    """
    content = _content(existing)
    rows, targets = identities(existing, incoming)
    matched = rows.join(targets, "group", "left").filter("owners IS NULL OR owners = 1")
    final = matched.groupBy("group").agg(
        F.first("target").alias("target"),
        F.min_by("id", "ord").alias("new_id"),
        F.min("ord").alias("new_ord"),
        F.max_by("doi", F.when(F.col("doi").isNotNull(), F.col("ord"))).alias("doi_of"),
        F.max_by(F.struct(*content), "ord").alias("v"),
    )
    values = F.struct(*[F.coalesce("v.doi", "doi_of").alias("doi") if c == "doi" else F.col(f"v.{c}").alias(c) for c in content])
    final = final.withColumn("v", F.when(F.col("target").isNull(), values).otherwise(F.col("v")))
    updates = final.filter("target IS NOT NULL").select(F.col("target").alias("id"), "v")
    old = existing.join(updates, "id", "left")
    same = reduce(Column.__and__, [F.col(f"v.{c}").eqNullSafe(F.col(c)) for c in content])
    old = old.withColumn(
        "action", F.when(F.col("v").isNull(), F.lit(None)).when(same, "unchanged").otherwise("updated"))
    kept = old.select(
        "id", *[F.when(F.col("v").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) for c in content],
        "ord", F.lit(0).alias("side"), "action")
    added = final.filter("target IS NULL").select(
        F.col("new_id").alias("id"), *[F.col(f"v.{c}").alias(c) for c in content],
        F.col("new_ord").alias("ord"), F.lit(1).alias("side"), F.lit("added").alias("action"))
    both = kept.unionByName(added)
    return both.drop("action"), both.filter("action IS NOT NULL").select("id", "action")


def registry(pubs: DataFrame) -> DataFrame:
    """Registry tokens of all publications in order."""
    return pubs.select(registry_token(F.col("doi"), F.col("id")).alias("token"), "side", "ord")


def project_merge(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge the staged rows and follow up in every state table.

    ``state``: canonical, staged (publications); rejected, pending, review (doi, ord).
    Staged rows whose key is rejected are dropped; processed keys leave the queues.
    """
    accepted = state["staged"].join(state["rejected"].select("doi"), "doi", "left_anti")
    canonical, log = merge(state["canonical"], accepted)
    processed = accepted.select("doi").filter("doi IS NOT NULL").unionByName(state["rejected"].select("doi"))
    return {
        "canonical": canonical,
        "log": log,
        "registry": registry(canonical),
        "pending": state["pending"].join(processed, "doi", "left_anti"),
        "review": state["review"].join(processed, "doi", "left_anti"),
        "rejected": state["rejected"],
    }


def prune_variants(mapping: DataFrame, removed: DataFrame, active: DataFrame) -> DataFrame:
    """Drop name variants that were removed and that no publication uses any more."""
    gone = removed.select("name").distinct().join(active.select("name"), "name", "left_anti")
    return mapping.join(gone, "name", "left_anti")


def possible_duplicates(new: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Warnings and violations of new rows against the canonical table.

    Rows: id, permalink, title, publication_year, identifiers map. A warning names the smallest
    canonical id that shares the key, and how many do (``alike``), so a common title or identifier
    gives one row for each new record; ``duplicate_members`` lists all that share a key.
    """
    known = duplicate_members(canonical).groupBy("reason", "key").agg(F.min("id").alias("canonical_id"), F.count("*").alias("alike"))
    warnings = duplicate_members(new).withColumnRenamed("id", "new_id").join(known, ["reason", "key"]).select("new_id", "canonical_id", "reason", "alike").distinct()
    same_id = new.join(canonical.select("id"), "id").select(
        F.col("id").alias("new_id"), F.col("id").alias("canonical_id"), F.lit("id exists").alias("reason"))
    same_link = new.select(F.col("id").alias("new_id"), "permalink").join(
        canonical.select(F.col("id").alias("canonical_id"), "permalink"), "permalink").select(
        "new_id", "canonical_id", F.lit("permalink exists").alias("reason"))
    return warnings, same_id.unionByName(same_link)


def duplicate_members(df: DataFrame) -> DataFrame:
    """``(id, reason, key)``: the keys by which a record may repeat another one."""
    shared = df.select("id", F.explode("identifiers").alias("name", "value")).filter("value IS NOT NULL").select(
        "id", F.concat_ws(":", F.lit("identifier"), "name", "value").alias("reason"), F.lit("").alias("key"))
    titled = df.select("id", slugify("title").alias("slug"), "publication_year").filter("slug <> '' AND publication_year IS NOT NULL").select(
        "id", F.lit("title and year").alias("reason"), F.concat_ws("|", "slug", "publication_year").alias("key"))
    return shared.unionByName(titled)
