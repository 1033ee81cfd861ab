"""Hygiene jobs: signal reports, migration proposals, contributor findings and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.markup import (
    assess_markup, clean_citations, clean_structured_abstract, clean_titles, is_institution_like, markup_families,
    signal_context, text_signals,
)
from quire.functions.text import display_name, strip


def abstract_findings(df: DataFrame, column: str = "abstract") -> DataFrame:
    """Rows with markup signals: families, assessment and context."""
    rows = df.withColumn("families", markup_families(column)).filter(F.size("families") > 0)
    rows = rows.withColumn("_a", assess_markup("families", column))
    return rows.withColumns({
        "deterministic": F.col("_a.deterministic"), "hint": F.col("_a.hint"), "context": signal_context(column)}).drop("_a")


def text_findings(df: DataFrame, column: str, target: str) -> DataFrame:
    """As ``abstract_findings`` for titles and citations, judged by the real cleaner."""
    rows = df.withColumn("families", text_signals(column)).filter(F.size("families") > 0)
    cleaner = clean_titles if target == "title" else clean_citations
    rows = cleaner(rows, column, "_r")
    only_tex = F.col("families") == F.array(F.lit("tex-fragment"))
    return rows.withColumns({
        "deterministic": F.col("_r.deterministic") & F.col("_r.changed"),
        "hint": F.when(~F.col("_r.deterministic") | F.col("_r.changed"), F.col("_r.reason"))
        .when(only_tex, "preserve-tex").otherwise("already-clean"),
        "context": signal_context(column), "normalized": F.col("_r.normalized")}).drop("_r")


def hygiene_report(df: DataFrame, column: str, families: Column, deterministic: Column) -> DataFrame:
    """One row of totals: scanned, present, suspicious, deterministic, review required."""
    rows = df.select(
        (strip(column) != "").alias("present"), families.alias("f"), deterministic.alias("d"))
    bad = F.size("f") > 0
    return rows.agg(
        F.count("*").alias("scanned"), F.count_if("present").alias("present"),
        F.count_if(F.col("present") & bad).alias("suspicious"),
        F.count_if(F.col("present") & bad & F.col("d")).alias("deterministic"),
        F.count_if(F.col("present") & bad & ~F.col("d")).alias("review_required"))


def family_counts(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("families").alias("family")).groupBy("family").agg(F.count("*").alias("n"))


def migration_proposals(df: DataFrame, column: str, field: str) -> DataFrame:
    """Cleaned value or review request for every finding.

    Titles and citations whose clean-up changes nothing are dropped; such abstracts ask for review.
    """
    signals = markup_families(column) if field == "abstract" else text_signals(column)
    rows = df.withColumn("families", signals).filter(F.size("families") > 0)
    cleaner = {"abstract": clean_structured_abstract, "title": clean_titles, "citation": clean_citations}[field]
    rows = cleaner(rows, column, "_r")
    ok = F.col("_r.deterministic") & F.col("_r.changed")
    if field != "abstract":
        rows = rows.filter(~(F.col("_r.deterministic") & ~F.col("_r.changed")))
    return rows.withColumns({
        "proposed_value": F.when(ok, F.col("_r.normalized")).otherwise(""),
        "review_required": ~ok,
        "reason": F.when(F.col("_r.deterministic") & ~F.col("_r.changed"), "no-deterministic-change")
        .otherwise(F.col("_r.reason"))}).drop("_r")


def mixed_contributors(pubs: DataFrame) -> DataFrame:
    """Institution-like entries of lists that also hold ordinary people.

    ``pubs``: id, authors, editors (arrays of names). The lists stay inside their rows, so
    there is nothing to shuffle.
    """
    found = []
    for role, col in (("author", "authors"), ("editor", "editors")):
        entries = F.transform(F.col(col), lambda n, i: F.struct(i.alias("index"), n.alias("name"), is_institution_like(n).alias("bad")))
        named = F.filter(entries, lambda e: strip(e["name"]) != "")
        mixed = F.exists(named, lambda e: ~e["bad"])
        found.append(F.when(mixed, F.transform(F.filter(named, lambda e: e["bad"]), lambda e: F.struct(
            F.lit(role).alias("role"), e["index"].alias("index"), e["name"].alias("name")))).otherwise(
            F.array().cast("array<struct<role:string,index:int,name:string>>")))
    return pubs.select("id", F.explode_outer(F.concat(*found)).alias("f")).filter("f IS NOT NULL").select("id", "f.*")


def apply_contributor_removals(pubs: DataFrame, decisions: DataFrame, column: str = "authors") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop flagged entries by index: ``(changed rows, removed names, violations)``.

    ``decisions``: id, index, decision. A list may not become empty.
    """
    drop = decisions.filter("decision = 'remove'").groupBy("id").agg(F.sort_array(F.collect_set("index")).alias("idx"))
    rows = pubs.join(drop, "id")
    kept = F.filter(F.col(column), lambda x, i: ~F.array_contains(F.col("idx"), i))
    gone = F.filter(F.col(column), lambda x, i: F.array_contains(F.col("idx"), i))
    rows = rows.withColumn("_kept", kept).withColumn("_gone", gone)
    ok = rows.filter(F.size("_kept") > 0)
    removed = ok.select("id", F.explode_outer("_gone").alias("name")).filter("name IS NOT NULL")
    changed = ok.withColumn(column, F.col("_kept")).drop("_kept", "_gone", "idx")
    return changed, removed, rows.filter(F.size("_kept") == 0).select("id", F.lit("no contributor left").alias("problem"))


def rename_contributor(pubs: DataFrame, changes: DataFrame, column: str = "authors") -> tuple[DataFrame, DataFrame]:
    """Rename exactly one contributor of a publication: ``(changed rows, violations)``.

    ``changes``: id, old_name, new_name.
    """
    rows = pubs.join(changes, "id")
    hits = F.size(F.filter(F.col(column), lambda n: n == F.col("old_name")))
    rows = rows.withColumn("_hits", hits)
    renamed = rows.filter("_hits = 1").withColumn(
        column, F.transform(F.col(column), lambda n: F.when(n == F.col("old_name"), F.col("new_name")).otherwise(n)))
    bad = rows.filter("_hits <> 1").select("id", "old_name", F.when(F.col("_hits") == 0, "name not found").otherwise(
        "name is ambiguous").alias("problem"))
    return renamed.drop("_hits", "old_name", "new_name"), bad


def named(persons) -> Column:
    """Display names of an array of contributor structs."""
    return F.transform(persons, display_name)


def apply_hygiene(pubs: DataFrame, proposals: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hygiene proposals written into reference lists: ``(staged rows, changes, violations)``.

    ``pubs``: id, refs. ``proposals``: id, pos, current_value, proposed_value, review_required.
    Without decisions only deterministic proposals apply. A decision (id, pos, decision,
    resolved_value) that equals the current value is a violation here, not a no-op.
    """
    now = F.get(F.col("refs"), F.col("pos").cast("int"))["citation"]
    rows = proposals.join(pubs.select("id", "refs"), "id", "left").withColumn("_now", now).drop("refs")
    if decisions is None:
        rows = rows.filter(~F.col("review_required")).withColumn("decision", F.lit("deterministic")).withColumn("value", F.col("proposed_value"))
    else:
        rows = rows.join(decisions.select("id", "pos", "decision", "resolved_value"), ["id", "pos"], "left").withColumn(
            "value", F.when(F.col("decision") == "accepted", F.col("proposed_value")).otherwise(F.col("resolved_value")))
    d = F.col("decision")
    problem = (
        F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("current_value"), "stale")
        .when(d.isNull() | (d == "deferred"), "undecided").when((d == "accepted") & F.col("review_required"), "review required")
        .when(d == "rejected", F.lit(None)).when(F.coalesce(strip("value"), F.lit("")) == "", "no value")
        .when(F.col("value") == F.col("_now"), "no change"))
    rows = rows.withColumn("problem", problem)
    changes = rows.filter((F.col("problem").isNull()) & (d != "rejected")).select("id", "pos", "decision", "value")
    per_pub = changes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), "value"))).alias("_m"))
    staged = pubs.join(per_pub, "id").withColumn("refs", F.transform("refs", lambda r, i: r.withField(
        "citation", F.coalesce(F.try_element_at("_m", i), r["citation"])))).drop("_m")
    return staged, changes, rows.filter("problem IS NOT NULL").select("id", "pos", "problem")


def evidence_fingerprint(doi, payload) -> Column:
    """Digest of the provider payload a contributor repair was reviewed against."""
    return F.sha2(F.concat_ws("\n", doi, payload), 256)


def apply_repairs(works: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed contributors for works whose payload is unchanged, and the other repairs as ``(doi, status)``.

    A repair is ``stale`` when the payload changed and ``gone`` when its work is not there any more.
    ``works``: doi, payload (canonical JSON). ``repairs``: doi, fingerprint, authors, editors.
    """
    now = works.select("doi", evidence_fingerprint(F.col("doi"), F.col("payload")).alias("now"))
    both = repairs.join(now, "doi", "left").withColumn("status", F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("fingerprint"), "stale"))
    return (both.filter("status IS NULL").select("doi", "authors", "editors"),
            both.filter("status IS NOT NULL").select("doi", "status"))
