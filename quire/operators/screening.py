"""Rule screening of candidate records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.identity import norm_doi
from quire.functions.text import _col, norm_dash
from quire.operators.sets import dedupe_first, exclude_substrings

# Record types screened by default.
ACCEPTED_TYPES = ["journal-article", "proceedings-article", "book-chapter", "book", "monograph"]


def relevance_text(title, abstract, keywords) -> Column:
    """Title, abstract and keywords joined by blanks, empty parts skipped."""
    words = F.array_join(F.coalesce(_col(keywords), F.array().cast("array<string>")), " ")
    parts = F.filter(F.array(_col(title), _col(abstract), words), lambda x: x != "")
    return F.array_join(parts, " ")


def match_rules(text, rules: list[str]) -> Column:
    """The configured patterns that match, in rule order.

    Patterns use Java syntax and ignore case. Each one is a literal, so it is compiled once.
    """
    surface = norm_dash(text)
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(surface.rlike("(?iu)" + r), F.lit(r)) for r in rules]))


def type_gate(df: DataFrame, accepted: list[str] = ACCEPTED_TYPES, col: str = "work_type") -> DataFrame:
    """Add ``type_ok``: false for an unsupported or absent record."""
    return df.withColumn("type_ok", F.coalesce(F.col(col).isin(accepted), F.lit(False)))


def triage(accept, reject, unmatched: str = "manual-review") -> Column:
    """Outcome of one record from its matched accept and reject rules."""
    if unmatched not in ("manual-review", "reject"):
        raise ValueError("unmatched must be 'manual-review' or 'reject'")
    has_a, has_r = F.size(_col(accept)) > 0, F.size(_col(reject)) > 0
    return (
        F.when(has_a & has_r, "review")
        .when(has_a, "queued")
        .when(has_r, "rejected")
        .otherwise("rejected" if unmatched == "reject" else "review")
    )


def screen(
    candidates: DataFrame,
    works: DataFrame,
    known: DataFrame,
    rejected: DataFrame,
    accept_rules: list[str],
    reject_rules: list[str],
    unmatched: str = "manual-review",
    accepted_types: list[str] = ACCEPTED_TYPES,
    excluded: list[str] = (),
) -> DataFrame:
    """Screen candidate keys; one row per distinct key with its outcome and evidence.

    ``works`` holds one row per doi: title, abstract, keywords, work_type, authors,
    container_title. Known keys leave before the works join, so the heavy text columns
    are only read for keys that are really screened.
    """
    keys = candidates.withColumn("doi", norm_doi("doi")).filter(F.col("doi").isNotNull())
    keys = dedupe_first(keys.select("doi", "ord"), "doi")
    seen = known.select("doi").unionByName(rejected.select("doi")).distinct()
    flagged = keys.join(seen.withColumn("_seen", F.lit(True)), "doi", "left")
    blocked = F.coalesce(F.col("_seen"), F.lit(False))
    open_keys = exclude_substrings(flagged.filter(~blocked), list(excluded)).drop("_seen")
    skipped = flagged.join(open_keys.select("doi"), "doi", "left_anti").select(
        "doi", "ord", F.lit("skipped").alias("outcome")
    )

    joined = type_gate(open_keys.join(works, "doi", "left"), accepted_types)
    text = relevance_text("title", "abstract", "keywords")
    gate = F.col("type_ok")
    none = F.array().cast("array<string>")
    screened = joined.withColumn("_text", F.when(gate, text)).select(
        "doi", "ord", "title", "abstract", "keywords", "work_type", "authors", "container_title", "type_ok",
        F.when(gate, match_rules("_text", accept_rules)).otherwise(none).alias("accept_matches"),
        F.when(gate, match_rules("_text", reject_rules)).otherwise(none).alias("reject_matches"),
    )
    outcome = F.when(~gate, "rejected").otherwise(triage("accept_matches", "reject_matches", unmatched))
    screened = screened.withColumn("outcome", outcome).withColumn("has_evidence", gate).drop("type_ok")
    return screened.unionByName(skipped, allowMissingColumns=True)


def screening_counts(screened: DataFrame) -> DataFrame:
    """Counts of every outcome."""
    return screened.groupBy("outcome").agg(F.count("*").alias("n"))


def rescreen(evidence: DataFrame, works: DataFrame, accept_rules: list[str], reject_rules: list[str],
             unmatched: str = "manual-review") -> DataFrame:
    """Rows whose outcome changes under new rules; a human decision stays untouched."""
    fresh = works.select(
        "doi",
        match_rules(relevance_text("title", "abstract", "keywords"), accept_rules).alias("accept_matches"),
        match_rules(relevance_text("title", "abstract", "keywords"), reject_rules).alias("reject_matches"),
    )
    proposed = triage("accept_matches", "reject_matches", unmatched)
    both = evidence.select("doi", F.col("screening_outcome").alias("previous"), "human_decision").join(fresh, "doi")
    return (
        both.filter(F.coalesce(F.col("human_decision"), F.lit("")) == "")
        .withColumn("proposed", proposed)
        .filter("previous <> proposed")
        .select("doi", "previous", "proposed", "accept_matches", "reject_matches")
    )
