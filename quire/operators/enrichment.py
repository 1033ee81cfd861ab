"""Enrichment of work records, canonical rows from works, and proposals for missing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.identity import norm_doi
from quire.functions.markup import clean_citations, clean_provider_abstract, clean_titles, is_institution_like
from quire.functions.staging import stage
from quire.functions.text import (
    _col, blank_to_null, clean_abstract, clean_metadata, is_missing, is_safe_component, strip,
)
from quire.operators.audit import AUDIT_FIELDS, audit_record, compare
from quire.sources.works import (
    date_year, first_text, isbn, page_locator, parse_contributors, people_names, strict_date, text,
)

_EVIDENCE = "array<struct<source:string,value:string,reason:string>>"


def base_enrichment(works: DataFrame, keep_refused: bool = False) -> DataFrame:
    """``(doi, abstract, keywords, abstract_source, evidence)`` of typed works; refused text becomes evidence."""
    rows = works.select(norm_doi("DOI").alias("doi"), F.coalesce("abstract", F.lit("")).alias("_raw"), "subject")
    rows = clean_provider_abstract(rows, "_raw", "_c")
    ok = F.col("_c.deterministic")
    words = F.filter(F.transform("subject", lambda s: clean_metadata(s)), lambda s: s != "")
    abstract = F.when(ok | F.lit(keep_refused), F.col("_c.normalized")).otherwise("")
    refused = F.array(F.struct(F.lit("crossref").alias("source"), F.col("_c.normalized").alias("value"), F.col("_c.reason").alias("reason")))
    return rows.select(
        "doi", abstract.alias("abstract"), F.coalesce(words, F.array().cast("array<string>")).alias("keywords"),
        F.when(abstract != "", "crossref").otherwise("").alias("abstract_source"),
        F.when(ok, F.array().cast(_EVIDENCE)).otherwise(refused).alias("evidence"))


def best_abstract(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longest safe abstract per key, the first provider on a tie, and the refused ones.

    ``candidates``: doi, source, rank, abstract. The choice is one ``max_by``, combined before
    the shuffle, so a key with very many candidates is no hot group.
    """
    rows = clean_provider_abstract(candidates.withColumn("_raw", F.coalesce("abstract", F.lit(""))), "_raw", "_c")
    rows = rows.select("doi", "source", "rank", "_c.*")
    best = rows.filter("deterministic AND normalized <> ''").groupBy("doi").agg(
        F.max_by(F.struct("normalized", "source"), F.struct(F.length("normalized").alias("n"), (-F.col("rank")).alias("r"))).alias("b"))
    refused = rows.filter("NOT deterministic").select("doi", "source", F.col("normalized").alias("value"), "reason")
    return best.select("doi", F.col("b.normalized").alias("abstract"), F.col("b.source").alias("source")), refused


def enrich_collect(base: DataFrame, extra: DataFrame, fallback: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Publisher values replace base values when present; the fallback serves empty abstracts only.

    ``extra``: doi, abstract as the publisher gives it, keywords, event. ``fallback`` and ``refused`` are the two
    tables of ``best_abstract``. Texts that were refused stay as evidence, in the order base, publisher,
    fallback sources; those of the fallback only where it was asked.
    """
    none = F.array().cast(_EVIDENCE)
    e = clean_provider_abstract(extra.withColumn("_raw", F.coalesce("abstract", F.lit(""))), "_raw", "_c")
    entry = F.struct(F.lit("publisher").alias("source"), F.col("_c.normalized").alias("value"), F.col("_c.reason").alias("reason"))
    e = e.select("doi", F.when(F.col("_c.deterministic"), F.col("_c.normalized")).alias("e_abstract"), F.when(~F.col("_c.deterministic"), F.array(entry)).alias("e_evidence"),
                 F.col("keywords").alias("e_keywords"), F.col("event").alias("e_event"))
    f = fallback.select("doi", F.col("abstract").alias("f_abstract"), F.col("source").alias("f_source"))
    both = base.join(e, "doi", "left").join(f, "doi", "left")
    if refused is not None:  # one entry for each fallback source of a key
        listed = refused.groupBy("doi").agg(F.sort_array(F.collect_list(F.struct("source", "value", "reason"))).cast(_EVIDENCE).alias("f_evidence"))
        both = both.join(listed, "doi", "left")
    else:
        both = both.withColumn("f_evidence", F.lit(None).cast(_EVIDENCE))
    own = F.coalesce(blank_to_null("e_abstract"), blank_to_null("abstract"))
    source = (F.when(blank_to_null("e_abstract").isNotNull(), "publisher").when(blank_to_null("abstract").isNotNull(), F.col("abstract_source"))
              .when(blank_to_null("f_abstract").isNotNull(), F.col("f_source")).otherwise(""))
    evidence = F.concat(F.coalesce("evidence", none), F.coalesce("e_evidence", none), F.when(own.isNull(), F.coalesce("f_evidence", none)).otherwise(none))
    return both.select(
        "doi", F.coalesce(own, F.col("f_abstract"), F.lit("")).alias("abstract"), source.alias("abstract_source"),
        F.when(F.size(F.coalesce("e_keywords", F.array().cast("array<string>"))) > 0, F.col("e_keywords")).otherwise(F.col("keywords")).alias("keywords"),
        F.coalesce("e_event", F.lit("")).alias("event"), evidence.alias("evidence"))


def enrich_discover(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Texts and keywords of both sources accumulate for screening."""
    e = extra.select("doi", F.col("abstract").alias("e_abstract"), F.col("keywords").alias("e_keywords"))
    both = base.join(e, "doi", "left")
    return both.select(
        "doi", F.concat_ws(" ", blank_to_null("abstract"), blank_to_null("e_abstract")).alias("abstract"),
        F.concat("keywords", F.coalesce("e_keywords", F.array().cast("array<string>"))).alias("keywords"))


# -- publications ----------------------------------------------------------------------

def pub_year() -> Column:
    """Year of the printed edition, else of the creation date."""
    return F.coalesce(date_year("`published-print`"), F.year(strict_date("created")).cast("string"))


def extract_references(works: DataFrame) -> DataFrame:
    """``(doi, pos, ref_doi, citation)``: the first safe citation text; neither DOI nor text drops the entry."""
    rows = works.select(norm_doi("DOI").alias("doi"), F.posexplode_outer("reference").alias("pos", "r")).filter("r IS NOT NULL")
    value = lambda k: blank_to_null(strip(F.col("r")[k]))
    composed = F.concat_ws(
        " ", F.concat(value("author"), F.lit(",")), F.concat(value("article-title"), F.lit(".")), value("journal-title"),
        value("volume-title"), F.concat(F.lit("("), value("year"), F.lit(")")))
    rows = rows.select("doi", "pos", norm_doi("r.DOI").alias("ref_doi"), F.coalesce(value("unstructured"), F.lit("")).alias("_u"), composed.alias("_k"))
    rows = clean_citations(clean_citations(rows, "_u", "_cu"), "_k", "_ck")
    safe = lambda c: blank_to_null(clean_metadata(F.when(F.col(f"{c}.deterministic"), F.col(f"{c}.normalized")).otherwise("")))
    rows = rows.select("doi", "pos", "ref_doi", F.coalesce(safe("_cu"), safe("_ck"), F.lit("")).alias("citation"))
    return rows.filter("citation <> '' OR ref_doi IS NOT NULL")


def name_based_id(name: Column) -> Column:
    """An id in UUID form that depends on ``name`` alone, so a repeated task or read gives the same one."""
    h = F.sha1(F.concat(F.lit("doi:"), name))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def build_publications(works: DataFrame, enrichment: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical rows and rejected keys with their reason.

    ``enrichment``: doi, abstract, keywords, event. ``slugs``: doi, slug.
    """
    rows = works.withColumn("doi", norm_doi("DOI")).withColumn("_t", first_text("title"))
    rows = clean_titles(rows, "_t", "_title").join(
        enrichment.select("doi", F.col("abstract").alias("_abs"), F.col("keywords").alias("_kw"), F.col("event").alias("_ev")), "doi", "left")
    rows = rows.join(slugs.select("doi", "slug"), "doi", "left")
    names = people_names("author")
    rows = stage(rows, _names=names, _authors=parse_contributors("author"), _editors=parse_contributors("editor"), _created=strict_date("created"))
    mixed = F.exists("_names", is_institution_like) & F.exists("_names", lambda n: ~is_institution_like(n))
    title = clean_metadata(F.col("_title.normalized"))
    reason = (
        F.when(F.col("doi").isNull(), "invalid doi").when(F.col("_created").isNull(), "missing creation date")
        .when(title == "", "missing title").when(~F.col("_title.deterministic"), "unsafe title")
        .when(~is_safe_component("slug"), "unsafe slug").when(mixed, "mixed contributors")
        .when(F.size("_authors") + F.size("_editors") == 0, "no contributors"))
    rows = stage(rows, _reason=reason)
    pages = page_locator()
    good = rows.filter("_reason IS NULL").select(
        name_based_id(F.col("doi")).alias("id"), "doi", isbn().alias("isbn"), text("type").alias("type"), title.alias("title"),
        F.col("_authors").alias("authors"), F.col("_editors").alias("editors"), clean_abstract(F.coalesce("_abs", F.lit(""))).alias("abstract"),
        first_text("`container-title`").alias("container_title"), pub_year().alias("publication_year"), text("volume").alias("volume"),
        text("issue").alias("issue"), F.when(text("page") != "", F.replace(pages, F.lit("-"), F.lit("--"))).otherwise(pages).alias("pages"),
        text("publisher").alias("publisher"), F.coalesce(clean_metadata("_ev"), F.lit("")).alias("event"),
        F.coalesce("_kw", F.array().cast("array<string>")).alias("keywords"), F.col("_created").alias("created_date"), F.col("slug").alias("permalink"))
    return good, rows.filter("_reason IS NOT NULL").select("doi", F.col("_reason").alias("reason"))


def collect(keys: DataFrame, works: DataFrame, enrichment: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requested keys split into ``(items, unavailable, invalid)``."""
    wanted = keys.select(norm_doi("doi").alias("doi")).filter("doi IS NOT NULL").distinct()
    known = works.withColumn("_k", norm_doi("DOI"))
    found = known.join(wanted.withColumnRenamed("doi", "_k"), "_k", "left_semi").drop("_k")
    items, invalid = build_publications(found, enrichment, slugs)
    return items, wanted.join(known.select(F.col("_k").alias("doi")), "doi", "left_anti"), invalid


# -- proposals for missing fields --------------------------------------------------------

def _missing_long(pubs: DataFrame, fields: list[str]) -> DataFrame:
    items = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("current"), is_missing(f, F.col(f)).alias("m")) for f in fields]
    return pubs.select("id", "doi", F.explode(F.array(*items)).alias("r")).select("id", "doi", "r.*")


def manual_backfill(pubs: DataFrame, fields: list[str], types: list[str]) -> DataFrame:
    """Missing fields of accepted types, as proposals a person fills in."""
    return _missing_long(pubs.filter(F.col("type").isin(types)), fields).filter("m").select(
        "id", "doi", "field", F.lit("").alias("proposed_value"), F.lit(True).alias("review_required"), F.lit(True).alias("manual"))


def eligible(pubs: DataFrame, types: list[str], fields: list[str]) -> DataFrame:
    """Rows of the given types with a DOI and at least one missing field."""
    any_missing = F.exists(F.array(*[is_missing(f, F.col(f)) for f in fields]), lambda m: m)
    return pubs.filter(F.col("type").isin(types) & F.col("doi").isNotNull() & any_missing)


def backfill(pubs: DataFrame, provider: DataFrame, fields: list[str], types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(proposals, without value, unavailable)`` from long provider values (doi, field, value, refused).

    Only missing fields travel into the join on (doi, field).
    """
    open_rows = _missing_long(eligible(pubs, types, fields), fields).filter("m").select("id", "doi", "field")
    p = provider.select("doi", "field", "value", F.coalesce("refused", F.lit(False)).alias("refused"))
    joined = open_rows.join(p, ["doi", "field"], "left")
    has = F.coalesce(strip("value"), F.lit("")) != ""
    known = provider.select("doi").distinct()
    return (
        joined.filter(has).select("id", "doi", "field", F.when(F.col("refused"), "").otherwise(F.col("value")).alias("proposed_value"),
                                  F.col("refused").alias("review_required"), F.lit(False).alias("manual")),
        joined.filter(~has).join(known, "doi", "left_semi").select("id", "doi", "field"),
        open_rows.join(known, "doi", "left_anti").select("id", "doi").distinct(),
    )


def refresh(pubs: DataFrame, stored: DataFrame, current: DataFrame, fresh: DataFrame, refused: DataFrame, fields: list[str],
            types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Refresh scan: ``(stale publications, proposals, collateral differences, unavailable)``.

    A publication is stale when its stored citation text is absent or differs from the
    current one. ``fresh``: the publications made anew, by ``doi``; ``refused``: doi, source, value, reason of
    texts that were not taken. All audit fields of both are classified, lists and dates too: a missing
    one of ``fields`` with a value becomes a proposal, a missing abstract with nothing but refused
    texts a proposal that needs a person; everything else that is not equal in its comparison form is
    reported with its class.
    """
    texts = stored.select("doi", F.col("text").alias("stored_text")).join(current.select("doi", F.col("text").alias("now_text")), "doi", "full")
    stale = eligible(pubs, types, fields).select("id", "doi").join(texts, "doi").filter(
        "trim(now_text) <> '' AND (stored_text IS NULL OR stored_text <> now_text)").select(
        "id", "doi", F.when(F.col("stored_text").isNull(), "missing text").otherwise("changed text").alias("reason"))
    shared = ["doi", *[f for f in AUDIT_FIELDS if f in pubs.columns and f in fresh.columns]]
    old = pubs.select("id", *shared).join(stale.select("id"), "id", "left_semi")
    new = fresh.select(*shared).join(stale.select("id", "doi"), "doi")
    made = audit_record(new).withColumns({"provider": F.lit("refresh"), "p_ord": F.lit(0), "status": F.lit("available"), "detail": F.lit("")})
    both = compare(audit_record(old), made)[0].withColumnRenamed("publication_id", "id").join(old.select("id", "doi"), "id")
    evidence = refused.groupBy("doi").agg(F.sort_array(F.collect_list(F.struct("source", "value", "reason"))).cast(_EVIDENCE).alias("_kept"))
    both = both.join(evidence, "doi", "left")
    first = lambda c: F.get(F.col(c), F.lit(0))
    blank = lambda c: F.when(F.col("field") == "abstract", is_missing("abstract", first(c))).otherwise(is_missing("", first(c)))
    none = F.array().cast(_EVIDENCE)
    both = stage(both, _open=F.col("field").isin(fields) & ~F.col("is_list") & blank("canonical_value"), _value=~F.col("is_list") & ~blank("provider_value"),
                 _evidence=F.when(F.col("field") == "abstract", F.coalesce("_kept", none)).otherwise(none))
    person = F.col("_open") & ~F.col("_value") & (F.size("_evidence") > 0)
    proposed = both.filter((F.col("_open") & F.col("_value")) | person)
    other = both.filter(~(F.col("_open") & F.col("_value")) & ~person & ~F.col("classification").isin("equal", "formatting-only"))
    return (
        stale,
        proposed.select("id", "doi", "field", F.when(F.col("_value"), first("provider_value")).otherwise("").alias("proposed_value"),
                        (~F.col("_value")).alias("review_required"), F.col("_evidence").alias("evidence")),
        other.select("id", "doi", "field", "classification", F.col("canonical_value").alias("current"), F.col("provider_value").alias("value")),
        stale.join(fresh.select("doi"), "doi", "left_anti").select("id", "doi"),
    )


# -- small mappings ------------------------------------------------------------------------

def publisher_of(url) -> Column:
    """Publisher class of a landing page host; null when none applies."""
    host = F.lower(F.try_parse_url(_col(url), F.lit("HOST")))
    return (F.when(host.contains("elsevier") | host.contains("sciencedirect"), "elsevier")
            .when(host.contains("springer"), "springer").when(host.contains("ieee"), "ieee"))


def categorise(event, kind, rules: list[tuple[str, str]], by_type: dict[str, str]) -> Column:
    """First event rule that matches, else the category of the type; null is an error."""
    out = None
    for pattern, category in rules:
        hit = F.coalesce(_col(event), F.lit("")).rlike("(?iu)" + pattern)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    lookup = F.create_map(*[F.lit(x) for pair in by_type.items() for x in pair]) if by_type else None
    other = F.try_element_at(lookup, _col(kind)) if lookup is not None else F.lit(None).cast("string")
    return other if out is None else out.otherwise(other)


# Work types and their names in the citation format.
CSL_TYPES = {
    "journal-article": "article-journal", "proceedings-article": "paper-conference", "book-chapter": "chapter",
    "book-section": "chapter", "book-part": "chapter", "book": "book", "monograph": "book", "edited-book": "book",
    "reference-book": "book", "proceedings": "book", "report": "report", "report-series": "report", "dissertation": "thesis",
    "posted-content": "article", "peer-review": "article", "component": "article",
}


def to_csl(works: DataFrame) -> DataFrame:
    """``(doi, csl)``: citation-format JSON; empty values are left out."""
    types = F.create_map(*[F.lit(x) for pair in CSL_TYPES.items() for x in pair])
    get = lambda p, k: blank_to_null(strip(F.try_element_at(p, F.lit(k))))

    def people(c: str) -> Column:
        made = F.transform(F.col(c), lambda p: F.struct(
            get(p, "given").alias("given"), F.coalesce(get(p, "family"), get(p, "name")).alias("family"), get(p, "suffix").alias("suffix")))
        kept = F.filter(made, lambda n: F.coalesce(n["given"], n["family"], n["suffix"]).isNotNull())
        return F.when(F.size(kept) > 0, kept)

    dates = [F.slice(F.get(F.col(f"`{c}`")["date-parts"], F.lit(0)), 1, 3) for c in ("issued", "published-print", "published-online", "published", "created")]
    issued = F.coalesce(*[F.when(F.get(d, F.lit(0)).isNotNull(), F.struct(F.array(d).alias("date-parts"))) for d in dates])
    value = lambda c: blank_to_null(text(c))
    doi = norm_doi("DOI")
    fields = [
        doi.alias("id"), F.coalesce(F.try_element_at(types, text("type")), F.lit("article")).alias("type"), doi.alias("DOI"),
        blank_to_null(first_text("title")).alias("title"), blank_to_null(first_text("`container-title`")).alias("container-title"),
        blank_to_null(first_text("`short-container-title`")).alias("container-title-short"), value("volume").alias("volume"),
        value("issue").alias("issue"), blank_to_null(page_locator()).alias("page"), value("publisher").alias("publisher"),
        value("`publisher-location`").alias("publisher-place"), value("edition").alias("edition"), value("URL").alias("URL"),
        people("author").alias("author"), people("editor").alias("editor"), issued.alias("issued"),
    ]
    return works.select(doi.alias("doi"), F.to_json(F.struct(*fields)).alias("csl"))


def tidy_citation(c) -> Column:
    """Last line of a citation response without its number and final dot; JSON payloads give ''."""
    body = strip(c)
    is_json = body.rlike(r"^[\[{]") & F.try_parse_json(body).isNotNull()
    last = strip(F.element_at(F.split(body, r"\r\n|[\n\r]"), -1))
    out = F.regexp_replace(last, r"^1\.\s*", "")
    return F.when(is_json | (body == ""), "").when(out.endswith("."), F.rtrim(F.substr(out, F.lit(1), F.length(out) - 1))).otherwise(out)
