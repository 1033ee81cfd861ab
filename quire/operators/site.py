"""Publication, author and year indexes.

``pubs``: id, permalink, doi, created_date, publication_year, title, authors (array of names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.text import author_sort_key, is_safe_component, strip


def site_errors(pubs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Publications that cannot be indexed, with the reason."""
    year = F.coalesce(strip("publication_year"), F.lit(""))
    own = pubs.select("id", F.explode(F.array_compact(F.array(
        F.when(~is_safe_component("permalink"), F.lit("unsafe permalink")),
        F.when(F.col("created_date").isNull(), F.lit("missing created_date")),
        F.when(~year.rlike(r"^\p{Nd}+$"), F.lit("invalid year"))))).alias("problem"))
    unmapped = pubs.select("id", F.explode("authors").alias("name")).join(mapping.select("name"), "name", "left_anti").select(
        "id", F.lit("unmapped author").alias("problem")).distinct()
    out = own.unionByName(unmapped)
    for key in ("permalink", "doi"):
        twice = pubs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
        out = out.unionByName(pubs.join(twice, key, "left_semi").select("id", F.lit(f"duplicate {key}").alias("problem")))
    return out


_NEWEST = ["created_date", "publication_year", "names", "title", "permalink"]


def _keyed(pubs: DataFrame) -> DataFrame:
    editors = F.col("editors") if "editors" in pubs.columns else F.array().cast("array<string>")
    return pubs.withColumn("names", F.when(F.size("authors") > 0, F.col("authors")).otherwise(editors))


def order_publications(pubs: DataFrame) -> DataFrame:
    """Newest first: a range-partitioned sort."""
    return _keyed(pubs).orderBy(*[F.desc(c) for c in _NEWEST])


def memberships(pubs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long author index ``(slug, id, sort columns)`` and long year index ``(year, id, sort columns)``.

    A year or an author may hold a large share of all rows, so pages stay long tables, sorted
    within their partitions on write, instead of one collected list per key.
    """
    cols = ["id", *_NEWEST]
    base = _keyed(pubs).select(*cols, "authors")
    by_author = base.select(*cols, F.explode("authors").alias("name")).join(mapping.select("name", "slug"), "name").select("slug", *cols)
    return by_author, base.select(strip("publication_year").alias("year"), *cols)


def author_pages(by_author: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per indexed author: display name, number of variants and of publications, newest one."""
    stats = by_author.groupBy("slug").agg(F.count("*").alias("publications"), F.max_by("id", F.struct(*_NEWEST)).alias("newest"))
    names = mapping.groupBy("slug").agg(F.min_by("name", "pos").alias("name"), F.count("*").alias("variants"))
    return stats.join(names, "slug")


def year_pages(by_year: DataFrame) -> DataFrame:
    return by_year.groupBy("year").agg(F.count("*").alias("publications"), F.max_by("id", F.struct(*_NEWEST)).alias("newest"))


def author_index(pages: DataFrame) -> DataFrame:
    """Authors with index letter, and a flag on the first one of each letter.

    The first of a letter is one ``min_by`` per letter, so no window runs over all authors.
    """
    rows = pages.withColumn("key", author_sort_key("name")).withColumn("letter", F.upper(F.substring("key", 1, 1)))
    heads = rows.groupBy("letter").agg(F.min_by("slug", F.struct("key", "name", "slug")).alias("head"))
    out = rows.join(heads, "letter").withColumn("starts_letter", F.col("slug") == F.col("head"))
    return out.select("slug", "name", "key", "letter", "starts_letter")


def ranked_members(members: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Ordered publications of every page, newest first; with ``limit`` the newest ones alone, cut in each task."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in _NEWEST])
    ranked = members.withColumn("rank", F.row_number().over(w))
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select(key, "rank", "id")


def file_coverage(pubs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publications without a companion file and files without a publication."""
    have = files.select(F.col("name").alias("permalink")).distinct()
    return (pubs.select("id", "permalink").join(have, "permalink", "left_anti"),
            have.join(pubs.select("permalink"), "permalink", "left_anti"))
