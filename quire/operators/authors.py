"""Author identities. The mapping is a long table ``(slug, pos, name)``; a name has one slug."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.identity import fingerprint
from quire.functions.markup import is_institution_like
from quire.functions.staging import stage
from quire.functions.text import casefold, is_safe_component, slugify, strip, romanised, to_ascii
from quire.operators.ranking import numbered
from quire.session import cut_lineage, stored


def mapping_errors(mapping: DataFrame) -> DataFrame:
    """Unsafe slugs, blank names, and names under two slugs."""
    rows = mapping.withColumn("name", strip("name"))
    unsafe = rows.filter(~is_safe_component("slug")).select("slug", F.lit("").alias("name"), F.lit("unsafe slug").alias("problem")).distinct()
    blank = rows.filter(F.coalesce(F.col("name"), F.lit("")) == "").select("slug", F.lit("").alias("name"), F.lit("blank name").alias("problem"))
    shared = rows.filter("name <> ''").groupBy("name").agg(F.min("slug").alias("slug"), F.max("slug").alias("hi")).filter("slug <> hi")
    return unsafe.unionByName(blank).unionByName(shared.select("slug", "name", F.lit("ambiguous name").alias("problem")))


def name_signature(c) -> Column:
    """Surname and first initial, taken from the slug; null, and so no join key, for a name without one."""
    words = F.split(F.nullif(slugify(c), F.lit("")), "-")
    return F.concat(F.element_at(words, -1), F.lit("|"), F.substring(F.get(words, F.lit(0)), 1, 1))


def occurrences(pubs: DataFrame) -> DataFrame:
    """How often each author name occurs; ``pubs`` holds ``id`` and the name array ``authors``."""
    return pubs.select(F.explode("authors").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def unknown_names(pubs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names without an identity, with their count and sort key (last word, name)."""
    gone = occurrences(pubs).join(mapping.select("name"), "name", "left_anti")
    return gone.withColumn("sort_word", romanised(F.element_at(F.split("name", r"\s+"), -1)))


def ordered_unknown_names(pubs: DataFrame, mapping: DataFrame) -> DataFrame:
    return unknown_names(pubs, mapping).orderBy("sort_word", "name")


def possible_matches(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(name, slug)`` of known identities with the same surname and first initial.

    Known names shrink to one row per signature and slug before the join, and unknown names
    to one row per signature, so a common signature is joined once.
    """
    known = mapping.select(name_signature("name").alias("sig"), "slug").distinct()
    return names.select("name", name_signature("name").alias("sig")).join(known, "sig").select("name", "slug")


def plan_authors(pubs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(safe, review)``: new identities without doubt, and proposals with reasons.

    A proposal is one slug with all unknown names that produce it; a name without a slug is a
    proposal of its own and never an identity.
    """
    named = unknown_names(pubs, mapping).select("name", "n", "sort_word", slugify("name").alias("slug"))
    unknown, blank = named.filter("slug <> ''"), named.filter("slug = ''")
    grouped = unknown.groupBy("slug").agg(
        F.min(F.struct("sort_word", "name")).alias("head"), F.count("*").alias("names"), F.sum("n").alias("occurrences"))
    heads = grouped.select("slug", "names", "occurrences", F.col("head.name").alias("name"), name_signature("head.name").alias("sig"))
    taken = mapping.select("slug", F.lit(True).alias("taken")).distinct()
    similar = mapping.select(name_signature("name").alias("sig"), F.lit(True).alias("similar")).distinct()
    rows = heads.join(taken, "slug", "left").join(similar, "sig", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("taken"), F.lit("slug exists")), F.when(F.col("names") > 1, F.lit("several names")),
        F.when(F.col("similar"), F.lit("same surname and initial"))))
    rows = rows.withColumn("reasons", reasons)
    return (
        rows.filter(F.size("reasons") == 0).select("slug", "name", "occurrences"),
        rows.filter(F.size("reasons") > 0).select("slug", "name", "names", "occurrences", "reasons").unionByName(
            blank.select("slug", "name", F.lit(1).cast("long").alias("names"), F.col("n").alias("occurrences"), F.array(F.lit("no slug")).alias("reasons"))),
    )


def author_status(pubs: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: known variants, unknown names, safe and review counts."""
    safe, review = plan_authors(pubs, mapping)
    rows = (safe.select(F.lit("safe").alias("k"), F.lit(1).cast("long").alias("n"))
            .unionByName(review.select(F.lit("review").alias("k"), F.col("names").alias("n")))
            .unionByName(mapping.select("name").distinct().select(F.lit("known").alias("k"), F.lit(1).cast("long").alias("n"))))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    return rows.agg(total("known").alias("known_variants"), (total("safe") + total("review")).alias("unknown_names"),
                    total("safe").alias("safe"), total("review").alias("manual_review"))


def author_cases(pubs: DataFrame, review: DataFrame, mapping: DataFrame) -> DataFrame:
    """Evidence rows of every reviewed name: its own occurrences and those of each candidate.

    ``pubs``: id, title, people array<struct<name, orcid, affiliations>>; ``review``: name, slug.
    """
    seen = pubs.select("id", "title", F.explode("people").alias("p")).select("id", "title", "p.name", "p.orcid", "p.affiliations")
    own = review.select("name", F.col("name").alias("seen_name"), F.lit("self").alias("candidate"))
    others = possible_matches(review, mapping).join(mapping.select("slug", F.col("name").alias("seen_name")), "slug").select(
        "name", "seen_name", F.col("slug").alias("candidate"))
    return own.unionByName(others).join(seen.withColumnRenamed("name", "seen_name"), "seen_name").select(
        "name", "candidate", "seen_name", "id", "title", "orcid", "affiliations")


# -- identity hygiene ------------------------------------------------------------------

def words(c) -> Column:
    return F.regexp_extract_all(casefold(to_ascii(c)), F.lit("[a-z0-9]+"), F.lit(0))


def _signed(mapping: DataFrame) -> DataFrame:
    rows = stage(mapping.select("slug", "name"), w=words("name"))
    n = F.size("w")
    given = F.when(n >= 2, F.slice("w", F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return stage(rows, given=given, family=F.coalesce(F.try_element_at("w", F.lit(-1)), F.lit("")), compact=F.array_join("w", "")).drop("w")


def encoding_groups(mapping: DataFrame) -> DataFrame:
    """Identities whose names collapse to one form: ``(compact, anchor, slug)``.

    Equality is transitive, so every pair follows from its anchor; the result stays linear in
    the mapping even if very many identities share one form.
    """
    members = _signed(mapping).filter("compact <> ''").select("compact", "slug").distinct()
    spans = members.groupBy("compact").agg(F.min("slug").alias("anchor"), F.max("slug").alias("last")).filter("anchor <> last")
    return members.join(spans.select("compact", "anchor"), "compact").filter("slug <> anchor")


def initial_candidates(mapping: DataFrame) -> DataFrame:
    """Forms of one surname where an initial on one side meets a full given name on the other.

    Works on distinct forms (family, given), each standing for the identities that bear it.
    A form has a mask of the positions it abbreviates. Two forms fit exactly when they agree
    on the initials and on the full names at positions neither abbreviates, so for each pair
    of masks the candidates come from an equality join and hold no false pair. Returns the
    two forms and their smallest slugs; ``form_members`` lists the others.
    """
    forms = _signed(mapping).filter("family <> '' AND size(given) > 0").groupBy("family", "given").agg(
        F.min("slug").alias("slug"), F.max("slug").alias("hi"))
    initials = F.array_join(F.transform("given", lambda g: F.substring(g, 1, 1)), "")
    mask = F.array_join(F.transform("given", lambda g: F.when(F.length(g) == 1, "1").otherwise("0")), "")
    forms = stage(forms, initials=initials, mask=mask)
    masks = forms.select("family", "initials", F.col("mask").alias("other")).distinct()
    sides = forms.join(masks, ["family", "initials"]).filter("mask <> other")
    rest = F.array_join(F.transform("given", lambda g, i: F.when(
        (F.substr("mask", i + 1, F.lit(1)) == "1") | (F.substr("other", i + 1, F.lit(1)) == "1"), "").otherwise(g)), " ")
    sides = stage(sides, rest=rest)
    pick = lambda p: sides.select("family", "initials", "rest", *[F.col(c).alias(p + c) for c in ("given", "slug", "hi", "mask", "other")])
    a, b = pick("l_"), pick("r_")
    same = ["family", "initials", "rest"]
    pairs = a.join(b.withColumnRenamed("r_mask", "l_other").withColumnRenamed("r_other", "l_mask"), [*same, "l_mask", "l_other"])
    pairs = pairs.filter((F.col("l_mask") < F.col("l_other")) & ~((F.col("l_slug") == F.col("r_slug")) & (F.col("l_hi") == F.col("r_hi")) & (F.col("l_slug") == F.col("l_hi"))))
    return pairs.select("family", F.array_join("l_given", " ").alias("left_given"), F.array_join("r_given", " ").alias("right_given"),
                        F.least("l_slug", "r_slug").alias("left_slug"), F.greatest("l_slug", "r_slug").alias("right_slug"))


def form_members(mapping: DataFrame) -> DataFrame:
    """``(family, given, slug)``: all identities behind each form."""
    return _signed(mapping).select("family", F.array_join("given", " ").alias("given"), "slug").distinct()


def slug_findings(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Initial-only slugs with a known full given name, and institution-like identities."""
    rows = _signed(mapping)
    full = rows.filter(F.length(F.get("given", F.lit(0))) > 1)
    best = full.groupBy("slug").agg(F.min_by("name", F.struct((-F.length("compact")).alias("n"), casefold("name").alias("c"))).alias("name"))
    best = best.withColumn("proposed_slug", slugify("name"))
    weak = best.filter((F.length(F.split_part("slug", F.lit("-"), F.lit(1))) == 1) & (F.col("proposed_slug") != "") & (F.col("proposed_slug") != F.col("slug")))
    return weak.select("slug", "proposed_slug"), mapping.filter(is_institution_like("name")).select("slug").distinct()


def pair_fingerprint(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pairs ``(left_slug, right_slug)`` with a fingerprint over both name lists; null if a slug is gone."""
    names = mapping.groupBy("slug").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "name")))["name"], "\n"), 256).alias("names"))
    out = pairs
    for side in ("left", "right"):
        out = out.join(names.select(F.col("slug").alias(f"{side}_slug"), F.col("names").alias(f"_{side}")), f"{side}_slug", "left")
    print_ = fingerprint(left_slug="left_slug", right_slug="right_slug", left="_left", right="_right")
    return out.withColumn("fingerprint", F.when(F.col("_left").isNotNull() & F.col("_right").isNotNull(), print_)).drop("_left", "_right")


def suppress_distinct(pairs: DataFrame, mapping: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open candidate pairs, and decisions that are stale.

    A reviewed-distinct decision ``(left_slug, right_slug, fingerprint)`` holds while both
    identities keep their names.
    """
    key = ["left_slug", "right_slug"]
    slim = pairs.select(*key).distinct()
    now = pair_fingerprint(decisions.select(*key, F.col("fingerprint").alias("seen")), mapping)
    now = now.join(slim.withColumn("_c", F.lit(True)), key, "left")
    valid = F.coalesce(F.col("_c") & (F.col("seen") == F.col("fingerprint")), F.lit(False))
    return slim.join(now.filter(valid).select(*key), key, "left_anti"), now.filter(~valid).select(*key)


def reconcile_distinct(decisions: DataFrame, edits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Decisions after merges (dropped when touched) and renames (carried over with a new fingerprint).

    ``edits``: op, slug, target; ``mapping`` is the mapping after the edits.
    """
    merged = edits.filter("op = 'merge'")
    touched = merged.select("slug").unionByName(merged.select(F.col("target").alias("slug"))).distinct()
    kept = decisions.select("left_slug", "right_slug")
    for side in ("left_slug", "right_slug"):
        kept = kept.join(touched.withColumnRenamed("slug", side), side, "left_anti")
        renamed = edits.filter("op = 'rename'").select(F.col("slug").alias(side), F.col("target").alias("_new"))
        kept = kept.join(renamed, side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
    ordered = kept.select(F.least("left_slug", "right_slug").alias("left_slug"), F.greatest("left_slug", "right_slug").alias("right_slug")).distinct()
    return pair_fingerprint(ordered, mapping).filter("fingerprint IS NOT NULL")


def edit_authors(mapping: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One batch of reviewed edits ``(op, slug, target, name)``: ``(mapping, errors)``.

    Operations: create, assign, merge, rename, remove. Merges and renames move whole
    identities, so they are one join on the slug.
    """
    slugs = mapping.groupBy("slug").agg(F.count("*").alias("size"), F.max("pos").alias("last"))
    e = edits.withColumn("name", strip(F.coalesce("name", F.lit(""))))
    e = e.join(slugs.select("slug", "size", F.lit(True).alias("has")), "slug", "left")
    e = e.join(slugs.select(F.col("slug").alias("target"), F.lit(True).alias("t_has")), "target", "left")
    owner = mapping.select("name", F.col("slug").alias("owner"))
    e = e.join(owner, "name", "left")
    op, has, t_has = F.col("op"), F.col("has").isNotNull(), F.col("t_has").isNotNull()
    problem = (
        F.when(op.isin("create", "assign") & F.col("owner").isNotNull(), "name already assigned")
        .when((op == "create") & has, "identity exists").when((op == "create") & ~is_safe_component("slug"), "unsafe slug")
        .when(op.isin("assign", "merge", "rename", "remove") & ~has, "unknown identity")
        .when((op == "merge") & (F.col("slug") == F.col("target")), "same identity").when((op == "merge") & ~t_has, "unknown target")
        .when((op == "rename") & t_has, "target exists").when((op == "rename") & ~is_safe_component("target"), "unsafe slug")
        .when((op == "remove") & ~F.coalesce(F.col("owner") == F.col("slug"), F.lit(False)), "no such variant")
        .when((op == "remove") & (F.col("size") == 1), "last variant"))
    e = e.withColumn("problem", problem)
    ok = e.filter("problem IS NULL")
    moved = ok.filter("op IN ('merge', 'rename')").select("slug", "target")
    removed = ok.filter("op = 'remove'").select("slug", "name")
    base = mapping.join(removed, ["slug", "name"], "left_anti").join(moved, "slug", "left")
    base = base.select(F.coalesce("target", "slug").alias("slug"), F.when(F.col("target").isNull(), 0).otherwise(1).alias("late"), "pos", "name")
    added = ok.filter("op IN ('create', 'assign')").select("slug", F.lit(2).alias("late"), F.lit(0).alias("pos"), "name")
    rows = base.unionByName(added)
    w = Window.partitionBy("slug").orderBy("late", "pos", "name")
    return rows.select("slug", F.row_number().over(w).alias("pos"), "name"), e.filter("problem IS NOT NULL").select("op", "slug", "target", "name", "problem")


def allocate_slugs(titles: DataFrame, used: DataFrame) -> DataFrame:
    """Unique slugs ``(id, slug)`` for titles in input order: zeros are appended until a slug is free.

    ``titles``: id, ord, title. One zero per earlier row makes the text of a crowded root grow with
    the square of its rows, which is the rule's; the allocation itself is ``allocate_zeros``.
    """
    rows = _rooted(titles.select("id", "ord", slugify("title").alias("base")), "base")
    placed = allocate_zeros(rows, _rooted(used.select("slug").distinct(), "slug").select("root", "zeros"))
    return placed.select(F.col("id").cast("string").alias("id"), F.concat("root", F.repeat(F.lit("0"), F.col("place").cast("int"))).alias("slug"))


def _rooted(df: DataFrame, slug: str) -> DataFrame:
    df = df.withColumn("root", F.regexp_replace(slug, "0+$", ""))
    return df.withColumn("zeros", (F.length(slug) - F.length("root")).cast("long")).drop(slug)


#: Free places of one join key of a gap.
GAP_BLOCK = 1000


def _gaps(used: DataFrame) -> DataFrame:
    """``(root, low, high, shift)``: the free places numbered ``low`` to ``high`` (no end where null) have ``shift`` used places below them."""
    ranked = numbered(used.distinct(), ["root"], [F.asc("zeros")], "shift")
    ranked = cut_lineage(ranked.select("root", "shift", (F.col("zeros") - F.col("shift") + 1).alias("low")))
    after = ranked.select("root", (F.col("shift") - 1).alias("shift"), (F.col("low") - 1).alias("high"))
    return ranked.join(after, ["root", "shift"], "left").filter("high IS NULL OR low <= high").select("root", "low", "high", "shift")


def _free_place(rows: DataFrame, gaps: DataFrame, at: str, place: str) -> DataFrame:
    """Add ``place``: the free place of the root whose number is ``at`` (from 0). Roots without used places have all free.

    Gaps meet rows by blocks of free numbers, so a crowded root is dealt to many keys; the last
    gap, which has no end, is one row of its root.
    """
    closed = gaps.filter("high IS NOT NULL").select(
        F.col("root").alias("_r"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("shift").alias("_shift"),
        F.explode(F.sequence(F.floor(F.col("low") / GAP_BLOCK), F.floor(F.col("high") / GAP_BLOCK))).alias("_b"))
    tail = gaps.filter("high IS NULL").select(F.col("root").alias("_t"), F.col("low").alias("_last"), F.col("shift").alias("_all"))
    inside = (F.col("root") == F.col("_r")) & (F.floor(F.col(at) / GAP_BLOCK) == F.col("_b")) & F.col(at).between(F.col("_low"), F.col("_high"))
    rows = rows.join(closed, inside, "left").join(tail, F.col("root") == F.col("_t"), "left")
    shift = F.coalesce("_shift", F.when(F.col(at) >= F.col("_last"), F.col("_all")), F.lit(0))
    return rows.withColumn(place, F.col(at) + shift).drop("_r", "_b", "_low", "_high", "_shift", "_t", "_last", "_all")


def allocate_zeros(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Place of each row: in order of ``ord``, the first number from its ``zeros`` on that neither ``used`` nor an earlier row of its root holds.

    ``rows``: id, root, ord, zeros; ``used``: root, zeros. Adds ``place``. A place goes to the earliest row that has
    passed or started at it and holds none yet. So the places between two starting numbers of a root go, in
    order, to the earliest of the rows that wait there, and the others wait at the next
    starting number: one round for each, over all roots at once. In a round rows are numbered by
    ranges and find their places by joins on gaps, so a crowded root takes many tasks.
    """
    gaps = cut_lineage(_gaps(used))
    crowd = rows.groupBy("root").agg(F.count("*").alias("_rows")).join(used.select("root").distinct().withColumn("_used", F.lit(True)), "root", "left")
    rows = rows.join(crowd, "root", "left")
    alone = rows.filter((F.col("_rows") == 1) & F.col("_used").isNull()).withColumn("place", F.col("zeros")).drop("_rows", "_used")
    waiting = rows.filter((F.col("_rows") > 1) | F.col("_used").isNotNull()).drop("_rows", "_used")
    columns = waiting.columns
    # starting numbers of each root, as numbers of free places: those below the start are out of reach
    starts = waiting.select("root", "zeros").distinct()
    below = starts.join(used.distinct().select("root", F.col("zeros").alias("_u")), "root", "left").groupBy("root", "zeros").agg(
        F.count_if(F.col("_u") < F.col("zeros")).alias("_below"))
    by = Window.partitionBy("root").orderBy("zeros")
    starts = below.select("root", "zeros", (F.col("zeros") - F.col("_below")).alias("_first"), F.row_number().over(by).alias("_round"))
    starts = cut_lineage(starts.withColumn("_next", F.lead("_first").over(by)))
    rounds = starts.agg(F.max("_round")).first()[0] or 0
    out, left = [alone.select(*columns, "place")], None
    waiting = waiting.join(starts.select("root", "zeros", F.col("_round").alias("_start")), ["root", "zeros"])
    for k in range(1, rounds + 1):
        pool = waiting.filter(F.col("_start") == k).select(*columns)
        pool = pool if left is None else pool.unionByName(left)
        pool = numbered(pool, ["root"], [F.asc("ord")], "_k").join(starts.filter(F.col("_round") == k).select("root", "_first", "_next"), "root")
        served = F.col("_next").isNull() | (F.col("_first") + F.col("_k") - 1 < F.col("_next"))
        pool = stored(pool.withColumn("_served", served), "slug-round")
        placed = _free_place(pool.filter("_served").withColumn("_at", F.col("_first") + F.col("_k") - 1), gaps, "_at", "place")
        out.append(placed.select(*columns, "place"))
        left = pool.filter("NOT _served").select(*columns)
    return reduce(DataFrame.unionByName, out)
