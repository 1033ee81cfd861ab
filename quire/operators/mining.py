"""Mining of screening rules from labelled evidence.

Evidence rows: doi, ord, title, abstract, keywords, batch_id. Labelled rows add
``label`` (keep or reject) and ``source``. Counting is two-level, first by phrase and
batch and then by phrase, so that map-side combine takes the weight of frequent phrases
and the number of distinct batches needs no distinct expansion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.staging import stage
from quire.functions.stats import promotion_ready, ratio, wilson_lower
from quire.functions.text import _col, casefold, norm_dash, unescape_entities
from quire.operators.screening import match_rules, relevance_text, triage
from quire.session import cut_lineage, stored

WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"


# Words never counted as phrases.
STOP_WORDS = """
a an and are as at be been being by for from has have in into is it its of on or that the their this to using
via was were with within without we our can may about above after again against all also am among an another
any around because before below between both but could did do does doing down during each few further had
having he her here hers herself him himself his how if itself just more most no nor not now off once only other
ought out over own same she should so some such than then there these they those through too under until up
very what when where which while who whom why will would you your yours yourself yourselves
""".split()


def feature_text(text) -> Column:
    """Markup-neutral lower-case surface used only for counting."""
    out = unescape_entities(unescape_entities(text))
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"</?[A-Za-z][^<>]*>", " ")
    return casefold(norm_dash(out))


def ngrams(tokens: Column, width: int) -> Column:
    """All runs of ``width`` tokens; empty for a shorter list."""
    last = F.size(tokens) - F.lit(width)
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(width)]),
    )
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def with_features(df: DataFrame, text, stop: list[str] | None = None) -> DataFrame:
    """Add ``features``: the distinct 1- to 3-grams of each row's whole text."""
    words = STOP_WORDS if stop is None else stop
    tokens = F.filter(
        F.regexp_extract_all(feature_text(text), F.lit(WORD), F.lit(0)),
        lambda t: (F.length(t) >= 2) & ~t.isin(words),
    )
    tok = F.col("_tokens")
    grams = F.array_distinct(F.concat(tok, ngrams(tok, 2), ngrams(tok, 3)))
    return df.withColumn("_tokens", tokens).withColumn("features", grams).drop("_tokens")


def labeled_features(evidence: DataFrame, labels: DataFrame, accept: list[str], reject: list[str],
                     unmatched: str = "manual-review", stop: list[str] | None = None) -> DataFrame:
    """Labelled rows with their phrases and whether current rules leave them to review."""
    rows = evidence.join(labels, "doi").withColumn("_text", relevance_text("title", "abstract", "keywords"))
    rows = rows.withColumn("_a", match_rules("_text", accept)).withColumn("_r", match_rules("_text", reject))
    rows = rows.withColumn("gap", triage("_a", "_r", unmatched) == "review")
    return with_features(rows, "_text", stop).select("doi", "ord", "batch_id", "label", "source", "gap", "features")


def base_rates(counts: DataFrame) -> DataFrame:
    """One row: keep and reject shares over all labelled rows and over the review gap, from the row of a ``phrase_table`` that counts all."""
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    sums = counts.filter(F.col("phrase") == ALL_ROWS).select(
        "keep", "reject", "review_keep", "review_reject", (F.col("keep") + F.col("reject")).alias("total"), (F.col("review_keep") + F.col("review_reject")).alias("gap_total"))
    return sums.select(
        "total", "gap_total",
        share("keep", "total").alias("base_keep"),
        share("reject", "total").alias("base_reject"),
        share("review_keep", "gap_total").alias("gap_base_keep"),
        share("review_reject", "gap_total").alias("gap_base_reject"),
    )


def with_base_rates(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the one row of base rates as columns through a scalar subquery."""
    rates = base_rates(counts)
    row = rates.select(F.struct(*rates.columns).alias("r")).scalar()
    return df.withColumn("_rates", row).select("*", "_rates.*").drop("_rates")


def _counts() -> list[Column]:
    keep, gap, human = F.col("label") == "keep", F.col("gap"), F.col("source") == "human"
    return [
        F.count_if(keep).alias("keep"),
        F.count_if(~keep).alias("reject"),
        F.count_if(gap & keep).alias("review_keep"),
        F.count_if(gap & ~keep).alias("review_reject"),
        F.count_if(human & keep).alias("human_keep"),
        F.count_if(human & ~keep).alias("human_reject"),
        F.count_if(gap & human & keep).alias("gap_human_keep"),
        F.count_if(gap & human & ~keep).alias("gap_human_reject"),
    ]


_COUNT_NAMES = ["keep", "reject", "review_keep", "review_reject", "human_keep", "human_reject",
                "gap_human_keep", "gap_human_reject"]


def _exploded(labeled: DataFrame, *keep: str) -> DataFrame:
    """One row per phrase.

    The outer form keeps Spark from inferring a ``size(features) > 0`` filter, which would be
    pushed below the projection and evaluate the tokens again inside the n-gram lambdas.
    """
    return labeled.select(*keep, F.explode_outer("features").alias("phrase")).filter(F.col("phrase").isNotNull())


def phrase_counts(labeled: DataFrame) -> DataFrame:
    """Counts of every phrase over all labelled rows and over the review gap."""
    grams = _exploded(labeled, "batch_id", "label", "source", "gap")
    per_batch = grams.groupBy("phrase", "batch_id").agg(*_counts())
    has_batch = F.coalesce(F.col("batch_id"), F.lit("")) != ""
    in_gap = F.col("review_keep") + F.col("review_reject") > 0
    return per_batch.groupBy("phrase").agg(
        *[F.sum(n).alias(n) for n in _COUNT_NAMES],
        F.count_if(has_batch).alias("batch_count"),
        F.count_if(has_batch & in_gap).alias("review_batch_count"),
    )


#: The phrase under which a phrase table counts all rows.
ALL_ROWS = ""


def phrase_table(labeled: DataFrame) -> DataFrame:
    """Counts of the phrases that stand in at least two rows of the review gap, and of all rows under the empty phrase.

    Texts are matched and cut once for the counts and the base rates; the table is written, because
    its readers need it twice.
    """
    every = labeled.withColumn("features", F.concat(F.array(F.lit(ALL_ROWS)), F.coalesce("features", F.array().cast("array<string>"))))
    return stored(phrase_counts(every).filter((F.col("phrase") == ALL_ROWS) | (F.col("review_keep") + F.col("review_reject") >= 2)), "phrases")


def signals(labeled: DataFrame, limit: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """Best single phrases per direction for closing the review gap. ``counts``: the ``phrase_table`` of ``labeled``, if there is one."""
    counts = phrase_table(labeled) if counts is None else counts
    frequent = counts.filter((F.col("phrase") != ALL_ROWS) & (F.col("review_keep") + F.col("review_reject") >= 2))
    rows = (
        with_base_rates(frequent, counts)
        .withColumn("support", F.col("keep") + F.col("reject"))
        .withColumn("review_support", F.col("review_keep") + F.col("review_reject"))
        .withColumn("d", F.explode(F.array(
            F.struct(F.lit("accept").alias("direction"), F.col("keep").alias("hit"),
                     F.col("review_keep").alias("gap_hit"), F.col("base_keep").alias("base"),
                     F.col("gap_base_keep").alias("gap_base")),
            F.struct(F.lit("reject").alias("direction"), F.col("reject").alias("hit"),
                     F.col("review_reject").alias("gap_hit"), F.col("base_reject").alias("base"),
                     F.col("gap_base_reject").alias("gap_base")),
        )))
    )
    rows = (
        rows.withColumn("direction", F.col("d.direction"))
        .withColumn("precision", ratio("d.hit", "support"))
        .withColumn("review_precision", ratio("d.gap_hit", "review_support"))
        .filter(F.col("review_precision") > F.col("d.gap_base"))
        .withColumn("wilson_lower", wilson_lower("d.hit", "support"))
        .withColumn("review_wilson_lower", wilson_lower("d.gap_hit", "review_support"))
        .withColumn("lift", ratio("precision", "d.base"))
        .withColumn("review_lift", ratio("review_precision", "d.gap_base"))
        .withColumn("promotion_ready", promotion_ready(
            "review_support", "review_precision", "review_wilson_lower", "review_batch_count"))
    )
    return top_signals(rows, limit).select(
        "direction", "rank", "phrase", "promotion_ready", "support", "keep", "reject", "precision",
        "wilson_lower", "lift", "review_support", "review_keep", "review_reject", "review_precision",
        "review_wilson_lower", "review_lift", "human_keep", "human_reject", "batch_count", "review_batch_count",
    )


def top_signals(rows: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` rows per direction; the rank filter limits each task before the shuffle."""
    order = [F.col(c).desc() for c in (
        "review_wilson_lower", "review_support", "review_precision", "wilson_lower", "support", "phrase")]
    w = Window.partitionBy("direction").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def examples(labeled: DataFrame, winners: DataFrame, per_label: int = 5, gap_only: bool = False) -> DataFrame:
    """First example keys per winning phrase and label, in input order.

    ``winners`` is a top-k result, so its broadcast is bounded by k.
    """
    rows = labeled.filter("gap") if gap_only else labeled
    phrases = F.broadcast(winners.select("phrase").distinct())
    hits = _exploded(rows, "doi", "ord", "label").join(phrases, "phrase")
    w = Window.partitionBy("phrase", "label").orderBy("ord")
    first = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_label)
    return first.groupBy("phrase", "label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "doi"))), lambda x: x["doi"]).alias("dois"))


def candidate_pool(labeled: DataFrame, size: int = 80, counts: DataFrame | None = None) -> DataFrame:
    """Phrases of the review gap that discriminate best; at most ``size`` rows. ``counts`` as in ``signals``."""
    counts = phrase_table(labeled) if counts is None else counts
    support = F.col("review_keep") + F.col("review_reject")
    rows = with_base_rates(counts.filter((F.col("phrase") != ALL_ROWS) & (support >= 2)), counts).withColumn("support", support)
    spread = F.greatest(
        F.abs(ratio("review_keep", "support") - F.col("gap_base_keep")),
        F.abs(ratio("review_reject", "support") - F.col("gap_base_reject")),
    )
    return (
        rows.withColumn("score", spread * F.log1p(F.col("support").cast("double")))
        .orderBy(F.desc("score"), F.desc("support"), F.desc("phrase"))
        .limit(size)
        .select("phrase", "support", "review_keep", "review_reject", "score")
    )


def redundant_pair(a, b) -> Column:
    """One phrase is a run of whole tokens of the other."""
    pa, pb = F.concat(F.lit(" "), _col(a), F.lit(" ")), F.concat(F.lit(" "), _col(b), F.lit(" "))
    return F.contains(pa, pb) | F.contains(pb, pa)


_GAP_SPLIT = r"[-\s]+"


def phrase_regex(c) -> Column:
    """Pattern of one phrase whose words may be joined by hyphens or blanks."""
    words = F.filter(F.split(_col(c), _GAP_SPLIT), lambda w: w != "")
    escaped = F.transform(words, lambda w: F.regexp_replace(w, r"([.^$*+?{}\[\]\\|()#&~\-])", r"\\$1"))
    return F.array_join(escaped, _GAP_SPLIT)


def pair_regex(a, b) -> Column:
    """Two-signal rule: both phrases occur somewhere in the text."""
    look = lambda c: F.concat(F.lit(r"(?=.*\b"), phrase_regex(c), F.lit(r"\b)"))
    return F.concat(F.lit("(?is)"), look(a), look(b))


def pair_signals(labeled: DataFrame, limit: int = 20, pool_size: int = 80, min_gain: float = 0.10,
                 counts: DataFrame | None = None, preselected: int | None = None, per_label: int = 5) -> DataFrame:
    """Two-phrase rules that predict better than either phrase alone: the ``limit`` best of each direction.

    The final order applies to the ``preselected`` pairs that lead by the review figures alone, five
    times the limit and at least 50 where it is not given. The first ``per_label`` keys that support
    and that contradict a rule come with it, of all rows and of the review gap.

    The pool holds at most ``pool_size`` phrases, which enter the plan as one array. What rows hold
    of it is written once and read for counts and examples, so texts are cut twice: for the phrase
    table and for the pool. A row yields at most pool_size*(pool_size-1)/2 pairs, all of them
    counted by a map-side combine over that same bounded key space; nothing is paired across rows.
    """
    counts = phrase_table(labeled) if counts is None else counts
    pool = cut_lineage(candidate_pool(labeled, pool_size, counts))
    listed = F.array(*[F.lit(r["phrase"]) for r in pool.select("phrase").orderBy("phrase").collect()]).cast("array<string>")
    held = stage(labeled, _sel=F.array_intersect(listed, "features"))
    rows = stored(held.filter(F.size("_sel") > 1).select("doi", "ord", "batch_id", "label", "source", "gap", "_sel"), "pool-phrases")
    keep_cols = ["batch_id", "label", "source", "gap"]
    firsts = rows.select(*keep_cols, "_sel", F.posexplode_outer("_sel").alias("pos", "first")).filter("first IS NOT NULL")
    later = F.expr("slice(_sel, pos + 2, size(_sel))")
    pairs = firsts.select(*keep_cols, "first", F.explode_outer(later).alias("second")).filter("second IS NOT NULL")
    pairs = pairs.filter(~redundant_pair("first", "second"))

    per_batch = pairs.groupBy("first", "second", "batch_id").agg(*_counts())
    has_batch = F.coalesce(F.col("batch_id"), F.lit("")) != ""
    gap_k, gap_r = F.col("review_keep"), F.col("review_reject")
    per_pair = per_batch.groupBy("first", "second").agg(
        *[F.sum(n).alias(n) for n in _COUNT_NAMES],
        F.count_if(has_batch).alias("batch_count"),
        F.count_if(has_batch & (gap_k + gap_r > 0)).alias("review_batch_count"),
        F.count_if(has_batch & (gap_k > 0) & (gap_r == 0)).alias("pure_keep"),
        F.count_if(has_batch & (gap_r > 0) & (gap_k == 0)).alias("pure_reject"),
    ).filter("review_keep + review_reject >= 3")

    single = pool.select("phrase", "support", F.col("review_keep").alias("k"), F.col("review_reject").alias("r"))
    for side in ("first", "second"):
        small = F.broadcast(single.select(
            F.col("phrase").alias(side),
            (F.col("k") / F.col("support")).alias(f"{side}_keep_p"),
            (F.col("r") / F.col("support")).alias(f"{side}_reject_p"),
        ))
        per_pair = per_pair.join(small, side)
    per_pair = with_base_rates(per_pair, counts).filter("gap_total >= 2")
    per_pair = per_pair.withColumn("review_support", gap_k + gap_r).withColumn("support", F.col("keep") + F.col("reject"))

    def side_struct(direction: str, label: str) -> Column:
        return F.struct(
            F.lit(direction).alias("direction"), F.col(label).alias("hit"), F.col(f"review_{label}").alias("gap_hit"),
            F.col(f"gap_base_{label}").alias("gap_base"), F.col(f"pure_{label}").alias("pure"),
            F.col(f"first_{label}_p").alias("first_review_precision"),
            F.col(f"second_{label}_p").alias("second_review_precision"),
        )

    out = per_pair.withColumn("d", F.explode(F.array(side_struct("accept", "keep"), side_struct("reject", "reject"))))
    out = (
        out.withColumn("review_precision", ratio("d.gap_hit", "review_support"))
        .withColumn("best_single_review_precision",
                    F.greatest("d.first_review_precision", "d.second_review_precision"))
        .withColumn("review_precision_gain", F.col("review_precision") - F.col("best_single_review_precision"))
        .withColumn("review_batch_agreement", F.coalesce(ratio("d.pure", "review_batch_count"), F.lit(0.0)))
        .filter((F.col("review_precision") > F.col("d.gap_base")) & (F.col("review_precision_gain") >= min_gain))
        .filter("review_batch_count >= 2 AND review_batch_agreement >= 0.75")
        .withColumn("review_wilson_lower", wilson_lower("d.gap_hit", "review_support"))
        .withColumn("promotion_ready", promotion_ready(
            "review_support", "review_precision", "review_wilson_lower", "review_batch_count"))
        .withColumn("precision", ratio("d.hit", "support"))
        .withColumn("wilson_lower", wilson_lower("d.hit", "support"))
        .withColumn("direction", F.col("d.direction"))
    )
    lead = ["review_precision_gain", "review_wilson_lower", "review_support", "review_batch_agreement"]
    first_cut = Window.partitionBy("direction").orderBy(*[F.desc(c) for c in lead + ["first", "second"]])
    final = Window.partitionBy("direction").orderBy(
        *[F.desc(c) for c in lead + ["wilson_lower", "support", "first", "second"]])
    best = (
        out.withColumn("_cut", F.row_number().over(first_cut)).filter(F.col("_cut") <= (preselected or max(limit * 5, 50)))
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= limit)
        .withColumn("regex", pair_regex("first", "second"))
        .select(
            "direction", "rank", "first", "second", "regex", "promotion_ready", "review_support", "review_keep",
            "review_reject", "review_precision", "review_wilson_lower", "review_batch_count",
            "review_batch_agreement", "d.first_review_precision", "d.second_review_precision",
            "best_single_review_precision", "review_precision_gain",
            F.col("gap_human_keep").alias("human_keep"), F.col("gap_human_reject").alias("human_reject"),
            "support", "keep", "reject", "precision", "wilson_lower", "batch_count",
        )
    )
    best = cut_lineage(best)
    found = pair_examples(rows, best, per_label)
    own = lambda scope, side: F.when(F.col("direction") == "accept", F.col(f"{scope}_{side[0]}")).otherwise(F.col(f"{scope}_{side[1]}"))
    sides = {"supporting": ("keep", "reject"), "contradicting": ("reject", "keep")}
    return best.join(found, ["first", "second"], "left").select(
        *best.columns, *[own("gap", s).alias(f"review_{n}_dois") for n, s in sides.items()], *[own("all", s).alias(f"{n}_dois") for n, s in sides.items()])


def pair_examples(rows: DataFrame, winners: DataFrame, per_label: int = 5) -> DataFrame:
    """First example keys of winning pairs: ``first, second`` and one array for each label, of all rows and of the review gap.

    ``rows`` has ``_sel``, the pool phrases of a row; ``winners`` is a top-k result, so its pairs
    enter the plan as one array. The rank filter becomes a window group limit: every
    task keeps ``per_label`` rows of a pair, label and scope before the shuffle.
    """
    pairs = [F.struct(F.lit(r["first"]).alias("first"), F.lit(r["second"]).alias("second")) for r in winners.select("first", "second").distinct().collect()]
    listed = F.array(*pairs).cast("array<struct<first:string,second:string>>")
    both = F.filter(listed, lambda p: F.array_contains("_sel", p["first"]) & F.array_contains("_sel", p["second"]))
    scopes = F.when(F.col("gap"), F.array(F.lit("all"), F.lit("gap"))).otherwise(F.array(F.lit("all")))
    hits = rows.select("doi", "ord", "label", scopes.alias("scopes"), F.explode(both).alias("p")).select("doi", "ord", "label", "p.*", F.explode("scopes").alias("scope"))
    first = Window.partitionBy("first", "second", "label", "scope").orderBy("ord", "doi")
    kept = hits.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_label)
    listing = lambda scope, label: F.transform(F.sort_array(F.collect_list(F.when(
        (F.col("scope") == scope) & (F.col("label") == label), F.struct("n", "doi")))), lambda x: x["doi"]).alias(f"{scope}_{label}")
    return kept.groupBy("first", "second").agg(*[listing(s, v) for s in ("all", "gap") for v in ("keep", "reject")])


# -- diagnostics of current rules ----------------------------------------------------

def with_matches(labeled: DataFrame, accept: list[str], reject: list[str]) -> DataFrame:
    """Labelled evidence with the accept and reject rules each row matches."""
    rows = labeled.withColumn("_text", relevance_text("title", "abstract", "keywords"))
    return rows.select(
        "doi", "ord", "batch_id", "label", "source",
        match_rules("_text", accept).alias("accept_matches"),
        match_rules("_text", reject).alias("reject_matches"),
    )


def rule_diagnostics(matched: DataFrame, rules: list[str], side: str = "accept") -> DataFrame:
    """Support, precisions, unique coverage and conflicts of every rule, unused ones included."""
    own, other = (("accept_matches", "reject_matches"), ("reject_matches", "accept_matches"))[side == "reject"]
    hits = matched.select(
        "label", F.explode(own).alias("pattern"), (F.size(own) == 1).alias("alone"),
        (F.size(other) > 0).alias("conflict"))
    stats = hits.groupBy("pattern").agg(
        F.count("*").alias("support"),
        F.count_if(F.col("label") == "keep").alias("keep"),
        F.count_if(F.col("label") == "reject").alias("reject"),
        F.count_if("alone").alias("unique_coverage"),
        F.count_if("conflict").alias("opposite_conflicts"),
    )
    spark = matched.sparkSession
    listed = spark.createDataFrame([(i, r) for i, r in enumerate(rules, 1)], "rule_index int, pattern string")
    zero = {c: 0 for c in ("support", "keep", "reject", "unique_coverage", "opposite_conflicts")}
    return (
        listed.join(stats, "pattern", "left").fillna(zero)
        .withColumn("keep_precision", ratio("keep", "support"))
        .withColumn("reject_precision", ratio("reject", "support"))
    )


def replay_metrics(matched: DataFrame, unmatched: str = "manual-review") -> DataFrame:
    """Metrics of the current rules for all labelled rows and for human-reviewed ones: two rows, one pass."""
    rows = matched.withColumn("outcome", triage("accept_matches", "reject_matches", unmatched)).withColumn(
        "conflict", (F.size("accept_matches") > 0) & (F.size("reject_matches") > 0))
    human = F.col("source").isin("human", "correction")
    scopes = F.explode(F.when(human, F.array(F.lit("all"), F.lit("human"))).otherwise(F.array(F.lit("all"))))
    o, label = F.col("outcome"), F.col("label")
    agg = rows.withColumn("scope", scopes).groupBy("scope").agg(
        F.count("*").alias("labeled"),
        F.count_if(o == "queued").alias("auto_accept"),
        F.count_if(o == "rejected").alias("auto_reject"),
        F.count_if(o == "review").alias("manual_review"),
        F.count_if("conflict").alias("conflicts"),
        F.count_if((o == "queued") & (label == "reject")).alias("accept_false_positives"),
        F.count_if((o == "rejected") & (label == "keep")).alias("reject_false_negatives"),
    )
    return (
        agg.withColumn("accept_precision", ratio(F.col("auto_accept") - F.col("accept_false_positives"), "auto_accept"))
        .withColumn("reject_precision", ratio(F.col("auto_reject") - F.col("reject_false_negatives"), "auto_reject"))
        .withColumn("automatic_coverage", ratio(F.col("auto_accept") + F.col("auto_reject"), "labeled"))
    )


def replay_keys(matched: DataFrame, unmatched: str = "manual-review") -> DataFrame:
    """Long list of the keys behind the metrics: false accepts, false rejects, conflicts."""
    outcome = triage("accept_matches", "reject_matches", unmatched)
    conflict = (F.size("accept_matches") > 0) & (F.size("reject_matches") > 0)
    kinds = F.array_compact(F.array(
        F.when((outcome == "queued") & (F.col("label") == "reject"), F.lit("false_accept")),
        F.when((outcome == "rejected") & (F.col("label") == "keep"), F.lit("false_reject")),
        F.when(conflict, F.lit("conflict")),
    ))
    return matched.select("doi", "ord", "source", F.explode(kinds).alias("kind"))


def evidence_summary(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of totals over the evidence and its labels."""
    rows = evidence.select("doi", "batch_id").join(labels.select("doi", "label", "source"), "doi", "left")
    label, source = F.col("label"), F.col("source")
    return rows.agg(
        F.count("*").alias("evidence"),
        F.count(label).alias("labeled"),
        F.count_if(label == "keep").alias("keep"),
        F.count_if(label == "reject").alias("reject"),
        F.count_if(source.isin("human", "correction")).alias("human_labeled"),
        F.count_if(source == "correction").alias("corrected_labeled"),
        F.count_if(label.isNull()).alias("unresolved_evidence"),
        F.countDistinct(F.nullif(F.col("batch_id"), F.lit(""))).alias("batches"),
    )


def label_source_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("source").agg(F.count("*").alias("n"))
