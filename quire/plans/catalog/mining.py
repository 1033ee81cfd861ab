"""Queries of screening and rule mining over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.stats import ratio, wilson_lower
from quire.operators import mining as M, screening as S
from quire.plans import views as V
from quire.plans.catalog import query

A, R = V.ACCEPT_RULES, V.REJECT_RULES


def _labeled(spark, sf) -> DataFrame:
    return M.labeled_features(V.evidence(spark, sf), V.labels(spark, sf), A, R)


def _matched(spark, sf) -> DataFrame:
    return M.with_matches(V.evidence(spark, sf).join(V.labels(spark, sf), "doi"), A, R)


def _r(*names):
    return [F.round(F.col(n), 9).alias(n) for n in names]


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in M.STOP_WORDS)
_FEATURES = rf"""
  clean AS (SELECT t.*, regexp_replace(regexp_replace(abstract, '(?s)<!--.*?-->', ' ', 'g'),
      '</?[A-Za-z][^<>]*>', ' ', 'g') AS c1 FROM triaged t WHERE label IS NOT NULL),
  tok AS (SELECT doi, ord, batch_id, label, source, outcome = 'review' AS gap,
      list_filter(regexp_extract_all(replace(lower(regexp_replace(c1, '\p{{Pd}}', '-', 'g')), 'ß', 'ss'),
        '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS t FROM clean),
  grams AS (SELECT doi, ord, batch_id, label, source, gap, unnest(list_distinct(list_concat(t,
      list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i+1]),
      list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])))) AS phrase FROM tok),
  counts AS (SELECT phrase, count(*) FILTER (label='keep') AS keep, count(*) FILTER (label='reject') AS reject,
      count(*) FILTER (gap AND label='keep') AS review_keep, count(*) FILTER (gap AND label='reject') AS review_reject,
      count(*) FILTER (source='human' AND label='keep') AS human_keep,
      count(*) FILTER (source='human' AND label='reject') AS human_reject,
      count(DISTINCT batch_id) AS batch_count, count(DISTINCT batch_id) FILTER (gap) AS review_batch_count
      FROM grams GROUP BY phrase),
  rates AS (SELECT count(*) FILTER (label='keep') / count(*) AS bk, count(*) FILTER (label='reject') / count(*) AS br,
      count(*) FILTER (gap AND label='keep') / count(*) FILTER (gap) AS gbk,
      count(*) FILTER (gap AND label='reject') / count(*) FILTER (gap) AS gbr FROM tok)"""
_BASE = V.with_("evidence", "labels_view", "matched", "triaged")
_MINING = _BASE + "," + _FEATURES


def _wilson(s: str, n: str) -> str:
    s, n, z2 = f"({s})::DOUBLE", f"({n})::DOUBLE", "(1.96*1.96)"
    p = f"({s}/{n})"
    return (f"greatest(0.0, ({p} + {z2}/(2.0*{n}) - sqrt(({p}*(1.0-{p}) + {z2}/(4.0*{n}))/{n})*1.96)"
            f"/({z2}/{n} + 1.0))")


_SIGNALS = _MINING + f""",
  dirs AS (SELECT c.*, 'accept' AS direction, keep AS hit, review_keep AS ghit, bk AS base, gbk AS gbase FROM counts c, rates
    UNION ALL SELECT c.*, 'reject', reject, review_reject, br, gbr FROM counts c, rates),
  scored AS (SELECT *, keep + reject AS support, review_keep + review_reject AS review_support,
      hit / (keep + reject) AS prec, ghit / (review_keep + review_reject) AS rprec,
      {_wilson('hit', 'keep + reject')} AS wl, {_wilson('ghit', 'review_keep + review_reject')} AS rwl
      FROM dirs WHERE keep + reject >= 2 AND review_keep + review_reject >= 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY rwl DESC, review_support DESC, rprec DESC,
      wl DESC, support DESC, phrase DESC) AS rank FROM scored WHERE rprec > gbase),
  winners AS (SELECT * FROM ranked WHERE rank <= 20)"""


@query("c1_relevance_text", _BASE + " SELECT doi, sha256(abstract) AS surface_hash, length(abstract) AS n FROM matched")
def c1(spark, sf):
    return V.evidence(spark, sf).withColumn("t", S.relevance_text("title", "abstract", "keywords")).select(
        "doi", F.sha2("t", 256).alias("surface_hash"), F.length("t").alias("n"))


@query("c2_match_rules", _BASE + """ SELECT doi, array_to_string(am, ' & ') AS accept_matches,
    array_to_string(rm, ' & ') AS reject_matches FROM matched""")
def c2(spark, sf):
    e = V.evidence(spark, sf)
    return e.select("doi", F.array_join(S.match_rules("abstract", A), " & ").alias("accept_matches"),
                    F.array_join(S.match_rules("abstract", R), " & ").alias("reject_matches"))


@query("c3_type_gate", """SELECT '10.1/d' || doc_id AS doi, lang AS work_type, lang IN ('en','fr') AS type_ok FROM documents""")
def c3(spark, sf):
    return S.type_gate(V.evidence(spark, sf), ["en", "fr"]).select("doi", "work_type", "type_ok")


@query("c4_triage", _BASE + " SELECT outcome, count(*) AS n FROM triaged GROUP BY outcome")
def c4(spark, sf):
    e = V.evidence(spark, sf)
    return e.select(S.triage(S.match_rules("abstract", A), S.match_rules("abstract", R)).alias("outcome")).groupBy(
        "outcome").agg(F.count("*").alias("n"))


@query("c5_screen", _BASE + """,
    known AS (SELECT doi FROM labels_view WHERE source = 'human'),
    gone AS (SELECT doi FROM labels_view WHERE label = 'reject')
    SELECT doi, CASE WHEN doi IN (SELECT doi FROM known) OR doi IN (SELECT doi FROM gone) OR contains(doi, 'd99')
        THEN 'skipped' WHEN work_type NOT IN ('en', 'fr', 'de') THEN 'rejected' ELSE outcome END AS outcome FROM triaged""")
def c5(spark, sf):
    lab = V.labels(spark, sf)
    cands = V.evidence(spark, sf).select(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), "ord")
    out = S.screen(cands, V.works(spark, sf), lab.filter("source = 'human'"), lab.filter("label = 'reject'"),
                   A, R, accepted_types=["en", "fr", "de"], excluded=["D99"])
    return out.select("doi", "outcome")


@query("c5_screening_counts", _BASE + """,
    known AS (SELECT doi FROM labels_view WHERE source = 'human'),
    gone AS (SELECT doi FROM labels_view WHERE label = 'reject')
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doi IN (SELECT doi FROM known) OR doi IN (SELECT doi FROM gone) OR contains(doi, 'd99')
        THEN 'skipped' WHEN work_type NOT IN ('en', 'fr', 'de') THEN 'rejected' ELSE outcome END AS outcome FROM triaged) GROUP BY outcome""")
def c5_counts(spark, sf):
    return S.screening_counts(c5(spark, sf))


@query("f17_wilson_lower", f"""SELECT doc_id, round({_wilson('len(w)', 'n')}, 9) AS wilson,
    round(len(w) / n, 9) AS share FROM (SELECT doc_id, greatest(n_chars, 1) AS n,
    regexp_extract_all(text, 'e') AS w FROM documents)""")
def f17(spark, sf):
    d = V.table(spark, sf, "documents").select(
        "doc_id", F.greatest("n_chars", F.lit(1)).alias("n"), F.regexp_count("text", F.lit("e")).alias("w"))
    return d.select("doc_id", F.round(wilson_lower("w", "n"), 9).alias("wilson"), F.round(ratio("w", "n"), 9).alias("share"))


@query("a1_rule_diagnostics", _BASE + """,
  rules AS (SELECT * FROM (VALUES """ + ", ".join(
      f"('{side}', {i}, '{r}')" for side in ("accept", "reject") for i, r in enumerate(V._SQL_RULES[side], 1)) + """) v(side, rule_index, pattern)),
  lab AS (SELECT * FROM matched WHERE label IS NOT NULL)
  SELECT r.side, r.rule_index, r.pattern, count(l.doi) AS support, count(l.doi) FILTER (l.label = 'keep') AS keep,
    count(l.doi) FILTER (l.label = 'reject') AS reject,
    count(l.doi) FILTER (CASE WHEN r.side = 'accept' THEN len(am) ELSE len(rm) END = 1) AS unique_coverage,
    count(l.doi) FILTER (CASE WHEN r.side = 'accept' THEN len(rm) ELSE len(am) END > 0) AS opposite_conflicts,
    round(count(l.doi) FILTER (l.label = 'keep') / nullif(count(l.doi), 0), 9) AS keep_precision,
    round(count(l.doi) FILTER (l.label = 'reject') / nullif(count(l.doi), 0), 9) AS reject_precision
  FROM rules r LEFT JOIN lab l ON list_contains(CASE WHEN r.side = 'accept' THEN l.am ELSE l.rm END, r.pattern)
  GROUP BY ALL""")
def a1(spark, sf):
    m = _matched(spark, sf)
    parts = [M.rule_diagnostics(m, rules, side).withColumn("side", F.lit(side)) for side, rules in (("accept", A), ("reject", R))]
    return parts[0].unionByName(parts[1]).select(
        "side", "rule_index", "pattern", "support", "keep", "reject", "unique_coverage", "opposite_conflicts",
        *_r("keep_precision", "reject_precision"))


@query("a2_replay_metrics", _BASE + """,
  s AS (SELECT *, unnest(CASE WHEN source = 'human' THEN ['all', 'human'] ELSE ['all'] END) AS scope FROM triaged WHERE label IS NOT NULL)
  SELECT scope, count(*) AS labeled, count(*) FILTER (outcome='queued') AS auto_accept,
    count(*) FILTER (outcome='rejected') AS auto_reject, count(*) FILTER (outcome='review') AS manual_review,
    count(*) FILTER (len(am)>0 AND len(rm)>0) AS conflicts,
    count(*) FILTER (outcome='queued' AND label='reject') AS accept_false_positives,
    count(*) FILTER (outcome='rejected' AND label='keep') AS reject_false_negatives,
    round(count(*) FILTER (outcome='queued' AND label<>'reject') / nullif(count(*) FILTER (outcome='queued'),0), 9) AS accept_precision,
    round(count(*) FILTER (outcome='rejected' AND label<>'keep') / nullif(count(*) FILTER (outcome='rejected'),0), 9) AS reject_precision,
    round(count(*) FILTER (outcome IN ('queued','rejected')) / nullif(count(*),0), 9) AS automatic_coverage
  FROM s GROUP BY scope""")
def a2(spark, sf):
    m = M.replay_metrics(_matched(spark, sf))
    floats = ["accept_precision", "reject_precision", "automatic_coverage"]
    return m.select(*[c for c in m.columns if c not in floats], *_r(*floats))


@query("a2_replay_keys", _BASE + """
  SELECT doi, k AS kind FROM (SELECT doi, unnest([CASE WHEN outcome='queued' AND label='reject' THEN 'false_accept' END,
    CASE WHEN outcome='rejected' AND label='keep' THEN 'false_reject' END,
    CASE WHEN len(am)>0 AND len(rm)>0 THEN 'conflict' END]) AS k FROM triaged WHERE label IS NOT NULL) WHERE k IS NOT NULL""")
def a2_keys(spark, sf):
    return M.replay_keys(_matched(spark, sf)).select("doi", "kind")


@query("a3_evidence_summary", _BASE + """ SELECT count(*) AS evidence, count(label) AS labeled,
    count(*) FILTER (label='keep') AS keep, count(*) FILTER (label='reject') AS reject,
    count(*) FILTER (source='human') AS human_labeled, 0::BIGINT AS corrected_labeled,
    count(*) FILTER (label IS NULL) AS unresolved_evidence, count(DISTINCT batch_id) AS batches FROM matched""")
def a3(spark, sf):
    return M.evidence_summary(V.evidence(spark, sf), V.labels(spark, sf))


@query("a3_label_sources", V.with_("labels_view") + " SELECT source, count(*) AS n FROM labels_view GROUP BY source")
def a3_sources(spark, sf):
    return M.label_source_counts(V.labels(spark, sf))


@query("a5_phrase_counts", _MINING + """ SELECT phrase, keep, reject, review_keep, review_reject, human_keep, human_reject,
    batch_count, review_batch_count FROM counts WHERE keep + reject >= 2""")
def a5_counts(spark, sf):
    return M.phrase_counts(_labeled(spark, sf)).filter("keep + reject >= 2").drop("gap_human_keep", "gap_human_reject")


@query("a5_signals", _SIGNALS + """ SELECT direction, rank, phrase,
    review_support >= 6 AND rprec >= 0.95 AND rwl >= 0.6 AND review_batch_count >= 3 AS promotion_ready,
    support, keep, reject, round(prec, 9) AS precision, round(wl, 9) AS wilson_lower, round(prec / base, 9) AS lift,
    review_support, review_keep, review_reject, round(rprec, 9) AS review_precision, round(rwl, 9) AS review_wilson_lower,
    round(rprec / gbase, 9) AS review_lift, human_keep, human_reject, batch_count, review_batch_count FROM winners""")
def a5(spark, sf):
    s = M.signals(_labeled(spark, sf))
    floats = ["precision", "wilson_lower", "lift", "review_precision", "review_wilson_lower", "review_lift"]
    return s.select(*[c for c in s.columns if c not in floats], *_r(*floats))


@query("t1_top_signals", _SIGNALS + " SELECT direction, rank, phrase FROM winners WHERE rank <= 5")
def t1(spark, sf):
    return M.signals(_labeled(spark, sf), limit=5).select("direction", "rank", "phrase")


@query("t2_examples", _SIGNALS + """,
    hits AS (SELECT g.phrase, g.label, g.doi, row_number() OVER (PARTITION BY g.phrase, g.label ORDER BY g.ord) AS n
        FROM grams g WHERE g.phrase IN (SELECT phrase FROM winners))
    SELECT phrase, label, string_agg(doi, ',' ORDER BY n) AS dois FROM hits WHERE n <= 5 GROUP BY phrase, label""")
def t2(spark, sf):
    lab = _labeled(spark, sf)
    return M.examples(lab, M.signals(lab)).select("phrase", "label", F.array_join("dois", ",").alias("dois"))


_POOL = _MINING + """,
  pool AS (SELECT phrase, review_keep + review_reject AS support, review_keep, review_reject,
      greatest(abs(review_keep / (review_keep + review_reject) - gbk), abs(review_reject / (review_keep + review_reject) - gbr))
        * ln(1 + (review_keep + review_reject)) AS score
      FROM counts, rates WHERE review_keep + review_reject >= 2 ORDER BY round(score, 12) DESC, support DESC, phrase DESC LIMIT 80)"""


@query("t3_candidate_pool", _POOL + " SELECT phrase, support, review_keep, review_reject, round(score, 6) AS score FROM pool")
def t3(spark, sf):
    return M.candidate_pool(_labeled(spark, sf)).select("phrase", "support", "review_keep", "review_reject", *[
        F.round("score", 6).alias("score")])


_PAIRS = _POOL + f""",
  sel AS (SELECT g.doi, g.batch_id, g.label, g.source, g.gap, g.phrase FROM grams g WHERE g.phrase IN (SELECT phrase FROM pool)),
  pairs AS (SELECT a.batch_id, a.label, a.source, a.gap, a.phrase AS p1, b.phrase AS p2 FROM sel a JOIN sel b
      ON a.doi = b.doi AND a.phrase < b.phrase
      WHERE NOT contains(' ' || a.phrase || ' ', ' ' || b.phrase || ' ') AND NOT contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')),
  pb AS (SELECT p1, p2, batch_id, count(*) FILTER (label='keep') AS keep, count(*) FILTER (label='reject') AS reject,
      count(*) FILTER (gap AND label='keep') AS gk, count(*) FILTER (gap AND label='reject') AS gr,
      count(*) FILTER (gap AND source='human' AND label='keep') AS hk,
      count(*) FILTER (gap AND source='human' AND label='reject') AS hr FROM pairs GROUP BY 1, 2, 3),
  pp AS (SELECT p1, p2, sum(keep)::BIGINT AS keep, sum(reject)::BIGINT AS reject, sum(gk)::BIGINT AS gk, sum(gr)::BIGINT AS gr,
      sum(hk)::BIGINT AS human_keep, sum(hr)::BIGINT AS human_reject, count(*) AS batch_count,
      count(*) FILTER (gk + gr > 0) AS review_batch_count, count(*) FILTER (gk > 0 AND gr = 0) AS pure_k,
      count(*) FILTER (gr > 0 AND gk = 0) AS pure_r FROM pb GROUP BY 1, 2 HAVING sum(gk) + sum(gr) >= 3),
  pd AS (SELECT pp.*, 'accept' AS direction, pp.keep AS hit, gk AS ghit, gbk AS gbase, pure_k AS pure,
        a.review_keep / a.support AS fp, b.review_keep / b.support AS sp FROM pp, rates, pool a, pool b WHERE a.phrase = p1 AND b.phrase = p2
      UNION ALL SELECT pp.*, 'reject', pp.reject, gr, gbr, pure_r, a.review_reject / a.support, b.review_reject / b.support
        FROM pp, rates, pool a, pool b WHERE a.phrase = p1 AND b.phrase = p2),
  ps AS (SELECT *, ghit / (gk + gr) AS rprec, greatest(fp, sp) AS best, ghit / (gk + gr) - greatest(fp, sp) AS gain,
      coalesce(pure / nullif(review_batch_count, 0), 0) AS agree, {_wilson('ghit', 'gk + gr')} AS rwl,
      hit / (keep + reject) AS prec, {_wilson('hit', 'keep + reject')} AS wl FROM pd),
  pf AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY gain DESC, rwl DESC, gk + gr DESC, agree DESC, p1 DESC, p2 DESC) AS cut
      FROM ps WHERE rprec > gbase AND gain >= 0.1 AND review_batch_count >= 2 AND agree >= 0.75),
  pr AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY gain DESC, rwl DESC, gk + gr DESC, agree DESC, wl DESC,
      keep + reject DESC, p1 DESC, p2 DESC) AS rank FROM pf WHERE cut <= 100),
  won AS (SELECT DISTINCT p1, p2 FROM pr WHERE rank <= 20),
  hit AS (SELECT w.p1, w.p2, a.doi, a.ord, a.label, a.gap FROM won w JOIN grams a ON a.phrase = w.p1 JOIN grams b ON b.phrase = w.p2 AND b.doi = a.doi),
  ex AS (SELECT p1, p2, label, 'all' AS scope, doi, row_number() OVER (PARTITION BY p1, p2, label ORDER BY ord) AS n FROM hit
      UNION ALL SELECT p1, p2, label, 'gap', doi, row_number() OVER (PARTITION BY p1, p2, label ORDER BY ord) FROM hit WHERE gap),
  el AS (SELECT p1, p2, scope, coalesce(string_agg(doi, ',' ORDER BY n) FILTER (label = 'keep'), '') AS k,
      coalesce(string_agg(doi, ',' ORDER BY n) FILTER (label = 'reject'), '') AS r FROM ex WHERE n <= 5 GROUP BY p1, p2, scope)"""


@query("a6_pair_signals", _PAIRS + r""" SELECT direction, rank, pr.p1 AS first, pr.p2 AS second,
    '(?is)(?=.*\b' || regexp_replace(pr.p1, '[- ]+', '[-\\s]+', 'g') || '\b)(?=.*\b' || regexp_replace(pr.p2, '[- ]+', '[-\\s]+', 'g') || '\b)' AS regex,
    gk + gr >= 6 AND rprec >= 0.95 AND rwl >= 0.6 AND review_batch_count >= 3 AS promotion_ready,
    gk + gr AS review_support, gk AS review_keep, gr AS review_reject, round(rprec, 9) AS review_precision,
    round(rwl, 9) AS review_wilson_lower, review_batch_count, round(agree, 9) AS review_batch_agreement,
    round(fp, 9) AS first_review_precision, round(sp, 9) AS second_review_precision,
    round(best, 9) AS best_single_review_precision, round(gain, 9) AS review_precision_gain, human_keep, human_reject,
    keep + reject AS support, keep, reject, round(prec, 9) AS precision, round(wl, 9) AS wilson_lower, batch_count,
    CASE direction WHEN 'accept' THEN e.k ELSE e.r END AS supporting_dois, CASE direction WHEN 'accept' THEN e.r ELSE e.k END AS contradicting_dois,
    CASE direction WHEN 'accept' THEN g.k ELSE g.r END AS review_supporting_dois, CASE direction WHEN 'accept' THEN g.r ELSE g.k END AS review_contradicting_dois
    FROM pr JOIN el e ON e.p1 = pr.p1 AND e.p2 = pr.p2 AND e.scope = 'all' JOIN el g ON g.p1 = pr.p1 AND g.p2 = pr.p2 AND g.scope = 'gap' WHERE rank <= 20""")
def a6(spark, sf):
    s = M.pair_signals(_labeled(spark, sf))
    floats = [f.name for f in s.schema if f.dataType.typeName() == "double"]
    lists = [f.name for f in s.schema if f.dataType.typeName() == "array"]
    return s.select(*[c for c in s.columns if c not in floats + lists], *[F.array_join(c, ",").alias(c) for c in lists], *_r(*floats))


@query("f16_phrase_regex", _SIGNALS + r""" SELECT phrase, regexp_replace(phrase, '[- ]+', '[-\\s]+', 'g') AS regex FROM winners""")
def f16(spark, sf):
    return M.signals(_labeled(spark, sf)).select("phrase", M.phrase_regex("phrase").alias("regex"))


@query("w4_rescreen", _BASE + """
  SELECT doi, CASE WHEN work_type = 'en' THEN 'queued' ELSE 'review' END AS previous, outcome AS proposed FROM triaged
  WHERE coalesce(source, '') <> 'human' AND CASE WHEN work_type = 'en' THEN 'queued' ELSE 'review' END <> outcome""")
def w4(spark, sf):
    human = V.labels(spark, sf).filter("source = 'human'").select("doi", F.col("label").alias("human_decision"))
    ev = V.evidence(spark, sf).withColumn(
        "screening_outcome", F.when(F.col("work_type") == "en", "queued").otherwise("review")).join(human, "doi", "left")
    return S.rescreen(ev, V.works(spark, sf), A, R).select("doi", "previous", "proposed")
