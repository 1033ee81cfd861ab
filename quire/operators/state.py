"""State transitions of keys between the queue tables, driven by a membership table.

Membership rows (``sets.state_membership``) hold the key and one boolean per state:
canonical, queued, review, rejected, staged, plus optional evidence and alias flags. A
transition table ``(doi, remove_from array, add_to)`` describes what changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.operators.merge import registry
from quire.operators.screening import match_rules, relevance_text
from quire.session import cut_lineage


def with_current_decision(membership: DataFrame) -> DataFrame:
    """Add the decision a key's state stands for: keep, reject or null."""
    c, r = F.col("canonical"), F.col("rejected")
    return membership.withColumn("current_decision", F.when(c & ~r, "keep").when(r & ~c, "reject"))


def _decided(membership: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.select("doi", F.lower(F.trim("decision")).alias("decision"))
    flags = [c for c in membership.columns if c != "doi"]
    return d.join(membership, "doi", "left").select(
        "doi", "decision", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags])


def apply_review(membership: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First human decisions: keep moves review to queued, reject moves it to rejected."""
    rows = _decided(membership, decisions).withColumn(
        "problem",
        F.when(~F.col("decision").isin("keep", "reject"), "unknown decision")
        .when(~F.col("review"), "not in review")
        .when(F.col("queued") | F.col("rejected"), "incompatible state"),
    )
    moves = rows.filter("problem IS NULL").select(
        "doi", "decision", F.array(F.lit("review")).alias("remove_from"),
        F.when(F.col("decision") == "keep", "queued").otherwise("rejected").alias("add_to"),
        F.lit("human").alias("record_as"))
    return moves, rows.filter("problem IS NOT NULL").select("doi", "decision", "problem")


def correct_relevance(membership: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corrections of earlier decisions: ``(moves, no_ops, violations)``.

    A key still in review gets an ordinary first decision. A keep takes a rejected key back
    to the queue; a reject takes it out of canon, queue and staging.
    """
    rows = _decided(with_current_decision(membership).withColumn(
        "current_keep", F.coalesce(F.col("current_decision") == "keep", F.lit(False))).withColumn(
        "current_reject", F.coalesce(F.col("current_decision") == "reject", F.lit(False))).drop("current_decision"), changes)
    c, q, v, r, s = (F.col(x) for x in ("canonical", "queued", "review", "rejected", "staged"))
    keep = F.col("decision") == "keep"
    noop = (keep & (F.col("current_keep") | q | s)) | (~keep & F.col("current_reject") & ~s)
    rows = rows.withColumn("step", F.when(F.col("alias"), "superseded")
        .when(~F.col("decision").isin("keep", "reject"), "unknown decision")
        .when(~(c | q | v | r | s | F.col("evidence")), "unknown key")
        .when(c & r, "canonical and rejected")
        .when(v & (c | q | r | s), "incompatible state")
        .when(v, "first decision")
        .when(noop, "no-op")
        .when(~F.col("evidence"), "evidence required")
        .otherwise("correct"))
    reject_from = F.array_compact(F.array(
        F.when(c, F.lit("canonical")), F.when(q, F.lit("queued")), F.when(s, F.lit("staged"))))
    moves = rows.filter("step IN ('first decision', 'correct')").select(
        "doi", "decision",
        F.when(v, F.array(F.lit("review"))).when(keep, F.array(F.lit("rejected"))).otherwise(reject_from).alias("remove_from"),
        F.when(keep, "queued").otherwise("rejected").alias("add_to"),
        F.when(v, "human").otherwise("correction").alias("record_as"))
    bad = ~F.col("step").isin("first decision", "correct", "no-op")
    return moves, rows.filter("step = 'no-op'").select("doi", "decision"), rows.filter(bad).select(
        "doi", "decision", F.col("step").alias("problem"))


def replace_keys(membership: DataFrame, resolved: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed replacements ``(src, dst)``: ``(moves, violations)``.

    The source leaves queue, review and staging; the replacement joins the queue unless it
    is canonical, queued or staged. ``resolved`` is the current alias table.
    """
    ends = resolved.select(F.col("src").alias("dst"), "terminal")
    rows = changes.select("src", "dst").join(ends, "dst", "left").withColumn("dst", F.coalesce("terminal", "dst")).drop("terminal")
    flags = [c for c in membership.columns if c != "doi"]
    for key in ("src", "dst"):
        side = membership.select(F.col("doi").alias(key), F.struct(*flags).alias(f"{key}_in"), F.lit(True).alias(f"{key}_known"))
        rows = rows.join(side, key, "left")
    has = lambda k, f: F.coalesce(F.col(f"{k}_in.{f}"), F.lit(False))
    rows = rows.withColumn("problem", F.when(F.col("src") == F.col("dst"), "self")
        .when(has("src", "canonical"), "source canonical").when(has("src", "rejected"), "source rejected")
        .when(F.col("src_known").isNull(), "unknown source")
        .when(has("dst", "rejected"), "replacement rejected").when(has("dst", "review"), "replacement in review"))
    ok = rows.filter("problem IS NULL")
    leaves = F.array_compact(F.array(*[F.when(has("src", f), F.lit(f)) for f in ("queued", "review", "staged")]))
    out = ok.select(F.col("src").alias("doi"), leaves.alias("remove_from"), F.lit(None).cast("string").alias("add_to"), "dst")
    joins = ok.filter(~(has("dst", "canonical") | has("dst", "queued") | has("dst", "staged"))).select(
        F.col("dst").alias("doi"), F.array().cast("array<string>").alias("remove_from"), F.lit("queued").alias("add_to"),
        F.lit(None).cast("string").alias("dst")).distinct()
    return out.unionByName(joins), rows.filter("problem IS NOT NULL").select("src", "dst", "problem")


def apply_moves(membership: DataFrame, moves: DataFrame) -> DataFrame:
    """Membership after the moves; keys that are new enter it."""
    flags = [c for c in membership.columns if c != "doi"]
    m = moves.select("doi", "remove_from", "add_to")
    after = membership.join(m, "doi", "full")
    cols = []
    for f in flags:
        held = F.coalesce(F.col(f), F.lit(False))
        drop = F.coalesce(F.array_contains("remove_from", f), F.lit(False))
        cols.append(((held & ~drop) | F.coalesce(F.col("add_to") == f, F.lit(False))).alias(f))
    return after.select("doi", *cols)


# -- ordered changes and what follows from them ------------------------------------------

_FLAGS = ("canonical", "queued", "review", "rejected", "staged")
_CONTEXT = {"human_decision": "string", "correction_decision": "string", "outcome": "string", "item_state": "string", "detail": "string"}


def change_state(membership: DataFrame, evidence: DataFrame, report: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per key with all that a change of its relevance may touch.

    ``membership`` has the state flags; ``evidence``: doi, human_decision, correction_decision;
    ``report``: doi, outcome; ``items``: key, state, detail of the work ledger; ``aliases``: src, terminal.
    """
    rows = membership.select("doi", *_FLAGS).join(evidence.select("doi", "human_decision", "correction_decision", F.lit(True).alias("evidence")), "doi", "full")
    rows = rows.join(report.select("doi", "outcome"), "doi", "full")
    rows = rows.join(items.select(F.col("key").alias("doi"), F.col("state").alias("item_state"), "detail"), "doi", "full")
    rows = rows.join(aliases.select(F.col("src").alias("doi"), F.col("terminal").alias("superseded_by")), "doi", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.select("doi", *[no(c) for c in (*_FLAGS, "evidence")], "superseded_by", *_CONTEXT)


def _step(s: Column, kind: Column, decision: Column) -> Column:
    """What one change does to a key in state ``s``: ``first decision``, ``correct``, ``no-op``, or why it is refused."""
    keep = decision == "keep"
    flying = s["queued"] | s["staged"]
    decided_keep, decided_reject = s["canonical"] & ~s["rejected"], s["rejected"] & ~s["canonical"]
    known = s["evidence"] | s["outcome"].isNotNull()
    for flag in _FLAGS:
        known = known | s[flag]
    human = F.when(~s["review"], "not in review").when(s["queued"] | s["rejected"], "incompatible state").otherwise("first decision")
    correction = (
        F.when(s["superseded_by"].isNotNull(), "superseded").when(~known, "unknown key").when(s["canonical"] & s["rejected"], "canonical and rejected")
        .when(s["review"], F.when(s["canonical"] | flying | s["rejected"], "incompatible state").otherwise("first decision"))
        .when((keep & (decided_keep | flying)) | (~keep & decided_reject & ~s["staged"]), "no-op")
        .when(~s["evidence"], "evidence required").otherwise("correct"))
    return F.when(~F.coalesce(decision.isin("keep", "reject"), F.lit(False)), "unknown decision").when(kind == "review", human).when(
        kind == "correction", correction).otherwise("unknown kind")


def _after(s: Column, step: Column, decision: Column) -> Column:
    """State of a key after a change of that step."""
    done, keep, first = step.isin("first decision", "correct"), decision == "keep", step == "first decision"
    moved = {
        "canonical": s["canonical"] & ~(done & ~keep), "staged": s["staged"] & ~(done & ~keep), "review": s["review"] & ~done,
        "queued": F.when(done, keep).otherwise(s["queued"]), "rejected": F.when(done, ~keep).otherwise(s["rejected"]),
        "human_decision": F.when(first & s["evidence"], decision).otherwise(s["human_decision"]),
        "correction_decision": F.when(step == "correct", decision).otherwise(s["correction_decision"]),
        "outcome": F.when(done & s["outcome"].isNotNull(), F.when(keep, "queued").otherwise("rejected")).otherwise(s["outcome"]),
        "item_state": F.when(done & ~keep & s["outcome"].isNotNull() & (s["item_state"] == "active"), "completed").otherwise(s["item_state"]),
    }
    kept = {c: s[c] for c in (*_FLAGS, "evidence", "superseded_by", *_CONTEXT)}
    return F.struct(*[c.alias(n) for n, c in (kept | moved).items()])


def fold_changes(state: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply an ordered log of decisions: ``(state after, results)``.

    ``log``: doi, seq, kind (review or correction), decision. The changes of one key are folded in
    their order, each judged by the state that the one before left; keys do not touch one another.
    ``results``: doi, seq, kind, decision, step. ``state`` is what ``change_state`` gives; keys that
    only the log knows come out in the results alone.
    """
    change = F.struct("seq", "kind", F.lower(F.trim("decision")).alias("decision"))
    changes = log.groupBy("doi").agg(F.sort_array(F.collect_list(change)).alias("changes"))
    columns = [c for c in state.columns if c != "doi"]
    rows = changes.join(state.withColumn("_there", F.lit(True)), "doi", "full")
    now = F.struct(*[(F.coalesce(F.col(c), F.lit(False)) if c in (*_FLAGS, "evidence") else F.col(c)).alias(c) for c in columns])
    result = "array<struct<seq:bigint,kind:string,decision:string,step:string>>"

    def fold(acc: Column, c: Column) -> Column:
        step = _step(acc["state"], c["kind"], c["decision"])
        entry = F.struct(c["seq"].cast("bigint").alias("seq"), c["kind"].alias("kind"), c["decision"].alias("decision"), step.alias("step"))
        return F.struct(_after(acc["state"], step, c["decision"]).alias("state"), F.concat(acc["results"], F.array(entry)).alias("results"))

    kinds = ", ".join([f"{f.name}: {f.dataType.simpleString()}" for f in state.schema if f.name != "doi"])
    start = F.struct(now.cast(f"struct<{kinds}>").alias("state"), F.array().cast(result).alias("results"))
    folded = rows.select("doi", F.col("_there").isNotNull().alias("_there"), F.aggregate(F.coalesce("changes", F.array()), start, fold).alias("f"))
    folded = cut_lineage(folded)
    return folded.filter("_there").select("doi", "f.state.*"), folded.select("doi", F.explode("f.results").alias("r")).select("doi", "r.*")


def supersede(state: DataFrame, moves: DataFrame) -> DataFrame:
    """State after reviewed replacements (``replace_keys``): the source leaves its queues, its report entry is skipped and an active item is completed."""
    gone = moves.filter("dst IS NOT NULL").select("doi", F.col("dst").alias("_dst"))
    come = moves.filter("dst IS NULL").select("doi", F.lit(True).alias("_joins"))
    rows = state.join(gone, "doi", "left").join(come, "doi", "full")
    out, joins = F.col("_dst").isNotNull(), F.col("_joins").isNotNull()
    held = lambda c: F.coalesce(F.col(c), F.lit(False))
    cols = {c: held(c) & ~out if c in ("queued", "review", "staged") else held(c) for c in (*_FLAGS, "evidence")}
    cols |= {"queued": cols["queued"] | joins, "superseded_by": F.coalesce("_dst", "superseded_by"),
             "outcome": F.when(out & F.col("outcome").isNotNull(), "skipped").otherwise(F.col("outcome")),
             "detail": F.when(out & (F.col("item_state") == "active"), F.concat(F.lit("superseded by "), "_dst")).otherwise(F.col("detail")),
             "item_state": F.when(out & (F.col("item_state") == "active"), "completed").otherwise(F.col("item_state"))}
    return rows.select("doi", *[cols.get(c, F.col(c)).alias(c) for c in state.columns if c != "doi"])


def follow_up(before: DataFrame, after: DataFrame, pubs: DataFrame, batches: DataFrame) -> dict[str, DataFrame]:
    """Every table that follows from a changed state.

    ``pubs``: publications with doi, id, side, ord; those whose key left the canon go, and the registry is
    made anew. ``batches``: batch_no, key, closed; an open batch closes when one of its items was
    completed by the change and none is active any more. ``report`` and ``items`` hold changed rows only.
    """
    left = before.filter("canonical").select("doi").join(after.filter("NOT canonical").select("doi"), "doi", "left_semi")
    kept = pubs.filter("doi IS NULL").unionByName(pubs.filter("doi IS NOT NULL").join(left, "doi", "left_anti").select(*pubs.columns))
    old = before.select("doi", F.col("outcome").alias("_o"), F.col("item_state").alias("_s"), F.col("detail").alias("_d"))
    both = after.join(old, "doi", "left")
    changed = lambda new, was: ~F.col(new).eqNullSafe(F.col(was))
    items = both.filter(F.col("item_state").isNotNull() & (changed("item_state", "_s") | changed("detail", "_d")))
    work = batches.filter("NOT closed").join(both.select(F.col("doi").alias("key"), "item_state", changed("item_state", "_s").alias("_moved")), "key", "left")
    closing = work.groupBy("batch_no").agg(F.count_if(F.col("item_state") == "active").alias("active"), F.bool_or("_moved").alias("moved")).filter("active = 0 AND moved")
    return {
        "publications": kept,
        "registry": registry(kept),
        "report": both.filter(F.col("outcome").isNotNull() & changed("outcome", "_o")).select("doi", "outcome"),
        "items": items.select(F.col("doi").alias("key"), F.col("item_state").alias("state"), "detail"),
        "closed_batches": closing.select("batch_no"),
    }


def review_cases(review: DataFrame, works: DataFrame, context: DataFrame, accept: list[str], reject: list[str]) -> DataFrame:
    """Every key in review with provider text, matched rules, availability and work context."""
    rows = review.select("doi", "ord").join(works.withColumn("_found", F.lit(True)), "doi", "left").join(
        context.select("doi", "batch_id", "attempt"), "doi", "left")
    text = F.coalesce(relevance_text("title", "abstract", "keywords"), F.lit(""))
    return rows.withColumn("_text", text).select(
        "doi", "ord", "title", "work_type", "abstract", F.col("_found").isNotNull().alias("metadata_available"),
        match_rules("_text", accept).alias("accept_matches"), match_rules("_text", reject).alias("reject_matches"),
        "batch_id", "attempt")


def init_status(items: DataFrame, membership: DataFrame, report: DataFrame) -> DataFrame:
    """One row of progress counts of an initial load.

    ``items``: key, state. ``report``: doi, outcome.
    """
    rows = (
        items.select(F.col("key").alias("doi"), "state")
        .join(membership, "doi", "left")
        .join(report.select("doi", "outcome"), "doi", "left")
    )
    on = lambda f: F.coalesce(F.col(f), F.lit(False))
    state, outcome = F.col("state"), F.col("outcome")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if((state == "pending") | ((state == "active") & outcome.isNull())).alias("unscreened"),
        F.count_if(on("queued") & ~on("staged") & ~on("canonical")).alias("queued"),
        F.count_if(on("review")).alias("review"),
        F.count_if(on("staged") & ~on("canonical")).alias("staged"),
        F.count_if(on("canonical")).alias("merged"),
        F.count_if(on("rejected")).alias("rejected"),
        F.count_if(outcome == "skipped").alias("skipped"),
    )
