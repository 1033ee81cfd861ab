"""Ordered changes of state and slug allocation against step-by-step versions."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import authors as AUT, ranking as RK, state as ST

FLAGS = ("canonical", "queued", "review", "rejected", "staged")


def _step(s, kind, d):
    if d not in ("keep", "reject"):
        return "unknown decision"
    if kind == "review":
        return "not in review" if not s["review"] else "incompatible state" if s["queued"] or s["rejected"] else "first decision"
    flying = s["queued"] or s["staged"]
    if s["superseded_by"]:
        return "superseded"
    if not (s["evidence"] or s["outcome"] or any(s[f] for f in FLAGS)):
        return "unknown key"
    if s["canonical"] and s["rejected"]:
        return "canonical and rejected"
    if s["review"]:
        return "incompatible state" if s["canonical"] or flying or s["rejected"] else "first decision"
    if d == "keep" and (s["canonical"] or flying) or d == "reject" and s["rejected"] and not s["staged"]:
        return "no-op"
    return "correct" if s["evidence"] else "evidence required"


def _apply(s, step, d):
    if step not in ("first decision", "correct"):
        return
    if step == "correct":
        s["correction_decision"] = d
    elif s["evidence"]:
        s["human_decision"] = d
    s |= {"review": False, "queued": d == "keep", "rejected": d == "reject"}
    if d == "reject":
        s |= {"canonical": False, "staged": False}
    if s["outcome"]:
        s["outcome"] = "queued" if d == "keep" else "rejected"
        if d == "reject" and s["item_state"] == "active":
            s["item_state"] = "completed"


def test_folded_changes_equal_single_steps(spark):
    rng, keys = random.Random(6), [f"k{i}" for i in range(300)]
    state = {k: {f: rng.random() < 0.3 for f in FLAGS} | {
        "evidence": rng.random() < 0.7, "superseded_by": rng.choice([None] * 6 + ["z"]), "human_decision": None, "correction_decision": None,
        "outcome": rng.choice([None, "review", "queued"]), "item_state": rng.choice([None, "active", "completed"]), "detail": None} for k in keys}
    log = [(k, n, rng.choice(["review", "correction"]), rng.choice(["keep", "reject", " Keep ", "perhaps"])) for k in keys + ["unknown"] for n in range(rng.randint(0, 5))]
    log += [("unknown", 9, "correction", "keep")]
    kinds = "doi string, " + ", ".join(f"{f} boolean" for f in (*FLAGS, "evidence")) + ", superseded_by string, human_decision string, correction_decision string, outcome string, item_state string, detail string"
    names = [f.split(" ")[0] for f in kinds.split(", ")]
    df = spark.createDataFrame([tuple([k] + [s[n] for n in names[1:]]) for k, s in state.items()], kinds)
    shuffled = rng.sample(log, len(log))
    after, results = ST.fold_changes(df, spark.createDataFrame(shuffled, "doi string, seq int, kind string, decision string"))
    want, blank = {}, {n: None for n in names[1:]} | {f: False for f in (*FLAGS, "evidence")}
    for k, n, kind, d in sorted(log, key=lambda r: (r[0], r[1])):
        s = state.get(k, dict(blank))
        want[k, n] = _step(s, kind, d.strip().lower())
        _apply(s, want[k, n], d.strip().lower())
    assert {(r["doi"], r["seq"]): r["step"] for r in results.collect()} == want
    assert {r["doi"]: {n: r[n] for n in names[1:]} for r in after.collect()} == state


def test_after_effects(spark):
    before = spark.createDataFrame([("10.1/a", True, None, None), ("b", False, "review", "active"), ("c", False, "review", "active"), ("d", False, "review", "completed")],
                                   "doi string, canonical boolean, outcome string, item_state string").withColumn("detail", F.lit(""))
    after = before.withColumn("canonical", F.lit(False)).withColumn("item_state", F.when(F.col("doi") == "b", "completed").otherwise(F.col("item_state"))).withColumn(
        "outcome", F.when(F.col("doi") == "b", "rejected").otherwise(F.col("outcome")))
    pubs = spark.createDataFrame([("10.1/a", "1", 0, 0), ("10.1/x", "2", 0, 1), (None, "00000000-0000-4000-8000-000000000003", 0, 2)], "doi string, id string, side int, ord int")
    batches = spark.createDataFrame([(1, "b", False), (2, "c", False), (3, "d", False), (4, "b", True)], "batch_no int, key string, closed boolean")
    out = ST.follow_up(before, after, pubs, batches)
    assert sorted(r["token"] for r in out["registry"].collect()) == ["doi:10.1/x", "id:00000000-0000-4000-8000-000000000003"] and out["publications"].count() == 2
    assert [tuple(r) for r in out["report"].collect()] == [("b", "rejected")] and [tuple(r) for r in out["items"].collect()] == [("b", "completed", "")]
    assert [r[0] for r in out["closed_batches"].collect()] == [1]


def _sequential(rows, used):
    taken, out = {}, {}
    for root, z in used:
        taken.setdefault(root, set()).add(z)
    nxt = {}
    for i, root, _, z in sorted(rows, key=lambda r: r[2]):
        own, jump = taken.setdefault(root, set()), nxt.setdefault(root, {})
        path = []
        while z in own:
            path.append(z)
            z = jump.get(z, z + 1)
        own.add(z)
        for p in path:
            jump[p] = z + 1
        out[i] = z
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_allocation_of_mixed_zeros(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"r{rng.choice([0, 0, 0, 1, 2, 3, 4, 5])}", i * 7 % 331, rng.choice([0, 0, 0, 1, 2, 5, 40])) for i in range(331)]
    used = {(f"r{rng.randint(0, 6)}", rng.choice([rng.randint(0, 60), rng.randint(0, 9)])) for _ in range(90)}
    kind = "root string, zeros long"
    got = AUT.allocate_zeros(spark.createDataFrame(rows, "id int, root string, ord int, zeros long"), spark.createDataFrame(list(used), kind))
    assert {r["id"]: r["place"] for r in got.collect()} == _sequential(rows, used)


def test_crowded_root_takes_many_tasks(spark):
    rng, n = random.Random(4), 100_000
    rows = [(i, "root" if i % 50 else "other", i, rng.choice([0, 0, 1, 3, 500])) for i in range(n)]
    used = [("root", z) for z in rng.sample(range(150_000), 30_000)]
    df = spark.createDataFrame(rows, "id int, root string, ord int, zeros long").repartition(4)
    got = AUT.allocate_zeros(df, spark.createDataFrame(used, "root string, zeros long"))
    assert {r["id"]: r["place"] for r in got.collect()} == _sequential(rows, used)
    dealt = RK.numbered(df.filter("root = 'root'"), ["root"], [F.asc("ord")], "k")
    assert dealt.agg(F.max("k")).first()[0] == n - n // 50
    parts = spark.read.parquet(*[f for f in dealt.inputFiles() if "/numbered-" in f]).groupBy("_range").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < n // 2
