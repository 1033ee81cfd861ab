"""Connected components by random contraction, shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.session import stored

MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges(a, b)``: ``node``, ``component``.

    ``component`` is the smallest node of the component. Null ends, self loops and repeated
    edges are allowed and ignored; an empty table gives an empty result. Nodes without an edge
    to another node don't appear.

    Each round lets every node join its neighbour of least random rank (or stay, if its own is
    least) and contracts the graph, which leaves a constant share of the nodes whatever the
    shape, so a chain takes a logarithmic number of rounds. All rounds are joins and combinable
    aggregates; each is written to the shared folder.
    """
    kind = edges.schema["a"].dataType
    left = stored(_tidy(edges.select(F.col("a").cast(kind), F.col("b").cast(kind))), "edges")
    steps: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        step = stored(best.select(
            F.col("a").alias("node"),
            F.when(F.struct(rank("a").alias("r"), F.col("a").alias("to")) < F.col("m"), F.col("a")).otherwise(F.col("m.to")).alias("to")), "step")
        steps.append(step)
        ends = (left.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
                .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b"))
        left = stored(_tidy(ends.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
    else:
        raise RuntimeError("contraction did not end")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("to").alias("then"))
        out = step.join(later, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    out = stored(out, "roots")
    least = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(least, "to").select("node", "component")


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller end first, without self loops."""
    return (edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
