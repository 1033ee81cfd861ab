"""Near-equal embeddings by NN-descent.

Vectors sorted by random hyperplane codes give each a first neighbour list; rounds of local joins
let the neighbours of a vector, and the neighbours of those that point at it, meet. Short lists cannot hold the
links of a large group: vectors whose list is full of links get a second list of the nearest in other
components, which is renewed until it joins no more of them, and in the end each list is enlarged to its
component, block by block. Recall is audited against brute force on a sample, full lists included, and
further rounds follow while it is too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.graph import connected_components
from quire.session import stored

THRESHOLD = 0.98
NEIGHBOURS = 8
TABLES = 12
BITS = 24
BLOCK = 64
ROUNDS = 2
#: Rounds after which a recall below the bound is an error.
MOST_ROUNDS = 20
#: Vectors of the recall audit; compared with all others.
AUDIT = 200
MIN_RECALL = 0.995
#: Members of a block when a component is compared in full.
WIDE_BLOCK = 256


def usable(embedding: Column, label: Column) -> Column:
    """Whether a vector takes part: label and components known, components finite, length not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False), len(column))


def _codes(tables: int, seed: int):
    """Codes of each vector in each table: the signs of ``BITS`` random projections, and the first projection itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                batch = whole.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * (BITS + 1)))
                seen = (_matrix(batch.column("embedding")) @ planes[dim]).reshape(batch.num_rows, tables, BITS + 1)
                code = (seen[:, :, :BITS] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                index = np.repeat(np.arange(batch.num_rows), tables)
                cols = [batch.column(c).take(pa.array(index)) for c in ("cid", "label", "dim", "embedding", "part")]
                cols += [pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(code.ravel()), pa.array(seen[:, :, BITS].ravel())]
                yield pa.RecordBatch.from_arrays(cols, names=["cid", "label", "dim", "embedding", "part", "t", "code", "along"])
    return run


def _best(ids: np.ndarray, x: np.ndarray, part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``most`` nearest of other parts: arrays of row id, other id and cosine."""
    s = x @ x.T
    s[part[:, None] == part[None, :]] = -2.0
    k = min(most, len(ids) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-s, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    near = near.ravel()
    cos = s[rows, near]
    met = cos > -1.5
    return ids[rows[met]], ids[near[met]], cos[met]


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate(c) if parts else np.empty(0, t) for c, t in zip(zip(*parts) if parts else ((), (), ()), (np.int64, np.int64, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "v", "cos"])


def _in_blocks(most: int):
    """Nearest others inside overlapping blocks of rows that follow each other in the order of codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "label", "dim")], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [batch.num_rows]))
            ids, part, parts = batch.column("cid").to_numpy(), batch.column("part").to_numpy(), []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if end - begin < 2:
                    continue
                x = _matrix(batch.column("embedding").slice(begin, end - begin))
                for at in range(0, max(1, end - begin - BLOCK // 2), BLOCK // 2):
                    own = slice(at, min(at + BLOCK, end - begin))
                    if own.stop - own.start > 1:
                        parts.append(_best(ids[begin:end][own], x[own], part[begin:end][own], most))
            yield _edges(parts)
    return run


def _lists(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest of each ``u``: array of ``(cos, v)``, nearest first."""
    entry = F.struct((-F.col("cos")).alias("far"), "v")
    return edges.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, most).alias("n"))


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode("n").alias("e")).select("u", F.col("e.v").alias("v"), (-F.col("e.far")).alias("cos"))


def _local_join(vectors: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Edges between different parts found among each vector's neighbours ``edges(u, v)`` and those it is a neighbour of.

    Those that point at a vector are dealt into chunks of about a list's length, each of which meets
    the whole list, so a vector that many point at makes many small groups.
    """
    forward = edges.select("u", "v")
    back = forward.select(F.col("v").alias("u"), F.col("u").alias("v"))
    chunks = back.groupBy("u").agg(F.ceil(F.count("*") / NEIGHBOURS).cast("int").alias("chunks"))
    met = forward.join(chunks, "u", "left").select("u", "v", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("c"))
    back = back.join(chunks, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("c"))
    groups = met.unionByName(back).distinct().join(vectors.select(F.col("cid").alias("v"), "part", "embedding"), "v")
    groups = groups.groupBy("u", "c").agg(F.collect_list(F.struct("v", "part", "embedding")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("m")
            offsets, flat = column.offsets.to_numpy(), column.flatten()
            ids, part, parts = flat.field("v").to_numpy(), flat.field("part").to_numpy(), []
            start = offsets[0]
            for a, b in zip(offsets[:-1] - start, offsets[1:] - start):
                if b - a > 1:
                    parts.append(_best(ids[a:b], _matrix(flat.field("embedding").slice(a, b - a)), part[a:b], most))
            yield _edges(parts)

    return groups.select("m").mapInArrow(run, "u long, v long, cos double")


def _audit(vectors: DataFrame, threshold: float, turn: int) -> float:
    """Share of the links of a sample whose ends are in one part; inside a part all links are counted later."""
    sample = vectors.orderBy(F.xxhash64("cid", F.lit(turn))).limit(AUDIT)
    probe = F.broadcast(stored(sample.select(F.col("cid").alias("q"), F.col("label").alias("ql"), F.col("dim").alias("qd"), F.col("part").alias("qp"), F.col("embedding").alias("qe")), "audit"))
    met = vectors.join(probe, (F.col("label") == F.col("ql")) & (F.col("dim") == F.col("qd")) & (F.col("cid") != F.col("q")))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = product(F.col("embedding"), F.col("qe")) / F.sqrt(product(F.col("embedding"), F.col("embedding")) * product(F.col("qe"), F.col("qe")))
    found = met.where(cos >= threshold).agg(F.count("*").alias("n"), F.count_if(F.col("part") == F.col("qp")).alias("k")).first()
    return found["k"] / found["n"] if found["n"] else 1.0


def _first(vectors: DataFrame, seed: int) -> DataFrame:
    """Edges between different parts among vectors that follow each other in the order of codes."""
    slots = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coded = vectors.mapInArrow(_codes(TABLES, seed), "cid long, label int, dim int, embedding array<float>, part long, t int, code long, along double")
    order = ["t", "label", "dim", "code", "along", "cid"]
    return coded.repartitionByRange(slots, *order).sortWithinPartitions(*order).mapInArrow(_in_blocks(4), "u long, v long, cos double")


def _between(full: DataFrame, edges: DataFrame, neighbours: int, rounds: int, seed: int) -> DataFrame:
    """Edges from the vectors ``full`` to their nearest of other parts, by descent along these and their own lists ``edges``."""
    lists = stored(_lists(_first(full, seed), neighbours), "others")
    for _ in range(rounds):
        more = _local_join(full, edges.unionByName(_flat(lists)), neighbours)
        lists = stored(_lists(_flat(lists).unionByName(more), neighbours), "others")
    return _flat(lists)


def neighbour_graph(vectors: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """``(parts, recall)`` of ``vectors(cid, label, dim, embedding)``.

    ``parts(cid, component)`` holds every vector that has a link, a cosine at the threshold or above.
    Vectors meet only inside their label and length. The rounds end when full lists join no further
    components and the audit finds its share of the links inside the components.
    """
    alone = vectors.select("cid", "label", "dim", "embedding", F.col("cid").alias("part"))
    lists = stored(_lists(_first(alone, 0), neighbours), "lists")
    pairs, turn = None, 0
    while True:
        turn += 1
        met = _flat(lists).unionByName(_local_join(alone, _flat(lists), neighbours))
        lists = stored(_lists(met if turn <= rounds else met.unionByName(_first(alone, turn)), neighbours), "lists")
        if turn < rounds:
            continue
        links = _flat(lists).where(F.col("cos") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        pairs = stored((links if pairs is None else links.unionByName(pairs)).distinct(), "pairs")
        joined = True
        while joined:
            parts = stored(connected_components(pairs).withColumnRenamed("node", "cid"), "parts")
            placed = alone.drop("part").join(parts, "cid", "left").select("cid", "label", "dim", "embedding", F.coalesce("component", "cid").alias("part"))
            placed = stored(placed, "placed")
            full = lists.where((F.size("n") == neighbours) & (-F.col("n")[neighbours - 1]["far"] >= threshold)).select(F.col("u").alias("cid"))
            full = stored(placed.join(full, "cid", "left_semi"), "full")
            joined = False
            if not full.isEmpty():
                across = _between(full, _flat(lists), neighbours, rounds, turn).where(F.col("cos") >= threshold)
                across = stored(across.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "across")
                joined = not across.isEmpty()
                if joined:
                    pairs = stored(pairs.unionByName(across), "pairs")
        recall = _audit(placed, threshold, turn)
        if recall >= MIN_RECALL:
            return parts, recall
        if turn >= MOST_ROUNDS:
            raise RuntimeError(f"the lists hold {recall:.4f} of the links of a sample after {turn} rounds")


def _degrees_in_full(vectors: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Weighted links ``(cid, n)`` of every vector of the components ``parts(cid, component)``, pair by pair of blocks."""
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / WIDE_BLOCK).cast("int").alias("blocks"))
    dealt = (parts.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
             .join(vectors.select("cid", "embedding", "weight"), "cid"))
    pairs = dealt.select("component", "cid", "embedding", "weight", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.groupBy("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(
        F.collect_list(F.struct("cid", "mine", "weight", "embedding")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for k in range(batch.num_rows):
                flat = batch.column("m").slice(k, 1).flatten()
                x, mine = _matrix(flat.field("embedding")), flat.field("mine").to_numpy()
                cid, weight = flat.field("cid").to_numpy(), flat.field("weight").to_numpy()
                i, j = batch.column("i")[k].as_py(), batch.column("j")[k].as_py()
                a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
                near = x[a] @ x[b].T >= threshold
                if i == j:
                    np.fill_diagonal(near, False)
                else:
                    ids.append(cid[b])
                    counts.append(near.T @ weight[a])
                ids.append(cid[a])
                counts.append(near @ weight[b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64)), pa.array(np.concatenate(counts).astype(np.int64) if ids else np.empty(0, np.int64))], names=["cid", "n"])

    return pairs.select("i", "j", "m").mapInArrow(run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``embeddings(vec_id, embedding, label, ...)``.

    Equal vectors of one label are one class and link with each other. Rows that are not ``usable``, or
    have no id, link with nothing and are their own component. Repeated rows count as other vectors.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = embeddings.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.withColumn("cid", F.when(usable(F.col("embedding"), F.col("label")) & F.col("vec_id").isNotNull(), F.xxhash64("label", "embedding")))
    vectors = rows.where("cid IS NOT NULL").groupBy("cid", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    vectors = stored(vectors.withColumn("dim", F.size("embedding")), "vectors")
    parts, _ = neighbour_graph(vectors.select("cid", "label", "dim", "embedding"), threshold, neighbours)
    degrees = _degrees_in_full(vectors, parts, threshold)
    named = vectors.select("cid", "rep", "weight").join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    final = named.join(least, "component").join(degrees, "cid", "left").select(
        "cid", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "least")
    out = rows.select("vec_id", "cid").join(final, "cid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
