"""Importance resampling towards a target distribution over hashed word n-grams, with a head-tail vocabulary.

Every feature (a run of consecutive words) has a bucket: the CRC-32 of its bytes. Frequent words and
word pairs, the head, go to all workers with their exact CRC states, so that most features cost one
look-up; the state of a longer feature continues that of its first words. Features outside the head,
the tail, take their CRC directly. Both feed the same exact bucket totals, so the choice of the head
changes the cost and never a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.batches import slices, split_words, word_table
from quire.session import stored

#: Most words and most word pairs of the head, and the longest of them in bytes: the bound of what goes to all workers.
HEAD_FEATURES = 20_000
HEAD_BYTES = 64
#: Fixed value: bytes of words are digits, letters and everything outside ASCII.
WORD_BYTES = word_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


class Head:
    """CRC states of frequent words, and of pairs of them by the words' places."""

    def __init__(self, words: list[str], pairs: list[str]):
        self.place = {w: i for i, w in enumerate(words)}
        self.state = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint32)
        known = {}
        for pair in pairs:
            a, _, b = pair.partition(" ")
            if a in self.place and b in self.place:
                known[self.place[a] * len(words) + self.place[b]] = zlib.crc32(pair.encode())
        self.pair = np.array(sorted(known), dtype=np.int64)
        self.pair_state = np.array([known[k] for k in self.pair.tolist()], dtype=np.uint32)

    def word_states(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head (-1: tail) and CRC state of each word."""
        place = np.array([self.place.get(w, -1) for w in words], dtype=np.int64)
        state = np.zeros(len(words), dtype=np.uint32)
        state[place >= 0] = self.state[place[place >= 0]]
        for i in np.flatnonzero(place < 0).tolist():
            state[i] = zlib.crc32(words[i].encode())
        return place, state

    def known_pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair of places is in the head, and its state."""
        key = a * len(self.place) + b
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        hit = (a >= 0) & (b >= 0)
        hit &= (self.pair[at] == key) if len(self.pair) else False
        return hit, self.pair_state[at] if len(self.pair) else np.zeros(len(key), np.uint32)


def feature_states(texts: pa.Array, head: Head, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length up to ``max_n``: the length, and text index and CRC of every feature, repeats included."""
    flat, offsets = split_words(texts, WORD_BYTES)
    if not len(flat):
        return
    coded = flat.dictionary_encode()
    words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    place, state = head.word_states(words)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    yield 1, owner, state[code]
    # longer features: the distinct ones of the batch continue the state of the feature one word shorter
    spaced = [b" " + w.encode() for w in words] if max_n > 1 else []
    prefix, prefix_state = code, state
    for n in range(2, min(max_n, len(code)) + 1):
        inside = owner[:len(code) - n + 1] == owner[n - 1:]
        left, right = prefix[:len(code) - n + 1][inside], code[n - 1:][inside]
        distinct, back = np.unique(left * len(words) + right, return_inverse=True)
        a, b = distinct // len(words), distinct % len(words)
        hit, found = head.known_pairs(place[a], place[b]) if n == 2 else (np.zeros(len(distinct), bool), np.zeros(len(distinct), np.uint32))
        for i in np.flatnonzero(~hit).tolist():
            found[i] = zlib.crc32(spaced[b[i]], int(prefix_state[a[i]]))
        yield n, owner[:len(code) - n + 1][inside], found[back]
        longer = np.zeros(len(code) - n + 1, dtype=np.int64)
        longer[inside] = back
        prefix, prefix_state = longer, found


def _frequent(max_n: int, most: int):
    """Counters of a task: at most ``4 * most`` of each length; when they overflow, all lose the count of the least one kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: list[dict[str, int]] = [{}, {}]

        def cut(counts: dict[str, int], to: int) -> dict[str, int]:
            if len(counts) <= to:
                return counts
            least = sorted(counts.values(), reverse=True)[to]
            return {w: n - least for w, n in counts.items() if n > least}

        for whole in batches:
            for batch in slices(whole, "ir_text"):
                flat, offsets = split_words(batch.column("ir_text"), WORD_BYTES)
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                for w, n in zip(words, np.bincount(code, minlength=len(words)).tolist()):
                    if len(w) <= HEAD_BYTES // 4:  # at most four bytes a character
                        counters[0][w] = counters[0].get(w, 0) + n
                if max_n > 1:
                    owner = np.repeat(np.arange(len(batch)), np.diff(offsets))
                    same = owner[:-1] == owner[1:]
                    pair, n = np.unique(code[:-1][same] * len(words) + code[1:][same], return_counts=True)
                    for k in np.argsort(-n, kind="stable")[:most].tolist():
                        a, b = words[pair[k] // len(words)], words[pair[k] % len(words)]
                        if len(a) + len(b) < HEAD_BYTES // 4:
                            counters[1][f"{a} {b}"] = counters[1].get(f"{a} {b}", 0) + int(n[k])
                counters = [c if len(c) <= 4 * most else cut(c, most) for c in counters]
        for length, counts in enumerate(counters, 1):
            kept = cut(counts, most)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(kept), pa.int32()), pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())],
                                                 names=["length", "feature", "n"])
    return run


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(f"`{text}`").cast("string").alias("ir_text"))


def head_vocabulary(docs: DataFrame, text: str = "text", max_n: int = 1, most: int = HEAD_FEATURES) -> Head:
    """The most frequent words (and pairs, for ``max_n`` above 1) by the counters of all tasks over all texts: at most ``most`` of each."""
    counts = _texts(docs, text).mapInArrow(_frequent(max_n, most), "length int, feature string, n long")
    counts = counts.groupBy("length", "feature").agg(F.sum("n").alias("n"))
    counts = stored(counts, "head-counts") if max_n > 1 else counts
    top = lambda length: [r.feature for r in counts.where(F.col("length") == length).orderBy(F.desc("n"), "feature").limit(most).collect()]
    return Head(top(1), top(2) if max_n > 1 else [])


def bucket_totals(docs: DataFrame, head: Head, text: str = "text", max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """Occurrences of features of all whole texts by bucket: ``bucket``, ``n``. Each task adds up in one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "ir_text"):
                for _, _, states in feature_states(batch.column("ir_text"), head, max_n):
                    total += np.bincount(states % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return _texts(docs, text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs_totals: DataFrame, target_totals: DataFrame, buckets: int = 10_000) -> list[int]:
    """Gain of each bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) in doubles. As many numbers as buckets."""
    spark = docs_totals.sparkSession
    both = reduce(DataFrame.unionByName, [
        docs_totals.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")),
        target_totals.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")),
        spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))])
    each = {r.bucket: (r.s, r.t) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    all_s, all_t = (sum(v[i] for v in each.values()) for i in (0, 1))
    rows = [(b, s, t, all_s, all_t) for b, (s, t) in each.items()]
    double = lambda c, plus: F.col(c).cast("double") + F.lit(float(plus))
    ratio = double("t", 1) * double("all_s", buckets) / (double("s", 1) * double("all_t", buckets))
    found = spark.createDataFrame(rows, "bucket long, s long, t long, all_s long, all_t long").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    gains = [0] * buckets
    for r in found.collect():
        gains[r.bucket] = r.gain
    return gains


def _noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise of a document in thousandths, from the first 32 bits of a digest of seed and id; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def weights(docs: DataFrame, head: Head, gains: list[int], doc_id: str = "doc_id", text: str = "text", max_n: int = 1, seed: int = 2024,
            keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the id), ``n_words``, ``n_features``, ``weight`` (sum of gains over features) and ``score`` (weight and noise)."""
    keep, buckets, gain = [doc_id] if keep is None else keep, len(gains), np.array(gains, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ir_text"):
                at, size = batch.schema.get_field_index("ir_text"), len(batch)
                sums, count, words = (np.zeros(size, dtype=np.int64) for _ in range(3))
                for n, owner, states in feature_states(batch.column(at), head, max_n):
                    found = np.bincount(owner, minlength=size)
                    count += found
                    words += found if n == 1 else 0
                    before = np.concatenate(([0], np.cumsum(gain[states % np.uint32(buckets)])))  # owners ascend
                    ends = np.searchsorted(owner, np.arange(size + 1))
                    sums += before[ends[1:]] - before[ends[:-1]]
                kept = [(c, n) for i, (c, n) in enumerate(zip(batch.columns, batch.schema.names)) if i != at]
                yield pa.RecordBatch.from_arrays([c for c, _ in kept] + [pa.array(x) for x in (words, count, sums)],
                                                 names=[n for _, n in kept] + ["n_words", "n_features", "weight"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("ir_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "ir_text"]
    out = source.mapInArrow(run, ", ".join([*kinds, "n_words long, n_features long, weight long"]))
    return out.withColumn("score", F.col("weight") + _noise(seed, F.col(f"`{doc_id}`")))


def draw(scored: DataFrame, percent: int, least_words: int, doc_id: str = "doc_id") -> DataFrame:
    """Adds ``rank`` (1, 2, ... by score, ties to the smaller id) to the highest ``percent`` of the rows with enough words; null elsewhere.

    Ranks need no window over all rows: rows are dealt by ranges of the order, counted by range, and
    numbered from the sum of the ranges before. There are as many ranges as shuffle partitions.
    """
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc(f"`{doc_id}`"), F.asc("n_features"), F.asc("weight")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = stored(scored, "importance-scored")
    dealt = stored(scored.where(able).repartitionByRange(ranges, *order).withColumn("ir_range", F.spark_partition_id()), "importance-dealt")
    sizes = {r.ir_range: r.n for r in dealt.groupBy("ir_range").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    drawn = percent * before // 100
    starts = spark.createDataFrame(starts, "ir_range int, ir_start long")
    place = F.row_number().over(Window.partitionBy("ir_range").orderBy(*order)).cast("long") + F.col("ir_start")
    numbered = dealt.join(F.broadcast(starts), "ir_range").withColumn("rank", place)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("ir_range", "ir_start")
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return numbered.select(*rest.columns).unionByName(rest)


def importance_resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", max_n: int = 1, buckets: int = 10_000,
                        percent: int = 10, least_words: int = 20, seed: int = 2024, keep: list[str] | None = None) -> DataFrame:
    """Documents scored by how much their features resemble ``target``, and the ranks of those drawn.

    Returns ``keep`` columns (default: the id), ``n_words``, ``n_features``, ``weight``, ``score`` and
    ``rank`` (null if not drawn). A null or empty text has no features and weight 0. A null id draws
    its noise as an empty one. Rows are scored on their own, so repeated rows get equal scores and
    ranks that follow one another. Empty tables give empty results; an empty target gives every
    bucket the gain of no occurrence. Other columns are ignored unless kept; kept columns must not
    be named like the results.
    """
    head = head_vocabulary(docs, text, max_n)
    totals = [bucket_totals(df, head, text, max_n, buckets) for df in (docs, target)]
    scored = weights(docs, head, bucket_gains(*totals, buckets), doc_id, text, max_n, seed, keep)
    return draw(scored, percent, least_words, doc_id)
