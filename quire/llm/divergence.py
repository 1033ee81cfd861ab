"""Source divergence audit: how far each source's words lie from those of its language, by a minimal-perfect-hash recount.

A first pass counts in how many documents each term of a language stands, exactly, and keeps the
frequent ones. The kept terms are dealt to shards; each shard gets a minimal perfect hash with its
keys. The hashes are broadcast, as many shards at a time as fit a stated bound, and a second pass
counts occurrences in dense arrays, one slot for each term and one array for each group. Whatever a
hash says is verified against the stored key. Shares of all groups then meet shard by shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.batches import slices, split_words, word_table
from quire.llm.joins import bounded
from quire.llm.worker import kept
from quire.session import stored

#: Fixed value: bytes of terms are letters and everything outside ASCII.
TERM_BYTES = word_table(lambda b: 97 <= b <= 122 or b >= 128)
#: Terms of a shard, about; the groups of one language meet by shards, in tables of at most so many counts.
SHARD_TERMS = 4096
SHARD_COUNTS = 4_000_000
#: Most bytes of terms and hashes that go to all workers at once; further shards are counted by further passes.
WAVE_BYTES = 64 << 20
#: Counters of a task before it hands them on.
TASK_COUNTERS = 8_000_000
#: Bytes of text whose document counts are added up at once.
COUNT_BYTES = 6 << 20
#: Rows of a table, one for each language, that may go to all workers.
BROADCAST_LANGS = 100_000
#: Share of a group in a term: parts of this unit.
UNIT = 1_000_000_000

_MIX = 0x9E3779B97F4A7C15


def term_hashes(terms: list[str]) -> np.ndarray:
    """64-bit hash of each term."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), dtype=np.uint64, count=len(terms))


def _level(hashes: np.ndarray, level: int) -> np.ndarray:
    """Fresh 64-bit values of the hashes for one level (multiply and shift, wrapping)."""
    x = (hashes + np.uint64((level + 1) * _MIX % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def build_hash(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Minimal perfect hash of distinct values: a bit array for each level, and the slot of each value.

    A level has two bits a key. Keys that are alone on their bit are settled there, the others go
    to the next level. The slot of a key is the number of set bits before its own.
    """
    levels, left, slots = [], np.arange(len(hashes)), np.empty(len(hashes), dtype=np.int64)
    base = 0
    while len(left):
        size = 2 * len(left) + 1
        at = (_level(hashes[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = base + np.cumsum(bits)[at[alone]] - 1
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
        if len(levels) > 200:
            raise ValueError("two terms of a shard have one 64-bit hash")
    return levels, slots


class TermTable:
    """Perfect hashes of many shards, laid end to end, with the keys in slot order."""

    def __init__(self, shards: list[tuple[str, int, int, list[int], bytes, pa.Array]]):
        """``shards``: language, shard, shards of the language, level sizes, packed bits, keys in slot order."""
        shards = sorted(shards, key=lambda s: s[:2])
        self.langs: dict[str, int] = {}
        place: list[list[int]] = []
        depth = max((len(s[3]) for s in shards), default=0)
        self.sizes = np.zeros((len(shards), depth), dtype=np.uint64)
        self.starts = np.zeros((len(shards), depth), dtype=np.int64)
        bits, offset, self.first_slot = [], 0, [0]
        for row, (lang, shard, of, sizes, packed, keys) in enumerate(shards):
            k = self.langs.setdefault(lang, len(self.langs))
            if k == len(place):
                place.append([-1] * of)
            place[k][shard] = row
            bits.append(np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=sum(sizes)))
            self.sizes[row, :len(sizes)] = sizes
            self.starts[row, :len(sizes)] = offset + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            offset += sum(sizes)
            self.first_slot.append(self.first_slot[-1] + len(keys))
        self.bits = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        self.keys = pa.concat_arrays([s[5] for s in shards]) if shards else pa.array([], pa.string())
        self.rows = [np.array(p, dtype=np.int64) for p in place]
        #: Slots of a language lie together: from its first row to its last.
        self.span = [(self.first_slot[r[r >= 0].min()], self.first_slot[r[r >= 0].max() + 1]) for r in self.rows]
        self.names = [(s[0], s[1]) for s in shards]
        self.first_slot = np.array(self.first_slot, dtype=np.int64)

    def slots(self, lang: int, terms: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Slot of each term of a language, -1 for terms that are not kept. Every hit is compared with its key."""
        row = self.rows[lang][(hashes % np.uint64(len(self.rows[lang]))).astype(np.int64)]
        found = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.flatnonzero(row >= 0)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = self.starts[row[open_], level] + (_level(hashes[open_], level) % size).astype(np.int64)
            hit = self.bits[at]
            found[open_[hit]] = self.rank[at[hit]] - 1
            open_ = open_[~hit]
        some = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[some])), terms.take(pa.array(some)))
        found[some[~same.to_numpy(zero_copy_only=False)]] = -1
        return found


def _prepared(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    name = lambda c, new: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(new)
    return docs.select(name(lang, "lang"), name(source, "source"), F.col(f"`{text}`").cast("string").alias("sd_text"))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) of a slice of texts, each term once for a document."""
    for whole in batches:
        for batch in slices(whole, "sd_text", COUNT_BYTES):
            flat, offsets = split_words(batch.column("sd_text"), TERM_BYTES)
            if not len(flat):
                continue
            coded, langs = flat.dictionary_encode(), batch.column("lang").dictionary_encode()
            n, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), np.diff(offsets))
            once = np.unique(owner * n + code)
            key, count = np.unique(langs.indices.to_numpy().astype(np.int64)[once // n] * n + once % n, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // n)), coded.dictionary.take(pa.array(key % n)), pa.array(count, pa.int64())],
                                             names=["lang", "term", "n"])


def frequent_terms(docs: DataFrame, least_docs: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Terms that stand in at least so many documents of their language: ``lang``, ``term``."""
    counts = _prepared(docs, text, lang, source).select("lang", "sd_text").mapInArrow(_document_counts, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def _build_shard(table: pa.Table) -> pa.Table:
    """The perfect hash of one shard of one language: level sizes, packed bits, terms in slot order."""
    terms = table.column("term").combine_chunks()
    levels, slots = build_hash(term_hashes(terms.to_pylist()))
    order = np.empty(len(slots), dtype=np.int64)
    order[slots] = np.arange(len(slots))
    keys = terms.take(pa.array(order))
    packed = np.packbits(np.concatenate(levels)).tobytes()
    of = table.column("shards")[0].as_py()
    return pa.table({"lang": table.column("lang").slice(0, 1), "shard": table.column("shard").slice(0, 1), "shards": pa.array([of], pa.int64()),
                     "sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int32())), "bits": pa.array([packed], pa.binary()), "n": pa.array([len(keys)], pa.int64()), "terms": pa.array([" ".join(keys.to_pylist())], pa.string())})


def perfect_hashes(terms: DataFrame, sources: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row for each shard of the kept terms: ``lang, shard, shards, sizes, bits, n, terms, bytes``; ``terms`` are joined by blanks.

    The shard follows the term's 64-bit hash, so a language falls into shards of about equal size.
    ``sources`` has the number of ``sources`` of each ``lang``: many sources make smaller shards.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = term_hashes(b.column("term").to_pylist()) % b.column("shards").to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard.astype(np.int64))], names=[*b.schema.names, "shard"])

    size = F.greatest(F.lit(1), F.least(F.lit(shard_terms), F.floor(F.lit(SHARD_COUNTS) / F.col("sources"))))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms")).join(sources, "lang").select("lang", F.ceil(F.col("terms") / size).cast("long").alias("shards"))
    dealt = terms.join(bounded(stored(sizes, "divergence-shards"), BROADCAST_LANGS), "lang").mapInArrow(hashed, "lang string, term string, shards long, shard long")
    made = dealt.groupBy("lang", "shard").applyInArrow(_build_shard, "lang string, shard long, shards long, sizes array<int>, bits binary, n long, terms string")
    # in a worker: keys with their offsets, one byte and four bytes of rank for each of the bits
    return made.withColumn("bytes", F.octet_length("terms") + F.col("n") * 4 + F.length("bits") * 40 + 200)


def _recount(table, key: str):
    """Occurrences of kept terms in each (lang, source) of a task: one dense array a group, handed on when full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: TermTable = kept(key, lambda: TermTable([(*s[:4], bytes(s[4]), pa.array(s[5].split(" "), pa.string())) for s in table.value]))
        groups: dict[tuple[int, str], np.ndarray] = {}
        owners = np.repeat(np.arange(len(own.names)), np.diff(own.first_slot))
        shard_of, lang_of = np.array([shard for _, shard in own.names], dtype=np.int64), list(own.langs)

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in groups.items():
                used = np.flatnonzero(counts)
                slot = used + own.span[lang][0]
                row = owners[slot]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang_of[lang], len(used)), pa.repeat(source, len(used)), pa.array(shard_of[row]),
                     pa.array((slot - own.first_slot[row]).astype(np.int32)), pa.array(counts[used].astype(np.int64))], names=["lang", "source", "shard", "slot", "n"])
            groups.clear()

        held = counted = 0
        for whole in batches:
            for batch in slices(whole, "sd_text"):
                flat, offsets = split_words(batch.column("sd_text"), TERM_BYTES)
                if not len(flat):
                    continue
                counted += len(flat)
                if counted > np.iinfo(np.int32).max:  # no counter can have overflowed before
                    yield from handed()
                    held, counted = 0, len(flat)
                coded = flat.dictionary_encode()
                code, hashes = coded.indices.to_numpy(), term_hashes(coded.dictionary.to_pylist())
                langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
                both = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                group, of = np.unique(both, return_inverse=True)
                member = np.repeat(of, np.diff(offsets))
                order = np.argsort(member, kind="stable")
                ends = np.searchsorted(member[order], np.arange(len(group) + 1))
                slot_of: dict[str, np.ndarray] = {}
                for g, k in enumerate(group.tolist()):
                    lang, source = langs.dictionary[k // len(sources.dictionary)].as_py(), sources.dictionary[k % len(sources.dictionary)].as_py()
                    if lang not in own.langs:
                        continue
                    number = own.langs[lang]
                    if lang not in slot_of:
                        slot_of[lang] = own.slots(number, coded.dictionary, hashes)
                    slots = slot_of[lang][code[order[ends[g]:ends[g + 1]]]]
                    slots = slots[slots >= 0]
                    if not len(slots):
                        continue
                    low, high = own.span[number]
                    if (number, source) not in groups:
                        if held + high - low > TASK_COUNTERS and groups:
                            yield from handed()
                            held = 0
                        groups[number, source] = np.zeros(high - low, dtype=np.int32)
                        held += high - low
                    counts = groups[number, source]
                    if len(slots) * 8 < high - low:
                        np.add.at(counts, slots - low, 1)
                    else:
                        counts += np.bincount(slots - low, minlength=high - low).astype(np.int32)
        yield from handed()
    return run


def group_counts(docs: DataFrame, shards: DataFrame, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Occurrences of the kept terms by group: ``lang, source, shard, slot, n``, only those above 0.

    ``shards`` goes to the workers in waves whose measured size stays within ``wave_bytes``; there is
    one pass over the texts for each wave, so any number of terms is counted in bounded memory. A
    single shard larger than the bound makes a wave of its own.
    """
    spark = docs.sparkSession
    total, most = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    waves = max(1, min(-(-total // wave_bytes), most))
    while True:
        dealt = shards.withColumn("wave", F.pmod(F.xxhash64("lang", "shard"), F.lit(waves)))
        worst = dealt.groupBy("wave").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > wave_bytes) & (F.col("n") > 1))
        if waves >= most or worst.isEmpty():
            break
        waves = min(2 * waves, most)
    schema = "lang string, source string, shard long, slot int, n long"
    parts = None
    for wave in range(waves):
        rows = dealt.where(F.col("wave") == wave).select("lang", "shard", "shards", "sizes", "bits", "terms").collect()
        if not rows and parts is not None:
            continue
        table = spark.sparkContext.broadcast([tuple(r) for r in rows])
        part = docs.mapInArrow(_recount(table, f"terms {uuid.uuid4().hex}"), schema)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly: long division in three steps of 1000."""
    under = totals.astype(np.int64)[:, None] + 2 * terms
    rest = counts.astype(np.int64) + 2
    quotient = rest // under
    rest %= under
    for _ in range(3):
        rest *= 1000
        quotient = quotient * 1000 + rest // under
        rest %= under
    return quotient + 1


def _divergences(top: int):
    """One shard of one language: summed pair values, and the best terms of each source."""
    def run(key, cells: pa.Table, block: pa.Table) -> pa.Table:
        joined = block.column("terms")[0].as_py()
        terms = joined.split(" ") if joined else []
        names, totals = block.column("sources")[0].as_py(), np.array(block.column("totals")[0].as_py(), dtype=np.int64)
        kept_terms, lang, size = block.column("kept_terms")[0].as_py(), block.column("lang")[0].as_py(), len(terms)
        counts = np.zeros((len(names), size), dtype=np.int64)
        if cells.num_rows:
            row = {s: i for i, s in enumerate(names)}
            at = np.array([row[s] for s in cells.column("source").to_pylist()], dtype=np.int64)
            counts[at, cells.column("slot").to_numpy()] = cells.column("n").to_numpy()
        p = shares(counts, totals, kept_terms) if size else counts
        value = lambda a, b: (a - b) * (a - b) // (a + b)  # noqa: E731 - below UNIT squared, which fits
        source, item, part, result = [], [], [], []
        for i, name in enumerate(names):
            if i + 1 < len(names):
                sums = value(p[i + 1:], p[i]).sum(axis=1)
                source += [name] * len(sums)
                item += names[i + 1:]
                part += ["pair"] * len(sums)
                result += sums.tolist()
        if size:
            q = shares(counts.sum(axis=0, keepdims=True), totals.sum(keepdims=True), kept_terms)[0]
            for i, name in enumerate(names):
                able = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                worth = value(p[i][able], q[able])
                if len(able) > top:  # all that reach the value of the last place, then ties by term
                    least = np.partition(worth, len(worth) - top)[len(worth) - top]
                    able, worth = able[worth >= least], worth[worth >= least]
                best = sorted(zip((-worth).tolist(), [terms[k].encode() for k in able.tolist()], able.tolist()))[:top]
                source += [name] * len(best)
                item += [terms[k] for _, _, k in best]
                part += ["term"] * len(best)
                result += [-v for v, _, _ in best]
        return pa.table({"lang": pa.array([lang] * len(item), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()),
                         "item": pa.array(item, pa.string()), "value": pa.array(result, pa.int64())})
    return run


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source",
                      shard_terms: int = SHARD_TERMS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Divergence of each (lang, source) from the other sources of its language, and its most unusual terms.

    Returns ``lang, source, part, item, value, rank``. Part ``pair``: ``item`` is another source of the
    language and ``value`` the sum over all kept terms, every pair both ways. Part ``term``: a term whose share in the group exceeds that
    in the language, the ``top`` best. Null text, language and source count as ''; a group without terms takes part with
    counts of 0; a language without kept terms has pairs of value 0. Repeated rows count as often as
    they stand. An empty table gives an empty result. Other columns are ignored.
    """
    texts = _prepared(docs, text, lang, source)
    present = stored(texts.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("total")), "divergence-groups")
    terms = stored(frequent_terms(docs, least_docs, text, lang, source), "divergence-terms")
    shards = stored(perfect_hashes(terms, present.groupBy("lang").agg(F.count("*").alias("sources")), shard_terms), "divergence-hashes")
    cells = stored(group_counts(texts, shards, wave_bytes), "divergence-counts")
    found = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = present.unionByName(found).groupBy("lang", "source").agg(F.sum("total").alias("total"))
    each = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"))
    kept_terms = shards.groupBy("lang").agg(F.sum("n").alias("kept_terms"))
    known = each.join(kept_terms, "lang", "left").join(shards.select("lang", "shard", "terms"), "lang", "left").select(
        "lang", F.coalesce("shard", F.lit(-1)).cast("long").alias("shard"), F.coalesce("kept_terms", F.lit(0)).cast("long").alias("kept_terms"),
        F.coalesce("terms", F.lit("")).alias("terms"), F.col("groups.source").alias("sources"), F.col("groups.total").alias("totals"))
    parts = cells.groupBy("lang", "shard").cogroup(known.groupBy("lang", "shard")).applyInArrow(_divergences(top), "lang string, source string, part string, item string, value long")
    parts = stored(parts, "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    turned = pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs.unionByName(turned)).unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top))
