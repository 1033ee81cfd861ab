"""Exact byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that stands inside no token of the vocabulary can never be merged over,
so it marks a certain cut; so does the end of a word, whose last byte is a symbol of its own. The
fragments between cuts are merged independently and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame, functions as F

from quire.llm.batches import slices
from quire.llm.worker import kept

#: Units kept in each of two generations of a worker's memory, and their greatest length.
CACHE_UNITS = 250_000
CACHE_CHARS = 64
#: Bytes of text that a worker encodes at once: a distinct unit of a slice is looked up once.
BATCH_BYTES = 6 << 20
#: Fragments up to these lengths are merged side by side, as the rows of one table each; longer ones with a heap.
TABLE_WIDTHS = (4, 8, 16, 32)
#: Texts that need no library to be normalised and cut: ASCII and the composed letters of Latin-1.
_PLAIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Fixed value: words of such a text in lower case without white space, as the vocabulary's pre-tokenizer cuts them.
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+|\n")
#: Rank of a pair that does not merge, and the id behind the end of a row.
_NEVER, _NONE = np.int64(1 << 62), np.int64((1 << 20) - 1)


class _MergeTable:
    """Merges by pair of ids, for arrays: open addressing, one probe for most pairs."""

    def __init__(self, merges: dict[int, int]):
        bits = max(8, (8 * len(merges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.found = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NEVER, dtype=np.int64)
        keys, found = np.fromiter(merges, np.int64, len(merges)), np.fromiter(merges.values(), np.int64, len(merges))
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # the first of the keys that want a free place gets it, the others go one further
            free = left[self.keys[slot[left]] < 0]
            _, taken = np.unique(slot[free], return_index=True)
            won = free[taken]
            self.keys[slot[won]], self.found[slot[won]] = keys[won], found[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (upper bits) and result (lower bits) of each pair."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.found[slot], _NEVER)
        open_ = np.flatnonzero(((there != keys) & (there >= 0)).ravel())
        while len(open_):
            slot.flat[open_] = (slot.flat[open_] + 1) & (len(self.keys) - 1)
            at, key = slot.flat[open_], keys.flat[open_]
            there = self.keys[at]
            out.flat[open_[there == key]] = self.found[at[there == key]]
            open_ = open_[(there != key) & (there >= 0)]
        return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class BoundaryCodec:
    """Encoder and decoder of one vocabulary file with a word-end suffix."""

    def __init__(self, file: str):
        self.library = tokenizers.Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as source:
            spec = json.load(source)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if not suffix or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or spec["decoder"]:
            raise ValueError("only plain byte-level vocabularies with a word-end suffix and no decoder are handled")
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        #: Symbols: 0-255 are bytes, 256-511 the same bytes at the end of a word.
        self.base = [vocab[c] for c in symbols] + [vocab[c + suffix] for c in symbols]
        #: Pair of ids -> rank in the upper and result in the lower 32 bits, so that the least value is the next merge.
        self.merges: dict[int, int] = {}
        self.inside = np.zeros((512, 512), dtype=bool)
        self._learn([m if isinstance(m, list) else m.split(" ") for m in model["merges"]], vocab)
        self.merge = _MergeTable(self.merges)
        self.base_ids = np.array(self.base, dtype=np.int64)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only special tokens that are matched literally are handled")
        self.special = specials
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.names = {i: t for t, i in (vocab | specials).items()}
        #: Each token behind a blank, in the order of the ids.
        self.spaced = pa.array([" " + self.names.get(i, "") for i in range(max(self.names) + 1)], pa.string())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, merges: list[list[str]], vocab: dict[str, int]) -> None:
        """All merges, and all pairs of symbols inside a token that merging can build."""
        spelled = {i: (s,) for s, i in enumerate(self.base)}
        for rank, (a, b) in enumerate(merges):
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            if left not in spelled or right not in spelled:
                continue
            word = spelled[left] + spelled[right]
            if spelled.setdefault(new, word) != word:
                raise ValueError(f"token {a + b!r} has two spellings")
            self.merges.setdefault(left << 32 | right, rank << 32 | new)
            for x, y in pairwise(word):
                self.inside[x, y] = True

    def _table(self, ids: np.ndarray) -> np.ndarray:
        """Merge the rows of ``ids`` (ended by ``_NONE``): in each always the merge of lowest rank, the leftmost first. Rows end at a smaller width."""
        out, rows, places = np.full_like(ids, _NONE), np.arange(len(ids)), np.arange(ids.shape[1])
        found = self.merge(ids[:, :-1], ids[:, 1:])
        while len(rows):
            k = found.argmin(axis=1)
            each = np.arange(len(rows))
            best = found[each, k]
            done = best == _NEVER
            if done.any():
                out[rows[done], :ids.shape[1]] = ids[done]
                rows, ids, found, k, best = rows[~done], ids[~done], found[~done], k[~done], best[~done]
                each = each[:len(rows)]
            if not len(rows):
                break
            # the pair at k becomes one token: what stands behind it moves up
            width, at = ids.shape[1], k[:, None]
            moved = places[:width] + (places[:width] > at)
            ids = np.take_along_axis(np.concatenate([ids, np.full((len(rows), 1), _NONE)], axis=1), moved, axis=1)[:, :width - 1]
            ids[each, k] = best & 0xFFFFFFFF
            found = np.take_along_axis(np.concatenate([found, np.full((len(rows), 1), _NEVER)], axis=1), places[:width - 1] + (places[:width - 1] >= at), axis=1)[:, :width - 2]
            inner = k > 0
            found[each[inner], k[inner] - 1] = self.merge(ids[each[inner], k[inner] - 1], ids[each[inner], k[inner]])
            inner = k < width - 2
            found[each[inner], k[inner]] = self.merge(ids[each[inner], k[inner]], ids[each[inner], k[inner] + 1])
            if width == 2:
                out[rows, 0] = ids[:, 0]
                break
        return out

    def _long_fragment(self, symbols: list[int]) -> list[int]:
        """As ``_table`` for one fragment, with a heap of candidate merges over a linked list; entries that no longer hold are skipped."""
        ids = [self.base[s] for s in symbols]
        get, size = self.merges.get, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(found, k, a, b) for k, (a, b) in enumerate(pairwise(ids)) if (found := get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            best, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= size or ids[right] != b:
                continue
            ids[k], ids[right] = best & 0xFFFFFFFF, -1
            after[k] = after[right]
            if after[k] < size:
                before[after[k]] = k
                if (found := get(ids[k] << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (found, k, ids[k], ids[after[k]]))
            if (left := before[k]) >= 0 and (found := get(ids[left] << 32 | ids[k])) is not None:
                heapq.heappush(heap, (found, left, ids[left], ids[k]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of non-empty words in order, and the offsets of each word's ids.

        The words are laid end to end. A cut is certain between two symbols that stand side by side in
        no token, as behind every word's last one; the fragments between cuts are merged independently.
        """
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        starts = np.concatenate(([0], np.flatnonzero(~self.inside[symbols[:-1], symbols[1:]]) + 1)) if len(symbols) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(symbols)))
        # the ids of a fragment stand from its first symbol on; places that merging leaves empty stay below 0
        placed = np.full(len(symbols), -1, dtype=np.int64)
        single = starts[sizes == 1]
        placed[single] = self.base_ids[symbols[single]]
        least = 1
        for width in TABLE_WIDTHS:
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if len(own):
                at = starts[own][:, None] + np.arange(width)
                real = np.arange(width) < sizes[own][:, None]
                ids = np.where(real, self.base_ids[symbols[np.minimum(at, len(symbols) - 1)]], _NONE)
                merged = self._table(ids)
                real = merged != _NONE
                placed[at[real]] = merged[real]
        for k in np.flatnonzero(sizes > least).tolist():
            ids = self._long_fragment(symbols[starts[k]:starts[k] + sizes[k]].tolist())
            placed[starts[k]:starts[k] + len(ids)] = ids
        real = placed >= 0
        return placed[real], np.concatenate(([0], np.cumsum(real)[ends - 1])) if len(words) else np.zeros(1, np.int64)

    def _words(self, text: str) -> list[bytes]:
        """Normalised words of a piece of text without special tokens, as bytes."""
        if _PLAIN.fullmatch(text):
            return [w.encode() for w in _PLAIN_WORDS.findall(text.lower())]
        library, byte_of = self.library, self.byte_of
        cut = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return [bytes([byte_of[c] for c in word]) for word, _ in cut]

    def _runs(self, words: list[bytes], counts: list[int]) -> list[bytes]:
        """Ids of runs of so many words each, as bytes."""
        ids, ends = self.encode_words(words)
        data, bounds = ids.astype("<u4").tobytes(), (ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))] * 4).tolist()
        return [data[a:b] for a, b in pairwise(bounds)]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian) of texts without ASCII white space."""
        marked = [bool(self.special_cut and "<" in u and self.special_cut.search(u)) for u in units]
        plain = [k for k, u in enumerate(units) if not marked[k] and _PLAIN.fullmatch(u)]
        out: list[bytes] = [b""] * len(units)
        if plain:  # cut together, with a line break between two units
            found = _PLAIN_WORDS.findall("\n".join([units[k] for k in plain]).lower())
            breaks = [i for i, w in enumerate(found) if w == "\n"]
            counts = [b - a - 1 for a, b in pairwise([-1, *breaks, len(found)])]
            for k, ids in zip(plain, self._runs([w.encode() for w in found if w != "\n"], counts)):
                out[k] = ids
        others = sorted(set(range(len(units))) - set(plain))
        parts = [(k, part, i % 2 == 1) for k in others for i, part in enumerate(self.special_cut.split(units[k]) if marked[k] else [units[k]])]
        words = [[] if special else self._words(part) for _, part, special in parts]
        runs = self._runs([w for own in words for w in own], [len(own) for own in words])
        for (k, part, special), ids in zip(parts, runs):
            out[k] += self.special[part].to_bytes(4, "little") if special else ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``, without begin and end tokens."""
        units = [u for u in re.split("[\t-\r ]+", text) if u]
        return np.frombuffer(b"".join(self.encode_units(units)), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of ``ids`` joined by blanks: what the vocabulary's library gives where a file has no decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def encode_batch(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids as bytes and decoded texts of non-null texts. White space is a certain cut: each distinct unit is encoded once."""
        units = pc.ascii_split_whitespace(texts)
        coded = units.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        found = [self.young.get(u) for u in names]
        new = [k for k, ids in enumerate(found) if ids is None]
        known = [self.old.get(names[k]) for k in new]
        made = iter(self.encode_units([names[k] for k, ids in zip(new, known) if ids is None]))
        for k, ids in zip(new, known):
            found[k] = next(made) if ids is None else ids
            if len(names[k]) <= CACHE_CHARS:
                if len(self.young) >= CACHE_UNITS:
                    self.old, self.young = self.young, {}
                self.young[names[k]] = found[k]
        joined = pc.binary_join(pa.ListArray.from_arrays(units.offsets, pa.array(found, pa.binary()).take(coded.indices)), b"")
        offsets, flat = token_ids(joined)
        decoded = pc.binary_join(pa.ListArray.from_arrays(offsets, self.spaced.take(pa.array(flat))), "")
        return joined, pc.utf8_slice_codeunits(decoded, 1)


def token_ids(joined: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Offsets of the texts and all ids, from ids as bytes."""
    ends = np.frombuffer(joined.buffers()[1], dtype=np.int32)[joined.offset:joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    flat = np.frombuffer(data, dtype="<u4", count=int(ends[-1]) // 4) if data is not None and len(ends) else np.empty(0, "<u4")
    return pa.array((ends - ends[0]) // 4), flat[ends[0] // 4:].astype(np.int32)


def codec(file: str) -> BoundaryCodec:
    """The codec of a vocabulary file, built once in each process."""
    return kept(f"boundaries {file}", lambda: BoundaryCodec(file))


def _digest(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())


def _round_trip(file: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file)
        for whole in batches:
            for batch in slices(whole, "bpe_text", BATCH_BYTES):
                at = batch.schema.get_field_index("bpe_text")
                joined, decoded = own.encode_batch(pc.fill_null(batch.column(at), ""))
                counts = pc.divide(pc.binary_length(joined), 4).cast(pa.int64())
                if digests:
                    ids, decoded = _digest(joined), _digest(decoded)
                else:
                    offsets, flat = token_ids(joined)
                    ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
                names = [n for i, n in enumerate(batch.schema.names) if i != at] + ["n_tokens", "ids", "decoded"]
                columns = [c for i, c in enumerate(batch.columns) if i != at] + [counts, ids, decoded]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def encode_decode(docs: DataFrame, file: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Encode and decode every whole text: kept columns plus ``n_tokens``, ``ids``, ``decoded``.

    ``ids`` is the id array and ``decoded`` the text that the library's decoder gives (here the tokens
    joined by blanks); with ``digests`` both are SHA-256 hex strings, of the ids as little-endian
    32-bit integers and of the UTF-8 text. A null or empty text has no ids and an empty text. Rows
    are independent, so repeated rows and ids give repeated results and an empty table an empty one:
    one narrow stage without shuffle, memory bounded by a batch or one text. ``keep`` defaults to all
    other columns; columns named like the results are replaced.
    """
    fresh = {"n_tokens", "ids", "decoded", "bpe_text"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in fresh | {text.lower()}]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("bpe_text"))
    kinds = "n_tokens long, ids string, decoded string" if digests else "n_tokens long, ids array<int>, decoded string"
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "bpe_text"], kinds])
    return source.mapInArrow(_round_trip(file, digests), schema)
