"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking.

The encoder never runs merges. An Aho-Corasick automaton finds the longest piece at each position;
a piece is accepted if it may stand behind the one before it, which is tested by undoing merges on
both sides of the seam; refused pieces give way to their next shorter prefix, and a bitfield keeps
positions from which no completion exists.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from quire.llm.worker import kept, trim

SPACE = "▁"
#: Words kept in each of two generations of a worker's memory.
CACHE_WORDS = 100_000
CACHE_WORD_CHARS = 64
#: Bytes of text that a worker encodes at once.
BATCH_BYTES = 1 << 20
#: Pairs of pieces whose compatibility a worker remembers, about 100 bytes each.
FIT_PAIRS = 500_000


class MergeCodec:
    """Encoder and decoder for one model whose pieces hold the space mark only at their start."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.unknown = model.unk_id()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(self.pieces[i].strip(SPACE) and SPACE in self.pieces[i][1:] for i in plain):
            raise ValueError("a piece holds the space mark other than once at its start")
        self.spaces = {len(self.pieces[i]): i for i in plain if not self.pieces[i].strip(SPACE)}
        self.id_of = {self.pieces[i]: i for i in plain}
        # merge order: a better score first; runs of spaces are encoded apart and have no order among themselves
        order = sorted((i for i in plain if i not in self.spaces.values() or self.pieces[i] == SPACE),
                       key=lambda i: (len(self.pieces[i]) > 1, -model.get_score(i), i))
        self.rank = {i: k for k, i in enumerate(order)}
        self.parts: dict[int, tuple[int, int]] = {}
        self._learn_parts(order)
        if any("\n" in self.pieces[i] for i in plain):
            raise ValueError("a piece holds a line break")
        self.automaton = ahocorasick.Automaton()
        for i in self.parts:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        self.automaton.make_automaton()
        self.plain_text = ["" if i in self.bytes else x for i, x in enumerate(self.pieces)]
        self.names = [str(i) for i in range(size)]
        self.shorter = {i: self._prefix(self.pieces[i]) for i in self.parts}
        self.length = {i: len(self.pieces[i]) for i in self.parts}
        self.fits: dict[int, bool] = {}
        self.characters = frozenset(c for c in self.id_of if len(c) == 1)
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def _learn_parts(self, order: list[int]) -> None:
        """The last merge of each piece; pieces that merging never builds have none and are left out."""
        for i in order:
            text = self.pieces[i]
            if len(text) == 1:
                self.parts[i] = (i, i)
                continue
            symbols = [self.id_of.get(c) for c in text]
            if None in symbols:
                continue
            while len(symbols) > 2:
                best = min(((self.rank[m], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))
                            if (m := self.id_of.get(self.pieces[a] + self.pieces[b])) in self.rank), default=None)
                if best is None:
                    break
                k = best[1]
                symbols[k:k + 2] = [self.id_of[self.pieces[symbols[k]] + self.pieces[symbols[k + 1]]]]
            if len(symbols) == 2:
                self.parts[i] = (symbols[0], symbols[1])

    def _prefix(self, text: str) -> int | None:
        """Longest proper prefix that is a usable piece."""
        for n in range(len(text) - 1, 0, -1):
            i = self.id_of.get(text[:n])
            if i in self.parts:
                return i
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave ``left`` and ``right`` apart when they stand side by side.

        The later of the two is unmerged step by step; if at some moment the two pieces at the seam
        could merge before the next recorded merge, the seam would not have survived.
        """
        rank, parts, pieces, id_of = self.rank, self.parts, self.pieces, self.id_of
        a, b, next_merge = left, right, len(pieces)
        while True:
            over_seam = rank.get(id_of.get(pieces[a] + pieces[b]), next_merge)
            if over_seam < next_merge:
                good = False
                break
            if len(pieces[a]) == 1 == len(pieces[b]):
                good = True
                break
            if rank[a] > rank[b]:
                next_merge, a = rank[a], parts[a][1]
            else:  # at equal order the seam lies further left and merges first
                next_merge, b = rank[b] + 1, parts[b][0]
        if len(self.fits) >= FIT_PAIRS:
            self.fits.clear()
        self.fits[left << 32 | right] = good
        return good

    def _run(self, text: str) -> list[int]:
        """Pieces of a text all of whose characters are pieces."""
        size = len(text)
        longest = [-1] * (size + 1)
        for end, (i, n) in self.automaton.iter(text):
            longest[end - n + 1] = i  # ends ascend: the last match that starts here is the longest
        length, fits = self.length, self.fits
        failed, out, at, last, token = bytearray(size + 1), [], 0, -1, longest[0]
        while True:
            end = at + length[token]
            if not failed[end]:
                good = last < 0 or fits.get(last << 32 | token)
                if good is None:
                    good = self.compatible(last, token)
                if good:
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            while token is None:  # no piece fits here: mark the position and shorten the piece before it
                failed[at] = 1
                at -= length[out[-1]]
                token = self.shorter[out.pop()]
                last = out[-1] if out else -1

    def _core(self, text: str) -> list[int]:
        """Ids of a unit: at most one space mark, at its start; unknown characters become bytes."""
        if self.characters.issuperset(text):
            return self._run(text)
        out: list[int] = []
        begin = 0
        for k, c in enumerate(text):
            if c not in self.characters:
                out += self._run(text[begin:k]) if k > begin else []
                out += [self.byte_id.get(b, self.unknown) for b in c.encode()]
                begin = k + 1
        return out + (self._run(text[begin:]) if begin < len(text) else [])

    def _spaces(self, n: int) -> list[int]:
        """A run of space marks, longest pieces first."""
        out, most = [], max(self.spaces)
        while n:
            k = min(n, most)
            while k not in self.spaces:
                k -= 1
            out.append(self.spaces[k])
            n -= k
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` as the library gives them without begin and end marks."""
        joined = self.encode_joined(text)[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: bytes are joined, the first space mark is the one encoding added."""
        marked = self._pieces(ids)
        return (marked[1:] if marked[:1] == SPACE else marked).replace(SPACE, " ")

    def _pieces(self, ids: list[int]) -> str:
        """Concatenated pieces, with runs of byte pieces read as UTF-8."""
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            b = self.bytes.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def _word(self, unit: str) -> str:
        """Ids of a unit, joined by commas. A kept unit has been decoded again and found equal."""
        known = self.old.get(unit)
        if known is None:
            ids = self._core(unit)
            known = ",".join([self.names[i] for i in ids])
            if "".join([self.plain_text[i] for i in ids]) != unit and (decoded := self._pieces(ids)) != unit:
                self.odd[unit] = decoded
        if len(unit) <= CACHE_WORD_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[unit] = known
        return known

    def encode_joined(self, text: str) -> tuple[str, str]:
        """Ids of a text joined by commas, and the text decoded from them.

        No piece crosses from a character to a space mark, and line breaks are no part of any
        piece, so the text falls into independent units that begin with either; units recur, and
        their ids are kept in memory. Runs of space marks are joined with the unit behind them.
        """
        if not text:
            return "", ""
        marked = SPACE + text.replace(" ", SPACE)
        if "\x00" in text:
            units = re.findall(f"[{SPACE}\n][^{SPACE}\n]*", marked)
        else:
            units = marked.replace(SPACE, "\x00" + SPACE).replace("\n", "\x00\n").split("\x00")[1:]
        get, word = self.young.get, self._word
        if SPACE not in units:
            ids = ",".join([get(u) or word(u) for u in units])
        else:
            ids = ",".join(self._with_runs(units))
        decoded = "".join([self.odd.get(u, u) for u in units]) if self.odd else marked
        return ids, decoded[1:].replace(SPACE, " ")

    def _with_runs(self, units: list[str]) -> Iterator[str]:
        run, mark = 0, str(self.id_of[SPACE])
        for unit in units:
            if unit == SPACE:
                run += 1
                continue
            ids = self.young.get(unit) or self._word(unit)
            if run:
                if ids == mark or ids.startswith(mark + ","):  # the mark of this unit stands alone and belongs to the run
                    run, ids = run + 1, ids[len(mark) + 1:]
                yield ",".join(map(str, self._spaces(run)))
                run = 0
            if ids:
                yield ids
        if run:
            yield ",".join(map(str, self._spaces(run)))


    def encode_batch(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """As ``encode_joined`` for an array of non-null texts; each distinct unit is looked up once, in sorted order."""
        plain = pc.invert(pc.match_substring_regex(texts, f"^$|^[ {SPACE}]|[ {SPACE}]$|[ {SPACE}][ {SPACE}\n]|\x00"))
        marked = pc.replace_substring(texts.filter(plain), SPACE, " ")
        marked = pc.replace_substring(pc.replace_substring(marked, " ", "\x00" + SPACE), "\n", "\x00\n")
        units = pc.split_pattern(pc.binary_join_element_wise(SPACE, marked, ""), "\x00")
        coded = units.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids: list[str] = [""] * len(words)
        for k in sorted(range(len(words)), key=words.__getitem__):
            ids[k] = self.young.get(words[k]) or self._word(words[k])
        joined = pc.binary_join(pa.ListArray.from_arrays(units.offsets, pa.array(ids, pa.string()).take(coded.indices)), ",")
        back = pa.array([self.odd.get(w, w) for w in words], pa.string()).take(coded.indices) if self.odd else units.flatten()
        decoded = pc.binary_join(pa.ListArray.from_arrays(units.offsets, back), "")
        decoded = pc.replace_substring(pc.utf8_slice_codeunits(decoded, 1), SPACE, " ")
        if pc.all(plain).as_py() is not False:
            return joined, decoded
        rest = [self.encode_joined(t.as_py()) for t in texts.filter(pc.invert(plain))]
        # fast rows first, then the others; back to the order of the texts
        flags = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(texts), dtype=np.int64)
        place[np.flatnonzero(flags)] = np.arange(int(flags.sum()))
        place[np.flatnonzero(~flags)] = np.arange(int(flags.sum()), len(texts))
        both = [pa.concat_arrays([x, pa.array([r[i] for r in rest], pa.string())]).take(pa.array(place)) for i, x in enumerate((joined, decoded))]
        return both[0], both[1]


def codec(model_file: str) -> MergeCodec:
    """The codec of a model file, built once in each process."""
    return kept(f"codec {model_file}", lambda: MergeCodec(model_file))


def _slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i - start
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, len(sizes) - start


def _digest(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())


def _round_trip(model_file: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for whole in batches:
            at = whole.schema.get_field_index("sp_text")
            for start, count in _slices(whole.column(at)):
                batch = whole.slice(start, count)
                joined, decoded = own.encode_batch(pc.fill_null(batch.column(at), ""))
                counts = pc.if_else(pc.equal(joined, ""), 0, pc.add(pc.count_substring(joined, ","), 1)).cast(pa.int64())
                if with_ids:
                    flat = pc.split_pattern(joined, ",").flatten()
                    flat = flat.filter(pc.not_equal(flat, "")).cast(pa.int32())
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts.to_numpy()))), pa.int32()), flat)
                else:
                    ids, decoded = _digest(joined), _digest(decoded)
                names = [n for i, n in enumerate(batch.schema.names) if i != at] + ["n_tokens", "ids", "decoded"]
                columns = [c for i, c in enumerate(batch.columns) if i != at] + [counts, ids, decoded]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()
    return run


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Encode and decode every whole text: kept columns plus ``n_tokens``, ``ids``, ``decoded``.

    ``ids`` is the id array and ``decoded`` the text; with ``digests`` both are SHA-256 hex strings
    (of the decimal ids joined by commas, and of the UTF-8 text) and the long values stay in the
    worker. A null text counts as empty: no ids, empty text. Rows are independent: one narrow stage
    without shuffle, memory bounded by a batch. ``keep`` defaults to all other columns; columns
    named like the results are replaced.
    """
    fresh = {"n_tokens", "ids", "decoded", "sp_text"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in fresh]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("sp_text"))
    kinds = "n_tokens long, ids string, decoded string" if digests else "n_tokens long, ids array<int>, decoded string"
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "sp_text"], kinds])
    return source.mapInArrow(_round_trip(model_file, not digests), schema)
