"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a
word is the sum over all its segmentations into pieces (forward algorithm); pieces never cross
word ends, so the likelihood of a text is the product over its words. The probabilities are
estimated by expectation-maximisation (forward-backward) on word counts of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.worker import kept, release, trim
from quire.session import stored

SPACE = "▁"
UNDETERMINED = "und"
MAX_LABELS = 2000
#: Letters of a word that the vectorised pass takes; longer words are scored one by one with rescaling.
LONG_WORD = 40
CACHE_UNITS = 80_000
BATCH_BYTES = 2 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(unit: str) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for w in _LETTERS.findall(unit.lower()) if any(c.isalpha() for c in w)]


@dataclass
class Lattice:
    """All piece matches of a batch of words, as edge arrays."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    sizes: np.ndarray


@dataclass
class PieceModel:
    """Piece probabilities of each language: ``table[piece, language]``; the last row is the unknown character."""

    pieces: list[str]
    labels: list[str]
    table: np.ndarray
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"pieces": self.pieces, "labels": self.labels, "table": self.table, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.pieces):
                self._automaton.add_word(p, (i, len(p)))
            self._automaton.make_automaton()
        return self._automaton

    def lattice(self, words: list[str]) -> Lattice:
        """Edges of all words (with the space mark in front); characters without a piece get an unknown edge."""
        word, start, end, piece, unknown = [], [], [], [], len(self.pieces)
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        search = self.automaton.iter
        for k, w in enumerate(words):
            covered = set()
            for at, (i, n) in search(SPACE + w):
                word.append(k)
                start.append(at + 1 - n)
                end.append(at + 1)
                piece.append(i)
                if n == 1:
                    covered.add(at)
            if len(covered) <= len(w):
                for at in range(len(w) + 1):
                    if at not in covered:
                        word.append(k)
                        start.append(at)
                        end.append(at + 1)
                        piece.append(unknown)
        return Lattice(*[np.array(x, dtype=np.int64) for x in (word, start, end, piece)], sizes)

    def forward(self, net: Lattice, label: int | None = None) -> np.ndarray:
        """Prefix sums ``[position, word, language]`` over all segmentations."""
        table = self.table if label is None else self.table[:, label:label + 1]
        n, top, langs = len(net.sizes), int(net.sizes.max(initial=0)), table.shape[1]
        alpha = np.zeros((top + 1, n, langs))
        alpha[0] = 1.0
        order = np.argsort(net.end, kind="stable")
        bounds = np.searchsorted(net.end[order], np.arange(1, top + 2))
        for e in range(1, top + 1):
            take = order[bounds[e - 1]:bounds[e]]
            w = net.word[take]
            value = alpha[net.start[take], w] * table[net.piece[take]]
            for j in range(langs):
                alpha[e, :, j] = np.bincount(w, value[:, j], n)
        return alpha

    def backward(self, net: Lattice, label: int) -> np.ndarray:
        """Suffix sums ``[position, word]`` for one language."""
        table = self.table[:, label]
        n, top = len(net.sizes), int(net.sizes.max(initial=0))
        beta = np.zeros((top + 1, n))
        beta[net.sizes, np.arange(n)] = 1.0
        order = np.argsort(net.start, kind="stable")
        bounds = np.searchsorted(net.start[order], np.arange(0, top + 1))
        for s in range(top - 1, -1, -1):
            take = order[bounds[s]:bounds[s + 1]]
            w = net.word[take]
            beta[s] += np.bincount(w, beta[net.end[take], w] * table[net.piece[take]], n)
        return beta

    def expected(self, words: list[str], counts: np.ndarray, label: int) -> np.ndarray:
        """Expected uses of each piece in the words of one language."""
        net = self.lattice(words)
        alpha, beta = self.forward(net, label)[:, :, 0], self.backward(net, label)
        whole = alpha[net.sizes, np.arange(len(words))]
        weight = alpha[net.start, net.word] * self.table[net.piece, label] * beta[net.end, net.word]
        weight *= np.where(whole > 0, counts / np.where(whole > 0, whole, 1), 0)[net.word]
        return np.bincount(net.piece, weight, len(self.pieces) + 1)

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Log of the summed likelihood of each word in each language."""
        out = np.zeros((len(words), len(self.labels)))
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        if short:
            net = self.lattice([words[k] for k in short])
            alpha = self.forward(net)
            out[short] = np.log(np.maximum(alpha[net.sizes, np.arange(len(short))], 1e-300))
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = self._rescaled(w)
        return out

    def _rescaled(self, word: str) -> np.ndarray:
        """The forward pass of one long word, rescaled at each position."""
        net = self.lattice([word])
        order = np.argsort(net.end, kind="stable")
        size, reach = len(word) + 1, max(map(len, self.pieces), default=1)
        bounds = np.searchsorted(net.end[order], np.arange(1, size + 2))
        alpha, scale = np.zeros((size + 1, len(self.labels))), np.zeros(len(self.labels))
        alpha[0] = 1.0
        for e in range(1, size + 1):
            take = order[bounds[e - 1]:bounds[e]]
            alpha[e] = (alpha[net.start[take]] * self.table[net.piece[take]]).sum(axis=0)
            top = np.maximum(alpha[e], 1e-300)
            alpha[max(0, e - reach):e + 1] /= top
            scale += np.log(top)
        return scale + np.log(np.maximum(alpha[size], 1e-300))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo 4, is 2. Null ids: false."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def vocabulary(model_file: str) -> list[str]:
    """Lower-case pieces of letters of a public vocabulary, with or without the space mark, in id order."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in dict.fromkeys(found) if p == SPACE or (body := p.removeprefix(SPACE)) and body.isalpha() and body == body.lower()]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for unit in (text or "").split():
                counts[lang, unit] = counts.get((lang, unit), 0) + 1
        merged: dict[tuple[str, str], int] = {}
        for (lang, unit), n in counts.items():
            for w in words_of(unit):
                if len(w) <= LONG_WORD:
                    merged[lang, w] = merged.get((lang, w), 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in merged], pa.string()), pa.array([k[1] for k in merged], pa.string()), pa.array(list(merged.values()), pa.int64())],
            names=["lang", "word", "n"])


def train(docs: DataFrame, model_file: str, docs_per_label: int = 1200, rounds: int = 3, smoothing: float = 0.1) -> PieceModel | None:
    """Fit the piece probabilities on labelled documents that are not held out; None without such documents.

    The fit uses a bounded sample: of each label about ``docs_per_label`` whole documents, chosen by
    a hash of the id. The word counts, and the expected piece counts of every round, are aggregated
    by Spark; the driver sees one number for each piece and language, both bounded.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").count().limit(MAX_LABELS + 1).collect()
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    if not sizes:
        return None
    share = {r["lang"]: min(1.0, docs_per_label / r["count"]) for r in sizes}
    chance = F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < chance * 1_000_000).select("lang", "text")
    counts = sample.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "words")
    pieces, labels = vocabulary(model_file), sorted(share)
    table = np.full((len(pieces) + 1, len(labels)), 1.0 / (len(pieces) + 1))
    model = PieceModel(pieces, labels, table)
    for _ in range(rounds):
        uses = np.zeros_like(table)
        for r in counts.mapInArrow(_expectation(model), "label int, piece int, n double").groupBy("label", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            uses[r["piece"], r["label"]] = r["n"]
        uses += smoothing
        model = PieceModel(pieces, labels, uses / uses.sum(axis=0))
    return model


def _expectation(model: PieceModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros_like(model.table)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                langs, words, counts = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
                for j, label in enumerate(model.labels):
                    own = [k for k, x in enumerate(langs) if x == label]
                    if own:
                        total[:, j] += model.expected([words[k] for k in own], np.array([counts[k] for k in own], dtype=float), j)
        piece, label = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, label])], names=["label", "piece", "n"])
    return run


class Scorer:
    """Sums of word likelihoods of whole texts; recurring units are kept, their values in one table of ``CACHE_UNITS`` rows."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.kept: dict[str, int] = {}
        self.table = np.zeros((CACHE_UNITS, len(model.labels) + 1))

    def _values(self, units: list[str]) -> np.ndarray:
        """For each unit the log likelihoods of its words, added up, and their number."""
        cut = [words_of(u) for u in units]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        place: dict[str, int] = {}
        index = np.fromiter((place.setdefault(w, len(place)) for ws in cut for w in ws), np.int64, int(counts.sum()))
        distinct = list(place)
        out = np.zeros((len(units), self.table.shape[1]))
        if not distinct:
            return out
        found = np.concatenate([self.model.log_likelihood(distinct[at:at + 8192]) for at in range(0, len(distinct), 8192)])
        owner = np.repeat(np.arange(len(units)), counts)
        for j in range(found.shape[1]):
            out[:, j] = np.bincount(owner, found[index, j], len(units))
        out[:, -1] = counts
        return out

    def _learn(self, units: list[str]) -> np.ndarray:
        """Values of distinct units; new ones are kept, and all older ones dropped when the table is full."""
        at = np.fromiter((self.kept.get(u, -1) for u in units), np.int64, len(units))
        new = np.flatnonzero(at < 0)
        out = self.table[at]
        if len(new):
            out[new] = self._values([units[k] for k in new.tolist()])
            if len(self.kept) + len(new) > CACHE_UNITS:
                self.kept = {}
            room = new[:CACHE_UNITS - len(self.kept)]
            first = len(self.kept)
            self.table[first:first + len(room)] = out[room]
            self.kept.update({units[k]: first + i for i, k in enumerate(room.tolist())})
        return out

    def sums(self, texts: pa.Array) -> np.ndarray:
        """For each text the log likelihoods and, last, the number of words."""
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        width, rows = len(self.model.labels) + 1, self._learn(units)
        index = coded.indices.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        # sums over slices of one long gather, in pieces to bound memory
        out = np.zeros((len(texts), width))
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for j in range(width):
            out[:, j] = np.bincount(owner, rows[index, j], len(texts)) if len(index) else 0.0
        return out


def _slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i - start
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, len(sizes) - start


def identify(docs: DataFrame, model: PieceModel | None, text: str = "text") -> DataFrame:
    """All columns plus ``lang_pred`` and ``score``, from the text alone.

    ``score`` is the posterior of the predicted language under equal priors. A text that is null or
    has no letter, and every text when nothing could be learned, is ``und`` with score 0. Ties go to the
    first label in order. Columns named like the results are replaced; repeated rows and extra
    columns stay. One narrow stage.
    """
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "lid_text")]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    if model is None:
        return base.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    key = f"language {uuid.uuid4()}"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(shared.value))
        for whole in batches:
            at = whole.schema.get_field_index("lid_text")
            for start, count in _slices(whole.column(at)):
                batch = whole.slice(start, count)
                sums = scorer.sums(pc.fill_null(batch.column(at), ""))
                logs = sums[:, :-1]
                best = logs.argmax(axis=1)
                share = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                seen = sums[:, -1] > 0
                labels = [shared.value.labels[b] if s else UNDETERMINED for b, s in zip(best, seen)]
                names = [n for i, n in enumerate(batch.schema.names) if i != at] + ["lang_pred", "score"]
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(labels, pa.string()), pa.array(np.where(seen, share, 0.0))], names=names)
        trim()

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema], "lang_pred string, score double"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("lid_text")).mapInArrow(run, schema)
