"""Personal data by weak supervision, with built-in functions only.

Four exact kinds (email, ip, card, phone) are found by pattern and validated. For looser candidates
regex, gazetteer, context and shape labelers vote; expectation-maximisation over the vote patterns
estimates how far each labeler can be trusted, and its posteriors train a span classifier whose
weights are part of the final expression.
"""

from __future__ import annotations

from dataclasses import dataclass
import math

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.staging import stage
from quire.session import stored

# The exact kinds, in their order. Possessive forms and the guards in front of them match the
# same spans as the plain patterns, without starting anew inside a run or going back in it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
KINDS = [*BASE, "secret", "ssn", "iban", "number"]
SECRET_WORDS = r"(?i:passwd|password|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]"
# Looser candidates, one alternative for each further kind. A secret's value has no upper length.
LOOSE = {
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|" + SECRET_WORDS + r"\s{0,3}[\"']?[A-Za-z0-9+/_.-]{6,}+",
    "ssn": r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: Holds wherever an alternative of ``LOOSE`` does: secrets need no digit, the other kinds do.
LOOSE_GATE = r"[0-9]|AKIA|" + SECRET_WORDS
# Gazetteers and cue words.
GAZETTEER = r"AKIA|(?i:passw|pwd|secret|token|key)|^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PT)[0-9]{2}|^\(?0"
CUES = r"(?i)(?:phone|tel|mobile|call|fax|contact|account|konto|compte|cuenta|ssn|social|security|card|passw|secret|token|key|credential|login|kontakt|telefon|tél|teléfono)[^\n]{0,20}$"
COUNTER_CUES = r"(?i)(?:isbn|issn|page|seite|página|version|chapter|kapitel|figure|table|section|vol|no)\.?[^\n]{0,6}$"
LABELERS = ["strict", "known", "context", "shape"]
CONTEXT = 40
KIND_FIELD = "struct<kind:int,start:int,end:int>"


def matches(df: DataFrame, text: str, pattern: str, gate: Column, name: str) -> DataFrame:
    """``df`` with ``name``: array of ``(start, end, match)``, code points, for the leftmost matches that don't overlap.

    The parts between the matches give the positions. Both lists are taken once, and only where the gate holds.
    """
    source = F.when(gate, F.col(text))
    cut = stage(df, _found=F.coalesce(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")))
    some = F.size("_found") > 0
    cut = stage(cut, _parts=F.when(some, F.split(F.col(text), pattern, -1)))
    pairs = F.zip_with(F.slice("_parts", 1, F.size("_found")), F.col("_found"), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["m"].alias("match")))).alias("out"))
    placed = F.when(some, F.aggregate(pairs, begin, step)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    return stage(cut, **{name: placed}).drop("_found", "_parts")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def step(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    size = F.length(_digits(match))
    if kind == "card":
        return F.when(size.between(12, 19), luhn(_digits(match))).otherwise(False)
    return size.between(9, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: the valid spans of the exact kinds as ``(kind, start, end)`` in order of start, then kind."""
    out = docs
    for kind, pattern in BASE.items():
        gate = F.contains("text", F.lit("@")) if kind == "email" else F.col("text").rlike(GATE[kind])
        out = matches(out, "text", pattern, gate, f"_{kind}")
    def valid(kind: str) -> Column:
        kept = F.filter(f"_{kind}", lambda m: _valid(kind, m["match"]))
        return F.transform(kept, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    spans = [valid(kind) for kind in BASE]
    out = stage(out, base=_in_order(F.concat(*spans)))
    return out.drop(*[f"_{kind}" for kind in BASE])


def _in_order(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``base``) plus ``loose``: candidates with their votes.

    Votes are 1 (personal), -1 (not) or 0 (no opinion): ``strict`` by the form of the kind, ``known`` by
    gazetteer, ``context`` by the words in front, ``shape`` by the variety of characters. Candidates
    that overlap an exact span are left to it.
    """
    pattern = "|".join(f"(?:{p})" for p in LOOSE.values())
    out = matches(docs, "text", pattern, F.col("text").rlike(LOOSE_GATE), "_loose")

    def kind_of(m: Column) -> Column:
        found = [F.when(m.rlike(f"^(?:{p.replace('(?<![0-9A-Za-z.+-])', '').replace('(?<![A-Za-z0-9])', '').replace('(?<![0-9A-Za-z+.-])', '')})$"), F.lit(KINDS.index(k))) for k, p in LOOSE.items()]
        return F.coalesce(*found, F.lit(len(KINDS) - 1))

    def vote(positive: Column, negative: Column) -> Column:
        return F.when(positive, F.lit(1)).when(negative, F.lit(-1)).otherwise(F.lit(0))

    def candidate(c):
        m, kind = c["match"], kind_of(c["match"])
        size, digits = F.length(_digits(m)), _digits(m)
        before = F.substring(F.col("text"), F.greatest(c["start"] - CONTEXT + 1, F.lit(1)), F.least(c["start"], F.lit(CONTEXT)))
        secret, number = F.lit(KINDS.index("secret")), F.lit(KINDS.index("number"))
        return F.struct(
            kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            vote(F.when(kind == secret, m.rlike(r"AKIA[0-9A-Z]{16}|[=:]\s*[\"']?[A-Za-z0-9+/_-]{16,}")).when(kind == number, size.between(9, 11)).otherwise(True),
                 (kind == number) & (size < 9)).alias("strict"),
            vote(m.rlike(GAZETTEER), F.lit(False)).alias("known"),
            vote(before.rlike(CUES), before.rlike(COUNTER_CUES)).alias("context"),
            vote(F.length(F.regexp_replace(digits, r"(.)\1{2,}", "")) * 2 > F.greatest(size, F.lit(1)), digits.rlike(r"^(.)\1*$") | (size < 4)).alias("shape"),
            F.least(F.floor(F.length(m) / 12).cast("int"), F.lit(3)).alias("long"))
    free = F.filter("_loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return stage(out, loose=F.transform(free, candidate)).drop("_loose")


@dataclass
class SpanModel:
    """Reliability of each labeler and weights of the classifier."""

    prior: float
    reliability: dict[str, dict[int, tuple[float, float]]]  # labeler -> vote -> (probability if not personal, if personal)
    weights: list[float]

    def probability(self, c: Column) -> Column:
        """Probability that a candidate is personal data, as an expression."""
        score = F.lit(0.0)
        for w, f in zip(self.weights, _features(c)):
            score = score + F.lit(w) * f
        return 1 / (1 + F.exp(-score))


def _features(c) -> list:
    """Features of a candidate: of a column, or of a plain dictionary."""
    plain = isinstance(c, dict)
    same = (lambda a, b: float(a == b)) if plain else (lambda a, b: (a == b).cast("double"))
    value = (lambda a: float(a)) if plain else (lambda a: a.cast("double"))
    return [value(F.lit(1)) if not plain else 1.0, *[value(c[x]) for x in LABELERS], *[same(c["long"], k) for k in (1, 2, 3)],
            *[same(c["kind"], k) for k in range(len(BASE), len(KINDS) - 1)]]


def fit(found: DataFrame, rounds: int = 25, steps: int = 300, rate: float = 0.5) -> SpanModel:
    """Estimate the labelers and train the classifier on all candidates of ``found``.

    Spark counts the candidates by kind, votes and length class; that table has a bounded number of
    rows (kinds times three to the number of labelers times four), and the estimation runs on it.
    """
    columns = ["kind", *LABELERS, "long"]
    table = found.select(F.explode("loose").alias("c")).select(*[F.col(f"c.{x}").alias(x) for x in columns]).groupBy(*columns).count()
    rows = [r.asDict() for r in table.orderBy(*columns).collect()]
    total = sum(r["count"] for r in rows)
    size = len(_features(dict.fromkeys(columns, 0)))
    if not total:
        return SpanModel(0.5, {}, [-1.0] + [0.0] * (size - 1))
    belief = [1 / (1 + math.exp(-sum(r[x] for x in LABELERS))) for r in rows]
    prior, trust = 0.5, {}
    for _ in range(rounds):
        prior = (1 + sum(b * r["count"] for b, r in zip(belief, rows))) / (2 + total)
        trust = {x: {} for x in LABELERS}
        for x in LABELERS:
            for v in (-1, 0, 1):
                good = 1 + sum(b * r["count"] for b, r in zip(belief, rows) if r[x] == v)
                bad = 1 + sum((1 - b) * r["count"] for b, r in zip(belief, rows) if r[x] == v)
                trust[x][v] = (bad / (3 + total * (1 - prior)), good / (3 + total * prior))
        for i, r in enumerate(rows):
            odds = math.log(prior / (1 - prior)) + sum(math.log(trust[x][r[x]][1] / trust[x][r[x]][0]) for x in LABELERS)
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    features, weights = [_features(r) for r in rows], [0.0] * size
    for _ in range(steps):
        slope = [1e-3 * w for w in weights]
        for f, b, r in zip(features, belief, rows):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * x for w, x in zip(weights, f))))))
            for k, x in enumerate(f):
                slope[k] += (p - b) * x * r["count"] / total
        weights = [w - rate * s for w, s in zip(weights, slope)]
    return SpanModel(prior, trust, weights)


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` for every row of ``docs(doc_id, text, ...)``: arrays of ``(kind, start, end)``.

    ``kind`` is an index of ``KINDS``, positions count code points and ends are exclusive. ``base`` are
    the exact spans; ``spans`` adds the candidates that the classifier accepts. A null text has none.
    Repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = stored(candidates(base_spans(source)).select("doc_id", "base", "loose"), "spans")
    model = fit(found)
    chosen = F.transform(F.filter("loose", lambda c: model.probability(c) >= threshold), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", "base", _in_order(F.concat("base", chosen)).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans are masked once, by the first."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise(acc["out"]).alias("out"))
    done = F.aggregate(spans, begin, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
