"""Bibliographic text entries as field rows, and their contributor audit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.text import casefold, strip, to_ascii

_HEAD = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_FIELDS = "entry_type string, entry_key string, field string, value string, error string"


class _Bad(ValueError):
    pass


def _closing(text: str, start: int) -> int:
    """Offset behind the bracket that closes the one at ``start``."""
    pairs = {"{": "}", "(": ")"}
    depth, quoted, i = 0, False, start
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            i += 2
            continue
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch == text[start]:
            depth += 1
        elif not quoted and ch == pairs[text[start]]:
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    raise _Bad("unterminated entry or value")


def _entry(text: str) -> tuple[str, str, list[tuple[str, str]]]:
    head = _HEAD.search(text or "")
    if not (text or "").strip():
        raise _Bad("empty")
    if head is None:
        raise _Bad("no entry header")
    end = _closing(text, head.end() - 1)
    if text[end:].strip():
        raise _Bad("more than one entry")
    body = text[head.end():end - 1]
    key, comma, body = body.partition(",")
    if not comma:
        raise _Bad("key without fields")
    if not key.strip():
        raise _Bad("empty key")
    fields: dict[str, str] = {}
    at = 0
    while True:
        while at < len(body) and (body[at].isspace() or body[at] in ",%"):
            at = (body.find("\n", at) + 1 or len(body)) if body[at] == "%" else at + 1
        if at >= len(body):
            return head.group(1).lower(), key.strip(), list(fields.items())
        name = _NAME.match(body, at)
        if name is None:
            raise _Bad("unreadable field")
        field = name.group(0).lower()
        if field in fields:
            raise _Bad(f"duplicate field: {field}")
        rest = body[name.end():].lstrip()
        if not rest.startswith("="):
            raise _Bad(f"field {field} without '='")
        at = len(body) - len(rest[1:].lstrip())
        if at < len(body) and body[at] == "{":
            stop = _closing(body, at)
            fields[field] = body[at + 1:stop - 1]
        elif at < len(body) and body[at] == '"':
            quote = re.compile(r'(?<!\\)"').search(body, at + 1)
            if quote is None:
                raise _Bad("unterminated quoted value")
            stop = quote.end()
            fields[field] = body[at + 1:stop - 1]
        else:
            stop = re.compile(r"[,\n\r]|$").search(body, at).start()
            if stop == at:
                raise _Bad("missing value")
            fields[field] = body[at:stop].strip()
        at = stop


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for link, text in zip(frame["permalink"], frame["text"]):
            try:
                kind, key, fields = _entry(text)
                out.extend((link, kind, key, f, v, None) for f, v in fields)
                if not fields:
                    out.append((link, kind, key, None, None, None))
            except _Bad as error:
                out.append((link, None, None, None, None, str(error)))
        yield pd.DataFrame(out, columns=["permalink", "entry_type", "entry_key", "field", "value", "error"])


def parse_bib(texts: DataFrame) -> DataFrame:
    """``(permalink, text)`` rows, one entry each, to field rows; an unreadable entry is one row with its error."""
    return texts.select("permalink", "text").mapInPandas(_rows, "permalink string, " + _FIELDS)


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """One entry per file; the file name without suffix is the permalink."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.bib)?$", 1).alias("permalink"), F.col("value").alias("text"))
    return parse_bib(files)


# -- contributor audit --------------------------------------------------------------------

def split_people(c) -> Column:
    """Segments at ``and`` outside braces, blank ones included.

    Words inside braces are protected by shielding their blanks before the split.
    """
    c = F.col(c) if isinstance(c, str) else c
    chars = F.split(c, "")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.when(ch == "{", acc["depth"] + 1).when(ch == "}", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.array(F.when((depth > 0) & (ch == " "), F.lit("\x1f")).otherwise(ch))).alias("out"))

    shielded = F.when(c.contains("{"), F.array_join(F.aggregate(chars, start, step, lambda acc: acc["out"]), "")).otherwise(c)
    return F.transform(F.split(shielded, r"(?i)\s+and\s+"), lambda s: F.translate(strip(s), "\x1f", " "))


def name_key(c) -> Column:
    """Order-insensitive key of one name."""
    text = casefold(to_ascii(F.translate(c, "{}", "")))
    return F.array_join(F.sort_array(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))), " ")


def audit_bib(pubs: DataFrame, bib: DataFrame) -> DataFrame:
    """Findings of canonical contributors against bibliography files: missing, invalid, no field, malformed, mismatch.

    ``pubs``: id, permalink, authors, editors (name arrays). Each publication meets one row of
    its file: fields are gathered into a map first, bounded by the fields of an entry.
    """
    files = bib.groupBy("permalink").agg(
        F.max("error").alias("error"),
        F.map_from_entries(F.collect_list(F.when(F.col("field").isin("author", "editor"), F.struct("field", "value")))).alias("f"))
    rows = pubs.filter("permalink <> ''").join(files, "permalink", "left")
    whole = rows.select("id", F.lit("bib").alias("field"), F.when(F.col("f").isNull(), "missing file").when(
        F.col("error").isNotNull(), "invalid file").alias("kind")).filter("kind IS NOT NULL")
    ok = rows.filter("f IS NOT NULL AND error IS NULL")
    roles = F.explode(F.array(F.struct(F.lit("author").alias("field"), F.col("authors").alias("names")),
                              F.struct(F.lit("editor").alias("field"), F.col("editors").alias("names"))))
    each = ok.select("id", "f", roles.alias("r")).select("id", "r.field", "r.names", F.try_element_at("f", F.col("r.field")).alias("value"))
    each = each.filter(F.size("names") > 0).withColumn("parts", split_people("value"))
    keys = F.transform(F.filter("parts", lambda p: p != ""), name_key)
    kinds = F.when(F.col("value").isNull(), F.array(F.lit("missing field"))).otherwise(F.array_compact(F.array(
        F.when(F.exists("parts", lambda p: p == ""), F.lit("malformed list")),
        F.when(keys != F.transform("names", name_key), F.lit("mismatch")))))
    return whole.unionByName(each.select("id", "field", F.explode(kinds).alias("kind")))


def bib_repairs(findings: DataFrame, pubs: DataFrame, bib: DataFrame) -> DataFrame:
    """Proposed contributor values: drop empty segments or add the missing field; invalid files need review."""
    values = bib.filter("field IS NOT NULL").select("permalink", "field", "value")
    names = F.when(F.col("field") == "author", F.col("authors")).otherwise(F.col("editors"))
    rows = findings.filter("kind IN ('malformed list', 'missing field', 'invalid file')").join(
        pubs.select("id", "permalink", "authors", "editors"), "id").join(values, ["permalink", "field"], "left")
    clean = F.array_join(F.filter(split_people("value"), lambda p: p != ""), " and ")
    proposed = F.when(F.col("kind") == "malformed list", clean).when(F.col("kind") == "missing field", F.array_join(names, " and "))
    return rows.select("id", "field", "kind", proposed.alias("proposed_value"), proposed.isNotNull().alias("deterministic"))
