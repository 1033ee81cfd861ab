"""Extraction of a publication abstract from a landing page.

The meta-tag branch is a chain of regular expressions in the JVM. Finding a block by its
heading or selector needs a tree, so pages that may hold one go through Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.functions.markup import VOID_TAGS
from quire.functions.text import collapse, unescape_entities

# Meta keys tried in this order.
META_KEYS = ["citation_abstract", "dcterms.abstract", "DC.Description", "dc.Description", "og:description", "description"]
_HEADINGS = ("h2", "h3", "h4", "h5")


class _Tree(HTMLParser):
    """Nodes as ``[tag, attrs, parent, first text, last text]`` over one list of text pieces."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.nodes, self.text, self.open = [], [], []
        self.feed(page)
        self.close()
        for n in self.open:
            self.nodes[n][4] = len(self.text)

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None, len(self.text), len(self.text)])
        if tag not in VOID_TAGS:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]][0] == tag:
                for n in self.open[depth:]:
                    self.nodes[n][4] = len(self.text)
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.text.append(data)

    def words(self, n: int, glue: str = " ") -> str:
        node = self.nodes[n]
        return " ".join(glue.join(t.strip() for t in self.text[node[3]:node[4]] if t.strip()).split())

    def up(self, n: int) -> Iterator[int]:
        n = self.nodes[n][2]
        while n is not None:
            yield n
            n = self.nodes[n][2]

    def inside(self, n: int, parent: int) -> bool:
        return parent in self.up(n)


def _classes(node) -> list[str]:
    return node[1].get("class", "").split()


def _headed_block(t: _Tree) -> str:
    for i, node in enumerate(t.nodes):
        if node[0] in _HEADINGS and (
            node[1].get("data-name") == "abstract-title" or re.fullmatch(r"\s*abstract\s*", t.words(i), re.I)
        ):
            parents = list(t.up(i))
            box = next((p for p in parents if t.nodes[p][0] in ("div", "section", "article")), parents[0] if parents else None)
            if box is None:
                return ""
            chain = [box, *t.up(box)]
            card = next((p for p in chain if any(c == "card" or c.startswith("card__") for c in _classes(t.nodes[p]))), box)
            for j, inner in enumerate(t.nodes):
                if inner[0] == "p" and inner[1].get("data-name") == "content" and t.inside(j, card):
                    spans = [k for k, s in enumerate(t.nodes) if s[0] == "span" and t.inside(k, j)]
                    return " ".join(t.words(k, "") for k in spans) if spans else t.words(j, "")
            return ""
    return ""


def _known_block(t: _Tree) -> str:
    tests = [
        lambda n, i: n[1].get("id") == "Abs1-content",
        lambda n, i: n[0] == "section" and "Abstract" in _classes(n),
        lambda n, i: n[0] == "div" and "Abstract" in _classes(n),
        lambda n, i: n[0] == "div" and n[1].get("id") == "abstract",
        lambda n, i: n[0] == "section" and n[1].get("id") == "abstract",
        lambda n, i: n[0] == "div" and "article__abstract" in _classes(n),
        lambda n, i: "abstract" in _classes(n) and any(t.nodes[p][0] == "article" for p in t.up(i)),
    ]
    for test in tests:
        first = next((i for i, n in enumerate(t.nodes) if test(n, i)), None)
        if first is not None and len(t.words(first).split()) > 30:
            return t.words(first)
    return ""


@F.pandas_udf(T.StringType())
def _block_udf(pages: pd.Series) -> pd.Series:
    def block(page: str) -> str:
        tree = _Tree(page)
        return _headed_block(tree) or _known_block(tree)

    return pages.map(block, na_action="ignore")


def _word_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def _meta(page: Column, key: str) -> Column:
    attr = r"(?:name|property)\s*=\s*[\"']" + re.escape(key) + r"[\"']"
    tag = F.regexp_extract(page, r"(?is)<meta\b(?=[^>]*\b" + attr + r")[^>]*>", 0)
    quoted = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'[^']*')", 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*'([^']*)'", 1))


def extract_page_abstract(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``(key, abstract)``; empty unless a block or meta value of at least 40 words is found."""
    page = F.col(column)
    hint = page.rlike(r"(?i)abstract")
    rows = pages.select(key, _block_udf(F.when(hint, page)).alias("_b"), F.array(*[
        unescape_entities(_meta(page, k)) for k in META_KEYS]).alias("_m"))
    metas = F.filter(F.transform("_m", lambda m: collapse(m)), lambda m: (_word_count(m) >= 40) & ~m.endswith("..."))
    found = F.coalesce(F.nullif(collapse("_b"), F.lit("")), F.get(metas, F.lit(0)), F.lit(""))
    rows = rows.withColumn("_t", F.regexp_replace(found, r"(?iu)^(abstract|résumé|summary|zusammenfassung)\s*[:–—-]\s*", ""))
    return rows.select(key, F.when(_word_count(F.col("_t")) >= 40, F.col("_t")).otherwise("").alias("abstract"))
