"""Main text of web pages by two passes of block rules.

The first pass classes each block by stop-word density, length and link density, with the part of
the page it stands in as a prior; the second gives ambiguous short blocks the label of the nearest
decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Frequent function words of four languages.
STOP_WORDS = frozenset((
    "a about after all also an and any are as at be been but by can did do for from had has have he her his how i if in into is it its just me more my no not of on one "
    "or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist kann mit nach nicht noch nur oder sich sie sind so "
    "über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur "
    "un une vous y "
    "al como con cuando de del desde donde el ella en entre era es esta este esto fue ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre "
    "son su sus también tiene un una y ya").split())

# Elements of the page grammar.
#: Their content is text up to the closing tag, or to the end of the page.
RAW = "script style noscript iframe textarea title"
#: Their content is markup that is not part of the text.
HIDDEN = frozenset("template svg math object select button canvas video audio".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                    "html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("nav footer aside form menu dialog header".split())
#: Elements that an opening tag ends, and those beyond which it does not look for them.
ENDS = {"li": (("li",), BLOCKS - {"address", "div", "p", "li"}), "dt": (("dt", "dd"), BLOCKS - {"address", "div", "p", "dt", "dd"}),
        "dd": (("dt", "dd"), BLOCKS - {"address", "div", "p", "dt", "dd"}), "td": (("td", "th"), frozenset(["tr", "table"])), "th": (("td", "th"), frozenset(["tr", "table"])),
        "tr": (("tr",), frozenset(["table"])), "option": (("option",), BLOCKS - {"option"})}
#: Inline elements whose closing tag leaves open blocks inside them open.
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())

_TOKEN = re.compile(
    r"<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW.replace(' ', '|')})(?![\w:-])(?!/>|[^>]*+(?<=[\s\"']/)>)[^>]*>[\s\S]*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.IGNORECASE)
_MARK = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|popup|modal|comments?|commentlist|disqus|replies|reactions?|sidebar|widget|menu|navbar|nav|"
    r"navigation|breadcrumbs?|footer|masthead|header|social|share|sharing|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|tags|copyright|"
    r"legal|disclaimer|toolbar|contentinfo|complementary)(?:$|[\s_-])", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the first pass, in characters and shares of words."""

    link_density: float = 0.33
    short: int = 70
    long: int = 200
    stop_low: float = 0.22
    stop_high: float = 0.30


@dataclass
class Block:
    text: str
    link_chars: int
    inside: bool   # in the article or main part
    framed: bool   # in a menu, footer, form, or a part whose class names it so
    heading: bool
    label: str = ""


def blocks(page: str) -> tuple[list[Block], bool]:
    """Text blocks in page order, and whether the page marks its main part. One pass over the tokens."""
    out: list[Block] = []
    # name, inside, framed, and from which depth on hidden (0: not); an element that ended before what stands in it has no name
    stack: list[tuple[str, bool, bool, int]] = []
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places of the open elements of a name in the stack
    open_blocks: list[int] = []
    parts: list[str] = []
    link_chars, marked = 0, False
    heading = False

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        if text:
            depth = stack[-1][3] - 1 if stack and stack[-1][3] else len(stack)
            _, inside, framed, _ = stack[depth - 1] if depth else ("", False, False, 0)
            out.append(Block(text, link_chars, inside, framed, heading))
        parts.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if stack and stack[-1][3]:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if opened["a"]:
            link_chars += len(text.strip())

    def cut(k: int) -> None:
        while len(stack) > k:
            name = stack.pop()[0]
            if name:
                opened[name].pop()
            if open_blocks and open_blocks[-1] == len(stack):
                open_blocks.pop()

    def close(name: str) -> None:
        if not opened[name]:
            return
        k = opened[name][-1]
        if name in FORMAT and open_blocks and open_blocks[-1] > k:
            opened[name].pop()
            stack[k] = ("", *stack[k][1:])
        else:
            cut(k)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at:token.start()])
        at = token.end()
        if token.group().startswith("<![CDATA["):
            add(token.group()[9:].removesuffix("]]>"))
            continue
        name = (token[3] or token[6] or "").lower()
        if not name:
            continue
        closing, attributes = token[2] or token[5], token[4] or token[7] or ""
        if name == "br":
            parts.append(" ")
            continue
        if stack and stack[-1][3] and not closing and name in BLOCKS:  # drawings and formulas left open end at a block of the page
            drawn = max((opened[n][-1] for n in ("svg", "math") if opened[n]), default=-1)
            if drawn >= 0 and not any(opened[n] and opened[n][-1] > drawn for n in ("foreignobject", "desc", "annotation-xml")):
                cut(min(opened[n][0] for n in ("svg", "math") if opened[n]))
        hidden = stack[-1][3] if stack else 0
        if closing:
            if name in BLOCKS and (not hidden or opened[name] and not stack[opened[name][-1]][3]):
                flush()
                heading = False
            close(name)
            continue
        if name in BLOCKS and not hidden:
            flush()
        if name in VOID:
            continue
        if not hidden:
            if name in ENDS:
                ended, beyond = ENDS[name]
                least = max((opened[n][-1] for n in beyond if opened[n]), default=-1)
                found = [opened[n][-1] for n in ended if opened[n] and opened[n][-1] > least]
                if found:
                    cut(min(found))
            if name == "a":
                close("a")
            if name in BLOCKS:  # inline elements left open in a paragraph end with it
                if open_blocks and stack[open_blocks[-1]][0] == "p":
                    cut(open_blocks[-1])
                heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        _, inside, framed, _ = stack[-1] if stack else ("", False, False, 0)
        main = name in ("article", "main") or bool(re.search(r"""role\s*=\s*["']?main\b""", attributes, re.IGNORECASE))
        marked |= main and not hidden
        named = " ".join(x for m in _MARK.findall(attributes) for x in m if x) if "=" in attributes else ""
        # the header of an article holds its title; any other header belongs to the page
        frame = name in FRAME and not (name == "header" and (inside or main)) or (name not in ("body", "html", "article", "main") and bool(_BOILER.search(named)))
        frame |= bool(attributes and _HIDDEN.search(attributes))
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        opened[name].append(len(stack))
        if name in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((name, inside or main, framed or frame, hidden or (len(stack) + 1 if name in HIDDEN else 0)))
    if at < len(page):
        tail = page[at:]
        add(tail if "<" not in tail else re.sub(r"<[a-zA-Z/!?][\s\S]*\Z", "", tail))
    flush()
    return out, marked


def classify(found: list[Block], marked: bool, rules: BlockRules = BlockRules()) -> list[Block]:
    """Label the blocks ``good`` or ``bad`` in two passes."""
    for b in found:
        size = len(b.text)
        words = _WORD.findall(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if b.framed or marked and not b.inside:
            b.label = "bad"
        elif b.link_chars > rules.link_density * size:
            b.label = "bad"
        elif marked:  # inside the main part only links and frames are suspect; text of any kind belongs to the article
            b.label = "good" if size >= rules.short or b.heading or not b.link_chars else "short"
        elif size < rules.short:
            b.label = "bad" if b.text[:1] == "©" else "short"
        elif density >= rules.stop_high:
            b.label = "good" if size > rules.long else "near"
        elif density >= rules.stop_low:
            b.label = "near"
        else:
            b.label = "bad"
    # second pass: the nearest decided block on each side, found by one sweep each way
    size, decided = len(found), [k for k, b in enumerate(found) if b.label in ("good", "bad")]
    if not decided:
        for b in found:
            b.label = "good"
        return found
    any_good = any(found[k].label == "good" for k in decided)
    before, after = [-1] * size, [-1] * size
    for order, table in ((range(size), before), (range(size - 1, -1, -1), after)):
        seen = -1
        for k in order:
            table[k] = seen
            if found[k].label in ("good", "bad"):
                seen = k
    first = [b.label for b in found]
    for k, b in enumerate(found):
        if first[k] in ("good", "bad"):
            continue
        up = first[before[k]] if before[k] >= 0 else "bad"
        down = first[after[k]] if after[k] >= 0 else "bad"
        if b.heading:
            b.label = down
        elif up == down:
            b.label = up if first[k] == "short" or any_good else "good"
        elif first[k] == "near":
            b.label = "good"
        else:  # the closer one; the one before at equal distance
            b.label = up if before[k] >= 0 and (after[k] < 0 or k - before[k] <= after[k] - k) else down
    return found


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The article's blocks in page order, one in a line."""
    if not page:
        return ""
    found, marked = blocks(page)
    if marked and not any(b.inside and not b.framed for b in found):
        marked = False
    return "\n".join(b.text for b in classify(found, marked, rules) if b.label == "good")


def extract_pages(pages: DataFrame, column: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """All columns of ``pages`` except the markup, plus ``text`` and ``n_chars`` (code points).

    A null or empty page, and one without an article, gives an empty text. Pages are independent
    rows of one narrow stage: nothing is shuffled and memory is bounded by a batch. Columns that
    are named like the results are replaced; repeated rows and extra columns stay.
    """
    keep = [c for c in pages.columns if c != column and c.lower() not in ("text", "n_chars", "page_markup")]
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(column).cast("string").alias("page_markup"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("page_markup")
            texts = [main_text(x.as_py(), rules) for x in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=names + ["text", "n_chars"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "page_markup"], "text string, n_chars long"])
    return source.mapInArrow(run, schema)
