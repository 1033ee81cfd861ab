"""Chat formatting as a prefix tree of conversations.

Conversations that share their first turns share the tokens of those turns: each turn of the tree
is emitted once, depth first, as part of one stream. Every run of new turns carries its place in
the stream, the position id of its first token, and the intervals of the stream that its ancestors
take, which with the causal order inside the run are what its tokens may attend to.
"""

from __future__ import annotations

from collections.abc import Iterator
import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
import tiktoken

from quire.llm.worker import kept
from quire.session import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Ranks that one block of the running total holds.
BLOCK = 4096


def escape(text: str) -> str:
    """``text`` without control strings: a backslash doubles, ``<|`` becomes ``<`` backslash ``|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The inverse of ``escape`` and ``escape_role``."""
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0 and k + 1 < len(text):
        out.append(text[at:k])
        out.append("\n" if text[k + 1] == "n" else text[k + 1])
        at = k + 2
    return "".join(out) + text[at:]


def escape_role(role: str) -> str:
    """As ``escape``, with line breaks as backslash ``n``: a role takes one line."""
    return escape(role).replace("\n", "\\n")


def format_turn(role: str | None, text: str | None) -> str:
    """One turn of the template; null role or text: empty."""
    return f"{START}{escape_role(role or '')}\n{escape(text or '')}{END}\n"


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(START):-len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


class Tokens:
    """Byte-pair tokens of a public vocabulary, with the two marks of the template behind its last id."""

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.start, self.end = len(ranks) + 1, len(ranks) + 2
        self.coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={START: self.start, END: self.end})

    def turn(self, role: str | None, text: str | None) -> tuple[list[int], int, int]:
        """Ids of a turn, and the range of those of its text."""
        head = [self.start] + self._plain(escape_role(role or "") + "\n")
        body = self._plain(escape(text or ""))
        return head + body + [self.end] + self._plain("\n"), len(head), len(head) + len(body)

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), 1 << 16):  # escaped texts hold no marks; long ones go in stretches
            out += self.coder.encode_ordinary(text[at:at + (1 << 16)])
        return out

    def text(self, ids: list[int]) -> str:
        return self.coder.decode(ids)


def _coder(ranks_file: str, pattern: str) -> Tokens:
    return kept(f"chat {ranks_file}", lambda: Tokens(ranks_file, pattern))


def _chain(keys: list[bytes]) -> list[bytes]:
    """Key of each prefix of a conversation: a digest over the digest before it and the turn."""
    out, last = [], b""
    for k in keys:
        last = hashlib.blake2b(last + k, digest_size=16).digest()
        out.append(last)
    return out


def _turn_key(role: str | None, text: str | None) -> bytes:
    r = (role or "").encode()
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + (text or "").encode(), digest_size=16).digest()


def build_tree(conversations: DataFrame, ranks_file: str, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prefix tree of ``conversations(conv_id, turn, role, text)``: ``(runs, nodes, members)``.

    ``runs(run, tree, start, n_tokens, position, tokens, loss, ancestors)``: stretches of the stream, one
    for each conversation that adds turns; ``loss`` marks the tokens of assistant texts, ``ancestors`` are
    intervals ``[begin, end)`` of the stream. ``nodes(node, run, depth, begin, size)`` places each turn in
    the stream; ``members(conv_id, k, node)`` lists the turns of each conversation.

    Rows are ordered by turn (null turns first), equal turns by role and text; equal rows are
    separate turns. Null ids make one conversation, null texts and roles are empty. Other columns are
    ignored; an empty table gives an empty tree. One conversation is one row of one task; trees of
    any size are spread, since order comes from a range sort and totals from blocks of ranks.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.binary()), ("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            paths, turns = [], []
            for own in batch.column("turns").to_pylist():
                nodes = _chain([_turn_key(t["role"], t["text"]) for t in own])
                paths.append(b"".join(x[:8] for x in nodes))
                turns.append([{"node": n, "role": t["role"], "text": t["text"]} for n, t in zip(nodes, own)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), pa.array(turns, kind)], names=["conv_id", "path", "turns"])

    key = conversations.schema["conv_id"].dataType.simpleString()
    convs = whole.mapInArrow(run, f"conv_id {key}, path binary, turns array<struct<node: binary, role: string, text: string>>")
    # sorted paths are the depth-first order of the tree; the written table fixes the ranks
    ranked = stored(convs.orderBy("path", "conv_id").withColumn("rank", F.monotonically_increasing_id()), "ranked")
    flat = ranked.select("conv_id", "rank", F.posexplode("turns").alias("k", "t"))
    members = flat.select("conv_id", "k", F.col("t.node").alias("node"))
    # a turn belongs to the first conversation that has it
    owned = stored(flat.groupBy(F.col("t.node").alias("node")).agg(F.min(F.struct("rank", "k", "t.role", "t.text")).alias("o"))
                   .select("node", F.col("o.rank").alias("run"), F.col("o.k").alias("depth"), F.col("o.role").alias("role"), F.col("o.text").alias("text")), "owned")
    kind = "node binary, run long, depth int, tokens array<int>, loss array<boolean>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for batch in batches:
            tokens, loss = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                ids, begin, end = coder.turn(role, text)
                tokens.append(ids)
                loss.append([role == "assistant" and begin <= i < end for i in range(len(ids))])
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("run"), batch.column("depth"),
                                              pa.array(tokens, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], names=["node", "run", "depth", "tokens", "loss"])

    coded = stored(owned.mapInArrow(encode, kind), "coded")
    sizes = coded.groupBy("run").agg(F.sum(F.size("tokens")).alias("n_tokens"))
    # running total in two steps: blocks of neighbouring ranks, then ranks inside a block
    sizes = sizes.withColumn("block", F.floor(F.col("run") / BLOCK))
    totals = sizes.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("run")) - F.col("n_tokens")
    placed = stored(sizes.withColumn("inside", inside).join(before, "block").select("run", "n_tokens", (F.col("base") + F.col("inside")).alias("start")), "placed")
    in_run = F.sum(F.size("tokens")).over(Window.partitionBy("run").orderBy("depth")) - F.size("tokens")
    nodes = (coded.select("node", "run", "depth", F.size("tokens").alias("size"), in_run.alias("inside")).join(placed, "run")
             .select("node", "run", "depth", (F.col("start") + F.col("inside")).alias("begin"), "size"))
    nodes = stored(nodes, "nodes")
    # what lies above each run: the turns of its conversation that other runs own
    heads = nodes.groupBy("run").agg(F.min("depth").alias("first"))
    spots = F.struct("k", "begin", "size", "node")
    above = (flat.select("rank", "k", F.col("t.node").alias("node")).join(heads.withColumnRenamed("run", "rank"), "rank").where("k < first")
             .join(nodes.select("node", "begin", "size"), "node").groupBy(F.col("rank").alias("run"))
             .agg(F.array_sort(F.collect_list(spots)).alias("up")))
    merged = F.aggregate("up", F.array().cast("array<struct<begin:bigint,end:bigint>>"), lambda acc, s: F.when(
        F.get(acc, F.size(acc) - 1)["end"] == s["begin"],
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["begin"].alias("begin"), (s["begin"] + s["size"]).alias("end"))))
    ).otherwise(F.concat(acc, F.array(F.struct(s["begin"].alias("begin"), (s["begin"] + s["size"]).alias("end"))))))
    above = above.select("run", merged.alias("ancestors"), F.aggregate("up", F.lit(0).cast("long"), lambda a, s: a + s["size"]).alias("position"), F.get("up", F.lit(0))["node"].alias("root"))
    bodies = coded.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "tokens", "loss"))).alias("own"))
    runs = (bodies.join(placed, "run").join(above, "run", "left").select(
        "run", F.coalesce("root", F.get("own", F.lit(0))["node"]).alias("tree"), "start", "n_tokens", F.coalesce("position", F.lit(0).cast("long")).alias("position"),
        F.flatten(F.transform("own", lambda o: o["tokens"])).alias("tokens"), F.flatten(F.transform("own", lambda o: o["loss"])).alias("loss"),
        F.coalesce("ancestors", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("ancestors")))
    return stored(runs, "runs"), nodes, members


def read_back(runs: DataFrame, nodes: DataFrame, members: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Turns read from the stream: ``conv_id``, ``k``, ``role``, ``text``, ``loss_text``, ``n_chars`` (formatted).

    Each turn's tokens are cut from its run, decoded and unescaped once and handed to all
    conversations that share it; ``loss_text`` is what the mask marks, null where it marks nothing of
    a turn that is not an assistant's.
    """
    spans = nodes.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("begin", "size", "node"))).alias("spans"))
    cut = runs.select("run", "start", "tokens", "loss").join(spans, "run")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for s in row["spans"]:
                    at = s["begin"] - row["start"]
                    ids, mask = row["tokens"][at:at + s["size"]], row["loss"][at:at + s["size"]]
                    formatted = coder.text(ids)
                    role, text = parse_turn(formatted)
                    marked = unescape(coder.text([i for i, m in zip(ids, mask) if m]))
                    out.append((s["node"], role, text, marked, len(formatted)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                names=["node", "role", "text", "loss_text", "n_chars"])

    turns = cut.mapInArrow(decode, "node binary, role string, text string, loss_text string, n_chars long")
    return members.join(stored(turns, "turns"), "node").select("conv_id", "k", "role", "text", "loss_text", "n_chars")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``read_back``: counts and digests of its turns and of its loss text."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text", "loss_text", "n_chars"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda x: x["loss_text"]), "")
    return whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n_chars"]).alias("formatted_chars"))
