"""Chat formatting as a forest of shared prefixes.

Conversations that begin with the same turns share them: every distinct beginning
is a node, named by a hash chained over its turns. The forest is emitted depth
first, each node's tokens once. A token here is a code point of the formatted
text. A node carries the position of its first token in any conversation through
it (position ids run on from its parent), its place in the emission, and the
intervals of the emission that its tokens may attend to besides their own past:
those of its ancestors, merged where they touch.

No tree is ever gathered in a task. Nodes are made by an aggregation on their
hash. Depth-first order is the order of conversations sorted by their path of
hashes: a node is emitted with the first conversation that passes through it.
Places are prefix sums over sorted ranges. A conversation is read back from the
emission alone: what its last node may attend to, interval by interval, and then
that node.

Template: ``<turn>ROLE\\nTEXT</turn>\\n``. In texts and roles a backslash goes
before every backslash and every ``<``; in a role a line feed becomes
backslash, n. So no control string can occur inside, and it reads back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frametide.llm._common import materialise, pick, skew_join, table

OPEN, CLOSE = "<turn>", "</turn>\n"
LOSS_ROLE = "assistant"

_TURN = re.compile(r"<turn>([^\\\n<]*(?:\\.[^\\\n<]*)*)\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; fails on anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass
class Forest:
    """``nodes``: node, parent, depth, formatted, start (in the emission), chars, position, loss_start and loss_chars (code points of ``formatted`` under the loss mask), attention (array of start and end), n_conversations.

    ``conversations``: uid, conv_id and node, the last of the conversation.
    """

    nodes: DataFrame
    conversations: DataFrame


_CHAIN = "uid long, conv_id long, depth int, node binary, parent binary, formatted string, position long, chars long, loss_start long, loss_chars long, path binary"
#: Code points of the emission by whose number nodes and the intervals that reach them are joined.
PAGE = 2048


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From turns sorted by conversation: a row for each turn, and after the last one a row with the conversation's path."""
    names = [c.split()[0] for c in _CHAIN.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), *[pa.int64()] * 4, pa.binary()]
    uid = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    size, started, conv, depth, node, position, path = 0, False, None, 0, b"", 0, bytearray()

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for conv_id, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role"), batch.column("text")):
            if started and conv_id != conv:
                rows.append((uid, conv, depth, node, None, None, None, None, None, None, bytes(path)))
                uid += 1
            if not started or conv_id != conv:
                started, conv, depth, node, position, path = True, conv_id, 0, b"", 0, bytearray()
            role, text = role.as_py() or "", text.as_py() or ""
            formatted = render(role, text)
            digest = hashlib.sha256(node + b"\n" + formatted.encode()).digest()[:16]
            parent, node = node or None, digest
            head = len(OPEN) + len(escape_role(role)) + 1
            loss = len(formatted) - head - len(CLOSE) if role == LOSS_ROLE else 0
            rows.append((uid, conv, depth, node, parent, formatted, position, len(formatted), head if role == LOSS_ROLE else 0, loss, None))
            position += len(formatted)
            path += digest[:8]
            depth += 1
            size += len(formatted)
            if size > 1 << 22:
                yield batch_of()
                rows.clear()
                size = 0
    if started:
        rows.append((uid, conv, depth, node, None, None, None, None, None, None, bytes(path)))
    if rows:
        yield batch_of()


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the split and adds up chars before each row in it."""
    split, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        chars = batch.column("chars").to_pylist()
        before = list(accumulate(chars, initial=total))
        total = before.pop()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([split] * len(chars), pa.int32()), pa.array(before, pa.int64())], names=[*batch.schema.names, "split", "local"])


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members sorted by conversation and depth: the ancestors' intervals of each node that its conversation is the first to have."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    uid, open_ = None, []
    for batch in batches:
        nodes, spans = [], []
        for u, node, start, chars, first in zip(*(batch.column(c).to_pylist() for c in ("uid", "node", "start", "chars", "first"))):
            if u != uid:
                uid, open_ = u, []
            if first:
                nodes.append(node)
                spans.append([{"start": a, "end": b} for a, b in open_])
            if open_ and open_[-1][1] == start:
                open_[-1] = (open_[-1][0], start + chars)
            else:
                open_.append((start, start + chars))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(spans, kind)], names=["node", "attention"])


def prefix_forest(turns: DataFrame) -> Forest:
    """Formats all conversations of ``turns`` (conv_id, turn, role, text) as one forest.

    Turns are ordered by turn, then role and text; a null turn comes first;
    repeated rows are turns of their own. A null role or text counts as empty, a
    null conv_id is a conversation like any other. An empty table gives an empty
    forest; other columns are ignored. A conversation's turns are chained one
    after the other, so it is sorted and read by one task, as a stream: held in
    memory are its hashes, eight bytes a turn.
    """
    spark = turns.sparkSession
    src = pick(turns, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    ordered = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    chain = materialise(ordered.mapInArrow(_chain, _CHAIN), "turns")
    convs = chain.filter("path IS NOT NULL").select("uid", "path").repartitionByRange("path", "uid").sortWithinPartitions("path", "uid")
    ranks = materialise(convs.select("uid", F.monotonically_increasing_id().alias("rank")), "ranks")
    turn = chain.filter("path IS NULL")
    # Texts stay where they are until every node has its place: only then are they looked up, by the turn that names the node.
    ranked = turn.select("uid", "depth", "node", "chars").join(ranks, "uid")
    heads = ranked.groupBy("node").agg(F.min(F.struct("rank", "uid")).alias("first"), F.count("*").alias("n_conversations"), F.first("depth").alias("depth"), F.first("chars").alias("chars"))
    heads = materialise(heads.select("node", "first.rank", "first.uid", "depth", "chars", "n_conversations"), "heads")
    emitted = heads.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth")
    emitted = materialise(emitted.mapInArrow(_running, T.StructType([*emitted.schema.fields, T.StructField("split", T.IntegerType()), T.StructField("local", T.LongType())])), "nodes")
    sums = sorted((r["split"], r["n"]) for r in emitted.groupBy("split").agg(F.sum("chars").alias("n")).collect())  # one row a split
    bases = spark.createDataFrame(list(zip([s for s, _ in sums], accumulate([n for _, n in sums], initial=0))), "split int, base long")
    placed = emitted.join(F.broadcast(bases), "split").withColumn("start", F.col("base") + F.col("local")).drop("split", "local", "base")
    lookup = placed.select("node", "start", "chars", F.col("rank").alias("node_rank"), "n_conversations")
    walked = skew_join(ranked.select("uid", "depth", "node", "rank"), lookup, ["node"], "n_conversations", chain.count(), ["uid"])
    walked = walked.withColumn("first", F.col("rank") == F.col("node_rank")).repartition("uid").sortWithinPartitions("uid", "depth")
    attention = walked.select("uid", "node", "start", "chars", "first").mapInArrow(_attention, "node binary, attention array<struct<start: long, end: long>>")
    texts = turn.select("uid", "depth", "parent", "formatted", "position", "loss_start", "loss_chars")
    nodes = placed.drop("rank").join(attention, "node").join(texts, ["uid", "depth"]).drop("uid")
    name = lambda c: F.lower(F.hex(c)).alias(c)
    nodes = nodes.select(name("node"), name("parent"), "depth", "formatted", "start", "chars", "position", "loss_start", "loss_chars", "attention", "n_conversations")
    return Forest(nodes, chain.filter("path IS NOT NULL").select("uid", "conv_id", name("node")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From nodes sorted by conversation and place in the emission: each conversation parsed and digested."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    uid, now, rows = None, None, []

    def close() -> None:
        if now is not None:
            if now["chars"] != now["whole"]:
                raise ValueError(f"conversation {now['id']}: {now['chars']} code points read, expected {now['whole']}")
            rows.append((now["id"], now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

    for batch in batches:
        for u, conv, whole, position, formatted, start, chars in zip(*(batch.column(c).to_pylist() for c in ("uid", "conv_id", "whole", "position", "formatted", "loss_start", "loss_chars"))):
            if u != uid:
                close()
                uid, now = u, {"id": conv, "whole": whole, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            if position != now["chars"]:
                raise ValueError(f"conversation {conv}: a node at position {position}, expected {now['chars']}")
            for role, text in parse(formatted):
                now["turns"] += 1
                now["all"].update(f"{role}\n{text}\n".encode())
            under = unescape(formatted[start : start + chars])
            now["loss"].update(under.encode())
            now["loss_chars"] += len(under)
            now["chars"] += len(formatted)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_back(forest: Forest, page: int = PAGE) -> DataFrame:
    """Every conversation, read from the emission: the nodes inside the intervals that its last node attends to, then that node, parsed and unescaped, and the text under their loss masks.

    Fails where an interval or a position is wrong. ``forest.nodes`` is read three times: give a written table.
    """
    nodes, convs = forest.nodes, forest.conversations
    last = nodes.select("node", "n_conversations", (F.col("position") + F.col("chars")).alias("whole"), F.concat("attention", F.array(F.struct("start", (F.col("start") + F.col("chars")).alias("end")))).alias("spans"))
    ends = skew_join(convs, last, ["node"], "n_conversations", convs.count(), ["uid"])
    spans = ends.select("uid", "conv_id", "whole", F.explode("spans").alias("s"))
    pages = F.sequence(F.floor(F.col("s.start") / page), F.floor((F.col("s.end") - 1) / page))
    spans = materialise(spans.select("uid", "conv_id", "whole", "s.start", "s.end", F.explode(pages).alias("page")), "spans", few=True)
    reached = spans.groupBy("page").agg(F.count("*").alias("n"))
    emission = nodes.select(F.floor(F.col("start") / page).alias("page"), F.col("start").alias("at"), "position", "formatted", "loss_start", "loss_chars")
    met = skew_join(spans, emission, ["page"], "n", spans.count(), ["uid"], weights=materialise(reached, "reached", few=True)).filter("at >= start AND at < end")
    found = met.select("uid", "conv_id", "whole", "at", "position", "formatted", "loss_start", "loss_chars").repartition("uid").sortWithinPartitions("uid", "at")
    return found.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings, formatted beside the table's.
PROBE = (-7, "\\### Assistant: </turn> ok")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id, text = PROBE
    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(conv_id).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    forest = prefix_forest(turns.unionByName(probe))
    forest.nodes = materialise(forest.nodes, "forest")
    return read_back(forest)


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(role) + length(text)
           + length(regexp_replace(role, '[^\\<\n]', '', 'g')) + length(regexp_replace(text, '[^\\<]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
