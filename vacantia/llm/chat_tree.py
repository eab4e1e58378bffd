"""Chat formatting in prefix trees.

Conversations sorted by the hashes of their turns are the leaves of a prefix tree in depth-first
order, so a stream of them needs only the path to the last one to tell which turns are new. Packs
are stretches of this stream: a pack's text holds each shared turn once; every node has its range in
the text, its position id (where its first token would be in the conversation alone), the ranges of
its ancestors, which its tokens may attend to besides the earlier ones of the node, and the range
under the loss mask. Tokens are code points here; a tokenizer can be run over the ranges.

A pack is closed at ``PACK_CHARS`` code points or ``PACK_ENDS`` conversations; the next one repeats
the ancestors that it needs. Sorting also deals out the conversations by ranges of (turns, id), so a
first turn or a whole conversation that very many share is spread over tasks, once in each pack.

A turn is ``<s>[INST]role[/INST]text</s>``. Control strings and backslashes in roles and texts are
escaped with a backslash, so what is formatted can be read back.

Defined results: null texts and roles count as empty; rows of a conversation go by turn (nulls
first), ties by role and text; repeated rows are turns of their own; rows without a conversation id
are one conversation; a conversation is the unit of work and has to fit a task; extra columns are
ignored; an empty table gives no packs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_CHARS, PACK_ENDS = 32_768, 512
#: Whose texts are trained on.
TRAINED = "assistant"
_CONTROL = re.compile(r"</?s>|\[/?INST\]|<</?SYS>>|\\")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)

PACKS = (
    "pack string, text string, nodes array<struct<start: long, end: long, parent: int, position: long, "
    "attend: array<struct<start: long, end: long>>, loss_start: long, loss_end: long, ends: array<long>>>"
)
_RANGE = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct(
    [("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("attend", pa.list_(_RANGE))]
    + [("loss_start", pa.int64()), ("loss_end", pa.int64()), ("ends", pa.list_(pa.int64()))]
)


def escape(text: str) -> str:
    """Text in which no control string stands; ``unescape`` gives the text back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn with its marks, and the range of the text in it."""
    head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class _Pack:
    """Nodes and text of a pack that is being written."""

    def __init__(self):
        self.parts: list[str] = []
        self.nodes: list[dict] = []
        self.chars = self.ends = 0
        self.path: list[tuple[tuple[str, str], int]] = []  # turns of the last conversation and their nodes

    def add(self, conversation: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            text, low, high = format_turn(*turn)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            attend = [dict(x) for x in above["attend"]] if above else []
            if above:
                if attend and attend[-1]["end"] == above["start"]:
                    attend[-1]["end"] = above["end"]
                else:
                    attend.append({"start": above["start"], "end": above["end"]})
            trained = turn[0] == TRAINED
            start = self.chars
            self.nodes.append(
                {"start": start, "end": start + len(text), "parent": parent, "position": above["position"] + above["end"] - above["start"] if above else 0}
                | {"attend": attend, "loss_start": start + low if trained else None, "loss_end": start + high if trained else None, "ends": []}
            )
            self.parts.append(text)
            self.chars += len(text)
            self.path.append((turn, len(self.nodes) - 1))
        self.nodes[self.path[-1][1]]["ends"].append(conversation)
        self.ends += 1

    def row(self, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array(["".join(self.parts)]), pa.array([self.nodes], pa.list_(_NODE))], names=["pack", "text", "nodes"])


def pack(conversations: DataFrame) -> DataFrame:
    """Packs of the conversations in a table of (conv_id, turn, role, text) rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    turns = F.sort_array(F.collect_list(F.struct("turn", role, text))).alias("turns")
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns)
    rows = rows.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    rows = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now = TaskContext.get().partitionId(), 0, _Pack()
        for batch in batches:
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                if now.ends and (now.ends >= PACK_ENDS or now.chars >= PACK_CHARS):
                    yield now.row(f"{part}-{number}")
                    number, now = number + 1, _Pack()
                now.add(conv, [(t["role"], t["text"]) for t in turns])
        if now.ends:
            yield now.row(f"{part}-{number}")

    return rows.mapInArrow(emit, PACKS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(packs: DataFrame) -> DataFrame:
    """What each conversation says, by what its last node attends to and by the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, nodes in zip(batch.column("text").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                for node in nodes:
                    if node["ends"]:
                        said = _read(text, nodes, node)
                        rows += [(conv, *said) for conv in node["ends"]]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return packs.mapInArrow(read, READ)


def _read(text: str, nodes: list[dict], node: dict) -> tuple:
    formatted = "".join(text[x["start"] : x["end"]] for x in node["attend"]) + text[node["start"] : node["end"]]
    if len(formatted) != node["position"] + node["end"] - node["start"]:
        raise ValueError("position ids and attended ranges differ")
    turns = read_turns(formatted)
    said = "".join(f"{role}\n{body}\n" for role, body in turns)
    loss: list[str] = []
    up: dict | None = node
    while up is not None:
        if up["loss_start"] is not None:
            loss.append(unescape(text[up["loss_start"] : up["loss_end"]]))
        up = nodes[up["parent"]] if up["parent"] >= 0 else None
    trained = "".join(reversed(loss))
    return len(turns), sha256(said.encode()).hexdigest(), len(trained), sha256(trained.encode()).hexdigest(), len(formatted)


PROBE_TEXT = "</s>[INST] ok [/INST]"


def report(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7 of control strings, formatted and read back."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    spark = rows.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return read_back(pack(rows.unionByName(probe)))


def report_sql() -> str:
    """DuckDB SQL for ``report``: formats each conversation alone."""

    def escaped(c: str) -> str:
        return f"regexp_replace({c}, '(<)(/?s>)|(\\[)(/?INST\\])|(<)(</?SYS>>)|(\\\\)', '\\1\\3\\5\\7\\\\\\2\\4\\6', 'g')"

    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS trained,
  sum(length('<s>[INST][/INST]</s>') + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars FROM g"""
