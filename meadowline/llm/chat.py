"""Chat formatting: conversations are rebuilt from event logs, then rendered with a loss mask.

A log has events of messages, which are numbered in their conversation (``message``, and ``copy`` where numbers repeat):
``open`` begins a message with a role and perhaps text, ``delta`` appends to it, ``edit`` replaces what it has, ``regenerate``
empties it, to be streamed anew, and drops all messages of higher numbers. Events of messages that are not open are ignored.

The log is dealt by ranges of (conversation, sequence) and sorted within them, so a task folds consecutive events, one
conversation at a time, and a conversation with most of all events is spread over many tasks. What a task has of a conversation
is a partial fold: for each message its role if it was opened here, whether earlier content was replaced, and the content; for
the conversation the lowest regenerated number. Conversations that reach over a range's edge, at most two a range, are put
together from the partial folds of their messages; all others are complete.

The template writes a message as ``### role: text</turn>`` and a line feed. Inside of roles and texts a backslash, ``#``, ``<`` and, in
roles, ``:`` become a backslash and a letter, so that no control string can occur in them, and reading back undoes it. The
loss mask is the span of an assistant's text in its formatted message, in code points.

Defined results: null text and null role count as empty, null numbers come first. Rows with the same ``conv_id`` and ``turn``
are messages of their own, in the order of the scan. A null ``conv_id`` is a conversation like others. Empty tables give no
rows but those that the query adds. Other columns are ignored. The digests are sequential by definition, so reading back
streams a conversation's messages through one task, which holds one batch of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import materialize, ship

CHUNK = 1000
#: Fixed values of the template.
BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
PROBE = (-7, "\\### Assistant: </turn> ok")
LEARNT = "assistant"

_KEY = ("conv_id", "message", "copy")
_PARTIAL = "conv_id long, part int, edge boolean, message long, copy long, opened boolean, replaced boolean, cut boolean, role string, content string"
_FIRST = -(1 << 63)


class _Fold:
    """Partial state of one conversation."""

    def __init__(self):
        self.messages: dict[tuple, list] = {}  # (message, copy) -> [opened, replaced, role, pieces]
        self.cut: tuple | None = None

    def take(self, key: tuple, kind: str, role: str | None, text: str) -> None:
        m = self.messages.get(key)
        if kind == "open":
            self.messages[key] = [True, True, role or "", [text]]
            return
        if kind == "regenerate":
            self.messages = {k: x for k, x in self.messages.items() if k <= key}
            self.cut = key if self.cut is None else min(self.cut, key)
        if m is None:
            if self.cut is not None and key > self.cut:
                return  # dropped by this very part, and not opened since
            m = self.messages[key] = [False, False, None, []]
        if kind == "delta":
            m[3].append(text)
        elif kind in ("edit", "regenerate"):
            m[1], m[3] = True, [text]

    def rows(self) -> Iterator[tuple]:
        for (message, copy), (opened, replaced, role, pieces) in self.messages.items():
            yield message, copy, opened, replaced, False, role, "".join(pieces)
        if self.cut is not None:
            yield *self.cut, False, False, True, None, None


def partial_folds(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """What each range of the log holds of each message, written."""
    dealt = events.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).select(
        F.spark_partition_id().alias("part"), "conv_id", F.coalesce("message", F.lit(_FIRST)).alias("message"), "copy", "kind", "role", F.coalesce("text", F.lit("")).alias("text")
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("edge", pa.bool_()), ("message", pa.int64()), ("copy", pa.int64()), ("opened", pa.bool_()), ("replaced", pa.bool_()), ("cut", pa.bool_()), ("role", pa.string()), ("content", pa.string())])
        out, held, at, state, part, first = [], 0, None, None, None, True

        def leave(edge: bool) -> None:
            nonlocal held
            for row in state.rows() if state else ():
                if edge or (row[2] and not row[4]):  # inside of a range nothing else can open a message
                    out.append((at, part, edge, *row))
                    held += len(row[-1] or "") + 64

        def batch() -> pa.RecordBatch:
            nonlocal out, held
            columns = list(zip(*out)) or [[]] * len(schema)
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

        for b in batches:
            for p, conv, message, copy, kind, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != at:
                    leave(edge=first)
                    first = first and state is None
                    at, state, part = conv, _Fold(), p
                    if held > 4 << 20:
                        yield batch()
                state.take((message, copy), kind, role, text)
        leave(edge=True)
        yield batch()

    return materialize(dealt.mapInArrow(fold, _PARTIAL))


def reconstruct(events: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Final messages of a log: conv_id, message, copy, role, content. ``order`` sorts the events of a conversation."""
    partial = partial_folds(events if "copy" in events.columns else events.withColumn("copy", F.lit(0).cast("long")), order)
    whole = partial.where("NOT edge").select(*_KEY, "role", "content")
    edge = partial.where("edge").withColumn("conv", F.struct("conv_id"))  # equal also where the id is missing
    # Two conversations a range at most have edges, and one lowest regenerated number each: the table is as small as the list of ranges.
    cuts = edge.where("cut").groupBy("conv").agg(F.collect_list(F.struct("part", F.struct("message", "copy").alias("at"))).alias("cuts"))
    pieces = edge.where("NOT cut").groupBy("conv", "message", "copy").agg(F.array_sort(F.collect_list(F.struct("part", "opened", "replaced", "role", "content"))).alias("p"))
    joined = pieces.join(F.broadcast(cuts), "conv", "left")
    last = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: x.part)), F.lit(-1))
    dropped = last(F.filter(F.coalesce("cuts", F.array().cast("array<struct<part:int,at:struct<message:bigint,copy:bigint>>>")), lambda c: c["at"] < F.struct("message", "copy")))
    joined = joined.withColumn("p", F.filter("p", lambda x: (x.part > dropped) | (x.part == dropped) & x.opened))
    joined = joined.withColumn("_open", last(F.filter("p", lambda x: x.opened))).where("_open >= 0")
    start = last(F.filter("p", lambda x: (x.part >= F.col("_open")) & x.replaced))
    content = F.array_join(F.transform(F.filter("p", lambda x: x.part >= F.col("_start")), lambda x: x.content), "")
    role = F.element_at(F.transform(F.filter("p", lambda x: x.part == F.col("_open")), lambda x: x.role), 1)
    return whole.unionByName(joined.withColumn("_start", start).select(F.col("conv.conv_id").alias("conv_id"), "message", "copy", role.alias("role"), content.alias("content")))


def escape(x: Column, also: str = "") -> Column:
    for c in "\\#<" + also:
        x = F.replace(x, F.lit(c), F.lit(ESCAPES[c]))
    return x


def render(messages: DataFrame) -> DataFrame:
    """conv_id, message, copy, formatted, and where the loss mask begins and ends in it (null: nowhere)."""
    head = F.concat(F.lit(BEGIN), escape(F.coalesce("role", F.lit("")), ":"), F.lit(MIDDLE))
    rows = messages.select(*_KEY, head.alias("_head"), escape(F.coalesce("content", F.lit(""))).alias("_body"), (F.col("role") == LEARNT).alias("_learnt"))
    start = F.when(F.col("_learnt"), F.length("_head"))
    return rows.select(*_KEY, F.concat("_head", "_body", F.lit(END)).alias("formatted"), start.alias("loss_start"), (start + F.length("_body")).alias("loss_end"))


_SIGNS = {e[1]: c for c, e in ESCAPES.items()}
_MESSAGE = re.compile(re.escape(BEGIN) + "([^#<:]*)" + re.escape(MIDDLE) + "([^#<]*)" + re.escape(END))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _SIGNS[m.group(1)], text, flags=re.S) if "\\" in text else text


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted message."""
    m = _MESSAGE.fullmatch(formatted)
    if not m:
        raise ValueError(f"not a formatted message: {formatted[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from formatted messages and their masks alone: counts and digests of turns and of what is learnt."""
    columns = ["conv_id", "formatted", "loss_start", "loss_end"]
    dealt = formatted.repartition("conv_id").sortWithinPartitions(*_KEY).select(*columns)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        out, at, state = [], None, None

        def leave() -> None:
            if state:
                n, turns, chars, loss, total = state
                out.append((at, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for b in batches:
            for conv, text, start, end in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != at:
                    leave()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = parse(text)
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                if start is not None:
                    learnt = unescape(text[start:end])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)
            out = []
        leave()
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)

    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The event log of a table of turns. Assistant turns are streamed, broken off after a chunk, and generated again; all
    others begin as a draft that an edit replaces."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    event = lambda kind, x, who=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if who is None else who).alias("role"), x.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / chunk).cast("int")), lambda i: event("delta", F.substring(text, i * chunk + 1, F.lit(chunk))))
    begin, draft = event("open", F.lit(""), role), event("delta", F.substring(text, 1, chunk))
    streamed, edited = F.concat(F.array(begin, draft, event("regenerate", F.lit(""))), pieces), F.array(begin, draft, event("edit", text))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("message"), "role", "text", F.monotonically_increasing_id().alias("copy"))
    return rows.select("conv_id", "message", "copy", F.posexplode(F.when(role == LEARNT, streamed).otherwise(edited)).alias("step", "e")).select("conv_id", "message", "copy", "step", "e.*")


ORDER = ("message", "copy", "step")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    probe = spark.createDataFrame([(PROBE[0], i, who, PROBE[1]) for i, who in enumerate(("user", LEARNT))], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(materialize(render(reconstruct(log_of(turns.unionByName(probe)), ORDER))))


OP12_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS body, replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
