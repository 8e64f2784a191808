"""Chat formatting by columnar byte assembly (operator 12).

Turns are dealt by ranges of (conversation, turn), so one long conversation spreads over many tasks.  A task formats an Arrow batch
at a time: numpy gives the length of every segment (header, text, footer), their cumulative offsets and the indices to
scatter their bytes to, and headers and texts are copied into one preallocated buffer.  That buffer becomes the output column
itself, cut where conversations end.  A conversation that goes on in the next batch comes in several pieces; every piece holds whole turns.

The template marks each turn by its role (see ``TEMPLATE``; any other role is written out).  Where a text or role holds one of
the control strings, a backslash goes after the string's first character, or one more where some stand there already; taking one
away restores it.  The loss mask is a list of byte spans that cover exactly the (escaped) texts of assistants.

A null text or role counts as empty, a null turn comes before all others, and rows with a null conversation id form one conversation.
Rows that share a turn go by role, then by text; repeated rows are separate turns.  Other columns are ignored.  An empty table
gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header and footer by role.
TEMPLATE = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = r"/?(?:s>|INST\]|SYS\]|ROLE\]|TEXT\])"
ESCAPE = rf"([<\[]\\*)({_CONTROL})"
_UNESCAPE = re.compile(rf"([<\[]\\*)\\({_CONTROL})")
_TURN = re.compile(r"\[SYS\] (?P<system>.*?) \[/SYS\]|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/ROLE\]", re.S)
#: Bytes that one scatter handles at a time; longer segments are copied as they are.
STRIP = 1 << 20
_PIECES = "conv_id long, piece long, n_turns long, formatted string, loss array<struct<start:long,length:long>>, open boolean"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted piece; a piece that the template did not make is an error."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at character {at}")
        at = m.end()
        role = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if role == "text" else (role, unescape(m[role])))
    if at != len(formatted):
        raise ValueError(f"no turn begins at character {at}")
    return out


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy segment k, ``length[k]`` bytes of ``data`` from ``start[k]``, to ``out`` from ``to[k]``."""
    for k in np.flatnonzero(length > STRIP).tolist():
        out[to[k] : to[k] + length[k]] = data[start[k] : start[k] + length[k]]
    rows = np.flatnonzero((length > 0) & (length <= STRIP))
    to, start, length = to[rows], start[rows], length[rows]
    total = np.cumsum(length)
    cuts = [0, *np.flatnonzero(np.diff(total // STRIP)) + 1, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            step = np.arange(length[a:b].sum()) - np.repeat(total[a:b] - length[a:b] - (total[a] - length[a]), length[a:b])
            out[np.repeat(to[a:b], length[a:b]) + step] = data[np.repeat(start[a:b], length[a:b]) + step]


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        roles = batch.column("role").dictionary_encode()
        marks = [tuple(x.encode() for x in TEMPLATE.get(r) or (f"[ROLE]{r}[TEXT]", "[/ROLE]")) for r in roles.dictionary.to_pylist()]
        role = roles.indices.to_numpy()
        ends = [np.frombuffer(b"".join(m[k] for m in marks), np.uint8) for k in (0, 1)]
        sizes = [np.array([len(m[k]) for m in marks]) for k in (0, 1)]
        at, data = _strings(batch.column("text"))

        lengths = np.stack([sizes[0][role], np.diff(at), sizes[1][role]], axis=1)
        stop = np.cumsum(lengths.reshape(-1)).reshape(lengths.shape)
        start = stop - lengths
        buffer = pa.allocate_buffer(int(stop[-1, -1]))
        out = np.frombuffer(buffer, np.uint8)
        _scatter(out, start[:, 1], data, at[:-1], lengths[:, 1])
        for k, side in ((0, 0), (1, 2)):
            _scatter(out, start[:, side], ends[k], (np.cumsum(sizes[k]) - sizes[k])[role], lengths[:, side])

        ids, absent = batch.column("conv_id").fill_null(0).to_numpy(), batch.column("conv_id").is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (absent[1:] != absent[:-1])]))
        begin, count = start[first, 0], np.diff(np.append(first, len(ids)))
        offsets = np.append(begin, stop[-1, -1]).astype(np.int64)
        formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer).cast(pa.string())

        is_loss = np.array([r == "assistant" for r in roles.dictionary.to_pylist()])[role]
        owner = np.repeat(np.arange(len(first)), count)[is_loss]
        spans = pa.StructArray.from_arrays([pa.array(start[is_loss, 1] - begin[owner]), pa.array(lengths[is_loss, 1])], names=["start", "length"])
        held = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))]).astype(np.int32)
        # a conversation at either end of a batch may go on in another one
        is_open = np.zeros(len(first), bool)
        is_open[[0, -1]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[first], mask=absent[first]), pa.array(np.full(len(first), piece)), pa.array(count), formatted, pa.ListArray.from_arrays(pa.array(held), spans), pa.array(is_open)],
            names=["conv_id", "piece", "n_turns", "formatted", "loss", "open"],
        )
        piece += 1


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, piece, n_turns, formatted, loss (byte spans in formatted) and open (whether other pieces may exist).

    A conversation's text is that of its pieces in ascending order.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("lead", F.substring(F.concat_ws("\n", "role", F.substring("text", 1, 64)), 1, 64))  # short, so that borders are
    rows = rows.repartitionByRange("conv_id", "turn", "lead").sortWithinPartitions("conv_id", "turn", "lead", "role", "text")
    escaped = [F.regexp_replace(c, ESCAPE, r"$1\\$2").alias(c) for c in ("role", "text")]
    return rows.select("conv_id", *escaped).mapInArrow(_assemble, _PIECES)


class _Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        turns, data = parse_turns(formatted), formatted.encode()
        self.turns.update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
        learnt = [unescape(data[s["start"] : s["start"] + s["length"]].decode()) for s in loss]
        self.loss.update("".join(learnt).encode())
        self.n_turns, self.loss_chars, self.chars = self.n_turns + len(turns), self.loss_chars + sum(map(len, learnt)), self.chars + len(formatted)

    def row(self, conv_id: int | None) -> dict:
        return {"conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations become digests; open pieces pass as they are."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["open"]:
                rows.append({"conv_id": r["conv_id"], "piece": r["piece"], "formatted": r["formatted"], "loss": r["loss"]})
            else:
                one = _Digest()
                one.add(r["formatted"], r["loss"])
                rows.append(one.row(r["conv_id"]))
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces, which come in order, are read one after the other; a digest is passed on."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    conv, one = None, None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if one and (r["formatted"] is None or r["conv_id"] != conv):
                rows.append(one.row(conv))
                one = None
            if r["formatted"] is None:
                rows.append({c: r[c] for c in schema.names})
                continue
            conv, one = r["conv_id"], one or _Digest()
            one.add(r["formatted"], r["loss"])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if one:
        yield pa.RecordBatch.from_pylist([one.row(conv)], schema=schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation what its formatted pieces and their loss mask hold; see ``_Digest``.

    A digest of one conversation is sequential.  Only conversations in several pieces (at most two a batch) cross to the task of their id, and
    they stream through it.
    """
    return pieces.mapInArrow(_read, f"{_DIGESTS}, piece long, formatted string, loss array<struct<start:long,length:long>>").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_join, _DIGESTS)


#: The same in SQL.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[]\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]|TEXT\]))', '\1\\\2', 'g')) +
             CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
                       ELSE 19 + length(regexp_replace(role, '([<\[]\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]|TEXT\]))', '\1\\\2', 'g')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
