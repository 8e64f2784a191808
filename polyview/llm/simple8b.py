"""Token ids as Simple-8b: word-aligned binary coding, written and read by Spark (operator 3).

A 64-bit word holds a 4-bit selector (lowest bits) and up to 240 ids of one width.  Ids that need more
than 60 bits are escaped: a word with the escape selector, then the id as a whole word.  Ids are
cut into blocks of 1024; the word at which each block starts is kept, so blocks decode on their own and
each selector's words decode together as one array operation.

File format: a Parquet table of segments, one row each, of whole documents in ascending id order
(``part``, ``segment``, ``first`` id within the part, ``doc_ids``, ``doc_lens``,
``blocks`` = word offsets, ``words`` = little-endian 64-bit words).  Parts are ranges of document ids dealt
by sampled splitters; the ids before a part come from summing the parts' sizes, one row each.

Null or empty text: only the end id.  Null document ids come first; documents that share an id
stay separate rows, in any order among themselves.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.llm.shared import stage_table
from polyview.llm.tokenizer_ids import text_encoder

#: (values in a word, bits of each) by selector; selector 0 is the escape, 15 one value of 60 bits.
LAYOUT = [(0, 0), (240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 1024
SEGMENT_IDS = 1 << 16

_SEGMENTS = "part int, segment int, first long, n_ids long, doc_ids array<long>, doc_lens array<int>, blocks array<int>, words binary"


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (0 for 0)."""
    if ids.max() < 1 << 52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    high = ids >> np.uint64(32)
    top = np.frexp(high.astype(np.float64))[1]
    return np.where(high > 0, 32 + top, np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of each block of 1024 ids.

    Each position's best selector is found for all positions at once, from windows of ids that are narrow enough; the
    blocks then step through their words side by side.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    wide = np.zeros((blocks, BLOCK + 240), np.uint64)  # past a block's end anything fits
    whole = n // BLOCK
    wide[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    if n % BLOCK:
        wide[whole, : n % BLOCK] = ids[whole * BLOCK :]
    bits = _bit_lengths(wide)
    choice = np.zeros((blocks, BLOCK), np.uint8)  # stays 0 (escape) where 60 bits are too few
    for selector in range(len(LAYOUT) - 1, 0, -1):
        count, width = LAYOUT[selector]
        fits, k = bits <= width, 1
        while 2 * k <= count:
            fits = fits[:, :-k] & fits[:, k:]
            k *= 2
        if count > k:
            fits = fits[:, : k - count] & fits[:, count - k :]
        np.copyto(choice, np.uint8(selector), where=fits[:, :BLOCK])
    choice = choice.reshape(-1)[:n]
    step = np.array([1] + [c for c, _ in LAYOUT[1:]])[choice]
    pointer = np.arange(0, n, BLOCK)
    limit, starts = np.minimum(pointer + BLOCK, n), np.zeros(n, bool)
    while len(pointer):
        starts[pointer] = True
        pointer = pointer + step[pointer]
        on = pointer < limit
        pointer, limit = pointer[on], limit[on]
    where = np.flatnonzero(starts)
    picked = choice[where]
    size = np.where(picked == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    flat, base = wide.reshape(-1), where // BLOCK * (BLOCK + 240) + where % BLOCK
    for selector in np.unique(picked):
        rows = np.flatnonzero(picked == selector)
        count, width = LAYOUT[selector]
        if selector == 0:
            words[place[rows] + 1] = ids[where[rows]]
            continue
        word, at = np.full(len(rows), selector, np.uint64), base[rows]
        for k in range(count if width else 0):
            word |= flat[at + k] << np.uint64(4 + k * width)
        words[place[rows]] = word
    return words.astype("<u8"), place[where % BLOCK == 0]


def decode(words: np.ndarray, n: int, offsets: np.ndarray) -> np.ndarray:
    """The ``n`` ids of ``words``; every selector's words at once."""
    words = np.asarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(selector == 0)
    if len(escapes):  # a raw word may look like an escape; those after an escape are raw
        for e in escapes.tolist():
            if not raw[e]:
                raw[e + 1] = True
    live = np.flatnonzero(~raw)
    counts = np.array([1] + [c for c, _ in LAYOUT[1:]])[selector[live]]
    block = np.searchsorted(offsets, live, side="right") - 1
    total = np.cumsum(counts) - counts
    base = total[np.searchsorted(live, offsets)]
    start = block * BLOCK + total - base[block]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector[live]):
        rows = np.flatnonzero(selector[live] == s)
        if s == 0:
            out[start[rows]] = words[live[rows] + 1]
            continue
        count, width = LAYOUT[s]
        if width == 0:
            continue
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            to = start[rows] + k
            ok = to < stop[rows]
            out[to[ok]] = (words[live[rows[ok]]] >> np.uint64(4 + k * width)) & mask
    return out


def write_token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the segments, and return the table of them with ``base``: ids before the part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part = text_encoder(tokenizer_path), TaskContext.get().partitionId()
        keys: list = []
        parts: list[np.ndarray] = []
        size = first = segment = 0

        def flush() -> pa.RecordBatch:
            words, blocks = encode(np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([blocks.astype(np.int32)], pa.list_(pa.int32())), pa.array([words.tobytes()], pa.binary())],
                names=["part", "segment", "first", "n_ids", "doc_ids", "doc_lens", "blocks", "words"],
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode_text(text.as_py() or ""), end_id)
                keys.append(key)
                parts.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield flush()
                    first, segment, size, keys, parts = first + size, segment + 1, 0, [], []
        if parts:
            yield flush()

    # rows with one id, and those without, have no order between them: their texts' hashes let ranges split them
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    segments = stage_table(dealt.mapInArrow(pack, _SEGMENTS), "simple8b")
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))
    return segments.join(F.broadcast(bases), "part")


def read_token_ids(segments: DataFrame) -> DataFrame:
    """One row per document from written segments: doc_id, start, ids (little-endian uint32), n_tokens."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8"), row["n_ids"], np.array(row["blocks"])).astype("<u4")
                lens = np.array(row["doc_lens"], np.int64)
                starts = row["base"] + row["first"] + np.cumsum(lens) - lens
                data, ends = ids.tobytes(), np.cumsum(lens)
                each = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return segments.select("base", "first", "n_ids", "doc_ids", "doc_lens", "blocks", "words").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
