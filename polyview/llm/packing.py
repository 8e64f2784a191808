"""Bound-certified best-fit packing of token pieces (operator 9).

Pieces are dealt to groups by hash.  Each group packs by best-fit decreasing and takes a lower
bound on its number of sequences from dual feasible functions.  A group that meets its bound keeps all but its emptiest
sequence; the others keep their well-filled ones and hand the pieces of their emptiest to an exchange, where pieces
of many groups meet in fewer groups and are packed again.  Every group gives half of its sequences at most, so the
exchange shrinks from round to round; it ends when it is a single group, whose sequences stand as they are.

The counts of all lengths (a row a length) give a bound for the whole table, returned with every piece as ``table_bound``: no packing
has fewer sequences.

Null or empty text: one piece with only the end id.  Null ids are kept; rows that share an id are
packed as separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.shared import stage_table
from polyview.llm.tokenizer_ids import text_encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
_PLACED = _PIECES + ", sequence_id long, offset long, final boolean, bound long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document; only documents longer than ``capacity`` are cut, the first piece taking the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = text_encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.append(encode_text(text.as_py() or ""), end_id).astype("<u4").tobytes()
                n = len(data) // 4
                head = n % capacity or capacity
                salt = zlib.crc32(data[:256]) ^ n
                for piece, start in enumerate([0, *range(head, n, capacity)]):
                    stop = head if piece == 0 else start + capacity
                    rows.append((key, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), salt))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int32(), *[pa.int64()] * 4))], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins: longest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = n_bins = 0  # bit r: a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r, n_bins = n_bins, capacity, n_bins + 1
        bins[i], offsets[i] = b, capacity - r
        if r > size:
            room[r - size].append(b)
            open_rooms |= 1 << (r - size)
    return bins, offsets, n_bins


def dual_feasible_bound(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the number of bins for items of these lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """The same from the number of items of each length: the best of two families of dual feasible functions."""
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    above, mass = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * size)
    for low in range(1, capacity // 2 + 1):  # items over capacity - low count as whole bins, those under low as nothing
        big = int(above[capacity - low + 1]) if capacity - low + 1 <= capacity else 0
        middle = int(mass[capacity - low] - mass[low - 1])
        best = max(best, big - (-middle // capacity))
    for k in range(1, 21):  # steps of 1/k of a bin
        scaled = size * (k + 1)
        steps = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * steps).sum()) // (capacity * k)))
    return best


def _pack_group(capacity: int, last: bool):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, n_bins = best_fit_decreasing(lengths, capacity)
        bound, final = dual_feasible_bound(lengths, capacity), np.ones(len(rows), bool)
        if not last:
            free = capacity - np.bincount(bins, weights=lengths, minlength=n_bins)
            most = max(16 * (n_bins - bound), n_bins // 8) if n_bins > bound else 1
            give = np.argsort(-free, kind="stable")[: min(most, max(1, n_bins // 2))]
            final = ~np.isin(bins, give[free[give] > 0])
        group = int(key[0])
        return rows.drop(columns="group_no").assign(sequence_id=group * (1 << 24) + bins, offset=offsets, final=final, bound=bound)

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group_size: int = 16384) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32, salt): adds sequence_id and offset."""
    done: DataFrame | None = None
    pool = pieces
    turn = 0
    while True:
        n = pool.count()
        if n == 0 and done is not None:
            break
        groups, last = max(1, -(-n // group_size)), n <= group_size
        group = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "salt"), F.lit(groups)) + F.lit(turn << 36)
        placed = stage_table(pool.select(*[c for c in pieces.columns], group.alias("group_no")).groupBy("group_no").applyInPandas(_pack_group(capacity, last), _PLACED), f"packed{turn}")
        kept = placed.filter("final")
        done = kept if done is None else done.unionByName(kept)
        pool = placed.filter("not final").select(*pieces.columns)
        if last:
            break
        turn += 1
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place, and the whole table's bound."""
    pieces = stage_table(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row a length
        counts[row["length"]] = row["count"]
    return pack_pieces(pieces, capacity).withColumn("table_bound", F.lit(bound_of_counts(counts, capacity)).cast("long"))
