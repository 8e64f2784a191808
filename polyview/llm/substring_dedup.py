"""Exact removal of repeated byte strings by a sampled, range-partitioned suffix sort (operator 4).

Every byte covered by a ``length``-byte string that also starts elsewhere goes.  Equal strings
have equal smallest 48-byte grams, so strings are compared only within the runs of consecutive windows that share
their smallest gram:

1. each text is cut into such runs, with a hash of the gram and a 128-bit digest (BLAKE2b) of the run's bytes; grams that occur once
   are settled by a count;
2. runs of one gram with equal digests are copies: all their windows repeat;
3. grams with differing runs keep one representative of each distinct run.  Its window suffixes are dealt to buckets by
   sampled splitters over the gram's leading bytes, and each bucket sorts them by multikey quicksort with 8-byte
   characters, going on only inside groups that still tie.  Splitters lie between distinct leading bytes, so suffixes
   equal in their gram never fall on two sides of a border and no match crosses one;
4. a gram with more distinct runs than a bucket should hold is split by content instead: the digests of its windows
   are grouped over the whole cluster.

Texts count as UTF-8 bytes, null as empty; matches never cross documents; strings are judged on the input.  Two rows
with the same id and text are two places of the same strings and get the same result.  Other columns are
ignored.  A row is known by the 128-bit digest of its id and text.  Grams whose 64-bit hashes collide only meet in one group, where bytes are
compared.  Memory is bounded by slices of ``_SLICE`` bytes and by buckets; only a document's own
spans and text meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.shared import stage_table

GRAM = 48
_SLICE = 1 << 18
_HOT = 4096
_BUCKET_WINDOWS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_CODES = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b % (1 << 64)))])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class _Hashes:
    """Hashes of all substrings of a byte array from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data) + 1)
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[data] * up[: len(data)])])

    def all(self, n: int) -> np.ndarray:
        """Of every substring of ``n`` bytes."""
        count = len(self._sums) - n
        return _mix((self._sums[n:] - self._sums[:count]) * self._down[:count] + np.uint64(n))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over every ``width`` neighbours: of a block's tail and the next one's head."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(fill))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    heads = pick.accumulate(blocks, axis=1).reshape(-1)
    tails = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(tails[:n], heads[width - 1 : width - 1 + n])


def cut_runs(slices: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest gram: (slice number, first window, last window, gram hash, two halves of the bytes' digest, whether the gram recurs inside)."""
    sizes = np.array([len(s) for s in slices])
    width = length - GRAM + 1
    data = np.concatenate([*slices, np.zeros(length, np.uint8)])
    offsets = np.cumsum(sizes) - sizes
    hashes = _Hashes(data)
    grams = hashes.all(GRAM)
    low = _sliding(grams, width, np.minimum, (1 << 64) - 1)
    at = np.arange(len(low))
    owner = np.searchsorted(offsets, at, side="right") - 1
    valid = at + length <= (offsets + sizes)[owner]
    first = valid & np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]])
    starts = np.flatnonzero(first)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    run = np.cumsum(first) - 1
    ends = np.zeros(len(starts), np.int64)
    ok = np.flatnonzero(valid)
    ends[run[ok]] = ok  # the last one stays
    # a gram that recurs within a window may make windows of one run equal
    value = np.where(valid, low, np.uint64(0))
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), value]), width, np.maximum, 0)
    chosen = np.flatnonzero((grams[: len(most)] == most) & (most > 0))
    near = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= width))
    again = np.zeros(len(starts), bool)
    for p, q in zip(chosen[near].tolist(), chosen[near + 1].tolist()):
        again[run[max(0, q - width)] : run[min(len(run) - 1, p + 1)] + 1] = True
    where = owner[starts]
    raw = data.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), (ends + length).tolist()))
    halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return where, starts - offsets[where], ends - offsets[where], low[starts], halves[:, 0], halves[:, 1], again


def _slices(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping slices that together hold every window once."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(data) - length + 1), _SLICE):
        yield start, data[start : start + _SLICE + length - 1]


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            where, first, last, gram, one, two, again = cut_runs([s for _, _, s in held], length)
            keys, shift = pa.array([k for k, _, _ in held], pa.binary()), np.array([o for _, o, _ in held])
            places = [pa.array((x + shift[where]).astype(np.int32)) for x in (first, last)]
            arrays = [pa.array(gram.astype(np.uint64).view(np.int64)), pa.array(one), pa.array(two), keys.take(pa.array(where)), *places, pa.array(again.astype(bool))]
            return pa.RecordBatch.from_arrays(arrays, names=["gram", "one", "two", "row", "first", "last", "again"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for start, part in _slices(text.as_py() or b"", length):
                    held.append((key, start, part))
                    size += len(part)
                    if size >= _SLICE:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return docs.select("row", "text").mapInArrow(run, "gram long, one long, two long, row binary, first int, last int, again boolean")


def _fetch(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of runs: wanted has row, and runs of (gram, first, last, done)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"].encode()
                rows = []
                for r in row["runs"]:
                    data = text[r["first"] : r["last"] + length]
                    grams = _Hashes(np.frombuffer(data, np.uint8)).all(GRAM)
                    at = int(np.argmax(grams == np.uint64(r["gram"] & 0xFFFFFFFFFFFFFFFF)))
                    rows.append((data[at : at + 16], r["gram"], row["row"], r["first"], r["done"], r["hot"], data))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()))], names=["lead", "gram", "row", "first", "done", "hot", "data"])

    return wanted.join(docs, "row").select("row", "runs", "text").mapInArrow(run, "lead binary, gram long, row binary, first int, done boolean, hot boolean, data binary")


def repeated_windows(groups: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all strings: (string, offset, whether an equal window exists in its group).

    Multikey quicksort with 8-byte characters: windows in groups that tie so far are sorted by their next character.
    """
    sizes = np.array([len(d) for d in data])
    buffer = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    chars = np.zeros(len(buffer) - 7, np.uint64)
    for k in range(8):
        chars |= buffer[k : len(buffer) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(data)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
    group = groups[owner]
    active = np.argsort(group, kind="stable")
    group = group[active]
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(active):
            break
        key = chars[place[active] + depth]
        border = np.concatenate([[True], group[1:] != group[:-1]])
        number = np.cumsum(border) - 1
        mixed = np.zeros(number[-1] + 1, bool)
        mixed[number[1:][(key[1:] != key[:-1]) & ~border[1:]]] = True
        rows = np.flatnonzero(mixed[number])
        if len(rows):
            order = rows[np.lexsort((key[rows], number[rows]))]
            active[rows], key[rows] = active[order], key[order]
            border = np.concatenate([[True], (number[1:] != number[:-1]) | (key[1:] != key[:-1])])
            number = np.cumsum(border) - 1
            keep = np.bincount(number)[number] > 1
            active, number = active[keep], number[keep]
        elif depth == 0:
            keep = np.bincount(number)[number] > 1
            active, number = active[keep], number[keep]
        group = number
    again = np.zeros(len(owner), bool)
    again[active] = True
    return owner, offset, again


def _spans(row: list[bytes], first: np.ndarray, owner: np.ndarray, offset: np.ndarray, again: np.ndarray, length: int) -> pa.RecordBatch:
    """Stretches of repeated windows as (row, start, stop)."""
    hit = np.flatnonzero(again)
    if not len(hit):
        return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["row", "start", "stop"])
    begin = np.concatenate([[True], (owner[hit][1:] != owner[hit][:-1]) | (np.diff(offset[hit]) != 1)])
    end = np.concatenate([begin[1:], [True]])
    own = owner[hit][begin]
    base = first[own]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.binary()).take(pa.array(own)), pa.array((base + offset[hit][begin]).astype(np.int32)), pa.array((base + offset[hit][end] + length).astype(np.int32))], names=["row", "start", "stop"])


def _sort_buckets(length: int):
    """Rows come sorted by (lead, gram); whole groups are gathered up to a bounded number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows, number, gram = 0, -1, None

        def settle() -> pa.RecordBatch:
            groups, rows, first, done, data = zip(*held)
            owner, offset, again = repeated_windows(np.array(groups), list(data), length)
            return _spans(list(rows), np.array(first), owner, offset, again & ~np.array(done)[owner], length)

        for batch in batches:
            for r in batch.to_pylist():
                if r["gram"] != gram:
                    gram, number = r["gram"], number + 1
                    if windows > _BUCKET_WINDOWS:
                        yield settle()
                        held, windows = [], 0
                held.append((number, r["row"], r["first"], r["done"], r["data"]))
                windows += len(r["data"]) - length + 1
        if held:
            yield settle()

    return run


def _window_digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["data"]) - length + 1
                digests = [hashlib.blake2b(r["data"][k : k + length], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([r["row"]] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32) + r["first"]), pa.array([r["done"]] * n, pa.bool_())], names=["digest", "row", "start", "done"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\n"), "text"))))
    runs = _runs(docs, length)  # made twice, for the counts and for the join: written once, they took an executor to 4004 MB
    grams = runs.groupBy("gram").agg(F.count("*").alias("n"), *[f(half).alias(f"{name}_{half}") for half in ("one", "two") for name, f in (("low", F.min), ("high", F.max))], F.max("again").alias("inside"))
    grams = grams.filter("n > 1 or inside").selectExpr("gram", "inside or low_one <> high_one or low_two <> high_two as mixed")
    repeated = stage_table(runs.join(grams, "gram"), "runs")

    copies = repeated.filter("not mixed").select("row", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    mixed = repeated.filter("mixed")
    classes = stage_table(mixed.groupBy("gram", "one", "two").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("at")).select("gram", "one", "two", (F.col("n") > 1).alias("done"), "at.*"), "classes")
    folded = mixed.join(classes.filter("done").select("gram", "one", "two"), ["gram", "one", "two"]).select("row", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))

    # grams whose classes are all copies need no text
    per_gram = classes.groupBy("gram").agg(F.count("*").alias("n"), F.bool_and("done").alias("all_done")).filter("not all_done").select("gram", (F.col("n") > _HOT).alias("hot"))
    wanted = classes.join(per_gram, "gram").groupBy("row").agg(F.collect_list(F.struct("gram", "first", "last", "done", "hot")).alias("runs"))
    fetched = stage_table(_fetch(wanted, docs, length), "representatives")
    sorted_spans = fetched.filter("not hot").repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram").select("gram", "row", "first", "done", "data").mapInArrow(_sort_buckets(length), "row binary, start int, stop int")
    digests = fetched.filter("hot").select("row", "first", "done", "data").mapInArrow(_window_digests(length), "digest binary, row binary, start int, done boolean")
    twice = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    hot_spans = digests.filter("not done").join(twice, "digest").select("row", "start", (F.col("start") + length).alias("stop"))

    spans = copies.union(folded).union(sorted_spans).union(hot_spans)
    spans = spans.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                kept, at, n = [], 0, 0
                stop = -1
                for s in sorted((x["start"], x["stop"]) for x in spans.as_py() or ()):
                    if s[0] > stop:
                        kept.append(data[at : s[0]])
                        n += 1
                    stop = max(stop, s[1])
                    at = max(at, stop)
                kept.append(data[at:])
                rest = b"".join(kept)
                for c, v in zip(cols, (len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(spans, "row", "left").select("id", "text", "spans").mapInArrow(cut, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The same by brute force in SQL: every window of every text, in hexadecimal, by its md5.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, greatest(0, len(x) // 2 - 199))) AS u(i)),
r AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) AS t USING (k)),
g AS (SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 200 AS fresh FROM r),
b AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS z FROM b GROUP BY 1, 2),
k AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY 1),
c AS (SELECT k.doc_id, string_agg(substr(x, 2 * k.a + 1, 2 * (coalesce(k.z, len(x) // 2) - k.a)), '' ORDER BY k.a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1),
q AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY 1)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(c.kept, x))) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)
"""
