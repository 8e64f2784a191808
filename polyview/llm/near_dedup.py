"""MinHash near-duplicates with tensored banding and full verification (operator 7).

Two small collections of keys are formed: collection A has ``tables`` keys of ``rows`` minhashes each, and so has B.
A table's key is a pair (key of A, key of B); all tables**2 pairs act as tables, so 2 * tables *
rows minhashes do the work of 2 * tables**2 * rows.  With the defaults (14 tables, 4 + 4 rows) a pair with
similarity 0.85 is missed with probability 7e-5, one with 0.9 with 1e-6.

A document has a partner only if it shares a key of A and a key of B with others, so only keys
that at least two sets share are paired up.  Documents with equal sets are folded first.  In each bucket every
member names the bucket's smallest id; each document is verified against the hub that most of its buckets name, and
components are formed.  Keys of A whose documents then still lie in several components are compared across components,
in square blocks, by signatures; pairs that may reach the threshold are verified on full sets, likeliest first, unless
earlier links have joined their components.

Words are runs without ASCII white space, A-Z lower-cased, as bytes.  Null and blank texts have an empty
set and no links.  Every row has its result row; rows that share an id each have the class of their own set.  Rows with a null id
are in no class and are kept.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.components import connected_components
from polyview.llm.shared import stage_table

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rows and shingles of a block of a bucket's members: two blocks meet in a task.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 4 << 20
#: A set is dealt to several tasks if it holds more than this share of all rows (so at most 1000 are), and this many rows.
HOT_SHARE, HOT_ROWS = 0.001, 1024
_LONG = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0x2545F4914F6CDD1D)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a byte array."""
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    codes = _BYTES[_LOWER[data]]
    for k in range(min(int(lengths.max()), _LONG)):  # Horner's rule, all words side by side
        live = np.flatnonzero(lengths > k)
        if len(live) < len(out):
            out[live] = out[live] * _ODD + codes[starts[live] + k]
        else:
            out = out * _ODD + codes[starts + k]
    if lengths.max() > _LONG:  # very long words: the same sums, of weighted codes
        power = np.full(int(lengths.max()), _ODD)
        power[0] = 1
        power = np.cumprod(power)
        for k in np.flatnonzero(lengths > _LONG):
            out[k] = (codes[starts[k] : ends[k]] * power[: lengths[k]][::-1]).sum()
    return _mix(out + lengths.astype(np.uint64))


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than ``size`` make one shingle."""
    words = word_hashes(np.frombuffer(text, np.uint8))
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _ODD + words[k : n - width + 1 + k])
    return np.unique(out)


def signature(items: np.ndarray, hashes: int) -> np.ndarray:
    """Minhashes of a non-empty set."""
    seeds = _mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    a, b = seeds[:hashes] | np.uint64(1), seeds[hashes:]
    low = np.full(hashes, ~np.uint64(0))
    for k in range(0, len(items), 4096):  # the high half of a multiply-add
        low = np.minimum(low, ((items[k : k + 4096, None] * a + b) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint64)


def _sets(docs: DataFrame, size: int, tables: int, rows: int) -> DataFrame:
    """id, n_shingles, digest of the set, key arrays a and b, signature of one byte a minhash."""
    hashes = 2 * tables * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        lanes = _mix(np.arange(7, 7 + 2 * tables, dtype=np.uint64))
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                items = shingle_set(text.as_py() or b"", size)
                if len(items):
                    low = signature(items, hashes)
                    keys = _mix((low.reshape(2 * tables, rows) * weights).sum(axis=1) + lanes).astype(np.int64)
                    digest, sig = hashlib.blake2b(items.tobytes(), digest_size=16).digest(), (low & np.uint64(255)).astype(np.uint8).tobytes()
                else:
                    keys, digest, sig = np.zeros(0, np.int64), b"", b""
                for c, v in zip(cols, (key, len(items), digest, keys[:tables].tolist(), keys[tables:].tolist(), sig)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["id", "n_shingles", "digest", "a", "b", "sig"])

    return docs.mapInArrow(run, "id long, n_shingles long, digest binary, a array<long>, b array<long>, sig binary")


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, y, s, t in zip(a, b, batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if x not in held:  # rows come sorted by the first id
                    held = {x: shingle_set(s.as_py(), size)}
                other = shingle_set(t.as_py(), size)
                common = len(np.intersect1d(held[x], other, assume_unique=True))
                keep.append(100 * common >= percent * (len(held[x]) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one, two = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _candidates(rows: pd.DataFrame, percent: int, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left rows, right rows and the places they agree on, of a block pair: other component, sizes and signatures near enough,
    and no earlier lane shared, so that each pair is looked at in one bucket only.  A block that meets itself comes once."""
    block = rows["block"].to_numpy()
    itself = rows["i"].iloc[0] == rows["j"].iloc[0]
    left, right = np.flatnonzero(block == rows["i"].iloc[0]), np.flatnonzero(block == rows["j"].iloc[0])
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
    lanes = np.stack(rows["a"].to_list())
    ids, comp, size = (rows[c].to_numpy() for c in ("id", "component", "n_shingles"))
    lane = int(rows["lane"].iloc[0])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for x in left if len(right) else []:
        fit = (comp[right] != comp[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x]))
        if itself:
            fit &= ids[right] > ids[x]
        other = right[fit]
        agreed = (sig[other] == sig[x]).sum(axis=1)
        other, agreed = other[agreed >= cut], agreed[agreed >= cut]
        first = (lanes[other] == lanes[x]).argmax(axis=1) == lane
        if first.any():
            found.append((np.full(int(first.sum()), x, np.int32), other[first].astype(np.int32), agreed[first].astype(np.int16)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16)
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


def _open_rows(percent: int, cut: int):
    """The rows of a block pair that take part in some candidate pair."""

    def scan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y, _ = _candidates(rows, percent, cut)
        return rows.iloc[np.union1d(x, y)][["bucket", "i", "j", "block", "lane", "id", "component"]]

    return scan


def _links_across(percent: int, cut: int, shingle: int):
    """Links between components of a block pair, likeliest first; a pair that earlier links have joined needs no look."""

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        ids, texts, held, out = rows["id"].to_numpy(), rows["text"].to_numpy(), {}, []
        x, y, agreed = _candidates(rows, percent, cut)
        order = np.lexsort((ids[y], ids[x], -agreed))
        for start in range(0, len(order), 4096):
            part = order[start : start + 4096]
            for k in part[group[x[part]] != group[y[part]]].tolist():
                u, v = int(x[k]), int(y[k])
                if group[u] == group[v]:
                    continue
                for r in (u, v):
                    if r not in held:
                        held[r] = shingle_set(texts[r].encode(), shingle)
                common = len(np.intersect1d(held[u], held[v], assume_unique=True))
                if 100 * common >= percent * (len(held[u]) + len(held[v]) - common):
                    group[group == group[v]] = group[u]
                    out.append((ids[u], ids[v]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return verify


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, tables: int = 14, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept.  Links are pairs of similarity >= percent / 100."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stage_table(_sets(docs, shingle, tables, rows), "sets")
    filled = sets.filter("n_shingles > 0 and id is not null")
    folded = filled.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # an id's own set stands for all documents with an equal set
    reps = stage_table(filled.join(folded, (filled.digest == folded.digest) & (filled.id == folded.rep)).select("id", "n_shingles", "a", "b", "sig"), "reps")

    lanes = reps.select("id", "n_shingles", F.posexplode(F.concat("a", "b")).alias("lane", "key"))
    shared = lanes.groupBy("lane", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    mine = lanes.join(shared, ["lane", "key"]).groupBy("id").agg(F.first("n_shingles").alias("n_shingles"), F.collect_list(F.struct("lane", "key")).alias("keys"))
    first, second = F.filter("keys", lambda x: x.lane < tables), F.filter("keys", lambda x: x.lane >= tables)
    mine = mine.select("id", "n_shingles", first.alias("a"), second.alias("b")).filter("size(a) > 0 and size(b) > 0")
    table_keys = mine.select("id", F.explode("a").alias("x"), "b").select("id", "x", F.explode("b").alias("y")).select(F.xxhash64("x", "y").alias("bucket"), "id")
    table_keys = stage_table(table_keys, "buckets")
    buckets = table_keys.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top").select("bucket", "hub")
    members = stage_table(table_keys.join(buckets, "bucket"), "members")

    votes = members.filter("hub < id").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("hub")).alias("low"))).alias("best")).select((-F.col("best.low")).alias("a"), F.col("id").alias("b"))
    links = stage_table(_verify(best, docs, shingle, percent), "links")
    component = connected_components(links)

    # keys of A whose documents lie in several components: compare across, in square blocks
    cut = int(2 * tables * rows * (percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (2 * tables * rows)) ** 0.5))
    waiting = members.select("id").distinct()
    told = mine.join(waiting, "id").select("id", "n_shingles", F.explode("a").alias("x")).join(component, "id", "left").select(F.xxhash64("x").alias("bucket"), F.col("x.lane").alias("lane"), "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    told = stage_table(told, "told")
    split = told.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("all")).filter("low < high")
    split = split.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows_ = told.drop("n_shingles").join(split, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sided = rows_.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "lane", "id", "component")
    light = reps.select("id", "n_shingles", "a", "sig")
    taking = sided.join(light, "id").groupBy("bucket", "i", "j").applyInPandas(_open_rows(percent, cut), "bucket long, i int, j int, block int, lane int, id long, component long")
    taking = stage_table(taking, "open")
    more = taking.join(light, "id").join(docs, "id").groupBy("bucket", "i", "j").applyInPandas(_links_across(percent, cut, shingle), "a long, b long")
    more = stage_table(more, "links")
    component = connected_components(links.union(more))

    # the smallest id of a class is its representative, so a component's smallest representative is its smallest id
    classes = folded.join(component, folded.rep == component.id, "left").select("digest", "n", F.coalesce("component", "rep").alias("component"))
    limit = max(HOT_ROWS, sets.count() * HOT_SHARE)
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(folded.filter(F.col("n") > limit).select("digest", salts.alias("salts")))  # at most 1 / HOT_SHARE rows
    dealt = filled.select("id", "n_shingles", "digest").join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    copies = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    joined = dealt.join(copies, ["digest", "salt"]).select("id", "n_shingles", "component")
    rest = sets.filter("NOT (n_shingles > 0 AND id IS NOT NULL)").select("id", "n_shingles", F.col("id").alias("component"))
    out = joined.unionByName(rest).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


#: The same by brute force in SQL: every pair that shares a shingle, and who reaches whom.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT doc_id, x FROM s SEMI JOIN (SELECT x FROM s GROUP BY x HAVING count(*) > 1) AS r USING (x)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h AS a JOIN h AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n AS m ON m.doc_id = a JOIN n AS k ON k.doc_id = b WHERE 100 * c >= 85 * (m.n + k.n - c)),
r(a, b) AS (SELECT a, b FROM (SELECT a, b FROM e UNION SELECT b, a FROM e) AS f UNION SELECT r.a, f.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) AS f ON f.a = r.b),
m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
