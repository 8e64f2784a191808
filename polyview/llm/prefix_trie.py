"""The trie of conversation prefixes, totalled by leaf peeling (operator 13).

A node is known by its depth and a 128-bit digest of its prefix: the exclusive or of digests of (depth, role, text), so a
prefix's digest is a running aggregate and a parent's follows from a child's row.  Texts never leave the first stage; what moves are
digests and byte lengths.

Peeling.  A node's path is that of the longest conversation through it (the smallest id on ties), so paths are vertical, and every
node with c > 0 children has c - 1 that begin other paths.  A path holds a counter of such children that are not finished.  In a round,
paths whose counter is zero send their subtree's totals to the node they hang on; messages to one node meet in partial
aggregates, and the path of that node lowers its counter.  Rounds go on until only the root's path is left.  A leaf thus
takes its whole path along: the rounds number not the depth but the most paths between a leaf and the root, which is below
the square root of twice the nodes.  Last, running sums up each path give every node its totals.

No step puts a conversation, a node's members or its children in one task: turns are numbered by ranges, running aggregates go in
blocks of ``BLOCK`` with offsets, children look their parent up by salted keys, and the lists of ids are hashed from pieces that are made by
ranges (the digest of one list is sequential, and streams).

Rows with a null conversation id take no part.  Null turns come first, null roles and texts count as empty; rows that share a turn
go by a digest of role and text.  Other columns are ignored.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.llm.shared import drop_table, read_tables, stage_table

BLOCK = 4096
SALTS = 256
KEY = ["depth", "a", "b"]
_PARENT = ["up_depth", "up_a", "up_b"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _before(rows: DataFrame, by: str, block: str, order: Column, value: Column) -> DataFrame:
    """``by``, ``block`` and the aggregate ``value`` of all earlier blocks, where there are any: one row a block."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", value.over(window)).filter("before IS NOT NULL").select(by, block, "before")


def number_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest of role and text, and the text's bytes; ranges are numbered side by side."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).filter("conv_id IS NOT NULL")
    rows = stage_table(rows.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "turns")
    # only the first conversation of a range can go on from an earlier one, so offsets number at most the ranges
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    offsets = F.broadcast(_before(sizes, "conv_id", "part", F.col("part"), F.sum("n")))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest"))
    return rows.withColumn("inside", inside).join(offsets, ["conv_id", "part"], "left").select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def rebuild(numbered: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, depth, digest, bytes, length, block) and conversations (conv_id, length).

    Conversation c becomes the first h turns of c - c % group and its own turns after its first h; h is the CRC-32 of c's digits
    modulo ``most``.  The remainder is that of mathematics, never negative.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = lambda c: c - F.pmod(c, F.lit(group))
    sizes = numbered.groupBy("conv_id").agg(F.max("pos").alias("n"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.withColumn("h", head).withColumn("base", first(F.col("conv_id"))).join(bases, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stage_table(convs.select("conv_id", "n", "h", "head", "length"), "conversations")

    own = numbered.filter(F.col("pos") > head).withColumn("own", F.lit(True))
    lent = numbered.filter((F.col("conv_id") == first(F.col("conv_id"))) & (F.col("pos") < most))
    lent = lent.withColumn("conv_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda k: F.try_add("conv_id", k.cast("long")))))
    lent = lent.filter(F.col("conv_id").isNotNull() & (F.col("pos") <= head)).withColumn("own", F.lit(False))
    rows = own.unionByName(lent).withColumn("block", F.when(F.col("own"), F.expr(f"pos div {BLOCK}")).otherwise(0))
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK}"))))
    depth = F.when(F.col("own"), F.col("head") + F.col("pos") - F.col("h")).otherwise(F.col("pos"))
    rows = rows.join(blocks, ["conv_id", "block"]).select("conv_id", depth.alias("depth"), "digest", "bytes", "length", "block")
    return rows, convs.select("conv_id", "length")


def _prefixes(rows: DataFrame) -> DataFrame:
    """Every row with the key of its node (depth, a, b) and of that node's parent."""
    rows = rows.select("conv_id", "depth", "block", "bytes", "length", *[F.xxhash64(F.lit(k), "depth", "digest").alias(x) for k, x in ((1, "x"), (2, "y"))])
    rows = stage_table(rows, "sequences")
    both = F.struct(F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    totals = rows.groupBy("conv_id", "block").agg(both.alias("t")).select("conv_id", "block", "t.a", "t.b")
    window = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "block", F.bit_xor("a").over(window).alias("a0"), F.bit_xor("b").over(window).alias("b0")).filter("block > 0")
    near = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = rows.select("*", F.bit_xor("x").over(near).alias("a1"), F.bit_xor("y").over(near).alias("b1")).join(offsets, ["conv_id", "block"], "left")
    rows = rows.withColumn("a", F.col("a1").bitwiseXOR(F.coalesce("a0", F.lit(0)))).withColumn("b", F.col("b1").bitwiseXOR(F.coalesce("b0", F.lit(0))))
    return rows.select("conv_id", "length", "bytes", *KEY, (F.col("depth") - 1).alias("up_depth"), F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"))


def _nodes(rows: DataFrame) -> DataFrame:
    """One row a node: key, parent's key, conv_id, n_convs, n_children, the bytes of its last text and its path."""
    longest = F.max(F.struct("length", F.bitwise_not("conv_id").alias("c")))
    nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), longest.alias("l"), *[F.max(c).alias(c) for c in _PARENT])
    nodes = stage_table(nodes.withColumn("path", F.bitwise_not("l.c")).drop("l"), "plain_nodes")
    children = nodes.filter("up_depth IS NOT NULL").groupBy(*_PARENT).agg(F.count("*").alias("n_children")).toDF(*KEY, "n_children")
    return stage_table(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")


def peel(nodes: DataFrame) -> DataFrame:
    """key, leaves, saved: what the finished children off a node's path have sent it."""
    own = (F.col("n_convs") - 1) * F.col("bytes")
    top = F.min(F.struct("depth", *_PARENT))
    paths = nodes.groupBy("path").agg(top.alias("top"), F.sum(F.greatest(F.col("n_children") - 1, F.lit(0))).alias("open"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum(own).alias("saved"))
    active = stage_table(paths.select("path", *[f"top.{c}" for c in _PARENT], "open", "leaves", "saved"), "paths")
    junctions = stage_table(nodes.filter("n_children > 1").select(*KEY, "path"), "junctions")
    sums = lambda *more: [F.sum(c).alias(c) for c in (*more, "leaves", "saved")]
    sent = []
    while not active.filter("open > 0").isEmpty():
        done = active.filter("open = 0").withColumn("n", F.lit(1))
        messages = done.groupBy(*_PARENT).agg(*sums("n")).toDF(*KEY, "n", "leaves", "saved")
        sent.append(stage_table(messages.join(junctions, KEY), "messages"))
        got = sent[-1].groupBy("path").agg(*sums("n")).toDF("path", "n", "more_leaves", "more_saved")
        add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        rest = active.filter("open > 0").join(got, "path", "left").select("path", *_PARENT, (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), add("leaves", "more_leaves"), add("saved", "more_saved"))
        last, active = active, stage_table(rest, "paths")
        drop_table(last)
    drop_table(active)
    received = read_tables(sent) if sent else junctions.limit(0).selectExpr("*", "0L AS leaves", "0L AS saved")
    return received.groupBy(*KEY).agg(*sums())


def _up_paths(nodes: DataFrame, received: DataFrame) -> DataFrame:
    """Nodes with n_leaves and saved_tokens of their subtrees, by running sums from the foot of each path to its top."""
    leaves, saved = F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")
    rows = nodes.join(received, KEY, "left").withColumn("leaves", leaves).withColumn("saved", saved).withColumn("block", F.expr(f"depth div {BLOCK}"))
    rows = stage_table(rows, "totals")
    below = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    offsets = blocks.select("path", "block", F.sum("l").over(below).alias("l0"), F.sum("s").over(below).alias("s0")).filter("l0 IS NOT NULL")
    near = Window.partitionBy("path", "block").orderBy(F.desc("depth"))
    rows = rows.withColumn("l1", F.sum("leaves").over(near)).withColumn("s1", F.sum("saved").over(near)).withColumn("up_conv", F.lead("conv_id").over(near)).join(offsets, ["path", "block"], "left")
    add = lambda c, d: F.col(c) + F.coalesce(d, F.lit(0))
    return rows.select(*KEY, *_PARENT, "conv_id", "n_convs", "n_children", "up_conv", add("l1", "l0").alias("n_leaves"), add("s1", "s0").alias("saved_tokens"))


def _parents(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """key and parent's conv_id of rows whose parent is on another path or block; a parent is copied once for each salt that asks."""
    asking = rows.filter("up_conv IS NULL AND up_depth IS NOT NULL").select(*KEY, *_PARENT, F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).alias("salt"))
    known = nodes.select(*[F.col(k).alias(p) for k, p in zip(KEY, _PARENT)], F.col("conv_id").alias("found"))
    answers = asking.select(*_PARENT, "salt").distinct().join(known, _PARENT)
    return asking.join(answers, [*_PARENT, "salt"]).select(*KEY, "found")


_SHA = "depth long, a long, b long, piece long, ids string, digest string"


def _list_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids: a digest, or the ids themselves where the run may go on in another batch."""
    piece = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        ids = batch.column("conv_id").to_pylist()
        lists = [",".join(map(str, ids[s:e])) for s, e in zip(cuts, cuts[1:])]
        last = len(lists) - 1
        digests = [None if k in (0, last) else hashlib.sha256(x.encode()).hexdigest() for k, x in enumerate(lists)]
        texts = [x if d is None else None for x, d in zip(lists, digests)]
        first = key[cuts[:-1]]
        yield pa.RecordBatch.from_arrays([*[pa.array(first[:, k].copy()) for k in range(3)], pa.array(np.full(len(lists), piece)), pa.array(texts, pa.string()), pa.array(digests, pa.string())], names=[*KEY, "piece", "ids", "digest"])
        piece += 1


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*[(c, pa.int64()) for c in KEY], ("ends_sha256", pa.string())])
    key, state = None, None
    row = lambda: dict(zip(KEY, key)) | {"ends_sha256": state.hexdigest()}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            mine = tuple(r[c] for c in KEY)
            if state and mine != key:
                out.append(row())
                state = None
            if r["digest"]:
                out.append({c: r[c] for c in KEY} | {"ends_sha256": r["digest"]})
            elif state:
                state.update(b"," + r["ids"].encode())
            else:
                key, state = mine, hashlib.sha256(r["ids"].encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if state:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def _ends(rows: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes where some conversation ends."""
    ends = rows.filter("depth = length").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    return ends.mapInArrow(_list_ids, _SHA).repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(_join_ids, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``sequences`` as ``rebuild`` gives them: a row for each turn, block being monotone in depth; ``convs`` (conv_id, length) also holds
    conversations without turns.
    """
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", "length", zero.alias("bytes"), *[zero.alias(c) for c in KEY], *[none.alias(c) for c in _PARENT])
    rows = stage_table(_prefixes(sequences).unionByName(root), "prefixes")
    nodes = _nodes(rows)
    totals = stage_table(_up_paths(nodes, peel(nodes)), "subtrees")
    out = totals.join(_parents(totals, nodes), KEY, "left").join(_ends(rows), KEY, "left")
    return out.select("conv_id", "depth", F.coalesce("up_conv", "found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


#: The same in SQL; CRC-32 goes bit by bit.
ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - ((conv_id % 5) + 5) % 5 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda r, x: list_reduce(list_prepend(xor(r, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, CASE WHEN s % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 9 AS h
      FROM t GROUP BY conv_id),
s AS (SELECT c.conv_id, pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= c.h
      UNION ALL SELECT c.conv_id, least(c.h, coalesce(m.n, 0)) + pos - c.h, role, text FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c AS m ON m.conv_id = c.base WHERE pos > c.h),
k AS (SELECT conv_id, depth, octet_length(encode(text)) AS bytes, list(length(role)::VARCHAR || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM s),
r AS (SELECT conv_id, depth, bytes, sha256(array_to_string(list_transform(prefix, lambda x: sha256(x)), ' ')) AS node FROM k
      UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
p AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM r),
n AS (SELECT node, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY node),
m AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.up = n.node) AS n_children FROM n),
d AS (SELECT DISTINCT x.node AS top, y.node FROM r AS x JOIN r AS y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
g AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM d JOIN m USING (node) GROUP BY top)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN g ON g.top = m.node LEFT JOIN n AS u ON u.node = m.up
"""
