"""Exact top-k inner products, norm-sorted with SVD-rotated partial sums (operator 8).

The Gram matrix of all vectors (dimension squared numbers) gives the rotation that puts most of the energy into the first
coordinates.  Rows are dealt to levels of descending length, a level to parts, and queries to blocks.  First every query
meets one part of the longest rows; the k-th score it finds there is its floor.  Then come the other levels in
growing groups, longest rows first: a query goes only to levels whose longest row can still reach its floor, a part goes only
to blocks where some query asks for it, and each group raises the floors for the next.  Within a
task rows go by descending length in strips.  A pair's partial sum over the first rotated
coordinates plus the Cauchy-Schwarz bound on the rest decides whether its exact integer product is needed, and a strip
whose longest row cannot reach any query's k-th score ends the task.

Scores are exact.  Scaled components are whole numbers held as doubles, lengths are doubles and bounds have slack for their
rounding.  A product whose lengths keep it in 52 bits is taken in doubles, in 62 bits in 64-bit integers, beyond in Python's integers.
A score past 64 bits cannot be returned: the query fails with an error where such a score is among the k best, rather than give a
wrong or a shorter answer.

Vectors that are null or hold a null or non-finite number take no part (nor those with a scaled component of 1e300 or more in size), nor do
rows with a null id; an empty vector meets no
other.  Vectors of different lengths are not compared.  A query's own row is every row with its id.  Ties go to the smaller id.
Rows that repeat an id are candidates one by one, and query rows that share an id answer as one query.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polyview.llm.shared import stage_table

QUERY_BLOCK = 2048
ROW_PART = 4096
LEVELS = 16
#: No candidate yet, and a score below what 64 bits hold.
_NONE, _BELOW = -(1 << 63), -(1 << 63) + 1


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, floor(scale * x) as doubles (a double of 2 ** 53 or more has no fraction), and length of every whole vector."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
            column = batch.column(1)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # a null component is no number
            with np.errstate(over="ignore"):
                v = np.floor(flat.astype(np.float64) * scale)
            bad = np.concatenate([[0], np.cumsum(~(np.abs(v) < 1e300))])
            keep = bad[offsets[1:]] == bad[offsets[:-1]]
            ids, column = batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)).filter(pa.array(keep))
            length = np.zeros(len(ids))
            for size, rows, group in _by_size(column):
                most = np.abs(group).max(axis=1, initial=0)
                length[rows] = most * np.sqrt(((group / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([ids, column, pa.array(length)], names=["id", "v", "length"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(whole, "id long, v array<double>, length double")


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task's Gram matrix by vector size; vectors count by direction, so that none drowns the others."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, _, group in _by_size(batch.column(0)):
            x = group / np.maximum(np.abs(group).max(axis=1, initial=1)[:, None], 1)
            total[size] = total.get(size, 0) + x.T @ x
    for size, m in total.items():
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], names=["size", "i", "gram"])


def _by_size(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each size of vectors: the size, their rows, and the vectors."""
    starts = column.offsets.to_numpy()
    sizes, flat = np.diff(starts), column.values.to_numpy(zero_copy_only=False)
    return [(int(s), np.flatnonzero(sizes == s), flat[starts[:-1][sizes == s][:, None] + np.arange(s)]) for s in np.unique(sizes)]


def _add_rows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"size": [key[0]], "i": [key[1]], "gram": [np.sum(np.stack(rows["gram"].to_list()), axis=0)]})


def _products(q: np.ndarray, c: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ``reach`` bounds their sizes."""
    if reach.max(initial=0) < 2.0**52:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    small = reach < 2.0**62
    out = np.zeros(len(q), np.int64)
    with np.errstate(invalid="ignore"):  # where a component is past 64 bits but the product is not, the other side is zero
        out[small] = np.einsum("ij,ij->i", q[small].astype(np.int64), c[small].astype(np.int64))
    for k in np.flatnonzero(~small).tolist():
        score = sum(int(a) * int(b) for a, b in zip(q[k].tolist(), c[k].tolist()))
        if score >= 1 << 63:
            raise OverflowError(f"an inner product of {score} does not fit in 64 bits")
        out[k] = max(score, _BELOW)
    return out


def _search(k: int, rotation: dict[int, np.ndarray], head: int, strip: int = 512):
    def unit(v: np.ndarray, length: np.ndarray) -> np.ndarray:
        return v / np.where(length > 0, length, 1)[:, None]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in rows["v"].map(len).unique():
            part = rows[rows["v"].map(len) == size]
            q, c = part[part["is_query"]], part[~part["is_query"]]
            if not size or not len(q) or not len(c):
                continue
            turn = rotation[int(size)]
            qi, ci = np.array(q["v"].tolist(), np.float64), np.array(c["v"].tolist(), np.float64)
            q_id, c_id = q["id"].to_numpy(), c["id"].to_numpy()
            q_length, length = q["length"].to_numpy(), c["length"].to_numpy()
            order = np.lexsort((c_id, -length))
            ci, c_id, length = ci[order], c_id[order], length[order]
            # partial sums and bounds are those of directions, so that no length overflows or drowns another
            qr, cr = unit(qi, q_length) @ turn, unit(ci, length) @ turn
            q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(axis=1)), np.sqrt((cr[:, head:] ** 2).sum(axis=1))
            floor = q["floor"].to_numpy()
            best, best_id = np.full((len(q_id), k), _NONE), np.full((len(q_id), k), np.iinfo(np.int64).max)
            for s in range(0, len(c_id), strip):
                reach = np.maximum(best[:, -1], floor)
                worst = np.where(reach > _BELOW, reach.astype(np.float64), -np.inf)
                with np.errstate(over="ignore"):
                    live = np.flatnonzero(q_length * length[s] * (1 + 1e-6) + 1 >= worst)
                if not len(live):
                    break
                block = slice(s, s + strip)
                with np.errstate(over="ignore", invalid="ignore"):
                    sizes = q_length[live][:, None] * length[block]
                    bound = sizes * (qr[live, :head] @ cr[block, :head].T + q_rest[live][:, None] * c_rest[block] + 1e-6) + 1
                # exact products only where the bound reaches the k-th score so far; a bound that is no number reaches it
                x, y = np.nonzero(~(bound < worst[live][:, None]) & (c_id[block] != q_id[live][:, None]))
                score = np.full(bound.shape, _NONE)
                for j in range(0, len(x), 1 << 16):
                    a, b = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
                    score[a, b] = _products(qi[live[a]], ci[s + b], sizes[a, b])
                every = np.concatenate([best[live], score], axis=1)
                ids = np.concatenate([best_id[live], np.broadcast_to(c_id[block], score.shape)], axis=1)
                pick = np.lexsort((ids, ~every), axis=1)[:, :k]  # ~ descends without overflow
                best[live], best_id[live] = np.take_along_axis(every, pick, 1), np.take_along_axis(ids, pick, 1)
            real = best > _NONE
            out.append(pd.DataFrame({"slot": np.repeat(q["slot"].to_numpy(), k)[real.reshape(-1)], "query_id": np.repeat(q_id, k)[real.reshape(-1)], "vec_id": best_id[real], "score": best[real]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("slot", "query_id", "vec_id", "score")})

    return run


def _levels(rows: DataFrame, part_rows: int) -> tuple[Column, list[Row]]:
    """The level of a row by its length, longest first, and of each level: its number, rows, greatest length, parts."""
    n = rows.count()
    count = min(LEVELS, -(-n // part_rows))
    cuts = sorted(set(rows.approxQuantile("length", [i / count for i in range(1, count)], 0.01))) if count > 1 else []
    level = sum((F.when(F.col("length") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    stats = rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.max("length").alias("top")).orderBy("level").collect()  # at most LEVELS rows
    return level, stats


def top_products(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", head: int = 16, part_rows: int = ROW_PART) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of every row for which ``is_query`` (SQL on id) holds.

    ``part_rows`` is the number of rows that one task compares at a time with a block of queries.
    """
    rows = integer_vectors(vectors, scale, id_col, vector_col).withColumn("is_query", F.expr(is_query))
    rows = stage_table(rows.withColumn("slot", F.monotonically_increasing_id()), "vectors")  # written, so a row keeps its slot
    sums = rows.select("v").mapInArrow(_gram, "size int, i int, gram array<double>").groupBy("size", "i").applyInPandas(_add_rows, "size int, i int, gram array<double>").collect()
    rotation: dict[int, np.ndarray] = {}  # dimension squared numbers for each size of vectors
    for size in {r["size"] for r in sums}:
        gram = np.array([r["gram"] for r in sorted((r for r in sums if r["size"] == size), key=lambda r: r["i"])])
        rotation[size] = np.linalg.eigh(gram)[1][:, ::-1]
    level, stats = _levels(rows, part_rows)
    blocks = max(1, -(-rows.filter("is_query").count() // QUERY_BLOCK))
    spread = F.xxhash64("slot")
    parts, first = {}, 0  # of a level: its first part and how many it has
    for r in stats:
        parts[r["level"]] = (first, -(-r["n"] // part_rows))
        first += parts[r["level"]][1]

    part = F.lit(0)
    for at, (start, many) in parts.items():
        part = F.when(F.col("level") == at, F.lit(start) + F.pmod(spread, F.lit(many)).cast("int")).otherwise(part)
    candidates = rows.withColumn("level", level).select("id", "v", "slot", "length", part.cast("int").alias("part"))
    queries = rows.filter("is_query").select("id", "v", "slot", "length", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"))

    def meet(asked: DataFrame, held: DataFrame) -> DataFrame:
        """Local results of queries (with block, part, floor) and candidates (with part), which go to the blocks that ask for it."""
        names = ["id", "v", "slot", "length", "floor", "block", "part"]
        held = held.join(asked.select("block", "part").distinct(), "part").withColumn("floor", F.lit(_NONE))
        both = asked.select(*names, F.lit(True).alias("is_query")).unionByName(held.select(*names, F.lit(False).alias("is_query")))
        return both.groupBy("block", "part").applyInPandas(_search(k, rotation, head), "slot long, query_id long, vec_id long, score long")

    def best(found: DataFrame, by: str) -> DataFrame:
        # row_number with a limit is cut to k rows before the shuffle as well
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    local = meet(queries.select("*", F.lit(_NONE).alias("floor"), F.lit(0).alias("part")), candidates.filter("part = 0"))
    # groups of levels, each twice as many as the last: (level's first part, its last, greatest length); part 0 is done
    spans = [(max(1, parts[r["level"]][0]), sum(parts[r["level"]]) - 1, float(r["top"])) for r in stats if sum(parts[r["level"]]) > 1]
    for g in (slice((1 << j) - 1, (1 << (j + 1)) - 1) for j in range(LEVELS)):
        if not spans[g]:
            break
        local = stage_table(local, "found")
        floors = best(local, "slot").groupBy("slot").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).select("slot", "floor")
        asked = queries.join(floors, "slot", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
        ranges = [F.struct(F.lit(top).alias("top"), F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z, top in spans[g]]
        # as in a task: length times length, with slack for rounding, against the k-th score
        open_ = F.filter(F.array(*ranges), lambda p: F.col("length") * p.top * (1 + 1e-6) + 1 >= F.col("floor"))
        asked = stage_table(asked.select("*", F.explode(F.flatten(F.transform(open_, lambda p: F.sequence(p.a, p.z)))).alias("part")), "asked")
        if asked.isEmpty():
            break  # nor can shorter rows reach
        local = local.unionByName(meet(asked, candidates.filter(F.col("part").between(spans[g][0][0], spans[g][-1][1]))))
    past = F.raise_error(F.lit("an inner product among the best does not fit in 64 bits"))
    score = F.when(F.col("score") > _BELOW, F.col("score")).otherwise(past)
    return best(local, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


#: The same by brute force in SQL.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
