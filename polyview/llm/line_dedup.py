"""Removal of repeated multi-line passages by content-defined line chunks, in DataFrame functions only (operator 2).

A rolling hash over the digests of a line and the line before it decides where chunks end, so that lines inserted in one
copy move no border farther on.  The chance of a border grows with the bytes of the two lines: lines that hold ``TARGET`` bytes
together always have one between their chunk and the next, so chunks hold about as many bytes, whatever the length of lines.
A line that repeats the one before it always ends a chunk.

A border whose two lines follow each other elsewhere too is an anchor.  From each anchor the match is extended
line by line over the chunk that ends there and the next one: pairs of neighbouring lines are grouped, and a pair that occurs
again is removed at all places but its first (smallest document id, then place).  Both lines of a pair's first place stay, even if
another pair would remove one of them, so every pair that is removed anywhere still stands whole in some result.  A repeated passage goes
whole if a border lies between two of its lines, whatever stands around it; one without is missed.  A passage of
two or more lines with 2 * TARGET bytes in lines of any length nearly always has one.  Single lines are never removed, but where a
line repeats itself in a row two of them stay.

Lines are known by 64-bit hashes only after all lines with a hash were found to hold the same bytes; lines that differ
under one hash are numbered and told apart by hash and number.  Pairs that hold a large share of all pairs are salted.

Empty lines go with the line before them.  Null text is kept null and has no lines.  Rows with the same id and text count as one
document and get the same result; a document is known by the 128-bit digest of both.  Null ids come first.
Other columns pass through; those named as the results are replaced, and no other name is reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.shared import stage_table

#: Two neighbouring lines of so many bytes always end a chunk; shorter ones in proportion.
TARGET = 128
#: A pair is salted if it holds more than this share of all repeated pairs (so at most 1000 are), and this many rows.
HOT_SHARE, HOT_ROWS = 0.001, 4096


def _lines(text: Column) -> Column:
    """Lines, each with the empty lines that follow it."""
    return F.split(text, r"\n(?=[^\n])", -1)


def _borders(lines: Column, digests: Column) -> Column:
    """Places (from 0) of the lines that end a chunk together with the line before them."""
    last = F.size(lines) - 1

    def ends(i: Column) -> Column:
        rolling = F.conv(F.substring(F.md5(F.concat(F.get(digests, i - 1), F.get(digests, i))), 1, 8), 16, 10).cast("long")
        return (i == last) | (F.get(digests, i - 1) == F.get(digests, i)) | (rolling % TARGET < F.octet_length(F.get(lines, i - 1)) + F.octet_length(F.get(lines, i)))

    return F.when(last > 0, F.filter(F.sequence(F.lit(1), last), ends))


def _keyed_lines(docs: DataFrame) -> DataFrame:
    """row, id, keys of the lines (equal only for equal bytes) and borders of documents (row, id, text)."""
    lined = docs.filter("text is not null").select("row", "id", _lines(F.col("text")).alias("lines")).filter("size(lines) > 1")
    hashed = lined.withColumn("digests", F.transform("lines", F.md5)).select("row", "id", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("keys"), _borders(F.col("lines"), F.col("digests")).alias("ends"))
    texts = lined.select(F.explode("lines").alias("line")).select(F.xxhash64("line").alias("hash"), "line").distinct()
    mixed = stage_table(texts.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "mixed")
    if mixed.limit(1).count():  # hashes that differing lines share: number these lines by their bytes
        number = F.transform(F.array_sort(F.collect_list("line")), lambda x, k: F.struct(k.alias("no"), x.alias("line")))
        numbered = texts.join(mixed, "hash", "left_semi").groupBy("hash").agg(number.alias("l")).select("hash", F.inline("l"))
        placed = hashed.select("row", "id", "ends", F.posexplode("lines").alias("place", "line")).dropDuplicates(["row", "place"])
        told = placed.withColumn("hash", F.xxhash64("line")).join(numbered, ["hash", "line"], "left")
        told = told.groupBy("row").agg(F.first("id").alias("id"), F.first("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("place", "hash", F.coalesce("no", F.lit(0)).alias("no")))).alias("all"))
        hashed = told.select("row", "id", F.transform("all", lambda x: F.struct(x.hash, x.no)).alias("keys"), "ends")
    return stage_table(hashed.select("row", "id", "keys", "ends"), "keyed")


def _pairs(rows: DataFrame, place: str, *more: str) -> DataFrame:
    return rows.select(F.get("keys", F.col(place) - 1).alias("k1"), F.get("keys", F.col(place)).alias("k2"), "row", place, *more)


def _salted_join(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs`` joined with the table ``groups`` (k1, k2, n, ...); pairs of hot groups are spread over several tasks."""
    limit = max(HOT_ROWS, (groups.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = groups.filter(F.col("n") > limit).select("k1", "k2", salts.alias("salts"))  # at most 1 / HOT_SHARE rows
    pairs = pairs.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return pairs.join(groups, ["k1", "k2", "salt"])


def repeated_places(docs: DataFrame) -> DataFrame:
    """row and the places of the lines that go, for documents (row, id, text) that lose lines."""
    keyed = _keyed_lines(docs)
    # anchors: borders whose two lines occur together again; each opens the chunk that ends there and the next
    start, stop = F.coalesce(F.get("ends", F.col("nth") - 1), F.lit(0)) + 1, F.coalesce(F.get("ends", F.col("nth") + 1), F.col("e"))
    borders = keyed.select("*", F.posexplode("ends").alias("nth", "e"))
    borders = _pairs(borders.withColumn("start", start).withColumn("stop", stop), "e", "start", "stop")
    anchors = stage_table(borders.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    opened = _salted_join(borders, anchors).groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    # extension: all neighbouring lines inside opened chunks
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.stop))))
    pairs = keyed.join(opened, "row").select("row", "id", "keys", F.explode(places).alias("place"))
    pairs = stage_table(_pairs(pairs, "place", "id"), "pairs")
    groups = pairs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "place")).alias("first")).filter("n > 1")
    groups = stage_table(groups.select("k1", "k2", "n", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place")), "groups")
    met = _salted_join(pairs.drop("id"), groups).withColumn("is_first", F.expr("row = first_row AND place = first_place"))
    both = lambda c: F.array_union(F.transform(c, lambda i: i - 1), c)
    places = [F.collect_set(F.when(F.col("is_first") == first, F.col("place"))).alias(c) for c, first in (("second", False), ("stay", True))]
    return met.groupBy("row").agg(*places).select("row", F.array_except(both("second"), both("stay")).alias("gone")).filter("size(gone) > 0")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated passages gone, and n_lines, n_removed_lines."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    # input columns travel under names of their own, so that none meets one used here
    inner = {c: {id_col: "id", text_col: "text"}.get(c, f"in_{k}") for k, c in enumerate(columns)}
    boxed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))
    # never null, so that both kinds of join below read the one exchange of texts
    boxed = boxed.withColumn("row", F.coalesce(digest, F.lit(bytearray())))
    gone = stage_table(repeated_places(boxed.select("row", "id", "text")), "gone")
    marked = boxed.join(gone.hint("merge"), "row", "left")  # lost lines grow with the input: never broadcast

    def count(text: Column) -> Column:
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1

    unbox = lambda new: [new.alias(c) if c == text_col else F.col(n).alias(c) for c, n in inner.items()]
    touched = marked.filter("gone is not null").withColumn("lines", _lines(F.col("text")))
    touched = touched.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"))
    touched = touched.withColumn("kept", F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    n_kept = F.when(F.size("stay") > 0, count(F.col("kept"))).otherwise(0)
    touched = touched.select(*unbox(F.col("kept")), count(F.col("text")).cast("long").alias("n_lines"), (count(F.col("text")) - n_kept).cast("long").alias("n_removed_lines"))
    n_lines = F.coalesce(count(F.col("text")), F.lit(0)).cast("long")
    whole = marked.filter("gone is null").select(*unbox(F.col("text")), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed_lines"))
    return touched.unionByName(whole)


#: The same in SQL: borders from md5, chunks next to repeated borders, pairs of lines by their bytes, all first places kept whole.
ORACLE = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(regexp_replace(text, '\n([^\n])', chr(1) || 'line' || chr(1) || '\1', 'g'), chr(1) || 'line' || chr(1)) AS l
           FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, i, l[i] AS line, CASE WHEN i > 1 THEN l[i - 1] END AS prev, len(l) AS n FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
b AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN i = n OR prev = line THEN 1
      WHEN ('0x' || substr(md5(md5(prev) || md5(line)), 1, 8))::BIGINT % {TARGET} < strlen(prev) + strlen(line) THEN 1 ELSE 0 END AS ends FROM l),
k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
a AS (SELECT doc_id, text, chunk FROM k WHERE ends = 1 QUALIFY count(*) OVER (PARTITION BY prev, line) > 1),
o AS (SELECT doc_id, text, chunk FROM a UNION SELECT doc_id, text, chunk + 1 FROM a),
p AS (SELECT doc_id, text, i, count(*) OVER (PARTITION BY prev, line) AS times, row_number() OVER (PARTITION BY prev, line ORDER BY doc_id NULLS FIRST, i) AS nth
      FROM k SEMI JOIN o ON k.doc_id IS NOT DISTINCT FROM o.doc_id AND k.text = o.text AND k.chunk = o.chunk WHERE i > 1),
g AS (SELECT doc_id, text, i - k AS i FROM p, range(2) AS r(k) WHERE nth > 1 EXCEPT SELECT doc_id, text, i - k FROM p, range(2) AS r(k) WHERE nth = 1 AND times > 1),
m AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.i = g.i)
SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_md5,
       sum(len(string_split(line, chr(10))))::BIGINT AS n_lines, coalesce(sum(len(string_split(line, chr(10)))) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines
FROM m GROUP BY doc_id, text
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
