"""Fill-in-middle transformation over code points by succinct rank and select (operator 11).

The texts of an Arrow batch lie in one buffer.  A bit for each byte says whether a code point begins there; the bits are packed,
and a directory holds how many are set before each block of 64 bytes.  ``rank`` of a text's two borders gives its
number of code points n, and ``select`` on the ranks of the two cuts gives the bytes where its parts end, so no text is
decoded.  Memory follows the batch (Spark bounds its bytes) or the longest text.

A null text counts as empty; a null id has the digits of the empty string.  Texts that hold a marker are left plain, as are
empty ones, so an output can be read back without its input.  Rows with the same id get the same cuts for the same text.  Other
columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are cut at all, and of these of the ones whose suffix comes first.
CUT_PERCENT, SPM_PERCENT = 90, 20
BLOCK = 64
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class CodePoints:
    """Rank and select over the code point starts of a UTF-8 buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        ones = _POPCOUNT[np.pad(self.bits, (0, -len(self.bits) % (BLOCK // 8)))].reshape(-1, BLOCK // 8)
        self.directory = np.concatenate([[0], np.cumsum(ones.sum(axis=1, dtype=np.int64))])
        self.size = len(data)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each byte offset."""
        block = at // BLOCK
        out = self.directory[block]
        for k in range(BLOCK // 8):  # the bytes of bits before the offset's own, then its own up to the offset
            byte = block * (BLOCK // 8) + k
            left = np.clip(at - byte * 8, 0, 8)
            mine = np.flatnonzero(left)
            out[mine] += _POPCOUNT[self.bits[byte[mine]] & ((1 << left[mine]) - 1).astype(np.uint8)]
        return out

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte offset of the code point with each rank; the end of the buffer for the rank after the last."""
        block = np.searchsorted(self.directory, nth, side="right") - 1
        out = np.full(len(nth), self.size, np.int64)
        inside = np.flatnonzero(nth < self.directory[-1])
        block, left = block[inside], nth[inside] - self.directory[block[inside]]
        byte = block * (BLOCK // 8)
        for _ in range(BLOCK // 8 - 1):
            ones = _POPCOUNT[self.bits[np.minimum(byte, len(self.bits) - 1)]]
            step = left >= ones
            step &= byte < (block + 1) * (BLOCK // 8) - 1
            left, byte = left - step * ones, byte + step
        ahead = np.cumsum(np.unpackbits(self.bits[byte][:, None], axis=1, bitorder="little"), axis=1, dtype=np.int64)
        out[inside] = byte * 8 + (ahead <= left[:, None]).sum(axis=1)
        return out


def _draws(doc_id: Column, salt: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begin = offsets[:-1] - offsets[0]
        points = CodePoints(data)
        before = points.rank(offsets - offsets[0])
        n = np.diff(before)
        first, second = (batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
        a, b = np.minimum(first, second), np.maximum(first, second)
        one, two = points.select(before[:-1] + a), points.select(before[:-1] + b)
        # the rank after a text's last code point is the next text's first, wherever empty texts lie between
        end = offsets[1:] - offsets[0]
        one, two = np.minimum(one, end), np.minimum(two, end)
        form = batch.column("form").to_pylist()
        whole, out = memoryview(data), []
        for kind, w, x, y, z in zip(form, begin.tolist(), one.tolist(), two.tolist(), end.tolist()):
            if kind == "plain":
                out.append(bytes(whole[w:z]))
            elif kind == "psm":
                out.append(b"".join((marks[0], whole[w:x], marks[1], whole[y:z], marks[2], whole[x:y])))
            else:
                out.append(b"".join((marks[1], whole[y:z], marks[0], whole[w:x], marks[2], whole[x:y])))
        plain = pc.equal(batch.column("form"), "plain").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), batch.column("form"), pa.array(a, mask=plain), pa.array(b - a, mask=plain), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1") -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every text.

    The draws come from the SHA-256 of ``salt``, a colon and the id: two cuts, whether to cut, and the order of the parts.
    """
    h1, h2, h3, h4 = _draws(F.col(id_col).cast("long"), salt)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when(held | (h3 % 100 >= CUT_PERCENT), "plain").when(h4 % 100 < SPM_PERCENT, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    return rows.mapInArrow(_assemble, _SCHEMA)


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made of: markers stand nowhere in its parts, and no part can complete one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: The same in SQL.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""
