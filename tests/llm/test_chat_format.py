"""Formatted conversations against plain Python, with texts that hold the template's own strings."""

import collections
import hashlib

import numpy as np
import pytest

TRICKY = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", TRICKY), (1, 2, "assistant", "<s>" + TRICKY + "</s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 1, "assistant", r"[\INST] [\\/INST] <\s> \ \\ <\/s>"), (2, None, "user", "first: null turn"), (2, 1, "assistant", "tie"), (2, 1, "user", "tie"), (2, 1, "user", "tie"),
    (3, 5, None, "no role"), (3, 6, "tool[TEXT]x[/ROLE]", "[ROLE]a[TEXT]b[/ROLE]"), (3, 7, "[", "INST] ["), (3, 8, "assistant", "["), (3, 9, "assistant", "/s>é日本😀"), (3, 10, "", "[TEXT]"),
    (None, 0, "user", "of no conversation"), (None, 1, "assistant", "nor this"), (4, 0, "assistant", "é" * 900_000 + TRICKY), (4, 1, "assistant", "word " * 300_000), (4, 2, "user", "x"),
]
ROWS += [(9, k, ("user", "assistant")[k % 2], f"turn {k} <s>") for k in range(300)] + [(10 + k, 0, "user", "same") for k in range(60)]


def brute(rows):
    by = collections.defaultdict(list)
    for c, n, role, text in rows:
        by[c].append(((n is not None, n or 0), role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (c, len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))
    return out


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_against_plain_python(spark, batch):
    from polyview.llm.chat_format import format_conversations, read_back

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS piece", "'z' AS lead", "1 AS formatted", "2 AS loss", "3 AS open")
    pieces = format_conversations(turns)
    got, texts = read_back(pieces).collect(), collections.defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        texts[r.conv_id].append(r.formatted)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(ROWS)
    assert len(got) == len(want) and {r.conv_id: tuple(r)[:5] for r in got} == want
    assert {r.conv_id: r.formatted_chars for r in got} == {c: sum(map(len, t)) for c, t in texts.items()}
    assert "".join(texts[1]).startswith(r"[SYS] be brief [/SYS][INST] <\/s>[\INST] ok [\/INST] [/INST]<s><\s><\/s>[\INST] ok [\/INST]<\/s></s>")
    assert read_back(format_conversations(turns.limit(0))).collect() == []


def test_scatter_strips(monkeypatch):
    from polyview.llm import chat_format as C

    rnd = np.random.default_rng(1)
    for strip in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(C, "STRIP", strip)
        length = rnd.integers(0, 40, 200)
        data = rnd.integers(0, 256, length.sum()).astype(np.uint8)
        start, to = np.cumsum(length) - length, np.cumsum(length[::-1])[::-1] - length
        out = np.zeros(len(data), np.uint8)
        C._scatter(out, to, data, start, length)
        assert bytes(out) == b"".join(bytes(data[s : s + n]) for s, n in list(zip(start, length))[::-1])


def test_torn_output_is_refused():
    from polyview.llm.chat_format import parse_turns

    assert parse_turns("[INST] a [/INST]<s>b</s>") == [("user", "a"), ("assistant", "b")]
    for torn in ("[INST] a", "x<s>b</s>", "<s>b</s> "):
        with pytest.raises(ValueError):
            parse_turns(torn)
