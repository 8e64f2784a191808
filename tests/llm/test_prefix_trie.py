"""The prefix trie against a plain trie, on awkward conversations, deep ones and paths that branch at every turn."""

import collections
import hashlib
import random
import zlib

import pytest

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    by = collections.defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            by[c].append(((n is not None, n or 0), digest, (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(t)] for c, t in by.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def brute(convs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest))
    return collections.Counter(out)


def run(spark, rows):
    from polyview.llm.prefix_trie import number_turns, prefix_trie, rebuild

    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'z' AS `{c}`" for c in "depth a b part n inside digest bytes pos h head length block own path salt before piece ids".split()])
    return collections.Counter(tuple(r) for r in prefix_trie(*rebuild(number_turns(turns))).collect())


AWKWARD = [(0, None, None, None), (0, None, None, None), (0, 3, "user", "é日本"), (1, 0, "", ""), (2, 0, "ab", "c"), (3, 0, "a", "bc"), (None, 0, "user", "no conversation"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (7, 1, "user", "tie"), (-3, 0, "user", "x"), (-5, 0, "user", "x"), (2**63 - 1, 0, "user", "last")]
AWKWARD += [(c, t, "user", f"same {t}") for c in range(40, 60) for t in range(6)] + [(c, t, "user", f"own {t % 2 * c}") for c in range(60, 90) for t in range(c % 11)]


def deep():
    """A long conversation, one that leaves it at every turn, and nested ones with rising ids."""
    rows = [(100, t, "user", f"t{t}") for t in range(60)]
    for k in range(1, 30):
        rows += [(100 + 5 * k, t, "user", f"t{t}" if t < k else f"{k} {t}") for t in range(k + 3)]
    return rows + [(1000 + 5 * k, t, "user", f"n{t}") for k in range(20) for t in range(k + 1)]


@pytest.mark.parametrize("block", [4, 4096])
def test_against_a_plain_trie(spark, monkeypatch, block):
    from polyview.llm import prefix_trie as T

    monkeypatch.setattr(T, "BLOCK", block)
    rnd = random.Random(2)
    mixed = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice("ab")) for c in range(150) for t in range(rnd.randrange(1, 14))]
    for rows in (AWKWARD, deep(), mixed):
        assert run(spark, rows) == brute(rebuilt(rows))


def test_small_batches_and_no_rows(spark):
    from polyview.llm.prefix_trie import number_turns, prefix_trie, rebuild

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    rows = [(c, 0, "user", "hot") for c in range(300)] + AWKWARD
    got = run(spark, rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rebuilt(rows))
    assert prefix_trie(*rebuild(number_turns(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)))).collect() == []
