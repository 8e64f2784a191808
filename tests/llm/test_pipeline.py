"""The whole pipeline against plain Python, stage by stage and at once, on a table with nulls, blanks, repeats, near copies, passages and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "kept gone lines posterior component n_entities sig row id n_words keys sequence_id".split()
VOCABULARY = "the of and to in is that for with on river stone lantern harbour copper meadow winter orchard signal marble thunder velvet compass garden whisper".split()


def documents():
    rnd = random.Random(12)
    line = lambda n=14: " ".join(rnd.choice(VOCABULARY) + rnd.choice(["", "s", "ed", "er"]) for _ in range(n))
    passage, other = [line() for _ in range(4)], [line() for _ in range(3)]
    texts = ["\n".join(line() for _ in range(rnd.randrange(4, 9))) for _ in range(30)]
    texts += ["\n".join([line(), *passage, line(), line(), line()]) for _ in range(5)] + ["\n".join([line(), line(), line(), *other, line()]) for _ in range(3)]
    words = " ".join(line() for _ in range(15)).split()
    texts += [" ".join(f"changed{k}" if i == 7 + 40 * k else w for i, w in enumerate(words)) for k in range(4)]  # near copies
    texts += [texts[0], texts[0], texts[1] + "\n" + line()]
    texts += [f"{line()}\n{line()}\nwrite to anna.bell{k}@mail.example.com or call +1 (555) 200-{k % 2}123 and {line()}\n{line()}" for k in range(4)]
    texts += [None, "", "  \n\t ", "too short", "# $ % & ! ! ! # # " * 20, "THE NAME OF A THING IN CAPITALS ALL THE TIME HERE " * 8, "again and again and once more again the same words " * 30, None]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[2] + "\n" + line(), "en", "s", 9)]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def kept_by_rules(rows):
    from polyview.llm.quality import STOP_WORDS, fit_accuracies, posterior

    vote = lambda bad, good: 0 if bad else 1 if good else None
    votes, failed = [], []
    for _, t, *_ in rows:
        t = t or ""
        w = split(t)
        n, chars = max(len(w), 1), max(sum(map(len, w)), 1)
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeats = len({j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
        lines = [x for x in t.split("\n") if split(x)]
        dup, symbols, bangs = len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t), t.count("!")
        upper = sum(c.isupper() for c in t)
        stops = sum(f" {t.lower()} ".count(f" {s} ") for s in STOP_WORDS)
        votes.append((vote(symbols > 0.2 * n, symbols <= 0.02 * n), vote(upper > 0.3 * chars, upper < 0.12 * chars), vote(bangs > 0.2 * n, bangs < 0.05 * n), vote(chars < 2.5 * n or chars > 12 * n, 3 * n <= chars <= 9 * n), vote(dup > 0.3 * len(lines), dup <= 0.1 * len(lines)), vote(repeats > 0.2 * n, repeats <= 0.05 * n), vote(stops < 0.02 * n, stops > 0.06 * n)))
        failed.append(len(w) < 20 or 100 * repeats > 30 * len(w))
    prior, chance = fit_accuracies(list(collections.Counter(votes).items()))
    return [r for r, v, f in zip(rows, votes, failed) if not f and posterior(v, prior, chance) >= 0.5]


def without_repeated_lines(rows):
    """Every pair of neighbouring lines that repeats goes, but at its first place, whose lines stay; equal rows are one document."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1]): r[:2] for r in rows}.items())
    places = collections.defaultdict(list)
    for key, (_, t) in order:
        lines = t.split("\n")
        for k in range(1, len(lines)):
            places[lines[k - 1], lines[k]].append((key, k))
    gone, stay = collections.defaultdict(set), collections.defaultdict(set)
    for found in places.values():
        for n, (key, k) in enumerate(found if len(found) > 1 else []):
            (gone if n else stay)[key] |= {k - 1, k}
    out = []
    for r in rows:
        key = (r[0] is not None, r[0] or 0, r[1])
        lost = gone[key] - stay[key]
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in lost)
        out.append((r[0], text, *r[2:4], len(text) if lost else r[4]))
    return out


def one_of_each_group(rows):
    shingles = []
    for r in rows:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]))
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                group[y] = x
    return [r for r in rows if r[0] is None or root(r[0]) == r[0]]


def plain(df):
    return sorted(map(repr, (tuple(r)[:5] for r in df.collect())))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    extra = [f"'{c}' AS `{c}`" for c in EXTRA]
    spark.createDataFrame(documents(), SCHEMA).selectExpr("*", *extra).write.parquet(f"{path}/documents.parquet")
    return path


def test_every_stage_and_the_whole(spark, folder):
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, got = documents(), docs
    names = dict(C.STAGES)
    for name, brute in (("quality", kept_by_rules), ("line_dedup", without_repeated_lines), ("near_dedup", one_of_each_group)):
        got, want = names[name](spark, got, folder), brute(want)
        assert got.columns == docs.columns and plain(got) == sorted(map(repr, want)), name
    assert 30 < len(want) < len(documents()) - 10 and sum(len(r[1] or "") for r in want) < sum(len(r[1] or "") for r in documents()) * 0.8
    clean = names["surrogates"](spark, got, folder)
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    rows = dict(texts)  # equal rows have equal results
    assert clean.columns == docs.columns and collections.Counter(i for i, _ in texts) == collections.Counter(r[0] for r in want) and set(texts) == set(rows.items())
    phones = collections.defaultdict(set)
    for i, t, *_ in want:
        found = re.search(r"anna\.bell(\d)@mail\.example\.com or call (\+1 \(555\) 200-\d{4})", t)
        if not found:
            assert rows[i] == t
        else:
            new = re.fullmatch(re.escape(t[: found.start()]) + r"([a-z.]+\d)@(\w+\.example) or call (\+1 \(\d{3}\) \d{3}-\d{4})" + re.escape(t[found.end() :]), rows[i])
            assert new and new[1] != f"anna.bell{found[1]}" and new[3] != found[2]
            phones[found[2]].add(new[3])
    assert len(phones) == 2 and all(len(p) == 1 for p in phones.values()) and len(set.union(*phones.values())) == 2
    pieces = names["packing"](spark, clean, folder).collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expect = []
    for i, t in texts:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert len(ids) <= 1024
        expect.append((i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in pieces))) == sorted(map(repr, expect))
    whole = C.run(spark, folder).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in whole))) == sorted(map(repr, expect))
    by = collections.defaultdict(list)
    for r in whole:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 1024 and [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in by.values())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_tables_with_nothing_to_keep(spark, tmp_path, rows):
    import corpus_pipeline as C

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_starts_of_token_ids(spark):
    """Operator 3: a document starts where all ids of the documents before it end."""
    from tokenizers import Tokenizer

    from polyview.llm.simple8b import read_token_ids, write_token_ids

    rows = [(i * 3, t) for i, (_, t, *_) in enumerate(documents())]
    random.Random(1).shuffle(rows)
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: (r.start, r.n_tokens) for r in read_token_ids(write_token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path)).collect()}
    want, at = {}, 0
    for i, text in sorted(rows):
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want[i], at = (at, n), at + n
    assert got == want
