"""The language-model operators against brute force on a small awkward table."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{i % 97}x{i}" for i in range(3000))
PASSAGE = "The quick brown fox jumps over the lazy dog while seventeen grey geese fly south for the winter season. " * 3
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (6, LONG), (7, LONG + " tail"), (8, PASSAGE + "alpha beta"),
    (9, "gamma " + PASSAGE), (10, "a" * 700), (11, "line one\nline two\nline three\nline four\nline five\nline six"),
    (12, "intro\nline one\nline two\nline three\nline four\nline five\nline six\nend"), (13, "mail a.b1@mail3.example.com and 10.20.30.40 and a.b1@mail3.example.com, +1 (555) 555-1234"),
    (14, "card 4111111111111111 password=abc123def456 Mrs. Anna Bell 日本語 <|endoftext|>"), (15, "x  y \n\n z's 123"), (15, "x  y \n\n z's 123"), (None, "no id here at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), t) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, row string")


def test_quality_measures(docs):
    from polyview.llm.quality import score_quality

    got = {(r.doc_id, r.text): r for r in score_quality(docs).collect()}
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        r = got[i, t]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_em_learns_rules():
    from polyview.llm.quality import fit_accuracies, posterior

    prior, chance = fit_accuracies([((1, 1, 1), 900), ((0, 1, 1), 50), ((1, 0, None), 30), ((0, 0, 1), 20)])
    assert posterior((1, 1, 1), prior, chance) > 0.9 > 0.5 > posterior((0, 0, 1), prior, chance)


def test_line_chunks(docs):
    from polyview.llm.line_dedup import remove_repeated_chunks

    out = remove_repeated_chunks(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(out.collect()) == len(ROWS) and rows[11].n_removed_lines == 0
    assert rows[12].text.startswith("intro") and rows[12].n_lines == 8
    assert rows[1].text is None


def test_passages_inside_other_texts_go_whole(spark):
    """Repeated passages of 2 to 12 lines between lines of their own, against all repeated pairs of lines."""
    import random

    from polyview.llm.line_dedup import TARGET, remove_repeated_chunks

    rnd = random.Random(5)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    shared = [[line(rnd.choice([2, 9, 25])) for _ in range(rnd.randrange(2, 13))] + [line(25), line(12)] for _ in range(20)]
    texts = [[x for p in rnd.sample(shared, 3) for x in [line(9) for _ in range(rnd.randrange(1, 4))] + p] + [line(5)] for _ in range(60)]
    got = {r.doc_id: r.text for r in remove_repeated_chunks(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    seen, want, times = set(), {}, collections.Counter(p for t in texts for p in zip(t, t[1:]))
    for i, t in enumerate(texts):
        gone = {j for k in range(1, len(t)) if (t[k - 1], t[k]) in seen for j in (k - 1, k)}
        stay = {j for k in range(1, len(t)) if (t[k - 1], t[k]) not in seen and times[t[k - 1], t[k]] > 1 for j in (k - 1, k)}
        gone, seen = gone - stay, seen | set(zip(t, t[1:]))
        want[i] = "\n".join(x for j, x in enumerate(t) if j not in gone)
    assert 2 * TARGET < len(line(25) + line(12)) and got == want


def test_lines_with_empty_lines_and_repeats(spark):
    from polyview.llm.line_dedup import remove_repeated_chunks

    p, q = "first paragraph " * 9, "second paragraph " * 9
    rows = [(1, f"{p}\n\n{q}\n\nown a"), (2, f"own b\n\n{p}\n\n{q}\n\nown c"), (3, f"{p}\nalone"), (4, "\n\n\n"), (5, "\n\n\n"), (6, f"{q}\n{q}\n{q}")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in remove_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 5, 0), 2: ("own b\n\nown c", 7, 4), 3: (rows[2][1], 2, 0), 4: ("\n\n\n", 4, 0), 5: ("\n\n\n", 4, 0), 6: (f"{q}\n{q}", 3, 1)}


def test_a_removed_pair_stands_whole_somewhere(spark):
    """A B / A B C / B C, rings of lines, and random texts of few lines: no pair of lines that was removed is lost."""
    import random

    from polyview.llm.line_dedup import remove_repeated_chunks

    a, b, c = (f"line {x} " * 10 for x in "abc")
    got = {r.doc_id: r.text for r in remove_repeated_chunks(spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}"), (3, f"{b}\n{c}")], "doc_id long, text string")).collect()}
    assert got == {1: f"{a}\n{b}", 2: f"{b}\n{c}", 3: ""}
    rnd = random.Random(9)
    lines = [f"line {k} " * rnd.choice([1, 9, 30]) for k in range(9)]
    texts = [[rnd.choice(lines) for _ in range(rnd.randrange(2, 12))] for _ in range(120)] + [[lines[(k + j) % 9] for j in range(3)] for k in range(9)]
    out = [r.text.split("\n") for r in remove_repeated_chunks(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()]
    assert sum(map(len, out)) < sum(map(len, texts)) / 3
    assert {p for t in texts for p in zip(t, t[1:])} == {p for t in out for p in zip(t, t[1:])} & {p for t in texts for p in zip(t, t[1:])}


def test_line_chunks_with_clashing_hashes(docs, monkeypatch):
    """Chunks that differ but share a hash are told apart by their bytes."""
    from polyview.llm import line_dedup as L

    more = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 100))
    want = sorted(map(str, L.remove_repeated_chunks(more).collect()))
    assert any("n_removed_lines=0" not in r for r in want)
    real = L.F.xxhash64
    monkeypatch.setattr(L.F, "xxhash64", lambda *a: real(*a) if len(a) > 1 else real(*a) % 2)
    assert sorted(map(str, L.remove_repeated_chunks(more).collect())) == want


def test_token_ids_round_trip(docs):
    from tokenizers import Tokenizer

    from polyview.llm.simple8b import decode, encode, read_token_ids, write_token_ids

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_ids(write_token_ids(docs, path)).collect())
    want = collections.Counter()
    for i, text in ROWS:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert got == want
    big = np.array([2**63 + 5, 0, 2**64 - 1, 16, 2**60, 1, *[0] * 2000], np.uint64)
    words, blocks = encode(big)
    assert (decode(words, len(big), blocks) == big).all()


def test_repeats_against_brute_force(docs):
    from polyview.llm import substring_dedup as S

    texts = [(t or "").encode() for _, t in ROWS]
    count = collections.Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = []
    for (i, _), t in zip(ROWS, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        want.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    for hot in (4096, 0):  # the second way through digests as well
        S._HOT = hot
        got = [tuple(r)[:5] for r in S.remove_repeats(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    S._HOT = 4096


def test_surrogates(docs):
    from polyview.llm.surrogates import replace_entities

    rows = {(r.doc_id, r.row): r for r in replace_entities(docs, "k").collect()}
    mail = rows[13, ROWS[12][1]].text
    found = re.findall(r"[\w.]+@[\w.]+", mail)
    assert len(set(found)) == 1 and "a.b1@mail3" not in mail and "10.20.30.40" not in mail and "555-1234" not in mail
    card = rows[14, ROWS[13][1]].text
    assert "4111111111111111" not in card and "abc123def456" not in card and "Mrs." in card and "Anna" not in card and "日本語" in card
    assert all(r.text == r.row for (i, _), r in rows.items() if i not in (13, 14))


def test_bpe_equals_tiktoken(docs):
    import tiktoken

    from polyview.llm.bpe_transducer import StreamDecoder, codec, encode_decode

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tk = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted([(r.doc_id, tuple(r.ids), r.decoded) for r in encode_decode(docs, path, P.PATTERN).collect()], key=str)
    assert got == sorted([(i, tuple(tk.encode_ordinary(t or "")), t or "") for i, t in ROWS], key=str)
    c = codec(path, P.PATTERN)
    for text in ("ab" * 9000, "a" * 9001, "日本" * 4000):
        ids = c.encode(text)
        assert ids == tk.encode_ordinary(text)
        d = StreamDecoder(c.transducer.tokens)
        assert "".join(d.feed([i]) for i in ids) + d.end() == text


def test_near_duplicates(docs):
    from polyview.llm.near_dedup import near_duplicates

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs.filter("doc_id <> 15")).collect()}
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert got[6][1] == 6 and got[7][1:] == (6, False) and got[9][1] == 8  # 20 of 23 shingles


def test_long_words_leave_other_hashes_alone(spark):
    from polyview.llm import near_dedup as N

    def plain(word):
        h = 0
        for c in word.lower():
            h = (h * int(N._ODD) + int(N._BYTES[c])) % 2**64
        return N._mix(np.array([h + len(word)], np.uint64))[0]

    words = [b"a", b"Bc", b"x" * 64, b"y" * 65, bytes(range(33, 133)), b"end"]
    assert N.word_hashes(np.frombuffer(b" ".join(words), np.uint8)).tolist() == [plain(w) for w in words]
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text + " " + "u" * 100), (3, text.replace("w0", "v" * 100)), (4, " ".join(f"z{i}" for i in range(200)))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    import corpus_pipeline

    def similarity(a, b):
        a, b = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    text = " ".join(f"w{i}" for i in range(200))
    near, far = (" ".join("x" if i % step == 9 else f"w{i}" for i in range(200)) for step in (50, 30))
    assert 0.8 <= similarity(text, near) < 0.85 and max(similarity(text, far), similarity(near, far)) < 0.8
    docs = spark.createDataFrame([(1, text), (2, near), (3, far)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_near_duplicates_against_brute_force(spark):
    """Chains, a hot group of near copies and unlike texts, at both thresholds in use, against all pairs on full sets."""
    from polyview.llm.near_dedup import near_duplicates

    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 120)] for _ in range(12)]
    texts = [" ".join(rng.integers(0, 300, 60).astype(str)) for _ in range(60)]
    for k, words in enumerate(base):
        for _ in range(40 if k == 0 else 8):
            words = list(words) if k else list(base[0])  # the first group stays near its source, the others drift in chains
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                words[at] = f"z{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    texts += texts[60:70]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    grams = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    for percent, tables in ((85, 14), (80, 20)):
        root = {i: i for i in grams}
        for _ in grams:  # smallest ids spread along links until nothing changes
            new = {i: min([root[i]] + [root[j] for j in grams if 100 * len(grams[i] & grams[j]) >= percent * len(grams[i] | grams[j])]) for i in grams}
            if new == root:
                break
            root = new
        got = {r.doc_id: r.component_id for r in near_duplicates(table, percent=percent, tables=tables).collect()}
        assert got == root and 1 < len(set(root.values())) < len(root)


def test_inner_products(spark):
    from polyview.llm.inner_product import top_products

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12))
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [float("nan")] * 12), (1000, [None] * 12)]
    got = sorted(map(tuple, top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 50 = 0").collect()))
    v = np.floor(x * 256).astype(int)
    want = [(q, k + 1, int(c), int(v[q] @ v[c])) for q in range(0, 400, 50) for k, c in enumerate(sorted((c for c in range(400) if c != q), key=lambda c: (-int(v[q] @ v[c]), c))[:5])]
    assert got == sorted(want)


def test_inner_products_over_levels(spark):
    """Many parts and levels: lengths from 0 to 3 digits, a hot vector, ties, two vector sizes."""
    from polyview.llm.inner_product import top_products

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)) * 10 ** rng.uniform(-2, 1, size=(600, 1))
    x[200:400] = x[200]
    rows = [(i, v.tolist() if i % 7 else v[:5].tolist()) for i, v in enumerate(x)] + [(600 + i, [0.0] * 8) for i in range(60)]
    got = sorted(map(tuple, top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 50 = 0", part_rows=40).collect()))
    v = {i: np.floor(np.array(w) * 256).astype(int) for i, w in rows}
    want = []
    for q in range(0, 660, 50):
        others = [c for c in v if c != q and len(v[c]) == len(v[q])]
        want += [(q, k + 1, c, int(v[q] @ v[c])) for k, c in enumerate(sorted(others, key=lambda c: (-int(v[q] @ v[c]), c))[:5])]
    assert got == sorted(want)


def test_packing(docs):
    from polyview.llm.packing import best_fit_decreasing, dual_feasible_bound, pack_documents

    rows = pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.array([r.length for r in rows])
    assert len(by) >= dual_feasible_bound(lengths, 1024) and len(by) <= best_fit_decreasing(lengths, 1024)[2] + 1


def test_pages(spark):
    from polyview.llm.page_text import main_text, shared_lines

    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one<br>two <b>x</b><p>three</article><div class='comments'><article>me too</article></div><footer>f</footer>"
    bare = "<body><div>Site name</div><div>own {0} words</div><div>Imprint</div></body>"
    rows = [(1, "http://a.com/x/1", page), (2, "http://a.com/x/2", bare.format(1)), (3, "http://a.com/x/3", bare.format(2)), (4, None, None), (5, "http://b.com/", "")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B\n\none two x\n\nthree", 2: "own 1 words", 3: "own 2 words", 4: "", 5: ""}
    assert shared_lines([1, 2, 3], [1, 3]) == [True, False, True]


def test_empty_tables(spark):
    from polyview.llm.line_dedup import remove_repeated_chunks
    from polyview.llm.near_dedup import near_duplicates
    from polyview.llm.packing import pack_documents
    from polyview.llm.quality import score_quality
    from polyview.llm.simple8b import read_token_ids, write_token_ids
    from polyview.llm.substring_dedup import remove_repeats
    from polyview.llm.surrogates import replace_entities

    none = spark.createDataFrame([], "doc_id long, text string")
    path = P.path("byte_bpe_50k.json")
    for f in (score_quality, remove_repeated_chunks, near_duplicates, remove_repeats, lambda d: replace_entities(d, "k"), lambda d: pack_documents(d, path), lambda d: read_token_ids(write_token_ids(d, path))):
        assert f(none).count() == 0
