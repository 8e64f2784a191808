"""Distinctness, coreference and format of surrogates against plain Python, also where formats are nearly full, and full."""

import random
import re

import pytest


def luhn(card):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(card))) % 10 == 0


def number(rnd, kind):
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = "4" + d(14)
        return body + next(c for c in "0123456789" if luhn(body + c))
    if kind == "ssn":
        return f"{rnd.randrange(1, 9)}{d(2)}-{d(2)}-{d(4)}"
    if kind == "phone":
        return f"+1 {rnd.randrange(2, 10)}{d(2)} {rnd.randrange(2, 10)}{d(2)} {d(4)}"
    if kind == "ip":
        return ".".join(str(rnd.randrange(1, 255)) for _ in range(4))
    body = d(18)
    rest = int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    return f"DE{98 - rest:02d}{body}"


KINDS = {"card": r"4\d{15}", "ssn": r"9\d\d-\d\d-\d{4}", "phone": r"\+1 \d{3} \d{3} \d{4}", "ip": r"\d+\.\d+\.\d+\.\d+", "iban": r"DE\d{20}"}


def test_every_number_keeps_its_format_and_stands_alone(spark):
    """Against a plain check of all pairs: one surrogate for one entity, in every place; none shared, none real; check digits hold."""
    from polyview.llm.surrogates import replace_entities

    rnd = random.Random(8)
    values = {k: sorted({number(rnd, k) for _ in range(150)}) for k in KINDS}
    texts = [(f"{k}|{v}", k, v) for k, vs in values.items() for v in vs for _ in range(2)]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(i, f"see {v} now") for i, (_, _, v) in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in replace_entities(docs, "k").collect():
        _, kind, value = texts[r.doc_id]
        new = re.fullmatch("see (.*) now", r.text)[1]
        assert r.n_entities == 1 and re.fullmatch(KINDS[kind], new), (kind, value, new)
        assert found.setdefault((kind, value), new) == new
    assert len(found) == sum(map(len, values.values())) and len(set(found.values())) == len(found)
    assert not set(found.values()) & {v for vs in values.values() for v in vs}
    assert all(luhn(n) for (k, _), n in found.items() if k == "card")
    assert all(int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1 for (k, _), n in found.items() if k == "iban")


def test_a_format_that_is_nearly_full(spark):
    """Secrets of one scope: 676 forms of two letters, of which 600 are taken; the rest are all found, in the same format."""
    from polyview.llm.surrogates import unit_surrogates

    rnd = random.Random(3)
    forms = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    real = rnd.sample(forms, 338)
    rows = unit_surrogates(spark.createDataFrame([("secret", "", v) for v in real], "kind string, scope string, canon string"), "k").collect()
    assert {r.canon for r in rows} == set(real) and {r.s for r in rows} == set(forms) - set(real)


def test_a_full_format_is_an_error(spark, monkeypatch):
    from polyview.llm import surrogates as S

    monkeypatch.setattr(S, "MOST_DRAWS", 64)
    rows = [("secret", "", c) for c in "abcdefghijklmnopqrstu"]
    with pytest.raises(ValueError, match="formats: secret$"):
        S.unit_surrogates(spark.createDataFrame(rows, "kind string, scope string, canon string"), "k")


def test_the_session_key(spark):
    from polyview.llm.queries import surrogate_key

    assert len(surrogate_key(spark)) == 64 and surrogate_key(spark) == surrogate_key(spark)
    spark.conf.set("spark.polyview.surrogateKey", "mine")
    assert surrogate_key(spark) == "mine"
    spark.conf.unset("spark.polyview.surrogateKey")
