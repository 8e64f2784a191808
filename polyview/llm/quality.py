"""Weak supervision for document quality, in DataFrame functions only (operator 1).

Each rule votes good (1) or bad (0) or abstains (null).  The votes of all documents are counted by pattern (at most
3**rules rows, whatever the corpus); expectation-maximisation on those counts estimates each rule's accuracy on
good and on bad documents and the share of good ones, and each document gets the posterior probability
of being good.  ``kept`` takes the place of an all-must-pass filter: posterior >= 0.5, and no base failure.

Null text has no words and fails the base rule.  Rows are scored one by one: repeated rows, null ids and other columns make no
difference; columns named as the results are replaced, and no other name is reserved.  A repeated 8-word window is found by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.shared import stage_table

#: Frequent short words of the four languages.
STOP_WORDS = ["the", "of", "and", "de", "la", "le", "que", "der", "die", "und", "el", "los"]
_SPACES = " \t\n\x0b\x0c\r"
_GAP = "[\\x20\\x09-\\x0D]+"


def _without(text: Column, parts: list[str]) -> Column:
    for p in parts:
        text = F.replace(text, F.lit(p), F.lit(""))
    return text


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the contract's counts, and the measures that the rules look at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_text", text)
    trimmed = F.btrim("_text", F.lit(_SPACES))
    df = df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP)))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    hashes = F.when(F.col("n_words") >= 8, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 7), lambda i: F.xxhash64(F.slice("_words", i, 8)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    df = df.select("*", hashes.alias("_windows"), lines.alias("_lines"))
    # windows in hash order; one with an equal neighbour is repeated; its words count once however windows overlap
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("_o"))
    after = F.concat(F.slice("_o", 2, F.size("_o")), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    flagged = F.zip_with(F.zip_with("_o", F.slice(before, 1, F.size("_o")), lambda a, b: F.struct(a.i.alias("i"), a.h.alias("h"), F.coalesce(a.h == b.h, F.lit(False)).alias("eq"))), after, lambda a, b: F.struct(a.i.alias("i"), (a.eq | F.coalesce(a.h == b.h, F.lit(False))).alias("eq")))
    places = F.array_sort(F.transform(F.filter(flagged, lambda x: x.eq), lambda x: x.i))
    covered = F.aggregate(F.zip_with("_p", F.concat(F.slice("_p", 2, F.size("_p")), F.array(F.lit(1 << 30))), lambda a, b: F.least(b - a, F.lit(8))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    has_repeat = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_o", F.when(has_repeat, ordered)).withColumn("_p", F.when(F.col("_o").isNotNull(), places))
    symbols = F.length("_text") - F.length(_without(F.col("_text"), list("#*$%&|<>")))
    solid = _without(F.col("_text"), list(_SPACES))
    lower = F.concat(F.lit(" "), F.lower("_text"), F.lit(" "))
    stops = sum(((F.length("_low") - F.length(F.replace("_low", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in STOP_WORDS), F.lit(0.0))
    df = df.withColumn("_low", lower)
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.length(solid).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_p").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).alias("_n_bangs"),
        F.length(F.regexp_replace("_text", "[^\\p{Lu}]+", "")).alias("_n_upper"),
        stops.alias("_n_stops"),
    )


def votes() -> dict[str, Column]:
    """The rules on the measures; null abstains."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    return {
        "symbols": rule(F.col("n_symbols") > 0.2 * n, F.col("n_symbols") <= 0.02 * n),
        "upper": rule(F.col("_n_upper") > 0.3 * chars, F.col("_n_upper") < 0.12 * chars),
        "bangs": rule(F.col("_n_bangs") > 0.2 * n, F.col("_n_bangs") < 0.05 * n),
        "word_length": rule((chars < 2.5 * n) | (chars > 12 * n), (chars >= 3 * n) & (chars <= 9 * n)),
        "dup_lines": rule(F.col("n_dup_lines") > 0.3 * F.col("_n_lines"), F.col("n_dup_lines") <= 0.1 * F.col("_n_lines")),
        "repeats": rule(F.col("n_repeat_words") > 0.2 * n, F.col("n_repeat_words") <= 0.05 * n),
        "stop_words": rule(F.col("_n_stops") < 0.02 * n, F.col("_n_stops") > 0.06 * n),
    }


def fit_accuracies(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 100, prior: float = 0.85) -> tuple[float, list[tuple[float, float]]]:
    """EM on (votes, count): share of good documents, and each rule's chance to vote good on good and on bad ones.

    Starts from rules that pass nearly all good documents and, each seeing its own kind of fault, seven of ten bad ones; smoothed
    counts keep chances inside (0, 1).
    """
    rules = len(patterns[0][0]) if patterns else 0
    chance = [(0.998, 0.7)] * rules
    for _ in range(rounds):
        good_n = bad_n = 0.0
        seen = [[1.996, 2.0, 1.4, 2.0] for _ in range(rules)]  # good votes and votes on good ones, the same on bad ones
        for vote, n in patterns:
            p = posterior(vote, prior, chance)
            good_n, bad_n = good_n + n * p, bad_n + n * (1 - p)
            for r, v in enumerate(vote):
                if v is not None:
                    s = seen[r]
                    s[0], s[1], s[2], s[3] = s[0] + n * p * v, s[1] + n * p, s[2] + n * (1 - p) * v, s[3] + n * (1 - p)
        prior = (good_n + 1) / (good_n + bad_n + 2)
        chance = [(s[0] / s[1], s[2] / s[3]) for s in seen]
    return prior, chance


def posterior(vote: tuple[int | None, ...], prior: float, chance: list[tuple[float, float]]) -> float:
    score = math.log(prior / (1 - prior)) + sum(math.log(g / b) if v else math.log((1 - g) / (1 - b)) for v, (g, b) in zip(vote, chance) if v is not None)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, score))))


def score_quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of the input with the measures, base_failed, posterior and kept."""
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*measures, "base_failed", "posterior", "kept")]
    # input columns travel in one struct, so that no name of theirs meets one used here
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    measured = base_measures(boxed).drop("text")
    rules = votes()
    names = [f"v_{k}" for k in rules]
    voted = stage_table(measured.withColumns(dict(zip(names, rules.values()))), "quality")
    counted = voted.groupBy(*names).count().collect()  # one row a pattern
    prior, chance = fit_accuracies([(tuple(r[k] for k in names), r["count"]) for r in counted])
    score = F.lit(math.log(prior / (1 - prior)))
    for k, (g, b) in zip(names, chance):
        score = score + F.when(F.col(k) == 1, math.log(g / b)).when(F.col(k) == 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-score))})
    return out.select(*[F.col("doc").getField(c).alias(c) for c in keep], *measures, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))
