"""Keyed surrogates for personal data and secrets, in DataFrame functions only (operator 5).

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers that pass the Luhn test, access
keys, password= and token= values, IBANs, US social security numbers, and names after a title.

An entity is known by its canonical form: addresses in lower case, telephone, card and account numbers by their digits and
letters alone, secrets without the word before them, names by given and family name without the title.  So
one entity has one surrogate in every spelling (coreference), and a family keeps one family name.  A surrogate hangs on the
secret key, the type and the canonical form alone.  It keeps the format of the place: separators, case, number of digits,
country codes; hexadecimal secrets stay hexadecimal, cards pass the Luhn test, IBANs have right check digits,
addresses end in the reserved ``.example``.  Names keep their script (Latin, Cyrillic, Greek) and gender,
which the title tells, or else the given name.  A full name that stands in a document once with a title is
replaced there without a title as well.

All distinct canonical forms meet in one table, where surrogates are checked against each other and against all
real forms; colliding ones are drawn again, several at a time in later rounds.  Every draw of a number or secret keeps its length, classes and check digits.
Names, domains and local parts of addresses have no fixed length: theirs grow, so there is always a free one.  Where a fixed format
has none left that ``MOST_DRAWS`` draws could find, the query fails and says of which type, rather than change the format or share a surrogate.

Every pattern takes time in proportion to the text, whatever it holds: local parts are possessive and begin only at their
first character, and all repeated groups are bounded, so no text overflows the stack.

Null and empty texts pass through, as do other columns (one named n_entities is replaced; no other name is reserved).
Repeated rows and null ids are rows of their own.  Texts without entities are neither changed nor moved.  A value that stands in
very many documents is a hot key of one join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyview.llm.shared import stage_table

#: Titles by gender.
MALE_TITLES = ["Mr", "Herr", "Señor", "Monsieur", "Signor", "Sir", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Signora", "Lady", "Госпожа", "Κυρία"]
NEUTRAL_TITLES = ["Dr", "Prof"]
#: Given names that the rule "feminine ones end in a" misjudges.
MALE_GIVEN = ["luca", "joshua", "andrea", "nikita", "ilya", "noah", "sasha", "никита", "илья", "саша"]
FEMALE_GIVEN = ["alice", "helen", "irene", "karen", "susan", "ruth", "marie", "jane", "anne", "mary", "ingrid", "astrid", "любовь"]
#: Telephone country codes of one and two digits; all others have three.
SHORT_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: By script: consonants, vowels, endings of given names (female, male), of family names, and what a woman's family name adds.
SCRIPTS = {
    "latin": ("bdfglmnrstvz", "aeiou", "a|ia|ina", "o|an|us", "er|son|ski|ez|man|sen", ""),
    "cyrillic": ("бвгдзклмнрст", "аеиоу", "а|ина|ия", "ан|ей|ор", "ов|ев|ин", "а"),
    "greek": ("βγδκλμνπρστ", "αειου", "α|ια|ινα", "ος|ης|ας", "ιδης|ακης|οπουλος", ""),
}

_SECRET_WORD = "(?i:password|passwd|pwd|secret|api_key|token)[ ]?[=:][ ]?\"?"
_TITLE = "(?:" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES, key=len, reverse=True)) + ")\\.?"
_TOKEN = "\\p{Lu}\\p{Ll}++(?:-\\p{Lu}\\p{Ll}++)?"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Type and pattern; an earlier one wins where two begin at one place.
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}+(?:\\.[A-Za-z0-9-]{1,63}+){0,8}\\.[A-Za-z]{2,63}+",
    "secret": f"(?:(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![0-9A-Z])|{_SECRET_WORD}[A-Za-z0-9_/+-]{{8,}}+\"?)",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": "\\+[0-9]{1,3} ?\\(?[0-9]{2,4}\\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9.-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?![0-9])",
    "ip": f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])",
    "name": f"(?<!\\p{{L}}){_TITLE} {_TOKEN}(?: {_TOKEN})?",
}
ENTITY = "(?:" + "|".join(PATTERNS.values()) + ")"
#: What every entity holds; a text without it is not matched further.
_SIGN = f"(?:@|[0-9][0-9]|[=:][ ]?\"?[A-Za-z0-9_/+-]{{8}}|{_TITLE} \\p{{Lu}})"

#: Draws for one canonical form before its format counts as full: a format with one form in a hundred free fails with probability 1e-35.
MOST_DRAWS = 8192

_UNIT = "array<struct<kind: string, scope: string, canon: string>>"


def entity_type(value: Column) -> Column:
    """The type of a matched value; null for a number that only looks like a card."""
    found = F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), kind) for kind, p in PATTERNS.items()], F.lit("secret"))
    return F.when((found != "card") | (_luhn(_digits(value)) % 10 == 0), found)


def _digits(value: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(value, "[^0-9]", ""), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digits."""
    return F.aggregate(F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))), F.lit(0), lambda s, d: s + d)


def _script(word: Column) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), "cyrillic").when(word.rlike("\\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column, given: Column) -> Column:
    """f or m: by the title, else by the given name."""
    bare, name = F.regexp_replace(title, "\\.$", ""), F.lower(given)
    told = F.when(bare.isin(FEMALE_TITLES), "f").when(bare.isin(MALE_TITLES), "m")
    guessed = F.when(name.isin(FEMALE_GIVEN), "f").when(name.isin(MALE_GIVEN), "m").when(name.rlike("[aаяαη]$"), "f").otherwise("m")
    return F.coalesce(told, guessed, F.lit("m"))


def describe(values: DataFrame) -> DataFrame:
    """value, kind, parts of its format and ``units``: the canonical forms that its surrogate is made of."""
    v = F.col("value")
    df = values.withColumn("kind", entity_type(v)).filter("kind is not null")
    words = F.split("value", " ")
    df = df.withColumns({
        "head": F.when(F.col("kind") == "secret", F.regexp_extract(v, f"^(?:AKIA|{_SECRET_WORD})", 0)).when(F.col("kind") == "name", F.element_at(words, 1)).otherwise(""),
        "given": F.when((F.col("kind") == "name") & (F.size(words) == 3), F.get(words, F.lit(1))),
        "family": F.when(F.col("kind") == "name", F.element_at(words, -1)),
        "local": F.when(F.col("kind") == "email", F.substring_index(v, "@", 1)),
        "domain": F.when(F.col("kind") == "email", F.substring_index(v, "@", -1)),
    })
    df = df.withColumn("gender", F.when(F.col("kind") == "name", _gender(F.col("head"), F.col("given"))))
    df = df.withColumn("body", F.when(F.col("kind") == "secret", F.regexp_replace(F.substring("value", F.length("head") + 1, F.length("value")), '"$', "")))
    bare = F.regexp_replace("value", "[^A-Za-z0-9]", "")
    # a woman's and a man's Russian family name are one family
    stem = F.regexp_replace(F.lower("family"), "(?<=ов|ев|ин)а$", "")
    unit = lambda kind, scope, canon: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), scope.alias("scope"), canon.alias("canon"))
    none = F.lit("")
    units = (
        F.when(F.col("kind") == "email", F.array(unit("email", F.lower("domain"), F.lower("local")), unit("domain", none, F.lower("domain"))))
        .when(F.col("kind") == "secret", F.array(unit("secret", none, F.col("body"))))
        .when(F.col("kind") == "iban", F.array(unit("iban", F.substring(bare, 1, 2), F.substring(bare, 5, 40))))
        .when(F.col("kind") == "phone", F.array(unit("phone", none, F.concat(F.when(v.startswith("+"), "+").otherwise(""), F.regexp_replace(v, "[^0-9]", "")))))
        .when(F.col("kind") == "name", F.concat(F.array(unit("family", _script(F.col("family")), stem)), F.when(F.col("given").isNotNull(), F.array(unit(F.concat(F.lit("given "), "gender"), _script(F.col("given")), F.lower("given")))).otherwise(F.array().cast(_UNIT))))
        .when(F.col("kind") == "ip", F.array(unit("ip", none, v)))
        .otherwise(F.array(unit(F.col("kind"), none, bare)))
    )
    return df.withColumn("units", units)


def draw(units: DataFrame, key: str) -> DataFrame:
    """Units (kind, scope, canon, turn) with their draw of that number as s: characters of the same classes, or a made-up name or domain."""
    kind, scope, canon, turn, flat, seed, same = map(F.col, ("kind", "scope", "canon", "turn", "flat", "seed", "same"))
    extra = F.least(F.lit(24), F.greatest(F.lit(0), F.expr("(turn - 4) div 2")).cast("int"))
    df = units.withColumn("flat", F.regexp_replace(canon, "[^\\p{L}0-9]", ""))
    df = df.withColumn("seed", F.sha2(F.concat(F.lit(key), F.sha2(F.concat_ws("\x1f", F.lit(key), kind, scope, turn.cast("string"), canon), 256)), 512))
    pick = lambda k, n: F.conv(F.substring(seed, k % 31 * 4 + 1, 4), 16, 10).cast("int") % n
    # one number for each character, 32 from a digest; arrays are zipped, so that time stays in proportion to the length
    blocks = F.array_repeat(seed, F.floor(F.length(flat) / 32).cast("int") + 1)
    digests = F.transform(blocks, lambda d, b: F.sha2(F.concat(d, b.cast("string")), 512))
    of = lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(d, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    df = df.withColumn("numbers", F.slice(F.flatten(F.transform(digests, of)), F.lit(1), F.greatest(F.length(flat), F.lit(1))))
    letter = lambda r, first: F.char(F.lit(ord(first)) + r % 26)
    drawn = lambda c, r: F.when(c.rlike("[0-9]"), (r % 10).cast("string")).when(c.rlike("[A-Z]"), letter(r, "A")).otherwise(letter(r, "a"))
    nibbles = F.array_join(F.transform("numbers", lambda r: F.hex(r % 16)), "")
    by_class = F.array_join(F.zip_with(F.split(flat, ""), "numbers", drawn), "")
    hexadecimal = (kind == "secret") & flat.rlike("^(?=.{16})(?:[0-9a-f]++|[0-9A-F]++)$")
    df = df.withColumn("same", F.when(hexadecimal, F.when(flat.rlike("[a-f]"), F.lower(nibbles)).otherwise(nibbles)).otherwise(by_class))
    more = F.substring(F.concat(*[pick(k, 10).cast("string") for k in range(24)]), F.lit(1), extra)
    code = F.regexp_extract(canon, f"^\\+({SHORT_CODES}|[0-9]{{3}})", 1)
    branded = F.concat(F.substring(flat, 1, 1), F.substring(same, F.lit(2), F.length(same) - 2))
    card = F.concat(branded, ((F.lit(10) - _luhn(_digits(F.concat(branded, F.lit("0")))) % 10) % 10).cast("string"))

    # made-up names: syllables of the script, one for a given name, two for a family, three for a domain
    by_script = lambda k: F.when(scope == "cyrillic", SCRIPTS["cyrillic"][k]).when(scope == "greek", SCRIPTS["greek"][k]).otherwise(SCRIPTS["latin"][k])
    df = df.withColumns({
        "consonants": by_script(0),
        "vowels": by_script(1),
        "endings": F.split(F.when(kind == "given f", by_script(2)).when(kind == "given m", by_script(3)).when(kind == "family", by_script(4)).otherwise("web|net|mail|post"), "\\|"),
    })
    sound = lambda k, letters: F.substring(letters, pick(k, F.length(letters)) + 1, F.lit(1))
    syllable = lambda k: F.concat(sound(2 * k, F.col("consonants")), sound(2 * k + 1, F.col("vowels")))
    more_than_given = F.when(kind.isin("family", "domain"), syllable(1)).otherwise("")
    third = F.when(kind == "domain", syllable(2)).otherwise("")
    name = F.concat(syllable(0), more_than_given, third, F.array_join(F.slice(F.array(*[syllable(k) for k in range(3, 27)]), F.lit(1), extra), ""), sound(20, F.col("consonants")), F.element_at("endings", pick(21, F.size("endings")) + 1))
    s = (
        F.when(kind.isin("family", "given f", "given m"), name)
        .when(kind == "domain", F.concat(name, F.lit(".example")))
        .when(kind == "ip", F.concat_ws(".", *[(pick(k, 254) + 1).cast("string") for k in range(4)]))
        .when(kind == "phone", F.concat(code, F.substring(same, F.length(code) + 1, F.length(same))))
        .when(kind == "card", card)
        # numbers from 900 on are never given out
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(same, F.lit(2), F.length(same))))
        .when(kind == "email", F.concat(same, more))
        .otherwise(same)
    )
    return df.select("kind", "scope", "canon", "turn", s.alias("s"))


def unit_surrogates(units: DataFrame, key: str) -> DataFrame:
    """kind, scope, canon, s: within a kind and scope every s is another one, and none is a real form."""
    flat = F.when(F.col("kind").isin("domain", "ip"), F.col("canon")).otherwise(F.regexp_replace("canon", "[^\\p{L}0-9]", ""))
    units = stage_table(units.distinct(), "units")
    real = units.select("kind", flat.alias("s")).distinct()
    done: DataFrame | None = None
    todo, turn, n = units, 0, 1
    while True:
        drawn = draw(todo.withColumn("turn", F.explode(F.sequence(F.lit(turn), F.lit(turn + n - 1)))), key)
        free = drawn.groupBy("kind", "scope", "s").agg(F.min("canon").alias("canon")).join(real, ["kind", "s"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "scope", "s"), ["kind", "scope", "s"], "left_anti")
        won = drawn.join(free, ["kind", "scope", "s", "canon"]).groupBy("kind", "scope", "canon").agg(F.min_by("s", "turn").alias("s"))
        settled = stage_table(todo.join(won, ["kind", "scope", "canon"], "left"), "surrogates")
        good = settled.filter("s IS NOT NULL")
        done = good if done is None else done.union(good)
        todo, turn = settled.filter("s IS NULL").select("kind", "scope", "canon"), turn + n
        if todo.isEmpty():
            return done
        if turn >= MOST_DRAWS:
            kinds = ", ".join(sorted(r.kind for r in todo.select("kind").distinct().collect()))  # a type each
            raise ValueError(f"no free surrogate is left of these types and their formats: {kinds}")
        n = 1 if turn < 4 else min(2 * n, MOST_DRAWS - turn)


def _dress(place: Column, s: Column) -> Column:
    """The characters of ``s`` in the places of the letters and digits of ``place``; case and separators as there."""
    at = F.transform(F.split(place, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    takes = lambda x: x.c.rlike("[\\p{L}0-9]")
    given = F.transform(F.split(s, ""), lambda c, i: F.struct((i + (1 << 24)).alias("i"), c.alias("c")))
    put = lambda x, y: F.struct(F.coalesce(x.i, y.i).alias("i"), F.when(x.c.rlike("\\p{Lu}"), F.upper(y.c)).otherwise(F.coalesce(y.c, F.lit(""))).alias("c"))
    both = F.array_sort(F.concat(F.filter(at, lambda x: ~takes(x)), F.zip_with(F.filter(at, takes), given, put)))
    return F.array_join(F.transform(both, lambda x: x.c), "")


def _check_digits(country: Column, body: Column) -> Column:
    """The two digits that make an IBAN's number leave 1 modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.transform(F.split(F.concat(body, country, F.lit("00")), ""), value), F.lit(0), lambda m, d: (m * F.when(d > 9, 100).otherwise(10) + d) % 97)
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """value, surrogate of distinct matched values, and for full names also full, full_new (without the title)."""
    described = stage_table(describe(values), "values")
    units = described.select("value", F.posexplode("units").alias("place", "unit"))
    found = unit_surrogates(units.select("unit.*"), key)
    each = units.select("value", "place", "unit.*").join(found, ["kind", "scope", "canon"]).groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x.s).alias("s"))
    one, two = F.element_at("s", 1), F.get("s", F.lit(1))
    kind, v = F.col("kind"), F.col("value")
    country = F.substring("value", 1, 2)
    feminine = F.when((F.col("gender") == "f") & F.col("family").rlike("\\p{IsCyrillic}"), F.lit(SCRIPTS["cyrillic"][5])).otherwise("")
    family = F.initcap(F.concat(one, feminine))
    full = F.when(F.col("given").isNotNull(), F.concat_ws(" ", F.initcap(two), family))
    out = (
        F.when(kind == "email", F.concat(_dress(F.col("local"), one), F.lit("@"), two))
        .when(kind == "secret", F.concat("head", _dress(F.col("body"), one), F.when(v.endswith('"'), '"').otherwise("")))
        .when(kind == "iban", _dress(v, F.concat(country, _check_digits(country, one), one)))
        .when(kind == "ip", one)
        .when(kind == "name", F.concat_ws(" ", "head", F.coalesce(full, family)))
        .otherwise(_dress(v, one))
    )
    joined = described.join(each, "value")
    return joined.select("value", out.alias("surrogate"), F.when(full.isNotNull(), F.concat_ws(" ", "given", "family")).alias("full"), full.alias("full_new"))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with surrogates in the text, and n_entities.  ``key`` is secret: who has it can test guesses."""
    if not key:
        raise ValueError("surrogates need a secret key")
    columns = [c for c in docs.columns if c != "n_entities"]
    # input columns travel in one struct, so that no name of theirs meets one used here
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"))
    text = F.col("doc").getField(text_col)
    signed = F.coalesce(text.rlike(_SIGN), F.lit(False))
    unbox = lambda new: [new.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in columns]
    clean = boxed.filter(~signed).select(*unbox(text), F.lit(0).cast("long").alias("n_entities"))
    found = boxed.filter(signed).select(F.monotonically_increasing_id().alias("row"), "doc", F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("found"))
    found = stage_table(found.withColumn("between", F.when(F.size("found") > 0, F.split(text, ENTITY, -1))), "entities")
    named = found.select("row", F.posexplode("found").alias("at", "value"))
    table = stage_table(surrogate_table(named.select("value").distinct(), key), "table")
    # a value without a surrogate is no entity after all and stays; the merge join can split a value of very many rows
    given = named.join(table.hint("merge"), "value", "left").select("row", "at", F.coalesce("surrogate", "value").alias("new"), F.col("surrogate").isNotNull().alias("real"), F.when(F.col("full").isNotNull(), F.struct("full", "full_new")).alias("name"))
    mapped = given.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x.new).alias("new"), F.collect_set("name").alias("names"), F.count_if("real").alias("n"))
    full, full_new = F.transform("names", lambda x: x.full), F.transform("names", lambda x: x.full_new)
    named_so = F.when(F.size("names") > 0, F.concat(F.lit("(?<!\\p{L})(?=\\p{Lu})(?:"), F.array_join(full, "|"), F.lit(")(?!\\p{L})")))
    mapped = mapped.select("row", "new", "n", full.alias("full"), full_new.alias("full_new"), named_so.alias("pattern"))
    rows = found.join(mapped, "row", "left")

    def again(part: Column) -> Column:
        hits = F.regexp_extract_all(part, F.col("pattern"), F.lit(0))
        new = F.concat(F.transform(hits, lambda x: F.get("full_new", F.array_position("full", x).cast("int") - 1)), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(part, F.col("pattern"), -1), new, lambda p, s: F.concat(p, s)), "")

    between = F.when(F.col("pattern").isNotNull(), F.transform("between", again)).otherwise(F.col("between"))
    replaced = F.array_join(F.zip_with(between, F.concat("new", F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    rows = rows.select(*unbox(F.when(F.col("n") > 0, replaced).otherwise(text)), F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"))
    return clean.unionByName(rows)
