"""Personal data replaced by keyed surrogates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literals, stored

# Formats of personal data, honorifics by gender.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?![\d])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = (r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-/]?\d{2,4}){2,4}(?!\d)"
         r"|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?!\d)")
SECRET = (r"(?i:(?<=\b(?:password|passwd|token|secret|api[_\-]?key)\s{0,2}[=:]\s{0,2}[\"']?))"
          r"[A-Za-z0-9+/_\-]{8,}")
MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Doña|Госпожа"
NEUTRAL = "Dr|Prof"
_NAME = r"\p{Lu}[\p{L}\p{M}'’\-]+"
PERSON = rf"\b(?:{MALE}|{FEMALE}|{NEUTRAL})\.? {_NAME}(?: {_NAME}){{0,2}}"

#: Kinds in the order in which they are told from each other.
KINDS = (("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ip", IP), ("ssn", SSN),
         ("card", CARD), ("phone", PHONE), ("person", PERSON))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)

#: What every find contains, cheap to look for: a digit or @, a sign before a secret, an honorific.
HINT = rf"[0-9@]|(?=[MHSDFPГ])\b(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}"
SECRET_HINT = r"(?i)(?<=d|n|t|y)\s{0,2}[=:]"

# Syllables of surrogate names by script, endings of given names by gender.
SYLLABLES = {"latin": "al be cor dan el fa gi han is jo ka lu ma ne or pe ro sa te ul va wi".split(),
             "cyrillic": "ал бе вор га де ин ка ле ми но ор пе ра си та ул фе ви зо бу да".split(),
             "greek": "αλ βε γο δα ελ ζι θε κα λο μι νε ορ πα ρι σα τε υλ φο χα ψι".split()}
ENDINGS = {("latin", "m"): ["us", "ert", "on", "ik"], ("latin", "f"): ["a", "ine", "elle", "ia"],
           ("latin", "n"): ["ey", "is"], ("latin", "family"): ["er", "son", "mann", "ez", "ard"],
           ("cyrillic", "m"): ["ан", "ей"], ("cyrillic", "f"): ["ана", "ия"],
           ("cyrillic", "n"): ["ен"], ("cyrillic", "family"): ["енко", "ич"],
           ("greek", "m"): ["ος", "ης"], ("greek", "f"): ["α", "η"], ("greek", "n"): ["ι"],
           ("greek", "family"): ["ίδης", "άκης"]}

HEX = "0123456789abcdef"
LOWERS = "abcdefghijklmnopqrstuvwxyz"
#: Attempts of a fixed format; each further one adds a character, as the format is nearly used up.
FIXED_ATTEMPTS = 8


def _stream(seed: Column, i: Column) -> Column:
    """Number 0 to 65535 at place i of the key stream of a seed (an array of hex digests)."""
    block = F.element_at(seed, (F.floor(i / 16) % 4 + 1).cast("int"))
    return F.conv(F.substring(block, (i % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")


def _seed(key: str, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), *parts)
    return F.array(*[F.sha2(F.concat(text, F.lit(f"|{k}")), 256) for k in range(4)])


def _drawn(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), (number % len(alphabet) + 1).cast("int"), F.lit(1))


def _char(c: Column, number: Column, hexadecimal: Column) -> Column:
    """A character of the same class; others stay."""
    return (F.when(hexadecimal & c.rlike("[0-9a-f]"), _drawn(HEX, number))
            .when(c.rlike("[0-9]"), _drawn("0123456789", number))
            .when(c.rlike("[a-z]"), _drawn(LOWERS, number))
            .when(c.rlike("[A-Z]"), F.upper(_drawn(LOWERS, number))).otherwise(c))


def _redrawn(text: Column, seed: Column, hexadecimal: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _char(
        c, _stream(seed, i), hexadecimal)), "")


def _check_digit(body: Column) -> Column:
    """Luhn digit to set behind a string of digits."""
    doubled = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(
        c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return ((10 - total % 10) % 10).cast("string")


def _luhn(digits: Column) -> Column:
    return _check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(
        digits, -1, 1)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(
        name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _picked(values: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.element_at(values, i))


def _name(kind: Column, original: Column, seed: Column, attempt: Column) -> Column:
    """A name of the same script, and for given names of the same gender; each further attempt
    may use one more syllable, so there are always names left."""
    out = None
    for script, pool in SYLLABLES.items():
        places = F.transform(F.sequence(F.lit(0), 1 + F.least(attempt, F.lit(6))),
                             lambda i: (_stream(seed, i) % 20 + 1).cast("int"))
        stem = F.array_join(_picked(literals(pool, "string"), places), "")
        for role in ("m", "f", "n", "family"):
            ends = ENDINGS[script, role]
            end = F.element_at(literals(ends, "string"),
                               (_stream(seed, F.lit(40)) % len(ends) + 1).cast("int"))
            here = (kind == ("family" if role == "family" else f"given_{role}")) & (
                _script(original) == script)
            out = F if out is None else out
            out = out.when(here, F.initcap(F.concat(stem, end)))
    return out


def _surrogate(kind: Column, canonical: Column, attempt: Column, seed: Column) -> Column:
    no, yes = F.lit(False), canonical.rlike("^[0-9a-f]+$")
    local, domain = F.split_part(canonical, F.lit("@"), F.lit(1)), F.lit("example.org")
    wider = F.greatest(attempt - (FIXED_ATTEMPTS - 1), F.lit(0))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), 3 + wider), lambda i: (
        _stream(seed, i) % 254 + 1).cast("string")), ".")
    # Hosts are invented, so their numbers grow from the second attempt on.
    host = F.concat((_stream(seed, F.lit(63)) % 100).cast("string"), F.array_join(F.transform(
        F.slice(F.sequence(F.lit(40), F.lit(62)), F.lit(1), F.least(attempt, F.lit(23))),
        lambda i: (_stream(seed, i) % 10).cast("string")), ""))
    digits = F.concat(canonical, F.repeat(F.lit("0"), wider))
    letters = F.concat(canonical, F.repeat(F.lit("a"), wider))
    n = F.length(digits)
    body = _redrawn(F.substring(digits, F.lit(1), n - 1), seed, no)
    card = F.when(_luhn(canonical), F.concat(body, _check_digit(body))).otherwise(
        _redrawn(digits, seed, no))
    return (F.when(kind == "email", F.concat(_redrawn(local, seed, no), F.lit("@mail"), host,
                                             F.lit("."), domain))
            .when(kind == "ip", octets).when(kind == "card", card)
            .when(kind == "secret", _redrawn(letters, seed, yes))
            .when(kind.isin("iban", "ssn", "phone"), _redrawn(digits, seed, no))
            .otherwise(_name(kind, canonical, seed, attempt)))


def _kind(surface: Column) -> Column:
    """Kind of a detected string; secrets are known by what stands before them, so they are what
    no other format fits."""
    out = F
    for kind, pattern in KINDS:
        if kind != "secret":
            out = out.when(surface.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("secret")


def _words_of(surface: Column) -> Column:
    """(kind, canonical) of the replaceable parts of a detected string, in order. A person's title
    stays; the last word is the family name, so `Mr. B.` and `Mr. A. B.` share it."""
    kind = _kind(surface)
    digits = F.regexp_replace(surface, r"\D", "")
    canonical = (F.when(kind == "email", F.lower(surface)).when(kind.isin("card", "ssn"), digits)
                 .when(kind == "phone", digits).when(
        kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).otherwise(surface))
    title = F.regexp_extract(surface, r"^(\S+?)\.? ", 1)
    gender = F.when(title.rlike(f"^(?:{MALE})$"), "m").when(
        title.rlike(f"^(?:{FEMALE})$"), "f").otherwise("n")
    names = F.slice(F.split(surface, " "), F.lit(2), F.greatest(
        F.size(F.split(surface, " ")) - 1, F.lit(0)))
    persons = F.transform(names, lambda w, i: F.struct(
        F.when(i == F.size(names) - 1, "family").otherwise(
            F.concat(F.lit("given_"), gender)).alias("kind"), w.alias("canonical")))
    one = F.array(F.struct(kind.alias("kind"), canonical.alias("canonical")))
    return F.when(kind == "person", persons).otherwise(one)


def _reformatted(surface: Column, canonical: Column, surrogate: Column) -> Column:
    """The surrogate's letters and digits in the layout of the surface, those of a wider one
    behind it."""
    return F.aggregate(
        F.split(surface, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(
            F.concat(s["out"], F.substring(surrogate, s["next"], F.lit(1))).alias("out"),
            (s["next"] + 1).alias("next"))).otherwise(F.struct(
                F.concat(s["out"], c).alias("out"), s["next"].alias("next"))),
        lambda s: F.concat(s["out"], F.substring(surrogate, s["next"], F.length(surrogate))))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canonical, surrogate) for distinct entities(kind, canonical).

    A surrogate depends on the key, the kind, the entity and an attempt. Within a kind, equal
    surrogates are a collision, and so is a surrogate that is itself an entity of the data. The
    entity of the fewest attempts, the least one on ties, keeps the surrogate; the others try
    again, until none collides. Letter case does not count.

    The space grows with the attempts, so there are always surrogates left: names get syllables and
    hosts of e-mail addresses digits from the second attempt on; the other kinds keep their length
    for FIXED_ATTEMPTS attempts, then each adds a digit, a letter to secrets or an octet to IP
    addresses.
    """
    state = stored(entities.select("kind", "canonical").distinct().withColumn(
        "attempt", F.lit(0)))
    while True:
        seeded = stored(state.withColumn("seed", _seed(
            key, F.col("kind"), F.col("canonical"), F.col("attempt").cast("string"))))
        drawn = stored(seeded.withColumn("surrogate", _surrogate(
            F.col("kind"), F.col("canonical"), F.col("attempt"), F.col("seed"))).withColumn(
            "same", F.lower("surrogate")).drop("seed"))
        owners = drawn.groupBy("kind", "same").agg(F.min(F.struct(
            "attempt", "canonical")).alias("owner"))
        real = entities.select("kind", F.lower("canonical").alias("same")).distinct().withColumn(
            "real", F.lit(True))
        judged = drawn.join(owners, ["kind", "same"]).join(real, ["kind", "same"], "left")
        lost = (F.col("owner.canonical") != F.col("canonical")) | F.col("real").isNotNull()
        judged = judged.select("kind", "canonical", "surrogate", "attempt", lost.alias("lost"))
        if judged.filter("lost").isEmpty():
            return drawn.select("kind", "canonical", "surrogate")
        state = stored(judged.select("kind", "canonical", (
            F.col("attempt") + F.col("lost").cast("int")).alias("attempt")))


def replace(docs: DataFrame, key: str = "surrogates-1") -> DataFrame:
    """docs(doc_id, text, ...) with personal data replaced in text, and n_entities (all kinds),
    n_kinds (map of kind to number).

    Found are e-mail and IP addresses, IBANs, card, social security and phone numbers, secrets
    after words like `password=`, and names after an honorific. Each entity has the same surrogate
    in the whole table (coreference), and different ones different surrogates. Surrogates keep
    kind, length (unless the values of a format run out, see `surrogates`), layout and letter case; cards that pass the Luhn check still do; names keep
    script and, by honorific, gender.

    The formats are only tried on texts with a sign that each of them needs. Texts without a find
    are not shuffled. The others are joined with their surrogates by a hash
    of the text; entities are made distinct per text and before the join, so an entity that stands
    in a third of all texts is one row for each of them, split by adaptive execution. The list of
    a text's finds is gathered only for that text.

    A null or empty text stays, with no finds. Equal texts have equal results, whatever their
    doc_id; a null doc_id is allowed. Columns of docs named like an added one are replaced. An
    empty table gives no rows.
    """
    cols = [c for c in docs.columns if c not in ("n_entities", "n_kinds")]
    hint = F.col("text").rlike(HINT) | F.col("text").rlike(SECRET_HINT)
    found = hint & F.col("text").rlike(ANY)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    rest = docs.select(*cols).filter(~found | F.col("text").isNull()).select(
        *cols, F.lit(0).alias("n_entities"), none.alias("n_kinds"))
    hit = docs.select(*cols).filter(found).withColumn("__key", F.sha2("text", 256))
    surface = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    parts = stored(hit.select("__key", F.explode(F.array_distinct(surface)).alias("surface"))
                   .distinct().select("__key", "surface", F.posexplode(_words_of(
                       F.col("surface"))).alias("at", "word"))
                   .select("__key", "surface", "at", "word.kind", "word.canonical"))
    known = surrogates(parts.select("kind", "canonical"), key)
    same_layout = F.col("kind").isin("card", "ssn", "phone", "iban")
    new = F.when(same_layout, _reformatted(F.col("surface"), F.col("canonical"),
                                           F.col("surrogate"))).otherwise(F.col("surrogate"))
    title = F.regexp_extract("surface", r"^\S+ ", 0)
    person = (F.col("kind") == "family") | F.col("kind").startswith("given_")
    pairs = parts.join(known, ["kind", "canonical"]).groupBy("__key", "surface").agg(
        F.array_sort(F.collect_list(F.struct("at", new.alias("new")))).alias("words"),
        F.max(F.when(person, "person").otherwise(F.col("kind"))).alias("kind"))
    pairs = pairs.select("__key", "surface", "kind", F.concat(
        F.when(F.col("kind") == "person", title).otherwise(F.lit("")),
        F.array_join(F.transform("words", lambda w: w["new"]), " ")).alias("new"))
    maps = pairs.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct(
        "surface", F.struct("new", "kind")))).alias("__map"))
    joined = hit.join(stored(maps), "__key").withColumn("__found", surface).withColumn(
        "__between", F.split("text", ANY, -1))
    text = F.array_join(F.zip_with("__between", "__found", lambda b, f: F.concat(
        b, F.coalesce(F.element_at(F.col("__map"), f)["new"], F.lit("")))), "")
    kinds = F.transform("__found", lambda f: F.element_at(F.col("__map"), f)["kind"])
    joined = joined.withColumn("__kinds", kinds).withColumn("__text", text)
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("__kinds")), lambda k: (
        F.struct(k, F.size(F.filter("__kinds", lambda x: x == k))))))
    done = joined.select(*[F.col("__text").alias("text") if c == "text" else F.col(c) for c in cols],
                         F.size("__found").alias("n_entities"), counted.alias("n_kinds"))
    return rest.unionByName(done)
