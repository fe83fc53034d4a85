"""Personal data: detection and surrogates.

Detected entities get keyed replacements of their own type: an address stays an address, digits stay
digits in the places and separators they had, card numbers and IBANs get valid check digits, network
addresses stay valid, and names keep their form of address, its gender, their
script, their number of words and their case.

A surrogate is a function of the key, the type and the entity in canonical form (case, or
separators, left out), so one entity has one surrogate in all its spellings and texts
(coreference). Distinctness is checked over the whole corpus: of entities that would share a
surrogate, all but the first draw anew, and so does an entity whose surrogate is a real
entity of the corpus, until no such case is left. Phone and SSN-like numbers keep their count of
digits for ``FORMAT_DRAWS`` draws; after that each draw adds a digit behind them, which makes room.

Null text stays null; empty text has no entity. Rows are rewritten one by one, so
repeated rows stay equal. Null ids are kept. Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.expressions import let, total
from starledger.sources.staging import stage

BROADCAST_ROWS = 500_000
FORMAT_DRAWS = 8  # numbers drawn more often get further digits, as their format is nearly full

# --- fixed values: patterns, forms of address, names ----------------------------

EMAIL = r"(?<![\w.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+)*\.\p{L}{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CARD = r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
)
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Sir", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Doctor")
NAME = (
    rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.?"
    r"(?: \p{Lu}[\p{L}'’-]++){1,3}"
)
PATTERN = "|".join((EMAIL, IP, IBAN, SSN, CARD, PHONE, NAME))
CUE = rf"[@0-9]|{'|'.join(MALE + FEMALE + NEUTRAL)}"
TYPES = ("email", "ip", "iban", "ssn", "card", "phone", "name")
GIVEN = {
    ("latin", "male"): "Adam Bruno Carl David Emil Felix Georg Henri Ivan Jonas Karim Louis Mateo Noel Oscar Paul",
    ("latin", "female"): "Alma Berta Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula",
    ("latin", "neutral"): "Alex Blair Casey Dana Eden Francis Gale Harper Indigo Jules Kim Lee Morgan Noa Robin Sam",
    ("cyrillic", "male"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Марк Никита Олег Павел Роман Тимур",
    ("cyrillic", "female"): "Анна Белла Вера Галина Дарья Ева Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса Тамара",
    ("cyrillic", "neutral"): "Саша Женя Валя Слава Миша Шура Юля Тоня Паша Лёля Митя Нюра Ося Рита Сима Фима",
    ("greek", "male"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λεωνίδας Μάρκος Νίκος Ορέστης Παύλος Σπύρος Τάσος Φώτης Χρήστος",
    ("greek", "female"): "Άννα Βασιλική Γεωργία Δέσποινα Ελένη Ζωή Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ολυμπία Πηνελόπη Ρέα Σοφία Χαρά",
    ("greek", "neutral"): "Άρτεμις Θέμις Ίρις Κλειώ Λητώ Μυρτώ Νεφέλη Ξένια Όλγα Πάρις Ρένα Σάσα Τόνια Φένια Χλόη Ψυχή",
}
SYLLABLES = {
    "latin": "ba de fi go ku la me ni po ra se ti vo wa ze lu",
    "cyrillic": "ба де фи го ку ла ме ни по ра се ти во жа зе лу",
    "greek": "βα δε φι γο κου λα με νι πο ρα σε τι χο ζα ξε λου",
}
FAMILY_SYLLABLES = 4
LETTERS = "abcdefghijklmnop"  # of the sixteen hexadecimal digits


def entities(text: Column) -> Column:
    """All entities of a text, in order; texts without any cue are not searched."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(CUE), found).otherwise(F.array().cast("array<string>"))


def entity_type(entity: Column) -> Column:
    tests = zip(TYPES, (EMAIL, IP, IBAN, SSN, CARD, PHONE), strict=False)
    picked = None
    for name, pattern in tests:
        fits = entity.rlike(rf"^(?:{pattern})$")
        picked = F.when(fits, name) if picked is None else picked.when(fits, name)
    return picked.otherwise("name")


def canonical(kind: Column, entity: Column) -> Column:
    """The entity without what its spellings may differ in."""
    person = F.concat_ws(
        " ",
        F.regexp_extract(entity, r"^\p{L}+", 0),
        F.initcap(F.lower(F.regexp_replace(entity, r"^\p{L}+\.? ", ""))),
    )
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "ip", entity)
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "name", person)
        .otherwise(F.regexp_replace(entity, r"\D", ""))
    )


def _hex(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """64 hexadecimal digits from the key, the type, the entity and the draw."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value), 256)


def _digits(hexes: Column) -> Column:
    """64 decimal digits of 64 hexadecimal ones."""
    return F.translate(hexes, "abcdef", "270495")


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", LETTERS)


def _refilled(shape: Column, pattern: str, filling: Column) -> Column:
    """``shape`` with the i-th character that fits ``pattern`` replaced by the i-th of ``filling``."""

    def joined(parts: Column) -> Column:
        def behind(part: Column, i: Column) -> Column:
            one = F.substring(filling, F.pmod(i, F.length(filling)) + 1, F.lit(1))
            return F.concat(part, F.when(i < F.size(parts) - 1, one).otherwise(""))

        return F.array_join(F.transform(parts, behind), "")

    return let(F.split(shape, pattern, -1), joined)


def _more(attempt: Column, part: Column) -> Column:
    """Nothing on the first draw; else ``part``, which makes room for more surrogates."""
    return F.when(attempt > 0, part).otherwise("")


def _email(key: str, entity: Column, hexes: Column, attempt: Column) -> Column:
    """Letters and digits change in place; one host is one host in all addresses."""

    def refilled(text: Column, by: Column) -> Column:
        return _refilled(_refilled(text, r"\p{L}", _letters(by)), r"\d", _digits(by))

    domain = F.lower(F.substring_index(entity, "@", -1))
    host = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    host_hex = _hex(key, F.lit("host"), domain, F.lit(0))
    return F.concat(
        refilled(F.lower(F.substring_index(entity, "@", 1)), hexes),
        _more(attempt, F.substring(_digits(hexes), F.lit(33), 4 + attempt)),
        F.lit("@"),
        refilled(host, host_hex),
        F.lit("."),
        F.substring_index(domain, ".", -1),
    )


def _address(hexes: Column) -> Column:
    octets = [F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("int") for i in range(4)]
    octets[0] = 1 + octets[0] % 223
    return F.concat_ws(".", *(o.cast("string") for o in octets))


def _longer(attempt: Column, hexes: Column) -> Column:
    """Further digits of a number whose format had no free surrogate in ``FORMAT_DRAWS`` draws."""
    count = F.greatest(attempt - (FORMAT_DRAWS - 1), F.lit(0))
    return F.substring(_digits(hexes), F.lit(33), count)


def _phone(entity: Column, hexes: Column, attempt: Column) -> Column:
    """The first digit of eleven or more (a country code) stays."""

    def refilled(old: Column) -> Column:
        kept = F.when(F.length(old) > 10, F.substring(old, 1, 1)).otherwise("")
        return F.concat(_refilled(entity, r"\d", F.concat(kept, _digits(hexes))), _longer(attempt, hexes))

    return let(F.regexp_replace(entity, r"\D", ""), refilled)


def _card(entity: Column, hexes: Column) -> Column:
    """The first digit (the scheme) stays; the last one makes the number valid."""

    def refilled(old: Column) -> Column:
        body = F.concat(
            F.substring(old, 1, 1), F.substring(_digits(hexes), F.lit(2), F.length(old) - 2)
        )
        return let(
            body, lambda b: _refilled(entity, r"\d", F.concat(b, _luhn_digit(b).cast("string")))
        )

    return let(F.regexp_replace(entity, r"\D", ""), refilled)


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` and it a valid card number."""

    def weighted(digits: Column) -> Column:
        def value(d: Column, i: Column) -> Column:
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return F.when((F.size(digits) - i) % 2 == 1, twice).otherwise(d)

        return F.pmod(-total(F.transform(digits, value), F.lit(0)), F.lit(10))

    return let(F.transform(F.regexp_extract_all(body, F.lit(r"\d"), F.lit(0)), lambda c: c.cast("int")), weighted)


def _iban(entity: Column, hexes: Column) -> Column:
    """The country stays; the check digits make the number valid."""
    country = F.substring(entity, 1, 2)
    account = F.substring(entity, F.lit(5), F.length(entity))

    def checked(filled: Column) -> Column:
        return F.concat(country, _iban_check(filled, country), filled)

    refilled = _refilled(_refilled(account, r"\d", _digits(hexes)), "[A-Z]", F.upper(_letters(hexes)))
    return let(refilled, checked)


def _iban_check(account: Column, country: Column) -> Column:
    """Two digits: 98 less the remainder by 97 of account, country and 00, letters read as 10 to 35."""
    signs = F.regexp_extract_all(F.concat(account, country, F.lit("00")), F.lit("[A-Z0-9]"), F.lit(0))

    def step(remainder: Column, sign: Column) -> Column:
        letter = sign >= "A"
        value = F.ascii(sign) - F.when(letter, 55).otherwise(48)
        return F.pmod(remainder * F.when(letter, 100).otherwise(10) + value, F.lit(97))

    return F.lpad((98 - F.aggregate(signs, F.lit(0), step)).cast("string"), 2, "0")


def _picked(words: str, hexes: Column, at: int | Column) -> Column:
    """One of sixteen words by a hexadecimal digit."""
    listed = F.array(*map(F.lit, words.split()))
    digit = F.substring(hexes, F.lit(at) if isinstance(at, int) else at, F.lit(1))
    return F.get(listed, F.conv(digit, 16, 10).cast("int"))


def _person(entity: Column, hexes: Column, attempt: Column) -> Column:
    """The form of address, a given name if there were two words or more, and family names."""
    title = F.regexp_extract(entity, r"^\p{L}+\.?", 0)
    bare = F.regexp_extract(entity, r"^\p{L}+", 0)
    rest = F.regexp_replace(entity, r"^\p{L}+\.? ", "")
    count = F.size(F.split(rest, " "))

    def by_gender(script: str) -> Column:
        names = {who: _picked(GIVEN[script, who], hexes, 1) for who in ("male", "female", "neutral")}
        return (
            F.when(bare.isin(*MALE), names["male"])
            .when(bare.isin(*FEMALE), names["female"])
            .otherwise(names["neutral"])
        )

    def by_count(script: str) -> Column:
        syllables = SYLLABLES[script]
        longer = F.array_join(
            F.transform(
                F.sequence(F.lit(1), attempt), lambda i: _picked(syllables, hexes, 30 + i % 30)
            ),
            "",
        )
        first, second = (
            F.concat(*(_picked(syllables, hexes, at + i) for i in range(FAMILY_SYLLABLES)))
            for at in (2, 10)
        )
        first = F.initcap(F.concat(first, _more(attempt, longer)))
        return (
            F.when(count == 1, first)
            .when(count == 2, F.concat_ws(" ", by_gender(script), first))
            .otherwise(F.concat_ws(" ", by_gender(script), F.initcap(second), first))
        )

    made = F.when(rest.rlike(r"\p{IsCyrillic}"), by_count("cyrillic"))
    made = made.when(rest.rlike(r"\p{IsGreek}"), by_count("greek")).otherwise(by_count("latin"))
    shouted = (F.upper(rest) == rest) & (F.length(rest) > 1)
    return F.concat_ws(" ", title, F.when(shouted, F.upper(made)).otherwise(made))


def surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """The replacement of one entity, in the spelling the entity has."""

    def made(hexes: Column) -> Column:
        return (
            F.when(kind == "email", _email(key, entity, hexes, attempt))
            .when(kind == "ip", _address(hexes))
            .when(kind == "iban", _iban(entity, hexes))
            .when(kind == "ssn", F.concat(_refilled(entity, r"\d", _digits(hexes)), _longer(attempt, hexes)))
            .when(kind == "card", _card(entity, hexes))
            .when(kind == "phone", _phone(entity, hexes, attempt))
            .otherwise(_person(entity, hexes, attempt))
        )

    return let(_hex(key, kind, canonical(kind, entity), attempt), made)


def _all_entities(docs: DataFrame, text_col: str) -> DataFrame:
    """kind and entity (canonical) of all entities of the corpus, once each."""
    found = docs.select(F.explode(entities(F.col(text_col))).alias("spelled"))
    typed = found.withColumn("kind", entity_type(F.col("spelled")))
    return typed.select("kind", canonical(F.col("kind"), F.col("spelled")).alias("entity")).distinct()


def redrawn(known: DataFrame, key: str) -> DataFrame:
    """kind, entity, attempt of the entities whose first surrogates clash.

    Each round finds shared surrogates and surrogates that are entities themselves, and draws
    anew for those; the corpus is not read again. Formats that can get full make room, so it ends.
    """
    known = stage(known)

    def drawn(rows: DataFrame) -> DataFrame:
        made = surrogate(key, F.col("kind"), F.col("entity"), F.col("attempt"))
        return rows.withColumn("made", canonical(F.col("kind"), made))

    now = stage(drawn(known.withColumn("attempt", F.lit(0))))
    while True:
        firsts = stage(
            now.groupBy("kind", "made")
            .agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n"))
            .where("n > 1")
        )
        shared = now.join(firsts, ["kind", "made"]).where(
            F.struct("attempt", "entity") != F.col("first")
        )
        real = now.join(known.select("kind", F.col("entity").alias("made")), ["kind", "made"], "left_semi")
        again = stage(shared.select("kind", "entity").union(real.select("kind", "entity")).distinct())
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "entity", "attempt")
        fresh = now.join(again, ["kind", "entity"], "left_semi")
        fresh = drawn(fresh.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        now = stage(now.join(again, ["kind", "entity"], "left_anti").union(fresh))


def replace_entities(
    docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with surrogates in the text, and n_entities (which replaces a column of that name)."""
    docs = docs.drop("n_entities")
    again = stage(redrawn(_all_entities(docs, text_col), key))
    text = F.col(text_col)
    draws = F.create_map().cast("map<string,int>")
    if not again.isEmpty():  # the rows that hold an entity drawn anew get its draw
        own = docs.select(F.col(id_col).alias("__pii_id"), F.explode(F.array_distinct(entities(text))).alias("spelled"))
        own = own.withColumn("kind", entity_type(F.col("spelled")))
        own = own.withColumn("entity", canonical(F.col("kind"), F.col("spelled")))
        listed = (
            own.join(again, ["kind", "entity"])
            .groupBy("__pii_id")
            .agg(F.collect_set(F.struct(F.concat_ws(":", "kind", "entity"), "attempt")).alias("__pii_draws"))
        )
        listed = stage(listed.withColumn("__pii_draws", F.map_from_entries("__pii_draws")))
        listed = F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed
        docs = docs.join(listed, docs[id_col].eqNullSafe(listed["__pii_id"]), "left").drop("__pii_id")
        draws = F.coalesce(F.col("__pii_draws"), draws)

    def replaced(spelled: Column, attempts: Column) -> Column:
        def typed(kind: Column) -> Column:
            named = F.concat_ws(":", kind, canonical(kind, spelled))
            attempt = F.coalesce(F.try_element_at(attempts, named), F.lit(0))
            return let(attempt, lambda a: surrogate(key, kind, spelled, a))

        return let(entity_type(spelled), typed)

    def rewritten(found: Column, attempts: Column) -> Column:
        parts = F.split(text, PATTERN, -1)
        made = F.transform(found, lambda e: replaced(e, attempts))
        return F.array_join(
            F.zip_with(parts, made, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""
        )

    found = docs.withColumn("__pii_found", entities(text)).withColumn("__pii_attempts", draws)
    none = F.size("__pii_found") == 0
    return found.select(
        *(
            F.when(text.isNull() | none, text).otherwise(rewritten(F.col("__pii_found"), F.col("__pii_attempts"))).alias(c)
            if c == text_col
            else F.col(f"`{c}`")
            for c in docs.columns
            if c != "__pii_draws"
        ),
        F.coalesce(F.size("__pii_found"), F.lit(0)).cast("long").alias("n_entities"),
    )
