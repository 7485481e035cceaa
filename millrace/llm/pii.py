"""Surrogate generation for personal data, by DataFrame functions alone.

One pattern finds the entities of a text; sixteen digits that fail the Luhn test
are no card. Each entity is replaced by a surrogate drawn from a keyed hash of
its canonical form, so one entity has one surrogate everywhere (coreference)
and nobody without the key can tell which. The surrogate keeps the entity's type
and format: letters, digits and separators stay such; card numbers keep their
first digit and pass the Luhn test; addresses stay valid; names keep their
title, number of parts, script and gender. A name's parts are drawn each on its
own, so people who share a part still do.

Collision checks: canonical surrogates of all entities (of names: parts) of the
corpus are compared with each other and with all entities. Where two of one type
would share one, or one is a real entity of the corpus, it draws again, until
none collide. Names grow by a syllable with each draw, and other formats by a
digit from draw GROW on, so the space can't run out. Those that drew again are
the exceptions. Few of them are looked up in a constant map. Where they are many,
a bitmap of bounded size tells which texts may hold one: those alone are joined
with the exceptions, the others are rewritten where they stand.

What is found: e-mail and IP addresses, telephone and card numbers, US social
security numbers, IBANs, access keys, labelled secrets that hold a digit, and
names after a title or that begin with a common given name. Names without
either aren't found.

Defined results: a null text stays null and has no entities; an empty text stays
empty; repeated rows are rewritten alike; an empty table gives an empty result;
extra columns pass through unless named like an output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, discard, has_bit, made, release

#: The key of the pipeline's and the query's surrogates; a deployment passes its own.
KEY = "surrogates-1"
#: Draws of one entity before the build stops with an error; the draw from which formats grow.
MAX_DRAWS, GROW = 48, 8
#: Exceptions up to which they are looked up in a constant map; bits of the bitmap used beyond that, at most.
MAP_ROWS, MAP_BITS = 2_000, 1 << 25

# Titles and common given names by gender, and parts of names by script.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Г-жа", "Госпожа", "Κα", "Κυρία"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κος", "Κύριος"]
GIVEN_FEMALE = ["Alice", "Anna", "Barbara", "Catherine", "Elizabeth", "Emily", "Emma", "Hannah", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lisa", "Margaret", "Maria", "Mary", "Olivia", "Patricia", "Rachel", "Rebecca", "Sarah", "Susan", "Анна", "Мария", "Елена"]
GIVEN_MALE = ["Alexander", "Andrew", "Anthony", "Charles", "Christopher", "Daniel", "David", "Edward", "George", "Hans", "James", "John", "Joseph", "Kevin", "Matthew", "Michael", "Paul", "Peter", "Richard", "Robert", "Steven", "Thomas", "William", "Иван", "Пётр", "Сергей"]
LATIN_FEMALE = ["Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"]
LATIN_MALE = ["Adam", "Bruno", "Conrad", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Max", "Nils", "Otto", "Paul"]
CYRILLIC_FEMALE = ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия"]
CYRILLIC_MALE = ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"]
GREEK_FEMALE = ["Αθηνά", "Δήμητρα", "Ειρήνη", "Ζωή", "Μαρία", "Σοφία"]
GREEK_MALE = ["Αλέξης", "Γιώργος", "Λουκάς", "Νίκος", "Πέτρος", "Σπύρος"]
LATIN_SYLLABLES = ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "zo", "bel", "dor"]
CYRILLIC_SYLLABLES = ["ба", "ве", "го", "ду", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "фо", "ха", "лар", "мен"]
GREEK_SYLLABLES = ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "φε", "χι", "ξο"]

#: (type, pattern); the first that fits names an entity's type.
TYPES = [
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}+)*(?<=\.[A-Za-z]{2,24})"),
    ("aws_key", r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}+(?!\d)|(?<![\d.\-])[2-9]\d{2}(?:[.\-]\d{3}[.\-]| [2-9]\d{2} )\d{4}(?![\d.\-]?\d)"),
    ("card", r"(?<![\d.])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}(?!\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("secret", r"(?<![A-Za-z])(?i:password|passwd|secret|token|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z_\-]{0,127}[0-9])[A-Za-z0-9_\-]{8,128}+"),
    ("name", r"(?<!\p{L})(?=\p{Lu})(?:(?:" + "|".join(FEMALE + MALE) + r")\.? \p{Lu}\p{Ll}{1,40}(?: \p{Lu}\p{Ll}{1,40})?|(?:" + "|".join(GIVEN_FEMALE + GIVEN_MALE) + r") \p{Lu}\p{Ll}{1,40})(?!\p{L})"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in TYPES).replace(r"([ \-]?)", r"(?<sep>[ \-]?)").replace(r"\1", r"\k<sep>")
#: What every entity has; a text without it is not searched.
GATE = r"[0-9@]|assw|ecret|oken|api_?key|AKIA|(?i:passw|secret|token)|(?=\p{Lu})(?:" + "|".join(FEMALE + MALE + GIVEN_FEMALE + GIVEN_MALE) + ")"
_PREFIX = r"^((?:\p{L}|_)+\s*[=:]\s*[\"']?)"


def type_of(entity: Column) -> Column:
    """The type of what the pattern found, from what sets the types apart; 'none' for sixteen digits that are no card."""
    first, length = F.substring(entity, 1, 1), F.length(entity)
    digit = first.between("0", "9")
    out = F.when(F.contains(entity, F.lit("@")), "email").when(entity.startswith("AKIA") & (length == 20) & ~F.contains(entity, F.lit(" ")), "aws_key")
    out = out.when(entity.rlike("[=:]"), "secret").when(first.isin("+", "("), "phone").when(digit & (length >= 16), F.when(_luhn(entity), "card").otherwise("none"))
    out = out.when(digit & (F.substring(entity, 4, 1) == "-") & (F.substring(entity, 7, 1) == "-") & (length == 11), "ssn").when(digit & (length == 12) & entity.rlike(r"^\d{3}[.\- ]\d{3}[.\- ]\d{4}$"), "phone").when(digit, "ip")
    return out.when(entity.rlike(r"^[A-Z]{2}\d"), "iban").otherwise("name")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, whatever number of times it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(value: Column, kind: Column) -> Column:
    """What makes two spellings one: digits alone, or lower case; a secret without its label; a Russian family name in its male form."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    plain = F.when(kind == "email", F.lower(value)).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "secret", F.regexp_replace(value, _PREFIX, ""))
    plain = plain.when(kind == "family", F.regexp_replace(value, "(ов|ев|ин)а$", "$1"))
    return plain.when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\x1f", F.lit(key), *parts), "UTF-8"), 256)


def _stream(seed: Column, blocks: int = 3) -> Column:
    """A long string of hexadecimal digits from a seed."""
    return F.concat(*[F.sha2(F.concat(seed.cast("binary"), F.lit(bytes([b]))), 256) for b in range(blocks)])


def _shaped(entity: Column, seed: Column) -> Column:
    """``entity`` with each letter and digit drawn anew, of its kind and by its number among them; other characters stay."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    # the n-th letter or digit takes the n-th two digits of the stream
    at = lambda i: F.pmod(2 * F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), "[^0-9A-Za-z]", "")), F.lit(188))
    pick = lambda letters, v: F.substr(F.lit(letters), F.pmod(v, F.lit(len(letters))) + 1, F.lit(1))
    kind = lambda c, v: F.when(c.between("0", "9"), pick(digits, v)).when(c.between("a", "z"), pick(lower, v)).otherwise(pick(upper, v))
    value = lambda stream, i: F.conv(F.substr(stream, at(i) + 1, F.lit(2)), 16, 10).cast("int")
    one = lambda stream: lambda c, i: F.when(c.rlike("^[0-9A-Za-z]$"), _let(value(stream, i), lambda v: kind(c, v))).otherwise(c)
    return _let(_stream(seed), lambda stream: F.array_join(F.transform(F.split(entity, ""), one(stream)), ""))


def _luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """The Luhn sum of a string of digits, the rightmost doubled or not."""
    at = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.struct(c.cast("int").alias("d"), (F.pmod(i, F.lit(2)) == (0 if first_doubled else 1)).alias("twice")))
    return F.aggregate(at, F.lit(0), lambda s, x: s + F.when(x["twice"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]))


def _luhn(entity: Column) -> Column:
    return F.pmod(_luhn_sum(F.regexp_replace(entity, r"[^0-9]", ""), False), F.lit(10)) == 0


def _card(entity: Column, seed: Column) -> Column:
    drawn = F.concat(F.substring(entity, 1, 1), F.substr(_shaped(entity, seed), F.lit(2), F.length(entity) - 1))
    check = lambda head: F.pmod(-_luhn_sum(F.regexp_replace(head, r"[^0-9]", ""), True), F.lit(10)).cast("string")
    return _let(drawn, lambda d: _let(F.substr(d, F.lit(1), F.length(d) - 1), lambda head: F.concat(head, check(head))))


def _octets(seed: Column, draw: Column) -> Column:
    """A valid address; from draw GROW on in the reserved block."""
    part = lambda k: F.conv(F.substring(seed, 1 + 4 * k, 4), 16, 10).cast("int")
    first = F.when(draw < GROW, F.pmod(part(0), F.lit(223)) + 1).otherwise(F.pmod(part(0), F.lit(15)) + 240)
    return F.concat_ws(".", first.cast("string"), *[F.pmod(part(k), F.lit(256)).cast("string") for k in (1, 2)], (F.pmod(part(3), F.lit(254)) + 1).cast("string"))


def _pick(words: list[str], stream: Column, place: int | Column) -> Column:
    """The word that the two digits at a place (from 0) of the stream name."""
    at = F.conv(F.substr(stream, F.lit(place) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.get(F.array(*map(F.lit, words)), F.pmod(at, F.lit(len(words))))


def _syllables(words: list[str], stream: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick(words, stream, i + 2)), "")


def _part(value: Column, kind: Column, seed: Column, draw: Column) -> Column:
    """A part of a name in its own script: given names from a list, family names (in their male form) from syllables, more of them with each draw.

    Of other scripts, letters of the name itself are drawn, the first in upper case.
    """

    def given(stream: Column, female: list[str], male: list[str], syllables: list[str]) -> Column:
        plain = F.when(kind == "given-f", _pick(female, stream, 0)).otherwise(_pick(male, stream, 0))
        return F.when(draw == 0, plain).otherwise(F.concat(plain, _syllables(syllables, stream, draw)))

    def family(stream: Column, syllables: list[str], end: str) -> Column:
        return F.initcap(F.concat(_syllables(syllables, stream, draw + 4), F.lit(end)))

    def own(stream: Column) -> Column:
        letters = F.split(F.lower(value), "")
        at = lambda i: F.pmod(F.conv(F.substr(stream, F.pmod(i, F.lit(90)) * 2 + 1, F.lit(2)), 16, 10).cast("int"), F.size(letters))
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.size(letters) - 1 + draw), lambda i: F.get(letters, at(i))), ""))

    def of(stream: Column) -> Column:
        is_family = kind == "family"
        out: Column | None = None
        for script, female, male, syllables, end in (("Latin", LATIN_FEMALE, LATIN_MALE, LATIN_SYLLABLES, ""), ("Cyrillic", CYRILLIC_FEMALE, CYRILLIC_MALE, CYRILLIC_SYLLABLES, "ов"), ("Greek", GREEK_FEMALE, GREEK_MALE, GREEK_SYLLABLES, "ς")):
            here = F.when(is_family, family(stream, syllables, end)).otherwise(given(stream, female, male, syllables))
            out = (F if out is None else out).when(value.rlike(rf"^\p{{Is{script}}}"), here)
        return out.otherwise(own(stream))

    return _let(_stream(seed), of)


def _name_parts(entity: Column) -> Column:
    """(title, given, family, female) of a name; title and given may be null."""

    def of(words: Column) -> Column:
        title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
        titled = title.isin(*FEMALE, *MALE)
        given = F.when(F.size(words) - titled.cast("int") > 1, F.get(words, titled.cast("int")))
        female = F.when(titled, title.isin(*FEMALE)).otherwise(given.isin(*GIVEN_FEMALE))
        return F.struct(F.when(titled, F.get(words, F.lit(0))).alias("title"), given.alias("given"), F.element_at(words, -1).alias("family"), female.alias("female"))

    return _let(F.split(entity, " "), of)


def items_of(entity: Column) -> Column:
    """(kind, canon, value) of what is drawn for an entity: itself, or the parts of a name."""
    item = lambda kind, value: F.struct(kind.alias("kind"), canonical(value, kind).alias("canon"), value.alias("value"))

    def of(kind: Column) -> Column:
        parts = lambda p: F.filter(F.array(item(F.when(p["female"], "given-f").otherwise("given-m"), p["given"]), item(F.lit("family"), p["family"])), lambda x: x["value"].isNotNull())
        return F.when(kind == "name", _let(_name_parts(entity), parts)).when(kind == "none", F.filter(F.array(item(kind, entity)), lambda x: F.lit(False))).otherwise(F.array(item(kind, entity)))

    return _let(type_of(entity), of)


def item_surrogate(kind: Column, canon: Column, value: Column, key: str, draw: Column) -> Column:
    """The surrogate of an item at its draw, 0 at first; family names in their male form."""

    def of(seed: Column) -> Column:
        whole = lambda start: F.substr(value, start, F.length(value))
        label, code = F.regexp_extract(value, _PREFIX, 1), F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .\-(]))", 1)
        # what stays in front, and what is drawn anew by letters and digits
        front = F.when(kind == "aws_key", "AKIA").when(kind == "iban", F.substring(value, 1, 2)).when(kind == "phone", code).when(kind == "secret", label).otherwise("")
        drawn = _let(front, lambda f: _let(whole(F.length(f) + 1), lambda rest: F.concat(f, F.when((kind == "secret") & rest.rlike("^[0-9a-f]+$") & (F.length(rest) <= 192), F.substr(_stream(seed), F.lit(1), F.length(rest))).otherwise(_shaped(rest, seed)))))
        more = F.when(draw < GROW, "").otherwise(F.translate(F.substr(seed, F.lit(1), draw - GROW + 1), "abcdef", "012345"))
        domain = F.concat(F.lit("@"), F.translate(F.substring(seed, 1, 10), "0123456789", "ghijklmnop"), F.lit(".example.org"))
        out = F.when(kind == "email", F.concat(_shaped(F.substring_index(value, "@", 1), seed), domain)).when(kind == "card", _card(value, seed)).when(kind == "ip", _octets(seed, draw))
        return out.when(kind.isin("given-f", "given-m", "family"), _part(value, kind, seed, draw)).when(kind == "none", value).otherwise(F.concat(drawn, more))

    return _let(_hash(key, kind, canon, draw.cast("string")), of)


def surrogate(entity: Column, key: str, draw_of: Callable[[Column, Column], Column]) -> Column:
    """The surrogate of an entity; ``draw_of`` gives the draw of a kind and canonical form."""
    one = lambda kind, value: _let(canonical(value, kind), lambda canon: item_surrogate(kind, canon, value, key, draw_of(kind, canon)))

    def name(p: Column) -> Column:
        given = F.when(p["given"].isNotNull(), one(F.when(p["female"], "given-f").otherwise("given-m"), p["given"]))
        return F.concat_ws(" ", p["title"], given, _let(one(F.lit("family"), p["family"]), lambda f: F.when(p["female"], F.regexp_replace(f, "ов$", "ова")).otherwise(f)))

    return _let(type_of(entity), lambda kind: F.when(kind == "none", entity).when(kind == "name", _let(_name_parts(entity), name)).otherwise(one(kind, entity)))


def entities_of(text: Column) -> Column:
    """What the pattern finds in a text, in order."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def exceptions(df: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """(kind, canon, draw) of the corpus's entities, or parts of names, that drew again."""
    found = df.select(F.explode(entities_of(F.col(text))).alias("entity")).distinct()
    known = cut(found.select(F.explode(items_of(F.col("entity"))).alias("x")).select("x.*").groupBy("kind", "canon").agg(F.min("value").alias("value")).withColumn("draw", F.lit(0)), "entities")
    real = known.select("kind", F.col("canon").alias("drawn"))
    for _ in range(MAX_DRAWS):
        new = item_surrogate(F.col("kind"), F.col("canon"), F.col("value"), key, F.col("draw"))
        drawn = cut(known.select("kind", "canon", "draw", canonical(new, F.col("kind")).alias("drawn")), "drawn")
        # of those that share one the earliest draw keeps it, unless it is real
        keeper = drawn.groupBy("kind", "drawn").agg(F.min(F.struct("draw", "canon")).alias("k"), F.count(F.lit(1)).alias("n"))
        shared = keeper.filter("n > 1").select("kind", "drawn", F.col("k.canon").alias("keeper"))
        again = drawn.join(shared, ["kind", "drawn"]).filter("canon <> keeper").select("kind", "canon").unionByName(drawn.join(real, ["kind", "drawn"], "left_semi").select("kind", "canon"))
        again = cut(again.distinct(), "again")
        discard(drawn)
        if again.isEmpty():
            return known.filter("draw > 0").select("kind", "canon", "draw")
        after = cut(known.join(again.withColumn("_again", F.lit(1)), ["kind", "canon"], "left").withColumn("draw", F.col("draw") + F.coalesce("_again", F.lit(0))).drop("_again"), "entities")
        known = after
    raise RuntimeError(f"surrogates still collide after {MAX_DRAWS} draws")


def _item_key(kind: Column, canon: Column) -> Column:
    return F.concat(kind, F.lit("\x1f"), canon)


def replace_pii(df: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``df`` with ``text`` rewritten, and ``entities``: (type, value, surrogate) in order."""
    since = made()
    again = cut(exceptions(df, key, text).select(_item_key(F.col("kind"), F.col("canon")).alias("item"), "draw"), "exceptions")
    release(since, again)
    n = again.count()
    rows = df.drop("entities") if "entities" in df.columns else df
    found = rows.withColumn("_found", entities_of(F.col(text)))
    if not n:
        return _rewritten(found, key, text)
    if n <= MAP_ROWS:
        return _rewritten(found.withColumn("_draws", again.agg(F.map_from_entries(F.collect_list(F.struct("item", "draw"))).alias("draws")).scalar()), key, text)
    # texts that may hold an exception, by a bitmap, are joined; the others stay where they are
    size = min(MAP_BITS, 64 << (n // 4).bit_length())
    at = lambda item: F.pmod(F.xxhash64(item), F.lit(size))
    bits = bitmap(again.select(at(F.col("item"))), size)
    has = lambda item: has_bit(bits, at(item))
    may = F.exists(F.col("_found"), lambda e: F.exists(items_of(e), lambda x: has(_item_key(x["kind"], x["canon"]))))
    found = found.withColumn("_may", F.coalesce(may, F.lit(False)))
    some = cut(found.filter("_may").withColumn("_row", F.monotonically_increasing_id()), "rows")
    items = some.select("_row", F.explode("_found").alias("e")).select("_row", F.explode(items_of(F.col("e"))).alias("x")).select("_row", _item_key(F.col("x.kind"), F.col("x.canon")).alias("item")).distinct()
    draws = items.join(again, "item").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("item", "draw"))).alias("_draws"))
    apart = _rewritten(some.join(draws, "_row", "left").drop("_row", "_may"), key, text)
    return _rewritten(found.filter("not _may").drop("_may"), key, text).unionByName(apart)


def _rewritten(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` (with _found, and _draws where some drew again) rewritten."""
    draw_of = (lambda kind, canon: F.coalesce(F.try_element_at(F.col("_draws"), _item_key(kind, canon)), F.lit(0))) if "_draws" in df.columns else lambda kind, canon: F.lit(0)
    new = df.withColumn("_new", F.transform("_found", lambda e: F.struct(type_of(e).alias("type"), e.alias("value"), surrogate(e, key, draw_of).alias("surrogate"))))
    between = F.split(F.col(text), PATTERN, -1)
    joined = F.concat(F.get(between, F.lit(0)), F.array_join(F.zip_with("_new", F.slice(between, 2, F.size("_found")), lambda s, b: F.concat(s["surrogate"], b)), ""))
    out = new.withColumn(text, F.when(F.size("_found") > 0, joined).otherwise(F.col(text)))
    return out.withColumn("entities", F.coalesce(F.filter("_new", lambda x: x["type"] != "none"), F.array())).drop("_found", "_new", "_draws")
