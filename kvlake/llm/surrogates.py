"""Operator 7, surrogates for personal data. DataFrame functions only.

Detected entities are replaced by keyed surrogates of their own kind and form: an e-mail address keeps its shape, case and
top domain, numbers keep their separators and (if the original is right) their Luhn or mod-97 check digits, addresses become
unrouted ones, names keep gender, script and capitals. A name is replaced word by word: given names and surnames are entities
of their own, so all mentions of one in whatever combination agree. A surrogate is a function of key, kind and normal form, so
mentions of one entity in whatever spelling agree everywhere (coreference) without a join. Distinctness is checked over the
corpus: the different entities, one row each, are grouped by surrogate; whoever shares one, or got the normal form of a
real entity, takes its next attempt until none does. Attempts draw from ever larger spaces, so that ends however many
entities there are. Only these few are looked up when texts are written.

Names are detected by context: a listed given name and what is capitalised after it, capitalised words after a form of
address or a phrase that announces a name; further, in the same text, every word of a name found so. Names without such
a context, and in scripts other than Latin, Cyrillic and Greek, are not found.

Defined results: null text stays null and has no entities; text without entities stays as it is; repeated rows give repeated rows; null
ids are kept; very long texts are searched whole; an empty table gives no rows; only the id and text columns are looked at,
whatever else is there. Detection is by form, so a number that looks like a card or a phone number is taken for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, settle

KEY = "kvlake"
#: Attempts from which on a surrogate's form may grow.
GROWING = 8
#: Rows of texts with second attempts that may be broadcast.
BROADCAST_ROWS = 20_000

#: Given names by script and gender that are given out, more that are only recognised, and syllables of surnames. Fixed values.
GIVEN = {
    ("latin", "f"): ("Alice", "Anna", "Carla", "Clara", "Elena", "Emily", "Emma", "Grace", "Hannah", "Helen", "Ingrid", "Julia", "Laura", "Lucy", "Maria", "Martha", "Nina", "Olivia", "Paula", "Sarah", "Sofia", "Susan", "Teresa", "Ursula"),
    ("latin", "m"): ("Adam", "Albert", "Carlos", "Daniel", "David", "Edward", "Felix", "George", "Henry", "Hugo", "Jacob", "James", "John", "Louis", "Marco", "Martin", "Michael", "Oscar", "Paul", "Peter", "Robert", "Simon", "Thomas", "Walter"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья", "Татьяна"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Дмитрий", "Иван", "Максим", "Николай", "Олег", "Павел", "Сергей"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
}
KNOWN = {
    ("latin", "f"): ("Aisha", "Amelia", "Ana", "Andrea", "Angela", "Barbara", "Camille", "Carmen", "Charlotte", "Chiara", "Christine", "Claire", "Diana", "Elizabeth", "Eva", "Fatima", "Francesca", "Giulia", "Heidi", "Isabel", "Jane", "Jennifer", "Jessica", "Karen", "Katarzyna", "Katharina", "Kate", "Linda", "Lisa", "Lucia", "Margaret", "Marie", "Mary", "Mei", "Monika", "Nancy", "Patricia", "Priya", "Rachel", "Rebecca", "Rosa", "Sandra", "Sophie", "Yuki"),
    ("latin", "m"): ("Ahmed", "Alan", "Alexander", "Ali", "Andrew", "Antonio", "Arjun", "Benjamin", "Brian", "Charles", "Chen", "Christian", "Diego", "Eric", "Francisco", "Frank", "Giovanni", "Hans", "Hiroshi", "Ivan", "Jan", "Jean", "Johannes", "Jorge", "José", "Joseph", "Juan", "Kevin", "Klaus", "Lars", "Luca", "Luis", "Mark", "Matthew", "Mohammed", "Muhammad", "Omar", "Pablo", "Patrick", "Pierre", "Rahul", "Richard", "Stefan", "Steven", "Wei", "William"),
    ("cyrillic", "f"): ("Екатерина", "Наталья", "Светлана"),
    ("cyrillic", "m"): ("Алексей", "Владимир", "Михаил"),
}
SYLLABLES = {
    "latin": ("bar", "bel", "cor", "dan", "fen", "gar", "hal", "ker", "lin", "mar", "nor", "pel", "ros", "sel", "tan", "ver"),
    "cyrillic": ("бар", "вел", "гор", "дан", "зар", "кар", "лен", "мар", "нов", "пол", "рос", "сел", "тар", "фед", "чер", "шар"),
    "greek": ("βαρ", "γαλ", "δημ", "θαν", "καρ", "λεν", "μαρ", "νικ", "παπ", "ραλ", "σαρ", "τασ", "φιλ", "χαρ", "ζαρ", "κον"),
}
#: Forms of address, phrases that announce a name, and words within names. Fixed values.
ADDRESS = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Lady", "Herr", "Herrn", "Frau", "Señor", "Señora", "Sr", "Sra", "Don", "Doña", "Monsieur", "Madame", "Mme", "Mlle", "господин", "госпожа", "Κύριος", "Κυρία")
ANNOUNCE = ("my name is", "My name is", "name:", "Name:", "Dear", "Regards,", "regards,", "signed by", "Signed by", "written by", "Written by", "Author:", "Contact:", "heiße", "me llamo", "Me llamo", "je m'appelle", "меня зовут", "Меня зовут", "με λένε")
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "la", "le", "bin", "al", "ben", "zu")

_LISTED = [n for t in (GIVEN, KNOWN) for names in t.values() for n in names]
_NAMES = "|".join([*_LISTED, *(n.upper() for n in _LISTED)])
_WORD = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*+(?![\p{L}\p{N}])"
_MORE = rf"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Forms of entities, tried in this order where a token begins.
FORMS = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z]{4})?(?: ?\d{4}){2,6}(?: ?\d{1,3})?(?![\p{L}\p{N}])",
    "card": r"\d{4}(?:\d{9,12}|(?: \d{4}){3}|(?:-\d{4}){3})(?![\p{L}\p{N}])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "phone": r"(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,4}|\(\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]?\d{3,4})|\d{3}[-.]\d{3}[-.]\d{4})(?![\p{L}\p{N}])",
    "secret": r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,64})(?![\p{L}\p{N}])",
    "name": rf"(?=\p{{Lu}})(?:(?:{_NAMES}){_MORE}{{1,3}}|(?<=(?<!\p{{L}})(?:{'|'.join(ADDRESS)})\.? ){_WORD}{_MORE}{{0,2}}|(?<=(?<!\p{{L}})(?:{'|'.join(ANNOUNCE)}) ){_WORD}{_MORE}{{1,2}})",
}
_BEGIN = r"(?<![\p{L}\p{N}._%+@-])"
ENTITY = _BEGIN + r"(?=[\p{L}\p{N}(+._%-])(?:" + "|".join(FORMS.values()) + ")"


def kind_of(entity: Column) -> Column:
    """Names are what is found but has no other form, as their context stands outside them."""
    out = F.lit("name")
    for kind, form in reversed([x for x in FORMS.items() if x[0] != "name"]):
        out = F.when(F.rlike(entity, F.lit(f"^(?:{form})$")), F.lit(kind)).otherwise(out)
    return out


def normal(entity: Column, kind: Column) -> Column:
    """What all spellings of one entity have in common."""
    return F.when(kind == "email", F.lower(entity)).when(kind.isin("card", "ssn", "phone", "iban"), F.regexp_replace(entity, "[^0-9A-Z]", "")).otherwise(entity)


class _Draw:
    """Keyed numbers for an entity: draw(i, n) is in 0..n-1."""

    def __init__(self, key: str, kind: Column, norm: Column, attempt: Column):
        self.seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)

    def __call__(self, i: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(self.seed, i), F.lit(n)).cast("int")


def _letters(text: Column, draw: _Draw, keep_after: Column) -> Column:
    """Letters and digits replaced by others of their class, what stands after position keep_after kept."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda s: F.substring(F.lit(s), draw(i, len(s)) + 1, F.lit(1))
        new = F.when(F.rlike(c, F.lit("[0-9]")), pick("0123456789")).when(F.rlike(c, F.lit(r"\p{Lu}")), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(F.rlike(c, F.lit(r"\p{L}")), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)
        return F.when(i < keep_after, new).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex(text: Column, draw: _Draw) -> Column:
    def one(c: Column, i: Column) -> Column:
        pick = lambda s: F.substring(F.lit(s), draw(i, 16) + 1, F.lit(1))
        return F.when(F.upper(text) == text, pick("0123456789ABCDEF")).otherwise(pick("0123456789abcdef"))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last one not doubled."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    step = lambda m, c: F.when(F.rlike(c, F.lit("[0-9]")), m * 10 + F.ascii(c) - 48).otherwise(m * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _digits(n: Column, draw: _Draw) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: draw(i, 10).cast("string")), "")


def _card(norm: Column, draw: _Draw) -> Column:
    body = F.concat(F.substring(norm, F.lit(1), F.lit(1)), _digits(F.length(norm) - 2, draw))
    right = lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
    wrong = lambda b: F.concat(b, draw(F.lit(0), 10).cast("string"))
    return let(body, lambda b: F.when(_luhn(norm) % 10 == 0, right(b)).otherwise(wrong(b)))


def _iban(norm: Column, draw: _Draw) -> Column:
    country = F.substring(norm, F.lit(1), F.lit(2))
    body = let(F.substring(norm, F.lit(5), F.length(norm)), lambda b: _letters(b, draw, F.length(b)))
    check = lambda b: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0")
    return let(body, lambda b: F.concat(country, F.when(_mod97(norm) == 1, check(b)).otherwise(_digits(F.lit(2), draw)), b))


def _script(word: Column) -> Column:
    return F.when(F.rlike(word, F.lit(r"\p{IsCyrillic}")), F.lit("cyrillic")).when(F.rlike(word, F.lit(r"\p{IsGreek}")), F.lit("greek")).otherwise(F.lit("latin"))


#: Alphabets by script.
LETTERS = {"latin": "".join(map(chr, range(0x61, 0x7B))), "cyrillic": "".join(map(chr, range(0x430, 0x450))), "greek": "".join(map(chr, range(0x3C3, 0x3CA)))}


def _ending(script: str, draw: _Draw, attempt: Column) -> Column:
    """Three more letters with each attempt from GROWING on: names don't run out however few there are to draw from."""
    n = 3 * (attempt - (GROWING - 1))
    drawn = lambda i: F.substring(F.lit(LETTERS[script]), draw(-i, len(LETTERS[script])) + 1, F.lit(1))
    return F.when(attempt >= GROWING, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), drawn), "")).otherwise(F.lit(""))


def _picks(values: tuple[str, ...], draw: _Draw, n: Column, between: str) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*[F.lit(x) for x in values]), draw(i, len(values)) + 1)), between)


def _given(norm: Column, draw: _Draw, attempt: Column) -> Column:
    """A given name of the same gender and script, a compound of more from attempt GROWING on; an unlisted name's gender goes by its ending."""
    listed = lambda k: F.array(*[F.lit(n) for n in GIVEN[k] + KNOWN.get(k, ())])
    f = [k for k in GIVEN if k[1] == "f"]
    female = F.array_contains(F.flatten(F.array(*[listed(k) for k in f])), norm)
    male = F.array_contains(F.flatten(F.array(*[listed(k) for k in GIVEN if k[1] == "m"])), norm)
    female = female | (~male & F.rlike(norm, F.lit("[aаяαηά]$")))
    out = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        out = F.when((_script(norm) == script) & (female if gender == "f" else ~female), F.concat(_picks(names, draw, F.greatest(attempt - (GROWING - 2), F.lit(1)), "-"), _ending(script, draw, attempt))).otherwise(out)
    return out


def _surname(norm: Column, draw: _Draw, attempt: Column) -> Column:
    """Four syllables of the same script, one more with each attempt."""
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        out = F.when(_script(norm) == script, F.initcap(F.concat(_picks(syllables, draw, attempt + 4, ""), _ending(script, draw, attempt)))).otherwise(out)
    return out


def surrogate(kind: Column, norm: Column, attempt: Column, key: str = KEY) -> Column:
    """The normal form of an entity's surrogate."""
    draw = _Draw(key, kind, norm, attempt)
    digits = lambda first: F.concat(first, _digits(F.length(norm) - 1, draw))
    octets = F.concat_ws(".", *[(draw(F.lit(i), 16) + 240 if i == 0 else draw(F.lit(i), 256)).cast("string") for i in range(4)])
    top = F.length(norm) - F.length(F.substring_index(norm, ".", -1))
    # forms of fixed size may run out of values: late attempts lengthen them
    longer = lambda c: F.when(attempt >= GROWING, F.concat(c, _digits(F.greatest(4 * (attempt - (GROWING - 1)), F.lit(1)), draw))).otherwise(c)
    return (
        F.when(kind == "given", _given(norm, draw, attempt))
        .when(kind == "surname", _surname(norm, draw, attempt))
        .when(kind == "email", F.when(attempt >= GROWING, F.concat(F.lit("x"), longer(F.lit("")), _letters(norm, draw, top))).otherwise(_letters(norm, draw, top)))
        .when(kind == "card", longer(_card(norm, draw)))
        .when(kind == "iban", longer(_iban(norm, draw)))
        .when(kind == "ssn", longer(digits(F.lit("9"))))
        .when(kind == "phone", longer(digits(F.substring(norm, F.lit(1), F.lit(1)))))
        .when(kind == "ip", longer(octets))
        .when((kind == "secret") & F.rlike(norm, F.lit("^[0-9a-fA-F]+$")), longer(_hex(norm, draw)))
        .when(kind == "secret", longer(F.concat(F.substring(norm, F.lit(1), F.lit(4)), let(F.substring(norm, F.lit(5), F.length(norm)), lambda b: _letters(b, draw, F.length(b))))))
        .otherwise(norm)
    )


def _form(entity: Column, kind: Column, new: Column) -> Column:
    """A surrogate's normal form in the spelling of the entity it replaces."""
    nth = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9A-Z]", ""))
    spaced = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(F.rlike(c, F.lit("[0-9A-Z]")), F.substring(new, nth(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(F.rlike(c, F.lit(r"\p{Lu}")), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    more = lambda out, n: F.concat(out, F.substring(new, n + 1, F.length(new)))
    spaced, cased = more(spaced, nth(F.length(entity))), more(cased, F.length(entity))
    shouted = (kind.isin("given", "surname")) & (F.upper(entity) == entity) & (F.length(entity) > 1)
    out = F.when(kind.isin("card", "ssn", "phone", "iban"), spaced).when((kind == "email") & (F.lower(entity) != entity), cased)
    return out.when(shouted, F.upper(new)).otherwise(new)


def entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, pattern, found): found is an array of (entity, kind, words), empty for most texts; pattern finds them.

    words are what is replaced, as (word, kind, norm): an entity itself, or the words of a name.
    """
    text = F.coalesce(text_col, F.lit(""))
    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("raw"))
    one = one.withColumn("raw", F.transform("raw", lambda e: let(kind_of(e), lambda k: F.struct(e.alias("entity"), k.alias("kind")))))
    # the words of names that stand for themselves elsewhere in the text; the last one is the surname
    upper = lambda words: F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    titled = lambda w: F.initcap(F.lower(w))
    named = F.transform(F.filter("raw", lambda e: e["kind"] == "name"), lambda e: upper(F.split(e["entity"], " ")))
    one = one.withColumn("names", named).withColumn("parts", F.array_distinct(F.flatten("names")))
    one = one.withColumn("givens", F.transform(F.flatten(F.transform("names", lambda w: F.slice(w, F.lit(1), F.size(w) - 1))), titled))
    parts = F.array_join(F.flatten(F.transform("parts", lambda w: F.array(w, titled(w), F.upper(w)))), "|")
    pattern = F.when(F.size("parts") > 0, F.concat(F.lit(ENTITY + "|" + _BEGIN + "(?:"), parts, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ENTITY))
    one = one.withColumn("pattern", pattern)
    again = F.transform(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), lambda e: let(kind_of(e), lambda k: F.struct(e.alias("entity"), k.alias("kind"))))
    all_found = F.when(F.size("parts") > 0, again).otherwise(F.col("raw"))

    def words(e: Column) -> Column:
        own = F.split(e["entity"], " ")

        def word(w: Column, i: Column) -> Column:
            last = i == F.size(own) - 1
            given = F.when(F.size(own) > 1, ~last).otherwise(F.array_contains("givens", titled(w)))
            kind = F.when(~F.rlike(w, F.lit(r"^\p{Lu}")), F.lit("particle")).when(given, F.lit("given")).otherwise(F.lit("surname"))
            return F.struct(w.alias("word"), kind.alias("kind"), F.when(kind == "particle", w).otherwise(titled(w)).alias("norm"))

        return F.when(e["kind"] == "name", F.transform(own, word)).otherwise(F.array(F.struct(e["entity"].alias("word"), e["kind"].alias("kind"), normal(e["entity"], e["kind"]).alias("norm"))))

    return one.select("id", "text", "pattern", F.transform(all_found, lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), words(e).alias("words"))).alias("found"))


def second_attempts(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt): the entities whose first surrogate another entity has or is."""
    every = found.select(F.explode(F.flatten(F.transform("found", lambda e: e["words"]))).alias("e")).groupBy("e.kind", "e.norm").agg(F.lit(0).alias("attempt")).where("kind <> 'particle'")
    draw = lambda rows: rows.select("kind", "norm", "attempt", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key).alias("new"))
    every = settle(draw(every))
    while True:
        nth = F.row_number().over(Window.partitionBy("kind", "new").orderBy("attempt", "norm"))
        real = every.select(F.col("kind").alias("k"), F.col("norm").alias("n"))
        ranked = every.withColumn("nth", nth)
        judged = ranked.join(real, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("n")), "left").select("kind", "norm", "attempt", "new", ((F.col("nth") > 1) | F.col("n").isNotNull()).alias("clash"))
        judged = settle(judged)
        if judged.where("clash").isEmpty():
            return every.where("attempt > 0").select("kind", "norm", "attempt")
        again = draw(judged.where("clash").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        every = settle(judged.where(~F.col("clash")).drop("clash").unionByName(again))


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(id, text, n_entities, kinds, surrogates): the text with surrogates, and what stands in it in order."""
    found = entities(docs, id_col, text_col)
    again = settle(second_attempts(found.where(F.size("found") > 0), key))
    if again.isEmpty():
        rows = found.withColumn("tries", F.lit(None).cast("map<string,int>"))
    else:
        mentions = found.select(F.xxhash64("text").alias("t"), F.explode(F.flatten(F.transform("found", lambda e: e["words"]))).alias("e")).select("t", "e.kind", "e.norm").distinct().join(again, ["kind", "norm"])
        tries = settle(mentions.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "norm"), "attempt"))).alias("tries")))
        rows = found.join(F.broadcast(tries) if tries.count() <= BROADCAST_ROWS else tries, F.xxhash64("text") == F.col("t"), "left").drop("t")

    def new(w: Column, tries: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(tries, F.concat_ws(":", w["kind"], w["norm"])), F.lit(0))
        return let(let(attempt, lambda a: surrogate(w["kind"], w["norm"], a, key)), lambda s: _form(w["word"], w["kind"], s))

    written = F.transform("found", lambda e: F.array_join(F.transform(e["words"], lambda w: new(w, F.col("tries"))), " "))
    rows = rows.select("id", "text", "pattern", "found", written.alias("surrogates"))
    gaps = F.when(F.size("found") > 0, F.split("text", F.col("pattern"))).otherwise(F.array("text"))
    body = F.array_join(F.zip_with(gaps, "surrogates", lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.size("found") > 0, body).otherwise(F.col("text")).alias(text_col),
        F.size("found").alias("n_entities"),
        F.transform("found", lambda e: e["kind"]).alias("kinds"),
        "surrogates",
    )
