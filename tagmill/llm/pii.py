"""Personal data: keyed surrogates of the same type, gender, script and format, checked for collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import bind, discard, split_join, stash

#: Fixed titles; they carry the gender of a name, or say nothing of it.
MALE = ("Mr", "Sir", "Sr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος", "السيد", "श्री")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Sra", "Frau", "Fräulein", "Madame", "Mme", "Señora", "Госпожа", "Κυρία", "السيدة", "श्रीमती")
NEUTRAL = ("Dr", "Prof", "Доктор")


def _titles(*titles: str) -> str:
    return "(?:" + "|".join(sorted(titles, key=len, reverse=True)) + r")\.? "


#: Fixed words that stand before a family name, and capitalised words that are no names.
PARTICLES = "al auf bin da das de del della den der di do dos du el ibn la las le lo los ter ten van vom von zu zum zur".split()
DAYS = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai Juni Juli Oktober Dezember"
).split()
_TOKEN = rf"(?!(?:{'|'.join(DAYS)})(?!\p{{L}}))(?:\p{{Lu}}[\p{{L}}'’-]{{1,40}}+|[\p{{Lo}}\p{{M}}]{{2,40}}+)"
_INITIAL = r"(?:\p{Lu}\.-?){1,3}"
_BEFORE = rf"(?:(?:{_INITIAL}|{'|'.join(PARTICLES)}) ){{0,3}}"
_LEAD = f"(?:{_titles(*MALE, *FEMALE, *NEUTRAL)})+"

#: Fixed patterns, in order of precedence. All start where no word, address or number goes on.
PATTERNS = {
    "email": r"[\p{L}\p{M}\p{N}._%+-]{1,64}+@[\p{L}\p{M}\p{N}-]{1,63}+(?:\.[\p{L}\p{M}\p{N}-]{1,63}+){1,8}+",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|\(\d{3}\) \d{3}-\d{4}(?!\w)",
    "key": r"AKIA[0-9A-Z]{16}(?!\w)|password=[^\s\"']{4,64}+",
    "name": rf"{_LEAD}{_BEFORE}{_TOKEN}(?: {_BEFORE}{_TOKEN}){{0,2}}+",
}
PATTERN = r"(?<![\p{L}\p{N}_.%+@-])(?:" + "|".join(PATTERNS.values()) + ")"

#: Fixed lists of given names by script and gender, and of syllables for family names.
NAMES = {
    ("latin", "male"): "Adam Alan Anton Boris Carl David Emil Erik Felix Frank Georg Hugo Ivan Jonas Karl Leon Lukas Marc Martin Oscar Paul Peter Robert Simon Thomas Victor".split(),
    ("latin", "female"): "Alice Anna Bella Carla Clara Diana Elena Emma Eva Flora Greta Helen Ida Irene Julia Laura Lena Lucy Maria Martha Nina Nora Olga Paula Rosa Sara".split(),
    ("cyrillic", "male"): "Адам Антон Борис Виктор Глеб Давид Денис Егор Иван Игорь Кирилл Максим Марк Олег Павел Пётр Роман Семён".split(),
    ("cyrillic", "female"): "Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Клара Лидия Мария Нина Ольга Раиса Софья Юлия".split(),
    ("greek", "male"): "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Χρήστος".split(),
    ("greek", "female"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("arabic", "male"): "أحمد حسن خالد سامي عمر كريم ماجد يوسف".split(),
    ("arabic", "female"): "أمل زينب سارة عائشة فاطمة ليلى مريم هدى".split(),
    ("devanagari", "male"): "अजय अमित अनिल दीपक मोहन राजेश सुरेश विजय".split(),
    ("devanagari", "female"): "अनीता आशा गीता कविता मीरा रेखा सीता सुनीता".split(),
}
SYLLABLES = {
    "latin": "bar bel cor dan del fer gar hal jor kel lam lin mar mer nor pel ran rol sal sten tor val ver wil".split(),
    "cyrillic": "бар вел гор дан ерм жук зор кор лам лин мар мер нор пел ран рол сал тор фед хар".split(),
    "greek": "βαρ γαλ δημ καλ λαμ μαν νικ παπ ραλ σταθ ταν χαρ".split(),
    "arabic": "بار حام دان راس سال شام طار عاد قاس كار مال نار".split(),
    "devanagari": "अग कर खन गुप चोप जोश तिव दव नाय पट मल शर".split(),
}
#: Fixed endings of given names made of syllables, for women.
ENDINGS = {"latin": "a", "cyrillic": "а", "greek": "α", "arabic": "ة", "devanagari": "ा"}
#: Fixed ranges of characters that replace one another: digits, then letters by script and case.
RANGES = (
    (0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0xDF, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE), (0x430, 0x44F), (0x410, 0x42F), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9),
    (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
#: In secrets, signs replace one another too, and what is in no range becomes a small letter.
SIGNS = ((0x23, 0x26), (0x2A, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Fixed country calling codes of one and two digits; all others have three.
CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
PEOPLE, NUMBERS = ("male", "female", "person"), ("phone", "card", "ssn", "iban")


def kind_of(value: Column) -> Column:
    """The type of a match, by what tells the patterns apart."""
    return (
        F.when(value.startswith("password=") | value.rlike("^AKIA[0-9A-Z]{16}$"), "key").when(value.contains("@"), "email").when(value.rlike(r"^[A-Z]{2}\d"), "iban")
        .when(value.rlike(r"^\d{1,3}\."), "ip").when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(r"^[+(]"), "phone").when(value.rlike(r"^\d"), "card")
        .when(value.rlike(rf"^(?:{_titles(*NEUTRAL)})*{_titles(*MALE)}"), "male").when(value.rlike(rf"^(?:{_titles(*NEUTRAL)})*{_titles(*FEMALE)}"), "female").otherwise("person")
    )


def lead(value: Column) -> Column:
    """What stands in a match before the entity itself: titles, or the word password=."""
    return F.regexp_extract(value, rf"^(?:{_LEAD}|password=)", 0)


def body(value: Column) -> Column:
    return F.substring(value, F.length(lead(value)) + 1, F.length(value))


def _identity(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity: case folds in addresses and separators don't count in numbers."""
    digits = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    return F.when(kind == "key", body(value)).when(kind == "email", F.lower(value)).when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits)).when(kind.isin(*NUMBERS), digits).otherwise(value)


def _is_name(word: Column) -> Column:
    """Neither an initial nor a word that stands before a family name."""
    return ~F.lower(word).isin(*PARTICLES) & ~word.rlike(f"^{_INITIAL}$")


def givens(words: Column) -> Column:
    """The given names among the words of a name: all but the last that are names."""
    return F.filter(F.slice(words, F.lit(1), F.size(words) - 1), _is_name)


def entities(kind: Column, value: Column, gendered: Column) -> Column:
    """The entities of a mention, an array of (kind, ident, of): of a name one for each word, else one.

    The last word of a name is its family name, the names before it are given names, each of the family `of`. Case folds, so a family name
    has one surrogate with or without title or given name. A given name without a gender takes the one that
    gendered, an array of (given, kind), has for it in the same text. Initials and particles are parts of their own.
    """
    one = lambda k, i, of="": F.struct(k.alias("kind"), i.alias("ident"), (of if isinstance(of, Column) else F.lit(of)).alias("of"))

    def name(words: Column) -> Column:
        family = F.lower(F.element_at(words, -1))

        def part(w: Column, i: Column) -> Column:
            known = F.try_element_at(F.filter(gendered, lambda g: g["given"] == F.lower(w)), F.lit(1))["kind"]
            given = one(F.when(kind == "person", F.coalesce(known, kind)).otherwise(kind), F.lower(w), family)
            return F.when(i == F.size(words) - 1, one(F.lit("family"), family)).when(_is_name(w), given).when(F.lower(w).isin(*PARTICLES), one(F.lit("particle"), w)).otherwise(one(F.lit("initial"), F.lower(w)))

        return F.transform(words, part)

    return F.when(kind.isin(*PEOPLE), bind(F.split(body(value), " "), name)).otherwise(F.array(one(kind, _identity(kind, value))))


def _bytes(secret: str, kind: Column, ident: Column, attempt: Column) -> Column:
    hexed = F.sha2(F.concat_ws("|", F.lit(secret), kind, ident, attempt.cast("string")), 512)
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _ciphered(value: Column, stream: Column, keep: Column, all_of_it: Column) -> Column:
    """Each character past the first `keep` replaced within its own range; others stay, or are replaced as well if all of it is secret."""

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        within = F.lit(None).cast("struct<low:int,size:int>")
        pair = lambda low, high: F.struct(F.lit(low).alias("low"), F.lit(high - low + 1).alias("size"))
        for low, high in SIGNS:
            within = F.when(all_of_it & code.between(low, high), pair(low, high)).otherwise(within)
        for low, high in RANGES:
            within = F.when(code.between(low, high), pair(low, high)).otherwise(within)
        within = F.coalesce(within, F.when(all_of_it, pair(0x61, 0x7A)))
        k = F.element_at(stream, (i % 63 + 1).cast("int")) * 251 + F.element_at(stream, (i % 61 + 2).cast("int")) + F.floor(i / 61).cast("int")
        new = within["low"] + F.pmod(code + k, within["size"])
        return F.when((i < keep) | within.isNull(), c).otherwise(F.decode(F.unhex(F.lpad(F.hex(new.cast("long")), 4, "0")), "UTF-16BE"))

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """The last digit that makes the digits before it and itself pass the card check."""
    front = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    twice = lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(F.filter(F.split(front, ""), lambda c: c != ""), twice), F.lit(0), lambda x, v: x + v)
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _checked_iban(code: Column) -> Column:
    """The account with the two check digits that make the whole 1 modulo 97, letters counting 10 to 35."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda x, c: (x * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substring(code, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(code, F.lit(5), F.length(code)))


def surrogate(secret: str, kind: Column, ident: Column, attempt: Column) -> Column:
    """The replacement of an entity's identity at the given attempt; keyed, so it can't be undone without the secret."""
    drawn_from = F.struct(_bytes(secret, kind, ident, attempt).alias("b"), kind.alias("k"), ident.alias("i"), attempt.alias("a"))
    return bind(drawn_from, lambda x: _drawn(secret, x["b"], x["k"], x["i"], x["a"]))


def _drawn(secret: str, stream: Column, kind: Column, ident: Column, attempt: Column) -> Column:
    def number(i: int) -> Column:
        return F.element_at(stream, i) * 256 + F.element_at(stream, i + 1)

    def pick(i: int, values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), number(i) % len(values) + 1)

    # One cipher serves addresses' local parts, numbers, keys and names in other scripts; some formats keep their first characters.
    # After a few attempts, what has no fixed length grows.
    longer = F.when(kind.isin("email", "key"), F.repeat(F.lit("a"), F.floor(attempt / 4).cast("int"))).otherwise("")
    plain = F.when(kind == "email", F.regexp_extract(ident, "^[^@]*", 0)).when(kind == "phone", F.ltrim(ident, F.lit("+"))).otherwise(ident)
    code = F.when(~ident.startswith("+"), 0).when(plain.rlike("^[17]"), 1).when(plain.substr(1, 2).isin(*CODES), 2).otherwise(3)
    keep = F.when(kind == "phone", code).when(kind == "card", 1).when(kind == "iban", 2).when((kind == "key") & ident.startswith("AKIA"), 4).otherwise(0)
    ciphered = _ciphered(F.concat(plain, longer), stream, keep, kind == "key")
    hidden = F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit("domain"), F.regexp_extract(ident, "@(.*)$", 1), F.floor(attempt / 4).cast("string")), 256), 1, 8)

    # Private, loopback and link-local addresses stay in their block, others outside all of them.
    octet = [F.split(ident, r"\.")[k].cast("int") for k in range(4)]
    drawn = [number(2 * k + 1) % 254 + 1 for k in range(4)]
    public = number(9) % 78 + 11  # 11 to 88
    first = F.when(octet[0].isin(10, 127), octet[0]).when((octet[0] == 192) & (octet[1] == 168) | (octet[0] == 169) & (octet[1] == 254), octet[0]).when((octet[0] == 172) & octet[1].between(16, 31), 172).otherwise(public)
    second = F.when((octet[0] == 192) & (octet[1] == 168) | (octet[0] == 169) & (octet[1] == 254), octet[1]).when((octet[0] == 172) & octet[1].between(16, 31), 16 + drawn[1] % 16).otherwise(drawn[1])
    address = F.concat_ws(".", *[c.cast("string") for c in (first, second, drawn[2], drawn[3])])

    def name(script: str) -> Column:
        syllable = [pick(k, SYLLABLES[script]) for k in range(10, 26, 2)]
        more = F.array_join(F.slice(F.array(*syllable[2:]), F.lit(1), F.least(F.lit(6), F.when(number(40) % 2 == 0, 1).otherwise(0) + F.ceil(attempt / 2).cast("int"))), "")
        made = F.concat(F.initcap(F.concat(syllable[0], syllable[1])), more)
        men, women = NAMES[script, "male"], NAMES[script, "female"]
        listed = F.when(kind == "male", pick(30, men)).when(kind == "female", pick(30, women)).otherwise(pick(30, men + women))
        return F.when(kind == "family", made).when(attempt == 0, listed).otherwise(F.concat(made, F.when(kind == "female", ENDINGS[script]).otherwise("")))

    names = F.when(ident.rlike(r"\p{IsLatin}"), name("latin"))
    for script in ("cyrillic", "greek", "arabic", "devanagari"):
        names = names.when(ident.rlike(rf"\p{{Is{script.title()}}}"), name(script))
    return (
        F.when(kind == "email", F.concat(ciphered, F.lit("@d"), hidden, F.lit(".example."), pick(60, ["com", "net", "org"])))
        .when(kind == "ip", address).when(kind == "card", _luhn(ciphered)).when(kind == "iban", _checked_iban(ciphered))
        .when(kind == "particle", ident).when(kind.isin("phone", "ssn", "key", "initial"), ciphered).otherwise(names.otherwise(ciphered))
    )


def rendered(kind: Column, value: Column, drawn: Column) -> Column:
    """The replacements of a mention's entities in its own format: its title, its separators for numbers, its case for names and addresses."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    at = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"[^0-9A-Za-z]", ""))
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9A-Za-z]$"), F.substring(drawn[0], at(i), F.lit(1))).otherwise(c)), "")
    case = lambda w, r: F.when((w == F.upper(w)) & (w != F.lower(w)), F.upper(r)).otherwise(r)
    name = F.array_join(F.zip_with(F.split(body(value), " "), drawn, case), " ")
    return F.when(kind.isin(*PEOPLE), F.concat(lead(value), name)).when(kind == "key", F.concat(lead(value), drawn[0])).when(kind.isin(*NUMBERS), filled).when(kind == "email", case(value, drawn[0])).otherwise(drawn[0])


def mentions(text: Column, pattern: Column) -> Column:
    """An array of (kind, value) of all matches, in order."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.transform(found, lambda value: F.struct(kind_of(value).alias("kind"), value.alias("value")))


def _named_too(found: Column) -> Column:
    """The pattern, and for a text with names also their family names without a title, after their given name or alone, in their own case or in capitals."""
    words = F.transform(F.filter(found, lambda m: m["kind"].isin(*PEOPLE)), lambda m: F.split(body(m["value"]), " "))
    either = lambda ws: F.array_join(F.transform(F.array_distinct(F.flatten(F.transform(ws, lambda w: F.array(w, F.upper(w), F.initcap(w))))), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    families = F.filter(F.transform(words, lambda w: F.element_at(w, -1)), lambda w: F.length(w) > 2)
    first = F.flatten(F.transform(words, givens))
    known = F.concat(F.when(F.size(first) > 0, F.concat(either(first), F.lit("|"))).otherwise(F.lit("")), F.lit(f"{_INITIAL}|{'|'.join(PARTICLES)}"))
    extra = F.concat(F.lit(r"|(?<![\p{L}\p{N}_@.-])(?:(?:"), known, F.lit(") ){0,4}(?:"), either(families), F.lit(r")(?![\p{L}\p{N}_@])"))
    return F.when(F.size(families) > 0, F.concat(F.lit(f"(?:{PATTERN})"), extra)).otherwise(F.lit(PATTERN))


def draw_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, ident, attempt) of entities (kind, ident) that need another draw than the first.

    A surrogate is refused if it is an entity of the corpus, or if another entity of the same kind (of any gender) holds it; the smaller
    (attempt, identity) keeps it and the other draws again, until no two agree. Only those refused are carried on. It
    raises an error if a fixed format has too few values for the corpus's entities (like more than half of all 65,536
    addresses 192.168.x.x); names, addresses and secrets grow, and so always end.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = stash(entities.distinct(), "entities")
    family = F.when(F.col("kind").isin(*PEOPLE), "given").otherwise(F.col("kind"))
    plain = F.when(F.col("kind") == "phone", F.ltrim("ident", F.lit("+"))).otherwise(F.col("ident"))
    originals = entities.select(family.alias("family"), F.lower(plain).alias("low")).distinct()

    def draw(rows: DataFrame) -> DataFrame:
        # Few bytes but much to compute: dealt out where it is computed, as small files are read together.
        rows = rows.repartition(tasks, "kind", "ident").withColumn("drawn", surrogate(secret, F.col("kind"), F.col("ident"), F.col("attempt")))
        return rows.withColumn("low", F.when(F.col("kind") == "key", F.col("drawn")).otherwise(F.lower("drawn")))

    drawn = stash(draw(entities.withColumn("family", family).withColumn("attempt", F.lit(0))), "drawn")
    for _ in range(200):
        taken = drawn.join(originals, ["family", "low"], "left_semi").select("kind", "ident")
        again = drawn.groupBy("family", "low").agg(F.min(F.struct("attempt", "kind", "ident")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
        twice = drawn.join(again, ["family", "low"]).where(~(F.struct("attempt", "kind", "ident") == F.col("first"))).select("kind", "ident")
        refused = stash(taken.union(twice).distinct(), "refused")
        if refused.isEmpty():
            return drawn.where("attempt > 0").select("kind", "ident", "attempt")
        kept = drawn.join(refused, ["kind", "ident"], "left_anti")
        fresh = draw(drawn.join(refused, ["kind", "ident"], "left_semi").select("kind", "ident", "family", (F.col("attempt") + 1).alias("attempt")))
        before, drawn = drawn, stash(kept.unionByName(fresh), "drawn")
        discard(before, refused)
    raise RuntimeError("no distinct surrogates: a kind's format leaves too few values for its entities")


def replace_entities(docs: DataFrame, secret: str) -> DataFrame:
    """One row per row of docs: doc_id, text with surrogates, n_entities, kinds (an array of the mentions' kinds in order).

    Mentions are found by one pattern: addresses, account, card, phone and security numbers, IPv4 addresses, secrets, and names
    after a title; a text with such names is searched again for their family names without one. A surrogate depends on
    the secret, the entity's kind and its identity only, so all its mentions, in any document, get the same one, rendered in
    each mention's format: gender, script, case, country codes, check digits, private networks and separators stay. The words of a name
    are entities each, so a family name keeps one surrogate with any given name, title or case; up to three names with initials and particles
    between them make one mention. Initials are enciphered alone, particles stay. A given name that stands after a title
    without a gender has the gender that a title gives the same given and family name in any document.
    Distinct entities get distinct surrogates that are no entity of the corpus. Names that no title ever introduces in
    their text are not found. Texts without entities are never shuffled; those with some are written once, and only the
    few whose entities drew more than once are joined with those draws.

    Null and empty texts come back as they are, with no entities. Repeated rows are treated alike; very long texts are read whole. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text"))
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    clean = rows.where(~has).select("doc_id", "text", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    dirty = rows.where(has).withColumn("found", mentions(F.col("text"), F.lit(PATTERN))).withColumn("pattern", _named_too(F.col("found")))
    dirty = dirty.withColumn("found", F.when(F.col("pattern") == PATTERN, F.col("found")).otherwise(mentions(F.col("text"), F.col("pattern"))))
    titled = F.flatten(F.transform(F.filter("found", lambda m: m["kind"].isin("male", "female")), lambda m: F.transform(givens(F.split(body(m["value"]), " ")), lambda g: F.struct(F.lower(g).alias("given"), m["kind"].alias("kind")))))
    dirty = dirty.withColumn("gendered", titled)
    parts = F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value"), entities(m["kind"], m["value"], F.col("gendered")).alias("parts")))
    dirty = stash(dirty.withColumn("found", parts).drop("gendered").withColumn("row", F.monotonically_increasing_id()), "dirty")
    flat = dirty.select("row", F.explode(F.flatten(F.transform("found", lambda m: m["parts"]))).alias("e")).select("row", "e.*").where("kind not in ('particle', 'initial')").distinct()
    flat = stash(flat.withColumn("new", F.col("kind")), "mentions")
    count = flat.count()
    # A person without a gender has the one that a title gives the same given and family name anywhere.
    genders = flat.where("kind in ('male', 'female') and of <> ''").groupBy("ident", "of").agg(F.min("kind").alias("gender"))
    persons = split_join(flat.where("kind = 'person'"), genders, ["ident", "of"], count, "left").withColumn("new", F.coalesce("gender", "kind")).drop("gender")
    named = stash(flat.where("kind <> 'person'").unionByName(persons), "mentions")
    redrawn = draw_surrogates(named.select(F.col("new").alias("kind"), "ident"), secret)
    others = split_join(named, redrawn.withColumnRenamed("kind", "new"), ["new", "ident"], count, "left").where("attempt is not null or new <> kind")
    others = others.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "ident", "of"), F.struct("new", F.coalesce("attempt", F.lit(0)).alias("attempt"))))).alias("others"))
    joined = dirty.join(others, "row", "left")

    def drawn(e: Column) -> Column:
        key = F.struct(e["kind"].alias("kind"), e["ident"].alias("ident"), e["of"].alias("of"))
        return bind(F.element_at("others", key), lambda o: surrogate(secret, F.coalesce(o["new"], e["kind"]), e["ident"], F.coalesce(o["attempt"], F.lit(0))))

    new = F.transform("found", lambda m: bind(F.struct(m["kind"].alias("k"), m["value"].alias("v"), F.transform(m["parts"], drawn).alias("r")), lambda x: rendered(x["k"], x["v"], x["r"])))
    gaps = F.split("text", F.col("pattern"), -1)
    text = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("found")), new, lambda g, n: F.concat(g, n)), ""), F.element_at(gaps, -1))
    done = joined.select("doc_id", text.alias("text"), F.size("found").alias("n_entities"), F.transform("found", lambda m: m["kind"]).alias("kinds"))
    return clean.unionByName(done)
