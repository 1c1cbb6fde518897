"""Keyed surrogates for personal data, in DataFrame functions alone.

Entities are found by one pattern. The distinct ones of the whole corpus get surrogates
from a keyed hash, of their own type and format; surrogates that meet each other or a
real entity are drawn again, so different entities stay different and equal ones equal.
Texts without an entity are passed on without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.tables import row_key, text_of
from lexweave.session import cut_lineage

# Names by script and gender, and forms of address by gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Peter Paul Hans Jürgen Pierre Jacques Carlos Miguel Antonio José".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Laura Ursula Heike Camille Juliette Carmen Lucía Dolores Isabel".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Павел Виктор Юрий Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Людмила Вера".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παναγιώτης Σπύρος Ανδρέας Πέτρος Στέλιος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Βασιλική Γεωργία Δήμητρα Ειρήνη Ιωάννα Χριστίνα".split(),
}
FAMILY = {
    "latin": "Smith Johnson Brown Taylor Wilson Clark Walker Harris Turner Cooper Bailey Murphy Müller Schneider Fischer Weber Wagner Becker Dubois Moreau Laurent Girard García Fernández Romero Navarro Torres Molina Castillo Ortega".split(),
    "cyrillic": "Коваленко Шевченко Бондаренко Ткаченко Кравченко Олейник Лысенко Гончаренко Савченко Романенко Павленко Марченко".split(),
    "greek": "Παπαδοπούλου Γεωργίου Δημητρίου Ιωάννου Νικολάου Αντωνίου Βασιλείου Κωνσταντίνου Αθανασίου Χριστοδούλου".split(),
}
# Syllables, and endings by gender, of names made up where the listed ones are taken.
SYLLABLES = {
    "latin": ["ba", "den", "fi", "gor", "hal", "ki", "lo", "mar", "nel", "or", "pe", "ras", "sil", "tan", "vo", "wen"],
    "cyrillic": ["ба", "ве", "гор", "да", "жи", "ка", "ла", "ми", "но", "пе", "ра", "сто", "ти", "фе", "хо", "яр"],
    "greek": ["βα", "γι", "δη", "ζα", "θε", "κα", "λι", "μα", "νι", "πε", "ρα", "στα", "τη", "φι", "χα", "ψα"],
}
ENDINGS = {
    ("latin", "m"): ["rik", "ton", "mund", "bert"], ("latin", "f"): ["lina", "rita", "wyna", "bella"], ("latin", "family"): ["ser", "holt", "mann", "berg"],
    ("cyrillic", "m"): ["слав", "мир", "дан", "тон"], ("cyrillic", "f"): ["лина", "рина", "сана", "мира"], ("cyrillic", "family"): ["ченко", "вчук", "нюк", "ских"],
    ("greek", "m"): ["νος", "ρος", "λης", "τας"], ("greek", "f"): ["νη", "ρα", "λια", "τα"], ("greek", "family"): ["πουλος", "ίδης", "άκης", "άτος"],
}
ADDRESS = {
    "m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία".split(),
    "n": "Dr Prof".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLES = "|".join(re.escape(t) for own in ADDRESS.values() for t in own)
_KNOWN = "|".join(n for own in GIVEN.values() for n in own)
#: The pattern of each kind, without its surroundings; the first that fits a match gives its kind.
KINDS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+'-]{0,127}+@[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?){0,8}\.\p{L}{2,}",
    "ip": rf"(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{3,4}){2}|\+\d{1,3}[ .-]\d(?:[ .-]\d{2}){4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "social": r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "card": r"(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{13,19})(?![\p{L}\p{N}])",
    "hex": r"(?=[a-fA-F]*\d)[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
    "account": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?:AKIA[0-9A-Z]{16}|(?:sk|pk|rk|ghp|gho|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}|(?<=(?i:token|secret|password|passwd|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"'])[^\"'\s]{6,}(?=[\"']))(?![\p{L}\p{N}])",
    "name": rf"(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{_KNOWN}) {_NAME})(?![\p{{L}}\p{{N}}])",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"


def found(text: Column) -> Column:
    """All entities of a text as they stand, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def kind_of(match: Column) -> Column:
    """The kind of a match."""
    digits = F.regexp_replace(match, r"\D", "")
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(match.rlike(r"^[\d -]+$") & (F.length(digits) >= 13), "card")
        .when(match.rlike(r"^[+(\d][\d() .+-]+$") & F.length(digits).between(7, 15), "phone")
        .when(match.rlike(r"^(?=.*\d)[0-9a-fA-F]{32,128}$"), "hex")
        .when(match.rlike(rf"^({_TITLES})\.? |^({_KNOWN}) "), "name")
        .when(match.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), "account")
        .otherwise("secret")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _listed(word: Column, names: list[str]) -> Column:
    return F.lower(word).isin([n.lower() for n in names])


def segments(match: Column, kind: Column) -> Column:
    """Array of (kind, canonical, gender, raw): one element, or the parts of a name.

    ``kind`` is null for a form of address, which stays. Kinds of name parts hold the script.
    """
    raw = F.struct
    country = F.regexp_extract(match, r"^\+\d{1,3}(?=[ .(-])", 0)
    canonical = (
        F.when(kind == "email", F.lower(match))
        .when(kind == "hex", F.lower(match))
        .when(kind == "phone", F.concat(country, F.lit(":"), F.regexp_replace(F.substr(match, F.length(country) + 1), r"\D", "")))
        .when(kind.isin("card", "social"), F.regexp_replace(match, r"\D", ""))
        .when(kind == "account", F.regexp_replace(match, " ", ""))
        .otherwise(match)
    )
    none = F.lit(None).cast("string")
    single = F.array(raw(kind.alias("kind"), canonical.alias("canonical"), none.alias("gender"), match.alias("raw")))
    parts = F.split(match, " ")
    title = F.regexp_replace(parts[0], r"\.$", "")
    titled = title.isin([t for own in ADDRESS.values() for t in own])
    by_title = F.when(title.isin(ADDRESS["m"]), "m").when(title.isin(ADDRESS["f"]), "f")
    men = [n for (_, g), own in GIVEN.items() if g == "m" for n in own]
    women = [n for (_, g), own in GIVEN.items() if g == "f" for n in own]

    def part(word: Column, i: Column) -> Column:
        family = i == F.size(parts) - 1
        gender = F.when(_listed(word, men), "m").when(_listed(word, women), "f").otherwise(by_title)
        own = F.when(family, F.concat(F.lit("family:"), _script(word))).otherwise(F.concat(F.lit("given:"), _script(word)))
        return raw(
            F.when(titled & (i == 0), none).otherwise(own).alias("kind"),
            F.lower(word).alias("canonical"),
            F.when(family, none).otherwise(gender).alias("gender"),
            word.alias("raw"),
        )

    return F.when(kind == "name", F.transform(parts, part)).otherwise(single)


def _digits(hexes: Column) -> Column:
    return F.translate(hexes, "abcdef", "012345")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit being the check digit."""
    from_right = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    weighed = F.transform(
        from_right,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def _number(hexes: Column, at: Column | int, n: int) -> Column:
    """A number below ``n`` from eight hexadecimal digits."""
    return F.conv(F.substr(hexes, at if isinstance(at, Column) else F.lit(at), F.lit(8)), 16, 10).cast("long") % n


def _picked(names: list[str], script: str, gender: str, hexes: Column, attempt: Column) -> Column:
    """A listed name; after three attempts one of syllables, longer as attempts go on."""
    listed = F.element_at(F.array(*[F.lit(n) for n in names]), (_number(hexes, 1, len(names)) + 1).cast("int"))
    syllables, ends = (F.array(*[F.lit(x) for x in own]) for own in (SYLLABLES[script], ENDINGS[(script, gender)]))
    count = F.least(1 + F.floor(attempt / 4), F.lit(7)).cast("int")
    made = F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(syllables, (_number(hexes, i * 8 - 7, len(SYLLABLES[script])) + 1).cast("int")))
    end = F.element_at(ends, (_number(hexes, 57, len(ENDINGS[(script, gender)])) + 1).cast("int"))
    return F.when(attempt < 3, listed).otherwise(F.initcap(F.concat(F.array_join(made, ""), end)))


_SIGNS = {r"[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[0-9]": "0123456789", r"[^A-Z0-9]": "abcdefghijklmnopqrstuvwxyz"}
#: Openings that say what a key is for; they stay.
PREFIX = r"^(?:AKIA|(?:sk|pk|rk|ghp|gho|xoxb|xoxp)[_-])"


def _alike(text: Column, signs: Column, hexes: Column, *, all_signs: Column) -> Column:
    """``text`` with every sign drawn anew within its class (capital, digit, small); others stay unless ``all_signs``.

    ``signs`` is the text's array of signs, ``hexes`` has at least 128 hexadecimal digits.
    """

    def one(c: Column, i: Column) -> Column:
        # a number per place: the digits of the hash are mixed with the place, so long texts do not repeat them
        drawn = F.pmod(F.xxhash64(hexes, i), F.lit(26))
        out = c
        for pattern, alphabet in _SIGNS.items():
            new = F.substr(F.lit(alphabet), (drawn % len(alphabet) + 1).cast("int"), F.lit(1))
            out = F.when(c.rlike(rf"^{pattern}$") & (c.rlike(r"^[\p{L}\p{N}]$") | all_signs), new).otherwise(out)
        return out

    return F.array_join(F.transform(signs, one), "")


def _remainder(text: Column) -> Column:
    """The number a string stands for, letters as 10 to 35, modulo 97."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    digits = F.transform(signs, lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _account(canonical: Column, hexes: Column) -> Column:
    """An account number of the same country and classes of signs; its check digits hold if they did."""
    country, body = F.substring(canonical, 1, 2), F.substr(canonical, F.lit(5))
    new = _alike(body, F.filter(F.split(body, ""), lambda c: c != ""), hexes, all_signs=F.lit(False))
    valid = _remainder(F.concat(body, F.substring(canonical, 1, 4))) == 1
    check = 98 - _remainder(F.concat(new, country, F.lit("00")))
    check = F.when(valid, check).otherwise(F.when(check > 2, check - 1).otherwise(check + 1))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)


def _secret(canonical: Column, hexes: Column, attempt: Column) -> Column:
    """A key of the same opening and classes of signs; after many attempts punctuation gives way, then the key grows."""
    opening = F.regexp_extract(canonical, PREFIX, 0)
    rest = F.substr(canonical, F.length(opening) + 1)
    more = F.greatest(F.floor((attempt - 12) / 4), F.lit(0)).cast("int")
    body = F.concat(rest, F.repeat(F.lit("a"), more))
    return F.concat(opening, _alike(body, F.filter(F.split(body, ""), lambda c: c != ""), hexes, all_signs=attempt >= 6))


def surrogate(kind: Column, canonical: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity at an attempt: same type, format and length of digits."""
    def draw(salt: str) -> Column:
        return F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(salt), kind, canonical, attempt.cast("string")), 256)

    hexes, more = draw("a"), draw("b")
    digits = F.concat(_digits(hexes), _digits(more))
    length = F.length(canonical)

    def octet(i: int, low: int, n: int) -> Column:
        return (F.conv(F.substring(hexes, i, 4), 16, 10).cast("long") % n + low).cast("string")

    inner = canonical.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    ip = F.concat_ws(".", F.when(inner, "10").otherwise(octet(1, 240, 15)), octet(5, 0, 256), octet(9, 0, 256), octet(13, 1, 254))
    country = F.substring_index(canonical, ":", 1)
    body = F.length(canonical) - F.length(country) - 1
    phone = F.concat(country, F.lit(":"), F.translate(F.substring(digits, 1, 1), "01", "23"), F.substr(digits, F.lit(2), body - 1))
    stem = F.concat(F.substring(canonical, 1, 1), F.substr(digits, F.lit(1), length - 2))
    valid = _luhn(canonical) % 10 == 0
    last = (F.lit(10) - _luhn(F.concat(stem, F.lit("0"))) % 10) % 10
    card = F.concat(stem, ((last + F.when(valid, 0).otherwise(1)) % 10).cast("string"))
    tld = F.lit("example")
    email = F.concat(F.lit("u"), F.substring(hexes, 1, 12), F.lit("@"), F.lit("d"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(key), F.substring_index(canonical, "@", -1)), 256), 1, 8), F.lit("."), tld)
    long = F.concat(hexes, more)
    out = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "social", F.substr(digits, F.lit(1), length))
        .when(kind == "account", _account(canonical, hexes))
        .when(kind == "hex", F.substr(long, F.lit(1), length))
    )
    for script, names in FAMILY.items():
        out = out.when(kind == f"family:{script}", _picked(names, script, "family", hexes, attempt))
        both = GIVEN[(script, "m")] + GIVEN[(script, "f")]
        men, women = (_picked(GIVEN[(script, g)], script, g, hexes, attempt) for g in "mf")
        any_ = F.when(_number(hexes, 49, 2) == 0, _picked(both, script, "m", hexes, attempt)).otherwise(_picked(both, script, "f", hexes, attempt))
        out = out.when(kind == f"given:{script}", F.when(gender == "m", men).when(gender == "f", women).otherwise(any_))
    return out.otherwise(_secret(canonical, hexes, attempt))


def _filled(pattern: Column, letters: str, with_: Column) -> Column:
    """``pattern`` with its characters of the class ``letters`` replaced in turn by those of ``with_``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    chars = F.filter(F.split(pattern, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        hit = c.rlike(letters)
        return F.struct(
            F.concat(a["out"], F.when(hit, F.substr(with_, a["at"], F.lit(1))).otherwise(c)).alias("out"),
            (a["at"] + hit.cast("int")).alias("at"),
        )

    return F.aggregate(chars, start, step, lambda a: a["out"])


def rendered(kind: Column, raw: Column, new: Column) -> Column:
    """A surrogate in the format of one mention: its separators, and capitals where it is all capitals."""
    country = F.regexp_extract(raw, r"^\+\d{1,3}(?=[ .(-])", 0)
    phone = F.concat(country, _filled(F.substr(raw, F.length(country) + 1), r"\d", F.substring_index(new, ":", -1)))
    shaped = (
        F.when(kind == "phone", phone)
        .when(kind.isin("card", "social"), _filled(raw, r"\d", new))
        .when(kind == "account", _filled(raw, r"[A-Z0-9]", new))
        .otherwise(new)
    )
    capitals = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1) & ~kind.isin("account", "secret")
    return F.when(capitals, F.upper(shaped)).otherwise(shaped)


def surrogates(entities: DataFrame, key: str, *, max_attempts: int = 60) -> DataFrame:
    """(kind, canonical, surrogate) for the distinct ``entities`` (kind, canonical, gender).

    In each round the smallest entity keeps a surrogate that several drew; the others, and
    those that drew a real entity or a surrogate given before, draw again.
    """
    group = F.substring_index("kind", ":", 1).alias("group")
    real = entities.select(group, F.lower("canonical").alias("new")).distinct()
    pending = entities.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    for attempt in range(max_attempts):
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.col("gender"), F.lit(attempt), key))
        drawn = drawn.select("*", group, F.lower("surrogate").alias("new"))
        taken = real if done is None else real.union(done.select("group", "new"))
        first = drawn.groupBy("group", "new").agg(F.min(F.struct("kind", "canonical")).alias("first"))
        free = first.join(taken.distinct(), ["group", "new"], "left_anti")
        marked = cut_lineage(
            drawn.join(free, ["group", "new"], "left")
            .withColumn("won", F.coalesce(F.struct("kind", "canonical") == F.col("first"), F.lit(False)))
            .drop("first")
        )
        won = marked.where("won").select("kind", "canonical", "surrogate", "group", "new")
        done = won if done is None else done.union(won)
        pending = marked.where("NOT won").select("kind", "canonical", "gender")
        if not pending.take(1):
            return done.select("kind", "canonical", "surrogate")
    raise RuntimeError(f"{max_attempts} attempts left entities without a surrogate")


def _mentions(rows: DataFrame) -> DataFrame:
    """``mentions`` of rows (key, found)."""
    rows = rows.select("key", F.posexplode("found").alias("place", "match")).dropDuplicates(["key", "place"])
    rows = rows.withColumn("match_kind", kind_of(F.col("match")))
    parts = rows.select("key", "place", F.posexplode(segments(F.col("match"), F.col("match_kind"))).alias("part", "s"))
    return parts.select("key", "place", "part", "s.*")


def mentions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, place, part, kind, canonical, gender, raw): the entities of each different (id, text)."""
    text = text_of(docs, text_col)
    return _mentions(docs.select(row_key(docs[id_col], text).alias("key"), found(text).alias("found")))


def bare_names(parts: DataFrame) -> DataFrame:
    """(key, names): how the name parts found in a text are written when they stand alone in it.

    ``parts`` are (key, kind, raw, surrogate). ``names`` are (pattern, new), long ones first:
    the part as it was found, in capitals, and with a capital alone.
    """
    name = parts.where(F.col("kind").rlike("^(family|given):")).select("key", "raw", "surrogate").distinct()
    forms = F.array(
        F.struct(F.col("raw").alias("old"), rendered(F.lit("name"), F.col("raw"), F.col("surrogate")).alias("new")),
        F.struct(F.upper("raw").alias("old"), F.upper("surrogate").alias("new")),
        F.struct(F.initcap("raw").alias("old"), F.col("surrogate").alias("new")),
    )
    each = name.select("key", F.explode(forms).alias("f")).groupBy("key", "f.old").agg(F.min("f.new").alias("new"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.col("old"), F.lit(r"(?![\p{L}\p{N}])"))
    listed = F.struct((-F.length("old")).alias("n"), pattern.alias("pattern"), "new")
    return each.groupBy("key").agg(F.array_sort(F.collect_list(listed)).alias("names"))


def replace_pii(
    docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced; the columns stay as they are.

    Emails, IPv4 addresses, phone, card, social-security and account numbers, keys and
    secrets, and names after a form of address or with a known given name. ``key`` is the
    secret of the hash; ``length_col`` (code points of the text) is brought up to date.
    A mention keeps its separators and capitals, a phone number its country code, a card
    its first digit and whether its check digit holds, an account its country, the class of
    each sign and whether its check digits hold, a key its opening and classes of signs, an
    inner address stays inner, a name keeps its script, its gender (by its own or its title)
    and its number of parts. Name parts get surrogates one by one, and a part found in a
    text is replaced in the rest of that text, too, where it stands alone with a capital or
    in capitals, so a person mentioned again by one name stays the same person.

    A null text stays null, an empty one empty; repeated rows are replaced alike; null ids
    and extra columns pass through; an empty table stays empty.
    """
    text = text_of(docs, text_col)
    # the texts are searched once; what was found goes with them
    every = cut_lineage(docs.withColumn("__lw_found", found(text)).withColumn("__lw_key", F.when(F.size("__lw_found") > 0, row_key(docs[id_col], text))))
    hit = F.size("__lw_found") > 0
    parts = cut_lineage(_mentions(every.where(hit).select(F.col("__lw_key").alias("key"), F.col("__lw_found").alias("found"))))
    known = F.when(F.min("gender") == F.max("gender"), F.min("gender"))
    entities = parts.where("kind IS NOT NULL").groupBy("kind", "canonical").agg(known.alias("gender"))
    table = surrogates(cut_lineage(entities), key)
    new = cut_lineage(parts.join(table, ["kind", "canonical"], "left"))
    word = F.when(F.col("kind").isNull(), F.col("raw")).otherwise(rendered(F.col("kind"), F.col("raw"), F.col("surrogate")))
    whole = (
        new.select("key", "place", F.struct("part", word.alias("word")).alias("p"))
        .groupBy("key", "place")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["word"]), " ").alias("word"))
        .groupBy("key")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda p: p["word"]).alias("__lw_new"))
        .join(bare_names(new), "key", "left")
        .select(F.col("key").alias("__lw_key"), "__lw_new", F.coalesce("names", F.array().cast("array<struct<n:int,pattern:string,new:string>>")).alias("__lw_names"))
    )
    changed = every.where(hit).join(whole, "__lw_key")
    between = F.split(F.col(text_col).cast("string"), PATTERN, -1)
    gaps = F.transform(between, lambda gap: F.aggregate("__lw_names", gap, lambda a, x: F.regexp_replace(a, x["pattern"], x["new"])))
    joined = F.array_join(F.zip_with(gaps, F.col("__lw_new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = changed.withColumn(text_col, joined)
    if length_col:
        changed = changed.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return every.where(~hit).select(*own).unionByName(changed.select(*own))
