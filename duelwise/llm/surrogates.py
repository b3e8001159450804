"""Personal data replaced by surrogates of the same kind.

Entities are found by patterns. An entity is what remains of a mention without its format
(digits of a card, a lower-cased address, a name without its title), so all mentions of one
entity get one surrogate, laid into each mention's own format. Surrogates come from a keyed
hash of the entity and of an attempt; the table of all distinct entities is checked, and of
entities that got one surrogate all but one try again, as do those whose surrogate is an
entity of the corpus. So different entities stay different.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelwise.llm.columns import let
from duelwise.llm.scratch import settle

#: From the attempt FREE on, each one's surrogates are a digit or a syllable longer, so the
#: space grows tenfold or more until all entities have a place.
FREE = 6
_NONE = -(1 << 63)

# Titles and common given names, by gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"], "u": ["Dr", "Prof"]}
GIVEN = {
    "f": ["Anna", "Maria", "Laura", "Julia", "Sophie", "Emma", "Clara", "Elena", "Sarah", "Alice",
          "Анна", "Мария", "Елена", "Ольга", "Ирина"],
    "m": ["John", "Peter", "Thomas", "Daniel", "Michael", "David", "Martin", "Pablo", "James",
          "Louis", "Иван", "Пётр", "Сергей", "Павел", "Олег"],
}
# Syllables of invented surnames, by script.
SYLLABLES = {
    "latin": ["ba", "den", "fol", "gar", "hil", "jor", "kam", "lin", "mor", "nes", "pol", "ros",
              "sel", "tan", "ver", "wil"],
    "cyrillic": ["ба", "ден", "фол", "гар", "хил", "жор", "кам", "лин", "мор", "нес", "пол",
                 "рос", "сел", "тан", "вер", "вил"],
}

def _signs(first: str, last: str, kind: str) -> str:
    """The signs from first to last of a Unicode category."""
    found = map(chr, range(ord(first), ord(last) + 1))
    return "".join(c for c in found if unicodedata.category(c) == kind)[:4096]


# Fixed values: (pattern, signs) of letters beyond ASCII; the first pattern that fits counts.
LETTERS = [
    (r"\p{IsLatin}&&\p{Lu}", _signs("À", "Þ", "Lu")), (r"\p{IsLatin}&&\p{L}", _signs("ß", "ÿ", "Ll")),
    (r"\p{IsCyrillic}&&\p{Lu}", _signs("А", "Я", "Lu")), (r"\p{IsCyrillic}&&\p{L}", _signs("а", "я", "Ll")),
    (r"\p{IsGreek}&&\p{Lu}", _signs("Α", "Ω", "Lu")), (r"\p{IsGreek}&&\p{L}", _signs("α", "ω", "Ll")),
    (r"\p{IsArmenian}&&\p{Lu}", _signs("Ա", "Ֆ", "Lu")), (r"\p{IsArmenian}&&\p{L}", _signs("ա", "ֆ", "Ll")),
    (r"\p{IsGeorgian}&&\p{L}", "".join(map(chr, range(0x10D0, 0x10F1)))),
    (r"\p{IsHebrew}&&\p{L}", _signs("א", "ת", "Lo")), (r"\p{IsArabic}&&\p{L}", _signs("ا", "ي", "Lo")),
    (r"\p{IsDevanagari}&&\p{L}", _signs("क", "ह", "Lo")), (r"\p{IsBengali}&&\p{L}", _signs("ক", "হ", "Lo")),
    (r"\p{IsTamil}&&\p{L}", _signs("க", "ஹ", "Lo")), (r"\p{IsThai}&&\p{L}", _signs("ก", "ฮ", "Lo")),
    (r"\p{IsHangul}&&\p{L}", _signs("가", "힣", "Lo")), (r"\p{IsHiragana}&&\p{L}", _signs("あ", "ん", "Lo")),
    (r"\p{IsKatakana}&&\p{L}", _signs("ア", "ン", "Lo")), (r"\p{IsHan}", _signs("一", "龥", "Lo")),
    # Letters of other scripts and digits that are not 0-9.
    (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{N}", "0123456789"),
]

_WORD = r"\p{Lu}\p{Ll}+"
_TITLE = "|".join(x for names in TITLES.values() for x in names)
_GIVEN = "|".join(x for names in GIVEN.values() for x in names)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# In the order in which they are tried at a place.
PATTERNS = [
    ("email", r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+"),
    ("secret", r"(?<=(?i:password|passwd|secret|token|api_key)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})"
               r"(?=[^\s\"',;=:]*[\p{L}\p{N}])[^\s\"',;=:]{6,}(?<![.!?)\]}>])"),
    ("key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    ("ip6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"
            r"|(?<![\w:])(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::"
            r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,4}(?!\d)"
              r"|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
              r"|(?<![\d.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])"
              r"|(?<![\d.])0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}(?!\d)"),
    ("card", r"(?<![\d.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)"),
    ("name", rf"\b(?:(?:{_TITLE})\b\.? {_WORD}(?: {_WORD}){{0,2}}|(?:{_GIVEN}) {_WORD})"),
]


def _numbered(pattern: str, before: int) -> str:
    """Back references of a pattern behind `before` groups."""
    return pattern.replace(r"\1", rf"\{before + 1}")


ANY = "|".join(_numbered(p, 0) for _, p in PATTERNS)


def _kind(mention: Column) -> Column:
    found = F.lit("name")
    for kind, pattern in reversed(PATTERNS[:-1]):
        whole = pattern.replace(r"(?<=(?i:password|passwd|secret|token|api_key)[ ]{0,2}[=:][ ]{0,2}"
                                r"[\"']{0,1})", "")
        if kind != "secret":
            found = F.when(mention.rlike(rf"^(?:{whole})$"), kind).otherwise(found)
    return F.when(found != "name", found).when(mention.rlike(rf"^(?:{PATTERNS[-1][1]})$"), "name") \
        .otherwise("secret")


def _gender(mention: Column) -> Column:
    """By a title that tells it, else by the given name, so that all mentions of a person agree."""
    gender, bare = F.lit("u"), _bare_name(mention)
    for g in ("f", "m"):
        gender = F.when(bare.rlike(rf"^(?:{'|'.join(GIVEN[g])})(?!\p{{L}})"), g).otherwise(gender)
    for g in ("f", "m"):
        gender = F.when(mention.rlike(rf"^(?:{'|'.join(TITLES[g])})(?!\p{{L}})"), g).otherwise(gender)
    return gender


def _bare_name(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^(?:{_TITLE})\b\.? ", "")


def entity(kind: Column, mention: Column) -> Column:
    """The mention without its format."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"\D", ""))
        .when(kind.isin("email", "ip6"), F.lower(mention))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "name", F.concat(_gender(mention), F.lit(":"), _bare_name(mention)))
        .otherwise(mention))


def _noise(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x01", F.lit(key), *parts).cast("binary"), 512)


def _number(noise: Column, at: Column, size: int) -> Column:
    """A number below `size` from three digits of the noise."""
    place = F.pmod(at, F.lit(42)) * 3 + 1
    return F.pmod(F.conv(F.substring(noise, place, F.lit(3)), 16, 10).cast("int"), F.lit(size))


def _scrambled(text: Column, key: str, *parts: Column) -> Column:
    """Every letter and digit replaced by one of its kind and script (LETTERS; of scripts that
    it lacks by an ASCII one), other signs kept; hexadecimal numbers stay such."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexadecimal = text.rlike(r"^(?=.*\d)[0-9a-f]{8,}$")

    def one(sign: Column, i: Column) -> Column:
        noise = _noise(key, *parts, (i / 42).cast("int").cast("string"))
        out = F.lit(None).cast("string")
        for pattern, signs in reversed(LETTERS):
            some = F.substring(F.lit(signs), _number(noise, i, len(signs)) + 1, F.lit(1))
            out = F.when(sign.rlike(f"^[{pattern}]$"), some).otherwise(out)
        out = F.when(F.octet_length(sign) == 1, sign).otherwise(F.coalesce(out, sign))
        for signs in (digits, lower, upper):
            at = _number(noise, i, len(signs))
            if signs == lower:
                at = F.when(hexadecimal, F.pmod(at, F.lit(6))).otherwise(at)
            some = F.substring(F.lit(signs), at + 1, F.lit(1))
            out = F.when(sign.rlike(f"^[{signs[0]}-{signs[-1]}]$"), some).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _longer(attempt: Column) -> Column:
    """How many signs more than its entity a surrogate has."""
    return F.greatest(attempt.cast("int") - (FREE - 1), F.lit(0))


def _extra(key: str, *parts: Column) -> Column:
    """As many digits; the last part is the attempt."""
    digits = F.translate(_noise(key, F.lit("extra"), *parts), "abcdef", "012345")
    return F.substring(digits, F.lit(1), _longer(parts[-1]))


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn scheme over digits, the last one counting once."""

    def worth(d: Column, i: Column) -> Column:
        doubled = d.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0),
                       lambda a, x: a + x)


def _card(own: Column, key: str, *parts: Column) -> Column:
    """The first digit stays, and a card that passes the Luhn check gets one that does."""
    head = F.concat(F.substring(own, 1, 1), _scrambled(
        F.substring(own, F.lit(2), F.length(own) - 2), key, *parts), _extra(key, *parts))
    check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10))
    last = F.when(F.pmod(_luhn_sum(own), F.lit(10)) == 0, check).otherwise(
        F.pmod(check + 1, F.lit(10)))
    return F.concat(head, last.cast("string"))


def _iban(own: Column, key: str, *parts: Column) -> Column:
    """The country stays; the check digits are right for the rest."""
    country = F.substring(own, 1, 2)
    body = F.concat(_scrambled(F.substring(own, F.lit(5), F.length(own) - 4), key, *parts),
                    _extra(key, *parts))
    signs = F.split(F.concat(body, country, F.lit("00")), "")
    numbers = F.transform(signs, lambda s: F.when(
        s.rlike(r"^\d$"), s).otherwise((F.ascii(s) - 55).cast("string")))
    rest = F.aggregate(F.split(F.array_join(numbers, ""), ""), F.lit(0),
                       lambda a, d: F.pmod(a * 10 + d.cast("int"), F.lit(97)))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _email(own: Column, key: str, *parts: Column) -> Column:
    """A reserved domain; mentions of one domain share its surrogate."""
    domain = F.substring_index(own, "@", -1)
    host = F.regexp_replace(domain, r"\.[a-z]+$", "")
    host = F.regexp_replace(host, r"\.example$", "")
    return F.concat(_scrambled(F.substring_index(own, "@", 1), key, *parts),
                    _extra(key, *parts), F.lit("@"),
                    _scrambled(host, key, F.lit("domain"), domain),
                    F.when(domain.endswith(".example.com"), ".example.com").otherwise(".example"))


def _ip(own: Column, key: str, *parts: Column) -> Column:
    """An address of 10/8, then of the reserved 240/4, then a local one of version 6."""
    noise, attempt = _noise(key, *parts), parts[-1].cast("int")
    first = F.when(attempt < FREE, F.lit(10)).otherwise(_number(noise, F.lit(3), 15) + 240)
    short = F.concat_ws(".", first.cast("string"), *(
        _number(noise, F.lit(i), 256).cast("string") for i in range(3)))
    return F.when(attempt < 2 * FREE, short).otherwise(_ip6(key, *parts))


def _ip6(key: str, *parts: Column) -> Column:
    """A local address of version 6, written in full."""
    noise = _noise(key, *parts)
    return F.concat_ws(":", F.concat(F.lit("fd"), F.substring(noise, 1, 2)), *(
        F.substring(noise, 3 + 4 * i, 4) for i in range(7)))


def _name(own: Column, key: str, *parts: Column) -> Column:
    """Words of the same number, script and gender; equal words of a first attempt agree."""
    gender, bare = F.substring(own, 1, 1), F.substring_index(own, ":", -1)
    attempt = parts[-1]

    def word(own_word: Column, i: Column, last: Column) -> Column:
        noise = _noise(key, F.lit("name"), own_word, attempt)
        cyrillic = own_word.rlike(r"^\p{IsCyrillic}")

        def pick(latin: list[str], other: list[str], at: Column | int) -> Column:
            at = F.lit(at) if isinstance(at, int) else at
            return F.when(cyrillic, F.get(F.array(*map(F.lit, other)), _number(
                noise, at, len(other)))).otherwise(
                F.get(F.array(*map(F.lit, latin)), _number(noise, at, len(latin))))

        def split(names: list[str]) -> tuple[list[str], list[str]]:
            return [n for n in names if n[0] < "Ё"], [n for n in names if n[0] >= "Ё"]

        n = _longer(attempt)
        more = F.array_join(F.when(n > 0, F.transform(
            F.sequence(F.lit(1), n),
            lambda k: pick(SYLLABLES["latin"], SYLLABLES["cyrillic"], k + 5))).otherwise(
            F.array().cast("array<string>")), "")
        surname = F.initcap(F.concat(*(pick(SYLLABLES["latin"], SYLLABLES["cyrillic"], k)
                                       for k in range(4)), more))
        first = F.when(gender == "f", pick(*split(GIVEN["f"]), 5)).when(
            gender == "m", pick(*split(GIVEN["m"]), 5)).otherwise(
            pick(*split(GIVEN["f"] + GIVEN["m"]), 5))
        return F.when(i == last, surname).otherwise(first)

    words = F.split(bare, " ")
    return F.concat(gender, F.lit(":"), F.array_join(F.transform(
        words, lambda w, i: word(w, i, F.size(words) - 1)), " "))


def surrogate(kind: Column, own: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity, an entity of the same kind."""
    parts = (kind, own, attempt.cast("string"))
    phone = F.concat(F.substring(own, 1, 1), _scrambled(
        F.substring(own, F.lit(2), F.length(own)), key, *parts), _extra(key, *parts))
    return (
        F.when(kind == "email", _email(own, key, *parts)).when(kind == "ip", _ip(own, key, *parts))
        .when(kind == "ip6", _ip6(key, *parts))
        .when(kind == "card", _card(own, key, *parts)).when(kind == "phone", phone)
        .when(kind == "iban", _iban(own, key, *parts)).when(kind == "name", _name(own, key, *parts))
        .when(kind == "key", F.concat(F.lit("AKIA"), _scrambled(F.substring(own, 5, 16), key, *parts),
                                      _extra(key, *parts)))
        .otherwise(F.concat(_scrambled(own, key, *parts), _extra(key, *parts))))


def laid_out(kind: Column, mention: Column, core: Column) -> Column:
    """A surrogate in the format of a mention."""

    def filled(signs: Column) -> Column:
        """Digits, or for an IBAN all but blanks, of the mention replaced in turn; what a
        longer surrogate has left over follows."""
        own = F.length(F.regexp_replace(mention, r"[^A-Z0-9]", ""))
        return F.concat(F.array_join(F.transform(signs, lambda s, i: F.when(
            s.rlike(r"^[A-Z0-9]$"), F.substring(core, F.length(F.regexp_replace(F.array_join(
                F.slice(signs, F.lit(1), i + 1), ""), r"[^A-Z0-9]", "")), F.lit(1)))
            .otherwise(s)), ""), F.substring(core, own + 1, F.length(core)))

    title = F.regexp_extract(mention, rf"^((?:{_TITLE})\b\.? )", 1)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), let(F.split(mention, ""), filled))
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(core))
        .when(kind == "name", F.concat(title, F.substring_index(core, ":", -1)))
        .otherwise(core))


def entity_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, own, core) for distinct (kind, own): all cores of a kind differ from each
    other and from all entities of that kind. The outcome does not depend on the order."""
    open_ = settle(entities.select("kind", "own", F.lit(0).alias("attempt")))
    done = None
    names = entities.select("kind", F.col("own").alias("core")).distinct()
    while True:
        tried = settle(open_.withColumn(
            "core", surrogate(F.col("kind"), F.col("own"), F.col("attempt"), key)))
        bad = names if done is None else names.union(done.select("kind", "core"))
        free = settle(tried.join(bad, ["kind", "core"], "left_anti"))
        winners = free.groupBy("kind", "core").agg(F.min("own").alias("own"))
        won = settle(winners.select("kind", "own", "core"))
        done = won if done is None else done.union(won)
        open_ = settle(tried.select("kind", "own", (F.col("attempt") + 1).alias("attempt")).join(
            won.select("kind", "own"), ["kind", "own"], "left_anti"))
        if open_.isEmpty():
            return done


def replace_entities(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
    out: str = "entities",
) -> DataFrame:
    """All columns of `docs`, the text with surrogates, and `out`, a name new to `docs`: how
    many were replaced.

    key is the secret of the keyed hash: the same key gives the same surrogates for the same
    corpus. A text without entities, an empty or a null text stays as it is, with 0; rows
    may repeat or lack an id and are treated by their text.
    """
    names = docs.columns
    keys = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NONE)).alias("id"),
            F.xxhash64(f"`{text_col}`").alias("part")]
    text = F.col(f"`{text_col}`")
    mentions = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    found = settle(
        docs.select(*keys, mentions.alias("m")).filter(F.size("m") > 0)
        .select("id", "part", F.posexplode("m").alias("at", "mention"))
        .withColumn("kind", _kind(F.col("mention")))
        .withColumn("own", entity(F.col("kind"), F.col("mention"))))
    table = settle(entity_table(found.select("kind", "own").distinct(), key))
    put = found.join(table, ["kind", "own"]).groupBy("id", "part").agg(
        F.sort_array(F.collect_set(F.struct(
            "at", laid_out(F.col("kind"), F.col("mention"), F.col("core")).alias("new"))))
        .alias("put"))
    # The mentions grow with the texts: they are never broadcast, at no size.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), *keys,
                       text.alias("text")).join(
        settle(put).hint("merge"), ["id", "part"], "left")
    gaps = F.split("text", ANY, -1)
    new = F.when(F.col("put").isNull(), F.col("text")).otherwise(let(gaps, lambda g: F.array_join(
        F.transform(g, lambda x, i: F.concat(x, F.coalesce(
            F.get("put", i)["new"], F.lit("")))), "")))
    return rows.select(
        *((new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names),
        F.coalesce(F.size("put"), F.lit(0)).cast("long").alias(out))
