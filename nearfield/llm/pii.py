"""PII surrogates, in DataFrame functions alone.

Detected entities get keyed, type-consistent replacements: an e-mail address stays one; a phone number keeps its country
code and its punctuation; a card number its length, issuer digit and a right check digit; an account number (IBAN) its
country, the kind of each sign and right check digits; an internet address becomes four public octets or eight groups; a
social security number and a secret keep length, case and alphabet; a name after a title keeps the title, and gets words of
the gender of the title, of its script, its number of words and its case.

The same entity, in whatever format, gets the same replacement in every document: ``+1 (555) 123-4567`` is
``(555) 123-4567``. Each word of a name is an entity of its own, so ``Mr John Smith`` and ``Mr Smith`` keep one family name;
where a document names someone with a title and two words or more, the same words without the title are replaced too.
Given names after titles of either gender (``Dr``, ``Prof``) are replaced by names of the gender that another title of the
same full name has in that text, else by names of either gender. Where one text names a full name under titles of both
genders, each mention follows its own title, and the words without a title follow the first.

Up to three capital words after a title are a name. A word after a possessive is none. Where a text has ``Mr Smith`` alone, and
Smith is no given name known here, what follows in ``Mr Smith Said`` belongs to the name only if it, too, is a family name of
that text, alone after a title or last in a longer name; else it stays.

Replacements are made by HMAC-SHA512 of kind, entity and attempt. Texts are read twice, without a shuffle. First, distinct
entities are gathered (with partial aggregation) and their replacements checked: no two entities may share one, and none may
be an entity of the corpus; the losers are hashed anew with a higher attempt until none is left (names then get longer, so
the values to choose from grow with each attempt). Second, texts are cut at their entities and put together again. Only the
few entities with an attempt over 0 must be looked up.

Patterns are linear in the text: none repeats a group without a bound, and runs are only tried from their first sign. What a
text names is looked up by bisection, so a text takes n log n steps, however many names it has, and no deep stack. Known limits: national phone
numbers without a country code are found in the forms ``(ddd) ddd-dddd`` and ``ddd-ddd-dddd`` only; names only after a title;
the end of a given name unknown here that a text has both alone after a title and before a family name seen once stays; internet addresses of version 6 only with all eight groups.

Defined cases: a null text stays null and has no entities; a number that is no valid card or account, or an address with an
octet over 255, stays; a text may name anybody under any titles; repeated rows are changed alike; an empty table gives an empty result; other columns stay as they
are, whatever their names; ties between entities for a replacement go to the lesser entity.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, settle

#: Titles by gender and script. F, M, N: female, male, either; L, C, G: Latin, Cyrillic, Greek.
TITLES = {
    "FL": ["Mrs", "Ms", "Miss", "Madame", "Mme", "Frau", "Señora", "Sra", "Signora", "Sig.ra"],
    "ML": ["Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Signor"],
    "NL": ["Dr", "Prof", "Professor"],
    "FC": ["госпожа", "Госпожа"],
    "MC": ["господин", "Господин"],
    "FG": ["κυρία", "Κυρία"],
    "MG": ["κύριος", "Κύριος"],
}
#: Given names by gender and script, and syllables and endings that family names are made of.
GIVEN = {
    "FL": "Anna Clara Diana Elena Emma Flora Greta Helena Ida Julia Laura Lena Maria Martha Nina Olivia Paula Rosa Sofia Vera".split(),
    "ML": "Adam Albert Anton Bruno Carl David Emil Felix Frank Georg Hugo Ivan Jonas Leon Martin Oscar Paul Robert Simon Victor".split(),
    "NL": "Alex Ariel Charlie Jamie Jules Kai Kim Luca Mika Noa Robin Sam Sascha Toni".split(),
    "FC": "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга София".split(),
    "MC": "Антон Борис Виктор Глеб Денис Иван Лев Максим Олег Роман".split(),
    "FG": "Άννα Ελένη Ζωή Ηρώ Θάλεια Ιρις Μαρία Νίκη Σοφία Χλόη".split(),
    "MG": "Αλέξης Βασίλης Γιάννης Δημήτρης Ηλίας Κώστας Λουκάς Νίκος Πέτρος Στέφανος".split(),
}
SYLLABLES = {
    "L": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no".split(),
    "C": "ба бе би бо да де ди до ва ве ви во га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но".split(),
    "G": "βα βε βι βο δα δε δι δο φα φε φι φο γα γε γι γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο".split(),
}
#: By the code of a family name: X, a Latin one, is the same for all genders.
ENDINGS = {"XL": "son", "FC": "ова", "MC": "ов", "FG": "ου", "MG": "ος"}
#: Country codes of telephone numbers.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

_TITLE = "(?:" + "|".join(t.replace(".", r"\.") for t in sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + ")"
_BLANK = r"[ \u00a0]"
_HEAD = rf"{_TITLE}\.?(?:{_BLANK}(?:Dr|Prof)\.?){{0,2}}{_BLANK}"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: What may end a word of a name and is no part of it.
_END = "(?:['’]s|['’-]+)$"
_MORE = rf"{_BLANK}(?!{_TITLE}(?![\p{{L}}])){_NAME}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: One pattern for each kind, asked in this order. Lengths of e-mail addresses are those of the standard.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-][A-Za-z0-9_%+.-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z-])",
    "secret": r"(?<![0-9A-Za-z])(?:(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})|AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}]){_HEAD}{_NAME}(?:{_MORE}){{0,2}}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold for the pattern to be tried.
QUICK = rf"[0-9@]|AKIA|gh[oprsu]_|sk-|{_TITLE}"
#: Greatest number of entities with an attempt over 0 that are broadcast, under 200 bytes each.
BROADCAST_ROWS = 100_000
#: From this attempt on a number or address gets four more digits; after the last one the format counts as used up.
LONGER, LAST_ATTEMPT = 12, 64


def _literal_map(entries: dict) -> Column:
    """A map of literals, which the optimizer makes once."""
    value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), value(v))])


def mentions(text: Column | str) -> Column:
    """All entity mentions of a text in order; null or plain texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    return F.coalesce(found, F.expr("cast(array() as array<string>)"))


def kind_of(m: Column) -> Column:
    """The kind of a mention."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, m: Column) -> Column:
    """The same for all formats of one entity that is no name: digits of numbers, lower case of addresses."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    phone = F.when(m.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))
    groups = F.regexp_replace(F.lower(m), "(^|:)0+(?=[0-9a-f])", "$1")
    return F.when(kind == "email", F.lower(m)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "ipv6", groups).otherwise(m)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def index(entries: Column) -> Column:
    """Structs (k, v) in order of k, of equal keys the first, for ``find``."""
    placed = F.sort_array(F.transform(entries, lambda x, i: F.struct(x["k"].alias("k"), i.alias("at"), x["v"].alias("v"))))
    return _let(placed, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["k"] != x["k"])))


def find(at: Column, key: Column) -> Column:
    """The v of a key in an index, by bisection; null if it isn't there."""
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def of(wanted: Column) -> Column:
        def step(s: Column, _) -> Column:
            middle = F.shiftright(s["lo"] + s["hi"], 1)
            return F.when(s["lo"] >= s["hi"], s).when(F.get(at, middle)["k"] < wanted, span(middle + 1, s["hi"])).otherwise(span(s["lo"], middle))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(at) + 1.0)).cast("int") + 1)
        place = F.aggregate(steps, span(F.lit(0), F.size(at)), step, lambda s: s["lo"])
        return _let(F.get(at, place), lambda x: F.when(x["k"] == wanted, x["v"]))

    return F.when(F.size(at) > 0, _let(key, of))


def name_words(m: Column) -> Column:
    """The words of a name without its title, as they are written."""
    return F.split(F.regexp_replace(m, f"^{_HEAD}", ""), _BLANK)


def bare(word: Column) -> Column:
    """A word without a possessive end or a mark."""
    return F.regexp_replace(word, _END, "")


def with_found(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_found``, the entities of ``text`` in order: m, what follows it in its match (tail), kind, whether it is
    one (ok), and its units.

    Units are (kind, canon, m): the entity itself, or the given and family names of a name. Each step is a column that the
    next ones name several times, so it is worked out once.
    """
    kept = docs.columns
    entry = lambda w: F.struct(w.alias("k"), F.lit(1).alias("v"))
    known = F.array(*[F.lit(w) for ws in GIVEN.values() for w in ws])
    code_of = _literal_map({t: c for c, ts in TITLES.items() for t in ts})

    # what is matched, with the words of names
    out = docs.withColumn("_read", F.transform(mentions("text"), lambda m: _let(kind_of(m), lambda kind: F.struct(m.alias("m"), kind.alias("kind"), F.when(kind == "name", name_words(m)).alias("words")))))
    # family names: alone after a title, or last in a longer name that doesn't begin with one
    out = out.withColumn("_solo", index(F.transform(F.array_except(F.transform(F.filter("_read", lambda x: F.size(x["words"]) == 1), lambda x: bare(F.get(x["words"], F.lit(0)))), known), entry)))
    out = out.withColumn("_first", F.transform("_read", lambda x: (F.size(x["words"]) > 1) & find(F.col("_solo"), F.get(x["words"], F.lit(0))).isNotNull()))
    longer = F.filter(F.zip_with("_read", "_first", lambda x, first: F.when((F.size(x["words"]) > 1) & ~first, bare(F.element_at(x["words"], -1)))), lambda w: w.isNotNull())
    out = out.withColumn("_family", index(F.concat(F.transform("_solo", lambda e: entry(e["k"])), F.transform(longer, entry))))

    # the words that belong to each name
    def cut(x: Column, first: Column) -> Column:
        n = F.size(x["words"])
        is_name = lambda k: find(F.col("_family"), bare(F.get(x["words"], F.lit(k)))).isNotNull()
        told = F.when(~first, n).when(~is_name(1), 1).when((n > 2) & is_name(2), 3).otherwise(2)
        owned = F.array_position(F.transform(x["words"], lambda w: w.rlike("['’]s$")), True).cast("int")
        ends = F.when(x["kind"] == "name", F.least(told, F.when(owned > 0, owned).otherwise(n))).otherwise(0)
        part = lambda k: F.when(k == 1, F.regexp_extract(x["m"], f"^{_HEAD}{_NAME}", 0)).when(k == 2, F.regexp_extract(x["m"], f"^{_HEAD}{_NAME}{_MORE}", 0)).otherwise(x["m"])
        code = F.when(x["kind"] == "name", F.element_at(code_of, F.regexp_extract(x["m"], f"^({_TITLE})", 1)))
        return _let(ends, lambda k: F.struct(part(k).alias("m"), x["m"].alias("whole"), x["kind"].alias("kind"), F.transform(F.slice(x["words"], 1, k), bare).alias("words"), code.alias("code")))

    out = out.withColumn("_cut", F.zip_with("_read", "_first", cut))
    full = lambda y: F.concat(F.substring(y["code"], 2, 1), F.lower(F.array_join(y["words"], " ")))
    gendered = F.filter("_cut", lambda y: (F.size(y["words"]) > 1) & ~y["code"].startswith("N"))
    out = out.withColumn("_genders", index(F.transform(gendered, lambda y: F.struct(full(y).alias("k"), y["code"].alias("v")))))

    def judged(y: Column) -> Column:
        unit = lambda kind, canon, m: F.struct(kind.alias("kind"), canon.alias("canon"), m.alias("m"))
        last = F.element_at(y["words"], -1)

        def names(code: Column) -> Column:
            given = F.transform(F.slice(y["words"], 1, F.greatest(F.size(y["words"]) - 1, F.lit(0))), lambda w: unit(F.lit("given"), F.concat(code, F.lower(w)), w))
            family = F.when(code.endswith("L"), F.lit("XL")).otherwise(code)
            return F.concat(given, F.array(unit(F.lit("family"), F.concat(family, F.lower(last)), last)))

        code = F.when(y["code"].startswith("N") & (F.size(y["words"]) > 1), F.coalesce(find(F.col("_genders"), full(y)), y["code"])).otherwise(y["code"])
        units = F.when(y["kind"] == "name", _let(code, names)).otherwise(F.array(unit(y["kind"], canonical(y["kind"], y["m"]), y["m"])))
        tail = F.when(F.length(y["m"]) == F.length(y["whole"]), F.lit("")).otherwise(F.substring(y["whole"], F.length(y["m"]) + 1, F.length(y["whole"])))
        return F.struct(y["m"].alias("m"), tail.alias("tail"), y["kind"].alias("kind"), is_entity(y["kind"], y["m"]).alias("ok"), units.alias("units"))

    return out.withColumn("_found", F.transform("_cut", judged)).select(*[F.col(f"`{c}`") for c in kept], "_found")


def luhn_sum(digits: Column) -> Column:
    """The check sum of a string of digits; valid if it divides by 10."""
    ds = F.reverse(F.split(digits, ""))

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    return F.aggregate(F.transform(F.filter(ds, lambda d: d != ""), worth), F.lit(0), lambda s, x: s + x)


def mod_97(signs: Column) -> Column:
    """The remainder by 97 of a string of digits and capital letters, A to Z being 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(signs, ""), lambda c: c != ""), F.lit(0), step)


def is_entity(kind: Column, m: Column) -> Column:
    """A number of a card's or an account's form counts only with right check digits."""
    account = F.replace(m, F.lit(" "), F.lit(""))
    card = luhn_sum(F.regexp_replace(m, "[^0-9]", "")) % 10 == 0
    iban = mod_97(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))) == 1
    return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(F.lit(True))


# ---------------------------------------------------------------- surrogates
def _nth(digest: Column, i: Column, n: int | Column) -> Column:
    """A number under n from the i-th part of a hex digest."""
    return F.conv(F.substring(digest, (i % 42) * 3 + 1, F.lit(3)), 16, 10).cast("int") % n


def _keyed(key: str, *parts: Column) -> Column:
    """HMAC-SHA512 of the parts, in hex."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), F.concat_ws("\u0001", *parts).cast("binary")), 512)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), F.unhex(inner)), 512)


def _swap(text: Column, digest: Column, keep: Column | int = 0) -> Column:
    """Each ASCII letter and digit after the first ``keep`` signs becomes another of its kind."""

    def one(c: Column, i: Column) -> Column:
        def other(signs: str) -> Column:  # never the same sign again
            return F.substring(F.lit(signs), F.pmod(F.instr(F.lit(signs), c) + _nth(digest, i, len(signs) - 1), F.lit(len(signs))) + 1, F.lit(1))

        new = F.when(c.rlike("[0-9]"), other("0123456789")).when(c.rlike("[a-z]"), other("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), other("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex_swap(text: Column, digest: Column) -> Column:
    """Each sign of a hex string becomes another one of its case."""
    low = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), _nth(digest, i, 16) + 1, F.lit(1))), "")
    return F.when(text.rlike("[A-F]"), F.upper(low)).otherwise(low)


def surrogate_digits(kind: Column, digits: Column, digest: Column) -> Column:
    """New digits: a country code or an issuer digit stays, and a card gets a right check digit."""
    head = F.when(kind == "phone", F.length(F.regexp_extract(digits, f"^({COUNTRY})", 1))).when(kind == "card", F.lit(1)).otherwise(F.lit(0))

    def one(d: Column, i: Column) -> Column:
        first = F.when(kind == "phone", 2 + _nth(digest, i, 8)).otherwise(_nth(digest, i, 10))  # no area begins with 0 or 1
        return F.when(i < head, d).when(i == head, first.cast("string")).otherwise(_nth(digest, i, 10).cast("string"))

    joined = F.array_join(F.transform(F.split(digits, ""), one), "")
    stem = F.substring(joined, F.lit(1), F.length(joined) - 1)
    check = F.pmod(10 - luhn_sum(F.concat(stem, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(kind == "card", F.concat(stem, check)).otherwise(joined)


def _account(canon: Column, digest: Column) -> Column:
    """An account number of the same country and form with right check digits."""
    country, body = F.substring(canon, 1, 2), _swap(F.substring(canon, F.lit(5), F.length(canon)), digest)
    check = F.lpad((98 - mod_97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, body)


def _into_format(m: Column, signs: Column) -> Column:
    """The last of ``signs`` in place of the letters and digits of a mention, what stands between them kept."""
    n = F.length(F.regexp_replace(m, "[^0-9A-Za-z]", ""))
    start = F.struct(F.lit("").alias("out"), (F.length(signs) - n + 1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_sign = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(s["out"], F.when(is_sign, F.substring(signs, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_sign.cast("int")).alias("at"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def _address(digest: Column) -> Column:
    """Four octets of the public kind."""
    first = F.get(F.array(*[F.lit(x) for x in range(11, 224) if x not in (100, 127, 169, 172, 192, 198, 203)]), _nth(digest, F.lit(0), 206))
    return F.concat_ws(".", first, *[_nth(digest, F.lit(k), 254) + 1 for k in (1, 2, 3)])


def _address_6(m: Column, digest: Column) -> Column:
    """Eight groups of the public kind, in the case of the mention."""
    groups = [F.concat(F.lit("2"), F.substring(digest, 2, 3))] + [F.regexp_replace(F.substring(digest, 4 * k + 1, 4), "^0+(?=.)", "") for k in range(1, 8)]
    low = F.concat_ws(":", *groups)
    return F.when(m.rlike("[A-F]"), F.upper(low)).otherwise(low)


def _word(kind: Column, canon: Column, digest: Column, attempt: Column) -> Column:
    """A given name or a family name of the code that leads the canonical form; each attempt has a larger choice."""
    code = F.substring(canon, 1, 2)
    pool = F.element_at(_literal_map(GIVEN), code)
    given = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: F.get(pool, _nth(digest, k, F.size(pool)))), "-")
    syllables = F.element_at(_literal_map(SYLLABLES), F.substring(code, 2, 1))
    stem = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda k: F.get(syllables, _nth(digest, k, F.size(syllables)))), "")
    return F.when(kind == "given", given).otherwise(F.initcap(F.concat(stem, F.element_at(_literal_map(ENDINGS), code))))


def surrogate(key: str, kind: Column, canon: Column, m: Column, attempt: Column) -> Column:
    """The replacement of a unit ``m``."""
    attempt = attempt.cast("int")
    keys = F.struct(_keyed(key, kind, canon, attempt.cast("string")).alias("own"), _keyed(key, F.lit("domain"), F.regexp_extract(canon, "@(.*)$", 1)).alias("domain"))

    def made(z: Column) -> Column:
        digest = z["own"]
        label = _swap(F.regexp_extract(m, r"^[^@]*@(.*)\.[^.]*$", 1), z["domain"])
        mail = F.concat(_swap(F.regexp_extract(m, "^([^@]*)@", 1), digest), F.lit("@"), label, F.regexp_extract(m, r"(\.[^.]*)$", 1))
        secret = F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _hex_swap(m, digest)).otherwise(_swap(m, digest, F.when(m.startswith("sk-"), 3).otherwise(4)))
        number = _into_format(m, F.when(kind == "iban", _account(canon, digest)).otherwise(surrogate_digits(kind, canon, digest)))
        same = F.when(kind == "email", mail).when(kind == "ip", _address(digest)).when(kind == "ipv6", _address_6(m, digest)).when(kind.isin("phone", "card", "ssn", "iban"), number).when(kind == "secret", secret).otherwise(_word(kind, canon, digest, attempt))
        more = F.lpad((F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % 10000).cast("string"), 4, "0")
        before = F.when((attempt >= LONGER) & (kind == "email"), more).otherwise("")
        after = F.when((attempt >= LONGER) & kind.isin("phone", "ssn"), F.concat(F.lit("-"), more)).otherwise("")
        return F.concat(before, same, after)

    # the keys are bound once: named in each part, they would be hashed for each sign and make the plan large
    return F.get(F.transform(F.array(keys), made), F.lit(0))


def _compared(kind: Column, canon: Column, made: Column) -> Column:
    """The canonical form of a replacement, in which replacements and entities are compared."""
    return F.when(kind.isin("given", "family"), F.concat(F.substring(canon, 1, 2), F.lower(made))).otherwise(canonical(kind, made))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct kind and canon of the units of the corpus, each with the least of its mentions."""
    read = with_found(docs.select(F.col("text").cast("string").alias("text")))
    each = read.select(F.explode(F.flatten(F.transform(F.filter("_found", lambda x: x["ok"]), lambda x: x["units"]))).alias("u"))
    return each.groupBy("u.kind", "u.canon").agg(F.min("u.m").alias("m"))


def attempts(docs: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first replacement was taken or is itself an entity of the corpus.

    Each round compares the replacements of the entities left with all entities and with those settled before.
    """
    found = settle(entities(docs), "entities")
    left, done = found, None
    for attempt in range(LAST_ATTEMPT + 1):
        made = surrogate(key, F.col("kind"), F.col("canon"), F.col("m"), F.lit(attempt))
        tried = settle(left.withColumn("s", _compared(F.col("kind"), F.col("canon"), made)), "surrogates")
        winners = tried.groupBy("kind", "s").agg(F.min("canon").alias("canon"))
        winners = winners.join(found.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_anti")
        if done is not None:
            winners = winners.join(done.select("kind", "s"), ["kind", "s"], "left_anti")
        winners = settle(winners.select("kind", "s", "canon", F.lit(attempt).alias("attempt")), "settled")
        done = winners if done is None else done.unionByName(winners)
        left = settle(tried.drop("s").join(winners, ["kind", "canon"], "left_anti"), "left")
        if not left.limit(1).count():
            return done.where("attempt > 0").select("kind", "canon", "attempt")
    raise RuntimeError(f"no replacement is left for some entities after {LAST_ATTEMPT} attempts")


def _woven(text: Column, pattern: Column, new: Column) -> Column:
    """A text whose matches of a pattern are replaced by ``new`` in order."""
    return F.get(F.transform(F.array(F.split(text, pattern)), lambda cut: F.concat(F.array_join(F.zip_with(F.slice(cut, 1, F.size(new)), new, lambda a, b: F.concat(a, b)), ""), F.element_at(cut, -1))), F.lit(0))


def _name_again(x: Column) -> Column:
    """(new, plain, words): a name with its new words, and where it has two words or more, it and they without the title."""
    old = name_words(x["m"])
    blanks = F.regexp_extract_all(F.regexp_replace(x["m"], f"^{_HEAD}", ""), F.lit(f"({_BLANK})"), F.lit(1))
    words = F.zip_with(old, x["made"], lambda w, new: F.when(F.upper(bare(w)) == bare(w), F.upper(new)).otherwise(new))

    def again(made: Column) -> Column:
        said = F.array_join(F.transform(made, lambda w, i: F.concat(F.when(i > 0, F.get(blanks, i - 1)).otherwise(F.lit("")), w)), "")
        end = F.regexp_extract(x["m"], f"({_END})", 1)
        plain = F.when(F.size(made) > 1, F.array_join(F.transform(old, lambda w, i: F.when(i == F.size(old) - 1, bare(w)).otherwise(w)), " "))
        return F.struct(F.concat(F.regexp_extract(x["m"], f"^({_HEAD})", 1), said, end).alias("new"), plain.alias("plain"), made.alias("words"))

    return _let(words, again)


#: A capital word, and it with up to two that follow it.
_WORD = rf"(?<![\p{{L}}'’-]){_NAME}"
_WINDOW = rf"(?<![\p{{L}}'’-])(?=({_NAME}(?:{_BLANK}{_NAME}){{0,2}})){_NAME}"


def _untitled(piece: Column, names: Column) -> Column:
    """A text between entities with the names of ``names``, an index of new words by old ones, replaced word by word.

    Where two names overlap, a word follows the one that begins first.
    """

    def hit(window: Column) -> Column:
        def of(words: Column) -> Column:
            name = lambda n: F.array_join(F.transform(F.slice(words, 1, n), lambda w, i: F.when(i == n - 1, bare(w)).otherwise(w)), " ")
            three = F.when(F.size(words) > 2, find(names, name(3)))
            return F.coalesce(three, F.when(F.size(words) > 1, find(names, name(2))))

        return _let(F.split(window, _BLANK), of)

    def new(hits: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            third, second, own = F.get(F.get(hits, i - 2), F.lit(2)), F.get(F.get(hits, i - 1), F.lit(1)), F.get(F.get(hits, i), F.lit(0))
            return _let(F.coalesce(third, second, own), lambda made: F.when(made.isNull(), w).otherwise(F.concat(made, F.regexp_extract(w, f"({_END})", 1))))

        return F.transform(F.regexp_extract_all(piece, F.lit(_WORD), F.lit(0)), word)

    hits = F.transform(F.regexp_extract_all(piece, F.lit(_WINDOW), F.lit(1)), hit)
    return _woven(piece, F.lit(_WORD), _let(hits, new))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """(row, n_entities): each row of ``docs`` as a struct with its text replaced, and the mentions replaced in it.

    The row is a struct, so that no column of it can clash with those made here.
    """
    again = settle(attempts(docs, key), "attempts")
    n = again.count()
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    base = with_found(base)
    none = F.expr("cast(array() as array<struct<k:string,v:int>>)")
    if n:
        base = base.withColumn("_row", F.struct(F.xxhash64("text"), F.length("text")))
        named = base.where(F.size("_found") > 0).select("_row", F.explode(F.flatten(F.transform("_found", lambda x: F.transform(x["units"], lambda u: F.struct(u["kind"].alias("kind"), u["canon"].alias("canon")))))).alias("x")).select("_row", "x.kind", "x.canon")
        named = named.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, ["kind", "canon"]).distinct()
        by_row = named.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "canon").alias("k"), F.col("attempt").alias("v")))).alias("_tries"))
        by_row = settle(by_row, "tries")
        base = base.join(F.broadcast(by_row) if by_row.count() <= BROADCAST_ROWS else by_row, "_row", "left").withColumn("_tries", F.coalesce("_tries", none))
    else:
        base = base.withColumn("_tries", none)

    def unit(u: Column) -> Column:
        attempt = F.coalesce(find(F.col("_tries"), F.concat_ws("\u0001", u["kind"], u["canon"])), F.lit(0))
        return _let(attempt, lambda k: surrogate(key, u["kind"], u["canon"], u["m"], k))

    def again_of(x: Column) -> Column:
        plain = lambda new: F.struct(new.alias("new"), F.lit(None).cast("string").alias("plain"), F.lit(None).cast("array<string>").alias("words"))
        return F.when(~x["ok"], plain(x["m"])).when(x["kind"] == "name", _name_again(x)).otherwise(plain(F.get(x["made"], F.lit(0))))

    made = F.transform("_found", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["ok"].alias("ok"), F.when(x["ok"], F.transform(x["units"], unit)).alias("made")))
    base = base.withColumn("_new", F.transform(made, again_of))
    plain = F.transform(F.filter("_new", lambda x: x["plain"].isNotNull()), lambda x: F.struct(x["plain"].alias("k"), x["words"].alias("v")))
    base = base.withColumn("_named", index(plain))

    def rest(piece: Column) -> Column:
        return F.when(F.size("_named") == 0, piece).otherwise(_untitled(piece, F.col("_named")))

    cut = F.transform(F.split("text", ENTITY), rest)
    news = F.zip_with("_new", "_found", lambda x, y: F.concat(x["new"], F.when(y["tail"] == "", "").otherwise(rest(y["tail"]))))
    woven = _let(F.struct(cut.alias("cut"), news.alias("new")), lambda z: F.concat(F.array_join(F.zip_with(F.slice(z["cut"], 1, F.size(z["new"])), z["new"], lambda a, b: F.concat(a, b)), ""), F.element_at(z["cut"], -1)))
    text = F.when(F.size("_found") > 0, woven).otherwise(F.col("text"))
    count = F.size(F.filter("_found", lambda x: x["ok"]))
    return base.select(F.col("row").withField("text", text).alias("row"), count.alias("n_entities"))


def replace_in_documents(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with replaced texts and the same columns; n_chars, where it is one, follows the new text."""
    out = replace(docs, key).select("row.*")
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


#: The key of the registered query and of the pipeline; a real run gives its own, and keeps it secret.
KEY = "nearfield-example-key"


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates and n_entities of every document."""
    return replace(documents(spark, sf_dir).select("doc_id", "text"), KEY).select("row.doc_id", "row.text", "n_entities")
