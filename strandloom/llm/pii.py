"""Surrogates for personal data, with DataFrame functions only.

Entities are the two parts of e-mail addresses (local part and domain), phone numbers, IP addresses
of both versions, account and card numbers, social security numbers, IBANs, and the words of names.
A name is known by a form of address before it; from there on each of its words is an entity
wherever it stands in the document, alone, in another order or in capitals, so that coreference
holds. The last word of a name is a family name, the others are given names of the gender that the
form of address tells.

Each distinct entity gets a surrogate that a secret key and the entity's canonical form decide: of
the same type and format (digit counts, punctuation, letter case, country code, Luhn validity), and
for names of the same script and gender. Forms of one entity ("+1 (665) 555-8922", "+1 665-555-8922";
"Schmidt", "SCHMIDT") share a surrogate, written in each form. Parts are kept apart one by one, so
addresses and full names are distinct if and only if they were, and those of one domain or family
keep sharing it.

Collision checks run over all distinct entities: a surrogate that equals another one, or an entity
that really occurs, is drawn again until every entity has one of its own; formats with little room
grow with the attempts, numbers last and by as few digits as needed. Of entities that want one surrogate the least canonical form keeps it. Only
entities that were drawn again travel back to documents, by a join; all others are computed in place.

Defined results: a null text stays null; a text without entities stays as it is; repeated rows get
the same text; an empty table stays empty; all other columns pass through (names starting with
``__p_`` are not supported). Not found: names without a form of address in their document, dates,
postal addresses, national phone numbers in groups other than 3-3-4.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import documents, materialise

#: Stands in for the secret key; production passes its own, or sets ``KEY_SETTING`` in the session.
KEY = "strandloom demonstration key"
KEY_SETTING = "spark.strandloom.pii.key"
#: Redrawn entities up to this number are sent to all executors, more are joined by shuffle.
SENT = 2_000
#: Attempts after which parts of addresses and names grow.
ROOMY = 3
#: Attempts after which a number grows: by one digit, and by one more every ``STEP`` attempts. A format can hold fewer numbers
#: than a corpus has of it, so some of them must leave it to stay distinct.
FULL, STEP = 8, 3

#: Forms of address by gender.
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
MALE, FEMALE = f"{MALE}|{MALE.upper()}", f"{FEMALE}|{FEMALE.upper()}"
TITLES = "Dr|Prof|Doctor|Professor|Доктор|Профессор|DR|PROF"
#: First letters of all forms, so that a search need not try them elsewhere.
_INITIAL = f"(?=[{''.join(sorted({w[0] for w in f'{MALE}|{FEMALE}|{TITLES}'.split('|')}))}])"
_ADDRESS = rf"(?:{MALE}|{FEMALE}|{TITLES})\.?(?: (?:{TITLES})\.?)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Letters of mail addresses: of A to Z and of other scripts, as ranges.
_MAIL = r"A-Za-z\u00C0-\u1FFF\u2C00-\uD7FF0-9"
_HOST = rf"[{_MAIL}-]++(?:\.[{_MAIL}-]++)+"
LOCAL = rf"(?<![{_MAIL}._%+-])[{_MAIL}._%+-]++@(?={_HOST})"
DOMAIN = rf"(?<=[{_MAIL}._%+-]@){_HOST}"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\w:]|\.\d)"
IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\dA-Za-z.])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])"
#: Three, three and four digits; after "+" 7 to 15 digits in any groups; ten digits, of which the first is not 1.
PHONE = (
    r"(?<![\dA-Za-z.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    rf"|\+(?!{_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))[1-9](?:(?:[ .-]|[ .-]?\(|\)[ .-]?)?\d){{6,14}}|[02-9]\d{{9}}(?!\.\d))(?![\dA-Za-z])"
)
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)*"
_CAPITALS = r"(?:\p{Lu}['’])?\p{Lu}{2,}(?![\p{L}\d])"
_PARTICLES = r"(?:(?:von|van|vom|zu|zum|zur|der|den|dem|de|del|della|di|da|dos|das|do|du|la|le|las|los|bin|ibn|ter|ten) |d['’]){0,3}"
_LETTERS = r"(?:\p{Lu}\.[ -]?){0,3}"
NAME = rf"{_INITIAL}(?<!\p{{L}}){_ADDRESS} {_LETTERS}{_PARTICLES}(?:{_WORD}(?:(?:-| {_PARTICLES}){_WORD}){{0,2}}|{_CAPITALS}(?:[ -]{_CAPITALS}){{0,2}})"
#: What to look for in a text that has an at sign, in one with colons as of version 6, and in one with a digit.
MAIL, NUMBERS = f"{LOCAL}|{DOMAIN}", f"(?=[0-9A-Z(+])(?:{'|'.join((IP, IBAN, SSN, CARD, PHONE))})"
COLONS = rf"::|(?:{_HEX}:){{7}}"
#: What a name after its form of address begins with.
CALLED = rf"{_INITIAL}{_ADDRESS} \p{{L}}"

NAMES = ("family", "given_f", "given_m", "given_n")
KINDS = ("local", "domain", "ip", "ip6", "iban", "ssn", "card", "phone", *NAMES)
#: Columns of the query and the kinds that they count.
TYPES = {"email": ("local",), "ip": ("ip", "ip6"), "iban": ("iban",), "ssn": ("ssn",), "card": ("card",), "phone": ("phone",), "name": NAMES}

_SYLLABLES = {
    "Latin": "ba be bo da de do fa ga go ka ke ko la le lo ma me mo na no pa ra re ro sa so ta te to va vo za".split(),
    "Cyrillic": "ба бо ва во га го да до за зо ка ко ла ло ма мо на но па ро са со та то фа хо".split(),
    "Greek": "βα βο γα γο δα δο θα θο κα κο λα λο μα μο να νο πα πο ρα ρο σα σο τα το".split(),
}
_ENDINGS = {"Latin": ("n", "ra"), "Cyrillic": ("н", "ра"), "Greek": ("ς", "ρα")}


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def type_of(entity: Column, words: Column) -> Column:
    """The kind of a match; ``words`` are the document's name words (word in capitals, role)."""
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    role = F.get(F.filter(words, lambda w: w["word"] == F.upper(entity)), F.lit(0))["role"]
    return (
        F.when(entity.endswith("@"), "local")
        .when(F.contains(entity, F.lit(":")), "ip6")
        .when(entity.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(entity.rlike(r"\p{L}.*\.|\..*\p{L}"), "domain")
        .when(entity.rlike(r"^[A-Z]{2}\d"), "iban")
        .when(role.isNotNull(), role)
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when((digits >= 13) & ~entity.startswith("+"), "card")
        .otherwise("phone")
    )


def canonical(kind: Column, entity: Column) -> Column:
    """What forms of one entity have in common."""
    return (
        F.when(kind == "local", F.lower(F.regexp_replace(entity, "@$", "")))
        .when(kind.isin("domain", "ip6"), F.lower(entity))
        .when(kind.isin(*NAMES), F.upper(entity))
        .when(kind.isin("ip", "iban"), entity)
        .otherwise(F.regexp_replace(entity, "[^0-9+]", ""))
    )


def _number(h: Column, i: Column, n: int) -> Column:
    """A number below n from four hex digits of a digest."""
    return (F.conv(F.substring(h, (i * 3) % 61 + 1, F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


#: Letters to draw from, by script; all scripts that are not listed get Latin ones.
_ALPHABETS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Latin": "abcdefghijklmnopqrstuvwxyz"}


def _scramble(text: Column, h: Column) -> Column:
    """Letters become letters, digits digits, all else stays; capitals only of A to Z."""

    def one(c: Column, i: Column) -> Column:
        small = None
        for script, letters in _ALPHABETS.items():
            pick = F.substring(F.lit(letters), _number(h, i, len(letters)) + 1, F.lit(1))
            small = F.when(c.rlike(rf"\p{{Is{script}}}"), pick) if small is None else small.when(c.rlike(rf"\p{{Is{script}}}"), pick)
        latin = F.substring(F.lit(_ALPHABETS["Latin"]), _number(h, i, 26) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), _number(h, i, 10).cast("string")).when(c.rlike("[A-Z]"), F.upper(latin)).when(c.rlike(r"\p{L}"), small.otherwise(latin)).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _recased(made: Column, like: Column) -> Column:
    """``made`` with capitals where ``like`` has them."""
    return F.array_join(F.transform(_chars(made), lambda c, i: F.when(F.substring(like, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The canonical surrogate of a canonical entity."""
    digest = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, attempt.cast("string")), 256)
    size = F.length(canon)

    more = lambda h, after: F.when(attempt > after, F.substring(h, 1, 2)).otherwise("")

    def extra(h: Column) -> Column:
        """Digits that a full format lacks."""
        n = F.floor((attempt - FULL) / STEP).cast("int") + 1
        return F.when(attempt >= FULL, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _number(h, i * 5 + 2, 10).cast("string")), "")).otherwise("")

    def domain(h: Column) -> Column:
        end = F.substring_index(canon, ".", -1)
        host = F.substring(canon, F.lit(1), size - F.length(end) - 1)
        return F.concat(_scramble(host, h), more(h, ROOMY), F.lit("."), end)

    def digits(h: Column, kept: Column, lead: Column) -> Column:
        """Digits after the first ``kept`` are drawn; the one after them is ``lead`` or more."""
        one = lambda c, i: F.when((i < kept) | (c == "+"), c).when(i == kept, (lead + _number(h, i, 10) % (10 - lead)).cast("string")).otherwise(_number(h, i, 10).cast("string"))
        return F.concat(F.array_join(F.transform(_chars(canon), one), ""), extra(h))

    def card(h: Column) -> Column:
        drawn = digits(h, F.lit(1), F.lit(0))
        body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
        valid = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), _luhn), F.lit(0))
        return F.when(_luhn(canon), valid).otherwise(drawn)

    def ip(h: Column) -> Column:
        # numbers above 255 are in no real address
        one = lambda i: F.when(attempt >= FULL, _number(h, i, 744) + 256).otherwise(_number(h, i, 254) + 1).cast("string")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), one), ".")

    def ip6(h: Column) -> Column:
        hexes = F.lit("0123456789abcdef")
        drawn = F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(F.substring(hexes, _number(h, i, 16) + 1, F.lit(1))))
        return F.concat(F.array_join(drawn, ""), F.when(F.contains(canon, F.lit("::")) & (attempt > ROOMY), F.concat(F.lit(":"), F.substring(h, 1, 4))).otherwise(""))

    def name(h: Column) -> Column:
        script = F.when(canon.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(canon.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
        out = None
        for s, syllables in _SYLLABLES.items():
            pick = lambda k, syllables=syllables: F.element_at(F.array(*map(F.lit, syllables)), _number(h, F.lit(k), len(syllables)) + 1)
            # later attempts draw longer names, so that there is always room
            body = F.concat(pick(0), pick(1), F.when(attempt > 3, pick(2)).otherwise(""), F.when(attempt > 12, pick(3)).otherwise(""), F.when(attempt > 24, F.concat(pick(5), pick(6))).otherwise(""))
            end = F.when(kind == "given_f", _ENDINGS[s][1]).when(kind == "given_m", _ENDINGS[s][0]).otherwise(pick(7))
            made = F.upper(F.concat(body, end))
            out = F.when(script == s, made) if out is None else out.when(script == s, made)
        return out

    def all_types(h: Column) -> Column:
        return (
            F.when(kind == "local", F.concat(_scramble(canon, h), more(h, ROOMY)))
            .when(kind == "domain", domain(h))
            .when(kind == "ip", ip(h))
            .when(kind == "ip6", ip6(h))
            .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _scramble(F.substring(canon, F.lit(3), size), h), extra(h)))
            .when(kind == "ssn", digits(h, F.lit(0), F.lit(1)))
            .when(kind == "card", card(h))
            .when(kind == "phone", digits(h, F.greatest(F.when(canon.rlike(r"^\+[2-9]"), 3).otherwise(0), size - 10), F.lit(2)))
            .when(kind.isin(*NAMES), name(h))
        )

    return _bind(digest(kind, canon), all_types)


def written(kind: Column, entity: Column, made: Column) -> Column:
    """A canonical surrogate in the form of one occurrence."""
    figures = F.regexp_replace(made, r"\D", "")
    nth = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"\D", ""))
    filled = F.array_join(F.transform(_chars(entity), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(figures, nth(i + 1), F.lit(1))).otherwise(c)), "")
    return (
        F.when(kind == "local", F.concat(_recased(made, entity), F.lit("@")))
        .when(kind == "domain", _recased(made, entity))
        .when(kind == "ip6", F.when(entity == F.upper(entity), F.upper(made)).otherwise(made))
        .when(kind.isin(*NAMES), F.when(entity == F.upper(entity), made).otherwise(F.initcap(made)))
        .when(kind.isin("ip", "iban"), made)
        .otherwise(F.concat(filled, F.substring(figures, nth(F.length(entity)) + 1, F.length(figures))))
    )


def _name_words(text: Column) -> Column:
    """The words of all names after a form of address, in capitals, with their roles."""

    def roles(name: Column) -> Column:
        gender = F.when(name.rlike(rf"^(?:{FEMALE})\.? "), "given_f").when(name.rlike(rf"^(?:{MALE})\.? "), "given_m").otherwise("given_n")
        words = F.regexp_extract_all(F.regexp_replace(name, rf"^{_ADDRESS} ", ""), F.lit(rf"{_CAPITALS}|{_WORD}"), F.lit(0))
        return _bind(words, lambda w: F.transform(w, lambda x, i: F.struct(F.upper(x).alias("word"), F.when(i == F.size(w) - 1, "family").otherwise(gender).alias("role"))))

    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))), roles)
    return F.when(text.rlike(CALLED), F.array_distinct(F.flatten(found)))


def detect(docs: DataFrame) -> DataFrame:
    """Add ``__p_found``, the entities of each whole text in order, as structs (entity, kind, canon), and ``__p_pattern``, which finds them."""
    text, words = F.col("text"), F.col("__p_words")
    staged = docs.select("*", _name_words(text).alias("__p_words"))
    forms = F.flatten(F.transform(words, lambda w: F.array(w["word"], F.initcap(w["word"]))))
    seen = F.array_distinct(F.concat(forms, F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}})(?:{_CAPITALS}|{_WORD})"), F.lit(0))))
    # every written form of a name word: in capitals, capitalised, or as it stands with inner capitals
    own = F.filter(seen, lambda x: F.exists(words, lambda w: w["word"] == F.upper(x)))
    named = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(own, "|"), F.lit(r")(?=['’]?s?(?!\p{L}))"))
    # only what a text can hold is looked for
    wanted = F.array(F.when(F.contains(text, F.lit("@")), MAIL), F.when(text.rlike(COLONS), IP6), F.when(text.rlike("[0-9]"), NUMBERS), F.when(F.size(words) > 0, named))
    staged = staged.select("*", F.nullif(F.array_join(wanted, "|"), F.lit("")).alias("__p_pattern"))
    staged = staged.select("*", F.when(F.col("__p_pattern").isNotNull(), F.regexp_extract_all(text, F.col("__p_pattern"), F.lit(0))).alias("__p_raw"))
    typed = F.transform("__p_raw", lambda e: F.struct(e.alias("entity"), type_of(e, words).alias("kind")))
    staged = staged.select("*", typed.alias("__p_typed"))
    found = F.transform("__p_typed", lambda x: F.struct(x["entity"].alias("entity"), x["kind"].alias("kind"), canonical(x["kind"], x["entity"]).alias("canon")))
    return staged.select(*(F.col(f"`{c}`") for c in docs.columns), found.alias("__p_found"), "__p_pattern")


def redrawn(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate collides, until all are distinct."""
    entities = detect(docs.select("text")).filter(F.size("__p_found") > 0).select(F.explode("__p_found").alias("e")).select("e.kind", "e.canon").distinct()
    entities = materialise(entities, "entities")
    real = entities.select("kind", F.col("canon").alias("made"))
    waiting, settled, again = entities, None, None
    for attempt in itertools.count():
        drawn = waiting.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key).alias("made"))
        free = drawn.join(real, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        first = free.groupBy("kind", "made").agg(F.min("canon").alias("canon")).select("kind", "canon", "made")
        first = materialise(first.select("*", F.lit(attempt).alias("attempt")), "surrogates")
        if attempt:
            again = first if again is None else again.unionByName(first)
        settled = first if settled is None else settled.unionByName(first)
        waiting = materialise(waiting.join(first, ["kind", "canon"], "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    return (again if again is not None else settled.limit(0)).select("kind", "canon", "attempt")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``__p_found`` as :func:`detect` makes it."""
    again = redrawn(docs, key)
    found = detect(docs)
    n = again.count()
    if n:
        found = found.select("*", F.xxhash64("text").alias("__p_text"))
        touched = found.filter(F.size("__p_found") > 0).select("__p_text", F.explode("__p_found").alias("e")).select("__p_text", "e.kind", "e.canon").distinct()
        touched = touched.join(again, ["kind", "canon"]).groupBy("__p_text").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("__p_again"))
        touched = materialise(touched, "redrawn").withColumnRenamed("__p_text", "__p_of")
        # the texts that hold a redrawn entity: sent along while few, else joined by shuffle
        few = touched.count() <= SENT
        found = found.join(F.broadcast(touched) if few else touched, F.col("__p_text") == F.col("__p_of"), "left")
    else:
        found = found.select("*", F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int>>").alias("__p_again"))
    attempt = lambda x: F.coalesce(F.get(F.filter("__p_again", lambda a: (a["kind"] == x["kind"]) & (a["canon"] == x["canon"])), F.lit(0))["attempt"], F.lit(0))
    told = F.transform("__p_found", lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), x["canon"].alias("canon"), attempt(x).alias("attempt")))
    new = F.transform("__p_told", lambda x: _bind(surrogate(x["kind"], x["canon"], x["attempt"], key), lambda made: written(x["kind"], x["entity"], made)))
    # as many gaps as entities and one more, in turn
    pieces = F.transform("__p_gaps", lambda g, i: F.concat(g, F.coalesce(F.get("__p_new", i), F.lit(""))))
    some = F.size("__p_found") > 0
    rows = found.select("*", F.when(some, told).alias("__p_told"))
    rows = rows.select("*", F.when(some, new).alias("__p_new"), F.when(some, F.split("text", F.col("__p_pattern"), -1)).alias("__p_gaps"))
    text = F.when(some, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text")
    return rows.select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns), "__p_found")


def key_of(spark: SparkSession) -> str:
    """The session's key."""
    return spark.conf.get(KEY_SETTING, KEY)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates for personal data in ``text``; the key is the session's if none is given."""
    return replace(docs, key or key_of(docs.sparkSession)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replace(documents(spark, sf_dir).select("doc_id", "text"), key_of(spark))
    count = lambda kinds: F.coalesce(F.size(F.filter("__p_found", lambda x: x["kind"].isin(*kinds))), F.lit(0)).cast("long")
    return rows.select("doc_id", "text", *(count(kinds).alias(f"n_{name}") for name, kinds in TYPES.items()))
