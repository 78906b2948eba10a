"""Personal data: keyed surrogates, all in DataFrame functions.

Entities are found by patterns, and each distinct one (by type and normal form)
gets one surrogate from a keyed hash: an address stays an address of the same
shape, a phone keeps its country code and layout, a card its first digit and a
valid check digit, a network address stays valid, a name after a title keeps its
script and the title's gender, letter case follows the original. All mentions of
an entity, in whatever layout, get the same surrogate (coreference); collision
rounds give a new one to every entity whose surrogate another entity has, or
that is itself an entity of the corpus, until all are distinct.

Only documents with a mention are shuffled; entities are distinct before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_of
from timberline.session import cut

# Titles by gender, and syllables surrogate names are built from, by script.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Signora", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ka", "la", "le", "li", "ma", "mi", "na", "ne", "no", "ra", "ri", "sa", "ta", "vi"),
    "cyrillic": ("ба", "бе", "да", "до", "ве", "га", "ка", "ла", "ле", "ли", "ма", "ми", "на", "не", "но", "ра", "ри", "са", "та", "ви"),
    "greek": ("βα", "βε", "δα", "δο", "φε", "γα", "κα", "λα", "λε", "λι", "μα", "μι", "να", "νε", "νο", "ρα", "ρι", "σα", "τα", "βι"),
}
ENDINGS = {"given_m": ("n", "н", "ν"), "given_f": ("a", "я", "α"), "given_n": ("", "", ""), "family": ("s", "в", "ς")}

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_AMEX = r"[0-9]{4}[ -](?:[0-9]{6}[ -][0-9]{4,5}|[0-9]{5}[ -][0-9]{6}|[0-9]{4}[ -][0-9]{5})(?![0-9])"
#: Runs of groups of four, which may hold other numbers before and after a card; a short last group if no number follows it.
FOURS = rf"[0-9]{{4}}(?:[ -](?!{_AMEX})[0-9]{{4}}(?![0-9])){{3,}}(?:[ -][0-9]{{1,3}}(?![ -]?[0-9]))?"
CARD = rf"(?<![0-9+])(?:[0-9]{{13,19}}|[0-9]{{6}}[ -][0-9]{{13}}|{_AMEX}|{FOURS})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Country codes: of one, two and three digits.
_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
PHONE = (r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)[ .-]?|[0-9]{1,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
         r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-](?:[0-9](?:[ .-][0-9]{2}){4}|[0-9]{2}(?:[ .-][0-9]{2}){3,4}|[0-9][ .-][0-9]{3}(?:[ .-][0-9]{2}){2})(?![0-9])"
         rf"|(?<![0-9A-Za-z+])\+{_CODE}[0-9]{{6,13}}(?![0-9])"
         r"|(?<![0-9A-Za-z+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
         r"|(?<![0-9A-Za-z+.-])(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
         r"|(?<![0-9A-Za-z+.-])(?:1[ .-])?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9])")
_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
NAME = rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?(?![\p{{L}}])"
NAME_PARTS = rf"^((?:{_TITLES})\.? )({_NAME})(?: ({_NAME}))?$"
#: Names and addresses get one more syllable or letter after so many attempts, so that no number of entities fills them.
GROWS = 2
ANY = f"{EMAIL}|{IP}|{SSN}|{PHONE}|{CARD}|{NAME}"
TYPES = ("email", "ip", "ssn", "phone", "card", "name")
#: A text without these holds no entity.
HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of a digit string from the right, every second digit doubled: those at odd (1) or even (0) places."""
    chars = F.reverse(F.split(digits, ""))
    value = F.transform(chars, lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
                        .otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b)


def kind_of(raw: Column) -> Column:
    """Type of a match; null for numbers that look like a card but fail its check digit."""
    def whole(pattern):
        return F.regexp_like(raw, F.lit(rf"^(?:{pattern})$"))

    return (F.when(raw.contains("@"), "email").when(whole(IP), "ip").when(whole(SSN), "ssn").when(whole(PHONE), "phone")
            .when(whole(CARD), F.when(luhn_sum(_digits(raw), 1) % 10 == 0, "card")).otherwise("name"))


def normal_form(kind: Column, raw: Column) -> Column:
    """What mentions of one entity have in common. A phone's country code is set off, as it is kept."""
    code = F.coalesce(*(F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")) for pattern in (
        r"^\+([0-9]{1,3})(?=[ .(-])", rf"^\+({_CODE})[0-9]{{6}}", r"^(1)[ .-]")), F.lit(""))
    rest = F.substring(_digits(raw), F.length(code) + 1, 99)
    return (F.when(kind == "phone", F.when(code != "", F.concat(code, F.lit("|"), rest)).otherwise(_digits(raw)))
            .when(kind.isin("card", "ssn"), _digits(raw)).when(kind == "ip", raw).otherwise(F.lower(raw)))


SEGMENTS = "array<struct<lit:string,kind:string,norm:string,raw:string>>"


def _cards(gap: Column, run: Column) -> Column:
    """Segments of a run of groups of four: from the left, each card of four groups, or of the last four and a short one.

    Of overlapping ones that pass by chance, one that starts like an issuer's comes first.
    """
    def valid(card: Column) -> Column:
        return luhn_sum(_digits(card), 1) % 10 == 0

    def issued(card: Column) -> Column:
        return (F.length(card) == 19) & F.regexp_like(card, F.lit("^(?:[3-6]|2[2-7])")) & valid(card)

    def step(done: Column, at: Column) -> Column:
        used = done["used"]
        four, rest = F.substr(run, at + 1, F.lit(19)), F.substr(run, at + 1, F.lit(99))
        later = F.exists(F.array(*map(F.lit, (5, 10, 15))), lambda by: issued(F.substr(run, at + by + 1, F.lit(19))))
        card = F.when((at >= used) & (F.length(four) == 19) & valid(four) & (issued(four) | ~later), four).when(
            (at >= used) & F.length(rest).between(21, 23) & valid(rest), rest)
        lit = F.concat(F.when(used == 0, gap).otherwise(""), F.substr(run, used + 1, at - used))
        found = F.array(F.struct(lit.alias("lit"), F.lit("card").alias("kind"), _digits(card).alias("norm"), card.alias("raw")))
        return F.when(card.isNull(), done).otherwise(F.struct((at + F.length(card)).alias("used"),
                                                              F.concat(done["found"], found.cast(SEGMENTS)).alias("found")))

    def finish(done: Column) -> Column:
        used = done["used"]
        last = F.struct(F.when(used == 0, gap).otherwise("").alias("lit"), F.lit(None).cast("string").alias("kind"),
                        F.lit(None).cast("string").alias("norm"), F.substr(run, used + 1, F.length(run)).alias("raw"))
        return F.concat(done["found"], F.array(last).cast(SEGMENTS))

    start = F.struct(F.lit(0).alias("used"), F.array().cast(SEGMENTS).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1, F.lit(5)), start, step, finish)


def _segments(text: Column) -> Column:
    """The text as literals and entities: ``array<struct<lit, kind, norm, raw>>``, each literal before its entity."""
    gaps, raws = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def seg(lit, kind, raw):
        kind = kind.cast("string")
        return F.struct(lit.alias("lit"), kind.alias("kind"), normal_form(kind, raw).alias("norm"), raw.alias("raw"))

    def one(raw, i):
        gap, kind = F.get(gaps, i), kind_of(raw)
        title, first, second = (F.regexp_extract(raw, NAME_PARTS, g) for g in (1, 2, 3))
        word = F.regexp_replace(title, r"\.? $", "")
        given = F.when(word.isin(*MALE), "given_m").when(word.isin(*FEMALE), "given_f").otherwise("given_n")
        single = F.array(seg(F.concat(gap, title), F.lit("family"), first))
        double = F.array(seg(F.concat(gap, title), given, first), seg(F.lit(" "), F.lit("family"), second))
        mixed = (F.length(raw) > 19) & F.regexp_like(raw, F.lit(rf"^(?:{FOURS})$"))
        return (F.when(kind == "name", F.when(second == "", single).otherwise(double)).when(mixed, _cards(gap, raw))
                .otherwise(F.array(seg(gap, kind, raw))))

    tail = F.struct(F.get(gaps, F.size(raws)).alias("lit"), F.lit(None).cast("string").alias("kind"),
                    F.lit(None).cast("string").alias("norm"), F.lit("").alias("raw"))
    return F.concat(F.flatten(F.transform(raws, one)), F.array(tail))


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, itself in normal form (a phone without the set-off mark)."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 256)
    h = F.sha2(F.concat(F.lit(key), inner).cast("binary"), 512)

    def byte(i):
        return F.conv(F.substr(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") + i

    def each(text, change):
        return F.array_join(F.transform(F.split(text, ""), change), "")

    def digit(i):
        return (byte(i) % 10).cast("string")

    more = F.floor(attempt / GROWS).cast("int")  # letters of an address or syllables of a name beyond the shape
    email = each(norm, lambda c, i: F.when(i >= F.length(norm) - F.length(F.substring_index(norm, ".", -1)), c)
                 .when(c.between("a", "z"), F.chr(97 + byte(i) % 26)).when(c.between("0", "9"), digit(i)).otherwise(c))
    longer = F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.chr(97 + byte(F.length(norm) + i) % 26))
    email = F.when(more > 0, F.concat(F.substring_index(email, "@", 1), F.array_join(longer, ""), F.lit("@"),
                                      F.substring_index(email, "@", -1))).otherwise(email)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6), F.lit(2)),
                                  lambda i: ((byte(i) * 256 + byte(i + 1)) % 254 + 1).cast("string")), ".")
    ssn = each(norm, lambda c, i: F.when(i == 0, "9").otherwise(digit(i)))
    code = F.when(norm.contains("|"), F.substring_index(norm, "|", 1)).otherwise("")
    rest = F.substring_index(norm, "|", -1)
    phone = F.concat(code, each(rest, lambda c, i: F.when(i == 0, (2 + byte(i) % 8).cast("string")).otherwise(digit(i))))
    body = F.concat(F.substring(norm, 1, 1), each(F.substr(norm, F.lit(2), F.length(norm) - 2), lambda c, i: digit(i)))
    card = F.concat(body, ((10 - luhn_sum(body, 0) % 10) % 10).cast("string"))

    def name(script: str, ending: int):
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        ends = F.when(kind == "given_m", ENDINGS["given_m"][ending]).when(kind == "given_f", ENDINGS["given_f"][ending]) \
            .when(kind == "family", ENDINGS["family"][ending]).otherwise("")
        size = F.when(F.length(norm) > 6, 4).otherwise(3) + more
        picked = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.element_at(parts, byte(i) % len(SYLLABLES[script]) + 1))
        return F.concat(F.array_join(picked, ""), ends)

    person = F.when(F.regexp_like(norm, F.lit(r"\p{IsCyrillic}")), name("cyrillic", 1)) \
        .when(F.regexp_like(norm, F.lit(r"\p{IsGreek}")), name("greek", 2)).otherwise(name("latin", 0))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "phone", phone)
            .when(kind == "card", card).otherwise(person))


def in_format(kind: Column, raw: Column, core: Column) -> Column:
    """A surrogate laid out like the mention it replaces: its punctuation or its letter case."""
    chars = F.split(raw, "")
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(
        c.between("0", "9"), F.substr(core, F.length(_digits(F.substr(raw, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    place = F.instr(raw, "@") - 1  # letters beyond the shape stand before the sign

    def cased_like(c: Column, i: Column) -> Column:
        more = F.length(core) - F.length(raw)
        own = F.get(chars, F.when(i < place, i).when(i >= place + more, i - more))
        return F.when(F.coalesce(own, F.lit("")).between("A", "Z"), F.upper(c)).otherwise(c)

    cased = F.array_join(F.transform(F.split(core, ""), cased_like), "")
    return (F.when(kind.isin("phone", "card", "ssn"), filled).when(kind == "email", cased).when(kind == "ip", core)
            .when(raw == F.upper(raw), F.upper(core)).otherwise(F.initcap(core)))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, norm, core)`` for distinct ``(kind, norm)``; no core is shared, or is itself a normal form of the kind."""
    now = entities.select("kind", "norm", F.lit(0).alias("attempt"))
    real = entities.select(F.col("kind").alias("k"), F.regexp_replace("norm", r"\|", "").alias("taken")).distinct()
    while True:
        now = cut(now.select("kind", "norm", "attempt", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")).alias("core")),
                  "surrogates")
        shared = now.groupBy("kind", "core").agg(F.min("norm").alias("keeps"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        marked = now.join(shared.drop("n"), ["kind", "core"], "left").join(
            real, (F.col("kind") == F.col("k")) & (F.col("core") == F.col("taken")), "left")
        clash = F.col("taken").isNotNull() | (F.col("keeps").isNotNull() & (F.col("norm") != F.col("keeps")))
        marked = cut(marked.select("kind", "norm", "attempt", F.coalesce(clash, F.lit(False)).alias("again")), "collisions")
        if marked.filter("again").isEmpty():
            return now.select("kind", "norm", "core")
        now = marked.select("kind", "norm", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``(doc, text, n)`` per row: the row as it was in a struct (whatever its columns are named), its text with
    surrogates, and the number of mentions per kind as a map (empty where there is none).

    A null text stays null; texts without entities stay as they are; null ids and repeated rows are rows like
    others; an empty table gives an empty result. The key decides all surrogates: same key, same result.
    """
    rows = docs.select(F.struct("*").alias("doc"), text_of(text_col).alias("t"), F.col(text_col).alias("text"))
    hinted = F.regexp_like("t", F.lit(HINT))
    none = F.create_map().cast("map<string,bigint>")
    parts = rows.filter(hinted).select("doc", _segments(F.col("t")).alias("segments"))
    found = cut(parts.select(F.monotonically_increasing_id().alias("row"), "doc", "segments"), "mentions")
    each = found.select("row", F.posexplode("segments").alias("at", "s"), "doc")
    each = each.select("row", "at", "s.*", F.when(F.col("at") == 0, F.col("doc")).alias("doc"))
    entities = cut(each.filter("kind IS NOT NULL").select("kind", "norm").distinct(), "entities")
    cores = distinct_surrogates(entities, key).select(F.col("kind").alias("k"), F.col("norm").alias("n"), "core")
    joined = each.join(cores, (F.col("kind") == F.col("k")) & (F.col("norm") == F.col("n")), "left")
    piece = F.concat("lit", F.when(F.col("kind").isNull(), F.col("raw")).otherwise(in_format(F.col("kind"), F.col("raw"), F.col("core"))))
    built = joined.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.sort_array(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"),
        F.collect_list("kind").alias("kinds"))
    kinds = F.array(*map(F.lit, ("card", "email", "ip", "name", "phone", "ssn")))
    named = F.transform("kinds", lambda k: F.when(k.isin("family", "given_m", "given_f", "given_n"), "name").otherwise(k))
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(named, lambda x: x == k)).cast("long")))
    changed = built.select("doc", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
                           F.map_filter(counts, lambda k, v: v > 0).alias("n"))
    return rows.filter(~hinted).select("doc", "text", none.alias("n")).unionByName(changed)
