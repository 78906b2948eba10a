import re

import pytest
from pyspark.sql import functions as F

from timberline.llm import privacy as V

KEY = "test key"


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(re.sub(r"\D", "", number))):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


TEXTS = [
    "Mail jo.19@mail5.example.com or JO.19@mail5.example.com now.",
    "Call +1 (310) 555-4510, +1-310-555-4510; card 4785380592391139, 4785-3805-9239-1139. No card: 4785380592391138.",
    "From 152.143.123.131, then 10.0.0.1. Version 1.2.3 and 300.1.1.1 stay.",
    "Mr. John Smith met Mrs. Anna Smith; Mr. SMITH, Herr Smith and Господин Иванов.",
    "SSN 123-45-6789 of jo.19@mail5.example.com at the end jo.19@mail5.example.com",
    "Plain words, 12 apples, #hash | and nothing else.",
    "", None, "é中😀 no hints here", "(310) 555-4510x 310.555.4511 end", "x" * 3000 + " a.b@c.org " + "y " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, 1, "r") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], 1, "r"), (0, TEXTS[0], 1, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, row string")


@pytest.fixture(scope="module")
def result(docs):
    return V.pseudonymize(docs, KEY).collect()


def of(result, k):
    return next(r for r in result if r.doc.doc_id == k)


def test_shape_is_kept(result):
    mail = of(result, 0).text
    first, second = re.fullmatch(r"Mail (\S+) or (\S+) now\.", mail).groups()
    assert re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", first) and first != "jo.19@mail5.example.com"
    assert second[:2].isupper() and second.lower() == first  # one entity, two spellings
    one = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}), (\+1-\d{3}-\d{3}-\d{4}); card (\d{16}), (\d{4}-\d{4}-\d{4}-\d{4})\. "
                       r"No card: 4785380592391138\.", of(result, 1).text)
    assert one and re.sub(r"\D", "", one[1]) == re.sub(r"\D", "", one[2]) != "13105554510"
    assert luhn(one[3]) and one[3] == one[4].replace("-", "") and one[3][0] == "4" and one[3] != "4785380592391139"
    ips = re.fullmatch(r"From (\S+), then (\S+)\. Version 1\.2\.3 and 300\.1\.1\.1 stay\.", of(result, 2).text).groups()
    assert len(set(ips)) == 2 and all(all(1 <= int(x) <= 254 for x in ip.split(".")) for ip in ips)
    assert of(result, 4).text[4] == "9"


def test_names_keep_gender_script_and_coreference(result):
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+), Herr (\w+) and Господин (\w+)\.", of(result, 3).text)
    john, smith, anna, smith2, smith3, smith4, ivanov = m.groups()
    assert smith == smith2 == smith4 and smith.istitle() and smith != "Smith"
    assert john.endswith("n") and anna.endswith("a") and re.fullmatch(r"[А-Я][а-я]+", ivanov)
    assert smith3 == smith.upper()


def test_clean_and_odd_rows(result, docs):
    assert len(result) == docs.count()
    for k in (5, 6, 7, 8):
        assert of(result, k).text == TEXTS[k] and not of(result, k).n
    assert of(result, 10).text.startswith("x" * 3000 + " ") and "a.b@c.org" not in of(result, 10).text
    assert of(result, 1).n == {"phone": 2, "card": 2} and of(result, 4).n == {"email": 2, "ssn": 1}
    same = {r.text for r in result if r.doc.text == TEXTS[0]}
    assert len(same) == 1
    assert V.pseudonymize(docs.limit(0), KEY).count() == 0


def test_every_mention_goes_and_distinct_stay_distinct(spark):
    rows = [(k, f"u{k}@a.io and 10.0.{k % 256}.{k // 256 + 1} +1 (310) 555-{k:04d}") for k in range(1500)]
    out = V.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    for part in range(3):
        pattern = (r"^\S+", r"and (\S+)", r"(\+1 .*)$")[part]
        new = {re.search(pattern, r.text).group() for r in out}
        old = {re.search(pattern, t).group() for _, t in rows}
        assert len(new) == 1500 and not new & old
    again = V.pseudonymize(spark.createDataFrame(rows[::-1], "doc_id long, text string"), KEY).collect()
    assert {(r.doc.doc_id, r.text) for r in out} == {(r.doc.doc_id, r.text) for r in again}


def test_collision_rounds(spark, monkeypatch):
    """A surrogate function with eight values for six entities, one of which it also makes."""
    rows = spark.createDataFrame([("ip", f"{k}") for k in (0, 11, 12, 13, 14, 15)], "kind string, norm string")
    monkeypatch.setattr(V, "surrogate", lambda key, kind, norm, attempt: F.pmod(F.hash(norm, attempt), F.lit(8)).cast("string"))
    got = V.distinct_surrogates(rows, KEY).collect()
    assert len({r.core for r in got}) == 6 and "0" not in {r.core for r in got}


def replaced(spark, texts):
    """Texts after the operator, and the counts, in order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sorted(V.pseudonymize(rows, KEY).collect(), key=lambda r: r.doc.doc_id)
    return [(r.text, r.n) for r in out]


def test_numbers_before_an_entity_do_not_hide_it(spark):
    card, fours, amex = "4785380592391139", "4785 3805 9239 1139", "3782 822463 10005"
    cases = [("Room 1204 ", "415-555-0123", "", "phone"), ("2023 ", "078-05-1120", "", "ssn"), ("order 77 ", card, " of 12", "card"),
             ("ID 12345 ", "078-05-1120", "", "ssn"), ("1204 ", fours, " 2023", "card"), ("1204 ", amex, "", "card"),
             ("1111 2222 3333 ", amex, " 1", "card"), ("12 ", fours.replace(" ", "-"), " 415", "card"), ("x 1204 5 ", fours, ", y", "card")]
    for (before, entity, after, kind), (text, n) in zip(cases, replaced(spark, ["".join(c[:3]) for c in cases]), strict=True):
        assert n == {kind: 1}, (before, entity, n)
        assert text.startswith(before) and text.endswith(after) and entity not in text
        assert kind != "card" or luhn(text[len(before) : len(before) + len(entity)])
    two = [f"{fours} {fours}", f"1204 {fours} 415-555-0123", f"{fours} 078-05-1120", "1204 1205 1206 1207 1209 stays", "4785 3805 9239 1138"]
    got = replaced(spark, two)
    assert [n for _, n in got] == [{"card": 2}, {"card": 1, "phone": 1}, {"card": 1, "ssn": 1}, {}, {}]
    assert got[3][0] == two[3] and got[4][0] == two[4] and got[0][0][:19] == got[0][0][20:] != fours


def test_surrogates_grow_when_their_space_is_full(spark, monkeypatch):
    """Two syllables make eight short names, and addresses of one letter 676: fewer than the entities."""
    monkeypatch.setitem(V.SYLLABLES, "latin", ("ba", "be"))
    shape = spark.range(9).select(*(V.surrogate(KEY, F.lit(k), F.lit(n), F.col("id").cast("int")).alias(k) for k, n in (("family", "smith"), ("email", "a@b.co"))))
    rows = shape.collect()
    assert max(len(r.family) for r in rows) > 7 and max(len(r.email) for r in rows) > 6  # else the next lines never end
    letters = "abcdefghijklmnopqrstuvwxyz"
    entities = [("family", "x" + letters[k]) for k in range(20)] + [("email", f"{a}@{b}.co") for a in letters for b in letters]
    got = V.distinct_surrogates(spark.createDataFrame(entities, "kind string, norm string"), KEY).collect()
    assert len({(r.kind, r.core) for r in got}) == len(entities) and not {(r.kind, r.core) for r in got} & set(entities)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.co", r.core) for r in got if r.kind == "email")
    long = spark.range(1).select(V.in_format(F.lit("email"), F.lit("A@B.co"), F.lit("qxx@r.co")).alias("x")).first().x
    assert long == "Qxx@R.co"


def test_common_phone_formats(spark):
    phones = ["+14155550123", "1-415-555-0123", "415 555 0123", "+33 1 23 45 67 89", "1 415 555 0123", "+45 12 34 56 78", "+32 2 123 45 67",
              "+61 2 1234 5678", "+35312345678"]
    got = replaced(spark, [f"Room 1204 {p} or 7" for p in phones])
    for phone, (text, n) in zip(phones, got, strict=True):
        assert n == {"phone": 1} and phone not in text, (phone, text, n)
        assert re.fullmatch(re.sub(r"[0-9]", "[0-9]", re.escape(f"Room 1204 {phone} or 7")), text)
    digits = [re.sub(r"\D", "", text[10:-5]) for text, _ in got]
    assert digits[0] == digits[1] == digits[4] and digits[0][0] == "1" and digits[3][:2] == "33" and digits[8][:3] == "353"
    plain = ["rows 100 200 3000", "+123 apples", "12 34 56 78 90"]
    assert replaced(spark, plain) == [(p, {}) for p in plain]
