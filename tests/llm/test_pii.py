from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from starledger.llm import pii
from tests.llm.conftest import EDGE_ROWS

TEXTS = [
    "Mail JOHN.doe@Mail.example.com or john.doe@mail.example.com, tel +1 (375) 555-3132.",
    "Again +1-375-555-3132 and +1 375 555 3132; card 4691220105823975, 4691-2201-0582-3975.",
    "ip 42.144.35.254 not 1.2.3.4.5 nor 300.1.1.1; ssn 123-45-6789",
    "Mr. Smith met Frau Anna Müller and Mrs JANE DOE; Mr Smith left. Госпожа Иванова. Κύριος Νίκος Παππάς.",
    "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013000 end",
    "nothing here: 12 of 1999, version 3.11, a@b, Mr nobody",
]


def replaced(frame, rows, key="k"):
    return {r["doc_id"]: r for r in pii.replace_entities(frame(rows), key=key).collect()}


@pytest.fixture(scope="module")
def result(frame):
    return replaced(frame, [*enumerate(TEXTS), *EDGE_ROWS])


def test_originals_are_gone_and_the_rest_stays(result):
    joined = "\n".join(result[i]["text"] for i in range(5))
    for old in (
        "john.doe", "JOHN", "555-3132", "4691220105823975", "42.144.35.254", "123-45-6789",
        "Smith", "Anna", "Müller", "JANE", "Иванова", "Παππάς", "370400440532013000",
    ):
        assert old not in joined
    assert "not 1.2.3.4.5 nor 300.1.1.1; ssn " in result[2]["text"]
    assert result[5]["text"] == TEXTS[5] and result[5]["n_entities"] == 0
    for i, text in EDGE_ROWS:
        assert result[i]["text"] == text


def test_one_entity_has_one_surrogate(result):
    first, second = re.findall(r"\S+@\S+?(?= or|,)", result[0]["text"])
    assert first == second
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[\d ()-]+\d", result[0]["text"] + result[1]["text"])]
    assert len(digits) == 3 and len(set(digits)) == 1
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", result[1]["text"])
    assert cards[0] == cards[1].replace("-", "")
    names = re.findall(r"Mr\.? (\w+)", result[3]["text"])
    assert names[0] == names[1]
    ibans = re.findall(r"DE[\d ]+\d", result[4]["text"])
    assert ibans[0].replace(" ", "") == ibans[1]


def test_types_formats_gender_and_script(result):
    card = re.findall(r"\d{16}", result[1]["text"])[0]
    doubled = [int(c) * (2 - k % 2) for k, c in enumerate(card)]
    assert card[0] == "4" and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    assert re.search(r"ssn \d{3}-\d{2}-\d{4}$", result[2]["text"])
    assert all(0 <= int(o) <= 255 for o in re.search(r"ip ([\d.]+) not", result[2]["text"])[1].split("."))
    assert re.search(r"tel \+1 \(\d{3}\) \d{3}-\d{4}\.$", result[0]["text"])
    text = result[3]["text"]
    given = re.search(r"Frau (\w+) \w+", text)[1]
    assert given in pii.GIVEN["latin", "female"].split()
    assert re.search(r"Mrs ([A-Z]+) [A-Z]+;", text)[1].capitalize() in pii.GIVEN["latin", "female"].split()
    assert re.search(r"Госпожа [А-Яа-я]+\.", text)
    assert re.search(r"Κύριος (\w+) ", text)[1] in pii.GIVEN["greek", "male"].split()


def test_surrogate_ibans_are_valid(frame):
    known = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    found = replaced(frame, list(enumerate(f"to {x} now" for x in known)))
    for i, old in enumerate(known):
        new = found[i]["text"].removeprefix("to ").removesuffix(" now")
        assert new != old and re.sub(r"\d", "0", re.sub("[A-Z]", "A", new)) == re.sub(
            r"\d", "0", re.sub("[A-Z]", "A", old)
        )
        plain = new.replace(" ", "")
        assert new[:2] == old[:2] and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_key_decides(frame, result):
    assert replaced(frame, [(0, TEXTS[0])], key="other")[0]["text"] != result[0]["text"]


def test_distinct_entities_stay_distinct(frame):
    """Many short addresses in one format: surrogates would clash without the check."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{c}@x.co and {c}{d}@x.co") for i, (c, d) in enumerate((c, d) for c in letters for d in letters)]
    found = replaced(frame, rows)
    made = {}
    for i, text in rows:
        new = re.findall(r"\S+@\S+", found[i]["text"])
        for old, fresh in zip(re.findall(r"\S+@\S+", text), new, strict=True):
            assert made.setdefault(old, fresh) == fresh
    assert len(set(made.values())) == len(made)
    assert not set(made) & set(made.values())


def test_more_numbers_than_their_format_has_room_for(frame):
    """6,000 of the 10,000 four-digit numbers: 4,000 are free, the other surrogates must be longer."""
    numbers = [f"+{n}" for n in range(1000, 7000)]
    rows = [(i, ", ".join(numbers[i * 100 : i * 100 + 100])) for i in range(60)]
    found = replaced(frame, [*rows, (60, numbers[0])])
    made = [x for i, _ in rows for x in found[i]["text"].split(", ")]
    assert all(re.fullmatch(r"\+\d{4,}", x) for x in made) and len(set(made)) == len(numbers)
    assert not set(made) & set(numbers) and found[60]["text"] == made[0]
    assert all(found[i]["n_entities"] == 100 for i, _ in rows)


def test_columns_and_empty_table(frame):
    docs = frame([])
    result = pii.replace_entities(docs, key="k")
    assert set(result.columns) == {*docs.columns, "n_entities"} and result.collect() == []


def test_long_text(frame, prose):
    text = prose(1, 20_000) + " a.b@c.org " + prose(2, 20_000)
    new = replaced(frame, [(1, text)])[1]["text"]
    assert "a.b@c.org" not in new and len(new) == len(text) and new[:1000] == text[:1000]


def test_types(spark):
    known = {
        "a.b@c.org": "email", "1.2.3.4": "ip", "DE89370400440532013000": "iban", "123-45-6789": "ssn",
        "4691 2201 0582 3975": "card", "+49 30 123456": "phone", "(375) 555-3132": "phone", "Mr. Smith": "name",
    }
    frame = spark.createDataFrame([(k,) for k in known], "e string")
    got = frame.select("e", pii.entity_type(F.col("e")).alias("kind"), pii.entities(F.col("e")).alias("found")).collect()
    assert {r["e"]: r["kind"] for r in got} == known
    assert all(r["found"] == [r["e"]] for r in got)
