import datetime
import re

from geocurate.llm import pii
from geocurate.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def luhn_valid(text):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", text))]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def iban_valid(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


VALID = {
    "email": ["anna.b-7@mail7.example.com", "x@a.org", "A@b.co"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
    "date": ["2024-02-29", "1900-01-01", "31.12.1999", "02/28/2001"],
    "ip": ["10.0.0.1", "255.255.255.255"],
    "ssn": ["123-45-6789", "665-01-0001", "899-99-9999"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234 567"],
    "card": ["4111111111111111", "4111-1111-1111-1111", "378282246310005"],
}
INVALID = [
    "DE88370400440532013000", "2023-02-29", "2100-01-01", "31.13.1999", "256.1.1.1", "01.2.3.4", "666-11-1111", "000-11-1111",
    "900-11-1111", "4111111111111112", "1.2.3.4.5", "12345", "a@b",
]


def test_formats_links_and_way_back(spark):
    values = [(k, v) for k, many in VALID.items() for v in many]
    texts = [f"é {v}, x {v}\nend" for _, v in values] + [f"é {v} end" for v in INVALID] + [None, "", " ".join(v for _, v in values)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, personal int")
    made = pii.pseudonymise(docs, "k").cache()
    rows = sorted(made.collect())
    whole = rows[-1].text.split(" ")
    for (kind, value), row in zip(values, rows):
        first, second = re.fullmatch(r"é (.*), x (.*)\nend", row.text).groups()
        assert first == second != value and row.personal[kind] == 2 == sum(row.personal), (kind, value)
        assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", first.split("@")[0]))) == re.sub(
            r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", value.split("@")[0]))
        ) or kind == "ip"
        assert all(word in whole for word in first.split(" "))
        if kind == "card":
            assert luhn_valid(first) and first[0] == value[0]
        if kind == "iban":
            assert iban_valid(first) and first[:2] == value[:2]
        if kind == "date":
            datetime.datetime.strptime(first, "%Y-%m-%d" if first[4] == "-" else "%d.%m.%Y" if "." in first else "%m/%d/%Y")
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in first.split("."))
    for row, value in zip(rows[len(values):], INVALID):
        assert row.text == f"é {value} end" and sum(row.personal) == 0
    assert rows[-3].text is None and rows[-2].text == "" and sum(rows[-1].personal) == len(values)
    back = {r.doc_id: r.text for r in pii.pseudonymise(made, "k", back=True).collect()}
    assert back == dict(enumerate(texts))
    assert sum(a.text != b.text for a, b in zip(rows, sorted(pii.pseudonymise(docs, "other").collect()))) == len(values) + 1
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    df = spark.range(12 * 7).select("id", F.lpad(F.col("id").cast("string"), 3, "0").alias("text"))
    got = df.select(pii.permute_number(F.col("id"), 12, 7, "x", "k"), pii.permute_text(F.col("text"), "x", "k")).collect()
    assert sorted(r[0] for r in got) == list(range(84)) and len({r[1] for r in got}) == 84


def test_query_leaves_no_valid_value(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_pii_pseudonyms"](spark, SF).collect()
    assert len(rows) == len(texts)
    found = 0
    for r in rows:
        for m in re.finditer(pii.FORMS["card"], texts[r.doc_id]):
            if luhn_valid(m[0]):
                found += 1
                assert m[0] not in r.text
        for m in re.finditer(pii.FORMS["email"], texts[r.doc_id]):
            found += 1
            assert m[0] not in r.text
        counts = [r[f"n_{k}"] for k in pii.FORMS]
        assert (r.text == texts[r.doc_id]) == (sum(counts) == 0)
    assert found > 10
