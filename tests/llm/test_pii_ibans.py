import re

from geocurate.llm import pii

VALID = ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "IE29AIBK93115212345678", "FR1420041010050500013M02606", "IT60X0542811101000000123456"]


def test_ibans_with_letters(spark):
    texts = [f"to {v} EUR 12" for v in VALID] + ["to GB83WEST12345698765432 EUR 12", "to AT61 1904 3002 3457 3201 EUR"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = pii.pseudonymise(docs, "k").cache()
    rows = sorted(made.collect())
    form = lambda x: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x))
    for value, row in zip(VALID, rows):
        new = re.fullmatch("to (.*) EUR 12", row.text)[1]
        plain = new.replace(" ", "")
        assert new != value and form(new) == form(value) and new[:2] == value[:2] and row.personal.iban == 1
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert rows[-2].text == texts[-2] and rows[-2].personal.iban == 0
    assert rows[-1].text != texts[-1] and rows[-1].personal.iban == 1
    assert [r.text for r in sorted(pii.pseudonymise(made, "k", back=True).collect())] == texts
