import random
import re

from geocurate.llm import pii


def checked(body):
    """*body* with the last digit that the sum of all, every second doubled, needs to be a multiple of ten."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def grouped(number, sizes, by):
    out, at = [], 0
    for n in sizes:
        out.append(number[at:at + n])
        at += n
    return by.join(out)


def cards(rng):
    for length, sizes in ((16, (4, 4, 4, 4)), (15, (4, 6, 5)), (14, (4, 6, 4)), (13, (4, 3, 3, 3)), (19, (4, 4, 4, 4, 3)), (16, (6, 10))):
        for first in "3456":
            number = checked(first + "".join(rng.choices("0123456789", k=length - 2)))
            for by in ("", " ", "-"):
                yield number, grouped(number, sizes, by)


BESIDE = ["card {} 12/26", "no 12 {}", "{} 3 items", "12/26 {} 123", "exp 1226 {}", "in 2024 {} 7", "x{}y", "{}, 4", "7-{}", "({})"]


def test_no_valid_card_stays(spark):
    rng = random.Random(3)
    many = [(n, form, t.format(form)) for n, form in cards(rng) for t in BESIDE]
    # a group of three after four groups of four may as well be a check value of a card of 16 digits; other groups join numbers beside them
    many = [(n, form, t) for n, form, t in many if not (re.fullmatch(r"\d{6}[ -]\d{10}", form) and re.search(r"\d[ -]\d{6}[ -]|\d{10} \d", t))]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(many)], "doc_id long, text string")
    made = pii.pseudonymise(docs, "k").cache()
    rows = sorted(made.collect())
    links = {}
    for (number, form, text), row in zip(many, rows):
        assert form not in row.text and row.personal.card == 1, (text, row.text)
        assert re.sub("[0-9]", "0", row.text) == re.sub("[0-9]", "0", text)
        at = text.index(form)
        new = re.sub("[ -]", "", row.text[at:at + len(form)])
        assert row.text[:at] == text[:at] and new[0] == number[0]
        if len(number) < 19:
            assert row.text[at + len(form):] == text[at + len(form):] and checked(new[:-1]) == new
            assert links.setdefault(number, new) == new
    back = sorted(pii.pseudonymise(made, "k", back=True).collect())
    assert [r.text for r in back] == [t for _, _, t in many]


def test_national_phones(spark):
    phones = ["(743) 555-3824", "743-555-3824", "743.555.3824"]
    texts = [f"call {p}, now" for p in phones] + ["call +1 743-555-3824, now", "v 1.743.555.3824", "743-555-38245", "12-743-555-3824"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = pii.pseudonymise(docs, "k").cache()
    rows = sorted(made.collect())
    digits = {re.sub("[^0-9]", "", r.text) for r in rows[:3]}
    assert len(digits) == 1 and "7435553824" not in digits  # written otherwise, still the same number
    assert [r.personal.phone for r in rows] == [1, 1, 1, 1, 0, 0, 0]
    assert [r.text for r in rows[4:]] == texts[4:]
    assert [r.text for r in sorted(pii.pseudonymise(made, "k", back=True).collect())] == texts
