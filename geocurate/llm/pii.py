"""Format-preserving pseudonyms for personal data, as expressions inside one row.

Every value that is found and valid is permuted by a keyed Feistel network within its own
format: digits stay digits, check digits are made anew, dates stay dates.  The
permutation depends on the key and the kind only, so equal values have equal pseudonyms
in all documents, different ones have different ones, and the key leads back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Lengths of the IBANs of countries whose account parts have letters or may have them.
IBAN_LENGTHS = {
    "AD": 24, "AZ": 28, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CY": 28, "DO": 28, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "IE": 22, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "MT": 31, "MU": 30, "NL": 18, "PK": 24, "PS": 29, "QA": 29, "RO": 24, "SA": 24, "SC": 31, "SM": 27, "TR": 26, "UA": 29, "VG": 24,
}


def _iban_forms() -> str:
    """One form for each length, which the country gives, so what follows an IBAN can't join it."""
    forms = []
    for n in sorted(set(IBAN_LENGTHS.values())):
        countries = "|".join(c for c, length in IBAN_LENGTHS.items() if length == n)
        rest = f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
        forms.append(f"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}")
    return "|".join(forms)


#: Lengths of the groups that cards are printed in.
CARD_GROUPS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3))


def _card_forms() -> str:
    """One group, or groups as printed, so numbers beside a card don't join it; else groups among which no card begins.

    What a form takes depends only on what pseudonyms keep: lengths of groups, and the first digits of printed groups.
    Those begin with 3 to 9 or 22 to 27, not like years and expiry dates.
    """
    printed = "|".join("[ -]".join(f"[0-9]{{{n}}}" for n in groups) for groups in CARD_GROUPS)
    single, printed = r"[0-9]{13,19}(?![0-9])", f"(?:{printed})(?![0-9])"
    begins = f"(?!{single}|{printed})"
    other = f"{begins}[0-9](?:[0-9]|[ -]{begins}[0-9]){{12,18}}(?![0-9])"
    return f"(?<![0-9])(?:{single}|(?=[3-9]|2[2-7]){printed}|{other})"


# Forms of the kinds.  The first kind that fits at a place counts.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": rf"(?<![A-Za-z0-9])(?:{_iban_forms()}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,6}}(?: ?[0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?<![0-9][./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
    r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9])(?<![0-9][.-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4}(?![0-9]|[.-][0-9])",
    "card": _card_forms(),
}
#: Forms of dates, and the days that are permuted: 270 * 270 from the first on.
DATE_FORMS = (("^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), ("^[0-9]{2}/", "MM/dd/yyyy"))
FIRST_DAY, DAY_ROOT = "1900-01-01", 270
#: Numbers of social security: areas 001 to 899 but for 666, groups 01 to 99, serials 0001 to 9999.
AREAS, SERIALS = 898, 99 * 9999
LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _draw(key: str, kind: str, round_: Column, size: Column, other: Column) -> Column:
    """Hexadecimal digits that depend on the key and on the other half."""
    told = F.concat_ws("|", F.lit(kind), round_.cast("string"), size.cast("string"), other)
    inner = F.sha2(F.concat(F.lit(f"{key}|inner|"), told), 256)
    return F.sha2(F.concat(F.lit(f"{key}|outer|"), inner), 256)


def _rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def _moved(part: Column, draw: Column, back: bool) -> Column:
    """Every letter and digit of a string moved on within its class by what was drawn for its place."""

    def move(ch: Column, j: Column) -> Column:
        by = F.conv(F.substring(draw, F.pmod(j, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = ch
        for letters in LETTERS:
            at = F.instr(F.lit(letters), ch)
            to = F.pmod(at - 1 - by if back else at - 1 + by, F.lit(len(letters)))
            out = F.when(at > 0, F.substring(F.lit(letters), to + 1, F.lit(1))).otherwise(out)
        return F.when(ch == "", ch).otherwise(out)

    return F.array_join(F.transform(F.split(part, ""), move), "")


def permute_text(text: Column, kind: str, key: str, back: bool = False) -> Column:
    """Feistel network over the two halves of a string; classes of characters and lengths are kept."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("left"), F.substring(text, half + 1, F.length(text)).alias("right"))

    def step(s: Column, i: Column) -> Column:
        size = F.length(s["left"]) + F.length(s["right"])
        even = i % 2 == 0
        return F.struct(
            F.when(even, _moved(s["left"], _draw(key, kind, i, size, s["right"]), back)).otherwise(s["left"]).alias("left"),
            F.when(~even, _moved(s["right"], _draw(key, kind, i, size, s["left"]), back)).otherwise(s["right"]).alias("right"),
        )

    return F.aggregate(_rounds(back), start, step, lambda s: F.concat(s["left"], s["right"]))


def permute_number(number: Column, a: int, b: int, kind: str, key: str, back: bool = False) -> Column:
    """Feistel network over a number below a * b as a pair below a and b."""
    start = F.struct(F.floor(number / b).cast("long").alias("x"), F.pmod(number, F.lit(b)).cast("long").alias("y"))

    def step(s: Column, i: Column) -> Column:
        def moved(value: Column, other: Column, size: int) -> Column:
            drawn = F.conv(F.substring(_draw(key, kind, i, F.lit(a * b), other.cast("string")), 1, 12), 16, 10).cast("long")
            by = F.pmod(drawn, F.lit(size).cast("long"))
            return F.pmod(value - by if back else value + by, F.lit(size).cast("long"))

        even = i % 2 == 0
        return F.struct(
            F.when(even, moved(s["x"], s["y"], a)).otherwise(s["x"]).alias("x"),
            F.when(~even, moved(s["y"], s["x"], b)).otherwise(s["y"]).alias("y"),
        )

    return F.aggregate(_rounds(back), start, step, lambda s: s["x"] * b + s["y"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """*form* with its digits replaced one by one."""
    return F.array_join(
        F.transform(
            F.split(form, ""),
            lambda ch, j: F.when(
                F.rlike(ch, F.lit("[0-9]")), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), j + 1))), F.lit(1))
            ).otherwise(ch),
        ),
        "",
    )


def _respaced(form: Column, chars: Column) -> Column:
    """*chars* with spaces where *form* has them."""
    return F.array_join(
        F.transform(
            F.split(form, ""),
            lambda ch, j: F.when(ch == " ", ch).otherwise(
                F.substring(chars, F.length(F.regexp_replace(F.substring(form, F.lit(1), j + 1), " ", "")), F.lit(1))
            ),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """The check digit for the digits before it."""
    double = F.transform(F.split(F.reverse(digits), ""), lambda ch, j: ch.cast("int") * F.when(j % 2 == 0, 2).otherwise(1))
    total = F.aggregate(double, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _mod_97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda s, ch: F.pmod(s * 10 + ch.cast("int"), F.lit(97)))


def _letters_as_numbers(text: Column) -> Column:
    """*text* with every capital as two digits."""
    return F.array_join(F.transform(F.split(text, ""), lambda ch: F.when(F.rlike(ch, F.lit("[A-Z]")), (F.ascii(ch) - 55).cast("string")).otherwise(ch)), "")


def _email(m: Column, key: str, back: bool) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permute_text(name, "email", key, back), F.substring(m, F.length(name) + 1, F.length(m)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """*then* of *value*, which is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _card_digits(d: Column, key: str, back: bool) -> Column:
    """Keeps the first digit, which names the kind of issuer (with 2 the second too), and sets the check digit anew.

    Of 19 digits, the 16th keeps its distance from the check digit of the 15 before it, so a
    card of 16 digits is told from one of 19 in the pseudonym as in the value.
    """
    keep = F.when(F.substring(d, 1, 1) == "2", 2).otherwise(1)
    size = F.length(d)
    head, free = F.substring(d, F.lit(1), keep), F.substring(d, keep + 1, size - keep - 1)
    plain = _let(F.concat(head, permute_text(free, "card", key, back)), lambda x: F.concat(x, _luhn(x)))
    off = F.pmod(F.substring(d, 16, 1).cast("int") - _luhn(F.substring(d, 1, 15)).cast("int"), F.lit(10))
    drawn = permute_text(F.concat(F.substring(d, keep + 1, 15 - keep), F.substring(d, 17, 2)), "card", key, back)

    def long(x: Column) -> Column:
        first = F.substring(x, 1, 15)
        digit = F.pmod(_luhn(first).cast("int") + off, F.lit(10)).cast("string")
        return _let(F.concat(first, digit, F.substring(x, 16, 2)), lambda y: F.concat(y, _luhn(y)))

    return F.when(size == 19, _let(F.concat(head, drawn), long)).otherwise(plain)


def _card(m: Column, key: str, back: bool) -> Column:
    """Four groups of four and one of three are a card of 16 digits beside a number if those are valid, else one of 19."""
    valid = lambda d: _luhn(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1))

    def renewed(d: Column) -> Column:
        beside = F.rlike(m, F.lit("^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}$")) & valid(F.substring(d, 1, 16))
        number = F.when(beside, F.substring(d, 1, 16)).otherwise(d)
        new = _let(number, lambda n: F.when(valid(n), _card_digits(n, key, back)).otherwise(n))
        return F.concat(new, F.when(beside, F.substring(d, 17, 3)).otherwise(F.lit("")))

    return _let(_digits(m), lambda d: _refilled(m, renewed(d)))


def _iban(m: Column, key: str, back: bool) -> Column:
    country, d = F.substring(m, 1, 2), F.regexp_replace(m, " ", "")
    check, body = F.substring(d, 3, 2), F.substring(d, F.lit(5), F.length(d))
    tail = _letters_as_numbers(country)
    right = _mod_97(F.concat(_letters_as_numbers(body), tail, check)) == 1
    new = F.element_at(
        F.transform(
            F.array(permute_text(body, "iban", key, back)),
            lambda x: F.concat(country, F.lpad((98 - _mod_97(F.concat(_letters_as_numbers(x), tail, F.lit("00")))).cast("string"), 2, "0"), x),
        ),
        1,
    )
    return F.when(right, _respaced(m, new)).otherwise(m)


def _phone(m: Column, key: str, back: bool) -> Column:
    """Keeps the country's code, if there is one."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _refilled(rest, permute_text(_digits(rest), "phone", key, back)))


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = permute_number(number, 1 << 16, 1 << 16, "ip", key, back)
    text = F.element_at(
        F.transform(F.array(new), lambda n: F.concat_ws(".", *(F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))), 1
    )
    plain = ~F.rlike(m, F.lit(r"(?:^|\.)0[0-9]"))  # an octet with a leading zero has no single reading
    return F.when(plain & F.forall(parts, lambda x: x <= 255), text).otherwise(m)


def _ssn(m: Column, key: str, back: bool) -> Column:
    part = lambda i, n: F.substring(m, i, n).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    number = (area - 1 - (area > 666).cast("long")) * SERIALS + (group - 1) * 9999 + serial - 1
    new = permute_number(number, AREAS, SERIALS, "ssn", key, back)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def text(n: Column) -> Column:
        place, rest = F.floor(n / SERIALS), F.pmod(n, F.lit(SERIALS))
        return F.concat_ws("-", pad(place + 1 + (place >= 665).cast("long"), 3), pad(F.floor(rest / 9999) + 1, 2), pad(F.pmod(rest, F.lit(9999)) + 1, 4))

    return F.when(good, F.element_at(F.transform(F.array(new), text), 1)).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    out = m
    for pattern, form in DATE_FORMS:
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        inside = (day >= 0) & (day < DAY_ROOT * DAY_ROOT)
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(day, DAY_ROOT, DAY_ROOT, "date", key, back).cast("int")), form)
        out = F.when(F.rlike(m, F.lit(pattern)) & inside, new).otherwise(out)
    return out


_WAYS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
ANY = "|".join(FORMS.values())


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """Replace *text_col* by the text with pseudonyms and add ``personal``: counts by kind of what was replaced.

    Kinds are e-mail names, IBANs, dates, IPv4 addresses, social security numbers, phone numbers (with a
    country code, or of ten digits in groups of three, three and four), and card numbers, also beside other
    numbers; what has the form but isn't valid (check digits, calendar, ranges) stays.  Dates from 1900 to August 2099 are permuted.  With ``back``, pseudonyms
    made with the same key become the values again.

    A null text stays null, an empty one empty, both with no counts.  Repeated rows get
    equal texts.  A column of *docs* named ``personal`` is replaced; names that begin with ``_`` are
    kept for inner use.  Nothing is exploded or shuffled.
    """
    none = F.array().cast("array<string>")
    has = F.coalesce(F.rlike(text_col, F.lit(ANY)), F.lit(False))
    df = docs.withColumn("_has", has)
    df = df.withColumns({
        "_found": F.when(F.col("_has"), F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0))).otherwise(none),
        "_gaps": F.when(F.col("_has"), F.split(text_col, ANY, -1)).otherwise(none),
    })

    def told(m: Column) -> Column:
        kind, new = F.lit("none"), m
        for name in reversed(FORMS):
            is_kind = F.rlike(m, F.lit(f"^(?:{FORMS[name]})$"))
            kind = F.when(is_kind, F.lit(name)).otherwise(kind)
            new = F.when(is_kind, _WAYS[name](m, key, back)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"), m.alias("old"))

    df = df.withColumn("_told", F.transform("_found", told))
    last = F.element_at("_gaps", -1)
    mixed = F.zip_with("_told", F.slice("_gaps", 1, F.size("_told")), lambda t, gap: F.concat(gap, t["new"]))
    changed = lambda kind: F.size(F.filter("_told", lambda t: (t["kind"] == kind) & (t["new"] != t["old"]))).cast("long")
    df = df.withColumns({
        text_col: F.when(F.col("_has"), F.concat(F.array_join(mixed, ""), last)).otherwise(F.col(text_col)),
        "personal": F.struct(*(changed(kind).alias(kind) for kind in FORMS)),
    })
    return df.drop("_has", "_found", "_gaps", "_told")
