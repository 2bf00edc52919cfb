"""Format-preserving Feistel pseudonyms for personal numbers and dates, in column expressions only.

Values found in a text are validated (check digits, number plans, calendar) and each is replaced by
another valid value of its own format. The replacement is a keyed permutation of all valid values of
the format: a Feistel network over mixed radices, whose round function is SHA-512 of key, kind,
round and the other half, with one more digest for each 21 further places. Equal values get equal pseudonyms in every document, however their digits
are grouped, different values get different ones, and no table of them is kept or shuffled.

| kind  | valid if                                  | what is permuted                               |
|-------|-------------------------------------------|------------------------------------------------|
| card  | 13 to 19 digits with a right Luhn digit   | all digits but the last, which is then set     |
| iban  | length, and remainder 1 modulo 97         | digits and letters after the check digits      |
| ssn   | 3-2-4 digits in the ranges that are used  | number of area, group and serial               |
| phone | 10-digit plan with digits 1 and 4 over 1; | the ten digits, within that plan;              |
|       | or + and 8 to 15 digits                   | all digits after the first two                 |
| ip    | four numbers up to 255                    | the four numbers                               |
| date  | a day of 1800 to 2199                     | the day within these 400 years                 |
| email | a local part of up to 64 characters, @    | letters and digits of the local part, by class |
|       | and a domain with a dot                   |                                                |

Each text is a row of its own: no join, no shuffle, whole texts. A null text stays null and has no
values; what is not valid stays as it is. Rows that repeat are treated alike. Columns other than key
and text are left out by `pseudonyms`; `replace` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")

# The shapes that are looked for.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}(?<mark>[./-])\d{2}\k<mark>\d{4})(?!\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?!\d)"
NATIONAL = r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
PLUS_PLAN = r"\+1[2-9]\d{2}[2-9]\d{6}"
PLUS = r"\+[1-9]\d{7,14}(?!\d)"
LONGEST_LOCAL = 64
CARD = r"(?:\d{4}(?<four>[ -])\d{4}\k<four>\d{4}\k<four>\d{4}|\d{4}(?<six>[ -])\d{6}\k<six>\d{5}|\d{13,19})(?!\d)"
_ANY = f"(?<![A-Za-z0-9._%+-])(?:{EMAIL}|{IBAN}|{IP}|{DATE}|{SSN}|{NATIONAL}|{PLUS}|{CARD})"

_DAYS = 146_097  # of 400 years, 189 * 773
_FIRST_DAY = "1800-01-01"


def _int(x) -> Column:
    return x.cast("int")


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\s\S]"), F.lit(0))


def _digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]"), F.lit(0)), lambda c: _int(c))


def permuted(values: Column, radices: Column, kind: str, key: str) -> Column:
    """A keyed permutation of arrays of numbers, each below its radix."""
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half
    ints = "array<int>"
    start = F.struct(
        F.slice(values, F.lit(1), half).cast(ints).alias("a"),
        F.slice(radices, F.lit(1), half).cast(ints).alias("ra"),
        F.slice(values, half + 1, rest).cast(ints).alias("b"),
        F.slice(radices, half + 1, rest).cast(ints).alias("rb"),
    )

    def source(h: Column, i: Column) -> Column:
        later = F.sha2(F.concat_ws("|", h, F.floor(i / 21).cast("string")), 512)
        return F.when(i < 21, h).otherwise(later)

    def turn(state: Column, n: Column) -> Column:
        other = F.array_join(state["b"].cast("array<string>"), ",")
        plan = F.array_join(state["ra"].cast("array<string>"), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), plan, other), 512)
        moved = _once(
            digest,
            lambda h: F.transform(
                state["a"],
                lambda v, i: _int(
                    (v + F.conv(source(h, i).substr((i % 21) * 6 + 1, F.lit(6)), 16, 10).cast("long"))
                    % F.element_at(state["ra"], i + 1)
                ),
            ),
        )
        return F.struct(
            state["b"].alias("a"), state["rb"].alias("ra"), moved.alias("b"), state["ra"].alias("rb")
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"])
    )


def _refill(text: Column, radix, kind: str, key: str) -> Column:
    """The text with characters permuted; radix(character, position from 0) is 0 where it stays."""

    def base(c: Column, r: Column) -> Column:
        return F.when(r == 8, F.ascii(F.lit("2"))).when(r == 10, F.ascii(F.lit("0"))).when(
            c.between("a", "z"), F.ascii(F.lit("a"))
        ).otherwise(F.ascii(F.lit("A")))

    def with_parts(parts: Column) -> Column:
        moving = F.filter(parts, lambda p: p["r"] > 0)
        new = permuted(
            F.transform(moving, lambda p: F.ascii(p["c"]) - base(p["c"], p["r"])),
            F.transform(moving, lambda p: p["r"]),
            kind,
            key,
        )
        return _once(
            new,
            lambda found: F.array_join(
                F.transform(
                    parts,
                    lambda p, i: F.when(p["r"] == 0, p["c"]).otherwise(
                        F.char(base(p["c"], p["r"]) + F.element_at(found, p["k"]))
                    ),
                ),
                "",
            ),
        )

    typed = F.transform(_chars(text), lambda c, i: F.struct(c.alias("c"), _int(radix(c, i)).alias("r")))
    numbered = _once(
        typed,
        lambda t: F.transform(
            t,
            lambda p, i: F.struct(
                p["c"].alias("c"),
                p["r"].alias("r"),
                F.size(F.filter(F.slice(t, F.lit(1), i + 1), lambda q: q["r"] > 0)).alias("k"),
            ),
        ),
    )
    return _once(numbered, with_parts)


def _is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, each second one from the right doubled; the check digit at the end counts."""
    return F.aggregate(
        F.transform(
            F.reverse(digits),
            lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )


def _card(x: Column, key: str) -> Column:
    body = F.regexp_replace(x, r"[0-9]$", "")
    moved = _refill(body, lambda c, i: F.when(_is_digit(c), 10).otherwise(0), "card", key)
    sum_without = lambda b: _luhn(F.concat(_digits(b), F.array(F.lit(0))))
    ended = _once(moved, lambda b: F.concat(b, ((10 - sum_without(b) % 10) % 10).cast("string")))
    return F.when(_luhn(_digits(x)) % 10 == 0, ended)


def _mod97(text: Column) -> Column:
    return F.aggregate(
        _chars(F.concat(F.substring(text, 5, 60), F.substring(text, 1, 4))),
        F.lit(0),
        lambda a, c: _int(
            F.when(_is_digit(c), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
        ),
    )


def _iban(x: Column, key: str) -> Column:
    plain = F.regexp_replace(x, " ", "")
    moved = _refill(
        F.substring(x, 5, 60), lambda c, i: F.when(_is_digit(c), 10).when(c == " ", 0).otherwise(26), "iban", key
    )
    country = F.substring(x, 1, 2)

    def checked(rest: Column) -> Column:
        left = _mod97(F.concat(country, F.lit("00"), F.regexp_replace(rest, " ", "")))
        return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)

    return F.when((F.length(plain) >= 15) & (_mod97(plain) == 1), _once(moved, checked))


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (_int(F.substring(x, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = permuted(
        F.array(place, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key
    )

    def written(v: Column) -> Column:
        one, two, three = (F.element_at(v, i) for i in (1, 2, 3))
        number = F.when(one > 664, one + 2).otherwise(one + 1)
        padded = [F.lpad(n.cast("string"), k, "0") for n, k in ((number, 3), (two + 1, 2), (three + 1, 4))]
        return F.concat_ws("-", *padded)

    return F.when(valid, _once(moved, written))


def _national(x: Column, key: str) -> Column:
    total = F.length(F.regexp_replace(x, "[^0-9]", ""))
    from_right = lambda i: total - F.length(F.regexp_replace(x.substr(F.lit(1), i + 1), "[^0-9]", ""))
    ten = F.substring(F.regexp_replace(x, "[^0-9]", ""), -10, 10)
    valid = F.substring(ten, 1, 1).between("2", "9") & F.substring(ten, 4, 1).between("2", "9")
    radix = lambda c, i: (
        F.when(~_is_digit(c) | (from_right(i) > 9), 0).when(from_right(i).isin(9, 6), 8).otherwise(10)
    )
    return F.when(valid, _refill(x, radix, "phone", key))


def _plus(x: Column, key: str) -> Column:
    # a number outside the ten-digit plan stays outside it, so it never gets the pseudonym of one inside
    stays = x.startswith("+1") & (F.length(x) == 12)
    return _refill(x, lambda c, i: F.when(_is_digit(c) & (i > 2) & ~(stays & (i == 5)), 10).otherwise(0), "plus", key)


def _ip(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: _int(p))
    moved = permuted(parts, F.array(*[F.lit(256)] * 4), "ip", key)
    return F.when(F.forall(parts, lambda p: p < 256), F.array_join(moved.cast("array<string>"), "."))


def _date(x: Column, key: str) -> Column:
    """Year first; or two numbers and the year, read month first after a slash and else day first."""
    first = F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))
    mark = F.substring(x, 3, 1)
    plain = F.regexp_replace(x, "[./]", "-")
    day = F.try_to_timestamp(plain, F.lit("dd-MM-yyyy"))
    month = F.try_to_timestamp(plain, F.lit("MM-dd-yyyy"))
    is_iso = x.rlike(r"^\d{4}")
    month_first = (mark == "/") & month.isNotNull()
    found = F.when(is_iso, first).when(month_first, month).otherwise(day).cast("date")
    number = F.datediff(found, F.lit(_FIRST_DAY).cast("date"))
    moved = permuted(
        F.array(_int(F.floor(number / 773)), number % 773), F.array(F.lit(189), F.lit(773)), "date", key
    )
    new = F.date_add(F.lit(_FIRST_DAY).cast("date"), F.element_at(moved, 1) * 773 + F.element_at(moved, 2))

    def written(d: Column) -> Column:
        iso = d.cast("string")
        y, m, n = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
        other = F.when(month_first, F.concat(m, mark, n, mark, y)).otherwise(F.concat(n, mark, m, mark, y))
        return F.when(is_iso, iso).otherwise(other)

    return F.when((number >= 0) & (number < _DAYS), _once(new, written))


def _email(x: Column, key: str) -> Column:
    at = F.locate("@", x)
    radix = lambda c, i: (
        F.when(_is_digit(c), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(0)
    )
    moved = _refill(x.substr(F.lit(1), at - 1), radix, "email", key)
    return F.when(at <= LONGEST_LOCAL + 1, F.concat(moved, x.substr(at, F.length(x))))


def _found(x: Column, key: str) -> Column:
    """kind and pseudonym of a piece; both null if it is not valid."""
    whole = lambda shape: x.rlike(f"^(?:{shape})$")
    tests = (
        ("email", x.contains("@"), _email),
        ("iban", x.rlike("^[A-Z]"), _iban),
        ("ip", whole(IP), _ip),
        ("date", whole(DATE), _date),
        ("ssn", whole(SSN), _ssn),
        ("phone", whole(NATIONAL), _national),
        ("phone", whole(PLUS_PLAN), _national),
        ("phone", whole(PLUS), _plus),
        ("card", whole(CARD), _card),
    )
    made = None
    for kind, test, make in tests:
        one = F.struct(F.lit(kind).alias("kind"), make(x, key).alias("text"))
        made = F.when(test, one) if made is None else made.when(test, one)
    return made


def _pieces(text: Column, key: str) -> Column:
    def piece(x: Column) -> Column:
        return _once(
            _found(x, key),
            lambda f: F.struct(
                F.when(f["text"].isNotNull(), f["kind"]).alias("kind"), F.coalesce(f["text"], x).alias("text")
            ),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), piece)


def _joined(text: Column, pieces: Column) -> Column:
    gaps = F.split(text, _ANY, -1)
    whole = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(pieces, i)["text"], F.lit(""))))
    return F.when(F.size(pieces) > 0, F.array_join(whole, "")).otherwise(text)


def _is_kind(kind: str):
    return lambda piece: piece["kind"] == kind


def pseudonyms(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with the pseudonyms, and n_<kind>, how many values of each kind were replaced."""
    pieces = docs.select(key, text, _pieces(F.coalesce(F.col(text), F.lit("")), secret).alias("pieces"))
    counts = [
        F.size(F.filter("pieces", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return pieces.select(key, _joined(F.col(text), F.col("pieces")).alias("text"), *counts)


def replace(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """The documents with the pseudonyms in their text; all columns stay."""
    return docs.withColumn(text, _joined(F.col(text), _pieces(F.coalesce(F.col(text), F.lit("")), secret)))
