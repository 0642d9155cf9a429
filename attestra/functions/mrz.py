"""Machine-readable zones as column expressions: fragments, check digits, TD1 and TD3 fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fragment(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9<]", "")


def check_digit(value: Column) -> Column:
    """ICAO 9303: weights 7, 3, 1 over 0-9, A=10 to Z=35, < = 0, modulo 10; null where another character occurs."""
    def digit(c: Column, i: Column) -> Column:
        n = F.ascii(c)
        of = F.when(n.between(48, 57), n - 48).when(n.between(65, 90), n - 55).otherwise(0)
        return of * F.get(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3)

    def once(v: Column) -> Column:  # the value is bound, so that nested zones aren't computed again for each character
        total = F.aggregate(F.transform(F.split(v, ""), digit), F.lit(0), lambda acc, x: acc + x)
        return F.when(v.rlike("^[A-Z0-9<]*$"), (total % 10).cast("string"))

    return F.transform(F.array(value), once)[0]


def _bare(line: Column, start: int, n: int) -> Column:
    v = F.regexp_replace(F.substring(line, start + 1, n), "<", "")
    return F.when(v != "", v)


def _name(value: Column, second: bool) -> Column:
    """Part before or after the first ``<<``."""
    at = F.instr(value, "<<")
    part = F.when(at > 0, F.substr(value, at + 2) if second else F.substring_index(value, "<<", 1)).otherwise(F.lit("") if second else value)
    clean = F.trim(F.regexp_replace(F.regexp_replace(part, "<", " "), " +", " "))
    return F.when(clean != "", clean)


def resplit(lines: Column, width: int, count: int) -> Column:
    """One line as long as all lines together is cut up."""
    return F.when((F.size(lines) == 1) & (F.length(lines[0]) == width * count), F.array(*(F.substring(lines[0], 1 + width * i, width) for i in range(count)))).otherwise(lines)


def _checks(parts: list[tuple[str, Column, Column]]) -> Column:
    return F.array(*(F.struct(F.lit(f"mrz_{c}_check_digit").alias("code"), F.when(check_digit(v) == d, "passed").otherwise("failed").alias("status")) for c, v, d in parts))


def td3(first: Column, second: Column) -> tuple[dict[str, Column], Column]:
    """Fields and check results of two lines of 44."""
    s = lambda a, n: F.substring(second, a + 1, n)
    name = F.substring(first, 6, 39)
    fields = {
        "document_code": _bare(first, 0, 2), "issuing_state": _bare(first, 2, 3), "surname": _name(name, False), "given_names": _name(name, True), "document_number": _bare(second, 0, 9), "nationality": _bare(second, 10, 3),
        "date_of_birth": _bare(second, 13, 6), "sex": _bare(second, 20, 1), "date_of_expiry": _bare(second, 21, 6), "optional_data": _bare(second, 28, 14),
    }
    return fields, _checks([("document_number", s(0, 9), s(9, 1)), ("birth_date", s(13, 6), s(19, 1)), ("expiry_date", s(21, 6), s(27, 1)), ("optional_data", s(28, 14), s(42, 1)), ("composite", F.concat(s(0, 10), s(13, 7), s(21, 22)), s(43, 1))])


def td1(first: Column, second: Column, third: Column) -> tuple[dict[str, Column], Column]:
    """Fields and check results of three lines of 30."""
    a = lambda i, n: F.substring(first, i + 1, n)
    b = lambda i, n: F.substring(second, i + 1, n)
    fields = {
        "document_code": _bare(first, 0, 2), "issuing_state": _bare(first, 2, 3), "document_number": _bare(first, 5, 9), "optional_data": _bare(first, 15, 15), "pinfl": _bare(first, 15, 15), "date_of_birth": _bare(second, 0, 6),
        "sex": _bare(second, 7, 1), "date_of_expiry": _bare(second, 8, 6), "nationality": _bare(second, 15, 3), "surname": _name(third, False), "given_names": _name(third, True),
    }
    return fields, _checks([("document_number", a(5, 9), a(14, 1)), ("birth_date", b(0, 6), b(6, 1)), ("expiry_date", b(8, 6), b(14, 1)), ("composite", F.concat(a(5, 25), b(0, 7), b(8, 7), b(18, 11)), b(29, 1))])


def all_passed(checks: Column) -> Column:
    return F.forall(checks, lambda c: c["status"] == "passed")


def full_date(yymmdd: Column) -> Column:
    """dd.mm.yyyy of a six-digit date, years from 50 on being 19yy."""
    century = F.when(F.substring(yymmdd, 1, 2).try_cast("int") >= 50, "19").otherwise("20")
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.concat(F.substring(yymmdd, 5, 2), F.lit("."), F.substring(yymmdd, 3, 2), F.lit("."), century, F.substring(yymmdd, 1, 2)))


def reconcile_key(field: Column, value: Column) -> Column:
    """The form in which a visible value and a zone's value are compared."""
    v = F.upper(value)
    digits = F.regexp_replace(v, r"\P{Nd}", "")
    date = F.when(F.length(digits) == 8, F.concat(F.substring(digits, 7, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2))).otherwise(digits)
    sex = F.when(v == "AYOL", "F").when(v == "ERKAK", "M").otherwise(v)
    plain = F.regexp_replace(v, "[^A-Z0-9]", "")
    return F.when(field.isin("date_of_birth", "date_of_expiry"), date).when(field == "sex", sex).when(field.isin("citizenship", "nationality") & v.contains("ZBEK"), "UZB").otherwise(plain)


def reconciled(visible: Column, zone: Column, field: Column, zone_field: Column) -> Column:
    return F.when(visible.isNull() | zone.isNull(), "not_run").when(reconcile_key(field, visible) == reconcile_key(zone_field, zone), "passed").otherwise("failed")


# Fixed values of ICAO 9303: by number and width of lines, the ranges that each check digit covers and its place, both in the lines joined.
DIGITS = {
    (2, 44): [([(44, 53)], 53), ([(57, 63)], 63), ([(65, 71)], 71), ([(72, 86)], 86), ([(44, 54), (57, 64), (65, 87)], 87)],
    (2, 36): [([(36, 45)], 45), ([(49, 55)], 55), ([(57, 63)], 63), ([(36, 46), (49, 56), (57, 71)], 71)],
    (3, 30): [([(5, 14)], 14), ([(30, 36)], 36), ([(38, 44)], 44), ([(5, 30), (30, 37), (38, 45), (48, 59)], 59)],
}
#: The digit of optional data may be left out, in lines of 44.
OPTIONAL = (2, 44, 86)


def digits_valid(lines: Column) -> Column:
    """Whether all check digits of a zone of any of the three shapes are right; null for other shapes, false where a checked part has an odd character."""
    z = F.array_join(lines, "")
    valid = F.lit(None).cast("boolean")
    for (n, width), digits in DIGITS.items():
        right = F.lit(True)
        for ranges, at in digits:
            digit = F.substring(z, at + 1, 1)
            same = F.coalesce(check_digit(F.concat(*(F.substring(z, a + 1, b - a) for a, b in ranges))) == digit, F.lit(False))
            right = right & ((digit == "<") | same if (n, width, at) == OPTIONAL else same)
        valid = F.when((F.size(lines) == n) & F.forall(lines, lambda x: F.length(x) == width), right).otherwise(valid)  # noqa: B023
    return valid
