"""Values read beside the box numbers of a licence, in the two older cleaners' forms, and the shape of a raw zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.columns import bound

# The number printed before each field, for the wide and for the narrow cleaner.
WIDE = {"surname": "1", "given_names": "2", "birth_place_and_date": "3", "issue_date": "4a", "expiry_date": "4b", "issued_place": "4c", "personal_id": "4d", "license_number": "5", "address": "8", "categories": "9"}
NARROW = {"surname": "1", "given_names": "2", "birth_place": "3", "birth_date": "3", "issue_date": "4a", "expiry_date": "4b", "issuer": "4c", "personal_id": "4d", "license_number": "5", "address": "8", "categories": "9"}
# Fixed value: a date with the day first.
DATE = r"(?U)\b(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})\b"


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def spaced(value: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def alphanumeric(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def dotted_date(value: Column) -> Column:
    """The first date as dd.mm.yyyy; null for none. The calendar isn't asked."""
    part = lambda n: F.regexp_extract(value, DATE, n)
    return F.when(value.rlike(DATE), F.concat_ws(".", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3)))


def _unnumbered(field: Column, value: Column, numbers: dict[str, str], pattern) -> Column:
    """``value`` without its field's number; fields that have none keep theirs."""
    out = F
    for number in dict.fromkeys(numbers.values()):
        out = out.when(field.isin([f for f, n in numbers.items() if n == number]), F.regexp_replace(value, pattern(number), ""))
    return out.otherwise(value)


def wide_value(field: Column, value: Column) -> Column:
    """Struct (value, date). Numbers go with any blanks and stops around them; dates as dd.mm.yyyy, personal ids as digits, licence and serial numbers as letters and digits, categories in upper case.

    ``birth_place_and_date`` gives the place before its first date, and the date; other fields have none. Nothing left is null.
    """
    bare = stripped(_unnumbered(field, stripped(value), WIDE, lambda n: r"(?iU)^\s*" + r"\s*".join(n) + r"[.\s:,-]*"))

    def cleaned(v: Column) -> Column:
        date = dotted_date(v)
        place = F.when(date.isNull(), v).otherwise(F.regexp_extract(v, rf"(?s)^(.*?){DATE}", 1))
        text = F.when(field.isin("issue_date", "expiry_date"), date).when(field == "personal_id", F.regexp_replace(v, r"\P{Nd}", "")).when(field.isin("license_number", "serial_number"), alphanumeric(v))
        text = text.when(field == "categories", spaced(F.upper(v))).when(field == "birth_place_and_date", spaced(place)).otherwise(spaced(v))
        return F.struct(F.nullif(text, F.lit("")).alias("value"), F.when(field == "birth_place_and_date", date).alias("date"))

    return bound(bare, cleaned)


def narrow_value(field: Column, value: Column) -> Column:
    """Numbers go only where they stand first; dates lose their spaces and numbers all but letters and digits. Null where nothing but the number was there."""
    bare = stripped(_unnumbered(field, value, NARROW, lambda n: rf"(?iU)^{n}[.\s]*"))
    text = lambda v: F.when(field.isin("birth_date", "issue_date", "expiry_date"), F.replace(v, F.lit(" "), F.lit(""))).when(field.isin("personal_id", "license_number"), alphanumeric(v)).otherwise(spaced(v))
    return bound(bare, lambda v: F.when(v != "", text(v)))


def centre_inside(box: Column, region: Column, width: int, height: int) -> Column:
    """Whether a pixel box's centre lies in a region given in shares of the page, its edges cut down to whole pixels and included."""
    edge = lambda c, n: F.floor(region[c] * n)
    return ((box["x1"] + box["x2"]) / 2).between(edge("x1", width), edge("x2", width)) & ((box["y1"] + box["y2"]) / 2).between(edge("y1", height), edge("y2", height))


def zone_shape(raw: Column) -> Column:
    """Struct (line_count, lines, looks_like_td3) of a zone as read: its lines that aren't blank, each with its length; nothing is repaired. Null has no lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\R"), stripped), lambda x: x != "")
    shape = lambda ls: F.struct(F.size(ls).alias("line_count"), F.transform(ls, lambda x: F.struct(x.alias("text"), F.length(x).alias("length"))).alias("lines"), ((F.size(ls) == 2) & F.forall(ls, lambda x: F.length(x) == 44)).alias("looks_like_td3"))
    return bound(lines, shape)
