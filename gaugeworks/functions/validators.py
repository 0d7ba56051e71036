"""Check digits and ranges of identifiers, as Columns. Texts are those that matched the identifier's pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what an odd place's sign counts in an Italian tax code, 0-9 then A-Z
ODD_VALUES = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: x.try_cast("int"))


def _doubled(d: Column) -> Column:
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def _luhn_sum(c: Column) -> Column:
    """Digits added from the right, every second doubled, its digits added."""
    return F.aggregate(
        F.transform(_digits(F.reverse(c)), lambda d, i: F.when(i % 2 == 1, _doubled(d)).otherwise(d)), F.lit(0), lambda s, x: s + x
    )


def _ok(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def credit_card(c: Column) -> Column:
    plain = F.translate(c, " -", "")
    return _ok(plain.rlike(r"\A[0-9]{13,19}\z") & (_luhn_sum(plain) % 10 == 0))


def piva_it(c: Column) -> Column:
    return _ok(c.rlike(r"\A[0-9]{11}\z") & (_luhn_sum(c) % 10 == 0))


def cap_it(c: Column) -> Column:
    return _ok(c.rlike(r"\A[0-9]+\z") & c.try_cast("int").between(10, 98168))


def codice_fiscale(c: Column) -> Column:
    odd = F.lit(list(ODD_VALUES))
    place = lambda x: F.instr(F.lit(_SIGNS), x)
    value = lambda x, i: F.when(i % 2 == 0, F.element_at(odd, F.greatest(place(x), F.lit(1)))).otherwise(F.when(place(x) > 10, place(x) - 11).otherwise(place(x) - 1))
    total = F.aggregate(F.transform(F.split(F.substring(c, 1, 15), ""), value), F.lit(0), lambda s, x: s + x)
    return _ok(c.rlike(r"\A[0-9A-Z]{16}\z") & (F.ascii(F.substring(c, 16, 1)) == 65 + total % 26))


def iban(c: Column) -> Column:
    """The first four signs moved to the end, letters as 10 to 35, the number's remainder by 97 is 1."""
    turned = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    place = lambda x: F.instr(F.lit(_SIGNS), x) - 1
    remainder = F.aggregate(
        F.transform(F.split(turned, ""), place), F.lit(0), lambda r, v: F.when(v < 10, (r * 10 + v) % 97).otherwise((r * 100 + v) % 97)
    )
    return _ok(c.rlike(r"\A[0-9A-Z]{5,34}\z") & (remainder == 1))


def ssn_us(c: Column) -> Column:
    plain = F.regexp_replace(c, "[^0-9]", "")
    part = lambda at, n: F.substring(plain, at, n).try_cast("int")
    return _ok((F.length(plain) == 9) & ~part(1, 3).isin(0, 666) & (part(1, 3) < 900) & (part(4, 2) != 0) & (part(6, 4) != 0))


def coordinates(c: Column) -> Column:
    """Latitude and longitude in range. ``12.345,67`` is a number with a decimal comma rather than a place."""
    parts = F.split(c, ",", 2)
    raw = F.get(parts, F.lit(1))
    latitude, longitude = F.trim(F.get(parts, F.lit(0))), F.trim(raw)
    comma_number = raw.rlike(r"\A[0-9]{2}\s*\z") & latitude.rlike(r"\A[+-]*[0-9]{1,3}\.[0-9]{3}\z")
    return _ok(~comma_number & latitude.try_cast("double").between(-90, 90) & longitude.try_cast("double").between(-180, 180))


def ipv6(c: Column) -> Column:
    """Eight groups of up to four hex digits, one run of them possibly left out, the last two possibly an IPv4 address."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"(?:{octet}\.){{3}}{octet}"
    short = F.regexp_replace(c, rf"(\A|:){v4}\z", "$10:0")  # as two groups
    group = "[0-9a-fA-F]{1,4}"
    halves = F.split(short, "::", 2)
    size = lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, ":")))
    whole = short.rlike(rf"\A{group}(?::{group}){{7}}\z")
    cut = short.rlike(rf"\A(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?\z") & (size(F.get(halves, F.lit(0))) + size(F.get(halves, F.lit(1))) <= 7)
    return _ok(whole | cut)
