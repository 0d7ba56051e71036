"""What a cell's text says: null, number, date, boolean. Each function takes and returns a Column.

Cells are judged as text, as in a CSV file. Patterns are anchored with ``\\z``: Java's ``$`` also matches before a last line
break. Casts are guarded by a pattern, as Spark's accept more than a number's text (``1d``, blanks around it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space, which is trimmed from cells.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NULL_TOKENS, BOOLEAN_TOKENS = ("", "null", "nan"), ("true", "false")

# fixed values: the date shapes of type inference, of validity checks and of mixed-format counts
INFERRED_DATES = (
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}",
    r"\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4}",
    r"\p{Nd}{2}-\p{Nd}{2}-\p{Nd}{4}",
    r"\p{Nd}{4}/\p{Nd}{2}/\p{Nd}{2}",
    r"\p{Nd}{2}\.\p{Nd}{2}\.\p{Nd}{4}",
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?",
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}",
    r"\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}",
)
VALID_DATES = (
    r"\p{Nd}{4}-\p{Nd}{1,2}-\p{Nd}{1,2}",
    r"\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{4}",
    r"\p{Nd}{1,2}-\p{Nd}{1,2}-\p{Nd}{4}",
    r"\p{Nd}{4}/\p{Nd}{2}/\p{Nd}{2}",
)
DATE_FORMATS = {
    "YYYY-MM-DD": r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}",
    "DD/MM/YYYY": r"\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4}",
    "DD-MM-YYYY": r"\p{Nd}{2}-\p{Nd}{2}-\p{Nd}{4}",
    "YYYY/MM/DD": r"\p{Nd}{4}/\p{Nd}{2}/\p{Nd}{2}",
}
# fixed values: signs of text that was decoded wrongly (the third has a soft hyphen)
ARTIFACTS = ("Ã¡", "Ã©", "Ã\u00ad", "Ã³", "Ãº", "Ã±", "Ã§")
# fixed values: the date shapes that a stream's text is judged by, as it stands; the last is a beginning
LIKE_DATES = (
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}\z",
    r"\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4}\z",
    r"\p{Nd}{2}-\p{Nd}{2}-\p{Nd}{4}\z",
    r"\p{Nd}{4}/\p{Nd}{2}/\p{Nd}{2}\z",
    r"\p{Nd}{2}\.\p{Nd}{2}\.\p{Nd}{4}\z",
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:",
)

#: How a text that is a date as it stands begins: year or day first, equal separators.
RAW_DATE = r"\A(?:[0-9]{4}([-/.])..\1|[0-9]{2}([-/.])..\2[0-9]{4})(?s:.*)\z"
_INTEGER = r"\A[+-]?[0-9]+\z"
_FLOAT = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_NAMED_FLOAT = r"\A[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])\z"


def one_of(*patterns: str) -> str:
    """A pattern for a whole text of any of these forms."""
    return rf"\A(?:{'|'.join(patterns)})\z"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_null_like(c: Column) -> Column:
    """Null, blank, or ``null`` or ``nan`` in any case. ``NA`` and the like are values."""
    return c.isNull() | F.lower(trimmed(c)).isin(*NULL_TOKENS)


def is_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin(*BOOLEAN_TOKENS), F.lit(False))


def is_integer(c: Column) -> Column:
    """An integer of 64 bits, signed or not."""
    value = c.try_cast("decimal(38,0)")
    # texts of up to 18 digits fit; a cast that fails costs more than all else
    fits = F.when(F.octet_length(c) <= 18, True).otherwise(value.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)")))
    return F.coalesce(F.when(c.rlike(_INTEGER), fits), F.lit(False))


def is_float(c: Column) -> Column:
    """A decimal number, an infinity or a NaN, without anything around it."""
    return F.coalesce(c.rlike(_FLOAT) | c.rlike(_NAMED_FLOAT), F.lit(False))


def number(c: Column) -> Column:
    """The finite number that the text says, untrimmed, or null."""
    value = F.when(c.rlike(_FLOAT), c.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def is_inferred_date(c: Column) -> Column:
    return F.coalesce(c.rlike(one_of(*INFERRED_DATES)), F.lit(False))


def looks_like_date(c: Column) -> Column:
    """Whether a text, untrimmed, has a date's shape or begins as a date with a time."""
    return F.coalesce(c.rlike(rf"\A(?:{'|'.join(LIKE_DATES)})"), F.lit(False))


def is_valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(one_of(*VALID_DATES)), F.lit(False))


def is_date(c: Column) -> Column:
    return F.coalesce(c.rlike(one_of(*INFERRED_DATES, *VALID_DATES)), F.lit(False))


def lexical_class(c: Column) -> Column:
    """``Numeric``, ``Date``, ``Boolean`` or ``Text``, the first that fits; null for null-like cells."""
    t = trimmed(c)
    return F.when(is_null_like(c), None).when(is_float(t), "Numeric").when(is_date(t), "Date").when(is_boolean(c), "Boolean").otherwise("Text")


def moment(c: Column) -> Column:
    """The local wall time that a date or datetime text says, or null. Day before month where both fit."""
    t = trimmed(c)

    clock, cast = r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}", lambda text: text.try_cast("timestamp")
    # a text of a known form is put as year-month-day, which a cast reads without a formatter
    year_first = F.when(t.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), cast(t)).when(
        t.rlike(rf"\A(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ]{clock}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{{2}}:[0-9]{{2}})|[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}(?:T{clock}(?:\.[0-9]+)?| {clock}))\z"),
        cast(F.regexp_replace(F.regexp_replace(t, r"(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})?\z", ""), "[Tt]", " ")),
    ).when(t.rlike(r"\A[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z"), cast(F.translate(t, "/", "-")))
    whole = r"\A([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})\z"
    day_first = F.when(t.rlike(whole), F.coalesce(cast(F.regexp_replace(t, whole, "$4-$3-$1")), F.when(F.contains(t, F.lit("/")), cast(F.regexp_replace(t, whole, "$4-$1-$3"))))).when(
        t.rlike(rf"\A[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} {clock}\z"), cast(F.regexp_replace(t, r"\A([0-9]+)/([0-9]+)/([0-9]+) (.*)\z", "$3-$2-$1 $4"))
    )
    # few texts begin like a date: the others aren't tried
    return F.when(t.rlike(r"\A[0-9]{1,2}[-/.]"), day_first).when(t.rlike(r"\A[0-9]{4}[-/]"), year_first)


def has_clock(c: Column) -> Column:
    """Whether a date text has a time of day."""
    return F.coalesce(trimmed(c).rlike(r"[0-9]:[0-9]"), F.lit(False))


def raw_moment(c: Column) -> Column:
    """As :func:`moment`, but for text as it stands: nothing around it, ten signs at least, equal separators."""
    return F.when((F.octet_length(c) >= 10) & (trimmed(c) == c) & c.rlike(RAW_DATE), moment(c))


def decimal_scale(c: Column) -> Column:
    """The decimals that a number's text really uses: trailing zeros don't count, an exponent shifts them."""
    digits = F.regexp_extract(c, r"\.([0-9]*)", 1)
    shift = F.coalesce(F.regexp_extract(c, r"[eE]([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))
    return F.when(c.rlike(_FLOAT), F.greatest(F.lit(0), F.length(F.regexp_replace(digits, "0+$", "")) - shift))


def rounded(c: Column, digits: int) -> Column:
    """Half away from zero on the binary double; numbers that aren't finite are null. Spark's round works on the decimal text."""
    k = float(10**digits)
    v = c.cast("double")
    up = F.floor(F.abs(v) * k)
    near = F.signum(v) * (up + F.when(F.abs(v) * k - up >= 0.5, 1).otherwise(0)) / k
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).when(F.abs(v) * k >= float(1 << 53), v).otherwise(near)


def has_encoding_artifact(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(("\ufffd", *ARTIFACTS))), F.lit(False))


def one_line(text: str) -> str:
    """Control signs of a value spelled out, for reports."""
    return "".join(ch if ch.isprintable() else ch.encode("unicode_escape").decode() for ch in text)
