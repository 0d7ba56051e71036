"""The catalogue of value patterns, and which of them a column shows.

Distinct values are matched once: each gets a bit mask of the patterns that it matches, and the masks are counted. Overlaps
of patterns and equal sets of rows follow from the masks' counts, of which there are few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import validators
from gaugeworks.functions.predicates import is_null_like, trimmed


@dataclass(frozen=True)
class PatternDef:
    name: str
    regex: str
    category: str
    specificity: int
    threshold: float
    locale: str | None = None
    validator: Callable[[Column], Column] | None = None

    @property
    def java(self) -> str:
        """The pattern for Java: digits and blanks of any script, the end of text rather than of the last line.

        Paths have a form of their own, as Java walks repeated groups by recursion, which long texts exhaust.
        """
        if self.name in PATHS:
            return PATHS[self.name]
        out, inside, k = [], False, 0
        while k < len(self.regex):
            ch = self.regex[k]
            if ch == "\\":
                sign = self.regex[k + 1]
                wide = {"d": r"\p{Nd}", "s": r"\s\p{Z}" if inside else r"[\s\p{Z}]"}
                out.append(wide.get(sign, ch + sign))
                k += 2
                continue
            inside = ch == "[" or (inside and ch != "]")
            out.append(r"\z" if ch == "$" and not inside else ch)
            k += 1
        return "".join(out)


#: The same paths without a repeated group: no empty part between two separators.
PATHS = {
    "File Path (Unix)": r"(?s)\A/[^/\x00](?!.*//)[^\x00]*\z",
    "File Path (Windows)": r"""\A[A-Z]:\\(?!\\)(?!.*\\\\)[^/:*?"<>|\r\n]*\z""",
}

# fixed values: names, patterns, categories, specificities, thresholds in percent, locales
CATALOGUE: tuple[PatternDef, ...] = (
    PatternDef("Email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "contact", 80, 3.0),
    PatternDef("Phone (US)", r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$", "contact", 70, 5.0, "US"),
    PatternDef("Phone (IT)", r"^(?:\+39|0039)[-.\s]?(?:0[0-9]{1,3}|3[0-9]{2})[-.\s]?[0-9]{5,8}$", "contact", 70, 5.0, "IT"),
    PatternDef("URL", r"^(?:https?|ftps?)://[^\s/$.?#].[^\s]*$", "network", 70, 5.0),
    PatternDef("UUID", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "identifier", 85, 3.0),
    PatternDef("IPv4", r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$", "network", 65, 3.0),
    PatternDef("IPv6", r"^[0-9a-fA-F]*:[0-9a-fA-F:.]*$", "network", 75, 3.0, None, validators.ipv6),
    PatternDef("MAC Address", r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$", "network", 80, 5.0),
    PatternDef("Geographic Coordinates", r"^[-+]?([1-8]?\d(\.\d+)?|90(\.0+)?),\s*[-+]?(180(\.0+)?|((1[0-7]\d)|([1-9]?\d))(\.\d+)?)$", "geographic", 75, 5.0, None, validators.coordinates),
    PatternDef("IBAN", r"^[A-Z]{2}\d{2}[A-Z0-9]{1,30}$", "financial", 90, 5.0, None, validators.iban),
    PatternDef("Codice Fiscale (IT)", r"^[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]$", "identifier", 95, 5.0, "IT", validators.codice_fiscale),
    PatternDef("P.IVA (IT)", r"^\d{11}$", "identifier", 40, 25.0, "IT", validators.piva_it),
    PatternDef("CAP (IT)", r"^\d{5}$", "geographic", 35, 20.0, "IT", validators.cap_it),
    PatternDef("ZIP Code (US)", r"^\d{5}(-\d{4})?$", "geographic", 35, 15.0, "US"),
    PatternDef("File Path (Unix)", r"^(/[^/\x00]+)+/?$", "file_path", 30, 10.0),
    PatternDef("File Path (Windows)", r"""^[A-Z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*$""", "file_path", 30, 10.0),
    PatternDef("Credit Card", r"^[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{1,4}$", "financial", 60, 10.0, None, validators.credit_card),
    PatternDef("SSN (US)", r"^\d{3}-?\d{2}-?\d{4}$", "identifier", 70, 10.0, "US", validators.ssn_us),
    PatternDef("UK Postcode", r"^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$", "geographic", 50, 15.0, "GB"),
    PatternDef("German PLZ", r"^\d{5}$", "geographic", 30, 20.0, "DE"),
    PatternDef("Canadian Postal Code", r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$", "geographic", 50, 15.0, "CA"),
    PatternDef("French Code Postal", r"^\d{5}$", "geographic", 30, 20.0, "FR"),
    PatternDef("Hex Color", r"^#[0-9a-fA-F]{6}$", "other", 60, 10.0),
    PatternDef("SWIFT/BIC", r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$", "financial", 75, 10.0),
    PatternDef("Currency", r"^[$€£¥₹]\s?-?\d{1,3}([,.\s]\d{3})*([.,]\d{1,2})?$|^-?\d{1,3}([,.\s]\d{3})*([.,]\d{1,2})?\s?[$€£¥₹]$", "other", 40, 15.0),
    PatternDef("Percentage", r"^-?\d+([.,]\d+)?\s?%$", "other", 35, 15.0),
    PatternDef("Alphanumeric Code", r"^[A-Z]{2,}[_-]\d{2,}$", "identifier", 15, 30.0),
    PatternDef("Scientific Notation", r"^[-+]?\d+(\.\d+)?[eE][-+]?\d+$", "other", 20, 20.0),
    PatternDef("Labeled Identifier", r"^[A-Za-z]+[_-][A-Za-z0-9]+$", "identifier", 10, 35.0),
    PatternDef("Date (ISO)", r"^\d{4}-\d{2}-\d{2}$", "other", 50, 5.0),
    PatternDef("Date (EU slash)", r"^\d{2}/\d{2}/\d{4}$", "other", 50, 5.0),
    PatternDef("Date (EU dash)", r"^\d{2}-\d{2}-\d{4}$", "other", 50, 5.0),
    PatternDef("Date (YYYY/MM/DD)", r"^\d{4}/\d{2}/\d{2}$", "other", 50, 5.0),
    PatternDef("Date (EU dot)", r"^\d{2}\.\d{2}\.\d{4}$", "other", 50, 5.0),
    PatternDef("DateTime (ISO)", r"^\d{4}-\d{2}-\d{2}T\d{2}:", "other", 55, 5.0),
)

# fixed values: countries' alpha-2 and alpha-3 codes that a locale may name
LOCALES = {"US": "USA", "IT": "ITA", "GB": "GBR", "DE": "DEU", "CA": "CAN", "FR": "FRA"}


def parse_locale(tag: str | None) -> str | None:
    """The country of a tag like ``it``, ``ITA``, ``it-IT`` or ``it_IT``; None for a blank one."""
    if tag is None or not tag.strip():
        return None
    parts = tag.strip().replace("_", "-").split("-")
    code = parts[-1].upper()
    by_long = {v: k for k, v in LOCALES.items()}
    if len(parts) > 2 or (code not in LOCALES and code not in by_long):
        raise ValueError(f"unknown locale {tag!r}: one of {', '.join(sorted(LOCALES))} is meant")
    return by_long.get(code, code)


def list_patterns(locale: str | None = None) -> list[dict]:
    """The catalogue: with a locale, its patterns and those of no locale."""
    wanted = parse_locale(locale)
    return [
        {"name": p.name, "regex": p.regex, "category": p.category, "locale": p.locale, "min_threshold": p.threshold}
        for p in CATALOGUE
        if wanted is None or p.locale in (None, wanted)
    ]


#: The patterns that a number's text can match: of digits with one dot, and of digits alone. The others have other signs.
DECIMAL_PATTERNS = ("Phone (US)",)
DIGIT_PATTERNS = ("Phone (US)", "Phone (IT)", "P.IVA (IT)", "CAP (IT)", "ZIP Code (US)", "Credit Card", "SSN (US)", "German PLZ", "French Code Postal")


def match_mask(t: Column) -> Column:
    """Bit k is set if the trimmed value matches pattern k; patterns with a validator have another bit for values that pass it."""

    def bits(names: tuple[str, ...] | None = None) -> Column:
        mask = F.lit(0).cast("long")
        for k, p in enumerate(CATALOGUE):
            if names is None or p.name in names:
                hit = F.when(t.rlike(p.java), F.when(p.validator(t), (1 << k) | (1 << _checked(k))).otherwise(1 << k)) if p.validator else F.when(t.rlike(p.java), 1 << k)
                mask = mask.bitwiseOR(F.coalesce(hit, F.lit(0)).cast("long"))
        return mask

    # no pattern has a blank right after letters: most prose is settled by its first word
    return (
        F.when(t.rlike(r"\A-?[0-9]+\.[0-9]+\z"), bits(DECIMAL_PATTERNS))
        .when(t.rlike(r"\A-?[0-9]+\z"), bits(DIGIT_PATTERNS))
        .when(t.rlike(r"\A[A-Za-z]+[,.]? "), F.lit(0).cast("long"))
        .otherwise(bits())
    )


_WITH_VALIDATOR = [k for k, p in enumerate(CATALOGUE) if p.validator]


def _checked(k: int) -> int:
    return len(CATALOGUE) + _WITH_VALIDATOR.index(k)


def mask_counts(frequencies: DataFrame) -> DataFrame:
    """For ``column``, ``value`` and ``n`` the counts of masks: ``column``, ``mask``, ``n``. Null-like values don't count."""
    values = frequencies.where(~is_null_like(F.col("value"))).withColumn("value", trimmed(F.col("value")))
    return values.groupBy("column", match_mask(F.col("value")).alias("mask")).agg(F.sum("n").alias("n"))


def confidence(specificity: int, percentage: float, pass_rate: float) -> float:
    return min(1.0, max(0.0, specificity / 100 * min(1.0, max(0.0, percentage / 50)) * pass_rate))


def detect(masks: dict[int, int], locale: str | None = None) -> list[dict]:
    """The patterns that a column's mask counts show, the surest first."""
    total = sum(masks.values())
    if not total:
        return []
    country, found = parse_locale(locale), []
    for k, p in enumerate(CATALOGUE):
        count = sum(n for m, n in masks.items() if m >> k & 1)
        share = count / total * 100
        if share > p.threshold:
            passed = sum(n for m, n in masks.items() if m >> _checked(k) & 1) / count if p.validator else 1.0
            if passed > 0:
                found.append((k, p, count, share, passed))
    # a more specific pattern that has four fifths of another's rows explains it
    hidden: set[int] = set()
    for k, p, *_ in sorted(found, key=lambda x: -x[1].specificity):
        if k in hidden:
            continue
        for other, q, count, *_ in found:
            if other not in hidden and q.specificity < p.specificity and sum(n for m, n in masks.items() if m >> k & 1 and m >> other & 1) / count >= 0.8:
                hidden.add(other)
    found = [x for x in found if x[0] not in hidden]
    rows_of = {k: frozenset(m for m in masks if m >> k & 1) for k, *_ in found}
    out = []
    for k, p, count, share, passed in found:
        sure = confidence(p.specificity, share, passed)
        if country:
            if p.locale not in (None, country):
                continue
            if p.locale:
                sure = min(1.0, sure * 1.2)
                if share >= 80 and passed >= 0.8:
                    sure = max(sure, 0.5)
        elif p.locale:
            rivals = {p.locale} | {q.locale for j, q, *_ in found if q.locale and q.category == p.category and rows_of[j] == rows_of[k]}
            sure *= 0.75 / len(rivals)
        out.append({"name": p.name, "regex": p.regex, "match_count": count, "match_percentage": share, "category": p.category, "confidence": sure})
    return sorted(out, key=lambda x: -x["confidence"])
